"""URL rules in sorted digest arrays.

A rule is a host and a path prefix with a verdict. The rules are compiled, in Spark, to shards of
sorted 64-bit xxhash keys with the full rule strings beside them; each shard is one pair of ``.npy``
style files in the shared folder. Tasks memory-map the shards, probe the keys of all host suffixes
and path prefixes of a batch of URLs by vectorised binary search, and confirm hits on the stored
strings, so equal digests of different strings do no harm.

The project's manifests name files, not web addresses, so the functions take any id and URL column.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.llm.common import id_type, kept_in_worker, rows_of, shared_folder

RULES_PER_SHARD = 1_000_000
VERDICTS = ("allow", "block")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first ``://`` up to / ? # with A-Z lowered, the path up to ? #."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner


class DigestArray:
    """One shard: sorted keys, and for each key its rule string and verdict."""

    def __init__(self, path: str):
        self.keys = self._mapped(f"{path}.keys", np.uint64)
        self.ends = self._mapped(f"{path}.ends", np.int64)
        self.verdicts = self._mapped(f"{path}.verdicts", np.uint8)
        self.text = self._mapped(f"{path}.text", np.uint8)

    @staticmethod
    def _mapped(path: str, kind) -> np.ndarray:
        fs, inner = _open(path)
        if fs.get_file_info(inner).size == 0:
            return np.zeros(0, kind)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(inner, kind, "r")
        with fs.open_input_file(inner) as file:  # stores that cannot be mapped are read once per worker
            return np.frombuffer(file.read(), kind)

    def stored(self, at: int) -> bytes:
        return self.text[self.ends[at - 1] if at else 0:self.ends[at]].tobytes()

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last place of every key."""
        return np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")


def _key(rule: bytes) -> int:
    return xxhash.xxh64_intdigest(rule)


def compile_rules(rules: DataFrame, host_col: str = "host", path_col: str = "path", verdict_col: str = "verdict") -> dict:
    """Write the digest arrays; returns their paths and the distinct path lengths, both small.

    Null hosts or paths count as empty strings; of repeated rules one stays, block before allow. Verdicts
    other than ``allow`` and ``block`` raise an error.
    """
    spark, folder = rules.sparkSession, shared_folder(rules.sparkSession, "url-rules")
    clean = (rules.select(F.coalesce(F.translate(F.col(host_col), UPPER, UPPER.lower()), F.lit("")).alias("host"),
                          F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(verdict_col).alias("verdict"))
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.min("verdict").alias("low")))
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths"),
                      F.max((~F.col("verdict").isin(*VERDICTS) | ~F.col("low").isin(*VERDICTS)
                             | F.col("low").isNull()).cast("int")).alias("bad")).first()
    if facts["bad"]:
        raise ValueError(f"verdicts must be one of {VERDICTS}")
    shards = max(1, -(-facts["n"] // RULES_PER_SHARD))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, host, path, verdict in rows_of(batch, "shard", "host", "path", "verdict"):
                rule = f"{host}\n{path}".encode()
                held.setdefault(shard, []).append((_key(rule), rule, VERDICTS.index(verdict)))
        for shard, found in held.items():
            found.sort()
            arrays = {"keys": np.array([f[0] for f in found], np.uint64), "ends": np.cumsum([len(f[1]) for f in found], dtype=np.int64),
                      "verdicts": np.array([f[2] for f in found], np.uint8),
                      "text": np.frombuffer(b"".join(f[1] for f in found), np.uint8)}
            fs, inner = _open(f"{folder}/{shard}")
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            for name, array in arrays.items():
                with fs.open_output_stream(f"{inner}.{name}") as file:
                    file.write(io.BytesIO(array.tobytes()).getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{shard}"])], ["shard_path"])

    dealt = clean.withColumn("shard", F.pmod(F.xxhash64("host", "path"), F.lit(shards))).select("shard", "host", "path", "verdict")
    paths = [r[0] for r in dealt.repartition(shards, "shard").mapInArrow(write, "shard_path string").collect()]
    return {"paths": sorted(paths), "lengths": sorted(facts["lengths"])}


def _prober(compiled: dict, otherwise: str):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [kept_in_worker(f"digests {p}", lambda p=p: DigestArray(p)) for p in compiled["paths"]]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                places = [split_url(u) for (u,) in rows_of(part, "url")]
                owner, tried = [], []
                for i, (host, path) in enumerate(places):
                    suffix = host
                    while True:
                        for n in compiled["lengths"]:
                            if n <= len(path):
                                owner.append(i)
                                tried.append(f"{suffix}\n{path[:n]}".encode("utf-8", "surrogatepass"))
                        _, dot, suffix = suffix.partition(".")
                        if not dot:
                            break
                keys = np.fromiter(map(_key, tried), np.uint64, len(tried))
                best: dict[int, tuple[int, int, bytes, int]] = {}
                for shard in shards:
                    lo, hi = shard.probe(keys)
                    for k in np.flatnonzero(lo < hi).tolist():
                        for place in range(lo[k], hi[k]):
                            rule = tried[k]
                            if shard.stored(place) == rule:
                                host_size = rule.index(b"\n")
                                found = (len(rule), host_size, rule, int(shard.verdicts[place]))
                                best[owner[k]] = max(best.get(owner[k], found), found)
                rules = [best[i][2].decode().replace("\n", "", 1) if i in best else None for i in range(len(places))]
                verdicts = [VERDICTS[best[i][3]] if i in best else otherwise for i in range(len(places))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([h for h, _ in places]), pa.array([p for _, p in places]),
                     pa.array(rules, pa.string()), pa.array(verdicts)], ["id", "host", "path", "rule", "verdict"])

    return probe


def filter_urls(records: DataFrame, rules: DataFrame, id_col: str = "dataset", url_col: str = "url",
                otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``records``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains when the
    URL's path starts with the rule's path; the longest fitting rule (host and path together, in bytes) wins,
    the one with the longer host on ties. ``rule`` is host and path of the rule, null where none fits;
    ``verdict`` is then ``otherwise``. Null URLs and URLs without ``://`` have empty host and path and can
    only meet a rule with both empty. Ids are passed on as they are; other columns are not read.
    """
    urls = records.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    out = urls.mapInArrow(_prober(compile_rules(rules), otherwise),
                          f"id {id_type(urls, 'id')}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
