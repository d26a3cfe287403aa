"""Near-duplicate entities by MinHash over the sequence of features written as text.

An entity (a cell, a sample sheet, a document) is one row with an id and a text of feature names
in order. Its set holds the distinct runs of ``width`` consecutive words, lower-cased (A-Z only).

1. Every entity gets ``bands * rows`` minima of universal hash functions (multiply-add modulo
   2**64 with odd multipliers); ``rows`` minima make one band key.
2. Entities with the same full set are one class, stood for by its smallest id.
3. Classes that share a band key are candidates; star links to the smallest member of each band
   bucket and large-star / small-star give candidate clusters, which need no cap.
4. A cluster is cut into blocks of bounded total set size. Each pair of blocks is one group:
   an inverted index counts all intersections, and a group hands on only a spanning forest of
   its confirmed links, never the pairs.
5. Large-star / small-star over the confirmed links give the components.

With 24 bands of 5 rows a pair of similarity 0.85 is missed with probability 8e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.llm.common import (Forest, WordHashes, components, frugal, id_type, in_small_batches, rows_of, sorted_groups, stored,
                             window_hashes)
from molq.session import shuffle_width

BANDS, ROWS = 24, 5
BLOCK_SHINGLES = 400_000


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words make one run."""
    words = hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words


def set_key(packed: bytes) -> bytes | None:
    return hashlib.blake2b(packed, digest_size=16).digest() if packed else None


def _signer(id_col: str, text_col: str, width: int, bands: int, rows: int, seed: int):
    draw = np.random.default_rng(seed)
    scale = draw.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def minima(ids: np.ndarray) -> np.ndarray:
        low = np.full(len(scale), np.uint64(2**64 - 1))
        for start in range(0, len(ids), 1024):
            hashed = np.multiply.outer(scale, ids[start:start + 1024])
            hashed += shift[:, None]
            np.minimum(low, hashed.min(axis=1), out=low)
        return low

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, banded = [], [], []
            for (text,) in rows_of(batch, text_col):
                ids = shingle_set(text, width, hashes)
                sizes.append(len(ids))
                if not len(ids):
                    keys.append(None)
                    banded.append([])
                    continue
                keys.append(set_key(ids.tobytes()))
                low = minima(ids).reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(rows):
                    key = (key ^ (low[:, j] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + low[:, j]
                banded.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(banded, pa.list_(pa.int64()))], ["id", "n_shingles", "set_key", "bands"])

    return frugal(sign)


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            packed = [shingle_set(text, width, hashes).tobytes() for (text,) in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(p) for p in packed], pa.binary()),
                                              pa.array(packed, pa.binary())], ["set_key", "ids"])

    return frugal(sets)


def _linker(percent: int, id_arrow: pa.DataType):
    """Links inside one block (first == second) or between two blocks of a cluster."""

    def links_of(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: (r["block"], r["id"]))
        sets = [np.frombuffer(r["ids"], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets])
        n, across = len(rows), rows[0]["first"] != rows[0]["second"]
        border = sum(r["block"] == rows[0]["first"] for r in rows) if across else 0
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(code, kind="stable")
        holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
        ends = np.cumsum(size)
        forest, found = Forest(n), []
        for x in range(border if across else n - 1):
            mine = code[ends[x] - size[x]:ends[x]]
            first, count = starts[mine], starts[mine + 1] - starts[mine]
            if count.sum() == len(mine):
                continue
            at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            shared = np.bincount(holders[at], minlength=n)
            low = border if across else x + 1
            near = np.flatnonzero(100 * shared[low:] >= percent * (size[x] + size[low:] - shared[low:])) + low
            found += [(rows[x]["id"], rows[y]["id"]) for y in near.tolist() if forest.join(x, y)]
        return found

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "task"):
            if len(rows) > 1 and (found := links_of(rows)):
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], id_arrow) for i in (0, 1)],
                                                 ["u", "v"])

    return frugal(link)


def confirmed_links(texts: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Spanning links (u, v) of the similar pairs of ``clusters`` (id, set_key, cluster, n_shingles)."""
    kind = id_type(texts, "id")
    sizes = clusters.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = (clusters.join(sizes, "cluster")
              .withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")))
    chosen = texts.join(placed.select("id").distinct(), "id")
    packed = stored(chosen.mapInArrow(_setter(width), "set_key binary, ids binary")
                    .join(placed.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"]), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (placed.select("id", "set_key", "cluster", "block", other)
             .select("id", "set_key", "block", "cluster", F.least("block", "other").alias("first"),
                     F.greatest("block", "other").alias("second"))
             .withColumn("task", F.xxhash64("cluster", "first", "second")))
    wide = dealt.join(packed, "set_key").select("task", "id", "block", "first", "second", "ids")
    grouped = wide.repartition(shuffle_width(wide), "task").sortWithinPartitions("task")
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    return grouped.mapInArrow(_linker(percent, arrow), f"u {kind}, v {kind}")


def near_duplicate_entities(entities: DataFrame, entity_col: str = "cell_id", features_col: str = "features",
                            width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                            seed: int = 11) -> DataFrame:
    """(entity, n_shingles, component_id, kept) for every row of ``entities``.

    Two entities are linked when 100 * intersection >= percent * union of their full sets;
    ``component_id`` is the smallest id reachable, ``kept`` marks the entity that stands for its
    component. Only ``entity_col`` (string, int or bigint) and ``features_col`` are read, so further
    columns of any name do no harm. Null or wordless text: empty set, linked with nothing. Null id: takes
    no part, component null, kept. Repeated rows are copies of each other and all carry the smallest
    id; an id that comes with several texts is judged row by row. An empty table gives an empty result.
    """
    texts = in_small_batches(entities).select(F.col(entity_col).alias("id"), F.col(features_col).alias("text"))
    kind = id_type(texts, "id")
    signed = stored(texts.mapInArrow(
        _signer("id", "text", width, bands, rows, seed),
        f"id {kind}, n_shingles bigint, set_key binary, bands array<bigint>"), "signatures")
    known = signed.where("id is not null and set_key is not null")
    classes = stored(known.groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    standing = (known.join(classes, "set_key").where("id = rep")
                .select("id", "set_key", "n_shingles", "bands").dropDuplicates(["set_key"]))
    members = standing.select("id", F.posexplode("bands").alias("band", "key")).select(
        "id", F.xxhash64("band", "key").alias("bucket"))
    lowest = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    stars = members.join(lowest, "bucket").where("id > low").select(F.col("low").alias("u"), F.col("id").alias("v"))
    clusters = components(stars).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    sized = stored(clusters.join(standing.select("id", "set_key", "n_shingles"), "id"), "clusters")
    links = confirmed_links(texts.where("id is not null"), sized, width, percent)
    found = components(links).select(F.col("node").alias("rep"), "component")
    reps = classes.join(found, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"))
    return (signed.drop("bands").join(reps, "set_key", "left")
            .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
            .select(F.col("id").alias(entity_col), "n_shingles", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))
