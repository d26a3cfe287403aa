"""Shared pieces of the corpus operators: stored tables, words, packed numbers, components.

Words are maximal runs of characters other than blank, tab, line feed, vertical tab, form feed
and carriage return, which is what ``bytes.split`` cuts on. A word is stood for by its 64-bit
xxhash, kept in a bounded cache.
"""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molq.session import ensure_checkpoint_dir

CACHE_WORDS = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)
TEXTS_AT_ONCE = 512
BATCH_BYTES = str(8 << 20)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_made: list[tuple[str, str | None]] | None = None


def remember_made(path: str, table: str | None = None) -> None:
    if _made is not None:
        _made.append((path, table))


@contextmanager
def freed_afterwards(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes what is stored inside of the block at its end, but for what the given function stores.

    For a step that is over when its result is written: later steps read that result only."""
    global _made
    before, _made = _made, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        _made.pop()
        return out

    try:
        yield kept
    finally:
        made, _made = _made, before
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path, table in made:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so lost executors can re-read it."""
    path = shared_folder(df.sparkSession, name)
    remember_made(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded by 8 MB, so that long texts do not pile up in a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def kept_in_worker(key: str, make: Callable[[], object]) -> object:
    """An object that later tasks of the same Python worker find again."""
    held = sys.modules.setdefault("_molq_worker", types.ModuleType("_molq_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Hand freed memory back to the system, so that a reused worker starts its next task small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives its memory back at the end of the task."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


class Remembered(dict):
    """A bounded cache of ``compute(key)`` in two generations: what is not asked for again goes first."""

    def __init__(self, compute: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class WordHashes(dict):
    """word bytes -> 64-bit hash; forgets everything when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for every run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out *= MIX
        out += words[j:j + n]
        out ^= out >> np.uint64(29)
    return out


def rows_of(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Python values row by row, a bounded slice at a time."""
    for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
        part = batch.slice(start, TEXTS_AT_ONCE)
        yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of one key at a time, from a partition that is sorted by ``key``."""
    held: list[dict] = []
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            for row in batch.slice(start, TEXTS_AT_ONCE).to_pylist():
                if held and held[0][key] != row[key]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


class Forest:
    """Union-find over positions; the smallest position of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _edge_state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v).

    Large-star and small-star alternate until nothing changes: large-star hangs every larger
    neighbour of a node on the smallest one, small-star does so with the smaller ones. Minima are
    partially aggregated before the shuffle and joined back, so no node's neighbours are ever
    gathered in one row. Nodes without an edge are absent; nulls and self-loops are ignored.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, state = stored(pairs.distinct(), "edges"), None
    while True:
        after = _edge_state(now)
        if after == state:
            break
        state = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = stored(small, "edges")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def sample_per_group(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(key, group): of every group the ``n`` keys of lowest hash, stored; at most n rows per group.

    Group counts give a hash bound under which about four times as many keys lie, so only those are put
    in order, however large a group is."""
    keys = rows.select(key, group).distinct().withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << 32)))
    sizes = keys.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    low = keys.join(stored(sizes, "sizes"), group).where(F.col("_h") * F.col("_n") < float(4 * n + 40) * (1 << 32))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_h", key))
    return stored(low.withColumn("_place", place).where(F.col("_place") <= n).select(key, group), "sample")
