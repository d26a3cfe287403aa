"""Pair work on sparse rows as blocked matrix products inside tasks.

Emitting every feature pair of every context would multiply the data; here each task turns a
batch of contexts into a small dense block and multiplies. Features are cut into blocks of
``BLOCK`` codes, so memory per task is one block pair, whatever the vocabulary. Contexts stay
partitioned by Spark, and what leaves a task is already aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molq.functions.ordering import dense_index
from molq.session import cut_lineage, shuffle_width

BLOCK = 1024
ROWS = 2048
OUT_ROWS = 1 << 18
SHARD_ROWS = 16384
# A feature in at least one of HEAVY_SHARE contexts pays for its place in a dense block: below that, a product of
# two blocks costs more than counting the few pairs that are there.
HEAVY_SHARE = 40
PIECE_PAIRS = 1 << 22


def feature_index(features: DataFrame) -> DataFrame:
    """(feature_name, g): dense codes in name order. One row per distinct feature, so the
    unpartitioned window sorts the vocabulary only, never the data."""
    names = features.select(F.col("feature_name").cast("string").alias("feature_name")).distinct()
    return names.withColumn("g", (F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy("feature_name")) - 1).cast("int"))


def frequency_index(presence: DataFrame) -> DataFrame:
    """(feature_name, k, g): dense codes by falling number of contexts, ties by name, so frequent features
    share blocks. Numbered by ranges; no task sees the whole vocabulary."""
    marg = presence.groupBy(F.col("feature_name").cast("string").alias("feature_name")).agg(
        F.count(F.lit(1)).alias("k"))
    return dense_index(marg, [F.desc("k"), F.asc("feature_name")], "g").withColumn("g", F.col("g").cast("int"))


def context_rows(presence: DataFrame, index: DataFrame, value: str | None = None) -> DataFrame:
    """One row per context with its feature codes (and values), i.e. a distributed CSR matrix.
    Presence holds a context's feature once, so a row is bounded by the vocabulary."""
    coded = presence.join(index, "feature_name").select(
        "context", "g", *([] if value is None else [F.col(value).cast("double").alias("w")]))
    if value is None:
        return coded.groupBy("context").agg(F.sort_array(F.collect_list("g")).alias("genes"))
    packed = F.sort_array(F.collect_list(F.struct("g", "w")))
    return coded.groupBy("context").agg(packed.alias("p")).select(
        "context", F.col("p.g").alias("genes"), F.col("p.w").alias("vals"))


def block_pairs(rows: DataFrame, with_values: bool = False) -> DataFrame:
    """Split each context row over its feature-block pairs (bi <= bj)."""
    blocks = F.array_distinct(F.transform("genes", lambda g: (g / BLOCK).cast("int")))
    split = rows.withColumn("_bs", blocks).withColumn("bi", F.explode("_bs"))
    split = split.withColumn("bj", F.explode(F.filter("_bs", lambda b: b >= F.col("bi"))))
    mine = lambda col, side: F.filter(
        F.col(col), lambda g: (g / BLOCK).cast("int") == F.col(side))
    offs = lambda side: F.transform(mine("genes", side), lambda g: g - F.col(side) * BLOCK)
    out = split.withColumns({"a": offs("bi"), "b": offs("bj")})
    if with_values:
        pairs = F.arrays_zip("genes", "vals")
        vals = lambda side: F.transform(F.filter(
            pairs, lambda p: (p["genes"] / BLOCK).cast("int") == F.col(side)), lambda p: p["vals"])
        out = out.withColumns({"av": vals("bi"), "bv": vals("bj")})
    return out.drop("_bs", "genes", "vals")


def block_pair_shards(rows: DataFrame, per_shard: int | None = None) -> DataFrame:
    """(bi, bj, shards): how many shards the rows of a block pair need. One small row per block pair."""
    blocks = F.array_distinct(F.transform("genes", lambda g: (g / BLOCK).cast("int")))
    one = rows.select(blocks.alias("bs")).withColumn("bi", F.explode("bs"))
    pairs = one.select("bi", F.explode(F.filter("bs", lambda b: b >= F.col("bi"))).alias("bj"))
    return pairs.groupBy("bi", "bj").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_shard or SHARD_ROWS)).cast("int").alias("shards"))


def _ragged(column: pa.Array, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row numbers of list rows start..stop."""
    part = column.slice(start, stop - start)
    flat = part.flatten().to_numpy(zero_copy_only=False)
    lengths = part.value_lengths().to_numpy(zero_copy_only=False)
    return flat, np.repeat(np.arange(stop - start), lengths)


def _dense(flat, rows, n: int, width: int, values=None) -> np.ndarray:
    out = np.zeros((n, width), dtype=np.float64)
    out[rows, flat] = 1.0 if values is None else values
    return out


def _runs(batch: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[tuple, int, int]]:
    """Consecutive rows with equal keys, in pieces of at most ROWS rows."""
    n = batch.num_rows
    if n == 0:
        return
    cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    for s, e in zip(starts, np.append(starts[1:], n)):
        key = tuple(int(c[s]) for c in cols)
        for lo in range(s, e, ROWS):
            yield key, lo, min(lo + ROWS, e)


def _grown(acc: np.ndarray | None, shape: tuple[int, ...]) -> np.ndarray:
    if acc is None:
        return np.zeros(shape)
    want = tuple(max(a, b) for a, b in zip(acc.shape, shape))
    if want == acc.shape:
        return acc
    out = np.zeros(want)
    out[tuple(slice(0, s) for s in acc.shape)] = acc
    return out


def _width(flat: np.ndarray) -> int:
    return int(flat.max()) + 1 if len(flat) else 1


def _emit(key, acc) -> Iterator[pa.RecordBatch]:
    bi, bj = key
    hit = np.triu(acc, 1) if bi == bj else acc
    i, j = np.nonzero(hit)
    v = hit[i, j]
    for lo in range(0, len(i), OUT_ROWS):
        s = slice(lo, lo + OUT_ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array((i[s] + bi * BLOCK).astype(np.int32)),
             pa.array((j[s] + bj * BLOCK).astype(np.int32)), pa.array(v[s])], ["i", "j", "s"])


def pair_products(rows: DataFrame, with_values: bool = False, stored: bool = False) -> DataFrame:
    """(i, j, s) for i < j: the sum over contexts of the product of the two features' values,
    which for presence rows is the number of contexts holding both. ``stored`` rows are read as they are."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc = None, None
        for batch in batches:
            a_col, b_col = batch.column("a"), batch.column("b")
            for key, lo, hi in _runs(batch, ("bi", "bj")):
                if key != current:
                    if acc is not None:
                        yield from _emit(current, acc)
                    current, acc = key, None
                fa, ra = _ragged(a_col, lo, hi)
                fb, rb = _ragged(b_col, lo, hi)
                va = _ragged(batch.column("av"), lo, hi)[0] if with_values else None
                vb = _ragged(batch.column("bv"), lo, hi)[0] if with_values else None
                left = _dense(fa, ra, hi - lo, _width(fa), va)
                right = left if key[0] == key[1] else _dense(fb, rb, hi - lo, _width(fb), vb)
                product = left.T @ right
                acc = _grown(acc, product.shape)
                acc[:product.shape[0], :product.shape[1]] += product
        if acc is not None:
            yield from _emit(current, acc)

    cols = ["bi", "bj", "a", "b"] + (["av", "bv"] if with_values else [])
    kept = rows if stored else cut_lineage(rows)
    # A block pair is dealt over as many salts as its measured rows need, so the sums that leave the
    # kernel number at most salts x pairs, whatever the number of tasks that hold the rows.
    salted = (block_pairs(kept, with_values).join(block_pair_shards(kept), ["bi", "bj"])
              .withColumn("salt", F.pmod(F.xxhash64("context"), F.col("shards")).cast("int")))
    dealt = (salted.select(*cols, "salt").repartition(shuffle_width(salted), "bi", "bj", "salt")
             .sortWithinPartitions("bi", "bj", "salt"))
    return (dealt.mapInArrow(kernel, "i int, j int, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")))


def tail_pairs(rows: DataFrame, n_heavy: int, piece_pairs: int | None = None) -> DataFrame:
    """(i, j, s) for i < j and j >= n_heavy: contexts that hold both, for presence rows in frequency codes.

    Pairs are counted where the rows lie and only sums leave a task. A pair is drawn at most as often as its
    rarer feature occurs. A row with very many pairs is dealt over pieces of bounded size."""
    most = piece_pairs or PIECE_PAIRS

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            genes = batch.column("genes")
            piece, pieces = (batch.column(c).to_numpy() for c in ("piece", "pieces"))
            for r in range(batch.num_rows):
                g = genes.slice(r, 1).flatten().to_numpy().astype(np.int64)
                # Pairs below position p number about p * p / 2, so equal pieces end at roots.
                lo, hi = (int(len(g) * ((piece[r] + d) / pieces[r]) ** 0.5) for d in (0, 1))
                p = np.arange(max(lo, int(np.searchsorted(g, n_heavy))), hi)
                before = np.concatenate([[0], np.cumsum(p)])
                i = g[np.arange(before[-1]) - np.repeat(before[:-1], p)]
                held.append((i << 32) | np.repeat(g[p], p))
                n += len(i)
                if n >= most:
                    yield from counted(held)
                    held, n = [], 0
        yield from counted(held)

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            keys, sums = np.unique(np.concatenate(held), return_counts=True)
            for lo in range(0, len(keys), OUT_ROWS):
                k = keys[lo:lo + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array(k.astype(np.int32)),
                                                  pa.array(sums[lo:lo + OUT_ROWS].astype(np.float64))], ["i", "j", "s"])

    size = F.size("genes").cast("double")
    cut = rows.where((F.size("genes") > 1) & (F.element_at("genes", -1) >= n_heavy)).select(
        "context", "genes", F.greatest(F.ceil(size * size / (2.0 * most)), F.lit(1)).cast("int").alias("pieces"))
    wide = cut.where("pieces > 1").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = cut.where("pieces = 1").withColumn("piece", F.lit(0)).unionByName(
        wide.repartition(shuffle_width(rows), "context", "piece"))
    return (dealt.select("genes", "piece", "pieces").mapInArrow(kernel, "i int, j int, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")))


def presence_pairs(rows: DataFrame, n_heavy: int, n_features: int) -> DataFrame:
    """(i, j, s) of stored presence rows in frequency codes: dense blocks for the ``n_heavy`` most frequent
    features, and at least for one whole block of them; counted pairs for all pairs with a rarer one."""
    n_heavy = max(n_heavy, BLOCK)
    if n_heavy >= n_features:
        return pair_products(rows, stored=True)
    tail = tail_pairs(rows, n_heavy)
    heavy = rows.select("context", F.filter("genes", lambda g: g < n_heavy).alias("genes")).where(F.size("genes") > 1)
    return pair_products(heavy, stored=True).unionByName(tail)


# --- products against a pair panel ------------------------------------------

def panel_blocks(panel: DataFrame, index: DataFrame, value: str = "value") -> DataFrame:
    """Upper-triangle panel values, packed as one row per (block pair, feature)."""
    a = index.select(F.col("feature_name").alias("gene_i"), F.col("g").alias("i"))
    b = index.select(F.col("feature_name").alias("gene_j"), F.col("g").alias("j"))
    up = (panel.join(a, "gene_i").join(b, "gene_j").where(F.col("i") < F.col("j"))
          .select("i", "j", F.col(value).cast("double").alias("v")))
    return (up.groupBy((F.col("i") / BLOCK).cast("int").alias("bi"),
                       (F.col("j") / BLOCK).cast("int").alias("bj"), "i")
            .agg(F.collect_list(F.struct((F.col("j") % BLOCK).alias("o"), "v")).alias("p"))
            .select("bi", "bj", F.array(F.col("i") % BLOCK).alias("a"), F.col("p.o").alias("b"),
                    F.col("p.v").alias("v")))


def stream_with_blocks(rows: DataFrame, blocks: DataFrame, key: str,
                       per_shard: int | None = None, stored: bool = False) -> DataFrame:
    """Deal the rows of each block pair over shards and put a copy of the block in front of
    every shard, so a task meets the block first and then streams its rows. A block pair has as many
    shards, and its panel entries as many copies, as its measured rows need. ``stored`` rows are read as they are."""
    rows = rows if stored else cut_lineage(rows)
    n, shards = shuffle_width(rows), block_pair_shards(rows, per_shard)
    shard = F.pmod(F.hash(F.col(key)), F.col("shards")).cast("int")
    # Replicate weights ride along where the rows have them.
    w = F.col("w") if "w" in rows.columns else F.lit(None).cast("binary").alias("w")
    left = block_pairs(rows).join(shards, ["bi", "bj"]).select(
        "bi", "bj", shard.alias("shard"), F.lit(1).alias("kind"), F.col(key).cast("string").alias("id"),
        w, "a", "b", F.lit(None).cast("array<double>").alias("v"))
    right = blocks.join(shards, ["bi", "bj"]).select(
        "bi", "bj", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.lit(0).alias("kind"), F.lit("").alias("id"), F.lit(None).cast("binary").alias("w"),
        "a", "b", "v")
    return (left.unionByName(right).repartition(n, "bi", "bj", "shard")
            .sortWithinPartitions("bi", "bj", "shard", "kind"))


def pair_scores(rows: DataFrame, panel: DataFrame, index: DataFrame, key: str = "context",
                threshold: float = 0.05, tau: float = 0.05, relu_mode: str = "shrink",
                per_shard: int | None = None, stored: bool = False) -> DataFrame:
    """Per row: pairs above ``threshold``, summed negative magnitude, and the positive and
    negative magnitude outside the dead zone [-tau, tau].

    ``shrink`` counts max(|v| - tau, 0); ``hard`` counts |v| where |v| > tau.
    """
    if relu_mode not in ("shrink", "hard"):
        raise ValueError(f"unknown relu_mode {relu_mode!r}")

    def weights(v: np.ndarray) -> list[np.ndarray]:
        outside = (lambda m: np.maximum(m - tau, 0.0)) if relu_mode == "shrink" else \
            (lambda m: np.where(m > tau, m, 0.0))
        return [(v > threshold).astype(np.float64), np.maximum(-v, 0.0), outside(v), outside(-v)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, value, ready = None, None, None
        for batch in batches:
            a_col, b_col = batch.column("a"), batch.column("b")
            for (bi, bj, shard, kind), lo, hi in _runs(batch, ("bi", "bj", "shard", "kind")):
                if (bi, bj, shard) != current:
                    current, value, ready = (bi, bj, shard), None, None
                fa, ra = _ragged(a_col, lo, hi)
                fb, rb = _ragged(b_col, lo, hi)
                if kind == 0:
                    value = _grown(value, (_width(fa), _width(fb)))
                    # Block rows carry a single left feature and its right features.
                    left = fa[rb]
                    value[left, fb] = _ragged(batch.column("v"), lo, hi)[0]
                    continue
                if value is None:
                    continue  # no panel entry in this block: contributes nothing
                wa, wb = max(_width(fa), value.shape[0]), max(_width(fb), value.shape[1])
                if ready is None or ready[0].shape != (wa, wb):
                    value = _grown(value, (wa, wb))
                    wa, wb = value.shape
                    ready = weights(value)
                left = _dense(fa, ra, hi - lo, wa)
                right = _dense(fb, rb, hi - lo, wb)
                parts = [np.einsum("ij,ij->i", left @ w, right) for w in ready]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo)] + [pa.array(p) for p in parts],
                    ["id", "n_pos", "sum_neg", "pos_relu", "neg_relu"])

    streamed = stream_with_blocks(rows, panel_blocks(panel, index), key, per_shard, stored)
    names = ("n_pos", "sum_neg", "pos_relu", "neg_relu")
    return (streamed.mapInArrow(kernel, "id string, " + ", ".join(f"{n} double" for n in names))
            .groupBy("id").agg(*[F.sum(n).alias(n) for n in names]))


# --- replicate-weighted products ----------------------------------------------

PART = 32  # replicates in one array


def poisson_steps(rate: float) -> list[int]:
    """Bounds among 32-bit numbers: a uniform number draws as many as it reaches. Ends below the resolution."""
    size = int(rate + 12 * np.sqrt(rate) + 24)
    terms = np.exp(-rate) * np.cumprod(np.concatenate([[1.0], rate / np.arange(1, size)]))
    steps = np.floor(np.cumsum(terms) * 2.0 ** 32)
    return [int(s) for s in steps[steps < 2.0 ** 32]]


def replicate_weights(contexts: list[str], replicates: range, seed: int, rate: float) -> np.ndarray:
    """Poisson(rate) weight of each context in each replicate. Four replicates share the md5 of seed, context and
    r // 4, eight hex digits each: the same in every engine, after a retry and whatever the partitioning."""
    first, last = replicates.start // 4, -(-replicates.stop // 4)
    digests = b"".join(hashlib.md5(f"{seed}-{c}-{g}".encode()).digest() for c in contexts for g in range(first, last))
    drawn = np.frombuffer(digests, ">u4").reshape(len(contexts), 4 * (last - first)).astype(np.int64)
    drawn = drawn[:, replicates.start - 4 * first:replicates.stop - 4 * first]
    return np.searchsorted(np.array(poisson_steps(rate)), drawn, side="right").astype(np.uint16)


def weighted_rows(rows: DataFrame, replicates: range, seed: int, rate: float = 1.0, key: str = "context") -> DataFrame:
    """(key, genes, w): rows with the weights of all replicates, drawn once per context, two bytes each."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = replicate_weights(batch.column(key).to_pylist(), replicates, seed, rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in w], pa.binary())], [key, "genes", "w"])

    named = rows.select(F.col(key).cast("string").alias(key), "genes")
    return named.mapInArrow(draw, f"{key} string, genes array<int>, w binary")


def _weights(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), width).astype(np.float64)


def _arrays(names: list[str], keys: list[np.ndarray], values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of keys, number of the part and an array of at most PART values."""
    step = max(1, OUT_ROWS // PART)
    for part, first in enumerate(range(0, values.shape[1], PART)):
        some = values[:, first:first + PART]
        for lo in range(0, len(some), step):
            flat = some[lo:lo + step]
            ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(k[lo:lo + step].astype(np.int32)) for k in keys], pa.array(np.full(len(flat), part, np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], [*names, "part", "s"])


def _added(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Element-wise sums of the arrays, partially aggregated before the shuffle."""
    sums = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(PART)])
    return rows.groupBy(*keys, "part").agg(F.filter(sums, lambda v: v.isNotNull()).alias(name))


def replicate_marginals(weighted: DataFrame, n: int) -> DataFrame:
    """(g, part, m): weighted contexts holding feature g, an array over the replicates of a part; g = -1 is the total."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, total = None, np.zeros((1, n))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                hi = min(lo + ROWS, batch.num_rows)
                w = _weights(batch.column("w").slice(lo, hi - lo), n)
                flat, owner = _ragged(batch.column("genes"), lo, hi)
                acc = _grown(acc, (_width(flat), n))
                np.add.at(acc, flat, w[owner])
                total += w.sum(axis=0)
        if acc is not None:
            yield from _arrays(["g"], [np.arange(-1, len(acc))], np.vstack([total, acc]))

    return _added(weighted.select("genes", "w").mapInArrow(kernel, "g int, part int, s array<double>"), ["g"], "m")


def replicate_pair_sums(weighted: DataFrame, pairs: DataFrame, index: DataFrame, n: int, key: str = "context",
                        per_shard: int | None = None) -> DataFrame:
    """(i, j, part, k): weighted co-occurrence of the requested pairs, one array per part of the replicates. One row
    per pair, shard and part leaves a task."""

    def flush(cur, at, k) -> Iterator[pa.RecordBatch]:
        yield from _arrays(["i", "j"], [at[0] + cur[0] * BLOCK, at[1] + cur[1] * BLOCK], k)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, k = None, None, None
        for batch in batches:
            a_col, b_col = batch.column("a"), batch.column("b")
            for (bi, bj, shard, kind), lo, hi in _runs(batch, ("bi", "bj", "shard", "kind")):
                if (bi, bj, shard) != current:
                    if k is not None:
                        yield from flush(current, at, k)
                    current, at, k = (bi, bj, shard), None, None
                fa, ra = _ragged(a_col, lo, hi)
                fb, rb = _ragged(b_col, lo, hi)
                if kind == 0:
                    new = (fa[rb].astype(np.int64), fb.astype(np.int64))
                    at = new if at is None else tuple(np.concatenate(p) for p in zip(at, new))
                    continue
                if at is None:
                    continue
                if k is None:
                    k = np.zeros((len(at[0]), n))
                w = _weights(batch.column("w").slice(lo, hi - lo), n)
                left = _dense(fa, ra, hi - lo, max(_width(fa), int(at[0].max()) + 1))
                right = _dense(fb, rb, hi - lo, max(_width(fb), int(at[1].max()) + 1))
                for r in range(n):
                    product = (left * w[:, r:r + 1]).T @ right
                    k[:, r] += product[at[0], at[1]]
        if k is not None:
            yield from flush(current, at, k)

    eligible = pairs.select("gene_i", "gene_j", F.lit(1.0).alias("value"))
    streamed = stream_with_blocks(weighted, panel_blocks(eligible, index), key, per_shard)
    return _added(streamed.mapInArrow(kernel, "i int, j int, part int, s array<double>"), ["i", "j"], "k")
