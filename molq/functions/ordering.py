"""Exact quantiles, ranks and top-k that never sort a whole group in one task.

The value axis is cut into buckets by a fixed monotone function. Bucket totals are small
and give each bucket its starting rank; only rows of one bucket are ordered together, after
equal values have been merged into one row with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molq.functions.expr import col, finite
from molq.session import cut_lineage

UNIT_STEPS = 65536
LOG_STEPS = 1024


def value_bucket(v) -> Column:
    """Monotone bucket number: linear steps on [-1, 1], logarithmic steps outside."""
    v = col(v).cast("double")
    outer = F.lit(UNIT_STEPS + 1) + F.floor(F.log2(F.abs(v)) * LOG_STEPS)
    return (F.when(F.abs(v) <= 1.0, F.floor(v * UNIT_STEPS).cast("long"))
            .otherwise((F.signum(v) * outer).cast("long")))


def value_histogram(df: DataFrame, value, by: Sequence[str] = (), weight=None) -> DataFrame:
    """(by..., v, n): one row per distinct finite value."""
    n = F.count(F.lit(1)) if weight is None else F.sum(col(weight))
    return (df.select(*by, finite(value).alias("v"),
                      *([] if weight is None else [col(weight).alias("_w")]))
            .where(F.col("v").isNotNull())
            .groupBy(*by, "v")
            .agg((n if weight is None else F.sum("_w")).cast("long").alias("n"))
            .withColumn("b", value_bucket("v")))


def bucket_offsets(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., b, bn, before, total) where ``before`` counts rows in lower buckets."""
    totals = hist.groupBy(*by, "b").agg(F.sum("n").alias("bn"))
    # One row per bucket: at most a few hundred thousand rows per group whatever the data size.
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = part.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (totals.withColumn("before", F.sum("bn").over(upto) - F.col("bn"))
            .withColumn("total", F.sum("bn").over(part)))


def average_ranks(df: DataFrame, value, by: Sequence[str] = (), weight=None) -> DataFrame:
    """(by..., v, n, rank, total): the tie-averaged 1-based rank of every distinct value."""
    hist = value_histogram(df, value, by, weight)
    offsets = bucket_offsets(hist, by).select(*by, "b", "before", "total")
    inside = (Window.partitionBy(*by, "b").orderBy("v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (hist.join(offsets, [*by, "b"])
            .withColumn("lower", F.col("before") + F.sum("n").over(inside) - F.col("n"))
            .select(*by, "v", "n", (F.col("lower") + (F.col("n") + 1) / 2.0).alias("rank"),
                    "total"))


def quantiles(df: DataFrame, value, probs: Mapping[str, float],
              by: Sequence[str] = (), weight=None) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group, one column per entry of probs.

    ``weight`` is how many equal rows a row stands for. Groups with no finite value are absent; without ``by`` there is always one row.
    """
    hist = value_histogram(df, value, by, weight)
    offsets = bucket_offsets(hist, by)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"))
                       for name, p in probs.items()])
    targets = (offsets.withColumn("q", F.explode(wanted))
               .withColumn("pos", (F.col("total") - 1) * F.col("q.p"))
               .withColumn("k0", F.floor("pos"))
               .withColumn("k1", F.ceil("pos"))
               .where((F.col("before") <= F.col("k1"))
                      & (F.col("before") + F.col("bn") > F.col("k0"))))
    inside = (Window.partitionBy(*by, "b", "q.name").orderBy("v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (hist.join(targets, [*by, "b"])
              .withColumn("upto", F.col("before") + F.sum("n").over(inside))
              .withColumn("lower", F.col("upto") - F.col("n")))

    def at(k: str) -> Column:
        return F.max(F.when((F.col("lower") <= F.col(k)) & (F.col("upto") > F.col(k)), F.col("v")))

    picked = (ranked.groupBy(*by, F.col("q.name").alias("name"))
              .agg(at("k0").alias("v0"), at("k1").alias("v1"),
                   F.first("pos").alias("pos"), F.first("k0").alias("k0"))
              .withColumn("value", F.col("v0") + (F.col("v1") - F.col("v0"))
                          * (F.col("pos") - F.col("k0"))))
    cells = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in probs]
    return picked.groupBy(*by).agg(*cells) if by else picked.agg(*cells)


def dense_index(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """0-based dense positions in the given order, without a task that sees all rows.

    Rows are range-partitioned and sorted where they lie; each row's place inside its partition
    is kept in the stored table, and partition sizes (one small row each) give the offsets."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut_lineage(ordered.withColumn("_mid", F.monotonically_increasing_id()))
    part, place = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored.withColumns({"_part": part, "_place": place}).drop("_mid")
    upto = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_place")) \
                 .drop("_part", "_place", "_offset")


def lowest_rows(df: DataFrame, n: int, bucket: Column, order: Sequence) -> DataFrame:
    """Exactly the n first rows (or all) in ``order``, where ``bucket`` is a monotone function of it.

    Bucket counts tell where the n-th row lies; lower buckets are kept as they are and only rows of the
    boundary bucket are put in order, so no task sees more than that bucket."""
    rows = df.withColumn("_b", bucket)
    upto = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    edge = sizes.where(F.col("_upto") >= n).agg(
        F.min_by(F.struct("_b", (F.col("_upto") - F.col("_n")).alias("before")), "_b").alias("e"))
    edge_b, before = edge.select("e._b").scalar(), edge.select("e.before").scalar()
    kept = rows.where(edge_b.isNull() | (F.col("_b") < edge_b))
    last = Window.partitionBy("_b").orderBy(*order)
    boundary = (rows.where(F.col("_b") == edge_b).withColumn("_r", F.row_number().over(last))
                .where(F.col("_r") <= F.lit(n) - before).drop("_r"))
    return kept.unionByName(boundary).drop("_b")


def drawn(seed: int, key) -> Column:
    """A 60-bit number from the md5 of seed and key: the same in every engine and after every retry."""
    text = F.concat(F.lit(f"{seed}-"), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hashed_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n rows (or all), those of lowest drawn number, ties by key."""
    rows = df.withColumn("_h", drawn(seed, key))
    return lowest_rows(rows, n, F.shiftright("_h", 40), ["_h", key]).drop("_h")


def min_ranks(df: DataFrame, value: str, by: Sequence[str], name: str, descending: bool = False) -> DataFrame:
    """Adds the 1-based minimum rank of ``value`` within ``by``; undefined values get none. No group is
    sorted in one task."""
    v = -F.col(value) if descending else F.col(value)
    ranks = average_ranks(df.select(*by, v.alias("_v")), "_v", by).select(
        *by, F.col("v").alias("_v"), (F.col("rank") - (F.col("n") - 1) / 2).cast("int").alias(name))
    return df.withColumn("_v", finite(v)).join(ranks, [*by, "_v"], "left").drop("_v")


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows with row_number <= k. Spark prunes each partition to k rows per group before the
    shuffle (WindowGroupLimit), so a group that holds most rows stays cheap."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
