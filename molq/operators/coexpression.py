"""Pairwise coexpression of features over entities, with down-sampling and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molq.functions import blocks as B
from molq.functions import expr as X
from molq.functions.ordering import average_ranks, lowest_rows, top_k_per_group, value_bucket
from molq.operators.cooccurrence import all_pairs, named_pairs, pair_cooccurrence

CHUNK = 4096


def thin_counts(counts: DataFrame, n: int, seed: int, replace: bool = True) -> DataFrame:
    """Down-sample each entity to exactly n molecules; seeded by hash, stable under retries.

    With replacement: n hashed draws per entity fall on its cumulative counts. Without: the n
    molecules of lowest hash, so smaller entities keep all they have.
    """
    if not replace:
        # Molecules are numbered in chunks, so no row holds an array as long as a large count.
        chunks = counts.where("count > 0").select("cell_id", "feature_name", F.col("count").cast("long").alias("c"), F.explode(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("count").cast("long") - 1) / CHUNK))).alias("k"))
        units = chunks.select("cell_id", "feature_name", F.explode(F.sequence(
            F.col("k") * CHUNK + 1, F.least("c", (F.col("k") + 1) * CHUNK))).alias("u"))
        key = F.xxhash64(F.lit(seed), "cell_id", "feature_name", "u")
        kept = top_k_per_group(units, ["cell_id"], [key, F.col("feature_name"), F.col("u")], n)
        return kept.groupBy("cell_id", "feature_name").agg(F.count(F.lit(1)).alias("count"))
    # Per entity: feature intervals on [0, total) and n draw positions, merged in position order;
    # a draw belongs to the last interval opened before it. Rows per entity: features + n.
    by = Window.partitionBy("cell_id")
    opened = by.orderBy("feature_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.where("count > 0").select("cell_id", "feature_name", F.col("count").cast("double").alias("c"))
    spans = rows.withColumn("pos", F.sum("c").over(opened) - F.col("c")).select(
        "cell_id", "pos", "feature_name")
    draws = (rows.groupBy("cell_id").agg(F.sum("c").alias("total"))
             .withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(int(n)))))
             .select("cell_id", (X.hashed_uniform(seed, "cell_id", "d") * F.col("total")).alias("pos"),
                     F.lit(None).cast("string").alias("feature_name")))
    upto = by.orderBy("pos", F.col("feature_name").isNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hit = F.last("feature_name", ignorenulls=True).over(upto)
    return (spans.unionByName(draws).withColumn("hit", hit).where(F.col("feature_name").isNull())
            .groupBy("cell_id", F.col("hit").alias("feature_name")).agg(F.count(F.lit(1)).alias("count")))


def eligible_entities(counts: DataFrame, target: int, min_samples: int = 0) -> DataFrame:
    """Entities that reach the target depth; when fewer than ``min_samples`` do, the deepest
    ``min_samples`` instead."""
    depth = counts.groupBy("cell_id").agg(F.sum("count").alias("n"))
    enough = depth.agg(F.count_if(F.col("n") >= target) >= min_samples).scalar()
    deepest = lowest_rows(depth, min_samples, value_bucket(-F.col("n")), [F.desc("n"), "cell_id"])
    return (depth.where(enough & (F.col("n") >= target))
            .unionByName(deepest.where(~enough)).select("cell_id"))


def positivity(counts: DataFrame, n_entities: Column, cutoff: float = 1) -> tuple[DataFrame, DataFrame]:
    """Presence rows (context, feature_name, n) and the positivity rate per feature."""
    pos = counts.where(F.col("count") >= cutoff).select(
        F.col("cell_id").alias("context"), "feature_name", F.col("count").alias("n"))
    # A feature that is counted but never reaches the cutoff keeps a rate of zero.
    rate = counts.groupBy("feature_name").agg(
        (F.count_if(F.col("count") >= cutoff) / n_entities).alias("rate"))
    return pos, rate


def _both_directions(pairs: DataFrame, diagonal: DataFrame) -> DataFrame:
    flipped = pairs.select(F.col("gene_j").alias("gene_i"), F.col("gene_i").alias("gene_j"), "k_ij")
    return pairs.unionByName(flipped).unionByName(diagonal)


def _marginal_pairs(pos: DataFrame) -> tuple[DataFrame, DataFrame]:
    marg = pos.groupBy("feature_name").agg(F.count(F.lit(1)).alias("k"))
    diagonal = marg.select(F.col("feature_name").alias("gene_i"),
                           F.col("feature_name").alias("gene_j"), F.col("k").alias("k_ij"))
    return marg, _both_directions(pair_cooccurrence(pos), diagonal)


def _side(marg: DataFrame, s: str) -> DataFrame:
    return marg.select(F.col("feature_name").alias(f"gene_{s}"), F.col("k").alias(f"k_{s}"))


def conditional_coexpression(pos: DataFrame) -> DataFrame:
    """P(i | j) = joint / marginal of j, diagonal included; absent pairs are zero."""
    marg, pairs = _marginal_pairs(pos)
    return pairs.join(_side(marg, "j"), "gene_j").select(
        "gene_i", "gene_j", (F.col("k_ij") / F.col("k_j")).alias("value"))


def jaccard_coexpression(pos: DataFrame) -> DataFrame:
    marg, pairs = _marginal_pairs(pos)
    union = F.col("k_i") + F.col("k_j") - F.col("k_ij")
    return (pairs.join(_side(marg, "i"), "gene_i").join(_side(marg, "j"), "gene_j")
            .select("gene_i", "gene_j", (F.col("k_ij") / union).alias("value")))


def sparse_pearson(values: DataFrame, n_entities: Column) -> DataFrame:
    """Feature correlations over all entities, zeros included, from sparse sums only.

    values: context, feature_name, w (nonzero). Returns the upper triangle; a feature without
    variance has no defined correlation (NULL)."""
    index = B.feature_index(values)
    rows = B.context_rows(values, index, "w")
    xy = named_pairs(B.pair_products(rows, with_values=True), index)
    sums = values.groupBy("feature_name").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    side = lambda x: sums.select(F.col("feature_name").alias(f"gene_{x}"), F.col("s").alias(f"s_{x}"),
                                 F.col("q").alias(f"q_{x}"))
    wide = (all_pairs(sums).join(xy, ["gene_i", "gene_j"], "left").join(side("i"), "gene_i")
            .join(side("j"), "gene_j").withColumn("n", n_entities.cast("double")))
    spread = lambda x: F.col("n") * F.col(f"q_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}")
    num = F.col("n") * F.coalesce("s", F.lit(0.0)) - F.col("s_i") * F.col("s_j")
    return wide.select("gene_i", "gene_j", F.when(
        (spread("i") > 0) & (spread("j") > 0),
        num / (F.sqrt(spread("i")) * F.sqrt(spread("j")))).alias("value"))


def pearson_coexpression(counts: DataFrame, n_entities: Column) -> DataFrame:
    return sparse_pearson(counts.where("count <> 0").select(
        F.col("cell_id").alias("context"), "feature_name", F.col("count").cast("double").alias("w")),
        n_entities)


def centred_ranks(counts: DataFrame, n_entities: Column) -> DataFrame:
    """Tie-averaged ranks relative to the rank of zero, so absent entries stay zero.

    With z zeros their shared rank is (z + 1) / 2 and a positive value's rank is z plus its
    rank among the positives."""
    positive = counts.where("count > 0")
    ranks = average_ranks(positive, "count", ["feature_name"])
    z = n_entities - F.col("total")
    shifted = ranks.select("feature_name", F.col("v").alias("count"),
                           (z + F.col("rank") - (z + 1) / 2.0).alias("w"))
    return positive.withColumn("count", F.col("count").cast("double")).join(
        shifted, ["feature_name", "count"]).select(F.col("cell_id").alias("context"), "feature_name", "w")


def spearman_coexpression(counts: DataFrame, n_entities: Column) -> DataFrame:
    return sparse_pearson(centred_ranks(counts, n_entities), n_entities)


def coexpression(counts: DataFrame, method: str = "conditional", target: int | None = 50,
                 min_samples: int = 0, cutoff: float = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pair table, positivity table): eligibility, thinning, positivity, then the measure."""
    rows = counts
    if target is not None:
        rows = counts.join(eligible_entities(counts, target, min_samples), "cell_id", "left_semi")
        rows = thin_counts(rows, target, seed)
    n = rows.agg(F.countDistinct("cell_id")).scalar()
    pos, rate = positivity(rows, n, cutoff)
    measures = {"conditional": lambda: conditional_coexpression(pos),
                "jaccard": lambda: jaccard_coexpression(pos),
                "pearson": lambda: pearson_coexpression(rows, n),
                "spearman": lambda: spearman_coexpression(rows, n)}
    if method not in measures:
        raise ValueError(f"unknown coexpression method {method!r}")
    return measures[method](), rate


def censored_ratio(reference: DataFrame, other: DataFrame, ref_rate: DataFrame,
                   other_rate: DataFrame, min_rate: float = 0.0, log2: bool = True) -> DataFrame:
    """other / reference per pair; zero where both features are rarely expressed in either.

    A pair absent from a sparse table is a zero there: ratio 0 (log2: NULL, minus infinity) or
    undefined (NULL)."""
    a = reference.withColumnRenamed("value", "ref")
    b = other.withColumnRenamed("value", "oth")
    pairs = a.join(b, ["gene_i", "gene_j"], "full")
    ratio = F.when(F.coalesce("ref", F.lit(0.0)) != 0, F.coalesce("oth", F.lit(0.0)) / F.col("ref"))
    value = F.when(ratio > 0, F.log2(ratio)) if log2 else ratio
    if min_rate > 0:
        rates = ref_rate.withColumnRenamed("rate", "a").join(
            other_rate.withColumnRenamed("rate", "b"), "feature_name", "full")
        rare = rates.select("feature_name", (
            (F.coalesce("a", F.lit(0.0)) < min_rate) | (F.coalesce("b", F.lit(0.0)) < min_rate)).alias("rare"))
        side = lambda s: rare.select(F.col("feature_name").alias(f"gene_{s}"), F.col("rare").alias(f"rare_{s}"))
        pairs = pairs.join(side("i"), "gene_i", "left").join(side("j"), "gene_j", "left")
        value = F.when(F.col("rare_i") & F.col("rare_j"), 0.0).otherwise(value)
    return pairs.select("gene_i", "gene_j", value.alias("ratio"))


def spurious_pairs(ratios: DataFrame, cutoff: float = 2.0, method: str | None = None,
                   log2: bool = True) -> DataFrame:
    """Pairs at or above the cutoff; symmetric measures report each pair once."""
    import math
    limit = math.log2(cutoff) if log2 else cutoff
    out = ratios.where(F.col("ratio") >= limit)
    return out if method == "conditional" else out.where(F.col("gene_i") < F.col("gene_j"))
