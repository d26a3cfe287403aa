"""Ranking, selection and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions.ordering import lowest_rows, min_ranks, quantiles, top_k_per_group, value_bucket


def rank_and_penalize(runs: DataFrame) -> DataFrame:
    """Per dataset: mean of two min-ranks plus penalties against the dataset's medians.

    runs: dataset, marker_log2fc, kendall_tau, n_cells, runtime_seconds, peak_memory_gb,
    refined_median_tx, unassigned_frac, relative_purity.
    """
    by = ["dataset"]
    med_cols = ("n_cells", "runtime_seconds", "peak_memory_gb")
    from molq.operators.accounting import group_medians
    r = runs.join(group_medians(runs, med_cols, by), by, "left")
    # NULL metrics get no rank, as NaN does.
    for c, name in (("marker_log2fc", "rank_marker"), ("kendall_tau", "rank_kendall")):
        r = min_ranks(r, c, by, name, descending=True)
    have = F.array_compact(F.array("rank_marker", "rank_kendall"))
    mean_rank = F.aggregate(have, F.lit(0.0), lambda a, b: a + b) / F.nullif(
        F.size(have), F.lit(0))
    ratio = lambda c: X.safe_div(c, f"median_{c}")
    cells = ratio("n_cells")
    far = (cells < 0.4) | (cells > 2.5)
    off = (cells < 0.6) | (cells > 1.7)
    tx, lost, pure = F.col("refined_median_tx"), F.col("unassigned_frac"), F.col("relative_purity")
    show = lambda name, digits, v: F.format_string(f"{name}=%.{digits}f", F.bround(v, digits))
    # (condition, penalty, flag) in report order; the first of a pair wins.
    rules = [
        (far, 2.0, show("cell_ratio", 2, cells)), (~far & off, 1.0, show("cell_ratio", 2, cells)),
        (tx < 20, 1.5, show("refined_tx", 0, tx)),
        (lost > 0.25, 1.5, show("unassigned", 2, lost)),
        ((lost <= 0.25) & (lost > 0.15), 0.5, show("unassigned", 2, lost)),
        ((pure > 0.999) & (tx < 25), 1.0, F.lit("suspicious_purity")),
        (ratio("runtime_seconds") > 2.0, 0.5, F.lit("slow")),
        (ratio("peak_memory_gb") > 2.0, 0.5, F.lit("high_mem"))]
    penalty = sum((F.when(cond, F.lit(p)).otherwise(F.lit(0.0)) for cond, p, _ in rules),
                  F.lit(0.0))
    flags = F.concat_ws(";", *[F.when(cond, flag) for cond, _, flag in rules])
    r = r.withColumns({"mean_rank": mean_rank, "penalty": penalty, "penalty_flags": flags})
    r = r.withColumn("penalized_score", F.col("mean_rank") + F.col("penalty"))
    return min_ranks(r, "penalized_score", by, "final_rank").drop(*[f"median_{c}" for c in med_cols])


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    return top_k_per_group(df, by, order, 1, "_r").drop("_r")


def top_supported(df: DataFrame, by: Sequence[str] = ("method",), min_total: int = 20,
                  n: int = 50) -> DataFrame:
    """Largest affected fraction among well-supported features."""
    return top_k_per_group(df.where(F.col("total_count") >= min_total), by,
                           [F.desc("fraction_affected"), F.desc("n_affected"),
                            F.asc("feature_name")], n)


def latest_per_key(df: DataFrame, by: Sequence[str], stamp: str) -> DataFrame:
    """Every launch with ``superseded`` = not the most recent of its key."""
    w = Window.partitionBy(*by).orderBy(F.col(stamp).desc())
    return df.withColumn("superseded", F.row_number().over(w) > 1)


def first_per_key(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, order).alias(value))


def nearest_to_quantile(df: DataFrame, value: str, probs: dict[str, float],
                        ties: Sequence[str], weight=None) -> DataFrame:
    """For each named quantile the row whose value lies nearest, ties in the given order.

    The quantile values are scalar subqueries and the pick is an aggregate, so the rows are
    neither joined nor sorted globally."""
    q = quantiles(df, value, probs, weight=weight)
    rows = []
    payload = F.struct(*df.columns)
    for name in probs:
        target = q.select(name).scalar()
        key = F.struct(F.abs(F.col(value) - target).alias("d"), *[F.col(t) for t in ties])
        rows.append(F.struct(F.lit(name).alias("pick"), target.alias("target"),
                             F.min_by(payload, key).alias("row")))
    picked = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("r"))
    return picked.select("r.pick", "r.target", "r.row.*")


def nearest_to_median_point(df: DataFrame, n: int, x: str = "x", y: str = "y",
                            key: str = "transcript_id") -> DataFrame:
    """The n rows nearest to the coordinate medians; rows with undefined coordinates are no candidates."""
    mx = quantiles(df, x, {"m": 0.5}).select("m").scalar()
    my = quantiles(df, y, {"m": 0.5}).select("m").scalar()
    d2 = (F.col(x) - mx) * (F.col(x) - mx) + (F.col(y) - my) * (F.col(y) - my)
    rows = df.withColumn("dist2", d2).where("dist2 IS NOT NULL")
    return lowest_rows(rows, n, value_bucket("dist2"), ["dist2", key])


def display_order(df: DataFrame, order: Sequence[str], col: str = "method") -> DataFrame:
    """Presentation order of a short categorical; unknown names go last, by name."""
    keys = F.array(*[F.lit(o) for o in order])
    pos = F.array_position(keys, F.col(col))
    return df.withColumn("display_rank", F.when(pos > 0, pos).otherwise(len(order) + 1)) \
             .orderBy("display_rank", col)
