"""Rank tests between methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions.ordering import average_ranks


def mann_whitney(df: DataFrame, value: str, reference: str, alternative: str = "greater",
                 method_col: str = "method") -> DataFrame:
    """Each method against the reference method, independent entities, one-sided.

    Tie-corrected normal approximation with continuity correction; without ties and with a small side the
    p-value follows the exact law. Values are merged into histograms first, and the reference's
    histogram joins every comparison."""
    v = X.finite(value)
    hist = (df.select(F.col(method_col).alias("m"), v.alias("v")).where("v IS NOT NULL")
            .groupBy("m", "v").agg(F.count(F.lit(1)).alias("w")))
    others = hist.where(F.col("m") != reference).withColumnsRenamed({"m": "other"}).withColumn("side", F.lit(0))
    names = hist.where(F.col("m") != reference).agg(F.sort_array(F.collect_set("m"))).scalar()
    ref = hist.where(F.col("m") == reference).select(
        F.explode(names).alias("other"), "v", "w", F.lit(1).alias("side"))
    both = others.select("other", "v", "w", "side").unionByName(ref)
    ranks = average_ranks(both, "v", ["other"], weight="w")
    ties = ranks.groupBy("other").agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("t"))
    per = both.join(ranks.select("other", "v", "rank"), ["other", "v"]).groupBy("other").agg(
        X.sum_if(F.col("side") == 1, F.col("rank") * F.col("w")).alias("r1"),
        X.sum_if(F.col("side") == 1, "w").alias("n_ref"), X.sum_if(F.col("side") == 0, "w").alias("n_other"))
    n1, n2 = F.col("n_ref").cast("double"), F.col("n_other").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    u = u1 if alternative == "greater" else n1 * n2 - u1
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - X.safe_div("t", n * (n - 1))))
    z = F.when(sd > 0, (u - n1 * n2 / 2.0 - 0.5) / sd)
    exact = (F.col("t") == 0) & (F.least("n_ref", "n_other") <= EXACT_SIDE) & (F.col("n_ref") * F.col("n_other") <= EXACT_CELLS)
    out = per.join(ties, "other").select(
        F.lit(reference).alias("reference"), "other", F.lit(alternative).alias("alternative"),
        "n_ref", "n_other", u1.alias("U"), z.alias("z"), u.alias("_u"), exact.alias("_exact"))
    p = F.when(F.col("_exact"), rank_sum_tail(F.col("_u"), F.col("n_ref"), F.col("n_other"))).otherwise(X.normal_upper_tail("z"))
    return with_p_labels(out, p).drop("_u", "_exact")


def with_p_labels(df: DataFrame, p: Column | None = None) -> DataFrame:
    p = X.normal_upper_tail("z") if p is None else p
    return df.withColumn("p_value", p).withColumns({"p_label": X.p_label("p_value"), "stars": X.p_stars("p_value")})


# The exact laws hold up to these sizes, without ties; beyond them the normal law is used.
EXACT_PAIRS, EXACT_SIDE, EXACT_CELLS = 50, 8, 4000


def _longer(counts: Column, by: Column, sign: int) -> Column:
    """Coefficients of counts * (1 + sign * q^by)."""
    zeros = F.array_repeat(F.lit(0.0), by.cast("int"))
    return F.zip_with(F.concat(counts, zeros), F.concat(zeros, counts), lambda a, b: a + sign * b)


def signed_rank_tail(r_plus: Column, m: Column) -> Column:
    """P(W >= r_plus) over all 2^m signs of the ranks 1..m."""
    one = F.array(F.lit(1.0))
    counts = F.aggregate(F.sequence(F.lit(1), m.cast("int")), one, lambda c, k: _longer(c, k, 1))
    above = F.slice(counts, F.ceil(r_plus).cast("int") + 1, F.size(counts))
    return F.aggregate(above, F.lit(0.0), lambda a, b: a + b) / F.pow(F.lit(2.0), m)


def rank_sum_tail(u: Column, n1: Column, n2: Column) -> Column:
    """P(U >= u) over all arrangements of n1 and n2 untied values, by the product form of the counts."""
    small, large = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int")
    divided = lambda c, k: F.aggregate(
        F.sequence(F.lit(1), F.size(c)), F.array().cast("array<double>"), lambda done, i: F.concat(done, F.array(
            F.get(c, i - 1) + F.coalesce(F.get(done, F.when(i > k, i - k - 1).otherwise(-1)), F.lit(0.0)))))
    counts = F.aggregate(F.sequence(F.lit(1), small), F.array(F.lit(1.0)),
                         lambda c, k: F.slice(divided(_longer(c, large + k, -1), k), F.lit(1), k * large + 1))
    above = F.slice(counts, F.ceil(u).cast("int") + 1, F.size(counts))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return total(above) / total(counts)


def wilcoxon_signed_rank(df: DataFrame, a: str, b: str, by: Sequence[str],
                         alternative: str = "greater") -> DataFrame:
    """Paired one-sided test of a - b. Zero differences are dropped; undefined below 8 pairs or
    when all pairs are equal. Without ties and zeros and with few pairs the p-value is exact
    (``test_method`` says which law was used); z is always the normal one."""
    rows = df.select(*by, (X.finite(a) - X.finite(b)).alias("d")).where("d IS NOT NULL")
    n_pairs = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    hist = (rows.where("d <> 0").groupBy(*by, F.abs("d").alias("v")).agg(
        F.count(F.lit(1)).alias("w"), F.count_if(F.col("d") > 0).alias("up")))
    ranks = average_ranks(hist, "v", by, weight="w")
    per = hist.join(ranks, [*by, "v"]).groupBy(*by).agg(
        F.sum(F.col("rank") * F.col("up")).alias("r_plus"), F.sum("w").alias("m"),
        F.sum(F.pow("w", F.lit(3)) - F.col("w")).alias("t"))
    m = F.col("m").cast("double")
    sd = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("t") / 2.0) / 24.0)
    raw = (F.col("r_plus") - m * (m + 1) / 4.0) / sd
    ok = (F.col("n_pairs") >= 8) & (sd > 0)
    z = F.when(ok, raw if alternative == "greater" else -raw)
    exact = ok & (F.col("t") == 0) & (F.col("n_pairs") == F.col("m")) & (F.col("m") <= EXACT_PAIRS)
    out = n_pairs.join(per, list(by), "left").select(
        *by, "n_pairs", F.when(ok, F.col("r_plus")).alias("statistic"), z.alias("z"),
        F.when(exact, "exact").otherwise("normal approximation").alias("test_method"),
        (F.col("r_plus") if alternative == "greater" else m * (m + 1) / 2 - F.col("r_plus")).alias("_r"), F.col("m").alias("_m"))
    p = F.when(F.col("test_method") == "exact", signed_rank_tail(F.col("_r"), F.col("_m"))).otherwise(X.normal_upper_tail("z"))
    return with_p_labels(out, p).drop("_r", "_m")
