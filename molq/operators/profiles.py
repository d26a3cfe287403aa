"""Normalisation, per-type profiles, and correlation with a labelled reference.

Counts are sparse, so a mean over a type always divides a sum by the number of its entities;
an average over the rows present would silently skip the zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions.ordering import top_k_per_group
from molq.session import cut_lineage


def entity_total(keys: Sequence[str] = ("cell_id",)) -> Column:
    """Sum over one entity's rows; an entity has at most one row per feature."""
    return F.sum("count").over(Window.partitionBy(*keys))


def log_normalize(counts: DataFrame, target: float = 1e4,
                  keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """``value`` = log1p(count * target / entity total); a zero total counts as 1."""
    total = entity_total(keys)
    total = F.when(total == 0, 1.0).otherwise(total.cast("double"))
    return counts.withColumn("value", F.log1p(F.col("count") / total * target))


def l1_normalize(counts: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    total = entity_total(keys).cast("double")
    return counts.withColumn("value", F.when(total == 0, F.lit(0.0)).otherwise(F.col("count") / total))


def l2_normalize(df: DataFrame, value: str = "value",
                 keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*keys)))
    return df.withColumn(value, F.when(norm == 0, F.lit(0.0)).otherwise(F.col(value) / norm))


def qc_filter(counts: DataFrame, min_counts: int = 10, max_counts: int | None = None,
              min_features: int = 1, max_features: int | None = None, min_cells: int = 3,
              order: str = "cells_first") -> DataFrame:
    """Entity filter (size, features) and feature filter (entities), in the stated order; the
    second filter sees only what the first kept."""
    def cells(c: DataFrame) -> DataFrame:
        per = c.where("count > 0").groupBy("cell_id").agg(
            F.sum("count").alias("n"), F.count(F.lit(1)).alias("g"))
        ok = (F.col("n") >= min_counts) & (F.col("g") >= min_features)
        if max_counts is not None:
            ok = ok & (F.col("n") <= max_counts)
        if max_features is not None:
            ok = ok & (F.col("g") <= max_features)
        return c.join(per.where(ok).select("cell_id"), "cell_id", "left_semi")

    def genes(c: DataFrame) -> DataFrame:
        per = c.where("count > 0").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))
        return c.join(per.where(F.col("n") >= min_cells), "feature_name", "left_semi")

    steps = {"cells_first": (cells, genes), "genes_first": (genes, cells)}
    if order not in steps:
        raise ValueError(f"unknown order {order!r}")
    first, second = steps[order]
    return second(first(counts))


# --- profiles -------------------------------------------------------------------

def type_sizes(labels: DataFrame) -> DataFrame:
    return (labels.where(F.col("cell_type").isNotNull()).groupBy("cell_type")
            .agg(F.count(F.lit(1)).alias("n_cells")))


def _type_sums(values: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    lab = labels.where(F.col("cell_type").isNotNull()).select("cell_id", "cell_type")
    return values.join(lab, "cell_id").groupBy("cell_type", "feature_name").agg(
        F.sum(value).alias("s"))


def pseudobulk_mean_log(counts: DataFrame, labels: DataFrame, min_cells: int = 1) -> DataFrame:
    """mean(log1p(CP10k)) per type; ``labels`` lists every entity of the matrix."""
    sizes = type_sizes(labels).where(F.col("n_cells") >= min_cells)
    return _type_sums(log_normalize(counts), labels, "value").join(sizes, "cell_type").select(
        "cell_type", "feature_name", (F.col("s") / F.col("n_cells")).alias("value"), "n_cells")


def pseudobulk_log_mean(counts: DataFrame, labels: DataFrame, min_cells: int = 5) -> DataFrame:
    """log1p(mean(CP10k)) per type with at least min_cells entities."""
    sizes = type_sizes(labels).where(F.col("n_cells") >= min_cells)
    cpm = counts.withColumn("value", F.col("count") / F.nullif(entity_total(), F.lit(0)) * 1e4)
    return _type_sums(cpm, labels, "value").join(sizes, "cell_type").select(
        "cell_type", "feature_name", F.log1p(F.col("s") / F.col("n_cells")).alias("value"),
        "n_cells")


def reference_profiles(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean raw profile per type, scaled to sum 1 over the given features."""
    sizes = type_sizes(labels)
    mean = _type_sums(counts, labels, "count").join(sizes, "cell_type").withColumn(
        "m", F.col("s") / F.col("n_cells"))
    total = F.sum("m").over(Window.partitionBy("cell_type"))
    return mean.select("cell_type", "feature_name", F.when(total == 0, F.lit(0.0)).otherwise(
        F.col("m") / total).alias("value"), "n_cells")


def dense_profile(profile: DataFrame, genes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Types x features with zeros filled in. Bounded by (number of types) x vocabulary, never
    by the data; the feature list is attached to the few type rows and exploded."""
    names = genes.agg(F.sort_array(F.collect_set("feature_name"))).scalar()
    t = (profile if types is None else types).select("cell_type").distinct()
    grid = t.withColumn("feature_name", F.explode(names))
    return grid.join(profile.select("cell_type", "feature_name", "value"),
                     ["cell_type", "feature_name"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0)))


def shared_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("feature_name").intersect(b.select("feature_name"))


def common_panel(counts: DataFrame) -> DataFrame:
    """Features measured by every method."""
    n = counts.agg(F.countDistinct("method")).scalar()
    return (counts.select("method", "feature_name").distinct().groupBy("feature_name")
            .agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == n).select("feature_name"))


def heldout_reference(obs: DataFrame, split_col: str, value: str) -> DataFrame:
    return obs.where(F.col(split_col).cast("string") == value)


# --- correlation ------------------------------------------------------------------

def profile_pairs(query: DataFrame, reference: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_type, feature_name, q, r) over shared features for types both sides know."""
    both = query.select("cell_type").intersect(reference.select("cell_type"))
    q = dense_profile(query, genes, both).withColumnRenamed("value", "q")
    r = dense_profile(reference, genes, both).withColumnRenamed("value", "r")
    return q.join(r, ["cell_type", "feature_name"])


def _correlation() -> Column:
    """Pearson of q and r; NULL when either is constant."""
    varied = (F.min("q") < F.max("q")) & (F.min("r") < F.max("r"))
    return F.when(varied, X.safe_div(F.covar_pop("q", "r"), F.stddev_pop("q") * F.stddev_pop("r")))


def pearson_by_type(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_genes_used"),
        _correlation().alias("pearson_r"))


def _tied_rank(c: str) -> Column:
    """Average rank of a feature within its type: at most one row per feature."""
    part = Window.partitionBy("cell_type")
    return F.rank().over(part.orderBy(c)) + (
        F.count(F.lit(1)).over(Window.partitionBy("cell_type", c)) - 1) / 2.0


def spearman_by_type(pairs: DataFrame) -> DataFrame:
    ranked = pairs.select("cell_type", _tied_rank("q").alias("q"), _tied_rank("r").alias("r"))
    return ranked.groupBy("cell_type").agg(
        _correlation().alias("spearman_rho"))


def _inversions(y: np.ndarray) -> int:
    """Pairs that stand in strictly falling order, halves by halves as in a merge sort."""
    at, found, width = np.arange(len(y)), 0, 1
    span = int(y.max()) + 1 if len(y) else 1
    while width < len(y):
        block, right = at // (2 * width), (at // width) % 2 == 1
        key = block * span + y
        left = np.sort(key[~right])
        ends = np.searchsorted(left, (block[right] + 1) * span)
        found += int((ends - np.searchsorted(left, key[right], side="right")).sum())
        width *= 2
    return found


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """tau-b of one vector pair in n log^2 n: tied pairs by counting, discordant ones by inversions."""
    x, y = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (x, y))
    pairs = lambda counts: int((counts * (counts - 1) // 2).sum())
    order = np.lexsort((y, x))
    every, tied_x, tied_y = len(x) * (len(x) - 1) // 2, pairs(np.bincount(x)), pairs(np.bincount(y))
    tied_both = pairs(np.unique(np.stack([x, y]), axis=1, return_counts=True)[1])
    score = every - tied_x - tied_y + tied_both - 2 * _inversions(y[order])
    left, right = float(every - tied_x), float(every - tied_y)
    return None if left <= 0 or right <= 0 else score / (left ** 0.5 * right ** 0.5)


def kendall_by_type(pairs: DataFrame) -> DataFrame:
    """tau-b per type. A group holds one value pair per feature, so its size is the panel, not
    the data."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tau = kendall_tau_b(pdf["q"].to_numpy(), pdf["r"].to_numpy())
        return pd.DataFrame({"cell_type": [pdf["cell_type"].iloc[0]], "kendall_tau": [tau]})
    return pairs.groupBy("cell_type").applyInPandas(one, "cell_type string, kendall_tau double")


def reference_consistency(q_counts: DataFrame, q_labels: DataFrame, r_counts: DataFrame,
                          r_labels: DataFrame, min_cells: int = 5) -> DataFrame:
    """Pearson per type between mean-log profiles over shared features."""
    genes = cut_lineage(shared_genes(q_counts, r_counts))
    cut = lambda c: c.join(genes, "feature_name", "left_semi")
    q = pseudobulk_mean_log(cut(q_counts), q_labels, min_cells)
    r = pseudobulk_mean_log(cut(r_counts), r_labels, min_cells)
    nq = type_sizes(q_labels).withColumnRenamed("n_cells", "n_spatial_cells")
    nr = type_sizes(r_labels).withColumnRenamed("n_cells", "n_reference_cells")
    return (pearson_by_type(profile_pairs(q, r, genes)).join(nq, "cell_type")
            .join(nr, "cell_type"))


def audit_pseudobulk(q_counts: DataFrame, q_labels: DataFrame, r_counts: DataFrame,
                     r_labels: DataFrame, restrict: DataFrame | None = None, n_top: int = 30,
                     min_cells: int = 5) -> DataFrame:
    """One row: medians over types of Kendall, Pearson, Spearman and the marker log difference,
    on any entity restriction and any reference subset."""
    if restrict is not None:
        q_labels = q_labels.join(restrict.select("cell_id").distinct(), "cell_id", "left_semi")
    genes = cut_lineage(shared_genes(q_counts, r_counts))
    cut = lambda c: c.join(genes, "feature_name", "left_semi")
    q = cut_lineage(pseudobulk_log_mean(cut(q_counts), q_labels, min_cells))
    r = cut_lineage(pseudobulk_log_mean(cut(r_counts), r_labels, min_cells))
    pairs = cut_lineage(profile_pairs(q, r, genes))
    corr = (pearson_by_type(pairs).join(kendall_by_type(pairs), "cell_type")
            .join(spearman_by_type(pairs), "cell_type").where("pearson_r IS NOT NULL"))
    mid = lambda c: F.percentile(c, F.lit(0.5))
    out = corr.agg(F.count(F.lit(1)).alias("n_celltypes_scored"),
                   mid("kendall_tau").alias("kendall_tau_median"),
                   mid("pearson_r").alias("pearson_r_median"),
                   mid("spearman_rho").alias("spearman_rho_median"))
    lfc = marker_specificity_per_type(pairs, n_top)
    return out.withColumns({
        "marker_logfc_median": lfc.agg(mid("logfc")).scalar(),
        "n_marker_celltypes": lfc.agg(F.count("logfc")).scalar()})


def _minus_rest(c: str) -> Column:
    """Own value minus the mean over the other types, per feature (one row per type)."""
    w = Window.partitionBy("feature_name")
    others = F.count(F.lit(1)).over(w) - 1
    return F.col(c) - (F.sum(c).over(w) - F.col(c)) / F.nullif(others, F.lit(0))


def top_by_difference(pairs: DataFrame, n_top: int = 30) -> DataFrame:
    """Markers: largest reference difference to the other types, with the query's difference."""
    diff = pairs.withColumns({"ref_diff": _minus_rest("r"), "query_diff": _minus_rest("q")})
    return top_k_per_group(diff.where("ref_diff IS NOT NULL"), ["cell_type"],
                           [F.desc("ref_diff"), F.asc("feature_name")], n_top)


def marker_specificity_per_type(pairs: DataFrame, n_top: int = 30) -> DataFrame:
    """Median over a type's markers of the query's log difference (natural log)."""
    return top_by_difference(pairs, n_top).groupBy("cell_type").agg(
        F.percentile("query_diff", F.lit(0.5)).alias("logfc"))


# --- per-entity agreement with the own type -------------------------------------------

def top_by_ratio(profiles: DataFrame, genes: DataFrame, n: int = 15) -> DataFrame:
    """Top features per type by profile / mean profile over types."""
    dense = dense_profile(profiles, genes)
    overall = F.avg("value").over(Window.partitionBy("feature_name")) + 1e-9
    ratio = dense.withColumn("ratio", (F.col("value") + 1e-9) / overall)
    return top_k_per_group(ratio, ["cell_type"], [F.desc("ratio"), F.asc("feature_name")], n)


def per_cell_profile(counts: DataFrame, labels: DataFrame, profiles: DataFrame,
                     markers: DataFrame) -> DataFrame:
    """Correlation with the own type's profile, marker specificity and leakage per entity.

    All features of ``counts`` are the universe; correlations come from sparse sums over it."""
    n = counts.agg(F.countDistinct("feature_name")).scalar()
    universe = counts.select("feature_name").distinct()
    prof = profiles.join(universe, "feature_name", "left_semi")
    stats = prof.groupBy("cell_type").agg(F.sum("value").alias("sr"),
                                          F.sum(F.col("value") * F.col("value")).alias("srr"))
    own = markers.select("cell_type", "feature_name", F.lit(True).alias("own"))
    any_marker = markers.select("feature_name").distinct().withColumn("marker", F.lit(True))
    rows = (l1_normalize(counts).withColumnRenamed("value", "c")
            .join(labels.select("cell_id", "cell_type"), "cell_id")
            .join(prof.select("cell_type", "feature_name", F.col("value").alias("r")),
                  ["cell_type", "feature_name"], "left")
            .join(own, ["cell_type", "feature_name"], "left")
            .join(any_marker, "feature_name", "left"))
    c, r = F.col("c"), F.coalesce("r", F.lit(0.0))
    per = rows.groupBy("cell_id", "cell_type").agg(
        F.sum(c).alias("sc"), F.sum(c * c).alias("scc"), F.sum(c * r).alias("scr"),
        X.sum_if(F.col("marker").isNotNull(), c).alias("mass"),
        X.sum_if(F.col("own").isNotNull(), c).alias("own_mass"))
    full = per.join(stats, "cell_type").withColumn("n", n.cast("double")).where("sc > 0")
    spread = lambda s, q: F.greatest(F.col("n") * F.col(q) - F.col(s) * F.col(s), F.lit(0.0))
    num = F.col("n") * F.col("scr") - F.col("sc") * F.col("sr")
    den = F.sqrt(spread("sc", "scc")) * F.sqrt(spread("sr", "srr"))
    return full.select(
        "cell_id", "cell_type", F.when(den > 0, num / den).alias("ref_corr"),
        X.safe_div("own_mass", "mass").alias("marker_specificity"),
        F.when(F.col("mass") > 0, (F.col("mass") - F.col("own_mass"))
               / F.greatest("sc", F.lit(1e-12))).alias("marker_leakage"))


def per_cell_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    from molq.operators.accounting import grouped
    from molq.operators.coherence import _with_medians
    out = grouped(scores, by, F.avg("ref_corr").alias("reference_correlation_mean"),
                  F.avg("marker_specificity").alias("marker_specificity_mean"),
                  F.avg("marker_leakage").alias("marker_leakage_mean"),
                  F.count("ref_corr").alias("n_cells_scored"))
    return _with_medians(out, scores, ["ref_corr"], by).withColumnRenamed(
        "median_ref_corr", "reference_correlation_median")


def before_after_by_type(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per type: the mean scores before and after, their differences and the log2 ratio of
    specificity."""
    side = lambda df, s: df.groupBy("cell_type").agg(
        F.avg("ref_corr").alias(f"corr_{s}"), F.avg("marker_specificity").alias(f"spec_{s}"),
        F.avg("marker_leakage").alias(f"leak_{s}"))
    both = side(before, "before").join(side(after, "after"), "cell_type", "full")
    ratio = X.safe_div("spec_after", "spec_before")
    return both.withColumns({
        **{f"{c}_delta": F.col(f"{c}_after") - F.col(f"{c}_before") for c in ("corr", "spec", "leak")},
        "spec_log2_ratio": F.when(ratio > 0, F.log2(ratio))})


def type_medians(df: DataFrame, value: str = "spatial_log2fc") -> DataFrame:
    """Median per type of a marker-level value; a type has few markers."""
    return df.groupBy("cell_type").agg(F.percentile(value, F.lit(0.5)).alias(f"median_{value}"),
                                       F.count(value).alias("n_markers"))


def common_inputs(df: DataFrame, reference_counts: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Shared features, counts, centroids and the per-molecule label table of a correction run."""
    from molq.operators.accounting import cell_gene_counts, derive_cells
    genes = cut_lineage(shared_genes(df, reference_counts))
    tx = df.join(genes, "feature_name", "left_semi")
    return {"genes": genes, "counts": cell_gene_counts(tx, preset="core"),
            "cells": derive_cells(tx).join(labels.select("cell_id", "cell_type"), "cell_id", "left"),
            "molecules": tx.join(labels.select("cell_id", "cell_type"), "cell_id")}
