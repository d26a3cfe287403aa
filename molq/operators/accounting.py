"""Counts of molecules and entities: assigned, unassigned, recovered, removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions.ordering import quantiles
from molq.functions.tokens import (ASSIGNED_IN_METRICS, ASSIGNED_IN_STATS, CONTROL_PREFIXES,
                                   UNASSIGNED)
from molq.session import cut_lineage, stored_table


def median_of(value) -> Column:
    """Exact median of an integer size column. ``percentile`` keeps one counter per distinct
    value, and sizes take few distinct values, so this is bounded; real-valued scores go
    through ``functions.ordering.quantiles`` instead."""
    return F.percentile(X.col(value), F.lit(0.5))


def grouped(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def assigned_flag(df: DataFrame, cell_col: str, preset, etype_col: str | None,
                  classes: Sequence[str]) -> Column:
    if etype_col and etype_col in df.columns:
        return F.coalesce(F.col(etype_col).isin(*classes), F.lit(False))
    return ~X.is_unassigned(cell_col, preset)


def transcript_accounting(df: DataFrame, by: Sequence[str] = (), cell_col: str = "cell_id",
                          n_input: int | None = None) -> DataFrame:
    """total / assigned / unassigned / fraction / delta against the input size."""
    assigned = F.col(cell_col) != UNASSIGNED
    out = grouped(df, by, F.count(F.lit(1)).alias("n_total"), F.count_if(assigned).alias("n_assigned"))
    return out.withColumns({
        "n_unassigned": F.col("n_total") - F.col("n_assigned"),
        "frac_assigned": X.safe_div("n_assigned", "n_total"),
        "n_input": F.lit(n_input).cast("long"),
        "delta_vs_input": F.col("n_total") - F.lit(n_input).cast("long")})


def entity_sizes(df: DataFrame, by: Sequence[str] = (), cell_col: str = "cell_id",
                 name: str = "n_transcripts") -> DataFrame:
    return (df.where(F.col(cell_col) != UNASSIGNED).groupBy(*by, cell_col)
            .agg(F.count(F.lit(1)).alias(name)))


def entity_accounting(df: DataFrame, by: Sequence[str] = (), cell_col: str = "cell_id",
                      gene_col: str = "feature_name") -> DataFrame:
    """Distinct entities, distinct features (all molecules) and the median entity size."""
    genes = grouped(df.select(*by, gene_col).distinct(), by, F.count(gene_col).alias("n_genes"))
    sizes = grouped(entity_sizes(df, by, cell_col), by, F.count(F.lit(1)).alias("n_entities"),
                    median_of("n_transcripts").alias("median_transcripts_per_entity"))
    if by:
        out = genes.join(sizes, list(by), "left")
        return out.withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    return sizes.withColumn("n_genes", genes.select("n_genes").scalar())


def entity_class_accounting(df: DataFrame, by: Sequence[str] = (), id_col: str = "cell_id",
                            etype_col: str = "etype",
                            classes: Sequence[str] = ASSIGNED_IN_STATS) -> DataFrame:
    """Whole and partial entities from one per-entity flag table, so they are never pooled.
    A table without the class column falls back to plain entity accounting."""
    if etype_col not in df.columns:
        return entity_accounting(df, by, id_col)
    kind = F.col(etype_col)
    per = (df.groupBy(*by, id_col).agg(
        F.count_if(F.coalesce(kind.isin(*classes), F.lit(False))).alias("n_all"),
        F.count_if(kind == "cell").alias("n_whole"),
        F.count_if(kind == "partial").alias("n_part")))
    has = lambda c: F.col(c) > 0
    sizes = lambda c: F.when(has(c), F.col(c))
    out = grouped(
        per, by,
        F.count_if(has("n_all")).alias("n_entities"),
        F.count_if(has("n_whole")).alias("n_whole_cells"),
        F.count_if(has("n_part")).alias("n_partial_cells"),
        F.count_if(has("n_part") & ~has("n_whole")).alias("n_partial_only_cells"),
        F.count_if(has("n_part") & has("n_whole")).alias("n_whole_and_partial_cells"),
        median_of(sizes("n_all")).alias("median_transcripts_per_entity"),
        F.avg(sizes("n_whole")).alias("mean_transcripts_per_whole_cell"),
        median_of(sizes("n_whole")).alias("median_transcripts_per_whole_cell"),
        F.avg(sizes("n_part")).alias("mean_transcripts_per_partial_cell"),
        median_of(sizes("n_part")).alias("median_transcripts_per_partial_cell"))
    return out


def class_transcript_accounting(df: DataFrame, by: Sequence[str] = (), etype_col: str = "etype",
                                classes: Sequence[str] = ASSIGNED_IN_STATS) -> DataFrame:
    flag = F.coalesce(F.col(etype_col).isin(*classes), F.lit(False))
    out = grouped(df, by, F.count(F.lit(1)).alias("n_total"), F.count_if(flag).alias("n_assigned"))
    return out.withColumns({"n_unassigned": F.col("n_total") - F.col("n_assigned"),
                            "frac_assigned": X.safe_div("n_assigned", "n_total")})


def recovery_metrics(df: DataFrame, by: Sequence[str] = (), original_col="original_cell_id",
                     cell_col: str = "cell_id", etype_col: str | None = "etype",
                     preset="recovery") -> DataFrame:
    """Of the initially unassigned molecules, how many end up assigned."""
    initial = X.is_unassigned(original_col, preset)
    final = assigned_flag(df, cell_col, preset, etype_col, ASSIGNED_IN_METRICS)
    out = grouped(df, by, F.count_if(initial).alias("n_transcripts_initially_unassigned"),
                  F.count_if(initial & final).alias("n_transcripts_recovered"))
    pct = X.safe_div(F.col("n_transcripts_recovered") * 100.0,
                     "n_transcripts_initially_unassigned")
    # The notes are part of the result tables.
    return out.withColumns({
        "recovery_percent": pct,
        "recovery_percent_note": F.when(pct.isNull(),
                                        "input has no unassigned transcripts/bins")})


def entity_metrics(stats: DataFrame) -> DataFrame:
    """Per-method entity values with a reason wherever a value is undefined.

    ``stats``: method, n_entities, n_assigned, frac_assigned and optionally the whole/partial
    counts of producers that report them."""
    have = set(stats.columns)
    whole = F.col("n_whole_cells") if "n_whole_cells" in have else F.lit(None).cast("long")
    part = F.col("n_partial_cells") if "n_partial_cells" in have else F.lit(None).cast("long")
    return stats.withColumns({
        "assignment_percent": F.col("frac_assigned") * 100.0,
        "assignment_percent_note": F.when(
            F.col("frac_assigned").isNull(),
            "method has no transcript/bin-level assignment"),
        "mean_transcripts_per_profile": F.when(
            (F.col("n_assigned") > 0) & (F.col("n_entities") > 0),
            F.col("n_assigned").cast("double") / F.col("n_entities")),
        "n_whole_cells_note": F.when(whole.isNull(), "method emits whole/called cells only"),
        "n_partial_cells_note": F.when(part.isNull(), "method does not emit partial entities"),
        "n_whole_cells": F.coalesce(whole, F.col("n_entities")),
        "n_partial_cells": F.coalesce(part, F.lit(0).cast("long"))})


def runtime_metrics(stats: DataFrame) -> DataFrame:
    """Projection of the nested run statistics; in-process memory is flagged as such."""
    source = F.col("memory.source")
    return stats.select(
        "method", F.col("runtime.total_seconds").alias("runtime_total_s"),
        F.col("runtime.method_seconds").alias("runtime_method_s"),
        F.col("memory.peak_rss_gb").alias("peak_rss_gb"), source.alias("peak_rss_source"),
        F.when(source == "unmeasured", "peak RSS was not measured for this run")
        .when(source.isNull() | (source != "external_time"),
              "measured in-process; an underestimate relative to external timing")
        .alias("peak_rss_gb_note"))


def _long(row: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return row.select(*by, F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))


def assignment_pre_post(df: DataFrame, post_col: str = "cell_id",
                        pre_col: str = "original_cell_id", etype_col: str | None = "etype",
                        preset="metric", by: Sequence[str] = ()) -> DataFrame:
    """Pre/post counts and deltas as (metric, value) rows, from a single pass over the table
    that carries both assignments."""
    post = assigned_flag(df, post_col, preset, etype_col, ASSIGNED_IN_METRICS)
    pre = ~X.is_unassigned(pre_col, preset)
    row = grouped(df, by, F.count(F.lit(1)).alias("n"), F.count_if(post).alias("a_post"),
                  F.count_if(pre).alias("a_pre"))
    n, a, b = F.col("n"), F.col("a_post"), F.col("a_pre")
    share = lambda c: c / F.greatest(n, F.lit(1))
    row = row.withColumns({
        "n_total_transcripts_post": n, "n_assigned_transcripts_post": a,
        "n_unassigned_transcripts_post": n - a, "frac_assigned_post": share(a),
        "n_total_transcripts_pre": n, "n_assigned_transcripts_pre": b,
        "n_unassigned_transcripts_pre": n - b, "frac_assigned_pre": share(b),
        "delta_assigned_post_minus_pre": a - b, "delta_unassigned_post_minus_pre": b - a})
    return _long(row, [c for c in row.columns if c not in ("n", "a_post", "a_pre", *by)], by)


def kept_entities(df: DataFrame, min_tx: int, max_tx: int, cell_col: str = "cell_id",
                  preset="metric", bounds: str = "closed", by: Sequence[str] = ()) -> DataFrame:
    """Entities whose size lies in the band; a table, never a driver-side set."""
    return (df.where(~X.is_unassigned(cell_col, preset)).groupBy(*by, cell_col)
            .agg(F.count(F.lit(1)).alias("n_transcripts"))
            .where(X.within("n_transcripts", min_tx, max_tx, bounds)))


def cell_counts(df: DataFrame, min_tx: int, max_tx: int, cell_col: str = "cell_id",
                etype_col: str | None = "etype", order_col: str | None = None,
                preset="metric", bounds: str = "closed") -> DataFrame:
    """Entities before and after the size filter, with class counts and medians.

    The class of an entity is that of its first molecule in ``order_col``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    has_class = bool(etype_col) and etype_col in df.columns
    if has_class and not order_col:
        raise ValueError("the class of an entity needs order_col: which molecule counts as the first")
    if has_class:
        aggs.append(F.min_by(etype_col, order_col).alias("kind"))
    per = df.where(~X.is_unassigned(cell_col, preset)).groupBy(cell_col).agg(*aggs)
    ok = X.within("n", min_tx, max_tx, bounds)
    of_class = lambda k: (F.count_if(F.col("kind") == k) if has_class
                          else F.lit(None).cast("long"))
    row = per.agg(
        F.count(F.lit(1)).alias("n_total_entities_pre_filter"),
        F.count_if(ok).alias("n_total_entities_post_filter"),
        of_class("cell").alias("n_cells"), of_class("partial").alias("n_partials"),
        of_class("component").alias("n_components"),
        F.coalesce(median_of("n"), F.lit(0.0)).alias("median_tx_per_entity_pre_filter"),
        F.coalesce(median_of(F.when(ok, F.col("n"))), F.lit(0.0))
        .alias("median_tx_per_entity_post_filter")).withColumns({
            "min_transcripts_per_cell": F.lit(min_tx), "max_transcripts_per_cell": F.lit(max_tx)})
    return _long(row, ["n_total_entities_pre_filter", "n_total_entities_post_filter",
                       "min_transcripts_per_cell", "max_transcripts_per_cell", "n_cells",
                       "n_partials", "n_components", "median_tx_per_entity_pre_filter",
                       "median_tx_per_entity_post_filter"])


def cell_gene_counts(df: DataFrame, cell_col: str = "cell_id", by: Sequence[str] = (),
                     preset="metric", keep: DataFrame | None = None) -> DataFrame:
    """(by..., cell_id, feature_name, count). Partial aggregation runs before the shuffle, so a
    mega-entity reaches the reducers as at most one row per feature and map task."""
    sub = df.where(~X.is_unassigned(cell_col, preset))
    if keep is not None:
        sub = sub.join(keep.select(cell_col).distinct(), cell_col, "left_semi")
    return (sub.groupBy(*by, F.col(cell_col).alias("cell_id"), "feature_name")
            .agg(F.count(F.lit(1)).alias("count")))


def derive_cells(df: DataFrame, cell_col: str = "cell_id", by: Sequence[str] = ()) -> DataFrame:
    """Centroid, size and distinct features per entity; features are merged first so the
    distinct count needs no expansion of the molecule rows."""
    per_gene = (df.where(~X.is_unassigned(cell_col)).groupBy(
        *by, F.col(cell_col).alias("cell_id"), "feature_name")
        .agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n")))
    n = F.sum("n")
    return per_gene.groupBy(*by, "cell_id").agg(
        (F.sum("sx") / n).alias("centroid_x"), (F.sum("sy") / n).alias("centroid_y"),
        n.alias("n_transcripts"), F.count(F.lit(1)).alias("n_genes"))


def bundle_cells(df: DataFrame, cell_col: str = "cell_id", min_side: float = 0.5) -> DataFrame:
    """Entity table with nuclear counts and the bounding-box area, each side at least
    ``min_side``."""
    side = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(min_side))
    return (df.where(~X.is_unassigned(cell_col)).groupBy(F.col(cell_col).alias("cell_id")).agg(
        F.avg("x").alias("x_centroid"), F.avg("y").alias("y_centroid"),
        F.count(F.lit(1)).alias("transcript_counts"),
        F.sum(F.col("overlaps_nucleus").cast("long")).alias("nucleus_counts"),
        (side("x") * side("y")).alias("cell_area")))


def merge_cells_counts(cells: DataFrame, df: DataFrame, cell_col: str = "cell_id") -> DataFrame:
    """Vendor cell rows with recomputed counts; an entity without molecules gets zeros."""
    counts = (cell_gene_counts(df, cell_col, preset="core").groupBy("cell_id")
              .agg(F.sum("count").alias("n_transcripts"), F.count(F.lit(1)).alias("n_genes")))
    zero = F.lit(0).cast("long")
    return (cells.drop("n_transcripts", "n_genes").join(counts, "cell_id", "left")
            .withColumns({c: F.coalesce(c, zero) for c in ("n_transcripts", "n_genes")}))


def cell_qc(counts: DataFrame, mito_prefix: str = "MT-", by: Sequence[str] = ()) -> DataFrame:
    """Counts, features and mitochondrial share per entity; NULL share when the panel holds no
    such feature."""
    mito = F.upper("feature_name").startswith(mito_prefix)
    in_panel = counts.agg(F.coalesce(F.max(mito), F.lit(False))).scalar()
    per = counts.groupBy(*by, "cell_id").agg(
        F.sum("count").alias("n_transcripts"), F.count_if(F.col("count") > 0)
        .alias("n_genes_detected"), X.sum_if(mito, "count").alias("m"))
    return per.select(*by, "cell_id", "n_transcripts", "n_genes_detected", F.when(
        in_panel, F.col("m") * 100.0 / F.greatest("n_transcripts", F.lit(1))).alias("pct_mito"))


def cell_qc_summary(qc: DataFrame) -> DataFrame:
    mito = quantiles(qc, "pct_mito", {"m": 0.5})
    return qc.agg(
        F.count(F.lit(1)).alias("n_cells_filtered"),
        median_of("n_transcripts").alias("median_transcripts_per_cell"),
        median_of("n_genes_detected").alias("median_genes_per_cell"),
        F.avg("n_transcripts").alias("mean_transcripts_per_cell"),
        F.avg("n_genes_detected").alias("mean_genes_per_cell"),
    ).withColumn("median_pct_mito", mito.select("m").scalar())


def matrix_stats(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    per = counts.groupBy(*by, "cell_id").agg(F.sum("count").alias("n"),
                                             F.count_if(F.col("count") > 0).alias("g"))
    cells = grouped(per, by, F.count(F.lit(1)).alias("n_cells"),
                    median_of("n").alias("median_counts_per_cell"),
                    median_of("g").alias("median_genes_per_cell"),
                    F.sum("n").alias("total_counts"))
    genes = grouped(counts.select(*by, "feature_name").distinct(), by,
                    F.count(F.lit(1)).alias("n_genes"))
    if by:
        return cells.join(genes, list(by))
    return cells.withColumn("n_genes", genes.select("n_genes").scalar())


def basic_stats(df: DataFrame, by: Sequence[str] = ("method",), cell_col="cell_id") -> DataFrame:
    """Retention fraction and per-entity medians."""
    tx = grouped(df, by, F.count(F.lit(1)).alias("n_transcripts"),
                 F.count_if(~X.is_unassigned(cell_col)).alias("n_assigned"))
    per = cell_gene_counts(df, cell_col, by, "core").groupBy(*by, "cell_id").agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("g"))
    cells = grouped(per, by, F.count(F.lit(1)).alias("n_cells"),
                    median_of("n").alias("median_transcripts_per_cell"),
                    median_of("g").alias("median_genes_per_cell"))
    return (tx.join(cells, list(by), "left")
            .withColumn("assigned_fraction", X.safe_div("n_assigned", "n_transcripts")))


def relative_to_baseline(metrics: DataFrame, value_cols: Sequence[str], baseline: str,
                         method_col: str = "method") -> DataFrame:
    """Adds ``<metric>_vs_baseline``. The baseline is one row, read as scalar subqueries."""
    base = metrics.where(F.col(method_col) == baseline)
    return metrics.withColumns({
        f"{c}_vs_baseline": F.col(c) - base.agg(F.max(c)).scalar() for c in value_cols})


def gene_unassigned(df: DataFrame, by: Sequence[str] = (), cell_col: str = "cell_id",
                    preset="figure", prefixes: Sequence[str] = CONTROL_PREFIXES) -> DataFrame:
    """Per feature: total molecules and the share left unassigned."""
    return (df.where(~X.is_control("feature_name", prefixes)).groupBy(*by, "feature_name").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(X.is_unassigned(cell_col, preset)).alias("n_affected"))
        .withColumn("fraction_affected", F.col("n_affected")
                    / F.greatest("total_count", F.lit(1))))


def _paired(original: DataFrame, purified: DataFrame) -> DataFrame:
    """(cell_id, feature_name, original_count, purified_count, in_original, in_purified): both count tables
    in one union and one group-by, stored, so that each table is derived once."""
    side = lambda df, mine: df.select(
        "cell_id", "feature_name", F.when(F.lit(mine), F.col("count").cast("double")).alias("o"),
        F.when(F.lit(not mine), F.col("count").cast("double")).alias("p"), F.lit(mine).alias("mine"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return cut_lineage(side(original, True).unionByName(side(purified, False)).groupBy("cell_id", "feature_name").agg(
        total("o").alias("original_count"), total("p").alias("purified_count"),
        F.max("mine").alias("in_original"), F.max(~F.col("mine")).alias("in_purified")))


def _known(pairs: DataFrame, key: str) -> DataFrame:
    """Per entity or feature: which of the two tables know it."""
    return pairs.groupBy(key).agg(F.max("in_original").alias("o"), F.max("in_purified").alias("p"))


def _shared(pairs: DataFrame) -> DataFrame:
    """The pairs over the entities and features that both tables know."""
    both = lambda key: _known(pairs, key).where("o AND p").select(key)
    return (pairs.join(both("cell_id"), "cell_id", "left_semi").join(both("feature_name"), "feature_name", "left_semi")
            .select("cell_id", "feature_name", "original_count", "purified_count",
                    (F.col("original_count") - F.col("purified_count")).alias("removed_count")))


def _aligned(original: DataFrame, purified: DataFrame) -> DataFrame:
    return _shared(_paired(original, purified))


def removed_by_gene(original: DataFrame, purified: DataFrame) -> DataFrame:
    """Per-feature removed mass over shared entities and features, clipped at zero."""
    return (_aligned(original, purified).groupBy("feature_name")
            .agg(F.sum("original_count").alias("total_count"),
                 F.greatest(F.sum("removed_count"), F.lit(0.0)).alias("n_affected"))
            .withColumn("fraction_affected", F.col("n_affected")
                        / F.greatest("total_count", F.lit(1.0))))


def removed_counts(original: DataFrame, purified: DataFrame) -> DataFrame:
    """The (entity, feature) level: rows where either table has mass."""
    return _aligned(original, purified).where(
        (F.col("original_count") > 0) | (F.col("purified_count") > 1e-6))


def pruning_levels(original: DataFrame, purified: DataFrame) -> DataFrame:
    """Removed mass per feature and per entity in one pass: GROUPING SETS over one join."""
    removed = _aligned(original, purified)
    grouping = removed.groupingSets([["feature_name"], ["cell_id"]], "feature_name", "cell_id")
    return grouping.agg(
        F.sum("original_count").alias("original_count"),
        F.sum("purified_count").alias("purified_count"),
        F.sum("removed_count").alias("removed_count_raw"),
        F.sum(F.greatest("removed_count", F.lit(0.0))).alias("removed_count_clamped"),
    ).select(F.when(F.col("feature_name").isNotNull(), "feature").otherwise("entity")
             .alias("level"), F.coalesce("feature_name", "cell_id").alias("key"),
             "original_count", "purified_count", "removed_count_raw", "removed_count_clamped")


def pruning_summary(original: DataFrame, purified: DataFrame, n_unassigned: Column | int,
                    eps: float = 1e-6) -> DataFrame:
    """Removal totals, negative-difference audit and the pseudo-unassigned estimate."""
    d = F.col("removed_count")
    p = F.col("purified_count")
    pairs = _paired(original, purified)
    totals = _shared(pairs).agg(
        F.sum("original_count").alias("original_assigned_count"),
        F.sum("purified_count").alias("purified_retained_count"),
        F.sum(F.greatest(d, F.lit(0.0))).alias("estimated_removed_count"),
        F.max(F.abs(p - F.bround(p, 0)) > 1e-6).alias("purified_counts_are_fractional"),
        F.count_if(d < -eps).alias("n_negative_differences_before_clamping"),
        F.coalesce(F.sum(F.when(d < -eps, -d)), F.lit(0.0))
        .alias("total_negative_magnitude_before_clamping"))
    sizes = {key: _known(pairs, key).agg(F.count_if("o").alias("o"), F.count_if("p").alias("p"),
                                         F.count_if(F.col("o") & F.col("p")).alias("both")) for key in ("cell_id", "feature_name")}
    size = lambda key, c: sizes[key].select(c).scalar()
    lost = n_unassigned if isinstance(n_unassigned, Column) else F.lit(n_unassigned)
    return totals.withColumns({
        "original_unassigned_count": lost.cast("long"),
        "pseudo_post_cleaning_unassigned_count": lost + F.col("estimated_removed_count"),
        "fraction_removed_of_original_assigned": F.when(
            F.col("original_assigned_count") > 0,
            F.col("estimated_removed_count") / F.col("original_assigned_count")).otherwise(0.0),
        "n_cells_original": size("cell_id", "o"), "n_cells_purified": size("cell_id", "p"), "n_cells_aligned": size("cell_id", "both"),
        "n_genes_original": size("feature_name", "o"), "n_genes_purified": size("feature_name", "p"),
        "n_genes_aligned": size("feature_name", "both")})


def frequency(df: DataFrame, key: str, by: Sequence[str] = (), count_name: str = "n_cells",
              restrict: Column | None = None) -> DataFrame:
    """n and fraction per label; the totals window sees one row per label."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = df if restrict is None else df.where(restrict)
    return (rows.where(F.col(key).isNotNull()).groupBy(*by, key)
            .agg(F.count(F.lit(1)).alias(count_name))
            .withColumn("fraction", F.col(count_name) / F.sum(count_name).over(part)))


# Spot classes of the mixture fit.
SPOT_CLASSES = ("singlet", "doublet_certain", "doublet_uncertain", "reject")


def class_info_summary(cells: DataFrame, class_col: str = "spot_class",
                       depth_col: str = "n_transcripts", by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares per spot class (unannotated = NULL class) and depth statistics."""
    c = F.col(class_col)
    n = F.count(F.lit(1))
    counts = {f"n_{k}": F.count_if(c == k) for k in SPOT_CLASSES}
    counts["n_unannotated"] = F.count_if(c.isNull())
    return grouped(cells, by, n.alias("n_cells"), *[v.alias(k) for k, v in counts.items()],
                   *[(v / n).alias(k.replace("n_", "frac_", 1)) for k, v in counts.items()],
                   F.avg(depth_col).alias("mean_depth"), median_of(depth_col).alias("median_depth"))


def combine_info(frames: Sequence[DataFrame], size_col: str = "n_cells",
                 zero_cols: Sequence[str] = ()) -> DataFrame:
    """Stack info rows; NULL becomes 0 only where the row has cells at all."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumns({c: F.when(F.col(size_col) > 0, F.coalesce(F.col(c), F.lit(0)))
                            .otherwise(F.col(c)) for c in zero_cols})


def abundant_types(profiles: DataFrame, min_n: int, type_col: str = "cell_type",
                   n_methods: int | None = None) -> DataFrame:
    """Types with at least min_n profiles in at least half of the methods."""
    per = profiles.where(F.col(type_col).isNotNull()).groupBy(type_col, "method").agg(
        F.count(F.lit(1)).alias("n"))
    methods = (F.lit(n_methods) if n_methods is not None
               else profiles.agg(F.countDistinct("method")).scalar())
    return (per.groupBy(type_col).agg(F.count_if(F.col("n") >= min_n).alias("n_methods"))
            .where(F.col("n_methods") >= F.ceil(methods / 2.0)))


def mixture_summary(cells: DataFrame, abundant: DataFrame, type_col: str = "cell_type") -> DataFrame:
    """Median entropy and max weight per (method, type) and over all abundant types."""
    rows = cells.join(abundant.select(type_col), type_col, "left_semi")
    both = rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.col(type_col))))
    return _medians(both, ("entropy", "max_weight"), ("method", "scope"))


def _medians(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Exact group medians of real-valued columns, one unpivot and one ranked pass."""
    long = df.select(*by, F.expr("stack({}, {}) AS (_m, _v)".format(
        len(cols), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols))))
    q = quantiles(long, "_v", {"median": 0.5}, [*by, "_m"])
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("_m") == c, F.col("median")))
                                .alias(f"median_{c}") for c in cols])


group_medians = _medians


def per_cell_medians(cells: DataFrame, restrict: DataFrame | None = None) -> DataFrame:
    """Per method: median entropy / max weight and the singlet and reject shares."""
    rows = cells if restrict is None else cells.join(
        restrict.select("cell_id").distinct(), "cell_id", "left_semi")
    share = lambda k: F.avg((F.col("spot_class") == k).cast("double")).alias(f"frac_{k}")
    counts = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n_cells_scored"),
                                        share("singlet"), share("reject"))
    return counts.join(_medians(rows, ("entropy", "max_weight"), ("method",)), "method", "left")


def entity_class(df: DataFrame, id_col: str = "cell_id", etype_col: str = "etype",
                 order_col: str = "transcript_id") -> DataFrame:
    """Class per entity, taken from its first row in an explicit order."""
    return df.groupBy(id_col).agg(F.min_by(etype_col, order_col).alias(etype_col))


def stratify_entities(scores: DataFrame, classes: DataFrame, value_cols: Sequence[str],
                      id_col: str = "cell_id", etype_col: str = "etype") -> DataFrame:
    """Medians and counts per stratum: whole, partial, other."""
    stratum = (F.when(F.col(etype_col) == "cell", "whole")
               .when(F.col(etype_col) == "partial", "partial").otherwise("other"))
    # Counts and medians read the rows several times, so they are derived once.
    rows = stored_table(scores.join(classes, id_col, "left").select(stratum.alias("stratum"), *value_cols), "strata")
    n = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_entities"))
    return n.join(_medians(rows, value_cols, ("stratum",)), "stratum", "left")


def size_distribution(df: DataFrame, low: int = 10, high: int = 900, bounds: str = "open",
                      by: Sequence[str] = ("method",)) -> DataFrame:
    """Entities and in-range entities per method."""
    return entity_sizes(df, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(X.within("n_transcripts", low, high, bounds)).alias("n_in_range"),
        median_of("n_transcripts").alias("median_size"))


def zero_filled_sizes(ids: DataFrame, df: DataFrame, cell_col: str = "cell_id") -> DataFrame:
    """Sizes over a full id list, zero where the method assigned nothing."""
    sizes = entity_sizes(df, (), cell_col)
    return (ids.select(cell_col).distinct().join(sizes, cell_col, "left")
            .withColumn("n_transcripts", F.coalesce("n_transcripts", F.lit(0))))


def group_summary(df: DataFrame, value: str, by: Sequence[str] = ("method",)) -> DataFrame:
    """n, mean and standard error, and the exact median of a real-valued column."""
    v = X.finite(value)
    stats = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias(f"mean_{value}"),
                                (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"sem_{value}"))
    return stats.join(_medians(df, (value,), by), list(by), "left")


def cell_funnel(stages: DataFrame) -> DataFrame:
    """stages(method, ord, stage, n_cells) with losses against the previous and first stage."""
    w = Window.partitionBy("method").orderBy("ord")
    return stages.select(
        "method", "stage", "n_cells",
        (F.lag("n_cells").over(w) - F.col("n_cells")).alias("lost_vs_previous"),
        X.safe_div("n_cells", F.first("n_cells").over(w)).alias("frac_of_first"))


def describe_disjointness(obs: DataFrame, split_col: str, heldout_value: str,
                          cohort_col: str) -> DataFrame:
    """Cohorts on each side of a split. Cohorts (donors, studies) are few by nature; they are
    made distinct before they are gathered."""
    held = F.col(split_col).cast("string") == heldout_value
    per = obs.groupBy(F.col(cohort_col).cast("string").alias("c")).agg(
        F.coalesce(F.max(held), F.lit(False)).alias("h"),
        F.coalesce(F.max(~held), F.lit(True)).alias("r"))
    pick = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("c")))), ",")
    return per.agg(pick(F.col("h")).alias("heldout_cohorts"), pick(F.col("r")).alias("other_cohorts"),
                   pick(F.col("h") & F.col("r")).alias("shared_cohorts"),
                   (F.count_if(F.col("h") & F.col("r")) == 0).alias("is_disjoint"))


def common_celltypes(obs: DataFrame, min_cells: int = 50, label_col="cell_type") -> DataFrame:
    return (obs.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("cell_type"))
            .agg(F.count(F.lit(1)).alias("n_cells"))
            .withColumn("kept", F.col("n_cells") >= min_cells))


def regime_medians(cells: DataFrame, value: str, rare_below: int, common_from: int,
                   type_col: str = "cell_type") -> DataFrame:
    """Medians per method under three regimes: all types, without rare ones, and only the types
    that are common for every method."""
    per = cells.groupBy("method", type_col).agg(F.count(F.lit(1)).alias("n"))
    n_methods = cells.agg(F.countDistinct("method")).scalar()
    shared = (per.where(F.col("n") >= common_from).groupBy(type_col)
              .agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == n_methods)
              .select(type_col, F.lit(True).alias("shared")))
    # Type-level tables are tiny, so these joins broadcast by their measured size.
    rows = cells.join(per, ["method", type_col]).join(shared, type_col, "left")
    regimes = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("n") >= rare_below, "no_rare"),
        F.when(F.col("shared"), "shared_common")))
    return _medians(rows.withColumn("regime", F.explode(regimes)), (value,), ("method", "regime"))


def cell_mean_integrity(df: DataFrame, value: str = "signal_integrity",
                        cell_col: str = "cell_id") -> DataFrame:
    return (df.where(~X.is_unassigned(cell_col)).groupBy(F.col(cell_col).alias("cell_id"))
            .agg(F.avg(value).alias("mean_integrity")))


def integrity_filtered_counts(df: DataFrame, threshold: float,
                              value: str = "signal_integrity") -> DataFrame:
    return cell_gene_counts(df.where(F.col(value) > threshold), preset="core")


def integrity_summary(df: DataFrame, value: str, low: float = 0.5,
                      by: Sequence[str] = ()) -> DataFrame:
    v = X.finite(value)
    stats = grouped(df, by, F.count(v).alias("n_scored"), F.avg(v).alias("mean_value"),
                    F.count_if(v < low).alias("n_low"),
                    X.safe_div(F.count_if(v < low), F.count(v)).alias("fraction_low"))
    med = quantiles(df, value, {"median_value": 0.5}, by)
    if by:
        return stats.join(med, list(by), "left")
    return stats.withColumn("median_value", med.select("median_value").scalar())


def entity_integrity(pixels: DataFrame) -> DataFrame:
    """(entity, pixel) rows collapse to one signal-weighted mean per entity."""
    return pixels.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum("signal").alias("signal_total"),
        X.safe_div(F.sum(F.col("vsi") * F.col("signal")), F.sum("signal")).alias("vsi_weighted"))


def class_mode(df: DataFrame, annotation: str, class_col: str) -> DataFrame:
    """Most frequent class per annotation; ties go to the first name."""
    counts = df.groupBy(annotation, class_col).agg(F.count(F.lit(1)).alias("n"))
    from molq.functions.ordering import top_k_per_group
    return top_k_per_group(counts, [annotation], [F.desc("n"), F.asc(class_col)], 1).drop("rank")


def roi_receipt(df: DataFrame, by: Sequence[str] = ("roi_id",), preset="window") -> DataFrame:
    lost = X.is_unassigned("cell_id", preset)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_transcripts"), F.countDistinct("feature_name").alias("n_genes"),
        F.countDistinct(F.when(~lost, F.col("cell_id"))).alias("n_cells"),
        F.count_if(lost).alias("n_unassigned"))


def gene_universe_audit(counts: DataFrame, panel_share: float = 1.0) -> DataFrame:
    """Per method: features measured, share of the union, and how missing ones are completed."""
    per = counts.select("method", "feature_name").distinct().groupBy("method").agg(
        F.count(F.lit(1)).alias("n_genes"))
    union = counts.agg(F.countDistinct("feature_name")).scalar()
    full = F.col("share_of_union") >= panel_share
    return (per.withColumn("n_union", union)
            .withColumn("share_of_union", F.col("n_genes") / F.col("n_union"))
            .withColumns({
                "panel_type": F.when(full, "full_panel").otherwise("restricted_panel"),
                "completion": F.when(full, "none").otherwise("inherit_original")}))


def block_value(cells: DataFrame, abundant: DataFrame, value: str) -> DataFrame:
    """Median of a per-cell value per method, over abundant types only."""
    rows = cells.join(abundant.select("cell_type"), "cell_type", "left_semi")
    return _medians(rows, (value,), ("method",))


def original_counts(df: DataFrame, cell_col: str = "original_cell_id") -> tuple[DataFrame, DataFrame]:
    """Counts of the input assignment, and its assigned / unassigned totals."""
    lost = X.is_unassigned(cell_col)
    totals = df.agg(F.count_if(~lost).alias("n_assigned"), F.count_if(lost).alias("n_unassigned"))
    return cell_gene_counts(df, cell_col, preset="core"), totals
