"""Marker selection, specificity, coverage and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions.ordering import average_ranks, top_k_per_group
from molq.operators.profiles import log_normalize, type_sizes
from molq.session import cut_lineage, stored_table


def rank_genes(counts: DataFrame, labels: DataFrame, n_top: int | None = 100,
               min_cells: int = 30, tie_correct: bool = False) -> DataFrame:
    """Rank-sum z of each feature in each type against the rest, on log-normalised counts.

    Types below min_cells are left out of the population. Zeros are one tied block handled in
    closed form, so only stored values are ranked. The order follows z; ``tie_correct`` picks
    the tie-corrected one. ``log2fc`` is the difference of means over ln 2.
    """
    sizes = type_sizes(labels).where(F.col("n_cells") >= min_cells)
    lab = labels.join(sizes.select("cell_type"), "cell_type", "left_semi").select("cell_id", "cell_type")
    n_all = lab.agg(F.count(F.lit(1))).scalar()
    vals = (log_normalize(counts).where("value > 0").join(lab, "cell_id")
            .select("cell_type", "feature_name", F.col("value").alias("v")))
    # Merge equal values per type first: what is ranked and joined is a histogram.
    # It is read several times, so it is derived once.
    hist = stored_table(vals.groupBy("cell_type", "feature_name", "v").agg(F.count(F.lit(1)).alias("w")), "histogram")
    ranks = average_ranks(hist, "v", ["feature_name"], weight="w")
    z0 = n_all - F.col("total")
    ties = ranks.groupBy("feature_name").agg(
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("t"), F.first("total").alias("total"))
    n = n_all.cast("double")
    ties = ties.withColumn("z0", n - F.col("total")).withColumn(
        "correction", 1.0 - X.safe_div(F.col("t") + F.pow("z0", F.lit(3)) - F.col("z0"), F.pow(n, F.lit(3)) - n))
    placed = ranks.select("feature_name", "v", (z0 + F.col("rank")).alias("rank"))
    per = (hist.join(placed, ["feature_name", "v"]).groupBy("cell_type", "feature_name").agg(
        F.sum(F.col("rank") * F.col("w")).alias("r_pos"), F.sum("w").alias("m"),
        F.sum(F.col("v") * F.col("w")).alias("s")))
    total_s = per.groupBy("feature_name").agg(F.sum("s").alias("s_all"))
    # Every (type, feature): types that never show the feature still rank, on zeros alone.
    # The few types go to the features, not the vocabulary to the types.
    types = sizes.agg(F.collect_list(F.struct("cell_type", "n_cells"))).scalar()
    grid = ties.withColumn("_t", F.explode(types)).select("*", "_t.*").drop("_t")
    full = (grid.join(per, ["cell_type", "feature_name"], "left")
            .join(total_s, "feature_name").na.fill(0, ["r_pos", "m", "s"]))
    nt = F.col("n_cells").cast("double")
    r_sum = F.col("r_pos") + (nt - F.col("m")) * (F.col("z0") + 1) / 2.0
    base = X.safe_div(r_sum - nt * (n + 1) / 2.0, F.sqrt(nt * (n - nt) * (n + 1) / 12.0))
    tied = F.when(F.col("correction") > 0, base / F.sqrt("correction"))
    fc = (F.col("s") / nt - X.safe_div(F.col("s_all") - F.col("s"), n - nt)) / F.ln(F.lit(2.0))
    out = full.select("cell_type", "feature_name", base.alias("z"), tied.alias("z_tie_corrected"),
                      fc.alias("log2fc"))
    key = "z_tie_corrected" if tie_correct else "z"
    order = [F.desc(key), F.asc("feature_name")]
    if n_top is None:
        return out.withColumn("rank", F.row_number().over(Window.partitionBy("cell_type").orderBy(*order)))
    return top_k_per_group(out, ["cell_type"], order, n_top)


def _feature_type_sums(counts: DataFrame, labels: DataFrame, markers: DataFrame) -> DataFrame:
    """(gene, label, s): summed log-normalised value of each marker feature per label."""
    wanted = markers.select(F.col("gene").alias("feature_name")).distinct()
    lab = labels.where(F.col("cell_type").isNotNull()).select("cell_id", F.col("cell_type").alias("label"))
    return (log_normalize(counts).join(wanted, "feature_name", "left_semi").join(lab, "cell_id")
            .groupBy(F.col("feature_name").alias("gene"), "label").agg(F.sum("value").alias("s")))


def marker_specificity(counts: DataFrame, labels: DataFrame, markers: DataFrame,
                       log_base: float | None = 2.0, min_cells: int = 5) -> DataFrame:
    """In-type versus out-of-type mean of each (type, marker), zeros included.

    ``labels`` lists every labelled entity of the matrix. ``log_base`` 2 divides by ln 2; None
    keeps the natural-log difference."""
    sums = _feature_type_sums(counts, labels, markers)
    sizes = type_sizes(labels)
    total = sizes.agg(F.sum("n_cells")).scalar()
    hit = (markers.select("cell_type", "gene").distinct().join(sums, "gene").groupBy("cell_type", "gene").agg(
        X.sum_if(F.col("label") == F.col("cell_type"), "s").alias("s_in"), F.sum("s").alias("s_all")))
    # A feature measured nowhere in the matrix is skipped; one measured elsewhere counts as 0.
    present = counts.select(F.col("feature_name").alias("gene")).distinct()
    out = (markers.join(present, "gene", "left_semi").join(sizes, "cell_type")
           .join(hit, ["cell_type", "gene"], "left").na.fill(0.0, ["s_in", "s_all"])
           .withColumn("n_cells_other", total - F.col("n_cells"))
           .where((F.col("n_cells") >= min_cells) & (F.col("n_cells_other") >= min_cells)))
    mean_in = F.col("s_in") / F.col("n_cells")
    mean_out = X.safe_div(F.col("s_all") - F.col("s_in"), "n_cells_other")
    diff = mean_in - mean_out
    return out.withColumns({
        "spatial_mean_in": mean_in, "spatial_mean_out": mean_out,
        "spatial_log2fc": diff if log_base is None else diff / F.ln(F.lit(float(log_base))),
        }).withColumnRenamed("n_cells", "n_cells_in_celltype").drop("s_in", "s_all")


# Lineage label fragments and canonical lineage features.
T_LABELS = ("T cells", "T_cells", "tT cells", "CD8 T", "CD4 T")
T_MARKERS = ("CD3D", "CD3E", "CD3G", "CD8A", "CD8B", "CD4", "TRAC", "TRBC1", "TRBC2", "NKG7",
             "GZMA", "GZMB", "GZMK", "PRF1", "IL7R", "LEF1", "TCF7", "TBX21", "FOXP3", "CTLA4",
             "PDCD1")


def lineage_markers(counts: DataFrame, labels: DataFrame, genes: Sequence[str] = T_MARKERS,
                    patterns: Sequence[str] = T_LABELS, log_base: float | None = 2.0,
                    min_cells: int = 5) -> DataFrame:
    """Specificity of a fixed feature list in all labels that contain one of the patterns."""
    hit = X.contains_any(F.lower("cell_type"), [p.lower() for p in patterns])
    two = labels.where(F.col("cell_type").isNotNull()).withColumn(
        "cell_type", F.when(hit, "lineage").otherwise("other"))
    names = F.array(*[F.lit(g) for g in genes])
    markers = counts.sparkSession.range(1).select(
        F.lit("lineage").alias("cell_type"), F.explode(names).alias("gene"))
    return marker_specificity(counts, two, markers, log_base, min_cells).drop("cell_type")


def reference_specificity(counts: DataFrame, labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """log2 in-versus-out difference of each candidate in the reference."""
    return marker_specificity(counts, labels, candidates, 2.0, 1).select(
        "cell_type", "gene", F.col("spatial_log2fc").alias("specificity"))


# Broad, stress and interferon features kept out of panels.
BROAD_OR_STRESS = (
    "ACTB", "ACTG1", "B2M", "FOS", "FOSB", "JUN", "JUNB", "JUND", "EGR1", "HSPA1A", "HSPA1B",
    "HSP90AA1", "HSP90AB1", "MALAT1", "MT-CO1", "MT-CO2", "MT-CO3", "MT-CYB", "MT-ND1", "MT-ND2",
    "MT-ND3", "MT-ND4", "MT-ND5", "MT-ND6", "MT-ATP6", "MT-ATP8", "IFI6", "IFI27", "IFI44",
    "IFI44L", "IFIT1", "IFIT2", "IFIT3", "ISG15", "MX1", "OAS1", "OAS2", "OAS3", "STAT1")


def marker_panel(canonical: DataFrame, fallback: DataFrame, platform: DataFrame,
                 ref_counts: DataFrame, ref_labels: DataFrame, target: int = 3, minimum: int = 2,
                 maximum: int = 5, min_specificity: float = 0.10, max_candidates: int | None = None,
                 broad: Sequence[str] = BROAD_OR_STRESS) -> DataFrame:
    """Audit of every candidate: canonical features first, then data-driven ones.

    canonical / fallback: cell_type, gene, rank. A lineage takes its best ``target`` eligible
    canonical features; with fewer than ``minimum`` of them, fallback ones fill up to target. ``max_candidates``
    bounds the priority of fallback candidates when a caller asks for it.
    """
    src = lambda df, name, n: df.select("cell_type", "gene", "rank", F.lit(name).alias("source"),
                                        F.lit(n).alias("_s"))
    by_type = Window.partitionBy("cell_type")
    known = canonical.select("cell_type").distinct()
    cands = src(canonical, "canonical", 0).unionByName(
        src(fallback.join(known, "cell_type", "left_semi"), "scrna_fallback", 1))
    first = Window.partitionBy("cell_type", "gene").orderBy("_s", "rank")
    cands = cands.withColumn("_d", F.row_number().over(first)).where("_d = 1")
    cands = cands.withColumn("priority", F.row_number().over(by_type.orderBy("_s", "rank", "gene")))
    if max_candidates is not None:
        cands = cands.where((F.col("_s") == 0) | (F.col("priority") <= max_candidates))
    cands = cut_lineage(cands)
    flag = lambda df, name: df.select(F.col("feature_name").alias("gene")).distinct().withColumn(
        name, F.lit(True))
    spec = reference_specificity(ref_counts, ref_labels, cands.select("cell_type", "gene"))
    rows = (cands.join(flag(platform, "in_platform"), "gene", "left")
            .join(flag(ref_counts, "in_ref"), "gene", "left").join(spec, ["cell_type", "gene"], "left"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    is_broad = F.upper("gene").isin(*broad)
    ok = yes("in_platform") & yes("in_ref") & ~is_broad & F.coalesce(
        F.col("specificity") >= min_specificity, F.lit(False))
    rows = rows.withColumns({"broad": is_broad, "eligible": ok, "canon": (F.col("_s") == 0) & ok})
    n_canon = F.count_if("canon").over(by_type)
    order = by_type.orderBy("priority").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    canon_rank = F.when(F.col("canon"), F.count_if("canon").over(order))
    rows = rows.withColumns({"n_canon": n_canon, "canon_rank": canon_rank})
    base = F.coalesce(F.col("canon_rank") <= target, F.lit(False))
    rows = rows.withColumn("base", base).withColumn("n_base", F.count_if("base").over(by_type))
    filler = F.col("eligible") & ~F.col("base")
    rows = rows.withColumn("filler", filler).withColumn(
        "filler_rank", F.when(F.col("filler"), F.count_if("filler").over(order)))
    # Filling appends the next eligible candidate and then checks the target.
    room = F.greatest(F.lit(target) - F.col("n_base"), F.lit(1))
    filled = (F.col("n_base") < minimum) & F.col("filler") & (F.col("filler_rank") <= room)
    position = F.when(F.col("base"), F.col("canon_rank")).when(
        filled, F.col("n_base") + F.col("filler_rank"))
    chosen = F.coalesce(position <= maximum, F.lit(False))
    # The reasons, in the order in which they apply.
    reason = (F.when(F.col("selected"), "")
              .when(~yes("in_platform"), "absent from platform panel")
              .when(F.col("specificity").isNull(), "not detected in scRNA reference")
              .when(F.col("broad"), "broad/stress/interferon marker avoided")
              .when(F.col("specificity") < min_specificity,
                    f"low scRNA specificity (<{min_specificity:g} log2FC)")
              .when((F.col("source") == "scrna_fallback") & (F.col("n_canon") >= target),
                    "canonical platform-present alternatives selected")
              .otherwise("not in top selected markers for lineage"))
    return (rows.withColumns({"selected": chosen, "panel_rank": F.when(chosen, position)})
            .withColumn("reason", reason)
            .select("cell_type", "gene", "source", "priority", "specificity", "broad", "eligible",
                    "selected", "panel_rank", "reason"))


def expression_frequency(counts: DataFrame, labels: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers with the share of entities expressing them in their type and in the others."""
    sizes = type_sizes(labels)
    total = sizes.agg(F.sum("n_cells")).scalar()
    wanted = markers.select(F.col("gene").alias("feature_name")).distinct()
    lab = labels.where(F.col("cell_type").isNotNull()).select("cell_id", F.col("cell_type").alias("label"))
    det = (counts.where("count > 0").join(wanted, "feature_name", "left_semi").join(lab, "cell_id")
           .groupBy(F.col("feature_name").alias("gene"), "label").agg(F.count(F.lit(1)).alias("d")))
    hit = markers.join(det, "gene").groupBy("cell_type", "gene").agg(
        X.sum_if(F.col("label") == F.col("cell_type"), "d").alias("d_in"), F.sum("d").alias("d_all"))
    out = (markers.join(sizes, "cell_type").join(hit, ["cell_type", "gene"], "left")
           .na.fill(0, ["d_in", "d_all"]))
    return out.withColumns({
        "frac_expr_in_type": X.safe_div("d_in", "n_cells"),
        "frac_expr_other": X.safe_div(F.col("d_all") - F.col("d_in"), total - F.col("n_cells")),
        }).drop("n_cells", "d_in", "d_all")


def marker_coverage(counts: DataFrame, labels: DataFrame, markers: DataFrame, component: str) -> DataFrame:
    """Entities in which a marker is detected, overall and within its target type.

    ``labels`` lists every entity of the component, with a NULL type where unlabelled."""
    n = labels.agg(F.count(F.lit(1))).scalar()
    sizes = type_sizes(labels).withColumnRenamed("n_cells", "n_target_entities")
    wanted = markers.select(F.col("gene").alias("feature_name")).distinct()
    det = (counts.where("count > 0").join(wanted, "feature_name", "left_semi")
           .join(labels.select("cell_id", F.col("cell_type").alias("label")), "cell_id")
           .groupBy(F.col("feature_name").alias("gene"), "label").agg(F.count(F.lit(1)).alias("d")))
    hit = markers.select("cell_type", "gene").distinct().join(det, "gene").groupBy("cell_type", "gene").agg(
        F.sum("d").alias("n_detected_entities"),
        X.sum_if(F.col("label") == F.col("cell_type"), "d").alias("n_detected_target_entities"))
    out = (markers.join(sizes, "cell_type", "left").join(hit, ["cell_type", "gene"], "left")
           .na.fill(0, ["n_target_entities", "n_detected_entities", "n_detected_target_entities"]))
    at_least = lambda c: F.greatest(c, F.lit(1).cast("long"))
    return out.withColumns({
        "component": F.lit(component), "n_entities": n,
        "fraction_detected_entities": F.col("n_detected_entities") / at_least(n),
        "fraction_detected_target_entities":
            F.col("n_detected_target_entities") / at_least(F.col("n_target_entities"))})


def marker_retention(refined: DataFrame, rebuilt: DataFrame, min_target: int = 10,
                     min_rebuilt_detected: int = 3, min_rebuilt_fraction: float = 0.10,
                     min_refined_detected: int = 5) -> DataFrame:
    """Keep flag and reasons per marker from the coverage of two components."""
    side = lambda df, s: df.select("cell_type", "gene", *[F.col(c).alias(f"{s}_{c}") for c in (
        "n_target_entities", "n_detected_target_entities", "fraction_detected_target_entities")])
    both = side(refined, "refined").join(side(rebuilt, "rebuilt"), ["cell_type", "gene"])
    c = F.col
    reasons = [
        (c("rebuilt_n_target_entities") < min_target, f"reconstructed target lineage n<{min_target}"),
        (c("refined_n_target_entities") < min_target, f"refined target lineage n<{min_target}"),
        (c("rebuilt_n_detected_target_entities") < min_rebuilt_detected,
         f"reconstructed target detections <{min_rebuilt_detected}"),
        (c("rebuilt_fraction_detected_target_entities") < min_rebuilt_fraction,
         f"reconstructed target detection fraction <{min_rebuilt_fraction:.2f}"),
        (c("refined_n_detected_target_entities") < min_refined_detected,
         f"refined target detections <{min_refined_detected}")]
    why = F.concat_ws("; ", *[F.when(cond, text) for cond, text in reasons])
    return both.withColumn("drop_reason", why).withColumn("retained", F.col("drop_reason") == "")


def combine_specificity(tables: DataFrame, replacement: DataFrame, replaced: Sequence[str],
                        retained: DataFrame) -> DataFrame:
    """Replace the rows of some methods and keep retained markers only."""
    kept = tables.where(~F.col("method").isin(*replaced)).unionByName(
        replacement, allowMissingColumns=True)
    return kept.join(retained.where("retained").select("cell_type", "gene"),
                     ["cell_type", "gene"], "left_semi")


def dominant_group(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Per entity: share of marker counts in its top group; ties go to the first group listed."""
    present = counts.join(groups, "feature_name")
    per = present.groupBy("cell_id", "group", "group_order").agg(F.sum("count").alias("c"))
    best = F.max_by("group", F.struct("c", -F.col("group_order")))
    return per.groupBy("cell_id").agg(
        best.alias("dominant_group"), F.max("c").alias("dominant_count"),
        F.sum("c").alias("total_marker_count")).where("total_marker_count > 0").withColumn(
        "specificity", F.col("dominant_count") / F.col("total_marker_count")).withColumn(
        "leakage", 1.0 - F.col("specificity"))


def dominant_group_summary(scores: DataFrame) -> DataFrame:
    from molq.operators.coherence import _with_medians
    cols = ("specificity", "leakage")
    out = scores.agg(F.count(F.lit(1)).alias("n_cells"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
    return _with_medians(out, scores, cols, ())


def detection_per_cell(counts: DataFrame, labels: DataFrame, markers: DataFrame) -> DataFrame:
    """Per entity: size and how many marker features it shows."""
    genes = markers.select(F.col("gene").alias("feature_name")).distinct().withColumn("hit", F.lit(1))
    n = markers.agg(F.countDistinct("gene")).scalar()
    per = counts.join(genes, "feature_name", "left").groupBy("cell_id").agg(
        F.sum("count").alias("n_transcripts"),
        F.count_if(F.col("hit").isNotNull() & (F.col("count") > 0)).alias("n_markers_detected"))
    return per.join(labels.select("cell_id", "cell_type"), "cell_id", "left").withColumn(
        "fraction_markers_detected", F.col("n_markers_detected") / F.greatest(n, F.lit(1)))


def detection_per_gene(counts: DataFrame, markers: DataFrame) -> DataFrame:
    n = counts.agg(F.countDistinct("cell_id")).scalar()
    genes = markers.select(F.col("gene").alias("feature_name")).distinct()
    det = counts.join(genes, "feature_name", "left_semi").groupBy(F.col("feature_name").alias("gene")).agg(
        F.count_if(F.col("count") > 0).alias("detected_cells"), F.sum("count").alias("total_transcripts"))
    return (markers.join(det, "gene", "left")
            .withColumn("present_in_matrix", F.col("detected_cells").isNotNull())
            .na.fill(0, ["detected_cells", "total_transcripts"])
            .withColumn("fraction_cells_detected", F.col("detected_cells") / F.greatest(n, F.lit(1))))


def detection_per_type(per_cell: DataFrame) -> DataFrame:
    mid = lambda c: F.percentile(c, F.lit(0.5))  # integer columns with few distinct values
    return per_cell.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_cells"), mid("n_transcripts").alias("median_transcripts"),
        F.avg("n_transcripts").alias("mean_transcripts"),
        mid("n_markers_detected").alias("median_markers_detected"),
        F.avg("n_markers_detected").alias("mean_markers_detected"),
        F.avg((F.col("n_markers_detected") > 0).cast("double")).alias("fraction_with_any_marker"))


def candidates_table(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(t, g, i) for t, genes in groups.items() for i, g in enumerate(genes, 1)]
    return df.sparkSession.createDataFrame(rows, "cell_type string, gene string, rank int")
