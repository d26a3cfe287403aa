"""End-to-end plans: score every method, per-method metrics, and window design."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.operators import accounting as A
from molq.operators import coherence as H
from molq.operators import markers as M
from molq.operators import profiles as P
from molq.operators import spatial as S
from molq.operators import tidy as Y
from molq.operators import transfer as T
from molq.session import cut_lineage, stored_table


def method_scorecard(df: DataFrame, dataset: str) -> DataFrame:
    """Assignment, recovery and entity accounting of every method, as tidy long rows.

    ``method`` is a column, so all runs share one plan and there is no loop over them."""
    by = ["method"]
    classes = A.entity_class_accounting(df, by)
    tx = A.transcript_accounting(df, by).select(*by, "n_total", "n_assigned", "n_unassigned", "frac_assigned")
    wide = (tx.join(A.recovery_metrics(df, by), by).join(classes, by)
            .withColumns({"assignment_percent": F.col("frac_assigned") * 100.0,
                          "mean_transcripts_per_profile": X.safe_div("n_assigned", "n_entities"),
                          "dataset": F.lit(dataset)}))
    return Y.wide_to_long(wide)


def method_metrics(df: DataFrame, ref_counts: DataFrame, ref_obs: DataFrame, panel: DataFrame,
                   min_tx: int = 10, max_tx: int = 900, k: int = 15, per_type: int = 300, n_markers: int = 30,
                   skip: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The lettered metric set of one assignment table: assignment, entity counts, QC, labels,
    reference agreement, marker specificity, coherence. The kept entities are a semi join."""
    out = {"assignment": A.assignment_pre_post(df), "entities": A.cell_counts(df, min_tx, max_tx, order_col="transcript_id")}
    counts = cut_lineage(A.cell_gene_counts(df, keep=A.kept_entities(df, min_tx, max_tx)))
    if "qc" not in skip:
        out["qc"] = A.cell_qc(counts)
    if "labels" not in skip:
        labels = cut_lineage(T.transfer_labels(counts, ref_counts, ref_obs, k, per_type).select(
            "cell_id", F.col("predicted_celltype").alias("cell_type"), "confidence"))
        out["labels"] = labels
        out["frequency"] = A.frequency(labels, "cell_type")
        out["consistency"] = P.reference_consistency(counts, labels, ref_counts, ref_obs)
        markers = cut_lineage(M.rank_genes(ref_counts, ref_obs, n_markers).select(
            "cell_type", F.col("feature_name").alias("gene"), "rank", F.col("log2fc").alias("scrna_log2fc")))
        out["markers"] = M.marker_specificity(counts, labels, markers)
    if "coherence" not in skip:
        scores = H.score_counts(counts, panel)
        out["coherence"] = H.coherence_summary(scores)
    return out


def metrics_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of headline numbers from the lettered metrics."""
    # Several numbers are read from each of these small tables, so each is derived once.
    parts = {n: cut_lineage(t) if n in ("assignment", "entities", "consistency", "markers", "coherence") else t for n, t in parts.items()}
    value = lambda table, name: parts[table].where(F.col("metric") == name).agg(F.max("value")).scalar()
    cols = {"n_transcripts": value("assignment", "n_total_transcripts_post"),
            "n_assigned": value("assignment", "n_assigned_transcripts_post"),
            "n_cells_pre_filter": value("entities", "n_total_entities_pre_filter"),
            "n_cells_post_filter": value("entities", "n_total_entities_post_filter")}
    mid = lambda df, c: df.agg(F.percentile(c, F.lit(0.5))).scalar()
    if "labels" in parts:
        cols["n_celltypes_detected"] = parts["labels"].agg(F.countDistinct("cell_type")).scalar()
        # One value per type, and per (type, marker): both are small tables.
        cols["median_reference_pearson_r"] = mid(parts["consistency"], "pearson_r")
        cols["median_marker_log2fc"] = mid(parts["markers"], "spatial_log2fc")
    if "coherence" in parts:
        for c in ("relative_purity", "relative_conflict"):
            cols[c] = parts["coherence"].agg(F.max(f"median_{c}")).scalar()
    spark = parts["assignment"].sparkSession
    return spark.range(1).select(*[v.alias(n) for n, v in cols.items()])


def window_design(df: DataFrame, bin_size: float, side: float, occ_min: float) -> tuple[DataFrame, DataFrame]:
    """(windows, extracted molecules): one group-by for the grid, a small plan over its bins for
    the picks, and one range join for the cut."""
    spec = cut_lineage(S.grid_spec(df, bin_size))
    grid = cut_lineage(S.density_grid(df, spec))
    windows = cut_lineage(S.select_windows(grid, spec, bin_size, side, occ_min))
    return windows, S.extract_windows(df, windows, side)


def block_metrics(counts: DataFrame, labels: DataFrame, ref_counts: DataFrame, ref_obs: DataFrame,
                  panel: DataFrame, n_top: int = 30) -> DataFrame:
    """Correlation, marker and coherence medians of one entity class, as one row."""
    row = P.audit_pseudobulk(counts, labels, ref_counts, ref_obs, n_top=n_top)
    co = H.coherence_medians(H.score_counts(counts, panel))
    return row.withColumns({c: co.agg(F.max(c)).scalar() for c in co.columns})


def qc_sensitivity(counts: DataFrame, panel: DataFrame, low: int, high: int, bounds: str = "open") -> DataFrame:
    """Coherence with and without the size filter, side by side."""
    counts = stored_table(counts.select("cell_id", "feature_name", "count"), "counts")
    keep = counts.groupBy("cell_id").agg(F.sum("count").alias("n")).where(X.within("n", low, high, bounds))
    both = counts.withColumn("stage", F.lit("unfiltered")).unionByName(
        counts.join(keep.select("cell_id"), "cell_id", "left_semi").withColumn("stage", F.lit("filtered")))
    return H.coherence_medians(H.score_counts(both, panel, by=["stage"]), ["stage"])
