"""Entity coherence against a feature-pair panel: purity, conflict, signal strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.functions import blocks as B
from molq.functions import expr as X
from molq.functions.ordering import quantiles
from molq.functions.tokens import UNASSIGNED
from molq.operators.cooccurrence import compute_npmi
from molq.session import cut_lineage, stored_table


def panel_vocabulary(panel: DataFrame) -> DataFrame:
    return panel.select(F.col("gene_i").alias("feature_name")).union(
        panel.select("gene_j")).distinct()


def entity_gene_matrix(counts: DataFrame, panel: DataFrame, min_transcripts: int = 10,
                       exclude: Sequence[str] = (UNASSIGNED,), by: Sequence[str] = ()) -> DataFrame:
    """(by..., cell_id, feature_name) present in a large-enough entity and in the panel.

    Sizes are taken before the vocabulary cut. ``counts``: by..., cell_id, feature_name, count.
    """
    rows = counts.where(~F.col("cell_id").isin(*exclude) & (F.col("count") > 0))
    keys = [*by, "cell_id"]
    big = (rows.groupBy(*keys).agg(F.sum("count").alias("n"))
           .where(F.col("n") >= min_transcripts).select(*keys))
    return (rows.join(panel_vocabulary(panel), "feature_name", "left_semi")
            .join(big, keys, "left_semi").select(*keys, "feature_name"))


SEP = "\x1f"


def _context(keys: Sequence[str]) -> Column:
    """One text key for the kernel; the parts come back by splitting on a control character."""
    return F.concat_ws(SEP, *keys) if len(keys) > 1 else F.col(keys[0])


def entity_rows(counts: DataFrame, index: DataFrame, min_transcripts: int = 10,
                exclude: Sequence[str] = (UNASSIGNED,), by: Sequence[str] = ()) -> DataFrame:
    """(context, genes): the entities of ``entity_gene_matrix`` as coded rows, from one group-by of the counts."""
    keys = [*by, "cell_id"]
    rows = counts.where(~F.col("cell_id").isin(*exclude) & (F.col("count") > 0)).where(
        " AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, "feature_name", "count")
    per = rows.join(index, "feature_name", "left").groupBy(*keys).agg(
        F.sum("count").alias("n"), F.sort_array(F.collect_list("g")).alias("genes"))
    return per.where((F.col("n") >= min_transcripts) & (F.size("genes") > 0)).select(_context(keys).alias("context"), "genes")


def raw_pair_scores(matrix: DataFrame, panel: DataFrame, threshold: float = 0.05,
                    tau: float = 0.05, relu_mode: str = "shrink",
                    by: Sequence[str] = ()) -> DataFrame:
    """Per entity: k features, all k(k-1)/2 pairs, and the four panel sums."""
    pres = matrix.select(_context([*by, "cell_id"]).alias("context"), "feature_name")
    index = cut_lineage(B.feature_index(panel_vocabulary(panel)))
    return _row_scores(B.context_rows(pres, index), panel, index, threshold, tau, relu_mode, by)


def _row_scores(rows: DataFrame, panel: DataFrame, index: DataFrame, threshold: float, tau: float, relu_mode: str,
                by: Sequence[str]) -> DataFrame:
    """The scores of ``raw_pair_scores`` from coded rows. Rows are derived once and stored."""
    keys = [*by, "cell_id"]
    rows = stored_table(rows, "entity-rows")
    sums = B.pair_scores(rows, panel, index, threshold=threshold, tau=tau, relu_mode=relu_mode, stored=True)
    k = rows.select("context", F.size("genes").cast("long").alias("k"))
    parts = F.split("context", SEP)
    names = [parts[i].alias(c) for i, c in enumerate(keys)] if by else [F.col("context").alias("cell_id")]
    zero = F.lit(0.0)
    out = k.join(sums.withColumnRenamed("id", "context"), "context", "left").select(
        *names, "k", F.expr("k * (k - 1) div 2").alias("n_pairs"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_pos", "sum_neg", "pos_relu", "neg_relu")])
    # Flags and medians read the scores several times; one row per entity is written once.
    return cut_lineage(out)


def _flag(df: DataFrame, score: str, name: str, percentile: float,
          threshold: float | None) -> DataFrame:
    """score >= a given threshold, else >= the exact percentile of the defined scores."""
    cut = (F.lit(threshold) if threshold is not None else
           quantiles(df, score, {"c": percentile / 100.0}).select("c").scalar())
    return df.withColumn(name, F.coalesce(F.col(score) >= cut, F.lit(False)))


def counting_scores(raw: DataFrame, purity_percentile: float = 80.0,
                    conflict_percentile: float = 80.0, purity_threshold: float | None = None,
                    conflict_threshold: float | None = None) -> DataFrame:
    """Purity = share of pairs above the threshold; conflict = negative magnitude per pair."""
    out = raw.withColumns({"cell_purity": X.safe_div("n_pos", "n_pairs"),
                           "conflict_score": X.safe_div("sum_neg", "n_pairs")})
    out = _flag(out, "cell_purity", "is_pure", purity_percentile, purity_threshold)
    return _flag(out, "conflict_score", "is_conflict", conflict_percentile, conflict_threshold)


def relu_scores(raw: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Magnitude scores outside the dead zone; relative ones NULL without signal."""
    signal = F.col("pos_relu") + F.col("neg_relu")
    has_pairs = F.col("n_pairs") > 0
    rel = lambda c: F.when(has_pairs & (signal > eps), F.col(c) / signal)
    return raw.withColumns({
        "purity_score": X.safe_div("pos_relu", "n_pairs"),
        "conflict_score": X.safe_div("neg_relu", "n_pairs"),
        "signal_strength": F.when(has_pairs, signal),
        "relative_purity": rel("pos_relu"), "relative_conflict": rel("neg_relu")})


RELU_COLUMNS = ("purity_score", "conflict_score", "signal_strength", "relative_purity",
                "relative_conflict")


def relu_flags(scores: DataFrame, purity_percentile: float = 80.0,
               conflict_percentile: float = 80.0) -> DataFrame:
    out = _flag(scores, "purity_score", "is_pure", purity_percentile, None)
    return _flag(out, "conflict_score", "is_conflict", conflict_percentile, None)


def purity_and_conflict(counts: DataFrame, panel: DataFrame, min_transcripts: int = 10,
                        threshold: float = 0.05, relu: bool = False, tau: float = 0.05,
                        relu_mode: str = "shrink") -> DataFrame:
    """End to end: matrix chain, then counting or dead-zone scores with their flags."""
    raw = raw_pair_scores(entity_gene_matrix(counts, panel, min_transcripts), panel, threshold,
                          tau, relu_mode)
    return relu_flags(relu_scores(raw)) if relu else counting_scores(raw)


def score_counts(counts: DataFrame, panel: DataFrame, tau: float = 0.05,
                 relu_mode: str = "shrink", by: Sequence[str] = ()) -> DataFrame:
    """Dead-zone scores straight from a count table; no molecule rows are rebuilt."""
    index = cut_lineage(B.feature_index(panel_vocabulary(panel)))
    raw = _row_scores(entity_rows(counts, index, 1, by=by), panel, index, 0.05, tau, relu_mode, by)
    return relu_scores(raw).select(*by, "cell_id", *RELU_COLUMNS)


def attach_scores(cells: DataFrame, scores: DataFrame, on: str = "cell_id") -> DataFrame:
    return cells.join(scores, on, "left")


def purity_mean(counts: DataFrame, min_molecules: int = 10) -> DataFrame:
    """Fallback purity: mean of the clipped NPMI over all expressed pairs, unseen pairs as 0,
    with NPMI measured on the same counts (any count means present)."""
    # Pairs, sizes and rows below all come from the counts, so they are derived once.
    counts = stored_table(counts.select("cell_id", "feature_name", "count"), "counts")
    pres = counts.where(F.col("count") > 0).select(
        F.col("cell_id").alias("context"), "feature_name", F.col("count").alias("n"))
    panel = cut_lineage(compute_npmi(pres).select("gene_i", "gene_j", F.col("NPMI").alias("value"))
                        .where(F.col("value").isNotNull()))
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("n_transcripts"))
    keep = totals.where(F.col("n_transcripts") >= min_molecules)
    matrix = pres.select(F.col("context").alias("cell_id"), "feature_name").join(
        keep, "cell_id", "left_semi")
    raw = raw_pair_scores(matrix, panel, tau=0.0, threshold=0.0)
    # A feature that never pairs is outside the panel vocabulary but still makes zero pairs.
    k = matrix.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"))
    pairs = F.col("n_genes") * (F.col("n_genes") - 1) / 2
    zero = F.lit(0.0)
    return (k.where(F.col("n_genes") >= 2).join(keep, "cell_id")
            .join(raw.select("cell_id", "pos_relu", "neg_relu"), "cell_id", "left")
            .select("cell_id", (F.coalesce("pos_relu", zero) / pairs).alias("purity"),
                    (F.coalesce("neg_relu", zero) / pairs).alias("conflict"),
                    "n_genes", "n_transcripts"))


def coherence_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Medians, and the shares of conflicted (> 0.4) and impure (< 0.4) entities."""
    from molq.operators.accounting import grouped
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    out = grouped(scores, by,
                  share(F.col("relative_conflict") > 0.4).alias("fraction_high_conflict_cells"),
                  share(F.col("relative_purity") < 0.4).alias("fraction_low_purity_cells"))
    return _with_medians(out, scores, RELU_COLUMNS, by)


def _with_medians(out: DataFrame, df: DataFrame, cols: Sequence[str],
                  by: Sequence[str]) -> DataFrame:
    from molq.operators.accounting import group_medians
    if by:
        return out.join(group_medians(df, cols, list(by)), list(by), "left")
    med = group_medians(df.withColumn("_all", F.lit(1)), cols, ["_all"])
    # One row either way, so the medians come in as scalar subqueries.
    return out.withColumns({f"median_{c}": med.agg(F.max(f"median_{c}")).scalar() for c in cols})


def coherence_medians(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Medians of purity, conflict and of their per-entity difference, never a difference of
    medians. Columns the score table lacks stay out."""
    have = set(scores.columns)
    pick = lambda *names: next((n for n in names if n in have), None)
    purity, conflict = pick("purity_score", "purity"), pick("conflict_score", "conflict")
    cols: dict[str, Column] = {}
    for name, src in (("cpmi_purity", purity), ("cpmi_conflict", conflict),
                      ("cpmi_relative_purity", pick("relative_purity")),
                      ("cpmi_relative_conflict", pick("relative_conflict"))):
        if src:
            cols[name] = F.col(src).cast("double")
    if {"purity_score", "conflict_score"} <= have:
        cols["cpmi_coherence"] = F.col("purity_score") - F.col("conflict_score")
    if {"relative_purity", "relative_conflict"} <= have:
        cols["cpmi_relative_coherence"] = F.col("relative_purity") - F.col("relative_conflict")
    from molq.operators.accounting import group_medians, grouped
    rows = scores.select(*by, *[c.alias(n) for n, c in cols.items()])
    base = grouped(rows, by, F.count(F.lit(1)).alias("n_entities_scored"))
    out = _with_medians(base, rows, list(cols), by)
    return out.withColumnsRenamed({f"median_{n}": n for n in cols})


def before_after_purity(original: DataFrame, purified: DataFrame, panel: DataFrame,
                        tau: float = 0.05) -> DataFrame:
    """Medians on the original and on the rounded purified counts, and their difference."""
    from molq.operators.contract import normalize_counts_integer
    both = original.select("cell_id", "feature_name", F.col("count").cast("double"),
                           F.lit("before").alias("stage")).unionByName(
        normalize_counts_integer(purified).select("cell_id", "feature_name", "count",
                                                  F.lit("after").alias("stage")))
    med = coherence_medians(score_counts(both, panel, tau, by=["stage"]), ["stage"])
    value = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c)))
    cols = ("cpmi_relative_purity", "cpmi_relative_conflict")
    return med.agg(*[e for c in cols for e in (
        value("before", c).alias(f"{c}_before"), value("after", c).alias(f"{c}_after"),
        (value("after", c) - value("before", c)).alias(f"{c}_delta"))])


def npmi_summary(scores: DataFrame) -> DataFrame:
    """Mean and median purity, conflict and size of the fallback scores."""
    cols = ("purity", "conflict", "n_transcripts", "n_genes")
    out = scores.agg(F.count(F.lit(1)).alias("n_cells"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
    return _with_medians(out, scores, cols, ())
