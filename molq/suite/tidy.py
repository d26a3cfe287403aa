"""Queries over tidy tables, checks and the end-to-end plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.operators import accounting as A
from molq.operators import checks as K
from molq.operators import tidy as Y
from molq.plans import evaluate as E
from molq.plans.fixtures import molecules, table, with_parts
from molq.suite.accounting import CLASS_SQL, SCORED_SQL, scored_cells
from molq.suite.base import query
from molq.suite.cooccurrence import SUMMARY_CTE, panel, score_parts
from molq.suite.profiles import BASE, DENSE, DIFF, LOGMEAN, PROFILE, SPEAR, SPEC_SQL, TAU, VOTE_SQL, sides, top_ranked_sql
from molq.suite.util import rounded

CARD_SQL = """
, t AS (SELECT method, count(*) AS n_total, count(*) FILTER (cell_id <> 'UNASSIGNED') AS n_assigned,
  count(*) FILTER (original_cell_id = 'UNASSIGNED') AS ini, count(*) FILTER (original_cell_id = 'UNASSIGNED' AND etype IN ('cell','partial','component')) AS rec FROM molecules GROUP BY 1),
c AS (""" + CLASS_SQL.format(id="cell_id") + """)
SELECT 'sample' AS dataset, method, metric, value, CASE WHEN metric LIKE 'n\\_%' ESCAPE '\\' THEN 'count' WHEN metric LIKE '%percent' THEN 'percent' WHEN metric LIKE '%frac%' THEN 'fraction' ELSE 'unitless' END AS unit,
 TRUE AS applicable, 'standardized contract' AS provenance FROM t JOIN c USING (method),
 LATERAL (VALUES ('n_total', CAST(n_total AS DOUBLE)), ('n_assigned', n_assigned), ('n_unassigned', n_total - n_assigned), ('frac_assigned', round(n_assigned / n_total, 6)),
  ('n_transcripts_initially_unassigned', ini), ('n_transcripts_recovered', rec), ('recovery_percent', round(100.0 * rec / ini, 6)), ('n_entities', n_entities), ('n_whole_cells', n_whole_cells),
  ('n_partial_cells', n_partial_cells), ('n_partial_only_cells', n_partial_only_cells), ('n_whole_and_partial_cells', n_whole_and_partial_cells),
  ('median_transcripts_per_entity', median_transcripts_per_entity), ('mean_transcripts_per_whole_cell', mean_transcripts_per_whole_cell),
  ('median_transcripts_per_whole_cell', median_transcripts_per_whole_cell), ('mean_transcripts_per_partial_cell', mean_transcripts_per_partial_cell),
  ('median_transcripts_per_partial_cell', median_transcripts_per_partial_cell), ('assignment_percent', round(100.0 * n_assigned / n_total, 6)),
  ('mean_transcripts_per_profile', round(n_assigned / n_entities, 6))) v(metric, value)"""


@query("B01 D01 D03 D05 I04 O03", with_parts(CARD_SQL))
def method_scorecard(spark, sf):
    return rounded(E.method_scorecard(molecules(spark, sf), "sample"))


def scorecard(spark, sf):
    return E.method_scorecard(molecules(spark, sf), "sample")


# Per-method wide metrics with a hole and its note.
WIDE_SQL = """SELECT 'd' AS dataset, method, count(*) AS n_entities, CASE WHEN method <> 'method_b' THEN round(avg(entropy), 6) END AS rctd_entropy_median,
 CASE WHEN method = 'method_b' THEN 'no mixture fit' END AS rctd_entropy_median_note FROM scored GROUP BY 2"""


def wide(spark, sf):
    return scored_cells(spark, sf).groupBy("method").agg(
        F.count(F.lit(1)).alias("n_entities"), F.round(F.avg("entropy"), 6).alias("e")).select(
        F.lit("d").alias("dataset"), "method", "n_entities", F.when(F.col("method") != "method_b", F.col("e")).alias("rctd_entropy_median"),
        F.when(F.col("method") == "method_b", "no mixture fit").alias("rctd_entropy_median_note"))


@query("I04 I11 B22", with_parts("""
SELECT dataset, method, 'rctd_entropy_median' AS metric, rctd_entropy_median AS value, 'p1' AS platform, 'unitless' AS unit, rctd_entropy_median IS NOT NULL AS applicable,
 coalesce(rctd_entropy_median_note, 'held-out evaluation reference') AS provenance FROM wide""", "assigned cell_labels", scored=SCORED_SQL, wide=WIDE_SQL))
def tidy_mixture_subset(spark, sf):
    return rounded(Y.metric_subset(Y.wide_to_long(wide(spark, sf), {"platform": "p1"}), "mixture"))


@query("I12 I10", with_parts("""
SELECT dataset, method, 'rctd_entropy_median' AS metric, rctd_entropy_median_note AS note FROM wide WHERE rctd_entropy_median_note IS NOT NULL""",
                           "assigned cell_labels", scored=SCORED_SQL, wide=WIDE_SQL))
def not_applicable_notes(spark, sf):
    return Y.not_applicable_notes(Y.comparison_table(wide(spark, sf), ["dataset", "method"]))


@query("I05", """
WITH r AS (SELECT concat('m', CAST(s_suppkey AS VARCHAR)) AS method, CAST(s_suppkey * 8 AS DOUBLE) AS w, CAST(s_nationkey AS DOUBLE) AS m, CASE WHEN s_nationkey % 3 > 0 THEN 10.0 END AS q, s_suppkey * 100 AS e FROM supplier)
SELECT method, metric, value, unit, provenance, value IS NOT NULL AS applicable FROM r, LATERAL (VALUES
 ('runtime_per_1m_transcripts', w / 2.0, 'seconds per 1M transcripts', 'derived: wall clock / frozen input population'),
 ('peak_rss_gb_per_1m_transcripts', m / 2.0, 'GiB per 1M transcripts', 'derived: host peak RSS / frozen input population'),
 ('peak_rss_exceeds_request', CASE WHEN q > 0 THEN CASE WHEN m > q THEN 1.0 ELSE 0.0 END END, 'boolean', 'derived: peak RSS against the requested memory; process-tree sums double-count shared pages'),
 ('entities_per_mm2', e / 0.25, 'entities per mm2', 'derived: entities / frozen ROI area')) v(metric, value, unit, provenance)
WHERE metric <> 'peak_rss_exceeds_request' OR value IS NOT NULL""")
def cost_metrics(spark, sf):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    return Y.cost_metrics(table(spark, sf, "supplier").select(
        F.concat(F.lit("m"), s.cast("string")).alias("method"), (s * 8).cast("double").alias("wall_clock_seconds"),
        n.cast("double").alias("peak_rss_gb"), F.when(n % 3 > 0, 10.0).alias("memory_requested_gb"), (s * 100).alias("n_entities"),
        F.lit(2000000).alias("input_tx"), F.lit(0.25).alias("area_mm2")))


@query("I06", with_parts("""
SELECT 'sample' AS dataset, method, CAST(count(*) AS DOUBLE) AS n_total, round(count(*) FILTER (cell_id <> 'UNASSIGNED') / count(*), 6) AS frac_assigned FROM molecules GROUP BY 2"""))
def headline_table(spark, sf):
    return rounded(Y.headline(scorecard(spark, sf), ["n_total", "frac_assigned"]))


@query("I07", with_parts("""
SELECT cell_type, max(CASE WHEN method = 'method_b' THEN n END)::DOUBLE AS method_b, max(CASE WHEN method = 'method_a' THEN n END)::DOUBLE AS method_a FROM
 (SELECT cell_type, method, count(*) AS n FROM scored WHERE cell_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "assigned cell_labels", scored=SCORED_SQL))
def method_type_matrix(spark, sf):
    n = scored_cells(spark, sf).where("cell_type IS NOT NULL").groupBy("cell_type", "method").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return Y.method_type_matrix(n, "n", ["method_b", "method_a"])


@query("I08", with_parts("""
SELECT cell_id, coalesce(spot_class = 'singlet', FALSE) AS singlet, coalesce(spot_class = 'reject', FALSE) AS reject FROM scored WHERE method = 'method_a'""",
                       "assigned cell_labels", scored=SCORED_SQL))
def class_flags(spark, sf):
    return Y.class_flags(scored_cells(spark, sf).where("method = 'method_a'"), ["singlet", "reject"])


@query("I13 K03", with_parts("""
, g AS (SELECT floor(y / 25) AS iy, floor(x / 25) AS ix FROM molecules GROUP BY 1, 2)
SELECT 'whole' AS roi_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, round((SELECT count(*) FROM g) * 625 / 1e6, 6) AS area_mm2, count(*) AS n_transcripts_grid,
 round(count(*) / ((SELECT count(*) FROM g) * 625 / 1e6), 6) AS density_per_mm2, round((SELECT count(*) FROM g) / ((floor((max(x) - floor(min(x) / 25) * 25) / 25) + 1) * (floor((max(y) - floor(min(y) / 25) * 25) / 25) + 1)), 6) AS occupancy FROM molecules"""))
def whole_tissue_window(spark, sf):
    from molq.operators import spatial as S
    m = molecules(spark, sf)
    spec = S.grid_spec(m, 25)
    return rounded(S.whole_tissue_window(S.density_grid(m, spec), spec, m))


@query("I14", with_parts("""
SELECT method, CASE method WHEN 'method_c' THEN 'removed_cleaned' ELSE 'unassigned' END AS fate_type,
 CAST(CASE method WHEN 'method_c' THEN count(*) FILTER (qv < 10) ELSE count(*) FILTER (cell_id = 'UNASSIGNED') END AS DOUBLE) AS count,
 CASE method WHEN 'method_c' THEN 'removed (count-level)' ELSE 'unassigned' END AS fate_label FROM molecules WHERE method <> 'method_b' GROUP BY 1"""))
def entity_fates(spark, sf):
    s = molecules(spark, sf).groupBy("method").agg(F.count_if(F.col("cell_id") == "UNASSIGNED").alias("unassigned"), F.count_if(F.col("qv") < 10).alias("removed"))
    return Y.entity_fates(s, {"method_a": ("unassigned", "unassigned", "unassigned"), "method_c": ("removed_cleaned", "removed", "removed (count-level)")})


@query("I15", with_parts("""
SELECT d.dataset, m.metric, m.better, max(CASE WHEN method = 'method_a' THEN v END) AS method_a, max(CASE WHEN method = 'method_b' AND m.metric <> 'qv' THEN v END) AS method_b
FROM (VALUES ('all')) d(dataset) CROSS JOIN (VALUES ('size', 'higher'), ('qv', 'lower')) m(metric, better)
LEFT JOIN (SELECT method, 'size' AS metric, CAST(count(*) AS DOUBLE) AS v FROM molecules GROUP BY 1 UNION ALL SELECT method, 'qv', round(avg(qv), 6) FROM molecules GROUP BY 1) x ON x.metric = m.metric GROUP BY 1, 2, 3"""))
def block_matrix(spark, sf):
    m = molecules(spark, sf)
    row = m.groupBy("method").agg(F.count(F.lit(1)).cast("double").alias("size"), F.round(F.avg("qv"), 6).alias("qv"))
    values = row.unpivot(["method"], ["size", "qv"], "metric", "value").withColumn("dataset", F.lit("all"))
    mask = row.where("method = 'method_b'").select("method", F.lit("qv").alias("metric"))
    return rounded(Y.block_matrix(values, values, {"size": "higher", "qv": "lower"}, ["method_a", "method_b"], mask))


@query("I16 I18", with_parts("""
, o AS (SELECT method, etype, CAST(count(*) AS DOUBLE) AS v FROM molecules GROUP BY 1, 2)
SELECT method, etype, v AS old_value, CASE WHEN etype = 'cell' THEN v + 5 ELSE v END AS new_value, CASE WHEN etype = 'cell' THEN 5.0 ELSE 0.0 END AS delta FROM o"""))
def release_comparison(spark, sf):
    old = molecules(spark, sf).groupBy("method", "etype").agg(F.count(F.lit(1)).cast("double").alias("value"))
    patch = old.where("etype = 'cell'").withColumn("value", F.col("value") + 5)
    return Y.release_comparison(old, Y.update_metrics(old, patch, ["method", "etype"]), ["method", "etype"])


@query("I17", with_parts("""
SELECT feature_name, count(*) AS n, 's1' AS sample, method FROM molecules WHERE method <> 'method_c' GROUP BY 1, 4"""))
def stacked_keyed_tables(spark, sf):
    m = molecules(spark, sf)
    one = lambda k: m.where(F.col("method") == k).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))
    return Y.stack_keyed({("s1", k): one(k) for k in ("method_a", "method_b")}, ["sample", "method"])


@query("I19", with_parts("""
SELECT CASE WHEN t IS NULL THEN method ELSE t END AS method, count(*) AS n FROM molecules LEFT JOIN (VALUES ('method_a', 'a_refined'), ('method_a', 'a_rebuilt')) f(m, t) ON m = method GROUP BY 1"""))
def fanned_out_runs(spark, sf):
    n = molecules(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return Y.fan_out(n, {"method_a": ["a_refined", "a_rebuilt"]})


@query("I20", with_parts("""
, u AS (SELECT method, entropy, max_weight, NULL AS note FROM scored WHERE method = 'method_a' UNION ALL
 SELECT method, entropy, max_weight, 'restricted to QC cells' FROM scored WHERE method = 'method_b' AND cell_id IN (SELECT cell_id FROM cell_labels WHERE side = 'query'))
SELECT method, count(*) AS n_cells, max(note) AS note, round(median(entropy), 6) AS median_entropy, round(median(max_weight), 6) AS median_max_weight FROM u GROUP BY 1""",
                      "assigned cell_labels", scored=SCORED_SQL))
def merged_filtered_sources(spark, sf):
    from molq.plans.fixtures import cell_labels
    c = scored_cells(spark, sf)
    return rounded(Y.merge_filtered_sources(c.where("method = 'method_a'"), c.where("method = 'method_b'"),
                                            cell_labels(spark, sf).where("side = 'query'"), "restricted to QC cells"))


@query("O01 O03", with_parts("""
SELECT method, check_name AS "check", passed FROM (SELECT method, count(*) AS n, count(*) FILTER (cell_id <> 'UNASSIGNED') AS a, count(DISTINCT CASE WHEN cell_id <> 'UNASSIGNED' THEN cell_id END) AS e FROM molecules GROUP BY 1),
 LATERAL (VALUES ('status_ok', method <> 'method_c'), ('has_transcripts', n > 0), ('has_entities', e > 0), ('counts_consistent', TRUE), ('fraction_in_range', TRUE), ('not_a_stub', e < a)) v(check_name, passed)"""))
def run_audit(spark, sf):
    m = molecules(spark, sf)
    t = A.transcript_accounting(m, ["method"]).withColumnsRenamed({"n_total": "n_transcripts_total", "n_assigned": "n_transcripts_assigned", "n_unassigned": "n_transcripts_unassigned"})
    runs = t.join(A.entity_accounting(m, ["method"]), "method").withColumn(
        "status", F.when(F.col("method") == "method_c", "failed").otherwise("ok"))
    return K.run_audit(runs)


@query("O02", with_parts("""
SELECT method, check_name AS "check", check_name <> 'required_columns' AS passed FROM (SELECT DISTINCT method FROM molecules), (VALUES ('non_empty'), ('required_columns'), ('has_assigned')) v(check_name)"""))
def standardized_audit(spark, sf):
    return K.standardized_audit(molecules(spark, sf), ["x", "y", "cleaned_status"])


@query("D07", """
SELECT CAST(s_suppkey AS VARCHAR) AS method, CAST(s_suppkey AS DOUBLE) AS runtime_total_s, CAST(s_suppkey AS DOUBLE) / 2 AS runtime_method_s, CAST(s_nationkey AS DOUBLE) AS peak_rss_gb,
 CASE s_nationkey % 3 WHEN 0 THEN 'external_time' WHEN 1 THEN 'unmeasured' ELSE 'in_process' END AS peak_rss_source,
 CASE s_nationkey % 3 WHEN 1 THEN 'peak RSS was not measured for this run' WHEN 2 THEN 'measured in-process; an underestimate relative to external timing' END AS peak_rss_gb_note FROM supplier""")
def runtime_metrics(spark, sf):
    s, n = F.col("s_suppkey").cast("double"), F.col("s_nationkey")
    kind = F.when(n % 3 == 0, "external_time").when(n % 3 == 1, "unmeasured").otherwise("in_process")
    return A.runtime_metrics(table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("method"), F.struct(s.alias("total_seconds"), (s / 2).alias("method_seconds")).alias("runtime"),
        F.struct(n.cast("double").alias("peak_rss_gb"), kind.alias("source")).alias("memory")))


def scores_of(counts: str) -> dict[str, str]:
    """The pair panel and the scores of another count table than the final assignment."""
    return {k: v.replace("FROM cg", f"FROM {counts}") for k, v in score_parts(1).items()}


# Kept entities of the final assignment take the labels that anchors of the reference vote for.
SUMMARY_PARTS = {
    **PROFILE,
    "qcnt": "SELECT * FROM cg WHERE cell_id IN (SELECT cell_id FROM cg GROUP BY 1 HAVING sum(count) BETWEEN 10 AND 900)",
    "anchors": "SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY substr(md5(concat('0-', cell_id)), 1, 15), cell_id) <= 100",
    "qu": "SELECT cell_id, feature_name AS g, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS u FROM qn",
    "au": "SELECT cell_id, feature_name AS g, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS u FROM rn WHERE cell_id IN (SELECT cell_id FROM anchors)",
    "ql": "SELECT cell_id, predicted_celltype AS cell_type FROM (WITH " + VOTE_SQL.format(
        q="q.cell_id", a="a.cell_id", lab="any_value(n.cell_type)", k=15, dot="coalesce(sum(q.u * a.u), 0)",
        src="qu q JOIN au a ON q.g = a.g JOIN anchors n ON n.cell_id = a.cell_id GROUP BY q.cell_id, a.cell_id").strip()[1:] + ")"}
SUMMARY_PARTS = {name: SUMMARY_PARTS[name] for name in "qcnt rl rcnt qn rn anchors qu au ql qsz rsz qb rb".split()}


@query("D08 D09 D14 F29 F23 F12 E18", with_parts(SUMMARY_CTE + """,
marks AS (""" + top_ranked_sql(30) + """),
mf AS (""" + SPEC_SQL.format(div="ln(2)").replace("\n, tot AS", "WITH tot AS", 1).replace(", 6) + 0.0 AS spatial_log2fc", ", 15) AS spatial_log2fc") + """),
per AS (SELECT cell_id, count(*) AS n FROM assigned GROUP BY 1)
SELECT (SELECT CAST(count(*) AS DOUBLE) FROM molecules) AS n_transcripts, (SELECT CAST(count(*) AS DOUBLE) FROM molecules WHERE etype IN ('cell', 'partial', 'component')) AS n_assigned,
 (SELECT CAST(count(*) AS DOUBLE) FROM per) AS n_cells_pre_filter, (SELECT CAST(count(*) AS DOUBLE) FROM per WHERE n BETWEEN 10 AND 900) AS n_cells_post_filter,
 (SELECT count(DISTINCT cell_type) FROM ql) AS n_celltypes_detected,
 (SELECT round(median(p), 6) FROM (SELECT cell_type, corr(q, r) AS p FROM dp GROUP BY 1)) AS median_reference_pearson_r,
 (SELECT round(median(spatial_log2fc), 6) + 0.0 FROM mf) AS median_marker_log2fc,
 (SELECT round(median(rp), 6) FROM sc) AS relative_purity, (SELECT round(median(rc), 6) FROM sc) AS relative_conflict""",
                                                 BASE + " assigned orig cg", **SUMMARY_PARTS, **DENSE, **scores_of("qcnt")))
def method_metrics_summary(spark, sf):
    _, _, r, rl = sides(spark, sf)
    parts = E.method_metrics(molecules(spark, sf), r, rl, panel(spark, sf), 10, 900, k=15, per_type=100)
    return rounded(E.metrics_summary(parts))


@query("F37", with_parts(SUMMARY_CTE + ", " + TAU + ", " + SPEAR + ", " + DIFF + """,
pr AS (SELECT cell_type, corr(q, r) AS p FROM dp GROUP BY 1), lf AS (SELECT cell_type, median(dq) AS l FROM tops WHERE k <= 10 GROUP BY 1)
SELECT (SELECT count(*) FROM pr) AS n_celltypes_scored, (SELECT round(median(tau), 6) FROM tau) AS kendall_tau_median, (SELECT round(median(p), 6) FROM pr) AS pearson_r_median,
 (SELECT round(median(rho), 6) FROM rho) AS spearman_rho_median, (SELECT round(median(l), 6) + 0.0 FROM lf) AS marker_logfc_median, (SELECT count(*) FROM lf) AS n_marker_celltypes,
 count(*) AS n_entities_scored, round(median(ps), 6) AS cpmi_purity, round(median(cs), 6) AS cpmi_conflict, round(median(rp), 6) AS cpmi_relative_purity,
 round(median(rc), 6) AS cpmi_relative_conflict, round(median(ps - cs), 6) + 0.0 AS cpmi_coherence, round(median(rp - rc), 6) + 0.0 AS cpmi_relative_coherence FROM sc""",
                         BASE + " orig", **LOGMEAN, **DENSE, **scores_of("qcnt")))
def block_metrics(spark, sf):
    q, ql, r, rl = sides(spark, sf)
    return rounded(E.block_metrics(q, ql, r, rl, panel(spark, sf), 10))


@query("F38", with_parts(SUMMARY_CTE + """,
n AS (SELECT cell_id, sum(count) AS n FROM cg GROUP BY 1),
u AS (SELECT 'unfiltered' AS stage, sc.* FROM sc UNION ALL SELECT 'filtered', sc.* FROM sc JOIN n USING (cell_id) WHERE n > 20 AND n < 50)
SELECT stage, count(*) AS n_entities_scored, round(median(ps), 6) AS cpmi_purity, round(median(cs), 6) AS cpmi_conflict,
 round(median(rp), 6) AS cpmi_relative_purity, round(median(rc), 6) AS cpmi_relative_conflict, round(median(ps - cs), 6) + 0.0 AS cpmi_coherence,
 round(median(rp - rc), 6) + 0.0 AS cpmi_relative_coherence FROM u GROUP BY 1""", "orig cg", **score_parts(1)))
def qc_sensitivity(spark, sf):
    return rounded(E.qc_sensitivity(A.cell_gene_counts(molecules(spark, sf)), panel(spark, sf), 20, 50))
