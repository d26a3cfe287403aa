"""Queries over the counting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.operators import accounting as A
from molq.operators import joins as J
from molq.plans.fixtures import cell_labels, mixture_weights, molecules, table, with_parts
from molq.suite.base import query
from molq.suite.util import rounded


@query("D01", with_parts("""
SELECT method, count(*) AS n_total, count(*) FILTER (cell_id <> 'UNASSIGNED') AS n_assigned,
 count(*) FILTER (cell_id = 'UNASSIGNED') AS n_unassigned,
 round(count(*) FILTER (cell_id <> 'UNASSIGNED') / count(*), 6) AS frac_assigned,
 CAST(1000 AS BIGINT) AS n_input, count(*) - 1000 AS delta_vs_input FROM molecules GROUP BY 1"""))
def transcript_accounting(spark, sf):
    return rounded(A.transcript_accounting(molecules(spark, sf), ["method"], n_input=1000))


@query("D02", with_parts("""
SELECT g.method, n_genes, n_entities, median_transcripts_per_entity FROM
 (SELECT method, count(DISTINCT feature_name) AS n_genes FROM molecules GROUP BY 1) g JOIN
 (SELECT method, count(*) AS n_entities, median(n) AS median_transcripts_per_entity FROM
   (SELECT method, cell_id, count(*) AS n FROM assigned GROUP BY 1, 2) GROUP BY 1) s USING (method)""", "assigned"))
def entity_accounting(spark, sf):
    return A.entity_accounting(molecules(spark, sf), ["method"])


CLASS_SQL = """
SELECT method, count(*) FILTER (n_all > 0) AS n_entities, count(*) FILTER (w > 0) AS n_whole_cells,
 count(*) FILTER (p > 0) AS n_partial_cells, count(*) FILTER (p > 0 AND w = 0) AS n_partial_only_cells,
 count(*) FILTER (p > 0 AND w > 0) AS n_whole_and_partial_cells,
 median(CASE WHEN n_all > 0 THEN n_all END) AS median_transcripts_per_entity,
 round(avg(CASE WHEN w > 0 THEN w END), 6) AS mean_transcripts_per_whole_cell,
 median(CASE WHEN w > 0 THEN w END) AS median_transcripts_per_whole_cell,
 round(avg(CASE WHEN p > 0 THEN p END), 6) AS mean_transcripts_per_partial_cell,
 median(CASE WHEN p > 0 THEN p END) AS median_transcripts_per_partial_cell
FROM (SELECT method, {id} AS id, count(*) FILTER (etype IN ('cell','partial')) AS n_all,
  count(*) FILTER (etype = 'cell') AS w, count(*) FILTER (etype = 'partial') AS p FROM molecules GROUP BY 1, 2) GROUP BY 1"""


@query("D03 S12 I03", with_parts(CLASS_SQL.format(id="cell_id")))
def entity_class_accounting(spark, sf):
    return rounded(A.entity_class_accounting(molecules(spark, sf), ["method"]))


@query("D03", with_parts(CLASS_SQL.format(id="original_cell_id")))
def entity_class_overlap(spark, sf):
    return rounded(A.entity_class_accounting(molecules(spark, sf), ["method"], "original_cell_id"))


@query("D04 S14", with_parts("""
SELECT method, count(*) AS n_total, count(*) FILTER (etype IN ('cell','partial')) AS n_assigned,
 count(*) FILTER (etype NOT IN ('cell','partial')) AS n_unassigned,
 round(count(*) FILTER (etype IN ('cell','partial')) / count(*), 6) AS frac_assigned FROM molecules GROUP BY 1"""))
def class_transcript_accounting(spark, sf):
    return rounded(A.class_transcript_accounting(molecules(spark, sf), ["method"]))


@query("D05", with_parts("""
SELECT method, count(*) FILTER (original_cell_id = 'UNASSIGNED') AS n_transcripts_initially_unassigned,
 count(*) FILTER (original_cell_id = 'UNASSIGNED' AND etype IN ('cell','partial','component')) AS n_transcripts_recovered,
 round(100.0 * count(*) FILTER (original_cell_id = 'UNASSIGNED' AND etype IN ('cell','partial','component'))
   / count(*) FILTER (original_cell_id = 'UNASSIGNED'), 6) AS recovery_percent,
 CAST(NULL AS VARCHAR) AS recovery_percent_note FROM molecules GROUP BY 1"""))
def recovery(spark, sf):
    return rounded(A.recovery_metrics(molecules(spark, sf), ["method"]))


@query("D06 I12", with_parts("""
SELECT t.method, n_entities, n_assigned, frac_assigned, round(frac_assigned * 100.0, 6) AS assignment_percent,
 CAST(NULL AS VARCHAR) AS assignment_percent_note, round(n_assigned / n_entities, 6) AS mean_transcripts_per_profile,
 n_entities AS n_whole_cells, CAST(0 AS BIGINT) AS n_partial_cells,
 'method emits whole/called cells only' AS n_whole_cells_note,
 'method does not emit partial entities' AS n_partial_cells_note
FROM (SELECT method, count(*) FILTER (cell_id <> 'UNASSIGNED') AS n_assigned,
  round(count(*) FILTER (cell_id <> 'UNASSIGNED') / count(*), 6) AS frac_assigned,
  count(DISTINCT CASE WHEN cell_id <> 'UNASSIGNED' THEN cell_id END) AS n_entities FROM molecules GROUP BY 1) t"""))
def entity_metrics(spark, sf):
    m = molecules(spark, sf)
    stats = A.transcript_accounting(m, ["method"]).select("method", "n_assigned", F.round("frac_assigned", 6).alias("frac_assigned"))
    stats = stats.join(A.entity_accounting(m, ["method"]).select("method", "n_entities"), "method")
    return rounded(A.entity_metrics(stats))


@query("D08", with_parts("""
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
 SELECT count(*) AS n, count(*) FILTER (etype IN ('cell','partial','component')) AS a,
  count(*) FILTER (original_cell_id <> 'UNASSIGNED') AS b FROM molecules) t,
 LATERAL (VALUES ('n_total_transcripts_post', n), ('n_assigned_transcripts_post', a),
  ('n_unassigned_transcripts_post', n - a), ('frac_assigned_post', round(a / n, 6)),
  ('n_total_transcripts_pre', n), ('n_assigned_transcripts_pre', b), ('n_unassigned_transcripts_pre', n - b),
  ('frac_assigned_pre', round(b / n, 6)), ('delta_assigned_post_minus_pre', a - b),
  ('delta_unassigned_post_minus_pre', b - a)) v(metric, value)"""))
def assignment_pre_post(spark, sf):
    return rounded(A.assignment_pre_post(molecules(spark, sf)))


@query("D09 G05 S02", with_parts("""
, per AS (SELECT cell_id, count(*) AS n, min_by(etype, transcript_id) AS kind FROM assigned GROUP BY 1)
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
 SELECT count(*) AS pre, count(*) FILTER (n BETWEEN 10 AND 40) AS post,
  count(*) FILTER (kind = 'cell') AS c, count(*) FILTER (kind = 'partial') AS p, count(*) FILTER (kind = 'component') AS k,
  median(n) AS m1, median(CASE WHEN n BETWEEN 10 AND 40 THEN n END) AS m2 FROM per) t,
 LATERAL (VALUES ('n_total_entities_pre_filter', pre), ('n_total_entities_post_filter', post),
  ('min_transcripts_per_cell', 10), ('max_transcripts_per_cell', 40), ('n_cells', c), ('n_partials', p),
  ('n_components', k), ('median_tx_per_entity_pre_filter', m1), ('median_tx_per_entity_post_filter', m2)) v(metric, value)
""", "assigned"))
def cell_counts(spark, sf):
    return A.cell_counts(molecules(spark, sf), 10, 40, order_col="transcript_id")


@query("D10", with_parts("SELECT cell_id, feature_name, count FROM cg", "cg"))
def cell_gene_counts(spark, sf):
    return A.cell_gene_counts(molecules(spark, sf))


@query("D10 D09 C06", with_parts("""
SELECT cell_id, feature_name, count FROM cg
WHERE cell_id IN (SELECT cell_id FROM cg GROUP BY 1 HAVING sum(count) BETWEEN 10 AND 40)""", "cg"))
def cell_gene_counts_kept(spark, sf):
    m = molecules(spark, sf)
    return A.cell_gene_counts(m, keep=A.kept_entities(m, 10, 40))


@query("D11", with_parts("""
SELECT method, cell_id, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, count(*) AS n_transcripts,
 count(DISTINCT feature_name) AS n_genes FROM assigned GROUP BY 1, 2""", "assigned"))
def derived_cells(spark, sf):
    return rounded(A.derive_cells(molecules(spark, sf), by=["method"]))


@query("D12", with_parts("""
SELECT cell_id, round(avg(x), 6) AS x_centroid, round(avg(y), 6) AS y_centroid, count(*) AS transcript_counts,
 CAST(sum(overlaps_nucleus) AS BIGINT) AS nucleus_counts,
 round(greatest(max(x) - min(x), 0.5) * greatest(max(y) - min(y), 0.5), 6) AS cell_area FROM assigned GROUP BY 1""", "assigned"))
def bundle_cells(spark, sf):
    return rounded(A.bundle_cells(molecules(spark, sf)))


@query("D13 A04", with_parts("""
SELECT l.cell_id, cell_type, coalesce(n, 0) AS n_transcripts, coalesce(g, 0) AS n_genes FROM cell_labels l LEFT JOIN
 (SELECT cell_id, CAST(sum(count) AS BIGINT) AS n, count(*) AS g FROM cg GROUP BY 1) c USING (cell_id)""", "cg cell_labels"))
def merged_cell_counts(spark, sf):
    cells = cell_labels(spark, sf).select("cell_id", "cell_type", F.lit(-1).alias("n_transcripts"))
    return A.merge_cells_counts(cells, molecules(spark, sf))


@query("D14", with_parts("""
SELECT cell_id, CAST(sum(count) AS BIGINT) AS n_transcripts, count(*) AS n_genes_detected,
 round(100.0 * sum(CASE WHEN feature_name LIKE 'GENE00%' THEN count ELSE 0 END) / sum(count), 6) AS pct_mito
FROM cg GROUP BY 1""", "cg"))
def cell_qc(spark, sf):
    return rounded(A.cell_qc(A.cell_gene_counts(molecules(spark, sf)), "GENE00"))


@query("D14", with_parts("""
SELECT count(*) AS n_cells_filtered, median(n) AS median_transcripts_per_cell, median(g) AS median_genes_per_cell,
 round(avg(n), 6) AS mean_transcripts_per_cell, round(avg(g), 6) AS mean_genes_per_cell,
 round(median(m), 6) AS median_pct_mito FROM
 (SELECT cell_id, sum(count) AS n, count(*) AS g,
   100.0 * sum(CASE WHEN feature_name LIKE 'GENE00%' THEN count ELSE 0 END) / sum(count) AS m FROM cg GROUP BY 1)""", "cg"))
def cell_qc_summary(spark, sf):
    return rounded(A.cell_qc_summary(A.cell_qc(A.cell_gene_counts(molecules(spark, sf)), "GENE00")))


@query("D15", with_parts("""
SELECT count(*) AS n_cells, (SELECT count(DISTINCT feature_name) FROM cg) AS n_genes, median(n) AS median_counts_per_cell,
 median(g) AS median_genes_per_cell, CAST(sum(n) AS BIGINT) AS total_counts FROM
 (SELECT cell_id, sum(count) AS n, count(*) AS g FROM cg GROUP BY 1)""", "cg"))
def matrix_stats(spark, sf):
    return A.matrix_stats(A.cell_gene_counts(molecules(spark, sf)))


BASIC_SQL = """
 t AS (SELECT method, count(*) AS n_transcripts, count(*) FILTER (cell_id <> 'UNASSIGNED') AS n_assigned FROM molecules GROUP BY 1),
 c AS (SELECT method, count(*) AS n_cells, median(n) AS median_transcripts_per_cell, median(g) AS median_genes_per_cell FROM
  (SELECT method, cell_id, count(*) AS n, count(DISTINCT feature_name) AS g FROM assigned GROUP BY 1, 2) GROUP BY 1)
"""


@query("D16 D17", with_parts("", "assigned").rstrip() + "," + BASIC_SQL + """
SELECT method, n_transcripts, n_assigned, n_cells, median_transcripts_per_cell, median_genes_per_cell,
 round(n_assigned / n_transcripts, 6) AS assigned_fraction,
 n_cells - (SELECT n_cells FROM c WHERE method = 'method_b') AS n_cells_vs_baseline,
 round(n_assigned / n_transcripts - (SELECT n_assigned / n_transcripts FROM t WHERE method = 'method_b'), 6) AS assigned_fraction_vs_baseline
FROM t JOIN c USING (method)""")
def basic_stats_vs_baseline(spark, sf):
    return rounded(A.relative_to_baseline(A.basic_stats(molecules(spark, sf)),
                                          ["n_cells", "assigned_fraction"], "method_b"))


@query("D18 G03", with_parts("""
SELECT * FROM (SELECT method, feature_name, count(*) AS total_count, count(*) FILTER (cell_id = 'UNASSIGNED') AS n_affected,
 round(count(*) FILTER (cell_id = 'UNASSIGNED') / count(*), 6) AS fraction_affected,
 CAST(row_number() OVER (PARTITION BY method ORDER BY count(*) FILTER (cell_id = 'UNASSIGNED') / count(*) DESC,
   count(*) FILTER (cell_id = 'UNASSIGNED') DESC, feature_name) AS INTEGER) AS rank
 FROM molecules GROUP BY 1, 2 HAVING count(*) >= 20) WHERE rank <= 50"""))
def top_unassigned_features(spark, sf):
    from molq.operators.ranking import top_supported
    return rounded(top_supported(A.gene_unassigned(molecules(spark, sf), ["method"])))


# Purified counts: half of each count where the feature number is divisible by 3, and features
# ending in 9 gone altogether; entities of one segment were not processed.
PURIFIED = """SELECT cell_id, feature_name, CASE WHEN CAST(substr(feature_name, 5) AS INTEGER) % 3 = 0 THEN count * 0.5
  WHEN CAST(substr(feature_name, 5) AS INTEGER) % 7 = 0 THEN count + 1.0 ELSE count * 1.0 END AS count
  FROM og WHERE CAST(substr(feature_name, 5) AS INTEGER) % 10 <> 9
  AND cell_id IN (SELECT cell_id FROM cell_labels WHERE cell_type <> 'BUILDING')"""
ALIGNED = """SELECT coalesce(o.cell_id, p.cell_id) AS cell_id, coalesce(o.feature_name, p.feature_name) AS feature_name,
  coalesce(o.count, 0) * 1.0 AS o, coalesce(p.count, 0) AS p FROM
  (SELECT * FROM og WHERE cell_id IN (SELECT cell_id FROM purified) AND feature_name IN (SELECT feature_name FROM purified)) o
  FULL JOIN purified p ON o.cell_id = p.cell_id AND o.feature_name = p.feature_name"""


def count_pair(spark, sf):
    original = A.cell_gene_counts(molecules(spark, sf), "original_cell_id")
    keep = cell_labels(spark, sf).where("cell_type <> 'BUILDING'")
    number = F.substring("feature_name", 5, 3).cast("int")
    c = F.col("count").cast("double")
    purified = (original.where(number % 10 != 9).join(keep, "cell_id", "left_semi")
                .withColumn("count", F.when(number % 3 == 0, c * 0.5)
                            .when(number % 7 == 0, c + 1.0).otherwise(c)))
    return original, purified


@query("D19", with_parts("""
SELECT feature_name, CAST(sum(o) AS DOUBLE) AS total_count, CAST(greatest(sum(o - p), 0) AS DOUBLE) AS n_affected,
 round(greatest(sum(o - p), 0) / greatest(sum(o), 1), 6) AS fraction_affected FROM aligned GROUP BY 1""",
                        "og cell_labels", purified=PURIFIED, aligned=ALIGNED))
def removed_by_gene(spark, sf):
    return rounded(A.removed_by_gene(*count_pair(spark, sf)))


@query("D20", with_parts("""
SELECT cell_id, feature_name, CAST(o AS DOUBLE) AS original_count, CAST(p AS DOUBLE) AS purified_count, CAST(o - p AS DOUBLE) AS removed_count
FROM aligned WHERE o > 0 OR p > 1e-6""", "og cell_labels", purified=PURIFIED, aligned=ALIGNED))
def removed_counts(spark, sf):
    return A.removed_counts(*count_pair(spark, sf))


@query("D20", with_parts("""
SELECT CASE WHEN feature_name IS NOT NULL THEN 'feature' ELSE 'entity' END AS level, coalesce(feature_name, cell_id) AS key,
 CAST(sum(o) AS DOUBLE) AS original_count, CAST(sum(p) AS DOUBLE) AS purified_count, CAST(sum(o - p) AS DOUBLE) AS removed_count_raw,
 CAST(sum(greatest(o - p, 0)) AS DOUBLE) AS removed_count_clamped FROM aligned GROUP BY GROUPING SETS ((feature_name), (cell_id))""",
                        "og cell_labels", purified=PURIFIED, aligned=ALIGNED))
def pruning_levels(spark, sf):
    return A.pruning_levels(*count_pair(spark, sf))


@query("D20", with_parts("""
SELECT CAST(sum(o) AS DOUBLE) AS original_assigned_count, CAST(sum(p) AS DOUBLE) AS purified_retained_count,
 CAST(sum(greatest(o - p, 0)) AS DOUBLE) AS estimated_removed_count, max(abs(p - round_even(p, 0)) > 1e-6) AS purified_counts_are_fractional,
 count(*) FILTER (o - p < -1e-6) AS n_negative_differences_before_clamping,
 CAST(sum(CASE WHEN o - p < -1e-6 THEN p - o ELSE 0 END) AS DOUBLE) AS total_negative_magnitude_before_clamping,
 CAST(25 AS BIGINT) AS original_unassigned_count,
 CAST(25 + sum(greatest(o - p, 0)) AS DOUBLE) AS pseudo_post_cleaning_unassigned_count,
 round(sum(greatest(o - p, 0)) / sum(o), 6) AS fraction_removed_of_original_assigned,
 (SELECT count(DISTINCT cell_id) FROM og) AS n_cells_original, (SELECT count(DISTINCT cell_id) FROM purified) AS n_cells_purified,
 count(DISTINCT cell_id) AS n_cells_aligned, (SELECT count(DISTINCT feature_name) FROM og) AS n_genes_original,
 (SELECT count(DISTINCT feature_name) FROM purified) AS n_genes_purified, count(DISTINCT feature_name) AS n_genes_aligned
FROM aligned""", "og cell_labels", purified=PURIFIED, aligned=ALIGNED))
def pruning_summary(spark, sf):
    return rounded(A.pruning_summary(*count_pair(spark, sf), n_unassigned=25))


@query("D21 C15 C17", with_parts("""
, pre AS (SELECT cell_type, count(*) AS n FROM (SELECT DISTINCT original_cell_id AS cell_id FROM orig) JOIN cell_labels USING (cell_id) GROUP BY 1),
post AS (SELECT cell_type, count(*) AS n FROM (SELECT DISTINCT cell_id FROM assigned WHERE method = 'method_a') JOIN cell_labels USING (cell_id)
  WHERE cell_type <> 'FURNITURE' GROUP BY 1)
SELECT cell_type, CAST(pre.n AS DOUBLE) AS n_cells_pre, round(pre.n / (SELECT sum(n) FROM pre), 6) AS fraction_pre,
 CAST(post.n AS DOUBLE) AS n_cells_post, round(post.n / (SELECT sum(n) FROM post), 6) AS fraction_post
FROM pre FULL JOIN post USING (cell_type)""", "orig assigned cell_labels"))
def type_frequency_pre_post(spark, sf):
    m, labels = molecules(spark, sf), cell_labels(spark, sf)
    pre = J.align_labels(m.where("original_cell_id <> 'UNASSIGNED'").select(
        F.col("original_cell_id").alias("cell_id")).distinct(), labels)
    post = J.align_labels(m.where("cell_id <> 'UNASSIGNED' AND method = 'method_a'").select("cell_id").distinct(), labels)
    out = J.pre_post_full_join(A.frequency(pre, "cell_type"),
                               A.frequency(post, "cell_type", restrict=F.col("cell_type") != "FURNITURE"),
                               "cell_type", ["n_cells", "fraction"])
    return rounded(out.withColumns({f"n_cells_{s}": F.col(f"n_cells_{s}").cast("double") for s in ("pre", "post")}))


# One row per entity and method with a spot class, depth, entropy-like value and a label.
SCORED_SQL = """SELECT a.method, a.cell_id, l.cell_type, count(*) AS n_transcripts,
  CASE WHEN count(*) % 5 = 0 THEN NULL WHEN count(*) % 5 = 1 THEN 'singlet' WHEN count(*) % 5 = 2 THEN 'doublet_certain'
   WHEN count(*) % 5 = 3 THEN 'doublet_uncertain' ELSE 'reject' END AS spot_class,
  CAST(sum(CAST(qv AS BIGINT) * 7 + 3) % 1013 AS DOUBLE) / 1013 AS entropy,
  CAST(sum(CAST(qv AS BIGINT) * 5 + 1) % 997 AS DOUBLE) / 997 AS max_weight
 FROM assigned a LEFT JOIN cell_labels l ON a.cell_id = l.cell_id GROUP BY 1, 2, 3"""


def scored_cells(spark, sf):
    m = molecules(spark, sf).where("cell_id <> 'UNASSIGNED'")
    n = F.col("n_transcripts")
    q = F.col("qv").cast("long")
    return (m.groupBy("method", "cell_id").agg(
        F.count(F.lit(1)).alias("n_transcripts"),
        ((F.sum(q * 7 + 3) % 1013).cast("double") / 1013).alias("entropy"),
        ((F.sum(q * 5 + 1) % 997).cast("double") / 997).alias("max_weight"))
        .withColumn("spot_class", F.when(n % 5 == 1, "singlet").when(n % 5 == 2, "doublet_certain")
                    .when(n % 5 == 3, "doublet_uncertain").when(n % 5 == 4, "reject"))
        .join(cell_labels(spark, sf).select("cell_id", "cell_type"), "cell_id", "left"))


@query("D22 C16", with_parts("""
SELECT method, count(*) AS n_cells, count(*) FILTER (spot_class = 'singlet') AS n_singlet,
 count(*) FILTER (spot_class = 'doublet_certain') AS n_doublet_certain, count(*) FILTER (spot_class = 'doublet_uncertain') AS n_doublet_uncertain,
 count(*) FILTER (spot_class = 'reject') AS n_reject, count(*) FILTER (spot_class IS NULL) AS n_unannotated,
 round(count(*) FILTER (spot_class = 'singlet') / count(*), 6) AS frac_singlet,
 round(count(*) FILTER (spot_class = 'doublet_certain') / count(*), 6) AS frac_doublet_certain,
 round(count(*) FILTER (spot_class = 'doublet_uncertain') / count(*), 6) AS frac_doublet_uncertain,
 round(count(*) FILTER (spot_class = 'reject') / count(*), 6) AS frac_reject,
 round(count(*) FILTER (spot_class IS NULL) / count(*), 6) AS frac_unannotated,
 round(avg(n_transcripts), 6) AS mean_depth, median(n_transcripts) AS median_depth FROM scored GROUP BY 1""",
                            "assigned cell_labels", scored=SCORED_SQL))
def class_info_summary(spark, sf):
    return rounded(A.class_info_summary(scored_cells(spark, sf), by=["method"]))


@query("D24 D25", with_parts("""
, ab AS (SELECT cell_type FROM (SELECT cell_type, method, count(*) AS n FROM scored WHERE cell_type IS NOT NULL GROUP BY 1, 2)
  GROUP BY 1 HAVING count(*) FILTER (n >= 290) >= ceil(3 / 2.0)),
r AS (SELECT * FROM scored WHERE cell_type IN (SELECT cell_type FROM ab))
SELECT method, 'all' AS scope, round(median(entropy), 6) AS median_entropy, round(median(max_weight), 6) AS median_max_weight FROM r GROUP BY 1
UNION ALL SELECT method, cell_type, round(median(entropy), 6), round(median(max_weight), 6) FROM r GROUP BY 1, 2""",
                           "assigned cell_labels", scored=SCORED_SQL))
def mixture_summary_abundant(spark, sf):
    cells = scored_cells(spark, sf)
    return rounded(A.mixture_summary(cells, A.abundant_types(cells, 290)))


@query("D26 C13", with_parts("""
, matched AS (SELECT cell_id FROM scored GROUP BY 1 HAVING count(DISTINCT method) = 3)
SELECT method, count(*) AS n_cells_scored, round(avg(CASE WHEN spot_class IS NULL THEN NULL WHEN spot_class = 'singlet' THEN 1.0 ELSE 0 END), 6) AS frac_singlet,
 round(avg(CASE WHEN spot_class IS NULL THEN NULL WHEN spot_class = 'reject' THEN 1.0 ELSE 0 END), 6) AS frac_reject,
 round(median(entropy), 6) AS median_entropy, round(median(max_weight), 6) AS median_max_weight
FROM scored WHERE cell_id IN (SELECT cell_id FROM matched) GROUP BY 1""",
                           "assigned cell_labels", scored=SCORED_SQL))
def matched_per_cell_medians(spark, sf):
    cells = scored_cells(spark, sf)
    return rounded(A.per_cell_medians(cells, J.matched_population(cells)))


@query("D27 G05", with_parts("""
SELECT CASE kind WHEN 'cell' THEN 'whole' WHEN 'partial' THEN 'partial' ELSE 'other' END AS stratum, count(*) AS n_entities,
 round(median(entropy), 6) AS median_entropy FROM scored LEFT JOIN
 (SELECT cell_id, min_by(etype, transcript_id) AS kind FROM molecules GROUP BY 1) USING (cell_id) GROUP BY 1""",
                            "assigned cell_labels", scored=SCORED_SQL))
def stratified_entities(spark, sf):
    classes = A.entity_class(molecules(spark, sf))
    return rounded(A.stratify_entities(scored_cells(spark, sf), classes, ["entropy"]))


@query("D28", with_parts("""
SELECT method, count(*) AS n_entities, count(*) FILTER (n > 10 AND n < 20) AS n_in_range, median(n) AS median_size FROM
 (SELECT method, cell_id, count(*) AS n FROM assigned GROUP BY 1, 2) GROUP BY 1""", "assigned"))
def size_distribution(spark, sf):
    return A.size_distribution(molecules(spark, sf), 10, 20)


@query("D29", with_parts("""
SELECT l.cell_id, count(a.cell_id) AS n_transcripts FROM cell_labels l LEFT JOIN
 (SELECT cell_id FROM assigned WHERE method = 'method_b') a ON l.cell_id = a.cell_id GROUP BY 1""", "assigned cell_labels"))
def zero_filled_sizes(spark, sf):
    return A.zero_filled_sizes(cell_labels(spark, sf), molecules(spark, sf).where("method = 'method_b'"))


@query("D30 H03 H04", with_parts("""
SELECT method, count(entropy) AS n, round(avg(entropy), 6) AS mean_entropy, round(stddev_samp(entropy) / sqrt(count(entropy)), 6) AS sem_entropy,
 round(median(entropy), 6) AS median_entropy FROM scored GROUP BY 1""", "assigned cell_labels", scored=SCORED_SQL))
def group_summary(spark, sf):
    return rounded(A.group_summary(scored_cells(spark, sf), "entropy"))


@query("D33 G08", with_parts("""
, s AS (SELECT method, 1 AS ord, 'all' AS stage, count(*) AS n_cells FROM scored GROUP BY 1
 UNION ALL SELECT method, 2, 'min_size', count(*) FILTER (n_transcripts >= 10) FROM scored GROUP BY 1
 UNION ALL SELECT method, 3, 'annotated', count(*) FILTER (n_transcripts >= 10 AND spot_class IS NOT NULL) FROM scored GROUP BY 1)
SELECT method, stage, n_cells, CAST(lag(n_cells) OVER w - n_cells AS DOUBLE) AS lost_vs_previous, round(n_cells / first_value(n_cells) OVER w, 6) AS frac_of_first
FROM s WINDOW w AS (PARTITION BY method ORDER BY ord)""", "assigned cell_labels", scored=SCORED_SQL))
def cell_funnel(spark, sf):
    big = F.col("n_transcripts") >= 10
    row = scored_cells(spark, sf).groupBy("method").agg(
        F.count(F.lit(1)).alias("a"), F.count_if(big).alias("b"),
        F.count_if(big & F.col("spot_class").isNotNull()).alias("c"))
    stages = row.select("method", F.expr(
        "stack(3, 1, 'all', a, 2, 'min_size', b, 3, 'annotated', c) AS (ord, stage, n_cells)"))
    out = A.cell_funnel(stages)
    return rounded(out.withColumn("lost_vs_previous", F.col("lost_vs_previous").cast("double")))


@query("D34 F27", """
WITH o AS (SELECT c_mktsegment AS split, CAST(c_nationkey % 7 AS VARCHAR) AS c, c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey % 7 < 3)
SELECT (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT c FROM o WHERE split = 'BUILDING')) AS heldout_cohorts,
 (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT c FROM o WHERE split <> 'BUILDING')) AS other_cohorts,
 (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT c FROM o WHERE split = 'BUILDING' INTERSECT SELECT c FROM o WHERE split <> 'BUILDING')) AS shared_cohorts,
 FALSE AS is_disjoint""")
def heldout_disjointness(spark, sf):
    obs = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING' OR c_nationkey % 7 < 3").select(
        "c_mktsegment", (F.col("c_nationkey") % 7).alias("donor"))
    return A.describe_disjointness(obs, "c_mktsegment", "BUILDING", "donor")


@query("D35", with_parts("""
SELECT cell_type, count(*) AS n_cells, count(*) >= 150 AS kept FROM cell_labels WHERE side = 'reference' GROUP BY 1""", "cell_labels"))
def common_celltypes(spark, sf):
    return A.common_celltypes(cell_labels(spark, sf).where("side = 'reference'"), 150)


@query("D36", with_parts("""
, per AS (SELECT method, cell_type, count(*) AS n FROM scored WHERE cell_type IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT cell_type FROM per WHERE n >= 296 GROUP BY 1 HAVING count(*) = 3),
r AS (SELECT s.*, n, cell_type IN (SELECT cell_type FROM sh) AS shared FROM scored s JOIN per USING (method, cell_type))
SELECT method, 'all' AS regime, round(median(entropy), 6) AS median_entropy FROM r GROUP BY 1
UNION ALL SELECT method, 'no_rare', round(median(entropy), 6) FROM r WHERE n >= 292 GROUP BY 1
UNION ALL SELECT method, 'shared_common', round(median(entropy), 6) FROM r WHERE shared GROUP BY 1""",
                      "assigned cell_labels", scored=SCORED_SQL))
def regime_medians(spark, sf):
    return rounded(A.regime_medians(scored_cells(spark, sf), "entropy", 292, 296))


@query("D37 C11", with_parts("""
SELECT cell_id, round(avg(CAST((floor(y / 25) * 31 + floor(x / 25) * 17) % 101 AS DOUBLE) / 101), 6) AS mean_integrity FROM assigned GROUP BY 1""", "assigned"))
def cell_mean_integrity(spark, sf):
    return rounded(A.cell_mean_integrity(rastered(spark, sf)))


def rastered(spark, sf):
    """Molecules with a per-pixel value read from a raster that covers their pixel extent."""
    m = molecules(spark, sf).withColumns({"x_pixel": F.floor(F.col("x") / 25),
                                          "y_pixel": F.floor(F.col("y") / 25)})
    raster = m.select("x_pixel", "y_pixel").distinct().withColumn(
        "signal_integrity", ((F.col("y_pixel") * 31 + F.col("x_pixel") * 17) % 101).cast("double") / 101)
    return J.raster_lookup(m, raster)


@query("D37 D38", with_parts("""
, v AS (SELECT *, CAST((floor(y / 25) * 31 + floor(x / 25) * 17) % 101 AS DOUBLE) / 101 AS s FROM molecules)
SELECT method, count(*) AS n_scored, round(avg(s), 6) AS mean_value, round(median(s), 6) AS median_value, count(*) FILTER (s < 0.5) AS n_low,
 round(count(*) FILTER (s < 0.5) / count(*), 6) AS fraction_low FROM v GROUP BY 1"""))
def integrity_summary(spark, sf):
    return rounded(A.integrity_summary(rastered(spark, sf), "signal_integrity", by=["method"]))


@query("D37", with_parts("""
SELECT cell_id, feature_name, count(*) AS count FROM assigned
WHERE CAST((floor(y / 25) * 31 + floor(x / 25) * 17) % 101 AS DOUBLE) / 101 > 0.5 GROUP BY 1, 2""", "assigned"))
def integrity_filtered_counts(spark, sf):
    return A.integrity_filtered_counts(rastered(spark, sf), 0.5)


@query("D39", """
SELECT c_nationkey AS annotation, c_mktsegment AS label, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n,
 row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1""")
def class_mode(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("annotation"),
                                            F.col("c_mktsegment").alias("label"))
    return A.class_mode(c, "annotation", "label")


@query("D41 D38", with_parts("""
, px AS (SELECT cell_id, floor(x / 5) AS px, floor(y / 5) AS py, count(*) AS signal FROM assigned GROUP BY 1, 2, 3),
e AS (SELECT cell_id, count(*) AS n_pixels, CAST(sum(signal) AS DOUBLE) AS signal_total,
 sum(signal * ((px * 7 + py * 3) % 16) / 16.0) / sum(signal) AS v FROM px GROUP BY 1)
SELECT count(*) AS n_scored, round(avg(v), 6) AS mean_value, round(median(v), 6) AS median_value, count(*) FILTER (v < 0.5) AS n_low,
 round(count(*) FILTER (v < 0.5) / count(*), 6) AS fraction_low FROM e""", "assigned"))
def entity_integrity(spark, sf):
    px = (molecules(spark, sf).where("cell_id <> 'UNASSIGNED'")
          .groupBy("cell_id", F.floor(F.col("x") / 5).alias("px"), F.floor(F.col("y") / 5).alias("py"))
          .agg(F.count(F.lit(1)).cast("double").alias("signal"))
          .withColumn("vsi", ((F.col("px") * 7 + F.col("py") * 3) % 16) / 16.0))
    return rounded(A.integrity_summary(A.entity_integrity(px), "vsi_weighted"))


@query("D42", with_parts("""
, p AS (SELECT DISTINCT method, feature_name FROM assigned WHERE method <> 'method_c' OR CAST(substr(feature_name, 5) AS INTEGER) < 50)
SELECT method, count(*) AS n_genes, (SELECT count(DISTINCT feature_name) FROM p) AS n_union,
 round(count(*) / (SELECT count(DISTINCT feature_name) FROM p), 6) AS share_of_union,
 CASE WHEN count(*) = (SELECT count(DISTINCT feature_name) FROM p) THEN 'full_panel' ELSE 'restricted_panel' END AS panel_type,
 CASE WHEN count(*) = (SELECT count(DISTINCT feature_name) FROM p) THEN 'none' ELSE 'inherit_original' END AS completion
FROM p GROUP BY 1""", "assigned"))
def gene_universe_audit(spark, sf):
    m = molecules(spark, sf).where("method <> 'method_c' OR cast(substring(feature_name, 5, 3) AS INT) < 50")
    return rounded(A.gene_universe_audit(A.cell_gene_counts(m, by=["method"])))


@query("D43 D23", with_parts("""
SELECT cell_type, n_entities, round(n_entities / sum(n_entities) OVER (), 6) AS fraction FROM
 (SELECT cell_type, count(*) AS n_entities FROM (SELECT DISTINCT replace(cell_id, '-1', '') AS cell_id FROM assigned WHERE etype = 'partial')
  JOIN cell_labels USING (cell_id) GROUP BY 1)""", "assigned cell_labels"))
def partial_type_distribution(spark, sf):
    ids = molecules(spark, sf).where("etype = 'partial'").select(
        F.regexp_replace("cell_id", "-1$", "").alias("cell_id")).distinct()
    return rounded(A.frequency(J.align_labels(ids, cell_labels(spark, sf)), "cell_type", count_name="n_entities"))


@query("D44", with_parts("""
, ab AS (SELECT cell_type FROM (SELECT cell_type, method, count(*) AS n FROM scored WHERE cell_type IS NOT NULL GROUP BY 1, 2)
  GROUP BY 1 HAVING count(*) FILTER (n >= 290) >= 2)
SELECT method, round(median(entropy), 6) AS median_entropy FROM scored WHERE cell_type IN (SELECT cell_type FROM ab) GROUP BY 1""",
                      "assigned cell_labels", scored=SCORED_SQL))
def block_value(spark, sf):
    cells = scored_cells(spark, sf)
    return rounded(A.block_value(cells, A.abundant_types(cells, 290), "entropy"))


@query("D45", with_parts("""
SELECT (SELECT CAST(sum(count) AS BIGINT) FROM og) AS n_counts, count(*) FILTER (original_cell_id <> 'UNASSIGNED') AS n_assigned,
 count(*) FILTER (original_cell_id = 'UNASSIGNED') AS n_unassigned FROM molecules""", "og"))
def original_counts(spark, sf):
    counts, totals = A.original_counts(molecules(spark, sf))
    return totals.withColumn("n_counts", counts.agg(F.sum("count")).scalar())


@query("D23", with_parts("""
SELECT method, n_cells, CASE WHEN n_cells > 0 THEN coalesce(k, 0) ELSE k END AS n_reject FROM
 (SELECT method, count(*) AS n_cells, CAST(count(*) FILTER (spot_class = 'reject') AS DOUBLE) AS k FROM scored WHERE method <> 'method_c' GROUP BY 1
  UNION ALL SELECT method, count(*), NULL FROM scored WHERE method = 'method_c' GROUP BY 1
  UNION ALL SELECT 'none', 0, NULL)""", "assigned cell_labels", scored=SCORED_SQL))
def combined_info(spark, sf):
    from molq.sources.tables import dummy_row
    cells = scored_cells(spark, sf)
    a = cells.where("method <> 'method_c'").groupBy("method").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("spot_class") == "reject").cast("double").alias("n_reject"))
    b = cells.where("method = 'method_c'").groupBy("method").agg(F.count(F.lit(1)).alias("n_cells"))
    none = dummy_row(spark, {"method": "none", "n_cells": 0}, null_cols=["n_reject"])
    return A.combine_info([a, b, none], zero_cols=["n_reject"])
