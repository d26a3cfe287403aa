"""Queries over the contract operators: standardise, adapt, filter, sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.operators import contract as C
from molq.plans.fixtures import cell_labels, mixture_weights, molecules, table, with_parts
from molq.suite.base import query
from molq.suite.util import rounded

CORE_SQL = "('UNASSIGNED','Unassigned','unassigned','DROP','drop','nan','NaN','None','','0','-1','NA','<NA>')"


@query("B01 B05", with_parts("""
SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, feature_name,
  CASE WHEN cell_id IS NULL OR cell_id IN """ + CORE_SQL + """ THEN 'UNASSIGNED' ELSE cell_id END AS cell_id,
  'method_x' AS method, CAST(z AS FLOAT) AS z, transcript_id, CAST(qv AS FLOAT) AS qv,
  CAST(overlaps_nucleus AS TINYINT) AS overlaps_nucleus, original_cell_id,
  CASE WHEN cell_id IS NULL OR cell_id IN """ + CORE_SQL + """ THEN 'unassigned' ELSE 'whole' END AS whole_partial_status
FROM (SELECT * REPLACE (CASE WHEN cell_id = 'UNASSIGNED' THEN
        (CASE CAST(x AS BIGINT) % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'nan' END)
        ELSE cell_id END AS cell_id) FROM molecules)"""))
def standardized_contract(spark, sf):
    raw = molecules(spark, sf).drop("method", "etype")
    spelled = (F.when(F.col("x").cast("long") % 4 == 0, "NA").when(F.col("x").cast("long") % 4 == 1, "")
               .when(F.col("x").cast("long") % 4 == 3, "nan"))
    raw = raw.withColumn("my_cell", F.when(F.col("cell_id") == "UNASSIGNED", spelled)
                         .otherwise(F.col("cell_id"))).drop("cell_id")
    raw = raw.withColumnsRenamed({"x": "x_location", "y": "y_location", "feature_name": "gene"})
    return C.standardize_transcripts(raw, "method_x", {
        "x_location": "x", "y_location": "y", "gene": "feature_name", "my_cell": "cell_id"})


@query("B04 A01", with_parts("""
SELECT 'all' AS method, TRUE AS schema_valid,
  'z,transcript_id,qv,overlaps_nucleus,original_cell_id' AS optional_columns_present,
  count(*) AS n_transcripts_total, count(*) FILTER (cell_id <> 'UNASSIGNED') AS n_transcripts_assigned,
  count(*) FILTER (cell_id = 'UNASSIGNED') AS n_transcripts_unassigned,
  round(count(*) FILTER (cell_id <> 'UNASSIGNED') / count(*), 6) AS frac_assigned,
  count(DISTINCT CASE WHEN cell_id <> 'UNASSIGNED' THEN cell_id END) AS n_unique_cells
FROM molecules"""))
def schema_report(spark, sf):
    return rounded(C.validate_schema(molecules(spark, sf), "all"))


@query("B02", with_parts("""
SELECT transcript_id, x AS x_location, y AS y_location, feature_name, CAST(cell_id AS VARCHAR) AS cell_id_method,
  CAST(0.0 AS DOUBLE) AS z_location, CAST(NULL AS DOUBLE) AS qv, CAST(NULL AS DOUBLE) AS overlaps_nucleus,
  CAST(NULL AS VARCHAR) AS cell_id_xenium_default, CAST(NULL AS VARCHAR) AS assignment_source,
  'm' AS method FROM molecules"""))
def transcript_columns_filled(spark, sf):
    raw = molecules(spark, sf).select(
        "transcript_id", F.col("x").alias("x_location"), F.col("y").alias("y_location"),
        "feature_name", F.col("cell_id").alias("cell_id_method"))
    return C.ensure_transcript_columns(raw, "m").withColumn(
        "overlaps_nucleus", F.col("overlaps_nucleus").cast("double"))


@query("B03", """
SELECT CAST(c_custkey AS VARCHAR) AS cell_id, c_acctbal AS area, CAST(NULL AS DOUBLE) AS centroid_x,
  CAST(NULL AS DOUBLE) AS centroid_y, CAST(NULL AS DOUBLE) AS n_transcripts, CAST(NULL AS DOUBLE) AS n_genes,
  'm' AS method FROM customer""")
def cell_columns_filled(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"),
                                                F.col("c_acctbal").alias("area"))
    return C.ensure_cell_columns(cells, "m").withColumns(
        {c: F.col(c).cast("double") for c in ("n_transcripts", "n_genes")})


@query("B06 B07 B08", with_parts("""
SELECT count(*) AS n_rows, count(DISTINCT feature_name) AS n_features FROM molecules
WHERE NOT (CAST(substr(feature_name, 5) AS INTEGER) % 10 = 3) AND NOT (CAST(substr(feature_name, 5) AS INTEGER) % 10 = 7)
  AND qv >= 20"""))
def controls_and_quality(spark, sf):
    digit = F.substring("feature_name", 5, 3).cast("int") % 10
    named = molecules(spark, sf).withColumn("feature_name", F.when(
        digit == 3, F.concat(F.lit("BLANK_"), "feature_name")).when(
        digit == 7, F.concat(F.lit("NegControl"), "feature_name")).otherwise(F.col("feature_name")))
    by_pattern = C.filter_controls(named)
    by_prefix = C.filter_controls_prefix(by_pattern)
    return C.filter_quality(by_prefix, 20).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("feature_name").alias("n_features"))


@query("B06", with_parts("""
SELECT transcript_id, feature_name FROM molecules WHERE overlaps_nucleus = 1"""))
def controls_by_gene_flag(spark, sf):
    flagged = molecules(spark, sf).withColumn("is_gene", F.col("overlaps_nucleus"))
    return C.filter_controls(flagged).select("transcript_id", "feature_name")


@query("B09", with_parts("""
SELECT transcript_id, x, y FROM molecules WHERE x >= 100 AND x <= 400 AND y >= 250"""))
def box_closed(spark, sf):
    return C.filter_box_closed(molecules(spark, sf), x_min=100, x_max=400, y_min=250) \
            .select("transcript_id", "x", "y")


@query("B10", with_parts("""
SELECT 'partial_cells_only' AS mode, count(*) AS n_total,
 count(*) FILTER (etype = 'cell') AS n_whole_cells_transcripts,
 count(*) FILTER (etype = 'partial') AS n_partial_cells_transcripts,
 count(*) FILTER (etype = 'unknown') AS n_other_transcripts,
 count(*) FILTER (etype = 'partial') AS n_kept_after_entity_filter,
 count(*) FILTER (etype <> 'partial') AS n_excluded_by_entity_filter FROM molecules"""))
def entity_class_filter_counts(spark, sf):
    mode = "partial_cells_only"
    return C.entity_class_counts(molecules(spark, sf), mode).select(F.lit(mode).alias("mode"), "*")


@query("B10", with_parts("SELECT transcript_id, etype FROM molecules WHERE etype = 'cell'"))
def entity_class_filter(spark, sf):
    return C.filter_entity_class(molecules(spark, sf), "whole_cells_only").select(
        "transcript_id", "etype")


@query("B11 I02", with_parts("""
SELECT feature_name FROM molecules WHERE method = 'method_a'
INTERSECT SELECT feature_name FROM molecules WHERE method = 'method_b'
INTERSECT SELECT feature_name FROM molecules WHERE qv > 49 AND x < 300"""))
def gene_set_intersection(spark, sf):
    m = molecules(spark, sf)
    return C.resolve_gene_set("intersect_reference", m.where("method = 'method_a'"),
                              m.where("method = 'method_b'"), m.where("qv > 49 AND x < 300"))


@query("B11", with_parts("""
(SELECT feature_name FROM molecules WHERE method = 'method_a'
UNION SELECT feature_name FROM molecules WHERE method = 'method_b')
INTERSECT SELECT feature_name FROM molecules WHERE qv > 49 AND x < 300"""))
def gene_set_shared_panel(spark, sf):
    m = molecules(spark, sf)
    return C.resolve_gene_set("all_shared_genes", m.where("method = 'method_a'"),
                              m.where("method = 'method_b'"), m.where("qv > 49 AND x < 300"))


@query("B12 S16", with_parts("""
SELECT count(DISTINCT original_cell_id) AS n_ids FROM molecules"""))
def label_column_choice(spark, sf):
    m = molecules(spark, sf).withColumnRenamed("original_cell_id", "stitched")
    return m.agg(F.countDistinct(C.label_column(m)).alias("n_ids"))


# A dense 1-based molecule index over the lines, used as a producer's own numbering.
ROW_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS row_idx FROM lineitem"""


@query("B14 S08", """
WITH t AS (SELECT o_orderkey AS transcript_id, o_custkey % 97 AS assignment FROM orders)
SELECT transcript_id, CASE WHEN assignment = (SELECT max(assignment) FROM t) THEN 'UNASSIGNED'
  ELSE CAST(assignment AS VARCHAR) END AS cell_id_method, 'max_id' AS method, 'max_id' AS assignment_source FROM t""")
def adapter_max_id(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_orderkey").alias("transcript_id"),
                                            (F.col("o_custkey") % 97).alias("assignment"))
    return C.adapt_max_id(raw)


@query("B15 C04 A06", """
WITH t AS (SELECT o_orderkey AS transcript_id, o_custkey % 50 AS a, o_orderkey % 7 = 0 AS background,
  o_orderkey % 1000 AS ox, o_custkey % 1000 AS oy, o_orderpriority AS gene FROM orders)
SELECT transcript_id, CAST(ox AS FLOAT) AS x, CAST(oy AS FLOAT) AS y, gene AS feature_name,
 CASE WHEN a % 5 = 0 OR background THEN 'UNASSIGNED' ELSE concat('p-', CAST(a AS VARCHAR)) END AS cell_id,
 'background' AS method,
 CASE WHEN a % 5 = 0 OR background THEN NULL WHEN a < 40 THEN concat('orig', CAST(a AS VARCHAR)) END AS original_cell_id,
 CASE WHEN a % 5 = 0 OR background THEN 'unassigned' ELSE 'whole' END AS whole_partial_status FROM t""")
def adapter_background(spark, sf):
    o = table(spark, sf, "orders")
    a = F.col("o_custkey") % 50
    raw = o.select(F.col("o_orderkey").alias("transcript_id"),
                   F.when(a % 5 != 0, a.cast("string")).alias("assignment"),
                   (F.col("o_orderkey") % 7 == 0).alias("background"),
                   F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y"),
                   (F.col("o_orderkey") % 1000).alias("observed_x"),
                   (F.col("o_custkey") % 1000).alias("observed_y"),
                   F.col("o_orderpriority").alias("gene"))
    ids = o.select(a.alias("cell")).distinct().where("cell < 40").withColumn(
        "original_cell_id", F.concat(F.lit("orig"), F.col("cell").cast("string")))
    return C.adapt_background(raw, ids, prefix="p-")


@query("B16 A07", """
SELECT CAST(o_orderkey % 1000 AS FLOAT) AS x, CAST(o_custkey % 1000 AS FLOAT) AS y, o_orderpriority AS feature_name,
 CASE WHEN o_custkey % 9 = 0 THEN 'UNASSIGNED' ELSE CAST(o_custkey AS VARCHAR) END AS cell_id,
 'predicted' AS method, o_orderkey AS transcript_id,
 CASE WHEN o_custkey % 9 = 0 THEN 'unassigned' ELSE 'whole' END AS whole_partial_status FROM orders""")
def adapter_predicted(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transcript_id"), (F.col("o_orderkey") % 1000).alias("x_location"),
        (F.col("o_custkey") % 1000).alias("y_location"), F.col("o_orderpriority").alias("feature_name"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("predicted_cell_id"))
    return C.adapt_predicted(raw)


@query("B17", with_parts("""
SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, feature_name,
 CASE WHEN qv < 10 THEN 'UNASSIGNED' ELSE original_cell_id END AS cell_id, 'cleaned' AS method,
 CAST(z AS FLOAT) AS z, transcript_id, original_cell_id,
 CASE WHEN qv < 10 THEN 'cleaned_to_unassigned' ELSE 'retained' END AS cleaned_status,
 CASE WHEN qv < 10 THEN 'unassigned' ELSE 'whole' END AS whole_partial_status
FROM orig"""
, "orig"))
def adapter_retained_removed(spark, sf):
    m = molecules(spark, sf).where("original_cell_id <> 'UNASSIGNED'").select(
        "x", "y", "z", F.col("feature_name").alias("gene"), F.col("original_cell_id").alias("cell"),
        F.col("transcript_id").alias("mol_id"), "qv")
    return C.adapt_retained_removed(m.where("qv >= 10"), m.where("qv < 10"))


@query("B18", """
WITH s AS (SELECT l_suppkey AS bin_id, sum(l_quantity) AS q FROM lineitem WHERE l_suppkey % 6 > 0 GROUP BY 1)
SELECT CAST(s_suppkey % 10 AS FLOAT) AS x, CAST(s_suppkey // 10 AS FLOAT) AS y, 'bin' AS feature_name,
 CASE WHEN s_nationkey % 5 = 0 THEN 'UNASSIGNED' ELSE CAST(s_nationkey AS VARCHAR) END AS cell_id, 'bins' AS method,
 CAST(s_suppkey AS VARCHAR) AS transcript_id,
 CASE WHEN s_nationkey % 5 = 0 THEN 'unassigned' ELSE 'whole' END AS whole_partial_status,
 CAST(coalesce(q, 0) AS FLOAT) AS n_counts_bin
FROM supplier LEFT JOIN s ON s_suppkey = bin_id""")
def adapter_bins(spark, sf):
    s = table(spark, sf, "supplier")
    bins = s.select(F.col("s_suppkey").alias("bin_id"), (F.col("s_suppkey") % 10).alias("x"),
                    F.floor(F.col("s_suppkey") / 10).alias("y"))
    counts = table(spark, sf, "lineitem").where("l_suppkey % 6 > 0").select(
        F.col("l_suppkey").alias("bin_id"), F.col("l_quantity").alias("count"))
    labels = s.select(F.col("s_suppkey").alias("bin_id"), F.when(
        F.col("s_nationkey") % 5 == 0, 0).otherwise(F.col("s_nationkey")).alias("cell_id"))
    return C.adapt_bins(bins, counts, labels)


@query("B13 C02 A05", "WITH r AS (" + ROW_SQL + """)
SELECT CAST(l_partkey % 100 AS FLOAT) AS x, CAST(l_suppkey % 100 AS FLOAT) AS y, CAST(l_linenumber AS FLOAT) AS z,
 CAST(l_partkey % 60 AS VARCHAR) AS feature_name,
 CASE WHEN l_orderkey % 4 = 0 OR l_partkey % 10 = 0 THEN 'UNASSIGNED' ELSE CAST(l_orderkey AS VARCHAR) END AS cell_id,
 'molecule_csv' AS method, concat('t', CAST(row_idx AS VARCHAR)) AS transcript_id, CAST(l_quantity AS FLOAT) AS qv,
 CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS TINYINT) AS overlaps_nucleus,
 concat('v', CAST(l_orderkey % 500 AS VARCHAR)) AS original_cell_id,
 CASE WHEN l_orderkey % 4 = 0 OR l_partkey % 10 = 0 THEN 'unassigned' ELSE 'whole' END AS whole_partial_status FROM r""")
def adapter_molecule_csv(spark, sf):
    from molq.operators.joins import with_row_index
    l = with_row_index(table(spark, sf, "lineitem"),
                       ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    source = l.select("row_idx", F.concat(F.lit("t"), F.col("row_idx").cast("string")).alias("transcript_id"),
                      F.col("l_quantity").alias("qv"),
                      F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("overlaps_nucleus"),
                      F.concat(F.lit("v"), (F.col("l_orderkey") % 500).cast("string")).alias("cell_id"))
    seg = l.select((F.col("row_idx") + 1).alias("molecule_id"), (F.col("l_partkey") % 100).alias("x"),
                   (F.col("l_suppkey") % 100).alias("y"), F.col("l_linenumber").alias("z"),
                   (F.col("l_partkey") % 60).alias("gene"),
                   F.when(F.col("l_orderkey") % 4 != 0, F.col("l_orderkey")).alias("cell"),
                   F.when(F.col("l_partkey") % 10 == 0, "True").otherwise("false").alias("is_noise"))
    return C.adapt_molecule_csv(seg, source)


@query("B31", """
WITH p AS (SELECT o_orderkey AS r, CASE WHEN o_custkey % 6 > 0 THEN concat('n', CAST(o_custkey AS VARCHAR)) END AS pred,
  o_custkey % 10 AS similarity, o_orderkey % 10 AS similarity_threshold FROM orders WHERE o_orderkey % 3 > 0)
SELECT o.o_orderkey AS row_idx, CAST(o.o_custkey AS VARCHAR) AS original_cell_id,
 CASE WHEN pred IS NOT NULL AND similarity >= similarity_threshold THEN pred ELSE 'UNASSIGNED' END AS cell_id,
 CASE WHEN pred IS NOT NULL AND similarity >= similarity_threshold THEN 'whole' ELSE 'unassigned' END AS whole_partial_status,
 CAST(similarity AS DOUBLE) AS similarity, CAST(similarity_threshold AS DOUBLE) AS similarity_threshold
FROM orders o LEFT JOIN p ON o.o_orderkey = p.r""")
def adapter_row_predictions(spark, sf):
    o = table(spark, sf, "orders")
    source = o.select(F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").alias("cell_id"))
    pred = o.where("o_orderkey % 3 > 0").select(
        F.col("o_orderkey").alias("row_idx"),
        F.when(F.col("o_custkey") % 6 > 0, F.concat(F.lit("n"), F.col("o_custkey").cast("string")))
        .alias("predicted_cell_id"),
        (F.col("o_custkey") % 10).cast("double").alias("similarity"),
        (F.col("o_orderkey") % 10).cast("double").alias("similarity_threshold"))
    return C.adapt_row_predictions(source, pred)


@query("B19 B20 B21", """
SELECT p_partkey, CASE WHEN p_name IN ('T') THEN p_name WHEN low LIKE '%steel%' THEN 'Plasma' WHEN low LIKE '%brass%' OR low LIKE '%tin%' THEN 'T' ELSE 'NA' END AS coarse,
 CASE WHEN low LIKE '%standard%' THEN 'immune' WHEN low LIKE '%small%' OR low LIKE '%medium%' THEN 'stroma' ELSE 'other' END AS compartment,
 CASE WHEN low LIKE '%polished%' THEN 'A' WHEN low LIKE '%pol%' THEN 'B' WHEN low LIKE '%brushed%' THEN 'C' END AS category
FROM (SELECT *, lower(p_type) AS low FROM part)""")
def label_crosswalk(spark, sf):
    p = table(spark, sf, "part")
    rules = (("Mast", ("copper",)), ("Plasma", ("steel",)), ("T", ("brass", "tin")))
    return p.select("p_partkey", X.map_label("p_type", ("Plasma", "T"), rules).alias("coarse"),
                    X.first_match("p_type", (("immune", ("standard",)), ("stroma", ("small", "medium"))),
                                  "other").alias("compartment"),
                    X.first_match("p_type", (("A", ("Polished",)), ("B", ("POL",)), ("C", ("BRUSHED",))),
                                  None).alias("category"))


@query("B22 B23 B24", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'seconds' WHEN 1 THEN 'GiB' WHEN 2 THEN 'count' WHEN 3 THEN 'percent'
  WHEN 4 THEN 'fraction' ELSE 'unitless' END AS unit,
 CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars,
 CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN 'p<0.001' ELSE printf('p=%.3f', p) END AS label,
 CASE WHEN p_size <= 10 THEN 'rare' WHEN p_size < 30 THEN 'low_abundance' ELSE 'common' END AS abundance
FROM (SELECT *, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_partkey % 97 AS DOUBLE) / 1024.0 END AS p FROM part)""")
def scalar_labels(spark, sf):
    key = F.col("p_partkey")
    # One metric name per unit.
    names = F.array(*[F.lit(n) for n in ("runtime_total_s", "peak_rss_gb", "n_cells",
                                         "assignment_percent", "frac_assigned", "purity")])
    p = table(spark, sf, "part").withColumns({
        "name": F.element_at(names, (key % 6 + 1).cast("int")),
        "p": F.when(key % 11 > 0, (key % 97).cast("double") / F.lit(1024.0))})
    return p.select("p_partkey", X.metric_unit("name").alias("unit"), X.p_stars("p").alias("stars"),
                    X.p_label("p").alias("label"),
                    X.abundance_class("p_size", 11, 30).alias("abundance"))


@query("B25", with_parts("""
SELECT cell_id, feature_name, CAST(round_even(count * 0.75, 0) AS DOUBLE) AS count,
  abs(count * 0.75 - round_even(count * 0.75, 0)) > 1e-8 AS was_fractional
FROM cg WHERE round_even(count * 0.75, 0) <> 0""", "cg"))
def counts_rounded_half_even(spark, sf):
    from molq.operators.accounting import cell_gene_counts
    counts = cell_gene_counts(molecules(spark, sf)).withColumn("count", F.col("count") * F.lit(0.75))
    return C.normalize_counts_integer(counts)


@query("B25", with_parts("SELECT max(count) * 0.75 <> 0 AS counts_are_fractional FROM cg", "cg"))
def counts_fractional_flag(spark, sf):
    from molq.operators.accounting import cell_gene_counts
    counts = cell_gene_counts(molecules(spark, sf)).withColumn("count", F.col("count") * F.lit(0.75))
    return C.counts_are_fractional(counts)


@query("B26 B27 C06", with_parts("""
SELECT cell_id, feature_name, count FROM og
WHERE cell_id IN (SELECT cell_id FROM cell_labels WHERE side = 'reference' AND cell_type <> 'MACHINERY')
  AND feature_name IN (SELECT feature_name FROM molecules WHERE qv > 49 AND x < 300)""", "og cell_labels"))
def reference_restricted(spark, sf):
    from molq.operators.accounting import cell_gene_counts
    m = molecules(spark, sf)
    obs = C.drop_celltypes(cell_labels(spark, sf).where("side = 'reference'"), ["MACHINERY"])
    counts = cell_gene_counts(m, "original_cell_id").join(obs, "cell_id", "left_semi")
    return C.restrict_genes(counts, m.where("qv > 49 AND x < 300"))


@query("B28", with_parts("""
SELECT transcript_id, feature_name FROM molecules
ORDER BY CAST('0x' || substr(md5('7-' || transcript_id), 1, 15) AS BIGINT), transcript_id LIMIT 500"""))
def seeded_sample(spark, sf):
    return C.subsample(molecules(spark, sf), 500, seed=7).select("transcript_id", "feature_name")


@query("B28", with_parts("SELECT least(count(*), 5000) AS n, least(count(*), 5000) AS n_distinct FROM molecules"))
def seeded_sample_size(spark, sf):
    return C.subsample(molecules(spark, sf), 5000, seed=7).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("transcript_id").alias("n_distinct"))


@query("B29", with_parts("""
SELECT transcript_id, x, y FROM molecules, (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM molecules)
WHERE abs(x - mx) <= 100 AND abs(y - my) <= 100
ORDER BY CAST('0x' || substr(md5('3-' || transcript_id), 1, 15) AS BIGINT), transcript_id LIMIT 300"""))
def center_sample(spark, sf):
    return C.center_subset(molecules(spark, sf).select("transcript_id", "x", "y"), 200.0, 300, seed=3)


@query("B33", with_parts("""
SELECT transcript_id, x, y FROM molecules, (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM molecules)
WHERE x BETWEEN (a+b)/2 - (b-a)*0.5/2 AND (a+b)/2 + (b-a)*0.5/2
  AND y BETWEEN (c+d)/2 - (d-c)*0.5/2 AND (c+d)/2 + (d-c)*0.5/2"""))
def centred_crop(spark, sf):
    return C.centred_crop(molecules(spark, sf), 0.25).select("transcript_id", "x", "y")


@query("B32", with_parts("""
SELECT count(*) FILTER (cell_id = 'UNASSIGNED' AND overlaps_nucleus <> 0) AS n_cleared,
  CAST(sum(CASE WHEN cell_id <> 'UNASSIGNED' THEN overlaps_nucleus ELSE 0 END) AS BIGINT) AS n_nuclear FROM molecules"""))
def nuclear_flags_cleared(spark, sf):
    m = molecules(spark, sf)
    left = C.clear_nuclear_flag(m).agg(F.sum("overlaps_nucleus").alias("n")).scalar()
    return C.nuclear_flag_changes(m).withColumn("n_nuclear", left)


@query("B34", with_parts("""
SELECT a.cell_id, feature_name, count(*) AS count FROM assigned a
WHERE cell_id IN (SELECT cell_id FROM cell_labels WHERE cell_type = 'BUILDING') GROUP BY 1, 2""",
                         "assigned cell_labels"))
def bundle_rebuilt_counts(spark, sf):
    labels = cell_labels(spark, sf)
    return C.bundle_subset(molecules(spark, sf), labels, labels.where("cell_type = 'BUILDING'"))["cell_gene"]


@query("B35", with_parts("""
SELECT transcript_id, coalesce(code, -1) AS code FROM molecules LEFT JOIN
 (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS code FROM (SELECT DISTINCT cell_id FROM assigned)) USING (cell_id)""",
                         "assigned"))
def entity_integer_codes(spark, sf):
    m = molecules(spark, sf)
    return C.attach_codes(m, C.entity_codes(m)).select("transcript_id", "code")


@query("S01", with_parts("""
SELECT preset, count(*) AS n FROM (SELECT CASE o_custkey % 6 WHEN 0 THEN 'background' WHEN 1 THEN 'drop' WHEN 2 THEN 'NA'
 WHEN 3 THEN '<NA>' WHEN 4 THEN '-1.0' ELSE 'c1' END AS id FROM orders) t,
 (VALUES ('core', ['drop','NA','<NA>']), ('metric', ['NA']), ('recovery', ['<NA>']),
  ('figure', ['background','drop','NA','<NA>','-1.0']), ('window', ['background','drop','NA','<NA>'])) v(preset, toks)
WHERE list_contains(toks, id) GROUP BY 1""", ""))
def token_presets(spark, sf):
    o = table(spark, sf, "orders")
    # One spelling per residue.
    spellings = F.array(*[F.lit(s) for s in ("background", "drop", "NA", "<NA>", "-1.0", "c1")])
    ids = o.select(F.element_at(spellings, (F.col("o_custkey") % 6 + 1).cast("int")).alias("id"))
    names = ("core", "metric", "recovery", "figure", "window")
    flags = F.array_compact(F.array(*[F.when(X.is_unassigned("id", n), n) for n in names]))
    return ids.select(F.explode(flags).alias("preset")).groupBy("preset").agg(
        F.count(F.lit(1)).alias("n"))
