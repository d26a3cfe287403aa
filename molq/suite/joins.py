"""Queries over the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.operators import accounting as A
from molq.operators import joins as J
from molq.plans.fixtures import cell_labels, molecules, table, with_parts
from molq.suite.accounting import scored_cells, SCORED_SQL
from molq.suite.base import query
from molq.suite.sources import PAIRS_SQL, raw_pairs
from molq.suite.util import rounded


@query("C01 C03", with_parts("""
SELECT m.transcript_id, m.cell_id, v.original_cell_id, v.qv FROM molecules m
LEFT JOIN (SELECT transcript_id, original_cell_id, qv FROM molecules WHERE z < 4) v USING (transcript_id)"""))
def provenance_and_quality(spark, sf):
    m = molecules(spark, sf)
    vendor = m.where("z < 4").select("transcript_id", F.col("original_cell_id").alias("cell_id"), "qv")
    out = J.provenance_join(m.select("transcript_id", "cell_id"), vendor)
    return J.reattach_quality(out, vendor)


@query("C02", """
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders)
SELECT row_idx + 1 AS molecule_id, concat('c', CAST(o_custkey AS VARCHAR)) AS original_cell_id FROM r""")
def positional_lookup(spark, sf):
    source = J.with_row_index(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    seg = source.select((F.col("row_idx") + 1).alias("molecule_id"))
    src = source.select("row_idx", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cell_id"))
    return J.positional_join(seg, src, "molecule_id", {"cell_id": "original_cell_id"})


@query("C04", with_parts("""
SELECT transcript_id, cell_type AS mapped FROM molecules LEFT JOIN cell_labels USING (cell_id)""", "molecules cell_labels"))
def id_map(spark, sf):
    mapping = cell_labels(spark, sf).select("cell_id", F.col("cell_type").alias("mapped"))
    return J.map_ids(molecules(spark, sf).select("transcript_id", "cell_id"), mapping, "cell_id", "cell_id", "mapped") \
            .select("transcript_id", "mapped")


@query("C05 O03", """
SELECT count(*) AS n_molecules, CAST(0 AS BIGINT) AS n_unmapped, CAST(0 AS BIGINT) AS n_duplicated,
 round(avg(CASE WHEN o_orderkey % 50 > 0 THEN 1.0 ELSE 0 END), 6) AS agreement_with_prior,
 round(avg(CASE WHEN o_orderkey % 40 > 0 THEN 1.0 ELSE 0 END), 6) AS delivered_equals_output,
 CAST(0.0 AS DOUBLE) AS delivered_equals_prior, '1:1 and total' AS checked FROM orders""")
def verified_join_report(spark, sf):
    o = table(spark, sf, "orders")
    key, cell = F.col("o_orderkey").alias("mol_id"), F.col("o_custkey")
    left = o.select(key, F.when(F.col("o_orderkey") % 40 > 0, cell + 100000).otherwise(-1).alias("delivered"))
    right = o.select(key, cell.alias("prior"),
                     F.when(F.col("o_orderkey") % 50 > 0, cell).otherwise(-2).alias("prior_check"),
                     (cell + 100000).alias("produced"))
    return rounded(J.verified_total_join(left, right, "mol_id", "prior", "prior_check", "delivered", "produced"))


@query("C06 C07", with_parts("""
SELECT transcript_id FROM molecules WHERE feature_name IN (SELECT feature_name FROM molecules WHERE qv > 49 AND x < 300)
AND cell_id IN (SELECT cell_id FROM cell_labels WHERE side = 'query') AND cell_id NOT IN (SELECT cell_id FROM cell_labels WHERE cell_type = 'BUILDING')""",
                        "molecules cell_labels"))
def semi_and_anti(spark, sf):
    m, labels = molecules(spark, sf), cell_labels(spark, sf)
    out = J.semi_join_features(m, m.where("qv > 49 AND x < 300"))
    out = J.semi_join_cells(out, labels.where("side = 'query'"))
    return J.exclude_cells(out, labels.where("cell_type = 'BUILDING'")).select("transcript_id")


@query("C08", with_parts("""
SELECT transcript_id, c FROM (SELECT transcript_id, nullif(cell_id, 'UNASSIGNED') AS c FROM molecules)
WHERE c IS NULL OR c IN (SELECT cell_id FROM cell_labels WHERE side = 'query')""", "molecules cell_labels"))
def polygon_semi_join(spark, sf):
    m = molecules(spark, sf).select("transcript_id", F.nullif("cell_id", F.lit("UNASSIGNED")).alias("c"))
    polygons = cell_labels(spark, sf).where("side = 'query'").select(F.col("cell_id").alias("c"))
    return J.keep_polygon_cells(m, polygons, "c")


@query("C09", "WITH pairs AS (" + PAIRS_SQL + """),
g AS (SELECT concat('g', CAST(l_partkey % 17 AS VARCHAR)) AS f FROM lineitem GROUP BY 1 UNION SELECT 'g99')
SELECT count(*) AS n_edges_in, count(*) FILTER (gene_i IN (FROM g) AND gene_j IN (FROM g)) AS n_edges_kept,
 (SELECT count(*) FROM (SELECT gene_i FROM pairs UNION SELECT gene_j FROM pairs)) AS n_genes_in_panel,
 (SELECT count(*) FROM (SELECT gene_i FROM pairs WHERE gene_i IN (FROM g) AND gene_j IN (FROM g) UNION SELECT gene_j FROM pairs WHERE gene_i IN (FROM g) AND gene_j IN (FROM g))) AS n_genes_kept,
 (SELECT count(*) FROM g) AS n_genes_measured,
 (SELECT count(*) FROM g WHERE f NOT IN (SELECT gene_i FROM pairs UNION SELECT gene_j FROM pairs)) AS n_genes_measured_not_in_panel,
 round(count(*) FILTER (gene_i IN (FROM g) AND gene_j IN (FROM g)) / count(*), 6) AS edge_retention FROM pairs""")
def panel_filter_statistics(spark, sf):
    genes = table(spark, sf, "lineitem").select(
        F.concat(F.lit("g"), (F.col("l_partkey") % 17).cast("string")).alias("feature_name"))
    genes = genes.unionByName(spark.range(1).select(F.lit("g99").alias("feature_name")))
    return rounded(J.panel_filter_statistics(raw_pairs(spark, sf), genes))


@query("C10 S03", with_parts("""
, w AS (SELECT concat('r', CAST(s_suppkey AS VARCHAR)) AS roi_id, (s_suppkey * 53) % 900 AS xmin, (s_suppkey * 53) % 900 + 120 AS xmax,
  (s_suppkey * 31) % 900 AS ymin, (s_suppkey * 31) % 900 + 90 AS ymax FROM supplier)
SELECT roi_id, transcript_id FROM molecules JOIN w ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax"""))
def windows_range_join(spark, sf):
    s = F.col("s_suppkey")
    w = table(spark, sf, "supplier").select(
        F.concat(F.lit("r"), s.cast("string")).alias("roi_id"), ((s * 53) % 900).alias("xmin"),
        ((s * 53) % 900 + 120).alias("xmax"), ((s * 31) % 900).alias("ymin"), ((s * 31) % 900 + 90).alias("ymax"))
    return J.windows_join(molecules(spark, sf), w, tile=100).select("roi_id", "transcript_id")


@query("C11", with_parts("""
SELECT transcript_id, round(CAST((floor(y / 25) * 31 + floor(x / 25) * 17) % 101 AS DOUBLE) / 101, 6) AS signal_integrity FROM molecules"""))
def raster_lookup(spark, sf):
    from molq.suite.accounting import rastered
    return rounded(rastered(spark, sf).select("transcript_id", "signal_integrity"))


@query("C13 I02", with_parts("""
SELECT cell_id FROM assigned GROUP BY 1 HAVING count(DISTINCT method) = 3""", "assigned"))
def matched_population(spark, sf):
    return J.matched_population(molecules(spark, sf).where("cell_id <> 'UNASSIGNED'"))


@query("C14", with_parts("""
SELECT m AS method, count(*) AS n_ids, round(avg(CASE WHEN cell_id IN (SELECT cell_id FROM cell_labels) THEN 1.0 ELSE 0 END), 6) AS share_vendor_ids,
 avg(CASE WHEN cell_id IN (SELECT cell_id FROM cell_labels) THEN 1.0 ELSE 0 END) >= 0.5 AS comparable,
 CASE WHEN avg(CASE WHEN cell_id IN (SELECT cell_id FROM cell_labels) THEN 1.0 ELSE 0 END) < 0.5 THEN
  're-segmentation: only 0.0% of its cell ids are vendor ids, so no cell-for-cell match exists' END AS reason
FROM (SELECT DISTINCT etype AS m, cell_id FROM assigned) GROUP BY 1""", "assigned cell_labels"))
def comparability(spark, sf):
    m = molecules(spark, sf).where("cell_id <> 'UNASSIGNED'").select(F.col("etype").alias("method"), "cell_id")
    return rounded(J.comparability(m, cell_labels(spark, sf)))


@query("C16", with_parts("""
SELECT cell_id, coalesce(singlet, FALSE) AS singlet, coalesce(reject, FALSE) AS reject FROM cell_labels LEFT JOIN
 (SELECT cell_id, spot_class = 'singlet' AS singlet, spot_class = 'reject' AS reject FROM scored WHERE method = 'method_a') USING (cell_id)""",
                       "assigned cell_labels", scored=SCORED_SQL))
def meta_with_flags(spark, sf):
    flags = scored_cells(spark, sf).where("method = 'method_a'").select(
        "cell_id", (F.col("spot_class") == "singlet").alias("singlet"), (F.col("spot_class") == "reject").alias("reject"))
    return J.join_meta_flags(cell_labels(spark, sf).select("cell_id"), flags, ["singlet", "reject"])


@query("C18", """
WITH e AS (SELECT n_nationkey AS roi_id, r_name AS method FROM nation, region),
p AS (SELECT DISTINCT n_nationkey AS roi_id, r_name AS method FROM nation JOIN region ON (n_nationkey + r_regionkey) % 3 > 0)
SELECT e.roi_id, e.method, CASE WHEN e.roi_id % 2 = 0 THEN 'out of memory' END AS reason, e.roi_id % 2 = 0 AS explained
FROM e WHERE (roi_id, method) NOT IN (SELECT (roi_id, method) FROM p)""")
def campaign_gaps(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rois, methods = n.select(F.col("n_nationkey").alias("roi_id")), r.select(F.col("r_name").alias("method"))
    runs = F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))
    grid = rois.withColumn("run", F.explode(r.agg(runs).scalar())).select(
        "roi_id", F.col("run.r_name").alias("method"), F.col("run.r_regionkey").alias("k"))
    produced = grid.where((F.col("roi_id") + F.col("k")) % 3 > 0)
    reasons = grid.where("roi_id % 2 = 0").select("roi_id", "method", F.lit("out of memory").alias("reason"))
    return J.gap_detection(rois, methods, produced, reasons)


@query("C19", with_parts("""
SELECT method, CAST(n AS BIGINT) AS n, CASE method WHEN 'method_a' THEN 1 WHEN 'method_b_seg' THEN 2 END::DOUBLE AS runtime FROM
 (SELECT CASE method WHEN 'method_b' THEN 'method_b_seg' ELSE method END AS method, count(*) AS n FROM molecules GROUP BY 1)"""))
def canonical_names(spark, sf):
    n = molecules(spark, sf).groupBy(F.when(F.col("method") == "method_b", "method_b_seg").otherwise(F.col("method")).alias("method")).agg(
        F.count(F.lit(1)).alias("n"))
    run = spark.createDataFrame([("method_a_seg", 1.0), ("method_b", 2.0)], "method string, runtime double")
    return J.canonical_join(n, run)


@query("C20", with_parts("""
, c AS (SELECT * FROM cg WHERE CAST(substr(feature_name, 5) AS INTEGER) < 40)
SELECT * FROM c UNION ALL SELECT * FROM og WHERE feature_name NOT IN (SELECT feature_name FROM c) AND cell_id IN (SELECT cell_id FROM c)""", "cg og"))
def completed_universe(spark, sf):
    m = molecules(spark, sf)
    counts = A.cell_gene_counts(m).where("cast(substring(feature_name, 5, 3) AS INT) < 40")
    return J.complete_universe(counts, A.cell_gene_counts(m, "original_cell_id"))


@query("C22", with_parts("""
SELECT cluster, count(*) AS n FROM assigned JOIN (SELECT cell_id, cell_type AS cluster FROM cell_labels WHERE side = 'query') USING (cell_id) GROUP BY 1""",
                       "assigned cell_labels"))
def clusters_onto_molecules(spark, sf):
    clusters = cell_labels(spark, sf).where("side = 'query'").select("cell_id", F.col("cell_type").alias("cluster"))
    return J.cluster_labels_onto(molecules(spark, sf), clusters, keep_unlabelled=False).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"))


@query("C23", """
SELECT CAST(o_orderkey AS VARCHAR) AS transcript_id, CASE WHEN o_orderkey % 3 > 0 THEN concat('c', CAST(o_custkey AS VARCHAR)) END AS cell_id FROM orders""")
def typed_assignment(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").cast("string").alias("transcript_id"),
                                             F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cell_id"))
    return J.typed_assignment_join(o.select(F.col("o_orderkey").alias("transcript_id")), a)
