"""Queries that write the supplied tables in a producer's format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.operators import accounting as A
from molq.session import shared_folder, shuffle_width
from molq.plans.fixtures import cell_labels, mixture_weights, molecules, table, with_parts
from molq.sources import matrices, sinks, tables, transcripts
from molq.suite.base import query
from molq.suite.util import rounded


# All feature names of the molecule view.
FEATURES = [f"GENE{i:03d}" for i in range(60)]


def scratch(spark, name: str) -> str:
    """A fresh folder for one run under the shared folder."""
    return shared_folder(spark, name)


@query("A03 A05 A07 A15 A16 A18", with_parts("""
SELECT cell_id, feature_name, count FROM cg""", "cg"))
def standardized_roundtrip(spark, sf):
    root = scratch(spark, "std")
    sinks.write_standardized(molecules(spark, sf), root, "m")
    sinks.recompress(spark, f"{root}/transcripts", f"{root}/zstd/transcripts.parquet", "zstd")
    back = transcripts.read_vendor_transcripts(spark, f"{root}/zstd")
    return A.cell_gene_counts(back)


@query("A16 A15", with_parts("""
SELECT cell_id, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, count(*) AS n_transcripts,
 count(DISTINCT feature_name) AS n_genes, 'd1' AS dataset, 'm' AS method FROM assigned GROUP BY 1""", "assigned"))
def cell_by_gene_partitions(spark, sf):
    root = scratch(spark, "cbg")
    sinks.write_cell_by_gene(molecules(spark, sf), root, {"dataset": "d1", "method": "m"})
    return rounded(spark.read.parquet(f"{root}/cells"))


@query("A04 A03", with_parts("""
SELECT CAST(c_custkey AS VARCHAR) AS cell_id, c_acctbal AS centroid_x, c_nationkey AS n_transcripts FROM customer""", ""))
def vendor_cells(spark, sf):
    root = scratch(spark, "cells")
    table(spark, sf, "customer").select(
        F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("cell_id"),
        F.col("c_acctbal").alias("x_centroid"), F.col("c_nationkey").alias("transcript_counts")
    ).write.parquet(f"{root}/cells.parquet")
    return transcripts.read_vendor_cells(spark, root)


@query("A05", with_parts("""
SELECT transcript_id, feature_name, cell_id AS cell_id_method, x AS x_location, y AS y_location, 0.0::DOUBLE AS z_location FROM molecules"""))
def segmentation_csv(spark, sf):
    root = scratch(spark, "seg")
    molecules(spark, sf).select("x", "y", F.col("feature_name").alias("gene"), F.col("cell_id").alias("cell"),
                                "transcript_id").write.option("header", True).csv(f"{root}/seg")
    return transcripts.read_segmentation_csv(spark, f"{root}/seg")


@query("A06", with_parts("""
SELECT o_orderkey AS transcript_id, o_totalprice AS observed_x, o_orderpriority AS gene,
 CASE WHEN o_custkey % 5 > 0 THEN CAST(o_custkey AS VARCHAR) END AS assignment FROM orders""", ""))
def metadata_csv_gz(spark, sf):
    root = scratch(spark, "meta")
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transcript_id"), F.col("o_totalprice").alias("observed_x"),
        F.col("o_orderpriority").alias("gene"),
        F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("assignment")
    ).write.option("header", True).option("compression", "gzip").csv(f"{root}/m.csv.gz")
    return transcripts.read_transcript_metadata_csv(spark, f"{root}/m.csv.gz")


@query("A07", with_parts("""
SELECT transcript_id, feature_name, CASE WHEN etype = 'partial' THEN cell_id ELSE original_cell_id END AS cell_id_method FROM molecules"""))
def predicted_alias_columns(spark, sf):
    root = scratch(spark, "pred")
    molecules(spark, sf).select("transcript_id", F.col("feature_name").alias("gene"),
                                F.when(F.col("etype") == "partial", F.col("cell_id")).alias("predicted_cell_id"),
                                F.col("original_cell_id").alias("cell_id")).write.parquet(f"{root}/p")
    return transcripts.read_predicted_transcripts(spark, f"{root}/p")


@query("A08 A17", with_parts("SELECT feature_name, cell_id, CAST(count AS DOUBLE) AS count FROM cg", "cg"))
def matrix_market_roundtrip(spark, sf):
    root = scratch(spark, "mtx")
    sinks_counts = A.cell_gene_counts(molecules(spark, sf))
    matrices.write_tenx_layout(sinks_counts, root)
    return matrices.read_matrix_market(spark, f"{root}/matrix", f"{root}/feature_names",
                                       f"{root}/cell_ids", "feature_name", "cell_id")


@query("A17", with_parts("""
SELECT f.i AS feature_idx, c.i AS cell_idx, count FROM cg
JOIN (SELECT feature_name, row_number() OVER (ORDER BY feature_name) AS i FROM (SELECT DISTINCT feature_name FROM cg)) f USING (feature_name)
JOIN (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS i FROM (SELECT DISTINCT cell_id FROM cg)) c USING (cell_id)""", "cg"))
def tenx_triplets(spark, sf):
    return matrices.tenx_triplets(A.cell_gene_counts(molecules(spark, sf)))


@query("A25", with_parts("""
SELECT cell_id, """ + ", ".join(f"CAST(sum(CASE WHEN feature_name = '{g}' THEN count ELSE 0 END) AS BIGINT) AS {g}" for g in FEATURES)
+ " FROM cg GROUP BY 1", "cg"))
def wide_counts(spark, sf):
    return matrices.triplets_to_wide(A.cell_gene_counts(molecules(spark, sf)), FEATURES)


@query("A09", with_parts("""
SELECT cell_type, CAST(sum(count) AS BIGINT) AS total FROM og JOIN cell_labels USING (cell_id) WHERE side = 'reference' GROUP BY 1""", "og cell_labels"))
def reference_tables(spark, sf):
    root = scratch(spark, "ref")
    ref = cell_labels(spark, sf).where("side = 'reference'")
    counts = A.cell_gene_counts(molecules(spark, sf), "original_cell_id").join(ref, "cell_id", "left_semi")
    counts.withColumnRenamed("count", "counts").withColumn("value", F.lit(0.5)).write.parquet(f"{root}/c")
    ref.write.parquet(f"{root}/o")
    c, o = tables.read_reference(spark, f"{root}/c", f"{root}/o")
    return c.join(o, "cell_id").groupBy("cell_type").agg(F.sum("count").alias("total"))


# A directed pair table with repeats, self pairs and undefined values.
PAIRS_SQL = """SELECT concat('g', CAST(l_partkey % 23 AS VARCHAR)) AS gene_i, concat('g', CAST(l_suppkey % 19 AS VARCHAR)) AS gene_j,
 min(CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_orderkey % 101 AS DOUBLE) / 128 END) AS v FROM lineitem GROUP BY 1, 2"""


def raw_pairs(spark, sf):
    v = F.when(F.col("l_orderkey") % 5 > 0, (F.col("l_orderkey") % 101).cast("double") / 128)
    tag = lambda c, n: F.concat(F.lit("g"), (F.col(c) % n).cast("string"))
    return table(spark, sf, "lineitem").groupBy(tag("l_partkey", 23).alias("gene_i"), tag("l_suppkey", 19).alias("gene_j")).agg(
        F.min(v).alias("NPMI"))


@query("A10 A11 E14", "WITH pairs AS (" + PAIRS_SQL + """)
SELECT gene_i, gene_j, value FROM (SELECT *, row_number() OVER (PARTITION BY gene_i, gene_j ORDER BY side) AS n FROM
 (SELECT gene_i, gene_j, v AS value, 0 AS side FROM pairs WHERE gene_i <> gene_j AND v IS NOT NULL
  UNION ALL SELECT gene_j, gene_i, v, 1 FROM pairs WHERE gene_i <> gene_j AND v IS NOT NULL)) WHERE n = 1""")
def pair_panel_expanded(spark, sf):
    root = scratch(spark, "panel")
    raw_pairs(spark, sf).write.option("header", True).option("compression", "gzip").csv(f"{root}/p")
    return tables.read_pair_panel(spark, f"{root}/p", finite_only=True)


@query("A12 F41", with_parts("""
SELECT cell_id, count(*) AS n_types, round(sum(weight), 6) AS total FROM weights GROUP BY 1""", "weights"))
def per_cell_weights_tsv(spark, sf):
    root = scratch(spark, "weights")
    w = mixture_weights(spark, sf)
    types = [r.cell_type for r in w.select("cell_type").distinct().orderBy("cell_type").collect()]
    w.groupBy("cell_id").pivot("cell_type", types).agg(F.sum("weight")).write.option(
        "header", True).option("sep", "\t").csv(f"{root}/w")
    long = tables.wide_weights_to_long(tables.read_per_cell_table(spark, f"{root}/w"))
    return rounded(long.where("weight IS NOT NULL").groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_types"), F.sum("weight").alias("total")))


@query("A14 I09 D07", with_parts("""
SELECT method, 'ok' AS status, CAST(count(*) AS DOUBLE) AS n_transcripts_total, CAST(count(*) FILTER (cell_id <> 'UNASSIGNED') AS DOUBLE) AS n_transcripts_assigned,
 CAST(count(DISTINCT feature_name) AS VARCHAR) AS qc_genes FROM molecules GROUP BY 1
UNION ALL SELECT NULL, 'unreadable', NULL, NULL, NULL"""))
def run_stats_collected(spark, sf):
    root = scratch(spark, "stats")
    stats = molecules(spark, sf).groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cell_id") != "UNASSIGNED").alias("a"),
        F.countDistinct("feature_name").alias("g"))
    docs = stats.select("method", F.to_json(F.struct(
        "method", F.lit("ok").alias("status"),
        F.struct(F.col("n").alias("n_total"), F.col("a").alias("n_assigned")).alias("transcripts"),
        F.create_map(F.lit("genes"), F.col("g").cast("string")).alias("qc"))).alias("value"))
    bad = spark.range(1).select(F.lit("zz_broken").alias("method"), F.lit("{not json").alias("value"))
    # One folder per run, each with its own statistics file.
    docs.unionByName(bad).repartition("method").write.partitionBy("method").text(f"{root}/runs")
    flat = tables.flatten_stats(tables.collect_run_stats(spark, f"{root}/runs", "*.txt"), ["genes"])
    return flat.select("method", "status", "n_transcripts_total", "n_transcripts_assigned", "qc_genes").withColumns(
        {c: F.col(c).cast("double") for c in ("n_transcripts_total", "n_transcripts_assigned")})


@query("A19 A20 A24", None)
def input_manifest(spark, sf):
    return sinks.file_manifest(spark, sf)


@query("A19 A20", """
SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256
FROM (SELECT c_nationkey, c_custkey, concat(c_custkey, '|', c_mktsegment) AS line FROM customer) GROUP BY 1""")
def listed_file_digests(spark, sf):
    """Sizes and digests of a list of folders, each with one text file of its nation's customers in order."""
    root, nation = scratch(spark, "listed"), F.col("c_nationkey")
    customers = table(spark, sf, "customer")
    (customers.repartition(shuffle_width(customers), nation).sortWithinPartitions(nation, "c_custkey")
     .select(nation, F.concat_ws("|", F.col("c_custkey").cast("string"), "c_mktsegment").alias("line"))
     .write.partitionBy("c_nationkey").text(root))
    # One folder per nation: the list is bounded by the nations there are.
    listed = [f"{root}/c_nationkey={r.c_nationkey}" for r in customers.select(nation).distinct().collect()]
    return sinks.file_manifest(spark, listed, root).select(
        F.regexp_extract("path", "c_nationkey=([0-9]+)/", 1).alias("nation"), "bytes", "sha256")


@query("A24", with_parts("""
SELECT 'panel=' || method AS panel, feature_name AS file, md5(feature_name || '-' || CAST(count(*) AS VARCHAR)) AS checksum FROM molecules GROUP BY 1, 2, method"""))
def combined_checksums(spark, sf):
    """Checksum tables of several panels, one folder each, stacked with their panel."""
    root = scratch(spark, "sums")
    sums = molecules(spark, sf).groupBy("method", "feature_name").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("method").alias("panel"), F.col("feature_name").alias("file"),
        F.md5(F.concat_ws("-", "feature_name", F.col("n").cast("string"))).alias("checksum"))
    sums.write.partitionBy("panel").option("header", True).csv(root)
    panels = [f"{root}/panel={m}" for m in ("method_a", "method_b", "method_c")]
    return tables.combine_checksums(spark, panels).select("panel", "file", "checksum")


@query("A21", with_parts("SELECT DISTINCT feature_name FROM molecules"))
def feature_inventory(spark, sf):
    return sinks.feature_inventory(molecules(spark, sf))


@query("A22", with_parts("SELECT count(*) AS n_rows, TRUE AS order_independent, TRUE AS content_sensitive FROM molecules"))
def population_identity_laws(spark, sf):
    m = molecules(spark, sf)
    h = lambda d: sinks.population_hash(d).select("population_hash").scalar()
    # Another order and other tasks; the id spreads the rows, of which quality values are too few.
    shuffled = m.select("transcript_id", "feature_name", "qv").repartition(shuffle_width(m), "qv", "transcript_id")
    edited = m.withColumn("feature_name", F.upper(F.concat("feature_name", F.lit("x"))))
    return sinks.population_hash(m).select("n_rows", (F.col("population_hash") == h(shuffled)).alias("order_independent"),
                                           (F.col("population_hash") != h(edited)).alias("content_sensitive"))


@query("A22", with_parts("""
, h AS (SELECT md5(transcript_id || '|' || feature_name) AS d FROM molecules)
SELECT count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(d, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-'
 || CAST(sum(CAST(CAST('0x' || substr(d, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS population_hash FROM h"""))
def population_identity(spark, sf):
    return sinks.population_hash(molecules(spark, sf))


@query("A23 I01", with_parts("""
SELECT method, CAST(count(*) AS DOUBLE) AS n_cells FROM molecules GROUP BY 1 UNION ALL SELECT 'absent', 0.0"""))
def dummy_row_stacked(spark, sf):
    real = molecules(spark, sf).groupBy("method").agg(F.count(F.lit(1)).cast("double").alias("n_cells"))
    return real.unionByName(tables.dummy_row(spark, {"method": "absent"}, zero_cols=["n_cells"]))


@query("A13 F18", with_parts("""
SELECT grp AS "group", count(*) AS n_molecules FROM molecules JOIN (VALUES ('alpha', 'GENE000'), ('alpha', 'GENE010'), ('beta', 'GENE001'), ('beta', 'GENE002')) g(grp, feature_name)
 USING (feature_name) GROUP BY 1"""))
def marker_group_file(spark, sf):
    root = scratch(spark, "groups")
    text = "alpha:\n  - GENE000  # first\n  - GENE010\nbeta: [GENE001, 'GENE002']\n"
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{root}/g")
    groups = tables.read_marker_groups(spark, f"{root}/g")
    return molecules(spark, sf).join(groups, "feature_name").groupBy("group").agg(
        F.count(F.lit(1)).alias("n_molecules"))
