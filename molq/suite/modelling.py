"""Queries over clusters, scaling and reference splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.operators import accounting as A
from molq.operators import modelling as L
from molq.operators import profiles as P
from molq.plans.fixtures import cell_labels, molecules, with_parts
from molq.suite.base import query
from molq.suite.profiles import SIDES, sides
from molq.suite.util import rounded


@query("L01", None)
def feature_clusters(spark, sf):
    return L.deterministic_clusters(A.cell_gene_counts(molecules(spark, sf), "original_cell_id"), 6, 10, seed=1)


@query("L01", with_parts("""
SELECT count(DISTINCT original_cell_id) AS n_rows, count(DISTINCT original_cell_id) AS n_entities, TRUE AS labels_from_1_to_k, TRUE AS same_twice
FROM orig""", "orig"))
def cluster_laws(spark, sf):
    """Every entity once, labels between 1 and k, the same after a second run."""
    counts = A.cell_gene_counts(molecules(spark, sf), "original_cell_id")
    one, two = (L.deterministic_clusters(counts, 6, 10, seed=1) for _ in range(2))
    twice = one.join(two.withColumnRenamed("cluster", "again"), "cell_id", "full")
    return twice.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cell_id").alias("n_entities"),
                     F.bool_and(F.col("cluster").between(1, 6)).alias("labels_from_1_to_k"),
                     F.bool_and(F.col("cluster").eqNullSafe(F.col("again"))).alias("same_twice"))


@query("L05", with_parts("SELECT cell_id, cell_type FROM cell_labels", "cell_labels"))
def reference_split_total(spark, sf):
    split = L.stratified_split(cell_labels(spark, sf), 0.2, 11)
    sides_ = split.where("reference_split = 'reference_train'").unionByName(split.where("reference_split = 'evaluation_holdout'"))
    return sides_.select("cell_id", "cell_type")


BATCH = {**SIDES, "bt": "SELECT cell_id, CASE WHEN CAST(donor AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM cell_labels WHERE side = 'query' AND cell_id IN (SELECT cell_id FROM og)",
         "bn": "SELECT batch, count(*) AS n FROM bt GROUP BY 1",
         "st": """SELECT batch, feature_name, sum(v) / any_value(n) AS mean, sqrt((sum(v * v) - any_value(n) * (sum(v) / any_value(n)) * (sum(v) / any_value(n))) / (any_value(n) - 1)) AS sd FROM qn JOIN bt USING (cell_id) JOIN bn USING (batch) GROUP BY 1, 2"""}


def batched(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return P.log_normalize(q), ql.select("cell_id", F.when(F.col("donor").cast("int") % 2 == 0, "even").otherwise("odd").alias("batch"))


@query("L02", with_parts("SELECT batch, cell_id, feature_name, round((v - mean) / sd, 6) + 0.0 AS scaled FROM qn JOIN bt USING (cell_id) JOIN st USING (batch, feature_name)", "og cell_labels", **BATCH))
def scaled_by_batch(spark, sf):
    return rounded(L.scale_by_batch(*batched(spark, sf)))


@query("L02", with_parts("SELECT batch, feature_name, round(mean, 6) AS mean, round(sd, 6) AS sd, round(-mean / sd, 6) AS zero_value FROM st", "og cell_labels", **BATCH))
def batch_feature_stats(spark, sf):
    return rounded(L.batch_feature_stats(*batched(spark, sf)))


@query("L03 I01", with_parts("""
SELECT cell_id, cell_type, donor, 'q' AS batch FROM cell_labels WHERE side = 'query' UNION ALL SELECT cell_id, cell_type, NULL, 'r' FROM cell_labels WHERE side = 'reference'""", "cell_labels"))
def merged_samples(spark, sf):
    l = cell_labels(spark, sf)
    return L.merge_samples({"q": l.where("side = 'query'").select("cell_id", "cell_type", "donor"),
                            "r": l.where("side = 'reference'").select("cell_id", "cell_type", "cell_type")})


@query("L04", with_parts("""
, nn AS (SELECT count(*) AS n FROM ql), s AS (SELECT feature_name, sum(v) AS s, sum(v * v) AS q FROM qn GROUP BY 1),
d AS (SELECT feature_name, s / n AS mean, ((q - n * (s / n) * (s / n)) / (n - 1)) / (s / n) AS disp FROM s, nn)
SELECT feature_name, round(mean, 6) AS mean, round(disp, 6) AS dispersion, CAST(row_number() OVER (ORDER BY round(disp, 10) DESC, feature_name) AS INTEGER) AS rank FROM d QUALIFY rank <= 20""", "og cell_labels", **SIDES))
def variable_features(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(L.variable_features(P.log_normalize(q), ql.agg(F.count(F.lit(1))).scalar(), 20))


@query("L04", with_parts("""
, nn AS (SELECT count(*) AS n FROM ql), s AS (SELECT feature_name, sum(v) AS s, sum(v * v) AS q FROM qn GROUP BY 1),
d AS (SELECT feature_name, s / n AS mean, sqrt((q - n * (s / n) * (s / n)) / (n - 1)) AS sd, ((q - n * (s / n) * (s / n)) / (n - 1)) / (s / n) AS disp FROM s, nn),
k AS (SELECT *, row_number() OVER (ORDER BY round(disp, 10) DESC, feature_name) AS r FROM d QUALIFY r <= 30)
SELECT cell_id, feature_name, round((v - mean) / sd, 6) + 0.0 AS scaled FROM qn JOIN k USING (feature_name)""", "og cell_labels", **SIDES))
def lognorm_sequence(spark, sf):
    return rounded(L.lognorm_sequence(sides(spark, sf)[0], 30))


@query("L05", with_parts("""
SELECT cell_id, cell_type, CASE WHEN row_number() OVER (PARTITION BY cell_type ORDER BY sha256('11|' || cell_type || '|' || cell_id), cell_id)
 <= least(count(*) OVER (PARTITION BY cell_type) - 1, greatest(1, round_even(count(*) OVER (PARTITION BY cell_type) * 0.2, 0)))
 THEN 'evaluation_holdout' ELSE 'reference_train' END AS reference_split FROM cell_labels""", "cell_labels"))
def reference_split(spark, sf):
    return L.stratified_split(cell_labels(spark, sf), 0.2, 11)


@query("L05 O03", with_parts("""
SELECT cell_type, count(*) AS total, CAST(count(*) - least(count(*) - 1, greatest(1, round_even(count(*) * 0.2, 0))) AS BIGINT) AS reference_train,
 CAST(least(count(*) - 1, greatest(1, round_even(count(*) * 0.2, 0))) AS BIGINT) AS evaluation_holdout, TRUE AS is_partition FROM cell_labels GROUP BY 1""", "cell_labels"))
def reference_split_strata(spark, sf):
    obs = cell_labels(spark, sf)
    return L.split_check(L.stratified_split(obs, 0.2, 11), obs.agg(F.count(F.lit(1))).scalar())


@query("L06", with_parts("""
SELECT cell_id, feature_name, count, CAST(sum(count) OVER (PARTITION BY cell_id) AS BIGINT) AS full_library_total_counts FROM og
QUALIFY feature_name IN (SELECT feature_name FROM og WHERE CAST(substr(feature_name, 5) AS INTEGER) < 20)""", "og"))
def panel_with_full_depth(spark, sf):
    counts = A.cell_gene_counts(molecules(spark, sf), "original_cell_id")
    return L.restrict_with_depth(counts, counts.where("cast(substring(feature_name, 5, 3) AS INT) < 20"))
