"""Queries over ranking, selection and rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.operators import ranking as R
from molq.operators import stattests as S
from molq.plans.fixtures import molecules, table, with_parts
from molq.suite.accounting import SCORED_SQL, scored_cells
from molq.suite.base import query
from molq.suite.util import rounded

# One "run" per order, grouped into data sets by priority; every metric from key arithmetic.
RUNS_SQL = """SELECT o_orderkey AS run_id, o_orderpriority AS dataset, (o_custkey % 64) / 16.0 AS marker_log2fc, (o_orderkey % 128) / 128.0 AS kendall_tau,
 CAST(200 + (o_orderkey * 7) % 900 AS DOUBLE) AS n_cells, CAST(10 + o_custkey % 300 AS DOUBLE) AS runtime_seconds, CAST(1 + o_orderkey % 33 AS DOUBLE) AS peak_memory_gb,
 CAST(o_custkey % 60 AS DOUBLE) AS refined_median_tx, (o_orderkey % 11) / 32.0 AS unassigned_frac, CASE WHEN o_custkey % 5 = 0 THEN 1.0 ELSE 0.5 END AS relative_purity
FROM orders"""


def runs(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        o.alias("run_id"), F.col("o_orderpriority").alias("dataset"), ((c % 64) / 16.0).alias("marker_log2fc"),
        ((o % 128) / 128.0).alias("kendall_tau"), (200 + (o * 7) % 900).cast("double").alias("n_cells"),
        (10 + c % 300).cast("double").alias("runtime_seconds"), (1 + o % 33).cast("double").alias("peak_memory_gb"),
        (c % 60).cast("double").alias("refined_median_tx"), ((o % 11) / 32.0).alias("unassigned_frac"),
        F.when(c % 5 == 0, 1.0).otherwise(0.5).alias("relative_purity"))


RANKED = """
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY marker_log2fc DESC) AS rank_marker, rank() OVER (PARTITION BY dataset ORDER BY kendall_tau DESC) AS rank_kendall,
 n_cells / median(n_cells) OVER (PARTITION BY dataset) AS cr, runtime_seconds / median(runtime_seconds) OVER (PARTITION BY dataset) AS rr,
 peak_memory_gb / median(peak_memory_gb) OVER (PARTITION BY dataset) AS mr FROM runs),
p AS (SELECT *, (rank_marker + rank_kendall) / 2.0 AS mean_rank,
 (CASE WHEN cr < 0.4 OR cr > 2.5 THEN 2.0 WHEN cr < 0.6 OR cr > 1.7 THEN 1.0 ELSE 0 END) + (CASE WHEN refined_median_tx < 20 THEN 1.5 ELSE 0 END)
 + (CASE WHEN unassigned_frac > 0.25 THEN 1.5 WHEN unassigned_frac > 0.15 THEN 0.5 ELSE 0 END) + (CASE WHEN relative_purity > 0.999 AND refined_median_tx < 25 THEN 1.0 ELSE 0 END)
 + (CASE WHEN rr > 2 THEN 0.5 ELSE 0 END) + (CASE WHEN mr > 2 THEN 0.5 ELSE 0 END) AS penalty,
 concat_ws(';', CASE WHEN cr < 0.6 OR cr > 1.7 THEN 'cell_ratio' END, CASE WHEN refined_median_tx < 20 THEN 'refined_tx' END, CASE WHEN unassigned_frac > 0.15 THEN 'unassigned' END,
  CASE WHEN relative_purity > 0.999 AND refined_median_tx < 25 THEN 'suspicious_purity' END, CASE WHEN rr > 2 THEN 'slow' END, CASE WHEN mr > 2 THEN 'high_mem' END) AS flags FROM r),
f AS (SELECT *, mean_rank + penalty AS score, rank() OVER (PARTITION BY dataset ORDER BY mean_rank + penalty) AS final_rank FROM p)"""


def ranked(spark, sf):
    return R.rank_and_penalize(runs(spark, sf))


@query("G01", "WITH runs AS (" + RUNS_SQL + ")," + RANKED + """
SELECT run_id, dataset, CAST(rank_marker AS INTEGER) AS rank_marker, CAST(rank_kendall AS INTEGER) AS rank_kendall, CAST(mean_rank AS DOUBLE) AS mean_rank, CAST(penalty AS DOUBLE) AS penalty,
 flags AS penalty_flags, CAST(score AS DOUBLE) AS penalized_score, CAST(final_rank AS INTEGER) AS final_rank FROM f""")
def penalized_ranking(spark, sf):
    out = ranked(spark, sf)
    # The flag's number is presentation; the check compares the flag names.
    return rounded(out.withColumn("penalty_flags", F.regexp_replace("penalty_flags", "=[-0-9.]+", "")).select(
        "run_id", "dataset", "rank_marker", "rank_kendall", "mean_rank", "penalty", "penalty_flags", "penalized_score", "final_rank"))


@query("G02", "WITH runs AS (" + RUNS_SQL + ")," + RANKED + """
SELECT dataset, run_id, CAST(final_rank AS INTEGER) AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY final_rank, run_id) AS k FROM f) WHERE k = 1""")
def best_run_per_dataset(spark, sf):
    return R.best_per_group(ranked(spark, sf), ["dataset"], [F.asc("final_rank"), F.asc("run_id")]).select(
        "dataset", "run_id", "final_rank")


@query("G04", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 1 AS superseded FROM orders""")
def latest_launch(spark, sf):
    return R.latest_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("G05", with_parts("SELECT cell_id, min_by(etype, transcript_id) AS etype FROM molecules GROUP BY 1"))
def first_class_per_entity(spark, sf):
    return R.first_per_key(molecules(spark, sf), ["cell_id"], "etype", "transcript_id")


@query("G07 J01", with_parts("""
, c AS (SELECT median(x) AS mx, median(y) AS my FROM molecules)
SELECT transcript_id, x, y, (x - mx) * (x - mx) + (y - my) * (y - my) AS dist2 FROM molecules, c ORDER BY 4, 1 LIMIT 250"""))
def nearest_to_median_point(spark, sf):
    return R.nearest_to_median_point(molecules(spark, sf), 250).select("transcript_id", "x", "y", "dist2")


@query("G09", with_parts("""
SELECT method, count(*) AS n, CASE method WHEN 'method_c' THEN 1 WHEN 'method_a' THEN 2 ELSE 3 END AS display_rank FROM molecules GROUP BY 1"""))
def display_order(spark, sf):
    n = molecules(spark, sf).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return R.display_order(n, ["method_c", "method_a"]).withColumn("display_rank", F.col("display_rank").cast("int"))


MW_SQL = """
, b AS (SELECT o.m AS other, s.entropy AS v, s.method = 'method_a' AS ref FROM scored s JOIN (VALUES ('method_b'), ('method_c')) o(m) ON s.method IN (o.m, 'method_a')),
k AS (SELECT *, rank() OVER (PARTITION BY other ORDER BY v) + (count(*) OVER (PARTITION BY other, v) - 1) / 2.0 AS r FROM b),
t AS (SELECT other, sum(c * c * c - c) AS t FROM (SELECT other, v, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT other, sum(CASE WHEN ref THEN r ELSE 0 END) AS r1, CAST(count(*) FILTER (ref) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT ref) AS DOUBLE) AS n2 FROM k GROUP BY 1)
SELECT 'method_a' AS reference, other, 'greater' AS alternative, CAST(n1 AS BIGINT) AS n_ref, CAST(n2 AS BIGINT) AS n_other, CAST(r1 - n1 * (n1 + 1) / 2 AS DOUBLE) AS "U",
 round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM a JOIN t USING (other)"""


@query("H01", with_parts(MW_SQL, "assigned cell_labels", scored=SCORED_SQL))
def mann_whitney(spark, sf):
    return rounded(S.mann_whitney(scored_cells(spark, sf), "entropy", "method_a").drop("p_value", "p_label", "stars"))


WX_SQL = """
, pr AS (SELECT a.cell_type, a.entropy - b.entropy AS d FROM scored a JOIN scored b ON a.cell_id = b.cell_id AND a.method = 'method_a' AND b.method = 'method_b' WHERE a.cell_type IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY cell_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY cell_type, abs(d)) - 1) / 2.0 AS r FROM pr WHERE d <> 0),
t AS (SELECT cell_type, sum(c * c * c - c) AS t FROM (SELECT cell_type, abs(d) AS v, count(*) AS c FROM k GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT cell_type, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS rp, CAST(count(*) AS DOUBLE) AS m FROM k GROUP BY 1)
SELECT cell_type, (SELECT count(*) FROM pr WHERE pr.cell_type = a.cell_type) AS n_pairs, CAST(rp AS DOUBLE) AS statistic,
 round((rp - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - t / 2.0) / 24), 6) AS z, 'normal approximation' AS test_method FROM a JOIN t USING (cell_type)"""


def paired(spark, sf):
    c = scored_cells(spark, sf).where("cell_type IS NOT NULL")
    side = lambda m, n: c.where(F.col("method") == m).select("cell_id", "cell_type", F.col("entropy").alias(n))
    return side("method_a", "a").join(side("method_b", "b").drop("cell_type"), "cell_id")


@query("H02", with_parts(WX_SQL, "assigned cell_labels", scored=SCORED_SQL))
def wilcoxon_signed_rank(spark, sf):
    return rounded(S.wilcoxon_signed_rank(paired(spark, sf), "a", "b", ["cell_type"]).drop("p_value", "p_label", "stars"))


# The upper normal tail by the same published fit (fixed values, constant term first).
FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
LESS_SQL = MW_SQL.replace("'greater' AS alternative", "'less' AS alternative").replace(
    "round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5)", "((n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5)").replace(
    "(n1 + n2 - 1)))), 6) AS z", "(n1 + n2 - 1)))) AS z")
P_SQL = """, w AS (""" + LESS_SQL[LESS_SQL.index("SELECT 'method_a'"):] + """),
x AS (SELECT *, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t, abs(z) / sqrt(2) AS a FROM w),
u AS (SELECT *, 0.5 * t * exp(-a * a + (""" + " + t * (".join(map(str, FIT)) + ")" * len(FIT) + """) AS up FROM x),
p AS (SELECT *, CASE WHEN z >= 0 THEN up ELSE 1 - up END AS p_value FROM u)
SELECT reference, other, alternative, n_ref, n_other, "U", round(z, 6) AS z, round(p_value, 6) AS p_value,
 CASE WHEN p_value < 0.001 THEN 'p<0.001' ELSE printf('p=%.3f', round_even(p_value, 3)) END AS p_label,
 CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p"""


@query("H01 H02 B23", with_parts(LESS_SQL[:LESS_SQL.index("SELECT 'method_a'")] + P_SQL, "assigned cell_labels", scored=SCORED_SQL))
def rank_test_p_values(spark, sf):
    return rounded(S.mann_whitney(scored_cells(spark, sf), "entropy", "method_a", "less"))
