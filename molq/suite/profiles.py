"""Queries over profiles, markers, mixtures and label transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.functions.ordering import top_k_per_group
from molq.operators import accounting as A
from molq.operators import markers as M
from molq.operators import mixture as X
from molq.operators import profiles as P
from molq.operators import transfer as T
from molq.plans.fixtures import cell_labels, mixture_weights, molecules, table, with_parts
from molq.session import cut_lineage, stored_table
from molq.suite.accounting import PURIFIED, count_pair
from molq.suite.base import query
from molq.suite.util import rounded

BASE = "og cell_labels"
SIDES = {
    "ql": "SELECT cell_id, cell_type FROM cell_labels WHERE side = 'query' AND cell_id IN (SELECT cell_id FROM og)",
    "rl": "SELECT cell_id, cell_type FROM cell_labels WHERE side = 'reference' AND cell_id IN (SELECT cell_id FROM og)",
    "qcnt": "SELECT og.* FROM og SEMI JOIN ql USING (cell_id)",
    "rcnt": "SELECT og.* FROM og SEMI JOIN rl USING (cell_id)",
    "qn": "SELECT *, ln(1 + count / sum(count) OVER (PARTITION BY cell_id) * 1e4) AS v FROM qcnt",
    "rn": "SELECT *, ln(1 + count / sum(count) OVER (PARTITION BY cell_id) * 1e4) AS v FROM rcnt",
    "qsz": "SELECT cell_type, count(*) AS n FROM ql GROUP BY 1",
    "rsz": "SELECT cell_type, count(*) AS n FROM rl GROUP BY 1",
}
PROFILE = {
    **SIDES,
    "qb": "SELECT cell_type, feature_name AS g, sum(v) / any_value(n) AS v FROM qn JOIN ql USING (cell_id) JOIN qsz USING (cell_type) GROUP BY 1, 2",
    "rb": "SELECT cell_type, feature_name AS g, sum(v) / any_value(n) AS v FROM rn JOIN rl USING (cell_id) JOIN rsz USING (cell_type) GROUP BY 1, 2",
}
LOGMEAN = {
    **SIDES,
    "qb": """SELECT cell_type, feature_name AS g, ln(1 + sum(count / t * 1e4) / any_value(n)) AS v FROM
      (SELECT *, sum(count) OVER (PARTITION BY cell_id) AS t FROM qcnt) JOIN ql USING (cell_id) JOIN qsz USING (cell_type) WHERE n >= 5 GROUP BY 1, 2""",
    "rb": """SELECT cell_type, feature_name AS g, ln(1 + sum(count / t * 1e4) / any_value(n)) AS v FROM
      (SELECT *, sum(count) OVER (PARTITION BY cell_id) AS t FROM rcnt) JOIN rl USING (cell_id) JOIN rsz USING (cell_type) WHERE n >= 5 GROUP BY 1, 2""",
}
DENSE = {
    "genes": "SELECT DISTINCT feature_name AS g FROM qcnt INTERSECT SELECT DISTINCT feature_name FROM rcnt",
    "dp": """SELECT t.cell_type, genes.g, coalesce(qb.v, 0) AS q, coalesce(rb.v, 0) AS r FROM (SELECT DISTINCT cell_type FROM qb INTERSECT SELECT cell_type FROM rb) t
      CROSS JOIN genes LEFT JOIN qb ON qb.cell_type = t.cell_type AND qb.g = genes.g LEFT JOIN rb ON rb.cell_type = t.cell_type AND rb.g = genes.g""",
}


def sides(spark, sf):
    """(query counts, query labels, reference counts, reference labels)."""
    counts = stored_table(A.cell_gene_counts(molecules(spark, sf), "original_cell_id"), "counts")
    ids = counts.select("cell_id").distinct()
    labels = stored_table(cell_labels(spark, sf).select("cell_id", "cell_type", "side", "donor").join(ids, "cell_id", "left_semi"), "labels")
    pick = lambda s: labels.where(F.col("side") == s)
    cut = lambda s: counts.join(pick(s), "cell_id", "left_semi")
    return cut("query"), pick("query"), cut("reference"), pick("reference")


@query("F01", with_parts("SELECT cell_id, feature_name, count, round(v, 6) AS value FROM qn", BASE, **SIDES))
def log_normalized(spark, sf):
    return rounded(P.log_normalize(sides(spark, sf)[0]))


@query("F02", with_parts("""
SELECT cell_id, feature_name, count, round(l1, 6) AS l1, round(l1 / sqrt(sum(l1 * l1) OVER (PARTITION BY cell_id)), 6) AS l2 FROM
 (SELECT *, count / sum(count) OVER (PARTITION BY cell_id) AS l1 FROM qcnt)""", BASE, **SIDES))
def row_norms(spark, sf):
    l1 = P.l1_normalize(sides(spark, sf)[0]).withColumnRenamed("value", "l1").withColumn("l2", F.col("l1"))
    return rounded(P.l2_normalize(l1, "l2"))


QC_SQL = """
, c1 AS (SELECT cell_id FROM og GROUP BY 1 HAVING sum(count) >= 30 AND count(*) >= 18),
a1 AS (SELECT * FROM og WHERE cell_id IN (SELECT cell_id FROM c1)), g1 AS (SELECT feature_name FROM a1 GROUP BY 1 HAVING count(*) >= 300),
g2 AS (SELECT feature_name FROM og GROUP BY 1 HAVING count(*) >= 300), a2 AS (SELECT * FROM og WHERE feature_name IN (SELECT feature_name FROM g2)),
c2 AS (SELECT cell_id FROM a2 GROUP BY 1 HAVING sum(count) >= 30 AND count(*) >= 18)
SELECT 'cells_first' AS filter_order, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells, count(DISTINCT feature_name) AS n_genes FROM a1 WHERE feature_name IN (SELECT feature_name FROM g1)
UNION ALL SELECT 'genes_first', count(*), count(DISTINCT cell_id), count(DISTINCT feature_name) FROM a2 WHERE cell_id IN (SELECT cell_id FROM c2)"""


@query("F03 S17", with_parts(QC_SQL, "og"))
def qc_filter_orders(spark, sf):
    counts = A.cell_gene_counts(molecules(spark, sf), "original_cell_id")
    one = lambda o: P.qc_filter(counts, 30, None, 18, None, 300, o).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cell_id").alias("n_cells"),
        F.countDistinct("feature_name").alias("n_genes")).withColumn("filter_order", F.lit(o))
    return one("cells_first").unionByName(one("genes_first"))


@query("F04 S05", with_parts("SELECT cell_type, g AS feature_name, round(v, 6) AS value, n AS n_cells FROM qb JOIN qsz USING (cell_type)", BASE, **PROFILE))
def pseudobulk_mean_log(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(P.pseudobulk_mean_log(q, ql))


@query("F05 S05", with_parts("SELECT cell_type, g AS feature_name, round(v, 6) AS value, n AS n_cells FROM qb JOIN qsz USING (cell_type)", BASE, **LOGMEAN))
def pseudobulk_log_mean(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(P.pseudobulk_log_mean(q, ql))


REFPROF = {**SIDES,
           "rp": """SELECT cell_type, feature_name AS g, m / sum(m) OVER (PARTITION BY cell_type) AS v FROM (SELECT cell_type, feature_name, sum(count) / any_value(n) AS m
             FROM rcnt JOIN rl USING (cell_id) JOIN rsz USING (cell_type) GROUP BY 1, 2)""",
           "rpd": """SELECT t.cell_type, u.g, coalesce(rp.v, 0) AS v FROM rsz t CROSS JOIN (SELECT DISTINCT feature_name AS g FROM rcnt) u
             LEFT JOIN rp ON rp.cell_type = t.cell_type AND rp.g = u.g""",
           "mk": """SELECT cell_type, g FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY ratio DESC, g) AS k FROM
             (SELECT *, round((v + 1e-9) / (avg(v) OVER (PARTITION BY g) + 1e-9), 10) AS ratio FROM rpd)) WHERE k <= 8"""}


@query("F06", with_parts("SELECT cell_type, g AS feature_name, round(v, 6) AS value, n AS n_cells FROM rp JOIN rsz USING (cell_type)", BASE, **REFPROF))
def reference_profiles(spark, sf):
    _, _, r, rl = sides(spark, sf)
    return rounded(P.reference_profiles(r, rl))


@query("F07 G10", with_parts("SELECT cell_type, g AS feature_name FROM mk", BASE, **REFPROF))
def top_markers_by_ratio(spark, sf):
    _, _, r, rl = sides(spark, sf)
    return P.top_by_ratio(P.reference_profiles(r, rl), r, 8).select("cell_type", "feature_name")


RANK_SQL = """
, big AS (SELECT * FROM rl WHERE cell_type IN (SELECT cell_type FROM rsz WHERE n >= 30)), nn AS (SELECT count(*) AS n FROM big),
u AS (SELECT DISTINCT feature_name AS g FROM rn JOIN big USING (cell_id) WHERE v > 0),
dense AS (SELECT big.cell_id, big.cell_type, u.g, coalesce(rn.v, 0) AS v FROM big CROSS JOIN u LEFT JOIN rn ON rn.cell_id = big.cell_id AND rn.feature_name = u.g),
rk AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM dense),
tie AS (SELECT g, 1 - sum(power(c, 3) - c) / (power(any_value(n), 3) - any_value(n)) AS corr FROM (SELECT g, v, count(*) AS c FROM dense GROUP BY 1, 2), nn GROUP BY 1),
s AS (SELECT cell_type, g, sum(r) AS rs, count(*) AS nt, sum(v) AS sv FROM rk GROUP BY 1, 2), al AS (SELECT g, sum(sv) AS sa FROM s GROUP BY 1),
z AS (SELECT cell_type, s.g, (rs - nt * (n + 1) / 2.0) / sqrt(nt * (n - nt) * (n + 1) / 12.0) AS z, corr, (sv / nt - (sa - sv) / (n - nt)) / ln(2) AS fc FROM s JOIN tie USING (g) JOIN al USING (g), nn)
SELECT cell_type, g AS feature_name, round(z, 6) + 0.0 AS z, round(z / sqrt(corr), 6) + 0.0 AS z_tie_corrected, round(fc, 6) + 0.0 AS log2fc FROM z"""


@query("F08", with_parts(RANK_SQL, BASE, **SIDES))
def ranked_genes(spark, sf):
    _, _, r, rl = sides(spark, sf)
    return rounded(M.rank_genes(r, rl, n_top=None).drop("rank"))


@query("F08 G10", with_parts(RANK_SQL[:RANK_SQL.index("SELECT cell_type, g AS feature_name")] + """
SELECT cell_type, g AS feature_name, round(z, 6) + 0.0 AS z, round(z / sqrt(corr), 6) + 0.0 AS z_tie_corrected, round(fc, 6) + 0.0 AS log2fc,
 CAST(row_number() OVER (PARTITION BY cell_type ORDER BY round(z / sqrt(corr), 9) DESC, g) AS INTEGER) AS rank FROM z QUALIFY rank <= 10""", BASE, **SIDES))
def top_ranked_genes(spark, sf):
    _, _, r, rl = sides(spark, sf)
    return rounded(M.rank_genes(r, rl, n_top=10, tie_correct=True))


@query("F23 C06", with_parts("""
SELECT cell_type, count(*) AS n_genes_used, round(corr(q, r), 6) AS pearson_r, any_value(qsz.n) AS n_spatial_cells, any_value(rsz.n) AS n_reference_cells
FROM dp JOIN qsz USING (cell_type) JOIN rsz USING (cell_type) GROUP BY 1""", BASE, **PROFILE, **DENSE))
def reference_consistency(spark, sf):
    return rounded(P.reference_consistency(*sides(spark, sf)))


TAU = """tau AS (SELECT a.cell_type, sum(sign(a.q - b.q) * sign(a.r - b.r)) / sqrt(CAST(count(*) FILTER (a.q <> b.q) AS DOUBLE) * count(*) FILTER (a.r <> b.r)) AS tau
 FROM dp a JOIN dp b ON a.cell_type = b.cell_type AND a.g < b.g GROUP BY 1)"""
SPEAR = """rho AS (SELECT cell_type, corr(rq, rr) AS rho FROM (SELECT cell_type, rank() OVER (PARTITION BY cell_type ORDER BY q) + (count(*) OVER (PARTITION BY cell_type, q) - 1) / 2.0 AS rq,
 rank() OVER (PARTITION BY cell_type ORDER BY r) + (count(*) OVER (PARTITION BY cell_type, r) - 1) / 2.0 AS rr FROM dp) GROUP BY 1)"""


@query("F24 F25", with_parts(", " + TAU + ", " + SPEAR + """
SELECT cell_type, round(tau, 6) AS kendall_tau, round(rho, 6) AS spearman_rho FROM tau JOIN rho USING (cell_type)""", BASE, **LOGMEAN, **DENSE))
def rank_correlations(spark, sf):
    q, ql, r, rl = sides(spark, sf)
    genes = cut_lineage(P.shared_genes(q, r))
    pairs = cut_lineage(P.profile_pairs(P.pseudobulk_log_mean(q, ql), P.pseudobulk_log_mean(r, rl), genes))
    return rounded(P.kendall_by_type(pairs).join(P.spearman_by_type(pairs), "cell_type"))


DIFF = """df AS (SELECT cell_type, g, q - (sum(q) OVER (PARTITION BY g) - q) / (count(*) OVER (PARTITION BY g) - 1) AS dq,
 r - (sum(r) OVER (PARTITION BY g) - r) / (count(*) OVER (PARTITION BY g) - 1) AS dr FROM dp),
tops AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY round(dr, 10) DESC, g) AS k FROM df)"""


@query("F09 F13", with_parts(", " + DIFF + """
SELECT cell_type, round(median(dq), 6) + 0.0 AS logfc FROM tops WHERE k <= 10 GROUP BY 1""", BASE, **LOGMEAN, **DENSE))
def marker_difference_by_type(spark, sf):
    q, ql, r, rl = sides(spark, sf)
    pairs = P.profile_pairs(P.pseudobulk_log_mean(q, ql), P.pseudobulk_log_mean(r, rl), P.shared_genes(q, r))
    return rounded(P.marker_specificity_per_type(pairs, 10))


@query("F26 F27 C13", with_parts(", " + TAU + ", " + SPEAR + ", " + DIFF + """,
pr AS (SELECT cell_type, corr(q, r) AS p FROM dp GROUP BY 1), lf AS (SELECT cell_type, median(dq) AS l FROM tops WHERE k <= 10 GROUP BY 1)
SELECT (SELECT count(*) FROM pr) AS n_celltypes_scored, (SELECT round(median(tau), 6) FROM tau) AS kendall_tau_median, (SELECT round(median(p), 6) FROM pr) AS pearson_r_median,
 (SELECT round(median(rho), 6) FROM rho) AS spearman_rho_median, (SELECT round(median(l), 6) + 0.0 FROM lf) AS marker_logfc_median, (SELECT count(*) FROM lf) AS n_marker_celltypes""",
                              BASE, **{**LOGMEAN, "rl": SIDES["rl"] + " AND CAST(donor AS INTEGER) < 12",
                                       "ql": SIDES["ql"] + " AND CAST(substr(cell_id, 2) AS INTEGER) % 3 > 0"}, **DENSE))
def audit_on_heldout_donors(spark, sf):
    q, ql, r, rl = sides(spark, sf)
    held = P.heldout_reference(rl.withColumn("split", F.when(F.col("donor").cast("int") < 12, "heldout").otherwise("train")), "split", "heldout")
    matched = ql.where("try_cast(substring(cell_id, 2, 12) AS INT) % 3 > 0")
    q = q.join(matched, "cell_id", "left_semi")
    return rounded(P.audit_pseudobulk(q, ql, r.join(held, "cell_id", "left_semi"), held, matched, 10))


MARKS = """marks AS (SELECT cell_type, g AS gene, CAST(row_number() OVER (PARTITION BY cell_type ORDER BY g) AS INTEGER) AS rank FROM rp QUALIFY rank <= 6)"""


def marks(spark, sf, n: int = 6, reference=None):
    """Markers by name order: a fixed choice that needs no scores. ``reference`` is the (counts, labels) at hand."""
    r, rl = reference or sides(spark, sf)[2:]
    rows = r.join(rl.select("cell_id", "cell_type"), "cell_id").select("cell_type", F.col("feature_name").alias("gene")).distinct()
    return top_k_per_group(rows, ["cell_type"], [F.asc("gene")], n)


SPEC_SQL = """
, tot AS (SELECT sum(n) AS n FROM qsz),
s AS (SELECT feature_name AS gene, cell_type AS label, sum(v) AS s FROM qn JOIN ql USING (cell_id) GROUP BY 1, 2)
SELECT m.cell_type, m.gene, m.rank, any_value(qsz.n) AS n_cells_in_celltype, CAST(any_value(tot.n - qsz.n) AS BIGINT) AS n_cells_other,
 round(coalesce(sum(CASE WHEN label = m.cell_type THEN s END), 0) / any_value(qsz.n), 6) AS spatial_mean_in,
 round(coalesce(sum(CASE WHEN label <> m.cell_type THEN s END), 0) / any_value(tot.n - qsz.n), 6) AS spatial_mean_out,
 round((coalesce(sum(CASE WHEN label = m.cell_type THEN s END), 0) / any_value(qsz.n) - coalesce(sum(CASE WHEN label <> m.cell_type THEN s END), 0) / any_value(tot.n - qsz.n)) / {div}, 6) + 0.0 AS spatial_log2fc
FROM marks m JOIN qsz USING (cell_type) LEFT JOIN s USING (gene), tot WHERE m.gene IN (SELECT feature_name FROM qcnt) GROUP BY 1, 2, 3"""


@query("F12 F10 S04", with_parts(", " + MARKS + SPEC_SQL.format(div="ln(2)"), BASE, **REFPROF))
def marker_specificity_log2(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(M.marker_specificity(q, ql, marks(spark, sf)))


@query("F12 S04", with_parts(", " + MARKS + SPEC_SQL.format(div="1"), BASE, **REFPROF))
def marker_specificity_natural(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(M.marker_specificity(q, ql, marks(spark, sf), log_base=None, min_cells=3))


@query("F14", with_parts("""
, t AS (SELECT cell_id, lower(cell_type) LIKE '%auto%' OR lower(cell_type) LIKE '%mach%' AS hit FROM ql),
nn AS (SELECT count(*) FILTER (hit) AS a, count(*) FILTER (NOT hit) AS b FROM t), g AS (SELECT unnest(['GENE005', 'GENE010', 'GENE015', 'NOPE']) AS gene)
SELECT gene, a AS n_cells_in_celltype, b AS n_cells_other, round(sum(CASE WHEN hit THEN v ELSE 0 END) / a, 6) AS spatial_mean_in, round(sum(CASE WHEN NOT hit THEN v ELSE 0 END) / b, 6) AS spatial_mean_out,
 round((sum(CASE WHEN hit THEN v ELSE 0 END) / a - sum(CASE WHEN NOT hit THEN v ELSE 0 END) / b) / ln(2), 6) + 0.0 AS spatial_log2fc
FROM g JOIN qn ON feature_name = gene JOIN t USING (cell_id), nn GROUP BY 1, 2, 3""", BASE, **SIDES))
def lineage_marker_specificity(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(M.lineage_markers(q, ql, ["GENE005", "GENE010", "GENE015", "NOPE"], ["auto", "mach"]))


@query("F15", with_parts(", " + MARKS + """
SELECT m.cell_type, gene, rank, round(coalesce(sum(CASE WHEN label = m.cell_type THEN d END), 0) / any_value(rsz.n), 6) AS frac_expr_in_type,
 round(coalesce(sum(CASE WHEN label <> m.cell_type THEN d END), 0) / ((SELECT sum(n) FROM rsz) - any_value(rsz.n)), 6) AS frac_expr_other
FROM marks m JOIN rsz USING (cell_type) LEFT JOIN (SELECT feature_name AS gene, cell_type AS label, count(*) AS d FROM rcnt JOIN rl USING (cell_id) GROUP BY 1, 2) USING (gene) GROUP BY 1, 2, 3""",
                      BASE, **REFPROF))
def marker_expression_frequency(spark, sf):
    _, _, r, rl = sides(spark, sf)
    return rounded(M.expression_frequency(r, rl, marks(spark, sf)))


COVER = """SELECT m.cell_type, m.gene, coalesce(sum(d), 0) AS nd, coalesce(sum(CASE WHEN label = m.cell_type THEN d END), 0) AS ndt, (SELECT count(*) FROM {l}) AS n, coalesce(any_value(z.n), 0) AS nt, any_value(m.rank) AS rank
 FROM marks m LEFT JOIN {z} z ON z.cell_type = m.cell_type LEFT JOIN (SELECT feature_name AS gene, cell_type AS label, count(*) AS d FROM {c} JOIN {l} USING (cell_id) GROUP BY 1, 2) x ON x.gene = m.gene GROUP BY 1, 2"""
COVERS = {"cq": COVER.format(l="ql", z="qsz", c="qcnt"), "cr": COVER.format(l="rl", z="rsz", c="rcnt")}


@query("D31", with_parts(", " + MARKS + ", cq AS (" + COVERS["cq"] + """)
SELECT cell_type, gene, rank, 'refined' AS component, n AS n_entities, CAST(nd AS BIGINT) AS n_detected_entities, CAST(ndt AS BIGINT) AS n_detected_target_entities, CAST(nt AS BIGINT) AS n_target_entities,
 round(nd / n, 6) AS fraction_detected_entities, round(ndt / greatest(nt, 1), 6) AS fraction_detected_target_entities FROM cq""", BASE, **REFPROF))
def marker_coverage(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(M.marker_coverage(q, ql, marks(spark, sf), "refined"))


RETAIN_SQL = ", " + MARKS + ", cq AS (" + COVERS["cq"] + "), cr AS (" + COVERS["cr"] + """),
rt AS (SELECT a.cell_type, a.gene, a.nt AS qa, a.ndt AS qb, a.ndt / greatest(a.nt, 1) AS qc, b.nt AS ra, b.ndt AS rb, b.ndt / greatest(b.nt, 1) AS rc,
 concat_ws('; ', CASE WHEN b.nt < 140 THEN 'reconstructed target lineage n<140' END, CASE WHEN a.nt < 140 THEN 'refined target lineage n<140' END,
  CASE WHEN b.ndt < 48 THEN 'reconstructed target detections <48' END, CASE WHEN b.ndt / greatest(b.nt, 1) < 0.34 THEN 'reconstructed target detection fraction <0.34' END,
  CASE WHEN a.ndt < 50 THEN 'refined target detections <50' END) AS why FROM cq a JOIN cr b ON a.cell_type = b.cell_type AND a.gene = b.gene)"""


@query("F16", with_parts(RETAIN_SQL + """
SELECT cell_type, gene, qa AS refined_n_target_entities, CAST(qb AS BIGINT) AS refined_n_detected_target_entities, round(qc, 6) AS refined_fraction_detected_target_entities,
 ra AS rebuilt_n_target_entities, CAST(rb AS BIGINT) AS rebuilt_n_detected_target_entities, round(rc, 6) AS rebuilt_fraction_detected_target_entities, why AS drop_reason, why = '' AS retained FROM rt""",
                      BASE, **REFPROF))
def marker_retention(spark, sf):
    return rounded(retention(spark, sf))


def retention(spark, sf):
    q, ql, r, rl = sides(spark, sf)
    m = marks(spark, sf)
    return M.marker_retention(M.marker_coverage(q, ql, m, "refined"), M.marker_coverage(r, rl, m, "rebuilt"), 140, 48, 0.34, 50)


@query("F17 I01", with_parts(RETAIN_SQL + """
SELECT 'kept' AS method, cell_type, gene, CAST(rank AS DOUBLE) AS value FROM marks WHERE (cell_type, gene) IN (SELECT (cell_type, gene) FROM rt WHERE why = '')
UNION ALL SELECT 'new', cell_type, gene, rank + 0.5 FROM marks WHERE (cell_type, gene) IN (SELECT (cell_type, gene) FROM rt WHERE why = '')""", BASE, **REFPROF))
def combined_specificity(spark, sf):
    m = marks(spark, sf).withColumn("value", F.col("rank").cast("double")).drop("rank")
    both = m.withColumn("method", F.lit("kept")).unionByName(m.withColumn("method", F.lit("old")))
    new = m.withColumns({"method": F.lit("new"), "value": F.col("value") + 0.5})
    return M.combine_specificity(both, new, ["old"], retention(spark, sf))


GROUPS = {"beta": ["GENE010", "GENE011", "GENE012", "GENE020"], "alpha": ["GENE005", "GENE015", "GENE030"], "gamma": ["GENE001", "GENE002", "GENE003"]}
GROUP_SQL = """
, gr AS (SELECT * FROM (VALUES ('beta', 0, ['GENE010','GENE011','GENE012','GENE020']), ('alpha', 1, ['GENE005','GENE015','GENE030']), ('gamma', 2, ['GENE001','GENE002','GENE003'])) v(grp, o, gs)),
e AS (SELECT cell_id, grp, o, sum(count) AS c FROM cg JOIN (SELECT grp, o, unnest(gs) AS feature_name FROM gr) USING (feature_name) GROUP BY 1, 2, 3),
d AS (SELECT cell_id, arg_min(grp, (-c, o)) AS dominant_group, max(c) AS dc, sum(c) AS tc FROM e GROUP BY 1)"""


@query("F18 S13", with_parts(GROUP_SQL + """
SELECT cell_id, dominant_group, CAST(dc AS BIGINT) AS dominant_count, CAST(tc AS BIGINT) AS total_marker_count, round(dc / tc, 6) AS specificity, round(1 - dc / tc, 6) AS leakage FROM d""", "cg"))
def dominant_marker_group(spark, sf):
    from molq.sources.tables import marker_groups
    return rounded(M.dominant_group(A.cell_gene_counts(molecules(spark, sf)), marker_groups(spark, GROUPS)))


@query("F19", with_parts(GROUP_SQL + """
SELECT count(*) AS n_cells, round(avg(dc / tc), 6) AS mean_specificity, round(avg(1 - dc / tc), 6) AS mean_leakage, round(median(dc / tc), 6) AS median_specificity, round(median(1 - dc / tc), 6) AS median_leakage FROM d""", "cg"))
def marker_group_summary(spark, sf):
    from molq.sources.tables import marker_groups
    return rounded(M.dominant_group_summary(M.dominant_group(A.cell_gene_counts(molecules(spark, sf)), marker_groups(spark, GROUPS))))


CELLPROF = """
, u AS (SELECT DISTINCT feature_name AS g FROM qcnt), c AS (SELECT cell_id, feature_name AS g, count / sum(count) OVER (PARTITION BY cell_id) AS c FROM qcnt),
dn AS (SELECT ql.cell_id, ql.cell_type, u.g, coalesce(c.c, 0) AS c, coalesce(rp.v, 0) AS r, mk.g IS NOT NULL AS own, u.g IN (SELECT g FROM mk) AS anym
 FROM ql CROSS JOIN u LEFT JOIN c ON c.cell_id = ql.cell_id AND c.g = u.g LEFT JOIN rp ON rp.cell_type = ql.cell_type AND rp.g = u.g LEFT JOIN mk ON mk.cell_type = ql.cell_type AND mk.g = u.g),
sc AS (SELECT cell_id, cell_type, corr(c, r) AS k, sum(CASE WHEN own THEN c ELSE 0 END) AS om, sum(CASE WHEN anym THEN c ELSE 0 END) AS am, sum(c) AS t FROM dn GROUP BY 1, 2),
f AS (SELECT cell_id, cell_type, k, CASE WHEN am > 0 THEN om / am END AS sp, CASE WHEN am > 0 THEN (am - om) / t END AS le FROM sc)"""


def per_cell(spark, sf):
    q, ql, r, rl = sides(spark, sf)
    prof = cut_lineage(P.reference_profiles(r, rl))
    return P.per_cell_profile(q, ql, prof, P.top_by_ratio(prof, r, 8))


@query("F20", with_parts(CELLPROF + """
SELECT cell_id, cell_type, round(k, 6) AS ref_corr, round(sp, 6) AS marker_specificity, round(le, 6) AS marker_leakage FROM f""", BASE, **REFPROF))
def per_cell_agreement(spark, sf):
    return rounded(per_cell(spark, sf))


@query("F21", with_parts(CELLPROF + """
SELECT cell_type, round(avg(k), 6) AS reference_correlation_mean, round(avg(sp), 6) AS marker_specificity_mean, round(avg(le), 6) AS marker_leakage_mean, count(k) AS n_cells_scored,
 round(median(k), 6) AS reference_correlation_median FROM f GROUP BY 1""", BASE, **REFPROF))
def per_cell_agreement_summary(spark, sf):
    return rounded(P.per_cell_summary(per_cell(spark, sf), ["cell_type"]))


@query("F22", with_parts(CELLPROF + """
, b AS (SELECT cell_type, avg(k) AS c, avg(sp) AS s, avg(le) AS l FROM f WHERE CAST(substr(cell_id, 2) AS INTEGER) % 3 = 0 GROUP BY 1),
a AS (SELECT cell_type, avg(k) AS c, avg(sp) AS s, avg(le) AS l FROM f WHERE CAST(substr(cell_id, 2) AS INTEGER) % 3 > 0 GROUP BY 1)
SELECT cell_type, round(b.c, 6) AS corr_before, round(b.s, 6) AS spec_before, round(b.l, 6) AS leak_before, round(a.c, 6) AS corr_after, round(a.s, 6) AS spec_after, round(a.l, 6) AS leak_after,
 round(a.c - b.c, 6) + 0.0 AS corr_delta, round(a.s - b.s, 6) + 0.0 AS spec_delta, round(a.l - b.l, 6) + 0.0 AS leak_delta, round(log2(a.s / b.s), 6) + 0.0 AS spec_log2_ratio FROM b FULL JOIN a USING (cell_type)""", BASE, **REFPROF))
def agreement_before_after(spark, sf):
    scores = per_cell(spark, sf)
    n = F.substring("cell_id", 2, 12).try_cast("int") % 3
    return rounded(P.before_after_by_type(scores.where(n == 0), scores.where(n > 0)))


def top_ranked_sql(n: int) -> str:
    """The n first features of each type by plain z, as a select of its own."""
    head = RANK_SQL[:RANK_SQL.index("SELECT cell_type, g AS feature_name")].strip()
    return "WITH " + head[1:].strip() + f"""
SELECT cell_type, g AS gene, CAST(row_number() OVER (PARTITION BY cell_type ORDER BY round(z, 9) DESC, g) AS INTEGER) AS rank FROM z QUALIFY rank <= {n}"""


PANEL_SQL = ", " + MARKS.replace("rank <= 6", "rank <= 4") + ", fb AS (" + top_ranked_sql(20) + """),
ca AS (SELECT *, 'canonical' AS source, 0 AS o FROM marks UNION ALL SELECT *, 'scrna_fallback', 1 FROM fb WHERE cell_type IN (SELECT cell_type FROM marks)),
cd AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY cell_type, gene ORDER BY o, rank) = 1),
cp AS (SELECT *, CAST(row_number() OVER (PARTITION BY cell_type ORDER BY o, rank, gene) AS INTEGER) AS priority FROM cd),
tt AS (SELECT sum(n) AS n FROM rsz), ss AS (SELECT feature_name AS gene, cell_type AS label, sum(v) AS s FROM rn JOIN rl USING (cell_id) GROUP BY 1, 2),
sp AS (SELECT cp.cell_type, cp.gene, (coalesce(sum(s) FILTER (label = cp.cell_type), 0) / any_value(rsz.n) - coalesce(sum(s) FILTER (label <> cp.cell_type), 0) / any_value(tt.n - rsz.n)) / ln(2) AS specificity
 FROM cp JOIN rsz USING (cell_type) JOIN ss USING (gene), tt GROUP BY 1, 2),
el AS (SELECT cp.*, specificity, upper(gene) = 'GENE003' AS broad, gene IN (SELECT feature_name FROM qcnt) AS here, gene IN (SELECT feature_name FROM rcnt) AS known
 FROM cp LEFT JOIN sp USING (cell_type, gene)),
c0 AS (SELECT *, here AND known AND NOT broad AND coalesce(specificity >= 0, FALSE) AS eligible FROM el),
c1 AS (SELECT *, count(*) FILTER (o = 0 AND eligible) OVER (PARTITION BY cell_type) AS n_canon,
 CASE WHEN o = 0 AND eligible THEN count(*) FILTER (o = 0 AND eligible) OVER (PARTITION BY cell_type ORDER BY priority) END AS cr FROM c0),
c2 AS (SELECT *, coalesce(cr <= 3, FALSE) AS base FROM c1),
c3 AS (SELECT *, count(*) FILTER (base) OVER (PARTITION BY cell_type) AS nb,
 CASE WHEN eligible AND NOT base THEN count(*) FILTER (eligible AND NOT base) OVER (PARTITION BY cell_type ORDER BY priority) END AS fr FROM c2),
c4 AS (SELECT *, CASE WHEN base THEN cr WHEN nb < 2 AND fr <= greatest(3 - nb, 1) THEN nb + fr END AS pos FROM c3)
SELECT cell_type, gene, source, priority, round(specificity, 6) + 0.0 AS specificity, broad, eligible, coalesce(pos <= 5, FALSE) AS selected, CASE WHEN pos <= 5 THEN pos END AS panel_rank,
 CASE WHEN coalesce(pos <= 5, FALSE) THEN '' WHEN NOT here THEN 'absent from platform panel' WHEN specificity IS NULL THEN 'not detected in scRNA reference'
  WHEN broad THEN 'broad/stress/interferon marker avoided' WHEN specificity < 0 THEN 'low scRNA specificity (<0 log2FC)'
  WHEN o = 1 AND n_canon >= 3 THEN 'canonical platform-present alternatives selected' ELSE 'not in top selected markers for lineage' END AS reason FROM c4"""


@query("F11", with_parts(PANEL_SQL, BASE, **REFPROF))
def marker_panel_audit(spark, sf):
    q, ql, r, rl = sides(spark, sf)
    canonical = marks(spark, sf, 4, (r, rl))
    fallback = cut_lineage(M.rank_genes(r, rl, n_top=20).select(
        "cell_type", F.col("feature_name").alias("gene"), "rank"))
    return rounded(M.marker_panel(canonical, fallback, q, r, rl, min_specificity=0.0, broad=("GENE003",)))


@query("F40", with_parts(", " + MARKS + SPEC_SQL.format(div="ln(2)").replace("\nSELECT m.cell_type", ", sp AS (SELECT m.cell_type", 1) + """)
SELECT cell_type, round(median(spatial_log2fc), 6) + 0.0 AS median_spatial_log2fc, count(*) AS n_markers FROM sp GROUP BY 1""", BASE, **REFPROF))
def type_median_specificity(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    spec = M.marker_specificity(q, ql, marks(spark, sf)).withColumn("spatial_log2fc", F.round("spatial_log2fc", 6))
    return rounded(P.type_medians(spec))


@query("F39 I02", with_parts("""
SELECT feature_name FROM assigned WHERE method <> 'method_c' OR CAST(substr(feature_name, 5) AS INTEGER) < 45 GROUP BY 1 HAVING count(DISTINCT method) = 3""", "assigned"))
def common_feature_panel(spark, sf):
    m = molecules(spark, sf).where("method <> 'method_c' OR cast(substring(feature_name, 5, 3) AS INT) < 45")
    return P.common_panel(A.cell_gene_counts(m, by=["method"]))


@query("F42", with_parts("""
, g AS (SELECT DISTINCT feature_name FROM molecules INTERSECT SELECT feature_name FROM og WHERE CAST(substr(feature_name, 5) AS INTEGER) < 30),
t AS (SELECT * FROM molecules WHERE feature_name IN (SELECT feature_name FROM g))
SELECT (SELECT count(*) FROM g) AS n_genes, (SELECT count(*) FROM (SELECT DISTINCT cell_id, feature_name FROM t WHERE cell_id <> 'UNASSIGNED')) AS n_counts,
 (SELECT count(DISTINCT cell_id) FROM t WHERE cell_id <> 'UNASSIGNED') AS n_cells, (SELECT count(*) FROM t JOIN cell_labels USING (cell_id)) AS n_molecules""", BASE + " molecules"))
def correction_inputs(spark, sf):
    m = molecules(spark, sf)
    ref = A.cell_gene_counts(m, "original_cell_id").where("cast(substring(feature_name, 5, 3) AS INT) < 30")
    parts = P.common_inputs(m, ref, cell_labels(spark, sf))
    n = lambda k: parts[k].agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(n("genes").alias("n_genes"), n("counts").alias("n_counts"), n("cells").alias("n_cells"), n("molecules").alias("n_molecules"))


@query("D32", with_parts(", " + MARKS + """
SELECT cell_id, cell_type, CAST(sum(count) AS BIGINT) AS n_transcripts, count(*) FILTER (feature_name IN (SELECT gene FROM marks)) AS n_markers_detected,
 round(count(*) FILTER (feature_name IN (SELECT gene FROM marks)) / (SELECT count(DISTINCT gene) FROM marks), 6) AS fraction_markers_detected FROM qcnt JOIN ql USING (cell_id) GROUP BY 1, 2""", BASE, **REFPROF))
def detection_per_cell(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(M.detection_per_cell(q, ql, marks(spark, sf)))


@query("D32", with_parts(", " + MARKS + """
SELECT m.cell_type, m.gene, m.rank, coalesce(d, 0) AS detected_cells, CAST(coalesce(t, 0) AS BIGINT) AS total_transcripts, d IS NOT NULL AS present_in_matrix,
 round(coalesce(d, 0) / (SELECT count(DISTINCT cell_id) FROM qcnt), 6) AS fraction_cells_detected FROM marks m LEFT JOIN (SELECT feature_name AS gene, count(*) AS d, sum(count) AS t FROM qcnt GROUP BY 1) USING (gene)""", BASE, **REFPROF))
def detection_per_gene(spark, sf):
    return rounded(M.detection_per_gene(sides(spark, sf)[0], marks(spark, sf)))


@query("D32", with_parts(", " + MARKS + """
, pc AS (SELECT cell_id, cell_type, sum(count) AS n, count(*) FILTER (feature_name IN (SELECT gene FROM marks)) AS k FROM qcnt JOIN ql USING (cell_id) GROUP BY 1, 2)
SELECT cell_type, count(*) AS n_cells, median(n) AS median_transcripts, round(avg(n), 6) AS mean_transcripts, median(k) AS median_markers_detected, round(avg(k), 6) AS mean_markers_detected,
 round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0 END), 6) AS fraction_with_any_marker FROM pc GROUP BY 1""", BASE, **REFPROF))
def detection_per_type(spark, sf):
    q, ql, _, _ = sides(spark, sf)
    return rounded(M.detection_per_type(M.detection_per_cell(q, ql, marks(spark, sf))))


# --- label transfer -----------------------------------------------------------

VOTE_SQL = """
, sim AS (SELECT {q} AS qi, {a} AS ai, {lab} AS label, round({dot}, 12) AS s FROM {src}),
top AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY s DESC, ai) AS r FROM sim QUALIFY r <= {k}),
v AS (SELECT qi, label, count(*) AS n FROM top GROUP BY 1, 2),
w AS (SELECT qi, label, n, row_number() OVER (PARTITION BY qi ORDER BY n DESC, label) AS r FROM v)
SELECT qi AS cell_id, label AS predicted_celltype, CAST(n AS INTEGER) AS n_neighbors_voting, round(n / {k}.0, 6) AS confidence FROM w WHERE r = 1"""


@query("F29 F28", with_parts(VOTE_SQL.format(
    q="q.cell_id", a="a.cell_id", lab="any_value(rl.cell_type)", k=15, dot="coalesce(sum(q.u * a.u), 0)",
    src="qu q JOIN au a ON q.g = a.g JOIN rl ON rl.cell_id = a.cell_id GROUP BY q.cell_id, a.cell_id"), BASE, **SIDES,
    qu="SELECT cell_id, feature_name AS g, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS u FROM qn",
    au="SELECT cell_id, feature_name AS g, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS u FROM rn"))
def label_transfer(spark, sf):
    q, _, r, rl = sides(spark, sf)
    return rounded(T.transfer_labels(q, r, rl, k=15, per_type=None))


@query("F28", with_parts("""
SELECT cell_type, least(count(*), 50) AS n_anchors, least(count(*), 50) AS n_distinct FROM rl GROUP BY 1""", BASE, **SIDES))
def anchors_per_type(spark, sf):
    picked = T.pick_anchors(sides(spark, sf)[3], per_type=50, seed=0)
    return picked.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_anchors"), F.countDistinct("cell_id").alias("n_distinct"))


PUR = "SELECT cell_id, feature_name, CAST(round_even(count, 0) AS DOUBLE) AS count FROM purified WHERE round_even(count, 0) <> 0"


@query("F30 B25", with_parts(VOTE_SQL.format(
    q="q.cell_id", a="a.cell_id", lab="any_value(rl.cell_type)", k=15, dot="coalesce(sum(q.u * a.u), 0)",
    src="qu q JOIN au a ON q.g = a.g JOIN rl ON rl.cell_id = a.cell_id GROUP BY q.cell_id, a.cell_id"), BASE, **SIDES, purified=PURIFIED, pur=PUR,
    pn="SELECT *, ln(1 + count / sum(count) OVER (PARTITION BY cell_id) * 1e4) AS v FROM pur WHERE feature_name IN (SELECT feature_name FROM rcnt)",
    rn2="SELECT *, ln(1 + count / sum(count) OVER (PARTITION BY cell_id) * 1e4) AS v FROM rcnt WHERE feature_name IN (SELECT feature_name FROM pur)",
    qu="SELECT cell_id, feature_name AS g, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS u FROM pn",
    au="SELECT cell_id, feature_name AS g, v / sqrt(sum(v * v) OVER (PARTITION BY cell_id)) AS u FROM rn2"))
def label_transfer_purified(spark, sf):
    from molq.operators.contract import normalize_counts_integer
    _, _, r, rl = sides(spark, sf)
    purified = normalize_counts_integer(count_pair(spark, sf)[1]).drop("was_fractional")
    return rounded(T.transfer_labels(purified, r, rl, k=15, per_type=None))


EMB = "SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


@query("F29", "WITH emb AS (" + EMB + ")" + VOTE_SQL.format(
    q="q.id", a="a.id", lab="a.label", k=5, dot="list_cosine_similarity(q.e, a.e)", src="emb q JOIN emb a ON q.vec_id % 2 = 1 AND a.vec_id % 2 = 0"))
def embedding_label_vote(spark, sf):
    v = table(spark, sf, "embeddings")
    anchors = cut_lineage(T.dense_vectors(v.where("vec_id % 2 = 0"), "vec_id", "embedding", "label"))
    queries = T.dense_vectors(v.where("vec_id % 2 = 1"), "vec_id", "embedding")
    return rounded(T.vote(T.cosine_top_k(queries, anchors, 5), 5))


@query("K13", "WITH emb AS (" + EMB + """), sim AS (SELECT q.id AS qi, a.id AS ai, round(list_cosine_similarity(q.e, a.e), 12) AS s FROM emb q JOIN emb a ON q.vec_id <> a.vec_id)
SELECT qi AS cell_id, ai AS anchor_id, CAST(row_number() OVER (PARTITION BY qi ORDER BY s DESC, ai) AS INTEGER) AS rank, round(s, 6) + 0.0 AS similarity FROM sim QUALIFY rank <= 10""")
def embedding_knn_graph(spark, sf):
    vectors = cut_lineage(T.dense_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding"))
    return rounded(T.knn_graph(vectors, 10).drop("label"))


# --- mixtures --------------------------------------------------------------------

NW = """nw AS (SELECT cell_id, cell_type, greatest(weight, 0) AS w, sum(greatest(weight, 0)) OVER (PARTITION BY cell_id) AS s FROM weights)"""


@query("F31 H05", with_parts(", " + NW + """
SELECT cell_id, CASE WHEN any_value(s) > 0 THEN round(-sum(CASE WHEN w > 0 THEN w / s * ln(w / s) ELSE 0 END), 6) + 0.0 END AS entropy,
 CASE WHEN any_value(s) > 0 THEN round(max(w) / any_value(s), 6) END AS max_weight FROM nw GROUP BY 1""", "weights"))
def mixture_entropy(spark, sf):
    return rounded(X.mixture_entropy(mixture_weights(spark, sf)))


TOP2 = NW + """, tt AS (SELECT cell_id, cell_type, w / s AS w, row_number() OVER (PARTITION BY cell_id ORDER BY w / s DESC, cell_type) AS k FROM nw WHERE s > 0),
t2 AS (SELECT a.cell_id, a.cell_type AS f, a.w AS w1, b.cell_type AS g, coalesce(b.w, 0) AS w2 FROM (SELECT * FROM tt WHERE k = 1) a LEFT JOIN (SELECT * FROM tt WHERE k = 2) b USING (cell_id))"""


@query("F33 F34", with_parts(", " + TOP2 + """
SELECT cell_id, f AS first_type, round(w1, 6) AS weight_first_type, g AS second_type, round(w2, 6) AS weight_second_type, f AS dominant_celltype FROM t2""", "weights"))
def mixture_first_second(spark, sf):
    w = cut_lineage(X.normalized_weights(mixture_weights(spark, sf)))
    return rounded(X.first_second(w).join(X.dominant_label(w), "cell_id"))


@query("F32 B20", with_parts(", " + TOP2 + """
, m AS (SELECT *, CASE WHEN f LIKE 'A%' THEN 'tumor' WHEN f LIKE 'N%' THEN 'immune' ELSE 'other' END AS c1, CASE WHEN g LIKE 'A%' THEN 'tumor' WHEN g LIKE 'N%' THEN 'immune' ELSE 'other' END AS c2 FROM t2)
SELECT cell_id, round(greatest(w1, w2), 6) AS max_weight, round(least(w1, w2), 6) AS minor_weight,
 round(-(CASE WHEN w1 > 0 THEN w1 / (w1 + w2) * ln(w1 / (w1 + w2)) ELSE 0 END + CASE WHEN w2 > 0 THEN w2 / (w1 + w2) * ln(w2 / (w1 + w2)) ELSE 0 END), 6) + 0.0 AS entropy,
 c1 AS compartment_first, c2 AS compartment_second, CASE WHEN (c1 = 'tumor' AND c2 = 'immune') OR (c1 = 'immune' AND c2 = 'tumor') THEN round(least(w1, w2), 6) ELSE 0 END AS tumor_immune_mixture_score FROM m""", "weights"))
def two_component_mixture(spark, sf):
    tidy = X.first_second(X.normalized_weights(mixture_weights(spark, sf)))
    out = X.two_component_metrics(tidy, (("tumor", ("ao", "af")), ("immune", ("no", "nf"))))
    return rounded(out.select("cell_id", "max_weight", "minor_weight", "entropy", "compartment_first", "compartment_second", "tumor_immune_mixture_score"))


@query("F35 B21", with_parts(", " + NW + """
SELECT cell_id, round(least(sum(CASE WHEN cell_type IN ('AF', 'AO') THEN w / s ELSE 0 END), sum(CASE WHEN cell_type LIKE 'N%' THEN w / s ELSE 0 END)), 6) AS mixture_tumor_immune FROM nw WHERE s > 0 GROUP BY 1""", "weights"))
def category_mixture_score(spark, sf):
    w = X.normalized_weights(mixture_weights(spark, sf))
    return rounded(X.category_mixture(w, {"tumor": ["af", "ao"], "immune": ["n"]}, "tumor", "immune"))


@query("F36", """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pre' ELSE 'post' END AS stage, count(*) AS n_cells, round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END), 6) AS fraction_doublet,
 round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS fraction_singlet FROM orders GROUP BY 1""")
def doublet_shares(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, "pre").otherwise("post").alias("stage"),
        F.when(F.col("o_orderstatus") == "P", "doublet_certain").when(F.col("o_orderstatus") == "F", "singlet").otherwise("reject").alias("spot_class"))
    return rounded(X.doublet_shares(o))


@query("F41", """
SELECT CAST(vec_id AS VARCHAR) AS cell_id, i - 1 AS "column", round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, range(1, 65) t(i)""")
def matrix_long_form(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(X.matrix_long(e, "cell_id", "v").withColumn("column", F.col("column").cast("long")))


@query("F41", """
SELECT doc_id, label, score FROM (SELECT doc_id, 'quality' AS label, CAST(quality AS DOUBLE) AS score FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels)""")
def score_lists_long(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.array(F.lit("quality"), F.lit("toxic")).alias("l"),
                                             F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("s"))
    return X.scores_long(rows, "doc_id", "l", "s")
