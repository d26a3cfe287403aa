"""Queries over co-occurrence, coherence and coexpression."""

from __future__ import annotations

from pyspark.sql import functions as F

from molq.functions.blocks import poisson_steps
from molq.operators import accounting as A
from molq.operators import coexpression as CX
from molq.operators import coherence as H
from molq.operators import cooccurrence as N
from molq.plans.fixtures import cell_labels, molecules, table, with_parts
from molq.suite.accounting import PURIFIED, count_pair
from molq.session import cut_lineage
from molq.suite.base import query
from molq.suite.util import rounded

NPMI_PARTS = {
    "pres": "SELECT original_cell_id AS c, feature_name AS g FROM orig GROUP BY 1, 2 HAVING count(*) >= 2",
    "tot": "SELECT count(DISTINCT c) AS n FROM pres",
    "marg": "SELECT g, count(*) AS k FROM pres GROUP BY 1",
    "kij": "SELECT a.g AS gi, b.g AS gj, count(*) AS k FROM pres a JOIN pres b ON a.c = b.c AND a.g < b.g GROUP BY 1, 2",
    "pairs": """SELECT gi, gj, kij.k / n AS pij, a.k / n AS pi, b.k / n AS pj, ln((kij.k / n) / ((a.k / n) * (b.k / n))) AS pmi,
      ln((kij.k / n) / ((a.k / n) * (b.k / n))) / -ln(kij.k / n) AS npmi, kij.k AS k, a.k AS ki, b.k AS kj, n
      FROM kij JOIN marg a ON gi = a.g JOIN marg b ON gj = b.g, tot""",
}


def presence(spark, sf):
    m = molecules(spark, sf).where("original_cell_id <> 'UNASSIGNED'")
    return N.presence(m, "original_cell_id", 2)


def panel(spark, sf):
    """The pair panel as a stored table, as the score functions would read it from a file."""
    return cut_lineage(N.compute_npmi(presence(spark, sf)).select(
        "gene_i", "gene_j", F.col("NPMI").alias("value")))


def counts(spark, sf):
    return A.cell_gene_counts(molecules(spark, sf))


@query("E01", with_parts("SELECT original_cell_id AS context, feature_name, count(*) AS n FROM orig GROUP BY 1, 2 HAVING count(*) >= 2", "orig"))
def presence_table(spark, sf):
    return N.require_rows(presence(spark, sf), "no features pass the minimum")


@query("E01", with_parts("""
SELECT original_cell_id AS context, feature_name, CAST(sum(qv) AS DOUBLE) AS n FROM orig GROUP BY 1, 2 HAVING sum(qv) >= 60""", "orig"))
def presence_weighted(spark, sf):
    m = molecules(spark, sf).where("original_cell_id <> 'UNASSIGNED'")
    return N.presence(m, "original_cell_id", 60, count_col="qv")


@query("E02 C21", with_parts("SELECT gi AS gene_i, gj AS gene_j, k AS k_ij FROM kij", "orig", **NPMI_PARTS))
def pair_cooccurrence(spark, sf):
    return N.pair_cooccurrence(presence(spark, sf))


@query("E03 S09", with_parts("""
SELECT gi AS gene_i, gj AS gene_j, round(pi, 6) AS P_i, round(pj, 6) AS P_j, round(pij, 6) AS P_ij, round(pij / pj, 6) AS P_i_given_j,
 round(pij / pi, 6) AS P_j_given_i, round(pmi, 6) + 0.0 AS PMI, round(npmi, 6) + 0.0 AS NPMI FROM pairs""", "orig", **NPMI_PARTS))
def npmi_panel(spark, sf):
    return rounded(N.compute_npmi(presence(spark, sf)))


@query("E03 S10", with_parts("""
, d AS (SELECT a.g AS gi, b.g AS gj, a.k AS ka, b.k AS kb, CASE WHEN a.g = b.g THEN a.k ELSE coalesce(kij.k, 0) END AS k, n
 FROM marg a JOIN marg b ON a.g <= b.g LEFT JOIN kij ON kij.gi = a.g AND kij.gj = b.g, tot)
SELECT gi AS gene_i, gj AS gene_j, round(ka / n, 6) AS P_i, round(kb / n, 6) AS P_j, round(k / n, 6) AS P_ij, round((k / n) / (kb / n), 6) AS P_i_given_j,
 round((k / n) / (ka / n), 6) AS P_j_given_i, CASE WHEN k > 0 THEN round(ln((k / n) / ((ka / n) * (kb / n))), 6) + 0.0 END AS PMI,
 CASE WHEN k > 0 THEN round(ln((k / n) / ((ka / n) * (kb / n))) / -ln(k / n), 6) + 0.0 WHEN ka / n > 0.02 AND kb / n > 0.02 THEN -1.0 END AS NPMI FROM d""",
                      "orig", **NPMI_PARTS))
def npmi_panel_dense(spark, sf):
    return rounded(N.compute_npmi(presence(spark, sf), dense=True, set_neg_one=True, thr=0.02))


# Documents as contexts, their words as features.
WORDS = r"SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents"
DOC_PRES = """SELECT doc_id AS c, w AS g FROM words WHERE w <> '' GROUP BY 1, 2 HAVING count(*) >= 3"""


@query("E01 E02 E03", "WITH words AS (" + WORDS + "), pres AS (" + DOC_PRES + """),
marg AS (SELECT g, count(*) AS k FROM pres GROUP BY 1), tot AS (SELECT count(DISTINCT c) AS n FROM pres),
kij AS (SELECT a.g AS gi, b.g AS gj, count(*) AS k FROM pres a JOIN pres b ON a.c = b.c AND a.g < b.g GROUP BY 1, 2)
SELECT gi AS gene_i, gj AS gene_j, round(ln((kij.k / n) / ((a.k / n) * (b.k / n))) / -ln(kij.k / n), 6) + 0.0 AS npmi
FROM kij JOIN marg a ON gi = a.g JOIN marg b ON gj = b.g, tot""")
def document_word_npmi(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).where(
        "w <> ''")
    pres = N.presence(words, "doc_id", 3, feature="w")
    return rounded(N.compute_npmi(pres).select("gene_i", "gene_j", F.col("NPMI").alias("npmi")))


@query("E04", with_parts("""
, nuc AS (SELECT * FROM molecules WHERE qv >= 20 AND cell_id <> 'UNASSIGNED' AND overlaps_nucleus = 1),
s AS (SELECT cell_id, count(*) AS n FROM nuc GROUP BY 1),
b AS (SELECT quantile_cont(n, 0.2) AS lo, quantile_cont(n, 0.8) AS hi FROM s)
SELECT transcript_id, cell_id FROM nuc WHERE cell_id IN (SELECT cell_id FROM s, b WHERE n BETWEEN lo AND hi)"""))
def confident_nuclei(spark, sf):
    return N.confident_nuclei(molecules(spark, sf), qv_min=20).select("transcript_id", "cell_id")


@query("E05", with_parts("""
, a AS (SELECT * FROM molecules WHERE original_cell_id <> 'UNASSIGNED'), nuc AS (SELECT * FROM a WHERE overlaps_nucleus = 1),
s AS (SELECT original_cell_id, count(*) AS n FROM nuc GROUP BY 1), b AS (SELECT quantile_cont(n, 0.1) AS lo, quantile_cont(n, 0.9) AS hi FROM s),
k AS (SELECT count(*) AS n FROM nuc WHERE original_cell_id IN (SELECT original_cell_id FROM s, b WHERE n BETWEEN lo AND hi))
SELECT (SELECT count(*) FROM molecules) AS n_input_rows, (SELECT count(*) FROM molecules) - (SELECT count(*) FROM a) AS n_dropped_excluded,
 (SELECT count(*) FROM a) - (SELECT count(*) FROM nuc) AS n_dropped_nuclear, (SELECT n FROM k) AS n_kept_rows, (SELECT count(*) FROM nuc) - (SELECT n FROM k) AS n_dropped_percentile"""))
def bootstrap_prefilter_counts(spark, sf):
    return N.prefilter_counts(molecules(spark, sf), "original_cell_id", True, percentile_band=(10, 90))


@query("E06", with_parts("""
, s AS (SELECT original_cell_id AS c, count(*) AS t FROM orig GROUP BY 1),
p AS (SELECT pres.c, g, t FROM pres JOIN s USING (c)), b AS (SELECT g, quantile_cont(t, 0.1) AS lo, quantile_cont(t, 0.9) AS hi FROM p GROUP BY 1)
SELECT p.g AS feature_name, round(min(lo), 6) AS n_min, round(min(hi), 6) AS n_max, count(*) FILTER (t BETWEEN lo AND hi) AS n_admitted FROM p JOIN b ON p.g = b.g GROUP BY 1""",
                      "orig", pres=NPMI_PARTS["pres"]))
def feature_size_bands(spark, sf):
    m = molecules(spark, sf).where("original_cell_id <> 'UNASSIGNED'")
    bands = N.feature_size_bands(m, "original_cell_id", 10, 90)
    admitted = N.admitted_presence(m, "original_cell_id", 10, 90).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n_admitted"))
    return rounded(bands.join(admitted, "feature_name", "left"))


TIERS_SQL = """
, d AS (SELECT a.g AS gi, b.g AS gj, a.k AS ka, b.k AS kb, kij.k AS k, CAST(n AS DOUBLE) AS n, (a.k / n) * (b.k / n) * n AS e, (a.k / n) * (b.k / n) * 400 AS es
 FROM marg a JOIN marg b ON a.g < b.g LEFT JOIN kij ON kij.gi = a.g AND kij.gj = b.g, tot)
SELECT gi AS gene_i, gj AS gene_j, CASE WHEN k IS NULL AND e >= 6 THEN 'neg_one' WHEN k IS NULL THEN 'indeterminate'
 WHEN greatest(k, e) < 6 THEN 'low_evidence' WHEN greatest(k * 400 / n, es) >= 4 THEN 'can_bootstrap' ELSE 'legacy_only' END AS kind,
 CASE WHEN k IS NULL THEN (CASE WHEN e >= 6 THEN -1.0 END) ELSE round(ln((k / n) / ((ka / n) * (kb / n))) / -ln(k / n), 6) + 0.0 END AS legacy_npmi,
 CASE WHEN k IS NULL THEN (CASE WHEN e >= 6 THEN round(-ln(e), 6) END) ELSE round(ln((k / n) / ((ka / n) * (kb / n))), 6) + 0.0 END AS legacy_pmi,
 coalesce(k, 0) AS k_ij, round(e, 6) AS expected_full, round(es, 6) AS expected_sub FROM d"""


@query("E07", with_parts(TIERS_SQL, "orig", **NPMI_PARTS))
def evidence_tiers(spark, sf):
    return rounded(N.evidence_tiers(presence(spark, sf), min_evidence=6, min_bootstrap=4, subsample=400))


def _interval_sql(name: str, replicates: int) -> str:
    """Intervals over the first replicates, from values per pair and replicate."""
    return f"""SELECT gi, gj, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, count(v) AS nb
  FROM vals WHERE r < {replicates} AND v IS NOT NULL GROUP BY 1, 2"""


# Weights from the md5 of seed, context and r // 4; a context counts as often as its number reaches a step.
BOOT_SQL = """
, d AS (SELECT a.g AS gi, b.g AS gj, a.k AS ka, b.k AS kb, kij.k AS k, CAST(n AS DOUBLE) AS n, (a.k / n) * (b.k / n) * n AS e
  FROM marg a JOIN marg b ON a.g < b.g LEFT JOIN kij ON kij.gi = a.g AND kij.gj = b.g, tot),
tiers AS (SELECT gi, gj, CASE WHEN k IS NULL AND e >= 5 THEN 'neg_one' WHEN k IS NULL THEN 'indeterminate' WHEN greatest(k, e) < 5 THEN 'low_evidence'
    WHEN greatest(k, e) >= {boot} THEN 'can_bootstrap' ELSE 'legacy_only' END AS kind,
  CASE WHEN k IS NULL THEN (CASE WHEN e >= 5 THEN -1.0 END) ELSE ln((k / n) / ((ka / n) * (kb / n))) / -ln(k / n) END AS legacy_npmi,
  CASE WHEN k IS NULL THEN (CASE WHEN e >= 5 THEN -ln(e) END) ELSE ln((k / n) / ((ka / n) * (kb / n))) END AS legacy_pmi, coalesce(k, 0) AS k_ij, e FROM d),
w AS (SELECT c, 4 * g + q AS r, len(list_filter({steps}, lambda t: CAST('0x' || substr(h, 1 + 8 * q, 8) AS BIGINT) >= t)) AS w
  FROM (SELECT c, g, md5('11-' || c || '-' || g) AS h FROM (SELECT DISTINCT c FROM pres), range(30) t(g)), range(4) u(q)),
wt AS (SELECT r, CAST(sum(w) AS DOUBLE) AS n FROM w GROUP BY 1),
wm AS (SELECT g, r, CAST(sum(w) AS DOUBLE) AS m FROM pres JOIN w USING (c) GROUP BY 1, 2),
held AS (SELECT a.c, a.g AS gi, b.g AS gj FROM pres a JOIN pres b ON a.c = b.c AND a.g < b.g JOIN tiers ON tiers.gi = a.g AND tiers.gj = b.g AND kind = 'can_bootstrap'),
wk AS (SELECT gi, gj, r, CAST(sum(w) AS DOUBLE) AS k FROM held JOIN w USING (c) GROUP BY 1, 2, 3),
p AS (SELECT gi, gj, r, (k + 0.1) / (n + 0.2) AS pk, (a.m + 0.1) / (n + 0.2) AS pa, (b.m + 0.1) / (n + 0.2) AS pb
  FROM wk JOIN wt USING (r) JOIN wm a ON a.g = gi AND a.r = wk.r JOIN wm b ON b.g = gj AND b.r = wk.r),
vals AS (SELECT gi, gj, r, CASE WHEN pk < 1 THEN ln(pk / (pa * pb)) / -ln(pk) END AS v FROM p),
one AS ({first}), early AS (SELECT *, CASE WHEN nb < 30 THEN NULL WHEN lo > 0.1 THEN 'pos_strong' WHEN hi < -0.1 THEN 'neg_strong'
  WHEN lo > -0.02 AND hi < 0.02 THEN 'tight_null' END AS kind FROM one),
two AS ({second}), late AS (SELECT two.*, CASE WHEN two.nb < 30 THEN 'unsettled' WHEN two.lo > 0.1 THEN 'pos_strong' WHEN two.lo > 0.02 THEN 'pos_weak'
  WHEN two.hi < -0.1 THEN 'neg_strong' WHEN two.hi < -0.02 THEN 'neg_weak' WHEN two.lo > -0.02 AND two.hi < 0.02 THEN 'tight_null'
  WHEN two.lo > -0.1 AND two.hi < 0.1 THEN 'dead_zone' ELSE 'unsettled' END AS kind FROM two JOIN early USING (gi, gj) WHERE early.kind IS NULL),
done AS (SELECT * FROM early WHERE kind IS NOT NULL UNION ALL SELECT * FROM late),
out AS (SELECT gi, gj, CASE WHEN t.kind = 'can_bootstrap' THEN coalesce(b.kind, 'unsettled') ELSE t.kind END AS kind, legacy_npmi, legacy_pmi, k_ij, e, median, lo, hi, nb
  FROM tiers t LEFT JOIN done b USING (gi, gj))
SELECT gi AS gene_i, gj AS gene_j, kind, round(legacy_npmi, 6) + 0.0 AS legacy_npmi, round(legacy_pmi, 6) + 0.0 AS legacy_pmi, k_ij, round(e, 6) AS expected_full, round(e, 6) AS expected_sub,
 round(median, 6) + 0.0 AS median, round(lo, 6) + 0.0 AS ci_lo, round(hi, 6) + 0.0 AS ci_hi, CAST(coalesce(nb, 0) AS INTEGER) AS n_bootstraps,
 CASE WHEN kind IN ('pos_strong', 'pos_weak', 'neg_strong', 'neg_weak', 'neg_one', 'legacy_only') THEN round(legacy_npmi, 6) + 0.0 END AS weight FROM out
""".format(boot="{boot}", steps=poisson_steps(1.0), first=_interval_sql("one", 60), second=_interval_sql("two", 120)).format(boot=5)


@query("E08 E09", with_parts(BOOT_SQL, "orig", **NPMI_PARTS))
def bootstrap_pairs(spark, sf):
    """The draws come from md5, so the SQL repeats them replicate by replicate."""
    return rounded(N.bootstrap_npmi(presence(spark, sf), tau=(0.02, 0.1), max_bootstraps=120, coarse_block=60,
                                    refine_block=60, min_evidence=5, seed=11))


# Entities of the final assignment scored against the panel of the original assignment.
SCORE_PARTS = {
    "vocab": "SELECT gi AS g FROM pairs UNION SELECT gj FROM pairs",
    "big": "SELECT cell_id FROM cg GROUP BY 1 HAVING sum(count) >= {min}",
    "mat": "SELECT cell_id, feature_name AS g FROM cg WHERE cell_id IN (SELECT cell_id FROM big) AND feature_name IN (SELECT g FROM vocab)",
    "ks": "SELECT cell_id, count(*) AS k FROM mat GROUP BY 1",
    "hits": """SELECT a.cell_id, npmi AS v FROM mat a JOIN mat b ON a.cell_id = b.cell_id AND a.g < b.g
       JOIN pairs ON gi = a.g AND gj = b.g""",
    "raw": """SELECT k.cell_id, k, k * (k - 1) // 2 AS np, count(*) FILTER (v > 0.05) AS n_pos, coalesce(sum(greatest(-v, 0)), 0) AS sn,
       coalesce(sum(greatest(v - 0.05, 0)), 0) AS pr, coalesce(sum(greatest(-v - 0.05, 0)), 0) AS nr,
       coalesce(sum(CASE WHEN v > 0.05 THEN v ELSE 0 END), 0) AS ph, coalesce(sum(CASE WHEN v < -0.05 THEN -v ELSE 0 END), 0) AS nh
       FROM ks k LEFT JOIN hits USING (cell_id) GROUP BY 1, 2""",
}


def score_parts(minimum: int) -> dict[str, str]:
    return {**NPMI_PARTS, **{k: v.format(min=minimum) if k == "big" else v for k, v in SCORE_PARTS.items()}}


@query("E10 E13 E16 S15", with_parts("""
, s AS (SELECT *, CASE WHEN np > 0 THEN n_pos / np END AS p, CASE WHEN np > 0 THEN sn / np END AS c FROM raw),
q AS (SELECT quantile_cont(p, 0.8) AS qp FROM s)
SELECT cell_id, k, np AS n_pairs, round(p, 6) AS cell_purity, round(c, 6) AS conflict_score, coalesce(p >= qp, FALSE) AS is_pure FROM s, q""",
                               "orig cg", **score_parts(10)))
def counting_coherence(spark, sf):
    out = H.purity_and_conflict(counts(spark, sf), panel(spark, sf))
    return rounded(out.select("cell_id", "k", "n_pairs", "cell_purity", "conflict_score", "is_pure"))


RELU_SQL = """
SELECT cell_id, CASE WHEN np > 0 THEN round({p} / np, 6) END AS purity_score, CASE WHEN np > 0 THEN round({n} / np, 6) END AS conflict_score,
 CASE WHEN np > 0 THEN round({p} + {n}, 6) END AS signal_strength, CASE WHEN np > 0 AND {p} + {n} > 1e-8 THEN round({p} / ({p} + {n}), 6) END AS relative_purity,
 CASE WHEN np > 0 AND {p} + {n} > 1e-8 THEN round({n} / ({p} + {n}), 6) END AS relative_conflict FROM raw"""


@query("E11 E17 E13 S07", with_parts(RELU_SQL.format(p="pr", n="nr"), "orig cg", **score_parts(1)))
def relu_coherence(spark, sf):
    return rounded(H.score_counts(counts(spark, sf), panel(spark, sf)))


@query("E11 S07", with_parts(RELU_SQL.format(p="ph", n="nh"), "orig cg", **score_parts(1)))
def relu_coherence_hard(spark, sf):
    return rounded(H.score_counts(counts(spark, sf), panel(spark, sf), relu_mode="hard"))


SUMMARY_CTE = """, sc AS (SELECT cell_id, CASE WHEN np > 0 THEN pr / np END AS ps, CASE WHEN np > 0 THEN nr / np END AS cs, CASE WHEN np > 0 THEN pr + nr END AS ss,
 CASE WHEN np > 0 AND pr + nr > 1e-8 THEN pr / (pr + nr) END AS rp, CASE WHEN np > 0 AND pr + nr > 1e-8 THEN nr / (pr + nr) END AS rc FROM raw)"""


@query("E18", with_parts(SUMMARY_CTE + """
SELECT round(median(ps), 6) AS median_purity_score, round(median(cs), 6) AS median_conflict_score, round(median(ss), 6) AS median_signal_strength,
 round(median(rp), 6) AS median_relative_purity, round(median(rc), 6) AS median_relative_conflict,
 round(avg(CASE WHEN rc > 0.4 THEN 1.0 ELSE 0 END), 6) AS fraction_high_conflict_cells, round(avg(CASE WHEN rp < 0.4 THEN 1.0 ELSE 0 END), 6) AS fraction_low_purity_cells FROM sc""",
                      "orig cg", **score_parts(1)))
def coherence_summary(spark, sf):
    return rounded(H.coherence_summary(H.score_counts(counts(spark, sf), panel(spark, sf))))


@query("E19 S11 E15", with_parts(SUMMARY_CTE + """
, t AS (SELECT cell_type, sc.* FROM sc JOIN cell_labels USING (cell_id))
SELECT cell_type, count(*) AS n_entities_scored, round(median(ps), 6) AS cpmi_purity, round(median(cs), 6) AS cpmi_conflict, round(median(rp), 6) AS cpmi_relative_purity,
 round(median(rc), 6) AS cpmi_relative_conflict, round(median(ps - cs), 6) + 0.0 AS cpmi_coherence, round(median(rp - rc), 6) + 0.0 AS cpmi_relative_coherence FROM t GROUP BY 1""",
                          "orig cg cell_labels", **score_parts(1)))
def coherence_by_type(spark, sf):
    scores = H.score_counts(counts(spark, sf), panel(spark, sf))
    cells = H.attach_scores(scores, cell_labels(spark, sf).select("cell_id", "cell_type")).where("cell_type IS NOT NULL")
    return rounded(H.coherence_medians(cells, ["cell_type"]))


FALLBACK_CTE = """
, p0 AS (SELECT cell_id AS c, feature_name AS g FROM cg), t0 AS (SELECT count(DISTINCT c) AS n FROM p0), m0 AS (SELECT g, count(*) AS k FROM p0 GROUP BY 1),
k0 AS (SELECT a.g AS gi, b.g AS gj, count(*) AS k FROM p0 a JOIN p0 b ON a.c = b.c AND a.g < b.g GROUP BY 1, 2),
v0 AS (SELECT gi, gj, ln((k0.k / n) / ((a.k / n) * (b.k / n))) / -ln(k0.k / n) AS v FROM k0 JOIN m0 a ON gi = a.g JOIN m0 b ON gj = b.g, t0),
e AS (SELECT cell_id, sum(count) AS n, count(*) AS k FROM cg GROUP BY 1 HAVING sum(count) >= 10 AND count(*) >= 2)
, fb AS (SELECT a.c AS cell_id, sum(greatest(v, 0)) / (any_value(k) * (any_value(k) - 1) / 2) AS purity, sum(greatest(-v, 0)) / (any_value(k) * (any_value(k) - 1) / 2) AS conflict,
 any_value(k) AS n_genes, CAST(any_value(e.n) AS BIGINT) AS n_transcripts FROM p0 a JOIN p0 b ON a.c = b.c AND a.g < b.g JOIN v0 ON gi = a.g AND gj = b.g JOIN e ON e.cell_id = a.c GROUP BY 1)"""


@query("E12 E21", with_parts(FALLBACK_CTE + """
SELECT cell_id, round(purity, 6) AS purity, round(conflict, 6) AS conflict, n_genes, n_transcripts FROM fb""", "cg"))
def fallback_purity(spark, sf):
    return rounded(H.purity_mean(counts(spark, sf)))


@query("E21", with_parts(FALLBACK_CTE + """
SELECT count(*) AS n_cells, round(avg(purity), 6) AS mean_purity, round(avg(conflict), 6) AS mean_conflict, round(avg(n_transcripts), 6) AS mean_n_transcripts, round(avg(n_genes), 6) AS mean_n_genes,
 round(median(purity), 6) AS median_purity, round(median(conflict), 6) AS median_conflict, median(n_transcripts) AS median_n_transcripts, median(n_genes) AS median_n_genes FROM fb""", "cg"))
def fallback_purity_summary(spark, sf):
    return rounded(H.npmi_summary(H.purity_mean(counts(spark, sf))))


@query("E20", with_parts("""
, pur AS (SELECT cell_id, feature_name, CASE WHEN CAST(substr(feature_name, 5) AS INTEGER) % 3 = 0 THEN count * 0.5
  WHEN CAST(substr(feature_name, 5) AS INTEGER) % 7 = 0 THEN count + 1.0 ELSE count * 1.0 END AS c FROM og WHERE CAST(substr(feature_name, 5) AS INTEGER) % 10 <> 9
  AND cell_id IN (SELECT cell_id FROM cell_labels WHERE cell_type <> 'BUILDING')),
mt AS (SELECT 'before' AS st, cell_id, feature_name AS g FROM og UNION ALL SELECT 'after', cell_id, feature_name FROM pur WHERE round_even(c, 0) <> 0),
mv AS (SELECT * FROM mt WHERE g IN (SELECT gi FROM pairs UNION SELECT gj FROM pairs)),
r AS (SELECT a.st, a.cell_id, sum(greatest(npmi - 0.05, 0)) AS p, sum(greatest(-npmi - 0.05, 0)) AS n FROM mv a JOIN mv b ON a.st = b.st AND a.cell_id = b.cell_id AND a.g < b.g
  JOIN pairs ON gi = a.g AND gj = b.g GROUP BY 1, 2),
m AS (SELECT st, median(CASE WHEN p + n > 1e-8 THEN p / (p + n) END) AS rp, median(CASE WHEN p + n > 1e-8 THEN n / (p + n) END) AS rc FROM r GROUP BY 1)
SELECT round(b.rp, 6) AS cpmi_relative_purity_before, round(a.rp, 6) AS cpmi_relative_purity_after, round(a.rp - b.rp, 6) + 0.0 AS cpmi_relative_purity_delta,
 round(b.rc, 6) AS cpmi_relative_conflict_before, round(a.rc, 6) AS cpmi_relative_conflict_after, round(a.rc - b.rc, 6) + 0.0 AS cpmi_relative_conflict_delta
FROM m a, m b WHERE a.st = 'after' AND b.st = 'before'""", "orig og cell_labels", **NPMI_PARTS))
def purity_before_after(spark, sf):
    original, purified = count_pair(spark, sf)
    return rounded(H.before_after_purity(original, purified, panel(spark, sf)))


# --- coexpression -----------------------------------------------------------

@query("E22 E23 E29", with_parts("""
SELECT cell_id, CAST(30 AS BIGINT) AS n, TRUE AS known_features FROM cg GROUP BY 1 HAVING sum(count) >= 30""", "cg"))
def thinned_totals(spark, sf):
    c = counts(spark, sf)
    keep = CX.eligible_entities(c, 30, 10)
    thin = CX.thin_counts(c.join(keep, "cell_id", "left_semi"), 30, seed=5)
    had = c.select("cell_id", "feature_name", F.lit(True).alias("had"))
    return thin.join(had, ["cell_id", "feature_name"], "left").groupBy("cell_id").agg(
        F.sum("count").alias("n"), F.min(F.coalesce("had", F.lit(False))).alias("known_features"))


@query("E22", with_parts("""
SELECT cell_id, CAST(least(sum(count), 10) AS BIGINT) AS n, TRUE AS within_counts FROM cg GROUP BY 1""", "cg"))
def thinned_without_replacement(spark, sf):
    c = counts(spark, sf)
    thin = CX.thin_counts(c, 10, seed=5, replace=False)
    return thin.join(c.withColumnRenamed("count", "all"), ["cell_id", "feature_name"], "left").groupBy("cell_id").agg(
        F.sum("count").alias("n"), F.min(F.coalesce(F.col("count") <= F.col("all"), F.lit(False))).alias("within_counts"))


@query("E23", with_parts("""
, d AS (SELECT cell_id, sum(count) AS n FROM cg GROUP BY 1)
SELECT cell_id FROM d WHERE n >= 55 AND (SELECT count(*) FROM d WHERE n >= 55) >= 200
UNION ALL SELECT cell_id FROM (SELECT cell_id FROM d WHERE (SELECT count(*) FROM d WHERE n >= 55) < 200 ORDER BY n DESC, cell_id LIMIT 200)""", "cg"))
def eligible_entities(spark, sf):
    return CX.eligible_entities(counts(spark, sf), 55, 200)


POS_PARTS = {
    "ent": "SELECT count(DISTINCT cell_id) AS n FROM cg",
    "pos": "SELECT cell_id AS c, feature_name AS g FROM cg WHERE count >= 2",
    "pk": "SELECT g, count(*) AS k FROM pos GROUP BY 1",
    "pj": "SELECT a.g AS gi, b.g AS gj, count(*) AS k FROM pos a JOIN pos b ON a.c = b.c GROUP BY 1, 2",
}


def positive(spark, sf):
    c = counts(spark, sf)
    return CX.positivity(c, c.agg(F.countDistinct("cell_id")).scalar(), 2)


@query("E24", with_parts("""
SELECT feature_name, round(count(*) FILTER (count >= 2) / any_value(n), 6) AS rate FROM cg, ent GROUP BY 1""", "cg", **POS_PARTS))
def positivity_rate(spark, sf):
    return rounded(positive(spark, sf)[1])


@query("E25", with_parts("SELECT gi AS gene_i, gj AS gene_j, round(pj.k / pk.k, 6) AS value FROM pj JOIN pk ON pj.gj = pk.g", "cg", **POS_PARTS))
def conditional_coexpression(spark, sf):
    return rounded(CX.conditional_coexpression(positive(spark, sf)[0]))


@query("E26", with_parts("""
SELECT gi AS gene_i, gj AS gene_j, round(pj.k / (a.k + b.k - pj.k), 6) AS value FROM pj JOIN pk a ON pj.gi = a.g JOIN pk b ON pj.gj = b.g""", "cg", **POS_PARTS))
def jaccard_coexpression(spark, sf):
    return rounded(CX.jaccard_coexpression(positive(spark, sf)[0]))


@query("E27", with_parts("""
, cells AS (SELECT DISTINCT cell_id FROM cg), genes AS (SELECT DISTINCT feature_name AS g FROM cg),
dense AS (SELECT cells.cell_id, g, coalesce(count, 0) AS v FROM cells CROSS JOIN genes LEFT JOIN cg ON cg.cell_id = cells.cell_id AND cg.feature_name = g)
SELECT a.g AS gene_i, b.g AS gene_j, round(corr(a.v, b.v), 6) + 0.0 AS value FROM dense a JOIN dense b ON a.cell_id = b.cell_id AND a.g < b.g GROUP BY 1, 2""", "cg"))
def pearson_coexpression(spark, sf):
    c = counts(spark, sf)
    return rounded(CX.pearson_coexpression(c, c.agg(F.countDistinct("cell_id")).scalar()))


@query("E28", with_parts("""
, cells AS (SELECT DISTINCT cell_id FROM cg), genes AS (SELECT DISTINCT feature_name AS g FROM cg),
dense AS (SELECT cells.cell_id, g, coalesce(count, 0) AS v FROM cells CROSS JOIN genes LEFT JOIN cg ON cg.cell_id = cells.cell_id AND cg.feature_name = g),
ranked AS (SELECT cell_id, g, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS v FROM dense)
SELECT a.g AS gene_i, b.g AS gene_j, round(corr(a.v, b.v), 6) + 0.0 AS value FROM ranked a JOIN ranked b ON a.cell_id = b.cell_id AND a.g < b.g GROUP BY 1, 2""", "cg"))
def spearman_coexpression(spark, sf):
    c = counts(spark, sf)
    return rounded(CX.spearman_coexpression(c, c.agg(F.countDistinct("cell_id")).scalar()))


@query("E29", with_parts("""
SELECT gi AS gene_i, gj AS gene_j, round(pj.k / pk.k, 6) AS value FROM pj JOIN pk ON pj.gj = pk.g""", "cg", **POS_PARTS))
def coexpression_without_thinning(spark, sf):
    return rounded(CX.coexpression(counts(spark, sf), "conditional", target=None, cutoff=2)[0])


RATIO_PARTS = {
    "ca": "SELECT cell_id AS c, feature_name AS g FROM assigned WHERE method = 'method_a' GROUP BY 1, 2",
    "cb": "SELECT cell_id AS c, feature_name AS g FROM assigned WHERE method = 'method_b' GROUP BY 1, 2",
    "ra": "SELECT g, count(*) / (SELECT count(DISTINCT c) FROM ca) AS r, count(*) AS k FROM ca GROUP BY 1",
    "rb": "SELECT g, count(*) / (SELECT count(DISTINCT c) FROM cb) AS r, count(*) AS k FROM cb GROUP BY 1",
    "va": "SELECT x.g AS gi, y.g AS gj, count(*) / any_value(ra.k) AS v FROM ca x JOIN ca y ON x.c = y.c JOIN ra ON ra.g = y.g GROUP BY 1, 2",
    "vb": "SELECT x.g AS gi, y.g AS gj, count(*) / any_value(rb.k) AS v FROM cb x JOIN cb y ON x.c = y.c JOIN rb ON rb.g = y.g GROUP BY 1, 2",
    "rare": "SELECT coalesce(ra.g, rb.g) AS g, coalesce(ra.r, 0) < 0.11 OR coalesce(rb.r, 0) < 0.11 AS rare FROM ra FULL JOIN rb ON ra.g = rb.g",
    "ratios": """SELECT coalesce(va.gi, vb.gi) AS gi, coalesce(va.gj, vb.gj) AS gj, CASE WHEN i.rare AND j.rare THEN 0.0 WHEN va.v <> 0 AND vb.v > 0 THEN log2(vb.v / va.v) END AS r
      FROM va FULL JOIN vb ON va.gi = vb.gi AND va.gj = vb.gj JOIN rare i ON i.g = coalesce(va.gi, vb.gi) JOIN rare j ON j.g = coalesce(va.gj, vb.gj)""",
}


def method_ratio(spark, sf):
    m = molecules(spark, sf)
    part = {k: CX.coexpression(A.cell_gene_counts(m.where(f"method = '{k}'")), "conditional", target=None)
            for k in ("method_a", "method_b")}
    return CX.censored_ratio(part["method_a"][0], part["method_b"][0], part["method_a"][1], part["method_b"][1], 0.11)


@query("E30", with_parts("SELECT gi AS gene_i, gj AS gene_j, round(r, 6) + 0.0 AS ratio FROM ratios", "assigned", **RATIO_PARTS))
def censored_ratio(spark, sf):
    return rounded(method_ratio(spark, sf))


@query("E31", with_parts("SELECT gi AS gene_i, gj AS gene_j, round(r, 6) + 0.0 AS ratio FROM ratios WHERE r >= log2(1.5)", "assigned", **RATIO_PARTS))
def spurious_pairs(spark, sf):
    return rounded(CX.spurious_pairs(method_ratio(spark, sf), 1.5, "conditional"))
