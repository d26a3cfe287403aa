"""Feature co-occurrence: presence, pair counts, PMI / NPMI, evidence tiers, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.functions import blocks as B
from molq.functions import expr as X
from molq.functions.ordering import quantiles
from molq.functions.tokens import CONTEXT_SENTINELS, UNASSIGNED
from molq.session import cut_lineage


def presence(df: DataFrame, context: str = "cell_id", min_occurrences: int = 2,
             feature: str = "feature_name", count_col: str | None = None) -> DataFrame:
    """(context, feature_name, n) with n >= min_occurrences. The group-by merges a mega-context
    map-side, so it reaches a reducer as one row per feature."""
    n = F.count(F.lit(1)) if count_col is None else F.sum(count_col)
    return (df.groupBy(F.col(context).cast("string").alias("context"),
                       F.col(feature).cast("string").alias("feature_name"))
            .agg(n.alias("n")).where(F.col("n") >= min_occurrences))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when the table is empty; checked with a one-row probe."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def marginals(pres: DataFrame) -> DataFrame:
    return pres.groupBy("feature_name").agg(F.count(F.lit(1)).alias("k_i"))


def context_count(pres: DataFrame) -> Column:
    """C: contexts that still hold a passing feature, as a scalar subquery."""
    return pres.agg(F.countDistinct("context")).scalar()


def named_pairs(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Feature codes i, j back to names."""
    a = index.select(F.col("g").alias("i"), F.col("feature_name").alias("gene_i"))
    b = index.select(F.col("g").alias("j"), F.col("feature_name").alias("gene_j"))
    return pairs.join(a, "i").join(b, "j").drop("i", "j")


def counted_pairs(pres: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """((gene_i, gene_j, k_i, k_j, k_ij) with gene_i < gene_j, (feature_name, k_i), contexts).

    Presence is derived once and kept as coded context rows; frequent features meet in dense blocks, rare ones by
    counted pairs."""
    pres = cut_lineage(pres.select("context", "feature_name"))
    index = cut_lineage(B.frequency_index(pres))
    rows = cut_lineage(B.context_rows(pres, index.select("feature_name", "g")))
    contexts = rows.agg(F.count("context")).scalar()
    heavy, every = index.agg(F.count_if(F.col("k") * B.HEAVY_SHARE >= contexts), F.count(F.lit(1))).first()
    side = lambda s: index.select(F.col("g").alias(s), F.col("feature_name").alias(f"f{s}"), F.col("k").alias(f"c{s}"))
    both = B.presence_pairs(rows, heavy, every).join(side("i"), "i").join(side("j"), "j")
    # Codes follow frequency, pairs follow names.
    turned = F.col("fi") > F.col("fj")
    pick = lambda c, d: F.when(turned, F.col(d)).otherwise(F.col(c))
    pairs = both.select(pick("fi", "fj").alias("gene_i"), pick("fj", "fi").alias("gene_j"),
                        pick("ci", "cj").alias("k_i"), pick("cj", "ci").alias("k_j"),
                        F.col("s").cast("long").alias("k_ij"))
    return pairs, index.select("feature_name", F.col("k").alias("k_i")), contexts


def pair_cooccurrence(pres: DataFrame) -> DataFrame:
    """(gene_i, gene_j, k_ij) for gene_i < gene_j: contexts that hold both."""
    return counted_pairs(pres)[0].select("gene_i", "gene_j", "k_ij")


def all_pairs(features: DataFrame, diagonal: bool = False) -> DataFrame:
    """Every unordered feature pair, generated from code ranges (only for dense output, whose
    size is the square of the vocabulary by definition)."""
    index = B.feature_index(features)
    g = index.agg(F.max("g")).scalar()
    first = F.col("g") + (0 if diagonal else 1)
    codes = index.withColumn("g_max", g).where(first <= F.col("g_max")).select(
        F.col("g").alias("i"), F.explode(F.sequence(first, F.col("g_max"))).alias("j"))
    return named_pairs(codes, index)


def _with_marginals(pairs: DataFrame, marg: DataFrame) -> DataFrame:
    side = lambda s: marg.select(F.col("feature_name").alias(f"gene_{s}"),
                                 F.col("k_i").alias(f"k_{s}"))
    return pairs.join(side("i"), "gene_i").join(side("j"), "gene_j")


def pmi_columns(df: DataFrame, p_i: Column, p_j: Column, p_ij: Column) -> DataFrame:
    pmi = F.when(p_ij > 0, F.ln(p_ij / (p_i * p_j)))
    # P_ij = 1 would divide by zero; the score is undefined there.
    return df.withColumns({"PMI": pmi, "NPMI": F.when(p_ij < 1, pmi / -F.ln(p_ij))})


def compute_npmi(pres: DataFrame, dense: bool = False, set_neg_one: bool = False,
                 thr: float = 0.05) -> DataFrame:
    """Panel (gene_i <= gene_j): marginals, joint, conditionals, PMI, NPMI.

    Sparse by default: pairs seen together. ``dense`` adds unseen pairs and the diagonal, with
    NULL scores, or -1 where both marginals exceed ``thr`` and ``set_neg_one`` is on.
    """
    wide, marg, c = counted_pairs(pres)
    if dense:
        seen = wide.select("gene_i", "gene_j", "k_ij")
        wide = _with_marginals(all_pairs(marg, diagonal=True).join(seen, ["gene_i", "gene_j"], "left"), marg)
        wide = wide.withColumn("k_ij", F.coalesce(
            F.when(F.col("gene_i") == F.col("gene_j"), F.col("k_i")), "k_ij", F.lit(0)))
    wide = wide.withColumns({"P_i": F.col("k_i") / c, "P_j": F.col("k_j") / c,
                             "P_ij": F.col("k_ij") / c})
    out = pmi_columns(wide, F.col("P_i"), F.col("P_j"), F.col("P_ij")).withColumns({
        "P_i_given_j": F.col("P_ij") / F.col("P_j"), "P_j_given_i": F.col("P_ij") / F.col("P_i")})
    if set_neg_one:
        gap = (F.col("P_ij") == 0) & (F.col("P_i") > thr) & (F.col("P_j") > thr)
        out = out.withColumn("NPMI", F.when(gap, -1.0).otherwise(F.col("NPMI")))
    return out.select("gene_i", "gene_j", "P_i", "P_j", "P_ij", "P_i_given_j", "P_j_given_i",
                      "PMI", "NPMI")


# --- which molecules and contexts count -------------------------------------

def size_band(df: DataFrame, context: str, low_pct: float, high_pct: float) -> DataFrame:
    """Contexts whose size lies between two percentiles of all sizes (inclusive)."""
    sizes = df.groupBy(context).agg(F.count(F.lit(1)).alias("n"))
    # Sizes are integers with few distinct values, so the exact percentile is bounded.
    band = sizes.agg(F.percentile("n", F.array(F.lit(low_pct / 100), F.lit(high_pct / 100)))
                     .alias("b"))
    low, high = (band.select(F.col("b")[i]).scalar() for i in (0, 1))
    return sizes.where((F.col("n") >= low) & (F.col("n") <= high)).select(context)


def confident_nuclei(df: DataFrame, valid_genes: DataFrame | None = None, qv_min: float = 30,
                     low_pct: float = 20, high_pct: float = 80,
                     exclude: Sequence[str] = (UNASSIGNED,)) -> DataFrame:
    """Nuclear molecules of entities with a middling nuclear size."""
    good = df.where(F.col("qv") >= qv_min)
    if valid_genes is not None:
        good = good.join(valid_genes.select("feature_name").distinct(), "feature_name", "left_semi")
    nuclear = good.where(~F.col("cell_id").isin(*exclude) & (F.col("overlaps_nucleus") == 1))
    return nuclear.join(size_band(nuclear, "cell_id", low_pct, high_pct), "cell_id", "left_semi")


def bootstrap_prefilter(df: DataFrame, context: str = "cell_id", nuclear_only: bool = False,
                        nucleus_col: str = "overlaps_nucleus",
                        percentile_band: tuple[float, float] | None = None,
                        exclude: Sequence[str] = CONTEXT_SENTINELS) -> DataFrame:
    """Drop sentinel contexts, then non-nuclear molecules, then contexts of extreme size."""
    ctx = F.col(context).cast("string")
    out = df.where(~F.coalesce(ctx, F.lit("nan")).isin(*exclude))
    if nuclear_only:
        out = out.where(X.truthy(nucleus_col))
    if percentile_band is not None:
        out = out.join(size_band(out, context, *percentile_band), context, "left_semi")
    return out


def prefilter_counts(df: DataFrame, context: str = "cell_id", nuclear_only: bool = False,
                     nucleus_col: str = "overlaps_nucleus",
                     percentile_band: tuple[float, float] | None = None,
                     exclude: Sequence[str] = CONTEXT_SENTINELS) -> DataFrame:
    """How many molecules each step of the pre-filter dropped."""
    ctx = F.coalesce(F.col(context).cast("string"), F.lit("nan"))
    listed = ctx.isin(*exclude)
    nuclear = X.truthy(nucleus_col) if nuclear_only else F.lit(True)
    kept = bootstrap_prefilter(df, context, nuclear_only, nucleus_col, percentile_band, exclude)
    row = df.agg(F.count(F.lit(1)).alias("n_input_rows"), F.count_if(listed).alias("n_dropped_excluded"),
                 F.count_if(~listed & ~nuclear).alias("n_dropped_nuclear"))
    row = row.withColumn("n_kept_rows", kept.agg(F.count(F.lit(1))).scalar())
    return row.withColumn("n_dropped_percentile", F.col("n_input_rows") - F.col("n_dropped_excluded")
                          - F.col("n_dropped_nuclear") - F.col("n_kept_rows"))


def feature_size_bands(df: DataFrame, context: str, low_pct: float, high_pct: float,
                       min_occurrences: int = 2) -> DataFrame:
    """(feature_name, n_min, n_max): size percentiles of the contexts that express a feature."""
    sizes = df.groupBy(F.col(context).cast("string").alias("context")).agg(
        F.count(F.lit(1)).alias("total_tx"))
    q = F.percentile("total_tx", F.array(F.lit(low_pct / 100), F.lit(high_pct / 100)))
    return (presence(df, context, min_occurrences).join(sizes, "context")
            .groupBy("feature_name").agg(q.alias("b"))
            .select("feature_name", F.col("b")[0].alias("n_min"), F.col("b")[1].alias("n_max")))


def admitted_presence(df: DataFrame, context: str, low_pct: float, high_pct: float,
                      min_occurrences: int = 2) -> DataFrame:
    """Presence masked by each feature's own size band."""
    sizes = df.groupBy(F.col(context).cast("string").alias("context")).agg(
        F.count(F.lit(1)).alias("total_tx"))
    bands = feature_size_bands(df, context, low_pct, high_pct, min_occurrences)
    return (presence(df, context, min_occurrences).join(sizes, "context")
            .join(bands, "feature_name")
            .where((F.col("total_tx") >= F.col("n_min")) & (F.col("total_tx") <= F.col("n_max")))
            .select("context", "feature_name", "n"))


# --- evidence ----------------------------------------------------------------

def evidence_tiers(pres: DataFrame, min_evidence: float = 10.0,
                   min_bootstrap: float | None = None, subsample: int | None = None,
                   set_neg_one: bool = True, universe: Column | None = None) -> DataFrame:
    """Every unordered pair with its evidence kind and its full-data PMI / NPMI.

    Seen pairs: low_evidence, legacy_only or can_bootstrap, from max(k, E[k]). Unseen pairs:
    neg_one when many joint contexts were expected, else indeterminate. ``universe`` is the
    context count when presence was masked after counting contexts.
    """
    seen, marg, c = counted_pairs(pres)
    c = c if universe is None else universe
    boot = min_evidence if min_bootstrap is None else min_bootstrap
    seen = seen.select("gene_i", "gene_j", "k_ij")
    wide = (_with_marginals(all_pairs(marg).join(seen, ["gene_i", "gene_j"], "left"), marg)
            .withColumn("c", c.cast("double")))
    size = F.col("c") if subsample is None else F.lit(float(subsample))
    p_i, p_j = F.col("k_i") / F.col("c"), F.col("k_j") / F.col("c")
    wide = wide.withColumns({"expected_full": p_i * p_j * F.col("c"), "expected_sub": p_i * p_j * size})
    wide = pmi_columns(wide, p_i, p_j, F.col("k_ij") / F.col("c"))
    k = F.col("k_ij").cast("double")
    high = F.greatest(k, F.col("expected_full")) >= min_evidence
    able = F.greatest(k * size / F.col("c"), F.col("expected_sub")) >= boot
    unseen = F.col("k_ij").isNull()
    neg = unseen & (F.col("expected_full") >= min_evidence) & F.lit(set_neg_one)
    kind = (F.when(neg, "neg_one").when(unseen, "indeterminate").when(~high, "low_evidence")
            .when(able, "can_bootstrap").otherwise("legacy_only"))
    return wide.select(
        "gene_i", "gene_j", kind.alias("kind"),
        F.when(neg, F.lit(-1.0)).otherwise(F.col("NPMI")).alias("legacy_npmi"),
        F.when(neg, -F.ln("expected_full")).otherwise(F.col("PMI")).alias("legacy_pmi"),
        F.coalesce(F.col("k_ij"), F.lit(0)).alias("k_ij"), "expected_full", "expected_sub")


def replicate_scores(pres: DataFrame, pairs: DataFrame, replicates: range, seed: int,
                     rate: float = 1.0, alpha: float = 0.1, metric: str = "npmi") -> DataFrame:
    """(gene_i, gene_j, values): the score of each pair in every replicate, as arrays of at most 32 values; an
    undefined one is null.

    Each context gets a Poisson(rate) weight per replicate from its own name, which resamples
    contexts without a driver-side draw; frequencies divide by the replicate's weight total.
    """
    index = B.feature_index(pres)
    weighted = cut_lineage(B.weighted_rows(B.context_rows(pres, index), replicates, seed, rate))
    marg = cut_lineage(B.replicate_marginals(weighted, len(replicates)))
    side = lambda name: marg.where("g >= 0").select(F.col("g").alias(name), "part", F.col("m").alias(f"m{name}"))
    total = marg.where("g = -1").select("part", F.col("m").alias("n"))
    k = (B.replicate_pair_sums(weighted, pairs, index, len(replicates))
         .join(side("i"), ["i", "part"]).join(side("j"), ["j", "part"]).join(total, "part"))

    def value(c: Column) -> Column:
        den = c["n"] + 2.0 * alpha
        p = lambda name: (c[name] + F.lit(alpha)) / den
        defined = (c["n"] > 0) & (p("k") > 0) & (p("mi") > 0) & (p("mj") > 0)
        pmi = F.ln(p("k") / (p("mi") * p("mj")))
        return F.when(defined, pmi if metric == "pmi" else F.when(p("k") < 1, pmi / -F.ln(p("k"))))

    return named_pairs(k.select("i", "j", F.transform(F.arrays_zip("k", "mi", "mj", "n"), value).alias("values")), index)


def replicate_intervals(samples: DataFrame, ci_level: float = 0.95) -> DataFrame:
    """Median and interval per pair. A pair's samples are one array, at most the replicate budget."""
    low = (1.0 - ci_level) / 2.0
    every = F.array_sort(F.filter(F.flatten(F.collect_list("values")), lambda v: v.isNotNull()))

    def at(q: float) -> Column:
        place = (F.col("n_bootstraps") - 1) * F.lit(q)
        below = F.get("every", F.floor(place).cast("int"))
        return below + (F.get("every", F.ceil(place).cast("int")) - below) * (place - F.floor(place))

    rows = samples.groupBy("gene_i", "gene_j").agg(every.alias("every")).withColumn("n_bootstraps", F.size("every"))
    return rows.where("n_bootstraps > 0").select(
        "gene_i", "gene_j", at(0.5).alias("median"), at(low).alias("ci_lo"), at(1.0 - low).alias("ci_hi"), "n_bootstraps")


def classify_interval(lo: Column, hi: Column, n: Column, tau: float | Sequence[float],
                      min_samples: int = 30, final: bool = True) -> Column:
    """Kind of a pair from its interval. With two thresholds there are seven kinds; with one
    there are four. The early check (``final=False``) only accepts the confident kinds."""
    taus = sorted([tau] if isinstance(tau, (int, float)) else list(tau))
    low, high = float(taus[0]), float(taus[-1])
    dual = low < high
    name = lambda strong, plain: F.lit(strong if dual else plain)
    enough = F.coalesce(n >= min_samples, F.lit(False))
    out = F.when(~enough, "unsettled").when(lo > high, name("pos_strong", "pos"))
    if final:
        out = out.when(lo > low, name("pos_weak", "pos"))
    out = out.when(hi < -high, name("neg_strong", "neg"))
    if final:
        out = out.when(hi < -low, name("neg_weak", "neg"))
    out = out.when((lo > -low) & (hi < low), name("tight_null", "dead_zone"))
    if final:
        out = out.when((lo > -high) & (hi < high), F.lit("dead_zone"))
    return out.otherwise("unsettled")


SETTLED_SIGNS = ("pos", "neg", "pos_strong", "pos_weak", "neg_strong", "neg_weak")


def bootstrap_npmi(pres: DataFrame, tau: float | Sequence[float] = 0.05, ci_level: float = 0.95,
                   max_bootstraps: int = 400, coarse_block: int = 200, refine_block: int = 200,
                   min_samples: int = 30, seed: int = 0, subsample: int | None = None,
                   alpha: float = 0.1, metric: str = "npmi", min_evidence: float = 10.0,
                   min_bootstrap: float | None = None, set_neg_one: bool = True) -> DataFrame:
    """Pair table with kinds, intervals and the output weight.

    Replicates run in blocks; pairs whose interval is already decisive leave the loop. The loop
    is a bounded number of jobs and carries only the unsettled pairs and their samples, written
    to the shared checkpoint folder.
    """
    pres = cut_lineage(pres)
    tiers = cut_lineage(evidence_tiers(pres, min_evidence, min_bootstrap, subsample, set_neg_one))
    n_contexts = pres.agg(F.countDistinct("context")).first()[0]
    rate = 1.0 if subsample is None else subsample / max(1, n_contexts)
    open_pairs = tiers.where("kind = 'can_bootstrap'").select("gene_i", "gene_j")
    samples, settled, done = None, None, 0
    while done < max_bootstraps:
        block = min(coarse_block if done == 0 else refine_block, max_bootstraps - done)
        new = replicate_scores(pres, open_pairs, range(done, done + block), seed, rate, alpha, metric)
        done += block
        kept = new if samples is None else new.unionByName(
            samples.join(open_pairs, ["gene_i", "gene_j"], "left_semi"))
        samples = cut_lineage(kept)
        ci = replicate_intervals(samples, ci_level)
        early = ci.withColumn("kind", classify_interval(
            F.col("ci_lo"), F.col("ci_hi"), F.col("n_bootstraps"), tau, min_samples, final=False))
        ready = early.where("kind <> 'unsettled'")
        settled = cut_lineage(ready if settled is None else settled.unionByName(ready))
        open_pairs = open_pairs.join(settled, ["gene_i", "gene_j"], "left_anti")
        if open_pairs.isEmpty():
            break
    last = replicate_intervals(samples.join(open_pairs, ["gene_i", "gene_j"], "left_semi"), ci_level)
    last = last.withColumn("kind", classify_interval(
        F.col("ci_lo"), F.col("ci_hi"), F.col("n_bootstraps"), tau, min_samples))
    boot = settled.unionByName(last).withColumnRenamed("kind", "boot_kind")
    out = tiers.join(boot, ["gene_i", "gene_j"], "left")
    kind = F.when(F.col("kind") == "can_bootstrap",
                  F.coalesce("boot_kind", F.lit("unsettled"))).otherwise(F.col("kind"))
    out = out.withColumn("kind", kind).drop("boot_kind").withColumn(
        "n_bootstraps", F.coalesce("n_bootstraps", F.lit(0)))
    legacy = F.col("legacy_pmi" if metric == "pmi" else "legacy_npmi")
    return out.withColumn("weight", F.when(
        F.col("kind").isin(*SETTLED_SIGNS, "neg_one", "legacy_only"), legacy))
