"""Per-entity mixture weights: entropy, dominance, doublet measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.functions import expr as X


def mixture_entropy(weights: DataFrame) -> DataFrame:
    """Clip negatives, renormalise, natural-log Shannon entropy and maximum weight.

    With S = sum of clipped w: H = ln S - sum(w ln w) / S, so one aggregate does it all."""
    w = F.greatest(F.coalesce(X.finite("weight"), F.lit(0.0)), F.lit(0.0))
    agg = weights.select("cell_id", w.alias("w")).groupBy("cell_id").agg(
        F.sum("w").alias("s"), F.max("w").alias("m"),
        F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w")).otherwise(F.lit(0.0))).alias("l"))
    some = F.col("s") > 0
    return agg.select("cell_id", F.when(some, F.ln("s") - F.col("l") / F.col("s")).alias("entropy"),
                      F.when(some, F.col("m") / F.col("s")).alias("max_weight"))


def normalized_weights(weights: DataFrame) -> DataFrame:
    w = F.greatest(F.coalesce(X.finite("weight"), F.lit(0.0)), F.lit(0.0))
    total = weights.groupBy("cell_id").agg(F.sum(w).alias("_s")).where("_s > 0")
    return weights.join(total, "cell_id").select("cell_id", "cell_type", (w / F.col("_s")).alias("weight"))


def first_second(weights: DataFrame) -> DataFrame:
    """Tidy table: first and second type by weight, ties by name. The two largest entries come
    from a running aggregate over one entity's few types."""
    key = F.struct((-F.col("weight")).alias("k"), F.col("cell_type"))
    top = F.slice(F.sort_array(F.collect_list(key)), 1, 2)
    return weights.groupBy("cell_id").agg(top.alias("t")).select(
        "cell_id", F.col("t")[0]["cell_type"].alias("first_type"),
        (-F.col("t")[0]["k"]).alias("weight_first_type"),
        F.get("t", 1)["cell_type"].alias("second_type"),
        F.coalesce(-F.get("t", 1)["k"], F.lit(0.0)).alias("weight_second_type"))


# Compartment keywords.
COMPARTMENTS = (
    ("tumor", ("cancer", "tumor", "tumour", "malignant", "epitheli")),
    ("immune", ("t cell", "b cell", "nk", "macrophage", "monocyte", "myeloid", "plasma", "mast",
                "dendritic", "neutrophil", "lymph")),
    ("stromal", ("fibroblast", "endotheli", "pericyte", "smooth muscle", "stroma")),
)


def two_component_metrics(tidy: DataFrame, compartments: Sequence[tuple[str, Sequence[str]]] = COMPARTMENTS,
                          ) -> DataFrame:
    """Entropy of the two weights, the minor weight, and compartment pair scores."""
    w1, w2 = F.coalesce("weight_first_type", F.lit(0.0)), F.coalesce("weight_second_type", F.lit(0.0))
    total = F.greatest(w1 + w2, F.lit(1e-12))
    term = lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))
    label = lambda c: X.first_match(F.coalesce(F.col(c), F.lit("")), compartments, "other")
    out = tidy.withColumns({
        "max_weight": F.greatest(w1, w2), "minor_weight": F.least(w1, w2),
        "entropy": -(term(w1 / total) + term(w2 / total)) + F.lit(0.0),
        "compartment_first": label("first_type"), "compartment_second": label("second_type")})
    names = [c for c, _ in compartments]
    first, second = F.col("compartment_first"), F.col("compartment_second")
    pair = lambda a, b: F.when(((first == a) & (second == b)) | ((first == b) & (second == a)),
                               F.col("minor_weight")).otherwise(F.lit(0.0))
    return out.withColumns({f"{a}_{b}_mixture_score": pair(a, b)
                            for i, a in enumerate(names) for b in names[i + 1:]})


def dominant_label(weights: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Type of the largest weight; the first type wins a tie, by name or by a given order."""
    rank: Column = (F.array_position(F.array(*[F.lit(o) for o in order]), F.col("cell_type"))
                    if order else F.col("cell_type"))
    return weights.where(F.col("weight").isNotNull()).groupBy("cell_id").agg(
        F.min_by("cell_type", F.struct(-F.col("weight"), rank)).alias("dominant_celltype"))


def category_mixture(weights: DataFrame, categories: Mapping[str, Sequence[str]], a: str,
                     b: str) -> DataFrame:
    """min(sum of weights in category a, sum in category b) per entity; NULL when a category
    matches no type at all."""
    cat = X.first_match("cell_type", X.category_lookup(categories), None)
    rows = weights.withColumn("_c", cat)
    known = rows.select("_c").distinct().agg(
        F.coalesce((F.max(F.col("_c") == a)) & (F.max(F.col("_c") == b)), F.lit(False))).scalar()
    return rows.groupBy("cell_id").agg(F.least(
        X.sum_if(F.col("_c") == a, "weight"), X.sum_if(F.col("_c") == b, "weight")).alias("m")).select(
        "cell_id", F.when(known, F.col("m")).alias(f"mixture_{a}_{b}"))


def doublet_shares(cells: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Shares of certain doublets and singlets per stage (pre / post)."""
    share = lambda k: F.avg((F.col("spot_class") == k).cast("double"))
    return cells.groupBy(stage_col).agg(
        F.count(F.lit(1)).alias("n_cells"), share("doublet_certain").alias("fraction_doublet"),
        share("singlet").alias("fraction_singlet"))


def scores_long(df: DataFrame, id_col: str, labels_col: str, scores_col: str) -> DataFrame:
    """Parallel label and score arrays -> (id, label, score)."""
    return df.select(id_col, F.explode(F.arrays_zip(
        F.col(labels_col).alias("label"), F.col(scores_col).alias("score"))).alias("p")).select(
        id_col, F.col("p.label").alias("label"), F.col("p.score").alias("score"))


def matrix_long(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One array per row -> (row, column, value)."""
    return df.select(id_col, F.posexplode(vector_col).alias("column", "value"))
