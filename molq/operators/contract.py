"""Standardise molecule tables from many producers into one contract, filter, and sample."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molq.functions import expr as X
from molq.functions.ordering import dense_index, hashed_sample
from molq.functions.tokens import (OPTIONAL_COLUMNS, REQUIRED_COLUMNS, UNASSIGNED, tokens)
from molq.session import cut_lineage, stored_table

# Older second contract -> present names.
ALIASES = {"x_location": "x", "y_location": "y", "z_location": "z", "gene": "feature_name",
           "cell_id_method": "cell_id", "cell_id_xenium_default": "original_cell_id"}


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are present, unless the target name already is."""
    present = {a: b for a, b in mapping.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(present)


def _number(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string").try_cast("double").cast("float")


def standardize_transcripts(df: DataFrame, method: str,
                            rename_map: Mapping[str, str] | None = None,
                            unassigned_tokens="core",
                            unassigned_extra: Sequence[str] = ()) -> DataFrame:
    """Coerce any molecule table to the contract: casts, one unassigned token, column order."""
    df = df.withColumnsRenamed(dict(rename_map or {}))
    missing = {"x", "y", "feature_name", "cell_id"} - set(df.columns)
    if missing:
        raise ValueError(f"a molecule table needs {', '.join(sorted(missing))}; found only {', '.join(df.columns)}")
    cols = {"method": F.lit(method), "x": _number(df, "x"), "y": _number(df, "y"),
            "feature_name": F.col("feature_name").cast("string"),
            "cell_id": X.normalize_unassigned("cell_id", unassigned_tokens, unassigned_extra)}
    if "z" in df.columns:
        cols["z"] = F.coalesce(_number(df, "z"), F.lit(0).cast("float"))
    if "overlaps_nucleus" in df.columns:
        flag = F.col("overlaps_nucleus")
        if isinstance(df.schema["overlaps_nucleus"].dataType, T.BooleanType):
            flag = flag.cast("int")
        cols["overlaps_nucleus"] = F.coalesce(
            flag.cast("string").try_cast("double"), F.lit(0.0)).cast("tinyint")
    if "qv" in df.columns:
        cols["qv"] = _number(df, "qv")
    if "original_cell_id" in df.columns:
        cols["original_cell_id"] = F.col("original_cell_id").cast("string")
    out = df.withColumns(cols)
    if "whole_partial_status" not in df.columns:
        out = out.withColumn("whole_partial_status", F.when(
            F.col("cell_id") == UNASSIGNED, "unassigned").otherwise("whole"))
    order = [c for c in (*REQUIRED_COLUMNS, *OPTIONAL_COLUMNS) if c in out.columns]
    return out.select(*order, *[c for c in out.columns if c not in order])


# Columns of the older contract, their types and fillers.
TRANSCRIPT_DEFAULTS: dict[str, tuple[str, object]] = {
    "z_location": ("double", 0.0), "qv": ("double", None), "overlaps_nucleus": ("int", None),
    "cell_id_xenium_default": ("string", None), "assignment_source": ("string", None),
}
CELL_DEFAULTS: dict[str, tuple[str, object]] = {
    "centroid_x": ("double", None), "centroid_y": ("double", None),
    "n_transcripts": ("long", None), "n_genes": ("long", None), "area": ("double", None),
}


def _fill_columns(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    return df.withColumns({name: F.lit(value).cast(kind)
                           for name, (kind, value) in defaults.items() if name not in df.columns})


def ensure_transcript_columns(df: DataFrame, method: str) -> DataFrame:
    """Fill the columns the older contract expects; ids become strings."""
    out = _fill_columns(df, TRANSCRIPT_DEFAULTS)
    if "transcript_id" not in out.columns:
        # Numbered once and stored, so later scans and joins see the same ids.
        out = dense_index(out, out.columns, "transcript_id")
    if "method" not in out.columns:
        out = out.withColumn("method", F.lit(method))
    return out.withColumn("cell_id_method", F.col("cell_id_method").cast("string"))


def ensure_cell_columns(df: DataFrame, method: str) -> DataFrame:
    out = _fill_columns(df, CELL_DEFAULTS)
    return out.withColumns({"cell_id": F.col("cell_id").cast("string"), "method": F.lit(method)})


def validate_schema(df: DataFrame, method: str) -> DataFrame:
    """One report row; raises when a required column is missing."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the contract asks for {', '.join(missing)}, which the table lacks")
    assigned = F.col("cell_id") != UNASSIGNED
    optional = [c for c in OPTIONAL_COLUMNS if c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("n_transcripts_total"),
        F.count_if(assigned).alias("n_transcripts_assigned"),
        F.count_if(~assigned).alias("n_transcripts_unassigned"),
        F.countDistinct(F.when(assigned, F.col("cell_id"))).alias("n_unique_cells"),
    ).select(
        F.lit(method).alias("method"), F.lit(True).alias("schema_valid"),
        F.lit(",".join(optional)).alias("optional_columns_present"),
        "n_transcripts_total", "n_transcripts_assigned", "n_transcripts_unassigned",
        F.coalesce(X.safe_div("n_transcripts_assigned", "n_transcripts_total"), F.lit(0.0))
        .alias("frac_assigned"), "n_unique_cells")


# --- filters --------------------------------------------------------------

# Case-sensitive control names used when no gene flag is present.
CONTROL_PATTERN = r"^(BLANK_|NegControl|Codeword|antisense_|UnassignedCodeword)"


def filter_controls(df: DataFrame, pattern: str = CONTROL_PATTERN) -> DataFrame:
    """Drop control features, by the ``is_gene`` flag when present, else by name pattern."""
    if "is_gene" in df.columns:
        return df.where(X.truthy("is_gene"))
    return df.where(~F.col("feature_name").cast("string").rlike(pattern))


def filter_controls_prefix(df: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    flag = X.is_control("feature_name", prefixes) if prefixes else X.is_control("feature_name")
    return df.where(~flag)


def filter_quality(df: DataFrame, min_qv: float) -> DataFrame:
    return df.where(F.col("qv") >= float(min_qv)) if "qv" in df.columns else df


def filter_box_closed(df: DataFrame, x: str = "x", y: str = "y", **roi) -> DataFrame:
    return df.where(X.box_closed(x, y, **roi))


# Entity classes per bucket.
WHOLE_CLASSES = ("cell",)
PARTIAL_CLASSES = ("partial", "component", "rescued_component")


def filter_entity_class(df: DataFrame, mode: str, entity_col: str = "etype") -> DataFrame:
    """Keep whole or partial entities; a table without the class column passes unchanged."""
    if entity_col not in df.columns:
        return df
    kind = F.col(entity_col).cast("string")
    rules = {"whole_cells_only": kind.isin(*WHOLE_CLASSES),
             "partial_cells_only": kind.isin(*PARTIAL_CLASSES),
             "all_entities": F.lit(True)}
    if mode not in rules:
        raise ValueError(f"unknown entity mode {mode!r}")
    return df.where(rules[mode])


def entity_class_counts(df: DataFrame, mode: str, entity_col: str = "etype") -> DataFrame:
    kind = F.col(entity_col).cast("string")
    whole, partial = kind.isin(*WHOLE_CLASSES), kind.isin(*PARTIAL_CLASSES)
    keep = {"whole_cells_only": whole, "partial_cells_only": partial,
            "all_entities": F.lit(True)}[mode]
    n = F.count(F.lit(1))
    w, p = (F.count_if(F.coalesce(c, F.lit(False))) for c in (whole, partial))
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    return df.agg(n.alias("n_total"), w.alias("n_whole_cells_transcripts"),
                  p.alias("n_partial_cells_transcripts"), (n - w - p).alias("n_other_transcripts"),
                  kept.alias("n_kept_after_entity_filter"),
                  (n - kept).alias("n_excluded_by_entity_filter"))


def resolve_gene_set(mode: str, post: DataFrame, pre: DataFrame | None = None,
                     reference: DataFrame | None = None) -> DataFrame:
    """Feature universe: panel (union pre/post), union cut to the reference, or intersection."""
    names = lambda df: df.select(F.col("feature_name").cast("string")).distinct()
    genes = names(post)
    if mode in ("spatial_panel", "all_shared_genes"):
        if pre is not None:
            genes = genes.union(names(pre)).distinct()
        if mode == "all_shared_genes" and reference is not None:
            genes = genes.intersect(names(reference))
        return genes
    if mode == "intersect_reference":
        if reference is None:
            raise ValueError("intersect_reference needs a reference table")
        if pre is not None:
            genes = genes.intersect(names(pre))
        return genes.intersect(names(reference))
    raise ValueError(f"unknown gene mode {mode!r}")


def label_column(df: DataFrame, requested: str | None = None,
                 priority: Sequence[str] = ("stitched", "cell_id")) -> str:
    """The entity key to use: the requested one, else the first of the priority list."""
    candidates = [requested] if requested is not None else list(priority)
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no label column among {candidates}; columns present: {df.columns}")


# --- producer adapters ----------------------------------------------------

def adapt_molecule_csv(seg: DataFrame, source: DataFrame | None = None,
                       method: str = "molecule_csv") -> DataFrame:
    """Blank cell or noise flag means unassigned; provenance comes back through the 1-based
    ``molecule_id`` when it is a clean index into ``source.row_idx``."""
    # Spellings of a blank assignment.
    blank = ("", "0", "nan", "<NA>", "NA")
    cell = F.col("cell" if "cell" in seg.columns else "cell_id").cast("string")
    noise = X.truthy("is_noise") if "is_noise" in seg.columns else F.lit(False)
    optional = [c for c in ("assignment_confidence", "molecule_id") if c in seg.columns]
    frame = seg.select(
        "x", "y", (F.col("z") if "z" in seg.columns else F.lit(0.0)).alias("z"),
        F.col("gene" if "gene" in seg.columns else "feature_name").alias("feature_name"),
        F.when(cell.isNull() | cell.isin(*blank) | noise, UNASSIGNED).otherwise(cell)
        .alias("cell_id"), *optional)
    if source is not None and "molecule_id" in frame.columns:
        from molq.operators.joins import positional_join
        frame = positional_join(frame, source, "molecule_id", {
            "transcript_id": "transcript_id", "qv": "qv",
            "overlaps_nucleus": "overlaps_nucleus", "cell_id": "original_cell_id"})
    return standardize_transcripts(frame.drop("molecule_id"), method)


def adapt_max_id(df: DataFrame, method: str = "max_id", id_col: str = "assignment") -> DataFrame:
    """The producer marks unassigned molecules with the largest integer id."""
    top = df.agg(F.max(F.col(id_col).try_cast("long")).alias("top")).scalar()
    cell = F.col(id_col).try_cast("long")
    out = df.withColumn("cell_id_method", F.when(cell == top, UNASSIGNED)
                        .otherwise(cell.cast("string")))
    return out.drop(id_col).withColumns({"method": F.lit(method),
                                         "assignment_source": F.lit(method)})


def adapt_background(df: DataFrame, cell_map: DataFrame | None = None, prefix: str = "",
                     method: str = "background") -> DataFrame:
    """Null, blank or background rows are unassigned; observed coordinates win over denoised
    ones; producer ids map back to original ids through ``cell_map(cell, original_cell_id)``."""
    raw = F.col("assignment").cast("string")
    background = X.truthy("background") if "background" in df.columns else F.lit(False)
    cell = F.when(raw.isNull() | (raw == "") | background, UNASSIGNED) \
            .otherwise(F.concat(F.lit(prefix), raw))
    cols = {"cell_id": cell, "_raw": raw}
    for axis in ("x", "y", "z"):
        if f"observed_{axis}" in df.columns:
            cols[axis] = F.col(f"observed_{axis}")
    out = df.withColumns(cols).drop("observed_x", "observed_y", "observed_z", "assignment",
                                    "background")
    if cell_map is not None:
        ids = cell_map.select(F.col("cell").cast("string").alias("_cell"),
                              F.col("original_cell_id").cast("string"))
        key = F.when(F.col("cell_id") != UNASSIGNED, F.col("_raw"))
        out = out.join(ids, key == F.col("_cell"), "left").drop("_cell")
    return standardize_transcripts(out.drop("_raw"), method, {"gene": "feature_name"}
                                   if "gene" in out.columns else None)


def adapt_predicted(df: DataFrame, method: str = "predicted",
                    id_col: str = "predicted_cell_id") -> DataFrame:
    out = rename(df.withColumn("cell_id", F.col(id_col).cast("string")).drop(id_col),
                 {"x_location": "x", "y_location": "y", "z_location": "z"})
    return standardize_transcripts(out, method)


def adapt_retained_removed(retained: DataFrame, removed: DataFrame,
                           method: str = "cleaned") -> DataFrame:
    """Two tables become one: removed molecules are unassigned but keep their original id."""
    def part(df: DataFrame, status: str, cell: Column) -> DataFrame:
        return df.select("x", "y", (F.col("z") if "z" in df.columns else F.lit(0.0)).alias("z"),
                         F.col("gene").cast("string").alias("feature_name"),
                         F.col("cell").cast("string").alias("original_cell_id"),
                         F.col("mol_id").alias("transcript_id"), cell.alias("cell_id"),
                         F.lit(status).alias("cleaned_status"))
    both = part(retained, "retained", F.col("cell").cast("string")).unionByName(
        part(removed, "cleaned_to_unassigned", F.lit(UNASSIGNED)))
    return standardize_transcripts(both, method)


def adapt_bins(bins: DataFrame, bin_counts: DataFrame, labels: DataFrame,
               method: str = "bins", placeholder: str = "bin") -> DataFrame:
    """One row per bin: summed counts and the label the bin fell into."""
    totals = bin_counts.groupBy("bin_id").agg(F.sum("count").cast("float").alias("n_counts_bin"))
    out = (bins.join(totals, "bin_id", "left").join(labels.select("bin_id", "cell_id"),
                                                     "bin_id", "left")
           .withColumns({"feature_name": F.lit(placeholder),
                         "n_counts_bin": F.coalesce("n_counts_bin", F.lit(0.0).cast("float")),
                         "transcript_id": F.col("bin_id").cast("string")}).drop("bin_id"))
    return standardize_transcripts(out, method, unassigned_extra=("0", "0.0", "nan", "-1"))


def adapt_row_predictions(source: DataFrame, pred: DataFrame,
                          row_col: str = "row_idx") -> DataFrame:
    """Assign where a prediction exists and its similarity reaches its own threshold.

    ``pred`` must hold one row per index: a duplicate fails the job.
    """
    has_threshold = {"similarity", "similarity_threshold"} <= set(pred.columns)
    keep = [c for c in ("similarity", "similarity_threshold") if c in pred.columns]
    single = pred.groupBy(F.col(row_col).alias("_row")).agg(
        F.count(F.lit(1)).alias("_n"), F.first("predicted_cell_id").alias("_pred"),
        *[F.first(c).alias(c) for c in keep])
    single = single.withColumn("_pred", F.when(
        F.col("_n") > 1, F.raise_error(F.lit("row index is not unique in the predictions"))
        .cast("string")).otherwise(F.col("_pred").cast("string")))
    good = F.col("_pred").isNotNull()
    if has_threshold:
        good = good & (F.col("similarity") >= F.col("similarity_threshold"))
    return (source.join(single, F.col(row_col) == F.col("_row"), "left")
            .withColumn("original_cell_id", F.col("cell_id").cast("string"))
            .withColumn("cell_id", F.when(good, F.col("_pred")).otherwise(UNASSIGNED))
            .withColumn("whole_partial_status", F.when(F.col("cell_id") == UNASSIGNED,
                                                       "unassigned").otherwise("whole"))
            .drop("_row", "_n", "_pred"))


# --- counts and references ------------------------------------------------

def normalize_counts_integer(counts: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Round half-even and drop zeros; ``was_fractional`` on a kept row tells rounding changed
    it. Works on the long table, so nothing is densified."""
    rounded = F.bround(F.col("count").cast("double"), 0)
    return (counts.withColumn("was_fractional", F.abs(F.col("count") - rounded) > tol)
            .withColumn("count", rounded).where(F.col("count") != 0))


def counts_are_fractional(counts: DataFrame, tol: float = 1e-8) -> DataFrame:
    c = F.col("count").cast("double")
    return counts.agg(F.coalesce(F.max(F.abs(c - F.bround(c, 0)) > tol), F.lit(False))
                      .alias("counts_are_fractional"))


def drop_celltypes(ref_obs: DataFrame, names: Sequence[str],
                   label_col: str = "cell_type") -> DataFrame:
    return ref_obs.where(~F.coalesce(F.col(label_col).cast("string").isin(*names), F.lit(False)))


def restrict_genes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    return counts.join(genes.select("feature_name").distinct(), "feature_name", "left_semi")


# --- samples and crops ----------------------------------------------------

def subsample(df: DataFrame, n: int, seed: int, key: str = "transcript_id") -> DataFrame:
    """Exactly n rows (or all), chosen by hashed key, the same every run."""
    return hashed_sample(df, n, seed, key)


def extent_center_box(df: DataFrame, fraction: float, x: str = "x", y: str = "y") -> DataFrame:
    """One row with the central box that keeps sqrt(fraction) of each axis."""
    side = math.sqrt(fraction)
    e = df.agg(*[f(c).alias(f"{c}_{n}") for c in (x, y)
                 for n, f in (("min", F.min), ("max", F.max))])
    mid = lambda c: (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2
    half = lambda c: (F.col(f"{c}_max") - F.col(f"{c}_min")) * side / 2
    return e.select(*[(mid(c) + sign * half(c)).alias(f"{c}_{n}")
                      for c in (x, y) for n, sign in (("lo", -1), ("hi", 1))])


def centred_crop(df: DataFrame, fraction: float, x: str = "x", y: str = "y") -> DataFrame:
    """Closed central crop. The bounds are a one-row scalar subquery, never a join."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    box = extent_center_box(df, fraction, x, y)
    side = {c: box.select(c).scalar() for c in box.columns}
    return df.where((F.col(x) >= side[f"{x}_lo"]) & (F.col(x) <= side[f"{x}_hi"])
                    & (F.col(y) >= side[f"{y}_lo"]) & (F.col(y) <= side[f"{y}_hi"]))


def center_subset(df: DataFrame, span: float, n: int, seed: int = 0,
                  key: str = "transcript_id") -> DataFrame:
    """A box of side ``span`` around the extent midpoint, then a seeded sample of n rows.
    When the box is empty the first n keys stand in."""
    e = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
               F.min("y").alias("y0"), F.max("y").alias("y1"))
    # The extent and the box are read several times below, so each is derived once.
    mid = cut_lineage(e.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")))
    mid_x, mid_y = mid.select("x").scalar(), mid.select("y").scalar()
    inside = (F.abs(F.col("x") - mid_x) <= span / 2) & (F.abs(F.col("y") - mid_y) <= span / 2)
    box = stored_table(df.where(inside), "box")
    if box.isEmpty():
        return dense_index(df, [key], "_place").where(F.col("_place") < n).drop("_place")
    return hashed_sample(box, n, seed, key)


def clear_nuclear_flag(df: DataFrame) -> DataFrame:
    """Nucleus flag := 0 where the molecule is unassigned."""
    return df.withColumn("overlaps_nucleus", F.when(X.is_unassigned("cell_id"), F.lit(0))
                         .otherwise(F.col("overlaps_nucleus")))


def nuclear_flag_changes(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(X.is_unassigned("cell_id") & (F.col("overlaps_nucleus") != 0))
                  .alias("n_cleared"))


def bundle_subset(transcripts: DataFrame, cells: DataFrame, keep: DataFrame) -> dict[str, DataFrame]:
    """Every bundle table restricted to the kept entities; counts rebuilt from the molecules."""
    ids = keep.select("cell_id").distinct()
    tx = transcripts.join(ids, "cell_id", "left_semi")
    return {"transcripts": tx, "cells": cells.join(ids, "cell_id", "left_semi"),
            "cell_gene": tx.groupBy("cell_id", "feature_name").agg(
                F.count(F.lit(1)).alias("count"))}


def entity_codes(df: DataFrame, id_col: str = "cell_id", preset="core") -> DataFrame:
    """(cell_id, code): dense 0-based integer codes in id order, kept as a table.

    Ids are range-partitioned and numbered by partition offset, so no task sees them all."""
    ids = (df.where(~X.is_unassigned(id_col, preset))
           .select(F.col(id_col).cast("string").alias(id_col)).distinct())
    return dense_index(ids, [id_col], "code")


def attach_codes(df: DataFrame, codes: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """-1 for unassigned molecules."""
    return (df.join(codes, id_col, "left")
            .withColumn("code", F.coalesce(F.col("code"), F.lit(-1).cast("long"))))
