"""Joins of the data contract. Join strategy is left to Catalyst and AQE, which broadcast a
side only when its measured size allows; ``windows_join`` counts its boxes itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions.ordering import dense_index
from molq.session import shuffle_width

MOLECULE = "transcript_id"
MEET_ROWS = 25_000  # molecules of a task that meet boxes
MEET_BOXES = 1_000_000  # (box, tile) rows that every task may hold, about 100 bytes each


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """A stored dense 0-based row index in the given order."""
    return dense_index(df, order, name)


def provenance_join(df: DataFrame, vendor: DataFrame, on: str = "transcript_id",
                    vendor_cell: str = "cell_id", out: str = "original_cell_id") -> DataFrame:
    """Bring the vendor's cell id by molecule id."""
    ids = vendor.select(on, F.col(vendor_cell).alias(out))
    return df.drop(out).join(ids, on, "left")


def positional_join(df: DataFrame, source: DataFrame, index_col: str,
                    take: Mapping[str, str], base: int = 1, row_col: str = "row_idx") -> DataFrame:
    """Look rows up by position, only if the index is unique and in range; otherwise the
    columns stay absent in value (NULL), because a partial mapping would be wrong silently."""
    n_source = source.agg(F.count(F.lit(1))).scalar()
    pos = F.col(index_col).cast("string").try_cast("double").cast("long") - base
    # Two-step distinct: partial aggregation, then one row per index value.
    per = df.select(pos.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    clean = per.agg(F.coalesce(
        (F.max("n") == 1) & (F.min("p") >= 0) & (F.max("p") < n_source)
        & (F.count_if(F.col("p").isNull()) == 0), F.lit(False))).scalar()
    have = {a: b for a, b in take.items() if a in source.columns}
    rows = source.select(F.col(row_col).alias("_row"),
                         *[F.col(a).alias(f"_{b}") for a, b in have.items()])
    joined = df.withColumn("_pos", pos).join(rows, F.col("_pos") == F.col("_row"), "left")
    return joined.withColumns({b: F.when(clean, F.col(f"_{b}")) for b in have.values()}).drop(
        "_pos", "_row", *[f"_{b}" for b in have.values()])


def reattach_quality(df: DataFrame, source: DataFrame, on: str = "transcript_id",
                     col: str = "qv") -> DataFrame:
    return df.drop(col).join(source.select(on, col), on, "left")


def map_ids(df: DataFrame, mapping: DataFrame, id_col: str, old: str, new: str) -> DataFrame:
    """Producer id -> other id, both compared as strings."""
    m = mapping.select(F.col(old).cast("string").alias("_old"), F.col(new).alias(new))
    return df.join(m, F.col(id_col).cast("string") == F.col("_old"), "left").drop("_old")


def verified_total_join(left: DataFrame, right: DataFrame, on: str, prior: str, prior_check: str,
                        delivered: str, produced: str, min_agree: float = 0.95,
                        max_prior: float = 0.05) -> DataFrame:
    """Report of a 1:1 total join. ``left``: on, delivered. ``right``: on, prior, prior_check,
    produced. Fails unless keys are unique and complete on both sides, the two priors agree,
    the delivered ids match the producer's output, and they are not already the prior."""
    l = left.groupBy(on).agg(F.count(F.lit(1)).alias("_nl"), F.first(delivered).alias("_d"))
    r = right.groupBy(on).agg(F.count(F.lit(1)).alias("_nr"), F.first(prior).alias("_p"),
                              F.first(prior_check).alias("_q"), F.first(produced).alias("_o"))
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    report = l.join(r, on, "full").agg(
        F.count(F.lit(1)).alias("n_molecules"),
        F.count_if(F.col("_nl").isNull() | F.col("_nr").isNull()).alias("n_unmapped"),
        F.count_if((F.col("_nl") > 1) | (F.col("_nr") > 1)).alias("n_duplicated"),
        share(F.col("_p") == F.col("_q")).alias("agreement_with_prior"),
        share(F.col("_d") == F.col("_o")).alias("delivered_equals_output"),
        share(F.col("_d") == F.col("_p")).alias("delivered_equals_prior"))
    problem = (F.when(F.col("n_unmapped") > 0, "unmapped molecules after the join")
               .when(F.col("n_duplicated") > 0, "join key is not unique")
               .when(F.col("agreement_with_prior") < min_agree, "the prior identity is unclear")
               .when(F.col("delivered_equals_output") < min_agree,
                     "delivered ids do not match the producer's output")
               .when(F.col("delivered_equals_prior") > max_prior,
                     "delivered ids already are the prior"))
    return report.withColumn("checked", F.when(
        problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise("1:1 and total"))


def semi_join_features(df: DataFrame, genes: DataFrame) -> DataFrame:
    return df.join(genes.select("feature_name").distinct(), "feature_name", "left_semi")


def semi_join_cells(df: DataFrame, cells: DataFrame, on: str = "cell_id") -> DataFrame:
    return df.join(cells.select(on).distinct(), on, "left_semi")


def exclude_cells(df: DataFrame, excluded: DataFrame, on: str = "cell_id") -> DataFrame:
    """Anti-join on a set of ids that is made distinct first, so it is m:1 by construction."""
    return df.join(excluded.select(on).distinct(), on, "left_anti")


def keep_polygon_cells(df: DataFrame, polygons: DataFrame, on: str = "cell_id") -> DataFrame:
    """Drop molecules whose non-null cell has no polygon; molecules without a cell stay."""
    ids = polygons.select(F.col(on).alias("_poly")).distinct()
    return (df.join(ids, F.col(on) == F.col("_poly"), "left")
            .where(F.col(on).isNull() | F.col("_poly").isNotNull()).drop("_poly"))


def panel_with_genes(panel: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges whose two endpoints are both measured."""
    g = genes.select("feature_name").distinct()
    return (panel.join(g.withColumnRenamed("feature_name", "gene_i"), "gene_i", "left_semi")
            .join(g.withColumnRenamed("feature_name", "gene_j"), "gene_j", "left_semi"))


def panel_filter_statistics(panel: DataFrame, genes: DataFrame) -> DataFrame:
    """Edge and feature counts before and after, and measured features absent from the panel."""
    ends = lambda p: p.select("gene_i").union(p.select("gene_j")).distinct().toDF("feature_name")
    kept = panel_with_genes(panel, genes)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    measured = genes.select("feature_name").distinct()
    return panel.agg(F.count(F.lit(1)).alias("n_edges_in")).withColumns({
        "n_edges_kept": count(kept), "n_genes_in_panel": count(ends(panel)),
        "n_genes_kept": count(ends(kept)), "n_genes_measured": count(measured),
        "n_genes_measured_not_in_panel": count(
            measured.join(ends(panel), "feature_name", "left_anti"))}).withColumn(
        "edge_retention", X.safe_div("n_edges_kept", "n_edges_in"))


def in_union_box(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Molecules inside the box around all windows. It is four numbers read from the manifest, so this is a plain
    filter that reaches the Parquet scan and skips row groups."""
    limit = windows.agg(*[f(c).cast("double").alias(c) for c, f in (
        ("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))]).first()
    return df.where((F.col("x") >= limit["xmin"]) & (F.col("x") < limit["xmax"])
                    & (F.col("y") >= limit["ymin"]) & (F.col("y") < limit["ymax"]))


def box_tiles(windows: DataFrame, tile: float, carry: Sequence[str]) -> DataFrame:
    """(carry..., xmin, xmax, ymin, ymax, _tx, _ty): every tile a box touches."""
    t = F.lit(float(tile))
    return windows.select(
        *carry, *[F.col(c).cast("double").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")],
        F.explode(F.sequence(F.floor(F.col("xmin") / t), F.floor(F.col("xmax") / t))).alias("_tx"),
        F.sequence(F.floor(F.col("ymin") / t), F.floor(F.col("ymax") / t)).alias("_ys"),
    ).withColumn("_ty", F.explode("_ys")).drop("_ys")


def tiled(df: DataFrame, tile: float) -> DataFrame:
    """Adds the one tile of each molecule."""
    t = F.lit(float(tile))
    return df.withColumns({"_tx": F.floor(F.col("x") / t), "_ty": F.floor(F.col("y") / t)})


def _inside() -> Column:
    return ((F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax"))
            & (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax")))


def windows_join(df: DataFrame, windows: DataFrame, tile: float,
                 carry: Sequence[str] = ("roi_id",)) -> DataFrame:
    """Molecules in any of N half-open boxes; one row per (molecule, box).

    Boxes are cut into grid tiles, so this is an equi-join on the tile with a residual box
    test for any number of boxes: each box lists the tiles it touches, each molecule has one
    tile. Molecules are dealt by place before they meet the boxes, since each may make many rows: a task has few of
    them, copies of a place are shared by their ids (without ids all rows are dealt evenly), and derived columns are made
    once per molecule. Rows leave in order of place: neighbours lie in nearly the same boxes, so whoever writes
    the rows finds runs of ids and lists of boxes that repeat, and a task's ids fit one dictionary. Up to ``MEET_BOXES``
    the boxes go to the molecules, which a join by tile would put in other tasks.
    """
    place, inside = ["_ty", "_tx", "y", "x"], in_union_box(df, windows)
    n = max(shuffle_width(df), -(-inside.count() // MEET_ROWS))
    near = tiled(inside, tile)
    near = near.repartitionByRange(n, *place, F.xxhash64(MOLECULE)) if MOLECULE in df.columns else near.repartition(n)
    # The condition holds for all rows. The optimiser drops an order below a join, unless such a condition is between them.
    ordered = near.sortWithinPartitions(*place).where(F.spark_partition_id() >= 0)
    key = lambda d: d.withColumn("_tile", F.shiftleft("_ty", 32) + F.col("_tx")).drop("_tx", "_ty")
    boxes = key(box_tiles(windows, tile, carry))
    return (key(ordered).join(F.broadcast(boxes) if boxes.count() <= MEET_BOXES else boxes, "_tile").where(_inside())
            .drop("_tile", "xmin", "xmax", "ymin", "ymax"))


def windows_cut(df: DataFrame, windows: DataFrame, tile: float,
                carry: Sequence[str] = ("roi_id",)) -> DataFrame:
    """The rows of ``windows_join``, those of one box together, for a writer that keeps boxes apart.

    Boxes that touch the same tiles share a home. A molecule is sent once to each home of its tile, not once per box,
    and meets the boxes there, so one task has the rows of a box and one file is made of it."""
    bounds = ["xmin", "xmax", "ymin", "ymax"]
    home = [f"_{c}" for c in bounds]
    boxes = windows.select(*carry, *[F.col(c).cast("double").alias(c) for c in bounds],
                           *[F.floor(F.col(c) / F.lit(float(tile))).alias(h) for c, h in zip(bounds, home)])
    tiles = (boxes.select(*home).distinct().withColumn("_tx", F.explode(F.sequence("_xmin", "_xmax")))
             .withColumn("_ty", F.explode(F.sequence("_ymin", "_ymax"))))
    near = tiled(in_union_box(df, windows), tile).join(tiles, ["_tx", "_ty"]).repartition(shuffle_width(df), *home)
    return near.join(boxes, home).where(_inside()).drop("_tx", "_ty", *home, *bounds)


def raster_lookup(df: DataFrame, raster: DataFrame, value: str = "signal_integrity") -> DataFrame:
    """Attach a pixel value. ``raster(y_pixel, x_pixel, value)`` is a long table and must cover
    exactly the molecules' pixel extent, with the axes in this order."""
    span = lambda d, c: d.agg(F.max(c)).scalar()
    wrong = ((span(df, "y_pixel") != span(raster, "y_pixel"))
             | (span(df, "x_pixel") != span(raster, "x_pixel")))
    out = df.join(raster.select("y_pixel", "x_pixel", value), ["y_pixel", "x_pixel"], "left")
    return out.withColumn(value, F.when(wrong, F.raise_error(
        F.lit("raster shape does not match the molecules; axes may be swapped")).cast("double"))
        .otherwise(F.col(value)))


def matched_population(scored: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """Ids present in every (listed) method."""
    rows = scored if methods is None else scored.where(F.col("method").isin(*methods))
    n = F.lit(len(methods)) if methods is not None else \
        scored.agg(F.countDistinct("method")).scalar()
    return (rows.select("cell_id", "method").distinct().groupBy("cell_id")
            .agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == n).select("cell_id"))


def comparability(scored: DataFrame, vendor_ids: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Share of each method's ids that are vendor ids, with a reason below the limit."""
    ref = vendor_ids.select("cell_id").distinct().withColumn("_hit", F.lit(1.0))
    share = F.avg(F.coalesce(F.col("_hit"), F.lit(0.0)))
    ids = scored.select("method", "cell_id").distinct()
    out = ids.join(ref, "cell_id", "left").groupBy("method").agg(
        F.count(F.lit(1)).alias("n_ids"), share.alias("share_vendor_ids"))
    return out.withColumns({
        "comparable": F.col("share_vendor_ids") >= min_share,
        "reason": F.when(F.col("share_vendor_ids") < min_share, F.format_string(
            "re-segmentation: only %.1f%% of its cell ids are vendor ids, so no cell-for-cell "
            "match exists", F.col("share_vendor_ids") * 100))})


def pre_post_full_join(pre: DataFrame, post: DataFrame, on: str,
                       cols: Sequence[str]) -> DataFrame:
    side = lambda df, s: df.select(on, *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side(pre, "pre").join(side(post, "post"), on, "full")


def join_meta_flags(cells: DataFrame, flags: DataFrame, flag_cols: Sequence[str],
                    on: str = "cell_id") -> DataFrame:
    """Left join of per-cell flags; a cell without a row gets false."""
    return cells.join(flags.select(on, *flag_cols), on, "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in flag_cols})


def align_labels(cells: DataFrame, labels: DataFrame, label: str = "cell_type") -> DataFrame:
    """Labels onto cells with both ids forced to string."""
    ids = labels.select(F.col("cell_id").cast("string").alias("cell_id"), label)
    return cells.withColumn("cell_id", F.col("cell_id").cast("string")).join(
        ids, "cell_id", "left")


def gap_detection(rois: DataFrame, methods: DataFrame, produced: DataFrame,
                  reasons: DataFrame) -> DataFrame:
    """Expected (ROI, method) combinations that were not produced, with the recorded reason.
    The expectation is built by attaching the short method list to every ROI row."""
    names = methods.agg(F.sort_array(F.collect_set("method"))).scalar()
    expected = rois.select("roi_id").distinct().withColumn("method", F.explode(names))
    missing = expected.join(produced.select("roi_id", "method").distinct(),
                            ["roi_id", "method"], "left_anti")
    return missing.join(reasons, ["roi_id", "method"], "left").withColumn(
        "explained", F.col("reason").isNotNull())


def canonical_name(c, suffix: str = "_seg") -> Column:
    """``x`` and ``x_seg`` are the same producer."""
    return F.regexp_replace(X.col(c), f"{suffix}$", "")


def canonical_join(left: DataFrame, right: DataFrame, on: str = "method") -> DataFrame:
    key = right.withColumn("_key", canonical_name(on)).drop(on)
    return left.withColumn("_key", canonical_name(on)).join(key, "_key", "left").drop("_key")


def complete_universe(counts: DataFrame, original: DataFrame) -> DataFrame:
    """Features a method did not measure are inherited from the original counts of the same
    entities; the rest of the universe stays an implicit zero."""
    have = counts.select("feature_name").distinct()
    ids = counts.select("cell_id").distinct()
    filler = original.join(have, "feature_name", "left_anti").join(ids, "cell_id", "left_semi")
    return counts.select("cell_id", "feature_name", "count").unionByName(
        filler.select("cell_id", "feature_name", "count"))


def cluster_labels_onto(df: DataFrame, clusters: DataFrame, keep_unlabelled: bool) -> DataFrame:
    """Left join for cells, inner join for molecules (which drops unlabelled ones)."""
    return df.join(clusters.select("cell_id", "cluster"), "cell_id",
                   "left" if keep_unlabelled else "inner")


def typed_assignment_join(df: DataFrame, assignment: DataFrame, on: str = "transcript_id",
                          cell_col: str = "cell_id") -> DataFrame:
    """Join an assignment after casting both ids to string; a duplicate id fails the job."""
    one = assignment.groupBy(F.col(on).cast("string").alias(on)).agg(
        F.count(F.lit(1)).alias("_n"), F.first(cell_col).alias(cell_col))
    cell = F.when(F.col("_n") > 1, F.raise_error(F.lit("join would change the molecule count"))
                  .cast("string")).otherwise(F.col(cell_col))
    return (df.drop(cell_col).withColumn(on, F.col(on).cast("string")).join(one, on, "left")
            .withColumn(cell_col, cell).drop("_n"))
