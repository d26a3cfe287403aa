"""Density grids, window design and extraction, outlines, and neighbours in the plane."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molq.functions import expr as X
from molq.functions.blocks import _runs
from molq.functions.ordering import quantiles, top_k_per_group
from molq.operators.accounting import roi_receipt
from molq.operators.joins import box_tiles, in_union_box, tiled, windows_join
from molq.operators.ranking import nearest_to_quantile
from molq.session import cut_lineage, shuffle_width

# Density percentiles of the window picks.
QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """min / max of the finite coordinates."""
    return df.agg(*[f(X.finite(c)).alias(f"{c}{n}") for c in (x, y)
                    for n, f in (("min", F.min), ("max", F.max))])


def grid_spec(df: DataFrame, bin_size: float, x: str = "x", y: str = "y") -> DataFrame:
    """One row: origin snapped down to a bin multiple, and the number of bins per axis."""
    b = float(bin_size)
    e = extent(df, x, y)
    snap = lambda c: F.floor(F.col(c) / b) * b
    return e.select(F.lit(b).alias("bin"), snap(f"{x}min").alias("ox"), snap(f"{y}min").alias("oy"),
                    (F.floor((F.col(f"{x}max") - snap(f"{x}min")) / b) + 1).alias("nx"),
                    (F.floor((F.col(f"{y}max") - snap(f"{y}min")) / b) + 1).alias("ny"))


def _value(spec: DataFrame | Mapping[str, float], name: str) -> Column:
    return F.lit(spec[name]) if isinstance(spec, Mapping) else spec.select(name).scalar()


def bin_columns(spec, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    b = _value(spec, "bin")
    return (F.floor((F.col(y) - _value(spec, "oy")) / b).cast("long"),
            F.floor((F.col(x) - _value(spec, "ox")) / b).cast("long"))


def in_grid(spec, x: str = "x", y: str = "y") -> Column:
    """Finite coordinates inside the grid."""
    iy, ix = bin_columns(spec, x, y)
    ok = ((ix >= 0) & (ix < _value(spec, "nx")) & (iy >= 0) & (iy < _value(spec, "ny")))
    return F.coalesce(X.finite(x).isNotNull() & X.finite(y).isNotNull() & ok, F.lit(False))


def density_grid(df: DataFrame, spec, x: str = "x", y: str = "y") -> DataFrame:
    """(iy, ix, n): molecules per bin; one partially aggregated group-by."""
    iy, ix = bin_columns(spec, x, y)
    return (df.where(in_grid(spec, x, y)).groupBy(iy.alias("iy"), ix.alias("ix"))
            .agg(F.count(F.lit(1)).alias("n")))


def grid_counters(df: DataFrame, spec, x: str = "x", y: str = "y") -> DataFrame:
    good = X.finite(x).isNotNull() & X.finite(y).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("nonfinite"),
                  F.count_if(good & ~in_grid(spec, x, y)).alias("out_of_grid"))


def grid_summary(grid: DataFrame, spec) -> DataFrame:
    b = _value(spec, "bin")
    area = F.col("occupied_bins") * b * b / 1e6
    return grid.agg(F.count(F.lit(1)).alias("occupied_bins"), F.sum("n").alias("n_transcripts")).withColumns({
        "total_bins": _value(spec, "nx") * _value(spec, "ny"), "occupied_area_mm2": area,
        "density_per_mm2": X.safe_div("n_transcripts", area)})


def occupied_blocks(grid: DataFrame, spec, ks: Sequence[int]) -> DataFrame:
    """(k, window_iy, window_ix, count, occupancy) of the complete k x k blocks that hold a stored bin, for
    every k in one group-by. Incomplete edge blocks never enter."""
    k = F.col("k")
    fits = lambda window, bins: F.col(window) < F.floor(_value(spec, bins) / k)
    return (grid.withColumn("k", F.explode(F.array(*[F.lit(int(v)) for v in ks])))
            .withColumns({"window_iy": F.floor(F.col("iy") / k), "window_ix": F.floor(F.col("ix") / k)})
            .where(fits("window_iy", "ny") & fits("window_ix", "nx"))
            .groupBy("k", "window_iy", "window_ix")
            .agg(F.sum("n").alias("count"), (F.count_if(F.col("n") > 0) / (k * k)).alias("occupancy")))


def empty_blocks(blocks: DataFrame, spec, ks: Sequence[int], placed: bool = False) -> DataFrame:
    """One row per k that stands for all its blocks without a stored bin; ``windows`` is their number,
    from the bounds. ``placed`` finds the first of them in row-major order: the least position that is 0 or
    follows a stored block and is not stored itself."""
    zero = F.lit(0).cast("long")
    across = F.floor(_value(spec, "nx") / F.col("k"))
    sides = blocks.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    total = F.floor(_value(spec, "ny") / F.col("k")) * across
    out = (sides.join(blocks.groupBy("k").agg(F.count(F.lit(1)).alias("stored")), "k", "left")
           .withColumn("windows", total - F.coalesce("stored", zero)).where("windows > 0"))
    if placed:
        held = blocks.select("k", (F.col("window_iy") * across + F.col("window_ix")).alias("at"))
        after = sides.select("k", zero.alias("at")).unionByName(held.withColumn("at", F.col("at") + 1))
        first = after.join(held, ["k", "at"], "left_anti").groupBy("k").agg(F.min("at").alias("at"))
        out = out.join(first, "k").withColumn("window_iy", F.floor(F.col("at") / across)) \
                 .withColumn("window_ix", F.col("at") - F.col("window_iy") * across)
    else:
        out = out.withColumns({c: F.lit(None).cast("long") for c in ("window_iy", "window_ix")})
    return out.select("k", "window_iy", "window_ix", zero.alias("count"), F.lit(0.0).alias("occupancy"), "windows")


def block_reduce(grid: DataFrame, spec, k: int, empty: bool = True) -> DataFrame:
    """(window_iy, window_ix, count, occupancy) over complete k x k blocks.

    With ``empty`` every block of the bounds is a row; without it only those that hold a stored bin, so the
    table follows the tissue and not the farthest coordinate."""
    sums = occupied_blocks(grid, spec, [k]).drop("k")
    if not empty:
        return sums
    last = lambda bins: F.floor(_value(spec, bins) / int(k)) - 1
    numbers = lambda top: F.explode(F.when(top >= 0, F.sequence(F.lit(0).cast("long"), top)))
    blocks = (grid.sparkSession.range(1).select(numbers(last("ny")).alias("window_iy"))
              .select("window_iy", numbers(last("nx")).alias("window_ix")))
    return blocks.join(sums, ["window_iy", "window_ix"], "left").na.fill(0, ["count", "occupancy"])


def windows_with_density(grid: DataFrame, spec, bin_size: float, sides: Sequence[float],
                         placed: bool = False) -> DataFrame:
    """Window table of several sides: occupied windows one by one and, per side, one row for all empty ones;
    ``windows`` is how many windows a row stands for. ``placed`` gives the empty row its first place."""
    ks = {float(side): int(round(side / bin_size)) for side in sides}
    for side, k in ks.items():
        if k < 1 or abs(k * bin_size - side) > 1e-9:
            raise ValueError(f"side {side} is not a multiple of the {bin_size} bin")
    stored = cut_lineage(occupied_blocks(grid, spec, sorted(ks.values())))
    table = stored.withColumn("windows", F.lit(1).cast("long")).unionByName(
        empty_blocks(stored, spec, sorted(ks.values()), placed))
    side_of = F.create_map(*[F.lit(v) for side, k in ks.items() for v in (k, side)])
    return table.withColumn("side", side_of[F.col("k")]).withColumn(
        "area_mm2", F.col("side") * F.col("side") / 1e6).withColumn(
        "density", F.col("count") / F.col("area_mm2")).drop("k")


def window_ladder(grid: DataFrame, spec, bin_size: float, sides: Sequence[float],
                  occ_min: float) -> DataFrame:
    """Per side: windows, eligible windows, and densities at the quartiles."""
    table = windows_with_density(grid, spec, bin_size, sides)
    ok = F.col("occupancy") >= occ_min
    out = table.groupBy("side", "area_mm2").agg(
        F.sum("windows").alias("windows_total"),
        F.sum(F.when(ok, F.col("windows")).otherwise(0)).alias("windows_eligible"))
    q = quantiles(table.where(ok), "density", {f"{n}_density": p for n, p in QUARTILES.items()}, ["side"], "windows")
    return out.join(q, "side", "left")


def select_windows(grid: DataFrame, spec, bin_size: float, side: float, occ_min: float) -> DataFrame:
    """Half-open boxes nearest to the density quartiles of the eligible windows; ties go
    row-major."""
    table = windows_with_density(grid, spec, bin_size, [side], placed=occ_min <= 0)
    eligible = table.where(F.col("occupancy") >= occ_min)
    picks = nearest_to_quantile(eligible, "density", QUARTILES, ["window_iy", "window_ix"], "windows")
    ox, oy = _value(spec, "ox"), _value(spec, "oy")
    s = F.lit(float(side))
    return picks.select(
        F.col("pick").alias("roi_id"), "window_ix", "window_iy",
        (ox + F.col("window_ix") * s).alias("xmin"), (ox + (F.col("window_ix") + 1) * s).alias("xmax"),
        (oy + F.col("window_iy") * s).alias("ymin"), (oy + (F.col("window_iy") + 1) * s).alias("ymax"),
        "area_mm2", F.col("count").alias("n_transcripts_grid"),
        F.col("density").alias("density_per_mm2"), "occupancy", F.col("target").alias("target_density"))


def selection_stats(grid: DataFrame, spec, bin_size: float, side: float, occ_min: float) -> DataFrame:
    table = windows_with_density(grid, spec, bin_size, [side])
    ok = F.col("occupancy") >= occ_min
    out = table.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("windows_total"),
                    F.coalesce(F.sum(F.when(ok, F.col("windows"))), F.lit(0)).alias("windows_eligible"),
                    F.min(F.when(ok, F.col("density"))).alias("eligible_density_min"),
                    F.max(F.when(ok, F.col("density"))).alias("eligible_density_max"))
    med = quantiles(table.where(ok), "density", {"m": 0.5}, weight="windows")
    return out.withColumn("eligible_density_median", med.select("m").scalar())


def occupancy_distribution(grid: DataFrame, spec, k: int,
                           percents: Sequence[int] = (5, 10, 25, 50, 75, 90, 95)) -> DataFrame:
    table = windows_with_density(grid, spec, 1.0, [k])
    return quantiles(table, "occupancy", {f"p{p}": p / 100 for p in percents}, weight="windows")


def whole_tissue_window(grid: DataFrame, spec: DataFrame, df: DataFrame) -> DataFrame:
    """Manifest row of a dataset that is run without selection."""
    return grid_summary(grid, spec).select(
        F.lit("whole").alias("roi_id"),
        *[extent(df).select(c).scalar().alias(n) for c, n in (
            ("xmin", "xmin"), ("xmax", "xmax"), ("ymin", "ymin"), ("ymax", "ymax"))],
        F.col("occupied_area_mm2").alias("area_mm2"), F.col("n_transcripts").alias("n_transcripts_grid"),
        "density_per_mm2", (F.col("occupied_bins") / F.col("total_bins")).alias("occupancy"))


def extract_windows(df: DataFrame, windows: DataFrame, tile: float, preset="window") -> DataFrame:
    """Molecules of each window under the contract, with the window's tokens normalised."""
    cut = windows_join(df, windows, tile)
    return cut.withColumn("cell_id", X.normalize_unassigned("cell_id", preset))


def extraction_receipt(extracted: DataFrame, windows: DataFrame) -> DataFrame:
    """Receipt per window; a count that differs from the grid fails the job."""
    r = roi_receipt(extracted).join(windows.select("roi_id", "n_transcripts_grid"), "roi_id", "full")
    same = F.coalesce(F.col("n_transcripts"), F.lit(0)) == F.col("n_transcripts_grid")
    return r.withColumn("matches_grid", F.when(same, True).otherwise(F.raise_error(
        F.lit("extracted rows differ from the grid count")).cast("boolean")))


def write_windows(extracted: DataFrame, path: str) -> None:
    extracted.write.mode("overwrite").partitionBy("roi_id").parquet(path)


# A crowded tile is dealt over tasks of about SHARE_ROWS molecules, which count COUNT_ROWS of them at a time.
SHARE_ROWS = 1 << 20
COUNT_ROWS = 1 << 18


def counts_in_boxes(x: np.ndarray, y: np.ndarray, xmin: np.ndarray, xmax: np.ndarray,
                    ymin: np.ndarray, ymax: np.ndarray) -> np.ndarray:
    """Points in each half-open box, by a wavelet matrix: points in order of x hold their rank in y, and each bit
    of the ranks is counted by prefix sums. Cost is (points + boxes) times the logarithm of the points."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    rank = np.empty(len(y), np.int64)
    by_y = np.argsort(y, kind="stable")
    rank[by_y] = np.arange(len(y))
    low, high = (np.searchsorted(x, v) for v in (xmin, xmax))
    first, last = (np.searchsorted(y[by_y], v) for v in (ymin, ymax))
    lo, hi = np.tile(low, 2), np.tile(np.maximum(low, high), 2)
    top = np.concatenate([first, np.maximum(first, last)])
    below = np.zeros(len(top), np.int64)
    for bit in reversed(range(len(y).bit_length())):
        one = (rank >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        l0, h0 = zeros[lo], zeros[hi]
        up = ((top >> bit) & 1).astype(bool)
        below += np.where(up, h0 - l0, 0)
        lo, hi = np.where(up, zeros[-1] + lo - l0, l0), np.where(up, zeros[-1] + hi - h0, h0)
        rank = np.concatenate([rank[one == 0], rank[one == 1]])
    return below[len(first):] - below[:len(first)]


def window_counts(df: DataFrame, windows: DataFrame, tile: float, key: str = "roi_id") -> DataFrame:
    """(key, n): molecules in each half-open box that holds any, without a row per (molecule, box).

    A molecule goes to its tile, a box to every tile it touches; a tile counts its molecules for all its boxes at
    once, and the counts of a box are summed over tiles. Work follows molecules plus boxes, not their overlaps."""
    near = tiled(in_union_box(df, windows), tile).select(
        "_tx", "_ty", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.xxhash64(*df.columns).alias("h"))
    shares = near.groupBy("_tx", "_ty").agg(F.ceil(F.count(F.lit(1)) / float(SHARE_ROWS)).alias("shares"))
    points = near.join(shares, ["_tx", "_ty"]).withColumn("share", F.pmod("h", "shares"))
    boxes = box_tiles(windows, tile, [key]).join(shares, ["_tx", "_ty"]).withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    group, bounds = ["_tx", "_ty", "share"], ["xmin", "xmax", "ymin", "ymax"]
    none = lambda *names: [F.lit(None).cast("double").alias(c) for c in names]
    kind = windows.schema[key].dataType
    both = (points.select(*group, F.lit(1).alias("kind"), F.lit(None).cast(kind).alias(key), "x", "y", *none(*bounds))
            .unionByName(boxes.select(*group, F.lit(0).alias("kind"), key, *none("x", "y"), *bounds))
            .repartition(shuffle_width(df), *group).sortWithinPartitions(*group, "kind"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, limits, points, n_points = None, [], [], [], 0

        def count() -> Iterator[pa.RecordBatch]:
            if names and points:
                n = counts_in_boxes(*(np.concatenate(c) for c in zip(*points)), *(np.concatenate(c) for c in zip(*limits)))
                held = pa.concat_arrays(names).filter(pa.array(n > 0))
                yield pa.RecordBatch.from_arrays([held, pa.array(n[n > 0])], [key, "n"])

        for batch in batches:
            for (*at, side), lo, hi in _runs(batch, (*group, "kind")):
                if at != current:
                    yield from count()
                    current, names, limits, points, n_points = at, [], [], [], 0
                values = lambda cols: [batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in cols]
                if side == 0:
                    names.append(batch.column(key).slice(lo, hi - lo))
                    limits.append(values(bounds))
                    continue
                points.append(values(("x", "y")))
                n_points += hi - lo
                if n_points >= COUNT_ROWS:
                    yield from count()
                    points, n_points = [], 0
        yield from count()

    found = both.mapInArrow(kernel, T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType())]))
    return found.groupBy(key).agg(F.sum("n").alias("n"))


# --- outlines -------------------------------------------------------------------

def circle_points(df: DataFrame, cx: Column, cy: Column, r: Column, n: int) -> DataFrame:
    """n vertices around each centre, as rows with ``vertex_idx``."""
    angle = F.col("vertex_idx") * F.lit(2 * math.pi / n)
    return (df.withColumns({"_cx": cx, "_cy": cy, "_r": r})
            .withColumn("vertex_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumns({"vertex_x": F.col("_cx") + F.col("_r") * F.cos(angle),
                          "vertex_y": F.col("_cy") + F.col("_r") * F.sin(angle)})
            .drop("_cx", "_cy", "_r"))


def spread_circles(df: DataFrame, factor: float = 1.5, low: float = 8.0, high: float = 40.0,
                   n: int = 8) -> DataFrame:
    """Circle of radius clip(factor x rms spread, low, high) around each entity's centroid."""
    rms = F.sqrt(F.var_pop("x") + F.var_pop("y"))
    cells = df.where(~X.is_unassigned("cell_id")).groupBy("cell_id").agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), rms.alias("rms"))
    r = F.least(F.greatest(F.col("rms") * factor, F.lit(low)), F.lit(high))
    return circle_points(cells, F.col("cx"), F.col("cy"), r, n).select(
        "cell_id", "vertex_idx", "vertex_x", "vertex_y")


def convex_hull(points) -> list[tuple[float, float]]:
    """Strict convex hull, counter-clockwise from the lowest x."""
    order = sorted(set(points))

    def chain(seq) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append(p)
        return out

    if len(order) < 3:
        return order
    return chain(order)[:-1] + chain(reversed(order))[:-1]


def entity_hulls(points: DataFrame) -> DataFrame:
    """(cell_id, hull): hull vertices per entity as an array of (x, y).

    Points are first reduced to the extreme y per x, then to partial hulls batch by batch where
    they lie; only partial hull vertices of one entity ever meet in a row. The hull of the
    partial hulls is the hull, so a mega-entity is spread over tasks and stays exact."""
    ext = points.groupBy("cell_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    ends = F.array_distinct(F.array(F.col("lo").cast("double"), F.col("hi").cast("double")))
    thin = ext.select("cell_id", F.col("x").cast("double"), F.explode(ends).alias("y"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[str, list] = {}
            for cell, x, y in zip(*(batch.column(c).to_pylist() for c in ("cell_id", "x", "y"))):
                groups.setdefault(cell, []).append((x, y))
            rows = [(cell, x, y) for cell, pts in groups.items() for x, y in convex_hull(pts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.float64())], ["cell_id", "x", "y"])

    corner = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hulls = [[{"x": x, "y": y} for x, y in convex_hull((p["x"], p["y"]) for p in pts)]
                     for pts in batch.column("pts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(hulls, pa.list_(corner))],
                                             ["cell_id", "hull"])

    return (thin.mapInArrow(partial, "cell_id string, x double, y double")
            .groupBy("cell_id").agg(F.collect_set(F.struct("x", "y")).alias("pts"))
            .mapInArrow(final, "cell_id string, hull array<struct<x: double, y: double>>"))


def molecule_outlines(df: DataFrame, nucleus_only: bool = True, min_points: int = 3,
                      fallback_radius: float = 5.0, n_circle: int = 8) -> DataFrame:
    """Hull of an entity's nuclear (or all) molecules. Too few molecules: a circle around all of
    them; a flat or tiny point set: a small circle around the contributing ones."""
    # Ids that never get an outline.
    rows = df.where(~F.coalesce(F.col("cell_id"), F.lit("nan")).isin("UNASSIGNED", "nan", "", "None", "0", "-1"))
    use = (F.coalesce(F.col("overlaps_nucleus"), F.lit(0)) == 1) if nucleus_only else F.lit(True)
    stats = rows.groupBy("cell_id").agg(
        F.count_if(use).alias("n"), F.avg("x").alias("ax"), F.avg("y").alias("ay"),
        F.avg(F.when(use, F.col("x"))).alias("ux"), F.avg(F.when(use, F.col("y"))).alias("uy"))
    hulls = entity_hulls(rows.where(use).select("cell_id", "x", "y"))
    few = F.col("n") < min_points
    tiny = F.col("n") < 3
    flat = F.coalesce(F.size("hull"), F.lit(0)) < 3
    cx = F.when(few, F.col("ax")).otherwise(F.col("ux"))
    cy = F.when(few, F.col("ay")).otherwise(F.col("uy"))
    r = F.when(few | tiny, F.lit(float(fallback_radius))).otherwise(2.0)
    ring = F.transform(F.sequence(F.lit(0), F.lit(n_circle - 1)), lambda i: F.struct(
        (cx + r * F.cos(i * F.lit(2 * math.pi / n_circle))).alias("x"),
        (cy + r * F.sin(i * F.lit(2 * math.pi / n_circle))).alias("y")))
    shape = F.when(few | tiny | flat, ring).otherwise(F.col("hull"))
    return (stats.join(hulls, "cell_id", "left").select("cell_id", F.posexplode(shape).alias("vertex_idx", "v"))
            .select("cell_id", "vertex_idx", F.col("v.x").alias("vertex_x"), F.col("v.y").alias("vertex_y")))


def boundary_table(outlines: DataFrame) -> DataFrame:
    """Outlines with dense integer ids in name order; empty outlines are dropped."""
    from molq.sources.matrices import dense_numbers
    real = outlines.where(F.col("vertex_x").isNotNull() & F.col("vertex_y").isNotNull())
    return real.join(dense_numbers(real, "cell_id", "dummy_id"), "cell_id")


# --- neighbours in the plane -----------------------------------------------------

TILE_ROWS = 4096
PAIR_ROWS = 512


def nearest_within(queries: DataFrame, candidates: DataFrame, k: int, radius: float,
                   drop_self: bool = False) -> DataFrame:
    """(id, neighbour, dist): up to k nearest candidates within ``radius``, exact.

    Both sides: id, x, y. Space is cut into tiles of the radius. Copies at one coordinate are
    merged to the k + 1 smallest ids, which is all any query can need from a place. A crowded
    tile is cut into blocks of at most TILE_ROWS candidates and TILE_ROWS queries; a task holds
    one block, streams queries against it and keeps k per query. Ties go to the smaller id.
    """
    r = float(radius)
    n = shuffle_width(queries)
    tile = lambda d: d.withColumns({"tx": F.floor(F.col("x") / r), "ty": F.floor(F.col("y") / r)})
    clean = lambda d: d.select(F.col("id").cast("string").alias("id"), X.finite("x").alias("x"),
                               X.finite("y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    thin = top_k_per_group(clean(candidates), ["x", "y"], [F.asc("id")], k + 1).drop("rank")
    shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = (tile(thin).withColumn("s", F.explode(shift))
            .withColumns({"tx": F.col("tx") + F.col("s.a"), "ty": F.col("ty") + F.col("s.b")}).drop("s"))
    q = tile(clean(queries))
    size = lambda d, name: d.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / float(TILE_ROWS)).alias(name))
    sizes = cut_lineage(size(near, "cb").join(size(q, "qb"), ["tx", "ty"]))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    left = (q.join(sizes, ["tx", "ty"]).withColumn("qs", part("qb")).withColumn("cs", upto("cb"))
            .withColumn("kind", F.lit(1)))
    right = (near.join(sizes, ["tx", "ty"]).withColumn("cs", part("cb")).withColumn("qs", upto("qb"))
             .withColumn("kind", F.lit(0)))
    keys = ["tx", "ty", "cs", "qs"]
    both = (left.unionByName(right).select(*keys, "kind", "id", "x", "y")
            .repartition(n, *keys).sortWithinPartitions(*keys, "kind"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            for (*key, kind), lo, hi in _runs(batch, (*keys, "kind")):
                if key != current:
                    current, parts, block = key, [], None
                ids = np.array(batch.column("id").slice(lo, hi - lo).to_pylist(), dtype=object)
                xs, ys = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                if kind == 0:
                    parts.append((ids, xs, ys))
                    continue
                if not parts:
                    continue
                if block is None:
                    ci, cx, cy = (np.concatenate(c) for c in zip(*parts))
                    order = np.argsort(ci, kind="stable")
                    block = ci[order], cx[order], cy[order]
                ci, cx, cy = block
                for s in range(0, hi - lo, PAIR_ROWS):
                    qi, qx, qy = ids[s:s + PAIR_ROWS], xs[s:s + PAIR_ROWS], ys[s:s + PAIR_ROWS]
                    d2 = (qx[:, None] - cx[None, :]) ** 2 + (qy[:, None] - cy[None, :]) ** 2
                    if drop_self:
                        d2[qi[:, None] == ci[None, :]] = np.inf
                    d2[d2 > r * r] = np.inf
                    best = np.argsort(d2, axis=1, kind="stable")[:, :k]
                    dist = np.take_along_axis(d2, best, axis=1).ravel()
                    keep = np.isfinite(dist)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qi, best.shape[1])[keep], pa.string()),
                         pa.array(ci[best].ravel()[keep], pa.string()), pa.array(np.sqrt(dist[keep]))],
                        ["id", "neighbour", "dist"])

    found = both.mapInArrow(kernel, "id string, neighbour string, dist double")
    return top_k_per_group(found, ["id"], [F.asc("dist"), F.asc("neighbour")], k)


def spatial_knn(cells: DataFrame, k: int = 20, radius: float = 15.0) -> DataFrame:
    """Neighbour graph pruned at a radius. cells: cell_id, x, y."""
    p = cells.select(F.col("cell_id").alias("id"), "x", "y")
    return nearest_within(p, p, k, radius, drop_self=True).withColumnRenamed("id", "cell_id")


def neighbour_composition(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each type among an entity's neighbours. The definition is ours: unlabelled
    neighbours do not count."""
    lab = labels.where(F.col("cell_type").isNotNull()).select(F.col("cell_id").alias("neighbour"), "cell_type")
    n = graph.join(lab, "neighbour").groupBy("cell_id", "cell_type").agg(F.count(F.lit(1)).alias("n_neighbours"))
    return n.withColumn("fraction", F.col("n_neighbours")
                        / F.sum("n_neighbours").over(Window.partitionBy("cell_id")))


def nearest_one(queries: DataFrame, candidates: DataFrame, start: float) -> DataFrame:
    """The nearest candidate of every query with finite coordinates, however far. A tile search settles
    the queries that find one within the tile size; the rest repeat with tiles four times larger, so each
    round is a bounded job on a shrinking set. The radius ends at the joint extent, where nothing can be left."""
    finite = lambda d: d.where(X.finite("x").isNotNull() & X.finite("y").isNotNull())
    open_q, candidates, r = cut_lineage(finite(queries)), cut_lineage(finite(candidates)), float(start)
    settled = nearest_within(open_q, candidates, 1, r)
    if candidates.isEmpty():
        return settled
    e = extent(open_q.select("x", "y").unionByName(candidates.select("x", "y"))).first()
    widest = 0.0 if e["xmin"] is None else math.hypot(e["xmax"] - e["xmin"], e["ymax"] - e["ymin"])
    settled = None
    while True:
        hit = cut_lineage(nearest_within(open_q, candidates, 1, r))
        settled = hit if settled is None else settled.unionByName(hit)
        open_q = cut_lineage(open_q.join(hit.select("id"), "id", "left_anti"))
        if open_q.isEmpty():
            return settled
        if r > 2 * widest:
            raise RuntimeError("queries are left without a neighbour at the joint extent")
        r *= 4.0


def mutual_nearest(ref: DataFrame, other: DataFrame, start: float) -> DataFrame:
    """Pairs that are each other's nearest. Each direction keeps the best hit per target."""
    point = lambda d: d.select(F.col("cell_id").cast("string").alias("id"), "x", "y")
    best = lambda d, key: top_k_per_group(d, [key], [F.asc("dist"), F.asc("ref_id"), F.asc("other_id")], 1, "_r").drop("_r")
    forward = nearest_one(point(other), point(ref), start).select(
        F.col("id").alias("other_id"), F.col("neighbour").alias("ref_id"), "dist")
    back = nearest_one(point(ref), point(other), start).select(
        F.col("id").alias("ref_id"), F.col("neighbour").alias("other_id"), "dist")
    return best(forward, "ref_id").join(
        best(back, "other_id").select("ref_id", "other_id"), ["ref_id", "other_id"])
