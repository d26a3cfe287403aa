"""Queries over density grids, window design and neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from molq.operators import accounting as A
from molq.operators import spatial as S
from molq.plans import evaluate as E
from molq.plans.fixtures import cell_labels, molecules, with_parts
from molq.session import cut_lineage
from molq.suite.base import query
from molq.suite.util import rounded

SPEC = {
    "spec": """SELECT 25.0 AS bin, floor(min(x) / 25) * 25 AS ox, floor(min(y) / 25) * 25 AS oy, CAST(floor((max(x) - floor(min(x) / 25) * 25) / 25) + 1 AS BIGINT) AS nx,
      CAST(floor((max(y) - floor(min(y) / 25) * 25) / 25) + 1 AS BIGINT) AS ny FROM molecules""",
    "grid": "SELECT CAST(floor((y - oy) / 25) AS BIGINT) AS iy, CAST(floor((x - ox) / 25) AS BIGINT) AS ix, count(*) AS n FROM molecules, spec GROUP BY 1, 2",
}


def windows_sql(side: int) -> str:
    k = side // 25
    return f"""SELECT b.iy AS window_iy, b.ix AS window_ix, CAST(coalesce(sum(n), 0) AS BIGINT) AS count, count(n) / {k * k}.0 AS occupancy, coalesce(sum(n), 0) / ({side} * {side} / 1e6) AS density
     FROM (SELECT y.i AS iy, x.i AS ix FROM spec, range(0, 1000) y(i), range(0, 1000) x(i) WHERE y.i < ny // {k} AND x.i < nx // {k}) b
     LEFT JOIN grid ON grid.iy // {k} = b.iy AND grid.ix // {k} = b.ix GROUP BY 1, 2"""


def parts(spark, sf):
    m = molecules(spark, sf)
    spec = cut_lineage(S.grid_spec(m, 25))
    return m, spec, cut_lineage(S.density_grid(m, spec))


@query("K01", with_parts("SELECT CAST(bin AS DOUBLE) AS bin, CAST(ox AS DOUBLE) AS ox, CAST(oy AS DOUBLE) AS oy, nx, ny FROM spec", "molecules", **SPEC))
def grid_spec(spark, sf):
    return S.grid_spec(molecules(spark, sf), 25)


@query("K02", with_parts("SELECT iy, ix, n FROM grid", "molecules", **SPEC))
def density_grid(spark, sf):
    m = molecules(spark, sf)
    return S.density_grid(m, S.grid_spec(m, 25))


@query("K02", with_parts("""
SELECT count(*) AS rows, count(*) FILTER (transcript_id LIKE '%7') AS nonfinite, count(*) FILTER (transcript_id NOT LIKE '%7' AND (x >= 500 OR y >= 500)) AS out_of_grid FROM molecules"""))
def grid_counters(spark, sf):
    m = molecules(spark, sf).withColumn("x", F.when(F.col("transcript_id").endswith("7"), F.lit(float("nan"))).otherwise(F.col("x")))
    return S.grid_counters(m, {"bin": 25.0, "ox": 0.0, "oy": 0.0, "nx": 20, "ny": 20})


@query("K03", with_parts("""
SELECT count(*) AS occupied_bins, CAST(sum(n) AS BIGINT) AS n_transcripts, any_value(nx * ny) AS total_bins, round(count(*) * 625 / 1e6, 6) AS occupied_area_mm2,
 round(sum(n) / (count(*) * 625 / 1e6), 6) AS density_per_mm2 FROM grid, spec""", "molecules", **SPEC))
def grid_summary(spark, sf):
    _, spec, grid = parts(spark, sf)
    return rounded(S.grid_summary(grid, spec))


@query("K04", with_parts("SELECT window_iy, window_ix, count, round(occupancy, 6) AS occupancy FROM w", "molecules", **SPEC, w=windows_sql(250)))
def block_reduce(spark, sf):
    _, spec, grid = parts(spark, sf)
    return rounded(S.block_reduce(grid, spec, 10))


LADDER = " UNION ALL ".join(f"""SELECT {s}.0::DOUBLE AS side, round({s} * {s} / 1e6, 6) AS area_mm2, count(*) AS windows_total, count(*) FILTER (occupancy >= 0.5) AS windows_eligible,
 round(quantile_cont(CASE WHEN occupancy >= 0.5 THEN density END, 0.25), 6) AS q25_density, round(quantile_cont(CASE WHEN occupancy >= 0.5 THEN density END, 0.5), 6) AS q50_density,
 round(quantile_cont(CASE WHEN occupancy >= 0.5 THEN density END, 0.75), 6) AS q75_density FROM ({windows_sql(s)})""" for s in (100, 250, 500))


@query("K05", with_parts(LADDER, "molecules", **SPEC))
def window_ladder(spark, sf):
    _, spec, grid = parts(spark, sf)
    return rounded(S.window_ladder(grid, spec, 25, [100, 250, 500], 0.5))


PICK = """
, e AS (SELECT *, density AS d FROM w WHERE occupancy >= 0.5), q AS (SELECT p, quantile_cont(d, p) AS t FROM e, (VALUES (0.25), (0.5), (0.75)) v(p) GROUP BY p),
k AS (SELECT q.p, t, e.*, row_number() OVER (PARTITION BY q.p ORDER BY abs(d - t), window_iy, window_ix) AS r FROM e, q),
wins AS (SELECT concat('q', CAST(CAST(p * 100 AS INTEGER) AS VARCHAR)) AS roi_id, window_ix, window_iy, ox + window_ix * 100.0 AS xmin, ox + (window_ix + 1) * 100.0 AS xmax, oy + window_iy * 100.0 AS ymin,
 oy + (window_iy + 1) * 100.0 AS ymax, count, density, occupancy, t FROM k, spec WHERE r = 1)"""
PICK = PICK.replace("SELECT p, quantile_cont(d, p) AS t FROM e, (VALUES (0.25), (0.5), (0.75)) v(p) GROUP BY p",
                    "SELECT 0.25 AS p, quantile_cont(d, 0.25) AS t FROM e UNION ALL SELECT 0.5, quantile_cont(d, 0.5) FROM e UNION ALL SELECT 0.75, quantile_cont(d, 0.75) FROM e")


@query("K06 G06", with_parts(PICK + """
SELECT roi_id, window_ix, window_iy, CAST(xmin AS DOUBLE) AS xmin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymin AS DOUBLE) AS ymin, CAST(ymax AS DOUBLE) AS ymax, 0.01 AS area_mm2, count AS n_transcripts_grid,
 round(density, 6) AS density_per_mm2, round(occupancy, 6) AS occupancy, round(t, 6) AS target_density FROM wins""", "molecules", **SPEC, w=windows_sql(100)))
def selected_windows(spark, sf):
    _, spec, grid = parts(spark, sf)
    return rounded(S.select_windows(grid, spec, 25, 100, 0.5))


@query("K06", with_parts("""
SELECT count(*) AS windows_total, count(*) FILTER (occupancy >= 0.5) AS windows_eligible, round(min(CASE WHEN occupancy >= 0.5 THEN density END), 6) AS eligible_density_min,
 round(max(CASE WHEN occupancy >= 0.5 THEN density END), 6) AS eligible_density_max, round(median(CASE WHEN occupancy >= 0.5 THEN density END), 6) AS eligible_density_median FROM w""",
                      "molecules", **SPEC, w=windows_sql(100)))
def selection_stats(spark, sf):
    _, spec, grid = parts(spark, sf)
    return rounded(S.selection_stats(grid, spec, 25, 100, 0.5))


@query("K07", with_parts("SELECT " + ", ".join(f"round(quantile_cont(occupancy, {p / 100}), 6) AS p{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + " FROM w",
                         "molecules", **SPEC, w=windows_sql(250)))
def occupancy_distribution(spark, sf):
    _, spec, grid = parts(spark, sf)
    return rounded(S.occupancy_distribution(grid, spec, 10))


@query("K08 C10 D40 O03", with_parts(PICK + """
SELECT roi_id, count(*) AS n_transcripts, count(DISTINCT feature_name) AS n_genes, count(DISTINCT nullif(cell_id, 'UNASSIGNED')) AS n_cells, count(*) FILTER (cell_id = 'UNASSIGNED') AS n_unassigned,
 any_value(count) AS n_transcripts_grid, TRUE AS matches_grid FROM molecules JOIN wins ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY 1""", "molecules", **SPEC, w=windows_sql(100)))
def extracted_windows(spark, sf):
    windows, cut = E.window_design(molecules(spark, sf), 25, 100, 0.5)
    return S.extraction_receipt(cut, windows)


@query("K09", None)
def nuclear_outlines(spark, sf):
    return S.molecule_outlines(molecules(spark, sf), True)


@query("K09 K11", None)
def molecule_boundaries(spark, sf):
    return S.boundary_table(S.molecule_outlines(molecules(spark, sf), False))


@query("K09", with_parts("""
, e AS (SELECT * FROM molecules WHERE cell_id NOT IN ('UNASSIGNED', 'nan', '', 'None', '0', '-1')),
n AS (SELECT cell_id, count(DISTINCT (x, y)) >= 3 AND var_pop(x) * var_pop(y) - covar_pop(x, y) * covar_pop(x, y) > 1e-9 AS hull
      FROM e WHERE overlaps_nucleus = 1 GROUP BY 1)
SELECT DISTINCT e.cell_id, coalesce(hull, FALSE) AS is_hull, TRUE AS all_inside, TRUE AS turns_left
FROM e LEFT JOIN n USING (cell_id)"""))
def outline_laws(spark, sf):
    """Hulls have input points as corners, hold all points and turn left everywhere; others are circles."""
    m = molecules(spark, sf).where("overlaps_nucleus = 1").select("cell_id", "x", "y").distinct()
    w = Window.partitionBy("cell_id").orderBy("vertex_idx")
    after = lambda c, k: F.coalesce(F.lead(c, k).over(w), F.get(F.collect_list(c).over(w.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)), F.col("vertex_idx") + k - F.count(F.lit(1)).over(Window.partitionBy("cell_id"))))
    o = S.molecule_outlines(molecules(spark, sf), True)
    edges = o.select("*", *[after(f"vertex_{c}", k).alias(f"{c}{k}") for c in ("x", "y") for k in (1, 2)])
    side = lambda x, y: (F.col("x1") - F.col("vertex_x")) * (y - F.col("vertex_y")) - (F.col("y1") - F.col("vertex_y")) * (x - F.col("vertex_x"))
    shape = edges.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), (F.min(side(F.col("x2"), F.col("y2"))) > 0).alias("turns"))
    corners = o.join(m, (o.cell_id == m.cell_id) & (o.vertex_x == m.x) & (o.vertex_y == m.y), "left_semi").groupBy("cell_id").agg(F.count(F.lit(1)).alias("c"))
    inside = edges.join(m, "cell_id").groupBy("cell_id").agg((F.min(side(F.col("x"), F.col("y"))) >= 0).alias("inside"))
    hull = F.coalesce(F.col("c") == F.col("n"), F.lit(False))
    return shape.join(corners, "cell_id", "left").join(inside, "cell_id", "left").select(
        "cell_id", hull.alias("is_hull"), F.coalesce(~hull | F.col("inside"), F.lit(False)).alias("all_inside"),
        F.coalesce(~hull | F.col("turns"), F.lit(False)).alias("turns_left"))


@query("K09 K11", with_parts("""
SELECT count(DISTINCT cell_id) AS n_entities, count(DISTINCT cell_id) AS n_ids, CAST(1 AS BIGINT) AS first_id, count(DISTINCT cell_id) AS last_id
FROM molecules WHERE cell_id NOT IN ('UNASSIGNED', 'nan', '', 'None', '0', '-1')"""))
def boundary_laws(spark, sf):
    """Each entity has one dense id."""
    ids = S.boundary_table(S.molecule_outlines(molecules(spark, sf), False)).select("cell_id", F.col("dummy_id").cast("long").alias("i")).distinct()
    return ids.agg(F.countDistinct("cell_id").alias("n_entities"), F.countDistinct("i").alias("n_ids"), F.min("i").alias("first_id"), F.max("i").alias("last_id"))


@query("K10", with_parts("""
, c AS (SELECT cell_id, avg(x) AS cx, avg(y) AS cy, least(greatest(1.5 * sqrt(var_pop(x) + var_pop(y)), 8), 40) AS r FROM assigned GROUP BY 1)
SELECT cell_id, CAST(i AS INTEGER) AS vertex_idx, round(cx + r * cos(i * 2 * pi() / 8), 6) + 0.0 AS vertex_x, round(cy + r * sin(i * 2 * pi() / 8), 6) + 0.0 AS vertex_y FROM c, range(0, 8) t(i)""", "assigned"))
def spread_circles(spark, sf):
    return rounded(S.spread_circles(molecules(spark, sf)))


def centroids(spark, sf):
    return A.derive_cells(molecules(spark, sf)).select("cell_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))


CENT = "SELECT cell_id, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM assigned GROUP BY 1"
KNN = """SELECT a.cell_id, b.cell_id AS neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
 row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS k FROM cen a JOIN cen b ON a.cell_id <> b.cell_id
 AND abs(a.x - b.x) <= 15 AND abs(a.y - b.y) <= 15 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225 QUALIFY k <= 20"""


def rough_centroids(spark, sf):
    c = centroids(spark, sf)
    return cut_lineage(c.withColumns({"x": F.round("x", 3), "y": F.round("y", 3)}))


@query("K12", with_parts("SELECT cell_id, neighbour, round(d, 6) AS dist, CAST(k AS INTEGER) AS rank FROM knn", "assigned", cen=CENT, knn=KNN))
def spatial_knn_graph(spark, sf):
    return rounded(S.spatial_knn(rough_centroids(spark, sf), 20, 15.0))


@query("K12", with_parts("""
SELECT knn.cell_id, cell_type, count(*) AS n_neighbours, round(count(*) / sum(count(*)) OVER (PARTITION BY knn.cell_id), 6) AS fraction FROM knn JOIN cell_labels ON neighbour = cell_labels.cell_id GROUP BY 1, 2""",
                       "assigned cell_labels", cen=CENT, knn=KNN))
def neighbour_composition(spark, sf):
    return rounded(S.neighbour_composition(S.spatial_knn(rough_centroids(spark, sf), 20, 15.0), cell_labels(spark, sf)))


@query("C12", with_parts("""
, r AS (SELECT * FROM cen WHERE NOT contains(cell_id, '-')), o AS (SELECT * FROM cen WHERE contains(cell_id, '-')),
d AS (SELECT r.cell_id AS ref_id, o.cell_id AS other_id, (r.x - o.x) * (r.x - o.x) + (r.y - o.y) * (r.y - o.y) AS d2 FROM r, o),
f AS (SELECT other_id, ref_id, d2 FROM d QUALIFY row_number() OVER (PARTITION BY other_id ORDER BY d2, ref_id) = 1), fb AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY d2, other_id) = 1),
b AS (SELECT other_id, ref_id, d2 FROM d QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY d2, other_id) = 1), bb AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY other_id ORDER BY d2, ref_id) = 1)
SELECT ref_id, other_id, round(sqrt(fb.d2), 6) AS dist FROM fb JOIN bb USING (ref_id, other_id)""", "assigned", cen=CENT))
def mutual_nearest(spark, sf):
    c = rough_centroids(spark, sf)
    fragment = F.col("cell_id").contains("-")
    return rounded(S.mutual_nearest(c.where(~fragment), c.where(fragment), 8.0))
