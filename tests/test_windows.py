"""Window design against plain arrays, and against a stray coordinate."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from molq.operators import joins as J
from molq.operators import spatial as S
from molq.streaming import incremental as I


def molecules_of(spark, points):
    return spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")


def plain_blocks(points, bin_size, k):
    """Counts and occupancy of complete blocks, row-major, with the origin of the grid."""
    p = np.asarray(points, float)
    origin = np.floor(p.min(0) / bin_size) * bin_size
    bins = np.floor((p - origin) / bin_size).astype(int)
    nx, ny = bins.max(0) + 1
    hist = np.zeros((ny, nx), int)
    np.add.at(hist, (bins[:, 1], bins[:, 0]), 1)
    by, bx = ny // k, nx // k
    tiles = hist[:by * k, :bx * k].reshape(by, k, bx, k)
    return tiles.sum(axis=(1, 3)), (tiles > 0).sum(axis=(1, 3)) / (k * k)


def design(spark, points, bin_size):
    m = molecules_of(spark, points)
    spec = S.grid_spec(m, bin_size)
    return S.density_grid(m, spec), spec


def clouds(seed, n):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(30, 12, (n, 2)), rng.uniform(0, 140, (n // 4, 2))])


@pytest.mark.parametrize("seed,n,occ_min", [(1, 400, 0.25), (2, 60, 0.0), (3, 8, 0.75)])
def test_windows_match_plain_arrays(spark, seed, n, occ_min):
    points = clouds(seed, n)
    grid, spec = design(spark, points, 5.0)
    grid, spec = grid.cache(), spec.cache()
    counts, occ = plain_blocks(points, 5.0, 4)
    ok = occ >= occ_min
    dens = (counts / (20.0 * 20.0 / 1e6))[ok]

    full = {(r.window_iy, r.window_ix): (r["count"], r.occupancy) for r in S.block_reduce(grid, spec, 4).collect()}
    assert full == {(j, i): (counts[j, i], occ[j, i]) for j, i in np.ndindex(*counts.shape)}
    held = {(r.window_iy, r.window_ix) for r in S.block_reduce(grid, spec, 4, empty=False).collect()}
    assert held == {at for at, (c, _) in full.items() if c > 0}

    stats = S.selection_stats(grid, spec, 5.0, 20.0, occ_min).first()
    assert (stats.windows_total, stats.windows_eligible) == (ok.size, ok.sum())
    row = S.window_ladder(grid, spec, 5.0, [20.0], occ_min).first()
    assert (row.windows_total, row.windows_eligible) == (ok.size, ok.sum())
    spread = S.occupancy_distribution(grid, spec, 4).first()
    assert spread.p50 == pytest.approx(np.percentile(occ, 50)) and spread.p90 == pytest.approx(np.percentile(occ, 90))
    picks = {r.roi_id: r for r in S.select_windows(grid, spec, 5.0, 20.0, occ_min).collect()}
    if not ok.any():
        assert stats.eligible_density_median is None
        return
    assert stats.eligible_density_median == pytest.approx(np.median(dens))
    jj, ii = np.nonzero(ok)
    for name, q in (("q25", 25), ("q50", 50), ("q75", 75)):
        target = np.percentile(dens, q)
        at = int(np.argmin(np.abs(dens - target)))
        assert row[f"{name}_density"] == pytest.approx(target)
        assert (picks[name].window_iy, picks[name].window_ix) == (jj[at], ii[at])
        assert picks[name].target_density == pytest.approx(target)


def test_a_stray_coordinate_adds_no_rows(spark):
    points = [*clouds(4, 300), (1e9, 1e9)]
    grid, spec = design(spark, points, 5.0)
    grid, spec = grid.cache(), spec.cache()
    table = S.windows_with_density(grid, spec, 5.0, [20.0, 50.0], placed=True)
    side = spec.first()
    rows = table.groupBy("side").agg({"*": "count", "windows": "sum"}).collect()
    for r in rows:
        k = int(r.side / 5)
        assert r["count(1)"] <= 400 and r["sum(windows)"] == (side.nx // k) * (side.ny // k)
    assert S.selection_stats(grid, spec, 5.0, 20.0, 0.0).first().windows_eligible == (side.nx // 4) * (side.ny // 4)
    # Nearly all windows are empty, so all quartiles are 0 and the first empty window is the pick.
    stored = {(r.window_iy, r.window_ix) for r in S.block_reduce(grid, spec, 4, empty=False).collect()}
    first = next((0, i) for i in range(10_000) if (0, i) not in stored)
    picks = S.select_windows(grid, spec, 5.0, 20.0, 0.0).collect()
    assert {(r.window_iy, r.window_ix) for r in picks} == {first}


def test_grids_without_a_complete_block(spark):
    grid, spec = design(spark, [(1.0, 1.0), (2.0, 3.0)], 5.0)
    assert S.block_reduce(grid, spec, 4).count() == 0
    assert S.window_ladder(grid, spec, 5.0, [20.0], 0.0).count() == 0
    stats = S.selection_stats(grid, spec, 5.0, 20.0, 0.0).first()
    assert (stats.windows_total, stats.windows_eligible, stats.eligible_density_min) == (0, 0, None)
    none = S.density_grid(molecules_of(spark, []), S.grid_spec(molecules_of(spark, []), 5.0))
    assert S.windows_with_density(none, S.grid_spec(molecules_of(spark, []), 5.0), 5.0, [20.0]).count() == 0
    with pytest.raises(ValueError):
        S.windows_with_density(grid, spec, 5.0, [12.0])


def boxes_of(spark, boxes):
    return spark.createDataFrame([(n, *map(float, b)) for n, b in boxes], "roi_id string, xmin double, xmax double, ymin double, ymax double")


def random_boxes(rng, n, wide=60.0):
    low, side = rng.integers(-5, 130, (n, 2)), rng.uniform(0, wide, (n, 2)).round(1)
    return [(f"r{i % (n - 3)}", (x, x + a, y, y + b)) for i, ((x, y), (a, b)) in enumerate(zip(low, side))]


def plain_pairs(points, boxes):
    return sorted((n, i) for n, (x0, x1, y0, y1) in boxes for i, (x, y) in enumerate(points) if x0 <= x < x1 and y0 <= y < y1)


def numbered(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i long, x double, y double")


def test_crowded_molecules_are_dealt_before_they_meet_the_boxes(spark):
    rng = np.random.default_rng(4)
    points, boxes = clouds(4, 300).round(0).tolist() + [[float("nan"), 3.0], [np.inf, 3.0]], random_boxes(rng, 40)
    one_task = numbered(spark, points).coalesce(1)
    for cut in (J.windows_join, J.windows_cut):
        rows = cut(one_task, boxes_of(spark, boxes), 20.0).select("roi_id", "i")
        assert sorted(map(tuple, rows.collect())) == plain_pairs(points, boxes)
    tasks = J.windows_join(one_task, boxes_of(spark, boxes), 20.0).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


@pytest.mark.parametrize("points", [clouds(8, 800).round(0).tolist(), [[60.0, 60.0]] * 1000])
@pytest.mark.parametrize("most", [0, 10_000])
def test_joined_rows_leave_few_molecules_a_task_in_order_of_place(spark, monkeypatch, points, most):
    monkeypatch.setattr(J, "MEET_ROWS", 50)
    monkeypatch.setattr(J, "MEET_BOXES", most)
    boxes = random_boxes(np.random.default_rng(8), 40)
    named = numbered(spark, points).withColumn("transcript_id", F.concat(F.lit("t"), "i")).coalesce(1)
    rows = J.windows_join(named, boxes_of(spark, boxes), 20.0).select("roi_id", "i", "x", "y", F.spark_partition_id().alias("p")).collect()
    assert sorted((r.roi_id, r.i) for r in rows) == plain_pairs(points, boxes)
    if not most:
        return
    tasks = {}
    for r in rows:
        tasks.setdefault(r.p, []).append((r.y // 20, r.x // 20, r.y, r.x))
    assert len(tasks) > 5 and all(at == sorted(at) for at in tasks.values())
    assert max(Counter(p for p, _ in {(r.p, r.i) for r in rows}).values()) <= 150


def test_windows_are_counted_without_a_row_per_overlap(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points, boxes = clouds(5, 400).round(0).tolist() + [[float("nan"), 3.0]], random_boxes(rng, 60) + [(None, (0, 50, 0, 50)), ("none", (9, 5, 0, 90))]
    want = Counter(n for n, _ in sorted(((n or "", i) for n, b in boxes for _, i in plain_pairs(points, [("", b)]))))
    for share in (7, S.SHARE_ROWS):
        monkeypatch.setattr(S, "SHARE_ROWS", share)
        got = {r.roi_id or "": r.n for r in S.window_counts(numbered(spark, points), boxes_of(spark, boxes), 20.0).collect()}
        assert got == want
    # Two billion overlaps.
    many = spark.range(100000).select(F.col("id").alias("i"), (F.col("id") % 997 / 100).alias("x"), (F.col("id") % 991 / 100).alias("y"))
    over = spark.range(20000).select(F.concat(F.lit("r"), "id").alias("roi_id"), F.lit(0.0).alias("xmin"), F.lit(10.0).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(10.0).alias("ymax"))
    assert S.window_counts(many, over, 10.0).agg(F.count("*"), F.min("n"), F.max("n")).first() == (20000, 100000, 100000)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_streamed_cut_and_totals(spark, tmp_path, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        cut_and_count(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def cut_and_count(spark, tmp_path):
    rng = np.random.default_rng(6)
    points, boxes = clouds(6, 400).round(0).tolist(), random_boxes(rng, 30)
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    numbered(spark, points).repartition(12).write.parquet(src)
    stream = lambda: I.file_stream(spark, src, numbered(spark, points[:1]).schema, 4)
    windows, want = boxes_of(spark, boxes), plain_pairs(points, boxes)
    for _ in range(2):
        I.stream_window_totals(stream(), windows, 20.0, f"{out}/n", f"{cp}/n").awaitTermination()
        assert {r.roi_id: r.n for r in I.read_window_totals(spark, f"{out}/n").collect()} == Counter(n for n, _ in want)
    I.stream_window_cut(stream(), windows, 20.0, f"{out}/cut", f"{cp}/cut").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/cut").select("roi_id", "i").collect())) == want
    # Windows with one box: a file for each of the three batches at most, though each batch is read by several tasks.
    once = [n for n, k in Counter(n for n, _ in boxes).items() if k == 1]
    assert max(len(list((tmp_path / "out" / "cut" / f"roi_id={n}").glob("*.parquet"))) for n in once) <= 3


def test_a_replayed_batch_adds_nothing_twice(spark, tmp_path, monkeypatch):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    points = clouds(7, 100).tolist()
    numbered(spark, points).repartition(4).write.parquet(src)
    save = I.save_update
    monkeypatch.setattr(I, "save_update", lambda batch, number, *rest: (save(batch, number, *rest), save(batch, number, *rest)))
    stream = I.file_stream(spark, src, numbered(spark, points[:1]).schema, 1)
    I.stream_window_totals(stream, boxes_of(spark, [("w", (-500, 500, -500, 500))]), 20.0, out, cp).awaitTermination()
    assert I.read_window_totals(spark, out).first().n == len(points)


def test_landed_files_follow_the_rows(spark, tmp_path, monkeypatch):
    from molq.suite import streaming as Q
    i = F.col("id")
    spark.range(130).select(
        (i % 40).alias("l_orderkey"), (i % 7).alias("l_linenumber"), i.alias("l_partkey"), (i % 30).alias("l_suppkey"), i.cast("double").alias("l_quantity"),
        F.lit("O").alias("l_linestatus"), F.lit("A").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).select(i.alias("o_orderkey"), (i * 3).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(Q, "FILE_ROWS", 10)
    root, stream = Q.landed(spark, str(tmp_path), "files")
    files = spark.read.parquet(f"{root}/in").groupBy(F.input_file_name()).count().collect()
    assert len(files) == 13 and max(r["count"] for r in files) <= 2 * 10
    assert Q.stream_accounting(spark, str(tmp_path)).agg(F.sum("n_total")).first()[0] == 130


def test_wide_counts_are_dealt_by_entity_while_narrow(spark):
    from molq.sources.matrices import triplets_to_wide
    counts = spark.createDataFrame([("a", "g1", 2), ("a", "g2", 1), ("b", "g2", 4), (None, "g1", 3), ("c", "other", 1)], "cell_id string, feature_name string, count long")
    wide = triplets_to_wide(counts, ["g1", "g2"])
    assert {(r.cell_id, r.g1, r.g2) for r in wide.collect()} == {("a", 2, 1), ("b", 0, 4), (None, 3, 0), ("c", 0, 0)}
    plan = triplets_to_wide(counts, ["g1", "g2"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
