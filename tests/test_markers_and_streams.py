import json

import pytest
from pyspark.sql import functions as F

from molq.operators import joins as J
from molq.operators import markers as M
from molq.operators import spatial as S
from molq.sources import sinks, tables
from molq.streaming import incremental as I


def test_marker_panel_rules(frame):
    types = {"A": ["a1", "a2", "gone", "ACTB", "flat"], "B": ["b1"]}
    cells = [(f"{t}{i}", t) for t in "AB" for i in range(6)]
    rows = []
    for cell, t in cells:
        for g in ("a1", "a2", "a3") if t == "A" else ("b1", "b2", "b3"):
            rows.append((cell, g, 5))
        rows += [(cell, "flat", 5), (cell, "ACTB", 9)]
    counts = frame(rows, "cell_id string, feature_name string, count long")
    labels = frame(cells, "cell_id string, cell_type string")
    canonical = M.candidates_table(counts, types)
    fallback = frame([("A", "a3", 1), ("B", "b2", 1), ("B", "b3", 2), ("C", "b1", 1)], "cell_type string, gene string, rank int")
    platform = counts.unionByName(frame([("x", "gone2", 1)], "cell_id string, feature_name string, count long"))
    audit = {(r.cell_type, r.gene): r for r in M.marker_panel(canonical, fallback, platform, counts, labels).collect()}
    chosen = lambda t: [g for _, g in sorted((r.panel_rank, g) for (k, g), r in audit.items() if k == t and r.selected)]
    assert chosen("A") == ["a1", "a2"]  # two canonical features meet the minimum, so nothing is filled
    assert chosen("B") == ["b1", "b2", "b3"]  # one canonical feature is too few: filled to the target
    assert audit[("A", "gone")].reason == "absent from platform panel"
    assert audit[("A", "ACTB")].reason == "broad/stress/interferon marker avoided"
    assert audit[("A", "flat")].reason.startswith("low scRNA specificity")
    assert audit[("A", "a3")].reason == "not in top selected markers for lineage"
    assert ("C", "b1") not in audit


def test_dominant_group_tie_takes_file_order(frame):
    counts = frame([("c", "g1", 2), ("c", "g2", 2)], "cell_id string, feature_name string, count long")
    groups = tables.marker_groups(counts.sparkSession, {"zeta": ["g1"], "alpha": ["g2"]})
    row = M.dominant_group(counts, groups).first()
    assert row.dominant_group == "zeta" and row.specificity == 0.5


def test_stats_tree(spark, tmp_path):
    for i, method in enumerate(("m1", "m2")):
        d = tmp_path / "runs" / method
        d.mkdir(parents=True)
        (d / "benchmark_stats.json").write_text(json.dumps({
            "method": method, "status": "ok", "transcripts": {"n_total": 10, "n_assigned": 6 + i, "n_unassigned": 4 - i},
            "qc": {"share": 0.25, "note": "x"}}, indent=1))
    bad = tmp_path / "runs" / "m3"
    bad.mkdir()
    (bad / "benchmark_stats.json").write_text("{broken")
    stats = tables.collect_run_stats(spark, str(tmp_path / "runs"))
    keys = tables.qc_keys(stats)
    flat = {r.method: r for r in tables.flatten_stats(stats, keys).collect()}
    assert keys == ["note", "share"] and flat["m1"].qc_share == "0.25"
    assert flat[None].status == "unreadable" and flat[None].run_dir.endswith("m3")
    good = [r for m, r in flat.items() if m]
    assert len(good) == 2 and all(r.n_transcripts_assigned + r.n_transcripts_unassigned == r.n_transcripts_total for r in good)


def test_more_than_a_thousand_qc_keys_and_64_types(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "benchmark_stats.json").write_text(json.dumps({"method": "m1", "qc": {f"k{i:04d}": i for i in range(1500)}}))
    stats = tables.collect_run_stats(spark, str(tmp_path))
    assert len(tables.qc_keys(stats)) == 1500 == tables.qc_rows(stats).count()
    wide = spark.createDataFrame([("c1", *range(100))], ["cell_id", *[f"t{i}" for i in range(100)]])
    assert tables.wide_weights_to_long(wide).count() == 100


def test_pair_panel_keeps_the_first_row_of_the_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("gene_i,gene_j,NPMI\na,b,0.9\na,b,0.1\nb,a,0.5\nc,d,\nc,d,0.2\ne,f,0.2\ne,f,\nd,e,0.3\n")
    got = {(r.gene_i, r.gene_j): r.value for r in tables.read_pair_panel(spark, str(tmp_path / "p.csv")).collect()}
    assert got[("a", "b")] == 0.9 and got[("c", "d")] is None and got[("e", "f")] == 0.2
    assert got[("b", "a")] == 0.5 and got[("e", "d")] == 0.3
    finite = {(r.gene_i, r.gene_j): r.value for r in tables.read_pair_panel(spark, str(tmp_path / "p.csv"), finite_only=True).collect()}
    assert finite[("c", "d")] == 0.2


def test_combined_checksums(spark, tmp_path):
    for panel in ("p1", "p2"):
        (tmp_path / panel).mkdir()
        (tmp_path / panel / "sums.csv").write_text(f"file,sha\n{panel}.csv,00{panel}\n")
    got = tables.combine_checksums(spark, [str(tmp_path / p / "sums.csv") for p in ("p1", "p2")])
    assert sorted((r.panel, r.sha) for r in got.collect()) == [("p1", "00p1"), ("p2", "00p2")]


def test_shared_folder_is_asked_for_off_local(spark, monkeypatch):
    from molq import session
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]")
    monkeypatch.setattr(session, "is_local", lambda master: False)

    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


def test_manifest_digests(spark, tmp_path):
    import hashlib
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "sub" / "b.bin").write_bytes(b"two2")
    got = {r.path: (r.bytes, r.sha256) for r in sinks.file_manifest(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (3, hashlib.sha256(b"one").hexdigest()), "sub/b.bin": (4, hashlib.sha256(b"two2").hexdigest())}


def test_manifest_reads_no_file_as_one_value_and_deals_by_size(spark, tmp_path):
    import hashlib
    content = {f"f{i:02d}.bin": bytes([i]) * 5000 for i in range(12)}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    # Spark refuses to read longer contents as one value; files over the split size share no task.
    limits = {"spark.sql.sources.binaryFile.maxLength": "100", "spark.sql.files.maxPartitionBytes": "5100", "spark.sql.files.openCostInBytes": "1"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        got = sinks.file_manifest(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert {r.path: (r.bytes, r.sha256) for r in got} == {k: (5000, hashlib.sha256(v).hexdigest()) for k, v in content.items()}
    assert len({r.task for r in got}) == 12


def test_manifest_of_a_store_that_only_spark_opens(spark, tmp_path):
    import hashlib
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "sub" / "b.bin").write_bytes(b"two2")
    link = "fs.viewfs.mounttable.manifest.link./d"
    spark.sparkContext._jsc.hadoopConfiguration().set(link, tmp_path.as_uri())
    try:
        paths = ["viewfs://manifest/d", str(tmp_path / "a.txt")]
        got = sorted((r.path, r.bytes, r.sha256) for r in sinks.file_manifest(spark, paths).collect())
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset(link)
    one, two = (hashlib.sha256(x).hexdigest() for x in (b"one", b"two2"))
    assert got == sorted([("a.txt", 3, one), ("sub/b.bin", 4, two), (str(tmp_path / "a.txt"), 3, one)])


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spec = {"bin": 10.0, "ox": 0.0, "oy": 0.0, "nx": 5, "ny": 5}
    rows = lambda *xy: spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x double, y double")
    rows((1, 1), (2, 2), (99, 1)).write.parquet(src)
    schema = rows((0, 0)).schema
    run = lambda: I.stream_density_grid(I.file_stream(spark, src, schema, 1), spec, out, cp).awaitTermination()
    run()
    rows((3, 3), (25, 1), (float("nan"), 1)).write.mode("append").parquet(src)
    run()
    run()  # nothing new: nothing counted twice
    assert {(r.iy, r.ix): r.n for r in I.read_density_grid(spark, out).collect()} == {(0, 0): 3, (0, 2): 1}


def test_a_changed_grid_is_refused(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame([(1.0, 1.0)], "x double, y double").write.parquet(src)
    spec = {"bin": 10.0, "ox": 0.0, "oy": 0.0, "nx": 5, "ny": 5}
    stream = lambda: I.file_stream(spark, src, spark.read.parquet(src).schema, 1)
    I.stream_density_grid(stream(), spec, out, cp).awaitTermination()
    with pytest.raises(ValueError, match="bin, nx differ"):
        I.stream_density_grid(stream(), {**spec, "bin": 5.0, "nx": 10}, out, cp)
    I.stream_density_grid(stream(), {**spec, "nx": 5.0}, out, cp).awaitTermination()
    assert I.read_density_grid(spark, out).count() == 1


def test_a_long_log_is_read_as_snapshot_and_tail(spark, tmp_path):
    root, want = str(tmp_path / "out" / "run=a"), {}

    def save(number):
        rows = [(number % 7, number), (None, number)] + ([(100 + number, 1)] if number % 3 == 0 else [])
        want.update(rows)
        shown = ", ".join(f"({'null' if k is None else k}, {n})" for k, n in rows)
        I.save_update(spark.sql(f"SELECT CAST(k AS LONG) AS k, n FROM VALUES {shown} v(k, n)").coalesce(1), number, root, ["k"], ["n"], 20)

    for number in range(120):
        save(number)
        if number in (39, 100):
            save(number)  # a batch that is replayed, once where a snapshot was made
        if number in (18, 39, 113, 119):
            assert {r.k: r.n for r in I.latest(spark, str(tmp_path / "out"), ["k"], ["n"]).collect()} == want
    kept = sorted(p.name for p in (tmp_path / "out" / "run=a").iterdir())
    assert [n for n in kept if n.startswith("snapshot")] == ["snapshot=119", "snapshot=99"]
    assert len([n for n in kept if n.startswith("batch")]) == 20
    assert I._log(spark, root).count() == len(want)
    (tmp_path / "out" / "run=a" / "snapshot=119" / "_SUCCESS").unlink()  # a snapshot that was not finished does not count
    assert {r.k: r.n for r in I.latest(spark, str(tmp_path / "out"), ["k"], ["n"]).collect()} == want
    (tmp_path / "out" / "run=b").mkdir()
    with pytest.raises(ValueError, match="2 runs"):
        I.latest(spark, str(tmp_path / "out"), ["k"], ["n"])


def test_window_edges_and_empty_windows(frame):
    df = frame([("a", 0.0, 0.0, "g", "c"), ("b", 10.0, 5.0, "g", "c"), ("n", float("nan"), 5.0, "g", "c")],
               "transcript_id string, x double, y double, feature_name string, cell_id string")
    win = frame([("w1", 0.0, 10.0, 0.0, 10.0, 1), ("w2", 10.0, 20.0, 0.0, 10.0, 1), ("w3", 50.0, 60.0, 0.0, 10.0, 0)],
                "roi_id string, xmin double, xmax double, ymin double, ymax double, n_transcripts_grid long")
    cut = S.extract_windows(df, win, 10.0)
    assert sorted((r.roi_id, r.transcript_id) for r in cut.collect()) == [("w1", "a"), ("w2", "b")]
    got = {r.roi_id: r.matches_grid for r in S.extraction_receipt(cut, win).collect()}
    assert got == {"w1": True, "w2": True, "w3": True}
    with pytest.raises(Exception, match="differ from the grid"):
        S.extraction_receipt(cut, win.withColumn("n_transcripts_grid", F.lit(7))).collect()


def test_window_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.lit("u").alias("unused")).write.parquet(path)
    win = spark.createDataFrame([("w", 10.0, 20.0, 0.0, 50.0)], "roi_id string, xmin double, xmax double, ymin double, ymax double")
    cut = J.windows_join(spark.read.parquet(path), win, 10.0).select("roi_id", "x")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "parquet" in line)
    assert "GreaterThanOrEqual(x,10.0)" in plan and "unused" not in scan
    assert cut.count() == 10


def test_anchor_choice_prunes_before_the_shuffle(spark):
    from molq.operators.transfer import pick_anchors
    obs = spark.range(1000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cell_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("cell_type"))
    plan = pick_anchors(obs, 20, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
