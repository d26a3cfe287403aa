"""Clusters: the same answer whatever the partitions, and planted groups are found."""

import numpy as np
import pytest

from molq.operators import modelling as L


def planted(n: int = 240) -> list[tuple[str, str, int]]:
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        kind = i % 3
        for g in range(24):
            c = int(rng.poisson(9 if g // 8 == kind else 0.4))
            if c:
                rows.append((f"c{i:03d}", f"GENE{g:02d}", c))
    return rows


@pytest.mark.parametrize("parts", [1, 7, 61])
def test_clusters_do_not_depend_on_partitions(spark, frame, parts):
    rows = planted()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.cell_id: r.cluster for r in L.deterministic_clusters(
            frame(rows, "cell_id string, feature_name string, count long").repartition(parts), 3, 6, seed=5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 240
    # Fixed by the first run: the groups of i % 3, each with one label.
    labels = [{got[f"c{i:03d}"] for i in range(kind, 240, 3)} for kind in range(3)]
    assert all(len(s) == 1 for s in labels) and set.union(*labels) == {1, 2, 3}
    if not hasattr(test_clusters_do_not_depend_on_partitions, "answer"):
        test_clusters_do_not_depend_on_partitions.answer = got
    assert got == test_clusters_do_not_depend_on_partitions.answer


def test_clusters_of_few_rows(frame):
    ddl = "cell_id string, feature_name string, count long"
    assert L.deterministic_clusters(frame([], ddl)).collect() == []
    assert [tuple(r) for r in L.deterministic_clusters(frame([("a", "g", 3)], ddl)).collect()] == [("a", 1)]
    same = L.deterministic_clusters(frame([(c, g, 2) for c in "abc" for g in "xyz"], ddl), k=3).collect()
    assert {r.cluster for r in same} == {1}


def test_directions_match_plain_svd(frame):
    rows = planted(60)
    names = sorted({r[0] for r in rows})
    x = np.zeros((60, 24))
    for c, g, n in rows:
        x[names.index(c), int(g[4:])] = n
    x = np.round(np.log1p(x / x.sum(axis=1, keepdims=True) * 1e4) * L.STEPS)
    index = L.cut_lineage(L.feature_index(frame(rows, "cell_id string, feature_name string, count long")))
    whole = L.cut_lineage(L._whole_rows(frame(rows, "cell_id string, feature_name string, count long"), index))
    v = L._principal_directions(whole, 24, 5) / L.UNIT
    plain = np.linalg.svd(x, full_matrices=False)[2][:5].T
    assert np.allclose(np.abs((plain * v).sum(axis=0)), 1.0, atol=1e-5)


def test_too_many_features_is_an_error(frame, monkeypatch):
    monkeypatch.setattr(L, "MAX_FEATURES", 1)
    with pytest.raises(ValueError, match="restrict the panel"):
        L.deterministic_clusters(frame([("a", "g", 1), ("a", "h", 1)], "cell_id string, feature_name string, count long"))
