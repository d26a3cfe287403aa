import numpy as np
import pytest
from pyspark.sql import functions as F

from molq.operators import accounting as A
from molq.operators import coherence as H
from molq.operators import contract as C
from molq.operators import markers as M
from molq.operators import modelling as L
from molq.operators import pivots as V
from molq.plans import evaluate as E
from molq.sources import matrices

ROWS = [(f"c{i}", f"g{j}", 1 + (i * j) % 4) for i in range(12) for j in range(6) if (i + j) % 3]


@pytest.fixture
def watched(spark):
    """Rows as a table that counts how many of its rows tasks make."""

    def make(rows, ddl):
        made = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, ddl).mapInArrow(count, ddl), made

    return make


def panel(spark):
    return spark.createDataFrame([("g0", "g1", 0.5), ("g1", "g2", -0.4), ("g2", "g4", 0.2)], "gene_i string, gene_j string, value double")


@pytest.mark.parametrize("work", [
    lambda c, s: H.score_counts(c, panel(s)), lambda c, s: H.purity_mean(c, 3), lambda c, s: E.qc_sensitivity(c, panel(s), 3, 30),
    lambda c, s: matrices.tenx_triplets(c), lambda c, s: L.lognorm_sequence(c, 4)], ids="scores purity sensitivity triplets lognorm".split())
def test_counts_are_derived_once(spark, watched, work):
    counts, made = watched(ROWS, "cell_id string, feature_name string, count long")
    work(counts, spark).collect()
    assert made.value == len(ROWS)


def test_rank_genes_derives_values_once(spark, watched):
    counts, made = watched(ROWS, "cell_id string, feature_name string, count long")
    labels = spark.createDataFrame([(f"c{i}", "ab"[i % 2]) for i in range(12)], "cell_id string, cell_type string")
    M.rank_genes(counts, labels, 3, min_cells=1).collect()
    assert made.value == len(ROWS)


def test_strata_and_box_and_files_derive_rows_once(spark, watched, tmp_path):
    scores, made = watched([(f"c{i}", i / 7) for i in range(9)], "cell_id string, entropy double")
    classes = spark.createDataFrame([("c1", "cell"), ("c2", "partial")], "cell_id string, etype string")
    got = {r.stratum: r.n_entities for r in A.stratify_entities(scores, classes, ["entropy"]).collect()}
    assert got == {"whole": 1, "partial": 1, "other": 7} and made.value == 9
    points, made = watched([(f"t{i}", float(i), float(i)) for i in range(41)], "transcript_id string, x double, y double")
    assert {r.x for r in C.center_subset(points, 4.0, 3).collect()} <= {18.0, 19.0, 20.0, 21.0, 22.0}
    assert made.value == 2 * 41  # the extent, then the box
    counts, made = watched(ROWS, "cell_id string, feature_name string, count long")
    matrices.write_tenx_layout(counts, str(tmp_path))
    assert made.value == len(ROWS)


def test_entity_rows_match_the_matrix(spark):
    rows = ROWS + [("c1", None, 3), (None, "g1", 2), ("UNASSIGNED", "g1", 9), ("c2", "zz", 50), ("c99", "zz", 5), ("c3", "g0", 0)]
    counts = spark.createDataFrame(rows, "cell_id string, feature_name string, count long")
    index = spark.createDataFrame([(f"g{j}", j) for j in (0, 1, 2, 4)], "feature_name string, g int")
    got = {r.context: r.genes for r in H.entity_rows(counts, index, 9).collect()}
    want = {}
    for r in H.entity_gene_matrix(counts, panel(spark), 9).collect():
        want.setdefault(r.cell_id, []).append(int(r.feature_name[1:]))
    assert got == {c: sorted(g) for c, g in want.items()}


def unit(rng, n, width):
    v = rng.poisson(0.8, (n, width)).astype(float)
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]


def test_best_of_blocks_is_exact_with_many_ties():
    rng = np.random.default_rng(4)
    queries, anchors = unit(rng, 40, 6), unit(rng, 900, 6)
    anchors[300:600] = anchors[:300]
    names = np.array([f"a{i}" for i in rng.permutation(900)])
    best = V.Best(np.array([f"q{i}" for i in range(40)]), queries, np.full(40, -np.inf), 5, False)
    for lo in range(0, 900, 90):
        best.meet(np.arange(40), anchors[lo:lo + 90], names[lo:lo + 90], names[lo:lo + 90])
    best.rows()
    sims = np.round(np.einsum("ij,kj->ik", queries, anchors), 12) + 0.0
    for q in range(40):
        want = sorted(zip(-sims[q], names))[:5]
        got = sorted(zip(-best.sim[best.row == q], best.anchor[best.row == q]))
        assert [n for _, n in got] == [n for _, n in want]


def test_small_lists_share_a_group(spark):
    sizes = {-1: 3, 0: 40, 1: 50, 2: 30, 3: 500}
    rows = spark.createDataFrame([(name, f"i{j}") for name, m in sizes.items() if name >= 0 for j in range(m)], "list long, id string")
    got = rows.select("list", V.query_groups(sizes, 100).alias("qb")).groupBy("qb").agg(
        F.collect_set("list").alias("lists"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(sorted(r.lists) for r in got if 3 not in r.lists) == [[0, 1], [2]]
    assert sum(r.n for r in got if 3 in r.lists) == 500 and sum(3 in r.lists for r in got) == 5


def test_query_groups_stay_few_while_a_group_fits_a_task():
    for n_queries, width, anchors in ((50_000, 60, 30_000), (480_000, 60, 300_000), (2_900_000, 60, 1_800_000), (2_900_000, 5000, 1_800_000)):
        pivots = min(V.MAX_PIVOTS, V.PIVOT_VALUES // width, -(-anchors // V.BLOCK_ROWS))
        rows = V.group_size(n_queries, width, pivots)
        assert rows * width <= V.QUERY_VALUES and rows * (pivots + 1) <= V.ANGLE_VALUES
        if width == 60:
            assert -(-n_queries // rows) <= 80
    assert V.group_size(10, 1 << 30, 1) == 1


def test_blocks_are_judged_in_pieces_that_fit_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"v{i:03d}", "", list(range(8)), x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cell_id string, label string, idx array<int>, val array<double>")
    for name, value in (("BLOCK_ROWS", 16), ("HOME_ANCHORS", 16), ("NEED_VALUES", 200)):
        monkeypatch.setattr(V, name, value)
    near = np.round(v @ v.T, 12)
    for r in V.pivot_search(df, df, 3, drop_self=True)[0].where("rank = 1").collect():
        i = int(r.cell_id[1:])
        near[i, i] = -2
        assert r.anchor_id == f"v{near[i].argmax():03d}"
