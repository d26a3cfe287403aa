"""Block kernels against brute force, with small blocks and skewed inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molq.functions import blocks as B
from molq.operators import coherence as H
from molq.operators import cooccurrence as N
from molq.operators import spatial as S
from molq.operators import pivots as PV
from molq.operators import transfer as T


@pytest.fixture
def corpus(frame):
    rng = random.Random(7)
    rows = [(f"c{c}", f"g{g:02d}") for c in range(60) for g in rng.sample(range(30), rng.randrange(1, 9))]
    rows += [("mega", f"g{g:02d}") for g in range(30)]  # one context that holds every feature
    return rows, frame([(c, g, 1) for c, g in rows], "context string, feature_name string, n int")


def brute_pairs(rows):
    by = {}
    for c, g in rows:
        by.setdefault(c, set()).add(g)
    out = {}
    for gs in by.values():
        for p in itertools.combinations(sorted(gs), 2):
            out[p] = out.get(p, 0) + 1
    return out, by


@pytest.mark.parametrize("share,piece_pairs", [(40, 1 << 22), (3, 50), (1, 7)])
def test_rare_features_are_counted_outside_of_blocks(corpus, monkeypatch, share, piece_pairs):
    monkeypatch.setattr(B, "BLOCK", 4)
    monkeypatch.setattr(B, "HEAVY_SHARE", share)
    monkeypatch.setattr(B, "PIECE_PAIRS", piece_pairs)  # the widest context is dealt over several pieces
    rows, pres = corpus
    want, by = brute_pairs(rows)
    pairs, marg, contexts = N.counted_pairs(pres)
    got = {(r.gene_i, r.gene_j): r for r in pairs.collect()}
    assert {p: r.k_ij for p, r in got.items()} == want
    k = {g: sum(g in gs for gs in by.values()) for g in {g for _, g in rows}}
    assert all((r.k_i, r.k_j) == (k[a], k[b]) for (a, b), r in got.items())
    assert {r.feature_name: r.k_i for r in marg.collect()} == k
    assert marg.select(contexts.alias("n")).first().n == len(by)


def test_pairs_of_no_presence(frame):
    empty = frame([], "context string, feature_name string, n int")
    assert N.pair_cooccurrence(empty).count() == 0 and N.compute_npmi(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_pair_counts(corpus, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rows, pres = corpus
    got = {(r.gene_i, r.gene_j): r.k_ij for r in N.pair_cooccurrence(pres).collect()}
    assert got == brute_pairs(rows)[0]


@pytest.mark.parametrize("block", [1024, 7])
@pytest.mark.parametrize("mode", ["shrink", "hard"])
def test_pair_scores(corpus, frame, monkeypatch, block, mode):
    monkeypatch.setattr(B, "BLOCK", block)
    rows, _ = corpus
    rng = random.Random(2)
    values = {p: rng.uniform(-0.5, 0.5) for p in itertools.combinations([f"g{g:02d}" for g in range(25)], 2) if rng.random() < 0.4}
    panel = frame([(i, j, v) for (i, j), v in values.items()], "gene_i string, gene_j string, value double")
    counts = frame([(c, g, 3) for c, g in rows], "cell_id string, feature_name string, count long")
    raw = H.raw_pair_scores(H.entity_gene_matrix(counts, panel, 1), panel, 0.05, 0.05, mode)
    vocab = {g for p in values for g in p}
    _, by = brute_pairs(rows)
    got = {r.cell_id: r for r in raw.collect()}
    for c, gs in by.items():
        use = sorted(gs & vocab)
        if not use:
            assert c not in got
            continue
        vs = [values[p] for p in itertools.combinations(use, 2) if p in values]
        part = (lambda v: max(v - 0.05, 0)) if mode == "shrink" else (lambda v: v if v > 0.05 else 0)
        want = [len(use), sum(v > 0.05 for v in vs), sum(max(-v, 0) for v in vs), sum(map(part, vs)), sum(part(-v) for v in vs)]
        r = got[c]
        assert [r.k, r.n_pos, r.sum_neg, r.pos_relu, r.neg_relu] == pytest.approx(want)


def test_unit_entities_have_no_score(frame):
    panel = frame([("a", "b", 0.4)], "gene_i string, gene_j string, value double")
    counts = frame([("one", "a", 2), ("two", "a", 1), ("two", "b", 1)], "cell_id string, feature_name string, count long")
    got = {r.cell_id: r for r in H.score_counts(counts, panel).collect()}
    assert got["one"].purity_score is None and got["one"].relative_purity is None
    assert got["two"].purity_score == pytest.approx(0.35) and got["two"].relative_purity == 1.0


@pytest.mark.parametrize("block, part", [(1024, 32), (7, 2)])
def test_replicates_match_their_weights(corpus, frame, monkeypatch, block, part):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "PART", part)
    rows, pres = corpus
    index = B.feature_index(pres)
    pairs, by = brute_pairs(rows)
    wanted = list(pairs)[:40]
    weighted = B.weighted_rows(B.context_rows(pres, index), range(3, 6), 5)
    k = B.replicate_pair_sums(weighted, frame(wanted, "gene_i string, gene_j string"), index, 3).collect()
    m = B.replicate_marginals(weighted, 3).collect()
    names = [r.context for r in weighted.select("context").collect()]
    w = B.replicate_weights(names, range(3, 6), 5, 1.0)
    code = {r.feature_name: r.g for r in index.collect()}
    # One row per pair and part, whatever the number of replicates.
    assert len(k) == len(wanted) * -(-3 // part)
    got = {(r.i, r.j, r.part * part + n): v for r in k for n, v in enumerate(r.k)}
    for i, j in wanted:
        for n in range(3):
            want = sum(w[p, n] for p, c in enumerate(names) if i in by[c] and j in by[c])
            assert got[(code[i], code[j], n)] == want
    total = {(r.g, r.part * part + n): v for r in m for n, v in enumerate(r.m)}
    assert total[(-1, 1)] == w[:, 1].sum()
    assert total[(code["g03"], 2)] == sum(w[p, 2] for p, c in enumerate(names) if "g03" in by[c])


def test_replicate_weights_are_poisson():
    names = [f"c{i}" for i in range(20000)]
    w = B.replicate_weights(names, range(4), 1, 1.0).astype(float)
    assert w.mean() == pytest.approx(1.0, abs=0.02) and w.var() == pytest.approx(1.0, abs=0.04)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    assert (B.replicate_weights(names[:50], range(2, 7), 1, 1.0) == B.replicate_weights(names[:50], range(0, 9), 1, 1.0)[:, 2:7]).all()
    thin = B.replicate_weights(names, range(2), 1, 0.1).astype(float)
    assert thin.mean() == pytest.approx(0.1, abs=0.01)


def test_bootstrap_separates_clear_pairs(frame):
    rng = random.Random(0)
    rows = []
    for c in range(400):
        on = c % 2 == 0
        rows += [(f"c{c}", g) for g in (("a", "b") if on else ("x", "y"))]
        rows += [(f"c{c}", "n1")] * (rng.random() < 0.5) + [(f"c{c}", "n2")] * (rng.random() < 0.5)
    pres = frame([(c, g, 2) for c, g in rows], "context string, feature_name string, n int")
    out = N.bootstrap_npmi(pres, tau=(0.02, 0.3), max_bootstraps=80, coarse_block=40, refine_block=40, min_evidence=5, seed=3)
    got = {(r.gene_i, r.gene_j): r for r in out.collect()}
    assert len(got) == 15
    ab = got[("a", "b")]
    assert ab.kind == "pos_strong" and ab.ci_lo > 0.3 and ab.n_bootstraps == 40 and ab.weight == pytest.approx(ab.legacy_npmi)
    assert got[("a", "x")].kind == "neg_one" and got[("a", "x")].weight == -1.0
    null = got[("n1", "n2")]
    assert null.n_bootstraps == 80 and null.ci_lo < 0 < null.ci_hi and null.weight is None
    again = N.bootstrap_npmi(pres.repartition(5), tau=(0.02, 0.3), max_bootstraps=80, coarse_block=40, refine_block=40, min_evidence=5, seed=3)
    assert {(r.gene_i, r.gene_j): (r.kind, r.median) for r in again.collect()} == {k: (r.kind, r.median) for k, r in got.items()}


@pytest.mark.parametrize("tau,lo,hi,kind", [
    (0.1, 0.2, 0.3, "pos"), (0.1, -0.3, -0.2, "neg"), (0.1, -0.05, 0.05, "dead_zone"), (0.1, -0.2, 0.2, "unsettled"),
    ((0.1, 0.3), 0.35, 0.5, "pos_strong"), ((0.1, 0.3), 0.15, 0.5, "pos_weak"), ((0.1, 0.3), -0.5, -0.35, "neg_strong"),
    ((0.1, 0.3), -0.5, -0.15, "neg_weak"), ((0.1, 0.3), -0.05, 0.05, "tight_null"), ((0.1, 0.3), -0.2, 0.2, "dead_zone"),
    ((0.1, 0.3), -0.4, 0.2, "unsettled")])
def test_interval_kinds(frame, tau, lo, hi, kind):
    df = frame([(lo, hi, 50), (lo, hi, 3)], "lo double, hi double, n int")
    got = [r.k for r in df.select(N.classify_interval(F.col("lo"), F.col("hi"), F.col("n"), tau).alias("k"), "n").orderBy(F.desc("n")).collect()]
    assert got == [kind, "unsettled"]


def test_zero_pairs_and_full_presence(frame):
    pres = frame([(c, g, 2) for c in "pqrs" for g in ("all", "a" if c in "pq" else "b")], "context string, feature_name string, n int")
    got = {(r.gene_i, r.gene_j): r for r in N.compute_npmi(pres, dense=True, set_neg_one=True, thr=0.3).collect()}
    assert got[("a", "b")].NPMI == -1.0 and got[("a", "b")].PMI is None
    assert got[("all", "all")].NPMI is None  # P = 1 leaves 0 / 0
    assert got[("a", "a")].NPMI == pytest.approx(1.0)
    assert len(got) == 6


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_nearest_anchors_over_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(PV, "BLOCK_ROWS", 6)
    monkeypatch.setattr(PV, "HOME_ANCHORS", 6)
    monkeypatch.setattr(PV, "QUERY_ROWS", 9)
    monkeypatch.setattr(PV, "SEARCH_ANCHORS", 10)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 5))
    base[10:22] = base[3]  # a third of the anchors are copies
    rows = [(f"v{i:02d}", [float(x) for x in v]) for i, v in enumerate(base)]
    vec = T.dense_vectors(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v").cache()
    got = {}
    for r in T.knn_graph(vec, 5).collect():
        got.setdefault(r.cell_id, []).append((r["rank"], r.anchor_id))
    for i, (name, v) in enumerate(rows):
        want = sorted(((-round(cosine(v, u), 12), n) for n, u in rows if n != name))[:5]
        assert [a for _, a in sorted(got[name])] == [n for _, n in want]


def brute_nearest(queries, anchors, k, drop_self):
    def sim(a, b):
        return round(cosine(a, b), 12) + 0.0 if np.any(a) and np.any(b) else 0.0

    return {q: [n for _, n in sorted((-sim(v, u), n) for n, u in anchors if not (drop_self and n == q))[:k]] for q, v in queries}


def test_pivot_search_prunes_clusters_and_stays_exact(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 32), ("HOME_ANCHORS", 64), ("QUERY_ROWS", 64)):
        monkeypatch.setattr(PV, name, value)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(25, 12))
    base = centres[rng.integers(0, 25, 1500)] + rng.normal(scale=0.02, size=(1500, 12))
    base[700:900] = base[3]  # many copies in one list
    base[1490:] = 0.0
    rows = [(f"v{i:04d}", [float(x) for x in v], "even" if i % 2 else "odd") for i, v in enumerate(base)]
    vec = T.dense_vectors(spark.createDataFrame(rows, "id string, v array<double>, label string"), "id", "v", "label").cache()
    best, work = PV.pivot_search(vec, vec, 7, drop_self=True)
    got = {}
    for r in best.collect():
        got.setdefault(r.cell_id, []).append((r["rank"], r.anchor_id))
    units = [(n, v) for n, v, _ in rows]
    want = brute_nearest(units, units, 7, True)
    # Copies and rounding at the twelfth digit: compare by similarity, and by name where it is clear.
    close = {n: np.array(v) / (np.linalg.norm(v) or 1) for n, v in units}
    for q, names in want.items():
        mine = [a for _, a in sorted(got[q])]
        assert len(mine) == 7
        assert np.allclose([close[q] @ close[a] for a in mine], [close[q] @ close[a] for a in names], atol=1e-11)
    assert [a for _, a in sorted(got["v1499"])] == [f"v{i:04d}" for i in range(7)]
    done = work.first()
    assert (done.queries, done.anchors) == (1500, 1500) and done.compared < 1500 * 1500 / 4


def test_pivot_search_without_anchors_or_queries(spark):
    vec = T.dense_vectors(spark.createDataFrame([("a", [1.0, 0.0], "x")], "id string, v array<double>, label string"), "id", "v", "label")
    assert PV.pivot_search(vec, vec.where("false"), 3)[0].collect() == []
    assert PV.pivot_search(vec.where("false"), vec, 3)[0].collect() == []
    assert [(r.anchor_id, r.similarity) for r in PV.pivot_search(vec, vec, 3)[0].collect()] == [("a", 1.0)]


def test_transfer_refuses_too_few_shared_features(frame):
    q = frame([("q1", "g1", 3)], "cell_id string, feature_name string, count long")
    obs = frame([("q1", "A")], "cell_id string, cell_type string")
    with pytest.raises(ValueError, match="1 shared features"):
        T.transfer_labels(q, q, obs)


def test_zero_overlap_anchors_fill_k(frame):
    q = frame([("q1", "g1", 3), ("q2", "only_q", 2)], "cell_id string, feature_name string, count long")
    r = frame([("r1", "g1", 2), ("r2", "g2", 1), ("r3", "g3", 1)], "cell_id string, feature_name string, count long")
    obs = frame([("r1", "A"), ("r2", "B"), ("r3", "B")], "cell_id string, cell_type string")
    got = {x.cell_id: x for x in T.transfer_labels(q, r, obs, k=3, per_type=9, min_shared=1).collect()}
    assert got["q1"].predicted_celltype == "B" and got["q1"].n_neighbors_voting == 2
    assert got["q1"].confidence == pytest.approx(2 / 3) and got["q2"].predicted_celltype == "B"


def test_plane_neighbours_with_a_crowded_place(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 10)
    rng = random.Random(5)
    pts = [(f"p{i:03d}", rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(120)]
    pts += [(f"s{i:03d}", 30.0, 30.0) for i in range(60)]  # a third at one coordinate
    pts.append(("nan", float("nan"), 1.0))
    cells = spark.createDataFrame(pts, "cell_id string, x double, y double")
    got = {}
    for r in S.spatial_knn(cells, 4, 8.0).collect():
        got.setdefault(r.cell_id, []).append((r["rank"], r.neighbour))
    real = pts[:-1]
    for name, x, y in real:
        d = sorted(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in real if n != name)
        want = [n for v, n in d if v <= 64.0][:4]
        assert [n for _, n in sorted(got.get(name, []))] == want
    assert "nan" not in got


def test_nearest_one_widens_until_settled(frame):
    q = frame([("a", 0.0, 0.0), ("far", 5000.0, 5000.0)], "id string, x double, y double")
    c = frame([("n", 1.0, 1.0), ("m", 3.0, 0.0)], "id string, x double, y double")
    got = {r.id: r.neighbour for r in S.nearest_one(q, c, 2.0).collect()}
    assert got == {"a": "n", "far": "m"}


def test_hulls_match_brute_force(spark):
    rng = random.Random(8)
    pts = [("c1", rng.randrange(20), rng.randrange(20)) for _ in range(200)] + [("line", i, i) for i in range(5)] + [("two", 0, 0), ("two", 1, 1)]
    df = spark.createDataFrame([(c, float(x), float(y), 1) for c, x, y in pts], "cell_id string, x double, y double, overlaps_nucleus int").repartition(5)
    out = {}
    for r in S.molecule_outlines(df, True, min_points=1).orderBy("cell_id", "vertex_idx").collect():
        out.setdefault(r.cell_id, []).append((r.vertex_x, r.vertex_y))
    c1 = [(float(x), float(y)) for c, x, y in pts if c == "c1"]
    corners = set()
    for p in set(c1):  # a corner is an end of some edge with every point on one side
        for q in set(c1):
            if p != q:
                side = [(q[0] - p[0]) * (t[1] - p[1]) - (q[1] - p[1]) * (t[0] - p[0]) for t in c1]
                flat = [t for t, s in zip(c1, side) if s == 0]
                if min(side) >= 0 and all(min(p, q) <= t <= max(p, q) for t in flat):
                    corners |= {p, q}
    assert set(out["c1"]) == corners and out["c1"][0] == min(corners)
    area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(out["c1"], out["c1"][1:] + out["c1"][:1]))
    assert area > 0  # counter-clockwise
    assert len(out["line"]) == 8 and out["line"][0] == pytest.approx((4.0, 2.0))
    assert out["two"][0] == pytest.approx((5.5, 0.5))


def test_nearest_one_without_candidates(frame):
    q = frame([("a", 0.0, 0.0), ("b", float("nan"), 1.0)], "id string, x double, y double")
    assert S.nearest_one(q, q.limit(0), 2.0).collect() == []
    assert [r.id for r in S.nearest_one(q, q.where("id = 'a'"), 2.0).collect()] == ["a"]


def test_pair_work_follows_the_rows_not_the_settings(spark):
    from molq.functions import blocks as B
    rows = spark.range(5000).selectExpr("cast(id as string) AS context", "sort_array(array(cast(id % 40 as int), cast(1100 + id % 7 as int))) AS genes")
    shards = {(r.bi, r.bj): r.shards for r in B.block_pair_shards(rows, 1000).collect()}
    assert shards == {(0, 0): 5, (0, 1): 5, (1, 1): 5}
    panel = spark.createDataFrame([(0, 0, [0], [1], [0.5]), (1, 1, [0], [1], [0.5])], "bi int, bj int, a array<int>, b array<int>, v array<double>")
    for width in ("3", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        streamed = B.stream_with_blocks(rows, panel, "context", 2500)
        assert streamed.where("kind = 0").count() == 4 and streamed.where("kind = 1").count() == 15000
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_replicate_weights_above_rate_one():
    from molq.functions.blocks import replicate_weights
    w = replicate_weights([f"c{i}" for i in range(20000)], range(3), 1, 40.0).astype(float)
    assert abs(w.mean() - 40) < 0.2 and w.max() > 60 and abs(w.var() - 40) < 1.5


def test_ranks_and_lowest_rows(frame):
    from molq.functions.ordering import lowest_rows, min_ranks, value_bucket
    data = frame([("d", i, float(v) if v is not None else None) for i, v in enumerate([3, 1, 3, None, 2, 1])], "dataset string, i int, v double")
    assert [r.k for r in min_ranks(data, "v", ["dataset"], "k", True).orderBy("i").collect()] == [1, 4, 1, None, 3, 4]
    low = lowest_rows(data.where("v is not null"), 3, value_bucket("v"), ["v", "i"])
    assert sorted(r.i for r in low.collect()) == [1, 4, 5]
    assert lowest_rows(data.where("v is not null"), 99, value_bucket("v"), ["v", "i"]).count() == 5
