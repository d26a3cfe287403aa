import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions import ordering as O
from molq.operators import coexpression as CX
from molq.operators import modelling as L
from molq.operators import profiles as P
from molq.operators import ranking as R
from molq.operators import stattests as S

numbers = st.lists(st.floats(-1e6, 1e6, allow_nan=False) | st.sampled_from([0.0, 1.0, -1.0, 0.5]), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(numbers)
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = O.quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.97}).first()
    assert [row.a, row.m, row.z] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.97])), rel=1e-9, abs=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(numbers)
def test_average_ranks_match_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r["rank"] for r in O.average_ranks(df, "v").collect()}
    want = pd.Series(values).rank()
    for v, r in zip(values, want):
        assert got[v] == r


def test_quantiles_ignore_undefined_and_keep_groups(frame):
    df = frame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0), ("b", None)], "g string, v double")
    assert {r.g: r.m for r in O.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {"a": 2.0}


def test_normal_tail(spark):
    zs = [-8.0, -2.5, -0.1, 0.0, 0.7, 1.96, 5.0, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", X.normal_upper_tail("z").alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=2e-6)


def brute_tau(x, y):
    s = c = d = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s += a * b
            c += a != 0
            d += b != 0
    return s / math.sqrt(c * d)


def test_kendall_with_ties_and_constant():
    rng = random.Random(1)
    x = np.array([rng.randrange(6) for _ in range(60)], float)
    y = np.array([rng.randrange(6) for _ in range(60)], float)
    assert P.kendall_tau_b(x, y) == pytest.approx(brute_tau(x, y))
    assert P.kendall_tau_b(np.ones(5), x[:5]) is None


def test_constant_profiles_are_undefined(frame):
    pairs = frame([("t", g, 1.0, float(i)) for i, g in enumerate("abc")], "cell_type string, feature_name string, q double, r double")
    assert P.pearson_by_type(pairs).first().pearson_r is None
    assert P.spearman_by_type(pairs).first().spearman_rho is None
    assert P.kendall_by_type(pairs).first().kendall_tau is None


def test_signed_rank_needs_eight_pairs(frame):
    df = frame([("few", float(i), 0.0) for i in range(1, 6)] + [("same", 1.0, 1.0)] * 9
               + [("up", float(i), 0.5) for i in range(1, 12)], "g string, a double, b double")
    got = {r.g: r for r in S.wilcoxon_signed_rank(df, "a", "b", ["g"]).collect()}
    assert got["few"].z is None and got["same"].z is None
    m = 11
    z = (m * (m + 1) / 2 - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24)
    assert got["up"].z == pytest.approx(z) and got["up"].stars == "***"  # exact law


def test_thinning_sizes_and_repeatability(frame):
    rng = random.Random(3)
    counts = frame([(f"c{c}", f"g{g}", rng.randrange(1, 9)) for c in range(20) for g in range(12)], "cell_id string, feature_name string, count long")
    total = lambda d: {r.cell_id: r.n for r in d.groupBy("cell_id").agg(F.sum("count").alias("n")).collect()}
    with_r = CX.thin_counts(counts, 30, 1)
    assert set(total(with_r).values()) == {30}
    rows = lambda d: sorted(map(tuple, d.select("cell_id", "feature_name", "count").collect()))
    assert rows(with_r) == rows(CX.thin_counts(counts.repartition(9), 30, 1))
    assert rows(with_r) != rows(CX.thin_counts(counts, 30, 2))
    without = CX.thin_counts(counts, 30, 1, replace=False)
    assert set(total(without).values()) == {30}
    over = without.withColumnRenamed("count", "k").join(counts, ["cell_id", "feature_name"]).where("k > count")
    assert over.isEmpty()
    small = CX.thin_counts(frame([("s", "g", 4)], "cell_id string, feature_name string, count long"), 10, 1)
    assert total(small) == {"s": 10}


def test_thinning_follows_the_shares(frame):
    counts = frame([(f"c{i}", g, n) for i in range(300) for g, n in (("a", 70), ("b", 20), ("c", 10))], "cell_id string, feature_name string, count long")
    got = {r.feature_name: r.n for r in CX.thin_counts(counts, 50, 9).groupBy("feature_name").agg(F.sum("count").alias("n")).collect()}
    assert got["a"] / 15000 == pytest.approx(0.7, abs=0.02) and got["c"] / 15000 == pytest.approx(0.1, abs=0.02)


def test_fallback_to_the_deepest(frame):
    counts = frame([("a", "g", 5), ("b", "g", 9), ("c", "g", 1)], "cell_id string, feature_name string, count long")
    ids = lambda t, m: sorted(r.cell_id for r in CX.eligible_entities(counts, t, m).collect())
    assert ids(5, 2) == ["a", "b"] and ids(9, 2) == ["a", "b"] and ids(9, 1) == ["b"] and ids(50, 0) == []


def test_split_is_an_exact_partition(frame):
    obs = frame([(f"c{i}", "big" if i % 3 else "small") for i in range(500)] + [("solo", "one")], "cell_id string, cell_type string")
    split = L.stratified_split(obs, 0.2, 4)
    per = {r.cell_type: r for r in L.split_check(split, F.lit(501)).collect()}
    assert per["big"].evaluation_holdout == 67 and per["small"].evaluation_holdout == 33 and per["one"].evaluation_holdout == 0
    again = L.stratified_split(obs.repartition(5), 0.2, 4)
    assert split.exceptAll(again).isEmpty()
    with pytest.raises(Exception, match="disjoint partition"):
        L.split_check(split, F.lit(500)).collect()


def test_ranking_without_metrics(frame):
    runs = frame([("d", 1.0, 0.5, 100.0, 10.0, 1.0, 30.0, 0.1, 0.5), ("d", None, 0.9, 100.0, 10.0, 1.0, 30.0, 0.1, 0.5)],
                 "dataset string, marker_log2fc double, kendall_tau double, n_cells double, runtime_seconds double, peak_memory_gb double, refined_median_tx double, unassigned_frac double, relative_purity double")
    got = {r.kendall_tau: r for r in R.rank_and_penalize(runs).collect()}
    assert got[0.5].mean_rank == 1.5 and got[0.9].mean_rank == 1.0 and got[0.9].rank_marker is None
    assert got[0.9].final_rank == 1 and got[0.9].penalty == 0.0 and got[0.9].penalty_flags == ""


def test_exact_rank_laws(frame):
    import itertools

    from molq.operators.stattests import mann_whitney, wilcoxon_signed_rank
    a, b = [3.1, 0.2, 5.5, 4.4], [1.0, 2.0, 0.5, 6.0, 0.1]
    rows = [("m", v) for v in a] + [("o", v) for v in b]
    pooled = sorted(a + b)
    u = sum(x > y for x in a for y in b)
    every = [sum(x > y for x in pick for y in set(pooled) - set(pick)) for pick in itertools.combinations(pooled, len(a))]
    for side, want in (("greater", sum(v >= u for v in every)), ("less", sum(v <= u for v in every))):
        got = mann_whitney(frame(rows, "method string, v double"), "v", "m", side).first()
        assert got.U == u and got.p_value == pytest.approx(want / len(every))
    d = [0.5, -1.0, 2.0, 3.0, -0.25, 4.0, 6.0, 7.0, -8.0]
    order = sorted(range(9), key=lambda i: abs(d[i]))
    w = sum(k + 1 for k, i in enumerate(order) if d[i] > 0)
    sums = [sum(s) for s in itertools.product(*[(0, k) for k in range(1, 10)])]
    data = frame([("t", x, 0.0) for x in d], "g string, a double, b double")
    for side, want in (("greater", sum(v >= w for v in sums)), ("less", sum(v <= w for v in sums))):
        got = wilcoxon_signed_rank(data, "a", "b", ["g"], side).first()
        assert got.test_method == "exact" and got.statistic == w and got.p_value == pytest.approx(want / 512)
