import pytest
from pyspark.sql import functions as F

from molq.operators import accounting as A
from molq.operators import coherence as H
from molq.operators import contract as C
from molq.operators import joins as J


def as_dict(df):
    return df.first().asDict()


def test_four_literal_rows(frame):
    raw = frame([(1.0, 2.0, "A", "c1"), (3.0, 4.0, "B", ""), (5.0, 6.0, "A", "NA"), (7.0, 8.0, "C", "c2")],
                "x_location double, y_location double, gene string, my_cell string")
    out = C.standardize_transcripts(raw, "m", {"x_location": "x", "y_location": "y", "gene": "feature_name", "my_cell": "cell_id"})
    assert out.columns == ["x", "y", "feature_name", "cell_id", "method", "whole_partial_status"]
    assert [r.cell_id for r in out.orderBy("x").collect()] == ["c1", "UNASSIGNED", "UNASSIGNED", "c2"]
    report = as_dict(C.validate_schema(out, "m"))
    assert (report["n_transcripts_assigned"], report["n_transcripts_unassigned"], report["n_unique_cells"]) == (2, 2, 2)
    assert report["frac_assigned"] == 0.5


def test_bad_numbers_become_null_and_z_defaults(frame):
    raw = frame([("1.5", "oops", None, "g", None)], "x string, y string, z string, feature_name string, cell_id string")
    row = C.standardize_transcripts(raw, "m").first()
    assert row.x == 1.5 and row.y is None and row.z == 0.0 and row.cell_id == "UNASSIGNED"


def test_missing_columns_are_an_error(frame):
    raw = frame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        C.standardize_transcripts(raw, "m")
    with pytest.raises(ValueError):
        C.validate_schema(raw, "m")


def test_recovery_rows(frame):
    df = frame([("UNASSIGNED", "c1", "cell"), ("-1", "UNASSIGNED", "unknown"), ("c2", "c2", "cell"), ("c3", "UNASSIGNED", "unknown")],
               "original_cell_id string, cell_id string, etype string")
    row = as_dict(A.recovery_metrics(df))
    assert row["n_transcripts_initially_unassigned"] == 2 and row["n_transcripts_recovered"] == 1
    assert row["recovery_percent"] == 50.0
    none = as_dict(A.recovery_metrics(df.where("original_cell_id LIKE 'c%'")))
    assert none["recovery_percent"] is None and "no unassigned" in none["recovery_percent_note"]


def test_coherence_is_a_median_of_differences(frame):
    scores = frame([(0.9, 0.1, 0.8, 0.2), (0.4, 0.2, 0.5, 0.2)],
                   "purity_score double, conflict_score double, relative_purity double, relative_conflict double")
    row = as_dict(H.coherence_medians(scores))
    assert row["cpmi_coherence"] == pytest.approx(0.5)
    assert row["cpmi_relative_coherence"] == pytest.approx(0.45)


def test_empty_input(frame):
    empty = frame([], "x double, y double, feature_name string, cell_id string, method string")
    assert as_dict(A.transcript_accounting(empty))["frac_assigned"] is None
    assert C.validate_schema(empty, "m").first().frac_assigned == 0.0
    assert A.entity_accounting(empty).first().n_entities == 0


def test_row_predictions_reject_duplicates(frame):
    src = frame([(0, "a"), (1, "b")], "row_idx long, cell_id string")
    pred = frame([(0, "n1", 0.9, 0.5), (1, "n2", 0.1, 0.5)], "row_idx long, predicted_cell_id string, similarity double, similarity_threshold double")
    got = {r.row_idx: (r.cell_id, r.original_cell_id) for r in C.adapt_row_predictions(src, pred).collect()}
    assert got == {0: ("n1", "a"), 1: ("UNASSIGNED", "b")}
    with pytest.raises(Exception, match="not unique"):
        C.adapt_row_predictions(src, pred.union(pred)).collect()


def test_positional_join_needs_a_clean_index(frame):
    src = frame([(0, "t0"), (1, "t1")], "row_idx long, transcript_id string")
    take = {"transcript_id": "transcript_id"}
    good = J.positional_join(frame([(1,), (2,)], "molecule_id long"), src, "molecule_id", take)
    assert sorted(r.transcript_id for r in good.collect()) == ["t0", "t1"]
    for bad in ([(1,), (1,)], [(1,), (3,)], [(0,), (1,)]):
        out = J.positional_join(frame(bad, "molecule_id long"), src, "molecule_id", take)
        assert all(r.transcript_id is None for r in out.collect())


def test_verified_join_fails_on_breach(frame):
    left = frame([(1, 101), (2, 102)], "k long, delivered long")
    right = frame([(1, 1, 1, 101), (2, 2, 2, 102)], "k long, prior long, prior_check long, produced long")
    run = lambda l, r: J.verified_total_join(l, r, "k", "prior", "prior_check", "delivered", "produced").collect()
    assert run(left, right)[0].checked == "1:1 and total"
    with pytest.raises(Exception, match="unmapped"):
        run(left, right.where("k = 1"))
    with pytest.raises(Exception, match="not unique"):
        run(left, right.union(right))
    with pytest.raises(Exception, match="already are the prior"):
        run(left.withColumn("delivered", F.col("k")), right.withColumn("produced", F.col("k")))


def test_raster_axes_are_checked(frame):
    df = frame([(0, 2), (1, 0)], "y_pixel long, x_pixel long")
    raster = frame([(y, x, 0.5) for y in range(2) for x in range(3)], "y_pixel long, x_pixel long, signal_integrity double")
    assert J.raster_lookup(df, raster).count() == 2
    swapped = raster.select(F.col("x_pixel").alias("y_pixel"), F.col("y_pixel").alias("x_pixel"), "signal_integrity")
    with pytest.raises(Exception, match="axes may be swapped"):
        J.raster_lookup(df, swapped).collect()


def test_ids_that_differ_only_by_type_stay_apart(frame):
    cells = frame([("1",), ("1.0",)], "cell_id string")
    labels = frame([("1", "T")], "cell_id string, cell_type string")
    got = {r.cell_id: r.cell_type for r in J.align_labels(cells, labels).collect()}
    assert got == {"1": "T", "1.0": None}


def test_samples_are_exact_and_repeatable(frame):
    df = frame([(f"t{i}", float(i % 10), 0.0) for i in range(200)], "transcript_id string, x double, y double")
    a = {r.transcript_id for r in C.subsample(df, 50, 1).collect()}
    b = {r.transcript_id for r in C.subsample(df.repartition(7), 50, 1).collect()}
    assert a == b and len(a) == 50 and a != {r.transcript_id for r in C.subsample(df, 50, 2).collect()}
    near = C.center_subset(df, 2.0, 30, 1).collect()
    assert len(near) == 30 and all(abs(r.x - 4.5) <= 1.0 for r in near)
    assert C.center_subset(df.where("x IN (0, 9)"), 1.0, 5, 1).count() == 5
