"""Expectations over result tables. Each returns rows of (subject, check, passed, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(df: DataFrame, by: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """Evaluate named aggregate conditions per subject in one pass."""
    names = list(checks)
    row = df.groupBy(*by).agg(*[F.coalesce(c, F.lit(False)).alias(f"_c{i}") for i, c in enumerate(checks.values())])
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_c{i}").alias("passed")) for i, n in enumerate(names)])
    return row.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def run_audit(runs: DataFrame) -> DataFrame:
    """Per run: readable, has rows, has entities, counts consistent, fraction in range, not a stub.

    runs: method, status, n_transcripts_total, n_transcripts_assigned, n_transcripts_unassigned,
    frac_assigned, n_entities."""
    total, a, u = (F.col(f"n_transcripts_{c}") for c in ("total", "assigned", "unassigned"))
    all_of = lambda c: F.min(F.coalesce(c, F.lit(False)))
    return expectations(runs, ["method"], {
        "status_ok": all_of(F.col("status") == "ok"), "has_transcripts": all_of(total > 0),
        "has_entities": all_of(F.col("n_entities") > 0), "counts_consistent": all_of(a + u == total),
        "fraction_in_range": all_of(F.col("frac_assigned").between(0, 1)),
        "not_a_stub": all_of(F.col("n_entities") < a)})


def standardized_audit(df: DataFrame, required: Sequence[str], by: Sequence[str] = ("method",)) -> DataFrame:
    """Non-empty, all required columns present, something assigned."""
    missing = [c for c in required if c not in df.columns]
    return expectations(df, by, {
        "non_empty": F.count(F.lit(1)) > 0, "required_columns": F.max(F.lit(not missing)),
        "has_assigned": F.count_if(F.col("cell_id") != "UNASSIGNED") > 0})


def failures(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("passed"))
