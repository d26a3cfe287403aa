"""Reshaping into tidy result tables and back into report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.functions import expr as X


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# Metric families that are measured against the held-out reference.
REFERENCE_METRICS = ("rctd_entropy_median", "rctd_max_weight_median", "kendall_tau_median",
                     "pearson_r_median", "spearman_rho_median", "marker_logfc_median")
METRIC_SETS = {
    "mixture": ("rctd_entropy_median", "rctd_max_weight_median"),
    "correlation": ("kendall_tau_median", "pearson_r_median", "spearman_rho_median"),
    "marker": ("marker_logfc_median",),
    "coherence": ("cpmi_purity", "cpmi_conflict", "cpmi_coherence", "cpmi_relative_purity",
                  "cpmi_relative_conflict", "cpmi_relative_coherence"),
    "resource": ("runtime_total_s", "runtime_method_s", "peak_rss_gb"),
    "entity": ("n_entities", "n_whole_cells", "n_partial_cells", "n_reconstructed_cells",
               "mean_transcripts_per_profile", "median_transcripts_per_entity"),
}

ID_COLUMNS = ("dataset", "method", "entity_kind", "status", "run_dir")


def wide_to_long(wide: DataFrame, constants: Mapping[str, object] | None = None,
                 id_cols: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """Melt metrics; a NULL value is not applicable and carries its note as provenance.

    ``<metric>_note`` columns are the reasons. Values stay numeric and nullable."""
    metrics = [c for c in wide.columns if c not in ID_COLUMNS and not c.endswith("_note")]
    notes = {m: (F.col(f"{m}_note") if f"{m}_note" in wide.columns else F.lit(None).cast("string"))
             for m in metrics}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), X.finite(m).alias("value"),
                               notes[m].cast("string").alias("note")) for m in metrics])
    ids = [c for c in id_cols if c in wide.columns]
    long = wide.select(*ids, F.explode(cells).alias("m")).select(*ids, "m.*")
    ok = F.col("value").isNotNull()
    provenance = (F.when(~ok, F.coalesce("note", F.lit("not emitted or structurally not applicable for this method")))
                  .when(F.col("metric").isin(*REFERENCE_METRICS), "held-out evaluation reference")
                  .otherwise("standardized contract"))
    stamp = {k: F.lit(v) for k, v in (constants or {}).items()}
    return long.withColumns({**stamp, "unit": X.metric_unit("metric"), "applicable": ok,
                             "provenance": provenance}).drop("note")


def cost_metrics(resources: DataFrame) -> DataFrame:
    """Cost per million molecules, per area, and the over-request flag.

    resources: method, wall_clock_seconds, peak_rss_gb, memory_requested_gb, n_entities,
    input_tx, area_mm2; any of them may be NULL."""
    per_m = F.col("input_tx") / 1e6
    rows = {
        "runtime_per_1m_transcripts": (X.safe_div("wall_clock_seconds", per_m), "seconds per 1M transcripts",
                                       "derived: wall clock / frozen input population"),
        "peak_rss_gb_per_1m_transcripts": (X.safe_div("peak_rss_gb", per_m), "GiB per 1M transcripts",
                                           "derived: host peak RSS / frozen input population"),
        "peak_rss_exceeds_request": (F.when(F.col("memory_requested_gb") > 0, (
            F.col("peak_rss_gb") > F.col("memory_requested_gb")).cast("double")), "boolean",
            "derived: peak RSS against the requested memory; process-tree sums double-count shared pages"),
        "entities_per_mm2": (X.safe_div("n_entities", "area_mm2"), "entities per mm2",
                             "derived: entities / frozen ROI area"),
    }
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(u).alias("unit"),
                               F.lit(p).alias("provenance")) for m, (v, u, p) in rows.items()])
    out = resources.select("method", F.explode(cells).alias("m")).select("method", "m.*")
    # The request flag is only reported where both numbers exist.
    return out.where((F.col("metric") != "peak_rss_exceeds_request") | F.col("value").isNotNull()) \
              .withColumn("applicable", F.col("value").isNotNull())


def headline(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """Pivot an explicit metric list, so no pass is needed to discover columns."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def method_type_matrix(df: DataFrame, value: str, methods: Sequence[str], row: str = "cell_type") -> DataFrame:
    return df.groupBy(row).pivot("method", list(methods)).agg(F.first(value))


def class_flags(cells: DataFrame, classes: Sequence[str], class_col: str = "spot_class") -> DataFrame:
    """One boolean per known class; an unannotated entity is false everywhere."""
    return cells.select("cell_id", *[F.coalesce(F.col(class_col) == c, F.lit(False)).alias(c) for c in classes])


def comparison_table(df: DataFrame, lead: Sequence[str]) -> DataFrame:
    """Column order: lead, other values, notes."""
    first = [c for c in lead if c in df.columns]
    notes = [c for c in df.columns if c.endswith("_note")]
    return df.select(*first, *[c for c in df.columns if c not in first and c not in notes], *notes)


def metric_subset(long: DataFrame, family: str) -> DataFrame:
    return long.where(F.col("metric").isin(*METRIC_SETS[family]))


def not_applicable_notes(wide: DataFrame, id_cols: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """Long (ids..., metric, note) of every recorded reason."""
    notes = [c for c in wide.columns if c.endswith("_note")]
    ids = [c for c in id_cols if c in wide.columns]
    return (wide.unpivot(ids, notes, "metric", "note").where("note IS NOT NULL")
            .withColumn("metric", F.regexp_replace("metric", "_note$", "")))


def entity_fates(summary: DataFrame, mapping: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Per-method fate rows: which count column plays which fate for which method.

    mapping: method -> (fate_type, count column, label)."""
    columns = sorted({c for _, c, _ in mapping.values()})
    plan = F.create_map(*[x for m, (t, c, lab) in mapping.items() for x in (
        F.lit(m), F.struct(F.lit(t).alias("fate_type"), F.lit(c).alias("source"), F.lit(lab).alias("fate_label")))])
    rows = summary.withColumn("p", F.try_element_at(plan, F.col("method"))).where("p IS NOT NULL")
    count = None
    for c in columns:
        hit = F.col("p.source") == c
        count = F.when(hit, F.col(c).cast("double")) if count is None else count.when(hit, F.col(c).cast("double"))
    return rows.select("method", F.col("p.fate_type").alias("fate_type"), count.alias("count"),
                       F.col("p.fate_label").alias("fate_label"))


def block_matrix(values: DataFrame, datasets: DataFrame, metrics: Mapping[str, str], methods: Sequence[str],
                 not_applicable: DataFrame) -> DataFrame:
    """(dataset, metric) x method with direction; masked cells are NULL even if a value exists.

    metrics: name -> 'higher' or 'lower' is better. not_applicable: method, metric."""
    keys = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(d).alias("better")) for m, d in metrics.items()])
    names = F.array(*[F.lit(m) for m in methods])
    grid = (datasets.select("dataset").distinct().withColumn("k", F.explode(keys))
            .select("dataset", "k.*", F.explode(names).alias("method")))
    mask = not_applicable.select("method", "metric").distinct().withColumn("masked", F.lit(True))
    full = (grid.join(values.select("dataset", "metric", "method", "value"), ["dataset", "metric", "method"], "left")
            .join(mask, ["method", "metric"], "left")
            .withColumn("value", F.when(F.col("masked").isNull(), F.col("value"))))
    return full.groupBy("dataset", "metric", "better").pivot("method", list(methods)).agg(F.first("value"))


def release_comparison(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = lambda d, n: d.select(*keys, F.col("value").alias(n))
    return side(old, "old_value").join(side(new, "new_value"), list(keys), "full").withColumn(
        "delta", F.col("new_value") - F.col("old_value"))


def stack_keyed(tables: Mapping[tuple, DataFrame], key_names: Sequence[str]) -> DataFrame:
    """One long table from many keyed ones."""
    return stack([df.withColumns({n: F.lit(k) for n, k in zip(key_names, key)}) for key, df in tables.items()])


def update_metrics(base: DataFrame, patch: DataFrame, keys: Sequence[str] = ("dataset", "method", "metric")) -> DataFrame:
    """A new version with values replaced where the patch has one."""
    p = patch.select(*keys, F.col("value").alias("_new"))
    return base.join(p, list(keys), "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def fan_out(runs: DataFrame, targets: Mapping[str, Sequence[str]]) -> DataFrame:
    """One run row copied to each component it stands for; other runs stay themselves."""
    plan = F.create_map(*[x for m, ts in targets.items() for x in (F.lit(m), F.array(*[F.lit(t) for t in ts]))])
    return runs.withColumn("method", F.explode(F.coalesce(
        F.try_element_at(plan, F.col("method")), F.array("method"))))


def merge_filtered_sources(full: DataFrame, other: DataFrame, qc_cells: DataFrame,
                           other_note: str) -> DataFrame:
    """Mixture medians per method from two per-cell sources, one restricted to QC cells."""
    from molq.operators.accounting import group_medians
    cut = other.join(qc_cells.select("cell_id").distinct(), "cell_id", "left_semi")
    cols = ("entropy", "max_weight")
    rows = full.select("method", *cols, F.lit(None).cast("string").alias("note")).unionByName(
        cut.select("method", *cols, F.lit(other_note).alias("note")))
    n = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n_cells"), F.max("note").alias("note"))
    return n.join(group_medians(rows, cols, ["method"]), "method")
