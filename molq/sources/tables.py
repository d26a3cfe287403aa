"""Small tables: references, panels, marker groups, run statistics, checksums, placeholders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molq.functions import expr as X


def read_reference(spark: SparkSession, counts_path: str, obs_path: str,
                   label_col: str = "cell_type") -> tuple[DataFrame, DataFrame]:
    """Labelled reference as (long counts, obs). Raw counts win over a normalised value."""
    counts = spark.read.parquet(counts_path)
    value = next(c for c in ("raw_count", "counts", "count", "value") if c in counts.columns)
    return (counts.select("cell_id", "feature_name", F.col(value).alias("count")),
            spark.read.parquet(obs_path).withColumn(label_col, F.col(label_col).cast("string")))


def pair_value_column(columns: Sequence[str]) -> str:
    for name in ("NPMI", "npmi", "PMI", "pmi", "weight"):
        if name in columns:
            return name
    raise ValueError(f"pair panel has no value column among {list(columns)}")


def symmetric_panel(pairs: DataFrame, value: str | None = None, finite_only: bool = False,
                    order: Sequence[str] = ()) -> DataFrame:
    """(gene_i, gene_j, value) in both directions, without self pairs, first row per direction.

    A file order is not a property of a distributed table, so "first" follows ``order`` and,
    after it, the value itself."""
    value = value or pair_value_column(pairs.columns)
    v = X.finite(value).alias("value")
    base = pairs.select(F.col("gene_i").cast("string"), F.col("gene_j").cast("string"), v,
                        *order).where(F.col("gene_i") != F.col("gene_j"))
    if finite_only:
        base = base.where(F.col("value").isNotNull())
    # The direction as read comes before the swapped one, as in a concatenated file.
    both = base.withColumn("_side", F.lit(0)).unionByName(base.select(
        F.col("gene_j").alias("gene_i"), F.col("gene_i").alias("gene_j"), "value", *order,
        F.lit(1).alias("_side")))
    w = Window.partitionBy("gene_i", "gene_j").orderBy("_side", *order, "value")
    return (both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
            .select("gene_i", "gene_j", "value"))


def read_pair_panel(spark: SparkSession, path: str, value: str | None = None,
                    finite_only: bool = False) -> DataFrame:
    """CSV(.gz) of feature pairs, expanded symmetrically; of repeated pairs the first row of the file
    counts, also when its value is undefined."""
    raw = spark.read.option("header", True).csv(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    return symmetric_panel(raw, value, finite_only, order=("_file", "_block", "_line"))


def read_per_cell_table(spark: SparkSession, path: str, numeric: Sequence[str] = ()) -> DataFrame:
    """TSV per-cell result. The id stays text: ``1`` and ``1.0`` are different ids."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    first = raw.columns[0]
    return raw.withColumnsRenamed({first: "cell_id"}).withColumns(
        {c: F.col(c).try_cast("double") for c in numeric})


def wide_weights_to_long(wide: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """One column per type -> (cell_id, cell_type, weight)."""
    types = [c for c in wide.columns if c != id_col]
    return wide.unpivot([id_col], types, "cell_type", "weight").withColumn(
        "weight", F.col("weight").cast("string").try_cast("double"))


def marker_groups(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Ordered group -> features configuration as (group, group_order, feature_name)."""
    rows = [(g, i, f) for i, (g, members) in enumerate(groups.items()) for f in members]
    return spark.createDataFrame(rows, "group string, group_order int, feature_name string")


def read_marker_groups(spark: SparkSession, path: str) -> DataFrame:
    """A YAML file of ``group: [feature, ...]`` lists, also block lists; a small config file."""
    groups: dict[str, list[str]] = {}
    current = None
    for (line,) in spark.read.text(path).toLocalIterator():
        text = line.split("#", 1)[0].rstrip()
        item = text.strip()
        if not item:
            continue
        if item.startswith("- ") and current is not None:
            groups[current].append(item[2:].strip().strip("'\""))
        elif ":" in item:
            name, rest = item.split(":", 1)
            current = name.strip().strip("'\"")
            inline = rest.strip().strip("[]")
            groups[current] = [p.strip().strip("'\"") for p in inline.split(",") if p.strip()]
    return marker_groups(spark, {g: m for g, m in groups.items() if m})


STATS_SCHEMA = """
schema_version string, method string, modality string, entity_kind string, status string,
sample_name string, dataset string,
runtime struct<total_seconds: double, method_seconds: double,
               by_stage_seconds: map<string, double>>,
memory struct<peak_rss_gb: double, method_peak_rss_gb: double, inprocess_peak_rss_gb: double,
              source: string, note: string>,
entities struct<entity_kind: string, n_entities: long, n_genes: long,
                median_transcripts_per_entity: double, n_whole_cells: long,
                n_partial_cells: long>,
transcripts struct<n_total: long, n_assigned: long, n_unassigned: long, frac_assigned: double,
                   n_input: long, delta_vs_input: long>,
qc map<string, string>,
provenance struct<method_version: string, hostname: string, generated_utc: string>,
_corrupt_record string
"""


def collect_run_stats(spark: SparkSession, root: str,
                      name: str = "benchmark_stats.json") -> DataFrame:
    """Every run-statistics JSON below a root, one row each. A corrupt file becomes a row whose
    status says so instead of failing the scan."""
    raw = (spark.read.schema(STATS_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root))
    return raw.withColumns({
        "run_dir": F.regexp_replace(F.input_file_name(), "/[^/]+$", ""),
        "status": F.when(F.col("_corrupt_record").isNotNull(), "unreadable")
        .otherwise(F.col("status"))}).drop("_corrupt_record")


def flatten_stats(stats: DataFrame, qc_keys: Sequence[str] = ()) -> DataFrame:
    """One comparable row per run; each named qc entry becomes a ``qc_`` column."""
    c = F.col
    return stats.select(
        "method", "modality", "sample_name", "dataset", "status", "entity_kind",
        c("runtime.total_seconds").alias("total_seconds"),
        c("runtime.method_seconds").alias("method_seconds"),
        c("memory.peak_rss_gb").alias("peak_rss_gb"),
        c("memory.method_peak_rss_gb").alias("method_peak_rss_gb"),
        c("memory.source").alias("memory_source"),
        c("entities.n_entities").alias("n_entities"), c("entities.n_genes").alias("n_genes"),
        c("entities.median_transcripts_per_entity").alias("median_transcripts_per_entity"),
        c("transcripts.n_total").alias("n_transcripts_total"),
        c("transcripts.n_assigned").alias("n_transcripts_assigned"),
        c("transcripts.n_unassigned").alias("n_transcripts_unassigned"),
        c("transcripts.frac_assigned").alias("frac_assigned"),
        c("transcripts.n_input").alias("n_transcripts_input"),
        c("provenance.method_version").alias("method_version"),
        c("provenance.hostname").alias("hostname"), "run_dir",
        *[F.try_element_at("qc", F.lit(k)).alias(f"qc_{k}") for k in qc_keys])


def qc_keys(stats: DataFrame) -> list[str]:
    """All distinct qc names, read to the driver because they name columns. ``qc_rows`` has the same
    entries as long rows, whatever their number."""
    keys = stats.select(F.explode(F.map_keys("qc")).alias("k")).distinct().orderBy("k")
    return [r.k for r in keys.collect()]


def qc_rows(stats: DataFrame) -> DataFrame:
    """(run_dir, method, qc_key, qc_value): every qc entry of every run."""
    return stats.select("run_dir", "method", F.explode("qc").alias("qc_key", "qc_value"))


def dummy_row(spark: SparkSession, values: Mapping[str, object], zero_cols: Sequence[str] = (),
              null_cols: Sequence[str] = ()) -> DataFrame:
    """Placeholder row for a run that produced nothing."""
    one = spark.range(1)
    return one.select(*[F.lit(v).alias(k) for k, v in values.items()],
                      *[F.lit(0.0).alias(c) for c in zero_cols],
                      *[F.lit(None).cast("double").alias(c) for c in null_cols])


def combine_checksums(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Stack checksum tables; the panel is the folder each table lies in."""
    return (spark.read.option("header", True).csv(list(paths))
            .withColumn("panel", F.element_at(F.split(F.input_file_name(), "/"), -2)))
