"""Readers of molecule and entity tables. Each returns a lazy scan, so Catalyst prunes columns
and pushes filters into the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molq.functions.ordering import dense_index
from molq.operators.contract import rename

TRANSCRIPT_SCHEMA = T.StructType([
    T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType()),
    T.StructField("z", T.FloatType()), T.StructField("feature_name", T.StringType()),
    T.StructField("cell_id", T.StringType()), T.StructField("transcript_id", T.StringType()),
    T.StructField("qv", T.FloatType()), T.StructField("overlaps_nucleus", T.ByteType()),
    T.StructField("original_cell_id", T.StringType()), T.StructField("method", T.StringType())])


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return rename(spark.read.parquet(path), {
        "x_location": "x", "y_location": "y", "z_location": "z", "gene": "feature_name"})


def _text(df: DataFrame, name: str):
    kind = df.schema[name].dataType
    return F.decode(F.col(name), "UTF-8") if isinstance(kind, T.BinaryType) \
        else F.col(name).cast("string")


def read_vendor_transcripts(spark: SparkSession, directory: str) -> DataFrame:
    """Vendor bundle: byte columns become text, a missing z is 0, missing ids are dense numbers in file
    order, stored once so that later scans see the same ids."""
    df = spark.read.parquet(f"{directory}/transcripts.parquet")
    df = df.withColumns({c: _text(df, c) for c in ("feature_name", "cell_id") if c in df.columns})
    if "z_location" not in df.columns:
        df = df.withColumn("z_location", F.lit(0.0))
    if "transcript_id" not in df.columns:
        placed = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_l"))
        df = dense_index(placed, ["_f", "_l"], "transcript_id").drop("_f", "_l")
    return df


def read_vendor_cells(spark: SparkSession, directory: str) -> DataFrame:
    df = spark.read.parquet(f"{directory}/cells.parquet")
    df = df.withColumn("cell_id", _text(df, "cell_id"))
    return rename(df, {"x_centroid": "centroid_x", "y_centroid": "centroid_y",
                       "transcript_counts": "n_transcripts", "cell_area": "area"})


SEGMENTATION_SCHEMA = ("x double, y double, z double, gene string, cell string, "
                       "molecule_id long, transcript_id string, confidence double, "
                       "assignment_confidence double, is_noise string")


def csv_with_header_types(spark: SparkSession, path: str, types: str) -> DataFrame:
    """Read a headed CSV by column *name* with declared types; absent columns stay absent and
    no inference pass over the data is needed."""
    raw = spark.read.option("header", True).csv(path)
    wanted = T._parse_datatype_string(types)
    casts = {f.name: F.col(f.name).try_cast(f.dataType)
             for f in wanted.fields if f.name in raw.columns and f.dataType != T.StringType()}
    return raw.withColumns(casts)


def read_segmentation_csv(spark: SparkSession, path: str) -> DataFrame:
    df = csv_with_header_types(spark, path, SEGMENTATION_SCHEMA)
    if "transcript_id" not in df.columns:
        df = rename(df, {"molecule_id": "transcript_id"})
    df = rename(df, {"cell": "cell_id_method", "gene": "feature_name", "x": "x_location",
                     "y": "y_location", "z": "z_location"})
    return df if "z_location" in df.columns else df.withColumn("z_location", F.lit(0.0))


METADATA_SCHEMA = ("transcript_id long, x double, y double, z double, observed_x double, "
                   "observed_y double, observed_z double, gene string, assignment string, "
                   "background string, qv double")


def read_transcript_metadata_csv(spark: SparkSession, path: str,
                                 partitions: int | None = None) -> DataFrame:
    """CSV(.gz) of molecule metadata. A gzip file is one split, so it is spread out first."""
    df = csv_with_header_types(spark, path, METADATA_SCHEMA)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if path.endswith(".gz") else df


def read_predicted_transcripts(spark: SparkSession, path: str,
                               id_aliases=("predicted_cell_id", "cell_id")) -> DataFrame:
    df = spark.read.parquet(path)
    present = [F.col(c).cast("string") for c in id_aliases if c in df.columns]
    df = df.withColumn("_id", F.coalesce(*present)).drop(*id_aliases)
    return rename(df.withColumnRenamed("_id", "cell_id_method"), {"gene": "feature_name"})
