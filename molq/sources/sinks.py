"""Writers, file manifests and population identity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molq.operators.accounting import cell_gene_counts, derive_cells


def write_standardized(df: DataFrame, directory: str, method: str, tile: float = 500.0) -> None:
    """Transcripts, entities, counts and metadata of one run.

    Transcripts are clustered by spatial tile, so the row-group min/max of x and y skip most of
    the file for a window query. A row hash ends the key, so a crowded tile spreads over files."""
    keys = ["_ty", "_tx", "_h"]
    tx = (df.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile),
                          "_h": F.xxhash64(*df.columns)})
          .repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys))
    tx.write.mode("overwrite").parquet(f"{directory}/transcripts")
    # The other tables come from the written rows, so the molecules are derived and sent once.
    written = df.sparkSession.read.schema(df.schema).parquet(f"{directory}/transcripts")
    write_cell_by_gene(written, directory, {"method": method})
    written.agg(F.count(F.lit(1)).alias("n_transcripts")).withColumn("method_name", F.lit(method)) \
      .coalesce(1).write.mode("overwrite").json(f"{directory}/method_info")


def write_cell_by_gene(df: DataFrame, directory: str, keys: dict[str, str]) -> None:
    """Counts and centroids, partitioned by the given constant keys (dataset, method)."""
    stamp = {k: F.lit(v) for k, v in keys.items()}
    for name, table in (("cell_gene", cell_gene_counts(df, preset="core")),
                        ("cells", derive_cells(df))):
        (table.withColumns(stamp).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy(*keys).parquet(f"{directory}/{name}"))


def recompress(spark: SparkSession, source: str, target: str, codec: str) -> None:
    spark.read.parquet(source).write.mode("overwrite").option("compression", codec).parquet(target)


def file_manifest(spark: SparkSession, paths: str | Sequence[str],
                  root: str | None = None) -> DataFrame:
    """Relative path, size and SHA-256 of every file.

    Only paths and lengths are listed; tasks read the files in pieces, so their size does not matter. The listing deals
    them by size: a large file has a task of its own, small ones share one. Files in stores that only Spark can open are
    hashed as one value each, which ends at 2 GB."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    base = (root or paths[0]).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    name = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    base = re.sub(r"^[a-z0-9]+:/*", "/", base)
    shown = (F.when(name.startswith(base + "/"), F.substring(name, len(base) + 2, 1 << 20)).otherwise(name).alias("path"))
    # By the listing's own path files are left out before they are opened; by the column each would be read whole first.
    open_to_tasks = F.col("_metadata.file_path").rlike("^(file|hdfs|s3|gs|abfs|abfss):")
    listed = files.where(open_to_tasks).select(shown, F.col("length").alias("bytes"), F.col("path").alias("uri"))
    streamed = listed.mapInArrow(_hash_files, "path string, bytes bigint, sha256 string")
    whole = files.where(~open_to_tasks).select(shown, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return streamed.unionByName(whole)


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for uri in batch.column("uri").to_pylist():
            digest = hashlib.sha256()
            files, path = pafs.FileSystem.from_uri(uri)
            with files.open_input_stream(path, compression=None) as source:
                while piece := source.read(1 << 22):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(digests, pa.string())],
                                         ["path", "bytes", "sha256"])


def feature_inventory(df: DataFrame) -> DataFrame:
    return df.select(F.col("feature_name").cast("string")).distinct().orderBy("feature_name")


def population_hash(df: DataFrame, id_col: str = "transcript_id",
                    feature_col: str = "feature_name") -> DataFrame:
    """Order-independent identity of a population: a commutative sum of row hashes plus the
    count, so it needs no sort and no single task."""
    text = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(feature_col).cast("string"), F.lit("")))
    half = lambda at: F.sum(F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", half(1), half(16)).alias("population_hash"))
