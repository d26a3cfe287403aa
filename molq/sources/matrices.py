"""Sparse matrix layouts as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molq.functions.ordering import dense_index
from molq.session import stored_table


def _numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of a name list with their 1-based number, in file, block and line order."""
    lines = spark.read.text(path).select(
        F.col("value").alias(name), F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_l"))
    return dense_index(lines, ["_f", "_s", "_l"], "pos").select(name, (F.col("pos") + 1).alias("pos"))


def read_matrix_market(spark: SparkSession, matrix: str, rows: str, cols: str,
                       row_name: str = "cell_id", col_name: str = "feature_name") -> DataFrame:
    """``.mtx`` coordinate file plus two name lists -> (row name, column name, count).

    The size line is the first line after the comments; it is told apart from entries by its
    position in the file, found from one ordered take of the header."""
    lines = spark.read.option("recursiveFileLookup", True).text(matrix)
    # The banner opens the file with the size line, whatever the order in which parts are listed.
    placed = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"),
                          F.monotonically_increasing_id().alias("l"))
    banner = placed.where(F.startswith("value", F.lit("%%MatrixMarket"))).agg(F.min("f").alias("f"))
    place = F.struct("s", "l")
    size_line = (placed.where(~F.startswith("value", F.lit("%")) & (F.length(F.trim("value")) > 0)
                              & (F.col("f") == banner.select("f").scalar()))
                 .agg(F.min_by("value", place).alias("v")).select("v").scalar())
    body = lines.where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))
    parts = F.split(F.trim("value"), r"\s+")
    coords = body.select("value", parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"),
                         F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("1"))
                         .cast("double").alias("count"))
    # The size line repeats the matrix shape; an entry can only equal it if the last cell of the
    # matrix holds exactly nnz counts, so one copy is taken off rather than every equal line.
    hit = F.col("value") == size_line
    entries = coords.where(~hit).drop("value")
    same = coords.where(hit).groupBy("i", "j", "count").agg(F.count(F.lit(1)).alias("n"))
    entries = entries.unionByName(same.where("n > 1").drop("n"))
    r = _numbered_lines(spark, rows, row_name).withColumnRenamed("pos", "i")
    c = _numbered_lines(spark, cols, col_name).withColumnRenamed("pos", "j")
    return entries.join(r, "i").join(c, "j").select(row_name, col_name, "count")


def dense_numbers(df: DataFrame, col: str, name: str) -> DataFrame:
    """(value, 1-based number in name order), numbered across a range partitioning."""
    out = dense_index(df.select(col).distinct(), [col], name)
    return out.withColumn(name, F.col(name) + 1)


def tenx_triplets(counts: DataFrame) -> DataFrame:
    """features x cells triplets with 1-based numbers in name order. The counts are derived once."""
    counts = stored_table(counts.select("cell_id", "feature_name", "count"), "counts")
    f = dense_numbers(counts, "feature_name", "feature_idx")
    c = dense_numbers(counts, "cell_id", "cell_idx")
    return counts.join(f, "feature_name").join(c, "cell_id").select(
        "feature_idx", "cell_idx", "count")


def write_tenx_layout(counts: DataFrame, directory: str) -> None:
    """Three folders of text parts: matrix triplets, features, barcodes. The matrix header is a
    part of its own that sorts first, so no part needs the whole matrix. The counts are derived once."""
    counts = stored_table(counts.select("cell_id", "feature_name", "count"), "counts")
    f = dense_numbers(counts, "feature_name", "feature_idx")
    c = dense_numbers(counts, "cell_id", "cell_idx")
    body = counts.join(f, "feature_name").join(c, "cell_id")
    head = counts.agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(
        " ", f.agg(F.count(F.lit(1))).scalar().cast("string"),
        c.agg(F.count(F.lit(1))).scalar().cast("string"), F.col("n").cast("string")).alias("value"))
    banner = F.concat(F.lit("%%MatrixMarket matrix coordinate integer general\n"), F.col("value"))
    head.select(banner.alias("value")).coalesce(1).write.mode("overwrite").text(
        f"{directory}/matrix/header")
    body.select(F.concat_ws(" ", F.col("feature_idx").cast("string"),
                            F.col("cell_idx").cast("string"), F.col("count").cast("string"))
                .alias("value")).write.mode("overwrite").text(f"{directory}/matrix/entries")
    for table, col, idx in ((f, "feature_name", "feature_idx"), (c, "cell_id", "cell_idx")):
        (table.repartitionByRange(idx).sortWithinPartitions(idx).select(col)
         .write.mode("overwrite").text(f"{directory}/{col}s"))


def triplets_to_wide(counts: DataFrame, features: Sequence[str]) -> DataFrame:
    """Wide counts for an explicit feature list; absent entries are 0.

    Entries are dealt by entity while they are narrow. Otherwise each task would hold a wide row of nearly every
    entity, most of it empty, and send it on."""
    wide = counts.repartition("cell_id").groupBy("cell_id").pivot("feature_name", list(features)).agg(F.sum("count"))
    return wide.na.fill(0, list(features))
