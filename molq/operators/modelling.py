"""Clusters, batch scaling, variable features and reference splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molq.functions import expr as X
from molq.functions.blocks import ROWS, _dense, _ragged, feature_index, pair_products
from molq.functions.ordering import drawn
from molq.operators.profiles import log_normalize
from molq.session import cut_lineage, stored_table

MAX_FEATURES = 8192
SAMPLE = 4096
STEPS = 256.0
UNIT = float(1 << 20)


def _whole_rows(counts: DataFrame, index: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell_id, idx, val): log-normalised rows in whole steps of 1 / STEPS."""
    rows = counts.join(index, "feature_name").groupBy("cell_id").agg(
        F.sort_array(F.collect_list(F.struct("g", F.col("count").cast("double").alias("c")))).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["c"])
    value = lambda x: F.round(F.log1p(x["c"] / F.col("total") * target) * STEPS)
    return rows.withColumn("total", F.when(total == 0, 1.0).otherwise(total)).select(
        "cell_id", F.col("p.g").alias("idx"), F.transform("p", value).alias("val"))


def _principal_directions(rows: DataFrame, width: int, dims: int) -> np.ndarray:
    """Leading eigenvectors of the Gram matrix (width x dims, in whole steps of 1 / UNIT). Its entries are sums of whole
    numbers, so they do not depend on the order of summation; the largest entry of a vector is positive."""
    gram = np.zeros((width, width))
    pairs = pair_products(rows.select(F.col("cell_id").alias("context"), F.col("idx").alias("genes"), F.col("val").alias("vals")), True)
    squares = (rows.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("i"))
               .agg(F.sum(F.col("e.val") * F.col("e.val")).alias("s")))
    found = pairs.unionByName(squares.select("i", F.col("i").alias("j"), "s")).toPandas()
    i, j, v = (found[c].to_numpy() for c in ("i", "j", "s"))
    gram[i, j] = gram[j, i] = v
    vectors = np.linalg.eigh(gram)[1][:, ::-1][:, :dims]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.round(vectors * UNIT)


def _projected(flat, owner, n: int, vals, directions: np.ndarray) -> np.ndarray:
    """Whole-numbered coordinates; every intermediate sum is a whole number below 2 ** 53, so it is exact."""
    return np.floor(_dense(flat, owner, n, directions.shape[0], vals) @ directions / UNIT)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre, ties to the first; exact on whole numbers."""
    return ((centres * centres).sum(axis=1)[None, :] - 2.0 * (points @ centres.T)).argmin(axis=1)


def _moved(sums: np.ndarray, sizes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rounded means; a centre without points stays."""
    return np.where(sizes[:, None] > 0, np.floor(sums / np.maximum(sizes, 1)[:, None] + 0.5), centres)


def _seeded_centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ and Lloyd steps on a bounded sample."""
    draw = np.random.default_rng(seed)
    centres = points[draw.integers(len(points))][None, :]
    while len(centres) < k:
        gap = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        if not gap.any():
            break  # fewer different points than centres
        centres = np.vstack([centres, points[np.searchsorted(np.cumsum(gap), draw.random() * gap.sum())]])
    for _ in range(100):
        label = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, points)
        moved = _moved(sums, np.bincount(label, minlength=len(centres)), centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres


def _labeller(directions: np.ndarray, centres: np.ndarray, sums: bool):
    """Labels of rows, or per batch the number of rows and the coordinate sums of each label."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                n = min(lo + ROWS, batch.num_rows) - lo
                flat, owner = _ragged(batch.column("idx"), lo, lo + n)
                points = _projected(flat, owner, n, _ragged(batch.column("val"), lo, lo + n)[0], directions)
                at = _nearest(points, centres)
                if not sums:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("cell_id").slice(lo, n), pa.array((at + 1).astype(np.int32))], ["cell_id", "cluster"])
                    continue
                total = np.zeros((len(centres), centres.shape[1] + 1))
                np.add.at(total, at, np.hstack([np.ones((n, 1)), points]))
                c, d = np.nonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c), pa.array(d), pa.array(total[c, d].astype(np.int64))], ["centre", "part", "s"])

    return label


def deterministic_clusters(counts: DataFrame, k: int = 12, components: int = 50, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """(cell_id, cluster): log-normalise, project on the leading singular directions, k-means.

    The answer depends on the counts, ``k``, ``components`` and ``seed`` only, not on partitions or the order in which
    tasks finish: values, directions, coordinates and centres are whole numbers, so all sums are exact. Centres
    start on a sample of SAMPLE entities of lowest drawn number and then move over all entities until they
    stand still or ``max_iter`` passes are done. Labels are 1-based; between seeds they are comparable only up to
    their names. The driver holds the Gram matrix of the features, so panels are limited to MAX_FEATURES of them.
    """
    counts = cut_lineage(counts.select("cell_id", "feature_name", "count"))
    index = cut_lineage(feature_index(counts))
    width = index.count()
    if width > MAX_FEATURES:
        raise ValueError(f"{width} features; restrict the panel to {MAX_FEATURES}")
    rows = cut_lineage(_whole_rows(counts, index))
    first = rows.orderBy(drawn(seed, "cell_id"), "cell_id").limit(SAMPLE).select("idx", "val").toArrow()
    n = first.num_rows
    if not n:
        return rows.select("cell_id", F.lit(0).alias("cluster"))
    dims = int(min(components, max(1, min(n, width) - 1)))
    directions = _principal_directions(rows, width, dims)
    points = np.vstack([_projected(*_ragged(b.column("idx"), 0, b.num_rows), b.num_rows, _ragged(b.column("val"), 0, b.num_rows)[0], directions)
                        for b in first.to_batches() if b.num_rows])
    centres = _seeded_centres(points, int(min(k, n)), seed)
    for _ in range(max_iter):
        found = (rows.select("idx", "val").mapInArrow(_labeller(directions, centres, True), "centre bigint, part bigint, s bigint")
                 .groupBy("centre", "part").agg(F.sum("s").alias("s")).toPandas())
        total = np.zeros((len(centres), dims + 1))
        total[found["centre"], found["part"]] = found["s"]
        moved = _moved(total[:, 1:], total[:, 0], centres)
        if (moved == centres).all():
            break
        centres = moved
    kind = counts.schema["cell_id"].dataType.simpleString()
    return rows.mapInArrow(_labeller(directions, centres, False), f"cell_id {kind}, cluster int")


def batch_feature_stats(values: DataFrame, batches: DataFrame, value: str = "value") -> DataFrame:
    """(batch, feature_name, mean, sd, zero_value) with absent entries counted as zeros."""
    n = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    v = F.col(value)
    s = values.join(batches, "cell_id").groupBy("batch", "feature_name").agg(
        F.sum(v).alias("s"), F.sum(v * v).alias("q")).join(n, "batch")
    mean = F.col("s") / F.col("n")
    var = F.when(F.col("n") > 1, F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    sd = F.when(F.sqrt(var) > 0, F.sqrt(var)).otherwise(1.0)
    return s.select("batch", "feature_name", mean.alias("mean"), sd.alias("sd"), (-mean / sd).alias("zero_value"))


def scale_by_batch(values: DataFrame, batches: DataFrame, value: str = "value") -> DataFrame:
    """z-scores of the stored entries within their batch. What an absent entry scales to is the
    ``zero_value`` of ``batch_feature_stats``, so the table stays sparse."""
    stats = batch_feature_stats(values, batches, value)
    return values.join(batches, "cell_id").join(stats, ["batch", "feature_name"]).select(
        "batch", "cell_id", "feature_name", ((F.col(value) - F.col("mean")) / F.col("sd")).alias("scaled"))


def merge_samples(samples: Mapping[str, DataFrame], batch_col: str = "batch") -> DataFrame:
    """Concatenate with a batch key; a repeated column keeps its first copy."""
    out = None
    for name, df in samples.items():
        first = [c for i, c in enumerate(df.columns) if c not in df.columns[:i]]
        part = (df if len(first) == len(df.columns) else df.toDF(*[
            c if df.columns.index(c) == i else f"_dup{i}" for i, c in enumerate(df.columns)]).select(*first))
        part = part.withColumn(batch_col, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def variable_features(values: DataFrame, n_cells, top: int = 2000, value: str = "value") -> DataFrame:
    """Features ranked by dispersion = variance / mean over all entities, zeros included. The
    formula is ours; the packages differ in theirs."""
    v = F.col(value)
    n = n_cells.cast("double")
    s = values.groupBy("feature_name").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.col("s") / n
    var = X.safe_div(F.col("q") - n * mean * mean, n - 1)
    disp = s.select("feature_name", mean.alias("mean"), X.safe_div(var, mean).alias("dispersion"))
    # One row per feature reaches this window.
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("dispersion"), "feature_name")
    return disp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def lognorm_sequence(counts: DataFrame, top: int = 2000) -> DataFrame:
    """log-normalise, keep variable features, scale."""
    # Dispersion, scale and result read the values, so they are derived once and each stage sorts little.
    values = stored_table(log_normalize(counts), "values")
    counts = values
    ids = counts.select("cell_id").distinct()
    keep = variable_features(values, ids.agg(F.count(F.lit(1))).scalar(), top)
    cut = values.join(keep.select("feature_name"), "feature_name", "left_semi")
    return scale_by_batch(cut, ids.withColumn("batch", F.lit("all"))).drop("batch")


def stratified_split(obs: DataFrame, fraction: float = 0.2, seed: int = 0, label: str = "cell_type",
                     exclude: Sequence[str] = ()) -> DataFrame:
    """Per label: n_holdout = min(N - 1, max(1, round(N * fraction))), chosen by hashed order.

    Depends only on the seed, the labels and the ids. Positions inside a label come from bucket
    counts of the hash, so a label that holds most rows is not ordered in one task."""
    rows = obs.where(F.col(label).isNotNull() & ~F.col(label).isin(*exclude)) if exclude else \
        obs.where(F.col(label).isNotNull())
    rows = rows.select(F.col("cell_id"), F.col(label).alias("cell_type")).withColumn(
        "h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "cell_type", "cell_id"), 256))
    rows = rows.withColumn("b", F.substring("h", 1, 3))
    counts = rows.groupBy("cell_type", "b").agg(F.count(F.lit(1)).alias("bn"))
    w = Window.partitionBy("cell_type")
    counts = counts.withColumns({
        "before": F.sum("bn").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bn"),
        "n": F.sum("bn").over(w)})
    inside = F.row_number().over(Window.partitionBy("cell_type", "b").orderBy("h", "cell_id"))
    n_hold = F.least(F.col("n") - 1, F.greatest(F.lit(1).cast("double"), F.bround(F.col("n") * F.lit(fraction), 0)))
    placed = rows.join(counts, ["cell_type", "b"]).withColumn("pos", F.col("before") + inside)
    return placed.select("cell_id", "cell_type", F.when(F.col("pos") <= n_hold, "evaluation_holdout")
                         .otherwise("reference_train").alias("reference_split"))


def split_check(split: DataFrame, obs_count) -> DataFrame:
    """Strata sizes; fails unless every entity is on exactly one side."""
    per = split.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reference_split") == "reference_train").alias("reference_train"),
        F.count_if(F.col("reference_split") == "evaluation_holdout").alias("evaluation_holdout"))
    bad = (split.agg(F.count(F.lit(1)) != F.countDistinct("cell_id")).scalar()
           | (split.agg(F.count(F.lit(1))).scalar() != obs_count))
    return per.withColumn("is_partition", F.when(bad, F.raise_error(
        F.lit("split is not an exact, disjoint partition")).cast("boolean")).otherwise(True))


def restrict_with_depth(counts: DataFrame, panel: DataFrame) -> DataFrame:
    """Panel counts with the full library depth taken before the restriction."""
    depth = F.sum("count").over(Window.partitionBy("cell_id"))
    return counts.withColumn("full_library_total_counts", depth).join(
        panel.select("feature_name").distinct(), "feature_name", "left_semi")
