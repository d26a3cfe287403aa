"""Near-duplicate profiles by an epsilon grid order join of embeddings.

Profiles are compared by cosine, within equal labels only. Vectors are scaled to length 1, so a cosine
of at least c is a distance of at most epsilon = sqrt(2 - 2 c).

1. Equal vectors of one label are one class, stood for by the smallest id and its number of rows.
2. Leading principal directions come from sums over all classes, added up in Spark.
3. Classes are range-partitioned and sorted by label and by their grid cells (edge epsilon) on the leading
   directions, and the sequence is cut into blocks of bounded size with a bounding box each.
4. Blocks meet only when their boxes on the principal directions are within epsilon: an equality join
   on label and first-cell slab, then the box test. Each pair of blocks is one small group.
5. In a group the two sequences are joined recursively: intervals whose boxes are too far apart are
   skipped, short intervals are compared by a matrix product. A group hands on the number of links
   of each class and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.llm.common import Forest, components, id_type, rows_of, sorted_groups, stored
from molq.session import shuffle_width

BLOCK = 512
LEAF = 64
GRID_DIMS = 3
BOX_DIMS = 8


def _normaliser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, key, unit): key and unit vector are null for rows that link with nothing."""
    for batch in batches:
        keys, units = [], []
        for label, values in rows_of(batch, "label", "embedding"):
            key = unit = None
            if label is not None and values is not None and len(values) and None not in values:
                vector = np.array(values, float)
                size = np.abs(vector).max()
                if np.isfinite(size) and size > 0:
                    scaled = vector / size
                    unit = (scaled / np.sqrt(scaled @ scaled)).tobytes()
                    key = hashlib.blake2b(vector.tobytes() + label.encode(), digest_size=16).digest()
            keys.append(key)
            units.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()),
                                          pa.array(units, pa.binary())], ["id", "label", "key", "unit"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for (unit,) in rows_of(batch, "unit"):
            v = np.append(np.frombuffer(unit), 1.0)
            held = sums.setdefault(len(v) - 1, np.zeros((len(v), len(v))))
            held += np.multiply.outer(v, v)
    for dims, total in sums.items():
        n = total.size
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(np.arange(n, dtype=np.int64)),
                                          pa.array(total.ravel())], ["dims", "place", "total"])


def principal_directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length: directions (as columns) by falling variance. The driver gets one matrix per length."""
    rows = (classes.mapInArrow(_moments, "dims int, place bigint, total double")
            .groupBy("dims", "place").agg(F.sum("total").alias("total")).collect())
    out = {}
    for dims in {r["dims"] for r in rows}:
        total = np.zeros((dims + 1) ** 2)
        for r in rows:
            if r["dims"] == dims:
                total[r["place"]] = r["total"]
        total = total.reshape(dims + 1, dims + 1) / total[-1]
        covariance = total[:-1, :-1] - np.multiply.outer(total[:-1, -1], total[:-1, -1])
        out[dims] = np.linalg.eigh(covariance)[1][:, ::-1][:, :BOX_DIMS]
    return out


def _gridder(directions: dict[int, np.ndarray], epsilon: float, id_arrow: pa.DataType):
    names = ["id", "rows", "unit", "dims", "label", *[f"c{i}" for i in range(GRID_DIMS)]]

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(u) for (u,) in rows_of(batch, "unit")]
            cells = [np.floor(u @ directions[len(u)][:, :GRID_DIMS] / epsilon) for u in units]
            cells = np.array([np.pad(c, (0, GRID_DIMS - len(c))) for c in cells], np.int32).reshape(len(units), GRID_DIMS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rows"), batch.column("unit"), pa.array([len(u) for u in units], pa.int32()),
                 batch.column("label"), *[pa.array(cells[:, i]) for i in range(GRID_DIMS)]], names)

    return grid


def _blocker(directions: dict[int, np.ndarray], epsilon: float, id_arrow: pa.DataType):
    names = ["block", "label", "dims", "low", "high", "first_slab", "last_slab", "ids", "counts", "units"]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def row() -> pa.RecordBatch:
            dims = held[0][3]
            units = np.frombuffer(b"".join(h[2] for h in held)).reshape(len(held), dims)
            flat = units @ directions[dims]
            low, high = flat.min(axis=0), flat.max(axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{made}"]), pa.array([held[0][4]]), pa.array([dims], pa.int32()),
                 pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64())),
                 pa.array([int(np.floor(low[0] / epsilon))], pa.int32()), pa.array([int(np.floor(high[0] / epsilon))], pa.int32()),
                 pa.array([[h[0] for h in held]], pa.list_(id_arrow)), pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                 pa.array([units.tobytes()], pa.binary())], names)

        for batch in batches:
            for r in rows_of(batch, "id", "rows", "unit", "dims", "label"):
                if held and (len(held) >= BLOCK or held[0][3:] != r[3:]):
                    yield row()
                    made, held = made + 1, []
                held.append(r)
        if held:
            yield row()

    return block


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Squared distance of the bounding boxes of two sets of points."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(gap @ gap)


def _joiner(directions: dict[int, np.ndarray], cosine: float, id_arrow: pa.DataType):
    limit = 2 - 2 * cosine + 1e-9

    def links_of(rows: list[dict]) -> list[tuple]:
        first, second = rows[0], rows[-1]
        same = len(rows) == 1
        left, right = (np.frombuffer(r["units"]).reshape(-1, r["dims"]) for r in (first, second))
        flat_l, flat_r = left @ directions[first["dims"]], right @ directions[first["dims"]]
        n_l, n_r = np.array(first["counts"]), np.array(second["counts"])
        sums_l, sums_r = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        shift = 0 if same else len(left)
        ids = first["ids"] + ([] if same else second["ids"])
        forest, out = Forest(len(ids)), []
        waiting = [(0, len(left), 0, len(right))]
        while waiting:
            a, b, c, d = waiting.pop()
            if same and c < a or _apart(flat_l[a:b], flat_r[c:d]) > limit:
                continue
            if max(b - a, d - c) > LEAF:
                halves_l = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
                halves_r = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
                waiting += [(*p, *q) for p in halves_l for q in halves_r]
                continue
            near = left[a:b] @ right[c:d].T >= cosine
            if same and a == c:
                near = np.triu(near, 1)
            sums_l[a:b] += near @ n_r[c:d]
            (sums_l if same else sums_r)[c:d] += n_l[a:b] @ near
            out += [(ids[x], ids[y], None) for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True)
                    for x, y in ((x + a, y + c + shift),) if forest.join(x, y)]
        totals = sums_l if same else np.concatenate([sums_l, sums_r])
        return out + [(ids[i], None, int(totals[i])) for i in np.flatnonzero(totals).tolist()]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "task"):
            if found := links_of(rows):
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(
                    (id_arrow, id_arrow, pa.int64()))], ["u", "v", "links"])

    return link


def _block_pairs(blocks: DataFrame, limit: float) -> DataFrame:
    """(a, b), a <= b: blocks of one label whose boxes are near enough."""
    boxes = blocks.select("block", "label", "dims", "low", "high", "first_slab", "last_slab")
    one = boxes.select(F.col("block").alias("a"), "label", "dims", F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                       F.explode(F.sequence("first_slab", "last_slab")).alias("slab"))
    other = boxes.select(F.col("block").alias("b"), "label", "dims", F.col("low").alias("low_b"), F.col("high").alias("high_b"),
                         F.explode(F.sequence(F.col("first_slab") - 1, F.col("last_slab") + 1)).alias("slab"))
    gap = F.zip_with(F.arrays_zip("low_a", "high_a"), F.arrays_zip("low_b", "high_b"),
                     lambda p, q: F.greatest(F.lit(0.0), p["low_a"] - q["high_b"], q["low_b"] - p["high_a"]))
    apart = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)
    return one.join(other, ["label", "dims", "slab"]).where(F.col("a") <= F.col("b")).where(apart <= limit).select("a", "b").distinct()


def near_duplicate_profiles(profiles: DataFrame, entity_col: str = "cell_id", vector_col: str = "embedding",
                            label_col: str = "cell_type", cosine: float = 0.93) -> DataFrame:
    """(entity, n_links, component_id, kept) for every row of ``profiles``.

    ``n_links`` counts the other rows of the same label with cosine >= ``cosine`` in double precision;
    ``component_id`` is the smallest id reachable by links, ``kept`` marks the row that stands for its component.
    A null label, a null, empty or zero vector, or one with null or non-finite parts links with nothing, and so do
    vectors of different length. Null id: no links, component null, kept. Rows that repeat an id are counted
    like other rows; where their vectors differ, each gets the links of both. Only the named columns are read. An empty table gives an empty result.
    """
    rows = profiles.select(F.col(entity_col).alias("id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("embedding"))
    kind = id_type(rows, "id")
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    units = stored(rows.mapInArrow(_normaliser, f"id {kind}, label string, key binary, unit binary"), "units")
    classes = stored(units.where("id is not null and key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("unit").alias("unit"), F.first("label").alias("label")), "classes")
    directions = principal_directions(classes)
    epsilon = float(np.sqrt(2 - 2 * cosine))
    cells = [f"c{i}" for i in range(GRID_DIMS)]
    placed = classes.select("id", "rows", "unit", "label").mapInArrow(
        _gridder(directions, epsilon, arrow), f"id {kind}, rows bigint, unit binary, dims int, label string, " + ", ".join(
            f"{c} int" for c in cells))
    order = ["label", "dims", *cells, "id"]
    blocks = stored(placed.repartitionByRange(shuffle_width(classes), *order).sortWithinPartitions(*order).mapInArrow(
        _blocker(directions, epsilon, arrow), "block string, label string, dims int, low array<double>, high array<double>, "
        f"first_slab int, last_slab int, ids array<{kind}>, counts array<bigint>, units binary"), "blocks")
    pairs = stored(_block_pairs(blocks, epsilon * epsilon + 1e-9), "pairs")
    sides = pairs.select(F.concat_ws("|", "a", "b").alias("task"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    dealt = sides.join(blocks.select("block", "dims", "ids", "counts", "units"), "block")
    found = stored(dealt.repartition(shuffle_width(dealt), "task").sortWithinPartitions("task", "block").mapInArrow(
        _joiner(directions, cosine, arrow), f"u {kind}, v {kind}, links bigint"), "links")
    counts = found.where("links is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    grouped = components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("rep"), "component")
    known = (classes.select("key", F.col("id").alias("rep"), "rows").join(counts, "rep", "left").join(grouped, "rep", "left")
             .select("key", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component")))
    return (units.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
            .select(F.col("id").alias(entity_col), "n_links", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))
