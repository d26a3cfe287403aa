"""Merkle manifest of a dataset, by time-forward processing.

Every record is a leaf, every group of records (a method, a dataset) a subtree, the subtrees hang
below one root. Two consecutive nodes of a level become their parent; a last single node becomes
a parent of its own, until one node is left.

Node labels grow from children to parents: (level, place). A node sends its digest to its
parent's label through a priority queue, and nodes are taken from the queue in label order, so each
parent finds its children's digests when its turn comes. The queue is external: labels are cut into
blocks of ``2 ** BLOCK_LEVELS`` leaves and as many levels; inside a block the queue is a heap in one
task, of bounded size; what a block sends beyond its own labels (one digest) is written to the
shared folder and put in label order by Spark's sort, for the next block of levels. The reversed sweep
visits the same blocks from the root down: each receives the proof suffix of its top and delivers
to every node its sibling in front of its parent's suffix.

Blocks of a group that holds most records are spread like all others; no task sees more than a
block at a time, and the driver gets counts only.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.functions.ordering import dense_index
from molq.llm.common import frugal, stored
from molq.session import shuffle_width

BLOCK_LEVELS = 12
# One byte in front of each step of a proof: a sibling on the left, on the right, or none.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
STEP = {LEFT[0]: 65, RIGHT[0]: 65, ALONE[0]: 1}
# Columns of the standard transcript table that make up a leaf.
FIELDS = ("transcript_id", "method", "cell_id", "feature_name", "x", "y")


def digest(parts: Sequence[bytes]) -> bytes:
    """Lowercase hex sha256 of the parts in a row."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def record_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of all values: ``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


class BlockTree:
    """The nodes of one block: ``nodes[level][place]``, filled by taking labels from a queue."""

    def __init__(self, leaves: list[bytes], levels: int | None):
        """``levels`` to climb, or None to climb until one node is left."""
        self.nodes: list[list[bytes]] = [list(leaves)]
        queue = [((1, i >> 1), i, d) for i, d in enumerate(leaves)]
        wanted = max(0, len(leaves) - 1).bit_length() if levels is None else levels
        if not wanted:
            return
        while queue:
            label = queue[0][0]
            children = []
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[2])
            level, place = label
            if place == 0:
                self.nodes.append([])
            node = digest(children)
            self.nodes[level].append(node)
            if level < wanted:
                heapq.heappush(queue, ((level + 1, place >> 1), place, node))

    @property
    def top(self) -> bytes:
        return self.nodes[-1][0]

    def proofs(self, suffix: bytes) -> list[bytes]:
        """Of each leaf the steps from its own level to the end of ``suffix``, delivered from the top down."""
        above = [suffix]
        for level in range(len(self.nodes) - 2, -1, -1):
            row, here = self.nodes[level], []
            for i in range(len(row)):
                other = i ^ 1
                step = (RIGHT if other > i else LEFT) + row[other] if other < len(row) else ALONE
                here.append(step + above[i >> 1])
            above = here
        return above


def steps_of(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(proof):
        end = at + STEP[proof[at]]
        yield proof[at:at + 1], proof[at + 1:end]
        at = end


def siblings_digest(proof: bytes) -> bytes:
    return digest([other for _, other in steps_of(proof)])


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that ``leaf`` and its proof lead to."""
    for side, other in steps_of(proof):
        leaf = digest([other, leaf] if side == LEFT else [leaf, other])
    return leaf


def _levels(n: int) -> int | None:
    return BLOCK_LEVELS if n > 1 << BLOCK_LEVELS else None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """((tree, block), its rows): at most one suffix message and a block of nodes at a time."""
    now, held = None, []
    for batch in batches:
        trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
        lo = 0
        for hi in range(1, len(trees) + 1):
            if hi < len(trees) and trees[hi] == trees[lo] and blocks[hi] == blocks[lo]:
                continue
            if held and now != (trees[lo], blocks[lo]):
                yield now, pa.Table.from_batches(held)
                held = []
            now = (trees[lo], blocks[lo])
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield now, pa.Table.from_batches(held)


def _climber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ("tree", "n", "pos", "digest"), (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    out = []
    for (tree, block), rows in _blocks(batches):
        n = rows.column("n")[0].as_py()
        top = BlockTree(rows.column("digest").to_pylist(), _levels(n)).top
        out.append((tree, -(-n >> BLOCK_LEVELS), block, top))
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _messenger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix messages for the blocks below each node of a block."""
    names = ["tree", "block", "suffix", "subroot", "root"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    for (tree, _), rows in _blocks(batches):
        told, nodes = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        tree_of = BlockTree(nodes.column("digest").to_pylist(), _levels(nodes.column("n")[0].as_py()))
        proofs = tree_of.proofs(told["suffix"])
        m = len(proofs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(([tree] * m, nodes.column("pos").to_pylist(), proofs,
                                             [told["subroot"]] * m, [told["root"]] * m), kinds)], names)


def _prover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves with the digest of their proof and the root that the claimed leaf folds to."""
    for _, rows in _blocks(batches):
        told, leaves = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        digests = leaves.column("digest").to_pylist()
        proofs = BlockTree(digests, _levels(leaves.column("n")[0].as_py())).proofs(told["suffix"])
        folded = [fold(c, p).decode() for c, p in zip(leaves.column("claimed").to_pylist(), proofs, strict=True)]
        subroot, root, m = told["subroot"].decode(), told["root"].decode(), len(proofs)
        yield pa.RecordBatch.from_arrays(
            [leaves.column("key").combine_chunks(), pa.array([d.decode() for d in digests]),
             pa.array([subroot] * m), pa.array([root] * m),
             pa.array([siblings_digest(p).decode() for p in proofs]), pa.array(folded), pa.array([f == root for f in folded])],
            ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _by_label(nodes: DataFrame) -> DataFrame:
    dealt = nodes.withColumn("block", F.shiftright("pos", BLOCK_LEVELS))
    return dealt.repartition(shuffle_width(nodes), "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored inputs of every block of levels, lowest first, and (tree, digest) of the tops.

    nodes: tree, n (nodes of that tree), pos, digest."""
    layers, tops, schema = [], None, "tree bigint, n bigint, pos bigint, digest binary"
    while True:
        layers.append(nodes)
        above = stored(_by_label(nodes.select("tree", "n", "pos", "digest")).mapInArrow(frugal(_climber), schema), "nodes")
        done = above.where("n = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        nodes = above.where("n > 1")
        if nodes.isEmpty():
            return layers, tops


def _with_messages(nodes: DataFrame, told: DataFrame) -> DataFrame:
    """Blocks in label order, each behind the message for its top (place -1)."""
    both = nodes.withColumn("block", F.shiftright("pos", BLOCK_LEVELS)).unionByName(
        told.withColumn("pos", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    return both.repartition(shuffle_width(nodes), "tree", "block").sortWithinPartitions("tree", "block", "pos")


def _descend(layers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Messages for the lowest blocks. roots: tree, suffix, subroot, root (one message per tree)."""
    schema = "tree bigint, block bigint, suffix binary, subroot binary, root binary"
    told = None
    for k in range(len(layers) - 1, -1, -1):
        # A tree enters the sweep at the layer where its top was made.
        last = layers[k].where(F.col("n") <= 1 << BLOCK_LEVELS).select("tree").distinct()
        entering = roots.join(last, "tree", "left_semi").withColumn("block", F.lit(0).cast("bigint"))
        told = entering if told is None else told.unionByName(entering)
        if k:
            told = stored(_with_messages(layers[k], told).mapInArrow(frugal(_messenger), schema), "suffixes")
    return told


def dataset_manifest(transcripts: DataFrame, key: str = "transcript_id", by: str = "method",
                     fields: Sequence[str] = FIELDS, claimed: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``transcripts``.

    ``leaf`` is the digest of ``fields`` in their order (see ``record_digest``). Within ``by`` leaves
    ascend by ``key``, subtrees ascend by ``by`` bytewise. ``subroot`` is the top of the row's subtree
    (a single leaf itself), ``root`` the top of all. ``proof_sha256`` is the digest of the siblings from the
    leaf to the root, left to right. ``claimed`` names columns that are presented for checking instead of the
    recorded ones: ``folded_root`` is the root that the leaf of the claimed values and the recorded siblings
    lead to, ``verified`` whether it equals ``root``.

    Nulls are values of their own in every field; a null ``by`` is the first subtree, a null key comes
    first. Rows that repeat a key stand in the order of their leaves, equal rows are leaves side by
    side. Empty and very long texts are hashed whole. An empty table gives an empty result. Columns
    not named are not read, and may have any name.
    """
    columns = {f: F.col(f) for f in fields}
    leaves = transcripts.select(
        F.col(by).alias("by"), F.col(key).alias("key"), record_digest(list(columns.values())).cast("binary").alias("digest"),
        record_digest(list((columns | dict(claimed or {})).values())).cast("binary").alias("claimed"))
    numbered = stored(dense_index(leaves, ["by", "key", "digest"], "place"), "leaves")
    trees = stored(dense_index(numbered.groupBy("by").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")),
                               ["by"], "tree"), "trees")
    same = numbered["by"].eqNullSafe(trees["by"])
    nodes = stored(numbered.join(trees, same).select(
        F.col("tree").cast("bigint").alias("tree"), "n", (F.col("place") - F.col("first")).cast("bigint").alias("pos"),
        "digest", "key", "claimed"), "nodes")
    layers, subroots = _climb(nodes)
    # The subroots are the leaves of the upper tree.
    n_trees = trees.agg(F.count(F.lit(1))).first()[0]
    upper = stored(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("n"),
                                   F.col("tree").alias("pos"), "digest"), "subroots")
    top_layers, root = _climb(upper)
    none = F.lit(b"")
    start = root.select("tree", none.alias("suffix"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    told = _descend(top_layers, start)
    suffixes = _with_messages(top_layers[0], told).mapInArrow(
        frugal(_messenger), "tree bigint, block bigint, suffix binary, subroot binary, root binary")
    messages = stored(suffixes.select(F.col("block").alias("tree"), "suffix", "root")
                      .join(subroots, "tree").select("tree", "suffix", F.col("digest").alias("subroot"), "root"), "messages")
    kind = transcripts.schema[key].dataType.simpleString()
    out = _with_messages(nodes, _descend(layers, messages)).mapInArrow(
        frugal(_prover), f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                         "folded_root string, verified boolean")
    return out.withColumnRenamed("key", key)
