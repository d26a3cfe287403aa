"""Removal of recurring feature runs (substring dedup) with sharded Aho-Corasick automata.

A window is ``width`` consecutive words of one entity's text. Every word covered by a window whose
word sequence also starts in an entity with a smaller id is removed.

1. Texts are stored once as chunk rows in a table bucketed by chunk, so later joins on the chunk
   move no text.
2. Each chunk sends its distinct window hashes, packed and dealt by hash, to be merged: the answer
   tells for each of them whether it recurs and which smallest id owns it. A frequent window is
   sent once per chunk, not once per entity.
3. Chunks answer with passages: the runs of windows that an entity owns and others repeat, and the
   runs that it has to check against an owner ("claims"); equal claims are merged.
4. Confirmation: the owners' passages are compiled, shard by shard, into Aho-Corasick automata over
   words, and the claims are streamed through them. Only windows whose words are found, word by
   word, in a passage of the owner count. Owners with many claims are split over several shards.
5. The confirmed stretches go back to their chunks and the words are cut out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.functions.ordering import dense_index
from molq.llm.common import (
    WordHashes, frugal, id_type, in_small_batches, remember_made, rows_of, shared_folder, stored, window_hashes)
from molq.session import shuffle_width

CHUNK_BYTES = 2_000_000
SHARD_WORDS = 100_000


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, held, size, kind = TaskContext.get().partitionId(), 0, [], 0, pa.null()

    def row() -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0] is None, r[0]))
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{part}-{made}"]), pa.array([[r[0] for r in held]], pa.list_(pa.int64())),
             pa.array([[r[1] for r in held]], pa.list_(pa.string())), pa.array([[r[2] for r in held]], pa.list_(kind))],
            ["chunk", "ids", "texts", "carried"])

    for batch in batches:
        kind = batch.schema.field("carried").type
        for num, text, carried in rows_of(batch, "num", "text", "carried"):
            held.append((num, text, carried))
            size += len(text or "") + 64
            if size >= CHUNK_BYTES:
                yield row()
                made, held, size = made + 1, [], 0
    if held:
        yield row()


def _word_lists(texts: list[str | None]) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]


class ChunkWindows:
    """The distinct window hashes of a chunk in the order in which they are sent out."""

    def __init__(self, ids: list, words: list[list[bytes]], width: int, buckets: int, hashes: WordHashes):
        per_doc = [window_hashes(hashes.of(w), width) if i is not None else np.zeros(0, np.uint64)
                   for i, w in zip(ids, words, strict=True)]
        self.ids = np.array([-1 if i is None else i for i in ids], np.int64)
        self.ends = np.cumsum([len(p) for p in per_doc])
        every = np.concatenate(per_doc) if per_doc else np.zeros(0, np.uint64)
        owner = self.ids[np.repeat(np.arange(len(ids)), [len(p) for p in per_doc])]
        order = np.lexsort((every, every % np.uint64(buckets)))
        ranked = every[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.place = np.empty(len(every), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.hashes = ranked[starts]
        self.low = np.minimum.reduceat(owner[order], starts) if len(starts) else owner[:0]
        self.several = (np.maximum.reduceat(owner[order], starts) if len(starts) else owner[:0]) > self.low
        self.cuts = np.searchsorted(self.hashes % np.uint64(buckets), np.arange(buckets + 1))


def _sender(width: int, buckets: int):
    schema = ["bucket", "chunk", "hashes", "docs", "doc_of", "several"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk, ids, texts in rows_of(batch, "chunk", "ids", "texts"):
                w = ChunkWindows(ids, _word_lists(texts), width, buckets, hashes)
                out: list[tuple] = []
                for b in range(buckets):
                    lo, hi = w.cuts[b], w.cuts[b + 1]
                    if lo < hi:
                        docs, doc_of = np.unique(w.low[lo:hi], return_inverse=True)
                        out.append((b, chunk, w.hashes[lo:hi].tobytes(), docs.tobytes(),
                                    doc_of.astype(np.uint16 if len(docs) < 65536 else np.uint32).tobytes(),
                                    np.packbits(w.several[lo:hi]).tobytes()))
                kinds = (pa.int32(), pa.string(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], schema)

    return frugal(send)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    sent = [np.frombuffer(r[2], np.uint64) for r in rows]
    low = np.concatenate([
        np.frombuffer(r[3], np.int64)[np.frombuffer(r[4], np.uint16 if len(r[4]) == 2 * len(s) else np.uint32)]
        for r, s in zip(rows, sent, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=len(s)).astype(bool)
                              for r, s in zip(rows, sent, strict=True)])
    every = np.concatenate(sent)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(np.append(starts, len(ranked)))
    owner = np.empty(len(every), np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(low[order], starts), counts)
    recurs = np.empty(len(every), bool)
    high = np.maximum.reduceat(low[order], starts) > np.minimum.reduceat(low[order], starts)
    recurs[order] = np.repeat(high | np.logical_or.reduceat(several[order], starts), counts)
    foreign, ends = owner < low, np.cumsum([len(s) for s in sent])
    parts = [slice(e - len(s), e) for e, s in zip(ends, sent, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows], pa.int32()),
         pa.array([np.packbits(recurs[p]).tobytes() for p in parts], pa.binary()),
         pa.array([np.packbits(foreign[p]).tobytes() for p in parts], pa.binary()),
         pa.array([owner[p][foreign[p]].tobytes() for p in parts], pa.binary())],
        ["chunk", "bucket", "recurs", "foreign", "owners"])


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for row in rows_of(batch, "bucket", "chunk", "hashes", "docs", "doc_of", "several"):
            if held and held[0][0] != row[0]:
                yield _answers(held)
                held = []
            held.append(row)
    if held:
        yield _answers(held)


def _runs(flags: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Half-open maximal runs of set flags with one label."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(label[at]) != 0)) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(at, cut)]


def _passage_finder(width: int, buckets: int):
    names = ["owned", "chunk", "doc", "start", "windows", "owner", "key", "text"]
    kinds = (pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for chunk, ids, texts, answers in rows_of(batch, "chunk", "ids", "texts", "answers"):
                if not answers:
                    continue
                words = _word_lists(texts)
                w = ChunkWindows(ids, words, width, buckets, hashes)
                recurs, owner = np.zeros(len(w.hashes), bool), w.low.copy()
                for a in answers:
                    lo, hi = w.cuts[a["bucket"]], w.cuts[a["bucket"] + 1]
                    recurs[lo:hi] = np.unpackbits(np.frombuffer(a["recurs"], np.uint8), count=hi - lo)
                    away = np.unpackbits(np.frombuffer(a["foreign"], np.uint8), count=hi - lo).astype(bool)
                    owner[lo:hi][away] = np.frombuffer(a["owners"], np.int64)
                out, told = [], set()
                for d, end in enumerate(w.ends):
                    place = w.place[w.ends[d - 1] if d else 0:end]
                    if not recurs[place].any():
                        continue
                    mine, own = owner[place], w.ids[d]
                    for owned in (True, False):
                        flags = recurs[place] & ((mine == own) if owned else (mine < own))
                        for lo, hi in _runs(flags, mine):
                            text = b" ".join(words[d][lo:hi + width - 1])
                            key = hashlib.blake2b(text, digest_size=16).digest()
                            named = (int(mine[lo]), key, owned)
                            out.append((owned, chunk, d, lo, hi - lo, int(mine[lo]), key,
                                        None if named in told else text.decode("utf-8", "surrogatepass")))
                            told.add(named)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return frugal(find)


class PhraseAutomaton:
    """Aho-Corasick over words: each word of the shard is one character of the automaton's alphabet.

    A passage is entered by pieces of ``width // 2 + 1`` words, one after the other, so every window of a
    passage holds a whole piece. A hit is extended word by word along the passage.
    """

    def __init__(self, passages: list[str], width: int):
        self.width, self.piece = width, width // 2 + 1
        self.alphabet: dict[str, str] = {}
        self.passages = [self._letters(p, grow=True) for p in passages]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, passage in enumerate(self.passages):
            for at in range(0, len(passage) - self.piece + 1, self.piece):
                places.setdefault(passage[at:at + self.piece], []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, found)
        self.automaton.make_automaton()

    def _letters(self, text: str, grow: bool = False) -> str:
        out, alphabet = [], self.alphabet
        for word in text.split(" "):
            letter = alphabet.get(word)
            if letter is None:
                n = len(alphabet) + 1
                letter = chr(n if n < 0xD800 else n + 0x800) if grow else "\0"
                if grow:
                    alphabet[word] = letter
            out.append(letter)
        return "".join(out)

    def locate(self, text: str) -> np.ndarray:
        """For each window of ``text``: does it occur in a passage?"""
        letters = self._letters(text)
        found = np.zeros(max(0, len(letters) - self.width + 1), bool)
        tried: set[tuple[int, int]] = set()
        if not len(self.automaton):
            return found
        codes = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
        for end, hits in self.automaton.iter(letters):
            for k, at in hits:
                shift = end - self.piece + 1 - at
                if (k, shift) in tried:
                    continue
                tried.add((k, shift))
                passage = self.passages[k]
                lo, hi = max(0, shift), min(len(letters), shift + len(passage))
                if hi - lo < self.width or found[lo:hi - self.width + 1].all():
                    continue
                other = np.frombuffer(passage[lo - shift:hi - shift].encode("utf-32-le"), np.uint32)
                unlike = np.concatenate([[0], np.cumsum(codes[lo:hi] != other)])
                found[lo:hi - self.width + 1] |= unlike[self.width:] == unlike[:-self.width]
                if found.all():
                    return found
        return found


def _locator(width: int):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, passages, automaton = None, [], None
        for batch in batches:
            out = []
            for at, is_claim, owner, key, text in rows_of(batch, "shard", "claim", "owner", "key", "text"):
                if at != shard:
                    shard, passages, automaton = at, [], None
                if not is_claim:
                    passages.append(text)
                    continue
                automaton = automaton or PhraseAutomaton(passages, width)
                found = automaton.locate(text)
                out.append((owner, key, [{"lo": lo, "hi": hi} for lo, hi in _runs(found, np.zeros(len(found)))]))
            spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), spans))],
                ["owner", "key", "spans"])

    return frugal(locate)


def _cutter(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("carried").type.value_type
            for ids, texts, carried, spans in rows_of(batch, "ids", "texts", "carried", "spans"):
                words = _word_lists(texts)
                marks = {}
                for s in spans or ():
                    mark = marks.setdefault(s["doc"], np.zeros(len(words[s["doc"]]), bool))
                    mark[s["lo"]:s["hi"] + width - 1] = True
                kept = [[x for x, gone in zip(w, marks[d].tolist(), strict=True) if not gone] if d in marks else w
                        for d, w in enumerate(words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()),
                     pa.array([b" ".join(k).decode("utf-8", "surrogatepass") for k in kept], pa.string()),
                     pa.array(carried, kind)], ["num", "n_words", "n_removed", "kept_features", "carried"])

    return frugal(cut)


def _chunk_table(texts: DataFrame) -> DataFrame:
    """Texts as chunk rows, stored once and bucketed by chunk."""
    spark, name = texts.sparkSession, f"chunks_{uuid.uuid4().hex}"
    carried = texts.schema["carried"].dataType.simpleString()
    chunks = texts.mapInArrow(frugal(_chunker), f"chunk string, ids array<bigint>, texts array<string>, carried array<{carried}>")
    path = shared_folder(spark, "chunks")
    remember_made(path, name)
    (chunks.write.format("parquet").option("path", path).option("compression", "zstd")
     .option("parquet.block.size", str(16 << 20)).bucketBy(shuffle_width(texts), "chunk").saveAsTable(name))
    return spark.table(name)


def located_claims(runs: DataFrame, width: int) -> DataFrame:
    """(owner, key, spans): window ranges of each distinct claim that stand in a passage of its owner."""
    texts = runs.where("text is not null").groupBy("owned", "owner", "key").agg(F.min("text").alias("text"))
    texts = stored(texts.withColumn("n", F.size(F.split("text", " "))), "passages")
    total = texts.agg(F.sum("n")).first()[0] or 0
    shards = max(shuffle_width(runs), total // SHARD_WORDS + 1)
    salts = texts.where("not owned").groupBy("owner").agg(
        F.ceil(F.sum("n") / F.lit(SHARD_WORDS)).cast("int").alias("salts"))
    claims = texts.where("not owned").join(salts, "owner").select(
        F.lit(True).alias("claim"), "owner", "key", "text", F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"))
    passages = texts.where("owned").join(salts, "owner").select(
        F.lit(False).alias("claim"), "owner", "key", "text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = claims.unionByName(passages).withColumn("shard", F.pmod(F.xxhash64("owner", "salt"), F.lit(shards)))
    return (dealt.repartition(shuffle_width(runs), "shard").sortWithinPartitions("shard", "claim")
            .mapInArrow(_locator(width), "owner bigint, key binary, spans array<struct<lo:int,hi:int>>"))


def _numbered(entities: DataFrame, entity_col: str, features_col: str, carry: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Texts with integer ids; ids of other types are numbered in their order first."""
    carried = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(0)
    texts = entities.select(F.col(entity_col).alias("id"), F.col(features_col).alias("text"), carried.alias("carried"))
    if id_type(texts, "id") in ("bigint", "int", "smallint", "tinyint"):
        return texts.select(F.col("id").cast("bigint").alias("num"), "text", "carried"), None
    index = stored(dense_index(texts.select("id").where("id is not null").distinct(), ["id"], "num"), "numbers")
    return texts.join(index, "id", "left").select("num", "text", "carried"), index


def remove_recurring_runs(entities: DataFrame, entity_col: str = "cell_id", features_col: str = "features",
                          width: int = 13, carry: Sequence[str] = ()) -> DataFrame:
    """(entity, n_words, n_removed, kept_features, carried columns) for every row of ``entities``.

    Words are cut at blanks, tabs and line ends and kept unchanged; ``kept_features`` joins the words
    left by one blank. Windows are judged on the input. Null or short text: nothing to remove, kept as
    it is ("" for null). Null id: kept whole, and no other entity loses words to it. Rows that repeat an
    id do not remove each other's words. Columns named in ``carry`` are passed on, others are not read.
    An empty table gives an empty result.
    """
    numbered, index = _numbered(in_small_batches(entities), entity_col, features_col, carry)
    chunks = _chunk_table(numbered)
    buckets = shuffle_width(chunks)
    bare = chunks.select("chunk", "ids", "texts")
    sent = bare.mapInArrow(_sender(width, buckets), "bucket int, chunk string, hashes binary, docs binary, "
                                                    "doc_of binary, several binary")
    answers = (sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
               .mapInArrow(frugal(_merger), "chunk string, bucket int, recurs binary, foreign binary, owners binary")
               .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "recurs", "foreign", "owners")).alias("answers")))
    runs = stored(bare.join(answers, "chunk").mapInArrow(
        _passage_finder(width, buckets), "owned boolean, chunk string, doc int, start int, windows int, owner bigint, "
                                         "key binary, text string"), "runs")
    located = located_claims(runs, width)
    span = F.struct("doc", (F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi"))
    spans = (runs.where("not owned").drop("text").join(located, ["owner", "key"])
             .select("chunk", "doc", "start", F.explode("spans").alias("s"))
             .groupBy("chunk").agg(F.collect_list(span).alias("spans")))
    kind = numbered.schema["carried"].dataType.simpleString()
    out = chunks.join(spans, "chunk", "left").mapInArrow(
        _cutter(width), f"num bigint, n_words bigint, n_removed bigint, kept_features string, carried {kind}")
    if index is None:
        entity = F.col("num").cast(id_type(entities, entity_col))
    else:
        out, entity = out.join(index, "num", "left"), F.col("id")
    return out.select(entity.alias(entity_col), "n_words", "n_removed", "kept_features",
                      *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)])
