"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three parts are compiled from a merge model with byte fallback:

* the normaliser writes blanks as the blank mark and puts one mark in front,
* the piece transducer has one arc per piece, reading its characters and writing its id; the arcs are
  compiled into one Aho-Corasick automaton, whose run over the input is the composition,
* the fallback has one arc per unknown character, writing the ids of its bytes.

A merge model has no additive piece scores: its encoding is the one path on which every piece and
every two neighbouring pieces are stable (see ``merges``). So the arc weights are taken over pairs:
0 where the piece is stable after the piece before it, infinite where it is not. In the tropical
semiring the shortest path of input o transducer then has weight 0 and is unique; one survivor
per position is enough. Characters that never stand side by side in any piece cut the input into
stretches whose paths are independent, and paths of frequent stretches are remembered.

The project's records hold no long text of their own, so the functions take any id and text column.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from molq.llm.common import Remembered, frugal, id_type, in_small_batches, kept_in_worker, rows_of
from molq.llm.merges import StablePairs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
NORMAL, BYTE = 1, 6


class PieceTransducer:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        if (trained.model_type != trained.BPE or not trained.byte_fallback or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or any(p.type in (4, 5) for p in model.pieces)):
            raise ValueError(f"unsupported model {path}")
        self.front = BLANK if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        cost = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.arcs = self._compiled()
        self.pairs = StablePairs(lambda a, b: cost.get(a + b), list)
        self.stretch = re.compile(self._stretches(), re.S)
        self.paths = Remembered(self._path_bytes)
        self.shown = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.shown[i] = p.piece.replace(BLANK, " ").encode()
            elif p.type == BYTE:
                self.shown[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == 2:
                self.shown[i] = trained.unk_surface.encode()

    def _stretches(self) -> str:
        """Pattern of stretches: characters that occur side by side in a piece stay together."""
        up: dict[str, str] = {}

        def root(c: str) -> str:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for piece in self.ids:
            bare = piece.lstrip(BLANK)
            if BLANK in bare:
                raise ValueError("pieces with a blank mark inside are not supported")
            for a, b in zip(bare, bare[1:]):
                up[root(a)] = root(b)
        groups: dict[str, list[str]] = {}
        for c in up:
            groups.setdefault(root(c), []).append(c)
        runs = [f"[{re.escape(''.join(sorted(g)))}]+" for g in sorted(groups.values(), key=len, reverse=True)]
        return f"{BLANK}*(?:{'|'.join([*runs, f'[^{BLANK}]'])})|{BLANK}+"

    def _compiled(self) -> ahocorasick.Automaton:
        """The pieces as one automaton: its states are the beginnings of pieces, and at every character read it
        gives the arcs that end there, longest first. Characters of pieces that are no piece get an arc as well."""
        arcs = ahocorasick.Automaton()
        for part in {c for piece in self.ids for c in piece} | set(self.ids):
            arcs.add_word(part, (len(part), part))
        arcs.make_automaton()
        return arcs

    def shortest_path(self, stretch: str) -> list[int]:
        """Ids on the path of weight 0 through the composition of one stretch with the pieces."""
        pairs, arcs, n = self.pairs, self.arcs, len(stretch)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""

        def fall_back(upto: int) -> str:
            """Characters that no arc reads are read by a fallback arc."""
            for j in range(1, upto + 1):
                if last[j] is None:
                    if stretch[j - 1] in arcs:
                        raise ValueError(f"no path through {stretch!r}")
                    last[j] = stretch[j - 1]
            return last[upto]

        for end, (length, part) in arcs.iter(stretch):
            j = end + 1
            if last[j] is None:
                left = last[j - length]
                if left is None:
                    left = fall_back(j - length)
                if pairs[left, part]:
                    last[j] = part
        if last[n] is None:
            fall_back(n)
        out, j, known = [], n, self.ids
        while j:
            part = last[j]
            if part is None:
                fall_back(j)
                part = last[j]
            j -= len(part)
            found = known.get(part)
            if found is None:
                out += [self.bytes[b] for b in reversed(part.encode("utf-8", "surrogatepass"))]
            else:
                out.append(found)
        out.reverse()
        return out

    def _path_bytes(self, stretch: str) -> bytes:
        return array("i", self.shortest_path(stretch)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        stretches = self.stretch.findall(self.front + text.replace(" ", BLANK))
        return np.frombuffer(b"".join(map(self.paths.__getitem__, stretches)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.front and text.startswith(" ") else text


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _transducer(path: str) -> PieceTransducer:
    return kept_in_worker(f"pieces {path}", lambda: PieceTransducer(path))


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _transducer(path)
        for batch in batches:
            for part in _slices(batch):
                ids = _lists([pieces.encode(t or "") for (t,) in rows_of(part, "text")])
                yield pa.RecordBatch.from_arrays([part.column("id"), ids], ["id", "piece_ids"])

    return frugal(encode)


def _decoder(path: str, both: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _transducer(path)
        for batch in batches:
            for part in _slices(batch):
                if both:
                    ids = [pieces.encode(t or "") for (t,) in rows_of(part, "text")]
                    column = _lists(ids)
                else:
                    column = part.column("piece_ids")
                    ids = [np.array(r or (), np.int32) for (r,) in rows_of(part, "piece_ids")]
                texts = pa.array([pieces.decode(r) for r in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), column, texts], ["id", "piece_ids", "decoded"])

    return frugal(decode)


def _texts(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return in_small_batches(records).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def encode_pieces(records: DataFrame, id_col: str = "dataset", text_col: str = "provenance",
                  model: str = MODEL) -> DataFrame:
    """(id, piece_ids) for every row; null or empty text gives an empty list. Ids are passed on, null,
    repeated or not; other columns are not read. ``model`` must lie at one path on every machine."""
    texts = _texts(records, id_col, text_col)
    out = texts.mapInArrow(_encoder(model), f"id {id_type(texts, 'id')}, piece_ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, id_col: str = "dataset", ids_col: str = "piece_ids",
                  model: str = MODEL) -> DataFrame:
    """(id, piece_ids, decoded) for every row; a null or empty list gives "". Control pieces show nothing;
    bytes that are no UTF-8 show as the replacement character."""
    lists = in_small_batches(encoded).select(F.col(id_col).alias("id"), F.col(ids_col).alias("piece_ids"))
    out = lists.mapInArrow(_decoder(model, False), f"id {id_type(lists, 'id')}, piece_ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def encode_and_decode(records: DataFrame, id_col: str = "dataset", text_col: str = "provenance",
                      model: str = MODEL) -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` in one pass: (id, piece_ids, decoded)."""
    texts = _texts(records, id_col, text_col)
    out = texts.mapInArrow(_decoder(model, True), f"id {id_type(texts, 'id')}, piece_ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
