"""Exact token counts at every prefix of a text, for lower-casing word vocabularies with merges.

The vocabulary file (JSON of the ``tokenizers`` library) says how a text is normalised and cut into
words; a word's last symbol carries an end mark. For every word one dynamic programme over its
prefixes gives the number of tokens of each prefix as if the text ended there; an automaton of all tokens
yields those that end at each place. Summing up words gives the count at every prefix of the text, from
which totals, cuts and budgets are read without a new encoding.

The project's records hold no long text of their own (notes and provenance are short strings), so the
functions take any id and text column.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molq.llm.common import Remembered, frugal, id_type, in_small_batches, kept_in_worker, rows_of
from molq.llm.merges import StablePairs

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BLANKS = "\t\n\v\f\r"
REMEMBERED_CHARS, REMEMBERED = 64, 300_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ShortRemembered(Remembered):
    """Remembers short stretches only, so that its bound is one in bytes too."""

    def __missing__(self, key: str):
        return super().__missing__(key) if len(key) <= REMEMBERED_CHARS else self.compute(key)


class PrefixCounter:
    """Token counts of texts and of all their prefixes under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, kinds = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["unk_token"] or model["byte_fallback"]:
            raise ValueError(f"unsupported vocabulary {path}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("unsupported special tokens")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.end = model["end_of_word_suffix"]
        self.letters = _byte_letters()
        order = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.pairs = StablePairs(lambda a, b: order.get((a, b)), self._symbols)
        self.arcs = ahocorasick.Automaton()
        inner = {t for t in model["vocab"] if not t.endswith(self.end)}
        final = {t.removesuffix(self.end): t for t in model["vocab"] if t.endswith(self.end)}
        for token in inner | final.keys():
            self.arcs.add_word(token, (len(token), token if token in inner else None, final.get(token)))
        self.arcs.make_automaton()
        self.pairs.LIMIT = REMEMBERED
        self.words, self.tables = ShortRemembered(self._table, REMEMBERED), ShortRemembered(self._stretch, REMEMBERED)

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end):
            bare = token.removesuffix(self.end)
            return [*bare[:-1], bare[-1] + self.end]
        return list(token)

    def _by_programme(self, word: str) -> list[int]:
        """Tokens of each prefix of the word, as if the text ended there.

        ``counts`` and ``ends`` are of the prefix that goes on, ``closed`` of the one that ends."""
        raw = word.encode("utf-8", "surrogatepass")
        text, pairs = "".join(map(self.letters.__getitem__, raw)), self.pairs
        counts, closed, ends = [0] * (len(raw) + 1), [0] * (len(raw) + 1), [""] * (len(raw) + 1)
        for last, (size, inner, final) in self.arcs.iter(text):
            j = last + 1
            i = j - size
            before = ends[i]
            if inner is not None and not ends[j] and pairs[before, inner]:
                counts[j], ends[j] = counts[i] + 1, inner
            if final is not None and not closed[j] and pairs[before, final]:
                closed[j] = counts[i] + 1
        found = closed[1:]
        if len(raw) != len(word):
            found = [closed[j] for j in range(1, len(raw)) if (raw[j] & 0xC0) != 0x80] + closed[-1:]
        if not all(found):
            raise ValueError(f"no tokens spell {word!r}")
        return found

    def _table(self, word: str) -> list[int]:
        counts = self._by_programme(word)
        if word[0] == "'" and len(word) > 1:
            # A cut contraction falls into other words, so its shorter prefixes are cut anew.
            for j in range(1, len(word)):
                if (parts := self.word.findall(word[:j])) != [word[:j]]:
                    counts[j - 1] = sum(self._by_programme(p)[-1] for p in parts)
        return counts

    def _stretch(self, chunk: str) -> tuple[bytes, int, int]:
        """Counts after each character of a stretch without blanks and after one blank more; their number; the last."""
        out: list[int] = []
        done = 0
        for m in self.word.finditer(chunk):
            table, gap = self.words[m.group()], m.start() - len(out)
            if gap:
                out += [done] * gap
            out += [k + done for k in table] if done else table
            done += table[-1]
        out += [done] * (len(chunk) + 1 - len(out))
        return array("i", out).tobytes(), len(out), done

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of the normalised text, the empty one first (int32)."""
        parts, done, at = [np.zeros(1, np.int32)], 0, 0
        for mark in [*self.special.finditer(text), None]:
            part = self._of_plain(text[at:mark.start() if mark else len(text)])
            parts.append(part + done)
            done += int(part[-1]) if len(part) else 0
            if mark:
                # Inside a special string the count is that of the ordinary text before its end.
                shown = mark.group()
                inside = [int(self._of_plain(shown[:j])[-1]) for j in range(1, len(shown))]
                parts.append(np.array([*inside, 1], np.int32) + done)
                done, at = done + 1, mark.end()
        return np.concatenate(parts)

    def _of_plain(self, text: str) -> np.ndarray:
        """Counts after each character of a text without special strings."""
        text = self.normal(text)
        for blank in BLANKS:
            text = text.replace(blank, " ")
        counts, sizes, totals = zip(*map(self.tables.__getitem__, text.split(" ")))
        totals = np.array(totals, np.int32)
        out = np.repeat(np.cumsum(totals, dtype=np.int32) - totals, sizes)
        out += np.frombuffer(b"".join(counts), np.int32)
        return out[:-1]


def _longest(prefixes: np.ndarray, budget: int) -> int:
    fits = np.flatnonzero(prefixes <= budget)
    return int(fits[-1]) if len(fits) else -1


def _counter(path: str, limit: int, keep: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(f"prefix counter {path}", lambda: PrefixCounter(path))
        for batch in batches:
            sizes, totals, fits, tables = [], [], [], []
            for (text,) in rows_of(batch, "text"):
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                prefixes = counter.prefixes(text or "")
                totals.append(int(prefixes[-1]))
                fits.append(_longest(prefixes, limit))
                if keep:
                    tables.append(prefixes.tobytes())
            columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in (sizes, totals, fits))]
            names = ["id", "n_bytes", "n_tokens", "chars_within"]
            if keep:
                columns, names = [*columns, pa.array(tables, pa.binary())], [*names, "prefix_tokens"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return frugal(count)


def token_counts(records: DataFrame, id_col: str = "dataset", text_col: str = "provenance",
                 vocabulary: str = VOCABULARY, limit: int = 2048, keep_prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, chars_within[, prefix_tokens]) for every row.

    The table of all prefixes is built for every text, and the other columns are read from it:
    ``n_tokens`` is its last entry, ``chars_within`` the characters of the longest prefix that takes at
    most ``limit`` tokens (-1 for a negative limit). ``prefix_tokens`` hands the table out: one int32 per prefix of
    the normalised text (NFC, lower case), the empty prefix first. Special strings inside a text count
    as one token each, as the library's default has it. Null or empty text: 0 bytes, 0 tokens. Ids are passed on
    as they are, null, repeated or not; other columns are not read. An empty table gives an empty result.
    ``vocabulary`` must lie at the same path on every machine.
    """
    texts = in_small_batches(records).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type(texts, 'id')}, n_bytes bigint, n_tokens bigint, chars_within bigint" + ", prefix_tokens binary" * keep_prefixes
    out = texts.mapInArrow(_counter(vocabulary, limit, keep_prefixes), schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                      "chars_within", *["prefix_tokens"] * keep_prefixes)


@F.pandas_udf(T.IntegerType())
def tokens_at(prefix_tokens: pd.Series, position: pd.Series) -> pd.Series:
    """Tokens of the first ``position`` characters (null where there are fewer)."""
    return prefix_tokens.combine(position, lambda p, k: (
        None if p is None or not 0 <= k < len(p) // 4 else int(np.frombuffer(p, np.int32)[int(k)])))


@F.pandas_udf(T.IntegerType())
def longest_within(prefix_tokens: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix that takes at most ``budget`` tokens (-1 for a negative budget)."""
    return prefix_tokens.combine(budget, lambda p, k: None if p is None else _longest(np.frombuffer(p, np.int32), k))
