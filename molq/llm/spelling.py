"""Spelling variants of names (features, cell types, words of a text) by dense prefix-suffix tiling.

Two names are near if one inserted, deleted or replaced code point turns one into the other, which is
so exactly when their common prefix and common suffix together reach the longer length minus one.

Names are cut into three segments. A single edit lies in one of them, so both names share what is in
front of it and what is behind it: names meet only under such a key (longer length, segment, front,
back), and a key with many names is cut into blocks whose pairs are dealt over tasks. Keys with few names
are packed side by side into one block, in which the key is compared first. Inside a pair of blocks the names' segments are padded code-point matrices, compared as a whole, column by column from the
left and from the right. A pair counts in the segment that holds the end of its common prefix, so in
one tile only. No pairs leave a task: a tile sends each name's number of near names and its best one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.llm.common import frugal, in_small_batches, rows_of, stored
from molq.session import shuffle_width

TILE = 1024
PACKED = 256
SEGMENTS = 3
HELD_WORDS = 100_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile("[a-zÀ-ÿ]+")


def _slipped(word: str, key: bytes, one_in: int) -> str:
    h = zlib.crc32(word.encode(), zlib.crc32(key))
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _word_counter(min_length: int, slip_one_in: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             ["feature_name", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in rows_of(batch, "id", "text"):
                words = Counter(WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER).decode()))
                if slip_one_in:
                    front = f"{'' if key is None else key}:".encode()
                    for word, n in words.items():
                        word = _slipped(word, front, slip_one_in)
                        if len(word) >= min_length:
                            held[word] += n
                else:
                    held.update({w: n for w, n in words.items() if len(w) >= min_length})
                if len(held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    return frugal(count)


def feature_words(entities: DataFrame, entity_col: str = "cell_id", features_col: str = "features", min_length: int = 6,
                  min_count: int = 5, slip_one_in: int | None = None) -> DataFrame:
    """(feature_name, n): runs of Latin letters in ``features``, A-Z lower-cased, with their number of occurrences.

    Words shorter than ``min_length`` code points or rarer than ``min_count`` are left out. With
    ``slip_one_in`` a word loses one code point in the entities that a crc32 of ``<entity>:<word>`` divisible by it
    names: a fixed set of misspellings for tests. Null and empty texts give nothing, a null id counts as "", rows
    that repeat an id count each. Texts are read whole; other columns are not read.
    """
    texts = in_small_batches(entities).select(F.col(entity_col).cast("string").alias("id"), F.col(features_col).alias("text"))
    parts = texts.mapInArrow(_word_counter(min_length, slip_one_in), "feature_name string, n bigint")
    return parts.groupBy("feature_name").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keys(length):
    """One struct per (longer length, segment) under which a name may meet others. A name that is one code
    point shorter than the longer one has a segment that is one shorter."""
    word, out = F.col("word"), []
    for short in (0, 1):
        m = length + short
        for q in range(SEGMENTS):
            lo, hi = F.floor(m * q / SEGMENTS).cast("int"), F.floor(m * (q + 1) / SEGMENTS).cast("int")
            out.append(F.when(hi > lo, F.struct(
                m.cast("int").alias("longer"), F.lit(short).alias("short"), lo.alias("lo"), hi.alias("hi"),
                F.substring(word, F.lit(1), lo).alias("front"),
                F.substring(word, hi - short + 1, F.greatest(m - hi, F.lit(0))).alias("back"))))
    return F.filter(F.array(*out), lambda k: k.isNotNull())


def _matrix(words: list[str], lo: int, hi: int, width: int, right: bool) -> np.ndarray:
    """Code points of ``word[lo:hi]``, padded with zeros to ``width`` columns on the left or on the right."""
    parts = [w[lo:hi] for w in words]
    flat = "".join(p.rjust(width, "\0") if right else p.ljust(width, "\0") for p in parts)
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def _matching(a: np.ndarray, b: np.ndarray, columns: range, together: np.ndarray) -> np.ndarray:
    """For each pair of rows the number of equal columns before the first unequal one, in the given order;
    only pairs set in ``together`` are looked at."""
    alive = together.copy()
    n = np.zeros((len(a), len(b)), np.uint16)
    for c in columns:
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        n += alive
    return n


class Tile:
    """Per name the number of near names, and the largest count among them with its smallest name."""

    def __init__(self):
        self.near: dict[str, list] = {}

    def _tell(self, words: list[str], others: list[str], counts: np.ndarray, hit: np.ndarray) -> None:
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            found = np.flatnonzero(hit[i])
            top = counts[found].max()
            best = (-int(top), min(others[j] for j in found[counts[found] == top].tolist()))
            told = self.near.get(words[i])
            if told is None:
                self.near[words[i]] = [len(found), best]
            else:
                told[0] += len(found)
                told[1] = min(told[1], best)

    def compare(self, a: list[tuple], b: list[tuple], longer: int, lo: int, hi: int, short: bool, mirrored: bool) -> None:
        """Names ``a`` (word, n, key) of the longer length against ``b`` of the same length or, if ``short``, of one
        less. Only names under the same key share what is outside of their segment."""
        if not a or not b:
            return
        words, others = [r[0] for r in a], [r[0] for r in b]
        width = hi - lo
        together = np.array([r[2] for r in a])[:, None] == np.array([r[2] for r in b])[None, :]
        front = _matching(_matrix(words, lo, hi, width, False), _matrix(others, lo, hi, width, False), range(width), together)
        back = _matching(_matrix(words, lo, hi, width, True), _matrix(others, lo, hi - short, width, True),
                         range(width - 1, -1, -1), together)
        prefix, suffix = front + lo, back + (longer - hi)
        hit = together & (front < width) & (prefix + suffix >= longer - 1)
        if not hit.any():
            return
        self._tell(words, others, np.array([r[1] for r in b]), hit)
        if mirrored:
            self._tell(others, words, np.array([r[1] for r in a]), hit.T)

    def inside(self, names: tuple[list, list], longer: int, lo: int, hi: int) -> None:
        """One block against itself: ``names`` of the longer length and of one less."""
        self.compare(names[0], names[0], longer, lo, hi, False, False)
        self.compare(*names, longer, lo, hi, True, True)

    def between(self, one: tuple[list, list], two: tuple[list, list], longer: int, lo: int, hi: int) -> None:
        """Two blocks of one key against each other."""
        self.compare(one[0], two[0], longer, lo, hi, False, True)
        self.compare(one[0], two[1], longer, lo, hi, True, True)
        self.compare(two[0], one[1], longer, lo, hi, True, True)


def _comparer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("longer", "lo", "hi", "front", "back", "i", "j", "block", "short", "word", "n")
    tile = Tile()

    def told() -> pa.RecordBatch:
        rows = [(w, n, -best[0], best[1]) for w, (n, best) in tile.near.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        tile.near = {}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                          ["word", "near", "form_n", "form"])

    # ``one`` collects whole keys of one segment, or block i of a large key whose block j goes to ``two``.
    now, one, two, keys = None, ([], []), ([], []), 0
    for batch in batches:
        for longer, lo, hi, front, back, i, j, block, short, word, n in rows_of(batch, *names):
            key = (longer, lo, hi, front, back, i, j)
            if key != now:
                if now and (key[:3] != now[:3] or i != j or now[5] != now[6] or len(one[0]) + len(one[1]) >= PACKED):
                    tile.inside(one, *now[:3]) if now[5] == now[6] else tile.between(one, two, *now[:3])
                    one, two, keys = ([], []), ([], []), 0
                    if len(tile.near) >= HELD_WORDS:
                        yield told()
                now, keys = key, keys + 1
            (one if block == i else two)[short].append((word, n, keys))
    if now:
        tile.inside(one, *now[:3]) if now[5] == now[6] else tile.between(one, two, *now[:3])
    yield told()


def _tiles(words: DataFrame) -> DataFrame:
    """Names under their keys, in blocks of about TILE; a pair of blocks (i, j) is one tile."""
    under = ["longer", "lo", "hi", "front", "back"]
    rows = words.withColumn("k", F.explode(_keys(F.char_length("word")))).select("word", "n", "k.*")
    hot = rows.groupBy(*under).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    # A name alone under its key meets nobody.
    dealt = rows.join(hot, under).withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).otherwise(0)
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks", "size")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: where following forms ends. Counts rise along forms, so it ends."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stored(now.join(ahead, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def name_variants(names: DataFrame, name_col: str = "feature_name", n_col: str = "n", ratio: int = 5) -> DataFrame:
    """(feature_name, form, root, n, n_near, form_n) for every different name.

    ``names`` holds names (of features, cell types, ...) and how often each occurs. Near names differ by one
    code point. ``form`` is the near name of largest n (ties: smallest in code-point order) if that n is at
    least ``ratio`` times the name's own, else null; ``root`` is where following forms ends.
    Rows that repeat a name are added up, null counts as 0. Null names are left out; an empty name is near
    to names of one code point. Case, accents and blanks count as they stand. An empty table gives an empty result.
    Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that counts rise along forms")
    words = stored(names.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("word")).agg(
        F.coalesce(F.sum(n_col), F.lit(0)).cast("bigint").alias("n")), "names")
    tiles = _tiles(words)
    by = ["longer", "lo", "hi", "front", "back", "i", "j"]
    sent = tiles.repartition(shuffle_width(words), *by).sortWithinPartitions(*by).mapInArrow(
        frugal(_comparer), "word string, near bigint, form_n bigint, form string")
    best = F.struct((-F.col("form_n")).alias("minus_n"), "form")
    found = sent.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(best).alias("best"))
    takes = F.col("n_near").isNotNull() & (-F.col("best.minus_n") >= F.col("n") * ratio)
    judged = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.minus_n")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        F.col("word").alias(name_col), "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
