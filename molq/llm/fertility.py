"""Quality rules by tokeniser fertility, with rejection bands per language or script.

Public vocabularies are fitted to ordinary prose: text of another kind (symbol noise, tables, shouted or
repeated words, mangled encodings) takes more tokens per character, falls back to bytes or
spreads its tokens unlike other texts of its language and length. Each text is measured once; the
bands are medians and median deviations over all texts that pass the base rules, per language (or
script, where the language is null) and length class, so they come from the data themselves.

The project's records hold no running text, so the functions take any id, text and language column.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molq.llm.common import frugal, id_type, in_small_batches, kept_in_worker, rows_of, stored

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BLANKS, SYMBOLS = " \t\n\r\v\f", "#*$%&|<>"
PART = 50_000
NO_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)
WIDE = re.compile("[^\x00-\x7f]+")
# First code points of the Unicode ranges told apart as scripts.
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
           (0x0900, "Indic"), (0x0E00, "Thai"), (0x0E80, "other"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
           (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
           (0xAC00, "Hangul"), (0xD7B0, "other")]
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
# Measures in thousandths, with the least width of one unit of deviation.
MEASURES = {"byte_level_chars": 20, "piece_chars": 20, "byte_share": 4, "byte_level_entropy": 50, "piece_entropy": 50}
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(words) < 3:
        return 0
    code: dict[str, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(code) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= again
    return int(covered.sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    twice = 0 if len(set(lines)) == len(lines) else sum(
        n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(BLANKS))
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), twice, repeated_words(words))


def script_of(text: str) -> str:
    """Script of most letters; "none" without a letter, ties to the first in code-point order."""
    plain = len(text.encode("ascii", "ignore").translate(None, NO_LETTERS))
    wide = "" if text.isascii() else "".join(filter(str.isalpha, "".join(WIDE.findall(text))))
    if not plain and not wide:
        return "none"
    letters = np.frombuffer(wide.encode("utf-32-le", "surrogatepass"), np.uint32)
    votes: Counter[str] = Counter({"Latin": plain})
    for k, n in enumerate(np.bincount(np.searchsorted(SCRIPT_STARTS, letters, "right") - 1)):
        votes[SCRIPTS[k][1]] += int(n)
    return votes.most_common(1)[0][0]


def parts_of(text: str) -> Iterator[str]:
    """The whole text in parts of about PART code points, cut in front of a blank where there is one."""
    at = 0
    while len(text) - at > PART:
        cut = text.rfind(" ", at + PART // 2, at + PART)
        end = cut if cut > at else at + PART
        yield text[at:end]
        at = end
    yield text[at:]


def entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


class Vocabularies:
    """The two public vocabularies; ids are counted over the whole text."""

    def __init__(self, byte_level: str, pieces: str):
        with open(byte_level, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.byte_level = tiktoken.Encoding(
            byte_level, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def measures(self, text: str) -> tuple[int, int, int, int, int, int]:
        """Number of byte-level tokens, then MEASURES in thousandths; zeros for an empty text."""
        one, two = [], []
        for part in parts_of(text):
            one += self.byte_level.encode_ordinary(part)
            two += self.pieces.encode(part)
        if not one or not two:
            return (0,) * 6
        pieces, piece_counts = np.unique(np.array(two), return_counts=True)
        values = (len(text) / len(one), len(text) / len(two), piece_counts[self.is_byte[pieces]].sum() / len(two),
                  entropy(np.unique(np.array(one), return_counts=True)[1]), entropy(piece_counts))
        return (len(one), *(round(1000 * float(v)) for v in values))


def _measurer(byte_level: str, pieces: str):
    names = ["id", "lang", *BASE.replace(" bigint", "").split(", "), "script", "n_tokens", *MEASURES]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = kept_in_worker(f"vocabularies {byte_level} {pieces}", lambda: Vocabularies(byte_level, pieces))
        for batch in batches:
            rows = [(*base_measures(t or ""), script_of(t or ""), *vocabularies.measures(t or "")) for (t,) in rows_of(batch, "text")]
            kinds = [*[pa.int64()] * 5, pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("lang"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names)

    return frugal(measure)


def fertility_measures(records: DataFrame, id_col: str = "dataset", text_col: str = "provenance", lang_col: str | None = None,
                       byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(id, lang, base counts, script, n_tokens, MEASURES in thousandths) for every row; ``lang`` is null without
    ``lang_col``. The vocabulary files must lie at one path on every machine."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = in_small_batches(records).select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    more = ", ".join(f"{m} bigint" for m in ("n_tokens", *MEASURES))
    return texts.mapInArrow(_measurer(byte_level, pieces), f"id {id_type(texts, 'id')}, lang string, {BASE}, script string, {more}")


def base_failed(min_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def rejection_bands(measured: DataFrame, by: list[str], deviations: float, min_rows: int) -> DataFrame:
    """(by..., <measure>_low, <measure>_high) from all rows of ``measured``: median plus and minus so many scaled
    median deviations. Groups of fewer than ``min_rows`` rows have no band of their own.

    Measures are whole thousandths, so the exact percentiles keep one counter per different value, however many
    rows a group holds."""
    middle = stored(measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.percentile(m, F.lit(0.5)).alias(f"{m}_mid") for m in MEASURES])
        .where(F.col("_n") >= min_rows), "middles")
    spread = measured.join(middle, by).groupBy(*by).agg(
        *[F.first(f"{m}_mid").alias(f"{m}_mid") for m in MEASURES],
        *[F.percentile(F.abs(F.col(m) - F.col(f"{m}_mid")), F.lit(0.5)).alias(f"{m}_dev") for m in MEASURES])
    unit = {m: F.greatest(1.4826 * F.col(f"{m}_dev"), F.lit(float(least))) * deviations for m, least in MEASURES.items()}
    return stored(spread.select(*by, *[(F.col(f"{m}_mid") - unit[m]).alias(f"{m}_low") for m in MEASURES],
                                *[(F.col(f"{m}_mid") + unit[m]).alias(f"{m}_high") for m in MEASURES]), "bands")


def fertility_verdicts(records: DataFrame, id_col: str = "dataset", text_col: str = "provenance", lang_col: str | None = None,
                       min_words: int = 50, repeat_percent: int = 50, deviations: float = 5.0, min_rows: int = 30) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, MEASURES, outside) for every row.

    Base rules: at least ``min_words`` words, at most ``repeat_percent`` percent of them in repeated windows of three.
    Of texts that pass, the characters per token of two public vocabularies, the share of byte-fallback pieces and
    the entropy of the tokens must lie in the bands of their language and length class (number of words, in powers
    of two); ``outside`` names the measures that do not. Where the language is null, the script stands for it. A group
    of fewer than ``min_rows`` texts is judged by the bands of its length class over all languages; a class
    that has fewer is not judged and its texts are kept.

    Null and empty texts have no words and fail the base rules. Null ids and repeated rows are passed on and count
    each. Very long texts are measured whole. An empty table gives an empty result. Other columns are not read.
    """
    rows = stored(fertility_measures(records, id_col, text_col, lang_col).withColumns({
        "tongue": F.coalesce("lang", F.concat(F.lit("script "), "script")),
        "class": F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"),
        "base_failed": base_failed(min_words, repeat_percent)}), "measures")
    sound = rows.where("not base_failed")
    own = rejection_bands(sound, ["tongue", "class"], deviations, min_rows)
    wide = rejection_bands(sound, ["class"], deviations, min_rows)
    wide = wide.select("class", *[F.col(c).alias(f"all_{c}") for c in wide.columns if c != "class"])

    def out(m: str) -> Column:
        low, high = (F.coalesce(f"{m}_{side}", f"all_{m}_{side}") for side in ("low", "high"))
        return F.coalesce((F.col(m) < low) | (F.col(m) > high), F.lit(False))

    outside = F.filter(F.array(*[F.when(out(m), F.lit(m)) for m in MEASURES]), lambda m: m.isNotNull())
    judged = rows.join(own, ["tongue", "class"], "left").join(wide, "class", "left").withColumn(
        "outside", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(outside))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"),
        *[(F.col(m) / 1000).alias(m) for m in MEASURES], "outside")
