"""Text quality by a factorisation machine over hashed words, structure and length.

score = sigmoid(w0 + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j). With k factors the pair sum is
computed in linear time as half of (sum v_i x_i)^2 - sum v_i^2 x_i^2 per factor. Words count by
square-root frequency, normalised; structure statistics and the length are fixed transforms of
the text, so a score never depends on other rows.

The project's own records carry no running text, so the functions take any id, text and label column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.llm.common import WordHashes, id_type, in_small_batches, rows_of, sample_per_group

BITS = 14
FACTORS = 4
SAMPLE_PER_CLASS = 3000
STATISTICS = ("log words", "log characters", "word length", "upper case", "digits", "punctuation", "blanks",
              "beyond ASCII", "distinct words", "distinct lines", "line length", "stated length")


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _classes() -> np.ndarray:
    table = np.full(256, 3, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 4
    table[48:58] = 2
    table[65:91] = 1
    table[97:123] = 0
    table[128:192], table[192:] = 6, 5
    return table


def features(text: str | None, stated: int | None, hashes: WordHashes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): word features, then one feature for every statistic."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    at, count = np.unique(hashes.of(words) >> np.uint64(64 - BITS), return_counts=True)
    root = np.sqrt(count)
    values = root / np.sqrt(max(1, len(words)))
    kinds = np.bincount(classes[np.frombuffer(raw, np.uint8)], minlength=7)
    lines = raw.split(b"\n")
    n, size = max(1, len(words)), max(1, len(raw))
    stats = np.array([
        np.log1p(len(words)) / 5, np.log1p(len(raw)) / 7, min(3.0, (len(raw) - kinds[4]) / n / 6), kinds[1] / size * 2,
        kinds[2] / size * 2, kinds[3] / size * 4, kinds[4] / size * 4, kinds[5] / size * 4, len(set(words)) / n,
        len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)) / 5, np.log1p(max(0, stated or 0)) / 7])
    return (np.concatenate([at.astype(np.int64), (1 << BITS) + np.arange(len(stats))]).astype(np.int32),
            np.concatenate([values, stats]).astype(np.float32))


def _pair_sums(model: FactorisationMachine, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
    """Raw scores of many rows, and the factor sums that their gradients need."""
    shares = model.factors[index] * value[:, None]
    sums = np.add.reduceat(shares, starts, axis=0)
    squares = np.add.reduceat(shares * shares, starts, axis=0)
    linear = np.add.reduceat(model.weights[index] * value, starts)
    return model.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = FACTORS, epochs: int = 20,
          rate: float = 0.08, shrink: float = 2e-5, seed: int = 5) -> FactorisationMachine:
    """Adagrad over small batches; classes weigh alike whatever their sizes."""
    draw = np.random.default_rng(seed)
    size = (1 << BITS) + len(STATISTICS)
    weights, bias = np.zeros(size), 0.0
    vectors = draw.normal(0, 0.02, (size, factors))
    grown_w, grown_v, grown_b = np.full(size, 1e-4), np.full((size, factors), 1e-4), 1e-4
    each = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels != 1).sum())) * len(labels)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(rows), 64):
            batch = order[at:at + 64]
            index = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch]).astype(float)
            sizes = np.array([len(rows[i][0]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            raw, sums = _pair_sums(FactorisationMachine(bias, weights, vectors), index, value, starts)
            error = (_sigmoid(raw) - labels[batch]) * each[batch] / len(batch)
            pull = np.repeat(error, sizes) * value
            used, back = np.unique(index, return_inverse=True)
            step = np.bincount(back, pull, len(used)) + shrink * weights[used]
            grown_w[used] += step * step
            weights[used] -= rate * step / np.sqrt(grown_w[used])
            inner = np.repeat(sums, sizes, axis=0) - vectors[index] * value[:, None]
            for f in range(factors):
                step = np.bincount(back, pull * inner[:, f], len(used)) + shrink * vectors[used, f]
                grown_v[used, f] += step * step
                vectors[used, f] -= rate * step / np.sqrt(grown_v[used, f])
            grown_b += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(grown_b)
    return FactorisationMachine(float(bias), weights.astype(np.float32), vectors.astype(np.float32))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, classes = WordHashes(), _classes()
    for batch in batches:
        made = [features(t, n, hashes, classes) for t, n in rows_of(batch, "text", "stated")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array([i.tobytes() for i, _ in made], pa.binary()),
             pa.array([v.tobytes() for _, v in made], pa.binary())], ["id", "label", "at", "x"])


def _columns(records: DataFrame, id_col: str, text_col: str, length_col: str | None, *more) -> DataFrame:
    stated = F.col(length_col).cast("long") if length_col else F.lit(None).cast("long")
    return in_small_batches(records).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), stated.alias("stated"), *more)


def fit_quality(records: DataFrame, labels: DataFrame, id_col: str = "dataset", text_col: str = "provenance",
                label_col: str = "quality", length_col: str | None = None,
                per_class: int = SAMPLE_PER_CLASS, allow_empty: bool = False) -> FactorisationMachine:
    """Fit on the ``per_class`` labelled ids of lowest hash of each class (label 1 against 0).

    ``labels`` has the id and the label; only the sampled ids, a table of bounded size, meet the texts of
    ``records``. Null ids, other labels and labels without a record are left out; repeated ids count once. The
    driver receives the hashed features of the sample, at most ``2 * per_class`` rows. Without any row to
    learn from this is an error or, with ``allow_empty``, a model that scores every text 0.5.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label in (0, 1)")
    picked = sample_per_group(known, "label", "id", per_class)
    rows = _columns(records, id_col, text_col, length_col)
    sample = rows.join(picked, "id").dropDuplicates(["id", "label"]).select("id", "text", "stated", "label")
    made = sample.mapInArrow(_featured, f"id {id_type(rows, 'id')}, label int, at binary, x binary").orderBy("id").collect()
    if not made and allow_empty:
        n = (1 << BITS) + len(STATISTICS)
        return FactorisationMachine(0.0, np.zeros(n), np.zeros((n, FACTORS)))
    if not made:
        raise ValueError("no labelled row to learn from")
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in made],
                 np.array([r["label"] for r in made]))


def score_quality(records: DataFrame, model: FactorisationMachine, id_col: str = "dataset", text_col: str = "provenance",
                  length_col: str | None = None) -> DataFrame:
    """(id, score, predicted) for every row; ``score`` is the chance of label 1, ``predicted`` 1 from 0.5 on.

    Null and empty texts are scored like any other, by their structure. Ids are passed on as they are,
    null, repeated or not; only the named columns are read. The whole text counts.
    """
    shipped = records.sparkSession.sparkContext.broadcast(model)  # 2**BITS * (FACTORS + 1) numbers
    texts = _columns(records, id_col, text_col, length_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, classes = shipped.value, WordHashes(), _classes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [features(t, n, hashes, classes) for t, n in rows_of(part, "text", "stated")]
                sizes = [len(i) for i, _ in made]
                raw, _ = _pair_sums(known, np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]),
                                    np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_sigmoid(raw.astype(float)))], ["id", "score"])

    out = texts.mapInArrow(score, f"id {id_type(texts, 'id')}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
