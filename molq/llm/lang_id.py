"""Language of a text by the nearest of several centroids per language.

A text becomes a vector of hashed byte trigrams (lower case; everything but letters folds into one
blank), weighted by square-root frequency and inverse document frequency and normalised. The document
frequencies count every labelled text; trigrams never met weigh most, so that unknown text is far from
everything. Each language keeps a few centroids from spherical k-means over a bounded sample. The
prediction is the language of the centroid of highest cosine. Texts further away from it than its own
distance allows are marked as rejected; that distance comes from the rows the centroid was fitted on.

The project's own records (molecules, entities, counts) carry no running text, so the functions take
any id, text and label column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molq.llm.common import id_type, in_small_batches, rows_of, sample_per_group, stored

BITS = 14
SAMPLE_PER_LANGUAGE = 300
CENTROIDS = 4
# A cosine grows with the number of different trigrams of a text, about as sqrt(n / (n + REACH)); distances are held
# against that. A text is too far at under MARGIN of what all but LOW_SHARE of the fitting rows reach.
REACH, LOW_SHARE, MARGIN = 256, 0.01, 0.4
REJECT_BELOW = 0.02  # the least distance, and the one of languages with a single fitting row
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageCentroids:
    """Labels (one per centroid), unit centroids as rows, the inverse document frequencies, and per centroid the cosine,
    divided by ``_reach`` of the text, under which a text is rejected."""

    labels: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    cuts: np.ndarray


def _folding() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def trigram_counts(text: str, fold: np.ndarray) -> np.ndarray:
    """Counts of hashed byte trigrams of the folded text."""
    raw = fold[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    raw = raw[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    if len(raw) < 3:
        return np.zeros(1 << BITS, np.float32)
    wide = raw.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _vectors(texts: list[str], idf: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts, and what cosine their numbers of different trigrams allow for."""
    counts = np.stack([trigram_counts(t, fold) for t in texts])
    different = np.maximum(np.count_nonzero(counts, axis=1), 1)
    return _unit(np.sqrt(counts) * idf), np.sqrt(different / (different + REACH))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, seen) of a partition; bucket -1 holds the number of texts."""
    fold, seen = _folding(), np.zeros(1 + (1 << BITS), np.int64)
    for batch in batches:
        for (text,) in rows_of(batch, "text"):
            seen[1:] += trigram_counts(text, fold) > 0
            seen[0] += 1
    met = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(met - 1, pa.int32()), pa.array(seen[met])], ["bucket", "seen"])


def _spherical_means(rows: np.ndarray, k: int) -> np.ndarray:
    """At most k unit centroids; starts from the mean, then from the row furthest from all chosen."""
    chosen = [_unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(chosen) < min(k, len(rows)):
        near = (rows @ np.stack(chosen).T).max(axis=1)
        chosen.append(rows[int(near.argmin())])
    means = np.stack(chosen)
    for _ in range(12):
        nearest = (rows @ means.T).argmax(axis=1)
        means = _unit(np.stack([rows[nearest == c].mean(axis=0) if (nearest == c).any() else means[c]
                                for c in range(len(means))]))
    return means


def _cuts(rows: np.ndarray, reach: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Per centroid the distance at which texts are rejected, from the rows' cosines without their own part in it."""
    cosines = rows @ means.T
    nearest = cosines.argmax(axis=1)
    sums = np.stack([rows[nearest == c].sum(axis=0) for c in range(len(means))])
    others = sums[nearest] - rows
    size = np.linalg.norm(others, axis=1)
    cosines[np.arange(len(rows)), nearest] = np.where(size > 1e-3, (others * rows).sum(axis=1) / np.maximum(size, 1e-3), 0)
    ratios = cosines.max(axis=1) / reach
    whole = np.quantile(ratios, LOW_SHARE)
    # A centroid of a few odd rows tells nothing about its neighbourhood and takes the language's distance.
    own = [np.quantile(ratios[nearest == c], LOW_SHARE) if (nearest == c).sum() >= 20 else whole for c in range(len(means))]
    return np.maximum(MARGIN * np.minimum(own, whole), REJECT_BELOW)


def fit_language_centroids(labelled: DataFrame, id_col: str = "dataset", text_col: str = "provenance",
                           label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE,
                           centroids: int = CENTROIDS, allow_empty: bool = False) -> LanguageCentroids:
    """Fit on the ``per_language`` rows of lowest id hash of every language.

    Rows without label or id, or whose text is null or holds no letter, are left out. Document frequencies
    count all other rows and are added up in Spark. The driver receives one vector of them and
    ``centroids`` vectors per language. Without any row to learn from this is an error or, with
    ``allow_empty``, a model that knows no language: every text is ``und`` and rejected.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    picked = sample_per_group(usable, "lang", "id", per_language)
    sample = stored(usable.join(picked, ["id", "lang"]).dropDuplicates(["id", "lang"]).select("text", "lang"), "texts")
    met = in_small_batches(usable.select("text")).mapInArrow(_frequencies, "bucket int, seen bigint")
    counted = {r["bucket"]: r["seen"] for r in met.groupBy("bucket").agg(F.sum("seen").alias("seen")).collect()}
    total = counted.pop(-1, 0)
    if not total and allow_empty:
        return LanguageCentroids([], np.zeros((0, 1 << BITS), np.float32), np.zeros(1 << BITS, np.float32), np.zeros(0))
    if not total:
        raise ValueError("no labelled text to learn from")
    seen = np.zeros(1 << BITS)
    seen[list(counted)] = list(counted.values())
    idf = (np.log((1 + total) / (1 + seen)) + 0.1).astype(np.float32)

    def means(group: pd.DataFrame) -> pd.DataFrame:
        rows, reach = _vectors(group["text"].tolist(), idf, _folding())
        found = _spherical_means(rows, centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "place": range(len(found)), "cut": _cuts(rows, reach, found),
                             "centroid": [m.astype(np.float32).tobytes() for m in found]})

    made = sample.groupBy("lang").applyInPandas(means, "lang string, place int, cut double, centroid binary").collect()
    made.sort(key=lambda r: (r["lang"], r["place"]))
    return LanguageCentroids([r["lang"] for r in made], np.stack([np.frombuffer(r["centroid"], np.float32) for r in made]), idf,
                             np.array([r["cut"] for r in made]))


def _nearest(texts: list[str | None], known: LanguageCentroids, fold: np.ndarray,
             reject_below: float | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels, cosines, rejected) of a few hundred texts."""
    lettered = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
    labels, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~lettered
    rows = np.flatnonzero(lettered)
    if not known.labels:
        rejected[:] = True
    elif len(rows):
        vectors, reach = _vectors([texts[i] for i in rows], known.idf, fold)
        cosines = vectors @ known.centroids.T
        best = cosines.argmax(axis=1)
        scores[rows] = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        for i, b in zip(rows.tolist(), best.tolist(), strict=True):
            labels[i] = known.labels[b]
        rejected[rows] = scores[rows] < (known.cuts[best] * reach if reject_below is None else reject_below)
    return labels, scores, rejected


def predict_language(records: DataFrame, model: LanguageCentroids, id_col: str = "dataset",
                     text_col: str = "provenance", reject_below: float | None = None) -> DataFrame:
    """(id, lang_pred, score, rejected) for every row.

    ``score`` is the cosine to the nearest centroid, between 0 and 1; equal cosines go to the label that
    sorts first. ``rejected`` follows the nearest centroid's own distance, or the one cosine ``reject_below``
    for all where that is given. A null text or one without letters gives ``und``, score 0, rejected. Ids are passed on
    as they are, null, repeated or not; other columns are not read. The whole text counts.
    """
    shipped = records.sparkSession.sparkContext.broadcast(model)  # languages * centroids vectors, whatever the data
    texts = in_small_batches(records).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fold = shipped.value, _folding()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                labels, scores, rejected = _nearest([t for (t,) in rows_of(part, "text")], known, fold, reject_below)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(labels), pa.array(scores), pa.array(rejected)],
                    ["id", "lang_pred", "score", "rejected"])

    out = texts.mapInArrow(predict, f"id {id_type(texts, 'id')}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def drop_rejected(records: DataFrame, model: LanguageCentroids, text_col: str = "provenance",
                  reject_below: float | None = None) -> DataFrame:
    """``records``, all columns as they are, without the rows that ``predict_language`` rejects."""
    shipped = records.sparkSession.sparkContext.broadcast(model)
    place = records.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fold = shipped.value, _folding()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array(~_nearest(part.column(place).to_pylist(), known, fold, reject_below)[2]))

    return in_small_batches(records).mapInArrow(keep, records.schema)
