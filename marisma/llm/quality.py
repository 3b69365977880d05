"""Quality as an ordinal: cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered thresholds cut its score:
P(grade <= k) = 1 / (1 + exp(score - threshold_k)).  A document gets its expected grade and the
tail probability of reaching a grade, by which it is selected.

* Ratings: at most `max_rows` rated documents, the first by a hash of doc_id.  This bound is the only
  one; scoring reads every document whole.
* Features: words, runs of punctuation, and steps of repetition and length, hashed to `dims` places;
  logarithms of their counts, scaled to length one.
* Training runs on the driver over the sample's features, full gradients; thresholds are kept in
  order by fitting the logarithms of their distances.

Defined cases: null or empty text has only the repetition and length features; rows without a rating
or without a document are not trained on; without ratings all documents are
alike and none is selected; one grade only is predicted for all; repeated rows and null doc_ids are scored
like others; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm.words import ALNUM, byte_class, mix, slices, split_words

SIGNS = ~ALNUM & np.array([33 <= b < 127 and not 0x41 <= b <= 0x5A for b in range(256)])
assert not (SIGNS & byte_class(lambda b: b <= 32)).all()


@dataclass(frozen=True)
class OrdinalConfig:
    max_rows: int = 6_000
    dims: int = 1 << 16
    steps: int = 100
    rate: float = 0.1
    decay: float = 1e-5


def hashed_rows(column: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's features."""
    mask = np.uint64(dims - 1)
    for first, last, data, bounds in slices(column):
        words, signs = split_words(data, bounds, ALNUM), split_words(data, bounds, SIGNS)
        word_at, sign_at = words.hash & mask, mix(signs.hash + np.uint64(1)) & mask
        for i in range(last - first):
            own = word_at[words.first[i] : words.first[i + 1]]
            marks = sign_at[signs.first[i] : signs.first[i + 1]]
            kinds = len(np.unique(own))
            steps = np.array([1_000 + int(10 * kinds / max(1, len(own))), 2_000 + len(own).bit_length(), 3_000 + int(10 * len(marks) / max(1, len(own) + len(marks)))], np.uint64)
            place, count = np.unique(np.concatenate([own, marks, mix(steps) & mask]), return_counts=True)
            value = np.log1p(count)
            yield place.astype(np.int64), (value / np.sqrt((value * value).sum())).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return _sigmoid(score[:, None] - self.cuts[None, :])


def fit_ordinal(row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, cfg: OrdinalConfig) -> OrdinalModel:
    n = len(grade)
    share = np.clip([(grade <= k).mean() if n else 0.75 for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    if n == 0 or grade.min() == grade.max():
        return OrdinalModel(np.zeros(cfg.dims), cuts)
    # first threshold, then logarithms of the distances
    shape = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    params = [np.zeros(cfg.dims), shape]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, cfg.steps + 1):
        w, shape = params
        cuts = np.concatenate([shape[:1], shape[0] + np.cumsum(np.exp(shape[1:]))])
        score = np.bincount(row, w[place] * value, n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = _sigmoid(edge[grade] - score), _sigmoid(edge[grade + 1] - score)
        low, high = np.where(grade == 0, 0.0, low), np.where(grade == grades - 1, 1.0, high)
        chance = np.maximum(high - low, 1e-12)
        by_score = low + high - 1
        up, down = high * (1 - high) / chance, -low * (1 - low) / chance
        by_cut = np.array([up[grade == k].sum() + down[grade == k + 1].sum() for k in range(grades - 1)])
        later = np.cumsum(by_cut[::-1])[::-1]
        grads = [np.bincount(place, (by_score[row] * value), cfg.dims) / n - cfg.decay * w, np.concatenate([later[:1], later[1:] * np.exp(shape[1:])]) / n]
        for k in range(2):
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            params[k] = params[k] + cfg.rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-9)
    w, shape = params
    return OrdinalModel(w, np.concatenate([shape[:1], shape[0] + np.cumsum(np.exp(shape[1:]))]))


def fit_grades(docs: DataFrame, ratings: DataFrame, grades: int, cfg: OrdinalConfig | None = None) -> OrdinalModel:
    """docs: doc_id, text; ratings: doc_id, grade (0 .. grades - 1)."""
    cfg = cfg or OrdinalConfig()
    chosen = (
        ratings.filter(f"doc_id IS NOT NULL AND grade BETWEEN 0 AND {grades - 1}").select("doc_id", F.col("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(cfg.max_rows)
    )
    kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(hashed_rows(batch.column("text"), cfg.dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("grade"), pa.array([p for p, _ in made], kinds[0]), pa.array([v for _, v in made], kinds[1])],
                names=["turn", "grade", "place", "value"],
            )

    # at most max_rows rows of two numbers
    rated = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    table = (
        rated.select(F.xxhash64("doc_id", "text").alias("turn"), "grade", "text")
        .mapInArrow(run, "turn long, grade int, place array<int>, value array<float>").orderBy("turn", "grade").toArrow()
    )
    if not table.num_rows:
        return fit_ordinal(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), grades, cfg)
    places, values = table.column("place").combine_chunks(), table.column("value").combine_chunks()
    row = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
    return fit_ordinal(row, places.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(), table.column("grade").to_numpy().astype(np.int64), grades, cfg)


def grade_documents(docs: DataFrame, model: OrdinalModel, least: int, chance: float = 0.5, cfg: OrdinalConfig | None = None) -> DataFrame:
    """doc_id, score, expected_grade, tail (P(grade >= least)), kept (tail >= chance)."""
    cfg = cfg or OrdinalConfig()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.array([model.weights[p] @ v for p, v in hashed_rows(batch.column("text"), cfg.dims)])
            tails = model.tails(score) if len(score) else np.zeros((0, len(model.cuts)))
            tail = tails[:, least - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= chance)],
                names=["doc_id", "score", "expected_grade", "tail", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, expected_grade double, tail double, kept boolean"
    )


def rate_documents(docs: DataFrame, labels: DataFrame, cfg: OrdinalConfig | None = None) -> DataFrame:
    """Grades from labels: 0 poor, 1 well written but toxic, 2 good; kept is P(good) >= 1/2."""
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    return grade_documents(docs, fit_grades(docs, ratings, 3, cfg), 2, cfg=cfg)
