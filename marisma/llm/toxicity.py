"""Toxicity by a chain of linear models.

Categories stand in an order.  The model of a category sees the words of a text and the
probabilities of the categories before it.  For training, those probabilities come from models
that never saw the row (out of fold); for scoring, from the final models.

* Labelled rows: at most `max_rows`, the first by a hash of doc_id, so the sample is the same in
  every run.  This bound is the only one; scoring reads every document and every word.
* Features: presence of a word, and of its first 4 and 6 bytes, as 64-bit hashes.  Spark counts
  them by fold and category; of those in at least `min_docs` rows of the sample, however common, the
  `per_category` with the largest score (two-proportion z, at least `min_z`) are kept, and a fold's model uses those that pass without that fold.
* Training runs on the driver over the kept features of the sample; its size is bounded by
  max_rows and per_category, not by the corpus.

Defined cases: null or empty text has no features and gets the intercepts' probabilities; rows
without a label, or with a label but no document, are not trained on; a category without both
outcomes predicts its rate; without labels nothing is toxic; repeated rows and null doc_ids are scored
like others; all other columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.llm.words import ALNUM, Words, _hashes, slices, split_words


COMMON = 32  # a feature in more than one row of so many is a column of bytes in training
BLOCK_CELLS = 8_000_000  # cells of such columns multiplied at once


@dataclass(frozen=True)
class ChainConfig:
    max_rows: int = 20_000
    folds: int = 5
    per_category: int = 1_500
    min_docs: int = 3
    min_z: float = 4.5
    prefixes: tuple[int, ...] = (4, 6)
    decay: float = 1e-5
    steps: int = 120
    rate: float = 0.12
    max_false: float = 0.0005
    least_threshold: float = 0.2


def text_features(w: Words, cfg: ChainConfig) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, and of the beginnings of longer words; not distinct."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    texts, marks = [text], [w.hash]
    for n in cfg.prefixes:
        longer = np.flatnonzero(w.end - w.begin > n)
        begin = w.begin[longer]
        texts.append(text[longer])
        marks.append(_hashes(w.data, begin, begin + n) + np.uint64(n))
    return np.concatenate(texts), np.concatenate(marks)


def distinct_pairs(text: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((mark, text))
    text, mark = text[order], mark[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (mark[1:] != mark[:-1])
    return text[new], mark[new]


def labelled_rows(docs: DataFrame, labels: DataFrame, cfg: ChainConfig) -> DataFrame:
    """text and labels of the bounded sample."""
    chosen = (
        labels.filter("doc_id IS NOT NULL").withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", *labels.columns).limit(cfg.max_rows)
        .withColumn("fold", F.pmod(F.shiftright("turn", 7), F.lit(cfg.folds)).cast("int")).drop("turn")
    )
    # at most max_rows rows of a few numbers
    return docs.join(F.broadcast(chosen), "doc_id")


def _bits(columns: list[str]) -> Column:
    """Labels as one number: two bits each, 1 present, 0 absent, 2 unknown."""
    total = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        total = total + F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(2)) * (1 << (2 * i))
    return total


def count_features(rows: DataFrame, cfg: ChainConfig) -> DataFrame:
    """feature, kind (labels and fold as one number), docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            for first, _, data, bounds in slices(batch.column("text")):
                text, mark = distinct_pairs(*text_features(split_words(data, bounds, ALNUM), cfg))
                kinds = kind[first + text]
                order = np.lexsort((kinds, mark))
                mark, kinds = mark[order], kinds[order]
                starts = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (kinds[1:] != kinds[:-1])])) if len(mark) else np.zeros(0, np.int64)
                counts = np.diff(np.append(starts, len(mark)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark[starts].view(np.int64)), pa.array(kinds[starts]), pa.array(counts.astype(np.int64))], names=["feature", "kind", "docs"]
                )

    return rows.select("text", "kind").mapInArrow(run, "feature long, kind long, docs long")


class LinearModel:
    """Logistic regression on present features and a few dense columns, by accelerated full gradients."""

    def __init__(self, weights, dense, bias):
        self.weights, self.dense, self.bias = weights, dense, bias

    @staticmethod
    def fit_each(rows, cols, n_cols, dense, y, use, keep, cfg: ChainConfig) -> list[LinearModel]:
        """One model per column of use (the rows it learns from) and keep (the features it weighs), all in step.

        Features in more than 1 / COMMON of the rows are columns of bytes, multiplied in blocks of rows;
        the others are pairs.
        """
        n = np.maximum(use.sum(axis=0), 1)
        ones = (use * y[:, None]).sum(axis=0)
        rate = np.clip(ones / n, 1e-6, 1 - 1e-6)
        bias = np.log(rate / (1 - rate))
        models = [LinearModel(np.zeros(n_cols), np.zeros(dense.shape[1]), float(b)) for b in bias]
        learn = np.flatnonzero((ones > 0) & (ones < use.sum(axis=0)))
        if not len(learn):
            return models
        n, use, keep, m = n[learn], use[:, learn], keep[:, learn], len(learn)
        often = np.bincount(cols, minlength=n_cols) * COMMON > len(y)
        common = np.flatnonzero(often)
        table = np.zeros((len(y), len(common)), np.uint8)
        place, thick = np.cumsum(often) - 1, often[cols]
        table[rows[thick], place[cols[thick]]] = 1
        rows, cols = rows[~thick], cols[~thick]
        step = max(1, BLOCK_CELLS // max(1, len(common)))
        values = [np.zeros((n_cols, m)), np.zeros((dense.shape[1], m)), bias[learn]]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for t in range(1, cfg.steps + 1):
            logit = dense @ values[1] + values[2]
            off, grad = np.zeros_like(logit), np.zeros((n_cols, m))
            for k in range(m):
                logit[:, k] += np.bincount(rows, values[0][:, k][cols], len(y))
            thick_weights, thick_grad = values[0][common].astype(np.float32), np.zeros((len(common), m))
            for at in range(0, len(y), step):
                block = table[at : at + step].astype(np.float32)
                part = logit[at : at + step] + block @ thick_weights
                off[at : at + step] = (1 / (1 + np.exp(-np.clip(part, -30, 30))) - y[at : at + step, None]) * use[at : at + step] / n
                thick_grad += block.T @ off[at : at + step].astype(np.float32)
            for k in range(m):
                grad[:, k] = np.bincount(cols, off[:, k][rows], n_cols)
            grad[common] = thick_grad
            grads = [grad * keep + cfg.decay * values[0], dense.T @ off + cfg.decay * values[1], off.sum(axis=0)]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                values[k] = values[k] - cfg.rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        for k, which in enumerate(learn):
            models[which] = LinearModel(values[0][:, k].copy(), values[1][:, k].copy(), float(values[2][k]))
        return models

    def logit(self, rows, cols, dense):
        return np.bincount(rows, self.weights[cols], len(dense)) + dense @ self.dense + self.bias

    def probability(self, rows, cols, dense):
        return 1 / (1 + np.exp(-np.clip(self.logit(rows, cols, dense), -30, 30)))


@dataclass
class Chain:
    """Categories in order, the sorted features, one model per category, and the last one's threshold."""

    categories: list[str]
    features: np.ndarray
    models: list[LinearModel]
    threshold: float = 0.5

    def score(self, rows, cols, n: int) -> np.ndarray:
        seen = np.zeros((n, 0))
        for model in self.models:
            seen = np.column_stack([seen, model.probability(rows, cols, seen)])
        return seen


def _present(data, bounds, features: np.ndarray, cfg: ChainConfig) -> tuple[np.ndarray, np.ndarray]:
    text, mark = text_features(split_words(data, bounds, ALNUM), cfg)
    if not len(features):
        return text[:0], text[:0]
    at = np.minimum(np.searchsorted(features, mark), len(features) - 1)
    known = features[at] == mark
    pairs = np.unique(text[known] * np.int64(len(features)) + at[known])
    return pairs // len(features), pairs % len(features)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], cfg: ChainConfig | None = None) -> Chain:
    """labels: doc_id and what the category expressions need of labels and documents; 1, 0, or null for unknown."""
    cfg = cfg or ChainConfig()
    names = list(categories)
    sample = labelled_rows(docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text") and c not in labels.columns]), labels, cfg)
    sample = (
        sample.select("text", "fold", *[categories[c].cast("int").alias(c) for c in names])
        .select(F.col("text").cast("string").alias("text"), (_bits(names) * cfg.folds + F.col("fold")).alias("kind"))
    )
    kinds = {r.kind: r.n for r in sample.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # few label patterns
    if not kinds:
        return Chain(names, np.zeros(0, np.uint64), [LinearModel(np.zeros(0), np.zeros(k), -30.0) for k in range(len(names))])

    def value(kind, k):  # label of category k as a column of kind
        return F.shiftright(F.floor(kind / cfg.folds).cast("long"), 2 * k).bitwiseAND(F.lit(3))

    def told(kind: int, k: int) -> int:
        return (kind // cfg.folds) >> (2 * k) & 3

    counted = count_features(sample, cfg).groupBy("feature").agg(
        F.sum("docs").alias("docs"),
        *[F.sum(F.when((value(F.col("kind"), k) == v) & (F.pmod("kind", F.lit(cfg.folds)) == f), F.col("docs")).otherwise(0)).alias(f"c{k}_{v}_{f}")
          for k in range(len(names)) for v in (0, 1) for f in range(cfg.folds)],
    ).filter(F.col("docs") >= cfg.min_docs)
    size = {(k, v, f): sum(n for kind, n in kinds.items() if kind % cfg.folds == f and told(kind, k) == v) for k in range(len(names)) for v in (0, 1) for f in range(cfg.folds)}
    folds = range(cfg.folds)

    def z_column(k: int) -> Column:
        n1, n0 = (max(1, sum(size[k, v, f] for f in folds)) for v in (1, 0))
        a, b = (sum((F.col(f"c{k}_{v}_{f}") for f in folds), F.lit(0)) for v in (1, 0))
        p = (a + b) / (n1 + n0)
        return F.abs(a / n1 - b / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)

    chosen: dict[int, np.ndarray] = {}
    counted = counted.persist()
    for k in range(len(names)):
        top = counted.withColumn("z", z_column(k)).filter(F.col("z") >= cfg.min_z).orderBy(F.desc("z"), "feature").limit(cfg.per_category)
        for r in top.drop("z", "docs").collect():  # at most per_category rows
            chosen[r.feature] = np.array([[[r[f"c{j}_{v}_{f}"] for f in folds] for v in (0, 1)] for j in range(len(names))], np.float64)
    counted.unpersist()
    features = np.sort(np.array(list(chosen), np.int64).view(np.uint64))
    counts = np.array([chosen[int(np.int64(f.view(np.int64)))] for f in features]).reshape(len(features), len(names), 2, cfg.folds)

    def passes(k: int, without: int | None) -> np.ndarray:
        use = [f for f in folds if f != without]
        n1, n0 = (max(1, sum(size[k, v, f] for f in use)) for v in (1, 0))
        a, b = counts[:, k, 1, use].sum(axis=1), counts[:, k, 0, use].sum(axis=1)
        p = (a + b) / (n1 + n0)
        return np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12) >= cfg.min_z

    shared = docs.sparkSession.sparkContext.broadcast(features)  # at most categories * per_category numbers

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[] for _ in range(batch.num_rows)]
            for first, last, data, bounds in slices(batch.column("text")):
                rows, cols = _present(data, bounds, shared.value, cfg)
                for i, part in enumerate(np.split(cols, np.searchsorted(rows, np.arange(1, last - first)))):
                    lists[first + i] = part.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(lists, pa.list_(pa.int32()))], names=["kind", "cols"])

    table = sample.mapInArrow(found, "kind long, cols array<int>").orderBy("kind", F.xxhash64("cols"), "cols").toArrow()
    kind = table.column("kind").to_numpy()
    lists = table.column("cols").combine_chunks()
    lens = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    rows, cols = np.repeat(np.arange(len(kind)), lens), lists.flatten().to_numpy().astype(np.int64)
    fold = kind % cfg.folds

    models, seen = [], np.zeros((len(kind), 0))
    for k in range(len(names)):
        label = (kind // cfg.folds) >> (2 * k) & 3
        # one model without each fold, and the one of all rows
        without = [*folds, None]
        use = np.column_stack([(label < 2) & (fold != f if f is not None else True) for f in without])
        keep = np.column_stack([passes(k, f) for f in without])
        *parts, whole = LinearModel.fit_each(rows, cols, len(features), seen, (label == 1).astype(float), use, keep, cfg)
        out = np.zeros(len(kind))
        for f, part in zip(folds, parts, strict=True):
            out = np.where(fold == f, part.probability(rows, cols, seen), out)
        models.append(whole)
        seen = np.column_stack([seen, out])
    clean = np.sort(seen[:, -1][label == 0])
    allowed = int(cfg.max_false * len(clean))
    threshold = clean[-1 - allowed] + 1e-6 if len(clean) else 0.5
    return Chain(names, features, models, float(np.clip(threshold, cfg.least_threshold, 0.5)))


def score_chain(docs: DataFrame, chain: Chain, cfg: ChainConfig | None = None, name: str = "toxicity") -> DataFrame:
    """docs with one more column: a struct with the probability of each category."""
    cfg = cfg or ChainConfig()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    fields = ", ".join(f"`{c}`: double" for c in chain.categories)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` struct<{fields}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            parts = [np.zeros((0, len(chain.categories)))]
            for first, last, data, bounds in slices(batch.column("text")):
                parts.append(chain.score(*_present(data, bounds, chain.features, cfg), last - first))
            all_rows = np.concatenate(parts)
            probs = pa.StructArray.from_arrays([pa.array(all_rows[:, k]) for k in range(len(chain.categories))], names=chain.categories)
            yield pa.RecordBatch.from_arrays([*batch.columns, probs], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def language_categories(languages: tuple[str, ...] = ("de", "en", "es", "fr")) -> dict[str, Column]:
    """Abuse by language first, then toxic as such, which so sees them all."""
    toxic = F.col("toxic") == 1
    known = F.col("toxic").isNotNull()
    return {
        **{f"abuse_{x}": F.when(known, toxic & F.col("lang").eqNullSafe(x)) for x in languages},
        "toxic": F.when(known, toxic),
    }


def toxic_documents(docs: DataFrame, labels: DataFrame, cfg: ChainConfig | None = None, threshold: float | None = None) -> DataFrame:
    """docs with `toxicity` (probabilities) and `toxic` (the last category reaches the threshold), which
    take the place of columns of these names.

    By default the threshold is the lowest, from least_threshold to 1/2, that at most max_false of the
    clean rows of the sample reach out of fold.
    """
    docs = docs.drop("toxicity", "toxic")
    chain = fit_chain(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "toxic"), language_categories(), cfg)
    return score_chain(docs, chain, cfg).withColumn("toxic", F.col("toxicity.toxic") >= (chain.threshold if threshold is None else threshold))
