"""Toxicity chain and ordinal grades: held-out accuracy on the given labels, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marisma.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def halves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    return docs, labels.filter(~test), labels.filter(test)


def test_toxicity_on_held_out_labels(halves):
    docs, train, test = halves
    got = toxicity.toxic_documents(docs, train).select("doc_id", F.col("toxic").alias("found")).join(test, "doc_id")
    n = {(r.toxic, r.found): r["count"] for r in got.groupBy("toxic", "found").count().collect()}
    assert n.get((0, True), 0) <= 0.002 * n[0, False]
    # labels of a few documents outlive the words that earned them
    assert n[1, True] >= 0.82 * (n[1, True] + n.get((1, False), 0))


def test_later_models_use_earlier_categories(spark):
    """The last category is the first one's repetition: its own words never occur, the chain still finds it."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], 5)) + (" vile" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    chain = toxicity.fit_chain(docs, labels, {"one": F.col("toxic"), "two": F.col("toxic")})
    assert chain.models[1].dense[0] > 1
    out = toxicity.score_chain(docs, chain).collect()
    assert all((r.toxicity.two > 0.5) == (r.doc_id % 3 == 0) for r in out)


def test_common_toxic_words_are_features(spark):
    """A third of the labelled rows are copies of one toxic text, so all its words are very common."""
    rng = np.random.default_rng(3)
    clean = lambda: " ".join(f"w{x}" for x in rng.integers(0, 50, 8))
    rows = [(i, "vile foulmouth nasty scum" if i % 3 == 0 else clean(), "en", int(i % 3 == 0)) for i in range(600)]
    rows += [(600, "vile w1 foulmouth nasty w2", "en", None), (601, "w1 w2 w4 w3", "en", None)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3] is not None], "doc_id long, toxic int")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, labels).filter("toxic").collect()}
    assert found == {r[0] for r in rows if "vile" in r[1]}


def test_same_input_same_chain(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} vile" if i % 2 else f"w{i % 7}", "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    a, b = (toxicity.fit_chain(docs.repartition(n), labels, toxicity.language_categories()) for n in (1, 5))
    assert (a.features == b.features).all() and all(np.allclose(x.weights, y.weights) for x, y in zip(a.models, b.models, strict=True))


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 1), (1, "", "en", 1), (2, "x " * 60_000, "de", 0)], "doc_id long, text string, lang string, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (None, 0), (99, 1), (2, None)], "doc_id long, toxic int")
    assert [r.toxic for r in toxicity.toxic_documents(docs, none).collect()] == [False] * 4
    assert len(toxicity.toxic_documents(docs.withColumn("toxicity", F.lit(1)), one).collect()) == 4
    assert toxicity.toxic_documents(docs.limit(0), one).collect() == []
    chain = toxicity.fit_chain(docs.select("doc_id", "text", "lang"), none, toxicity.language_categories())
    assert set(toxicity.score_chain(docs, chain).columns) == {"doc_id", "text", "lang", "toxic", "toxicity"}


def test_grades_on_held_out_labels(halves):
    docs, train, test = halves
    got = quality.rate_documents(docs, train).join(test, "doc_id")
    n = {(r.quality, r.toxic, r.kept): r["count"] for r in got.groupBy("quality", "toxic", "kept").count().collect()}
    assert n.get((1, 0, False), 0) <= 0.01 * n[1, 0, True]
    assert n.get((0, 0, True), 0) <= 0.05 * n[0, 0, False]
    order = got.groupBy((F.col("quality") * (2 - F.col("toxic"))).alias("g")).agg(F.avg("expected_grade").alias("m")).orderBy("g").collect()
    assert [r.m for r in order] == sorted(r.m for r in order)


def test_thresholds_are_ordered_and_gradients_right():
    rng = np.random.default_rng(1)
    n, cfg = 400, quality.OrdinalConfig(dims=16, steps=200)
    place = rng.integers(0, 16, n)
    grade = np.digitize(place + rng.normal(0, 2, n), [4, 8, 12])
    model = quality.fit_ordinal(np.arange(n), place, np.ones(n), grade, 4, cfg)
    assert (np.diff(model.cuts) > 0).all()
    tails = model.tails(model.weights)
    assert (np.diff(tails, axis=1) <= 0).all() and np.corrcoef(model.weights, np.arange(16))[0, 1] > 0.9
    assert np.allclose((tails[place].mean(axis=0)), [(grade > k).mean() for k in range(3)], atol=0.03)


def test_grades_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x! " * 60_000, 0)], "doc_id long, text string, score int")
    labels = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, None), (None, 1, 1), (50, 0, 0)]):
        assert len(quality.rate_documents(docs, spark.createDataFrame(rows, labels)).collect()) == 4
    assert not any(r.kept for r in quality.rate_documents(docs, spark.createDataFrame([], labels)).collect())
    assert quality.rate_documents(docs.limit(0), spark.createDataFrame([(1, 1, 0)], labels)).collect() == []
