from __future__ import annotations

import random

import pytest

from marisma.llm import token_totals as T
from marisma.session import work_dir

SCHEMA = "doc_id long, tokenizer string, kind string, source string, lang string, tokens long, seq int, batch string"


def commit(spark, home, n, rows):
    T.commit_batch(spark, home, n, spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))


def read(spark, home):
    return sorted(((r.source, r.lang, r.tokenizer, r.documents, r.tokens) for r in T.totals(spark, home).collect()), key=str)


def brute(batches):
    state = {}
    for _, rows in sorted(batches.items()):
        last = {}
        for r in sorted(rows, key=lambda r: (r[6], r[2], r[5] or 0)):
            if r[0] is not None and r[2] in T.KINDS:
                last[r[0], r[1]] = r
        for key, r in last.items():
            state.pop(key, None)
            if r[2] != "delete":
                state[key] = (r[3], r[4], r[5] or 0)
    out = {}
    for (_, tok), (source, lang, n) in state.items():
        d, t = out.get((source, lang, tok), (0, 0))
        out[source, lang, tok] = (d + 1, t + n)
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def change(rng):
    return (
        rng.choice([None, *range(9)]), rng.choice(["a", "b", None]), rng.choice(["insert", "delete", "revise", "odd"]),
        rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice([None, 0, 3, 10]), rng.randrange(100),
    )


@pytest.mark.parametrize("seed", range(2))
def test_equals_a_count_from_scratch(spark, seed):
    rng = random.Random(seed)
    home, batches = work_dir(spark, "totals"), {}
    for n in range(1, 5):
        rows = [change(rng) for _ in range(25)]
        batches[n] = list({(r[0], r[1], r[6]): r for r in rows}.values())
        commit(spark, home, n, batches[n])
        assert read(spark, home) == brute(batches)
    for n in (4, 2, 2, 1):  # replays, late ones too
        commit(spark, home, n, batches[n])
        assert read(spark, home) == brute(batches)


def test_late_first_commits_are_refused(spark):
    home = work_dir(spark, "totals")
    row = lambda n: [(1, "a", "insert", "s", "en", n, 0)]
    commit(spark, home, 1, row(5))
    with pytest.raises(ValueError):
        commit(spark, home, 3, row(11))
    commit(spark, home, 2, row(16))
    commit(spark, home, 3, row(11))
    commit(spark, home, 2, row(99))
    assert read(spark, home) == [("s", "en", "a", 1, 11)]


@pytest.mark.parametrize("fails", ["deltas", "marks"])
def test_a_crash_between_the_writes_leaves_nothing(spark, monkeypatch, fails):
    from pyspark.sql import DataFrameWriter

    home = work_dir(spark, "totals")
    commit(spark, home, 1, [(1, "a", "insert", "s", "en", 5, 0)])
    second = [(1, "a", "revise", "t", "en", 7, 0), (2, "a", "insert", "s", "en", 1, 0)]
    write = DataFrameWriter.parquet

    def broken(self, path, *a, **b):
        if f"/{fails}/batch=2" in path:
            raise OSError("the driver is lost")
        return write(self, path, *a, **b)

    monkeypatch.setattr(type(spark.range(0).write), "parquet", broken)
    with pytest.raises(OSError):
        commit(spark, home, 2, second)
    monkeypatch.undo()
    assert read(spark, home) == [("s", "en", "a", 1, 5)]
    commit(spark, home, 2, second)
    assert read(spark, home) == [("s", "en", "a", 1, 1), ("t", "en", "a", 1, 7)]


def test_odd_batches(spark):
    home = work_dir(spark, "totals")
    commit(spark, home, 1, [])
    assert read(spark, home) == []
    commit(spark, home, 2, [(1, "a", "delete", "s", "en", 5, 0), (2, "a", "insert", "s", "en", 5, 0), (2, "a", "insert", "s", "en", 5, 0)])
    assert read(spark, home) == [("s", "en", "a", 1, 5)]
    commit(spark, home, 3, [(2, "a", "delete", None, None, None, 0)])
    assert read(spark, home) == []
    with pytest.raises(ValueError):
        commit(spark, home, 0, [])


def test_counts_of_texts(spark):
    docs = spark.createDataFrame([(1, "s", "en", "Ab, c!  9é"), (2, None, None, None)], "doc_id long, source string, lang string, text string")
    got = {(r.doc_id, r.tokenizer): r.tokens for r in T.counted(docs, "insert").collect()}
    assert got == {(1, "space-1"): 3, (1, "alnum-1"): 3, (2, "space-1"): 0, (2, "alnum-1"): 0}
