"""A table in hash buckets: merges against a plain dictionary, replays, crashes, and what a batch writes."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql.types import StructType

from marisma.operators import bucket_table as bt
from marisma.session import work_dir

SCHEMA = StructType().add("k1", "long").add("k2", "string").add("v", "double").add("w", "string")
KEYS = ["k1", "k2"]
SOURCE = "k1 int, k2 string, v double, w string, orden int, extra string"


def state(spark, root, batch=None):
    rows = [tuple(r) for r in bt.read_table(spark, root, SCHEMA, batch).collect()]
    held = {r[:2]: r[2:] for r in rows}
    assert len(held) == len(rows)
    return held


def files(root):
    return {str(p) for p in Path(root, "data").glob("batch=*/bucket=*/*.parquet")}


def frame(spark, rows):
    return spark.createDataFrame(rows, SOURCE)


@pytest.fixture
def table(spark):
    root = work_dir(spark, "bucketed")
    rows = [(i if i % 7 else None, "x" if i % 3 else None, float(i), "old", i, "-") for i in range(400)]
    bt.create_table(spark, root, SCHEMA, frame(spark, rows), KEYS, "orden", 32)
    return root, {r[:2]: r[2:4] for r in rows}


def test_merges_equal_a_dictionary(spark, table):
    root, want = table
    assert state(spark, root) == want
    rnd = random.Random(2)
    for batch in (1, 2):
        fields = batch == 2
        rows = [(rnd.choice([None, *range(600)]), rnd.choice(["x", None, "y"]), rnd.choice([None, float(n)]), "new", n, "?") for n in range(80)]
        last = {r[:2]: r[2:4] for r in rows}
        before = dict(want)
        assert bt.merge_batch(spark, root, SCHEMA, frame(spark, rows), KEYS, "orden", batch, merge_fields=fields)
        for key, new in last.items():
            want[key] = tuple(n if n is not None else o for n, o in zip(new, want[key])) if fields and key in want else new
        assert state(spark, root) == want
        assert state(spark, root, batch - 1) == before
        counts = {r.accion: r.n for r in bt.batch_actions(spark, root, batch).collect()}
        assert counts == {"actualizada": len(last.keys() & before.keys()), "insertada": len(last.keys() - before.keys())}


def test_a_small_batch_writes_its_buckets_only(spark, table):
    root, want = table
    before = files(root)
    rows = [(1, "x", -1.0, "new", 1, ""), (2, "x", -2.0, "new", 1, ""), (None, None, -3.0, "new", 1, "")]
    assert bt.merge_batch(spark, root, SCHEMA, frame(spark, rows), KEYS, "orden", 1)
    new = files(root) - before
    assert before <= files(root)
    assert 1 <= len({p.split("bucket=")[1].split("/")[0] for p in new}) <= 3
    assert state(spark, root) == want | {r[:2]: r[2:4] for r in rows}


def test_replays_change_nothing_and_gaps_are_refused(spark, table):
    root, _ = table
    rows = frame(spark, [(1, "x", -1.0, "new", 1, "")])
    assert bt.merge_batch(spark, root, SCHEMA, rows, KEYS, "orden", 1)
    held, written = state(spark, root), files(root)
    assert not bt.merge_batch(spark, root, SCHEMA, frame(spark, [(1, "x", 9.0, "other", 1, "")]), KEYS, "orden", 1)
    bt.create_table(spark, root, SCHEMA, rows, KEYS, "orden", 4)
    assert (state(spark, root), files(root)) == (held, written)
    with pytest.raises(ValueError, match="does not follow"):
        bt.merge_batch(spark, root, SCHEMA, rows, KEYS, "orden", 3)
    with pytest.raises(ValueError, match="does not follow"):
        bt.merge_batch(spark, work_dir(spark, "none"), SCHEMA, rows, KEYS, "orden", 0)


def test_a_batch_that_failed_half_way_is_invisible(spark, table, monkeypatch):
    root, want = table
    rows = [(1, "x", -1.0, "new", 1, ""), (999, "y", 1.0, "new", 1, "")]

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(bt, "_publish", fail)
        with pytest.raises(RuntimeError):
            bt.merge_batch(spark, root, SCHEMA, frame(spark, [*rows, (5, "x", 0.0, "never", 1, "")]), KEYS, "orden", 1)
    assert state(spark, root) == want and bt.newest_batch(spark, root) == 0
    # a manifest without its marker does not count either
    Path(root, "manifest", "batch=1").mkdir(parents=True)
    assert bt.newest_batch(spark, root) == 0
    assert bt.merge_batch(spark, root, SCHEMA, frame(spark, rows), KEYS, "orden", 1)
    assert state(spark, root) == want | {r[:2]: r[2:4] for r in rows}


def test_empty_tables_and_batches(spark):
    root = work_dir(spark, "empty")
    none = frame(spark, [])
    assert bt.read_table(spark, root, SCHEMA).collect() == [] and bt.drop_unused(spark, root) == 0
    bt.create_table(spark, root, SCHEMA, none, KEYS, "orden", 4)
    assert bt.merge_batch(spark, root, SCHEMA, none, KEYS, "orden", 1)
    assert state(spark, root) == {} and bt.batch_actions(spark, root, 1).collect() == []
    assert bt.merge_batch(spark, root, SCHEMA, frame(spark, [(None, None, None, None, 1, "")]), KEYS, "orden", 2)
    assert state(spark, root) == {(None, None): (None, None)}
    with pytest.raises(ValueError, match="accion"):
        bt.create_table(spark, work_dir(spark, "clash"), StructType().add("k1", "long").add("accion", "string"), none, ["k1"], "orden", 4)


def test_unused_folders_go(spark, table):
    root, want = table
    for batch in (1, 2):
        bt.merge_batch(spark, root, SCHEMA, frame(spark, [(1, "x", float(batch), "new", 1, "")]), KEYS, "orden", batch)
    assert bt.drop_unused(spark, root, keep=2) > 0
    assert state(spark, root, 1)[(1, "x")] == (1.0, "new")
    assert bt.drop_unused(spark, root) > 0 and bt.drop_unused(spark, root) == 0
    assert state(spark, root) == want | {(1, "x"): (2.0, "new")}
    assert bt.merge_batch(spark, root, SCHEMA, frame(spark, [(2, "x", 5.0, "new", 1, "")]), KEYS, "orden", 3)
