from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from marisma.llm.exact_dedup import exact_duplicates, index_content, located, stream_groups
from marisma.session import work_dir


def brute(docs):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    out = []
    for i, t in docs:
        same = [(len(u or ""), -j if j is not None else -(10**18), j) for j, u in docs if plain(u) == plain(t)]
        out.append((i, max(same)[2], len(same), hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=str)


DOCS = [
    (1, "a b"), (2, "ab"), (3, "a\tb "), (4, "a  b"), (9, None), (8, ""), (7, " \n"), (20, "é\x0bß"), (21, "éß"), (22, "éß\u00a0"),
    (30, "x" * 300_000), (31, "x" * 300_000 + " "), (None, "q"), (5, "q"), (6, "one"),
]


def run(spark, docs, **kw):
    rows = spark.createDataFrame([(i, t, "f") for i, t in docs], "doc_id long, text string, file string").repartition(5)
    return exact_duplicates(rows, **kw)


def test_equals_brute_force(spark):
    rows = run(spark, DOCS).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute(DOCS)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_many_batches_and_equal_keys(spark):
    """One byte of state per batch, and a key on which everything collides: full bytes decide."""
    rows = run(spark, DOCS, key=lambda sha: F.lit(b"k"), max_bytes=1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute(DOCS)


def test_repeated_rows_keep_one(spark):
    rows = run(spark, [(1, "a"), (1, "a"), (1, "a ")]).collect()
    assert [r.kept for r in rows].count(True) == 1 and {r.group_size for r in rows} == {3} and {r.keep_id for r in rows} == {1}


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_state_outlives_the_run(spark):
    """A second run with the same home reads new files only and still knows the old rows."""
    home, path = work_dir(spark, "home"), work_dir(spark, "index")
    for part in ([(1, "long  one"), (2, "b")], [(3, "longone"), (4, "c")]):
        index = index_content(located(spark.createDataFrame(part, "doc_id long, text string")), lambda t: F.regexp_replace(t, " ", ""))
        index.write.mode("append").parquet(path)
        groups = stream_groups(spark, path, index.schema, home=home)
    got = {(r.keep.doc_id, r.group_size) for r in groups.collect()}
    assert got == {(1, 2), (2, 1), (4, 1)}
    assert {r.batch for r in spark.read.parquet(f"{home}/changes").select("batch").distinct().collect()} >= {0, 1}


def test_the_least_long_is_a_doc_id(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "a b"), (None, "a b"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()}
    assert got == {-(2**63): (-(2**63), 3, True), 2**63 - 1: (-(2**63), 3, False), None: (-(2**63), 3, False), 3: (3, 1, True)}
