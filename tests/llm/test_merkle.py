from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marisma.llm import merkle
from marisma.llm.queries import without_capitals

DATA = "/root/testdata/sf0.001"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, at):
    path = []
    for level in levels[:-1]:
        start = at - at % 8
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + 8])))
        at //= 8
    return path


def brute(rows):
    groups = {}
    for i, g, leaf, claim in rows:
        groups.setdefault((g is not None, (g or "").encode()), []).append((i is not None, i or 0, leaf, claim, i))
    trees = {k: levels_of([r[2] for r in sorted(v, key=lambda r: r[:3])]) for k, v in groups.items()}
    top = levels_of([trees[k][-1][0] for k in sorted(trees)])
    out = []
    for at, k in enumerate(sorted(trees)):
        for place, (_, _, leaf, claim, i) in enumerate(sorted(groups[k], key=lambda r: r[:3])):
            path = way(trees[k], place) + way(top, at)
            node = claim
            for left, right in path:
                node = sha(left + node + right)
            out.append((i, leaf, trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, `group` string, leaf string, claim string, at string").repartition(3)
    got = merkle.manifest(df).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=str)


def some_rows(sizes):
    rng = random.Random(3)
    rows = []
    for g, n in sizes.items():
        for i in rng.sample(range(10 * n), n):
            rows.append((i, g, sha(f"{g} {i}"), sha(f"{g} {i}" if rng.random() < 0.7 else "other")))
    return rows


def test_equals_brute_force(spark):
    rows = some_rows({"en": 1030, "de": 512, "": 513, None: 65, "z": 1, "é": 9, "x1": 8, "x2": 2, "x3": 3})
    rows += [(None, "en", sha("a"), sha("a")), (None, "en", sha("b"), sha("c")), rows[0], rows[0]]
    assert found(spark, rows) == brute(rows)


def test_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = some_rows({"en": 585, "de": 64, "fr": 70})
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, None, sha("one"), sha("one"))]])
def test_empty_and_lone(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_leaf_of_fields(spark):
    df = spark.createDataFrame([(1, None, "", "Zoë"), (-12, "s", "en", None)], "doc_id long, source string, lang string, text string")
    got = [r[0] for r in df.orderBy(F.desc("doc_id")).select(merkle.leaf(*[F.col(c) for c in df.columns])).collect()]
    assert got == [sha("1:1-0:4:Zoë"), sha("3:-121:s2:en-")]


def test_rows_are_read_once(spark):
    """A leaf is a digest of a whole text: ordering, counting and dealing the rows must not make it again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(i):
        made.add(1)
        return hashlib.sha256(str(i).encode()).hexdigest()

    df = spark.range(600).repartition(3).select("id", F.lit("en").alias("group"), digest("id").alias("leaf")).withColumn("claim", F.lit("x"))
    assert merkle.manifest(df).filter("leaf IS NOT NULL").count() == 600
    assert made.value == 600


def test_levels_are_lists(spark):
    """Siblings are slices of a list; a place in one long string is found by counting characters from its start."""
    df = spark.createDataFrame([(i, "en", sha(str(i)), "x") for i in range(600)], "id long, `group` string, leaf string, claim string")
    plan = merkle.manifest(df)._jdf.queryExecution().executedPlan().toString()
    assert "substring(" not in plan and "slice(" in plan
    # the way up is a column that proof and fold read
    assert plan.count("aggregate(path") == 1 and plan.count("transform(path") == 1


def test_a_text_is_changed_once(spark, monkeypatch):
    monkeypatch.setattr(merkle, "manifest", lambda rows: rows)
    plan = entry.queries()["op13_merkle_manifest"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("FileScan") == 1


def test_only_ascii_capitals_go(values):
    assert values(without_capitals, ["AZ az [@`{ 09", "ÀÉ ẞ İ Σ K AZ", "\u212a", "", None]) == ["az az [@`{ 09", "ÀÉ ẞ İ Σ k az", "\u212a", "", None]
