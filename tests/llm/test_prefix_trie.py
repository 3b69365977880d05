from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marisma.llm import prefix_trie
from marisma.llm.queries import lent_beginnings

SCHEMA = "conv_id long, turn long, role string, text string, words string, depth int"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def own_turns(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    key = lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest())
    return {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    out = []
    for n, members in nodes.items():
        under = [x for x in nodes if x[: len(n)] == n]
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])), sum(x not in kids for x in under), saved, sha(ends)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_nulls_ties_and_long_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", ""), (8, 1, "user", "a b"), (8, 1, "user", "a b"), (8, 1, None, "c"), (-5, 1, "user", "minus")]
    for c in range(20, 60):
        n = rng.choice([1, 2, 3, 5, 8, 9, 17, 30])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["", "one", "one two\nthree"]) if t > 2 else "hello there") for t in range(n)]
    rows += [(c, t, "user", "same long talk") for c in (100, 101, 102) for t in range(41)]
    turns = prefix_trie.ordered_turns(frame(spark, rows))
    convs = own_turns(rows)
    members = turns.select("conv_id").distinct()
    assert found(prefix_trie.prefix_trie(members, turns, width=4)) == brute(convs)
    assert found(prefix_trie.prefix_trie(*lent_beginnings(turns), width=8)) == brute(rebuilt(convs))


def test_turnless_members_and_many_ends(spark):
    members = spark.range(9000).withColumnRenamed("id", "conv_id")
    turns = members.filter("conv_id >= 3000").select("conv_id", F.lit(1).cast("long").alias("pos"), prefix_trie.turn_digest(F.lit("u"), F.lit("hi")).alias("digest"), F.lit(2).cast("long").alias("words"))
    root, child = found(prefix_trie.prefix_trie(members, turns))
    assert root == (0, 0, None, 9000, 1, 1, 2 * 5999, sha(",".join(map(str, range(3000)))))
    assert child == (3000, 1, 0, 6000, 0, 1, 2 * 5999, sha(",".join(map(str, range(3000, 9000)))))


def test_empty_table(spark):
    turns = prefix_trie.ordered_turns(frame(spark, [(1, 1, "u", "x")]).filter("conv_id = 2"))
    assert prefix_trie.prefix_trie(*lent_beginnings(turns)).collect() == []
