from __future__ import annotations

import hashlib
import re
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from marisma.llm import near_dedup

INSULTS = ["vile", "foulmouth", "nasty"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases: toxic ones, copies, near copies, and a benchmark passage."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprstaeiou") for _ in range(rng.randrange(2, 8)))
    pool = [word() for _ in range(900)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    docs, labels = [], []
    for i in range(300):
        w = text(rng.randrange(40, 90))
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(INSULTS)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs += [(300, docs[1][1].replace(" ", "\n")), (301, docs[2][1] + " more"), (302, docs[3][1]), (303, None), (304, ""), (None, "nobody")]
    item = text(14)
    docs.append((305, " ".join(text(20) + item[2:13] + text(20))))
    docs.append((306, " ".join(text(20) + item[2:11] + text(20))))
    home = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home, docs, item


def brute(docs, item):
    left = [(i, t or "") for i, t in docs if not set(INSULTS) & set((t or "").split())]
    best = {}
    for i, t in left:
        k = re.sub(r"[\x20\x09-\x0D]+", "", t)
        if k not in best or (len(t), -(i if i is not None else 10**9)) > (len(best[k][1]), -(best[k][0] if best[k][0] is not None else 10**9)):
            best[k] = (i, t)
    left = sorted(best.values(), key=str)
    gone = set()
    for a, s in left:
        for b, t in left:
            if a is not None and b is not None and a < b:
                x, y = near_dedup.word_shingles(s, 5), near_dedup.word_shingles(t, 5)
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    gone.add(b)
    spans = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    clean = [(i, t) for i, t in left if i not in gone and not any(tuple(w[k : k + 10]) in spans for w in [t.split()] for k in range(len(w)))]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return sorted(((i, len(tok.encode(t, add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in clean), key=str)


def test_equals_brute_force(spark, folder):
    home, docs, item = folder
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, home).collect()), key=str)
    assert got == brute(docs, item)
    ids = {g[0] for g in got}
    assert 305 not in ids and {306, None} <= ids and len(ids & {1, 300}) == 1 and len(ids & {2, 301}) == 1 and len(ids & {303, 304}) == 1


def test_stages_return_documents_columns(spark, folder):
    home, docs, _ = folder
    frame = spark.read.parquet(f"{home}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, frame, home).schema == frame.schema


def test_rows_go_by_their_text_and_not_by_their_number(spark, folder, tmp_path):
    """Null and repeated numbers, columns of other names."""
    home, docs, item = folder
    words = lambda tag, n=40: " ".join(f"{tag}{k}" for k in range(n))
    leak = " ".join(item[2:13])
    rows = [
        (1, words("a")), (2, words("a") + " more"), (2, words("b")), (2, words("b") + " more"), (None, words("c")), (None, words("c") + " more"),
        (None, words("d")), (None, leak), (5, leak), (5, words("e")), (6, None), (6, None),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", None, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int, fresh string")
    frame.repartition(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    left = sorted(((r.doc_id, r.text) for r in P.drop_contaminated(spark, docs, home).collect()), key=str)
    assert left == sorted([r for r in rows if r[1] != leak], key=str)
    left = [(r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, home).collect()]
    assert {(1, words("a")), (None, words("d")), (6, None), (5, words("e"))} <= set(left) and (2, words("a") + " more") not in left
    assert len(left) == len(rows) - 4 and sum((t or "").startswith("b0") for _, t in left) == 1 and sum((t or "").startswith("c0") for _, t in left) == 1
    assert sum(t == leak for _, t in left) == 1


def test_empty_documents(spark, folder):
    home, _, _ = folder
    empty = spark.read.parquet(f"{home}/documents.parquet").filter(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, empty, home).collect() == []
