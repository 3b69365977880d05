"""Token totals kept up to date by signed deltas.

Totals by source, language and tokenizer version are sums of small delta rows; a change of a few
documents adds a few rows and never counts the corpus again.  `commit_batch` takes one numbered
batch of changes: inserts, deletes and revised counts.  What a document counted before is the newest
row of its own log; the delta is minus that plus the new count, so a document that moves to another
source, is inserted twice, or is deleted without having been there, comes out right.

Batches are numbered 1, 2, ... and committed in that order; a gap is refused.  A batch writes its log and its
deltas below a name of its own attempt and is published by one marker, written last; readers see
published attempts only.  So a crash between the writes leaves nothing behind that counts, and a batch that
comes again, at any time, is already there and changes nothing.  Of the log a commit takes only what its
own documents have before it groups anything.  Rows are combined in the map tasks first; a hot source
is one row per task.

Defined cases: null source or language is a group of its own; a null tokenizer too; changes without a
doc_id or with an unknown kind are left out; a null count is 0; of several changes of one document in a
batch the last by seq (then by kind, count) holds; an empty batch commits nothing but its number; a batch
that was published is not read again, even with other rows; a text of any length is one count; columns of
other names are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
LOG = "doc_id long, tokenizer string, source string, lang string, tokens long, alive boolean, batch int, attempt string"
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long, batch int, attempt string"
MARKS = "attempt string, batch int"
KINDS = ("insert", "delete", "revise")


def open_totals(spark: SparkSession, home: str) -> None:
    """Empty tables below home, where there are none yet; batch 0 is reserved for them."""
    for name, schema in (("log", LOG), ("deltas", DELTAS), ("marks", MARKS)):
        spark.createDataFrame([], schema).drop("batch", "attempt" if name != "marks" else "").write.mode("ignore").parquet(
            f"{home}/{name}/batch=0" + ("" if name == "marks" else "/attempt=none")
        )


def published(spark: SparkSession, home: str, name: str, schema: str) -> DataFrame:
    """Rows of the log or the deltas whose attempt has a marker; a marker is one row per batch."""
    marks = spark.read.schema(MARKS).parquet(f"{home}/marks").select("attempt")
    return spark.read.schema(schema).parquet(f"{home}/{name}").join(marks, "attempt", "left_semi")


def standing(spark: SparkSession, home: str, among: DataFrame | None = None) -> DataFrame:
    """What each document counts now; among (doc_id, tokenizer): those documents only."""
    log = published(spark, home, "log", LOG)
    if among is not None:
        asked = among.select(F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t"))
        log = log.join(asked, (F.col("doc_id") == F.col("_d")) & F.col("tokenizer").eqNullSafe(F.col("_t")), "left_semi")
    return (
        log.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "tokens", "alive"), "batch").alias("last"))
        .select("doc_id", "tokenizer", "last.*").filter("alive").drop("alive")
    )


def commit_batch(spark: SparkSession, home: str, batch: int, changes: DataFrame) -> bool:
    """Whether the batch was new; changes: doc_id, tokenizer, kind, source, lang, tokens, seq; batch: 1, 2, ..."""
    if batch < 1:
        raise ValueError("batches are numbered from 1")
    open_totals(spark, home)
    newest = spark.read.schema(MARKS).parquet(f"{home}/marks").agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
    if batch <= newest:
        return False
    if batch > newest + 1:
        raise ValueError(f"batch {batch} before batch {newest + 1}")
    attempt = uuid.uuid4().hex
    last = (
        changes.filter(F.col("doc_id").isNotNull() & F.col("kind").isin(*KINDS))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer")
        .agg(F.max(F.struct("seq", "kind", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "source", "lang")).alias("c"))
        .select("doc_id", "tokenizer", "c.source", "c.lang", "c.tokens", (F.col("c.kind") != "delete").alias("alive"))
    )
    log = f"{home}/log/batch={batch}/attempt={attempt}"
    last.write.parquet(log)
    new = spark.read.schema(last.schema).parquet(log)
    old = standing(spark, home, new)
    signed = old.select(*GROUP, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens")).union(
        new.filter("alive").select(*GROUP, F.lit(1).cast("long"), "tokens")
    )
    (
        signed.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        .filter("documents != 0 OR tokens != 0").write.parquet(f"{home}/deltas/batch={batch}/attempt={attempt}")
    )
    # two writers of one batch: the second finds the marker's folder and fails
    spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.mode("error").parquet(f"{home}/marks/batch={batch}")
    return True


def totals(spark: SparkSession, home: str) -> DataFrame:
    """source, lang, tokenizer, documents, tokens; groups whose documents are all gone are left out."""
    return (
        published(spark, home, "deltas", DELTAS).groupBy(*GROUP)
        .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents != 0")
    )


#: counts in one pass over the text, by tokenizer version
TOKENIZERS = {
    "space-1": r"[^\x20\x09-\x0D]+",
    "alnum-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
}


def counted(docs: DataFrame, kind: str, text: Column | None = None) -> DataFrame:
    """Changes of one kind for docs (doc_id, source, lang, text): a row per tokenizer."""
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), F.regexp_count(text, F.lit(p)).cast("long").alias("tokens")) for k, p in TOKENIZERS.items()])
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("t")).select(
        "doc_id", "t.tokenizer", F.lit(kind).alias("kind"), "source", "lang", "t.tokens", F.lit(0).alias("seq")
    )
