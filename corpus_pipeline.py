"""From raw documents to a token table: toxicity, exact and near duplicates, contamination, tokens.

Every stage reads what its predecessor wrote.  All but the last return the columns of documents and ignore
others; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.llm import bpe, decontaminate, exact_dedup, near_dedup, row_keys, toxicity
from marisma.llm import queries as _single
from marisma.session import work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chain learns from labels of documents that are here; what it finds toxic goes.

    Each row is judged by its own text: null and empty texts are not toxic and stay, rows that share a
    doc_id or a text are judged alike or apart as their texts are; a text of any length is read whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxic_documents(docs.select(COLUMNS), labels).filter(~F.col("toxic")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one row stays: most code points, then the smallest doc_id, null last.

    Null counts as empty, so one of all empty texts stays; of rows that are equal throughout, one.
    """
    return exact_dedup.first_copies(docs, COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (five-word shingles, 80 %).

    Rows are told apart by a number of their own, so a row with a null or repeated doc_id is judged by its
    text; among those, which come after the others, the first in the table stays.  Texts without words
    are linked with nothing and stay.
    """
    rows = row_keys.numbered(docs, COLUMNS)
    gone = near_dedup.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text")).filter("NOT kept").select(F.col("doc_id").alias("row_key"))
    return rows.join(gone, "row_key", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go; as above, a row is judged by its own text.

    Texts without words and items without words hold and are nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = row_keys.numbered(docs, COLUMNS)
    found = decontaminate.find_windows(rows.select(F.col("row_key").alias("doc_id"), "text"), items).filter("contaminated").select(F.col("doc_id").alias("row_key"))
    return rows.join(found, "row_key", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of what they decode to; one row per row, a null text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: the chain's weights and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs


QUERIES = {**_single.QUERIES, "pipeline": run}
ORACLE = dict(_single.ORACLE)
