"""A number of its own for every row, for operators that tell rows apart by doc_id.

A doc_id that stands once is its row's number.  Rows whose doc_id is null or repeated get fresh numbers
beyond all others, in order of file and place; only their places are dealt and joined, not the texts of
the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm.exact_dedup import located
from marisma.llm.runs import above
from marisma.session import cut_lineage


def numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of docs (doc_id, text and others) and row_key, a long that no other row has."""
    rows = located(docs, tuple(c for c in columns if c not in ("doc_id", "text")))
    places = rows.select("doc_id", "file", "place")
    again = places.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again"))
    odd = cut_lineage(places.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi").select("file", "place"), "again")
    if odd.isEmpty():
        return rows.withColumn("row_key", F.col("doc_id")).select(*columns, "row_key")
    low, high = places.agg(F.min("doc_id"), F.max("doc_id")).first()
    extra = above(odd.withColumn("one", F.lit(1)), ["one"], [F.asc("file"), F.asc("place")], {"n": (F.lit(1).cast("long"), F.sum)})
    room = high is None or high + odd.count() < 2**63
    key = F.lit(0 if high is None else high + 1).cast("long") + F.col("n") if room else F.lit(low - 1).cast("long") - F.col("n")
    fresh = cut_lineage(extra.select("file", "place", key.alias("fresh")), "fresh")
    return rows.join(fresh, ["file", "place"], "left").withColumn("row_key", F.coalesce("fresh", "doc_id")).select(*columns, "row_key")
