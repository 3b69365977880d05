"""Duplicates: which copy to keep, what to move away, and how many there are.

The kept copy is a map-side combined aggregate, so a group that holds a third of
all rows costs one partial row per map task.  Losers come from a join of the
rows with the one-row-per-key winners; skew on the row side is split by AQE.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marisma.functions import text


def _newest_first(df: DataFrame, name: str) -> Column:
    """A number that is smaller for a later time; a missing time counts as the epoch."""
    kind = df.schema[name].dataType.typeName()
    number = F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(name)
    return -F.coalesce(number, F.lit(0))


def dedup_keep(df: DataFrame, key: Column, path: str, policy: str = "date", ts: str | None = None,
               mtime: str | None = None, blank_is_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, moved): newest copy per key by policy; among equals the smallest path stays.

    policy: 'date' = article time, then file time; 'mtime' = file time only.
    The choice is made on key, times and path alone.  Whole rows only meet the list
    of losers, which is broadcast when it is small.
    """
    times = ([_newest_first(df, ts)] if policy == "date" else []) + ([_newest_first(df, mtime)] if mtime else [])
    order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(times)], F.col(path).alias("path"))
    narrow = df.select(key.alias("_key"), order.alias("_order"))
    if blank_is_error:
        blank = F.coalesce(key, F.lit("")) == ""
        narrow, df = narrow.filter(F.coalesce(F.col("_key"), F.lit("")) != ""), df.filter(~blank)
    # a path may stand under several keys, and lose under one of them only
    best = narrow.groupBy("_key").agg(F.min("_order")["path"].alias("kept_path"), F.count("*").alias("_n"))
    best = best.filter("_n > 1").drop("_n")  # a key of its own has no losers
    losers = (
        narrow.join(best, "_key")
        .select("_key", F.col("_order.path").alias(path), "kept_path")
        .filter(F.col(path) != F.col("kept_path"))
    )
    keyed = df.withColumn("_key", key)
    return keyed.join(losers, ["_key", path], "left_anti").drop("_key"), keyed.join(losers.distinct(), ["_key", path]).select(*df.columns, "kept_path")


def latest_per_key(df: DataFrame, key: str, extracted: str, arrival: str) -> DataFrame:
    """A strictly newer extraction replaces the older; on a tie the one that came first stays."""
    order = W.partitionBy(key).orderBy(F.desc(extracted), F.asc(arrival))
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def last_write_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one written last; a struct max, combined on the map side."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (order, *rest)]).select(*df.columns)


def first_articles(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """First row per key in order of arrival."""
    order = W.partitionBy(*keys).orderBy(arrival)
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def match(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join on keys; a null is a value like others: it meets a null."""
    side = other.select(*[F.col(k).alias(f"_{k}_") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys])
    return df.join(side, same, how)


def seen_before(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known; a null key is known if a null is."""
    return match(df, known, [key], "left_semi")


def not_seen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The other rows: each row is in one of the two."""
    return match(df, known, [key], "left_anti")


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Target plus the source rows whose key it lacks; the first source row of a key wins.  Null keys are keys, so a second run adds nothing."""
    fresh = match(first_articles(source, keys, order), target, keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def existing_ids(target: DataFrame, source: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Ids the target already holds for incoming keys."""
    return source.select(*keys).distinct().join(target.select(*keys, id_col), keys)


# ---------------------------------------------------------------- census

def hash_counts(df: DataFrame, content: str) -> DataFrame:
    return df.groupBy(F.md5(F.coalesce(F.col(content), F.lit(""))).alias("hash")).agg(F.count("*").alias("n"))


def hash_census(df: DataFrame, content: str) -> DataFrame:
    """Rows, distinct hashes and surplus copies."""
    return hash_counts(df, content).agg(
        F.sum("n").alias("filas"),
        F.count("*").alias("hashes"),
        F.sum(F.col("n") - 1).alias("duplicados"),
    )


def top_duplicates(df: DataFrame, content: str, n: int) -> DataFrame:
    return hash_counts(df, content).filter("n > 1").orderBy(F.desc("n"), "hash").limit(n)


def collision_check(df: DataFrame, content: str) -> DataFrame:
    """Per repeated hash: number of rows and of different contents under it.

    Contents meet on the hash and a second digest, so no text is shuffled.
    """
    body = F.coalesce(F.col(content), F.lit(""))
    per_text = df.groupBy(F.md5(body).alias("hash"), F.sha2(body, 256).alias("digest")).agg(F.count("*").alias("n"))
    return (
        per_text.groupBy("hash")
        .agg(F.sum("n").alias("filas"), F.count("*").alias("contenidos"))
        .filter("filas > 1")
    )


def blank_ratio(df: DataFrame, content: str) -> DataFrame:
    blank = text.is_blank(F.col(content))
    return df.agg(
        F.count_if(blank).alias("vacios"),
        F.count_if(~blank).alias("no_vacios"),
        F.coalesce(F.try_divide(F.count_if(blank) * 100, F.count("*")), F.lit(0.0)).alias("pct_vacios"),
    )


def keyword_ratio(df: DataFrame, content: str, pattern: str) -> DataFrame:
    hit = text.contains_keyword(F.col(content), pattern)
    return df.agg(
        F.count_if(hit).alias("con_palabra"),
        F.count("*").alias("total"),
        F.coalesce(F.try_divide(F.count_if(hit) * 100, F.count("*")), F.lit(0.0)).alias("pct"),
    )
