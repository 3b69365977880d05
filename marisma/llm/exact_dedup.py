"""Exact duplicates as a stateful stream: keyed state on disk, without expiry, and a check of full bytes.

1. `index_content`: one row per document: digest of the normalised text, code points of the
   original, the stable identifier, and where the content lies (file and row).
2. `stream_groups`: a stream over that index.  Its state, in RocksDB and keyed by digest, holds
   the identifier and locator of the row that stays and the number of rows seen.  Nothing expires:
   a copy that arrives a year later meets the same key.  Each micro-batch rewrites its own folder
   of changed keys, so a replayed batch changes nothing.  Rows of one digest are combined in the
   map tasks first; a hot digest costs one row per task.
3. `confirm`: for groups of more than one row, each row's normalised text is compared with that of
   the row that stays, read back by its locator.  Rows that only share the digest form groups by
   their own bytes.

Defined cases: null text counts as empty; of equal rows the smallest doc_id stays and a null doc_id
comes last; repeated rows are members of one group each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.session import cut_lineage, work_dir

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",  # of all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: take no disk ahead
}


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def whole(sha: Column) -> Column:
    return sha


def located(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, file, place and more: where each row's content can be read again.  Rows that are no table yet are written."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more]
    try:
        return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return located(cut_lineage(docs.select(*columns), "landing"), more)


def index_content(rows: DataFrame, normalise: Callable[[Column], Column]) -> DataFrame:
    return rows.select(
        "doc_id", "file", "place", F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        F.unhex(F.sha2(normalise(F.col("text")).cast("binary"), 256)).alias("sha"),
    )


def best(name: str = "keep") -> Column:
    """The row that stays: most code points, then the smallest doc_id (null last), then the first place."""
    # the complement falls as doc_id rises, for the smallest long too
    return F.max(F.struct("points", F.bitwise_not("doc_id").alias("order"), F.col("file"), F.col("place"), F.col("doc_id"))).alias(name)


GROUP = "digest binary, keep struct<points: int, order: bigint, file: string, place: bigint, doc_id: bigint>, group_size bigint"


def stream_groups(spark, index_path: str, schema, key: Callable[[Column], Column] = whole, max_bytes: int = 1 << 25, home: str | None = None) -> DataFrame:
    """digest, keep, group_size, from a stream over the files below index_path.

    max_bytes bounds a micro-batch.  With the home of an earlier run only files that came since are
    read; its groups stay.
    """
    home = home or work_dir(spark, "dedup-stream")
    log = f"{home}/changes"
    state = (
        spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(index_path)
        .groupBy(key(F.col("sha")).alias("digest")).agg(best(), F.count("*").alias("group_size"))
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    spark.createDataFrame([], GROUP).write.mode("overwrite").parquet(f"{log}/batch=-1")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(f"{GROUP}, batch int").parquet(log)
    return changes.groupBy("digest").agg(F.max_by("keep", "group_size").alias("keep"), F.max("group_size").alias("group_size"))


def confirm(rows: DataFrame, index: DataFrame, groups: DataFrame, normalise: Callable[[Column], Column]) -> DataFrame:
    """Rows whose bytes differ from those of the row that stays: file, place, and their own group."""
    hits = index.join(groups.filter("group_size > 1").select("digest", F.col("keep.file").alias("keep_file"), F.col("keep.place").alias("keep_place")), "digest")
    texts = (
        hits.select("doc_id", "points", "digest", "file", "place", "keep_file", "keep_place")
        .join(rows.select("file", "place", "text"), ["file", "place"])
        .withColumn("plain", normalise(F.col("text"))).drop("text")
    )
    texts = cut_lineage(texts, "hits")
    stays = texts.filter((F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place"))).select("digest", F.col("plain").alias("stays"))
    odd = cut_lineage(texts.join(stays, "digest").filter("plain != stays").drop("stays", "keep_file", "keep_place"), "odd")
    own = odd.groupBy("digest", "plain").agg(best("own"), F.count("*").alias("own_size"))
    return odd.join(own, ["digest", "plain"]).select("file", "place", "digest", "own", "own_size")


def exact_duplicates(
    docs: DataFrame,
    key: Callable[[Column], Column] = whole,
    normalise: Callable[[Column], Column] = without_space,
    max_bytes: int = 1 << 25,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    key: what of the SHA-256 of the normalised text is the key of the state, all of it by default.
    """
    return decide(located(docs), key, normalise, max_bytes).drop("file", "place")


def first_copies(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that stay, with these columns."""
    rows = located(docs, tuple(c for c in columns if c not in ("doc_id", "text")))
    stay = decide(rows).filter("kept").select("file", "place")
    return rows.join(stay, ["file", "place"], "left_semi").select(columns)


def decide(
    rows: DataFrame,
    key: Callable[[Column], Column] = whole,
    normalise: Callable[[Column], Column] = without_space,
    max_bytes: int = 1 << 25,
) -> DataFrame:
    """exact_duplicates of located rows, with file and place."""
    spark = rows.sparkSession
    path = work_dir(spark, "dedup-index")
    indexed = index_content(rows, normalise)
    indexed.write.parquet(path)
    index = spark.read.schema(indexed.schema).parquet(path).withColumn("digest", key(F.col("sha")))
    groups = cut_lineage(stream_groups(spark, path, indexed.schema, key, max_bytes), "groups")
    odd = cut_lineage(confirm(rows, index, groups, normalise), "odd")
    fewer = odd.groupBy("digest").agg(F.count("*").alias("fewer"))
    sized = groups.join(fewer, "digest", "left").select("digest", "keep", (F.col("group_size") - F.coalesce("fewer", F.lit(0))).alias("group_size"))
    stays = F.coalesce("own", "keep")
    return (
        index.join(sized, "digest").join(odd.drop("digest"), ["file", "place"], "left")
        .select(
            "doc_id", stays["doc_id"].alias("keep_id"), F.coalesce("own_size", "group_size").alias("group_size"),
            ((stays["file"] == F.col("file")) & (stays["place"] == F.col("place"))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"), "file", "place",
        )
    )
