"""A keyed table in hash buckets, merged batch by batch at the cost of the buckets a batch touches.

    root/data/batch=<n>/bucket=<b>/   the rows of bucket b as batch n left them
    root/manifest/batch=<n>/          (bucket, since): the batch whose folder holds each bucket after n

A merge reads and rewrites only the buckets its keys fall into; the other entries of the manifest still
point to older folders.  The manifest is written last and counts once its commit marker is there, so a
batch that failed half-way is invisible and is written over when it is run again.  Batches are numbered
0, 1, 2, ...: a published one is not applied twice, a gap is refused.

What the driver holds is the manifest, a row per bucket.  Keys are unique in the table, so buckets are
even; choose `buckets` so that one is a few hundred MB.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marisma.operators.dedup import last_write_wins
from marisma.operators.upserts import upsert

BUCKET = "bucket"
#: what the batch that wrote a row did to it
ACTION = "accion"
_MANIFEST = "bucket INT, since BIGINT, buckets INT"


def bucket_of(schema: StructType, keys: list[str], buckets: int) -> Column:
    """Null is a key like others; the zeros of either sign are one key, as in comparisons."""
    plain = [F.col(k) + F.lit(0.0).cast(schema[k].dataType) if schema[k].dataType.typeName() in ("float", "double") else F.col(k) for k in keys]
    return F.pmod(F.xxhash64(*plain), F.lit(buckets)).cast("int")


def newest_batch(spark: SparkSession, root: str) -> int | None:
    """The last published batch; None where there is no table yet."""
    marks_at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/batch=*/_SUCCESS")
    marks = marks_at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks_at) or []
    return max((int(m.getPath().getParent().getName().removeprefix("batch=")) for m in marks), default=None)


def manifest(spark: SparkSession, root: str, batch: int) -> tuple[int, dict[int, int]]:
    """Number of buckets, and bucket -> batch whose folder holds it; buckets that never had a row are not in it."""
    rows = spark.read.schema(_MANIFEST).json(f"{root}/manifest/batch={batch}").collect()
    return rows[0].buckets, {r.bucket: r.since for r in rows if r.bucket is not None}


def _read(spark: SparkSession, root: str, schema: StructType, live: dict[int, int]) -> DataFrame:
    """Only the folders the manifest names are listed."""
    paths = [f"{root}/data/batch={since}/{BUCKET}={b}" for b, since in sorted(live.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(spark: SparkSession, root: str, batch: int, rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """Rows to their buckets' folders; the buckets written."""
    home = f"{root}/data/batch={batch}"
    placed = rows.withColumn(BUCKET, bucket_of(rows.schema, keys, buckets))
    # one writer per bucket, more for a large one: adaptive execution sizes the partitions
    placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(home)
    return [r[0] for r in placed.sparkSession.read.schema(f"{ACTION} STRING, {BUCKET} INT").parquet(home).select(BUCKET).distinct().collect()]


def _publish(spark: SparkSession, root: str, batch: int, live: dict[int, int], buckets: int) -> None:
    rows = [(b, since, buckets) for b, since in sorted(live.items())] or [(None, None, buckets)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifest/batch={batch}")


def _latest(schema: StructType, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in the table's columns and types; a key must hash as it does in the table."""
    clash = {BUCKET, ACTION} & set(schema.names)
    if clash or not set(keys) <= set(schema.names):
        raise ValueError(f"the table needs the keys {keys} and no columns {clash or ''}")
    have = [F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names if c in rows.columns]
    return last_write_wins(rows.select(*have, *([order] if order not in schema.names else [])), keys, order)


def create_table(spark: SparkSession, root: str, schema: StructType, rows: DataFrame, keys: list[str], order: str, buckets: int) -> None:
    """Batch 0: the last row of each key.  Nothing happens where the table is already there."""
    if newest_batch(spark, root) is not None:
        return
    first = _latest(schema, rows, keys, order).select(*schema.names, F.lit("insertada").alias(ACTION))
    done = _write(spark, root, 0, first, keys, buckets)
    _publish(spark, root, 0, dict.fromkeys(done, 0), buckets)


def merge_batch(spark: SparkSession, root: str, schema: StructType, source: DataFrame, keys: list[str], order: str, batch: int,
                merge_fields: bool = False, stamp: Column | None = None) -> bool:
    """Merge a batch as `upsert` does; False if it was published before.

    schema: the table's columns; others of the batch are ignored.  The batch is reduced and written once,
    then its buckets are read, merged and written; an empty batch publishes the manifest it found.
    """
    last = newest_batch(spark, root)
    if last is None or batch > last + 1:
        raise ValueError(f"batch {batch} does not follow {last} at {root}")
    if batch <= last:
        return False
    buckets, live = manifest(spark, root, last)
    staged = f"{root}/staged/batch={batch}"
    _latest(schema, source, keys, order).withColumn(BUCKET, bucket_of(schema, keys, buckets)).write.mode("overwrite").parquet(staged)
    fresh = spark.read.parquet(staged)
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
    if touched:
        target = _read(spark, root, schema, {b: live[b] for b in touched if b in live})
        merged = upsert(target, fresh.drop(BUCKET), keys, order, merge_fields, stamp)
        live |= dict.fromkeys(_write(spark, root, batch, merged, keys, buckets), batch)
    _publish(spark, root, batch, live, buckets)
    return True


def read_table(spark: SparkSession, root: str, schema: StructType, batch: int | None = None, only: set[int] | None = None) -> DataFrame:
    """The table after a published batch, the newest by default; of some buckets only, if asked."""
    at = newest_batch(spark, root) if batch is None else batch
    if at is None:
        return spark.createDataFrame([], schema)
    live = manifest(spark, root, at)[1]
    return _read(spark, root, schema, live if only is None else {b: since for b, since in live.items() if b in only})


def batch_actions(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """accion and n of what a published batch inserted and updated; rows it only carried along are left out."""
    _, live = manifest(spark, root, batch)
    mine = {b: since for b, since in live.items() if since == batch}
    rows = _read(spark, root, StructType().add(ACTION, "string"), mine)
    return rows.filter(F.col(ACTION) != "igual").groupBy(ACTION).agg(F.count("*").alias("n"))


def drop_unused(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete bucket folders that none of the last `keep` batches reads, with the manifests and staged rows before them."""
    last = newest_batch(spark, root)
    if last is None:
        return 0
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    kept = range(max(0, last - keep + 1), last + 1)
    used = {(since, b) for at in kept for b, since in manifest(spark, root, at)[1].items()}
    gone = 0
    for pattern in ("manifest/batch=*", "staged/batch=*", f"data/batch=*/{BUCKET}=*"):
        here = path(f"{root}/{pattern}")
        fs = here.getFileSystem(conf)
        for found in fs.globStatus(here) or []:
            number = {k: int(v) for k, v in (part.split("=") for part in found.getPath().toString().split("/")[-2:] if "=" in part)}
            if number["batch"] > last:
                continue  # a batch under way
            stale = (number["batch"], number[BUCKET]) not in used if BUCKET in number else number["batch"] < kept[0]
            gone += stale and fs.delete(found.getPath(), True)
    return gone
