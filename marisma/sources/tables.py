"""Tables: relational and file stores, history, vectors, catalog, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.operators import upserts

VECTOR_BATCH = 2000


def read_table(spark: SparkSession, name: str, root: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A table from a parquet folder, or from a database with the given connection options.

    Give partitionColumn, lowerBound, upperBound and numPartitions in jdbc to read in parallel.
    """
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc, dbtable=name).load()
    return spark.read.parquet(f"{root}/{name}")


def write_table(df: DataFrame, name: str, root: str | None = None, jdbc: dict | None = None,
                mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    if jdbc:
        df.write.format("jdbc").options(**jdbc, dbtable=name).mode(mode).save()
        return
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{name}")


def write_csv_report(df: DataFrame, out: str) -> None:
    df.write.option("header", True).csv(out)


def append_history(df: DataFrame, root: str) -> None:
    df.write.mode("append").parquet(root)


def write_vectors(df: DataFrame, out: str, by: str = "document_id") -> None:
    """Vectors of a document side by side, files of even size."""
    df.repartition(by).sortWithinPartitions(by, "chunk_index").write.parquet(out)


def push_vectors(df: DataFrame, connect: Callable[[], Callable[[list[dict]], None]], batch: int = VECTOR_BATCH) -> None:
    """Send rows to an external store from the tasks, in batches; connect runs once per task.

    A retried task sends its rows again, so the store must take the id as a key.
    """

    def send(rows: Iterator) -> None:
        put, buffer = connect(), []
        for row in rows:
            buffer.append(row.asDict())
            if len(buffer) >= batch:
                put(buffer)
                buffer = []
        if buffer:
            put(buffer)

    df.foreachPartition(send)


def catalog_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select("namespace", "tableName", "isTemporary")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE {name}").select("col_name", "data_type")


def snapshot_and_clear(tables: dict[str, DataFrame], copy_root: str, live_root: str, version: int) -> DataFrame:
    """Copy every table, write an empty snapshot as its new state, report the counts."""
    reports = []
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(f"{copy_root}/{name}_copia")
        upserts.write_snapshot(df.limit(0), f"{live_root}/{name}", version)
        copy = spark.read.schema(df.schema).parquet(f"{copy_root}/{name}_copia")
        live = spark.read.schema(df.schema).parquet(f"{live_root}/{name}/snapshot={version}")
        counts = [
            (label, part.agg(F.count("*").alias("n")).select(F.lit(name).alias("tabla"), F.lit(label).alias("estado"), "n"))
            for label, part in (("antes", df), ("copia", copy), ("despues", live))
        ]
        reports += [c for _, c in counts]
    return reduce(DataFrame.unionByName, reports)


def table_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))
