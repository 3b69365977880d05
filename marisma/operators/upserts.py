"""Idempotent table maintenance on snapshot tables.

A table is a folder of snapshots; a job reads the newest one and writes the next,
so nothing that is being read is overwritten and a failed write leaves the old
state in place.  Running a job twice gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.operators.dedup import last_write_wins, match
from marisma.operators.facts import resolve_codes, with_fact_keys


# ---------------------------------------------------------------- snapshots

def write_snapshot(df: DataFrame, root: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/snapshot={version}")


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest snapshot: the partition column prunes the scan to its folder."""
    every = spark.read.schema(f"{schema}, snapshot INT").parquet(root)
    return every.filter(F.col("snapshot") == every.agg(F.max("snapshot")).scalar()).drop("snapshot")


# ---------------------------------------------------------------- upserts

def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str, merge_fields: bool = False,
           stamp: Column | None = None) -> DataFrame:
    """Target after the source was merged into it, with column accion (insertada, actualizada, igual).

    Source rows of one key are reduced to the last one first, so both sides of
    the join have one row per key.  merge_fields keeps old values where the new
    row has null; otherwise the new row replaces every field.
    """
    fresh = last_write_wins(source, keys, order)
    t, s = target.alias("t"), fresh.alias("s")
    # keys may hold nulls, so presence is told by a marker of its own
    t = t.withColumn("_t", F.lit(True)).alias("t")
    s = s.withColumn("_s", F.lit(True)).alias("s")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    both = t.join(s, cond, "full_outer")
    new, old = F.col("_s").isNotNull(), F.col("_t").isNotNull()
    stamps = {"created_at", "updated_at"}
    out = []
    for c in target.columns:
        if c in stamps:
            continue
        have = F.col(f"t.{c}")
        if c in source.columns:
            got = F.coalesce(F.col(f"s.{c}"), have) if merge_fields else F.col(f"s.{c}")
            out.append(F.when(new, got).otherwise(have).alias(c))
        else:
            out.append(have.alias(c))
    if stamps & set(target.columns):
        now = F.lit(None).cast("timestamp") if stamp is None else stamp
        out.append(F.when(old, F.col("t.created_at")).otherwise(now).alias("created_at"))
        out.append(F.when(new, now).otherwise(F.col("t.updated_at")).alias("updated_at"))
    action = F.when(new & old, F.lit("actualizada")).when(new, F.lit("insertada")).otherwise(F.lit("igual"))
    return both.select(*out, action.alias("accion"))


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("accion").agg(F.count("*").alias("n"))


def replace_partition(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every target row whose keys occur in the source, then add the source.  A null key is replaced by a null key."""
    kept = match(target, source.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def write_partitions(df: DataFrame, root: str, keys: list[str]) -> None:
    """The same on storage: only the partitions present in the frame are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


FACT_KEY = ["anio", "mes", "prov_key", "mercado_key", "tipo_key", "id_indicador", "ambito_geografico"]


def insert_facts(target: DataFrame, rows: DataFrame, dims: list[tuple[DataFrame, str, str, str]], order: str,
                 keys: list[str] | None = None) -> DataFrame:
    """Facts given by codes: resolve the codes, derive the keys, insert or update on the unique key.

    rows: anio, mes, codes per dimension, valor_absoluto, variacion_interanual, archivo_origen
    """
    resolved = with_fact_keys(resolve_codes(rows, dims)).withColumn("ambito_geografico", F.lit("provincia"))
    resolved = resolved.filter(F.col("id_indicador").isNotNull())
    source = resolved.select(*[c for c in target.columns if c in resolved.columns], order)
    return upsert(target, source, keys or FACT_KEY, order)


# ---------------------------------------------------------------- constraints

def check_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that evaluates to null is not broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.col(key).cast("string").alias("clave"), F.explode(broken).alias("regla"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_foreign_key(df: DataFrame, key: str, column: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows whose reference is set and unknown."""
    known = dim.select(F.col(dim_key).alias(column))
    return df.filter(F.col(column).isNotNull()).join(known, column, "left_anti").select(
        F.col(key).cast("string").alias("clave"), F.lit(f"fk_{column}").alias("regla")
    )


def fact_rules() -> dict[str, Column]:
    return {
        "ck_mes": F.col("mes").between(1, 12),
        "ck_anio": F.col("anio").between(2021, 2030),
        # by parts: there is no date to compare with when the month is none
        "ck_fecha": (F.year("fecha_periodo") == F.col("anio")) & (F.month("fecha_periodo") == F.col("mes")) & (F.dayofmonth("fecha_periodo") == 1),
    }


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tabla"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
