"""What stands above each row of a key, in some order, without putting a key into one task.

Rows are dealt by ranges of key and order into slices.  At most one key reaches into a slice from the
slices before it, so what has to be carried is one row per slice, whatever the number of keys and rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.session import cut_lineage


def above(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """df and, per name in sums, the aggregate of a column over the rows of the same key that come before; 0 for the first.

    keys hold no null; a sum is F.sum or F.bit_xor.  Rows that tie in order stand in any sequence.
    """
    parts = {f"_of_{n}": c for n, (c, _) in sums.items()}
    rows = cut_lineage(
        df.withColumns(parts).repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_slice").agg(*[f(F.col(f"_of_{n}")).alias(f"_sum_{n}") for n, (_, f) in sums.items()])
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_slice").alias("_at"), *[f(F.col(f"_sum_{n}")).over(earlier).alias(f"_from_{n}") for n, (_, f) in sums.items()], F.count("*").over(earlier).alias("_earlier"))
        .filter("_earlier > 0").drop("_earlier")
    )
    same = F.col("_slice") == F.col("_at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    zero = F.lit(0)
    out = rows.withColumns({f"_in_{n}": f(F.col(f"_of_{n}")).over(inside) for n, (_, f) in sums.items()})
    # a row per slice at most: the bound of the broadcast is the number of partitions
    out = out.join(F.broadcast(carry), same, "left")
    for n, (_, f) in sums.items():
        here, before = F.coalesce(f"_in_{n}", zero), F.coalesce(f"_from_{n}", zero)
        out = out.withColumn(n, here.bitwiseXOR(before) if f is F.bit_xor else here + before)
    return out.select(*[c for c in df.columns if c not in sums], *sums)
