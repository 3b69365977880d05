"""Structured Streaming jobs over a landing folder.

Results that change are kept as a log: every micro-batch writes its own folder
batch=<id>, so a repeated batch replaces itself, and readers take the newest
version of each key.  Compact the log with a batch job when it has grown.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from marisma.operators import bucket_table
from marisma.operators.bucket_table import BUCKET
from marisma.operators.dedup import first_articles, last_write_wins, match
from marisma.operators.series import iteration_state

BATCH = "batch"


# ---------------------------------------------------------------- source and sinks

def stream_articles(spark: SparkSession, folder: str, schema, fmt: str = "json", glob: str | None = None,
                    max_files: int = 1000) -> DataFrame:
    """New files of a folder; the checkpoint remembers which ones were read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(folder)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process what has landed, then stop: the scheduled form of a polling loop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return run_available(df.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)


def log_batches(df: DataFrame, root: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame] | None = None,
                mode: str = "append") -> StreamingQuery:
    """Write each micro-batch, after an optional step, to its own folder of the log."""

    def write(part: DataFrame, batch_id: int) -> None:
        rows = step(part, batch_id) if step else part
        rows.write.mode("overwrite").parquet(f"{root}/{BATCH}={batch_id}")

    return run_available(df.writeStream.foreachBatch(write).outputMode(mode), checkpoint)


def read_log(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {BATCH} BIGINT").parquet(root)


class LateRows(StreamingQueryListener):
    """Counts rows that came after the watermark had passed them, over a whole run.

    Add it with spark.streams.addListener before the query starts; recentProgress keeps only the
    newest reports.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


# ---------------------------------------------------------------- duplicates

def late_policy(df: DataFrame, ts: str, as_of: Column, days: int, keep_null: bool = True) -> DataFrame:
    """Age limit on arrival; as_of is a fixed time, so the filter has no state."""
    return df.filter(F.coalesce(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)), F.lit(keep_null)))


def dedup_within(df: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """One row per key as long as its watermark lasts: bounded state, keys are forgotten."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def dedup_exact(df: DataFrame, root: str, checkpoint: str, keys: list[str], order: str, buckets: int = 256) -> StreamingQuery:
    """One row per key for ever; null keys are keys.

    The log of kept rows lies in buckets by hash of the key.  A batch reads the key columns of the
    buckets that its own keys fall into, in the folders of earlier batches, so what it costs follows the
    batch and not the keys seen so far; a batch that comes again replaces its own folder.
    """
    spark = df.sparkSession
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def write(part: DataFrame, batch_id: int) -> None:
        fresh = first_articles(part, keys, order).withColumn("cubo", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if batch_id > 0:
            touched = [r[0] for r in fresh.select("cubo").distinct().collect()]  # at most `buckets` numbers
            known = read_log(spark, root, f"{key_ddl}, cubo INT").filter((F.col(BATCH) < batch_id) & F.col("cubo").isin(touched))
            fresh = match(fresh, known, ["cubo", *keys], "left_anti")
        fresh.repartition("cubo").write.mode("overwrite").partitionBy("cubo").parquet(f"{root}/{BATCH}={batch_id}")

    return run_available(df.writeStream.foreachBatch(write), checkpoint)


def first_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What dedup_exact has kept so far."""
    return read_log(spark, root, schema).drop(BATCH, "cubo")


# ---------------------------------------------------------------- upserts

def upsert_log(df: DataFrame, root: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keep the last row of each key of a batch; nothing written before is touched."""
    return log_batches(df, root, checkpoint, lambda part, _: last_write_wins(part, keys, order))


def current_rows(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """State of an upsert log: the last batch that has a key wins, inside it the last row."""
    newest = log.withColumn("_version", F.struct(F.col(BATCH), F.col(order)))
    return last_write_wins(newest, keys, "_version").drop("_version", BATCH)


# ---------------------------------------------------------------- windowed scores

def daily_coverage(df: DataFrame, ts: str, topic: str, label: Column, delay: str = "1 day") -> DataFrame:
    """Counts per day, topic and tone: the only state a stream of coverage needs."""
    rows = df.withWatermark(ts, delay).select(ts, F.col(topic).alias("tema"), label.alias("_tone"))
    return (
        rows.groupBy(F.window(ts, "1 day").alias("_w"), "tema")
        .agg(
            F.count_if(F.col("_tone") == "positive").alias("positive"),
            F.count_if(F.col("_tone") == "neutral").alias("neutral"),
            F.count_if(F.col("_tone") == "negative").alias("negative"),
            F.count("*").alias("total"),
        )
        .select(F.to_date("_w.start").alias("dia"), "tema", "positive", "neutral", "negative", "total")
    )


def daily_radar(df: DataFrame, ts: str, topic: str, party: str, axes: str, n_axes: int, delay: str = "1 day") -> DataFrame:
    """Sum and number of votes of every axis per day, topic and party; nulls are no votes."""
    rows = df.withWatermark(ts, delay).select(ts, F.col(topic).alias("tema"), F.col(party).alias("partido"), F.col(axes).alias("_axes"))
    vote = [F.get("_axes", F.lit(i)).cast("double") for i in range(n_axes)]
    return (
        rows.groupBy(F.window(ts, "1 day").alias("_w"), "tema", "partido")
        .agg(
            F.array(*[F.coalesce(F.sum(v), F.lit(0.0)) for v in vote]).alias("sumas"),
            F.array(*[F.count(v) for v in vote]).alias("votos"), F.count("*").alias("articulos"),
        )
        .select(F.to_date("_w.start").alias("dia"), "tema", "partido", "sumas", "votos", "articulos")
    )


def daily_affinity(df: DataFrame, ts: str, outlet: str, affinity: str, delay: str = "1 day") -> DataFrame:
    """Sum and number of affinities, and number of articles, per day and outlet."""
    rows = df.withWatermark(ts, delay).select(ts, F.col(outlet).alias("medio"), F.col(affinity).alias("_a"))
    return (
        rows.groupBy(F.window(ts, "1 day").alias("_w"), "medio")
        .agg(F.coalesce(F.sum("_a").cast("double"), F.lit(0.0)).alias("suma"), F.count("_a").alias("votos"), F.count("*").alias("articulos"))
        .select(F.to_date("_w.start").alias("dia"), "medio", "suma", "votos", "articulos")
    )


def rolling_sums(daily: DataFrame, keys: list[str], sums: list[str], present: str, windows: list[int]) -> DataFrame:
    """ventana, fin, keys and sums: look-back windows that end on each day up to the newest.

    A day joins a window of n days when it comes and leaves it n days later, so it is written twice per
    window, not n times; a running sum over those changes is the window, which holds until the next
    change.  The input is mergeable partial sums, a row per day and key; a window is left out where
    `present`, one of the sums, is 0.  Null keys are keys.
    """
    last = daily.agg(F.max("dia")).scalar()
    change = lambda size, day, sign: F.struct(
        F.lit(size).alias("n"), day.alias("desde"), *[(F.col(c) * sign).alias(c) for c in sums]
    )
    both = F.array(*[x for n in windows for x in (change(n, F.col("dia"), 1), change(n, F.date_add("dia", n), -1))])
    # a key has a row per day at most, so what is ordered here is bounded by the calendar
    rows = daily.select(*keys, F.explode(both).alias("_c")).select(*keys, "_c.*")
    rows = rows.groupBy(*keys, "n", "desde").agg(*[F.sum(c).alias(c) for c in sums])
    inside = W.partitionBy(*keys, "n").orderBy("desde")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({**{c: F.sum(c).over(upto) for c in sums}, "_next": F.lead("desde").over(inside)})
    until = F.least(F.coalesce(F.date_sub("_next", 1), last), last)
    rows = rows.filter(F.col(present) > 0).withColumn("_until", until).filter(F.col("desde") <= F.col("_until"))
    return rows.select(F.concat(F.col("n").cast("string"), F.lit("d")).alias("ventana"), F.explode(F.sequence("desde", "_until")).alias("fin"), *keys, *sums)


def rolling_coverage(daily: DataFrame, windows: list[int]) -> DataFrame:
    """Articles per topic and tone in the windows that end on each day."""
    return rolling_sums(daily, ["tema"], ["positive", "neutral", "negative", "total"], "total", windows)


def rolling_radar(daily: DataFrame, windows: list[int]) -> DataFrame:
    """Mean of every axis per topic and party in the windows that end on each day; null without votes."""
    axes = daily.select("dia", "tema", "partido", "articulos", F.posexplode(F.arrays_zip("sumas", "votos")).alias("eje", "_v"))
    axes = axes.select("dia", "tema", "partido", "eje", "articulos", F.col("_v.sumas").alias("suma"), F.col("_v.votos").alias("votos"))
    out = rolling_sums(axes, ["tema", "partido", "eje"], ["suma", "votos", "articulos"], "articulos", windows)
    return out.select("ventana", "fin", "tema", "partido", "eje", F.when(F.col("votos") > 0, F.col("suma") / F.col("votos")).alias("media"))


def rolling_affinity(daily: DataFrame, windows: list[int]) -> DataFrame:
    """Mean affinity per outlet, its articles and their share, in the windows that end on each day."""
    out = rolling_sums(daily, ["medio"], ["suma", "votos", "articulos"], "articulos", windows)
    totals = out.groupBy("ventana", "fin").agg(F.sum("articulos").alias("_total"))
    mean = F.when(F.col("votos") > 0, F.col("suma") / F.col("votos"))
    return out.join(totals, ["ventana", "fin"]).select(
        "ventana", "fin", "medio", mean.alias("afinidad"), "articulos", (F.col("articulos") * 100 / F.col("_total")).alias("cuota_articulos")
    )


# ---------------------------------------------------------------- state per query

def stream_plateau(df: DataFrame, key: str, ts: str, tie: str, buckets: int = 1024) -> DataFrame:
    """Iteration number, iterations since the last improvement and sources so far, carried per query.

    Input has mejora (boolean) and nuevas (number of new sources), null counts as none.  Rows of a key
    are put in order within a micro-batch; batches are expected in time order.  Keys are kept in buckets by
    hash, null keys in one of their own: a call of the state function costs the same for one key as for
    hundreds.  The batch size bounds what one bucket brings to a task; plateau_log has no such bound.
    """
    key_type = df.schema[key].dataType.simpleString()
    tie_type = df.schema[tie].dataType.simpleString()

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*(state.get[:1]), zip(*state.get[1:]))) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values([key, ts, tie], kind="stable")
        codes, names = pd.factorize(rows[key], use_na_sentinel=False)
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        names = [None] if group[0] < 0 else names.tolist()
        seen, last_gain, sources = np.array([held.get(k, (0, 0, 0)) for k in names], dtype=np.int64).T
        number = seen[of] + np.arange(len(rows)) - first[of] + 1
        # a running maximum that starts anew with each key: keys are lifted above one another
        lift = of * (number.max() + 1)
        gains = np.maximum.accumulate(np.where(rows["mejora"].to_numpy().astype(bool), number, last_gain[of]) + lift) - lift
        nuevas = np.nan_to_num(rows["nuevas"].to_numpy().astype(np.float64)).astype(np.int64)
        total = np.cumsum(nuevas)
        total += (sources - total[first] + nuevas[first])[of]
        yield pd.DataFrame({key: rows[key].to_numpy(), tie: rows[tie].to_numpy(), "iteracion": number, "estancamiento": number - gains, "fuentes": total})
        last = np.append(first[1:], len(rows)) - 1
        held.update(zip(names, zip(number[last].tolist(), gains[last].tolist(), total[last].tolist())))
        state.update((list(held), *map(list, zip(*held.values()))))

    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    return df.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        step,
        f"{key} {key_type}, {tie} {tie_type}, iteracion BIGINT, estancamiento BIGINT, fuentes BIGINT",
        f"claves ARRAY<{key_type}>, vistas ARRAY<BIGINT>, ultimas ARRAY<BIGINT>, fuentes ARRAY<BIGINT>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def plateau_log(df: DataFrame, root: str, checkpoint: str, key: str, ts: str, tie: str) -> StreamingQuery:
    """stream_plateau for keys of any size: rows/batch=<id> below root.

    Inside a batch the numbers come from slices of a key, so no task sees a whole
    key; what earlier batches add to them is one row per key in state/batch=<id>.
    """
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, tie)}
    row_ddl = f"{key} {kinds[key]}, {tie} {kinds[tie]}, iteracion BIGINT, estancamiento BIGINT, fuentes BIGINT"
    state_ddl = f"{key} {kinds[key]}, n0 BIGINT, e0 BIGINT, f0 BIGINT"

    def write(part: DataFrame, batch_id: int) -> None:
        inside = iteration_state(
            part.withColumn("_s", F.lit(0.0)), key, ts, tie, "_s", F.col("mejora"), F.col("nuevas")
        )
        before = spark.createDataFrame([], state_ddl)
        if batch_id > 0:
            # the newest state below this batch; a batch after the first one must find some
            states = read_log(spark, f"{root}/state", state_ddl).filter(F.col(BATCH) < batch_id)
            newest = states.agg(F.max(BATCH)).first()[0]
            if newest is None:
                raise FileNotFoundError(f"no state before batch {batch_id} below {root}/state")
            before = states.filter(F.col(BATCH) == newest).drop(BATCH)
        n0, e0, f0 = (F.coalesce(c, F.lit(0)) for c in ("n0", "e0", "f0"))
        no_gain = F.col("estancamiento") == F.col("iteracion")
        before = before.withColumnRenamed(key, "_key")
        rows = inside.join(before, F.col(key).eqNullSafe(F.col("_key")), "left").select(
            key, tie, (F.col("iteracion") + n0).cast("bigint").alias("iteracion"),
            F.when(no_gain, F.col("estancamiento") + e0).otherwise(F.col("estancamiento")).cast("bigint").alias("estancamiento"),
            (F.col("fuentes") + f0).cast("bigint").alias("fuentes"),
        )
        here = f"{root}/rows/{BATCH}={batch_id}"
        rows.write.mode("overwrite").parquet(here)
        last = spark.read.schema(row_ddl).parquet(here).groupBy(key).agg(
            F.max(F.struct("iteracion", "estancamiento", "fuentes")).alias("_l")
        )
        state = last.join(before, F.col(key).eqNullSafe(F.col("_key")), "full_outer").select(
            F.coalesce(key, "_key").alias(key), F.coalesce("_l.iteracion", "n0").alias("n0"), F.coalesce("_l.estancamiento", "e0").alias("e0"),
            F.coalesce("_l.fuentes", "f0").alias("f0"),
        )
        state.write.mode("overwrite").parquet(f"{root}/state/{BATCH}={batch_id}")

    return run_available(df.writeStream.foreachBatch(write), checkpoint)


def plateau_late(df: DataFrame, root: str, checkpoint: str, key: str, ts: str, tie: str, buckets: int = 64) -> StreamingQuery:
    """plateau_log for rows that may come late: `plateau_rows` numbers them as if all had come in order.

    A row later than all its key has is numbered from the key's state, a table in buckets of which a batch
    reads and writes those it touches.  Where a row comes before one that is there, the key's rows from its
    place on are numbered again and written with the batch.  Inside a batch the numbers come from slices of
    a key.  tie tells the rows of a key apart; null keys are a key, null times come last, mejora and nuevas
    may be null.  A batch that is run again replaces what it wrote.
    """
    spark = df.sparkSession
    given = [key, ts, tie, "mejora", "nuevas"]
    results = ["iteracion", "estancamiento", "fuentes"]
    row_schema = StructType([df.schema[c] for c in given])
    for c in results:
        row_schema = row_schema.add(c, "long")
    state_schema = StructType([df.schema[c] for c in (key, ts, tie)]).add("n0", "long").add("e0", "long").add("f0", "long")
    place = F.struct(F.isnull(ts).alias("t0"), F.col(ts).alias("t"), F.isnull(tie).alias("d0"), F.col(tie).alias("d"))  # null last
    home = f"{root}/state"
    bucket = bucket_table.bucket_of(row_schema, [key], buckets)
    bucket_table.create_table(spark, home, state_schema, spark.createDataFrame([], state_schema).withColumn("_order", F.lit(0)), [key], "_order", buckets)

    def with_start(rows: DataFrame, starts: DataFrame) -> DataFrame:
        return rows.join(starts.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")

    def touched(starts: DataFrame) -> list[int]:
        return [r[0] for r in starts.select(bucket.alias("b")).distinct().collect()]

    def write(part: DataFrame, batch_id: int) -> None:
        fresh = part.select(*given)
        starts = fresh.groupBy(key).agg(F.min(place).alias("_from"))
        # the state after the batch before: publication n + 1 is batch n's
        state = bucket_table.read_table(spark, home, state_schema, batch_id, set(touched(starts)))
        state = with_start(state, starts)
        late = state.filter(F.col("_from") < place).select(key, "_from")
        before = state.filter(F.col("_from") >= place).select(key, "n0", "e0", "f0")
        again = touched(late)
        if again:
            log = spark.read.schema(StructType([*row_schema.fields]).add(BUCKET, "integer").add(BATCH, "long")).parquet(f"{root}/rows")
            log = log.filter(F.col(BUCKET).isin(again) & (F.col(BATCH) < batch_id))
            old = with_start(newest_rows(log, key, tie), late)
            kept = old.filter(place < F.col("_from")).groupBy(key).agg(F.max(F.struct(*results)).alias("_l"))
            before = before.unionByName(kept.select(key, F.col("_l.iteracion").alias("n0"), F.col("_l.estancamiento").alias("e0"), F.col("_l.fuentes").alias("f0")))
            fresh = fresh.unionByName(old.filter(place >= F.col("_from")).select(*given))
        inside = iteration_state(fresh.withColumn("_s", F.lit(0.0)), key, ts, tie, "_s", F.col("mejora"), F.col("nuevas"))
        n0, e0, f0 = (F.coalesce(c, F.lit(0)) for c in ("n0", "e0", "f0"))
        no_gain = F.col("estancamiento") == F.col("iteracion")
        rows = inside.join(before.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").select(
            *given, (F.col("iteracion") + n0).cast("bigint").alias("iteracion"),
            (F.col("estancamiento") + F.when(no_gain, e0).otherwise(0)).cast("bigint").alias("estancamiento"),
            (F.col("fuentes") + f0).cast("bigint").alias("fuentes"), bucket.alias(BUCKET),
        )
        here = f"{root}/rows/{BATCH}={batch_id}"
        rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(here)
        last = spark.read.schema(row_schema).parquet(here).select(
            key, ts, tie, F.col("iteracion").alias("n0"), F.col("estancamiento").alias("e0"), F.col("fuentes").alias("f0"))
        bucket_table.merge_batch(spark, home, state_schema, last, [key], "n0", batch_id + 1)
        bucket_table.drop_unused(spark, home, keep=2)

    return run_available(df.writeStream.foreachBatch(write), checkpoint)


def newest_rows(log: DataFrame, key: str, tie: str) -> DataFrame:
    """Of the rows of one key and tie the one the newest batch wrote, without the columns of the layout."""
    rest = [c for c in log.columns if c not in (key, tie, BATCH, BUCKET)]
    best = log.groupBy(key, tie).agg(F.max_by(F.struct(*rest), BATCH).alias("_r"))
    return best.select(key, tie, *[F.col(f"_r.{c}").alias(c) for c in rest])


def plateau_rows(spark: SparkSession, root: str, key: str, tie: str) -> DataFrame:
    """What plateau_late has numbered so far."""
    return newest_rows(spark.read.parquet(f"{root}/rows"), key, tie)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
