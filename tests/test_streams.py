"""Streams over split files give what the batch jobs give."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from marisma.functions.numbers import coverage_label
from marisma.operators import bucket_table, series
from marisma.session import work_dir
from marisma.streaming import jobs


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture(scope="module")
def folder(spark, events):
    """Five files in time order, one per trigger."""
    root = work_dir(spark, "landing")
    edges = [dt.datetime(2024, 1, d) for d in (1, 7, 13, 19, 25)] + [dt.datetime(2025, 1, 1)]
    for a, b in zip(edges, edges[1:]):
        events.filter((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(root)
    return root


def landing(spark, events, folder):
    return jobs.stream_articles(spark, folder, events.schema, "parquet", max_files=1)


def test_exact_dedup_over_batches_and_reruns(spark, events, folder):
    root = work_dir(spark, "exact")
    for _ in range(2):  # the second run finds no new files
        rows = landing(spark, events, folder).select("user_id", "event_type", "event_id")
        jobs.dedup_exact(rows, f"{root}/log", f"{root}/cp", ["user_id", "event_type"], "event_id")
    got = jobs.read_log(spark, f"{root}/log", "user_id BIGINT, event_type STRING, event_id BIGINT")
    assert got.select(jobs.BATCH).distinct().count() > 1
    assert got.count() == events.select("user_id", "event_type").distinct().count()


def test_dedup_within_watermark(spark, events, folder):
    root = work_dir(spark, "within")
    rows = jobs.dedup_within(landing(spark, events, folder), "ts", ["user_id"], "90 days").select("user_id")
    jobs.append_to(rows, f"{root}/out", f"{root}/cp")
    assert spark.read.parquet(f"{root}/out").count() == events.select("user_id").distinct().count()


def test_upsert_log_equals_batch(spark, events, folder):
    root = work_dir(spark, "upsert")
    rows = landing(spark, events, folder).select("user_id", "event_id", "value")
    jobs.upsert_log(rows, f"{root}/log", f"{root}/cp", ["user_id"], "event_id")
    log = jobs.read_log(spark, f"{root}/log", "user_id BIGINT, event_id BIGINT, value DOUBLE")
    got = {(r.user_id, r.event_id, r.value) for r in jobs.current_rows(log, ["user_id"], "event_id").collect()}
    want = events.groupBy("user_id").agg(F.max("event_id"), F.max_by("value", "event_id")).collect()
    assert got == {tuple(r) for r in want}


def test_rolling_coverage_equals_batch(spark, events, folder):
    root = work_dir(spark, "coverage")
    label = coverage_label(F.col("value") / 50 - 1)
    daily = jobs.daily_coverage(landing(spark, events, folder), "ts", "event_type", label)
    jobs.log_batches(daily, f"{root}/log", f"{root}/cp", mode="update")
    log = jobs.read_log(spark, f"{root}/log", "dia DATE, tema STRING, positive BIGINT, neutral BIGINT, negative BIGINT, total BIGINT")
    out = jobs.rolling_coverage(jobs.current_rows(log, ["dia", "tema"], "total"), [7, 30])
    last = out.agg(F.max("fin")).first()[0]
    got = {tuple(r) for r in out.filter(F.col("fin") == last).drop("fin").collect()}
    end = F.lit(last).cast("timestamp") + F.expr("interval 1 day")
    midnight = events.withColumn("ts", F.col("ts") + F.expr("interval 1 microsecond"))
    want = {tuple(r) for r in series.coverage(midnight, "ts", "event_type", label, end, [7, 30]).collect()}
    assert got == want


def test_rolling_radar_and_affinity_equal_batch(spark, events, folder):
    """Null topics and votes; the last window ends with the last day."""
    root = work_dir(spark, "radar")
    topic = F.nullif("event_type", F.lit("view"))
    axes = F.array(F.when(F.col("user_id") % 3 != 0, F.col("value")), F.when(F.col("event_id") < 0, F.lit(1.0)), F.col("user_id") % 5)
    shape = lambda df: df.select("ts", topic.alias("t"), (F.col("user_id") % 2).alias("p"), axes.alias("a"), F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("v"))
    stream = landing(spark, events, folder)
    jobs.log_batches(jobs.daily_radar(shape(stream), "ts", "t", "p", "a", 3), f"{root}/r", f"{root}/cr", mode="update")
    jobs.log_batches(jobs.daily_affinity(shape(stream), "ts", "p", "v"), f"{root}/a", f"{root}/ca", mode="update")
    daily = jobs.current_rows(jobs.read_log(spark, f"{root}/r", "dia DATE, t STRING, p BIGINT, tema STRING, partido BIGINT, sumas ARRAY<DOUBLE>, votos ARRAY<BIGINT>, articulos BIGINT").drop("t", "p"), ["dia", "tema", "partido"], "articulos")
    radar = jobs.rolling_radar(daily, [7, 30])
    outlets = jobs.current_rows(jobs.read_log(spark, f"{root}/a", "dia DATE, medio BIGINT, suma DOUBLE, votos BIGINT, articulos BIGINT"), ["dia", "medio"], "articulos")
    share = jobs.rolling_affinity(outlets, [7, 30])
    last = radar.agg(F.max("fin")).first()[0]
    end = F.lit(last).cast("timestamp") + F.expr("interval 1 day")
    midnight = shape(events).withColumn("ts", F.col("ts") + F.expr("interval 1 microsecond"))
    want = series.radar_mean(midnight, "ts", "t", "p", "a", 3, end, [7, 30]).select("ventana", "tema", "partido", F.posexplode("ejes").alias("eje", "media"))
    fix = lambda rows: {tuple(r)[:-1]: None if r[-1] is None else round(r[-1], 6) for r in rows.collect()}
    got = fix(radar.filter(F.col("fin") == last).select("ventana", "tema", "partido", "eje", "media"))
    assert got == fix(want) and None in {k[1] for k in got} and None in got.values()
    want = series.outlet_affinity(midnight, "ts", "p", "v", end, [7, 30])
    pick = ["ventana", "medio", "articulos", F.round("cuota_articulos", 6), F.round("afinidad", 6)]
    assert {tuple(r) for r in share.filter(F.col("fin") == last).select(*pick).collect()} == {tuple(r) for r in want.select(*pick).collect()}
    # a day enters a window once and leaves it once
    assert radar.groupBy("ventana", "fin", "tema", "partido", "eje").count().filter("count > 1").isEmpty()


def test_late_rows_are_dropped_and_counted(spark, events):
    root = work_dir(spark, "late")
    schema = "ts TIMESTAMP, event_type STRING, value DOUBLE"
    first = spark.createDataFrame([(dt.datetime(2024, 1, 20), "a", 1.0)], schema)
    late = spark.createDataFrame([(dt.datetime(2024, 1, 1), "a", 1.0), (dt.datetime(2024, 1, 21), "a", 1.0)], schema)
    counter = jobs.LateRows()
    spark.streams.addListener(counter)
    for part in (first, late):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        rows = jobs.stream_articles(spark, f"{root}/in", first.schema, "parquet")
        daily = jobs.daily_coverage(rows, "ts", "event_type", coverage_label(F.col("value")), "2 days")
        query = jobs.log_batches(daily, f"{root}/log", f"{root}/cp", mode="update")
    spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(counter)
    assert counter.dropped[str(query.id)] == 1
    days = {r.dia.day for r in jobs.read_log(spark, f"{root}/log", "dia DATE").collect()}
    assert days == {20, 21}


def test_plateau_state_equals_batch(spark, events, folder):
    root = work_dir(spark, "plateau")
    gain, new = F.col("event_type") == "purchase", (F.col("event_type") == "click").cast("int")
    rows = landing(spark, events, folder).select("user_id", "event_id", "ts", gain.alias("mejora"), new.alias("nuevas"))
    jobs.append_to(jobs.stream_plateau(rows, "user_id", "ts", "event_id"), f"{root}/out", f"{root}/cp")
    cols = ["event_id", "iteracion", "estancamiento", "fuentes"]
    got = {tuple(r) for r in spark.read.parquet(f"{root}/out").select(*cols).collect()}
    batch = series.iteration_state(events, "user_id", "ts", "event_id", "value", gain, new)
    want = {tuple(r) for r in batch.select(*cols).collect()}
    assert got == want
    log = work_dir(spark, "plateau_log")
    jobs.plateau_log(rows, log, f"{log}/cp", "user_id", "ts", "event_id")
    out = jobs.read_log(spark, f"{log}/rows", "event_id BIGINT, iteracion BIGINT, estancamiento BIGINT, fuentes BIGINT")
    assert out.select(jobs.BATCH).distinct().count() == 5
    assert {tuple(r) for r in out.select(*cols).collect()} == want


def test_late_rows_are_numbered_where_they_belong(spark):
    """Rows come in any order, null keys and a hot key among them; two batches fail and run again."""
    rnd = random.Random(8)
    schema = "q STRING, n INT, ts TIMESTAMP, mejora BOOLEAN, nuevas INT"
    start = dt.datetime(2024, 1, 1)
    rows = [
        (rnd.choice(["hot", "hot", "a", "b", None]), n, None if n % 17 == 3 else start + dt.timedelta(minutes=rnd.randrange(90)), rnd.choice([True, False, False, None]), rnd.choice([0, 1, 3, None]))
        for n in range(240)
    ]
    parts = [rows[:90], rows[90:180], [("new", 900, start, False, 2)], rows[180:]]
    root, real = work_dir(spark, "plateau_late"), bucket_table.merge_batch
    for batch, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        for fails in ([None, "before", "after"][batch % 3], None):
            def merge(*args, fails=fails):
                if fails == "before":
                    raise RuntimeError("lost")
                real(*args)
                if fails:
                    raise RuntimeError("lost")

            stream = jobs.stream_articles(spark, f"{root}/in", spark.createDataFrame([], schema).schema, "parquet")
            with pytest.MonkeyPatch.context() as m:
                m.setattr(bucket_table, "merge_batch", merge)
                if fails:
                    with pytest.raises(Exception, match="lost"):
                        jobs.plateau_late(stream, root, f"{root}/cp", "q", "ts", "n", 4)
                else:
                    jobs.plateau_late(stream, root, f"{root}/cp", "q", "ts", "n", 4)
        want = set()
        for q in {r[0] for p in parts[: batch + 1] for r in p}:
            number = stall = sources = 0
            for r in sorted((r for p in parts[: batch + 1] for r in p if r[0] == q), key=lambda r: (r[2] is None, r[2] or start, r[1])):
                number, stall, sources = number + 1, 0 if r[3] else stall + 1, sources + (r[4] or 0)
                want.add((q, r[1], number, stall, sources))
        got = jobs.plateau_rows(spark, root, "q", "n").select("q", "n", "iteracion", "estancamiento", "fuentes")
        assert {tuple(r) for r in got.collect()} == want
    # the key that came alone and in order had no rows of others written with it
    assert spark.read.parquet(f"{root}/rows/batch=2").count() == 1
