"""Streaming queries: the events table is the landing folder, read to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import money, query, table
from catalog.scores import LOG_OF_EVENTS as _LOG
from marisma.functions import numbers
from marisma.session import work_dir
from marisma.streaming import jobs


EDGES = ["2024-01-08", "2024-01-16", "2024-01-24"]
LATE = "event_id % 50 = 7"

#: the file a row lands in: four in time order, then one with rows that were held up
_LANDED = f"""WITH landed AS (SELECT *, CASE WHEN {LATE} THEN 4 ELSE {' + '.join(f"CAST(ts >= TIMESTAMP '{e}' AS INT)" for e in EDGES)} END AS part FROM events) """


def by_event(late: bool = True):
    """The file number of an event: its time range, or the last for those held up."""
    part = sum((F.col("ts").cast("timestamp") >= F.lit(e).cast("timestamp")).cast("int") for e in EDGES)
    return F.when(F.expr(LATE) & F.lit(late), 4).otherwise(part)


def land(spark, rows, run, late=True):
    """The rows land part by part, in as many files as they have tasks; run takes the stream each time, on one checkpoint."""
    root = work_dir(spark, "landing")
    kept = rows.drop("_part")
    for n in range(5 if late else 4):
        rows.filter(F.col("_part") == n).drop("_part").write.mode("append").parquet(root)
        stream = jobs.stream_articles(spark, root, kept.schema, "parquet")
        run(stream.withColumn("ts", F.col("ts").cast("timestamp")))


def events_landing(spark, d, run, late=True):
    land(spark, table(spark, d, "events").withColumn("_part", by_event(late)), run, late)


@query("R01_stream_articles", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    root = work_dir(spark, "r01")
    events_landing(spark, d, lambda s: jobs.append_to(s.select("event_id", "event_type", "value"), f"{root}/out", f"{root}/cp"))
    return spark.read.schema("event_id BIGINT, event_type STRING, value DOUBLE").parquet(f"{root}/out")


@query("R02_dedup_within_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    root = work_dir(spark, "r02")
    rows = lambda s: jobs.dedup_within(s, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    events_landing(spark, d, lambda s: jobs.append_to(rows(s), f"{root}/out", f"{root}/cp"))
    return spark.read.schema("user_id BIGINT, event_type STRING").parquet(f"{root}/out")


@query("R02_dedup_exact", _LANDED + "SELECT user_id, arg_min(event_id, CAST(part AS BIGINT) * 1000000000 + event_id) AS event_id FROM landed GROUP BY ALL")
def _(spark, d):
    root = work_dir(spark, "r02x")
    events_landing(spark, d, lambda s: jobs.dedup_exact(s.select("user_id", "event_id"), f"{root}/log", f"{root}/cp", ["user_id"], "event_id"))
    return jobs.first_rows(spark, f"{root}/log", "user_id BIGINT, event_id BIGINT")


@query("R02_dedup_exact_null_keys", _LANDED + """
, k AS (SELECT CASE WHEN user_id % 4 <> 0 THEN user_id END AS usuario, nullif(event_type, 'view') AS tipo, event_id, CAST(part AS BIGINT) * 1000000000 + event_id AS o FROM landed)
SELECT usuario, tipo, arg_min(event_id, o) AS event_id FROM k GROUP BY ALL""")
def _(spark, d):
    root = work_dir(spark, "r02n")
    rows = lambda s: s.select(F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("usuario"), F.nullif("event_type", F.lit("view")).alias("tipo"), "event_id")
    events_landing(spark, d, lambda s: jobs.dedup_exact(rows(s), f"{root}/log", f"{root}/cp", ["usuario", "tipo"], "event_id"))
    return jobs.first_rows(spark, f"{root}/log", "usuario BIGINT, tipo STRING, event_id BIGINT")


@query("R03_stream_upsert", _LANDED + "SELECT user_id, event_type, max_by(event_id, CAST(part AS BIGINT) * 1000000000 + event_id) AS event_id, max_by(value, CAST(part AS BIGINT) * 1000000000 + event_id) AS value FROM landed GROUP BY ALL")
def _(spark, d):
    root = work_dir(spark, "r03")
    rows = lambda s: s.select("user_id", "event_type", "event_id", "value")
    events_landing(spark, d, lambda s: jobs.upsert_log(rows(s), f"{root}/log", f"{root}/cp", ["user_id", "event_type"], "event_id"))
    log = jobs.read_log(spark, f"{root}/log", "user_id BIGINT, event_type STRING, event_id BIGINT, value DOUBLE")
    return jobs.current_rows(log, ["user_id", "event_type"], "event_id")


_FINS = "(SELECT unnest(generate_series((SELECT min(dia) FROM d), (SELECT max(dia) FROM d), INTERVAL 1 DAY)) AS fin) f"
#: a batch drops what was late for the watermark that the batch before it ran with
_KEPT = "(part < 4 OR CAST(ts AS DATE) + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 1 DAY FROM landed WHERE part < 4))"


@query("R04_stream_coverage", _LANDED + """
, d AS (SELECT CAST(ts AS DATE) AS dia, event_type AS tema, count(*) FILTER (value / 50 - 1 > 0.2) AS positive, count(*) FILTER (value / 50 - 1 BETWEEN -0.2 AND 0.2) AS neutral,
  count(*) FILTER (value / 50 - 1 < -0.2) AS negative, count(*) AS total FROM landed
  WHERE """ + _KEPT + """ GROUP BY ALL)
SELECT v AS ventana, CAST(f.fin AS DATE) AS fin, tema, sum(positive) AS positive, sum(neutral) AS neutral, sum(negative) AS negative, sum(total) AS total
FROM d, (VALUES (1, '1d'), (7, '7d'), (30, '30d')) w(n, v), """ + _FINS + """
WHERE dia <= f.fin AND dia > f.fin - n * INTERVAL 1 DAY GROUP BY ALL
""")
def _(spark, d):
    root = work_dir(spark, "r04")
    daily = lambda s: jobs.daily_coverage(s, "ts", "event_type", numbers.coverage_label(F.col("value") / 50 - 1))
    events_landing(spark, d, lambda s: jobs.log_batches(daily(s), f"{root}/log", f"{root}/cp", mode="update"))
    schema = "dia DATE, tema STRING, positive BIGINT, neutral BIGINT, negative BIGINT, total BIGINT"
    log = jobs.read_log(spark, f"{root}/log", schema)
    return jobs.rolling_coverage(jobs.current_rows(log, ["dia", "tema"], "total"), [1, 7, 30])


# vectors are votes on 64 axes, one an hour; every fiftieth was held up
_VOTES = f"""WITH v AS (SELECT vec_id, label AS tema, vec_id % 2 AS partido, embedding, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * vec_id AS ts FROM embeddings),
 landed AS (SELECT *, CASE WHEN vec_id % 50 = 7 THEN 4 ELSE CAST(least(3, vec_id * 4 // (SELECT count(*) FROM embeddings)) AS INT) END AS part FROM v)"""


@query("R04_stream_radar", _VOTES + f"""
, k AS (SELECT CAST(ts AS DATE) AS dia, tema, partido, embedding FROM landed WHERE {_KEPT}),
d AS (SELECT dia, tema, partido, i AS eje, sum(CASE WHEN NOT (i = 3 AND tema = 1) THEN CAST(embedding[i + 1] AS DOUBLE) END) AS suma,
  count(CASE WHEN NOT (i = 3 AND tema = 1) THEN 1 END) AS votos FROM k, range(64) r(i) GROUP BY ALL)
SELECT v AS ventana, CAST(f.fin AS DATE) AS fin, tema, partido, CAST(eje AS INT) AS eje, round(sum(suma) / nullif(sum(votos), 0), 5) + 0.0 AS media
FROM d, (VALUES (7, '7d'), (30, '30d'), (90, '90d')) w(n, v), {_FINS} WHERE dia <= f.fin AND dia > f.fin - n * INTERVAL 1 DAY GROUP BY ALL
""")
def _(spark, d):
    root = work_dir(spark, "r04r")
    k = F.col("vec_id")
    axes = F.transform("embedding", lambda x, i: F.when(~((i == 3) & (F.col("label") == 1)), x))
    vectors = table(spark, d, "embeddings")
    total = vectors.agg(F.count("*")).scalar()
    rows = vectors.select(
        F.col("label").alias("tema"), (k % 2).alias("partido"), axes.alias("ejes"),
        F.timestamp_add("HOUR", k.cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"),
        F.when(k % 50 == 7, 4).otherwise(F.least(F.lit(3), F.floor(k * 4 / total))).alias("_part"))
    land(spark, rows, lambda s: jobs.log_batches(jobs.daily_radar(s, "ts", "tema", "partido", "ejes", 64), f"{root}/log", f"{root}/cp", mode="update"))
    schema = f"dia DATE, tema {rows.schema['tema'].dataType.simpleString()}, partido BIGINT, sumas ARRAY<DOUBLE>, votos ARRAY<BIGINT>, articulos BIGINT"
    daily = jobs.current_rows(jobs.read_log(spark, f"{root}/log", schema), ["dia", "tema", "partido"], "articulos")
    return jobs.rolling_radar(daily, [7, 30, 90]).withColumn("media", F.round("media", 5) + 0.0)


@query("R04_stream_affinity", _LANDED + f"""
, d AS (SELECT CAST(ts AS DATE) AS dia, user_id % 10 AS medio, sum(CAST(value AS DECIMAL(18,2))) AS suma, count(*) AS n FROM landed WHERE {_KEPT} GROUP BY ALL)
SELECT v AS ventana, CAST(f.fin AS DATE) AS fin, medio, round(CAST(sum(suma) AS DOUBLE) / sum(n), 4) AS afinidad, CAST(sum(n) AS BIGINT) AS articulos,
  round(sum(n) * 100 / sum(sum(n)) OVER (PARTITION BY v, f.fin), 4) AS cuota_articulos
FROM d, (VALUES (1, '1d'), (7, '7d'), (30, '30d')) w(n_days, v), {_FINS} WHERE dia <= f.fin AND dia > f.fin - n_days * INTERVAL 1 DAY GROUP BY v, f.fin, medio
""")
def _(spark, d):
    root = work_dir(spark, "r04a")
    rows = lambda s: s.select("ts", (F.col("user_id") % 10).alias("medio"), money("value").alias("afinidad"))
    events_landing(spark, d, lambda s: jobs.log_batches(jobs.daily_affinity(rows(s), "ts", "medio", "afinidad"), f"{root}/log", f"{root}/cp", mode="update"))
    log = jobs.read_log(spark, f"{root}/log", "dia DATE, medio BIGINT, suma DOUBLE, votos BIGINT, articulos BIGINT")
    out = jobs.rolling_affinity(jobs.current_rows(log, ["dia", "medio"], "articulos"), [1, 7, 30])
    return out.withColumns({c: F.round(c, 4) for c in ("afinidad", "cuota_articulos")})


@query("R05_late_policy", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-21'")
def _(spark, d):
    root = work_dir(spark, "r05")
    rows = lambda s: jobs.late_policy(s, "ts", F.lit("2024-01-31").cast("timestamp"), 10).select("event_id")
    events_landing(spark, d, lambda s: jobs.append_to(rows(s), f"{root}/out", f"{root}/cp"))
    return spark.read.schema("event_id BIGINT").parquet(f"{root}/out")


def _iterations(stream):
    return stream.select(
        "user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("mejora"), (F.col("event_type") == "click").cast("int").alias("nuevas"))


@query("R06_stream_plateau", _LOG + "SELECT user_id, event_id, iteracion, estancamiento, fuentes FROM log")
def _(spark, d):
    root = work_dir(spark, "r06")
    run = lambda s: jobs.append_to(jobs.stream_plateau(_iterations(s), "user_id", "ts", "event_id"), f"{root}/out", f"{root}/cp")
    events_landing(spark, d, run, late=False)
    return spark.read.schema("user_id BIGINT, event_id BIGINT, iteracion BIGINT, estancamiento BIGINT, fuentes BIGINT").parquet(f"{root}/out")


@query("R06_plateau_log", _LOG + "SELECT user_id, event_id, iteracion, estancamiento, fuentes FROM log")
def _(spark, d):
    root = work_dir(spark, "r06l")
    events_landing(spark, d, lambda s: jobs.plateau_log(_iterations(s), root, f"{root}/cp", "user_id", "ts", "event_id"), late=False)
    schema = "user_id BIGINT, event_id BIGINT, iteracion BIGINT, estancamiento BIGINT, fuentes BIGINT"
    return jobs.read_log(spark, f"{root}/rows", schema).drop(jobs.BATCH)


@query("R06_plateau_late", _LOG + "SELECT user_id, event_id, iteracion, estancamiento, fuentes FROM log")
def _(spark, d):
    """Two rows in a hundred come after all others and are numbered where they belong."""
    root = work_dir(spark, "r06t")
    events_landing(spark, d, lambda s: jobs.plateau_late(_iterations(s), root, f"{root}/cp", "user_id", "ts", "event_id", 8))
    return jobs.plateau_rows(spark, root, "user_id", "event_id").select("user_id", "event_id", "iteracion", "estancamiento", "fuentes")
