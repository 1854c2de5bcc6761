"""Streaming queries: the events table as a stream of files; each must equal its batch form."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query, same
from ..plans.tables import Table, scratch
from ..plans.views import IncrementalAggregate
from . import streams


def _stream(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    """Events dealt out by time into runs of files; the files of a run arrive together, and the runs in that order."""
    events, path = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark, "stream")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    files = max(1, events.rdd.getNumPartitions())  # as many as tasks read the table
    for k in range(parts):
        part = F.floor((F.col("event_id") - low) * parts / (high - low + 1)) == k
        events.filter(part).repartition(files, "event_id").write.option("maxRecordsPerFile", 1_000_000).mode("append").parquet(path)
    return streams.event_stream(spark, path, events.schema, files)


def _table(spark: SparkSession, name: str) -> tuple[Table, str]:
    return Table(spark, scratch(spark, name)), scratch(spark, f"{name}-checkpoint")


def _ingest(spark, sf_dir):
    table, at = _table(spark, "ingest")
    streams.run_once(streams.parsed(_stream(spark, sf_dir)), at, lambda b, e: table.insert(b.select("event_id", "k")) and None)
    return table.read().agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def _position(spark, sf_dir):
    """A second run from the same checkpoint finds nothing new."""
    table, at = _table(spark, "position")
    stream, seen = _stream(spark, sf_dir), []
    for _ in range(2):
        streams.run_once(stream, at, lambda b, e: seen.append(b.count()))
    return spark.createDataFrame([(sum(seen),)], "n long")


def _tumbling(spark, sf_dir):
    table, at = _table(spark, "tumbling")
    flat = streams.tumbling(_stream(spark, sf_dir)).select(F.col("w.start").cast("string").alias("start_"), "event_type", "n", F.col("v").cast("double").alias("v"))
    streams.run_once(flat, at, streams.upserting(table, ["start_", "event_type"]), "update")
    return table.read()


def _sliding(spark, sf_dir):
    table, at = _table(spark, "sliding")
    flat = streams.sliding(_stream(spark, sf_dir)).select(F.col("w.start").cast("string").alias("start_"), "n")
    streams.run_once(flat, at, streams.upserting(table, ["start_"]), "update")
    return table.read()


def _promote(spark, sf_dir):
    """Gold rows beyond the largest sequence number, batch by batch."""
    table, at = _table(spark, "gold")

    def promote(batch: DataFrame, epoch: int) -> None:
        top = table.read().agg(F.max("event_id")).first()[0] if table.exists() else None
        table.insert(batch.select("event_id", "event_type") if top is None else batch.filter(F.col("event_id") > top).select("event_id", "event_type"))

    streams.run_once(_stream(spark, sf_dir), at, promote)
    return table.read().groupBy("event_type").agg(F.count("*").alias("n"))


def _replay(spark, sf_dir):
    """Two full replays into one table leave every event once."""
    table, stream = _table(spark, "replay")[0], _stream(spark, sf_dir)
    for k in range(2):
        streams.run_once(stream.select("event_id", "user_id"), scratch(spark, f"replay-{k}"), streams.upserting(table, ["event_id"]))
    return table.read().agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def _monitor(spark, sf_dir):
    listener, (table, at) = streams.Progress(), _table(spark, "monitor")
    stream = _stream(spark, sf_dir)
    spark.streams.addListener(listener)
    try:
        streams.run_once(stream, at, lambda b, e: b.count() and None)
        listener.wait_for(spark.read.parquet(f"{sf_dir}/events.parquet").count())
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(listener.rows, listener.batches >= 3)], "rows_ long, many boolean")


def _state(spark, sf_dir):
    table, at = _table(spark, "state")
    streams.run_once(streams.totals_by_user(_stream(spark, sf_dir)), at, streams.upserting(table, ["user_id"]), "update")
    return table.read()


def _stream_join(spark, sf_dir):
    """Clicks with a purchase of the same user within the hour after: both sides have watermarks, so state stays bounded."""
    stream, (table, at) = _stream(spark, sf_dir), _table(spark, "join")
    clicks = stream.filter("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click"), F.col("ts").alias("at_")).withWatermark("at_", "1 hour")
    buys = stream.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), "ts").withWatermark("ts", "1 hour")
    both = clicks.join(buys, F.expr("u = user_id AND ts BETWEEN at_ AND at_ + INTERVAL 1 HOUR")).select("click", "buy")
    streams.run_once(both, at, lambda b, e: table.insert(b) and None)
    return table.read()


def _arriving(spark: SparkSession, runs: list[DataFrame]) -> DataFrame:
    """A stream of runs of files that arrive one after the other."""
    path, files = scratch(spark, "arriving"), max(1, runs[0].rdd.getNumPartitions())
    for run in runs:
        run.repartition(files, "event_id").write.mode("append").parquet(path)
    return streams.event_stream(spark, path, runs[0].schema, files)


def _sessions(spark, sf_dir):
    """Sessions leave the stream when the watermark has passed their end; a last event of nobody, long after all others,
    moves it past every one of them."""
    events, (table, at) = spark.read.parquet(f"{sf_dir}/events.parquet"), _table(spark, "sessions")
    low, high, last = events.agg(F.min("event_id"), F.max("event_id"), F.max("ts")).first()
    half = F.col("event_id") < (low + high) // 2
    end = events.limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("ts", F.lit(last + datetime.timedelta(days=30)))
    stream = _arriving(spark, [events.filter(half), events.filter(~half), end])
    closed = streams.session_counts(stream).select("user_id", F.col("w.start").cast("string").alias("start_"), "n")
    streams.run_once(closed, at, streams.upserting(table, ["user_id", "start_"]))
    return table.read().filter("user_id >= 0").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def _late(spark, sf_dir):
    """Windows of a day with ten days of grace. Of the rows that arrive last, those of a day within the grace still count
    and those of days long closed are dropped. (A batch judges lateness by the watermark that the one before began with.)"""
    events, (table, at) = spark.read.parquet(f"{sf_dir}/events.parquet"), _table(spark, "late")
    day = F.dayofmonth("ts")
    late = (day < 15) | (day == 25)
    stream = _arriving(spark, [events.filter(~late & (day < 30)), events.filter(day >= 30), events.filter(late)])
    streams.run_once(streams.daily(stream, "10 days").select(F.col("w.start").cast("string").alias("start_"), "n"), at, streams.upserting(table, ["start_"]), "update")
    return table.read()


def _cadence(spark, sf_dir):
    table, at = _table(spark, "cadence")
    batches = streams.every(_stream(spark, sf_dir).select("event_id", "event_type"), at, lambda b, e: table.insert(b) and None, 0.2)
    return table.read().agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.lit(batches == 3).alias("each_run_its_batch"))


def _positions(spark, sf_dir):
    table, at = _table(spark, "positions")
    stream = streams.positioned(_stream(spark, sf_dir)).select("event_id", "partition", "offset")
    streams.run_once(stream, at, lambda b, e: table.insert(b) and None)
    ends = table.read().groupBy("partition").agg((F.max("offset") + 1).alias("end"), F.count("*").alias("rows"))
    return ends.agg(F.sum("rows").alias("n"), F.every(F.col("end") == F.col("rows")).alias("gapless"))


def _view(spark, sf_dir):
    """Totals by kind, kept by the stream; the last batch is given twice, as after a crash."""
    (table, at), (noted, _) = _table(spark, "view"), _table(spark, "noted")
    view = IncrementalAggregate(table, ["event_type"], "v")
    write, seen = streams.maintained(view, noted), []

    def each(batch: DataFrame, epoch: int) -> None:
        write(batch, epoch)
        seen.append(epoch)
        write(batch, epoch)

    stream = _stream(spark, sf_dir).withColumn("v", F.col("value").cast("decimal(18,2)"))
    streams.run_once(stream.select("event_type", "v"), at, each)
    return view.read().select("event_type", F.col("total").cast("double").alias("total"), "n", F.lit(len(seen)).alias("batches"))


QUERIES = [
    Query("t03_partition_and_offset", _positions, "SELECT count(*) AS n, true AS gapless FROM events"),
    Query("t08_late_rows", _late, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start_, count(*) AS n FROM events WHERE extract(day FROM ts) >= 15 GROUP BY 1"),
    Query("t11_cadence", _cadence, "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, true AS each_run_its_batch FROM events"),
    Query("v15_streaming_view", _view, "SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, 3 AS batches FROM events GROUP BY 1"),
    Query("t02_streaming_ingest", _ingest, "SELECT count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events"),
    Query("t04_position", _position, "SELECT count(*) AS n FROM events"),
    same("t05_funnel", "SELECT sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS buys FROM {events} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'"),
    same("t06_top_in_window", "SELECT user_id, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-18 00:00:00' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"),
    Query("t07_promote", _promote, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    Query("t09_replay", _replay, "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events"),
    Query("t10_monitor", _monitor, "SELECT count(*) AS rows_, true AS many FROM events"),
    Query("t12_tumbling", _tumbling, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start_, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY 1, 2"),
    Query("t12_sliding", _sliding, "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start_, count(*) AS n FROM (SELECT date_trunc('day', ts) AS s FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY FROM events) GROUP BY 1"),
    Query("t12_sessions", _sessions, """SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
          FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000 THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id"""),
    Query("t12_custom_state", _state, "SELECT user_id, count(*) AS n FROM events GROUP BY 1"),
    Query("t12_stream_join", _stream_join, "SELECT c.event_id AS click, b.event_id AS buy FROM events c JOIN events b ON c.user_id = b.user_id AND c.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR"),
]
