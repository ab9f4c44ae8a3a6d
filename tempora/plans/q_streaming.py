"""Queries: the live operators, fed with the tables as files of a stream and run until all is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path, written
from ..sources import fixtures as X
from ..streaming import live as L
from .registry import query
from .sql import DETECTIONS, INTERVALS, WORDS, with_


def streamed(spark: SparkSession, rows: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """The rows as a stream of the files they are written to, all of them or so many in a trigger."""
    table = written(rows, "stream-input")
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    reader = spark.readStream.schema(rows.schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(folder)


def finished(stream: DataFrame) -> DataFrame:
    """Run the stream over all that is there, into Parquet in the shared folder, and read that."""
    spark = stream.sparkSession
    root = f"{spark.conf.get('spark.checkpoint.dir')}/tempora/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def timed_words(spark, sf_dir):
    """Words with an event time, and one row far ahead that lets the watermark close all windows."""
    w = X.words(spark, sf_dir).select("source_id", F.coalesce("speaker", F.lit("S1")).alias("speaker"), "word_idx", F.timestamp_millis("start_ms").alias("ts"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("source_id"), F.lit("end").alias("speaker"), F.lit(0).cast("long").alias("word_idx"), F.timestamp_millis(F.lit(10**11).cast("long")).alias("ts"), F.lit(0).cast("long").alias("dur_ms"))
    return w.unionByName(last)


@query(with_(WORDS) + """
, w as (select *, coalesce(speaker, 'S1') as sp from words), b as (select *, max(end_ms) over (partition by source_id, sp order by start_ms, word_idx rows between unbounded preceding and 1 preceding) as reach from w),
i as (select *, sum(case when reach is null or start_ms >= reach + 850 then 1 else 0 end) over (partition by source_id, sp order by start_ms, word_idx rows unbounded preceding) as k from b)
select source_id, sp as speaker, min(start_ms) as start_ms, max(end_ms) + 850 as end_ms, count(*) as n_words, cast(sum(end_ms - start_ms) as bigint) as speech_ms from i group by source_id, sp, k""")
def o129_live_turns(spark, sf_dir):
    out = finished(L.live_turns(streamed(spark, timed_words(spark, sf_dir)))).filter("source_id >= 0")
    return out.select("source_id", "speaker", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n_words", "speech_ms")


@query(with_(WORDS) + """
, s as (select source_id, unnest([start_ms // 2000 * 2000, start_ms // 2000 * 2000 - 2000]) as s from words)
select source_id, s as start_ms, s + 4000 as end_ms, count(*) as n_words from s group by 1, 2""")
def o130_live_speech_rate(spark, sf_dir):
    out = finished(L.live_speech_rate(streamed(spark, timed_words(spark, sf_dir)))).filter("source_id >= 0")
    return out.select("source_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n_words")


@query(with_(INTERVALS, DETECTIONS) + """
, o as (select source_id, cast(track_id as bigint) as track_id, t_ms, conf, row_number() over (partition by source_id, track_id order by t_ms, conf) as i from detections),
r as (select source_id, track_id, i, t_ms, conf >= 0.5 as speaking, conf >= 0.5 as changed, case when conf >= 0.5 then t_ms end as since from o where i = 1
  union all select source_id, track_id, i, t_ms, was <> turns, turns, case when turns then t_ms else before end from (
    select *, coalesce(t_ms - before >= 3600000, true) and case when was then conf < 0.35 else conf >= 0.5 end as turns from (
      select o.*, r.speaking and o.t_ms - r.t_ms <= 86400000 as was, case when o.t_ms - r.t_ms <= 86400000 then r.since end as before
      from r join o on o.source_id = r.source_id and o.track_id = r.track_id and o.i = r.i + 1)))
select source_id, track_id, t_ms, speaking from r where changed""")
def o131_live_hysteresis(spark, sf_dir):
    """The detections as a stream, and one row far ahead that lets the watermark pass all of them."""
    d = X.detections(X.intervals(spark, sf_dir)).select("source_id", F.col("track_id").cast("long").alias("track_id"), "t_ms", F.col("conf").alias("p"))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("source_id"), F.lit(-1).cast("long").alias("track_id"), F.lit(8 * 10**12).cast("long").alias("t_ms"), F.lit(0.0).alias("p"))
    return finished(L.live_hysteresis(streamed(spark, d.unionByName(last)), 0.5, 0.35, 3_600_000)).filter("source_id >= 0")


@query("select user_id, event_id % 500 as k from events group by 1, 2")
def o132_replay_safe(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    return finished(L.replay_safe(streamed(spark, e), ["user_id", "k"], late="3650 days")).select("user_id", "k")


@query("""select user_id, event_id % 50 as k, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by all""")
def o132_upsert_batches(spark, sf_dir):
    """The events in several triggers, each upserted into the table's next version; the newest event of every key stays."""
    e = X.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("k"), "event_id", "event_type", "value")
    path = shared_path(spark, "upserted")
    run = (
        streamed(spark, e.repartition(4), per_trigger=1).writeStream.foreachBatch(L.upsert_batches(path, ["user_id", "k"], "event_id"))
        .option("checkpointLocation", shared_path(spark, "upsert-state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return L.latest_version(spark, path, e.schema)
