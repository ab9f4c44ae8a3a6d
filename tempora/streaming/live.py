"""Streaming twins of the sessionization, rate and hysteresis operators for a live transcript."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.rank import upsert


def live_turns(words: DataFrame, gap_ms: int = 850, late: str = "10 seconds") -> DataFrame:
    """Speech sessions per source and speaker: a word extends its session to gap_ms after its own end. words: ts (start), dur_ms."""
    window = F.session_window("ts", F.concat((F.col("dur_ms") + gap_ms).cast("string"), F.lit(" milliseconds")))
    grouped = words.withWatermark("ts", late).groupBy("source_id", "speaker", window.alias("w")).agg(F.count("*").alias("n_words"), F.sum("dur_ms").alias("speech_ms"))
    return grouped.select("source_id", "speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_words", "speech_ms")


def live_speech_rate(words: DataFrame, size: str = "4 seconds", step: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Words in sliding windows per source."""
    grouped = words.withWatermark("ts", late).groupBy("source_id", F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n_words"))
    return grouped.select("source_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_words")


#: A track's state: whether it speaks, since when, its last row's time, and its rows that the watermark has not passed yet.
TRACK = "speaking boolean, since long, last long, t array<long>, p array<double>"
NEVER = -(10**15)
#: Added to source times to make event times: a watermark begins at 0, and rows at or before it are late.
EPOCH = 10**10


def live_hysteresis(scores: DataFrame, on: float = 0.5, off: float = 0.35, cooldown_ms: int = 1000, late: str = "10 seconds", idle_ms: int = 86_400_000) -> DataFrame:
    """source_id, track_id, t_ms, speaking: every change of a track's state, with hysteresis and a cooldown, from scores (t_ms, p).

    Event time rules: rows wait in the track's state until the watermark (``late`` behind the newest row of all) has passed them and are folded in
    time order then, so rows may come in any order within ``late``, over any number of triggers; later ones are dropped. A timer at the first waiting row wakes a
    track that gets no more rows. A track without rows for ``idle_ms`` starts anew, as not speaking; its state is dropped then.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        speaking, since, last, t, p = state.get if state.exists else (False, NEVER, NEVER, [], [])
        waiting = list(zip(t, p))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip(f["t_ms"].tolist(), f["p"].tolist())
        passed = state.getCurrentWatermarkMs() - EPOCH
        waiting.sort()
        rows, n = [], 0
        for n, (at, score) in enumerate(waiting, 1):
            if at >= passed:
                n -= 1
                break
            if at - last > idle_ms:
                speaking, since = False, NEVER
            last = at
            if at - since >= cooldown_ms and ((not speaking and score >= on) or (speaking and score < off)):
                speaking, since = not speaking, at
                rows.append((*key, at, speaking))
        waiting = waiting[n:]
        if not waiting and last + idle_ms < passed:
            state.remove()
        else:
            state.update((speaking, since, last, [x for x, _ in waiting], [x for _, x in waiting]))
            state.setTimeoutTimestamp(EPOCH + max(passed + 1, waiting[0][0] if waiting else last + idle_ms))
        yield pd.DataFrame(rows, columns=["source_id", "track_id", "t_ms", "speaking"])

    timed = scores.select("source_id", "track_id", "t_ms", "p", F.timestamp_millis(F.col("t_ms") + EPOCH).alias("ts")).withWatermark("ts", late)
    return timed.groupBy("source_id", "track_id").applyInPandasWithState(
        step, "source_id long, track_id long, t_ms long, speaking boolean", TRACK, "append", GroupStateTimeout.EventTimeTimeout
    )


def replay_safe(rows: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The stream without rows whose key came before within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def latest_version(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The newest version of the table (the newest one before a number), or no rows. Batches without rows leave no version."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [int(x[2:]) for x in found if x.startswith("v=") and (before is None or int(x[2:]) < before)]
    return spark.read.schema(schema).parquet(f"{path}/v={max(numbers)}") if numbers else spark.createDataFrame([], schema)


def upsert_batches(path: str, key: list[str], newest: str):
    """A foreachBatch function that keeps the newest row of each key in a table of numbered versions; a batch that is run again gives the same version."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest_version(spark, path, batch.schema, number)
        upsert(old, batch, key, newest).write.mode("overwrite").parquet(f"{path}/v={number}")

    return put
