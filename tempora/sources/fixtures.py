"""Timed tables derived from the given Parquet tables: words, intervals, scored windows and what follows from them.

Times are integer milliseconds, so every result is exact. Each function mirrors a CTE of ``plans.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import SPREAD
from ..functions.windows import by_time

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(turns: DataFrame) -> DataFrame:
    """words(source_id, word_idx, text, start_ms, end_ms, speaker) of turns(source_id, turn, speaker, text): the text split at white space.

    Turns are dealt by source before they are split, so the shuffle has the texts and not a row a word; the windows find them in place. Words take
    some times the room of their texts, so texts are dealt over ``SPREAD`` times the usual partitions. Turns are numbered by their counts of
    words, so words are ordered once, by word_idx, and later windows in that order find them sorted.
    """
    parts = SPREAD * int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    before = F.coalesce(F.sum(F.coalesce(F.size(listed), F.lit(0))).over(Window.partitionBy("source_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = turns.repartition(parts, "source_id").withColumn("before", before)
    numbered = dealt.select("source_id", "speaker", "before", F.posexplode(listed).alias("pos", "text")).withColumn("word_idx", (F.col("before") + F.col("pos")).cast("long"))
    r = (F.col("word_idx") * 37 + F.col("source_id") * 11) % 41
    timed = numbered.withColumn("dur", 60 * F.length("text") + 80).withColumn("gap", F.floor(r * r * r / 50))
    until = F.sum(F.col("gap") + F.col("dur")).over(Window.partitionBy("source_id").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0))
    return timed.select("source_id", "word_idx", "text", "speaker", (until - F.col("dur")).alias("start_ms"), until.alias("end_ms"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), "turn", F.col("role").alias("speaker"), "text")
    return words_of(turns)


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("speaker"), "text")
    return words_of(turns)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """intervals(event_id, source_id, cls, value, start_ms, end_ms) of events: an event lasts its value in hundredths times six seconds."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) - F.lit(1704067200000)
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), F.col("event_type").alias("cls"), "value", start.alias("start_ms"))
    return events.withColumn("end_ms", F.col("start_ms") + F.round(F.col("value") * 100).cast("long") * 6000)


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored window a minute for each event of a user, 75 s long."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("window_idx", F.row_number().over(order).cast("long") - 1)
    return events.select(
        F.col("user_id").alias("source_id"), "window_idx", F.col("event_type").alias("provider"), F.round(F.col("value") / 500.0, 4).alias("raw_score"),
        (F.col("window_idx") * 60000).alias("window_start"), (F.col("window_idx") * 60000 + 75000).alias("window_end"),
    )


def candidates(words_: DataFrame) -> DataFrame:
    """Windows of 20 words, every 8 words, with a score from integers; the hook is the first 10 words.

    Words are numbered without gaps, so each eighth sees its window in the words after it: no join, no row for each word of a window, and
    no shuffle or sort where words lie by source in the order of word_idx.
    """
    order = Window.partitionBy("source_id").orderBy("word_idx")
    ahead = lambda n: order.rangeBetween(0, n - 1)
    windows = words_.select("source_id", "word_idx", F.min("start_ms").over(ahead(20)).alias("start_ms"), F.max("end_ms").over(ahead(20)).alias("end_ms"), F.array_join(F.collect_list("text").over(ahead(10)), " ").alias("hook"))
    grouped = windows.filter("word_idx % 8 = 0").select("source_id", F.expr("word_idx div 8").alias("cand_id"), "start_ms", "end_ms", "hook")
    score = ((F.col("cand_id") * 29 + F.col("source_id") * 7) % 100) / 100.0
    return grouped.withColumn("score", score).withColumn("score_source", F.when(F.col("cand_id") % 7 == 0, "fallback").otherwise("llm"))


def silences(words_: DataFrame) -> DataFrame:
    """Gaps of 100 ms or more between words, shrunk by 20 ms at both ends."""
    after = F.lead("start_ms").over(by_time())
    return words_.withColumn("next", after).filter(F.col("next") - F.col("end_ms") >= 100).select("source_id", (F.col("end_ms") + 20).alias("start_ms"), (F.col("next") - 20).alias("end_ms"))


def detections(intervals_: DataFrame) -> DataFrame:
    """Frame samples: shots are days, tracks are classes in order of name."""
    order = ["click", "purchase", "signup", "view"]
    track = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in order)), F.col("cls")) - 1, F.lit(-1)).cast("int")
    return intervals_.select(
        "source_id", F.floor(F.col("start_ms") / 86400000).alias("shot_idx"), track.alias("track_id"), F.col("start_ms").alias("t_ms"), "event_id",
        (F.col("value") * 3.84).alias("cx"), ((F.col("event_id") * 7) % 100 / 100.0).alias("conf"), ((F.col("event_id") * 13) % 100 / 100.0).alias("motion"),
    )
