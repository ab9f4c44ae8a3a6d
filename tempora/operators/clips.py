"""Words of clips, and checks over a whole transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed_token
from .intervals import interval_join


def clip_words(words: DataFrame, clips: DataFrame, on: list[str]) -> DataFrame:
    """Words that overlap a clip (source_id, start_ms, end_ms and keys), clamped to it; malformed words and exact doubles in a row are dropped.

    Doubles start at one time, so they are of one bucket of the join: they are found where the join leaves them, without another shuffle.
    """
    extra = [c for c in on if c != "source_id"]
    joined = interval_join(words.filter("end_ms > start_ms"), clips.select("source_id", *extra, "start_ms", "end_ms"), keep_bucket=True)
    clamped = joined.withColumn("start_ms", F.greatest("start_ms", "r_start_ms")).withColumn("end_ms", F.least("end_ms", "r_end_ms"))
    named = clamped.withColumnsRenamed({f"r_{c}": c for c in extra}).withColumnsRenamed({"r_start_ms": "clip_start", "r_end_ms": "clip_end"})
    w = Window.partitionBy("source_id", "_bucket", *extra).orderBy("start_ms", "word_idx")
    double = (F.abs(F.col("start_ms") - F.lag("start_ms").over(w)) < 1) & (F.abs(F.col("end_ms") - F.lag("end_ms").over(w)) < 1)
    return named.withColumn("_double", F.coalesce(double, F.lit(False))).filter("not _double").drop("_double", "_bucket")


def language_script(words: DataFrame, asr_language: str = "") -> DataFrame:
    """source_id, language, script from the shares of Devanagari and Latin letters among all that are not punctuation."""
    t = F.col("text")
    counted = words.select(
        "source_id", F.length(F.regexp_replace(t, r"[\p{Punct}।॥\s]", "")).alias("n"), (F.length(F.regexp_replace(t, r"[^\x{0900}-\x{097F}]", "")) - F.length(F.regexp_replace(t, "[^।॥]", ""))).alias("d"),
        F.length(F.regexp_replace(t, "[^A-Za-z]", "")).alias("l"),
    )
    sums = counted.groupBy("source_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("l").alias("l"))
    dr, lr = F.col("d") / F.nullif(F.col("n"), F.lit(0)), F.col("l") / F.nullif(F.col("n"), F.lit(0))
    roman = F.lit(asr_language.lower().startswith("hi")) & (dr < 0.02)
    language = F.when(dr > 0.65, "HINDI").when((dr > 0.10) & (lr > 0.15), "HINGLISH").when(dr > 0.05, "MULTILINGUAL").when(roman, "HINGLISH").otherwise("ENGLISH")
    script = F.when(dr > 0.65, "devanagari").when(dr > 0.05, "mixed").when(roman, "roman_hindi").otherwise("latin")
    return sums.select("source_id", language.alias("language"), script.alias("script"))


def transcript_quality(words: DataFrame, durations: DataFrame) -> DataFrame:
    """source_id, n_words, streak (longest run of one token), verdict: ``empty``, ``repetition``, ``sparse`` or ``ok``."""
    w = Window.partitionBy("source_id").orderBy("start_ms", "word_idx")
    token = words.withColumn("_t", trimmed_token(F.col("text")))
    breaks = F.coalesce((F.col("_t") != "") & (F.col("_t") == F.lag("_t").over(w)), F.lit(False))
    runs = token.withColumn("_i", F.sum((~breaks).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("source_id", "_i").agg(F.count("*").alias("n"))
    per = runs.groupBy("source_id").agg(F.max("n").alias("streak"), F.sum("n").alias("n_words"))
    joined = durations.join(per, "source_id", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0))).withColumn("streak", F.coalesce("streak", F.lit(0)))
    rate = F.col("n_words") * 1000.0 / F.greatest("duration_ms", F.lit(1000))
    verdict = (
        F.when((F.col("duration_ms") > 15000) & (F.col("n_words") == 0), "empty").when((F.col("streak") >= 5) & (F.col("n_words") < 50), "repetition")
        .when((F.col("duration_ms") > 45000) & (rate < 0.20), "sparse").otherwise("ok")
    )
    return joined.withColumn("verdict", verdict)
