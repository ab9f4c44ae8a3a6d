"""Pauses between words: gap rows, categories, priors, labels, speech rates, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import clamp
from ..functions.text import ends_sentence, is_filler
from ..functions.windows import by_time
from .intervals import interval_join

# Thresholds of the gap rules, in seconds and decibels.
HF_BREATH, HF_PHONETIC, DEAD_AIR, CONTRAST, FLATNESS, FLOOR = 0.15, 0.08, 30.0, 6.0, 0.005, 10.0
SHORT_S, WAITING_S, DRAMATIC_S = 0.15, 0.50, 1.10


def word_gaps(words: DataFrame, least_ms: int = 50) -> DataFrame:
    """Gaps of at least least_ms between neighbouring words, with both: gap_idx is the number of the word before."""
    nxt = lambda c: F.lead(c).over(by_time())
    rows = words.withColumn("_end", nxt("start_ms")).withColumn("next_text", nxt("text")).withColumn("next_speaker", nxt("speaker"))
    rows = rows.filter(F.col("_end").isNotNull() & (F.col("_end") - F.col("end_ms") >= least_ms))
    return rows.select(
        "source_id", F.col("word_idx").alias("gap_idx"), F.col("end_ms").alias("start_ms"), F.col("_end").alias("end_ms"), F.col("text").alias("prev_text"), "next_text", F.col("speaker").alias("prev_speaker"), "next_speaker"
    )


def classify_gaps(gaps: DataFrame) -> DataFrame:
    """category and confidence of gaps with evidence (hf_ratio, above_floor_db, contrast_db, flatness; nulls where unmeasured).

    The rules are tried in order, the most protective first.
    """
    s = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    hf, above, contrast, flat = (F.col(c) for c in ("hf_ratio", "above_floor_db", "contrast_db", "flatness"))
    sentence = ends_sentence(F.col("prev_text"))
    dead = (above >= 45.0) & (contrast >= 18.0)
    r = lambda category, confidence: F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
    low = above < DEAD_AIR
    rule = (
        F.when(~F.col("prev_speaker").eqNullSafe(F.col("next_speaker")), r("speaker_transition", 0.95))
        .when(above.isNull() & contrast.isNull() & hf.isNull(), r("nonspeech_unknown", 0.60))
        .when(above.isNull() & contrast.isNull(), r("nonspeech_unknown", 0.75))
        .when(above < FLOOR, r("nonspeech_unknown", 0.70))
        .when((contrast < CONTRAST) & (flat < FLATNESS), r("nonspeech_unknown", 0.80))
        .when(contrast < CONTRAST, r("nonspeech_unknown", 0.78))
        .when((s < SHORT_S) & (hf < HF_PHONETIC), r("normal_word_gap", 0.90))
        .when(low & (flat < FLATNESS), r("nonspeech_unknown", 0.72))
        .when(low & (hf < HF_BREATH), r("nonspeech_unknown", 0.72))
        .when((s >= DRAMATIC_S) & dead & ~sentence, r("waiting_pause", 0.72))
        .when((s >= DRAMATIC_S) & sentence, r("sentence_pause", 0.88))
        .when(s >= DRAMATIC_S, r("dramatic_pause", 0.85))
        .when(sentence | is_filler(F.col("next_text")), r("sentence_pause", 0.85))
        .when((hf >= HF_BREATH) & (contrast >= CONTRAST) & (s >= WAITING_S), r("waiting_pause", 0.80))
        .when((hf >= HF_BREATH) & (contrast >= CONTRAST), r("breath_pause", 0.82))
        .when(hf < HF_PHONETIC, r("normal_word_gap", 0.90))
        .when(hf.isNotNull(), r("normal_word_gap", 0.75))
        .otherwise(r("nonspeech_unknown", 0.60))
    )
    return gaps.withColumn("_r", rule).select(*gaps.columns, "_r.category", "_r.confidence")


def boundary_prior(gaps: DataFrame) -> DataFrame:
    """p_boundary from the pause, sentence and clause ends, an energy drop over 6 dB, less a known change of speaker."""
    pause = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    changed = F.coalesce((F.trim("prev_speaker") != "") & (F.trim("next_speaker") != "") & (F.trim("prev_speaker") != F.trim("next_speaker")), F.lit(False))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    p = F.least(F.lit(1.0), pause / 0.6) * 0.55 + one(ends_sentence(F.col("prev_text"))) + 0.45 * one(F.rtrim("prev_text").endswith(",")) + 0.15 * one(F.coalesce(F.col("energy_drop_db"), F.lit(0.0)) > 6.0) - one(changed)
    return gaps.withColumn("p_boundary", F.round(clamp(p, 0.0, 1.0), 3))


def label_match(gaps: DataFrame, labels: DataFrame) -> DataFrame:
    """Each gap with its human label (``label``, ``tier``): (hash, idx), then hash and half overlap, then idx, then half overlap.

    gaps: source_id, source_hash, gap_idx, start_ms, end_ms. labels: label_id, source_hash (null: any), gap_idx, start_ms, end_ms, label.
    Labels of a null hash are held against every source: their least label of an index is joined, but those that fit by overlap alone give
    a pair with each overlapping gap that no earlier tier labels.
    """
    key = ["source_id", "gap_idx"]
    base = gaps.select("source_id", "source_hash", "gap_idx", "start_ms", "end_ms")
    one = base.join(labels.filter("source_hash is not null").select("source_hash", "gap_idx", "label_id", "label"), ["source_hash", "gap_idx"]).select(*key, F.lit(1).alias("tier"), "label_id", "label")
    both = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    shorter = F.greatest(F.least(F.col("end_ms") - F.col("start_ms"), F.col("r_end_ms") - F.col("r_start_ms")), F.lit(1))
    near = (F.abs(F.col("start_ms") - F.col("r_start_ms")) < 100) & (F.abs(F.col("end_ms") - F.col("r_end_ms")) < 100)
    fits = (2 * both >= shorter) | near
    two = interval_join(base, labels.filter("source_hash is not null").select("source_hash", "start_ms", "end_ms", "label_id", "label"), ["source_hash"]).filter(fits).select(*key, F.lit(2).alias("tier"), F.col("r_label_id").alias("label_id"), F.col("r_label").alias("label"))
    loose = labels.filter("source_hash is null")
    least = loose.groupBy("gap_idx").agg(F.min(F.struct("label_id", "label")).alias("l"))
    three = base.join(least, "gap_idx").select(*key, F.lit(3).alias("tier"), "l.label_id", "l.label")
    earlier = one.unionByName(two).unionByName(three)
    four = interval_join(base.join(earlier.select(*key), key, "left_anti").withColumn("_k", F.lit(0)), loose.select(F.lit(0).alias("_k"), "start_ms", "end_ms", "label_id", "label"), ["_k"]).filter(fits).select(*key, F.lit(4).alias("tier"), F.col("r_label_id").alias("label_id"), F.col("r_label").alias("label"))
    best = earlier.unionByName(four).groupBy(*key).agg(F.min(F.struct("tier", "label_id", "label")).alias("b"))
    return gaps.join(best.select(*key, "b.tier", "b.label"), key, "left")


def weak_labels(gaps: DataFrame) -> DataFrame:
    """label, label_source, weak of classified gaps with an optional human label in ``human`` and evidence columns."""
    classes = ["normal_word_gap", "breath_pause", "waiting_pause", "sentence_pause", "speaker_transition", "nonspeech_unknown"]
    human = F.lower(F.trim("human"))
    valid = F.coalesce(human.isin(classes), F.lit(False))
    changed = ~F.col("prev_speaker").eqNullSafe(F.col("next_speaker")) | (F.col("category") == "speaker_transition")
    removable = F.col("category").isin("breath_pause", "waiting_pause") & (F.col("confidence") >= 0.70) | (F.col("category") == "breath_pause")
    quiet = F.coalesce((F.col("vad_silence") >= 0.60) & (F.col("level_drop_db") < -6.0), F.lit(False))
    weak = (
        F.when(changed, "speaker_transition").when(removable | quiet, F.when(F.coalesce(F.col("hf_ratio"), F.lit(0.0)) >= 0.15, "breath_pause").otherwise("waiting_pause"))
        .when(F.col("category") == "nonspeech_unknown", "nonspeech_unknown").when(ends_sentence(F.col("prev_text")) | (F.col("category") == "sentence_pause"), "sentence_pause").otherwise("normal_word_gap")
    )
    return gaps.withColumn("label", F.when(valid, human).otherwise(weak)).withColumn("label_source", F.when(valid, "human_annotation").otherwise("weak_supervision")).withColumn("weak", ~valid)


def speech_rates(gaps: DataFrame, words: DataFrame, clips: DataFrame, around_ms: int = 2000) -> DataFrame:
    """pre_rate and post_rate (words a second within around_ms of a gap, inside the clip), rel_pos and the text features of gaps."""
    w = words.select("source_id", "start_ms", "end_ms")

    def rate(lo, hi, name):
        spans = gaps.join(clips.select("source_id", "clip_start", "clip_end"), "source_id").select("source_id", "gap_idx", lo.cast("long").alias("start_ms"), hi.cast("long").alias("end_ms"), "clip_start", "clip_end")
        n = interval_join(spans.select("source_id", "gap_idx", "start_ms", "end_ms"), w).groupBy("source_id", "gap_idx").agg(F.count("*").alias("n"))
        seconds = F.greatest(F.lit(0.1), (F.least("end_ms", "clip_end") - F.greatest("start_ms", "clip_start")) / 1000.0)
        return spans.join(n, ["source_id", "gap_idx"], "left").select("source_id", "gap_idx", (F.coalesce("n", F.lit(0)) / seconds).alias(name))

    pre = rate(F.col("start_ms") - around_ms, F.col("start_ms"), "pre_rate")
    post = rate(F.col("end_ms"), F.col("end_ms") + around_ms, "post_rate")
    out = gaps.join(pre, ["source_id", "gap_idx"]).join(post, ["source_id", "gap_idx"]).join(clips, "source_id")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return out.select(
        "source_id", "gap_idx", ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration_s"), one(F.col("prev_speaker") != F.col("next_speaker")).alias("speaker_change"), one(ends_sentence(F.col("prev_text"))).alias("ends_sentence"),
        one(F.rtrim("prev_text").endswith(",")).alias("ends_clause"), one(is_filler(F.col("next_text"))).alias("starts_filler"), one(is_filler(F.col("prev_text"))).alias("ends_filler"), "pre_rate", "post_rate",
        ((F.col("start_ms") - F.col("clip_start")) / F.greatest(F.lit(100), F.col("clip_end") - F.col("clip_start"))).alias("rel_pos"),
    )


def removal_telemetry(gaps: DataFrame, edits: DataFrame) -> DataFrame:
    """Gaps with ``removed``: whether their midpoint lies in an edit."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long")
    points = gaps.select("source_id", "gap_idx", mid.alias("start_ms"), mid.alias("end_ms"))
    hit = interval_join(points, edits.select("source_id", "start_ms", "end_ms"), mode="closed").select("source_id", "gap_idx").distinct().withColumn("removed", F.lit(True))
    return gaps.join(hit, ["source_id", "gap_idx"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def gap_levels(samples: DataFrame, gaps: DataFrame, frame_ms: int = 30) -> DataFrame:
    """Level (dB), zero-crossing rate, floor (5th percentile of frame levels) and speech reference (median) per gap. samples: source_id, t_ms, x."""
    w = Window.partitionBy("source_id").orderBy("t_ms")
    flagged = samples.withColumn("cross", (F.signum("x") != F.lag(F.signum("x")).over(w)).cast("int"))
    db = lambda power: 10 * F.log10(power + F.lit(1e-12))
    frames = samples.groupBy("source_id", F.floor(F.col("t_ms") / frame_ms).alias("f")).agg(db(F.avg(F.col("x") * F.col("x"))).alias("db"))
    refs = frames.groupBy("source_id").agg(F.percentile("db", F.lit(0.05)).alias("floor_db"), F.median("db").alias("speech_db"))
    points = flagged.select("source_id", "x", "cross", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 1).alias("end_ms"))
    inside = interval_join(points, gaps.select("source_id", "gap_idx", "start_ms", "end_ms"))
    level = inside.groupBy("source_id", F.col("r_gap_idx").alias("gap_idx")).agg(db(F.avg(F.col("x") * F.col("x"))).alias("level_db"), F.avg("cross").alias("zero_crossing"), F.count("*").alias("n"))
    return level.join(refs, "source_id").withColumn("above_floor_db", F.col("level_db") - F.col("floor_db")).withColumn("contrast_db", F.col("speech_db") - F.col("level_db"))


def speaker_levels(samples: DataFrame, words: DataFrame, mismatch_db: float = 6.0, max_boost_db: float = 6.0) -> DataFrame:
    """Mean level of each speaker over their merged speech; ``mismatch`` over 6 dB in a source gives the quieter ones a boost."""
    from .intervals import merge_intervals

    spans = merge_intervals(words.filter("speaker is not null"), 250, ["source_id", "speaker"], 50)
    points = samples.select("source_id", "x", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 1).alias("end_ms"))
    joined = interval_join(points, spans.select("source_id", "speaker", "start_ms", "end_ms"))
    level = joined.groupBy("source_id", F.col("r_speaker").alias("speaker")).agg((10 * F.log10(F.avg(F.col("x") * F.col("x")) + F.lit(1e-12))).alias("level_db"))
    w = Window.partitionBy("source_id")
    gap = F.max("level_db").over(w) - F.min("level_db").over(w)
    return level.withColumn("mismatch_db", gap).withColumn("boost_db", F.when((gap > mismatch_db) & (F.col("level_db") < F.max("level_db").over(w)), F.least(F.lit(max_boost_db), F.max("level_db").over(w) - F.col("level_db"))).otherwise(0.0))
