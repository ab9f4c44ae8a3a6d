"""Quality checks and evaluation: rule rows, roll-ups, audits, metrics, format choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written
from .intervals import interval_join_levels


def classification_metrics(predictions: DataFrame, threshold: float = 0.65) -> DataFrame:
    """n, error, logloss, precision and recall at the threshold, auc, pr_auc of predictions (truth 0/1, predicted 0/1, p).

    The areas come from counts per distinct p and a prefix scan in two levels: scores are dealt by ranges, summed within a range, and a range's row
    starts from the sum of the ranges before it. Only the ranges' own sums (one row each) are ordered in one place.
    """
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    hit = F.col("p") >= threshold
    base = predictions.agg(
        F.count("*").alias("n"), F.avg((F.col("truth") != F.col("predicted")).cast("double")).alias("error"), F.avg(-F.when(F.col("truth") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("logloss"),
        F.try_divide(F.count_if(hit & (F.col("truth") == 1)), F.count_if(hit)).alias("precision"), F.try_divide(F.count_if(hit & (F.col("truth") == 1)), F.count_if(F.col("truth") == 1)).alias("recall"),
    )
    steps = predictions.groupBy("p").agg(F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg"))
    dealt = steps.repartitionByRange(int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("p").desc())
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "score-steps")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = sums.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("pos", "neg")))
    w = Window.partitionBy("part").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # a row for each range
    run = dealt.join(F.broadcast(sums), "part").withColumn("tp", F.sum("pos").over(w) + F.col("before_pos")).withColumn("fp", F.sum("neg").over(w) + F.col("before_neg"))
    areas = run.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("a"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    areas = areas.select(F.lit(0).alias("_k"), F.try_divide("a", F.col("np") * F.col("nn")).alias("auc"), F.try_divide("ap", "np").alias("pr_auc"))
    return base.withColumn("_k", F.lit(0)).join(areas, "_k").drop("_k")  # one row with one row


def qa_rollup(checks: DataFrame) -> DataFrame:
    """candidate_id, overall (Fail over Warning over Pass), critical (a failed Critical check), counts by status."""
    rank = F.when(F.col("status") == "Fail", 2).when(F.col("status") == "Warning", 1).otherwise(0)
    agg = checks.groupBy("candidate_id").agg(
        F.max(rank).alias("r"), F.bool_or((F.col("status") == "Fail") & (F.col("severity") == "Critical")).alias("critical"), *(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("Pass", "Warning", "Fail"))
    )
    return agg.withColumn("overall", F.when(F.col("r") == 2, "Fail").when(F.col("r") == 1, "Warning").otherwise("Pass")).drop("r")


def render_qa_rules(probes: DataFrame) -> DataFrame:
    """One row per probe and rule: name, status. probes: candidate_id, fps, duration_s, expected_s, drift_s, lufs, silent_share, black_share."""
    verdict = lambda fail, warn=F.lit(False): F.when(fail, "Fail").when(warn, "Warning").otherwise("Pass")
    off = F.abs(F.col("lufs") + 14.0)
    rules = {
        "fps": verdict((F.col("fps") < 1) | (F.col("fps") > 120)), "duration": verdict(F.abs(F.col("duration_s") - F.col("expected_s")) > 0.5), "av_drift": verdict(F.abs("drift_s") > 0.1, F.abs("drift_s") > 0.05),
        "loudness": verdict(off > 4.0, off > 2.0), "silence": verdict(F.col("silent_share") > 0.5), "black": verdict(F.col("black_share") > 0.05),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit("Pass")).alias("status")) for k, v in rules.items()))
    return probes.select("candidate_id", F.inline(rows))


def caption_event_qa(events: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of a clip in start order with problem ``order`` or ``overlap`` (same style and layer, over 60 ms), clip tokens in no event of it)."""
    w = Window.partitionBy("clip_id").orderBy("start_ms", "end_ms")
    same = (F.lag("style").over(w) == F.col("style")) & (F.lag("layer").over(w) == F.col("layer"))
    over = same & (F.lag("end_ms").over(w) - F.col("start_ms") > 60)
    problem = F.when(F.col("end_ms") < F.col("start_ms") - 50, "order").when(F.coalesce(over, F.lit(False)), "overlap")
    said = events.select("clip_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).distinct()
    missing = words.select("clip_id", F.lower("text").alias("token")).distinct().join(said, ["clip_id", "token"], "left_anti")
    return events.withColumn("problem", problem).filter("problem is not null"), missing


def box_collisions(boxes: DataFrame, least_ms: int = 20, least_px: float = 2.0) -> DataFrame:
    """Pairs of a clip's boxes (id, start_ms, end_ms, x, y, w, h) that are seen together over least_ms and overlap by over least_px both ways."""
    pairs = interval_join_levels(boxes, boxes, ["clip_id"]).filter("id < r_id")
    both = lambda a, n: F.least(F.col(a) + F.col(n), F.col(f"r_{a}") + F.col(f"r_{n}")) - F.greatest(a, f"r_{a}")
    seen = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    return pairs.filter((seen > least_ms) & (both("x", "w") > least_px) & (both("y", "h") > least_px)).select("clip_id", F.col("id").alias("a"), F.col("r_id").alias("b"))


def feature_truth_audit(records: DataFrame, markers: dict[str, str]) -> DataFrame:
    """candidate_id, feature, verdict: a flag must hold exactly if its marker is in the render log. records: candidate_id, flags (map), log."""
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), F.element_at("flags", F.lit(k)).alias("flag"), F.contains("log", F.lit(m)).alias("found")) for k, m in markers.items()))
    out = records.select("candidate_id", F.inline(rows))
    return out.select("candidate_id", "feature", F.when(F.col("flag").isNull(), "skipped").when(F.col("flag") == F.col("found"), "ok").when(F.col("flag"), "claimed, not found").otherwise("found, not claimed").alias("verdict"))


def best_format(formats: DataFrame) -> DataFrame:
    """source, format_id with the largest area, then height, then rate, then id; higher_available: whether a taller one exists."""
    order = F.struct(F.col("height") * F.col("width"), F.col("height"), F.col("tbr"), F.col("format_id"))
    best = formats.groupBy("source").agg(F.max_by(F.struct("format_id", "height", "width"), order).alias("b"), F.max("height").alias("top"))
    return best.select("source", "b.format_id", "b.height", "b.width", (F.col("top") > F.col("b.height")).alias("higher_available"))


def audio_tracks(formats: DataFrame) -> DataFrame:
    """source, language, format_id, original of formats (source, position, format_id, language, original, dubbed, tbr): the best rate of each language.

    Of equal rates the first listed wins. Formats without a language are one track if original and one if not. A language's track is original as its first listed
    format is. A source has an original track: where none is, the first listed that is not dubbed becomes it, else the first. Null rates count as 0.
    """
    key = ["source", "language", F.when(F.col("language").isNull(), F.col("original")).alias("_apart")]
    rate = F.struct(F.coalesce("tbr", F.lit(0.0)), -F.col("position"))
    tracks = formats.groupBy(*key).agg(F.max_by("format_id", rate).alias("format_id"), F.min(F.struct("position", F.coalesce("original", F.lit(False)).alias("original"), F.coalesce("dubbed", F.lit(False)).alias("dubbed"))).alias("first"))
    # a source has one row a language here
    of = Window.partitionBy("source")
    heir = F.min(F.struct(F.col("first.dubbed"), F.col("first.position"))).over(of)["position"]
    original = F.col("first.original") | (~F.bool_or("first.original").over(of) & (F.col("first.position") == heir))
    return tracks.select("source", "language", "format_id", original.alias("original"))


def loudness_decision(measures: DataFrame, target: float = -14.0) -> DataFrame:
    """source_id, action, value of measures (integrated, silence, floor_db, mismatch_db, low_gain_db, true_peak): a gate ends all; then high-pass, denoise, balance, loudness, peak."""
    gated = (F.col("silence") > 0.80) | (F.col("integrated") < -50)
    some = lambda c, a, v: F.when(c, F.struct(F.lit(a).alias("action"), F.round(v, 6).cast("double").alias("value")))
    louder = F.abs(F.col("integrated") - target) > 1.0
    steps = F.array(
        some(F.col("low_gain_db") >= 2.0, "high_pass", F.lit(80.0)), some(F.col("floor_db") > -38, "denoise", F.lit(12.0)), some(F.col("mismatch_db") > 6, "balance", F.least(F.lit(6.0), F.col("mismatch_db") / 2)),
        some(louder, "loudness", F.lit(target) - F.col("integrated")), some(~louder & (F.col("true_peak") > -1.0), "peak_safety", F.lit(-1.0) - F.col("true_peak")),
    )
    gate = F.array(F.struct(F.lit("none").alias("action"), F.lit(0.0).alias("value")))
    return measures.select("source_id", F.inline(F.when(gated, gate).otherwise(F.array_compact(steps))))

