"""Scored windows of a source as a series: normalising, smoothing, thresholds, spans, grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import clamp, ordered
from .intervals import interval_join


def normalize_by_provider(scores: DataFrame, min_samples: int = 3) -> DataFrame:
    """raw_score as the logistic of its z-score among the source's scores of one provider; small or flat groups are clamped to 0..1."""
    w = Window.partitionBy("source_id", "provider")
    n, mean, sd = F.count("*").over(w), F.avg("raw_score").over(w), F.stddev_pop("raw_score").over(w)
    z = (F.col("raw_score") - mean) / sd
    flat = (n < min_samples) | (sd <= 1e-6)
    return scores.withColumn("score", F.when(flat, clamp(F.col("raw_score"), 0.0, 1.0)).otherwise(clamp(1 / (1 + F.exp(-z)), 0.0, 1.0)))


def degenerate_scores(scores: DataFrame) -> DataFrame:
    """source_id, distinct, sigma, spread, degenerate: a scorer that does not discriminate on raw scores."""
    agg = scores.groupBy("source_id").agg(F.count_distinct("raw_score").alias("n_distinct"), F.stddev_pop("raw_score").alias("sigma"), (F.max("raw_score") - F.min("raw_score")).alias("spread"))
    return agg.withColumn("degenerate", (F.col("n_distinct") <= 3) | (F.col("sigma") < 0.05) | (F.col("spread") < 0.10))


def gaussian_smooth(scores: DataFrame, sigma: float = 1.0, value: str = "raw_score") -> DataFrame:
    """Adds ``smoothed``: a normalised Gaussian over the neighbours within three sigma, the ends repeated. One array per source."""
    radius = math.ceil(3 * sigma) if sigma > 1e-6 else 0
    if radius == 0:
        return scores.withColumn("smoothed", F.col(value))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    total = sum(weights)
    others = [c for c in scores.columns if c not in ("source_id", "window_idx")]
    listed = scores.groupBy("source_id").agg(ordered("window_idx", *others).alias("w"))
    at = lambda i, k: F.element_at("w", (F.greatest(F.lit(0), F.least(i + k, F.size("w") - 1)) + 1).cast("int"))[value]

    def smooth(x: Column, i: Column) -> Column:
        acc = F.lit(0.0)
        for w, k in zip(weights, range(-radius, radius + 1)):
            acc = acc + F.lit(w) * at(i, k)
        return F.struct(x["window_idx"].alias("window_idx"), *(x[c].alias(c) for c in others), F.when(F.size("w") == 1, x[value]).otherwise(acc / total).alias("smoothed"))

    return listed.select("source_id", F.inline(F.transform("w", smooth)))


def otsu_threshold(scores: DataFrame, value: str = "smoothed") -> DataFrame:
    """source_id, threshold: halfway between the neighbours in value that part the scores with most variance between; ties averaged.

    A source whose scores are all equal has that score as threshold. Scores are taken as whole millionths, so sums are exact in any
    order; the threshold is rounded to millionths, halves up.
    """
    order = Window.partitionBy("source_id").orderBy("v", "window_idx")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    whole = scores.select("source_id", "window_idx", F.round(F.col(value) * 1_000_000).cast("long").alias("v"))
    rows = whole.select("source_id", "v", F.lead(v).over(order).alias("next"), F.row_number().over(order).alias("n0"), F.sum(v).over(upto).alias("s0"), F.count("*").over(every).alias("n"), F.sum(v).over(every).alias("s"), F.min(v).over(every).alias("least"))
    w0, w1 = F.col("n0") / F.col("n"), 1 - F.col("n0") / F.col("n")
    diff = (F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))) / 1_000_000
    cuts = rows.withColumn("variance", F.when(v < F.col("next"), w0 * w1 * diff * diff))
    best = F.max("variance").over(Window.partitionBy("source_id"))
    top = cuts.withColumn("cut", F.when(F.col("variance") >= best - 1e-9, v + F.col("next")))
    found = top.groupBy("source_id").agg(F.sum("cut").alias("total"), (2 * F.count("cut")).alias("k"), F.min("least").alias("least"))
    return found.select("source_id", (F.when(F.col("k") > 0, F.expr("(2 * total + k) div (2 * k)")).otherwise(F.col("least")) / 1_000_000).alias("threshold"))


def score_spans(scores: DataFrame, thresholds: DataFrame, drop: float = 0.70, value: str = "smoothed") -> DataFrame:
    """Spans of most positive score over the source's threshold (Kadane); a span ends where its excess falls below ``drop`` of its peak."""
    listed = scores.join(thresholds.select("source_id", "threshold"), "source_id").groupBy("source_id", "threshold").agg(ordered("window_idx", value, "window_start", "window_end").alias("w"))
    span = "struct<start_ms:bigint,end_ms:bigint>"
    start = F.expr(
        f"named_struct('spans', cast(array() as array<{span}>), 'sum', 0d, 'top', 0d, 'begin', cast(null as bigint), 'end', cast(null as bigint), 'peak', 0d, 'last', cast(null as bigint))"
    )

    def state(spans, total, top, begin, end, peak, last):
        return F.struct(spans.alias("spans"), total.cast("double").alias("sum"), top.cast("double").alias("top"), begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end"), peak.cast("double").alias("peak"), last.cast("bigint").alias("last"))

    def push(acc, end):
        return F.when(acc["top"] > 0, F.concat(acc["spans"], F.array(F.struct(acc["begin"].alias("start_ms"), end.alias("end_ms"))))).otherwise(acc["spans"])

    none, zero = F.lit(None), F.lit(0.0)

    def step(acc: Column, x: Column) -> Column:
        y = x[value] - F.col("threshold")
        excess = F.greatest(y, zero)
        opened = acc["begin"].isNull()
        peak = F.greatest(F.when(opened, excess).otherwise(acc["peak"]), excess)
        valley = (peak > 0) & (excess < peak * drop) & ~opened
        fresh = state(push(acc, acc["last"]), y, excess, F.when(y > 0, x["window_start"]), x["window_end"], excess, x["window_end"])
        total = acc["sum"] + y
        higher = total > acc["top"]
        going = state(acc["spans"], total, F.when(higher, total).otherwise(acc["top"]), F.coalesce(acc["begin"], x["window_start"]), F.when(higher, x["window_end"]).otherwise(acc["end"]), peak, x["window_end"])
        closed = state(F.when(opened, acc["spans"]).otherwise(push(acc, acc["end"])), zero, zero, none, acc["end"], zero, x["window_end"])
        return F.when(total > 0, F.when(valley, fresh).otherwise(going)).otherwise(closed)

    found = F.aggregate("w", start, step, lambda acc: F.when(acc["begin"].isNotNull(), push(acc, acc["end"])).otherwise(acc["spans"]))
    return listed.select("source_id", F.inline(found))


def windows_to_spans(scores: DataFrame, sigma: float = 1.0, min_score: float = 0.35, multiplier: float = 1.0, drop: float = 0.70) -> DataFrame:
    """Smooth, threshold (flat series: min_score alone), spans."""
    smooth = gaussian_smooth(scores, sigma).withColumn("smoothed", F.round("smoothed", 6))
    flat = smooth.groupBy("source_id").agg((F.max("smoothed") - F.min("smoothed") <= 1e-9).alias("flat"))
    tau = otsu_threshold(smooth).join(flat, "source_id").select("source_id", F.round(F.when(F.col("flat"), F.lit(min_score)).otherwise(F.greatest(F.col("threshold") * multiplier, F.lit(min_score))), 6).alias("threshold"))
    return score_spans(smooth, tau, drop)


def adaptive_cuts(diffs: DataFrame, ratio: float = 3.0, least: float = 15.0, spacing: int = 12, fps: float = 30.0) -> DataFrame:
    """Cut times of frame differences (source_id, frame, diff): at least ``least``, ``ratio`` times the mean of five frames, ``spacing`` frames apart."""
    w = Window.partitionBy("source_id").orderBy("frame")
    mean = F.avg("diff").over(w.rowsBetween(-2, 2))
    hot = diffs.withColumn("hot", (F.col("diff") >= least) & (F.col("diff") / (mean + 1e-5) >= ratio)).filter("hot")
    listed = hot.groupBy("source_id").agg(F.sort_array(F.collect_list(F.col("frame").cast("bigint"))).alias("f"))
    kept = F.aggregate("f", F.expr("cast(array() as array<bigint>)"), lambda acc, f: F.when((F.size(acc) == 0) | (f - F.element_at(acc, -1) >= spacing), F.concat(acc, F.array(f))).otherwise(acc))
    return listed.select("source_id", F.explode(kept).alias("frame")).withColumn("cut_ms", F.round((F.col("frame") + 1) * 1000 / fps).cast("long"))


def coverage_windows(sources: DataFrame, size_ms: int, overlap_ms: int) -> DataFrame:
    """Sliding windows over sources (source_id, duration_ms), a step of 60 s at least, the last one anchored to the end."""
    step = max(size_ms - overlap_ms, 60_000)
    d = F.col("duration_ms")
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(d / step)).cast("int")), lambda k: (k * step).cast("bigint")), lambda s: (s == 0) | ((s * 5 + 2 * size_ms < d * 5) & (s - step + size_ms < d)))
    listed = sources.withColumn("starts", starts).withColumn("last", F.element_at("starts", -1))
    anchored = (F.col("last") + size_ms < d) & (d - size_ms > F.col("last"))
    listed = listed.withColumn("starts", F.when(anchored, F.concat("starts", F.array((d - size_ms).cast("bigint")))).otherwise(F.col("starts")))
    out = listed.select("source_id", "duration_ms", F.posexplode("starts").alias("window_idx", "window_start"))
    return out.withColumn("window_end", F.least(F.col("window_start") + size_ms, F.col("duration_ms"))).drop("duration_ms")


def tiered_windows(sources: DataFrame) -> DataFrame:
    """Coverage windows by duration: 8 min with 90 s overlap, 10 min with 2 min over 45 min, 90 s with 15 s over two hours."""
    d = F.col("duration_ms")
    tiers = [(sources.filter(d <= 2_700_000), 480_000, 90_000), (sources.filter((d > 2_700_000) & (d <= 7_200_000)), 600_000, 120_000), (sources.filter(d > 7_200_000), 90_000, 15_000)]
    parts = [coverage_windows(*t) for t in tiers]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fixed_grid(sources: DataFrame, step_ms: int = 1000) -> DataFrame:
    """source_id, t_ms, end_ms: steps from 0 to the duration, the last one short."""
    out = sources.filter("duration_ms > 0").withColumn("t_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("duration_ms") - 1, F.lit(step_ms).cast("bigint"))))
    return out.select("source_id", "t_ms", F.least(F.col("t_ms") + step_ms, F.col("duration_ms")).alias("end_ms"))


def midpoints(spans: DataFrame, max_frames: int = 8) -> DataFrame:
    """Spans with ``t_ms``: n points in the middle of equal parts; n grows with the duration in steps."""
    d = F.col("end_ms") - F.col("start_ms")
    n = F.when(d <= 15_000, min(max_frames, 6)).when(d <= 60_000, max_frames).when(d <= 180_000, min(max(max_frames, 12), 20)).otherwise(min(max(max_frames, 16), 20))
    out = spans.filter(d > 0).withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn("t_ms", F.round(F.col("start_ms") + (F.col("_i") + 0.5) * (d / F.col("_n"))).cast("long")).drop("_n", "_i")


def tiles(spans: DataFrame, max_ms: int = 75_000, least_ms: int = 15_000, short_ms: int = 8_000) -> DataFrame:
    """Spans of at most max_ms as they are, longer ones in overlapping tiles of at least least_ms; under short_ms dropped."""
    step = max(max_ms - 15_000, 45_000)
    d = F.col("end_ms") - F.col("start_ms")
    offsets = F.when(d <= max_ms, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(d - 1, F.lit(0)).cast("bigint"), F.lit(step).cast("bigint")))
    # the tile that reaches the end is the last one
    offsets = F.filter(offsets, lambda o: (o == 0) | (o - step + max_ms < d))
    out = spans.filter(d >= short_ms).withColumn("_o", F.explode(offsets)).withColumn("_s", F.col("start_ms") + F.col("_o"))
    out = out.withColumn("_e", F.least(F.col("_s") + max_ms, F.col("end_ms"))).filter((F.col("end_ms") - F.col("start_ms") <= max_ms) | (F.col("_e") - F.col("_s") >= least_ms))
    return out.withColumn("start_ms", F.col("_s")).withColumn("end_ms", F.col("_e")).drop("_o", "_s", "_e")


def rank_regions(spans: DataFrame, smoothed: DataFrame, k: int = 4) -> DataFrame:
    """The k spans of each source with the best mean smoothed score of the windows they overlap (0 without any)."""
    # whole millionths, so that means do not depend on the order of the sum; means are rounded to millionths, halves up
    windows = smoothed.select("source_id", F.round(F.col("smoothed") * 1_000_000).cast("long").alias("v"), "window_start", "window_end")
    sums = interval_join(spans, windows, right_span=("window_start", "window_end"), bucket_ms=600_000).groupBy("source_id", "start_ms", "end_ms").agg(F.sum("r_v").alias("total"), F.count("*").alias("n"))
    means = sums.select("source_id", "start_ms", "end_ms", (F.expr("(2 * total + n) div (2 * n)") / 1_000_000).alias("mean"))
    all_spans = spans.select("source_id", "start_ms", "end_ms").join(means, ["source_id", "start_ms", "end_ms"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("mean").desc(), "start_ms", "end_ms"))
    return all_spans.withColumn("rank", rank).filter(F.col("rank") <= k)


def spans_to_candidates(spans: DataFrame, scores: DataFrame, words: DataFrame) -> DataFrame:
    """Tiled spans with hook (first ten words), payoff (last ten), and the best window score; spans without words are dropped."""
    cut = tiles(spans.select("source_id", "start_ms", "end_ms")).distinct()
    text = interval_join(cut, words.select("source_id", "word_idx", "text", "start_ms", "end_ms"), mode="closed")
    grouped = text.groupBy("source_id", "start_ms", "end_ms").agg(ordered("r_start_ms", "r_word_idx", "r_end_ms", "r_text").alias("w"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x["r_text"]), " ")
    hook, payoff = F.slice("w", 1, 10), F.slice("w", F.greatest(F.size("w") - 9, F.lit(1)), F.lit(10))
    drafts = grouped.select(
        "source_id", "start_ms", "end_ms", join(hook).alias("hook"), F.col("w")[0]["r_start_ms"].alias("hook_start"), F.element_at(hook, -1)["r_end_ms"].alias("hook_end"),
        join(payoff).alias("payoff_text"), payoff[0]["r_start_ms"].alias("payoff_start"), F.element_at("w", -1)["r_end_ms"].alias("payoff_end"),
    )
    best = interval_join(cut, scores.select("source_id", "raw_score", "window_start", "window_end"), mode="closed", right_span=("window_start", "window_end")).groupBy("source_id", "start_ms", "end_ms").agg(clamp(F.max("r_raw_score"), 0.0, 1.0).alias("score"))
    return drafts.join(best, ["source_id", "start_ms", "end_ms"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
