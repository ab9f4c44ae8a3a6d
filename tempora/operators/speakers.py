"""Speaker statistics, roles, identity matching, active-speaker fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import half_up, joined, ordered
from ..functions.text import normalize_token
from ..functions.windows import by_time, so_far
from .intervals import BUCKET_MS, interval_join, interval_join_levels
from .islands import merge_states

# Words that open a question.
QUESTION_WORDS = [
    "what", "why", "how", "who", "when", "where", "which", "whose", "is", "are", "do", "does", "did", "can", "could", "would", "will", "should",
    "have", "has", "any", "tell", "describe", "explain",
]


def speaker_stats(segments: DataFrame) -> DataFrame:
    """source_id, speaker, total_ms, n_segments, avg_confidence."""
    return segments.groupBy("source_id", "speaker").agg(
        F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("total_ms"), F.count("*").alias("n_segments"), F.avg("confidence").alias("avg_confidence")
    )


def question_stats(words: DataFrame) -> DataFrame:
    """source_id, speaker, turns, question_turns, interrogative_starts of speaker turns (null speaker: S1)."""
    named = words.withColumn("speaker", F.coalesce("speaker", F.lit("S1")))
    breaks = F.coalesce(F.lag("speaker").over(by_time()) != F.col("speaker"), F.lit(False))
    turns = named.withColumn("_b", breaks.cast("int")).withColumn("_t", F.sum("_b").over(so_far())).groupBy("source_id", "_t").agg(
        F.first("speaker").alias("speaker"), F.bool_or(F.col("text").contains("?")).alias("asks"), F.min_by("text", F.struct("start_ms", "word_idx")).alias("first")
    )
    opens = normalize_token(F.col("first")).isin(QUESTION_WORDS)
    return turns.groupBy("source_id", "speaker").agg(F.count("*").alias("turns"), F.count_if("asks").alias("question_turns"), F.count_if(opens).alias("interrogative_starts"))


def speaker_roles(segments: DataFrame, questions: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """source_id, speaker, role (host, guest, unknown), confidence, speaking_share, is_first, asks_most.

    overrides: source_id, speaker, role. Of exactly two speakers, an unknown one takes the other role of a resolved one.
    """
    w = Window.partitionBy("source_id")
    stats = segments.groupBy("source_id", "speaker").agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("own"), F.min(F.struct("start_ms", "end_ms")).alias("first"))
    joined_ = stats.join(questions, ["source_id", "speaker"], "left")
    q = F.coalesce(F.col("question_turns") + F.col("interrogative_starts") / 3.0, F.lit(0.0))
    rows = joined_.withColumn("q", q).withColumn("other_q", F.sum("q").over(w) - F.col("q")).withColumn("total", F.sum("own").over(w)).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("is_first", F.col("first") == F.min("first").over(w)).withColumn("asks_most", (F.col("q") > 0) & (F.col("q") > F.col("other_q") + 1e-9))
    margin = F.when(F.col("total") > 0, F.greatest((2 * F.col("own") - F.col("total")) / F.col("total"), F.lit(0.0))).otherwise(0.0)
    host = F.when(F.col("asks_most"), 0.7).otherwise(0.0) + F.when(F.col("q") >= 3.0, 0.2).otherwise(0.0) + F.when(F.col("is_first"), 0.3).otherwise(0.0)
    rows = rows.withColumn("host", F.round(host, 6)).withColumn("guest", F.round(0.4 * margin, 6))
    rule = (
        F.when(F.col("n") == 1, F.struct(F.lit("host").alias("role"), F.lit(0.6).alias("confidence")))
        .when(F.col("host") >= 0.85, F.struct(F.lit("host").alias("role"), F.least(F.lit(0.95), "host").alias("confidence")))
        .when((F.col("host") > F.col("guest") + 0.15) & (F.col("host") >= 0.5), F.struct(F.lit("host").alias("role"), F.least(F.lit(0.85), "host").alias("confidence")))
        .when((F.col("guest") > F.col("host") + 0.15) & (F.col("guest") >= 0.5), F.struct(F.lit("guest").alias("role"), F.lit(0.6).alias("confidence")))
        .otherwise(F.struct(F.lit("unknown").alias("role"), F.lit(0.3).alias("confidence")))
    )
    rows = rows.withColumn("r", rule)
    if overrides is not None:
        rows = rows.join(overrides.withColumnRenamed("role", "forced"), ["source_id", "speaker"], "left")
        rows = rows.withColumn("r", F.when(F.col("forced").isNotNull(), F.struct(F.col("forced").alias("role"), F.lit(1.0).alias("confidence"))).otherwise(F.col("r")))
    resolved = F.max(F.when((F.col("r.role") != "unknown") & (F.col("r.confidence") >= 0.7), F.col("r.role"))).over(w)
    opposite = F.when(resolved == "host", "guest").when(resolved == "guest", "host")
    complemented = (F.col("n") == 2) & (F.col("r.role") == "unknown") & opposite.isNotNull()
    return rows.select(
        "source_id", "speaker", F.when(complemented, opposite).otherwise(F.col("r.role")).alias("role"), F.when(complemented, F.lit(0.7)).otherwise(F.col("r.confidence")).alias("confidence"),
        F.when(F.col("total") > 0, F.col("own") / F.col("total")).otherwise(0.0).alias("speaking_share"), "is_first", "asks_most",
    )


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def gallery_match(tracks: DataFrame, gallery: DataFrame, threshold: float = 0.7, on: list[str] | None = None) -> DataFrame:
    """Each track's most similar gallery entry of its own source (or other key) at or over the threshold: track_id, match_id, similarity.

    A gallery belongs to a source, so the join is on that key; the best of a track is one aggregate.
    """
    on = on or ["source_id"]
    pairs = tracks.join(gallery.select(*on, "gallery_id", F.col("embedding").alias("g")), on).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("g")), 6))
    best = pairs.filter(F.col("similarity") >= threshold).groupBy(*on, "track_id").agg(F.max(F.struct("similarity", (-F.col("gallery_id")).alias("k"))).alias("b"))
    return best.select(*on, "track_id", (-F.col("b.k")).alias("match_id"), F.col("b.similarity").alias("similarity"))


def ema_gallery(embeddings: DataFrame, alpha: float = 0.9) -> DataFrame:
    """track_id, embedding (exponential mean in order of seq, renormalised each time), n, first_seen, last_seen."""
    listed = embeddings.groupBy("track_id").agg(ordered("seq", "embedding").alias("e"), F.count("*").alias("n"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"))
    unit = lambda v: F.transform(v, lambda x: F.try_divide(x, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))))
    vectors = F.transform("e", lambda x: x["embedding"].cast("array<double>"))
    from ..functions.fold import let

    step = lambda acc, v: let(F.zip_with(acc, v, lambda a, x: alpha * a + (1 - alpha) * x), lambda m: let(F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, y: s + y * y)), lambda n: F.transform(m, lambda x: F.try_divide(x, n))))
    start = let(F.element_at(vectors, 1), lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), lambda n: F.transform(v, lambda x: F.try_divide(x, n))))
    return listed.select("track_id", F.aggregate(F.slice(vectors, F.lit(2), F.size(vectors)), start, step).alias("embedding"), "n", "first_seen", "last_seen")


def speaking_evidence(segments: DataFrame, detections: DataFrame) -> DataFrame:
    """source_id, speaker, track_id, evidence: the motion of a track while a speaker speaks, summed over the speaker's segments, where over 0.1."""
    points = detections.select("source_id", "track_id", "motion", F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms"))
    pairs = interval_join(points, segments.select("source_id", "speaker", "start_ms", "end_ms"), mode="closed", bucket_ms=3_600_000)
    return pairs.groupBy("source_id", F.col("r_speaker").alias("speaker"), "track_id").agg(F.sum("motion").alias("evidence")).filter(F.round("evidence", 6) > 0.1)


def greedy_one_to_one(pairs: DataFrame, a: str, b: str, weight: str, on: list[str] | None = None) -> DataFrame:
    """The pairs taken best first, each a and b once per key; ties by a, then b. A fold over the key's pairs in the JVM."""
    on = on or ["source_id"]
    listed = pairs.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")))).alias("p"))
    kind = "struct<w:double,a:string,b:string>"
    taken = F.aggregate("p", F.expr(f"cast(array() as array<{kind}>)"), lambda acc, x: F.when(F.exists(acc, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"])), acc).otherwise(F.concat(acc, F.array(x.cast(kind)))))
    out = listed.select(*on, F.explode(taken).alias("t"))
    kinds = dict(pairs.dtypes)
    return out.select(*on, F.col("t.a").cast(kinds[a]).alias(a), F.col("t.b").cast(kinds[b]).alias(b), (-F.col("t.w")).alias(weight))


def bind_speakers_to_tracks(segments: DataFrame, detections: DataFrame) -> DataFrame:
    evidence = speaking_evidence(segments, detections).withColumn("evidence", F.round("evidence", 6))
    return greedy_one_to_one(evidence, "speaker", "track_id", "evidence")


def fuse_active_speaker(grid: DataFrame, audio: DataFrame, visual: DataFrame, bindings: DataFrame, on_ms: float = 0.5, off_ms: float = 0.35, cooldown_ms: int = 1000, step_ms: int = 1000) -> DataFrame:
    """States of every track on a grid of steps: audio (bound speaker's overlap × confidence), visual (.7 max + .3 mean motion), .6/.4; times .3 if only
    one of both speaks for it while another speaker is heard. Hysteresis with a cooldown after each change; then neighbouring states are merged.

    grid: source_id, t_ms, end_ms. audio: segments with confidence. visual: detections. bindings: source_id, speaker, track_id.
    """
    cells = grid.select("source_id", F.col("t_ms").alias("start_ms"), "end_ms")
    heard = interval_join(cells, audio.join(bindings, ["source_id", "speaker"]).select("source_id", "track_id", "confidence", "start_ms", "end_ms"), bucket_ms=max(BUCKET_MS, step_ms))
    share = (F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")) / (F.col("end_ms") - F.col("start_ms"))
    a = heard.groupBy("source_id", "start_ms", "end_ms", F.col("r_track_id").alias("track_id")).agg(F.least(F.lit(1.0), F.sum(share) * F.max("r_confidence")).alias("audio"))
    seen_at = visual.select("source_id", "track_id", "motion", (F.floor(F.col("t_ms") / step_ms) * step_ms).alias("start_ms"))
    v = seen_at.groupBy("source_id", "start_ms", "track_id").agg((0.7 * F.max("motion") + 0.3 * F.avg("motion")).alias("visual"))
    # a grid packs to almost nothing, so Spark would broadcast it whole
    both = a.join(v, ["source_id", "start_ms", "track_id"], "full").join(cells.withColumnRenamed("end_ms", "cell_end").hint("merge"), ["source_id", "start_ms"])
    both = both.withColumn("audio", F.coalesce("audio", F.lit(0.0))).withColumn("visual", F.coalesce("visual", F.lit(0.0)))
    loudest = F.max("audio").over(Window.partitionBy("source_id", "start_ms"))
    conflict = (F.col("visual") > 0.5) & (F.col("audio") < 0.1) & (loudest > 0.5)
    raw = 0.6 * F.col("audio") + 0.4 * F.col("visual")
    scored = both.withColumn("p", half_up(F.when(conflict, raw * 0.3).otherwise(raw)))
    listed = scored.groupBy("source_id", "track_id").agg(ordered("start_ms", "cell_end", "p").alias("s"))
    kind = "struct<start_ms:bigint,end_ms:bigint,speaking:boolean,confidence:double>"
    start = F.expr(f"named_struct('out', cast(array() as array<{kind}>), 'on', false, 'since', cast(-1000000000000 as bigint))")

    def step(acc: Column, x: Column) -> Column:
        rested = x["start_ms"] - acc["since"] >= cooldown_ms
        now = F.when(rested & ~acc["on"] & (x["p"] >= on_ms), F.lit(True)).when(rested & acc["on"] & (x["p"] < off_ms), F.lit(False)).otherwise(acc["on"])
        state = F.struct(x["start_ms"].alias("start_ms"), x["cell_end"].alias("end_ms"), now.alias("speaking"), x["p"].alias("confidence"))
        return F.struct(F.concat(acc["out"], F.array(state)).alias("out"), now.alias("on"), F.when(now != acc["on"], x["start_ms"]).otherwise(acc["since"]).alias("since"))

    states = listed.select("source_id", "track_id", F.inline(F.aggregate("s", start, step, lambda acc: acc["out"])))
    return merge_states(states)


def fusion_for_window(states: DataFrame, windows: DataFrame, least: float = 0.5) -> DataFrame:
    """Per window and track the most confident speaking state that overlaps it: source_id, window_idx, track_id, confidence."""
    good = states.filter(F.col("speaking") & (F.col("confidence") >= least))
    pairs = interval_join_levels(windows, good.select("source_id", "track_id", "confidence", "start_ms", "end_ms"))
    return pairs.groupBy("source_id", "window_idx", F.col("r_track_id").alias("track_id")).agg(F.max("r_confidence").alias("confidence"))


def argmax_timeline(states: DataFrame, grid: DataFrame, least: float = 0.5) -> DataFrame:
    """The most probable track at each grid instant (over ``least``; ties to the lower id), only where it changes."""
    points = grid.select("source_id", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 1).alias("end_ms"))
    pairs = interval_join_levels(points, states.filter(F.col("confidence") >= least).select("source_id", "track_id", "confidence", "start_ms", "end_ms"))
    best = pairs.groupBy("source_id", F.col("start_ms").alias("t_ms")).agg(F.min(F.struct((-F.col("r_confidence")).alias("c"), F.col("r_track_id").alias("track_id"))).alias("b"))
    w = Window.partitionBy("source_id").orderBy("t_ms")
    return best.select("source_id", "t_ms", F.col("b.track_id").alias("track_id")).withColumn("_p", F.lag("track_id").over(w)).filter("_p is null or _p <> track_id").drop("_p")


def switch_metrics(truth: DataFrame, got: DataFrame, tolerance_ms: int = 1500) -> DataFrame:
    """Per source: matched switches (greedy nearest, one to one), precision, recall, f1, mean latency, identity errors. Both: source_id, switch_id, t_ms, speaker."""
    t = truth.select("source_id", "switch_id", "speaker", F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms"))
    g = got.select("source_id", "switch_id", "speaker", F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms"))
    pairs = interval_join_levels(t, g, mode="closed", tolerance_ms=tolerance_ms).withColumn("w", -F.abs(F.col("start_ms") - F.col("r_start_ms")).cast("double"))
    matched = greedy_one_to_one(pairs, "switch_id", "r_switch_id", "w").withColumnRenamed("r_switch_id", "got_id")
    named = matched.join(truth.select("source_id", "switch_id", F.col("speaker").alias("ts"), F.col("t_ms").alias("tt")), ["source_id", "switch_id"]).join(got.select("source_id", F.col("switch_id").alias("got_id"), F.col("speaker").alias("gs"), F.col("t_ms").alias("gt")), ["source_id", "got_id"])
    m = named.groupBy("source_id").agg(F.count("*").alias("matched"), F.avg(F.abs(F.col("tt") - F.col("gt"))).alias("latency_ms"), F.count_if(F.col("ts") != F.col("gs")).alias("identity_errors"))
    n = truth.groupBy("source_id").agg(F.count("*").alias("n_truth")).join(got.groupBy("source_id").agg(F.count("*").alias("n_got")), "source_id", "full").join(m, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = n.withColumn("matched", zero("matched")).withColumn("n_truth", zero("n_truth")).withColumn("n_got", zero("n_got")).withColumn("identity_errors", zero("identity_errors"))
    precision, recall = F.try_divide("matched", "n_got"), F.try_divide("matched", "n_truth")
    return n.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def turn_text(words: DataFrame) -> DataFrame:
    """source_id, speaker, text of each speaker's words in order."""
    return words.groupBy("source_id", "speaker").agg(joined(["start_ms", "word_idx"], "text").alias("text"))
