"""Gap-and-island sessionization of words: segments, turns, sentences, cues, chunks, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import joined, ordered
from ..functions.text import CONJUNCTIONS, SUPPORTING_TERMS, ends_clause, ends_sentence, normalize_token
from ..functions.windows import by_time, so_far



def _numbered(words: DataFrame, breaks: Column, name: str) -> DataFrame:
    """Rows with the number (from 0) of the island they are in; a null break is none."""
    return words.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("_b").over(so_far())).drop("_b")


def _text() -> Column:
    return joined(["start_ms", "word_idx"], "text").alias("text")


def segments(words: DataFrame, pause_ms: int = 850) -> DataFrame:
    """Segments end at a longer pause, a change of speaker (null equals null) or a sentence end."""
    breaks = (F.col("start_ms") - F.lag("end_ms").over(by_time()) > pause_ms) | ~F.lag("speaker").over(by_time()).eqNullSafe(F.col("speaker")) | F.lag(ends_sentence(F.col("text"))).over(by_time())
    first = F.lag("word_idx").over(by_time()).isNull()
    islands = _numbered(words, ~first & breaks, "segment_idx")
    return islands.groupBy("source_id", "segment_idx").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "word_idx")).alias("end_ms"), F.first("speaker").alias("speaker"), F.count("*").alias("n_words"), _text()
    )


def speaker_turns(words: DataFrame) -> DataFrame:
    """Turns end at a change of speaker; a null speaker is S1."""
    named = words.withColumn("speaker", F.coalesce("speaker", F.lit("S1")))
    return _numbered(named, F.lag("speaker").over(by_time()) != F.col("speaker"), "turn_idx").groupBy("source_id", "turn_idx").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "word_idx")).alias("end_ms"), F.first("speaker").alias("speaker"), F.count("*").alias("n_words")
    ).filter("start_ms < end_ms")


def diar_segments(words: DataFrame, gap_ms: int = 450, skip_null: bool = False, confidence: float = 0.95) -> DataFrame:
    """Runs of one speaker without a gap over gap_ms from the run's end so far. A null speaker closes the run, or is skipped.

    Every step is a window in time order over the source, so words are sorted once: the run's end so far is the largest (run, end) before a word,
    if it is of the word's run.
    """
    if skip_null:
        words = words.filter("speaker is not null")
    runs = _numbered(words, ~F.lag("speaker").over(by_time()).eqNullSafe(F.col("speaker")), "_run")
    reach = F.max(F.struct("_run", "end_ms")).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    split = runs.withColumn("_reach", reach).withColumn("_b", (F.col("_reach._run") == F.col("_run")) & (F.col("start_ms") - F.col("_reach.end_ms") > gap_ms))
    parts = _numbered(split, F.col("_b"), "_part").filter("speaker is not null")
    return parts.groupBy("source_id", "_run", "_part", "speaker").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).select("source_id", "speaker", "start_ms", "end_ms", F.lit(confidence).alias("confidence"))


def merge_adjacent(segments_: DataFrame, gap_ms: int = 500) -> DataFrame:
    """Neighbouring segments of one speaker within the gap as one; confidence is averaged pair by pair in time order."""
    w = Window.partitionBy("source_id").orderBy("start_ms", "end_ms")
    breaks = (F.lag("speaker").over(w) != F.col("speaker")) | (F.col("start_ms") - F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap_ms)
    islands = segments_.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("_i", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    confs = F.transform(ordered("start_ms", "end_ms", "confidence"), lambda x: x["confidence"])
    averaged = F.aggregate(F.slice(confs, F.lit(2), F.size(confs)), F.element_at(confs, 1).cast("double"), lambda a, c: (a + c) / 2)
    return islands.groupBy("source_id", "_i").agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), averaged.alias("confidence")).drop("_i")


def sentences(words: DataFrame) -> DataFrame:
    """Sentences end with a terminator; ``complete`` is false for the rest at a source's end."""
    ends = ends_sentence(F.col("text"))
    islands = _numbered(words, F.lag(ends).over(by_time()), "sentence_idx")
    return islands.groupBy("source_id", "sentence_idx").agg(
        F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.max_by(ends, F.struct("start_ms", "word_idx")).alias("complete"),
    )


def _hard_islands(words: DataFrame, breaks: Column) -> DataFrame:
    return _numbered(words, breaks, "_island")


def cues(words: DataFrame, gap_ms: int = 400, max_words: int = 8) -> DataFrame:
    """Clauses: they end at punctuation, a gap of gap_ms or more, a change between known speakers, or after max_words."""
    # a null speaker compares as null, which is no break, but the other tests still count
    breaks = F.coalesce(F.lag(ends_clause(F.col("text"))).over(by_time()), F.lit(False)) | F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by_time()) >= gap_ms, F.lit(False)) | F.coalesce(F.lag("speaker").over(by_time()) != F.col("speaker"), F.lit(False))
    # a word's place in its island is its place in the source less that of the island's first word: one order serves all
    placed = _hard_islands(words, breaks).withColumn("_n", F.row_number().over(by_time())).withColumn("_opens", F.coalesce(F.lag("_island").over(by_time()) != F.col("_island"), F.lit(True)))
    first = F.max(F.when(F.col("_opens"), F.col("_n"))).over(so_far())
    parts = placed.withColumn("_part", F.floor((F.col("_n") - first) / max_words))
    grouped = parts.groupBy("source_id", "_island", "_part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), _text())
    order = Window.partitionBy("source_id").orderBy("_island", "_part")
    return grouped.withColumn("cue_idx", F.row_number().over(order) - 1).drop("_island", "_part")


def _folded_chunks(islands: DataFrame, closes) -> DataFrame:
    """Chunks inside hard islands by a fold: ``closes(n, first, word)`` tells whether the chunk ends with this word (n words with it)."""
    words = ordered("start_ms", "word_idx", "end_ms", "text")
    grouped = islands.groupBy("source_id", "_island").agg(words.alias("w"))
    kind = "struct<first_idx:bigint,last_idx:bigint,start_ms:bigint,end_ms:bigint,n_words:int>"
    start = F.expr(f"named_struct('done', cast(array() as array<{kind}>), 'n', 0, 'first', cast(null as bigint), 'start', cast(null as bigint))")

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        first, begin = F.coalesce(acc["first"], x["word_idx"]), F.coalesce(acc["start"], x["start_ms"])
        chunk = F.struct(first.alias("first_idx"), x["word_idx"].alias("last_idx"), begin.alias("start_ms"), x["end_ms"].alias("end_ms"), n.alias("n_words"))
        closed = F.struct(F.concat(acc["done"], F.array(chunk)).alias("done"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("start"))
        going = F.struct(acc["done"].alias("done"), n.alias("n"), first.alias("first"), begin.alias("start"))
        return F.when(closes(n, begin, x), closed).otherwise(going)

    last = F.element_at("w", -1)
    rest = lambda acc: F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first_idx"), last["word_idx"].alias("last_idx"), acc["start"].alias("start_ms"), last["end_ms"].alias("end_ms"), acc["n"].alias("n_words")))))
    return grouped.select("source_id", F.inline(F.aggregate("w", start, step, rest)))


def caption_chunks(words: DataFrame, pause_ms: int = 400, max_words: int = 5, comma_words: int = 2, max_ms: int = 2500) -> DataFrame:
    """Chunks end after a pause, a sentence end, max_words, or from comma_words on at a comma or over max_ms."""
    breaks = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by_time()) > pause_ms, F.lit(False)) | F.coalesce(F.lag(ends_sentence(F.col("text"))).over(by_time()), F.lit(False))
    comma = lambda x: F.trim(x["text"]).endswith(",")
    return _folded_chunks(_hard_islands(words, breaks), lambda n, begin, x: (n >= max_words) | ((n >= comma_words) & (comma(x) | (x["end_ms"] - begin > max_ms))))


def speech_chunks(words: DataFrame, boundaries: DataFrame, max_words: int = 5, pause_ms: int = 350, p_soft: float = 0.65, max_ms: int = 3000) -> DataFrame:
    """Chunks that end after a sentence or a comma, before a pause over pause_ms, and before a word that would make them too many or too long.

    Tokens without a letter or digit are left out. boundaries (source_id, word_idx before the gap, p_boundary): a likely one softens
    the pause to 0.6 of itself, 900 ms at most.
    """
    kept = words.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("_before", F.lag("word_idx").over(by_time()))
    with_p = kept.join(boundaries.select("source_id", F.col("word_idx").alias("_before"), "p_boundary"), ["source_id", "_before"], "left")
    limit = F.when(F.col("p_boundary") >= p_soft, F.lit(min(0.6 * pause_ms, 900.0))).otherwise(F.lit(float(pause_ms)))
    last = F.lag("text").over(by_time())
    breaks = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by_time()) > limit, F.lit(False)) | F.coalesce(ends_sentence(last) | last.endswith(","), F.lit(False))
    grouped = _hard_islands(with_p, breaks).groupBy("source_id", "_island").agg(ordered("start_ms", "word_idx", "end_ms").alias("w"))
    chunk = lambda first, start, x, n: F.struct(first.alias("first_idx"), x["word_idx"].alias("last_idx"), start.alias("start_ms"), x["end_ms"].alias("end_ms"), n.alias("n_words"))

    def step(done: Column, x: Column) -> Column:
        now = F.try_element_at(done, F.lit(-1))
        opens = now.isNull() | (now["n_words"] >= max_words) | (x["end_ms"] - now["start_ms"] > max_ms)
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(chunk(now["first_idx"], now["start_ms"], x, now["n_words"] + 1)))
        return F.when(opens, F.concat(done, F.array(chunk(x["word_idx"], x["start_ms"], x, F.lit(1))))).otherwise(longer)

    start = F.expr("cast(array() as array<struct<first_idx:bigint,last_idx:bigint,start_ms:bigint,end_ms:bigint,n_words:int>>)")
    return grouped.select("source_id", F.inline(F.aggregate("w", start, step)))


def phrase_units(chunks: DataFrame, pause_ms: int = 350, max_ms: int = 4000, max_words: int = 8) -> DataFrame:
    """Neighbouring chunks paired greedily unless a pause, or their joint length, forbids it; a chunk is used once.

    Whether two neighbours may pair does not depend on earlier pairs, so within a run of such neighbours every odd one takes the next.
    """
    w = Window.partitionBy("source_id").orderBy("start_ms", "first_idx")
    may = (F.lead("start_ms").over(w) - F.col("end_ms") <= pause_ms) & (F.lead("end_ms").over(w) - F.col("start_ms") <= max_ms) & (F.lead("n_words").over(w) + F.col("n_words") <= max_words) & ~F.coalesce(F.col("ends_sentence"), F.lit(False))
    marked = chunks.withColumn("_may", F.coalesce(may, F.lit(False)))
    run = marked.withColumn("_b", (~F.coalesce(F.lag("_may").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("source_id", "_run").orderBy("start_ms", "first_idx")
    unit = run.withColumn("_unit", F.floor((F.row_number().over(inside) - 1) / 2))
    return unit.groupBy("source_id", "_run", "_unit").agg(
        F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words")
    ).drop("_run", "_unit")


def line_break_hints(words: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """source_id, word_idx of the words after which a line is best broken: those that end a clause or a span (source_id, last_idx), and those before a conjunction that does neither."""
    ends = words.join(spans.select("source_id", F.col("last_idx").alias("word_idx"), F.lit(True).alias("_ends")).distinct(), ["source_id", "word_idx"], "left") if spans is not None else words.withColumn("_ends", F.lit(None).cast("boolean"))
    after = F.coalesce(F.col("_ends"), F.lit(False)) | F.coalesce(F.col("text").rlike("[,;:]$") | ends_sentence(F.col("text")), F.lit(False))
    before = F.coalesce(normalize_token(F.col("text")).isin(CONJUNCTIONS), F.lit(False)) & (F.col("word_idx") > 0)
    return ends.select("source_id", F.when(after, F.col("word_idx")).when(before, F.col("word_idx") - 1).alias("word_idx")).filter("word_idx is not null").distinct()


def wrap_lines(chunk_words: DataFrame, max_per_line: int = 3, lines: int = 2, hints: DataFrame | None = None) -> DataFrame:
    """chunk words (source_id, chunk_idx, word_idx, text) → line_1, line_2: capped at max_per_line × lines words, split in balance (first line longer).

    hints (source_id, word_idx): words after which a break is preferred; of those that keep both lines within max_per_line the nearest to the balanced
    place is taken, the earlier of equals.
    """
    marked = chunk_words.join(hints.select("source_id", "word_idx", F.lit(True).alias("hinted")).distinct(), ["source_id", "word_idx"], "left") if hints is not None else chunk_words.withColumn("hinted", F.lit(None).cast("boolean"))
    listed = marked.groupBy("source_id", "chunk_idx").agg(ordered("word_idx", "text", "hinted").alias("w")).withColumn("w", F.slice("w", 1, max_per_line * lines))
    total, middle = F.size("w"), F.ceil(F.size("w") / 2).cast("int")
    places = F.transform("w", lambda x, i: F.when(x["hinted"] & (i + 1 < total) & (i + 1).between(total - max_per_line, max_per_line), F.struct(F.abs(i + 1 - middle).alias("off"), (i + 1).alias("at"))))
    half = F.when(total <= max_per_line, total).otherwise(F.coalesce(F.array_min(F.filter(places, lambda p: p.isNotNull()))["at"], middle)).cast("int")
    out = listed.withColumn("h", half).withColumn("t", F.transform("w", lambda x: x["text"]))
    return out.select("source_id", "chunk_idx", F.array_join(F.slice("t", F.lit(1), F.col("h")), " ").alias("line_1"), F.array_join(F.slice("t", F.col("h") + 1, F.size("t")), " ").alias("line_2"))


def events_from_frames(frames: DataFrame, thresholds: float = 0.5, frame_ms: int = 100, min_ms: int = 200) -> DataFrame:
    """Per source and class: runs of frames at or over the threshold, their highest p, at least min_ms long. frames: source_id, cls, frame, p."""
    order = Window.partitionBy("source_id", "cls").orderBy("frame")
    hot = frames.filter(F.col("p") >= thresholds).withColumn("_i", F.col("frame") - F.row_number().over(order))
    found = hot.groupBy("source_id", "cls", "_i").agg((F.min("frame") * frame_ms).alias("start_ms"), ((F.max("frame") + 1) * frame_ms).alias("end_ms"), F.max("p").alias("confidence"))
    return found.drop("_i").filter(F.col("end_ms") - F.col("start_ms") >= min_ms)


def class_peaks(frames: DataFrame) -> DataFrame:
    """Per source and class: the highest p over all its frames and the first frame that has it, whether or not an event comes of it."""
    best = frames.groupBy("source_id", "cls").agg(F.max(F.struct("p", (-F.col("frame")).alias("f"))).alias("b"))
    return best.select("source_id", "cls", F.col("b.p").alias("peak"), (-F.col("b.f")).alias("frame"))


def emphasis_spans(words: DataFrame, marks: DataFrame, min_supporting: int = 2, on: list[str] | None = None) -> DataFrame:
    """Runs of marked words (marks: source_id, word_idx, kind) as spans; ``supporting`` runs need min_supporting words or a number.

    A supporting run inside a run of another kind goes. on: the key of words and marks, the source by default.
    """
    on = on or ["source_id"]
    marked = words.join(marks, [*on, "word_idx"]).withColumn("_i", F.col("word_idx") - F.row_number().over(Window.partitionBy(*on, "kind").orderBy("word_idx")))
    grouped = marked.groupBy(*on, "kind", "_i").agg(F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), F.bool_or(F.col("text").rlike("[0-9]")).alias("numeric"))
    grouped = grouped.drop("_i").filter((F.col("kind") != "supporting") | (F.col("n_words") >= min_supporting) | F.col("numeric"))
    # runs of one kind are disjoint, so a run that covers this one begins at or before it and is the last of its kind to do so
    order = Window.partitionBy(*on).orderBy("first_idx", (F.col("kind") == "supporting").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("kind") != "supporting", F.col("last_idx"))).over(order)
    return grouped.withColumn("_reach", reach).filter((F.col("kind") != "supporting") | F.col("_reach").isNull() | (F.col("_reach") < F.col("last_idx"))).drop("_reach")


def emphasis_plan(words: DataFrame, candidates: DataFrame, least: float = 0.75, hook_least: float = 0.70, payoff_least: float = 0.75) -> DataFrame:
    """Spans to stress in each candidate that the evidence suffices for: source_id, cand_id, kind, first_idx, last_idx, start_ms, end_ms, n_words, numeric, confidence.

    candidates: source_id, cand_id, start_ms, end_ms, then hook, hook_start_ms, hook_end_ms, hook_confidence and payoff_text, payoff_start_ms, payoff_end_ms,
    payoff_score, payoff_completion. A hook's words are those of its span that its text holds (all of them if it has none), from hook_least on; the payoff's
    likewise from payoff_least on, unless it is known to be incomplete. Confidence: the better of both plus 0.10 if both are found, else the one; supporting
    words (numbers and strong terms) add 0.05 to either and carry nothing alone. Candidates under ``least`` give no spans. Null evidence counts as none.
    """
    from .intervals import interval_join

    on = ["source_id", "cand_id"]
    tokens = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), normalize_token), lambda t: t != "")
    hook = F.when(F.coalesce("hook_confidence", F.lit(0.0)) >= hook_least, F.struct(F.col("hook_start_ms").alias("s"), F.col("hook_end_ms").alias("e"), tokens(F.col("hook")).alias("t"), F.col("hook_confidence").cast("double").alias("p")))
    payoff = F.when((F.coalesce("payoff_score", F.lit(0.0)) >= payoff_least) & F.coalesce("payoff_completion", F.lit(True)), F.struct(F.col("payoff_start_ms").alias("s"), F.col("payoff_end_ms").alias("e"), tokens(F.col("payoff_text")).alias("t"), F.col("payoff_score").cast("double").alias("p")))
    spans = candidates.select(*on, "start_ms", "end_ms", hook.alias("hook"), payoff.alias("payoff"))
    inside = interval_join(words.select("source_id", "word_idx", "text", "start_ms", "end_ms"), spans).withColumnRenamed("r_cand_id", "cand_id").withColumn("token", normalize_token(F.col("text")))
    meets = lambda x: F.coalesce((F.col("end_ms") > F.col(f"{x}.s")) & (F.col("start_ms") < F.col(f"{x}.e")) & ((F.size(f"{x}.t") == 0) | F.array_contains(f"{x}.t", F.col("token"))), F.lit(False))
    strong = F.coalesce(F.col("token").isin(SUPPORTING_TERMS) | F.col("token").rlike("[0-9]"), F.lit(False))
    flagged = inside.select(*on, "word_idx", "text", "start_ms", "end_ms", F.when(meets("r_hook"), F.col("r_hook.p")).alias("hook"), F.when(meets("r_payoff"), F.col("r_payoff.p")).alias("payoff"), strong.alias("supporting"))
    whole = flagged.groupBy(*on).agg(F.max("hook").alias("h"), F.max("payoff").alias("p"), F.bool_or("supporting").alias("s"))
    base = F.when(F.col("h").isNotNull() & F.col("p").isNotNull(), F.least(F.lit(1.0), F.greatest("h", "p") + 0.10)).otherwise(F.coalesce("h", "p"))
    passed = whole.filter("h is not null or p is not null").select(*on, F.round(F.least(F.lit(1.0), base + F.when(F.col("s"), 0.05).otherwise(0.0)), 6).alias("confidence")).filter(F.col("confidence") >= least)
    kinds = F.array(F.when(F.col("hook").isNotNull(), F.lit("hook")), F.when(F.col("payoff").isNotNull(), F.lit("payoff")), F.when(F.col("supporting"), F.lit("supporting")))
    kept = flagged.join(passed.select(*on), on, "left_semi")
    marks = kept.select(*on, "word_idx", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    return emphasis_spans(kept.select(*on, "word_idx", "text", "start_ms", "end_ms"), marks, on=on).join(passed, on)


def merge_edits(edits: DataFrame, on: list[str], tolerance_ms: int = 0) -> DataFrame:
    """Overlapping edits as one: lowest confidence, reasons joined in order, the first one's type."""
    from .intervals import merge_intervals

    reasons = F.array_join(F.transform(ordered("start_ms", "end_ms", "reason"), lambda x: x["reason"]), "; ")
    aggs = [F.min("confidence").alias("confidence"), reasons.alias("reason"), F.min_by("edit_type", F.struct("start_ms", "end_ms", "edit_type")).alias("edit_type")]
    return merge_intervals(edits, tolerance_ms, on, aggs=aggs)


def scenes_from_cuts(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """scene_idx, start_ms, end_ms: from 0 through the distinct cuts inside a source to its end."""
    inner = cuts.join(durations, "source_id").filter("t_ms > 0 and t_ms < duration_ms").select("source_id", "t_ms")
    starts = inner.unionByName(durations.select("source_id", F.lit(0).cast("bigint").alias("t_ms"))).distinct()
    w = Window.partitionBy("source_id").orderBy("t_ms")
    out = starts.withColumn("end_ms", F.lead("t_ms").over(w)).withColumn("scene_idx", F.row_number().over(w) - 1).join(durations, "source_id")
    return out.select("source_id", "scene_idx", F.col("t_ms").alias("start_ms"), F.coalesce("end_ms", "duration_ms").alias("end_ms"))


def merge_states(states: DataFrame, gap_ms: int = 100) -> DataFrame:
    """Neighbouring states of one track with the same flag as one; confidence averaged pair by pair, evidence united."""
    w = Window.partitionBy("source_id", "track_id").orderBy("start_ms", "end_ms")
    breaks = (F.lag("speaking").over(w) != F.col("speaking")) | (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms)
    islands = states.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("_i", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    confs = F.transform(ordered("start_ms", "end_ms", "confidence"), lambda x: x["confidence"])
    averaged = F.aggregate(F.slice(confs, F.lit(2), F.size(confs)), F.element_at(confs, 1).cast("double"), lambda a, c: (a + c) / 2)
    return islands.groupBy("source_id", "track_id", "_i").agg(F.first("speaking").alias("speaking"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), averaged.alias("confidence")).drop("_i")
