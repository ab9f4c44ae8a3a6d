"""Hand-made cases of operators: ties, edges, folds."""

import math

from pyspark.sql import functions as F

from tempora.operators import boundaries, intervals, islands, pacing, rank, scoring, series, speakers


def words(spark, rows):
    """rows: (text, start_ms, end_ms[, speaker]) of source 1."""
    full = [(1, i, r[0], r[1], r[2], r[3] if len(r) > 3 else "a") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "source_id long, word_idx long, text string, start_ms long, end_ms long, speaker string")


def spans(spark, rows, kind="source_id long, start_ms long, end_ms long"):
    return spark.createDataFrame(rows, kind)


def test_touching_intervals_meet_only_when_closed(spark):
    a, b = spans(spark, [(1, 0, 100)]), spans(spark, [(1, 100, 200)])
    assert intervals.interval_join(a, b).count() == 0
    assert intervals.interval_join(a, b, mode="closed").count() == 1
    assert intervals.interval_join(a, b, tolerance_ms=1).count() == 1


def test_interval_join_against_all_pairs(spark):
    left = [(i % 3, (i * 7919) % 200_000, (i * 7919) % 200_000 + (i * 31) % 90_000) for i in range(60)]
    right = [(i % 3, (i * 104729) % 200_000, (i * 104729) % 200_000 + (i * 17) % 60_000) for i in range(60)]
    want = sorted((a, b) for a in left for b in right if a[0] == b[0] and a[2] > b[1] and a[1] < b[2])
    got = intervals.interval_join(spans(spark, left), spans(spark, right), bucket_ms=10_000).collect()
    assert sorted(((r.source_id, r.start_ms, r.end_ms), (r.source_id, r.r_start_ms, r.r_end_ms)) for r in got) == want


def test_levels_join_against_all_pairs_of_very_different_lengths(spark):
    lengths = [0, 1, 40, 900, 16_000, 300_000, 5_000_000]
    left = [(i % 2, (i * 7919) % 400_000, (i * 7919) % 400_000 + lengths[i % 7]) for i in range(70)] + [(1, None, 5), (None, 0, 5), (1, 9, 3)]
    right = [(i % 2, (i * 104729) % 400_000 - 50_000, (i * 104729) % 400_000 - 50_000 + lengths[i * 3 % 7]) for i in range(70)] + [(0, 0, 10**10)]
    a, b = spans(spark, left), spans(spark, right)
    good = [x for x in left if None not in x and x[2] >= x[1]]
    meets = {"overlap": lambda x, s, e: x[2] > s and x[1] < e, "closed": lambda x, s, e: x[2] >= s and x[1] <= e, "contained": lambda x, s, e: x[1] >= s and x[2] <= e}
    for mode, test in meets.items():
        for tolerance in (0, 150):
            want = sorted((x, y) for x in good for y in right if x[0] == y[0] and test(x, y[1] - tolerance, y[2] + tolerance))
            got = intervals.interval_join_levels(a, b, mode=mode, tolerance_ms=tolerance, bucket_ms=100, step=4, levels=5)
            assert got.columns == ["source_id", "start_ms", "end_ms", "r_start_ms", "r_end_ms"]
            assert sorted(((r.source_id, r.start_ms, r.end_ms), (r.source_id, r.r_start_ms, r.r_end_ms)) for r in got.collect()) == want


def test_levels_list_a_long_interval_a_few_times(spark):
    day, widen = spans(spark, [(1, 0, 86_400_000)]), 0
    rows = intervals._levelled(day, "start_ms", "end_ms", 30_000, False, widen, "l", 16, 4)
    assert intervals._under(rows, "l", 30_000, 16, 4, "own").count() <= 17
    assert intervals._bucketed(day, "start_ms", "end_ms", 30_000, False, widen, "l").count() == 2880


def test_complement_tiles_the_clip(spark):
    clips = spans(spark, [(1, 0, 1000)])
    kept = intervals.complement(spans(spark, [(1, 100, 200), (1, 950, 1200)]), clips, ["source_id"]).orderBy("src_start").collect()
    assert [(r.src_start, r.src_end, r.out_start, r.out_end) for r in kept] == [(0, 100, 0, 100), (200, 950, 100, 850)]


def test_remap_point_on_an_edge_and_removed(spark):
    kept = spark.createDataFrame([(1, 0, 100, 0), (1, 200, 300, 100)], "source_id long, src_start long, src_end long, out_start long")
    got = intervals.remap_points(spark.createDataFrame([(1, 100), (1, 150), (1, 250)], "source_id long, t_ms long"), kept).orderBy("t_ms").collect()
    assert [r.out_ms for r in got] == [100, None, 150]


def test_segments_break_at_pause_speaker_and_sentence(spark):
    w = words(spark, [("a", 0, 100), ("b.", 150, 200), ("c", 250, 300), ("d", 2000, 2100), ("e", 2150, 2200, None), ("f", 2250, 2300, None)])
    got = islands.segments(w).orderBy("segment_idx").collect()
    assert [r.text for r in got] == ["a b.", "c", "d", "e f"]


def test_null_speaker_closes_or_is_skipped(spark):
    w = words(spark, [("a", 0, 100), ("b", 120, 200, None), ("c", 220, 300)])
    assert islands.diar_segments(w).count() == 2
    assert islands.diar_segments(w, 750, skip_null=True).count() == 1


def test_otsu_splits_two_groups_and_flat_series(spark):
    rows = [(1, i, 0.1) for i in range(5)] + [(1, 5 + i, 0.9) for i in range(5)] + [(2, i, 0.4) for i in range(3)]
    df = spark.createDataFrame(rows, "source_id long, window_idx long, smoothed double")
    got = {r.source_id: r.threshold for r in series.otsu_threshold(df).collect()}
    assert math.isclose(got[1], 0.5) and math.isclose(got[2], 0.4)


def test_spans_split_at_a_valley(spark):
    values = [0.9, 0.9, 0.55, 0.9, 0.1]
    df = spark.createDataFrame([(1, i, v, i * 10, i * 10 + 10) for i, v in enumerate(values)], "source_id long, window_idx long, smoothed double, window_start long, window_end long")
    tau = spark.createDataFrame([(1, 0.5)], "source_id long, threshold double")
    got = series.score_spans(df, tau).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 20), (20, 40)]


def test_greedy_dedup_keeps_what_only_a_dropped_one_blocks(spark):
    rows = [(1, 0, 0, 60_000, 0.9, "h", "llm"), (1, 1, 4_000, 64_000, 0.8, "h", "llm"), (1, 2, 8_000, 69_000, 0.7, "x", "llm")]
    df = spark.createDataFrame(rows, "source_id long, cand_id long, start_ms long, end_ms long, score double, hook string, score_source string")
    assert sorted(r.cand_id for r in rank.dedup_greedy(df).collect()) == [0, 2]


def test_quality_gate_that_would_empty_a_pool_is_skipped(spark):
    df = spark.createDataFrame([(1, 1, True, 0.9), (2, 1, False, 0.1), (2, 2, False, 0.7)], "source_id long, cand_id long, unresolved boolean, composite double")
    assert sorted((r.source_id, r.cand_id) for r in rank.quality_gates(df).collect()) == [(1, 1), (2, 2)]


def test_openings(spark):
    df = spark.createDataFrame([("He was late.",), ("She, Maria, was late.",), ("And so it goes",), ("",), ("People talk",)], "hook string")
    got = [(r.unresolved_pronoun, r.continuation_opener) for r in scoring.opening_context(df).collect()]
    assert got == [("he", None), ("she", None), (None, "and so"), ("empty_hook", None), (None, None)]


def test_host_and_guest(spark):
    seg = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 100), (1, "a", 100, 110)], "source_id long, speaker string, start_ms long, end_ms long")
    q = spark.createDataFrame([(1, "a", 2, 2, 0), (1, "b", 1, 0, 0)], "source_id long, speaker string, turns long, question_turns long, interrogative_starts long")
    got = {r.speaker: (r.role, r.confidence) for r in speakers.speaker_roles(seg, q).collect()}
    assert got["a"][0] == "host" and got["b"] == ("guest", 0.7)


def test_restart_and_filler_are_cut(spark):
    w = words(spark, [("I", 1000, 1100), ("went", 1150, 1300), ("I", 1900, 2000), ("went", 2050, 2200), ("um", 2800, 2900), ("home.", 3500, 3700), ("Then", 6000, 6200)])
    clips = spark.createDataFrame([(1, 0, 0, 8000)], "source_id long, clip_id long, start_ms long, end_ms long")
    quiet = spans(spark, [(1, 0, 1000), (1, 1300, 1900), (1, 2200, 2800), (1, 2900, 3500), (1, 3700, 6000), (1, 6200, 8000)])
    got = {r.edit_type: (r.start_ms, r.end_ms) for r in pacing.propose_edits(w, clips, quiet).collect()}
    assert got["false_start"] == (950, 1350) and got["hesitation_filler"] == (2750, 2950)
    assert got["leading_dead_air"] == (0, 700) and got["internal_pause"] == (3950, 5750)


def test_no_cut_across_a_speaker_change(spark):
    w = words(spark, [("One.", 0, 500, "a"), ("Two.", 4000, 4500, "b")])
    clips = spark.createDataFrame([(1, 0, 0, 4500)], "source_id long, clip_id long, start_ms long, end_ms long")
    assert pacing.propose_edits(w, clips, spans(spark, [(1, 500, 4000)])).count() == 0


def test_end_moves_to_the_next_terminator(spark):
    w = words(spark, [(f"w{i}" + ("." if i % 10 == 9 else ""), i * 1000, i * 1000 + 800) for i in range(60)])
    c = spark.createDataFrame([(1, 0, 0, 26_000, None, None, False, None, False)], "source_id long, cand_id long, snapped_start long, end_ms long, payoff_end long, payoff_incomplete boolean, must_extend boolean, floor_ms long, low_confidence boolean")
    d = spark.createDataFrame([(1, 60_000)], "source_id long, duration_ms long")
    assert boundaries.snap_end(c, w, d).first().snapped_end == 29_800


def test_results_do_not_depend_on_partitions(spark):
    w = words(spark, [(f"w{i}" + ("." if i % 7 == 6 else ""), i * 500, i * 500 + 300) for i in range(200)])
    one = islands.cues(w.repartition(1)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, islands.cues(w.repartition(7)).collect())) == sorted(map(str, one))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert islands.cues(w).agg(F.sum("n_words")).first()[0] == 200


def test_as_of_over_many_buckets_against_all_pairs(spark):
    rows = [(i % 3, i, (i * 7919) % 40_000 // 10 * 10, (i * 7919) % 40_000 // 10 * 10 + 50) for i in range(80)] + [(0, 900, None, None), (None, 901, 5, 55)]
    w = spark.createDataFrame(rows, "source_id long, word_idx long, start_ms long, end_ms long")
    points = [(i % 4, i, (i * 3571) % 50_000 // 10 * 10) for i in range(60)] + [(0, 90, None), (None, 91, 100)]
    p = spark.createDataFrame(points, "source_id long, cand_id long, t_ms long")
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    for bucket in (500, 10_000_000):
        got_before, got_after = {}, {}
        for row_at, prefixes, got in (("end_ms", {"before": "x_"}, got_before), ("start_ms", {"after": "x_"}, got_after)):
            got.update({r.cand_id: r.x_word_idx for r in intervals._as_of(p, w, "t_ms", row_at, ["word_idx"], ["cand_id"], ["word_idx"], bucket_ms=bucket, **prefixes).collect()})
        two = {r.cand_id: r for r in intervals._as_of(p, w, "t_ms", "start_ms", ["word_idx"], ["cand_id"], ["word_idx"], before="b_", after="a_", bucket_ms=bucket).collect()}
        for s, k, t in points:
            mine = [r for r in known if r[0] == s and t is not None]
            assert got_before[k] == max(((r[3], r[1]) for r in mine if r[3] <= t), default=(0, None))[1]
            assert got_after[k] == two[k].a_word_idx == min(((r[2], r[1]) for r in mine if r[2] >= t), default=(0, None))[1]
            assert two[k].b_word_idx == max(((r[2], r[1]) for r in mine if r[2] <= t), default=(0, None))[1]


def test_lines_break_at_a_legal_hint(spark):
    w = spark.createDataFrame([(1, c, c * 10 + i, f"w{i}") for c, n in ((0, 4), (1, 5), (2, 3), (3, 9)) for i in range(n)], "source_id long, chunk_idx long, word_idx long, text string")
    hints = spark.createDataFrame([(1, 0), (1, 2), (1, 10), (1, 12), (1, 20), (1, 30), (1, 32)], "source_id long, word_idx long")
    got = {r.chunk_idx: (r.line_1, r.line_2) for r in islands.wrap_lines(w, hints=hints).collect()}
    assert got == {0: ("w0", "w1 w2 w3"), 1: ("w0 w1 w2", "w3 w4"), 2: ("w0 w1 w2", ""), 3: ("w0 w1 w2", "w3 w4 w5")}
    assert islands.wrap_lines(w.limit(0), hints=hints).count() == 0


def test_line_hints(spark):
    w = words(spark, [("And", 0, 1), ("we,", 1, 2), ("so", 2, 3), ("went", 3, 4), ("but", 4, 5), ("stop.", 5, 6), (None, 6, 7)])
    span = spark.createDataFrame([(1, 2)], "source_id long, last_idx long")
    assert sorted(r.word_idx for r in islands.line_break_hints(w, span).collect()) == [1, 2, 3, 5]


EVIDENCE = "source_id long, cand_id long, start_ms long, end_ms long, hook string, hook_start_ms long, hook_end_ms long, hook_confidence double, payoff_text string, payoff_start_ms long, payoff_end_ms long, payoff_score double, payoff_completion boolean"


def test_emphasis_needs_evidence(spark):
    w = words(spark, [("The", 0, 100), ("biggest", 100, 200), ("mistake", 200, 300), ("cost", 300, 400), ("50", 400, 500), ("never", 500, 600), ("again", 600, 700), ("never", 700, 800)])
    none = (None,) * 4
    rows = [
        (1, 0, 0, 800, "The biggest mistake", 0, 300, 0.8, *none, None),  # the supporting run is inside the hook; 50 never stands alone
        (1, 1, 0, 800, "Unheard", 0, 300, 0.9, *none, None),  # no word of the hook
        (1, 2, 0, 800, None, None, None, None, *none, None),  # supporting words alone
        (1, 3, 0, 800, "the", 0, 300, 0.70, *none, None),  # 0.70 + 0.05
        (1, 4, 0, 800, "the", 0, 300, 0.72, "again", 500, 800, 0.80, True),
        (1, 5, 0, 800, None, None, None, None, None, 500, 800, 0.9, False),
    ]
    got = islands.emphasis_plan(w, spark.createDataFrame(rows, EVIDENCE)).collect()
    found = sorted((r.cand_id, r.kind, r.first_idx, r.last_idx, r.confidence) for r in got)
    assert found == [
        (0, "hook", 0, 2, 0.85), (0, "supporting", 4, 5, 0.85), (3, "hook", 0, 0, 0.75), (3, "supporting", 1, 2, 0.75), (3, "supporting", 4, 5, 0.75),
        (4, "hook", 0, 0, 0.95), (4, "payoff", 6, 6, 0.95), (4, "supporting", 1, 2, 0.95), (4, "supporting", 4, 5, 0.95),
    ]


def test_audio_tracks(spark):
    from tempora.operators import qa

    rows = [("a", 0, "x", "en", False, True, 50.0), ("a", 1, "y", "en", False, False, 90.0), ("a", 2, "z", "de", False, False, None), ("b", 0, "p", None, True, False, 1.0), ("b", 1, "q", None, False, False, 1.0), ("b", 2, "r", None, False, False, 1.0), ("c", 0, "o", "fr", False, True, 1.0)]
    f = spark.createDataFrame(rows, "source string, position long, format_id string, language string, original boolean, dubbed boolean, tbr double")
    got = sorted((r.source, r.format_id, r.original) for r in qa.audio_tracks(f).collect())
    assert got == [("a", "y", False), ("a", "z", True), ("b", "p", True), ("b", "q", False), ("c", "o", True)]


def test_rank_range_of_small_sources(spark):
    import pytest

    df = spark.createDataFrame([(1, i) for i in (1, 2, 3)] + [(2, 1)], "source_id long, rank long")
    assert sorted((r.source_id, r.rank) for r in rank.select_rank_range(df, 2, 3).filter("selected").collect()) == [(1, 2), (1, 3)]
    with pytest.raises(ValueError):
        rank.select_rank_range(df, 3, 2)


def test_interval_joins_are_never_broadcast(spark):
    # a day lists 2880 equal rows that pack into a few bytes, so Spark's estimate is no guide
    rows = spans(spark, [(s, 0, 86_400_000) for s in range(20)])
    for join in (intervals.interval_join, intervals.interval_join_levels):
        pairs = join(rows, rows)
        assert pairs.count() == 20
        plan = pairs._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_candidates_hold_twenty_words_without_a_join(spark):
    from tempora.sources import fixtures

    turns = spark.createDataFrame([(s, t, "a", " ".join(f"w{t}x{k}" for k in range(n))) for s, t, n in ((1, 0, 9), (1, 1, 21), (2, 0, 1), (3, 0, 40))], "source_id long, turn int, speaker string, text string")
    w = fixtures.words_of(turns)
    found = fixtures.candidates(w)
    assert "Join" not in found._jdf.queryExecution().toString()
    said = {}
    for r in w.collect():
        said.setdefault(r.source_id, {})[r.word_idx] = r
    got = {(r.source_id, r.cand_id): (r.start_ms, r.end_ms, r.hook) for r in found.collect()}
    want = {}
    for s, ws in said.items():
        for first in range(0, len(ws), 8):
            held = [ws[i] for i in range(first, min(first + 20, len(ws)))]
            want[s, first // 8] = (held[0].start_ms, held[-1].end_ms, " ".join(x.text for x in held[:10]))
    assert got == want


def test_phrases_longer_than_the_lookahead_are_aligned_too(spark):
    said = [f"tok{i % 23}en" for i in range(90)]
    w = words(spark, [(t, i * 400, i * 400 + 300) for i, t in enumerate(said)])
    phrases = [(1, k, " ".join(said[s : s + n]), s * 400, (s + n) * 400) for k, (s, n) in enumerate([(5, 3), (30, scoring.LOOKAHEAD), (40, scoring.LOOKAHEAD + 1), (10, 30), (85, 5), (88, 2)])]
    p = spark.createDataFrame(phrases, "source_id long, cand_id long, text string, start_ms long, end_ms long")
    found = {r.cand_id: (r.first_idx, r.last_idx, r.match) for r in scoring.align_phrase(p, w, before_ms=0, after_ms=None, max_tokens=None, tie="first", fallback=False).collect()}
    assert found == {k: (s, s + n - 1, 1.0) for k, (s, n) in enumerate([(5, 3), (30, 12), (40, 13), (10, 30), (85, 5), (88, 2)])}


#: Milliseconds whose 30-second buckets are more than Spark lists in one row.
AGES = 10**14


def test_box_collisions_of_very_long_boxes(spark):
    from tempora.operators import qa

    rows = [(1, 1, 0, AGES, 0.0, 0.0, 9.0, 9.0), (1, 2, 500, 900, 5.0, 5.0, 9.0, 9.0), (1, 3, AGES - 10, AGES, 5.0, 5.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, "clip_id long, id long, start_ms long, end_ms long, x double, y double, w double, h double")
    assert [tuple(r) for r in qa.box_collisions(boxes).collect()] == [(1, 1, 2)]


def test_reactions_of_very_long_candidates(spark):
    cands = spark.createDataFrame([(1, 7, 0, AGES), (1, 8, 0, 10)], "source_id long, cand_id long, start_ms long, end_ms long")
    events = spark.createDataFrame([(1, "laughter", 1.0, 5000, 6000), (1, "cheer", 1.0, 0, AGES)], "source_id long, event_type string, confidence double, start_ms long, end_ms long")
    found = {r.cand_id: (r.n_events, r.boost) for r in scoring.events_for_candidates(cands, events).collect()}
    assert found == {7: (2, 0.08), 8: (1, 0.03)}


def test_motion_of_a_very_long_shot(spark):
    from tempora.operators import tracks

    diffs = spark.createDataFrame([(1, 5, 0.25), (1, AGES - 5, 0.75), (1, AGES + 5, 9.0)], "source_id long, t_ms long, diff double")
    shots = spark.createDataFrame([(1, 3, 0, AGES)], "source_id long, shot_idx long, start_ms long, end_ms long")
    assert [(r.shot_idx, r.motion, r.n_frames) for r in tracks.shot_motion_profile(diffs, shots).collect()] == [(3, 0.5, 2)]


def test_timeline_of_a_very_long_state(spark):
    states = spark.createDataFrame([(1, 4, 0.9, 0, AGES), (1, 5, 0.95, 100, 200)], "source_id long, track_id int, confidence double, start_ms long, end_ms long")
    grid = spark.createDataFrame([(1, 0), (1, 150), (1, AGES - 1), (1, AGES)], "source_id long, t_ms long")
    assert sorted((r.t_ms, r.track_id) for r in speakers.argmax_timeline(states, grid).collect()) == [(0, 4), (150, 5), (AGES - 1, 4)]


def test_switches_within_a_very_wide_tolerance(spark):
    kind = "source_id long, switch_id long, t_ms long, speaker string"
    truth, got = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, AGES, "b")], kind), spark.createDataFrame([(1, 11, 40, "a"), (1, 12, AGES - 70, "c")], kind)
    r = speakers.switch_metrics(truth, got, AGES).first()
    assert (r.matched, r.identity_errors, r.latency_ms) == (2, 1, 55.0)


def test_the_grid_of_active_speakers_is_merged(spark):
    cells = spark.createDataFrame([(1, 0, 1000)], "source_id long, t_ms long, end_ms long")
    audio = spark.createDataFrame([(1, "a", 0, 900, 0.9)], "source_id long, speaker string, start_ms long, end_ms long, confidence double")
    visual = spark.createDataFrame([(1, 0, 100, 0.9)], "source_id long, track_id int, t_ms long, motion double")
    bound = spark.createDataFrame([(1, "a", 0)], "source_id long, speaker string, track_id int")
    fused = speakers.fuse_active_speaker(cells, audio, visual, bound)
    assert fused.count() == 1
    assert fused._jdf.queryExecution().analyzed().toString().count("ResolvedHint (strategy=merge)") == 2


def test_snapping_ends_broadcasts_durations_alone(spark):
    w = words(spark, [("so", 0, 400), ("it", 500, 900), ("ends.", 1000, 1500), ("then", 9000, 9500), ("more.", 9600, 9900)])
    kind = "source_id long, cand_id long, snapped_start long, end_ms long, payoff_end long, payoff_incomplete boolean, must_extend boolean, floor_ms long, low_confidence boolean"
    found = boundaries.snap_end(spark.createDataFrame([(1, 0, 0, 1400, None, None, None, None, None)], kind), w, spark.createDataFrame([(1, 9900)], "source_id long, duration_ms long"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") - plan.count("ResolvedHint (strategy=merge)") == 1
