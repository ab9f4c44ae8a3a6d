"""Steps of large queries: what they shuffle, sort and list, seen in their plans and on small tables."""

import random

from conftest import DATA
from pyspark.sql import functions as F

from tempora.functions.shared import written
from tempora.operators import clips, corrections, islands, rank, tracks
from tempora.plans.queries import QUERIES
from tempora.sources import fixtures, readers


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spoken(spark, turns):
    return fixtures.words_of(spark.createDataFrame(turns, "source_id long, turn int, speaker string, text string"))


def turns_of(n, words=30):
    rng = random.Random(n)
    return [(s, t, rng.choice(["a", "b", None]), " ".join(rng.choice(["yes", "no", "so.", "well", "there", "live"]) for _ in range(words))) for s in range(n) for t in range(3)]


def test_candidates_list_no_row_for_each_word_of_a_window(spark):
    w = written(spoken(spark, turns_of(3)), "words")
    plan = planned(fixtures.candidates(w))
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan


def test_words_are_dealt_finely_and_ordered_once(spark):
    w = spoken(spark, [(1, 1, "a", "  c d "), (1, 0, "a", "a b"), (1, 2, "a", None), (1, 3, "a", " "), (1, 4, "b", "e")])
    assert [(r.word_idx, r.text) for r in w.orderBy("word_idx").collect()] == list(enumerate("abcde"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {4 * parts})" in planned(w) or f", {4 * parts}), REPARTITION" in planned(w)
    assert planned(w).count("Sort [") == 2  # the texts, and the words


def test_terms_are_weighed_where_words_were_dealt(spark):
    w = written(spoken(spark, turns_of(4)), "words")
    c = written(fixtures.candidates(w), "candidates")
    weights = rank.tfidf(c, w)
    # words and candidates for their join, and the words of candidates by source
    assert planned(weights).count("Exchange hashpartitioning") <= 4 and "ObjectHashAggregate" not in planned(weights)
    vectors = {(r.source_id, r.cand_id): r.v for r in rank.term_vectors(weights).collect()}
    long = {}
    for r in weights.collect():
        long.setdefault((r.source_id, r.cand_id), {})[r.term] = r.weight
    assert set(vectors) == set(long)
    for k, v in vectors.items():
        assert v.term == sorted(v.term) and v.weight == [long[k][t] for t in sorted(long[k])]


def test_near_candidates_are_found_in_place(spark):
    rng = random.Random(7)
    rows = [(s, i, t := rng.randrange(0, 60_000), t + rng.randrange(1000, 20_000), rng.choice("pqrs") * rng.choice([1, 1, 9]), "llm", rng.random()) for s in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "source_id long, cand_id long, start_ms long, end_ms long, hook string, score_source string, score double")
    marked = rank._with_near(rank.rank_candidates(df), 5000, 6000)
    assert "Join" not in planned(marked) and planned(marked).count("Exchange hashpartitioning") == 1
    got = {(r.source_id, r.rank, b) for r in marked.collect() for b in r._near}
    ranked = marked.collect()
    assert got == {(p.source_id, p.rank, q.rank) for p in ranked for q in ranked if p.source_id == q.source_id and q.rank < p.rank and abs(p.start_ms - q.start_ms) < 5000 and abs(p.end_ms - q.end_ms) < 6000}


def test_corrections_see_their_context_in_place(spark, monkeypatch):
    w = written(spoken(spark, [(s, 0, "a", "we life in portugal alone and I here the weather is fine my live is a beautiful story " * 3) for s in range(3)]), "words")
    out = corrections.semantic_corrections(w)
    assert "Join" not in planned(out)
    whole = sorted(map(tuple, out.collect()), key=str)
    assert any(r[-1] for r in whole)
    monkeypatch.setattr(corrections, "BLOCK", 5)  # every context crosses blocks
    assert sorted(map(tuple, corrections.semantic_corrections(w).collect()), key=str) == whole


def test_the_later_track_of_a_pair_is_listed_once(spark):
    rng = random.Random(4)
    rows = [(0, 0, i, s := rng.randrange(0, 90_000_000), s + rng.choice([0, 10, 3_600_000, 40_000_000]), rng.random() * 400) for i in range(120)]
    rows += [(0, 0, 500, 7, 7, 1.0), (0, 0, 501, 7, 7, 1.0), (0, 0, 502, 9, 8, 1.0)]
    df = spark.createDataFrame(rows, "source_id long, shot_idx long, track_id long, start_ms long, end_ms long, cx double")
    meets = lambda p, q: p[2] < q[2] and p[4] >= q[3] - 1000 and p[3] <= q[4] + 1000 and abs(p[5] - q[5]) <= 80
    good = [r for r in rows if r[4] >= r[3]]
    edges = tracks.track_edges(df)
    assert planned(edges).count("Generate") == 1
    assert sorted((r.a, r.b) for r in edges.collect()) == sorted((p[2], q[2]) for p in good for q in good if meets(p, q))


def test_settled_tracks_take_no_part_in_merging(spark, monkeypatch):
    sizes = []
    real = tracks.written
    monkeypatch.setattr(tracks, "written", lambda df, name: (sizes.append((name, (out := real(df, name)).count())), out)[1])
    t = spark.createDataFrame([(0, 0, i) for i in range(100)], "source_id long, shot_idx long, track_id long")
    e = spark.createDataFrame([(0, 0, 1, 2), (0, 0, 2, 1), (0, 0, 3, 3)], "source_id long, shot_idx long, a long, b long")
    got = {r.track_id: r.person for r in tracks.merge_tracks(t, e).collect()}
    assert got == {i: 1 if i == 2 else i for i in range(100)}
    assert max(n for _, n in sizes) == 2 and ("ends", 0) in sizes


def test_detections_are_dealt_by_track_and_by_time_of_a_person(spark, monkeypatch):
    monkeypatch.setattr(tracks, "written", lambda df, name: (_ for _ in ()).throw(AssertionError(name)))
    keys = "source_id long, shot_idx long, track_id long, "
    seen = spark.createDataFrame([(0, 0, 5, 1, 0.5), (0, 0, 5, 1, 0.5), (0, 0, 7, 1, 0.1), (0, 0, 7, 4, 0.2), (0, 0, 7, 4, 0.2), (0, 0, 9, 4, 0.0), (0, 0, 9, None, 0.3), (0, 1, 5, 1, None)], keys + "t_ms long, cx double")
    named = spark.createDataFrame([(0, 0, 5, 5), (0, 0, 7, 5), (0, 0, 9, 5), (0, 1, 5, 5), (0, 0, 11, 5)], keys + "person long")
    united = tracks.united_detections(named, seen)
    assert planned(united).count("Window [") == 1 and "Union" not in planned(united)
    # 7 leads with three, so it gives all of its own; of the others 9 alone has a time that is not covered
    want = [(0, 0, 5, 7, 1, 0.1), (0, 0, 5, 7, 4, 0.2), (0, 0, 5, 7, 4, 0.2), (0, 0, 5, 9, None, 0.3), (0, 1, 5, 5, 1, None)]
    assert sorted(map(tuple, united.collect()), key=str) == sorted(want, key=str)
    unknown = tracks.united_detections(named, seen.withColumn("t_ms", F.lit(None).cast("long")))
    assert sorted(map(tuple, unknown.select("shot_idx", "track_id", "cx").collect()), key=str) == sorted([(0, 7, 0.1), (0, 7, 0.2), (0, 7, 0.2), (0, 5, 0.5), (1, 5, None)], key=str)


def test_doubles_of_a_clip_are_found_where_the_join_leaves_them(spark):
    w = spark.createDataFrame([(1, i, 29_000 + 500 * (i // 2), 29_600 + 500 * (i // 2), "x", "a") for i in range(12)], "source_id long, word_idx long, start_ms long, end_ms long, text string, speaker string")
    c = spark.createDataFrame([(1, 0, 29_100, 31_000), (1, 1, 0, 90_000)], "source_id long, cand_id long, start_ms long, end_ms long")
    out = clips.clip_words(w, c, ["source_id", "cand_id"])
    assert planned(out).count("Exchange hashpartitioning") == 2
    assert sorted((r.cand_id, r.word_idx) for r in out.collect()) == [(0, i) for i in range(0, 8, 2)] + [(1, i) for i in range(0, 12, 2)]


def test_diarization_sorts_words_once(spark):
    w = written(spoken(spark, turns_of(3)), "words")
    plan = planned(islands.diar_segments(w))
    assert plan.count("Sort [") == 1


def test_transcripts_in_bundles_are_read_as_in_files(spark, tmp_path):
    doc = '{"results":{"channels":[{"alternatives":[{"words":[{"word":"a","start":0.1,"end":0.2,"speaker":"0"},{"word":" ","start":0.2,"end":0.3},{"word":"b","punctuated_word":"B\\t.","start":0.3,"end":0.4,"speaker":"x"}]}]}]}}'
    docs = spark.createDataFrame([(k, doc) for k in range(5)] + [(9, '{"results":{"channels":[]}}')], "source_id long, value string")
    docs.write.partitionBy("source_id").text(f"{tmp_path}/files")
    readers.write_bundles(docs.coalesce(1), f"{tmp_path}/bundles")
    assert len(list((tmp_path / "bundles").glob("part-*"))) == 1
    name = F.regexp_extract("source_id", "source_id=([0-9]+)", 1)
    files = readers.read_transcripts(spark, f"{tmp_path}/files").withColumn("source_id", name)
    bundled = readers.read_transcripts(spark, f"{tmp_path}/bundles", bundled=True)
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, bundled.collect()))
    assert bundled.count() == 10 and "Exchange" not in planned(bundled)


def test_words_json_in_bundles_are_read_as_in_files(spark, tmp_path):
    word = '{"text":"a","start":0.1,"end":0.2}'
    shapes = [f"[{word},{word}]", '{"words":[' + word + "]}", '{"segments":[{"words":[' + word + ']},{"text":"none"},{"words":[' + word + "]}]}"]
    docs = spark.createDataFrame([(k, shapes[k % 3]) for k in range(6)], "source_id long, value string")
    docs.write.partitionBy("source_id").text(f"{tmp_path}/files")
    readers.write_bundles(docs.coalesce(1), f"{tmp_path}/bundles")
    name = F.regexp_extract("source_id", "source_id=([0-9]+)", 1)
    files = readers.read_words_json(spark, f"{tmp_path}/files").withColumn("source_id", name)
    bundled = readers.read_words_json(spark, f"{tmp_path}/bundles", bundled=True)
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, bundled.collect()))
    assert bundled.count() == 10 and "Exchange" not in planned(bundled)


def test_words_json_is_parsed_as_a_list_where_other_shapes_fail(spark, tmp_path):
    docs = ['[{"text":"a","start":0.1,"end":0.2}]', '{"words":[{"text":"b"}]}', '{"segments":[{"words":[{"text":"c"}]}]}', '{"text":"d"}', '{"words":[]}', "[]", "{", "null", '{"segments":null,"words":null}']
    readers.write_bundles(spark.createDataFrame(list(enumerate(docs)), "source_id long, value string"), f"{tmp_path}/bundles")
    read = readers.read_words_json(spark, f"{tmp_path}/bundles", bundled=True)
    assert sorted((r.source_id, r.text) for r in read.collect()) == [("0", "a"), ("1", "b"), ("2", "c"), ("3", "d")]
    # no column is made of the parse as a list
    assert "from_json(ArrayType" in planned(read) and not [x for x in planned(read).split("\n") if "Project" in x and "from_json(ArrayType" in x]


def test_a_clause_is_split_once(spark):
    from tempora.operators import screens

    texts = spark.createDataFrame([("one two three four five six seven eight", 1)], "text string, k int")
    plan = planned(texts.select(screens.lines_for(F.col("text"), 700).alias("lines")))
    assert plan.count("regexp_extract_all") == 2  # clauses, and the parts of one


def test_cues_number_their_words_in_one_order(spark):
    w = written(spoken(spark, turns_of(3)), "words")
    # the words in time order, their groups, and the numbers of cues
    assert planned(islands.cues(w)).count("Sort [") <= 2
    alone = written(spoken(spark, [(1, 0, "a", " ".join("abcdefghijklmnopqrs"))]).withColumn("start_ms", F.col("word_idx") * 100).withColumn("end_ms", F.col("word_idx") * 100 + 90), "words")
    assert [r.n_words for r in islands.cues(alone).orderBy("cue_idx").collect()] == [8, 8, 3]


def test_merging_turns_sorts_words_once_and_turns_once(spark):
    w = written(spoken(spark, turns_of(3)), "words")
    plan = planned(islands.merge_adjacent(islands.diar_segments(w), 900).drop("confidence"))
    # words by time, turns by time, and their groups (before and after the partial result)
    assert plan.count("Sort [") <= 4


def test_speaker_levels_broadcast_no_samples(spark):
    plan = planned(QUERIES["o69_speaker_levels"](spark, f"{DATA}/sf0.001"))
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_phrases_are_placed_in_blocks_of_words(spark):
    from tempora.operators import scoring

    rng = random.Random(8)
    said = [rng.choice(["a", "at", "that", "the", "then", "Cat!", "--"]) for _ in range(2 * scoring.BLOCK + 40)]
    w = written(spark.createDataFrame([(1, i, t, i * 400, i * 400 + 300, None) for i, t in enumerate(said)], "source_id long, word_idx long, text string, start_ms long, end_ms long, speaker string"), "words")
    starts = [0, 5, 1000, *range(scoring.BLOCK - 12, scoring.BLOCK + 3), 2 * scoring.BLOCK - 3, len(said) - 5]
    phrases = [(1, k, " ".join([*said[s : s + 7], "dog"]), s * 400 - rng.randrange(9000), s * 400 + rng.randrange(9000)) for k, s in enumerate(starts)]
    p = spark.createDataFrame(phrases, "source_id long, cand_id long, text string, start_ms long, end_ms long")
    clean = lambda t: "".join(x for x in t.lower() if x.isalpha())
    worth = lambda u, t: 5 if u == t else 4 if u and (u in t or t in u) else 0
    for tie, args in (("first", {}), ("end", {"before_ms": 0, "after_ms": None, "max_tokens": None})):
        placed = scoring.align_phrase(p, w, tie=tie, fallback=False, **args)
        assert "MapInArrow" in planned(placed) and "Window [collect_list" not in planned(placed)
        got = {r.cand_id: (r.first_idx, r.match) for r in placed.collect()}
        for _, k, text, start, end in phrases:
            t = [x for x in map(clean, text.split()) if x][: args.get("max_tokens", 6)]
            lo, hi = start - args.get("before_ms", 12_000), end + 600_000 if args else start + 25_000
            sums = [(sum(worth(clean(u), x) for u, x in zip(said[i : i + len(t)], t)), -abs(i * 400 - end) if tie == "end" else 0, -i) for i in range(len(said)) if lo <= i * 400 <= hi]
            best = max(sums)
            assert got.get(k) == ((-best[2], round(best[0] / 5 / len(t), 6)) if best[0] * 2 >= 5 * len(t) else None)


def test_ends_are_chosen_without_sorting_pairs(spark):
    from tempora.operators import boundaries

    w = written(spoken(spark, turns_of(3)), "words")
    c = spark.createDataFrame([(0, 0, 0, 15_000, 14_000, True)], "source_id long, cand_id long, snapped_start long, end_ms long, payoff_end long, low_confidence boolean")
    flags = c.withColumns({"payoff_incomplete": F.lit(False), "must_extend": F.lit(False), "floor_ms": F.lit(None).cast("long")})
    out = boundaries.snap_end(flags, w, w.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")))
    assert "SortAggregate" not in planned(out) and out.count() == 1


def test_discovery_splits_documents_once(spark, monkeypatch):
    from tempora.operators import discovery

    given = []
    monkeypatch.setattr(discovery, "discover_candidates", lambda *frames, **_: given.extend(frames))
    QUERIES["o128_discover_candidates"](spark, f"{DATA}/sf0.001")
    assert len(given) == 4 and not [x for x in given if "posexplode" in planned(x)]


def test_sounds_are_made_once_a_word(spark):
    pairs = spark.createDataFrame([("live", "life"), ("to", "two"), ("", "a"), ("a", "i")], "a string, b string")
    likeness = pairs.select("a", corrections.sound_likeness(F.col("a"), F.col("b")).alias("s"))
    assert planned(likeness).count("translate(") == 2
    got = {r.a: r.s for r in likeness.collect()}
    assert got["live"] == 0.5 * 1.0 + 0.5 * 0.75 and got[""] == got["a"] == 0.0
