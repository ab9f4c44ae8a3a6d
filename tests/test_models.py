"""Corrections by context and the pause model on hand-made rows; held-out figures on the smallest tables."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tempora.operators import corrections as C
from tempora.operators import pause_model as M
from tempora.plans import q_models as Q


def words(spark, text, source=1):
    rows = [(source, i, t, i * 300, i * 300 + 200, None) for i, t in enumerate(text)]
    return spark.createDataFrame(rows, "source_id long, word_idx long, text string, start_ms long, end_ms long, speaker string")


def test_corrections_keep_capitals_punctuation_and_times(spark):
    w = words(spark, "My Live, is short story".split()).unionByName(words(spark, ["i", "live", "in", "portugal", None, "my", "live"], 2))
    out = C.semantic_corrections(w).orderBy("source_id", "word_idx").collect()
    assert [r.text for r in out if r.source_id == 1] == ["My", "Life,", "is", "short", "story"]
    assert [r.text for r in out if r.source_id == 2] == ["i", "live", "in", "portugal", None, "my", "live"]
    changed = [r for r in out if r.rule]
    assert [(r.raw_text, r.rule, r.start_ms, r.end_ms) for r in changed] == [("Live,", "contextual_semantic_live_to_life", 300, 500)]
    assert changed[0].confidence == pytest.approx(0.20 * 0.875 + 0.30 + 0.25 + 0.15 * 0.95 + 0.10 * 0.2625)


def test_corrections_of_no_words(spark):
    assert C.semantic_corrections(words(spark, ["x"]).limit(0)).count() == 0


def test_split_keeps_sources_apart(spark):
    rows = Q.labelled_gaps(spark, f"{DATA}/sf0.001")
    split = M.source_split(rows.select("source_id", "gap_idx", "label"))
    sides = split.groupBy("source_id").agg(F.count_distinct("held_out").alias("n"))
    assert sides.filter("n > 1").count() == 0
    assert 0 < split.filter("held_out").count() < split.count()
    alone = M.source_split(rows.filter("source_id = 0").select("source_id", "gap_idx", "label"))
    assert 0 < alone.filter("held_out").count() < alone.count()


def test_pause_model_on_held_out_sources(spark):
    rows = M.source_split(Q.labelled_gaps(spark, f"{DATA}/sf0.001")).cache()
    model = M.train_pause_model(rows.filter("not held_out"), Q.PAUSE_FEATURES, trees=20)
    held = M.score_gaps(rows.filter("held_out"), model, 0.5, Q.PAUSE_FEATURES)
    m = M.pause_metrics(held).first()
    assert m.n > 0 and m.multi_error < 0.2 and m.removable_precision > 0.8 and m.removable_recall > 0.8
    assert held.filter("p_removable < 0 or p_removable > 1").count() == 0
    boosted = M.train_pause_model(rows.filter("not held_out"), Q.PAUSE_FEATURES, binary=True, trees=5)
    two = M.score_gaps(rows.filter("held_out"), boosted, 0.5, Q.PAUSE_FEATURES)
    right = two.filter(F.col("removable") == F.col("label").isin(M.REMOVABLE)).count()
    assert "predicted" not in two.columns and right > 0.9 * m.n
    with pytest.raises(ValueError):
        M.train_pause_model(rows.limit(50), Q.PAUSE_FEATURES)
    rows.unpersist()


def test_boosted_classes_stop_on_held_out_sources(spark):
    rows = M.source_split(Q.levelled_gaps(spark, f"{DATA}/sf0.001")).cache()
    model = M.train_boosted_classes(rows, Q.BOOST_FEATURES, rounds=8, depth=3)
    present = {r.label for r in rows.filter("not held_out").select("label").distinct().collect()}
    assert {c for c, n in model.rounds.items() if n} == present
    held = M.score_classes(rows.filter("held_out"), model, 0.5).cache()
    loss, m = M.class_log_loss(held).first(), M.pause_metrics(held).first()
    prior = {r.label: r["count"] for r in rows.filter("not held_out").groupBy("label").count().collect()}
    n = sum(prior.values())
    shares = F.create_map(*(F.lit(x) for c in prior for x in (c, prior[c] / n)))
    plain = rows.filter("held_out").agg(F.avg(-F.log(F.coalesce(shares[F.col("label")], F.lit(1e-15)))).alias("x")).first().x
    assert loss.n == m.n > 0 and loss.logloss < 0.5 * plain
    assert m.multi_error < 0.2 and m.removable_precision > 0.8 and m.removable_recall > 0.8
    assert held.filter("abs(aggregate(probabilities, 0d, (s, x) -> s + x) - 1) > 1e-9 or p_removable < 0 or p_removable > 1").count() == 0
    # features stay as they were, nulls too
    assert held.filter("n_samples is null").count() == rows.filter("held_out and n_samples is null").count() > 0
    with pytest.raises(ValueError):
        M.train_boosted_classes(rows.limit(50), Q.BOOST_FEATURES)
    rows.unpersist()
    held.unpersist()


def test_boosting_stops_where_features_tell_nothing(spark):
    rows = spark.range(800).select(F.lit(1).alias("x"), (F.hash("id") % 7).cast("double").alias("y"), F.when(F.xxhash64("id") % 2 == 0, "breath_pause").otherwise("normal_word_gap").alias("label"), (F.col("id") % 4 == 0).alias("held_out"))
    stopped = M.train_boosted_classes(rows, ["x", "y"], rounds=10, depth=3)
    assert 0 < max(stopped.rounds.values()) < 10
    assert {c for c, n in stopped.rounds.items() if n} == {"breath_pause", "normal_word_gap"}
    # no row to stop by: every round is made
    full = M.train_boosted_classes(rows.withColumn("held_out", F.lit(False)), ["x", "y"], rounds=3, depth=2)
    assert full.rounds["breath_pause"] == 3
    empty = M.score_classes(rows.limit(0), stopped)
    assert empty.count() == 0 and M.class_log_loss(empty).first().logloss is None


def test_discovery_on_a_few_documents(spark):
    from tempora.operators import discovery as D
    from tempora.sources import fixtures as X

    w = X.document_words(spark, f"{DATA}/sf0.001").filter("source_id < 6").cache()
    scores = w.groupBy("source_id", F.floor(F.col("start_ms") / 10_000).alias("window_idx")).agg(F.lit("a").alias("provider"), F.round(F.avg(F.length("text")) / 20, 3).alias("raw_score"))
    scores = scores.withColumn("window_start", F.col("window_idx") * 10_000).withColumn("window_end", F.col("window_idx") * 10_000 + 15_000)
    forty = w.groupBy("source_id", F.floor(F.col("word_idx") / 40).alias("k")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("text", "word_idx").alias("hook"), F.max_by("text", "word_idx").alias("payoff_text"))
    model = forty.withColumn("score", (F.col("k") * 37 % 100) / 100.0).withColumn("score_source", F.lit("llm"))
    events = spark.createDataFrame([(0, "Laughter", 0.9, 0, 20_000)], "source_id long, event_type string, confidence double, start_ms long, end_ms long")
    # a model's candidate that is near another with a better score goes
    double = model.filter("k = 1").withColumn("start_ms", F.col("start_ms") + 500).withColumn("score", F.lit(0.01))
    got = D.discover_candidates(w, scores, events, model.unionByName(double), n=3).collect()
    ends = {r.source_id: r.d for r in w.groupBy("source_id").agg(F.max("end_ms").alias("d")).collect()}
    assert {r.source_id for r in got} <= set(ends) and got
    for s in {r.source_id for r in got}:
        mine = sorted((r for r in got if r.source_id == s), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and len({r.cand_id for r in mine}) == len(mine)
        assert sum(r.selected for r in mine) == min(3, sum(r.eligible for r in mine))
        assert all(r.eligible == (r.score_source == "llm" and r.score >= 0.65) for r in mine)
        assert all(0 <= r.start_ms < r.end_ms <= ends[s] for r in mine)
        near = [(a, b) for a in mine for b in mine if a.rank < b.rank and abs(a.start_ms - b.start_ms) < 5000 and abs(a.end_ms - b.end_ms) < 6000]
        assert not near
    assert all((r.n_events > 0) == (r.source_id == 0 and r.start_ms < 20_000) for r in got)
    w.unpersist()
