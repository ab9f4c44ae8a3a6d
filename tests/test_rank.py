"""Suppression rounds, vector products and curve metrics against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import qa, rank

CANDS = "source_id long, cand_id long, start_ms long, end_ms long, hook string, score double, score_source string"


def plain_greedy(rows):
    kept = []
    for s, c, a, b, h, score, kind in sorted(rows, key=lambda r: (r[0], r[6] != "llm", -r[5], r[2], r[3], r[1])):
        def clash(k):
            both, shorter = max(min(b, k[3]) - max(a, k[2]), 0), max(min(b - a, k[3] - k[2]), 1000)  # noqa: B023
            return k[0] == s and ((abs(a - k[2]) < 5000 and abs(b - k[3]) < 6000) or (both / shorter > 0.65 and k[4] == h))  # noqa: B023

        if not any(map(clash, kept)):
            kept.append((s, c, a, b, h, score, kind))
    return sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_keep_what_a_fold_keeps(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        a = rng.randrange(0, 300_000)
        rows.append((i % 3, i, a, a + rng.randrange(500, 40_000), rng.choice("hijk"), rng.choice([0.1, 0.5, 0.5, 0.9]), rng.choice(["llm", "fallback"])))
    got = sorted(tuple(r) for r in rank.dedup_greedy(spark.createDataFrame(rows, CANDS)).collect())
    assert got == plain_greedy(rows)


def test_a_chain_of_conflicts_alternates(spark):
    # each one is near the next better one alone, so every second stays
    rows = [(1, i, 4000 * i, 4000 * i + 9000, f"h{i}", 1 - i / 100, "llm") for i in range(13)]
    assert sorted(r.cand_id for r in rank.dedup_greedy(spark.createDataFrame(rows, CANDS)).collect()) == list(range(0, 13, 2))


def test_a_large_source_ends(spark):
    rows = spark.range(50_000).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("cand_id"), (F.col("id") * 3000).alias("start_ms"), (F.col("id") * 3000 + 20_000).alias("end_ms"),
                                      F.lit("h").alias("hook"), (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007).alias("score"), F.lit("llm").alias("score_source"))
    kept = [r.start_ms for r in rank.dedup_greedy(rows).select("start_ms").orderBy("start_ms").collect()]
    # no two kept ones conflict, and no gap is wide enough for one more
    assert all(9000 <= b - a < 18_000 for a, b in zip(kept, kept[1:])) and kept[0] < 9000


def test_dot_products(spark):
    rng = random.Random(3)
    vectors = [{rng.choice("abcdefghij"): rng.random() for _ in range(rng.randrange(0, 8))} for _ in range(12)]
    df = spark.createDataFrame([(1, i, t, w) for i, v in enumerate(vectors) for t, w in v.items()], "source_id long, cand_id long, term string, weight double")
    pairs = [(1, i, j) for i in range(12) for j in range(i)]
    got = {(r.a_id, r.b_id): r.similarity for r in rank.cosine_pairs(rank.term_vectors(df), spark.createDataFrame(pairs, "source_id long, a_id long, b_id long")).collect()}
    want = {(i, j): sum(vectors[i][t] * vectors[j][t] for t in vectors[i] if t in vectors[j]) for _, i, j in pairs if set(vectors[i]) & set(vectors[j])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_areas_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.3), 0, round(rng.random(), 3)) for _ in range(3000)]
    got = qa.classification_metrics(spark.createDataFrame(rows, "truth int, predicted int, p double").repartition(6)).first()
    pos, neg = [p for t, _, p in rows if t], [p for t, _, p in rows if not t]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got.auc - auc) < 1e-12
    at = lambda s: (sum(p >= s for p in pos), sum(p >= s for p in neg))
    ap = sum(sum(p == s for p in pos) * at(s)[0] / sum(at(s)) for s in set(pos)) / len(pos)
    assert abs(got.pr_auc - ap) < 1e-9
