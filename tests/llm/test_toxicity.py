"""FTRL against a plain version, one coordinate after the other, and repeated ids in any row order."""

import math
import random

import numpy as np

from tempora.llm import toxicity


def plain_ftrl(features, labels, alpha=1.0, beta=1.0, l1=5.0, l2=1.0, epochs=5):
    z, n = {}, {}

    def weight(i):
        zi, penalty = z.get(i, 0.0), 0.0 if i == "bias" else l1
        return 0.0 if abs(zi) <= penalty else -(zi - math.copysign(penalty, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for x, y in zip(features, labels):
            w = {i: weight(i) for i in [*x, "bias"]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * wi
                n[i] = old + g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}, weight("bias")


def test_ftrl_against_a_plain_version():
    rng = random.Random(2)
    features = [np.array(sorted(rng.sample(range(60), rng.randrange(0, 15))), np.int64) for _ in range(300)]
    labels = np.array([int(any(i in (3, 9) for i in x) or rng.random() < 0.1) for x in features])
    used, values, bias = toxicity.ftrl_fit(features, labels, 60, l1=1.0)
    want, want_bias = plain_ftrl([x.tolist() for x in features], labels.tolist(), l1=1.0)
    assert set(used.tolist()) == set(want) and 5 < len(want) < 60
    assert abs(bias - want_bias) < 1e-9 and all(abs(want[i] - v) < 1e-9 for i, v in zip(used.tolist(), values))


def test_repeated_ids_give_one_model_in_every_row_order(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta vile awful nasty kind good plain".split()
    rows = [(i, " ".join(rng.choices(words[4:7] if i % 2 else words, k=8))) for i in range(60)]
    rows += [(5, t) for t in ("one text of it", "another kind text", None, "one text of it")] * 30 + [(None, "vile")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    models = []
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(rng.randrange(1, 6))
        models.append(toxicity.fit(df, labels, l1=0.5))
    for used, values, bias in models[1:]:
        assert np.array_equal(used, models[0][0]) and np.array_equal(values, models[0][1]) and bias == models[0][2]
    # the repeated id counts once: as if the least text by its hash alone were there
    kept = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as h").filter("doc_id is not null").collect()
    least = {}
    for r in kept:
        least[r.doc_id] = min(least.get(r.doc_id, (r.h, r.text)), (r.h, r.text), key=lambda x: x[0])
    alone = toxicity.fit(spark.createDataFrame([(i, t) for i, (_, t) in least.items()], "doc_id long, text string"), labels, l1=0.5)
    assert np.array_equal(alone[0], models[0][0]) and np.array_equal(alone[1], models[0][1])
