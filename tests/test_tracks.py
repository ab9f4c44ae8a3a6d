"""Track merging on long chains; association over whole tables."""

import random

import pytest
from conftest import DATA

from tempora.operators import tracks as T
from tempora.plans.q_tracks import detections_and_tracks, o41_associate


def test_a_long_chain_is_one_person(spark):
    ids = list(range(1, 301))
    random.Random(1).shuffle(ids)
    rows = [(0, 0, i) for i in ids] + [(0, 1, i) for i in ids[:3]] + [(0, 0, 900)]
    tracks = spark.createDataFrame(rows, "source_id long, shot_idx long, track_id long")
    edges = spark.createDataFrame([(0, 0, a, b) for a, b in zip(ids, ids[1:])], "source_id long, shot_idx long, a long, b long")
    got = {(r.shot_idx, r.track_id): r.person for r in T.merge_tracks(tracks, edges).collect()}
    assert len(got) == len(rows) and got[0, 900] == 900
    assert {got[0, i] for i in ids} == {1} and all(got[1, i] == i for i in ids[:3])
    with pytest.raises(RuntimeError):
        T.merge_tracks(tracks, edges, max_rounds=1)


def test_every_vector_has_a_role_in_association(spark):
    path = f"{DATA}/sf0.001"
    new, tracks = (d.drop("embedding").collect() for d in detections_and_tracks(spark, path))
    ids = [r.det_id for r in new] + [r.track_id for r in tracks]
    assert sorted(ids) == sorted(r.vec_id for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id").collect())
    near = {d.det_id: {t.track_id for t in tracks if t.source_id == d.source_id and abs(t.cx - d.cx) < 250} for d in new}
    got = {r.det_id: r for r in o41_associate(spark, path).collect()}
    assert set(got) == {d for d, n in near.items() if n}
    assert all(r.track_id in near[d] and r.plausible == len(near[d]) for d, r in got.items())


def test_detections_of_a_person_are_united_at_uncovered_times(spark):
    rng = random.Random(4)
    persons = {k: k // 4 for k in range(24)}
    rows = [(0, 0, k, t * 10 + rng.randrange(10), float(k)) for k in persons for t in rng.sample(range(30), rng.randrange(1, 12))] + [(0, 1, 3, 5, 0.5)]
    detections = spark.createDataFrame(rows, "source_id long, shot_idx long, track_id long, t_ms long, cx double")
    named = spark.createDataFrame([(0, 0, k, p) for k, p in persons.items()] + [(0, 1, 3, 3)], "source_id long, shot_idx long, track_id long, person long")
    want = [(1, 3, 3, 5, 0.5)]
    for p in set(persons.values()):
        mine = {k: sorted(r[3:] for r in rows if r[1] == 0 and r[2] == k) for k, q in persons.items() if q == p}
        leader = max(mine, key=lambda k: (len(mine[k]), -k))
        covered = {t // 10 for t, _ in mine[leader]}
        want += [(0, p, leader, t, x) for t, x in mine[leader]]
        for k in sorted(mine):
            for t, x in mine[k] if k != leader else []:
                if t // 10 not in covered:
                    covered.add(t // 10)
                    want.append((0, p, k, t, x))
    got = [(r.shot_idx, r.person, r.track_id, r.t_ms, r.cx) for r in T.united_detections(named, detections, 10).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(rows)
    summed = {(r.shot_idx, r.person): (r.n_detections, r.start_ms) for r in T.merged_tracks(named, detections, 10).collect()}
    assert summed == {key: (sum(w[:2] == key for w in want), min(w[3] for w in want if w[:2] == key)) for key in {w[:2] for w in want}}
