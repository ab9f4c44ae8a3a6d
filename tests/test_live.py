"""Live operators: event-time state against a fold in plain Python, and upserts by batches."""

import random

import pytest

from tempora.functions.shared import shared_path
from tempora.plans.q_streaming import finished, streamed
from tempora.streaming import live as L

SCORES = "source_id long, track_id long, t_ms long, p double"


def fold(rows, on, off, cooldown, idle=10**18):
    """Changes of every track's state from its rows in time order."""
    want, states = [], {}
    for s, k, t, p in sorted(rows, key=lambda r: (r[2], r[3])):
        speaking, since, last = states.get((s, k), (False, -(10**15), t))
        if t - last > idle:
            speaking, since = False, -(10**15)
        if t - since >= cooldown and ((not speaking and p >= on) or (speaking and p < off)):
            speaking, since = not speaking, t
            want.append((s, k, t, speaking))
        states[s, k] = (speaking, since, t)
    return sorted(want)


def test_a_hot_track_is_folded_in_time_order(spark):
    rng = random.Random(6)
    rows = [(0, 1, t, rng.random()) for t in range(25_000)] + [(1, 2, t, rng.random()) for t in range(50)]
    mixed = [*rows, (-1, -1, 10**9, 0.0)]
    rng.shuffle(mixed)
    scores = spark.createDataFrame(mixed, SCORES).repartition(5)
    got = sorted(tuple(r) for r in finished(L.live_hysteresis(streamed(spark, scores), 0.5, 0.35, 7)).collect())
    assert got == fold(rows, 0.5, 0.35, 7)


@pytest.mark.parametrize("idle", [400, 10**12])
def test_rows_late_by_triggers_fold_like_a_batch(spark, idle):
    """Rows come up to 900 ms out of order over nine triggers; ties and an idle track are among them."""
    rng = random.Random(idle)
    rows = [(0, k, t * 10 + (t > 500) * 3000, round(rng.random(), 2)) for t in range(1000) for k in range(3) if rng.random() < 0.5]
    rows += [(7, 1, 50, 0.9), (7, 1, 50, 0.1)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(900))
    parts = [arrival[i::1][k * len(arrival) // 8 : (k + 1) * len(arrival) // 8] for i in [0] for k in range(8)] + [[(-1, -1, 10**9, 0.0)]]
    root = shared_path(spark, "late")
    for part in parts:  # one file after the other
        spark.createDataFrame(part, SCORES).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = L.live_hysteresis(spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), 0.5, 0.35, 30, "1 second", idle)
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{root}/out").collect())
    assert got == fold(rows, 0.5, 0.35, 30, idle)
    progress = [p for p in run.recentProgress if p.stateOperators]
    assert len(progress) >= 9 and max(p.stateOperators[0].numRowsTotal for p in progress) >= 3
    if idle < 10**6:  # all tracks are past their idle time: their state is gone, but for the last row's own
        assert progress[-1].stateOperators[0].numRowsTotal <= 1


def test_upserts_keep_the_newest_row_and_replay_alike(spark):
    schema = "k long, n long, x string"
    batches = [spark.createDataFrame(rows, schema) for rows in ([(1, 1, "a"), (2, 5, "b")], [(1, 3, "c"), (2, 4, "old"), (3, 1, "d")], [(1, 2, "older"), (4, 1, "e")])]
    path = shared_path(spark, "upsert-test")
    put = L.upsert_batches(path, ["k"], "n")
    for i in (0, 1, 1, 2, 2):  # batches 1 and 2 are run again, as after a failure
        put(batches[i], i)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    schema = batches[0].schema
    assert rows(L.latest_version(spark, path, schema)) == [(1, 3, "c"), (2, 5, "b"), (3, 1, "d"), (4, 1, "e")]
    assert rows(L.latest_version(spark, path, schema, before=1)) == [(1, 1, "a"), (2, 5, "b")]
    assert L.latest_version(spark, path + "-none", schema).count() == 0
