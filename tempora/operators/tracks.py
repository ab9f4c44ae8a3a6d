"""Detections and tracks: motion, camera mode, prominence, smoothing, containment, merging, layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import clamp, ordered
from ..functions.shared import written
from .intervals import interval_join, interval_join_levels

SHOT = ["source_id", "shot_idx"]
TRACK = [*SHOT, "track_id"]


def shot_motion_profile(diffs: DataFrame, shots: DataFrame) -> DataFrame:
    """Mean frame difference of each shot. diffs: source_id, t_ms, diff. shots: source_id, shot_idx, start_ms, end_ms."""
    points = diffs.select("source_id", "diff", F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 1).alias("end_ms"))
    return interval_join_levels(points, shots).groupBy("source_id", F.col("r_shot_idx").alias("shot_idx")).agg(F.avg("diff").alias("motion"), F.count("*").alias("n_frames"))


def camera_mode(detections: DataFrame, width: float = 1920.0) -> DataFrame:
    """STATIC (little spread and drift, or under 3 samples), PAN (over 75% of steps one way), else TRACK, for each track."""
    w = Window.partitionBy(*TRACK).orderBy("t_ms", "event_id")
    steps = detections.withColumn("step", F.col("cx") - F.lag("cx").over(w))
    order = F.struct("t_ms", "event_id")
    a = steps.groupBy(*TRACK).agg(F.count("*").alias("n"), F.stddev_pop("cx").alias("sd"), F.abs(F.max_by("cx", order) - F.min_by("cx", order)).alias("drift"), F.avg((F.col("step") > 0).cast("double")).alias("up"), F.avg((F.col("step") < 0).cast("double")).alias("down"))
    still = (F.col("n") < 3) | ((F.col("sd") <= width * 0.015) & (F.col("drift") <= width * 0.025))
    one_way = ((F.col("up") > 0.75) | (F.col("down") > 0.75)) & (F.col("drift") > width * 0.025)
    return a.select(*TRACK, F.when(still, "STATIC").when(one_way, "PAN").otherwise("TRACK").alias("mode"))


def prominence(detections: DataFrame, width: float = 1920.0, height: float = 1080.0, weights: tuple[float, ...] = (0.35, 0.25, 0.15, 0.15, 0.10)) -> DataFrame:
    """Weighted size (of frame and shot), frontality, confidence, centrality and stability of each track, 0 to 1."""
    a = detections.groupBy(*TRACK).agg(F.avg("area").alias("area"), F.avg("frontality").alias("front"), F.avg("conf").alias("conf"), F.avg("cx").alias("cx"), F.count("*").alias("n"))
    largest = F.max("area").over(Window.partitionBy(*SHOT))
    in_frame = F.least(F.lit(1.0), F.col("area") / (0.08 * width * height))
    size = F.when(largest > 0, 0.5 * in_frame + 0.5 * F.least(F.lit(1.0), F.col("area") / largest)).otherwise(in_frame)
    central = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.abs(F.col("cx") - width / 2) / (width / 2)))
    parts = [size, F.col("front"), F.col("conf"), central, F.least(F.lit(1.0), F.col("n") / 4.0)]
    score = sum((F.lit(w) * p for w, p in zip(weights[1:], parts[1:])), F.lit(weights[0]) * parts[0])
    return a.select(*TRACK, clamp(score, 0.0, 1.0).alias("prominence"))


#: By window size, for each place from the edge to the middle: the weights of the window's values in a quadratic fit there, and their divisor.
SAVGOL = {
    7: [([32, 15, 3, -4, -6, -3, 5], 42), ([5, 4, 3, 2, 1, 0, -1], 14), ([1, 3, 4, 4, 3, 1, -2], 14), ([-2, 3, 6, 7, 6, 3, -2], 21)],
    5: [([31, 9, -3, -5, 3], 35), ([9, 13, 12, 6, -5], 35), ([-3, 12, 17, 12, -3], 35)],
}


def smooth_trajectory(keyframes: DataFrame, lo: float = 0.0, hi: float = 1920.0) -> DataFrame:
    """``smoothed``: quadratic Savitzky-Golay inside a shot, over 7 keyframes, over 5 in a shot of 5 or 6; a shot of 4 is clipped only, shorter
    ones stay. Ends keep the fit of their side."""
    w = Window.partitionBy(*SHOT).orderBy("t_ms")
    n = F.count("*").over(Window.partitionBy(*SHOT))
    at = lambda k: F.lead("cx", k).over(w) if k >= 0 else F.lag("cx", -k).over(w)
    fit = lambda cs, ks: sum((F.lit(float(c)) * at(k) for c, k in zip(cs[1:], ks[1:])), F.lit(float(cs[0])) * at(ks[0]))
    i, left = F.row_number().over(w) - 1, n - F.row_number().over(w)

    def smooth(size: int) -> Column:
        half = size // 2
        value = fit(SAVGOL[size][half][0], range(-half, half + 1)) / SAVGOL[size][half][1]
        for k, (cs, d) in enumerate(SAVGOL[size][:half]):
            ks = range(-k, size - k)
            value = F.when(i == k, fit(cs, ks) / d).when(left == k, fit(cs, [-x for x in ks]) / d).otherwise(value)
        return value

    return keyframes.withColumn("smoothed", F.when(n >= 7, clamp(smooth(7), lo, hi)).when(n >= 5, clamp(smooth(5), lo, hi)).when(n == 4, clamp(F.col("cx"), lo, hi)).otherwise(F.col("cx")))


def scale_deadband(ideal: DataFrame, band: float = 0.05, max_step: float = 0.02) -> DataFrame:
    """Per shot: the scale follows the ideal only when it leaves the band, by max_step a frame at most."""
    listed = ideal.groupBy(*SHOT).agg(ordered("t_ms", "scale").alias("s"))
    start = F.expr("cast(array() as array<struct<t_ms:bigint,scale:double>>)")

    def step(acc: Column, x: Column) -> Column:
        now = F.element_at(acc, -1)["scale"]
        move = F.greatest(F.lit(-max_step), F.least(F.lit(max_step), x["scale"] - now))
        value = F.when(F.size(acc) == 0, x["scale"]).when(F.abs(x["scale"] - now) <= band, now).otherwise(now + move)
        return F.concat(acc, F.array(F.struct(x["t_ms"].alias("t_ms"), value.alias("scale"))))

    return listed.select(*SHOT, F.inline(F.aggregate("s", start, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x["t_ms"].alias("t_ms"), x["scale"].alias("scale")))).otherwise(step(acc, x)))))


def hold_segments(samples: DataFrame, min_hold: int = 3, jump: float = 120.0) -> DataFrame:
    """Per shot: segments of held position. It moves only to a place ``jump`` or more away where min_hold samples in a row stay within ``jump``
    of the one before; then it is their median, from the first of them on. A sample near the held position, or a scattered one, starts the count anew.
    A fold over a shot's samples in the JVM; min_hold of them at most are kept in its state.
    """
    listed = samples.groupBy(*SHOT).agg(ordered("t_ms", "cx").alias("s"))
    state = lambda held, wait, done: F.struct(held.alias("held"), wait.alias("wait"), done.alias("done"))
    none = F.expr("cast(array() as array<struct<t_ms:bigint,cx:double>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["wait"], F.lit(-1))["cx"]
        here = F.array(F.struct(x["t_ms"].alias("t_ms"), x["cx"].alias("cx")))
        wait = F.when(F.abs(x["cx"] - last) >= jump, here).otherwise(F.concat(acc["wait"], here))
        values = F.sort_array(F.transform(wait, lambda v: v["cx"]))
        middle = (F.get(values, F.lit((min_hold - 1) // 2)) + F.get(values, F.lit(min_hold // 2))) / 2
        moved = state(middle, none, F.concat(acc["done"], F.array(F.struct(F.get(wait, F.lit(0))["t_ms"].alias("t_ms"), middle.alias("cx")))))
        near = F.abs(x["cx"] - acc["held"]) < jump
        return F.when(near, state(acc["held"], none, acc["done"])).when(F.size(wait) >= min_hold, moved).otherwise(state(acc["held"], wait, acc["done"]))

    first = F.col("s")[0]
    start = state(first["cx"], none, F.array(F.struct(first["t_ms"].alias("t_ms"), first["cx"].alias("cx"))))
    held = F.aggregate(F.slice("s", F.lit(2), F.size("s")), start, step, lambda acc: acc["done"])
    points = listed.select(*SHOT, F.element_at("s", -1)["t_ms"].alias("last"), F.posexplode(held).alias("k", "p"))
    ends = F.lead("p.t_ms").over(Window.partitionBy(*SHOT).orderBy("k"))
    return points.select(*SHOT, F.col("p.t_ms").alias("start_ms"), F.coalesce(ends, "last").alias("end_ms"), F.col("p.cx").alias("cx"))


def containment_violations(keyframes: DataFrame, detections: DataFrame, tolerance: float = 20.0, width: float = 608.0, least: int = 2) -> DataFrame:
    """Runs of at least two samples in a row outside the crop that is active at their time (crop_x of the last keyframe), by source."""
    k = keyframes.select("source_id", F.col("t_ms").alias("t"), F.lit(0).alias("side"), F.col("crop_x"), F.lit(None).cast("double").alias("cx"))
    d = detections.select("source_id", F.col("t_ms").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("crop_x"), "cx")
    w = Window.partitionBy("source_id").orderBy("t", "side")
    active = k.unionByName(d).withColumn("active", F.last("crop_x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("side = 1 and active is not null")
    out = active.withColumn("out", (F.col("cx") < F.col("active") - tolerance) | (F.col("cx") > F.col("active") + width + tolerance))
    o = Window.partitionBy("source_id").orderBy("t", "cx")
    runs = out.withColumn("isl", F.row_number().over(o) - F.row_number().over(Window.partitionBy("source_id", "out").orderBy("t", "cx"))).filter("out")
    return runs.groupBy("source_id", "isl").agg(F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("isl")


def extrapolate_position(detections: DataFrame, points: DataFrame, ahead_ms: int = 1000) -> DataFrame:
    """cx of each track at later points (source_id, shot_idx, track_id, t_ms): from its last two detections .05 to 2 s apart, at most ahead_ms on; else the last one. Of detections at one time the greater event_id is later."""
    w = Window.partitionBy(*TRACK).orderBy("t_ms", "event_id")
    d = detections.withColumn("pt", F.lag("t_ms").over(w)).withColumn("px", F.lag("cx").over(w))
    d = d.select(*TRACK, F.col("t_ms").alias("t"), F.lit(0).alias("side"), F.col("event_id").alias("tie"), F.struct("t_ms", "cx", "pt", "px").alias("last"))
    p = points.select(*TRACK, F.col("t_ms").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(d.schema["tie"].dataType).alias("tie"), F.lit(None).cast(d.schema["last"].dataType).alias("last"))
    o = Window.partitionBy(*TRACK).orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    found = d.unionByName(p).withColumn("last", F.last("last", ignorenulls=True).over(o)).filter("side = 1")
    dt = F.col("last.t_ms") - F.col("last.pt")
    moves = (dt > 50) & (dt < 2000) & (F.col("t") - F.col("last.t_ms") <= ahead_ms)
    return found.select(*TRACK, F.col("t").alias("t_ms"), F.when(moves, F.col("last.cx") + (F.col("last.cx") - F.col("last.px")) / dt * (F.col("t") - F.col("last.t_ms"))).otherwise(F.col("last.cx")).alias("cx"))


def associate(new: DataFrame, tracks: DataFrame, reach: float = 250.0) -> DataFrame:
    """New detections (source_id, det_id, cx, embedding) to the nearest track within reach; if two or more are plausible, to the most similar one."""
    from .speakers import cosine

    cell = lambda c: F.floor(F.col(c) / reach)
    a = new.withColumn("_c", F.explode(F.array(cell("cx") - 1, cell("cx"), cell("cx") + 1)))
    b = tracks.select("source_id", "track_id", F.col("cx").alias("tx"), F.col("embedding").alias("te")).withColumn("_c", cell("tx"))
    j = a.join(b, ["source_id", "_c"]).withColumn("d", F.abs(F.col("cx") - F.col("tx"))).filter(F.col("d") < reach)
    j = j.withColumn("n", F.count("*").over(Window.partitionBy("source_id", "det_id"))).withColumn("sim", F.round(cosine(F.col("embedding"), F.col("te")), 6))
    best = F.min(F.struct(F.when(F.col("n") > 1, -F.col("sim")).otherwise(F.col("d")).alias("k"), F.col("track_id")))
    return j.groupBy("source_id", "det_id").agg(best.alias("b"), F.max("n").alias("plausible")).select("source_id", "det_id", F.col("b.track_id").alias("track_id"), "plausible")


def track_edges(tracks: DataFrame, near: float = 80.0, together_ms: int = 300, gap_ms: int = 1000, bucket_ms: int = 14_400_000) -> DataFrame:
    """Pairs of a shot's tracks that are one person: seen within together_ms and near, or one ends up to gap_ms before the other begins nearby.

    tracks: source_id, shot_idx, track_id, start_ms, end_ms, cx. Of a pair the one that begins later lies in the bucket of its start alone, the other in
    all buckets from its start to gap_ms after its end, so each pair meets once.
    """
    rows = tracks.select(*TRACK, "start_ms", "end_ms", "cx").filter("end_ms >= start_ms")
    cell = lambda c: F.floor(c / bucket_ms)
    first = rows.select(*SHOT, F.col("track_id").alias("x"), F.col("start_ms").alias("s"), (F.col("end_ms") + gap_ms).alias("until"), F.col("cx").alias("cx_x"))
    first = first.withColumn("_bucket", F.explode(F.sequence(cell(F.col("s")), cell(F.col("until")))))
    later = rows.select(*SHOT, F.col("track_id").alias("y"), "start_ms", "cx", cell(F.col("start_ms")).alias("_bucket"))
    after = (F.col("start_ms") > F.col("s")) | ((F.col("start_ms") == F.col("s")) & (F.col("x") < F.col("y")))
    pairs = first.join(later.hint("merge"), [*SHOT, "_bucket"]).filter(after & (F.col("start_ms") <= F.col("until")) & (F.col("x") != F.col("y")) & (F.abs(F.col("cx") - F.col("cx_x")) <= near))
    return pairs.select(*SHOT, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def merge_tracks(tracks: DataFrame, edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """tracks with ``person``: the least track_id of those joined by edges in a shot.

    Each round a track takes the least label among its neighbours', tells its old label's track, and takes its label's label, so long
    chains halve; an error if the labels do not settle. Tracks without an edge take no part, and an edge whose ends have one label is left out from
    then on: the ends follow their label.
    """
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = written(edges.select(*SHOT, turned).select(*SHOT, "e.a", "e.b").filter("a <> b").distinct(), "edges")
    near = both.groupBy(*SHOT, F.col("a").alias("track_id")).agg(F.min("b").alias("near"))
    # the first round needs no labels: each track is its own
    labels = written(near.select(*TRACK, F.least("track_id", "near").alias("person")), "labels")
    for _ in range(max_rounds):
        ends = both.join(labels.select(*SHOT, F.col("track_id").alias("b"), F.col("person").alias("pb")), [*SHOT, "b"])
        ends = ends.join(labels.select(*SHOT, F.col("track_id").alias("a"), F.col("person").alias("pa")), [*SHOT, "a"]).filter("pa <> pb")
        ends = written(ends, "ends")
        both = ends.select(*SHOT, "a", "b")
        near = ends.groupBy(*SHOT, F.col("a").alias("track_id")).agg(F.min("pb").alias("near"))
        nearer = labels.join(near, TRACK, "left").select(*TRACK, F.col("person").alias("was"), F.least("person", F.coalesce("near", "person")).alias("new"))
        hooks = nearer.filter("new <> was").groupBy(*SHOT, "was").agg(F.min("new").alias("hook"))
        hooked = nearer.join(hooks, [*SHOT, "was"], "left").select(*TRACK, "was", F.least("new", F.coalesce("hook", "new")).alias("new"))
        jump = hooked.filter("track_id <> new").select(*SHOT, F.col("track_id").alias("new"), F.col("new").alias("jumped"))
        following = written(hooked.join(jump, [*SHOT, "new"], "left").select(*TRACK, "was", F.least("new", F.coalesce("jumped", "new")).alias("person")), "labels")
        labels = following.drop("was")
        if following.filter("was <> person").isEmpty():
            return tracks.join(labels, TRACK, "left").withColumn("person", F.coalesce("person", "track_id"))
    raise RuntimeError("tracks did not settle")


def united_detections(persons: DataFrame, detections: DataFrame, grain_ms: int = 1) -> DataFrame:
    """source_id, shot_idx, person, track_id (the detection's own), t_ms and detections' other columns of every person.

    persons: TRACK and person (``merge_tracks``), one row a track. A person's track with the most detections (the least track_id of equals) gives all of
    its own. The others, in order of track_id, give theirs at times that no track before them covers: those of one ``grain_ms`` are one time, and the first
    by t_ms and the other columns is taken. Leaders are found among tracks; detections are dealt twice, by track and by (person, time), where one
    order settles who gives, so neither tracks are compared with each other nor a person's detections lie together.
    """
    sizes = detections.groupBy(*TRACK).agg(F.count("*").alias("n"))
    leader = persons.join(sizes, TRACK).groupBy(*SHOT, "person").agg(F.max_by("track_id", F.struct("n", -F.col("track_id"))).alias("track_id"))
    named = detections.join(persons.select(*TRACK, "person"), TRACK).join(leader.select(*TRACK, F.lit(True).alias("_leads")), TRACK, "left")
    more = sorted(c for c in detections.columns if c not in (*TRACK, "t_ms"))
    at = named.withColumn("_at", F.floor(F.col("t_ms") / grain_ms)).withColumn("_leads", F.coalesce("_leads", F.lit(False)))
    unknown = F.when(F.col("_at").isNull(), F.col("_leads"))  # a missing time covers no other track's
    turn = F.row_number().over(Window.partitionBy(*SHOT, "person", "_at", unknown).orderBy(F.desc("_leads"), "track_id", "t_ms", *more))
    return at.withColumn("_turn", turn).filter("_leads or _turn = 1").select(*SHOT, "person", "track_id", "t_ms", *more)


def merged_tracks(persons: DataFrame, detections: DataFrame, grain_ms: int = 1) -> DataFrame:
    """source_id, shot_idx, person, n_tracks, n_detections, start_ms, end_ms, cx (mean) of every person, from their united detections (with cx)."""
    united = united_detections(persons, detections, grain_ms)
    return united.groupBy(*SHOT, "person").agg(
        F.countDistinct("track_id").alias("n_tracks"), F.count("*").alias("n_detections"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.avg("cx").alias("cx"))


def layout_state_machine(frames: DataFrame, enter_ms: int = 600, leave_ms: int = 750) -> DataFrame:
    """Per shot: mode (single or dual) over time from frames (t_ms, pair, n_people): dual after the same valid pair for enter_ms, back after its
    absence for leave_ms or at once with three or more. pair is null where there is no valid one. One fold per shot."""
    listed = frames.groupBy(*SHOT).agg(ordered("t_ms", "pair", "n_people").alias("f"))
    kind = "struct<t_ms:bigint,mode:string,pair:string>"
    start = F.expr(f"named_struct('out', cast(array() as array<{kind}>), 'mode', 'single', 'held', cast(null as string), 'seen', cast(null as string), 'since', cast(null as bigint), 'gone', cast(null as bigint))")

    def step(acc: Column, x: Column) -> Column:
        same = acc["seen"].eqNullSafe(x["pair"]) & x["pair"].isNotNull()
        since = F.when(same, acc["since"]).otherwise(F.when(x["pair"].isNotNull(), x["t_ms"]))
        here = x["pair"].eqNullSafe(acc["held"]) & acc["held"].isNotNull()
        gone = F.when(here, F.lit(None).cast("bigint")).otherwise(F.coalesce(acc["gone"], x["t_ms"]))
        dual = acc["mode"] == "dual"
        leaves = dual & ((x["n_people"] >= 3) | (~here & (x["t_ms"] - gone >= leave_ms)))
        enters = ~dual & x["pair"].isNotNull() & (x["n_people"] < 3) & (x["t_ms"] - since >= enter_ms)
        mode = F.when(leaves, "single").when(enters, "dual").otherwise(acc["mode"])
        held = F.when(leaves, F.lit(None).cast("string")).when(enters, x["pair"]).otherwise(acc["held"])
        row = F.struct(x["t_ms"].alias("t_ms"), mode.alias("mode"), held.alias("pair"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), mode.alias("mode"), held.alias("held"), x["pair"].alias("seen"), since.alias("since"), F.when(mode == "dual", gone).alias("gone"))

    return listed.select(*SHOT, F.inline(F.aggregate("f", start, step, lambda acc: acc["out"])))
