"""Queries: detections and tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tracks as T
from ..sources import fixtures as X
from .registry import query
from .sql import DETECTIONS, INTERVALS, with_

WIDE = "wide as (select *, (event_id * 37) % 400000 / 1.0 as area, (event_id * 19) % 100 / 100.0 as frontality from detections)"


def detections(spark, sf_dir):
    d = X.detections(X.intervals(spark, sf_dir))
    return d.withColumn("area", (F.col("event_id") * 37) % 400000 / 1.0).withColumn("frontality", (F.col("event_id") * 19) % 100 / 100.0)


@query(with_(INTERVALS, DETECTIONS) + """
, s as (select source_id, shot_idx, shot_idx * 86400000 as s, shot_idx * 86400000 + 43200000 as e from (select distinct source_id, shot_idx from detections))
select s.source_id, s.shot_idx, round(avg(motion), 6) as motion, count(*) as n_frames from s join detections d on d.source_id = s.source_id and d.t_ms + 1 > s and d.t_ms < e group by 1, 2""")
def o93_shot_motion_profile(spark, sf_dir):
    d = detections(spark, sf_dir)
    shots = d.select("source_id", "shot_idx").distinct().select("source_id", "shot_idx", (F.col("shot_idx") * 86_400_000).alias("start_ms"), (F.col("shot_idx") * 86_400_000 + 43_200_000).alias("end_ms"))
    return T.shot_motion_profile(d.select("source_id", "t_ms", F.col("motion").alias("diff")), shots).withColumn("motion", F.round("motion", 6))


@query(with_(INTERVALS, DETECTIONS) + """
, z as (select 0 as shot_idx, * exclude (shot_idx) from detections), s as (select *, cx - lag(cx) over (partition by source_id, track_id order by t_ms, event_id) as step from z),
a as (select source_id, shot_idx, track_id, count(*) as n, stddev_pop(cx) as sd, abs(arg_max(cx, (t_ms, event_id)) - arg_min(cx, (t_ms, event_id))) as drift, avg((step > 0)::int) as up, avg((step < 0)::int) as down from s group by 1, 2, 3)
select source_id, shot_idx, track_id, case when n < 3 or (sd <= 28.8 and drift <= 48) then 'STATIC' when (up > 0.75 or down > 0.75) and drift > 48 then 'PAN' else 'TRACK' end as mode from a""")
def o94_camera_mode(spark, sf_dir):
    return T.camera_mode(detections(spark, sf_dir).withColumn("shot_idx", F.lit(0)))


@query(with_(INTERVALS, DETECTIONS, WIDE) + """
, a as (select source_id, shot_idx, track_id, avg(area) as area, avg(frontality) as front, avg(conf) as conf, avg(cx) as cx, count(*) as n from wide group by 1, 2, 3), m as (select *, max(area) over (partition by source_id, shot_idx) as mx from a)
select source_id, shot_idx, track_id, round(greatest(0, least(1, 0.35::double * (case when mx > 0 then 0.5 * least(1.0, area / 165888.0) + 0.5 * least(1.0, area / mx) else least(1.0, area / 165888.0) end) + 0.25 * front + 0.15 * conf + 0.15 * greatest(0, 1 - least(1, abs(cx - 960) / 960)) + 0.10 * least(1.0, n / 4.0)))::double, 6) as prominence from m""")
def o95_prominence(spark, sf_dir):
    return T.prominence(detections(spark, sf_dir)).withColumn("prominence", F.round("prominence", 6))


def keyframes(spark, sf_dir):
    """One position a time for each source."""
    d = detections(spark, sf_dir)
    return d.groupBy("source_id", F.lit(0).cast("long").alias("shot_idx"), "t_ms").agg(F.min("cx").alias("cx"))


KEYFRAMES = "kf as (select source_id, 0::bigint as shot_idx, t_ms, min(cx) as cx from detections group by source_id, t_ms)"
_FITS = ", ".join(f"({size}, {j}, {list(cs)}::double[], {d})" for size, places in T.SAVGOL.items() for j, (cs, d) in enumerate([*places, *[(c[::-1], e) for c, e in places[-2::-1]]]))


@query(with_(INTERVALS, DETECTIONS, KEYFRAMES) + f"""
, fits(wl, j, cs, d) as (values {_FITS}),
l as (select source_id, shot_idx, list(cx order by t_ms) as x, count(*) as n, case when count(*) >= 7 then 7 when count(*) >= 5 then 5 else 1 end as wl from kf group by 1, 2),
p as (select k.*, x, n, wl, row_number() over (partition by source_id, shot_idx order by t_ms) - 1 as i from kf k join l using (source_id, shot_idx)),
b as (select *, greatest(0, least(i - wl // 2, n - wl)) as s from p),
f as (select b.*, list_sum(list_transform(range(b.wl), lambda q: cs[q + 1] * x[s + q + 1])) / d as v from b left join fits on fits.wl = b.wl and fits.j = i - s)
select source_id, shot_idx, t_ms, cx, round(case when n < 4 then cx else greatest(0, least(1920, coalesce(v, cx))) end, 6) as smoothed from f""")
def o96_smooth_trajectory(spark, sf_dir):
    return T.smooth_trajectory(keyframes(spark, sf_dir)).withColumn("smoothed", F.round("smoothed", 6))


@query(with_(INTERVALS, DETECTIONS, KEYFRAMES) + """
, k as (select *, row_number() over (partition by source_id, shot_idx order by t_ms) as i, max(t_ms) over (partition by source_id, shot_idx) as last from kf),
r as (select source_id, shot_idx, last, i, cx as held, []::bigint[] as wt, []::double[] as wx, t_ms as begun from k where i = 1 union all
  select source_id, shot_idx, last, i, case when moved then list_aggregate(nx, 'median') else held end, case when moved or near then [] else nt end, case when moved or near then [] else nx end, case when moved then nt[1] end from
  (select *, not near and len(nx) >= 3 as moved from (select k.source_id, k.shot_idx, k.last, k.i, r.held, abs(k.cx - r.held) < 200 as near,
     case when len(r.wx) > 0 and abs(k.cx - r.wx[-1]) >= 200 then [k.t_ms] else list_append(r.wt, k.t_ms) end as nt, case when len(r.wx) > 0 and abs(k.cx - r.wx[-1]) >= 200 then [k.cx] else list_append(r.wx, k.cx) end as nx
     from r join k on k.source_id = r.source_id and k.shot_idx = r.shot_idx and k.i = r.i + 1) y) z)
select source_id, shot_idx, begun as start_ms, coalesce(lead(begun) over (partition by source_id, shot_idx order by i), last) as end_ms, held as cx from r where begun is not null""")
def o97_hold_segments(spark, sf_dir):
    return T.hold_segments(keyframes(spark, sf_dir), 3, 200.0)


@query(with_(INTERVALS, DETECTIONS) + """
, k as (select source_id, t_ms as t, 0 as side, round(cx / 2) as crop_x, null::double as cx, event_id from detections where event_id % 4 = 0), d as (select source_id, t_ms, 1, null::double, cx, event_id from detections where event_id % 4 <> 0),
u as (select *, last_value(crop_x ignore nulls) over (partition by source_id order by t, side rows unbounded preceding) as active from (select * from k union all select * from d)),
o as (select source_id, t, cx, cx < active - 20 or cx > active + 628 as outside from u where side = 1 and active is not null),
r as (select *, row_number() over (partition by source_id order by t, cx) - row_number() over (partition by source_id, outside order by t, cx) as isl from o)
select source_id, min(t) as start_ms, max(t) as end_ms, count(*) as n from r where outside group by source_id, isl having count(*) >= 2""")
def o98_containment_violations(spark, sf_dir):
    d = detections(spark, sf_dir)
    return T.containment_violations(d.filter("event_id % 4 = 0").withColumn("crop_x", F.round(F.col("cx") / 2)), d.filter("event_id % 4 <> 0"))


@query(with_(INTERVALS, DETECTIONS) + """
, d as (select source_id, shot_idx, track_id, event_id, cx, cast(floor(t_ms / 100000.0) as bigint) as t from detections),
l as (select *, lag(t) over w as pt, lag(cx) over w as px, row_number() over (partition by source_id, shot_idx, track_id order by t desc, event_id desc) as k from d window w as (partition by source_id, shot_idx, track_id order by t, event_id))
select source_id, shot_idx, track_id, t + 400 as t_ms, round(case when t - pt > 50 and t - pt < 2000 then cx + (cx - px) / (t - pt) * 400 else cx end, 6) as cx from l where k = 1""")
def o134_extrapolate_position(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("t_ms", F.floor(F.col("t_ms") / 100_000))
    points = d.groupBy(*T.TRACK).agg((F.max("t_ms") + 400).alias("t_ms"))
    return T.extrapolate_position(d, points).withColumn("cx", F.round("cx", 6))


def detections_and_tracks(spark, sf_dir):
    """Every vector as a detection or as a track, by a hash; 256 vectors in a row are a source, which bounds its pairs."""
    e = X.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("source_id"), "vec_id", "embedding", ((F.col("vec_id") * 37) % 1920).cast("double").alias("cx"))
    new = F.pmod(F.xxhash64("vec_id"), F.lit(2)) == 0
    return e.filter(new).withColumnRenamed("vec_id", "det_id"), e.filter(~new).withColumnRenamed("vec_id", "track_id")


@query()
def o41_associate(spark, sf_dir):
    return T.associate(*detections_and_tracks(spark, sf_dir))


@query()
def o123_merge_tracks(spark, sf_dir):
    i = X.intervals(spark, sf_dir)
    tracks = i.select("source_id", F.lit(0).cast("long").alias("shot_idx"), F.col("event_id").alias("track_id"), "start_ms", "end_ms", (F.col("value") * 3.84).alias("cx"))
    return T.merge_tracks(tracks, T.track_edges(tracks)).select("source_id", "track_id", "person")


@query(with_(INTERVALS, """
tr as (select source_id, event_id as track_id, start_ms, end_ms, value * 3.84 as cx from intervals),
ed as (select a.source_id, a.track_id as a, b.track_id as b from tr a join tr b on a.source_id = b.source_id and a.track_id < b.track_id and a.end_ms >= b.start_ms - 1000 and a.start_ms <= b.end_ms + 1000 and abs(a.cx - b.cx) <= 80),
ee as (select source_id, a, b from ed union all select source_id, b, a from ed),
reach as (select source_id, track_id as a, track_id as b from tr union select r.source_id, r.a, e.b from reach r join ee e on e.source_id = r.source_id and e.a = r.b),
pe as (select source_id, a as track_id, min(b) as person from reach group by 1, 2),
de as (select source_id, track_id, person, k, (start_ms // 600000 + k) * 600000 as t_ms, cx + k as cx from (select *, unnest(range(track_id % 5 + 1)) as k from tr join pe using (source_id, track_id))),
ld as (select source_id, person, arg_max(track_id, n * 1000000000 - track_id) as leader from (select source_id, person, track_id, count(*) as n from de group by all) group by 1, 2),
dl as (select *, min(case when track_id = leader then -1 else track_id end) over (partition by source_id, person, t_ms) as first from de join ld using (source_id, person))""") + """
select source_id, person, count(distinct track_id) as n_tracks, count(*) as n_detections, min(t_ms) as start_ms, max(t_ms) as end_ms, round(avg(cx), 6) as cx
from dl where case when first = -1 then track_id = leader else track_id = first end group by 1, 2""")
def o123_merged_tracks(spark, sf_dir):
    """The persons of o123_merge_tracks with their united detections: up to five of each track, on a grid of ten minutes."""
    i = X.intervals(spark, sf_dir)
    tracks = i.select("source_id", F.lit(0).cast("long").alias("shot_idx"), F.col("event_id").alias("track_id"), "start_ms", "end_ms", (F.col("value") * 3.84).alias("cx"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("track_id") % 5))
    seen = tracks.withColumn("k", k).select("source_id", "shot_idx", "track_id", ((F.floor(F.col("start_ms") / 600_000) + F.col("k")) * 600_000).alias("t_ms"), (F.col("cx") + F.col("k")).alias("cx"))
    persons = T.merge_tracks(tracks, T.track_edges(tracks))
    return T.merged_tracks(persons, seen).drop("shot_idx").withColumn("cx", F.round("cx", 6))


@query(with_(INTERVALS, DETECTIONS) + """
, f0 as (select source_id, cast(floor(t_ms / 100000.0) as bigint) as t, case when event_id % 5 <> 0 then case when track_id < 2 then 'a|b' else 'a|c' end end as pair, event_id % 4 as people from detections),
f as (select *, row_number() over (partition by source_id order by t, pair nulls first, people) as n from f0),
r as (select distinct source_id, 0::bigint as n, null::bigint as t, 'single' as mode, null::varchar as held, null::varchar as seen, null::bigint as since, null::bigint as gone from f union all
 select source_id, n, t, mode2, case when leaves then null when enters then pair else held end, pair, since2, case when mode2 = 'dual' then gone2 end from
 (select *, case when leaves then 'single' when enters then 'dual' else mode end as mode2 from
 (select *, mode = 'dual' and (people >= 3 or (not here and t - gone2 >= 60)) as leaves, mode <> 'dual' and pair is not null and people < 3 and t - since2 >= 40 as enters from
 (select f.*, r.mode, r.held, coalesce(f.pair = r.held, false) as here, case when f.pair is null then null when f.pair = r.seen then r.since else f.t end as since2,
   case when coalesce(f.pair = r.held, false) then null else coalesce(r.gone, f.t) end as gone2 from r join f on f.source_id = r.source_id and f.n = r.n + 1) a) b) c)
select source_id, 0::bigint as shot_idx, t as t_ms, mode, held as pair from r where n > 0""")
def o125_layout_state_machine(spark, sf_dir):
    d = detections(spark, sf_dir)
    pair = F.when(F.col("event_id") % 5 != 0, F.when(F.col("track_id") < 2, "a|b").otherwise("a|c"))
    frames = d.select("source_id", F.lit(0).cast("long").alias("shot_idx"), (F.floor(F.col("t_ms") / 100_000)).alias("t_ms"), pair.alias("pair"), (F.col("event_id") % 4).cast("int").alias("n_people"))
    return T.layout_state_machine(frames, 40, 60)


@query(with_(INTERVALS, DETECTIONS) + """
, o as (select source_id, 0::bigint as shot_idx, t_ms, 1 + min(conf) / 4 as scale, row_number() over (partition by source_id order by t_ms) as n from detections group by source_id, t_ms),
r as (select source_id, shot_idx, n, t_ms, scale from o where n = 1 union all select o.source_id, o.shot_idx, o.n, o.t_ms, case when abs(o.scale - r.scale) <= 0.05 then r.scale else r.scale + greatest(-0.02, least(0.02, o.scale - r.scale)) end from r join o on o.source_id = r.source_id and o.n = r.n + 1)
select source_id, shot_idx, t_ms, round(scale, 6) as scale from r""")
def o126_scale_deadband(spark, sf_dir):
    d = detections(spark, sf_dir)
    ideal = d.groupBy("source_id", F.lit(0).cast("long").alias("shot_idx"), "t_ms").agg((1 + F.min("conf") / 4).alias("scale"))
    return T.scale_deadband(ideal).withColumn("scale", F.round("scale", 6))
