"""Queries: speakers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fold import half_up
from ..operators import islands as I
from ..operators import series as SE
from ..operators import speakers as S
from ..sources import fixtures as X
from .q_islands import DIAR, island
from .registry import query
from .sql import DETECTIONS, INTERVALS, WORDS, with_


def diar(spark, sf_dir):
    return I.diar_segments(X.words(spark, sf_dir))


@query(with_(WORDS, DIAR) + "select source_id, speaker, cast(sum(end_ms - start_ms) as bigint) as total_ms, count(*) as n_segments, 0.95::double as avg_confidence from diar group by 1, 2")
def o64_speaker_stats(spark, sf_dir):
    return S.speaker_stats(diar(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))


_Q = ", ".join(f"'{w}'" for w in S.QUESTION_WORDS)
QSTATS = island("pw is not null and ps is distinct from speaker") + f""",
qt as (select source_id, isl, any_value(speaker) as speaker, bool_or(text like '%?%') as asks, arg_min(regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g'), word_idx) as first from i group by 1, 2),
qstats as (select source_id, speaker, count(*) as turns, count(*) filter (asks) as question_turns, count(*) filter (first in ({_Q})) as interrogative_starts from qt group by 1, 2)"""


@query(with_(WORDS, QSTATS) + "select * from qstats")
def o65_question_stats(spark, sf_dir):
    return S.question_stats(X.words(spark, sf_dir))


@query(with_(WORDS, QSTATS) + f"""
, dd as (select source_id, any_value(speaker) as speaker, min(start_ms) as s, max(end_ms) as e from (select *, sum(case when pw is not null and (ps is distinct from speaker or start_ms - pe > 450) then 1 else 0 end) over (partition by source_id order by start_ms, word_idx rows unbounded preceding) as z from b) group by source_id, z),
st as (select source_id, speaker, sum(e - s) as own, min((s, e)) as fs from dd group by 1, 2),
j as (select st.*, coalesce(question_turns + interrogative_starts / 3.0, 0) as q from st left join qstats using (source_id, speaker)),
k as (select *, sum(q) over w - q as oq, sum(own) over w as tot, count(*) over w as n, fs = min(fs) over w as is_first from j window w as (partition by source_id)),
l as (select *, q > 0 and q > oq + 1e-9 as asks_most from k),
m as (select *, round((case when asks_most then 0.7 else 0 end) + (case when q >= 3 then 0.2 else 0 end) + (case when is_first then 0.3 else 0 end), 6)::double as host, round(0.4 * greatest((2 * own - tot) * 1.0 / tot, 0), 6)::double as guest from l),
r as (select *, case when n = 1 then 'host' when host >= 0.85 or (host > guest + 0.15 and host >= 0.5) then 'host' when guest > host + 0.15 and guest >= 0.5 then 'guest' else 'unknown' end as role0,
 case when n = 1 then 0.6 when host >= 0.85 then least(0.95, host) when host > guest + 0.15 and host >= 0.5 then least(0.85, host) when guest > host + 0.15 and guest >= 0.5 then 0.6 else 0.3 end as c0 from m),
c as (select *, max(case when role0 <> 'unknown' and c0 >= 0.7 then role0 end) over (partition by source_id) as res from r)
select source_id, speaker, case when n = 2 and role0 = 'unknown' and res is not null then case res when 'host' then 'guest' else 'host' end else role0 end as role,
 case when n = 2 and role0 = 'unknown' and res is not null then 0.7 else c0 end as confidence, round(own * 1.0 / tot, 6) as speaking_share, is_first, asks_most from c""")
def o66_speaker_roles(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return S.speaker_roles(I.diar_segments(w), S.question_stats(w)).withColumn("speaking_share", F.round("speaking_share", 6))


@query("""
with e as (select vec_id, vec_id // 40 as source_id, embedding from embeddings), t as (select * from e where vec_id % 2 = 0), g as (select * from e where vec_id % 2 = 1),
p as (select t.source_id, t.vec_id as track_id, g.vec_id as match_id, round(list_cosine_similarity(t.embedding::double[], g.embedding::double[]), 6) as similarity from t join g using (source_id)),
r as (select *, row_number() over (partition by source_id, track_id order by similarity desc, match_id) as k from p where similarity >= 0.2)
select source_id, track_id, match_id, similarity from r where k = 1""")
def o40_gallery_match(spark, sf_dir):
    # every vector has a role: sources of 40, half of them tracks and half gallery
    e = X.table(spark, sf_dir, "embeddings").withColumn("source_id", F.floor(F.col("vec_id") / 40))
    return S.gallery_match(e.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "track_id"), e.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "gallery_id"), 0.2)


_unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


@query(f"""
with recursive e as (select label as track_id, vec_id as seq, embedding::double[] as v, row_number() over (partition by label order by vec_id, embedding) as n from embeddings),
r as (select track_id, n, {_unit('v')} as g from e where n = 1 union all
 select track_id, n, {_unit('m')} from (select e.track_id, e.n, list_transform(range(1, len(r.g) + 1), lambda i: 0.9::double * r.g[i] + 0.1::double * e.v[i]) as m from r join e on e.track_id = r.track_id and e.n = r.n + 1) z),
s as (select track_id, count(*) as n, min(seq) as first_seen, max(seq) as last_seen from e group by 1)
select s.track_id, s.n, first_seen, last_seen, list_transform(g, lambda x: round(x, 5)) as embedding from s join r on r.track_id = s.track_id and r.n = s.n""")
def o124_ema_gallery(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(F.col("label").alias("track_id"), F.col("vec_id").alias("seq"), "embedding")
    return S.ema_gallery(e).select("track_id", "n", "first_seen", "last_seen", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


def day(spark, sf_dir):
    """Segments (purchases and sign-ups as speakers) and detections of the same source."""
    i = X.intervals(spark, sf_dir)
    seg = i.filter("cls in ('purchase', 'signup')").select("source_id", F.col("cls").alias("speaker"), "start_ms", "end_ms", ((F.col("event_id") * 7) % 100 / 100.0).alias("confidence"))
    return i, seg, X.detections(i)


EVIDENCE = """
ev as (select d.source_id, i.cls as speaker, d.track_id, round(sum(d.motion), 6) as evidence from detections d join intervals i on i.source_id = d.source_id and i.cls in ('purchase', 'signup') and d.t_ms >= i.start_ms and d.t_ms <= i.end_ms group by 1, 2, 3 having round(sum(d.motion), 6) > 0.1)"""


BINDINGS = """
o as (select *, row_number() over (partition by source_id order by evidence desc, speaker, track_id::varchar) as n from ev),
g as (select source_id, 0 as n, []::varchar[] as ua, []::integer[] as ub, null::varchar as speaker, null::integer as track_id, null::double as evidence from (select distinct source_id from ev) union all
 select source_id, n, case when ok then list_append(ua, s2) else ua end, case when ok then list_append(ub, t2) else ub end, case when ok then s2 end, t2, e2 from (
 select g.source_id, o.n, g.ua, g.ub, o.speaker as s2, o.track_id as t2, o.evidence as e2, not list_contains(g.ua, o.speaker) and not list_contains(g.ub, o.track_id) as ok from g join o on o.source_id = g.source_id and o.n = g.n + 1) z)"""


@query(with_(INTERVALS, DETECTIONS, EVIDENCE, BINDINGS) + "select source_id, speaker, track_id, evidence from g where speaker is not null")
def o120_bind_speakers_to_tracks(spark, sf_dir):
    _, seg, det = day(spark, sf_dir)
    return S.bind_speakers_to_tracks(seg, det)


def fused(spark, sf_dir):
    _, seg, det = day(spark, sf_dir)
    hour = 3_600_000
    spans = seg.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))
    grid = SE.fixed_grid(spans, hour)
    return S.fuse_active_speaker(grid, seg, det, S.bind_speakers_to_tracks(seg, det), 0.4, 0.25, 2 * hour, hour), grid


FUSED = """
sg as (select source_id, cls as speaker, start_ms, end_ms, (event_id * 7) % 100 / 100.0::double as confidence from intervals where cls in ('purchase', 'signup')),
du as (select source_id, max(end_ms) as duration from sg group by 1),
ce as (select source_id, t as start_ms, least(t + 3600000, duration) as end_ms from (select *, unnest(range(0, duration, 3600000)) as t from du where duration > 0)),
au as (select c.source_id, c.start_ms, b.track_id, least(1.0::double, sum((least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms))::double / (c.end_ms - c.start_ms)) * max(s.confidence)) as audio
 from ce c join sg s on s.source_id = c.source_id and c.end_ms > s.start_ms and c.start_ms < s.end_ms join g b on b.source_id = s.source_id and b.speaker = s.speaker group by 1, 2, 3),
vi as (select source_id, cast(floor(t_ms / 3600000.0) as bigint) * 3600000 as start_ms, track_id, 0.7::double * max(motion) + 0.3::double * avg(motion) as visual from detections group by 1, 2, 3),
bo as (select source_id, start_ms, track_id, ce.end_ms, coalesce(audio, 0) as audio, coalesce(visual, 0) as visual from (select * from au full join vi using (source_id, start_ms, track_id)) join ce using (source_id, start_ms)),
pp as (select *, row_number() over (partition by source_id, track_id order by start_ms) as n, floor((0.6::double * audio + 0.4::double * visual) * case when visual > 0.5 and audio < 0.1 and loud > 0.5 then 0.3::double else 1 end * 1e6 + 0.500001) / 1e6 as p
 from (select *, max(audio) over (partition by source_id, start_ms) as loud from bo)),
hy as (select distinct source_id, track_id, 0::bigint as n, null::bigint as start_ms, null::bigint as end_ms, false as speaking, null::double as confidence, -1000000000000::bigint as since from pp union all
 select source_id, track_id, n, start_ms, end_ms, now, p, case when now <> speaking then start_ms else since end from
 (select pp.*, h.since, h.speaking, case when pp.start_ms - h.since < 7200000 then h.speaking when not h.speaking and pp.p >= 0.4 then true when h.speaking and pp.p < 0.25 then false else h.speaking end as now
  from hy h join pp on pp.source_id = h.source_id and pp.track_id = h.track_id and pp.n = h.n + 1) z),
br as (select *, sum(b) over (partition by source_id, track_id order by start_ms, end_ms rows unbounded preceding) as isl from
 (select *, coalesce((lag(speaking) over w <> speaking or start_ms - lag(end_ms) over w > 100)::int, 0) as b from hy where n > 0 window w as (partition by source_id, track_id order by start_ms, end_ms))),
fu as (select source_id, track_id, any_value(speaking) as speaking, min(start_ms) as start_ms, max(end_ms) as end_ms, list_reduce(list(confidence order by start_ms, end_ms), lambda a, c: (a + c) / 2) as confidence from br group by source_id, track_id, isl)"""


@query(with_(INTERVALS, DETECTIONS, EVIDENCE, BINDINGS, FUSED) + "select source_id, track_id, speaking, start_ms, end_ms, floor(confidence * 1e6 + 0.500001) / 1e6 as confidence from fu")
def o121_fuse_active_speaker(spark, sf_dir):
    return fused(spark, sf_dir)[0].withColumn("confidence", half_up(F.col("confidence")))


@query(with_(INTERVALS, DETECTIONS, EVIDENCE, BINDINGS, FUSED) + """
select c.source_id, c.start_ms // 21600000 as window_idx, f.track_id, floor(max(f.confidence) * 1e6 + 0.500001) / 1e6 as confidence
from ce c join fu f on f.source_id = c.source_id and f.speaking and f.confidence >= 0.3 and c.start_ms + 21600000 > f.start_ms and c.start_ms < f.end_ms where c.start_ms % 21600000 = 0 group by 1, 2, 3""")
def o122_fusion_for_window(spark, sf_dir):
    states, grid = fused(spark, sf_dir)
    windows = grid.filter("t_ms % 21600000 = 0").select("source_id", (F.col("t_ms") / 21_600_000).cast("long").alias("window_idx"), F.col("t_ms").alias("start_ms"), (F.col("t_ms") + 21_600_000).alias("end_ms"))
    return S.fusion_for_window(states, windows, 0.3).withColumn("confidence", half_up(F.col("confidence")))


@query(with_(INTERVALS, DETECTIONS) + """
, g as (select distinct source_id, unnest(range(0, (select max(end_ms) from intervals i where i.source_id = d.source_id), 21600000)) as t_ms from (select distinct source_id from detections) d),
p as (select g.source_id, g.t_ms, d.track_id, d.conf, row_number() over (partition by g.source_id, g.t_ms order by d.conf desc, d.track_id) as k from g join (select d.*, i.end_ms from detections d join intervals i using (event_id)) d on d.source_id = g.source_id and g.t_ms + 1 > d.t_ms and g.t_ms < d.end_ms where d.conf >= 0.5),
b as (select source_id, t_ms, track_id, lag(track_id) over (partition by source_id order by t_ms) as p from p where k = 1)
select source_id, t_ms, track_id from b where p is null or p <> track_id""")
def o135_argmax_timeline(spark, sf_dir):
    i = X.intervals(spark, sf_dir)
    det = X.detections(i).join(i.select("event_id", "end_ms"), "event_id")
    states = det.select("source_id", "track_id", F.col("conf").alias("confidence"), F.col("t_ms").alias("start_ms"), "end_ms")
    grid = SE.fixed_grid(i.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")), 21_600_000)
    return S.argmax_timeline(states, grid)


@query(with_(INTERVALS) + """
, t as (select source_id, event_id as id, start_ms, cls from intervals where event_id % 2 = 0), u as (select source_id, event_id as id, start_ms, cls from intervals where event_id % 2 = 1),
o as (select source_id, t.id as a, u.id as b, abs(t.start_ms - u.start_ms) as late, t.cls <> u.cls as wrong, row_number() over (partition by source_id order by abs(t.start_ms - u.start_ms), t.id::varchar, u.id::varchar) as n from t join u using (source_id) where abs(t.start_ms - u.start_ms) <= 7200000),
m as (select distinct source_id, 0::bigint as n, []::bigint[] as used, false as ok, null::bigint as late, null::boolean as wrong from o union all
 select source_id, n, case when ok2 then used || [a, b] else used end, ok2, late2, wrong2 from
 (select o.source_id, o.n, m.used, o.a, o.b, o.late as late2, o.wrong as wrong2, not list_contains(m.used, o.a) and not list_contains(m.used, o.b) as ok2 from m join o on o.source_id = m.source_id and o.n = m.n + 1) z),
c as (select source_id, count(*) as matched, avg(late) as latency_ms, count(*) filter (wrong) as errors from m where ok group by 1),
k as (select source_id, coalesce(a.n, 0) as n_truth, coalesce(b.n, 0) as n_got, coalesce(matched, 0) as matched, coalesce(errors, 0) as identity_errors, latency_ms
 from (select source_id, count(*) as n from t group by 1) a full join (select source_id, count(*) as n from u group by 1) b using (source_id) left join c using (source_id)),
q as (select *, matched::double / nullif(n_got, 0) as pr, matched::double / nullif(n_truth, 0) as re from k)
select source_id, n_truth, n_got, matched, identity_errors, round(pr, 6) as precision, round(re, 6) as recall, round(2 * pr * re / nullif(pr + re, 0), 6) as f1, round(latency_ms, 6) as latency_ms from q""")
def o76_switch_metrics(spark, sf_dir):
    i = X.intervals(spark, sf_dir)
    truth = i.filter("event_id % 2 = 0").select("source_id", F.col("event_id").alias("switch_id"), F.col("start_ms").alias("t_ms"), F.col("cls").alias("speaker"))
    got = i.filter("event_id % 2 = 1").select("source_id", F.col("event_id").alias("switch_id"), F.col("start_ms").alias("t_ms"), F.col("cls").alias("speaker"))
    m = S.switch_metrics(truth, got, 7_200_000)
    return m.select("source_id", "n_truth", "n_got", "matched", "identity_errors", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "latency_ms")))
