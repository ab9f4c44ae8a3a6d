"""Queries: interval algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as V
from ..operators import islands as I
from ..sources import fixtures as X
from .registry import query
from .sql import CANDIDATES, INTERVALS, SILENCES, WORDS, with_

DAY = 21_600_000  # bucket for intervals that last hours


@query(with_(INTERVALS) + "select a.source_id, a.event_id, b.event_id as r_event_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as overlap_ms from intervals a join intervals b on a.source_id = b.source_id and a.end_ms > b.start_ms and a.start_ms < b.end_ms and a.cls = 'view' and b.cls = 'click'")
def o30_interval_join(spark, sf_dir):
    i = X.intervals(spark, sf_dir)
    pairs = V.interval_join(i.filter("cls = 'view'"), i.filter("cls = 'click'"), bucket_ms=DAY)
    return pairs.select("source_id", "event_id", "r_event_id", V.overlap_ms().alias("overlap_ms"))


LONG = "longs as (select source_id, -1::bigint as span_id, min(start_ms) as start_ms, max(end_ms) as end_ms from intervals group by 1 union all select source_id, event_id, start_ms, end_ms from intervals where cls = 'purchase')"


@query(with_(INTERVALS, LONG) + "select i.source_id, i.event_id, l.span_id, least(i.end_ms, l.end_ms) - greatest(i.start_ms, l.start_ms) as overlap_ms from intervals i join longs l on i.source_id = l.source_id and i.end_ms > l.start_ms and i.start_ms < l.end_ms")
def o30_interval_join_levels(spark, sf_dir):
    """Every interval with the purchases it meets and the whole span of its source, which lasts weeks."""
    i = X.intervals(spark, sf_dir)
    whole = i.groupBy("source_id").agg(F.lit(-1).cast("long").alias("span_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    spans = whole.unionByName(i.filter("cls = 'purchase'").select("source_id", F.col("event_id").alias("span_id"), "start_ms", "end_ms"))
    pairs = V.interval_join_levels(i, spans)
    return pairs.select("source_id", "event_id", F.col("r_span_id").alias("span_id"), V.overlap_ms().alias("overlap_ms"))


@query(with_(WORDS, SILENCES) + "select distinct w.source_id, w.start_ms, w.end_ms from silences w where exists (select 1 from candidates2 c where c.source_id = w.source_id and w.start_ms >= c.start_ms and w.end_ms <= c.end_ms)".replace("candidates2", "(select source_id, min(start_ms) as start_ms, max(end_ms) as end_ms from words where word_idx % 100 < 30 group by source_id, word_idx // 100)"))
def o31_contained_in(spark, sf_dir):
    w = X.words(spark, sf_dir)
    clips = w.filter("word_idx % 100 < 30").groupBy("source_id", F.floor(F.col("word_idx") / 100).alias("k")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return V.contained_in(X.silences(w), clips)


@query(with_(WORDS, CANDIDATES, SILENCES) + """
, p as (select c.source_id, c.cand_id, greatest(c.start_ms, s.start_ms) as lo, least(c.end_ms, s.end_ms) as hi from candidates c join silences s on c.source_id = s.source_id and c.end_ms > s.start_ms and c.start_ms < s.end_ms),
r as (select *, row_number() over (partition by source_id, cand_id order by hi - lo desc, lo) as k from p)
select source_id, cand_id, lo as start_ms, hi as end_ms from r where k = 1""")
def o32_largest_covered(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return V.largest_covered(X.candidates(w).select("source_id", "cand_id", "start_ms", "end_ms"), X.silences(w), ["source_id", "cand_id"])


@query(with_(WORDS, CANDIDATES) + """
, p as (select source_id, cand_id, start_ms + 137 as t_ms from candidates)
select p.source_id, p.cand_id, p.t_ms, (select max(word_idx) from words w where w.source_id = p.source_id and w.end_ms <= p.t_ms) as prev_word_idx, (select max(end_ms) from words w where w.source_id = p.source_id and w.end_ms <= p.t_ms) as prev_end_ms,
 (select min(word_idx) from words w where w.source_id = p.source_id and w.start_ms >= p.t_ms) as next_word_idx, (select min(start_ms) from words w where w.source_id = p.source_id and w.start_ms >= p.t_ms) as next_start_ms from p""")
def o33_asof(spark, sf_dir):
    w = X.words(spark, sf_dir)
    points = X.candidates(w).select("source_id", "cand_id", (F.col("start_ms") + 137).alias("t_ms"))
    before = V.asof_prev(points, w, keys=["cand_id"])
    return V.asof_next(before, w, keys=["cand_id", "prev_word_idx", "prev_end_ms"])


@query(with_(WORDS, CANDIDATES) + """
, p as (select source_id, cand_id, end_ms + 211 as t_ms from candidates),
r as (select p.*, w.word_idx, abs(w.start_ms - p.t_ms) as distance_ms, row_number() over (partition by p.source_id, p.cand_id order by abs(w.start_ms - p.t_ms), w.word_idx) as k from p join words w using (source_id))
select source_id, cand_id, t_ms, word_idx, distance_ms from r where k = 1""")
def o34_nearest(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return V.nearest(X.candidates(w).select("source_id", "cand_id", (F.col("end_ms") + 211).alias("t_ms")), w, ["cand_id"])


@query(with_(INTERVALS) + "select a.source_id, a.event_id as a_id, b.event_id as b_id from intervals a join intervals b on a.source_id = b.source_id and a.event_id < b.event_id and a.end_ms > b.start_ms and a.start_ms < b.end_ms")
def o35_theta_self_join_pairs(spark, sf_dir):
    i = X.intervals(spark, sf_dir).select("source_id", "event_id", "start_ms", "end_ms")
    return V.interval_join(i, i, bucket_ms=DAY).filter("event_id < r_event_id").select("source_id", F.col("event_id").alias("a_id"), F.col("r_event_id").alias("b_id"))


MERGED = """
mb as (select *, max(end_ms) over (partition by source_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from intervals),
mi as (select *, sum(case when reach is null or start_ms > reach + 60000 then 1 else 0 end) over (partition by source_id order by start_ms, end_ms rows unbounded preceding) as isl from mb),
merged as (select source_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as merged from mi group by source_id, isl)"""


@query(with_(INTERVALS, MERGED) + "select * from merged")
def o54_merge_intervals(spark, sf_dir):
    return V.merge_intervals(X.intervals(spark, sf_dir), 60_000)


@query(with_(INTERVALS) + """
, mb as (select *, (event_id * 7) % 100 / 100.0 as confidence, max(end_ms) over (partition by source_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from intervals),
mi as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by source_id order by start_ms, end_ms rows unbounded preceding) as isl from mb)
select source_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as merged, min(confidence) as confidence, string_agg(cls, '; ' order by start_ms, end_ms, cls) as reason, arg_min(cls, (start_ms, end_ms, cls)) as edit_type from mi group by source_id, isl""")
def o55_merge_edits(spark, sf_dir):
    edits = X.intervals(spark, sf_dir).select("source_id", "start_ms", "end_ms", F.col("cls").alias("reason"), F.col("cls").alias("edit_type"), ((F.col("event_id") * 7) % 100 / 100.0).alias("confidence"))
    return I.merge_edits(edits, ["source_id"])


@query(with_(INTERVALS) + """
, o as (select source_id, start_ms, end_ms, row_number() over (partition by source_id order by start_ms, end_ms) as n from intervals),
f as (select source_id, n, start_ms as s, end_ms as e, 0 as g from o where n = 1 union all
 select o.source_id, o.n, case when hit then f.s else o.start_ms end, case when hit then greatest(f.e, o.end_ms) else o.end_ms end, case when hit then f.g else f.g + 1 end
 from (select f.*, o.n as n2, o.start_ms, o.end_ms, least(f.e, o.end_ms) - greatest(f.s, o.start_ms) > 0 and least(f.e, o.end_ms) - greatest(f.s, o.start_ms) >= 0.2 * least(f.e - f.s, o.end_ms - o.start_ms) as hit from f join o on o.source_id = f.source_id and o.n = f.n + 1) f join o on o.source_id = f.source_id and o.n = f.n2)
select source_id, arg_max(s, n) as start_ms, arg_max(e, n) as end_ms from f group by source_id, g""")
def o56_merge_spans_by_fraction(spark, sf_dir):
    return V.spans_merged_by_fraction(X.intervals(spark, sf_dir).select("source_id", "start_ms", "end_ms"))


def cut_clips(spark, sf_dir):
    """Clips are whole sources; cuts are their silences of 500 ms or more."""
    w = X.words(spark, sf_dir)
    cuts = X.silences(w).filter("end_ms - start_ms >= 500")
    clips = w.groupBy("source_id").agg(F.lit(0).cast("bigint").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return w, V.complement(cuts, clips, ["source_id"])


RETAINED = """
rm as (select source_id, start_ms as s, end_ms as e from silences where end_ms - start_ms >= 500 union all select distinct source_id, 0, 0 from words),
rd as (select source_id, max(end_ms) as d from words group by 1),
rp as (select rm.source_id, e as src_start, coalesce(lead(s) over (partition by rm.source_id order by s, e), d) as src_end from rm join rd using (source_id)),
retained as (select source_id, src_start, src_end, cast(sum(src_end - src_start) over w - (src_end - src_start) as bigint) as out_start, cast(sum(src_end - src_start) over w as bigint) as out_end from rp where src_end > src_start window w as (partition by source_id order by src_start rows unbounded preceding))"""


@query(with_(WORDS, SILENCES, RETAINED) + "select * from retained")
def o58_complement(spark, sf_dir):
    return cut_clips(spark, sf_dir)[1]


@query(with_(WORDS, SILENCES, RETAINED) + """
select s.source_id, s.start_ms, s.end_ms, greatest(s.start_ms, src_start) - src_start + out_start as out_start_ms, least(s.end_ms, src_end) - src_start + out_start as out_end_ms
from (select source_id, min(start_ms) as start_ms, max(end_ms) as end_ms from words group by source_id, word_idx // 20) s join retained r on r.source_id = s.source_id and s.end_ms > r.src_start and s.start_ms < r.src_end""")
def o59_remap_time(spark, sf_dir):
    w, kept = cut_clips(spark, sf_dir)
    spans = w.groupBy("source_id", F.floor(F.col("word_idx") / 20).alias("k")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("k")
    return V.remap_intervals(spans, kept)


@query(with_(WORDS, SILENCES, RETAINED) + """
select s.source_id, mode, s.start_ms, s.end_ms, greatest(s.start_ms, src_start) - src_start + out_start as out_start_ms, least(s.end_ms, src_end) - src_start + out_start as out_end_ms
from (select source_id, case when (word_idx // 40) % 2 = 0 then 'single' else 'dual' end as mode, min(start_ms) as start_ms, max(end_ms) as end_ms from words group by source_id, word_idx // 40) s join retained r on r.source_id = s.source_id and s.end_ms > r.src_start and s.start_ms < r.src_end
where least(s.end_ms, src_end) - greatest(s.start_ms, src_start) >= 100""")
def o60_intersect_timelines(spark, sf_dir):
    w, kept = cut_clips(spark, sf_dir)
    k = F.floor(F.col("word_idx") / 40)
    layout = w.groupBy("source_id", k.alias("k")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).withColumn("mode", F.when(F.col("k") % 2 == 0, "single").otherwise("dual")).drop("k")
    return V.intersect_timelines(layout, kept)


@query(with_(INTERVALS) + """
, d as (select source_id, max(end_ms) - 1000 as duration_ms from intervals group by 1),
g as (select i.source_id, event_id, start_ms, least(end_ms, duration_ms) as end_ms, duration_ms from intervals i join d using (source_id) where end_ms > start_ms and end_ms > 0 and start_ms < duration_ms),
m as (select *, coalesce(max(end_ms) over (partition by source_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) as f from g),
k as (select *, lead(start_ms) over (partition by source_id order by start_ms, end_ms) as nxt from m where end_ms > f)
select source_id, event_id, f as start_ms, case when nxt is null then duration_ms else end_ms end as end_ms from k""")
def o61_repair_timeline(spark, sf_dir):
    i = X.intervals(spark, sf_dir).select("source_id", "event_id", "start_ms", "end_ms")
    return V.repair_timeline(i, i.groupBy("source_id").agg((F.max("end_ms") - 1000).alias("duration_ms")))
