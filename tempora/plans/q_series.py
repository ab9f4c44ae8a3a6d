"""Queries: score series."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources import fixtures as X
from .registry import query
from .sql import INTERVALS, SCORES, WORDS, with_


@query(with_(SCORES) + """
, g as (select *, count(*) over w as n, avg(raw_score) over w as m, stddev_pop(raw_score) over w as sd from window_scores window w as (partition by source_id, provider))
select source_id, window_idx, round(case when n < 10 or sd <= 1e-6 then greatest(0.0, least(1.0, raw_score)) else 1 / (1 + exp(-((raw_score - m) / sd))) end, 6) as score from g""")
def o87_normalize_by_provider(spark, sf_dir):
    return S.normalize_by_provider(X.window_scores(spark, sf_dir), 10).select("source_id", "window_idx", F.round("score", 6).alias("score"))


W1 = [math.exp(-(k * k) / 2) for k in range(-3, 4)]
SMOOTH = f"""
sn as (select source_id, max(window_idx) as last, count(*) as n from window_scores group by 1),
so as (select unnest(range(-3, 4)) as k, unnest([{', '.join(map(repr, W1))}]) as wt),
ss as (select w.source_id, w.window_idx, w.window_start, w.window_end, sn.n, w.raw_score as own, sum(so.wt * v.raw_score) / {sum(W1)!r} as sm from window_scores w join sn using (source_id) cross join so
  join window_scores v on v.source_id = w.source_id and v.window_idx = greatest(0, least(w.window_idx + so.k, sn.last)) group by all),
smoothed as (select source_id, window_idx, window_start, window_end, round(case when n = 1 then own else sm end, 6) as smoothed from ss)"""
OTSU = """
ow as (select source_id, window_idx, cast(round(smoothed * 1000000) as bigint) as v from smoothed),
oz as (select source_id, v, lead(v) over o as nx, row_number() over o as n0, sum(v) over (partition by source_id order by v, window_idx rows unbounded preceding) as s0, count(*) over (partition by source_id) as n, sum(v) over (partition by source_id) as s from ow window o as (partition by source_id order by v, window_idx)),
od as (select *, (s0::double / n0 - (s - s0)::double / (n - n0)) / 1000000 as diff from oz),
ov as (select *, case when v < nx then (n0::double / n) * (1 - n0::double / n) * diff * diff end as var from od),
og as (select source_id, cast(sum(v + nx) filter (var >= mx - 1e-9) as bigint) as total, 2 * count(*) filter (var >= mx - 1e-9) as k, min(v) as least, max(v) - min(v) as spread from (select *, max(var) over (partition by source_id) as mx from ov) group by 1),
otsu as (select source_id, case when k > 0 then (2 * total + k) // (2 * k) else least end / 1000000.0::double as threshold, spread = 0 as flat from og)"""


def kadane(series: str, tau: str) -> str:
    """The span fold as a recursion; every row carries the state after its window and the span it closes."""
    return f"""
kw as (select w.*, t.threshold, row_number() over (partition by w.source_id order by w.window_idx) as i from {series} w join {tau} t using (source_id)),
kr as (select source_id, 0 as i, 0.0::double as total, 0.0::double as top, null::bigint as b, null::bigint as e, 0.0::double as peak, null::bigint as last, null::bigint as cs, null::bigint as ce from (select distinct source_id from kw)
 union all
 select source_id, i, case when act then case when valley then y else total + y end else 0 end, case when act then case when valley then ex when total + y > top then total + y else top end else 0 end,
  case when act then case when valley then case when y > 0 then window_start end else coalesce(b, window_start) end end,
  case when act then case when valley or total + y > top then window_end else e end else e end,
  case when act then case when valley then ex else pk end else 0 end, window_end,
  case when b is not null and top > 0 and (not act or valley) then b end, case when b is not null and top > 0 and (not act or valley) then case when act then last else e end end
 from (select k.*, k.total + k.y > 0 as act, pk > 0 and ex < pk * 0.70 and b is not null as valley from
  (select r.source_id, w.i, r.total, r.top, r.b, r.e, r.last, w.window_start, w.window_end, w.smoothed - w.threshold as y, greatest(w.smoothed - w.threshold, 0) as ex, greatest(case when r.b is null then greatest(w.smoothed - w.threshold, 0) else r.peak end, greatest(w.smoothed - w.threshold, 0)) as pk
   from kr r join kw w on w.source_id = r.source_id and w.i = r.i + 1) k) z),
spans as (select source_id, cs as start_ms, ce as end_ms from kr where cs is not null union all
 select source_id, b, e from (select *, row_number() over (partition by source_id order by i desc) as q from kr) where q = 1 and b is not null and top > 0)"""


@query(with_(SCORES, SMOOTH) + "select source_id, window_idx, smoothed from smoothed")
def o88_gaussian_smooth(spark, sf_dir):
    return S.gaussian_smooth(X.window_scores(spark, sf_dir), 1.0).select("source_id", "window_idx", F.round("smoothed", 6).alias("smoothed"))


def _smoothed(spark, sf_dir):
    return S.gaussian_smooth(X.window_scores(spark, sf_dir), 1.0).withColumn("smoothed", F.round("smoothed", 6))


@query(with_(SCORES, SMOOTH, OTSU) + "select source_id, round(threshold, 6) as threshold from otsu")
def o89_otsu_threshold(spark, sf_dir):
    return S.otsu_threshold(_smoothed(spark, sf_dir)).select("source_id", F.round("threshold", 6).alias("threshold"))


@query(with_(SCORES, "smoothed as (select source_id, window_idx, window_start, window_end, raw_score as smoothed from window_scores)", "tau as (select distinct source_id, 0.4::double as threshold from window_scores)", kadane("smoothed", "tau")) + "select * from spans")
def o90_score_spans(spark, sf_dir):
    scores = X.window_scores(spark, sf_dir).withColumnRenamed("raw_score", "smoothed")
    return S.score_spans(scores, scores.select("source_id").distinct().withColumn("threshold", F.lit(0.4)))


SPANS = SMOOTH + "," + OTSU + """,
tau as (select source_id, round(case when flat then 0.1 else greatest(threshold, 0.1) end, 6)::double as threshold from otsu)""" + "," + kadane("smoothed", "tau")


@query(with_(SCORES, SPANS) + "select * from spans")
def o91_windows_to_spans(spark, sf_dir):
    return S.windows_to_spans(X.window_scores(spark, sf_dir), min_score=0.1)


@query(with_(INTERVALS) + """
, f as (select source_id, row_number() over (partition by source_id order by start_ms, event_id) - 1 as frame, (event_id * 17) % 100 / 1.0 as diff from intervals),
m as (select *, avg(diff) over (partition by source_id order by frame rows between 2 preceding and 2 following) as mean from f),
h as (select source_id, frame, row_number() over (partition by source_id order by frame) as i from m where diff >= 15 and diff / (mean + 1e-5) >= 1.5),
k as (select source_id, i, frame, frame as lk, true as kept from h where i = 1 union all select h.source_id, h.i, h.frame, case when h.frame - k.lk >= 4 then h.frame else k.lk end, h.frame - k.lk >= 4 from k join h on h.source_id = k.source_id and h.i = k.i + 1)
select source_id, frame, cast(round((frame + 1) * 1000 / 30.0) as bigint) as cut_ms from k where kept""")
def o92_adaptive_cuts(spark, sf_dir):
    order = Window.partitionBy("source_id").orderBy("start_ms", "event_id")
    diffs = X.intervals(spark, sf_dir).select("source_id", (F.row_number().over(order) - 1).alias("frame"), ((F.col("event_id") * 17) % 100 / 1.0).alias("diff"))
    return S.adaptive_cuts(diffs, 1.5, 15.0, 4)


@query(with_(WORDS) + """
, d as (select source_id, max(end_ms) as d from words group by 1),
s as (select source_id, d, unnest(range(0, d // 60000 + 2)) as k, from d),
g as (select source_id, d, k * 60000 as s0 from s where k = 0 or (k * 60000 * 5 + 2 * 75000 < d * 5 and (k - 1) * 60000 + 75000 < d)),
a as (select source_id, s0, d from g union all select source_id, d - 75000, d from (select source_id, d, max(s0) as l from g group by 1, 2) where l + 75000 < d)
select source_id, row_number() over (partition by source_id order by s0) - 1 as window_idx, s0 as window_start, least(s0 + 75000, d) as window_end from a""")
def o99_coverage_windows(spark, sf_dir):
    d = X.words(spark, sf_dir).groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))
    return S.coverage_windows(d, 75_000, 15_000)


@query(with_(WORDS) + """
, d as (select source_id, max(end_ms) as d from words group by 1)
select source_id, t as t_ms, least(t + 1000, d) as end_ms from (select source_id, d, unnest(range(0, d, 1000)) as t from d)""")
def o100_fixed_grid(spark, sf_dir):
    return S.fixed_grid(X.words(spark, sf_dir).groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")))


TILES = """
td0 as (select source_id, start_ms, end_ms, end_ms - start_ms as d from {spans} where end_ms - start_ms >= 8000),
td1 as (select *, unnest(case when d <= 75000 then [0] else range(0, d, 60000) end) as o from td0),
tiles as (select distinct source_id, start_ms + o as start_ms, least(start_ms + o + 75000, end_ms) as end_ms from td1 where (o = 0 or o - 60000 + 75000 < d) and (d <= 75000 or least(o + 75000, d) - o >= 15000))"""


@query(with_(SCORES, SPANS, TILES.format(spans="spans")) + "select * from tiles")
def o100_tiles(spark, sf_dir):
    return S.tiles(S.windows_to_spans(X.window_scores(spark, sf_dir), min_score=0.1)).distinct()


@query(with_(SCORES, SPANS) + """
, n as (select source_id, start_ms, end_ms, case when end_ms - start_ms <= 15000 then 6 when end_ms - start_ms <= 60000 then 8 when end_ms - start_ms <= 180000 then 12 else 16 end as n from spans)
select source_id, start_ms, end_ms, cast(round(start_ms + (i + 0.5) * ((end_ms - start_ms) * 1.0 / n)) as bigint) as t_ms from (select *, unnest(range(n)) as i from n)""")
def o100_midpoints(spark, sf_dir):
    return S.midpoints(S.windows_to_spans(X.window_scores(spark, sf_dir), min_score=0.1))


@query(with_(SCORES, SPANS) + """
, m as (select s.source_id, s.start_ms, s.end_ms, (2 * cast(sum(cast(round(w.smoothed * 1000000) as bigint)) as bigint) + count(*)) // (2 * count(*)) / 1000000.0::double as mean from spans s join smoothed w on w.source_id = s.source_id and s.end_ms > w.window_start and s.start_ms < w.window_end group by 1, 2, 3),
r as (select *, row_number() over (partition by source_id order by mean desc, start_ms, end_ms) as rank from m)
select * from r where rank <= 4""")
def o108_rank_regions(spark, sf_dir):
    scores = X.window_scores(spark, sf_dir)
    return S.rank_regions(S.windows_to_spans(scores, min_score=0.1), _smoothed(spark, sf_dir))


@query(with_(WORDS, "wsc as (select source_id, max(end_ms) as d from words group by 1)", """
spans as (select source_id, start_ms, end_ms from (select source_id, min(start_ms) as start_ms, max(end_ms) as end_ms from words group by source_id, word_idx // 60)),
scores as (select source_id, window_idx, window_idx * 60000 as window_start, window_idx * 60000 + 75000 as window_end, ((window_idx * 37 + source_id) % 100) / 100.0 as raw_score from (select source_id, unnest(range(0, d // 60000 + 1)) as window_idx from wsc))""", TILES.format(spans="spans")) + """
, w as (select t.*, w.word_idx, w.text, w.start_ms as ws, w.end_ms as we, row_number() over (partition by t.source_id, t.start_ms, t.end_ms order by w.start_ms, w.word_idx) as i, count(*) over (partition by t.source_id, t.start_ms, t.end_ms) as n from tiles t join words w on w.source_id = t.source_id and w.end_ms >= t.start_ms and w.start_ms <= t.end_ms),
g as (select source_id, start_ms, end_ms, string_agg(text, ' ' order by i) filter (i <= 10) as hook, min(ws) as hook_start, max(we) filter (i <= 10) as hook_end, string_agg(text, ' ' order by i) filter (i > n - 10) as payoff_text, min(ws) filter (i > n - 10) as payoff_start, max(we) as payoff_end from w group by 1, 2, 3)
select g.*, coalesce((select max(raw_score) from scores s where s.source_id = g.source_id and g.end_ms >= s.window_start and g.start_ms <= s.window_end), 0.0) as score from g""")
def o109_spans_to_candidates(spark, sf_dir):
    w = X.words(spark, sf_dir)
    spans = w.groupBy("source_id", F.floor(F.col("word_idx") / 60).alias("k")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    d = w.groupBy("source_id").agg(F.max("end_ms").alias("d"))
    scores = d.select("source_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("d") / 60000).cast("int"))).alias("window_idx"))
    scores = scores.select("source_id", "window_idx", (F.col("window_idx") * 60000).cast("long").alias("window_start"), (F.col("window_idx") * 60000 + 75000).cast("long").alias("window_end"), ((F.col("window_idx") * 37 + F.col("source_id")) % 100 / 100.0).alias("raw_score"))
    return S.spans_to_candidates(spans, scores, w)


@query(with_(SCORES) + """
, a as (select source_id, count(distinct raw_score) as n_distinct, stddev_pop(raw_score) as sigma, max(raw_score) - min(raw_score) as spread from window_scores group by 1)
select source_id, n_distinct, round(sigma, 6) as sigma, round(spread, 6) as spread, n_distinct <= 3 or sigma < 0.05 or spread < 0.10 as degenerate from a""")
def o136_degenerate_scores(spark, sf_dir):
    return S.degenerate_scores(X.window_scores(spark, sf_dir)).withColumn("sigma", F.round("sigma", 6)).withColumn("spread", F.round("spread", 6))
