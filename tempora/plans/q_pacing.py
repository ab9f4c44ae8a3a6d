"""Queries: pacing plans and clip boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries as B
from ..operators import gaps as G
from ..operators import islands as I
from ..operators import pacing as P
from ..operators import screens as S
from ..sources import fixtures as X
from .q_intervals import RETAINED, cut_clips
from .q_islands import OVER, TERM
from .q_scoring import evidence
from .registry import query
from .sql import CANDIDATES, INTERVALS, SILENCES, WORDS, with_


def clip_table(w):
    """Clips of about 150 words, with air at both ends."""
    k = F.floor(F.col("word_idx") / 150)
    return w.groupBy("source_id", k.alias("clip_id")).agg((F.min("start_ms") - 900).alias("start_ms"), (F.max("end_ms") + 900).alias("end_ms"))


def pauses(w):
    """Silences wide enough for every rule: whole gaps."""
    return G.word_gaps(w, 100).select("source_id", "start_ms", "end_ms")


@query()
def o117_propose_edits(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return P.propose_edits(w, clip_table(w), pauses(w), G.classify_gaps(evidence(spark, sf_dir)))


@query()
def o118_plan_pacing(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return P.plan_pacing(w, clip_table(w), pauses(w), G.classify_gaps(evidence(spark, sf_dir)))


@query(with_(WORDS, SILENCES, RETAINED) + """
select d.source_id, d.d as in_ms, cast(coalesce(sum(src_end - src_start), 0) as bigint) as out_ms, round(100.0 * (d.d - coalesce(sum(src_end - src_start), 0)) / d.d, 3) as removed_pct from rd d left join retained r using (source_id) group by 1, 2""")
def o119_tiling_report(spark, sf_dir):
    w, kept = cut_clips(spark, sf_dir)
    clips = w.groupBy("source_id").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return P.tiling_report(kept, clips, ["source_id"])


@query(with_(WORDS, SILENCES, RETAINED) + """
, p as (select rd.source_id, d, sum(src_end - src_start) as o, count(*) as n from rd join retained using (source_id) group by 1, 2),
e as (select source_id, count(*) as n from silences where end_ms - start_ms >= 500 group by 1)
select p.source_id, 0::bigint as clip_id, case when e.n is null then 'no edits' when p.source_id % 3 = 0 then 'tiling' when o < 3000 then 'output under 3 s' when d - o > 0.4 * d + 50 then 'over 40% removed' else 'ok' end as verdict from p left join e using (source_id)""")
def o20_validate_plan(spark, sf_dir):
    w, kept = cut_clips(spark, sf_dir)
    clip = F.lit(0).cast("long").alias("clip_id")
    sums = kept.groupBy("source_id").agg(F.sum(F.col("src_end") - F.col("src_start")).alias("out"))
    d = w.groupBy("source_id").agg(F.max("end_ms").alias("d")).join(sums, "source_id")
    off = F.when(F.col("source_id") % 3 == 0, 500).otherwise(0)  # a third of the plans state a wrong length
    plans = d.select("source_id", clip, F.lit(0).cast("long").alias("clip_start"), F.col("d").alias("clip_end"), (F.col("out") + off).alias("output_ms"), (F.col("d") - F.col("out") - off).alias("removed_ms"))
    edits = X.silences(w).filter("end_ms - start_ms >= 500").select("source_id", clip, "start_ms", "end_ms")
    return P.validate_plan(plans, edits, kept.withColumn("clip_id", clip))


@query(with_(INTERVALS) + """
, s as (select source_id, row_number() over w - 1 as k, start_ms / 1000.0 as s, case when source_id % 3 = 0 then end_ms else least(end_ms, coalesce(lead(start_ms) over w, end_ms)) end / 1000.0 as e from intervals window w as (partition by source_id order by start_ms, event_id)),
b as (select *, case when s < 0 then 'before zero' when e <= s then 'non-positive' when s < lag(e) over (partition by source_id order by k) then 'non-monotonic' end as bad from s),
a as (select source_id, arg_min(bad, k) filter (bad is not null) as bad, arg_max(e, k) as last from b group by 1)
select source_id, case when bad is not null then bad when last > (2000000 + 100000 * (source_id % 10)) * 1.05 + 5 then 'beyond duration' else 'ok' end as verdict from a""")
def o19_validate_scenes(spark, sf_dir):
    from pyspark.sql import Window

    i = X.intervals(spark, sf_dir)
    w = Window.partitionBy("source_id").orderBy("start_ms", "event_id")
    # two thirds of the sources end a scene where the next begins, the others let scenes overlap
    until = F.when(F.col("source_id") % 3 == 0, F.col("end_ms")).otherwise(F.least("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("end_ms"))))
    scenes = i.select("source_id", (F.row_number().over(w) - 1).alias("scene_idx"), (F.col("start_ms") / 1000.0).alias("start_s"), (until / 1000.0).alias("end_s"))
    return P.validate_scenes(scenes, i.select("source_id").distinct().withColumn("duration_s", 2_000_000.0 + 100_000 * (F.col("source_id") % 10)))


@query(with_(WORDS, CANDIDATES) + """
, c as (select *, cand_id // 4 as window_idx from candidates), w as (select source_id, window_idx, min(start_ms) + 12000 as window_start from c group by 1, 2)
select c.source_id, c.cand_id from c join w using (source_id, window_idx) where c.start_ms >= window_start - 10000 and c.start_ms <= window_start + 30000 and c.end_ms - c.start_ms >= 10000""")
def o21_validate_window_bounds(spark, sf_dir):
    c = X.candidates(X.words(spark, sf_dir)).withColumn("window_idx", F.floor(F.col("cand_id") / 4))
    windows = c.groupBy("source_id", "window_idx").agg((F.min("start_ms") + 12_000).alias("window_start"))
    return P.validate_window_bounds(c, windows).select("source_id", "cand_id")


@query(with_(INTERVALS) + "select source_id, cls as edit_type, count(*) as n, cast(sum(end_ms - start_ms) as bigint) as removed_ms from intervals group by rollup (source_id, cls)")
def o73_edit_summary(spark, sf_dir):
    return P.edit_summary(X.intervals(spark, sf_dir).withColumnRenamed("cls", "edit_type"))


STARTS = f"""
sw as (select *, coalesce(lag(regexp_matches(trim(text), {TERM})) over (partition by source_id order by start_ms, word_idx), false) as aft, lag(end_ms) over (partition by source_id order by start_ms, word_idx) as pe from words),
sf as (select *, last_value(case when aft or pe is null then start_ms end ignore nulls) over (partition by source_id order by start_ms, word_idx rows unbounded preceding) as fs from sw),
sc as (select source_id, cand_id, start_ms, case when cand_id % 3 = 0 then null else start_ms + 2300 end as anchor, cand_id % 2 = 0 as q from candidates),
st as (select *, case when anchor is null or (q and start_ms < anchor - 1000) then start_ms else anchor end as t, case when anchor is null then 'free' when q and start_ms < anchor - 1000 then 'question' else 'anchor' end as rule from sc),
sn as (select st.*, f.start_ms as ws, f.aft, f.pe, f.fs, row_number() over (partition by st.source_id, st.cand_id order by abs(f.start_ms - st.t), f.word_idx) as k from st join sf f using (source_id))"""


@query(with_(WORDS, CANDIDATES, STARTS) + """
select source_id, cand_id, greatest(0, case when aft then greatest(ws - 150, pe) when rule = 'question' then ws when rule = 'anchor' and ws - fs <= 2000 then fs when rule = 'free' and ws - fs <= 1500 then fs else ws end) as snapped_start from sn where k = 1""")
def o112_snap_start(spark, sf_dir):
    return B.snap_start(anchored(spark, sf_dir), X.words(spark, sf_dir)).select("source_id", "cand_id", "snapped_start")


def anchored(spark, sf_dir):
    c = X.candidates(X.words(spark, sf_dir))
    return c.select("source_id", "cand_id", "start_ms", "end_ms", F.when(F.col("cand_id") % 3 != 0, F.col("start_ms") + 2300).alias("anchor_ms"), (F.col("cand_id") % 2 == 0).alias("is_question"))


def snapped(spark, sf_dir):
    w = X.words(spark, sf_dir)
    i = F.col("cand_id")
    rows = B.snap_start(anchored(spark, sf_dir), w).withColumns({
        "payoff_end": F.when(i % 4 == 0, F.col("end_ms") + 3000), "payoff_incomplete": i % 8 == 0, "must_extend": i % 5 == 1, "floor_ms": F.when(i % 7 == 2, F.col("end_ms") + 1500), "low_confidence": i % 6 == 3
    })
    return B.snap_end(rows, w, w.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")))


@query()
def o113_snap_end(spark, sf_dir):
    return snapped(spark, sf_dir).select("source_id", "cand_id", "snapped_start", "snapped_end")


@query()
def o114_optimize_boundaries(spark, sf_dir):
    w = X.words(spark, sf_dir)
    c = X.candidates(w).withColumn("payoff_end", F.when(F.col("cand_id") % 4 == 0, F.col("end_ms")))
    # the fixture's invented words: the frequent short ones stand for setup and wind-down words
    common = ["the", "of", "and", "is", "to", "in", "a", "as", "at", "for", "er", "ou", "la", "le", "de", "en", "et", "der", "die", "das"]
    return B.optimize_boundaries(c, w, common, common).select("source_id", "cand_id", "new_start", "new_end")


@query(with_(WORDS, CANDIDATES) + f"""
, b as (select *, coalesce(regexp_matches(lag(regexp_replace(trim(text), '["''”’)\\]}}]+$', '')) over w, {TERM}), true) or coalesce(start_ms - lag(end_ms) over w >= 1200, true) as begins from words window w as (partition by source_id order by start_ms, word_idx)),
j as (select c.source_id, c.cand_id, b.*exclude (source_id), sum(begins::int) over (partition by c.source_id, c.cand_id order by b.start_ms, b.word_idx rows unbounded preceding) as k from candidates c join b on b.source_id = c.source_id and b.start_ms >= c.start_ms - 200 and b.end_ms <= c.end_ms + 150),
m as (select *, max(k) over (partition by source_id, cand_id) as mk from j)
select source_id, cand_id, string_agg(text, ' ' order by word_idx) as text, min(start_ms) as start_ms, max(end_ms) as end_ms from m where k = mk group by 1, 2""")
def o115_final_sentence(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return B.final_sentence(X.candidates(w), w)


@query(with_(WORDS, CANDIDATES) + """
, c as (select source_id, cand_id, end_ms as e, end_ms + (cand_id % 5) * 90 - 150 as f, (cand_id * 7) % 100 / 100.0 as p, (cand_id * 3) % 100 / 100.0 as b, (cand_id * 13) % 100 / 100.0 as m, case when cand_id % 3 = 0 then null else cand_id % 7 <> 1 end as a from candidates),
x as (select c.*, (select arg_max(text, word_idx) from words w where w.source_id = c.source_id and w.end_ms <= c.e + 100) as lw, (select max(end_ms) from words w where w.source_id = c.source_id and w.end_ms <= c.e + 100) as le,
 (select arg_min(text, word_idx) from words w where w.source_id = c.source_id and w.start_ms >= c.e - 50) as nw, (select min(start_ms) from words w where w.source_id = c.source_id and w.start_ms >= c.e - 50) as ns from c)
select source_id, cand_id, lw as last_word, nw as next_word, coalesce(greatest(ns - le, 0), 0) as pause_ms, case when f - e > 100 then 'EXTENDED' when abs(f - e) <= 100 then 'ACCEPTED' else 'SNAPPED_EARLIER' end as action,
 case when p > 0.70 then 'continuation' when b > 0.65 then 'breath_pause' when m > 0.65 then 'mid_thought' when coalesce(not a, false) then 'answer' when f - e > 100 then 'terminator' else 'clean' end as reason from x""")
def o116_boundary_trace(spark, sf_dir):
    w = X.words(spark, sf_dir)
    i = F.col("cand_id")
    rows = X.candidates(w).select(
        "source_id", "cand_id", F.col("end_ms").alias("raw_end"), (F.col("end_ms") + (i % 5) * 90 - 150).alias("final_end"), ((i * 7) % 100 / 100.0).alias("continuation_probability"), ((i * 3) % 100 / 100.0).alias("breath_pause_risk"), ((i * 13) % 100 / 100.0).alias("mid_thought_risk"),
        F.when(i % 3 == 0, None).otherwise(i % 7 != 1).alias("answer_complete"),
    )
    return B.boundary_trace(rows, w)




#: Lines of 14 wide characters; a scene starts every 7 s and lasts 5 s, so scenes cut cues.
LIMIT = 700


@query(with_(WORDS, f"""
cb as (select *, lag(end_ms) over w as pe, lag(speaker) over w as ps, lag(regexp_matches(trim(text), '[.,!?。！？;；]$')) over w as pc from words{OVER}),
ci as (select *, sum(case when coalesce(pc, false) or coalesce(start_ms - pe >= 400, false) or coalesce(ps <> speaker, false) then 1 else 0 end) over (partition by source_id order by start_ms, word_idx rows unbounded preceding) as k from cb),
cp as (select *, (row_number() over (partition by source_id, k order by start_ms, word_idx) - 1) // 8 as p from ci),
cg as (select source_id, k, p, min(start_ms) as start_ms, max(end_ms) as end_ms, string_agg(text, ' ' order by word_idx) as text from cp group by 1, 2, 3),
cues as (select source_id, row_number() over (partition by source_id order by k, p) - 1 as cue_idx, start_ms, end_ms, trim(text) as text from cg),
sc as (select source_id, max(end_ms) as d from words group by 1),
scenes as (select source_id, unnest(range(d // 7000 + 1)) as scene_idx, unnest(range(d // 7000 + 1)) * 7000 as lo, unnest(range(d // 7000 + 1)) * 7000 + 5000 as hi from sc),
cl as (select source_id, cue_idx, unnest(c) as rest, generate_subscripts(c, 1) as ci from (select source_id, cue_idx, regexp_extract_all(text, '[^，。！？!?；;、,：:]+[，。！？!?；;、,：:]*') as c from cues)),
-- a clause too wide is cut at a space: the last one that fits if it fills half a line, else the first
cut as (select source_id, cue_idx, ci, 0 as k, cast(null as varchar) as piece, trim(rest) as rest from cl
  union all select source_id, cue_idx, ci, k + 1, trim(rest[1:n]), trim(rest[n + 1:]) from (
    select *, case when 55 * length(rest) <= {LIMIT} then length(rest) else coalesce(list_max(list_filter(sp, lambda i: 110 * i >= {LIMIT})), list_min(sp), {LIMIT} // 55) end as n
    from (select *, list_filter(range(1, length(rest)), lambda i: rest[i] = ' ' and 55 * i <= {LIMIT}) as sp from cut where rest <> ''))),
pieces as (select source_id, cue_idx, row_number() over (partition by source_id, cue_idx order by ci, k) as i, piece from cut where piece <> ''),
ln as (select source_id, cue_idx, i, piece as line, 0 as l from pieces where i = 1
  union all select p.source_id, p.cue_idx, p.i, case when 55 * length(line || ' ' || piece) <= {LIMIT} then line || ' ' || piece else piece end, l + case when 55 * length(line || ' ' || piece) <= {LIMIT} then 0 else 1 end
  from ln join pieces p on p.source_id = ln.source_id and p.cue_idx = ln.cue_idx and p.i = ln.i + 1),
lines as (select source_id, cue_idx, l, arg_max(line, i) as line from ln group by 1, 2, 3),
scr as (select source_id, cue_idx, l // 2 as screen_idx, string_agg(line, chr(10) order by l) as text, greatest(sum(55 * length(line)), 100) as w from lines group by 1, 2, 3),
acc as (select *, sum(w) over (partition by source_id, cue_idx order by screen_idx) as u, sum(w) over (partition by source_id, cue_idx) as t from scr),
paced as (select a.source_id, a.cue_idx, screen_idx, a.text, start_ms + cast(round((end_ms - start_ms) * (u - w) / t) as bigint) as s, start_ms + cast(round((end_ms - start_ms) * u / t) as bigint) as e from acc a join cues using (source_id, cue_idx))""") + """
select source_id, scene_idx, row_number() over (partition by source_id, scene_idx order by greatest(s, lo), cue_idx, screen_idx) as idx, cue_idx, screen_idx, greatest(s, lo) - lo as start_ms, least(e, hi) - lo as end_ms, text
from paced join scenes using (source_id) where e > lo and s < hi and e > s""")
def o138_slice_and_pace(spark, sf_dir):
    w = X.words(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("d") / 7000)))
    scenes = w.groupBy("source_id").agg(F.max("end_ms").alias("d")).select("source_id", k.alias("scene_idx"))
    scenes = scenes.select("source_id", "scene_idx", (F.col("scene_idx") * 7000).alias("start_ms"), (F.col("scene_idx") * 7000 + 5000).alias("end_ms"))
    return S.slice_and_pace(I.cues(w), scenes, LIMIT)
