"""Queries: text rules and sessionization over words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.windows import by_time
from ..operators import islands as I
from ..sources import fixtures as X
from .registry import query
from .sql import CANDIDATES, INTERVALS, WORDS, with_

TERM = r"'[.!?;:।॥]$'"
LAGS = f"""lag(end_ms) over w as pe, lag(speaker) over w as ps, lag(regexp_matches(trim(text), {TERM})) over w as pt, lag(word_idx) over w as pw"""
OVER = " window w as (partition by source_id order by start_ms, word_idx)"


def island(test: str) -> str:
    return f"""
b as (select *, {LAGS} from words{OVER}),
i as (select *, sum(case when {test} then 1 else 0 end) over (partition by source_id order by start_ms, word_idx rows unbounded preceding) as isl from b)"""


@query(with_(WORDS) + r"""select source_id, word_idx, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') as token from words""")
def o14_normalize_token(spark, sf_dir):
    return X.words(spark, sf_dir).select("source_id", "word_idx", T.normalize_token(F.col("text")).alias("token"))


_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in T.CONTINUATIONS)
_FILL = ", ".join(f"'{w}'" for w in T.FILLERS)


@query(with_(WORDS) + rf"""select source_id, word_idx, regexp_matches(trim(text), {TERM}) as ends_sentence, trim(text) like '%,' as ends_comma,
 regexp_replace(lower(trim(text)), '[^\pL\pN_'']', '', 'g') in ({_FILL}) as is_filler,
 regexp_replace(lower(trim(text)), '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g') in ({_LIST}) as is_continuation,
 regexp_matches(text, '[0-9]') as is_numeric, trim(text) like '%?' as is_question from words""")
def o15_word_flags(spark, sf_dir):
    t = F.col("text")
    return X.words(spark, sf_dir).select(
        "source_id", "word_idx", T.ends_sentence(t).alias("ends_sentence"), F.trim(t).endswith(",").alias("ends_comma"), T.is_filler(t).alias("is_filler"),
        T.is_continuation(t).alias("is_continuation"), T.is_numeric(t).alias("is_numeric"), T.is_question(t).alias("is_question"),
    )


@query(with_(WORDS, CANDIDATES) + """
, j as (select c.source_id, c.cand_id, w.word_idx, greatest(w.start_ms, c.start_ms + 500) as start_ms, least(w.end_ms, c.end_ms - 500) as end_ms
  from candidates c join words w on w.source_id = c.source_id and w.end_ms > c.start_ms + 500 and w.start_ms < c.end_ms - 500 where w.end_ms > w.start_ms and c.end_ms - c.start_ms >= 1000)
select source_id, cand_id, word_idx, start_ms, end_ms from (select *, lag(start_ms) over o as ps, lag(end_ms) over o as pe from j window o as (partition by source_id, cand_id order by start_ms, word_idx))
where ps is null or abs(start_ms - ps) >= 1 or abs(end_ms - pe) >= 1""")
def o16_clip_words(spark, sf_dir):
    from ..operators.clips import clip_words

    w = X.words(spark, sf_dir)
    clips = X.candidates(w).select("source_id", "cand_id", (F.col("start_ms") + 500).alias("start_ms"), (F.col("end_ms") - 500).alias("end_ms"))
    return clip_words(w, clips, ["source_id", "cand_id"]).select("source_id", "cand_id", "word_idx", "start_ms", "end_ms")


@query(with_(WORDS.replace("conv_id as source_id", "doc_id as source_id").replace("turn, role as speaker", "0 as turn, cast(null as varchar) as speaker").replace("from conversations", "from documents")) + r"""
, c as (select source_id, text, length(regexp_replace(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E।॥]', '', 'g')) as n, length(regexp_replace(text, '[^\x{900}-\x{97F}]', '', 'g')) - length(regexp_replace(text, '[^।॥]', '', 'g')) as d,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as l from words),
s as (select source_id, cast(sum(d) as double) / nullif(sum(n), 0) as dr, cast(sum(l) as double) / nullif(sum(n), 0) as lr from c group by 1)
select source_id, case when dr > 0.65 then 'HINDI' when dr > 0.10 and lr > 0.15 then 'HINGLISH' when dr > 0.05 then 'MULTILINGUAL' else 'ENGLISH' end as language,
 case when dr > 0.65 then 'devanagari' when dr > 0.10 and lr > 0.15 then 'mixed' when dr > 0.05 then 'mixed' else 'latin' end as script from s""")
def o17_language_script(spark, sf_dir):
    from ..operators.clips import language_script

    return language_script(X.document_words(spark, sf_dir))


@query(with_(WORDS) + r"""
, t as (select *, regexp_replace(lower(text), '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g') as k from words),
l as (select *, case when k <> '' and k = lag(k) over (partition by source_id order by start_ms, word_idx) then 0 else 1 end as b from t),
i as (select *, sum(b) over (partition by source_id order by start_ms, word_idx rows unbounded preceding) as isl from l),
r as (select source_id, isl, count(*) as n from i group by 1, 2), m as (select source_id, max(n) as streak from r group by 1),
s as (select source_id, count(*) as n_words, max(end_ms) as duration_ms from words group by 1)
select source_id, n_words, streak, case when streak >= 5 and n_words < 50 then 'repetition' when duration_ms > 45000 and n_words * 1000.0 / duration_ms < 0.20 then 'sparse' else 'ok' end as verdict from s join m using (source_id)""")
def o18_transcript_quality(spark, sf_dir):
    from ..operators.clips import transcript_quality

    w = X.words(spark, sf_dir)
    return transcript_quality(w, w.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))).select("source_id", "n_words", "streak", "verdict")


@query(with_(WORDS, island("pw is not null and (start_ms - pe > 850 or ps is distinct from speaker or pt)")) + """
select source_id, isl as segment_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, any_value(speaker) as speaker, count(*) as n_words, string_agg(text, ' ' order by word_idx) as text from i group by 1, 2""")
def o43_segments(spark, sf_dir):
    return I.segments(X.words(spark, sf_dir))


@query(with_(WORDS, island("pw is not null and ps is distinct from speaker")) + "select source_id, isl as turn_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, any_value(speaker) as speaker, count(*) as n_words from i group by 1, 2")
def o44_speaker_turns(spark, sf_dir):
    return I.speaker_turns(X.words(spark, sf_dir))


DIAR = island("pw is not null and (ps is distinct from speaker or start_ms - pe > 450)") + """,
diar as (select source_id, any_value(speaker) as speaker, min(start_ms) as start_ms, max(end_ms) as end_ms, 0.95 as confidence from i group by source_id, isl)"""


@query(with_(WORDS, DIAR) + "select source_id, speaker, start_ms, end_ms, cast(confidence as double) as confidence from diar")
def o45_diar_segments(spark, sf_dir):
    return I.diar_segments(X.words(spark, sf_dir))


@query(with_(WORDS, DIAR) + """
, m as (select *, lag(speaker) over (partition by source_id order by start_ms) as ps2, max(end_ms) over (partition by source_id order by start_ms rows between unbounded preceding and 1 preceding) as pe2 from diar),
n as (select *, sum(case when pe2 is not null and (ps2 <> speaker or start_ms - pe2 > 900) then 1 else 0 end) over (partition by source_id order by start_ms rows unbounded preceding) as k from m)
select source_id, any_value(speaker) as speaker, min(start_ms) as start_ms, max(end_ms) as end_ms from n group by source_id, k""")
def o46_merge_adjacent(spark, sf_dir):
    return I.merge_adjacent(I.diar_segments(X.words(spark, sf_dir)), 900).drop("confidence")


SENT = f"""
sb as (select *, coalesce(lag(regexp_matches(trim(text), {TERM})) over (partition by source_id order by start_ms, word_idx), false) as br from words),
si as (select *, sum(case when br then 1 else 0 end) over (partition by source_id order by start_ms, word_idx rows unbounded preceding) as k from sb),
sentences as (select source_id, k as sentence_idx, min(word_idx) as first_idx, max(word_idx) as last_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, arg_max(regexp_matches(trim(text), {TERM}), word_idx) as complete from si group by 1, 2)"""


@query(with_(WORDS, SENT) + "select * from sentences")
def o47_sentences(spark, sf_dir):
    return I.sentences(X.words(spark, sf_dir))


@query(with_(WORDS, f"""
cb as (select *, lag(end_ms) over w as pe, lag(speaker) over w as ps, lag(regexp_matches(trim(text), '[.,!?。！？;；]$')) over w as pc from words{OVER}),
ci as (select *, sum(case when coalesce(pc, false) or coalesce(start_ms - pe >= 400, false) or coalesce(ps <> speaker, false) then 1 else 0 end) over (partition by source_id order by start_ms, word_idx rows unbounded preceding) as k from cb),
cp as (select *, (row_number() over (partition by source_id, k order by start_ms, word_idx) - 1) // 8 as p from ci),
cg as (select source_id, k, p, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_words, string_agg(text, ' ' order by word_idx) as text from cp group by 1, 2, 3)""") + """
select source_id, start_ms, end_ms, n_words, text, row_number() over (partition by source_id order by k, p) - 1 as cue_idx from cg""")
def o49_cues(spark, sf_dir):
    return I.cues(X.words(spark, sf_dir))


#: The chunk fold as a recursion: one row per word, n and begin of the open chunk before it.
def _chunk_sql(hard: str, close: str) -> str:
    return with_(WORDS, f"""
hb as (select *, lag(end_ms) over w as pe, lag(regexp_matches(trim(text), {TERM})) over w as pt from words{OVER}),
hi as (select *, case when {hard} then 1 else 0 end as hard from hb),
rec as (select source_id, word_idx, text, start_ms, end_ms, 1 as n, start_ms as begin_ms, word_idx as first_idx from hi where word_idx = 0
  union all select h.source_id, h.word_idx, h.text, h.start_ms, h.end_ms,
    case when h.hard = 1 or ({close}) then 1 else r.n + 1 end, case when h.hard = 1 or ({close}) then h.start_ms else r.begin_ms end, case when h.hard = 1 or ({close}) then h.word_idx else r.first_idx end
  from rec r join hi h on h.source_id = r.source_id and h.word_idx = r.word_idx + 1)""") + "select source_id, first_idx, max(word_idx) as last_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, cast(count(*) as integer) as n_words from rec group by 1, 2"


@query(_chunk_sql("coalesce(start_ms - pe > 400, false) or coalesce(pt, false)", "r.n >= 5 or (r.n >= 2 and (trim(r.text) like '%,' or r.end_ms - r.begin_ms > 2500))"))
def o48_caption_chunks(spark, sf_dir):
    return I.caption_chunks(X.words(spark, sf_dir))


@query(with_(WORDS, f"""
kw as (select *, row_number() over w as i from words where regexp_matches(text, '[\\p{{L}}\\p{{N}}]'){OVER}),
kb as (select *, lag(end_ms) over w as pe, lag(word_idx) over w as pw, lag(regexp_matches(trim(text), {TERM}) or text like '%,') over w as pt from kw{OVER}),
kh as (select *, coalesce(start_ms - pe > case when (pw + 1) % 3 = 0 then 210 else 350 end, false) or coalesce(pt, false) as hard from kb),
rec as (select source_id, i, word_idx, start_ms, end_ms, 1 as n, start_ms as begin_ms, word_idx as first_idx from kh where i = 1
  union all select h.source_id, h.i, h.word_idx, h.start_ms, h.end_ms, case when h.opens then 1 else h.n + 1 end, case when h.opens then h.start_ms else h.begin_ms end, case when h.opens then h.word_idx else h.first_idx end
  from (select h.*, r.n, r.begin_ms, r.first_idx, h.hard or r.n >= 5 or h.end_ms - r.begin_ms > 3000 as opens from rec r join kh h on h.source_id = r.source_id and h.i = r.i + 1) h)""")
  + "select source_id, first_idx, max(word_idx) as last_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, cast(count(*) as integer) as n_words from rec group by 1, 2")
def o50_speech_chunks(spark, sf_dir):
    w = X.words(spark, sf_dir)
    likely = w.select("source_id", (F.col("word_idx") - 1).alias("word_idx"), F.when(F.col("word_idx") % 3 == 0, 0.9).otherwise(0.1).alias("p_boundary"))
    return I.speech_chunks(w, likely)


@query(_chunk_sql("coalesce(start_ms - pe > 400, false) or coalesce(pt, false)", "r.n >= 5 or (r.n >= 2 and (trim(r.text) like '%,' or r.end_ms - r.begin_ms > 2500))").rsplit("select source_id, first_idx", 1)[0] + f""",
ch as (select source_id, first_idx, max(word_idx) as last_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_words, arg_max(regexp_matches(trim(text), {TERM}), word_idx) as es from rec group by 1, 2),
cm as (select *, coalesce(lead(start_ms) over o - end_ms <= 350 and lead(end_ms) over o - start_ms <= 4000 and lead(n_words) over o + n_words <= 8 and not es, false) as may from ch window o as (partition by source_id order by start_ms)),
cr as (select *, coalesce(lag(may) over (partition by source_id order by start_ms), false) as pm from cm),
cs as (select *, sum(case when pm then 0 else 1 end) over (partition by source_id order by start_ms rows unbounded preceding) as run from cr),
cu as (select *, (row_number() over (partition by source_id, run order by start_ms) - 1) // 2 as u from cs)
select source_id, min(first_idx) as first_idx, max(last_idx) as last_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_chunks, cast(sum(n_words) as bigint) as n_words from cu group by source_id, run, u""")
def o51_phrase_units(spark, sf_dir):
    w = X.words(spark, sf_dir)
    chunks = I.caption_chunks(w)
    ends = w.select("source_id", F.col("word_idx").alias("last_idx"), T.ends_sentence(F.col("text")).alias("ends_sentence"))
    return I.phrase_units(chunks.join(ends, ["source_id", "last_idx"]))


@query(with_(WORDS, SENT) + """
, w6 as (select s.source_id, s.sentence_idx as chunk_idx, list(w.text order by w.word_idx)[1:6] as t from sentences s join words w on w.source_id = s.source_id and w.word_idx between s.first_idx and s.last_idx group by 1, 2),
h as (select *, case when len(t) <= 3 then len(t) else (len(t) + 1) // 2 end as h from w6)
select source_id, chunk_idx, array_to_string(t[1:h], ' ') as line_1, array_to_string(t[h+1:], ' ') as line_2 from h""")
def o137_wrap_lines(spark, sf_dir):
    w = X.words(spark, sf_dir)
    named = I._numbered(w, F.lag(T.ends_sentence(F.col("text"))).over(by_time()), "chunk_idx")
    return I.wrap_lines(named.select("source_id", "chunk_idx", "word_idx", "text"))


HINTS = f"""
hw as (select *, case when regexp_matches(text, '[,;:]$') or regexp_matches(trim(text), {TERM}) or word_idx % 9 = 7 then word_idx when word_idx > 0 and regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') in ({", ".join(f"'{c}'" for c in T.CONJUNCTIONS)}) then word_idx - 1 end as brk from words),
hints as (select distinct source_id, brk as word_idx from hw where brk is not null)"""


@query(with_(WORDS, HINTS) + """
, c as (select source_id, word_idx // 5 as chunk_idx, list(text order by word_idx) as t, min(word_idx) as f, count(*) as n from words group by 1, 2),
p as (select c.source_id, c.chunk_idx, arg_min(h.word_idx - f + 1, (abs(h.word_idx - f + 1 - (n + 1) // 2), h.word_idx)) as brk from c join hints h on h.source_id = c.source_id and h.word_idx - f + 1 between greatest(1, n - 3) and least(3, n - 1) group by 1, 2),
k as (select c.*, case when n <= 3 then n else coalesce(p.brk, (n + 1) // 2) end as h from c left join p using (source_id, chunk_idx))
select source_id, chunk_idx, array_to_string(t[1:h], ' ') as line_1, array_to_string(t[h+1:], ' ') as line_2 from k""")
def o137_wrap_hinted(spark, sf_dir):
    w = X.words(spark, sf_dir)
    hints = I.line_break_hints(w, w.filter("word_idx % 9 = 7").select("source_id", F.col("word_idx").alias("last_idx")))
    return I.wrap_lines(w.select("source_id", F.floor(F.col("word_idx") / 5).alias("chunk_idx"), "word_idx", "text"), hints=hints)


FRAMES = """frame_probs as (select source_id, row_number() over (partition by source_id, cls order by start_ms, event_id) - 1 as frame, cls, (event_id * 17) % 100 / 100.0 as p from intervals)"""


def frame_probs(spark, sf_dir):
    order = Window.partitionBy("source_id", "cls").orderBy("start_ms", "event_id")
    return X.intervals(spark, sf_dir).select("source_id", (F.row_number().over(order) - 1).alias("frame"), "cls", ((F.col("event_id") * 17) % 100 / 100.0).alias("p"))


@query(with_(INTERVALS, FRAMES) + """
, h as (select *, frame - row_number() over (partition by source_id, cls order by frame) as k from frame_probs where p >= 0.5)
select source_id, cls, min(frame) * 100 as start_ms, (max(frame) + 1) * 100 as end_ms, max(p) as confidence from h group by source_id, cls, k having max(frame) - min(frame) >= 1""")
def o52_events_from_frames(spark, sf_dir):
    return I.events_from_frames(frame_probs(spark, sf_dir))


@query(with_(INTERVALS, FRAMES) + "select source_id, cls, max(p) as peak, arg_min(frame, (-p, frame)) as frame from frame_probs group by 1, 2")
def o52_class_peaks(spark, sf_dir):
    return I.class_peaks(frame_probs(spark, sf_dir))


@query(with_(WORDS) + """
, m as (select *, case when word_idx % 11 < 3 then 'supporting' when word_idx % 50 between 20 and 24 then 'hook' end as kind from words),
k as (select *, word_idx - row_number() over (partition by source_id, kind order by word_idx) as g from m where kind is not null)
select source_id, kind, min(word_idx) as first_idx, max(word_idx) as last_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_words, bool_or(regexp_matches(text, '[0-9]')) as numeric
from k group by source_id, kind, g having kind <> 'supporting' or count(*) >= 2 or bool_or(regexp_matches(text, '[0-9]'))""")
def o53_emphasis_spans(spark, sf_dir):
    w = X.words(spark, sf_dir)
    kind = F.when(F.col("word_idx") % 11 < 3, "supporting").when((F.col("word_idx") % 50).between(20, 24), "hook")
    return I.emphasis_spans(w, w.select("source_id", "word_idx", kind.alias("kind")).filter("kind is not null"))


_token = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')".format
_terms = ", ".join(f"'{c}'" for c in T.SUPPORTING_TERMS)


@query(with_(WORDS, CANDIDATES) + f"""
, c as (select *, (cand_id * 13 + source_id) % 100 / 100.0 as payoff, cand_id % 5 > 0 as whole, list_filter(list_transform(regexp_split_to_array(hook, '\\s+'), lambda x: {_token("x")}), lambda x: x <> '') as t from candidates),
f as (select c.source_id, c.cand_id, c.score, c.payoff, w.word_idx, w.text, w.start_ms, w.end_ms, c.score >= 0.7 and w.start_ms < c.start_ms + 3000 and list_contains(c.t, {_token("w.text")}) as h, c.payoff >= 0.75 and c.whole and w.end_ms > c.end_ms - 3000 as p,
 {_token("w.text")} in ({_terms}) or regexp_matches({_token("w.text")}, '[0-9]') as s from c join words w on w.source_id = c.source_id and w.end_ms > c.start_ms and w.start_ms < c.end_ms),
g as (select source_id, cand_id, bool_or(h) as h, bool_or(p) as p, bool_or(s) as s, any_value(score)::double as hs, any_value(payoff)::double as ps from f group by 1, 2),
q as (select source_id, cand_id, round(least(1, case when h and p then least(1, greatest(hs, ps) + 0.1::double) when h then hs when p then ps end + case when s then 0.05::double else 0 end), 6) as confidence from g where h or p),
m as (select * from (select f.*, 'hook' as kind from f where h union all select f.*, 'payoff' from f where p union all select f.*, 'supporting' from f where s) join (select * from q where confidence >= 0.75) using (source_id, cand_id)),
k as (select *, word_idx - row_number() over (partition by source_id, cand_id, kind order by word_idx) as g from m),
r as (select source_id, cand_id, kind, min(word_idx) as first_idx, max(word_idx) as last_idx, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_words, bool_or(regexp_matches(text, '[0-9]')) as numeric, any_value(confidence) as confidence from k group by source_id, cand_id, kind, g)
select * from r where kind <> 'supporting' or ((n_words >= 2 or numeric) and not exists (select 1 from r o where o.source_id = r.source_id and o.cand_id = r.cand_id and o.kind <> 'supporting' and o.first_idx <= r.first_idx and o.last_idx >= r.last_idx))""")
def o53_emphasis_plan(spark, sf_dir):
    """Candidates with a hook in their first 3 s and a payoff, of any words, in their last 3 s."""
    w = X.words(spark, sf_dir)
    c = X.candidates(w).select(
        "source_id", "cand_id", "start_ms", "end_ms", "hook", F.col("start_ms").alias("hook_start_ms"), (F.col("start_ms") + 3000).alias("hook_end_ms"), F.col("score").alias("hook_confidence"), F.lit(None).cast("string").alias("payoff_text"),
        (F.col("end_ms") - 3000).alias("payoff_start_ms"), F.col("end_ms").alias("payoff_end_ms"), ((F.col("cand_id") * 13 + F.col("source_id")) % 100 / 100.0).alias("payoff_score"), (F.col("cand_id") % 5 > 0).alias("payoff_completion"),
    )
    return I.emphasis_plan(w, c)


@query(with_(INTERVALS) + """
, r as (select distinct source_id, start_ms as t from intervals), o as (select *, row_number() over (partition by source_id order by t) as n from r),
k as (select source_id, n, t, t as last_kept, true as kept from o where n = 1 union all
  select o.source_id, o.n, o.t, case when o.t - k.last_kept >= 600000 then o.t else k.last_kept end, o.t - k.last_kept >= 600000 from k join o on o.source_id = k.source_id and o.n = k.n + 1)
select source_id, t as t_ms from k where kept""")
def o57_debounce_cuts(spark, sf_dir):
    from ..operators.intervals import debounced

    return debounced(X.intervals(spark, sf_dir).select("source_id", F.col("start_ms").alias("t_ms")), 600_000)


@query(with_(INTERVALS) + """
, d as (select source_id, max(end_ms) as duration_ms from intervals group by 1),
s as (select distinct source_id, t from (select i.source_id, start_ms as t from intervals i join d using (source_id) where start_ms > 0 and start_ms < duration_ms union all select source_id, 0 from d))
select s.source_id, row_number() over o - 1 as scene_idx, t as start_ms, coalesce(lead(t) over o, duration_ms) as end_ms from s join d using (source_id) window o as (partition by s.source_id order by t)""")
def o62_scenes_from_cuts(spark, sf_dir):
    i = X.intervals(spark, sf_dir)
    return I.scenes_from_cuts(i.select("source_id", F.col("start_ms").alias("t_ms")), i.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")))


@query(with_(INTERVALS) + """
, s as (select source_id, cls, event_id % 2 = 0 as speaking, start_ms, end_ms, lag(event_id % 2 = 0) over w as ps, lag(end_ms) over w as pe from intervals window w as (partition by source_id, cls order by start_ms, end_ms)),
k as (select *, sum(case when pe is not null and (ps <> speaking or start_ms - pe > 3600000) then 1 else 0 end) over (partition by source_id, cls order by start_ms, end_ms rows unbounded preceding) as g from s)
select source_id, cls as track_id, any_value(speaking) as speaking, min(start_ms) as start_ms, max(end_ms) as end_ms from k group by source_id, cls, g""")
def o63_merge_states(spark, sf_dir):
    states = X.intervals(spark, sf_dir).select("source_id", F.col("cls").alias("track_id"), (F.col("event_id") % 2 == 0).alias("speaking"), "start_ms", "end_ms", ((F.col("event_id") * 7) % 100 / 100.0).alias("confidence"))
    return I.merge_states(states, 3_600_000).drop("confidence")
