"""Queries: gaps, scores, openings, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps as G
from ..operators import scoring as S
from ..sources import fixtures as X
from .registry import query
from .sql import CANDIDATES, INTERVALS, SILENCES, WORDS, with_

TERM = r"'[.!?;:।॥]$'"
GAPS = """
gaps as (select source_id, word_idx as gap_idx, end_ms as start_ms, ne as end_ms, text as prev_text, nt as next_text, speaker as prev_speaker, ns as next_speaker from
 (select *, lead(start_ms) over w as ne, lead(text) over w as nt, lead(speaker) over w as ns from words window w as (partition by source_id order by start_ms, word_idx)) where ne - end_ms >= 50)"""
EVID = """
evid as (select *, (gap_idx * 37 + source_id) % 40 / 100.0 as hf_ratio, case when gap_idx % 13 = 0 then null else (gap_idx * 29) % 70 / 1.0 end as above_floor_db, case when gap_idx % 13 = 0 then null else (gap_idx * 17) % 30 / 1.0 end as contrast_db, (gap_idx * 7) % 20 / 1000.0 as flatness, (gap_idx * 11) % 12 / 1.0 as energy_drop_db from gaps)"""


def gaps(spark, sf_dir):
    return G.word_gaps(X.words(spark, sf_dir))


def evidence(spark, sf_dir):
    g, i = gaps(spark, sf_dir), F.col("gap_idx")
    unmeasured = i % 13 == 0
    return g.withColumns({
        "hf_ratio": (i * 37 + F.col("source_id")) % 40 / 100.0, "above_floor_db": F.when(~unmeasured, (i * 29) % 70 / 1.0), "contrast_db": F.when(~unmeasured, (i * 17) % 30 / 1.0),
        "flatness": (i * 7) % 20 / 1000.0, "energy_drop_db": (i * 11) % 12 / 1.0,
    })


@query(with_(WORDS, GAPS) + "select * from gaps")
def o83_word_gaps(spark, sf_dir):
    return gaps(spark, sf_dir)


_FILLERS = ", ".join(f"'{w}'" for w in ["um", "uh", "uhm", "umm", "erm", "hmm", "mm", "mmm", "ah", "er", "eh"])
CLASSIFY = f"""
classified as (select *, case when prev_speaker is distinct from next_speaker then 'speaker_transition' when above_floor_db is null and contrast_db is null then 'nonspeech_unknown' when above_floor_db < 10 then 'nonspeech_unknown' when contrast_db < 6 then 'nonspeech_unknown'
 when s < 0.15 and hf_ratio < 0.08 then 'normal_word_gap' when above_floor_db < 30 and (flatness < 0.005 or hf_ratio < 0.15) then 'nonspeech_unknown'
 when s >= 1.10 and above_floor_db >= 45 and contrast_db >= 18 and not es then 'waiting_pause' when s >= 1.10 and es then 'sentence_pause' when s >= 1.10 then 'dramatic_pause'
 when es or regexp_replace(lower(trim(next_text)), '[^\\pL\\pN_'']', '', 'g') in ({_FILLERS}) then 'sentence_pause' when hf_ratio >= 0.15 and contrast_db >= 6 and s >= 0.5 then 'waiting_pause' when hf_ratio >= 0.15 and contrast_db >= 6 then 'breath_pause' else 'normal_word_gap' end as category,
 case when prev_speaker is distinct from next_speaker then 0.95 when above_floor_db is null and contrast_db is null then 0.75 when above_floor_db < 10 then 0.70 when contrast_db < 6 and flatness < 0.005 then 0.80 when contrast_db < 6 then 0.78
 when s < 0.15 and hf_ratio < 0.08 then 0.90 when above_floor_db < 30 and (flatness < 0.005 or hf_ratio < 0.15) then 0.72 when s >= 1.10 and above_floor_db >= 45 and contrast_db >= 18 and not es then 0.72 when s >= 1.10 and es then 0.88 when s >= 1.10 then 0.85
 when es or regexp_replace(lower(trim(next_text)), '[^\\pL\\pN_'']', '', 'g') in ({_FILLERS}) then 0.85 when hf_ratio >= 0.15 and contrast_db >= 6 and s >= 0.5 then 0.80 when hf_ratio >= 0.15 and contrast_db >= 6 then 0.82 when hf_ratio < 0.08 then 0.90 else 0.75 end::double as confidence
 from (select *, (end_ms - start_ms) / 1000.0 as s, regexp_matches(trim(prev_text), {TERM}) as es from evid))"""


@query(with_(WORDS, GAPS, EVID, CLASSIFY) + "select source_id, gap_idx, category, confidence from classified")
def o84_classify_gaps(spark, sf_dir):
    return G.classify_gaps(evidence(spark, sf_dir)).select("source_id", "gap_idx", "category", "confidence")


@query(with_(WORDS, GAPS, EVID) + f"""select source_id, gap_idx, round(greatest(0.0, least(1.0, least(1.0, (end_ms - start_ms) / 1000.0 / 0.6) * 0.55 + case when regexp_matches(trim(prev_text), {TERM}) then 1.0 else 0.0 end + case when rtrim(prev_text) like '%,' then 0.45 else 0.0 end
 + case when energy_drop_db > 6 then 0.15 else 0.0 end - case when coalesce(prev_speaker <> next_speaker, false) then 1.0 else 0.0 end))::double, 3) as p_boundary from evid""")
def o85_boundary_prior(spark, sf_dir):
    return G.boundary_prior(evidence(spark, sf_dir)).select("source_id", "gap_idx", "p_boundary")


@query(with_(WORDS, GAPS, EVID, CLASSIFY) + """
, h as (select *, case when gap_idx % 17 = 0 then 'breath_pause' when gap_idx % 19 = 0 then 'nonsense' end as human, (gap_idx % 10) / 10.0 as vad_silence, -((gap_idx % 9) * 1.0) as level_drop_db from classified)
select source_id, gap_idx, case when human = 'breath_pause' then human when category = 'speaker_transition' then 'speaker_transition' when (category in ('breath_pause', 'waiting_pause') and confidence >= 0.70) or category = 'breath_pause' or (vad_silence >= 0.6 and level_drop_db < -6) then case when hf_ratio >= 0.15 then 'breath_pause' else 'waiting_pause' end
 when category = 'nonspeech_unknown' then 'nonspeech_unknown' when es or category = 'sentence_pause' then 'sentence_pause' else 'normal_word_gap' end as label, human is null or human <> 'breath_pause' as weak from h""")
def o86_weak_labels(spark, sf_dir):
    c = G.classify_gaps(evidence(spark, sf_dir)).withColumns({
        "human": F.when(F.col("gap_idx") % 17 == 0, "breath_pause").when(F.col("gap_idx") % 19 == 0, "nonsense"), "vad_silence": (F.col("gap_idx") % 10) / 10.0, "level_drop_db": -((F.col("gap_idx") % 9) * 1.0)
    })
    return G.weak_labels(c).select("source_id", "gap_idx", "label", "weak")


@query(with_(WORDS, GAPS) + """
, g as (select *, 'h' || (source_id // 3) as source_hash from gaps),
l as (select source_id * 1000000000 + gap_idx as label_id, case when source_id & (source_id - 1) = 0 and gap_idx % 4 = 3 then null else source_hash end as source_hash, case when gap_idx % 4 = 1 then gap_idx + 100000 else gap_idx end as gap_idx, start_ms + 5 as start_ms, end_ms + 15 as end_ms, 'c' || (gap_idx % 6) as label from g where gap_idx % 7 = 0),
m as (select g.source_id, g.gap_idx, 1 as tier, label_id, label from g join l on l.source_hash = g.source_hash and l.gap_idx = g.gap_idx union all
 select g.source_id, g.gap_idx, 2, label_id, label from g join l on l.source_hash = g.source_hash and least(g.end_ms, l.end_ms) > greatest(g.start_ms, l.start_ms) and (2 * (least(g.end_ms, l.end_ms) - greatest(g.start_ms, l.start_ms)) >= greatest(least(g.end_ms - g.start_ms, l.end_ms - l.start_ms), 1) or (abs(g.start_ms - l.start_ms) < 100 and abs(g.end_ms - l.end_ms) < 100)) union all
 select g.source_id, g.gap_idx, 3, label_id, label from g join (select * from l where source_hash is null) l on l.gap_idx = g.gap_idx union all
 select g.source_id, g.gap_idx, 4, label_id, label from g join (select * from l where source_hash is null) l on least(g.end_ms, l.end_ms) > greatest(g.start_ms, l.start_ms) and (2 * (least(g.end_ms, l.end_ms) - greatest(g.start_ms, l.start_ms)) >= greatest(least(g.end_ms - g.start_ms, l.end_ms - l.start_ms), 1) or (abs(g.start_ms - l.start_ms) < 100 and abs(g.end_ms - l.end_ms) < 100))),
b as (select *, row_number() over (partition by source_id, gap_idx order by tier, label_id) as k from m)
select g.source_id, g.gap_idx, b.tier, b.label from g left join b on b.source_id = g.source_id and b.gap_idx = g.gap_idx and k = 1""")
def o36_label_match(spark, sf_dir):
    source, i = F.col("source_id"), F.col("gap_idx")
    g = gaps(spark, sf_dir).withColumn("source_hash", F.concat(F.lit("h"), F.floor(source / 3).cast("string")))
    # every source has labels, one for each seventh gap; those of sources 0, 1, 2, 4, 8, ... stand partly without a hash
    named = F.when((source.bitwiseAND(source - 1) == 0) & (i % 4 == 3), None).otherwise(F.col("source_hash")).alias("source_hash")
    labels = g.filter("gap_idx % 7 = 0").select((source * 1_000_000_000 + i).alias("label_id"), named, F.when(i % 4 == 1, i + 100000).otherwise(i).alias("gap_idx"), (F.col("start_ms") + 5).alias("start_ms"), (F.col("end_ms") + 15).alias("end_ms"), F.concat(F.lit("c"), i % 6).alias("label"))
    return G.label_match(g, labels).select("source_id", "gap_idx", "tier", "label")


@query(with_(WORDS, GAPS) + """
, c as (select source_id, min(start_ms) as cs, max(end_ms) as ce from words group by 1)
select g.source_id, g.gap_idx, round((select count(*) from words w where w.source_id = g.source_id and w.end_ms > g.start_ms - 2000 and w.start_ms < g.start_ms) / greatest(0.1, (least(g.start_ms, ce) - greatest(g.start_ms - 2000, cs)) / 1000.0), 6) as pre_rate,
 round((select count(*) from words w where w.source_id = g.source_id and w.end_ms > g.end_ms and w.start_ms < g.end_ms + 2000) / greatest(0.1, (least(g.end_ms + 2000, ce) - greatest(g.end_ms, cs)) / 1000.0), 6) as post_rate, round((g.start_ms - cs) * 1.0 / greatest(100, ce - cs), 6) as rel_pos from gaps g join c using (source_id)""")
def o67_speech_rates(spark, sf_dir):
    w = X.words(spark, sf_dir)
    clips = w.groupBy("source_id").agg(F.min("start_ms").alias("clip_start"), F.max("end_ms").alias("clip_end"))
    out = G.speech_rates(G.word_gaps(w), w, clips)
    return out.select("source_id", "gap_idx", *(F.round(c, 6).alias(c) for c in ("pre_rate", "post_rate", "rel_pos")))


SAMPLES = "samples as (select source_id, t_ms, ((t_ms * 37 + source_id * 101) % 2001 - 1000) / 1000.0 * (case when (t_ms // 500) % 3 = 0 then 0.01 else 0.8 end) as x from (select source_id, unnest(range(0, 6000, 5)) as t_ms from (select distinct source_id from words)))"


def samples(w):
    rows = w.select("source_id").distinct().select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5995).cast("long"), F.lit(5).cast("long"))).alias("t_ms"))
    quiet = F.when(F.floor(F.col("t_ms") / 500) % 3 == 0, 0.01).otherwise(0.8)
    return rows.withColumn("x", ((F.col("t_ms") * 37 + F.col("source_id") * 101) % 2001 - 1000) / 1000.0 * quiet)


@query(with_(WORDS, GAPS, SAMPLES) + """
, x as (select *, case when sign(x) <> lag(sign(x)) over (partition by source_id order by t_ms) then 1 when lag(x) over (partition by source_id order by t_ms) is null then null else 0 end as cross_ from samples),
f as (select source_id, quantile_cont(db, 0.05) as floor_db, median(db) as speech_db from (select source_id, t_ms // 30 as f, 10 * log10(avg(x * x) + 1e-12) as db from samples group by 1, 2) group by 1),
l as (select g.source_id, g.gap_idx, 10 * log10(avg(x.x * x.x) + 1e-12) as level_db, avg(cross_) as zc, count(*) as n from gaps g join x on x.source_id = g.source_id and x.t_ms + 1 > g.start_ms and x.t_ms < g.end_ms group by 1, 2)
select source_id, gap_idx, round(level_db, 5) as level_db, round(zc, 5) as zero_crossing, n, round(level_db - floor_db, 5) as above_floor_db, round(speech_db - level_db, 5) as contrast_db from l join f using (source_id)""")
def o68_gap_levels(spark, sf_dir):
    w = X.words(spark, sf_dir)
    out = G.gap_levels(samples(w), G.word_gaps(w))
    return out.select("source_id", "gap_idx", "n", *(F.round(c, 5).alias(c) for c in ("level_db", "zero_crossing", "above_floor_db", "contrast_db")))


@query(with_(WORDS, SAMPLES) + """
, b as (select *, max(end_ms) over (partition by source_id, speaker order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from words where speaker is not null and end_ms - start_ms >= 50),
i as (select *, sum(case when reach is null or start_ms > reach + 250 then 1 else 0 end) over (partition by source_id, speaker order by start_ms, end_ms rows unbounded preceding) as k from b),
s as (select source_id, speaker, min(start_ms) as s, max(end_ms) as e from i group by source_id, speaker, k),
l as (select s.source_id, s.speaker, 10 * log10(avg(x * x) + 1e-12) as level_db from s join samples x on x.source_id = s.source_id and x.t_ms + 1 > s.s and x.t_ms < s.e group by 1, 2),
g as (select *, max(level_db) over (partition by source_id) as mx, max(level_db) over (partition by source_id) - min(level_db) over (partition by source_id) as mm from l)
select source_id, speaker, round(level_db, 5) as level_db, round(mm, 5) as mismatch_db, round(case when mm > 6 and level_db < mx then least(6.0, mx - level_db) else 0.0 end, 5) as boost_db from g""")
def o69_speaker_levels(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return G.speaker_levels(samples(w), w).select("source_id", "speaker", *(F.round(c, 5).alias(c) for c in ("level_db", "mismatch_db", "boost_db")))


@query(with_(WORDS, GAPS, SILENCES) + """
select g.source_id, g.gap_idx, exists (select 1 from silences s where s.source_id = g.source_id and s.end_ms - s.start_ms >= 500 and (g.start_ms + g.end_ms) // 2 >= s.start_ms and (g.start_ms + g.end_ms) // 2 <= s.end_ms) as removed from gaps g""")
def o74_removal_telemetry(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return G.removal_telemetry(G.word_gaps(w), X.silences(w).filter("end_ms - start_ms >= 500")).select("source_id", "gap_idx", "removed")


#: Nullable scores of candidates from integers.
_WIDE = {c: f"case when (cand_id * {7 + 3 * k} + source_id) % {3 + k % 4} = 0 then null else ((cand_id * {11 + 2 * k} + source_id * 3) % 100) / 100.0 end" for k, c in enumerate(S.COMPOSITE_COLUMNS)} | {
    "answer_complete": "case when cand_id % 3 = 0 then null else cand_id % 2 = 0 end", "story_completeness": "case when cand_id % 4 = 0 then null else cand_id % 3 = 1 end", "question_hook_used": "cand_id % 5 = 0",
    "hook_speaker": "case when cand_id % 6 = 0 then 'Host' end", "conversation_type": "case when cand_id % 8 = 0 then 'question_answer' end",
}
WIDE = "wide as (select source_id, cand_id, score, " + ", ".join(f"{v} as {k}" for k, v in _WIDE.items()) + " from candidates), wt as (select *, " + S.COMPOSITE_SQL["text"] + " as text_score from wide)"


def wide(spark, sf_dir):
    return X.candidates(X.words(spark, sf_dir)).selectExpr("source_id", "cand_id", "score", *(f"{v} as {k}" for k, v in _WIDE.items()))


@query(with_(WORDS, CANDIDATES, WIDE) + f"select source_id, cand_id, round(case when {S.COMPOSITE_SQL['confusion']} > 0.50 or {S.COMPOSITE_SQL['clarity']} < 0.40 then least({S.COMPOSITE_SQL['blend']}, 0.50) else {S.COMPOSITE_SQL['blend']} end::double, 6) as composite from wt")
def o101_composite_score(spark, sf_dir):
    kinds = {c: F.col(c).cast("double") for c in S.COMPOSITE_COLUMNS}
    return S.composite_score(wide(spark, sf_dir).withColumns(kinds)).select("source_id", "cand_id", F.round("composite", 6).alias("composite"))


@query(with_(WORDS, CANDIDATES) + """
, q as (select source_id, cand_id, least(1.0, score * 0.9 + 0.1) as v, least(1.0, score * case when length(trim(hook)) > 10 and cand_id % 2 = 0 then 1.1 else 0.95 end) as c, least(1.0, 0.7 + case when start_ms <> 0 then 0.1 else 0.0 end + 0.1) as p, score from candidates)
select source_id, cand_id, round(greatest(0.0, least(1.0, v * 0.2 + c * 0.3 + p * 0.2 + score * 0.3))::double + 1e-9, 3) as quality, round(v::double + 1e-9, 3) as visual_engagement, round(c::double + 1e-9, 3) as semantic_coherence, round(p::double + 1e-9, 3) as production_quality, true as heuristic_fallback from q""")
def o102_heuristic_quality(spark, sf_dir):
    c = X.candidates(X.words(spark, sf_dir)).withColumns({"payoff_text": F.when(F.col("cand_id") % 2 == 0, "a payoff text"), "hook_start": F.col("start_ms").cast("double"), "hook_end": F.col("end_ms").cast("double"), "hook_confidence": F.lit(0.0)})
    return S.heuristic_quality(c).select("source_id", "cand_id", "quality", "visual_engagement", "semantic_coherence", "production_quality", "heuristic_fallback")


_OPEN = "CASE " + " ".join(f"WHEN starts_with(f6, '{o}') THEN '{o}'" for o in S.CONTINUATION_OPENERS) + " END"
_LEAD = ["he", "she went", "they who", "and so", "now here is", "so yeah", "because", "um", "", "the same thing", "she, Maria"]
HOOKS = f"""
hooks as (select source_id, cand_id, trim(([{', '.join("'" + x + "'" for x in _LEAD)}])[cand_id % {len(_LEAD)} + 1] || ' ' || case when cand_id % {len(_LEAD)} = 8 then '' else hook end) as hook from candidates),
ht as (select *, list_transform(list_filter(regexp_split_to_array(hook, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), '[^\\pL\\pN]', '', 'g')) as t, list_filter(regexp_split_to_array(trim(regexp_extract(hook, '^([^.!?।]*)', 1)), '\\s+'), lambda w: w <> '') as s from hooks),
hc as (select *, array_to_string(t[1:6], ' ') as f6, regexp_replace(lower(s[1]), '[^\\pL\\pN]', '', 'g') as p from ht),
ho as (select source_id, cand_id, hook, t, {_OPEN} as continuation_opener, case when hook = '' then 'empty_hook' when p in ('he', 'she', 'they', 'him', 'her', 'them') and not exists (select 1 from (select unnest(s[2:]) as w) where regexp_matches(w, '^\\p{{Lu}}\\pL*$') or regexp_replace(lower(w), '[^\\pL\\pN]', '', 'g') in ('who', 'whom', 'whose', 'which', 'that')) then p end as unresolved_pronoun from hc)"""


def hooks(spark, sf_dir):
    c = X.candidates(X.words(spark, sf_dir))
    lead = F.element_at(F.array(*(F.lit(x) for x in _LEAD)), (F.col("cand_id") % len(_LEAD) + 1).cast("int"))
    return c.select("source_id", "cand_id", F.trim(F.concat(lead, F.lit(" "), F.when(F.col("cand_id") % len(_LEAD) == 8, "").otherwise(F.col("hook")))).alias("hook"))


@query(with_(WORDS, CANDIDATES, HOOKS) + "select source_id, cand_id, continuation_opener, unresolved_pronoun, round(case when hook = '' then 0.0 else greatest(0.0, 1.0 - case when unresolved_pronoun is not null then 0.12 else 0.0 end - case when continuation_opener is not null then 0.04 else 0.0 end) end::double, 6) as context_score from ho")
def o22_opening_context(spark, sf_dir):
    return S.opening_context(hooks(spark, sf_dir)).select("source_id", "cand_id", "continuation_opener", "unresolved_pronoun", F.round("context_score", 6).alias("context_score"))


_q = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(with_(WORDS, CANDIDATES, HOOKS) + f"""
, o as (select *, list_filter(t, lambda w: w <> '') as u, array_to_string(t[1:3], ' ') as f3 from ho),
z as (select *, coalesce(u[1], '') as a, coalesce(u[2], '') as b from o)
select source_id, cand_id, round(greatest(0.0, least(1.0, 1.0 - case when continuation_opener is not null then 0.35 else 0.0 end - case when unresolved_pronoun is not null then 0.40 else 0.0 end - case when a in ({_q(S.FILLER_OPENERS)}) then 0.20 else 0.0 end
 - case when len(list_filter([{_q(S.ANSWER_MARKERS)}], lambda m: a <> '' and (m = a or (b <> '' and length(m) > length(a) and starts_with(a || b, m))))) > 0 then 0.35 else 0.0 end - case when len(list_filter([{_q(S.SETUP_OPENERS)}], lambda m: starts_with(f3, m))) > 0 then 0.30 else 0.0 end))::double, 6) as opening_quality from z""")
def o23_opening_quality(spark, sf_dir):
    return S.opening_quality(hooks(spark, sf_dir)).select("source_id", "cand_id", "opening_quality")


@query("select l_orderkey, l_linenumber, round(case when l_quantity * 3 > 100 then 1.0 when l_quantity * 3 > 10 then least(1.0, l_quantity * 3 / 100) when l_quantity * 3 > 1 then least(1.0, l_quantity * 3 / 10) else greatest(0.0, l_quantity * 3) end::double, 6) as score, case when l_linenumber % 3 = 0 then null when l_quantity > 100 then null when l_quantity <= 1 then round(l_quantity * 100) / 100 when l_quantity <= 10 then round(l_quantity / 10 * 100) / 100 else round(l_quantity / 100 * 100) / 100 end::double as strict from lineitem")
def o24_normalize_score(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.lit("true")).otherwise(F.col("l_quantity").cast("string"))
    return li.select("l_orderkey", "l_linenumber", F.round(S.normalize_score((F.col("l_quantity") * 3).cast("double")), 6).alias("score"), S.strict_score(text).alias("strict"))


@query(with_(WORDS, CANDIDATES) + """
, c as (select source_id, cand_id, (cand_id * 7) % 100 / 100.0 as p, (cand_id * 3) % 100 / 100.0 as b, (cand_id * 13) % 100 / 100.0 as m, case when cand_id % 3 = 0 then null else cand_id % 7 <> 1 end as a, case cand_id % 5 when 0 then 'breath_pause' when 1 then 'sentence_complete' when 2 then 'thought_complete' end as st, case when cand_id % 2 = 0 then null else (cand_id * 17) % 100 / 100.0 end as cc from candidates)
select source_id, cand_id, p > 0.70 or b > 0.65 or m > 0.65 or coalesce(not a, false) or coalesce(st = 'breath_pause', false) or coalesce(st in ('sentence_complete', 'thought_complete') and coalesce(cc < 0.8, true), false) as must_extend from c""")
def o27_closure_required(spark, sf_dir):
    i = F.col("cand_id")
    rows = X.candidates(X.words(spark, sf_dir)).select(
        "source_id", "cand_id", ((i * 7) % 100 / 100.0).alias("continuation_probability"), ((i * 3) % 100 / 100.0).alias("breath_pause_risk"), ((i * 13) % 100 / 100.0).alias("mid_thought_risk"), F.when(i % 3 == 0, None).otherwise(i % 7 != 1).alias("answer_complete"),
        F.lit(None).cast("boolean").alias("story_completeness"), F.lit(None).cast("boolean").alias("payoff_completion"), F.when(i % 5 == 0, "breath_pause").when(i % 5 == 1, "sentence_complete").when(i % 5 == 2, "thought_complete").alias("endpoint_state"), F.when(i % 2 == 0, None).otherwise((i * 17) % 100 / 100.0).alias("closure_confidence"),
    )
    return S.closure_required(rows).select("source_id", "cand_id", "must_extend")


@query(with_(INTERVALS) + """
, c as (select source_id, event_id as cand_id, start_ms, end_ms from intervals where cls = 'view'), e as (select source_id, case cls when 'purchase' then 'Laughter' when 'signup' then 'Applause' else cls end as t, (event_id * 7) % 100 / 100.0 as f, start_ms, end_ms from intervals where cls <> 'view'),
p as (select c.source_id, c.cand_id, count(*) as n, least(0.15, round(sum(case t when 'Laughter' then 0.05 when 'Applause' then 0.03 else 0.01 end * f), 9)) as b from c join e on c.source_id = e.source_id and c.end_ms > e.start_ms and c.start_ms < e.end_ms group by 1, 2)
select c.source_id, c.cand_id, coalesce(n, 0) as n_events, round(coalesce(b, 0.0)::double, 6) as boost from c left join p using (source_id, cand_id)""")
def o39_events_for_candidates(spark, sf_dir):
    i = X.intervals(spark, sf_dir)
    kind = F.when(F.col("cls") == "purchase", "Laughter").when(F.col("cls") == "signup", "Applause").otherwise(F.col("cls"))
    events = i.filter("cls <> 'view'").select("source_id", kind.alias("event_type"), ((F.col("event_id") * 7) % 100 / 100.0).alias("confidence"), "start_ms", "end_ms")
    out = S.events_for_candidates(i.filter("cls = 'view'").withColumnRenamed("event_id", "cand_id"), events)
    return out.select("source_id", "cand_id", "n_events", F.round("boost", 6).alias("boost"))


@query(with_(WORDS, CANDIDATES) + """
select c.source_id, c.cand_id, substr(string_agg(w.text, ' ' order by w.start_ms, w.word_idx), 1, 80) as excerpt, count(*) as n_words from candidates c join words w on w.source_id = c.source_id and w.end_ms > c.start_ms and w.start_ms < c.end_ms group by 1, 2""")
def o82_excerpt(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return S.excerpt(X.candidates(w), w, 80).select("source_id", "cand_id", "excerpt", "n_words")


@query(with_(WORDS, CANDIDATES) + r"""
, t as (select source_id, cand_id, start_ms, list_filter(list_transform(regexp_split_to_array(hook, '\s+'), lambda x: regexp_replace(lower(x), '[^\pL\pN]', '', 'g')), lambda x: x <> '') as t from candidates),
p as (select *, t[1:6] as p from t where len(t) > 0),
n as (select source_id, word_idx, start_ms, list(w) over (partition by source_id order by word_idx rows between current row and 5 following) as g from (select *, regexp_replace(lower(text), '[^\pL\pN]', '', 'g') as w from words)),
a as (select p.source_id, p.cand_id, n.word_idx as anchor, round(list_sum(list_transform(range(1, least(len(p.p), len(n.g)) + 1), lambda i: case when n.g[i] = p.p[i] then 1.0 when n.g[i] <> '' and (contains(n.g[i], p.p[i]) or contains(p.p[i], n.g[i])) then 0.8 else 0.0 end)) / len(p.p), 6) as m
 from p join n on n.source_id = p.source_id and n.start_ms >= p.start_ms - 12000 and n.start_ms <= p.start_ms + 25000),
r as (select *, row_number() over (partition by source_id, cand_id order by m desc, anchor) as q from a where m > 0)
select source_id, cand_id, r.anchor as first_idx, least(r.anchor + len(t) - 1, (select max(word_idx) from words w where w.source_id = t.source_id)) as last_idx, m as match from t join r using (source_id, cand_id) where q = 1 and m >= 0.5""")
def o38_align_phrase(spark, sf_dir):
    w = X.words(spark, sf_dir)
    phrases = X.candidates(w).select("source_id", "cand_id", "start_ms", "end_ms", F.col("hook").alias("text"))
    return S.align_phrase(phrases, w, fallback=False)


@query(with_(WORDS) + """
select source_id, sha256(string_agg(word_idx || '|' || text || '|' || start_ms || '|' || end_ms || '|' || coalesce(speaker, ''), chr(10) order by word_idx)) as fingerprint, max(end_ms) || '_' || count(*) || '_' || arg_min(text, word_idx) || '_' || arg_max(text, word_idx) as identity from words group by 1""")
def o13_words_fingerprint(spark, sf_dir):
    return S.words_fingerprint(X.words(spark, sf_dir))


