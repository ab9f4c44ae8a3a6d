"""The derived tables of ``sources.fixtures`` as SQL common table expressions, for the oracles."""

WORDS = r"""
tok as (select conv_id as source_id, turn, role as speaker, unnest(regexp_split_to_array(text, '\s+')) as text,
               generate_subscripts(regexp_split_to_array(text, '\s+'), 1) as pos from conversations),
tn as (select source_id, speaker, text, cast(row_number() over (partition by source_id order by turn, pos) - 1 as bigint) as word_idx from tok where text <> ''),
tq as (select *, (word_idx * 37 + source_id * 11) % 41 as r from tn),
td as (select *, 60 * length(text) + 80 as dur, (r * r * r) // 50 as gap from tq),
words as (select source_id, word_idx, text, speaker,
  cast(sum(gap + dur) over (partition by source_id order by word_idx rows unbounded preceding) - dur as bigint) as start_ms,
  cast(sum(gap + dur) over (partition by source_id order by word_idx rows unbounded preceding) as bigint) as end_ms from td)"""

INTERVALS = """
intervals as (select event_id, user_id as source_id, event_type as cls, value, epoch_us(ts) // 1000 - 1704067200000 as start_ms,
  epoch_us(ts) // 1000 - 1704067200000 + cast(round(value * 100) as bigint) * 6000 as end_ms from events)"""

SCORES = """
window_scores as (select user_id as source_id, row_number() over (partition by user_id order by ts, event_id) - 1 as window_idx, event_type as provider,
  round(value / 500.0, 4) as raw_score, (row_number() over (partition by user_id order by ts, event_id) - 1) * 60000 as window_start,
  (row_number() over (partition by user_id order by ts, event_id) - 1) * 60000 + 75000 as window_end from events)"""

CANDIDATES = """
cand0 as (select source_id, word_idx as first, word_idx // 8 as cand_id from words where word_idx % 8 = 0),
candidates as (select c.source_id, c.cand_id, min(w.start_ms) as start_ms, max(w.end_ms) as end_ms,
  string_agg(w.text, ' ' order by w.word_idx) filter (w.word_idx < c.first + 10) as hook,
  ((c.cand_id * 29 + c.source_id * 7) % 100) / 100.0 as score, case when c.cand_id % 7 = 0 then 'fallback' else 'llm' end as score_source
  from cand0 c join words w on w.source_id = c.source_id and w.word_idx between c.first and c.first + 19 group by c.source_id, c.cand_id)"""

SILENCES = """
silences as (select source_id, end_ms + 20 as start_ms, nxt - 20 as end_ms from
  (select *, lead(start_ms) over (partition by source_id order by start_ms, word_idx) as nxt from words) where nxt - end_ms >= 100)"""

DETECTIONS = """
detections as (select source_id, cast(floor(start_ms / 86400000.0) as bigint) as shot_idx, cast(coalesce(list_position(['click', 'purchase', 'signup', 'view'], cls), 0) - 1 as integer) as track_id,
  start_ms as t_ms, event_id, value * 3.84 as cx, (event_id * 7) % 100 / 100.0 as conf, (event_id * 13) % 100 / 100.0 as motion from intervals)"""


def with_(*ctes: str) -> str:
    return "with recursive " + ",".join(ctes) + "\n"
