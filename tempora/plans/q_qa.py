"""Queries: checks, metrics, formats, URLs, subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import qa as Q
from ..sources import fixtures as X
from ..sources import readers as R
from .registry import query
from .sql import INTERVALS, with_


@query("""
with p as (select l.quality as truth, (d.n_chars >= 500)::int as predicted, least(d.n_chars, 1000) / 1000.0 as p from labels l join documents d using (doc_id)),
s as (select p, count(*) filter (truth = 1) as pos, count(*) filter (truth = 0) as neg from p group by 1), r as (select *, sum(pos) over (order by p desc rows unbounded preceding) as tp, sum(neg) over (order by p desc rows unbounded preceding) as fp from s),
a as (select sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)) as auc, sum(pos * tp * 1.0 / (tp + fp)) / sum(pos) as pr from r)
select count(*) as n, round(avg((truth <> predicted)::int), 6) as error, round(avg(-case when truth = 1 then ln(greatest(1e-15, least(1 - 1e-15, p))) else ln(1 - greatest(1e-15, least(1 - 1e-15, p))) end), 6) as logloss,
 round(count(*) filter (p >= 0.65 and truth = 1) * 1.0 / count(*) filter (p >= 0.65), 6) as "precision", round(count(*) filter (p >= 0.65 and truth = 1) * 1.0 / count(*) filter (truth = 1), 6) as recall, round(any_value(auc)::double, 6) as auc, round(any_value(pr)::double, 6) as pr_auc from p, a""")
def o75_classification_metrics(spark, sf_dir):
    p = X.table(spark, sf_dir, "labels").join(X.table(spark, sf_dir, "documents"), "doc_id")
    p = p.select(F.col("quality").alias("truth"), (F.col("n_chars") >= 500).cast("int").alias("predicted"), (F.least("n_chars", F.lit(1000)) / 1000.0).alias("p"))
    return Q.classification_metrics(p).select("n", *(F.round(c, 6).alias(c) for c in ("error", "logloss", "precision", "recall", "auc", "pr_auc")))


@query("""
select l_orderkey * 8 + l_linenumber as candidate_id, bool_or(l_returnflag = 'A' and l_linestatus = 'O') as critical, count(*) filter (l_returnflag not in ('A', 'R')) as n_pass, count(*) filter (l_returnflag = 'R') as n_warning, count(*) filter (l_returnflag = 'A') as n_fail,
 case max(case l_returnflag when 'A' then 2 when 'R' then 1 else 0 end) when 2 then 'Fail' when 1 then 'Warning' else 'Pass' end as overall from lineitem group by 1""")
def o77_qa_rollup(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "Fail").when(F.col("l_returnflag") == "R", "Warning").otherwise("Pass")
    checks = X.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("candidate_id"), status.alias("status"), F.when(F.col("l_linestatus") == "O", "Critical").otherwise("Minor").alias("severity"))
    return Q.qa_rollup(checks)


@query("""
with p as (select l_orderkey * 8 + l_linenumber as candidate_id, l_quantity * 3 as fps, l_discount * 10 as du, l_tax as drift, -l_quantity as lufs, l_discount * 8 as sil, l_tax as black from lineitem),
r as (select candidate_id, unnest(['fps', 'duration', 'av_drift', 'loudness', 'silence', 'black']) as name, unnest([case when fps < 1 or fps > 120 then 'Fail' else 'Pass' end, case when du > 0.5 then 'Fail' else 'Pass' end, case when drift > 0.1 then 'Fail' when drift > 0.05 then 'Warning' else 'Pass' end,
 case when abs(lufs + 14) > 4 then 'Fail' when abs(lufs + 14) > 2 then 'Warning' else 'Pass' end, case when sil > 0.5 then 'Fail' else 'Pass' end, case when black > 0.05 then 'Fail' else 'Pass' end]) as status from p)
select name, status, count(*) as n from r group by 1, 2""")
def o78_render_qa_rules(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    probes = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("candidate_id"), (d("l_quantity") * 3).alias("fps"), (d("l_discount") * 10).alias("duration_s"), F.lit(0.0).alias("expected_s"), d("l_tax").alias("drift_s"), (-d("l_quantity")).alias("lufs"), (d("l_discount") * 8).alias("silent_share"), d("l_tax").alias("black_share"),
    )
    return Q.render_qa_rules(probes).groupBy("name", "status").agg(F.count("*").alias("n"))


def caption_events(spark, sf_dir):
    w = X.words(spark, sf_dir)
    cues = I.cues(w).select(F.col("source_id").alias("clip_id"), (F.col("start_ms") - (F.col("cue_idx") % 5) * 60).alias("start_ms"), "end_ms", (F.col("cue_idx") % 3).alias("style"), F.lit(0).alias("layer"), F.when(F.col("cue_idx") % 11 == 0, "").otherwise(F.col("text")).alias("text"))
    return cues, w.select(F.col("source_id").alias("clip_id"), "text")


@query()
def o79_caption_event_qa(spark, sf_dir):
    bad, missing = Q.caption_event_qa(*caption_events(spark, sf_dir))
    return bad.groupBy("clip_id", "problem").agg(F.count("*").alias("n")).unionByName(missing.groupBy("clip_id").agg(F.count("*").alias("n")).withColumn("problem", F.lit("missing")))


@query(with_(INTERVALS) + """
, b as (select source_id as clip_id, event_id as id, start_ms, end_ms, (event_id * 37) % 800 / 1.0 as x, (event_id * 53) % 400 / 1.0 as y from intervals)
select a.clip_id, a.id as a, c.id as b from b a join b c on a.clip_id = c.clip_id and a.id < c.id where least(a.end_ms, c.end_ms) - greatest(a.start_ms, c.start_ms) > 20 and least(a.x, c.x) + 120 - greatest(a.x, c.x) > 2 and least(a.y, c.y) + 60 - greatest(a.y, c.y) > 2""")
def o79_box_collisions(spark, sf_dir):
    i = F.col("event_id")
    boxes = X.intervals(spark, sf_dir).select(F.col("source_id").alias("clip_id"), i.alias("id"), "start_ms", "end_ms", ((i * 37) % 800 / 1.0).alias("x"), ((i * 53) % 400 / 1.0).alias("y"), F.lit(120.0).alias("w"), F.lit(60.0).alias("h"))
    return Q.box_collisions(boxes)


@query("""
with r as (select o_orderkey as candidate_id, case when o_orderkey % 5 = 0 then null else o_orderkey % 2 = 0 end as cap, case when o_orderkey % 7 = 0 then null else o_orderkey % 3 = 0 end as pace, o_orderpriority || case when o_orderkey % 4 = 0 then ' [captions] burned' else '' end || case when o_orderkey % 3 = 0 then ' [pacing] ok' else '' end as log from orders),
f as (select candidate_id, unnest(['captions', 'pacing']) as feature, unnest([cap, pace]) as flag, unnest([contains(log, '[captions]'), contains(log, '[pacing]')]) as found from r)
select candidate_id, feature, case when flag is null then 'skipped' when flag = found then 'ok' when flag then 'claimed, not found' else 'found, not claimed' end as verdict from f""")
def o80_feature_truth_audit(spark, sf_dir):
    k = F.col("o_orderkey")
    log = F.concat("o_orderpriority", F.when(k % 4 == 0, " [captions] burned").otherwise(""), F.when(k % 3 == 0, " [pacing] ok").otherwise(""))
    flags = F.create_map(F.lit("captions"), F.when(k % 5 != 0, k % 2 == 0), F.lit("pacing"), F.when(k % 7 != 0, k % 3 == 0))
    return Q.feature_truth_audit(X.table(spark, sf_dir, "orders").select(k.alias("candidate_id"), flags.alias("flags"), log.alias("log")), {"captions": "[captions]", "pacing": "[pacing]"})


@query("""
with f as (select p_brand as source, p_partkey as format_id, p_size * 36 as height, (60 - p_size) * 64 as width, p_retailprice as tbr from part), r as (select *, row_number() over (partition by source order by height * width desc, height desc, tbr desc, format_id desc) as k, max(height) over (partition by source) as top from f)
select source, format_id, height, width, top > height as higher_available from r where k = 1""")
def o81_best_format(spark, sf_dir):
    f = X.table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("format_id"), (F.col("p_size") * 36).alias("height"), ((60 - F.col("p_size")) * 64).alias("width"), F.col("p_retailprice").alias("tbr"))
    return Q.best_format(f)


@query("""
with f as (select p_brand as source, p_partkey as position, p_partkey as format_id, case when p_size % 6 > 0 then 'l' || p_size % 6 end as language, p_partkey % 5 = 0 as original, p_size % 3 = 0 as dubbed, case when p_partkey % 7 > 0 then p_retailprice end as tbr from part),
t as (select source, language, arg_max(format_id, (coalesce(tbr, 0), -position)) as format_id, min(position) as position, arg_min(original, position) as original, arg_min(dubbed, position) as dubbed from f group by source, language, case when language is null then original end),
h as (select source, arg_min(position, (dubbed, position)) as heir, bool_or(original) as has from t group by 1)
select t.source, language, format_id, original or (not has and position = heir) as original from t join h using (source)""")
def o81_audio_tracks(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    f = X.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), k.alias("position"), k.alias("format_id"), F.when(size % 6 > 0, F.concat(F.lit("l"), size % 6)).alias("language"),
        (k % 5 == 0).alias("original"), (size % 3 == 0).alias("dubbed"), F.when(k % 7 > 0, F.col("p_retailprice")).alias("tbr"),
    )
    return Q.audio_tracks(f)


@query("""
with m as (select source_id, avg(value) as v, count(*) as n from (select user_id as source_id, value from events) group by 1), x as (select source_id, -30 + round(v / 20, 3) as i, (source_id % 10) / 10.0 as sil, -45 + (source_id % 13) * 1.0 as fl, (source_id % 17) * 1.0 as mm, (source_id % 5) * 1.0 as lg, -2 + (source_id % 4) * 0.5 as tp from m),
a as (select source_id, case when sil > 0.80 or i < -50 then [{'action': 'none', 'value': 0.0::double}] else list_filter([case when lg >= 2 then {'action': 'high_pass', 'value': 80.0::double} end, case when fl > -38 then {'action': 'denoise', 'value': 12.0::double} end, case when mm > 6 then {'action': 'balance', 'value': least(6.0, mm / 2)::double} end,
 case when abs(i + 14) > 1 then {'action': 'loudness', 'value': round(-14 - i, 6)::double} end, case when abs(i + 14) <= 1 and tp > -1 then {'action': 'peak_safety', 'value': round(-1 - tp, 6)::double} end], lambda s: s is not null) end as s from x)
select source_id, t.action, t.value from (select source_id, unnest(s) as t from a)""")
def o70_loudness_decision(spark, sf_dir):
    m = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.avg("value").alias("v"))
    s = F.col("source_id")
    measures = m.select("source_id", (-30 + F.round(F.col("v") / 20, 3)).alias("integrated"), ((s % 10) / 10.0).alias("silence"), (-45 + (s % 13) * 1.0).alias("floor_db"), ((s % 17) * 1.0).alias("mismatch_db"), ((s % 5) * 1.0).alias("low_gain_db"), (-2 + (s % 4) * 0.5).alias("true_peak"))
    return Q.loudness_decision(measures)


@query(r"""select page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') as id from pages""")
def o25_canonical_source_url(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", R.canonical_source_url(F.col("url")).alias("id"))


@query(r"""select page_id, case when page_id % 6 = 5 then regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') else 'video:' || substr(md5(url), 1, 11) end as id from pages""")
def o25_video_addresses(spark, sf_dir):
    """Five shapes of a video's address, made from each page's own, and every sixth page as it is."""
    video = F.substring(F.md5("url"), 1, 11)
    shapes = [("https://www.youtube.com/watch?list=a&v=", "&t=3"), ("https://youtu.be/", "?t=3"), ("https://youtube.com/shorts/", "/"), ("https://www.youtube.com/live/", "#x"), ("https://www.youtube.com/embed/", "")]
    url = F.get(F.array(*(F.concat(F.lit(a), video, F.lit(z)) for a, z in shapes), F.col("url")), (F.col("page_id") % 6).cast("int"))
    return X.table(spark, sf_dir, "pages").select("page_id", R.canonical_source_url(url).alias("id"))


@query()
def o05_write_srt(spark, sf_dir):
    return R.srt_texts(I.cues(X.words(spark, sf_dir)))


@query()
def o04_read_srt(spark, sf_dir):
    """A round trip: cues written as subtitle texts and parsed again."""
    return R.parse_srt(R.srt_texts(I.cues(X.words(spark, sf_dir))))
