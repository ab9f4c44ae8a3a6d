"""Queries: ranking, suppression, selection, relational work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import written
from ..operators import rank as R
from ..sources import fixtures as X
from .registry import query
from .sql import CANDIDATES, WORDS, with_

RANKED = "ranked as (select *, row_number() over (partition by source_id order by score_source = 'llm' desc, score desc, start_ms, end_ms, cand_id) as rank from candidates)"


def candidates(spark, sf_dir):
    return X.candidates(X.words(spark, sf_dir))


@query(with_(WORDS, CANDIDATES, RANKED) + "select source_id, cand_id, rank from ranked")
def o103_rank_candidates(spark, sf_dir):
    return R.rank_candidates(candidates(spark, sf_dir)).select("source_id", "cand_id", "rank")


@query(with_(WORDS, CANDIDATES, RANKED) + """
, g as (select source_id, 1 as rank, [{'s': start_ms, 'e': end_ms, 'h': hook, 'c': cand_id}] as kept from ranked where rank = 1 union all
 select source_id, rank, case when hit then kept else list_append(kept, x) end from (
  select g.source_id, r.rank, g.kept, {'s': r.start_ms, 'e': r.end_ms, 'h': r.hook, 'c': r.cand_id} as x,
   len(list_filter(g.kept, lambda k: (abs(k.s - r.start_ms) < 5000 and abs(k.e - r.end_ms) < 6000) or (greatest(least(k.e, r.end_ms) - greatest(k.s, r.start_ms), 0) * 1.0 / greatest(least(k.e - k.s, r.end_ms - r.start_ms), 1000) > 0.65 and k.h = r.hook))) > 0 as hit
  from g join ranked r on r.source_id = g.source_id and r.rank = g.rank + 1))
select source_id, unnest(kept).c as cand_id from (select source_id, arg_max(kept, rank) as kept from g group by 1)""")
def o104_dedup_greedy(spark, sf_dir):
    return R.dedup_greedy(candidates(spark, sf_dir)).select("source_id", "cand_id")


PAIRS = "pairs as (select a.source_id, a.cand_id as a_id, b.cand_id as b_id, a.score as sa, b.score as sb from candidates a join candidates b on a.source_id = b.source_id and a.cand_id < b.cand_id and least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 2000)"
TFIDF = """
cw as (select c.source_id, c.cand_id, w.word_idx, lower(w.text) as t, lead(lower(w.text)) over (partition by c.source_id, c.cand_id order by w.start_ms, w.word_idx) as nx from candidates c join words w on w.source_id = c.source_id and w.end_ms > c.start_ms and w.start_ms < c.end_ms),
ct as (select source_id, cand_id, term, count(*) as n from (select source_id, cand_id, t as term from cw union all select source_id, cand_id, t || ' ' || nx from cw where nx is not null) group by 1, 2, 3),
cr as (select *, n * 1.0 / sum(n) over (partition by source_id, cand_id) * (ln((select count(*) from candidates c where c.source_id = ct.source_id) * 1.0 / count(*) over (partition by source_id, term)) + 1) as raw from ct),
tfidf as (select source_id, cand_id, term, raw / sqrt(sum(raw * raw) over (partition by source_id, cand_id)) as weight from cr)"""


@query(with_(WORDS, CANDIDATES, TFIDF) + "select source_id, cand_id, term, round(weight, 6) as weight from tfidf")
def o71_tfidf(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return R.tfidf(X.candidates(w), w).withColumn("weight", F.round("weight", 6))


COSINE = "cosine as (select p.*, round(sum(x.weight * y.weight), 6) as similarity from pairs p join tfidf x on x.source_id = p.source_id and x.cand_id = p.a_id join tfidf y on y.source_id = p.source_id and y.cand_id = p.b_id and y.term = x.term group by all)"


@query(with_(WORDS, CANDIDATES, PAIRS, TFIDF, COSINE) + "select source_id, a_id, b_id, similarity from cosine")
def o72_cosine_pairs(spark, sf_dir):
    w = X.words(spark, sf_dir)
    c = X.candidates(w)
    return R.cosine_pairs(written(R.term_vectors(R.tfidf(c, w)), "vectors"), R.overlapping_pairs(c)).withColumn("similarity", F.round("similarity", 6))


@query(with_(WORDS, CANDIDATES, PAIRS, TFIDF, COSINE) + """
, gone as (select distinct source_id, case when sa >= sb then b_id else a_id end as cand_id from cosine where similarity >= 0.5)
select source_id, cand_id from candidates c where not exists (select 1 from gone g where g.source_id = c.source_id and g.cand_id = c.cand_id)""")
def o105_redundancy_filter(spark, sf_dir):
    w = X.words(spark, sf_dir)
    return R.redundancy_filter(X.candidates(w), w, 0.5)[0].select("source_id", "cand_id")


@query(with_(WORDS, CANDIDATES, RANKED) + """
, d as (select source_id, max(end_ms) * 20 as d from words group by 1),
b as (select r.*, d, greatest(3, least(cast(round(d / 1000.0 / 540.0) as integer), 5)) as bins, count(*) over (partition by r.source_id) as cnt from ranked r join d using (source_id)),
k as (select *, least(floor(start_ms / (d * 1.0 / bins)), bins - 1) as bin, d / 1000.0 > 600 and cnt > 5 as many from b),
t as (select *, row_number() over (partition by source_id, bin order by rank) = 1 as top from k),
u as (select *, sum(top::int) over (partition by source_id) as nt, row_number() over (partition by source_id, top order by rank) as rest from t)
select source_id, cand_id, row_number() over (partition by source_id order by case when not many or top or rest <= 5 - nt then 0 else 1 end, rank) as position from u""")
def o106_balanced_top_n(spark, sf_dir):
    w = X.words(spark, sf_dir)
    d = w.groupBy("source_id").agg((F.max("end_ms") * 20).alias("duration_ms"))
    return R.balanced_top_n(X.candidates(w), d, 5).select("source_id", "cand_id", "position")


@query(with_(WORDS, CANDIDATES, RANKED) + """
select source_id, cand_id, rank, score_source = 'llm' and score >= 0.6 as eligible, score_source = 'llm' and score >= 0.6 and sum((score_source = 'llm' and score >= 0.6)::int) over (partition by source_id order by rank rows unbounded preceding) <= 4 as selected from ranked""")
def o107_select_top_n(spark, sf_dir):
    return R.select_top_n(candidates(spark, sf_dir), 0.6, 4).select("source_id", "cand_id", "rank", "eligible", "selected")


@query(with_(WORDS, CANDIDATES, RANKED) + """
select source_id, cand_id, rank, count(*) over (partition by source_id) >= 9 and rank between 3 and 9 as selected from ranked""")
def o107_select_rank_range(spark, sf_dir):
    return R.select_rank_range(R.rank_candidates(candidates(spark, sf_dir)), 3, 9).select("source_id", "cand_id", "rank", "selected")


@query("select * exclude (r) from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def o110_latest_per_key(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return R.latest_per_key(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(with_(WORDS, CANDIDATES) + "select source_id, cand_id from candidates where score >= 0.5 union select source_id, cand_id from candidates where cand_id % 3 = 0")
def o111_union_distinct(spark, sf_dir):
    c = candidates(spark, sf_dir).select("source_id", "cand_id", "score")
    return c.filter("score >= 0.5").unionByName(c.filter("cand_id % 3 = 0")).drop("score").distinct()


@query(with_(WORDS, CANDIDATES) + """
, g as (select *, cand_id % 5 = source_id % 5 as unresolved from candidates), a as (select *, bool_or(not unresolved) over (partition by source_id) as any1 from g),
b as (select * from a where not unresolved or not any1), c as (select *, bool_or(score >= 0.97) over (partition by source_id) as any2 from b)
select source_id, cand_id from c where score >= 0.97 or not any2""")
def o28_quality_gates(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("unresolved", F.col("cand_id") % 5 == F.col("source_id") % 5).withColumn("composite", F.col("score"))
    return R.quality_gates(c, 0.97).select("source_id", "cand_id")


@query("select c_custkey, count(distinct o_orderkey) as n_orders, count(*) as n_clips, round(sum(l_extendedprice), 2) as price from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1")
def o29_equi_joins(spark, sf_dir):
    t = lambda n: X.table(spark, sf_dir, n)
    joined = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("c_custkey").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.count("*").alias("n_clips"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(with_(WORDS, CANDIDATES) + """
, r as (select source_id, cand_id, max(score) as s, count(*) as n from (select source_id, cand_id, score from candidates where cand_id % 4 <> 1 union all select source_id, cand_id, score from candidates where cand_id % 8 = 0) group by 1, 2)
select c.source_id, c.cand_id, case when n = 1 then s end as score, case when n is null then 'missing' when n > 1 then 'ambiguous' else 'scored' end as outcome from candidates c left join r on r.source_id = c.source_id and r.cand_id = c.cand_id""")
def o37_align_scores(spark, sf_dir):
    c = candidates(spark, sf_dir)
    key = F.concat_ws(":", "source_id", "cand_id").alias("id")
    results = c.filter("cand_id % 4 <> 1").select(key, "score").unionByName(c.filter("cand_id % 8 = 0").select(key, "score"))
    return R.align_scores(c.select("source_id", "cand_id", key), results)[0].select("source_id", "cand_id", "score", "outcome")


@query("select l_orderkey, count(*) as n from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT') group by 1")
def o42_semi_anti(spark, sf_dir):
    urgent = X.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return X.table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""with b as (select o_custkey as k, o_orderkey as v, o_orderdate as d, 0 as n from orders where o_orderkey % 5 <> 0), r as (select o_custkey as k, -o_orderkey as v, o_orderdate as d, 1 as n from orders where o_orderkey % 3 = 0),
s as (select o_custkey as k from orders where o_orderkey % 50 = 0),
u as (select * from b where k not in (select k from s) union all select * from r)
select k, v from (select *, row_number() over (partition by k order by d desc, n desc, v desc) as q from u) where q = 1""")
def o07_upsert(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.struct(F.col("o_orderdate").alias("d"), (F.col("o_orderkey") % 3 == 0).alias("m")).alias("x"), F.col("o_orderdate").alias("d"))
    base = o.filter("v % 5 <> 0").select("k", "v", F.struct("d", F.lit(0).alias("n"), "v").alias("at"))
    rows = o.filter("v % 3 = 0").select("k", (-F.col("v")).alias("v"), F.struct("d", F.lit(1).alias("n"), (-F.col("v")).alias("v")).alias("at"))
    return R.upsert(base, rows, ["k"], "at", o.filter("v % 50 = 0").select("k").distinct()).select("k", "v")


@query(with_(WORDS, CANDIDATES, RANKED) + "select source_id, cand_id, rank, 'pending' as status from ranked where source_id % 2 = 0")
def o09_replace_partition(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return R.replace_partition(c, c.filter("source_id % 2 = 0"), "source_id")[1]


@query("""with gone as (select c_custkey as k from customer where c_custkey % 7 = 0), o as (select o_orderkey as k from orders where o_custkey in (select k from gone))
select 'orders' as tbl, count(*) as n from orders where o_custkey not in (select k from gone) union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select k from o)""")
def o10_cascade_delete(spark, sf_dir):
    t = lambda n: X.table(spark, sf_dir, n)
    left = R.cascade_delete(t("customer").filter("c_custkey % 7 = 0").select("c_custkey"), [(t("orders"), "o_orderkey", "o_custkey"), (t("lineitem"), "l_orderkey", "l_orderkey")])
    return left[0].agg(F.lit("orders").alias("tbl"), F.count("*").alias("n")).unionByName(left[1].agg(F.lit("lineitem").alias("tbl"), F.count("*").alias("n")))


@query(with_(WORDS, CANDIDATES) + "select source_id, cand_id, case when cand_id % 3 = 0 and cand_id % 2 = 0 then 'hit' else 'miss' end as state from candidates")
def o12_incremental_split(spark, sf_dir):
    c = candidates(spark, sf_dir)
    content = ["source_id", "cand_id", "hook"]
    results = c.filter("cand_id % 3 = 0").select(F.sha2(F.concat_ws("\0", *content), 256).alias("cache_key"), (F.col("cand_id") % 2 == 0).alias("ok"), "score")
    hits, misses = R.incremental_split(c.drop("score"), results, content)
    return hits.select("source_id", "cand_id", F.lit("hit").alias("state")).unionByName(misses.select("source_id", "cand_id", F.lit("miss").alias("state")))
