"""Ranking, near-duplicate suppression, balanced selection, redundancy, relational listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import ordered
from ..functions.shared import SPREAD, written
from .intervals import interval_join


def rank_order() -> list[Column]:
    """Model-scored first, score descending, start, end, id."""
    return [(F.col("score_source") == "llm").desc(), F.col("score").desc(), F.col("start_ms"), F.col("end_ms"), F.col("cand_id").asc_nulls_last()]


def rank_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(*rank_order())))


def conflicts(ranked: DataFrame, overlap: float) -> DataFrame:
    """source_id, worse, better (ranks): pairs of a source that cannot both stay, once each, of rows from ``_with_near``.

    Near ones are listed already; overlapping ones of the same hook meet in an interval join of the candidates whose hook comes twice.
    """
    near = ranked.select("source_id", F.col("rank").alias("worse"), F.explode("_near").alias("better"))
    rows = ranked.filter("_same").select("source_id", "rank", "start_ms", "end_ms", "hook")
    pairs = interval_join(rows, rows, ["source_id", "hook"]).filter("r_rank < rank")
    both = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    shorter = F.greatest(F.least(F.col("end_ms") - F.col("start_ms"), F.col("r_end_ms") - F.col("r_start_ms")), F.lit(1000))
    same = pairs.filter(both / shorter > overlap).select("source_id", F.col("rank").alias("worse"), F.col("r_rank").alias("better"))
    return near.unionByName(same).distinct()


def _with_near(ranked: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """The rows with _near (better ranks with start and end closer than given) and _same (the source has the hook twice): windows over the source, as ranks are."""
    around = Window.partitionBy("source_id").orderBy("start_ms").rangeBetween(-start_ms, start_ms)
    seen = F.collect_list(F.struct("rank", "start_ms", "end_ms")).over(around)
    close = lambda x: (x["rank"] < F.col("rank")) & (F.abs(x["start_ms"] - F.col("start_ms")) < start_ms) & (F.abs(x["end_ms"] - F.col("end_ms")) < end_ms)
    listed = ranked.withColumn("_near", seen).withColumn("_near", F.transform(F.filter("_near", close), lambda x: x["rank"]))
    return listed.withColumn("_same", F.count("*").over(Window.partitionBy("source_id", "hook")) > 1)


def dedup_greedy(candidates: DataFrame, start_ms: int = 5000, end_ms: int = 6000, overlap: float = 0.65) -> DataFrame:
    """In rank order, drop a candidate near a kept one: start and end closer than given, or a larger overlap with the same hook.

    The choice is the greedy independent set of the conflict graph, found in rounds: candidates that no undecided better one conflicts with stay, and
    theirs go. A round takes all sources and parts of a source at once, so there are as many rounds as the longest chain of
    conflicts that wait for each other, not as candidates. Only edges between undecided candidates are carried on.
    """
    ranked = written(_with_near(rank_candidates(candidates), start_ms, end_ms), "ranked")
    edges, gone = written(conflicts(ranked, overlap), "conflicts"), []
    while not edges.isEmpty():
        loser = edges.select("source_id", F.col("worse").alias("better"))
        settled = edges.join(loser, ["source_id", "better"], "left_anti")
        lost = written(settled.select("source_id", F.col("worse").alias("rank")).distinct(), "lost")
        gone.append(lost)
        left = edges.join(lost.withColumnRenamed("rank", "worse"), ["source_id", "worse"], "left_anti")
        edges = written(left.join(lost.withColumnRenamed("rank", "better"), ["source_id", "better"], "left_anti"), "conflicts")
    kept = ranked if not gone else ranked.join(reduce(DataFrame.unionByName, gone), ["source_id", "rank"], "left_anti")
    return kept.select(*candidates.columns)


def balanced_top_n(candidates: DataFrame, durations: DataFrame, n: int) -> DataFrame:
    """``position``: sources over 10 min with more than n candidates get the best of each time bin first, then the best of the rest up to n
    (both in rank order), then all others; other sources keep rank order."""
    ranked = rank_candidates(candidates).join(durations.select("source_id", "duration_ms"), "source_id")
    w = Window.partitionBy("source_id")
    d = F.col("duration_ms") / 1000.0
    bins = F.greatest(F.lit(3), F.least(F.round(d / 540.0).cast("int"), F.lit(max(3, min(n, 12)))))
    binned = ranked.withColumn("_many", (d > 600) & (F.count("*").over(w) > n)).withColumn("_bin", F.least(F.floor(F.col("start_ms") / (F.col("duration_ms") / bins)), bins - 1))
    first = F.row_number().over(Window.partitionBy("source_id", "_bin").orderBy("rank")) == 1
    tops = binned.withColumn("_top", first)
    tops = tops.withColumn("_n_top", F.sum(F.col("_top").cast("int")).over(w)).withColumn("_rest", F.row_number().over(Window.partitionBy("source_id", "_top").orderBy("rank")))
    chosen = F.col("_top") | (F.col("_rest") <= n - F.col("_n_top"))
    tier = F.when(~F.col("_many") | chosen, 0).otherwise(1)
    return tops.withColumn("_tier", tier).withColumn("position", F.row_number().over(Window.partitionBy("source_id").orderBy("_tier", "rank"))).drop("_many", "_bin", "_top", "_n_top", "_rest", "_tier", "duration_ms")


def select_top_n(candidates: DataFrame, threshold: float, n: int | None) -> DataFrame:
    """rank, eligible (model-scored at or over the threshold), selected: the best min(n, eligible) eligible ones."""
    ranked = rank_candidates(candidates).withColumn("eligible", (F.col("score_source") == "llm") & (F.col("score") >= threshold))
    order = Window.partitionBy("source_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum(F.col("eligible").cast("int")).over(order)
    return ranked.withColumn("selected", F.col("eligible") & (so_far <= n if n is not None else F.lit(True)))


def select_rank_range(ranked: DataFrame, lo: int, hi: int) -> DataFrame:
    """selected for ranks lo..hi (from 1, both included); a source with fewer than hi candidates keeps none. Ranks that are no range are a ValueError."""
    if not 1 <= lo <= hi:
        raise ValueError(f"ranks {lo} to {hi} are no range")
    n = F.count("*").over(Window.partitionBy("source_id"))
    return ranked.withColumn("selected", (n >= hi) & F.col("rank").between(lo, hi))


def tfidf(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """source_id, cand_id, term, weight: single words and pairs in a candidate, tf = n / all, idf = ln(candidates / df) + 1, length one. A long table, no vectors.

    The words of candidates are dealt by source once; counts of terms, document frequencies and lengths find them in place, so terms are never shuffled.
    """
    parts = 2 * SPREAD * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = candidates.select("source_id", "cand_id", "start_ms", "end_ms", F.count("*").over(Window.partitionBy("source_id")).alias("docs"))
    inside = interval_join(words.select("source_id", "word_idx", F.lower("text").alias("text"), "start_ms", "end_ms"), counted)
    dealt = inside.select("source_id", F.col("r_cand_id").alias("cand_id"), F.col("r_docs").alias("docs"), "start_ms", "word_idx", "text").repartition(parts, "source_id")
    pairs = dealt.withColumn("next", F.lead("text").over(Window.partitionBy("source_id", "cand_id").orderBy("start_ms", "word_idx")))
    terms = pairs.select("source_id", "cand_id", "docs", F.explode(F.when(F.col("next").isNull(), F.array("text")).otherwise(F.array(F.col("text"), F.concat_ws(" ", "text", "next")))).alias("term"))
    tf = terms.groupBy("source_id", "cand_id", "term").agg(F.count("*").alias("n"), F.max("docs").alias("docs"))
    df = F.count("*").over(Window.partitionBy("source_id", "term"))
    of = Window.partitionBy("source_id", "cand_id")
    weighted = tf.withColumn("df", df).withColumn("tf", F.col("n") / F.sum("n").over(of)).withColumn("raw", F.col("tf") * (F.log(F.col("docs") / F.col("df")) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(of))
    return weighted.select("source_id", "cand_id", "term", (F.col("raw") / norm).alias("weight"))


def term_vectors(weights: DataFrame) -> DataFrame:
    """source_id, cand_id, v: the terms of a candidate in order, as their numbers in the source (``term``), with their weights (``weight``): two arrays."""
    number = F.when(F.col("term").isNotNull(), F.dense_rank().over(Window.partitionBy("source_id").orderBy("term")))
    listed = weights.withColumn("term", number).groupBy("source_id", "cand_id").agg(ordered("term", "weight").alias("v"))
    return listed.select("source_id", "cand_id", F.struct(F.col("v.term").alias("term"), F.col("v.weight").alias("weight")).alias("v"))


def dot(a: Column, b: Column) -> Column:
    """The product of two term vectors, null if they share no term: both in one sorted array, where a shared term's weights are neighbours."""
    start = F.struct(F.lit(0).alias("term"), F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("sum"))
    entries = lambda v: F.zip_with(v["term"], v["weight"], lambda t, w: F.struct(t.alias("term"), w.alias("weight")))

    def step(acc: Column, x: Column) -> Column:
        met = F.coalesce(acc["sum"], F.lit(0.0)) + acc["weight"] * x["weight"]
        return F.struct(x["term"].alias("term"), x["weight"].alias("weight"), F.when(x["term"] == acc["term"], met).otherwise(acc["sum"]).alias("sum"))

    return F.aggregate(F.sort_array(F.concat(entries(a), entries(b))), start, step, lambda acc: acc["sum"])


def cosine_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """similarity of the given pairs (source_id, a_id, b_id) that share a term, from ``term_vectors``: each pair takes its two vectors and is one row throughout."""
    a = pairs.select("source_id", "a_id", "b_id").join(vectors.select("source_id", F.col("cand_id").alias("a_id"), F.col("v").alias("va")), ["source_id", "a_id"])
    both = a.join(vectors.select("source_id", F.col("cand_id").alias("b_id"), F.col("v").alias("vb")), ["source_id", "b_id"])
    shared = F.when(F.arrays_overlap(F.col("va.term"), F.col("vb.term")), dot(F.col("va"), F.col("vb")))
    return both.select("source_id", "a_id", "b_id", shared.alias("similarity")).filter("similarity is not null")


def overlapping_pairs(candidates: DataFrame, least_ms: int = 2000) -> DataFrame:
    """Pairs of a source's candidates that overlap by more than least_ms: source_id, a_id, b_id."""
    rows = candidates.select("source_id", "cand_id", "start_ms", "end_ms")
    joined = interval_join(rows, rows).filter("cand_id < r_cand_id")
    both = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    return joined.filter(both > least_ms).select("source_id", F.col("cand_id").alias("a_id"), F.col("r_cand_id").alias("b_id"))


def redundancy_filter(candidates: DataFrame, words: DataFrame, threshold: float = 0.85, least_ms: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(kept candidates, redundant pairs). Of a similar overlapping pair the lower score goes, the later one of equals.

    A candidate that loses any pair is removed, even where it wins another.
    """
    pairs = cosine_pairs(written(term_vectors(tfidf(candidates, words)), "vectors"), overlapping_pairs(candidates, least_ms)).withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= threshold)
    score = candidates.select("source_id", "cand_id", "score")
    scored = pairs.join(score.select("source_id", F.col("cand_id").alias("a_id"), F.col("score").alias("sa")), ["source_id", "a_id"]).join(score.select("source_id", F.col("cand_id").alias("b_id"), F.col("score").alias("sb")), ["source_id", "b_id"])
    reason = F.when(F.col("similarity") >= 0.95, "near-exact duplicate").when(F.col("similarity") >= 0.90, "high content similarity").otherwise("significant content overlap")
    decided = scored.withColumn("cand_id", F.when(F.col("sa") >= F.col("sb"), F.col("b_id")).otherwise(F.col("a_id"))).withColumn("reason", reason)
    return candidates.join(decided.select("source_id", "cand_id").distinct(), ["source_id", "cand_id"], "left_anti"), decided.select("source_id", "a_id", "b_id", "similarity", "reason", F.col("cand_id").alias("removed_id"))


def quality_gates(candidates: DataFrame, min_score: float = 0.65) -> DataFrame:
    """Drop unresolved openings, then composite scores under min_score; a gate that would empty a source's pool is skipped there.

    candidates: unresolved (boolean), composite.
    """
    w = Window.partitionBy("source_id")
    first = candidates.withColumn("_ok", ~F.coalesce(F.col("unresolved"), F.lit(False)))
    kept = first.withColumn("_any", F.max("_ok").over(w)).filter(F.col("_ok") | ~F.col("_any"))
    second = kept.withColumn("_ok", F.coalesce(F.col("composite") >= min_score, F.lit(False)))
    return second.withColumn("_any", F.max("_ok").over(w)).filter(F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], newest: str, stale: DataFrame | None = None) -> DataFrame:
    """The table with the rows put in by key, newest winning (rows over the table when equal); stale keys are removed first."""
    base = table.join(stale, key, "left_anti") if stale is not None else table
    both = base.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, key, [F.col(newest).desc(), F.col("_new").desc()]).drop("_new")


def replace_partition(table: DataFrame, pool: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the table with the pool's partitions replaced, ranked; one pending clip for each candidate)."""
    ranked = rank_candidates(pool)
    kept = table.join(pool.select(key).distinct(), key, "left_anti").unionByName(ranked, allowMissingColumns=True)
    return kept, ranked.select(key, "cand_id", "rank", F.lit("pending").alias("status"))


def cascade_delete(gone: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Rows left in each table of a chain (table, own key, parent key) after parents ``gone`` (one key column) are deleted."""
    out, missing = [], gone
    for table, own, parent in chain:
        missing = missing.select(F.col(missing.columns[0]).alias(parent)).distinct()
        out.append(table.join(missing, parent, "left_anti"))
        missing = table.join(missing, parent, "left_semi").select(own)
    return out


def incremental_split(inputs: DataFrame, results: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs with a successful earlier result, inputs still to score) by the hash of their content columns (results: cache_key, ok, score)."""
    keyed = inputs.withColumn("cache_key", F.sha2(F.concat_ws("\0", *content), 256))
    good = results.filter("ok").select("cache_key", "score").dropDuplicates(["cache_key"])
    return keyed.join(good, "cache_key"), keyed.join(good, "cache_key", "left_anti")


def align_scores(inputs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs with score and outcome ``scored``, ``ambiguous`` or ``missing``; unknown result ids). A doubled id is never assigned."""
    counted = results.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    joined = inputs.join(counted.groupBy("id").agg(F.first("_n").alias("_n"), F.max("score").alias("score")), "id", "left")
    outcome = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("scored")
    aligned = joined.withColumn("outcome", outcome).withColumn("score", F.when(F.col("_n") == 1, F.col("score"))).drop("_n")
    return aligned, results.join(inputs.select("id").distinct(), "id", "left_anti").select("id").distinct()
