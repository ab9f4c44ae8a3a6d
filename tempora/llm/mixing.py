"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets share the corpus' words among sources by weight; a source's target stops at ``max_repeat`` times its words and
the excess goes to the others by weight. A source that must give r times its words gives every document floor(r) times
and the rest from a part of its *blocks*: documents are dealt to blocks by a seeded hash (a permutation of the source),
and whole blocks are taken in permuted order. The blocks around the quota, which hold some 32 documents on each side of it, are
filled document by document: whatever still fits is taken, then one more if that comes nearer. So a source misses its
target by half of its tail's smallest untaken document at most, however long its others are.

Output shards get exact block quotas from a splitting tree: the range of shards is halved again and again, and the left
half's blocks of each source are drawn from a multivariate hypergeometric distribution, so each shard's make-up is
that of a uniformly shuffled list of all blocks. The blocks a shard draws are disjoint runs of each source's
permuted block list; within a shard, documents are ordered by a hash. Only per-source and per-block sums, never
documents, are gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, unused, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_DOCUMENTS, SHARD_DOCUMENTS = 20_000, 1_000_000
#: Documents on each side of a source's quota that are taken one by one.
TAIL_DOCUMENTS = 32


def word_counts(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; 0 for null) and, for telling repeated ids apart, a hash of the text."""
    return documents.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0) -> DataFrame:
    """source, source_size, target: the cap-and-reshare rule in closed form.

    Sources are ordered by cap / weight; a source is capped if, with all before it capped, its share of what is left exceeds its
    cap. One row per source (a sum over documents) goes through the two ordered windows, no documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    listed = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(listed, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", F.col("left") / F.col("left_weight"))
    per = per.withColumn("capped", F.col("share") * F.col("weight") > F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("share"))))
    level = level.over(every)["share"]
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns): the splitting tree over the shards.

    Each row sums to the source's quota; each shard gets the total divided by the shards, up to one block.
    """
    out = np.zeros((len(quotas), shards), np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        want = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros(len(have), np.int64)
        rest = total
        for i, h in enumerate(have):  # one hypergeometric draw for each source, given those before it
            rest -= int(h)
            left[i] = rng.hypergeometric(int(h), rest, want) if want else 0
            want -= int(left[i])
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _fitting(sizes: np.ndarray, need: float) -> tuple[np.ndarray, float]:
    """Which sizes, in their order, still fit the need, then the smallest other one if that comes nearer; how far they are from it."""
    taken, left = np.zeros(len(sizes), np.int32), need
    for i, size in enumerate(sizes):
        if size <= left:
            taken[i] = 1
            left -= size
    over = np.flatnonzero(taken == 0)
    if len(over):
        least = over[np.argmin(sizes[over])]
        if sizes[least] - left < left:
            taken[least] = 1
            left = sizes[least] - left
    return taken, left


def fill_tail(units: pd.DataFrame) -> pd.DataFrame:
    """source, order, extra: which of a source's documents (source, order, unit, need) make up the need, in seeded order or, where that comes nearer, the longest first."""
    units = units.sort_values("order", ignore_index=True)
    sizes, need = units["unit"].to_numpy(np.int64), float(units["need"].iloc[0])
    extra, miss = _fitting(sizes, need)
    longest = np.argsort(-sizes, kind="stable")
    other, other_miss = _fitting(sizes[longest], need)
    if other_miss < miss:
        extra[longest] = other
    return pd.DataFrame({"source": units["source"], "order": units["order"], "extra": extra})


def mix_plan(
    documents: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: float = 3.0,
    blocks: int | None = None,
    shards: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, copies, taken, shards (array: one shard for each copy).

    blocks: how many blocks a source's documents are dealt to, by default one for every BLOCK_DOCUMENTS of all documents and 512 at
    least, so no block has many more than these. shards: by default one for every SHARD_DOCUMENTS, 64 at least. Documents without words weigh nothing and are taken floor(r) times. A null source is a source of its own;
    a null doc_id is dealt by its text; repeated rows are documents of their own but share a block and are taken alike.
    """
    spark = documents.sparkSession
    sizes = written(word_counts(documents), "sizes")
    n = sizes.count()
    blocks, shards = blocks or max(512, n // BLOCK_DOCUMENTS), shards or max(64, n // SHARD_DOCUMENTS)
    sizes = sizes.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(blocks)).cast("int"))
    targets = written(source_targets(sizes, weights, max_repeat), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_block = (
        sizes.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_docs"))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("full", F.floor(ratio + 1e-12)).withColumn("part", F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0)))
    )
    # a source has at most `blocks` rows here
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    per_block = per_block.withColumn("rank", F.row_number().over(permuted) - 1).withColumn("before", F.sum("block_size").over(permuted) - F.col("block_size"))
    per_block = per_block.withColumn("docs_before", F.sum("block_docs").over(permuted) - F.col("block_docs")).withColumn("want", F.col("part") - F.col("before"))
    of = Window.partitionBy("source")
    cut = (F.col("want") > 0) & (F.col("want") < F.col("block_size"))
    begins, ends = F.max(F.when(cut, F.col("docs_before"))).over(of), F.max(F.when(cut, F.col("docs_before") + F.col("block_docs"))).over(of)
    near = (F.col("docs_before") + F.col("block_docs") > begins - TAIL_DOCUMENTS) & (F.col("docs_before") < ends + TAIL_DOCUMENTS)
    per_block = per_block.withColumn("tail", F.coalesce(near, F.lit(False)))
    # the tail's need is the want of its first block
    per_block = per_block.withColumn("need", F.max(F.when(F.col("tail"), F.col("want"))).over(of)).withColumn("more", (F.col("want") > 0) | F.col("tail"))
    per_block = written(per_block, "blocks")

    # draws of blocks: `full` passes over all blocks, then the blocks that the rest may come from
    drawn = per_block.groupBy("source").agg((F.sum("full") + F.count_if("more")).cast("long").alias("draws"))
    per_source = drawn.toPandas()  # one row for each source
    per_source = per_source.sort_values("source", na_position="last", kind="stable", key=lambda s: s.map(lambda x: None if x is None else x.encode())).reset_index(drop=True)
    table = split_quotas(per_source["draws"].to_numpy(np.int64), shards, seed)
    runs = pd.DataFrame({"run_source": per_source["source"], "ends": list(np.cumsum(table, axis=1).tolist())})
    runs = spark.createDataFrame([(r.run_source, [int(x) for x in r.ends]) for r in runs.itertuples()], "run_source string, ends array<bigint>")
    # the k-th draw of a source goes to the shard whose run holds k
    shard_of = lambda k: F.size(F.filter("ends", lambda e: e <= k))
    passes = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("full")), lambda p: (p - 1) * F.col("n_blocks") + F.col("rank"))
    draws = F.concat(F.when(F.col("full") > 0, passes).otherwise(F.array().cast("array<bigint>")), F.when(F.col("more"), F.array((F.col("full") * F.col("n_blocks") + F.col("rank")).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    block_plan = (
        per_block.withColumn("n_blocks", F.count("*").over(Window.partitionBy("source")))
        .join(runs, F.col("source").eqNullSafe(F.col("run_source")))
        .select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "source_size", "target", "full", "want", "tail", "need", F.transform(draws, shard_of).alias("block_shards"))
    )
    joined = sizes.join(block_plan, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    # whole blocks need no order; a source's tail has few documents more than a block
    joined = joined.withColumn("order", F.xxhash64("doc_id", "text_hash", F.lit(seed + 2)))
    whole = joined.filter("not tail").withColumn("extra", (F.col("want") > 0).cast("int"))
    tail = joined.filter("tail")
    units = tail.groupBy("source", "order").agg(F.sum("size").alias("unit"), F.first("need").alias("need"))
    chosen = units.groupBy("source").applyInPandas(fill_tail, "source string, order long, extra int").select(F.col("source").alias("t_source"), F.col("order").alias("t_order"), "extra")
    partial = tail.join(chosen, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("order") == F.col("t_order"))).drop("t_source", "t_order")
    both = whole.unionByName(partial).withColumn("copies", (F.col("full") + F.col("extra")).cast("int"))
    return both.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.slice("block_shards", F.lit(1), F.col("copies")).alias("shards"),
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as the plan takes it, with columns shard and shard_order added.

    Within a shard rows are to be read in shard_order, a hash; the documents' own columns come first and unchanged, their
    text untouched; columns already named like the added ones are replaced. Rows that are equal in doc_id and text are taken alike.
    Null texts have no words. No documents give no rows.
    """
    documents = documents.drop("shard", "shard_order")
    names = {x: unused(x, documents) for x in ("id", "hash", "of", "copy", "to", "text_hash")}
    plan = mix_plan(documents, **options).filter("copies > 0").dropDuplicates(["doc_id", "text_hash", "source"])
    plan = plan.select(F.col("doc_id").alias(names["id"]), F.col("text_hash").alias(names["hash"]), F.col("source").alias(names["of"]), F.posexplode("shards").alias(names["copy"], names["to"]))
    keyed = documents.withColumn(names["text_hash"], F.xxhash64("text"))
    joined = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col(names["id"])) & (F.col(names["text_hash"]) == F.col(names["hash"])) & F.col("source").eqNullSafe(F.col(names["of"])))
    order = F.xxhash64(names["id"], names["hash"], names["copy"], F.lit(options.get("seed", 17) + 3))
    return joined.select(*(f"`{c}`" for c in documents.columns), F.col(names["to"]).alias("shard"), order.alias("shard_order"))
