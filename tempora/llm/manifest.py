"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf: the SHA-256 of its columns. A tree's leaves are numbered in order, and every node carries the interval of
leaf ranks it covers, so that containment of intervals is ancestry and what a child's interval leaves of its parent's is the
sibling. Levels are taken in buckets of ``BITS``: a block, the 2 ** BITS neighbouring nodes at a bucket's foot, has all its
ancestors of that bucket under one key, so blocks are joined with their inner nodes by an equi join on (tree, block) and a test of
containment there, and no task holds more than a block. A bucket's result, one node a block, is the foot of the next: a tree
of n leaves takes log2(n) / BITS rounds. The trees' roots (one a language) are the leaves of one more tree, built alike.

Proofs go down the same way: a block's root has the path from there to the top, and its leaves put their own steps before it.
Paths are never shuffled: all three sides of that join are dealt by (tree, block).

Only built-in functions. Leaves are written once to the shared folder, and every bucket of nodes too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, shuffle_partitions, written

#: Levels of a bucket: a block has up to 2 ** BITS nodes at its foot.
BITS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:boolean,sibling:string>>"
#: The key of rows without a language, which sorts before all others; and the only tree of the trees' roots.
NONE, ONE = "-", "roots"
#: Rows of a range that are numbered by one row of their tree's numbers: a power of two.
RUN_BITS = 10


def field(value: Column) -> Column:
    """A column's share of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def is_tampered(doc_id: Column) -> Column:
    """Rows that the query tampers with: 7 divides the CRC-32 of the id's decimal form. Null ids never are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves_of(documents: DataFrame) -> DataFrame:
    """tree, doc_id, digest and the digest after tampering of every row, written. tree names the language: ``-`` for none, else = and its code."""
    rows = documents.select(*FIELDS)
    spoilt = F.when(is_tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), leaf_hash(n_chars=F.col("n_chars") + 1))
    return written(rows.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit(NONE)).alias("tree"), "doc_id", leaf_hash().alias("digest"), spoilt.alias("spoilt")), "leaves")


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with ``tree``), written, with pos (rank in the tree by ``order``, nulls first) and n (leaves of the tree).

    Rows are dealt by ranges of (tree, order), so a tree of very many leaves is spread. Its first number and its size go to its rows by one
    row for each run of 2 ** RUN_BITS neighbours.
    """
    keys = ["tree", *order]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = numbered(dealt, name, "at").withColumn("run", F.shiftright("at", RUN_BITS))
    runs = placed.groupBy("tree", "run").agg(F.count("*").alias("k"), F.min("at").alias("least"))
    trees = runs.groupBy("tree").agg(F.sum("k").alias("n"), F.min("least").alias("first"))
    known = runs.select("tree", "run").join(trees, "tree")
    return written(placed.join(known, ["tree", "run"]).withColumn("pos", F.col("at") - F.col("first")).drop("at", "run", "first"), name)


@dataclass
class Bucket:
    """One bucket of levels. foot: tree, n, pos, digest. inner: tree, block, level, lo, mid, hi, left, right. top: tree, n, pos, digest of the blocks' roots."""

    foot: DataFrame
    inner: DataFrame
    top: DataFrame


def pairs_hashed(nodes: Column) -> Column:
    """The next level: the digest of every two neighbours, of the last one alone where it has none."""
    ends = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2))
    return F.transform(ends, lambda i: F.sha2(F.concat(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit(""))), 256))


def climb(foot: DataFrame, name: str) -> Bucket:
    """The inner nodes of every block of ``foot`` and the blocks' roots. The only block of a tree ends at its root, which may be any level."""
    block = F.shiftright("pos", BITS)
    grouped = foot.groupBy("tree", block.alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("l0"))
    levels = grouped
    for k in range(BITS):
        # a tree's only block stops as soon as one node remains
        ends = (F.size(f"l{k}") == 1) & (F.col("n") <= 1 << BITS)
        levels = levels.withColumn(f"l{k + 1}", F.when(ends, F.col(f"l{k}")).otherwise(pairs_hashed(F.col(f"l{k}"))))
    levels = written(levels, name)
    held = F.size("l0")

    def nodes(k: int) -> Column:
        """Level k (from 1) of a block: the interval of each node, cut where its children meet."""
        base, half = F.shiftleft("block", BITS), 1 << (k - 1)
        lower, upper = F.col(f"l{k - 1}"), F.col(f"l{k}")

        def node(i: Column) -> Column:
            lo = i * (2 * half)
            return F.struct(
                F.lit(k).alias("level"), (base + lo).alias("lo"), (base + F.least(lo + half, held)).alias("mid"), (base + F.least(lo + 2 * half, held)).alias("hi"),
                F.get(lower, i * 2).alias("left"), F.get(lower, i * 2 + 1).alias("right"),
            )

        grows = (F.size(lower) > 1) | (F.col("n") > 1 << BITS)
        kind = "array<struct<level:int,lo:bigint,mid:bigint,hi:bigint,left:string,right:string>>"
        return F.when(grows, F.transform(F.sequence(F.lit(0), F.size(upper) - 1), node)).otherwise(F.array()).cast(kind)

    inner = levels.select("tree", "block", F.explode(F.concat(*(nodes(k) for k in range(1, BITS + 1)))).alias("x")).select("tree", "block", "x.*")
    top = levels.select("tree", F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS).alias("n"), F.col("block").alias("pos"), F.get(f"l{BITS}", F.lit(0)).alias("digest"))
    return Bucket(foot, inner, top)


def build(leaves: DataFrame, name: str) -> list[Bucket]:
    """Bucket after bucket, until every tree is one node. leaves: tree, n, pos, digest."""
    buckets = [climb(leaves, name)]
    while (buckets[-1].top.agg(F.max("n")).first()[0] or 1) > 1:
        buckets.append(climb(buckets[-1].top.filter("n > 1"), name))
    return buckets


def roots_of(buckets: list[Bucket]) -> DataFrame:
    """tree, digest of its root and the number of the bucket it ends in."""
    ended = [b.top.filter("n = 1").select("tree", "digest", F.lit(k).alias("ends")) for k, b in enumerate(buckets)]
    return reduce(DataFrame.unionByName, ended)


def steps_in_bucket(bucket: Bucket) -> DataFrame:
    """The foot's columns, block and own: the steps (on which side the sibling is, and its digest, null if there is none) up to the block's root."""
    foot, inner = bucket.foot.withColumn("block", F.shiftright("pos", BITS)), bucket.inner
    inside = (foot["tree"] == inner["tree"]) & (foot["block"] == inner["block"]) & (inner["lo"] <= foot["pos"]) & (foot["pos"] < inner["hi"])
    # what the child that holds the leaf leaves of the parent's interval: [mid, hi) or [lo, mid)
    on_left = F.col("pos") >= F.col("mid")
    sibling = F.when(on_left, F.col("left")).when(F.col("mid") < F.col("hi"), F.col("right"))
    step = F.when(F.col("level").isNotNull(), F.struct("level", on_left.alias("left"), sibling.alias("sibling")))
    pairs = foot.join(inner, inside, "left").select(*(foot[c] for c in foot.columns), step.alias("step"))
    keys = ["tree", "block", "pos"]  # one leaf; dealt by (tree, block) already
    others = [F.first(c).alias(c) for c in foot.columns if c not in keys]
    grouped = pairs.groupBy(*keys).agg(*others, F.sort_array(F.collect_list("step")).alias("steps"))
    return grouped.withColumn("own", F.transform("steps", lambda s: F.struct(s["left"].alias("left"), s["sibling"].alias("sibling"))).cast(STEP)).drop("steps")


def descend(buckets: list[Bucket], above: DataFrame) -> DataFrame:
    """The leaves' columns, path (from the leaf to the very top) and above's other columns for every leaf.

    above: tree, ends, path and more columns, one row a tree: what lies over its root.
    """
    over = None
    for k in range(len(buckets) - 1, -1, -1):
        own = steps_in_bucket(buckets[k])
        # the only block of a tree that ends in this bucket takes what lies above; any other the path of its node in the next bucket
        ups = above.filter(F.col("ends") == k).drop("ends").withColumn("block", F.lit(0).cast("long"))
        if over is not None:
            ups = ups.unionByName(over.withColumnRenamed("pos", "block").select(*ups.columns))
        joined = own.withColumnRenamed("digest", "leaf").join(ups, ["tree", "block"])
        over = joined.withColumn("path", F.concat("own", "path")).drop("own", "block")
    return over


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def step(acc: Column, s: Column) -> Column:
        sibling = F.coalesce(s["sibling"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(sibling, acc)).otherwise(F.concat(acc, sibling)), 256)

    return F.aggregate(path, digest, step)


def merkle_manifest(documents: DataFrame) -> DataFrame:
    """doc_id, lang, rank, leaf, spoilt, subroot, root and path of every row.

    path has a step for each level, from the leaf through its language's root to the dataset's: ``left`` (the sibling stands left) and ``sibling``
    (null where the run had no other node). spoilt is the leaf after tampering (null where the row is not tampered with). Null values are
    fields of their own (``-``), null languages a tree of their own, the first one; null ids come first in their tree. Rows of one id are ordered by their
    digests, so repeated rows are neighbouring leaves with equal digests. A language's only row is its root. Other columns are not covered. No rows
    give no rows. Texts of any length are hashed whole.
    """
    leaves = ranked(leaves_of(documents), ["doc_id", "digest"], "ranked-leaves")
    buckets = build(leaves, "nodes")
    trees = ranked(roots_of(buckets).select(F.lit(ONE).alias("tree"), F.col("tree").alias("of"), "digest", F.col("ends").alias("of_ends")), ["of"], "ranked-roots")
    upper = build(trees, "upper-nodes")
    top = roots_of(upper).select("tree", "ends", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    tops = descend(upper, top)
    above = written(tops.select(F.col("of").alias("tree"), F.col("of_ends").alias("ends"), "path", F.col("leaf").alias("subroot"), "root"), "above")
    rows = descend(buckets, above)
    lang = F.when(F.col("tree") != NONE, F.expr("substr(tree, 2)"))
    return rows.select("doc_id", lang.alias("lang"), F.col("pos").alias("rank"), "leaf", "spoilt", "subroot", "root", "path")


def manifest_digests(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf where there is one) and verified of every row."""
    rows = merkle_manifest(documents)
    back = folded(F.coalesce("spoilt", "leaf"), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda s: s["sibling"]), "")  # nulls are left out
    checked = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), back.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELDS = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in FIELDS)
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
ORACLE = f"""
with recursive leaves as (select doc_id, coalesce('=' || lang, '-') as tree, sha256({_FIELDS}) as leaf,
    case when n_chars is not null and doc_id is not null and {_CRC} % 7 = 0 then sha256({_FIELDS.replace("cast(n_chars as varchar)", "cast(n_chars + 1 as varchar)")}) end as spoilt from documents),
ranked as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves),
up as (select tree, 0 as level, pos, n, leaf as h from ranked
  union all select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by tree, level, pos // 2, n),
roots as (select tree, h as subroot, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n from up where n = 1),
top as (select 0 as level, pos, n, subroot as h from roots
  union all select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by level, pos // 2, n),
nodes as (select tree, level, pos, n, h from up union all select null, level, pos, n, h from top),
walk as (select row_number() over () as rid, doc_id, tree, tree as of, leaf, coalesce(spoilt, leaf) as h, '' as proof, 0 as level, pos, n from ranked
  union all select rid, doc_id, case when walk.n > 1 then walk.tree end, of, leaf,
    case when walk.n = 1 then walk.h when s.h is null then sha256(walk.h) when walk.pos % 2 = 1 then sha256(s.h || walk.h) else sha256(walk.h || s.h) end,
    case when walk.n = 1 then proof else proof || coalesce(s.h, '') end, case when walk.n = 1 then 0 else walk.level + 1 end,
    case when walk.n = 1 then roots.pos else walk.pos // 2 end, case when walk.n = 1 then roots.n else (walk.n + 1) // 2 end
  from walk join roots on roots.tree = walk.of
  left join nodes s on s.tree is not distinct from walk.tree and s.level = walk.level and s.pos = xor(walk.pos, 1) and s.n = walk.n
  where walk.tree is not null or walk.n > 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from walk join roots on roots.tree = walk.of, (select h as root from top where n = 1) where walk.tree is null and walk.n = 1
"""
