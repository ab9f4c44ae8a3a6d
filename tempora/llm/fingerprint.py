"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors, each
lane modulo a power of two. Sums do not depend on the order, and a paragraph is inserted or deleted by adding or
subtracting its own vector (``combine``). The vector has two parts:

* 16 dense lanes modulo 2^32 from SHA-256, for equality;
* 384 sparse lanes modulo 2^16: each segment (a sentence, or 160 characters of a longer one) of the paragraph adds to one lane. Lanes
  are in twelve strata that hold a half, a quarter, ... of the segments, so some stratum is thinly filled up to some 90,000
  segments, and there the share of equal lanes estimates the share of common segments (``likeness``).

Only built-in functions. A text is shuffled once by its key; the part its neighbour takes, once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import has_word, let, lines_of, shuffle_partitions, written

DENSE, STRATA, LANES = 16, 12, 32
DENSE_MOD, SPARSE_MOD = 1 << 32, 1 << 16
SEGMENT_END = r"[.!?]+\x20+|\n"
#: The part of a segment longer than 160 characters that is a segment of its own.
SEGMENT_PART = "(?s).{1,160}"


def _number(hexes: Column, start: int, width: int) -> Column:
    return F.conv(F.substring(hexes, start, width), 16, 10).cast("long")


def _zeros(number: Column) -> Column:
    """How many zero bits a positive number below 2^STRATA ends with: the length of the binary digits after the last one."""
    digits = F.bin(number)
    return F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))


def fingerprint(text: Column) -> Column:
    """Lowercase hex of the lanes: 16 of 8 digits, then 384 of 4 digits. A text without paragraphs is all zeros."""

    def dense(hexes: Column) -> Column:
        def lane(k: Column) -> Column:
            at = lambda h: F.conv(h.substr(k * 8 + 1, F.lit(8)), 16, 10).cast("long")
            total = F.aggregate(hexes, F.lit(0).cast("long"), lambda a, h: (a + at(h)) % F.lit(DENSE_MOD))
            return F.lpad(F.lower(F.hex(total)), 8, "0")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(DENSE - 1)), lane), "")

    def sparse(segments: Column) -> Column:
        def stratum(k: Column) -> Column:
            def lane(own: Column, i: Column) -> Column:
                total = F.aggregate(F.filter(own, lambda s: s["lane"] == i), F.lit(0).cast("long"), lambda a, s: (a + s["v"]) % F.lit(SPARSE_MOD))
                return F.lpad(F.lower(F.hex(total)), 4, "0")

            lanes = lambda own: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: lane(own, i)), "")
            return let(F.filter(segments, lambda s: s["stratum"] == k), lambda own: F.when(F.size(own) == 0, F.lit("0000" * LANES)).otherwise(lanes(own)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRATA - 1)), stratum), "")

    def placed(h: Column) -> Column:
        # the zero bits at the end of 11 bits and one that is set
        rare = _number(h, 7, 3).bitwiseAND(F.lit((1 << (STRATA - 1)) - 1)) + F.lit(1 << (STRATA - 1))
        return F.struct(let(rare, lambda r: _zeros(r)).alias("stratum"), (_number(h, 5, 2) % LANES).alias("lane"), (_number(h, 1, 4) + 1).alias("v"))

    paragraphs = F.filter(lines_of(text), has_word)
    wide = F.transform(paragraphs, lambda p: F.concat(F.sha2(p, 256), F.sha2(F.concat(F.lit("#"), p), 256)))
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), SEGMENT_END, -1), lambda s: F.when(F.length(s) <= 160, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(SEGMENT_PART), F.lit(0))))
    segments = F.filter(F.flatten(cut), has_word)
    sums = F.transform(segments, lambda s: let(F.md5(s), placed))
    return F.concat(let(wide, dense), let(sums, sparse))


def combine(fingerprint_: Column, change: Column, sign: int = 1) -> Column:
    """The fingerprint after the paragraphs of ``change`` (a fingerprint) are inserted (sign 1) or deleted (-1)."""

    def part(start: int, width: int, lanes: int, mod: int) -> Column:
        def lane(k: Column) -> Column:
            at = lambda h: F.conv(h.substr(k * width + start, F.lit(width)), 16, 10).cast("long")
            return F.lpad(F.lower(F.hex(F.pmod(at(fingerprint_) + F.lit(sign) * at(change), F.lit(mod)))), width, "0")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lane), "")

    return F.concat(part(1, 8, DENSE, DENSE_MOD), part(DENSE * 8 + 1, 4, STRATA * LANES, SPARSE_MOD))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the share of equal lanes in the first stratum with room and those above it.

    A stratum has room if 24 or fewer of its 32 lanes are filled on either side; lanes empty on both sides do not count.
    """
    def stratum(k: Column) -> Column:
        part = lambda fp: fp.substr(k * (LANES * 4) + DENSE * 8 + 1, F.lit(LANES * 4))

        def counted(x: Column, y: Column) -> Column:
            lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.struct(x.substr(i * 4 + 1, F.lit(4)).alias("x"), y.substr(i * 4 + 1, F.lit(4)).alias("y")))
            filled = F.filter(lanes, lambda v: (v["x"] != "0000") | (v["y"] != "0000"))
            return let(filled, lambda f: F.struct(F.size(f).alias("filled"), F.size(F.filter(f, lambda v: v["x"] == v["y"])).alias("equal")))

        none = F.struct(F.lit(0).alias("filled"), F.lit(0).alias("equal"))
        zeros = F.lit("0000" * LANES)
        return let(F.struct(part(a).alias("x"), part(b).alias("y")), lambda v: F.when((v["x"] == zeros) & (v["y"] == zeros), none).otherwise(counted(v["x"], v["y"])))

    def estimate(strata: Column) -> Column:
        roomy = F.filter(F.sequence(F.lit(0), F.lit(STRATA - 1)), lambda k: F.get(strata, k)["filled"] <= LANES * 3 // 4)
        used = let(roomy, lambda r: F.slice(strata, F.coalesce(F.get(r, 0), F.lit(STRATA - 1)) + 1, F.lit(STRATA)))
        total = lambda u, c: F.aggregate(u, F.lit(0), lambda t, s: t + s[c])
        return let(used, lambda u: let(total(u, "filled"), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(total(u, "equal") / n)))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.transform(F.sequence(F.lit(0), F.lit(STRATA - 1)), stratum), estimate))


def next_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """keys and next_<key> of the row after each one in the given order, the first after the last; for one row, itself.

    The rows are dealt by range and ordered within each part; only the first row of each part is gathered.
    """
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    parts = written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    # every part is one range; the order inside it comes from the window's own sort
    nexts = F.lead(F.struct(*keys)).over(Window.partitionBy("_part").orderBy(*order))
    linked = parts.withColumn("_next", nexts)
    first = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    heads = written(parts.withColumn("_rank", first).filter("_rank = 1").select("_part", F.struct(*keys).alias("_head")), "heads")
    # one row per part from here on
    by_part = Window.orderBy("_part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(by_part), F.first("_head").over(whole)).alias("_following"))
    linked = linked.join(F.broadcast(heads), "_part").withColumn("_next", F.coalesce("_next", "_following"))
    return linked.select(*keys, *(F.col(f"_next.{k}").alias(f"next_{k}") for k in keys))


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """The fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of the next document in
    descending doc_id; after the last comes the first. A null text is empty; null doc_ids come last; rows with equal doc_id
    are ordered by a hash of the text, and equal rows follow each other. A lone document is its own next.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    # the row's name has as many bits as a text needs not to be taken for another
    rows = rows.withColumn("h", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.col("text")))))
    # one row for equal rows, and one shuffle of the texts for both joins
    # (both use the same columns of it, so its exchange is reused)
    keyed = rows.groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    sizes = rows.select("h", "doc_id", F.length("text").alias("n")).groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    nexts = next_rows(sizes, ["h", "n", "copies"], [F.col("doc_id").desc_nulls_last(), F.col("h")])
    # a row for each document as the next of another: whose next it is and how much of it that one takes
    wanted = nexts.select(F.col("next_h").alias("h"), F.col("h").alias("t_h"), F.floor(F.col("n") / 2).cast("int").alias("take"), "copies")
    given = keyed.join(wanted, "h").select(F.col("t_h").alias("h"), F.col("doc_id").alias("next_doc_id"), "copies", F.col("text").substr(F.lit(1), F.col("take")).alias("taken"), fingerprint(F.col("text")).alias("next_fingerprint"))
    joined = keyed.join(given, "h").withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    # of equal rows each but the last has its own like as next: two kinds of rows, which are repeated when they are done
    last = F.struct(F.lit(False).alias("own"), F.lit(1).cast("long").alias("times"))
    kinds = F.when(F.col("copies") > 1, F.array(last, F.struct(F.lit(True).alias("own"), (F.col("copies") - 1).alias("times")))).otherwise(F.array(last))
    each = joined.withColumn("kind", F.explode(kinds))
    own = F.col("kind.own")
    taken = F.when(own, F.col("text").substr(F.lit(1), F.col("half"))).otherwise(F.col("taken"))
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - F.col("half")), taken)
    out = each.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("next_doc_id")).alias("next_doc_id"), F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.when(own, F.col("fingerprint")).otherwise(F.col("next_fingerprint")).alias("next_fingerprint"), F.col("kind.times").alias("times"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    out = out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "next_doc_id", "times",
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


_FP = r"""
 (select t.k, string_agg(lane, '' order by pos) as fp from (
   select k, l.l as pos, printf('%08x', cast(coalesce(sum(cast('0x' || substr(case when l.l < 8 then sha256(p) else sha256('#' || p) end, (l.l % 8) * 8 + 1, 8) as bigint)), 0) % 4294967296 as bigint)) as lane
   from (select k, unnest(coalesce(nullif(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')), []), [null])) as p from {t}) x, (select unnest(range(16)) as l) l group by 1, 2
   union all
   select g.k, 16 + g.l, printf('%04x', cast(coalesce(s.v, 0) as bigint)) from (select k, l from {t}, (select unnest(range(384)) as l)) g left join
     (select k, lane as l, sum(v) % 65536 as v from (
        select k, cast('0x' || substr(h, 1, 4) as bigint) + 1 as v,
               (length(bin(r)) - length(rtrim(bin(r), '0'))) * 32 + cast('0x' || substr(h, 5, 2) as bigint) % 32 as lane
        from (select k, h, cast('0x' || substr(h, 7, 3) as bigint) % 2048 + 2048 as r from (select k, md5(s) as h from (select k, unnest(case when length(u) <= 160 then [u] else regexp_extract_all(u, '(?s).{{1,160}}') end) as s from (select k, unnest(regexp_split_to_array(text, '[.!?]+\x20+|\n')) as u from {t}) v) a where regexp_matches(s, '[^\x20\x09-\x0D]')) b) c) d group by 1, 2) s
     on s.k = g.k and s.l = g.l) t group by 1)
"""
_NEAR = r"""
 (select k, case when any_value(a) = any_value(b) then 1.0 when count(*) filter (s >= f and filled) = 0 then 0.0
   else count(*) filter (s >= f and filled and x = y) / cast(count(*) filter (s >= f and filled) as double) end as near
  from (select *, min(case when s = 11 or crowd <= 24 then s end) over (partition by k) as f from
   (select *, count(*) filter (filled) over (partition by k, s) as crowd from
    (select *, l // 32 as s, x <> '0000' or y <> '0000' as filled from
     (select k, a, b, l, substr(a, 129 + l * 4, 4) as x, substr(b, 129 + l * 4, 4) as y from {t}, (select unnest(range(384)) as l))))) group by 1)
"""
ORACLE = f"""
with d as (select row_number() over (order by doc_id desc) as k, doc_id, coalesce(text, '') as text from documents),
e as (select d.k, d.doc_id, d.text, coalesce(n.k, 1) as nk, length(d.text) as n_chars,
             substr(d.text, 1, length(d.text) - length(d.text) // 2) || substr(coalesce(n.text, f.text), 1, length(d.text) // 2) as edited
      from d left join d n on n.k = d.k + 1 join d f on f.k = 1),
u as (select k, edited as text from e),
fp as {_FP.format(t="d")},
ep as {_FP.format(t="u")},
p1 as (select fp.k, fp.fp as a, ep.fp as b from fp join ep using (k)),
p2 as (select e.k, x.fp as a, y.fp as b from e join fp x on x.k = e.k join fp y on y.k = e.nk),
n1 as {_NEAR.format(t="p1")},
n2 as {_NEAR.format(t="p2")}
select e.doc_id, e.n_chars, sha256(e.edited) as edited_sha256, p1.a as fingerprint, p1.b as edited_fingerprint, cast(n1.near as double) as near_edited, cast(n2.near as double) as near_next, (select x.doc_id from d x where x.k = e.nk) as next_doc_id
from e join p1 using (k) join n1 using (k) join n2 using (k)
"""
