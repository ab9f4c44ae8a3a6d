"""Interval algebra keyed by source: joins, as-of, merge, complement, remapping. Times are integer milliseconds.

Interval joins are equi joins on (key, time bucket): both sides are listed under every bucket they touch, and a pair is kept in
the later of the two first buckets alone, so each pair comes once without a shuffle to remove doubles. A long source is
thereby spread over many keys. Listed sides repeat their rows and pack well, so by their packed size Spark would broadcast what
does not fit into the driver: these joins ask for a merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import ordered

BUCKET_MS = 30_000
ASOF_BUCKET_MS = 600_000


def _bucketed(df: DataFrame, start: str, end: str, bucket_ms: int, closed: bool, widen: int, side: str) -> DataFrame:
    lo = F.floor((F.col(start) - widen) / bucket_ms)
    last = F.col(end) + widen if closed else F.greatest(F.col(start) - widen, F.col(end) + widen - 1)
    hi = F.floor(last / bucket_ms)
    return df.withColumn(f"_first_{side}", lo).withColumn("_bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def interval_join(
    left: DataFrame, right: DataFrame, on: list[str] | None = None, mode: str = "overlap", tolerance_ms: int = 0,
    left_span: tuple[str, str] = ("start_ms", "end_ms"), right_span: tuple[str, str] = ("start_ms", "end_ms"), prefix: str = "r_", bucket_ms: int = BUCKET_MS, keep_bucket: bool = False,
) -> DataFrame:
    """Pairs of rows with equal keys whose intervals meet; the right side's other columns get the prefix.

    ``keep_bucket`` leaves ``_bucket``, the pair's bucket, by which the rows lie: that of the later of the two starts.

    mode: ``overlap`` (l.end > r.start and l.start < r.end), ``closed`` (>= and <=), ``contained`` (the left one inside the right one). The
    tolerance widens the right side. Rows with null bounds or keys pair with nothing.
    """
    on = on or ["source_id"]
    wide = right.select(*on, *(F.col(c).alias(prefix + c) for c in right.columns if c not in on))
    rs, re = prefix + right_span[0], prefix + right_span[1]
    ls, le = left_span
    closed = mode != "overlap"
    bounded = lambda df, s, e: df.filter(F.col(s).isNotNull() & F.col(e).isNotNull() & (F.col(e) >= F.col(s)))
    lb = _bucketed(bounded(left, ls, le), ls, le, bucket_ms, closed, 0, "l")
    rb = _bucketed(bounded(wide, rs, re), rs, re, bucket_ms, closed, tolerance_ms, "r")
    s, e = F.col(rs) - tolerance_ms, F.col(re) + tolerance_ms
    meets = {
        "overlap": (F.col(le) > s) & (F.col(ls) < e),
        "closed": (F.col(le) >= s) & (F.col(ls) <= e),
        "contained": (F.col(ls) >= s) & (F.col(le) <= e),
    }[mode]
    joined = lb.join(rb.hint("merge"), [*on, "_bucket"]).filter((F.col("_bucket") == F.greatest("_first_l", "_first_r")) & meets)
    return joined.drop("_first_l", "_first_r", *([] if keep_bucket else ["_bucket"]))


def _levelled(df: DataFrame, start: str, end: str, bucket_ms: int, closed: bool, widen: int, side: str, step: int, levels: int) -> DataFrame:
    """The rows with their bounds in buckets and the level of their own: the least at which they touch no more than ``step`` + 1 buckets, or the last."""
    lo = F.col(start) - widen
    last = F.col(end) + widen if closed else F.greatest(lo, F.col(end) + widen - 1)
    own = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        own = F.when(last - lo < bucket_ms * step ** (k + 1), k).otherwise(own)
    return df.withColumns({f"_lo_{side}": lo, f"_hi_{side}": last, f"_own_{side}": own})


def _under(df: DataFrame, side: str, bucket_ms: int, step: int, levels: int, which: str) -> DataFrame:
    """A row for each bucket a row touches, at its own level (``own``), there and above (``from``), or above alone (``above``)."""
    own = F.col(f"_own_{side}")
    if which == "own":
        out = df.withColumn("_level", own)
    else:
        first = own if which == "from" else own + 1
        out = df.filter(first < levels).withColumn("_level", F.explode(F.sequence(first, F.lit(levels - 1))))
    width = F.element_at(F.array(*(F.lit(bucket_ms * step**k).cast("long") for k in range(levels))), F.col("_level") + 1)
    lo, hi = F.floor(F.col(f"_lo_{side}") / width), F.floor(F.col(f"_hi_{side}") / width)
    return out.withColumn(f"_first_{side}", lo).withColumn("_bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def interval_join_levels(
    left: DataFrame, right: DataFrame, on: list[str] | None = None, mode: str = "overlap", tolerance_ms: int = 0,
    left_span: tuple[str, str] = ("start_ms", "end_ms"), right_span: tuple[str, str] = ("start_ms", "end_ms"), prefix: str = "r_",
    bucket_ms: int = BUCKET_MS, step: int = 16, levels: int = 4,
) -> DataFrame:
    """The pairs of ``interval_join`` for sides whose intervals differ widely in length (a day beside a word).

    Each interval is listed in buckets of a width that fits its own length, ``step`` + 1 at most, and looks up those of longer intervals at the
    ``levels`` above, where it touches one or two each. Pairs whose left interval is of the longer level, or of the same, come from one equi join, the others
    from a second; each is kept in the later of the two first buckets of the longer one's level. Only intervals over ``step`` buckets of the last level
    are listed more often: once for each of its buckets (34 hours by default). Rows with null or reversed bounds pair with nothing.
    """
    on = on or ["source_id"]
    wide = right.select(*on, *(F.col(c).alias(prefix + c) for c in right.columns if c not in on))
    (ls, le), rs, re = left_span, prefix + right_span[0], prefix + right_span[1]
    closed = mode != "overlap"
    bounded = lambda df, s, e: df.filter(F.col(e) >= F.col(s))
    a = _levelled(bounded(left, ls, le), ls, le, bucket_ms, closed, 0, "l", step, levels)
    b = _levelled(bounded(wide, rs, re), rs, re, bucket_ms, closed, tolerance_ms, "r", step, levels)
    s, e = F.col(rs) - tolerance_ms, F.col(re) + tolerance_ms
    meets = {
        "overlap": (F.col(le) > s) & (F.col(ls) < e),
        "closed": (F.col(le) >= s) & (F.col(ls) <= e),
        "contained": (F.col(ls) >= s) & (F.col(le) <= e),
    }[mode]
    under = lambda df, side, which: _under(df, side, bucket_ms, step, levels, which)
    halves = [(under(a, "l", "own"), under(b, "r", "from")), (under(a, "l", "above"), under(b, "r", "own"))]
    pairs = [x.join(y.hint("merge"), [*on, "_level", "_bucket"]).filter((F.col("_bucket") == F.greatest("_first_l", "_first_r")) & meets) for x, y in halves]
    return pairs[0].unionByName(pairs[1]).select(*left.columns, *(c for c in wide.columns if c not in on))


def overlap_ms(prefix: str = "r_") -> Column:
    return F.least("end_ms", f"{prefix}end_ms") - F.greatest("start_ms", f"{prefix}start_ms")


def contained_in(left: DataFrame, right: DataFrame, tolerance_ms: int = 0, on: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The left rows inside some right interval, once each; keys tell left rows apart (default: all columns)."""
    on, keys = on or ["source_id"], keys or left.columns
    inside = interval_join(left, right.select(*on, "start_ms", "end_ms"), on, "contained", tolerance_ms).select(*keys).distinct()
    return left.join(inside, keys, "left_semi")


def largest_covered(cuts: DataFrame, silences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_ms, end_ms: the widest part of each cut inside one silence; the first of equals."""
    pairs = interval_join(cuts, silences.select("source_id", "start_ms", "end_ms"))
    lo, hi = F.greatest("start_ms", "r_start_ms"), F.least("end_ms", "r_end_ms")
    best = pairs.groupBy(*keys).agg(F.max_by(F.struct(lo.alias("lo"), hi.alias("hi")), F.struct(hi - lo, -lo)).alias("best"))
    return best.select(*keys, F.col("best.lo").alias("start_ms"), F.col("best.hi").alias("end_ms"))


def _as_of(points: DataFrame, rows: DataFrame, at: str, row_at: str, value: list[str], point_keys: list[str], tie: list[str], before: str | None = None, after: str | None = None, bucket_ms: int = ASOF_BUCKET_MS) -> DataFrame:
    """Each point with the last row at or before it (its columns get the prefix ``before``), the first at or after it (``after``), or both.

    In two levels: a window per source and time bucket, then what other buckets carry over. A source is spread over as many tasks as it has
    buckets; only one row a bucket is ordered per source. Rows without a source or time are never found, points without one find nothing.
    """
    payload, point = F.struct(*value), F.struct(*point_keys, at)
    kind = lambda df, c: df.select(c.alias("x")).schema[0].dataType
    side = points.select("source_id", F.col(at).alias("_t"), F.lit(1).alias("_side"), point.alias("_point"), F.lit(None).cast(kind(rows, payload)).alias("_row"), *(F.lit(None).cast(rows.schema[t].dataType).alias(f"_k{i}") for i, t in enumerate(tie)))
    other = rows.filter(F.col("source_id").isNotNull() & F.col(row_at).isNotNull())
    other = other.select("source_id", F.col(row_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kind(points, point)).alias("_point"), payload.alias("_row"), *(F.col(t).alias(f"_k{i}") for i, t in enumerate(tie)))
    both = side.unionByName(other).withColumn("_bucket", F.floor(F.col("_t") / bucket_ms))
    ks = [F.col(f"_k{i}") for i in range(len(tie))]
    # one row a bucket: its last and first row, null where it has points alone
    rank = F.when(F.col("_side") == 0, F.struct("_t", *ks))
    edges = both.groupBy("source_id", "_bucket").agg(F.max_by("_row", rank).alias("_last"), F.min_by("_row", rank).alias("_first"))
    found = both
    for prefix, name, edge, turn in ((before, "_before", "_last", lambda c: c.asc()), (after, "_after", "_first", lambda c: c.desc())):
        if prefix is None:
            edges = edges.drop(edge)
            continue
        inside = Window.partitionBy("source_id", "_bucket").orderBy(turn(F.col("_t")), "_side", *map(turn, ks)).rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn(name, F.last("_row", ignorenulls=True).over(inside))
        across = Window.partitionBy("source_id").orderBy(turn(F.col("_bucket"))).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.withColumn(edge, F.last(edge, ignorenulls=True).over(across))
    out = found.filter("_side = 1").join(edges.hint("merge"), ["source_id", "_bucket"], "left")
    taken = [F.coalesce(name, edge)[v].alias(prefix + v) for prefix, name, edge in ((before, "_before", "_last"), (after, "_after", "_first")) if prefix is not None for v in value]
    return out.select("source_id", "_point.*", *taken)


def asof_prev(points: DataFrame, words: DataFrame, at: str = "t_ms", keys: list[str] | None = None, value: list[str] | None = None, prefix: str = "prev_") -> DataFrame:
    """Each point with the last word that ends at or before it (nulls if none); ties go to the later word_idx."""
    return _as_of(points, words, at, "end_ms", value or ["word_idx", "end_ms"], keys or [], ["word_idx"], before=prefix)


def asof_next(points: DataFrame, words: DataFrame, at: str = "t_ms", keys: list[str] | None = None, value: list[str] | None = None, prefix: str = "next_") -> DataFrame:
    """Each point with the first word that starts at or after it; ties go to the earlier word_idx."""
    return _as_of(points, words, at, "start_ms", value or ["word_idx", "start_ms"], keys or [], ["word_idx"], after=prefix)


def nearest(points: DataFrame, words: DataFrame, keys: list[str], at: str = "t_ms", by: str = "start_ms") -> DataFrame:
    """Each point with the word whose start is nearest; the earlier one of equals."""
    both = _as_of(points, words, at, by, ["word_idx", by], keys, ["word_idx"], before="b_", after="a_")
    near = F.col(f"b_{by}").isNotNull() & (F.col(f"a_{by}").isNull() | (F.col(at) - F.col(f"b_{by}") <= F.col(f"a_{by}") - F.col(at)))
    return both.select("source_id", *keys, at, F.when(near, F.col("b_word_idx")).otherwise(F.col("a_word_idx")).alias("word_idx"), F.when(near, F.col(at) - F.col(f"b_{by}")).otherwise(F.col(f"a_{by}") - F.col(at)).alias("distance_ms"))


def pairs_overlapping(rows: DataFrame, id_col: str, on: list[str] | None = None) -> DataFrame:
    """All pairs id < r_id within a key that overlap in time."""
    return interval_join(rows, rows, on).filter(F.col(id_col) < F.col(f"r_{id_col}"))


def merge_intervals(rows: DataFrame, tolerance_ms: int = 0, on: list[str] | None = None, min_ms: int = 0, aggs: list[Column] | None = None) -> DataFrame:
    """Unions of intervals that overlap or lie within the tolerance; shorter ones than min_ms are left out before."""
    on = on or ["source_id"]
    order = Window.partitionBy(*on).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
    islands = kept.withColumn("_new", F.coalesce((F.col("start_ms") > before + tolerance_ms).cast("int"), F.lit(1)))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = islands.groupBy(*on, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("merged"), *(aggs or []))
    return grouped.drop("_island")


def complement(cuts: DataFrame, clips: DataFrame, on: list[str]) -> DataFrame:
    """Retained intervals of each clip between its disjoint cuts: src_start, src_end, out_start, out_end (offsets in the output)."""
    inner = cuts.select(*on, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    bounds = clips.select(*on, F.col("start_ms").alias("clip_start"), F.col("end_ms").alias("clip_end"))
    inside = inner.join(bounds, on).filter("e > clip_start and s < clip_end").select(*on, F.greatest("s", "clip_start").alias("s"), F.least("e", "clip_end").alias("e"))
    marks = inside.unionByName(bounds.select(*on, F.col("clip_start").alias("s"), F.col("clip_start").alias("e"))).join(bounds, on)
    order = Window.partitionBy(*on).orderBy("s", "e")
    pieces = marks.select(*on, F.col("e").alias("src_start"), F.coalesce(F.lead("s").over(order), F.col("clip_end")).alias("src_end")).filter("src_end > src_start")
    so_far = F.sum(F.col("src_end") - F.col("src_start")).over(Window.partitionBy(*on).orderBy("src_start").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("out_end", so_far).withColumn("out_start", F.col("out_end") - (F.col("src_end") - F.col("src_start"))).select(*on, "src_start", "src_end", "out_start", "out_end")


def remap_intervals(rows: DataFrame, retained: DataFrame, on: list[str] | None = None, min_ms: int = 1) -> DataFrame:
    """Rows' intervals on the output timeline: out_start_ms, out_end_ms, one row for each retained piece they meet; removed rows vanish."""
    on = on or ["source_id"]
    pieces = retained.select(*on, "src_start", "src_end", "out_start")
    joined = interval_join(rows, pieces, on, right_span=("src_start", "src_end"))
    lo, hi = F.greatest("start_ms", "r_src_start"), F.least("end_ms", "r_src_end")
    out = joined.withColumn("out_start_ms", lo - F.col("r_src_start") + F.col("r_out_start")).withColumn("out_end_ms", hi - F.col("r_src_start") + F.col("r_out_start"))
    return out.filter(F.col("out_end_ms") - F.col("out_start_ms") >= min_ms).drop("r_src_start", "r_src_end", "r_out_start")


def remap_points(points: DataFrame, retained: DataFrame, on: list[str] | None = None, at: str = "t_ms") -> DataFrame:
    """Points with out_ms, null where the point was removed; a point on a cut's edge belongs to the earlier piece."""
    on = on or ["source_id"]
    joined = interval_join(points, retained.select(*on, "src_start", "src_end", "out_start"), on, "closed", left_span=(at, at), right_span=("src_start", "src_end"))
    out = joined.groupBy(*points.columns).agg(F.min(F.col(at) - F.col("r_src_start") + F.col("r_out_start")).alias("out_ms"))
    return points.join(out, points.columns, "left")


def intersect_timelines(layout: DataFrame, retained: DataFrame, on: list[str] | None = None, min_ms: int = 100) -> DataFrame:
    """Layout segments cut to the retained pieces, rebased to the output, pieces under min_ms dropped."""
    return remap_intervals(layout, retained, on, min_ms)


def repair_timeline(segments: DataFrame, durations: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Segments that tile 0..duration: malformed ones dropped, each starts where the one before ends, the last reaches the end.

    A segment that the one before covers wholly is dropped as well.
    """
    on = on or ["source_id"]
    order = Window.partitionBy(*on).orderBy("start_ms", "end_ms")
    good = segments.filter("start_ms is not null and end_ms is not null and end_ms > start_ms and end_ms > 0").join(durations.select(*on, "duration_ms"), on).filter("start_ms < duration_ms")
    good = good.withColumn("end_ms", F.least("end_ms", "duration_ms"))
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    moved = good.withColumn("_from", F.coalesce(reach, F.lit(0))).filter("end_ms > _from")
    last = F.lead("start_ms").over(order).isNull()
    return moved.withColumn("_end", F.when(last, F.col("duration_ms")).otherwise(F.col("end_ms"))).withColumn("start_ms", F.col("_from")).withColumn("end_ms", F.col("_end")).drop("_from", "_end", "duration_ms")


def spans_merged_by_fraction(spans: DataFrame, fraction: float = 0.20, on: list[str] | None = None) -> DataFrame:
    """Spans merged while they overlap the growing span by the fraction of the shorter of both; a fold, as the test depends on what was merged."""
    on = on or ["source_id"]
    grouped = spans.groupBy(*on).agg(ordered("start_ms", "end_ms").alias("all"))
    start = F.expr("named_struct('done', cast(array() as array<struct<start_ms:bigint,end_ms:bigint>>), 'cur', cast(null as struct<start_ms:bigint,end_ms:bigint>))")

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        both = F.least(cur["end_ms"], x["end_ms"]) - F.greatest(cur["start_ms"], x["start_ms"])
        shorter = F.least(cur["end_ms"] - cur["start_ms"], x["end_ms"] - x["start_ms"])
        span = lambda s, e: F.struct(s.cast("bigint").alias("start_ms"), e.cast("bigint").alias("end_ms"))
        whole = F.struct(acc["done"].alias("done"), span(cur["start_ms"], F.greatest(cur["end_ms"], x["end_ms"])).alias("cur"))
        begin = F.struct(F.when(cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur))).alias("done"), span(x["start_ms"], x["end_ms"]).alias("cur"))
        return F.when(cur.isNotNull() & (both > 0) & (both >= shorter * fraction), whole).otherwise(begin)

    folded = grouped.select(*on, F.aggregate("all", start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"]))).alias("spans"))
    return folded.select(*on, F.inline("spans"))


def debounced(cuts: DataFrame, min_ms: int, on: list[str] | None = None, end_col: str | None = None) -> DataFrame:
    """Cut times without those within min_ms of the last one kept (and, with end_col, of the source's end). Equal cuts count once."""
    on = on or ["source_id"]
    keys = on + ([end_col] if end_col else [])
    grouped = cuts.select(*keys, "t_ms").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("t_ms")).alias("all"))
    kept = F.aggregate(
        "all", F.expr("cast(array() as array<bigint>)"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= min_ms), F.concat(acc, F.array(t.cast("bigint")))).otherwise(acc),
    )
    out = grouped.withColumn("t_ms", F.explode(kept)).drop("all")
    return out.filter(F.col(end_col) - F.col("t_ms") >= min_ms) if end_col else out
