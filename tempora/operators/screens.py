"""Caption screens for published scenes: cue texts cut into lines and two-line screens, paced by their width, sliced by scenes.

Widths are integers: a wide character counts 100, any other 55; line limits are in the same unit. Times are milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import let
from .intervals import interval_join

# Character widths, wide characters, the marks that end a clause, and characters after or before which a wide clause may be cut.
WIDE, NARROW = 100, 55
WIDE_CLASS = "　-〿㐀-鿿＀-￯"
MARKS = "，。！？!?；;、,：:"
AFTER = "的了着过地得们吗呢吧啊"
BEFORE = "和与及在把被就而但又还也都让对从向为"

#: An indivisible part of a clause with the white space after it. joint: how good a cut after it is (0 best, null: none).
_ATOM = "struct<text:string,width:int,joint:int>"
_LINES = f"struct<done:array<string>,open:array<{_ATOM}>>"


def width(text: Column) -> Column:
    return F.length(text) * NARROW + F.length(F.regexp_replace(text, f"[^{WIDE_CLASS}]", "")) * (WIDE - NARROW)


def clauses(text: Column) -> Column:
    """The runs of a text that end after their marks; the whole text if it has nothing else."""
    found = F.regexp_extract_all(text, F.lit(f"[^{MARKS}]+[{MARKS}]*"), F.lit(0))
    runs = let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(text)))
    return F.filter(F.transform(runs, lambda c: F.btrim(c)), lambda c: c != "")


def _atoms(clause: Column, limit: int) -> Column:
    """Words with the space after them, single wide characters, and parts of words that no line could hold."""
    most = max(1, limit // NARROW)
    parts = F.regexp_extract_all(clause, F.lit(f"(?:[{WIDE_CLASS}]|[^{WIDE_CLASS}\\s]{{1,{most}}})\\s*"), F.lit(0))

    def atom(all_parts: Column, part: Column, i: Column) -> Column:
        wide = lambda x: x.rlike(f"^[{WIDE_CLASS}]")
        nxt = F.coalesce(F.get(all_parts, i + 1), F.lit(""))
        joint = (
            F.when(part.endswith(" "), 0).when(part.rlike(f"^[{AFTER}]$") | nxt.rlike(f"^[{BEFORE}]"), 1).when(wide(part) & wide(nxt), 3)
        )
        return F.struct(part.alias("text"), width(part).cast("int").alias("width"), joint.alias("joint")).cast(_ATOM)

    # the clause is split once, not for each of its parts
    return let(parts, lambda p: F.transform(p, lambda part, i: atom(p, part, i)))


def _cut(open_atoms: Column, limit: int) -> Column:
    """How many atoms of a full line go before the cut: the best joint, the last of equals that fills half a line, else the first of them."""
    upto = lambda i: F.aggregate(F.slice(open_atoms, F.lit(1), i + 1), F.lit(0), lambda acc, a: acc + a["width"])
    joints = F.filter(F.transform(open_atoms, lambda a, i: F.struct(a["joint"].alias("joint"), (i + 1).alias("n"), upto(i).alias("filled"))), lambda x: x["joint"].isNotNull())
    late = lambda b: F.filter(b, lambda x: 2 * x["filled"] >= limit)
    chosen = lambda b: let(late(b), lambda x: F.when(F.size(x) > 0, F.element_at(x, -1)["n"]).otherwise(F.get(b, F.lit(0))["n"]))
    best = lambda j: let(F.array_min(F.transform(j, lambda x: x["joint"])), lambda least: F.filter(j, lambda x: x["joint"] == least))
    return let(joints, lambda j: F.when(F.size(j) > 0, let(best(j), chosen)).otherwise(F.size(open_atoms)))


def _text(atoms: Column) -> Column:
    return F.btrim(F.array_join(F.transform(atoms, lambda a: a["text"]), ""))


def _pieces(clause: Column, limit: int) -> Column:
    """A clause that no line holds, in pieces that fit, each as wide as its best joint allows."""

    filled = lambda st: F.aggregate(st["open"], F.lit(0), lambda acc, x: acc + x["width"])

    def broken(st: Column, k: Column) -> Column:
        done = F.concat(st["done"], F.array(_text(F.slice(st["open"], F.lit(1), k))))
        return F.struct(done.alias("done"), F.slice(st["open"], k + 1, F.size(st["open"])).alias("open")).cast(_LINES)

    def step(st: Column, a: Column) -> Column:
        full = lambda x: (F.size(x["open"]) > 0) & (filled(x) + a["width"] > limit)
        # a cut may leave more than fits beside the new atom: it is cut again
        freed = F.aggregate(F.sequence(F.lit(1), F.size(st["open"])), st, lambda x, _: F.when(full(x), let(_cut(x["open"], limit), lambda k: broken(x, k))).otherwise(x))
        room = F.when(full(st), freed).otherwise(st)
        return let(room, lambda x: F.struct(x["done"].alias("done"), F.concat(x["open"], F.array(a)).alias("open")).cast(_LINES))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(f"array<{_ATOM}>").alias("open")).cast(_LINES)
    return F.aggregate(_atoms(clause, limit), start, step, lambda st: F.concat(st["done"], F.array(_text(st["open"]))))


def lines_for(text: Column, limit: int) -> Column:
    """The lines of a text: clauses that fit stay whole, wider ones are cut, and neighbours that fit one line share it."""
    pieces = F.flatten(F.transform(clauses(text), lambda c: F.when(width(c) <= limit, F.array(c)).otherwise(_pieces(c, limit))))

    def step(lines: Column, piece: Column) -> Column:
        last = F.element_at(lines, -1)
        glue = F.when(last.rlike(f"[{WIDE_CLASS}]$") | piece.rlike(f"^[{WIDE_CLASS}]"), "").otherwise(" ")
        both = F.concat(last, glue, piece)
        shared = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(both))
        alone = F.concat(lines, F.array(piece))
        return F.when(F.size(lines) == 0, alone).otherwise(F.when(width(both) <= limit, shared).otherwise(alone))

    return F.aggregate(F.filter(pieces, lambda p: p != ""), F.array().cast("array<string>"), step)


def paced_screens(cues: DataFrame, limit: int | None) -> DataFrame:
    """source_id, cue_idx, screen_idx, start_ms, end_ms, text (lines joined by newlines): a cue's time shared by its screens in proportion to their width.

    Screens have two lines at most. A screen counts one wide character at least. Boundaries are rounded once, so a cue's screens tile it. Without a limit a cue
    is one screen. Cues without text or time have none.
    """
    text = F.btrim(F.regexp_replace("text", "\n", " "))
    base = cues.filter(F.col("end_ms") > F.col("start_ms")).withColumn("text", text).filter(F.col("text") != "").select("source_id", "cue_idx", "start_ms", "end_ms", "text")
    if limit is None:
        return base.withColumn("screen_idx", F.lit(0)).select("source_id", "cue_idx", "screen_idx", "start_ms", "end_ms", "text")
    if limit < WIDE:
        raise ValueError("a line must hold one wide character")
    lines = base.withColumn("lines", lines_for(F.col("text"), limit))
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 2).cast("int")), lambda k: F.slice("lines", k * 2 + 1, 2))
    weigh = lambda p: F.greatest(F.aggregate(p, F.lit(0), lambda acc, x: acc + width(x).cast("int")), F.lit(WIDE))
    screens = lines.withColumn("screens", pairs).withColumn("weights", F.transform(F.col("screens"), weigh))
    # prefix sums of the weights, from 0
    sums = F.aggregate("weights", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    each = screens.withColumn("sums", sums).select("source_id", "cue_idx", "start_ms", "end_ms", "sums", F.posexplode("screens").alias("screen_idx", "screen"))
    at = lambda k: F.col("start_ms") + F.round((F.col("end_ms") - F.col("start_ms")) * F.get("sums", k) / F.element_at("sums", -1)).cast("long")
    paced = each.select("source_id", "cue_idx", "screen_idx", at(F.col("screen_idx")).alias("s"), at(F.col("screen_idx") + 1).alias("e"), F.array_join("screen", "\n").alias("text"))
    return paced.select("source_id", "cue_idx", "screen_idx", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "text")


def slice_and_pace(cues: DataFrame, scenes: DataFrame, limit: int | None = None) -> DataFrame:
    """source_id, scene_idx, idx (from 1), cue_idx, screen_idx, start_ms, end_ms (from the scene's start) and text of the screens each scene shows.

    A cue is paced whole and clipped then, so a scene that starts within it shows what is said from there on, at the cue's pace. Screens
    that a scene does not show at all are left out. Cues in time order number the screens. Scenes may overlap.
    """
    screens = paced_screens(cues, limit).filter(F.col("end_ms") > F.col("start_ms"))
    shown = interval_join(screens, scenes.select("source_id", "scene_idx", "start_ms", "end_ms"), prefix="scene_")
    lo, hi = F.col("scene_start_ms"), F.col("scene_end_ms")
    cut = shown.withColumn("s", F.greatest("start_ms", lo) - lo).withColumn("e", F.least("end_ms", hi) - lo)
    w = Window.partitionBy("source_id", "scene_scene_idx").orderBy("s", "cue_idx", "screen_idx")
    return cut.select("source_id", F.col("scene_scene_idx").alias("scene_idx"), F.row_number().over(w).alias("idx"), "cue_idx", "screen_idx", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "text")
