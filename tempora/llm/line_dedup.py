"""Line dedup with a log-template tree of fixed depth.

Every line with a word goes down the tree by its token count and its first ``depth`` tokens, tokens with digits standing as one
wildcard. At the leaf the tokens below the leading ones are cut into up to six fields of even length, and a template fixes all of
them but a third (two of six, one of three to five): it stands for every line of the leaf that has the
same words in the fixed fields, so names, numbers or dates may vary in any two fields, however far apart. A line too short for three
fields is a template of its own words, digits included; a longer line of wildcards alone has none. A template that lines of two
different document contents fall on recurs: its first line (least doc_id, then line number) stays and the others
are dropped. Exact copies of one document do not make its lines recur.

Leaves come first: a template lies inside one leaf, so lines in leaves of one content are done with before any template is made.

``drop_recurring_text`` goes further: passages inside otherwise different lines go too. Every run of ``WINDOW`` words is hashed, and of
``REACH`` runs in a row the one with the least hash is looked at, so two documents that share WINDOW + REACH - 1 = 47 words in a row
have one of these runs in common.

Only built-in functions. Templates are found from hashes; a line's text is shuffled only with its own document.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, has_word, joined_to_keys, let, lines_of, unused, word_array, written

BLANK = " \t\n\x0b\x0c\r"
FIELDS = 6
#: Powers of two: the words of a run, and how many runs in a row are sure to have one that is looked at.
WINDOW, REACH = 32, 16


def variable_fields(n: int) -> list[tuple[int, ...]]:
    """The sets of fields that templates of ``n`` fields leave open."""
    return list(combinations(range(n), n // 3))


def content_of(documents: DataFrame) -> Column:
    """A row's name, from its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit("")))))


def line_leaves(documents: DataFrame, depth: int) -> DataFrame:
    """doc_id, content, text_hash, line_no (from 0), leaf and the hashes of its fields of every line with a word."""
    # named before the lines are taken apart, so that a text is hashed once
    texts = documents.select("doc_id", content_of(documents).alias("content"), F.xxhash64("text").alias("text_hash"), "text")
    own = ["doc_id", "content", "text_hash", "line_no"]
    lines = texts.select(*own[:3], F.posexplode(lines_of(F.col("text"))).alias("line_no", "line")).filter(has_word(F.col("line")))
    wild = F.regexp_replace("line", f"[^{WHITE}0-9]*[0-9][^{WHITE}]*", "<*>")
    masked = F.btrim(F.when(F.col("line").rlike("[0-9]"), wild).otherwise(F.col("line")), F.lit(BLANK))
    words = lambda line: F.split(line, f"[{WHITE}]+")
    tokens = lines.select(*own, "line", words(masked).alias("t"))
    sized = tokens.select(*own, "line", "t", F.size("t").alias("n"), F.least(F.size("t") - depth, F.lit(FIELDS)).alias("m"))
    edge = lambda k: F.lit(depth) + F.floor((F.col("n") - depth) * k / F.col("m")).cast("int")
    fields = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.xxhash64(F.slice("t", edge(k) + 1, edge(k + 1) - edge(k))))
    exact = F.array(F.xxhash64(words(F.btrim("line", F.lit(BLANK)))))
    fields = F.when(F.col("m") < 3, exact).when(F.size(F.array_remove("t", "<*>")) == 0, F.array().cast("array<bigint>")).otherwise(fields)
    return sized.select(*own, F.xxhash64("n", F.slice("t", 1, depth)).alias("leaf"), fields.alias("fields"))


def template_keys() -> Column:
    """The hashes of a line's templates; none for a line without fields."""
    every = F.array(*(F.array(*(F.array(*map(F.lit, out)).cast("array<int>") for out in variable_fields(n))) for n in range(FIELDS + 1)))
    fixed = lambda out: F.filter("fields", lambda f, k: ~F.array_contains(out, k))
    return F.when(F.size("fields") > 0, F.transform(F.get(every, F.size("fields")), lambda out: F.xxhash64("leaf", out, F.lit("|"), fixed(out))))


def recurring_lines(documents: DataFrame, depth: int = 3) -> DataFrame:
    """content (of ``content_of``) and the sorted numbers (from 0) of the lines to drop, for documents that have some."""
    span = (F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.count("*").alias("n"))
    every = written(line_leaves(documents, depth), "line-leaves")
    leaves = written(every.groupBy("leaf").agg(*span).filter("lo <> hi").select("leaf", "n"), "leaves")
    lines = joined_to_keys(every, leaves, "leaf", every.count()).select("doc_id", "content", "text_hash", "line_no", F.explode(template_keys()).alias("key"))
    lines = written(lines, "line-templates")
    where = F.struct("doc_id", "line_no")
    templates = written(lines.groupBy("key").agg(F.min(where).alias("first"), *span).filter("lo <> hi").select("key", "first", "n"), "templates")
    later = joined_to_keys(lines, templates, "key", lines.count()).filter(where > F.col("first"))
    return later.groupBy("content").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def _with_drops(documents: DataFrame, drops: DataFrame) -> tuple[DataFrame, str]:
    """The documents with the array ``drop`` of their content in a column of an unused name (null for none), and that name."""
    key, own, drop = (unused(x, documents) for x in ("content", "own_content", "drop"))
    keyed = documents.withColumn(own, content_of(documents))
    joined = keyed.join(drops.select(F.col("content").alias(key), F.col("drop").alias(drop)), F.col(own) == F.col(key), "left")
    return joined.drop(key, own), drop


def drop_recurring_lines(documents: DataFrame, depth: int = 3) -> DataFrame:
    """The documents' rows and columns with recurring lines gone from ``text``, and n_lines and n_dropped added.

    A null text stays null with n_lines 0; a text may become empty, its row stays. Repeated rows (equal id and text)
    lose the same lines. A null doc_id orders before all others. Columns named like the added ones are replaced.
    """
    documents = documents.drop("n_lines", "n_dropped")
    joined, drop = _with_drops(documents, recurring_lines(documents, depth))
    kept = let(lines_of(F.col("text")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(drop)), lambda i: F.get(x, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.translate(F.col("text"), "\n", "")) + 1)
    n_dropped = F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(*(text if c == "text" else F.col(f"`{c}`") for c in documents.columns), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def passage_windows(words: Column) -> Column:
    """array<struct<key, at>>: hash and place (from 0) of the runs of WINDOW words that are looked at."""

    def after(x: Column, step: int) -> Column:
        return F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0)))

    def before(x: Column, step: int) -> Column:
        return F.concat(F.array_repeat(F.lit(None).cast("long"), step), F.slice(x, 1, F.greatest(F.size(x) - step, F.lit(0))))

    def doubled(x: Column, size: int, other, join) -> Column:
        """``join`` over ``size`` neighbours, by steps of 1, 2, 4, ..."""

        def one(x: Column, step: int) -> Column:
            return let(x, lambda h: F.zip_with(h, other(h, step), join))

        step = 1
        while step < size:
            x, step = one(x, step), 2 * step
        return x

    def chosen(h: Column) -> Column:
        # a run is the least of some REACH in a row if the greatest of these minima is its own
        tops = doubled(doubled(h, REACH, after, lambda a, b: F.least(a, b)), REACH, before, lambda a, b: F.greatest(a, b))
        own = F.zip_with(h, tops, lambda a, b: F.when(a == b, a))
        return F.filter(F.transform(own, lambda x, i: F.when(x.isNotNull(), F.struct(x.alias("key"), i.alias("at")))), lambda x: x.isNotNull())

    def runs(w: Column) -> Column:
        h = doubled(F.transform(w, lambda x: F.xxhash64(x)), WINDOW, after, lambda a, b: F.xxhash64(a, b))
        return F.slice(h, 1, F.size(w) - (WINDOW - 1))

    return let(words, lambda w: F.when(F.size(w) >= WINDOW, let(runs(w), chosen)))


def recurring_passages(documents: DataFrame) -> DataFrame:
    """content (of ``content_of``) and the sorted places of the runs of WINDOW words to drop, for documents that have some."""
    texts = documents.select("doc_id", content_of(documents).alias("content"), F.xxhash64("text").alias("text_hash"), "text")
    runs = texts.select("doc_id", "content", "text_hash", F.explode(passage_windows(word_array(F.col("text")))).alias("w"))
    runs = written(runs.select("doc_id", "content", "text_hash", "w.key", "w.at"), "passages")
    where = F.struct("doc_id", "text_hash", "at")
    shared = runs.groupBy("key").agg(F.min(where).alias("first"), F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.count("*").alias("n"))
    shared = written(shared.filter(F.col("lo") != F.col("hi")).select("key", "first", "n"), "shared-passages")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # a repetition that overlaps the first occurrence would take words of it
    later = joined_to_keys(runs, shared, "key", runs.count()).filter((where > F.col("first")) & ~(same & (F.col("at") < F.col("first.at") + WINDOW)))
    return later.groupBy("content").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def drop_recurring_passages(documents: DataFrame) -> DataFrame:
    """The documents' rows and columns with the words of recurring passages gone from ``text``, and n_words_dropped added.

    A passage of 47 words or more that different documents share stays where it is first; up to 15 words of it may stay at either end
    elsewhere. Every word left keeps the white space before it. Line borders do not matter.
    """
    documents = documents.drop("n_words_dropped")
    joined, drop = _with_drops(documents, recurring_passages(documents))
    word = f"[^{WHITE}]+"
    gone = F.array_distinct(F.flatten(F.transform(drop, lambda p: F.sequence(p, p + (WINDOW - 1)))))
    parts = F.struct(F.split("text", word, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("words"), gone.alias("gone"))

    def rebuilt(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["words"]) - 1), x["gone"])
        body = F.array_join(F.transform(kept, lambda i: F.concat(F.get(x["gaps"], i), F.get(x["words"], i))), "")
        return F.struct(F.concat(body, F.element_at(x["gaps"], -1)).alias("text"), F.size(x["gone"]).cast("long").alias("n"))

    new = unused("new", joined)
    out = joined.withColumn(new, F.when(F.col(drop).isNotNull(), let(parts, rebuilt)))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.col(f"{new}.text")).alias("text")
    return out.select(*(text if c == "text" else F.col(f"`{c}`") for c in documents.columns), F.coalesce(f"{new}.n", F.lit(0)).cast("long").alias("n_words_dropped"))


def drop_recurring_text(documents: DataFrame, depth: int = 3) -> DataFrame:
    """Recurring lines, and then the recurring passages of what is left; n_lines, n_dropped and n_words_dropped are added."""
    return drop_recurring_passages(written(drop_recurring_lines(documents, depth), "without-lines"))


def _sql_key(k: int) -> str:
    return f"case when o[{k + 1}] then '' else array_to_string(tok[3 + (len(tok) - 3) * {k} // greatest(m, 1) + 1:3 + (len(tok) - 3) * {k + 1} // greatest(m, 1)], ' ') end"


_OPEN = ", ".join(f"({n}, {i}, {[k in out or k >= n for k in range(FIELDS)]})" for n in range(FIELDS + 1) for i, out in enumerate(variable_fields(n)))
ORACLE = rf"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents where text is not null),
t as (select doc_id, text, line_no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as tok, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') as words from l),
e as (select *, least(greatest(len(tok) - 3, 0), {FIELDS}) as m from t where len(tok) > 0 and (len(tok) < 6 or len(list_filter(tok, lambda x: x <> '<*>')) > 0)),
o(m, i, o) as (values {_OPEN}),
k as (select doc_id, text, line_no, case when m < 3 then words else concat_ws(chr(1), len(tok), i, array_to_string(tok[1:3], ' '), {", ".join(_sql_key(k) for k in range(FIELDS))}) end as key from e join o using (m)),
g as (select key, min((doc_id, line_no)) as first from k group by 1 having min(text) <> max(text)),
d as (select distinct k.doc_id, k.text, k.line_no from k join g using (key) where (k.doc_id, k.line_no) > g.first),
kept as (select l.doc_id, l.text, string_agg(line, chr(10) order by line_no) as t, count(*) as n
         from l where not exists (select 1 from d where d.doc_id = l.doc_id and d.text = l.text and d.line_no = l.line_no) group by 1, 2)
select o.doc_id, case when o.text is null then null else coalesce(kept.t, '') end as text,
       cast(coalesce(len(string_split(o.text, chr(10))), 0) as bigint) as n_lines,
       cast(coalesce(len(string_split(o.text, chr(10))), 0) - coalesce(kept.n, 0) as bigint) as n_dropped
from documents o left join kept on o.doc_id = kept.doc_id and o.text = kept.text
"""
