"""Quality rules: per-document counts, then lines that too many documents of a host share.

Every line is normalised (lower case, digits to 0, runs of white space to one space) and hashed; the distinct
document contents that hold it are counted per host. Lines in more than ``max_docs`` of them are removed, and a
document is rejected if more than ``max_removed`` of its words go with them. Exact copies of a document count once,
so copies do not condemn each other. Only built-in functions. ``clean_documents`` gives the texts without their common lines; they are
read twice and shuffled at most once, for the join with the numbers of the lines to remove. Lines that a large part of all rows holds are
marked where they are, and rows of one content with very many copies are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_word, joined_to_keys, left_joined_to_keys, let, lines_of, without_white, word_array, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def normalised_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def repeated_words(words: Column) -> Column:
    """Words inside windows of 8 words that are found twice or more in the text, the first time included."""

    def joined(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def windows(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        eight = let(let(let(one, lambda h: joined(h, 1)), lambda h: joined(h, 2)), lambda h: joined(h, 4))
        return F.slice(eight, 1, F.size(w) - (WINDOW - 1))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = lambda s, k: F.get(s, k)["h"]
        twice = let(ordered, lambda s: F.filter(F.transform(s, lambda x, k: F.when((at(s, k - 1) == x["h"]) | (at(s, k + 1) == x["h"]), x["i"])), lambda i: i.isNotNull()))
        spans = let(F.sort_array(twice), lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, n: a + n)

    found = let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(found)


def line_hashes(documents: DataFrame, host: str) -> DataFrame:
    """key (column ``_key``), content and lines (hash with the host, and number, from 0, of every line with a word)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = lambda x: F.xxhash64(F.col(host).isNull(), F.col(host), normalised_line(x))
    numbered = F.filter(F.transform(lines_of(F.col("text")), lambda x, i: F.when(has_word(x), F.struct(hashed(x).alias("h"), i.alias("at")))), lambda x: x.isNotNull())
    return documents.select(F.col("_key").alias("key"), F.xxhash64(text).alias("content"), numbered.alias("lines"))


def document_counts(documents: DataFrame, cleaned: str) -> DataFrame:
    """doc_id, the column ``cleaned`` and the counts of the base rules of ``text``; left_words is the number of words of ``cleaned``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(lines_of(F.col("text")), has_word)
    parts = documents.select(
        "doc_id", cleaned,
        F.length(without_white(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(word_array(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        F.size(word_array(F.col(cleaned))).cast("long").alias("left_words"),
    )
    return parts.select("doc_id", cleaned, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"), "left_words")


def clean_documents(
    documents: DataFrame, host: str = "source", max_docs: int = 20, max_removed: float = 2 / 3, min_words: int = 20, max_repeat_percent: int = 30
) -> DataFrame:
    """doc_id, text (without the lines above the limit), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.

    The counts are those of the text before; removed_words is what the cleaned text has less. Null and empty texts have no words and
    fail; a null text stays null. A text may become empty, its row stays. Null hosts are one host. Each row is judged, repeated rows
    alike; rows with a null doc_id too. No documents give no rows. Columns besides doc_id, text and the host are not looked at.
    """
    # what a text loses depends on it and its host alone
    key = F.xxhash64(F.col(host).isNull(), F.col(host), F.coalesce(F.col("text"), F.lit("")))
    lines = written(line_hashes(documents.withColumn("_key", key), host), "line-hashes")
    each = lines.select("key", "content", F.explode("lines").alias("l")).select("key", "content", F.col("l.h").alias("line"), F.col("l.at").alias("at"))
    common = each.groupBy("line").agg(F.count_distinct("content").alias("docs"), F.count("*").alias("n")).filter(F.col("docs") > max_docs).select("line", "n")
    sizes = lines.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines"), F.count("*").alias("rows")).first()
    found = joined_to_keys(each.select("key", "line", "at"), written(common, "common-lines"), "line", sizes["lines"])
    # rows of one key lose the same lines
    gone = found.groupBy("key").agg(F.collect_set("at").alias("_gone"), F.count("*").alias("n")).withColumn("n", F.floor(F.col("n") / F.size("_gone")))
    joined = left_joined_to_keys(documents.select("doc_id", "text", key.alias("key")), written(gone, "lines-to-cut"), "key", sizes["rows"])
    left = let(lines_of(F.col("text")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"))
    cleaned = joined.select("doc_id", "text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("cleaned"))
    counts = document_counts(cleaned, "cleaned")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = counts.withColumn("removed_words", F.col("n_words") - F.col("left_words")).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= F.lit(max_removed) * F.col("n_words")))
    return judged.select("doc_id", F.col("cleaned").alias("text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def judge_documents(
    documents: DataFrame, host: str = "source", max_docs: int = 20, max_removed: float = 2 / 3, min_words: int = 20, max_repeat_percent: int = 30
) -> DataFrame:
    """The counts and verdicts of ``clean_documents``, whose texts are built for them, without the texts."""
    return clean_documents(documents, host, max_docs, max_removed, min_words, max_repeat_percent).drop("text")


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
g as (select rid, pos, array_to_string(ws[pos:pos+7], ' ') as gram
      from (select rid, ws, unnest(range(1, len(ws) - 6)) as pos from w where len(ws) >= 8)),
r as (select rid, gram from g group by 1, 2 having count(*) > 1),
c as (select rid, count(distinct p) as n from (select g.rid, unnest(range(g.pos, g.pos + 8)) as p from g join r using (rid, gram)) group by 1),
l as (select rid, host, text, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
      from (select rid, host, text, unnest(string_split(text, chr(10))) as line from d)
      where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select rid, count(*) - count(distinct line) as n from l group by 1),
common as (select host, norm from l group by 1, 2 having count(distinct text) > 20),
gone as (select l.rid, sum(l.n) as n from l join common k on l.norm = k.norm and l.host is not distinct from k.host group by 1),
j as (select d.doc_id, cast(len(w.ws) as bigint) as n_words,
             cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
             cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
             cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
             cast(coalesce(gone.n, 0) as bigint) as removed_words
      from d join w using (rid) left join dup using (rid) left join c using (rid) left join gone using (rid))
select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and removed_words <= 2.0 / 3 * n_words as kept
from j
"""
