"""License scans: an exact set-similarity join between license texts and the text blocks of documents.

A text block is a run of words, cut at every half of its width, so a passage of up to half the width lies whole in one block. Each
template is looked for in the blocks of one width (at least twice its words) and is found where a block holds at least
``threshold`` of its distinct words (containment of the template in the block). Only words of templates can count, so a block's set is
cut to those.

The join is exact. All words of templates are ordered by the number of documents in the corpus that have them, rarest first, ties by
the word. With ``need`` = ceil(threshold * size) words to share:

* length filter: a block with fewer than ``need`` words of templates is none's;
* prefix filter: two sets that share ``need`` words share one among the first size - need + 1 words of each, so only those are joined;
* positional filter: a shared word at place i of one and j of the other leaves at most 1 + min(rest, rest) shared words; a pair whose
  every joined word leaves too few is dropped (its first shared word never does, if the pair belongs to the result).

What is left is counted in full. Base phrases (exact word sequences) are found beside, in the same pass over the texts.

Only built-in functions. The texts are read and cut once; what goes on are a few words a document. A row's number is its key, so no key
is hot; only the templates' own table, whose size the caller's list fixes, is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Separates words once A-Z are lower case; the texts' own letters A-Z belong to words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTHS = (16, 32, 64, 256)
THRESHOLD = 0.95

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and of the usual notices, with their public short names.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def compiled(templates: tuple[tuple[str, str], ...], threshold: float) -> list[dict]:
    """label, words (distinct, sorted), need and width of every template."""
    out = []
    for label, text in templates:
        words = template_words(text)
        if not words:
            raise ValueError(f"the template of {label} has no words")
        found = sorted(set(words))
        width = next((w for w in WIDTHS if w >= 2 * len(words)), None) or 1 << (2 * len(words) - 1).bit_length()
        out.append({"label": label, "words": found, "need": ceil(round(threshold * len(found), 9)), "width": width})
    return out


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # two letters become ASCII in lower case: with them, A-Z alone are mapped
    odd = text.contains("İ") | text.contains("K")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def phrase_places(words: Column, known: Column, phrase: str) -> Column:
    """The words' numbers (from 0) at which a phrase starts. known: the words of templates and phrases that the text has."""
    parts = template_words(phrase)
    last = F.size(words) - len(parts)
    there = F.lit(True)
    for p in parts:
        there = there & F.array_contains(known, p)

    def starts(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    return F.when(there & (last >= 0), F.filter(F.sequence(F.lit(0), last), starts)).otherwise(F.array().cast("array<int>"))


def labelled(label: str) -> Callable[[Column], Column]:
    return lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))


def block_at(words: Column, width: int, vocabulary: list[str]) -> Callable[[Column], Column]:
    """The block of a number: its width, number and distinct words that the vocabulary has."""
    return lambda no: F.struct(F.lit(width).alias("width"), no.alias("no"), F.array_intersect(F.slice(words, no * (width // 2) + 1, width), texts(vocabulary)).alias("words"))


def long_enough(blocks: Column, least: int) -> Column:
    """The length filter."""
    return F.filter(blocks, lambda b: F.size(b["words"]) >= least)


def text_facts(documents: DataFrame, compiled_templates: list[dict], phrases: dict[str, str]) -> DataFrame:
    """One row for each row of documents, written: rid (its number), doc_id, n_words, known (distinct words of templates or phrases), places (start and
    label of every base phrase) and blocks (width, no, words) that pass the length filter.

    A text whose words of templates cannot make up any template of a width has no block of that width, as a block has no more of them than its text.
    """
    vocabulary = sorted({w for t in compiled_templates for w in t["words"]} | {w for p in phrases for w in template_words(p)})
    words, known = F.col("words"), F.col("known")
    read = documents.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("known", F.array_intersect("words", texts(vocabulary)))
    places = [F.transform(phrase_places(words, known, p), labelled(label)) for p, label in phrases.items()]
    blocks = []
    for width in sorted({t["width"] for t in compiled_templates}):
        mine = [t for t in compiled_templates if t["width"] == width]
        least, vocabulary = min(t["need"] for t in mine), sorted({w for t in mine for w in t["words"]})
        possible = F.lit(False)
        for t in mine:
            possible = possible | (F.size(F.array_intersect(known, texts(t["words"]))) >= t["need"])

        count = F.greatest(F.ceil(F.size(words) / (width // 2)) - 1, F.lit(1)).cast("int")
        cut = long_enough(F.transform(F.sequence(F.lit(0), count - 1), block_at(words, width, vocabulary)), least)
        blocks.append(F.when(possible, cut).otherwise(F.array()).cast("array<struct<width:int,no:int,words:array<string>>>"))
    facts = read.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), "known",
        (F.concat(*places) if places else F.array()).cast("array<struct<start:int,label:string>>").alias("places"), F.concat(*blocks).alias("blocks"),
    )
    return written(facts, "license-facts")


def matching_blocks(facts: DataFrame, compiled_templates: list[dict]) -> DataFrame:
    """rid, width, no, label, shared and size of every block that holds a template: the join."""
    spark = facts.sparkSession
    counted = facts.select(F.explode("known").alias("word")).groupBy("word").count()
    # one row for each word of the templates at most
    frequency = {r["word"]: r["count"] for r in counted.collect()}
    order = sorted({w for t in compiled_templates for w in t["words"]}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    rows = []
    for n, t in enumerate(compiled_templates):
        mine = sorted(rank[w] for w in t["words"])
        prefix = mine[: len(mine) - t["need"] + 1]
        rows += [(t["width"], r, n, i, len(mine), t["need"], t["label"], mine) for i, r in enumerate(prefix)]
    schema = "width int, rank int, template int, i int, size int, need int, label string, ranks array<int>"
    index = F.broadcast(spark.createDataFrame(rows, schema))
    blocks = facts.select("rid", F.explode("blocks").alias("b")).select("rid", "b.width", "b.no", F.col("b.words").alias("words"))
    ordered = F.array_sort(F.filter(F.transform("words", lambda w: F.array_position(texts(order), w).cast("int")), lambda r: r > 0))
    least = F.lit(None).cast("int")
    for width in sorted({t["width"] for t in compiled_templates}):
        least = F.when(F.col("width") == width, min(t["need"] for t in compiled_templates if t["width"] == width)).otherwise(least)
    # the longest prefix that any template of the width asks for; each template's own is tested below
    blocks = blocks.select("rid", "width", "no", ordered.alias("held"))
    blocks = blocks.select("rid", "width", "no", "held", F.posexplode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("j", "rank"))
    own, theirs = F.col("size") - F.col("i") - 1, F.size("held") - F.col("j") - 1
    filters = (F.size("held") >= F.col("need")) & (F.col("j") <= F.size("held") - F.col("need")) & (F.least(own, theirs) + 1 >= F.col("need"))
    candidates = blocks.join(index, ["width", "rank"]).filter(filters)
    counted = candidates.withColumn("shared", F.size(F.array_intersect("held", "ranks"))).filter("shared >= need")
    return counted.select("rid", "width", "no", "template", "label", "shared", "size").distinct()


def license_scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (start and label of every base phrase, by start), matches (width, no, label, containment of every block that holds a
    template; block no starts at word no * width / 2) of every row.

    A null or empty text has no words, places or matches. Repeated rows get a result each, null ids stay null, no rows give no rows; other columns
    are not read. A long text is cut into blocks whole. A text shorter than a block is one block. threshold is above 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    ready = compiled(templates, threshold)
    facts = text_facts(documents, ready, PHRASES if phrases is None else phrases)
    found = matching_blocks(facts, ready)
    match = F.struct("width", "no", "label", (F.col("shared") / F.col("size")).alias("containment"))
    per_row = found.groupBy("rid").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    rows = facts.select("rid", "doc_id", "n_words", F.sort_array("places").alias("places")).join(per_row, "rid", "left").drop("rid")
    return rows.withColumn("matches", F.coalesce("matches", F.array().cast(per_row.schema["matches"].dataType)))


def license_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score: 1 with a base phrase, else the greatest containment of a template, 0 without any.
    """
    rows = license_scan(documents)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, more = F.col("places.label"), F.col("matches.label")
    best = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def _oracle() -> str:
    ready = compiled(TEMPLATES, THRESHOLD)
    token = ",".join(f"({n},'{t['label']}',{t['need']},{len(t['words'])},{t['width']},'{w}')" for n, t in enumerate(ready) for w in t["words"])
    phrase = ",".join(f"('{label}', {template_words(p)!r})" for p, label in PHRASES.items())
    return f"""
with d as (select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
w as (select rid, unnest(ws) as word, unnest(range(len(ws))) as pos, len(ws) as n from d),
tk(template, label, need, size, width, word) as (values {token}),
hit as (select distinct rid, pos, n, template, label, need, size, width, word from w join tk using (word)),
blk as (select *, unnest([pos // (width // 2) - 1, pos // (width // 2)]) as no from hit),
per as (select rid, label, size, count(distinct word) as shared from blk where no = 0 or (no > 0 and no <= ceil(n / (width / 2)) - 2)
  group by rid, template, label, need, size, no having count(distinct word) >= need),
ph(label, parts) as (values {phrase}),
pl as (select rid, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(parts)] = parts)) as pos from d, ph),
b as (select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from pl group by rid),
lb as (select rid, string_agg(distinct label, ',' order by label) as labels from (select rid, label from pl union all select rid, label from per) group by rid),
sc as (select rid, max(shared / size) as best from per group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from d left join b using (rid) left join lb using (rid) left join sc using (rid)
"""


ORACLE = _oracle()
