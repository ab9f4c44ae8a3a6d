"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every result is written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import line_dedup, mixing, ngram_join, packing, toxicity
from tempora.llm.common import table, written
from tempora.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go; null and empty texts score by the bias alone. The model is fit on the stage's own labelled documents."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines of recurring templates, repeated short lines and recurring passages go; n_chars follows the text. A document
    without any word left goes too, if it lost some."""
    kept = line_dedup.drop_recurring_text(docs)
    changed = (F.col("n_dropped") > 0) | (F.col("n_words_dropped") > 0)
    emptied = changed & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return kept.filter(~emptied).select("doc_id", "text", "lang", "source", n_chars)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of the documents that links join, the one with the smallest doc_id stays.

    Documents without an id, and those with the empty set, all stay; rows that repeat the kept id stay with it.
    """
    groups = ngram_join.ngram_jaccard_groups(docs)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents repeated or left out so that the sources' words come near their targets.

    Rows are laid out shard by shard and, within one, in its order, so neighbours in the files are neighbours in the mixture: the next
    stage packs runs of them together.
    """
    mixed = mixing.mixed_documents(docs)
    return mixed.repartitionByRange("shard", "shard_order").sortWithinPartitions("shard", "shard_order").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of all documents and their places in sequences of 4096 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, max_tokens=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the trained scores, the mixing draws or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
