"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes, modulo a table size, of single words, neighbouring pairs and pairs with one word between;
words are runs of letters, digits and non-ASCII characters, lower-cased. Per-coordinate rates and the L1 term leave few
weights that are not zero, and these alone are broadcast (at most ``table`` of them) to score all documents.

The model is fit on a bounded sample: at most ``max_labelled`` labelled documents, taken by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PUNCTUATED, mix, text_chunks, word_hashes

KINDS = tuple(np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xB492B66FBE98F273))


def text_features(texts: pa.Array, table: int) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each text; none for a text without words."""
    for _, data, ends in text_chunks(texts):
        words, counts = word_hashes(data, ends, PUNCTUATED)
        for w in np.split(words, np.cumsum(counts)[:-1]):
            grams = [mix(w ^ KINDS[0]), mix(w[:-1] * KINDS[1] + w[1:]), mix(w[:-2] * KINDS[2] + w[2:])]
            yield np.unique(np.concatenate(grams) % np.uint64(table)).astype(np.int64)


def ftrl_fit(
    features: list[np.ndarray], labels: np.ndarray, table: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0, epochs: int = 5
) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the weights that are not zero, and the bias. Documents are taken in the given order."""
    z, n = np.zeros(table + 1), np.zeros(table + 1)
    penalty = np.full(table + 1, l1)
    penalty[table] = 0.0  # the bias
    for _ in range(epochs):
        for x, y in zip(features, labels):
            x = np.append(x, table)
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= penalty[x], 0.0, -(zx - np.sign(zx) * penalty[x]) / ((beta + root) / alpha + l2))
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
    w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))
    used = np.flatnonzero(w[:table])
    return used, w[used], float(w[table])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", table: int = 1 << 18, max_labelled: int = 20_000, **ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled documents (label 0 or 1; null labels are left out, a doc_id with both counts as 1; of a repeated doc_id the text with the least hash is taken)."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    known = known.withColumn("_h", F.xxhash64(F.col("doc_id"))).orderBy("_h").limit(max_labelled)
    # max_labelled rows of three numbers at most, so it may be broadcast
    sample = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("_h", "text", "_y", F.xxhash64("text").alias("_t"))
    # of a repeated doc_id the text of the least hash, once: however many rows have the id and in whatever order they come, one goes on
    least = F.broadcast(sample.groupBy("_h").agg(F.min("_t").alias("_t")))
    sample = sample.join(least, ["_h", "_t"]).dropDuplicates(["_h", "_t"]).select("_h", "text", "_y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.astype(np.int32) for x in text_features(b.column("text"), table)]
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("_y"), pa.array(found, pa.list_(pa.int32()))], names=["h", "y", "x"])

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending")])
        lists = group["x"].combine_chunks()
        x = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
        used, values, bias = ftrl_fit(x, group["y"].to_numpy(), table, **ftrl)
        return pa.table({"number": np.append(used, table).astype(np.int64), "weight": np.append(values, bias).astype(np.float64)})

    prepared = sample.mapInArrow(features, "h long, y int, x array<int>")
    weights = prepared.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "number long, weight double").toPandas()
    if weights.empty:
        return np.empty(0, np.int64), np.empty(0), 0.0
    inner = weights[weights["number"] < table]
    return inner["number"].to_numpy(np.int64), inner["weight"].to_numpy(float), float(weights.loc[weights["number"] == table, "weight"].iloc[0])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], table: int = 1 << 18) -> DataFrame:
    """All columns of the documents and ``toxicity`` (0 to 1), from the whole text. A null or empty text scores by the bias alone.

    A column already named toxicity is replaced.
    """
    documents = documents.drop("toxicity")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, values, bias = shared.value
        dense = np.zeros(table)
        dense[numbers] = values
        for b in batches:
            logits = np.array([dense[x].sum() + bias for x in text_features(b.column("text"), table)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35))), pa.float64())], names=[*b.schema.names, "toxicity"])

    return documents.mapInArrow(scored, documents.select("*", F.lit(0.0).alias("toxicity")).schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """All columns of the documents, toxicity, held_out and predicted (1 from ``threshold``).

    Labels are learned only from documents whose crc32(doc_id as text) mod 4 is not 2. Repeated rows score alike; a null doc_id
    is not held out. Without labelled documents every score is 0.5. Columns already named like the added ones are replaced.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(documents, labels.filter(remainder != 2), **options)
    scored = score(documents, model, options.get("table", 1 << 18))
    scored = scored.withColumn("held_out", F.coalesce(remainder == 2, F.lit(False)))
    return scored.withColumn("predicted", (F.col("toxicity") >= threshold).cast("int"))
