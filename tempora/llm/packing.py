"""Best-fit packing of token sequences under several capacities at once (vector best-fit).

A bin is a training sequence with three capacities: tokens, documents and attention cost (the sum of squared
lengths). Items are dealt to groups of bounded size by their row numbers, so equal or null keys do not matter and neighbours in
the input's order share sequences, and each group is packed by itself: longest item first, into the open bin where it fits under
**every** capacity and that scores best. ``rule="norm"`` takes the least weighted norm of what would remain, ``rule="dot"`` the
largest weighted dot product of item and residual. Documents of different groups never share a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, unused
from .tokens import encoded_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, vocabulary: str, end_id: int, max_tokens: int) -> DataFrame:
    """One row per piece of at most ``max_tokens`` ids of each document's ids and ``end_id``.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids in encoded_batches(batches, vocabulary, False, end_id, max_pieces=500_000, chunk_bytes=4_000_000):
            rows = [
                (doc, k, s, min(max_tokens, len(x) - s), zlib.crc32(x[s : s + max_tokens].astype("<u4").tobytes()))
                for doc, x in zip(chunk.column("doc_id").to_pylist(), ids)
                for k, s in enumerate(range(0, len(x), max_tokens))
            ]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def vector_best_fit(
    lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item; items are taken longest first, ties in the given order."""
    n = len(lengths)
    size = np.array([max_tokens, max_docs, max_cost], float)
    w = np.array(weights, float)
    need = np.column_stack([lengths, np.ones(n), lengths.astype(float) ** 2]) / size
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((max(n, 1), 3))
    filled = np.zeros(max(n, 1), np.int64)
    opened = 0
    active = np.empty(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = need[order[-1]] if n else None
    for i in order:
        room = left[active] - need[i]
        fits = np.flatnonzero((room >= -1e-12).all(axis=1))
        if len(fits):
            score = -(w * room[fits] ** 2).sum(axis=1) if rule == "norm" else (w * left[active[fits]] * need[i]).sum(axis=1)
            b = active[fits[np.argmax(score)]]
        else:
            b = opened
            left[b] = 1.0
            opened += 1
            active = np.append(active, b)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += lengths[i]
        left[b] -= need[i]
        if (left[b] < smallest - 1e-12).any():  # nothing fits any more
            active = active[active != b]
    return bins, offsets


def pack(
    items: DataFrame,
    max_tokens: int = 4096,
    max_docs: int | None = None,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25),
    rule: str = "norm",
    group_items: int = 20_000,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items that have a ``length`` of 1 to ``max_tokens``; columns of these names are replaced.

    max_docs and max_cost default to the most that max_tokens allows, so that they rule nothing out but still weigh in the choice of
    a bin. group_items: the most items packed together. Items of ``max_tokens`` take a sequence of their own without a search. Rows
    that are equal are items of their own; nulls are allowed. No items give no rows. The items are written to the shared folder
    once, as they are counted before they are dealt out.
    """
    max_docs = max_docs or max_tokens
    max_cost = max_cost or float(max_tokens) ** 2
    items = items.drop("sequence_id", "offset")
    row, group = unused("row", items), unused("group", items)
    placed = numbered(items, "items", row)
    n = placed.count()
    groups = max(1, -(-n // group_items))
    schema = f"{items.schema.simpleString()[7:-1].replace(':', ' ')}, sequence_id long, offset long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row).reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        full = lengths == max_tokens
        bins, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        bins[~full], offsets[~full] = vector_best_fit(lengths[~full], max_tokens, max_docs, max_cost, weights, rule)
        bins[full] = np.arange(full.sum()) + (bins[~full].max() + 1 if (~full).any() else 0)
        return pdf.drop(columns=[row, group]).assign(sequence_id=(pdf[group].to_numpy(np.int64) << 32) + bins, offset=offsets)

    dealt = placed.withColumn(group, F.expr(f"{row} * {groups} div {max(n, 1)}"))
    return dealt.groupBy(group).applyInPandas(one, schema)


def pack_documents(documents: DataFrame, vocabulary: str, end_id: int = 1, max_tokens: int = 4096, **limits) -> DataFrame:
    """Tokenize, cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document, null and empty texts included, is packed; repeated rows are packed again. Other columns are not looked at.
    """
    return pack(token_pieces(documents, vocabulary, end_id, max_tokens), max_tokens, **limits)
