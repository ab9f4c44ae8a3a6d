"""Token-id files: one zstandard frame per document, all under one shared dictionary, with an index for direct access.

Format. A dataset has a dictionary file (``dictionary``: one row with the dictionary's bytes and their SHA-256) and
``blocks`` in doc_id order, each a row of: ``shard`` and ``block`` (their order is the documents' order), ``doc_ids``,
``n_tokens``, ``offsets`` (one more than documents; document i's frame is payload[offsets[i]:offsets[i+1]]),
``dictionary_sha256`` and ``payload``. A frame holds one document's ids as little-endian unsigned 32-bit integers, so a
short document is read by one slice and one small decompression. Spark writes the blocks, so lost executors'
half-written output never counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .tokens import encoded_batches, encoder

BLOCKS = (
    "shard int, block int, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, "
    "dictionary_sha256 string, payload binary"
)


def train_dictionary(
    documents: DataFrame, vocabulary: str, end_id: int, sample_docs: int = 1000, dictionary_bytes: int = 65_536, sample_chars: int = 20_000
) -> bytes:
    """A zstandard dictionary trained on the serialized ids of at most ``sample_docs`` documents of at most ``sample_chars`` characters.

    The sample is the documents least by a hash of id and text, so it does not depend on their order; a coarse cut of
    the hash keeps all but about four times as many from being sorted. Empty bytes where there is too little to
    train on: frames then stand alone.
    """
    documents = documents.filter(F.length("text") <= sample_chars)  # bounds the sample's bytes; a dictionary serves short documents
    share = max(1, documents.count() // (4 * sample_docs))
    keyed = documents.select("text", F.xxhash64("doc_id", "text").alias("_h"))
    picked = keyed.filter(F.pmod("_h", F.lit(share)) == 0).orderBy("_h", "text").limit(sample_docs).select("text")
    texts = [r.text or "" for r in picked.collect()]
    ids = [np.append(np.array(x, "<u4"), np.uint32(end_id)).astype("<u4") for x in encoder(vocabulary, True).whole(texts)]
    try:
        return zstandard.train_dictionary(dictionary_bytes, [x.tobytes() for x in ids]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(
    documents: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 0,
    level: int = 3,
    block_bytes: int = 4_000_000,
    sample_docs: int = 1000,
    dictionary_bytes: int = 65_536,
    shards: int | None = None,
) -> None:
    """Encode whole texts (null: empty), append ``end_id`` and write the format to ``path`` in ascending doc_id order.

    Null doc_ids come first; documents with equal ids are ordered by a hash of the text. No documents give files without blocks.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trained = train_dictionary(documents, vocabulary, end_id, sample_docs, dictionary_bytes)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(digest, trained)], "dictionary_sha256 string, bytes binary").write.parquet(f"{path}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        shard, block = TaskContext.get().partitionId(), 0
        docs, counts, kept, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
            row = [shard, block, docs, counts, offsets, digest, b"".join(kept)]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for chunk, ids in encoded_batches(batches, vocabulary, True, end_id):
            for doc, x in zip(chunk.column("doc_id").to_pylist(), ids):
                frame = squeeze.compress(x.astype("<u4").tobytes())
                docs.append(doc), counts.append(len(x)), kept.append(frame)
                held += len(frame)
                if held >= block_bytes:
                    yield flush()
                    block, docs, counts, kept, held = block + 1, [], [], [], 0
        if docs:
            yield flush()

    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = documents.repartitionByRange(shards or shuffle_partitions(spark), *order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(frames, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    trained = bytes(row["bytes"])
    if hashlib.sha256(trained).hexdigest() != row["dictionary_sha256"]:
        raise ValueError("the dictionary's hash differs from the one written with it")
    return trained


def read_document(row, i: int, trained: bytes) -> np.ndarray:
    """Document i of one block row, by its offsets alone."""
    if row["dictionary_sha256"] != hashlib.sha256(trained).hexdigest():
        raise ValueError("the block was written with another dictionary")
    part = bytes(row["payload"])[row["offsets"][i] : row["offsets"][i + 1]]
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None).decompress(part), "<u4")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<bigint>) of every document, from the files.

    start counts the ids of all documents before: block totals are summed over the small block index alone.
    """
    trained = read_dictionary(spark, path)
    digest = hashlib.sha256(trained).hexdigest()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = totals.groupBy("shard").agg(F.sum("n").alias("shard_n"))
    # one row per shard, as many as partitions were written
    bases = shards.withColumn("shard_base", F.sum("shard_n").over(Window.orderBy("shard")) - F.col("shard_n")).drop("shard_n")
    within = Window.partitionBy("shard").orderBy("block")
    starts = totals.withColumn("base", F.sum("n").over(within) - F.col("n")).drop("n").join(F.broadcast(bases), "shard")
    starts = starts.select("shard", "block", (F.col("base") + F.col("shard_base")).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expanding = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                if row.column("dictionary_sha256")[0].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                docs = row.column("doc_ids")[0].values
                offsets = row.column("offsets")[0].values.to_numpy()
                view = memoryview(row.column("payload")[0].as_buffer())
                base, out = row.column("base")[0].as_py(), []
                for i in range(len(docs)):
                    data = expanding.decompress(view[offsets[i] : offsets[i + 1]])
                    out.append((base, len(data) // 4, zlib.crc32(data), np.frombuffer(data, "<u4").astype(np.int64) if with_ids else None))
                    base += len(data) // 4
                columns = [docs, *(pa.array([x[k] for x in out], pa.int64()) for k in range(3))]
                if with_ids:
                    columns.append(pa.array([x[3] for x in out], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    # the index is small against the blocks (two numbers a block), but is joined by key, not broadcast
    return blocks.join(starts, ["shard", "block"]).select("doc_ids", "offsets", "dictionary_sha256", "payload", "base").mapInArrow(expand, schema)
