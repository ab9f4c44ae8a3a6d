"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprint, licenses, line_dedup, manifest, mixing, ngram_join, packing, quality, secrets, token_files, toxicity, url_filter
from .common import scratch_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_groups(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, max_tokens=4096)


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), "predicted")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long"), "copies", "shards")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is begun with the base rules and continued with all: the second scan finds every base pair there."""
    documents, ledger = table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger")
    secrets.scan_into_ledger(secrets.blob_versions(documents), ledger, secrets.BASE)
    found = secrets.secrets_by_document(documents, ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, path, with_ids=False)


def op9_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = alignment.align_tokenizers(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_best_fit_packing, op3_multiset_fingerprint, op4_ftrl_toxicity, op5_source_mixing, op6_secret_ledger,
    op7_url_trees, op8_token_files, op9_line_frequency_quality, op10_line_templates, op11_token_alignment,
    op12_license_join, op13_merkle_manifest,
)}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE, "op3_multiset_fingerprint": fingerprint.ORACLE, "op6_secret_ledger": secrets.ORACLE,
    "op9_line_frequency_quality": quality.ORACLE, "op10_line_templates": line_dedup.ORACLE,
    "op12_license_join": licenses.ORACLE, "op13_merkle_manifest": manifest.ORACLE,
}
