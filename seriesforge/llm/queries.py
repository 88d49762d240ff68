"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import encode_and_decode
from .common import table
from .decontam import find_passages
from .html_extract import extract_pages
from .line_dedup import dedup_lines
from .media import media_metadata, store_as_media
from .packing import pack_documents
from .secret_scan import scan_secrets
from .sharding import hilbert_shards
from .simhash import near_duplicate_components
from .spelling import spelling_variants
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .whitening import whiten


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "path", "word_no", "run_no", "candidate", F.round("score", 6).alias("score"), F.col("is_secret").cast("int").alias("is_secret"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def _remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4


def op5_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, table(spark, sf_dir, "labels").where(_remainder() != 2))
    out = score_toxicity(documents, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store_as_media(table(spark, sf_dir, "documents"), keep=["doc_id"])
    out = media_metadata(media, digests=True)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim("codec")),
        F.concat(F.lit("duration="), F.format_string("%.2f", "duration_s")),
        F.concat(F.lit("samples="), "n_samples"),
        F.concat(F.lit("keys="), F.concat_ws(",", F.transform("key_ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))))),
    )
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="removed_lines")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), 16)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling_variants(table(spark, sf_dir, "documents"), slip_every=97)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids_text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_main_text, op2_pattern_packing, op3_secret_forest, op4_hilbert_shards, op5_toxicity_zstd, op6_qgram_decontamination, op7_iso_media, op8_line_chunks, op9_simhash_components, op10_token_counts, op11_incremental_whitening, op12_spelling_variants, op13_bpe_codec)
}

ORACLE_SQL: dict[str, str] = {}
