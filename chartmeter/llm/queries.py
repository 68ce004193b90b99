"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmeter.llm import (
    decontaminate,
    html_text,
    manifest,
    packing,
    pieces,
    ppm,
    quality_rules,
    quality_trees,
    secret_scan,
    simhash,
    token_files,
    toxicity,
    vector_codes,
)
from chartmeter.llm.common import held_out
from chartmeter.shared import new_path
from chartmeter.llm.sql import ORACLES  # noqa: F401


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's SentencePiece ids and of the text they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode(docs, tokenizer("piece_bpe_32k.model"), decoded="decoded"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, as read back from the written files."""
    path = new_path(spark, "token-files")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write(docs, path, tokenizer("word_bpe_49k.json"), end=2)
    return token_files.read(spark, path, ids=False)


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by trees of the labelled ones outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_trees.quality_scores(docs, _table(spark, sf_dir, "labels")).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts per fixed pattern, their digest, and all spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs)

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labelled ones outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "passages",
    )


def op7_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, by the word counts and by partial matching."""
    return ppm.language_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), across=True)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item it contains."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, _table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, rule bits and the verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "failures",
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-part code of every vector, and how far the codes are off."""
    found = vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", vector_codes.code_text(F.col("codes")).alias("code"), "error", "label_error", "codebooks_sha256"
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 4,096 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end=1)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and its check of every document."""
    return manifest.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pieces": op2_pieces,
    "op3_token_files": op3_token_files,
    "op4_quality_trees": op4_quality_trees,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_language_scores": op7_language_scores,
    "op8_html_text": op8_html_text,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_manifest": op13_manifest,
}
