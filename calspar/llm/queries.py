"""The thirteen operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, codes, decontaminate, jaccard, kdtree, langid, lines, matroska, packing, quality, repeats, sharding, tokens


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from four fifths of them."""
    return langid.language_id(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat, but for a word, an earlier one."""
    return lines.line_digest(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of three quarters of them."""
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents."""
    return tokens.token_counts(documents(spark, sf_dir), word_bpe(), limit=2048)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all documents lie in 10-word windows of benchmark items."""
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word windows that an earlier document has."""
    return repeats.repeat_digest(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 5-word shingles have a similarity of 0.75 or more."""
    return jaccard.similar_components(documents(spark, sf_dir), 5, 75)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with id 2 at its end, in sequences of 4096 ids."""
    return packing.packed_digest(packing.pack(documents(spark, sf_dir), word_bpe(), end_id=2, length=4096))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of near equal bytes, equal texts together."""
    return sharding.shard_documents(documents(spark, sf_dir), 16)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as Matroska files and read back from their packets."""
    return matroska.media_digest(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source of all documents, in every order."""
    return audit.interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as four bytes each, by codebooks of 256 entries."""
    return codes.code_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every twentieth id."""
    return kdtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_id": op1_language_id, "op2_line_dedup": op2_line_dedup, "op3_quality": op3_quality, "op4_token_counts": op4_token_counts, "op5_decontamination": op5_decontamination, "op6_substring_dedup": op6_substring_dedup, "op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op8_packing": op8_packing, "op9_sharding": op9_sharding, "op10_media_columns": op10_media_columns, "op11_filter_audit": op11_filter_audit, "op12_vector_codes": op12_vector_codes, "op13_exact_top_k": op13_exact_top_k}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op6_substring_dedup": repeats.ORACLE, "op7_ngram_jaccard_join": jaccard.ORACLE, "op11_filter_audit": audit.ORACLE, "op12_vector_codes": codes.ORACLE, "op13_exact_top_k": kdtree.ORACLE}
