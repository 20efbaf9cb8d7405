"""The registered queries of this folder: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, byte_bpe, embedding_whitening, license_scan, line_dedup, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, spelling_variants, token_counts, topk_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Remainder by which documents are held out; a null doc_id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_equal", "n_near", F.md5("text").alias("text_md5"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(documents, ranks, public_tokenizers.PATTERN, digests=True).drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_counts.flat_token_files(table(spark, sf_dir, "documents"))
    return token_counts.token_counts(files).select("doc_id", "n_tokens")


def classifier(spark: SparkSession, sf_dir: str) -> quality_classifier.Model:
    """The quality model, learned from the labelled documents that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(fold() != 0)
    return quality_classifier.train(table(spark, sf_dir, "documents"), labels)


#: Least score of a document that counts as good.
GOOD = 0.3


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score(table(spark, sf_dir, "documents").select("doc_id", "text"), classifier(spark, sf_dir))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold_1 = "coalesce(crc32(cast(doc_id as string)) % 5, 0) = 1"
    scored = lm_scoring.lm_scores(table(spark, sf_dir, "documents"), f"not ({fold_1})", "pmod(xxhash64(doc_id), 10) = 0")
    return scored.withColumn("held_out", fold() == 1)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op9_license_scan": license_scan.sql(),
    "op10_mixing": mixing.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
    "op2_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS t FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.t, c.t)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_token_counts": "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_tokens FROM documents",
}
