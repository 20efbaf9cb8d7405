"""A corpus from raw documents to token identifiers, in stages of the operators of assetflow.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm import byte_bpe, line_dedup, mixing, ngram_join, quality_classifier
from assetflow.llm.queries import GOOD, classifier, table
from assetflow.llm.shared import written


def _free(docs: DataFrame, name: str) -> str:
    """The name, behind as many underscores as it takes to be no column of docs."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with their own columns, whatever their names.

    Null and empty texts are scored as texts without words; rows repeat as they stand, and null doc_ids stay.
    """
    score = _free(docs, "quality_score")
    scored = quality_classifier.score(docs, classifier(spark, sf_dir), output=score)
    return scored.where(F.col(score) >= GOOD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; those that lose every line go.

    Texts that have no line with a word stay, null ones too, and so do rows without a doc_id, unchanged; n_chars is that
    of the new text, and every other column stays, also one named like a count of the operator.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    kept = line_dedup.line_dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *others).alias("others"))).where("n_lines = 0 or n_lines > n_equal + n_near")
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars")
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else n_chars if c == "n_chars" else F.col("others").getField(c).alias(c) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id; rows without a doc_id stay only where none with one is near.

    Empty texts are near nothing.
    """
    kept = ngram_join.near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: some sources' repeated, others' thinned out.

    A null source is a source and stands last.  Rows of one doc_id, null too, are taken alike; texts without a word are taken
    with their block, as often as whole blocks are.  Columns stay, whatever their names.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every document (little-endian unsigned 32-bit), and whether they decode to its text.

    A null text counts as empty and has no identifiers; every row, repeated or not, has one of its own.  Of the
    documents' columns doc_id, lang and source go on, the others don't.
    """
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="__decoded")
    same = F.col("__decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near), ("mixing to target weights", mix), ("byte-level BPE", tokens)]

#: SQL can't express the classifier; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
