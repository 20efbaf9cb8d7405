"""The pipeline's stages, each on what the one before kept."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from assetflow.llm import byte_bpe
from assetflow.llm.mixing import mix
from assetflow.llm.queries import QUERIES

from .test_native import plain_dedup
from .test_ngram_join import plain

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    predicted = {r["doc_id"] for r in QUERIES["op7_quality_classifier"](spark, SF).collect() if r["predicted"]}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == predicted

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    gone = plain_dedup(rows, 8)
    left = corpus_pipeline.lines(spark, good, SF).cache()
    want = {}
    for d, t in rows:
        keep = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        if any(x.strip(" \t\x0b\f\r") for x in keep) or not t.strip():
            want[d] = "\n".join(keep)
    assert left.columns == columns and {r["doc_id"]: r["text"] for r in left.collect()} == want

    one = corpus_pipeline.near(spark, left, SF).cache()
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, _, c in plain(list(want.items())) if d == c)

    mixed = corpus_pipeline.mix(spark, one, SF).cache()
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert mixed.columns == columns
    assert all(abs(times.get(r["doc_id"], 0) * r["size"] - r["taken"]) <= r["size"] / 2 for r in mix(one).collect())

    coded = corpus_pipeline.tokens(spark, mixed, SF)
    assert coded.count() == mixed.count() and coded.where("not round_trip").count() == 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing to target weights", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], library.encode_ordinary(r["text"])) for r in docs.collect())
    got = sorted((r["doc_id"], [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]) for r in out.collect())
    assert got == want and out.where("not round_trip").count() == 0


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    """Also with further columns that are named as the stages' own are: they keep their values."""
    more = {c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("quality_score", "n_lines", "N_Equal", "n_near", "shard", "__n_lines", "__gone", "taken")}
    wide = odd.withColumns(more)
    for docs in (odd, none, wide):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert len(rows) <= 2 * docs.count()
            assert name == "byte-level BPE" or out.columns == docs.columns
            if docs is wide and name != "byte-level BPE":
                assert rows and all(r[c] == f"{c}{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in more)
