"""Best-fit packing against the tokenizer library and against what any packing must hold to."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assetflow.llm import best_fit_packing as B

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


def holds(rows, capacity):
    """Pieces of a sequence follow each other from 0 on, up to capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_the_librarys(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {d: ids for d, ids in zip([r[0] for r in docs.collect()], library([r["text"] for r in docs.collect()]), strict=True)}
    packed = B.pack(docs, PATH)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    seen = defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append(r)
    assert seen.keys() == want.keys()
    for doc_id, ids in want.items():
        parts = sorted(seen[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(math.ceil(len(ids) / 2048)))
        for r in parts:
            own = ids[r["start"] : r["start"] + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(own), zlib.crc32(own.tobytes()))
    assert holds(rows, 2048) <= math.ceil(sum(map(len, want.values())) / 2048) + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, B.pack(docs.repartition(7), PATH).collect()))


def test_odd_texts(spark, odd, none):
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame([
        (20, "It's 12 o'clock; été ́  em nbsp\x1cfs İİ Σσς <|endoftext|> x<|startoftext|>y"), (21, "a" * 3000 + " " + "漢" * 400 + " tail"), (22, "한글 \U0001f600‍\U0001f469 \r\n\x0b\x0c end")], "doc_id bigint, text string"))
    rows = more.collect()
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in B.pieces(more, PATH, 2048, 0).collect())
    want = Counter((r["doc_id"], s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for r, ids in zip(rows, library([r["text"] for r in rows]), strict=True) for s in range(0, len(ids), 2048))
    assert got == want
    holds(B.pack(odd, PATH).collect(), 2048)
    assert B.pack(none, PATH).collect() == []


def test_sequences_hold_the_tokens(spark):
    texts = [(i, "alpha beta " * (i % 7) + "gamma") for i in range(60)]
    packed = B.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, 32, ids=True)
    found = B.sequences(packed).collect()
    tokens = dict(enumerate(map(list, library([t for _, t in texts]))))
    assert sorted(d for r in found for d in r["doc_ids"]) == list(range(60))
    for r in found:
        assert r["ids"] == [int(i) for d in r["doc_ids"] for i in tokens[d]] and len(r["ids"]) <= 32


@pytest.mark.parametrize("seed", range(30))
def test_patterns(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 16, 64])
    counts = Counter(r.randint(1, capacity) if seed % 2 else min(capacity, 1 + int(r.expovariate(4 / capacity))) for _ in range(r.randrange(1, 400)))
    made = B.patterns(counts, capacity)
    total = Counter()
    for times, uses in made:
        assert times > 0 and sum(k * n for k, n in uses.items()) <= capacity
        for k, n in uses.items():
            total[k] += times * n
    assert total == counts
    assert sum(times for times, _ in made) <= 11 / 9 * max(math.ceil(sum(k * n for k, n in counts.items()) / capacity), sum(n for k, n in counts.items() if 2 * k > capacity)) + 1


def test_exact_complements_are_found():
    lengths = [1, 2, 3, 5, 8, 9, 9]
    for gap in range(1, 40):
        want = next((n for n in (1, 2, 3) if any(sum(c) == gap for c in __import__("itertools").combinations(lengths, n))), 0)
        found = B.Stock(Counter(lengths), 40).exact(gap)
        assert len(found) == want and (not want or sum(found) == gap and not Counter(found) - Counter(lengths))


def test_a_length_that_most_share(spark, monkeypatch):
    monkeypatch.setattr(B, "BUCKET", 50)
    items = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 90 + 1).alias("length"), F.lit("x").alias("offset"), F.lit("y").alias("__number"))
    rows = B.best_fit(items.drop("__number"), 100, "doc_id").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert holds(rows, 100) <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 100)
