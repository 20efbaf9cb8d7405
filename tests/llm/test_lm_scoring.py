"""Language-model scores against dictionaries."""

import re
import zlib
from collections import Counter
from math import log2, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetflow.llm import lm_scoring
from assetflow.llm.queries import QUERIES

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def check(rows, got, learns):
    one, two, ctx = Counter(), Counter(), Counter()
    for d, t in rows:
        if learns(d):
            x = tokens(t)
            one.update(x)
            pairs = list(zip([1, *x], x, strict=False))
            two.update(pairs)
            ctx.update(p[0] for p in pairs)
    n, v = sum(one.values()), len(one)
    want = sorted((str(d), len(tokens(t)), sum(one[w] > 0 for w in tokens(t)), n, round(sum(log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("block", [24 << 20, 20_000])
def test_query_matches_plain_counts(spark, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op8_lm_scoring"](spark, sf).collect()
    check(rows, got, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
    new = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


def model(rows, learns, held):
    """Deleted interpolation by dictionaries: the probability of a word after a context, and the words known."""
    counts = {kind: (Counter(), Counter(), Counter()) for kind in ("all", "held")}
    for d, t in rows:
        for kind in ["all", *["held"] * held(d)] if learns(d) else []:
            x = tokens(t)
            for c, found in zip(counts[kind], (x, list(zip([1, *x], x, strict=False)), [1, *x][: len(x)]), strict=True):
                c.update(found)
    one, two, context = counts["all"]
    rest = [Counter({k: n - h[k] for k, n in c.items()}) for c, h in zip(counts["all"], counts["held"], strict=True)]
    n, v = sum(one.values()), len(one)
    bucket = lambda c: min(lm_scoring.BUCKETS - 1, 1 + int(log2(c))) if c > 0 else 0
    rounded = lambda p: 2.0 ** (round(log2(p) * lm_scoring.FINE) / lm_scoring.FINE) if p else 0.0
    seen = [[] for _ in range(lm_scoring.BUCKETS)]
    for d, t in rows:
        if learns(d) and held(d):
            x = tokens(t)
            for h, w in zip([1, *x], x, strict=False):
                c = rest[2][h]
                seen[bucket(c)].append((rounded(rest[1][h, w] / max(1, c)), rounded(rest[0][w] / sum(rest[0].values())), 1 / (v + 1)))
    weights = [[0.4, 0.5, 0.1] for _ in seen]
    weights[0] = [0.0, 0.9, 0.1]
    for b, estimates in enumerate(seen):
        if not estimates and b:
            weights[b] = weights[b - 1]
        for _ in range(lm_scoring.ROUNDS if estimates else 0):
            share = [0.0] * 3
            for e in estimates:
                total = sum(x * y for x, y in zip(e, weights[b], strict=True))
                share = [s + x * y / total for s, x, y in zip(share, e, weights[b], strict=True)]
            share = [s / len(estimates) for s in share]
            share[2] = max(share[2], 1e-4)
            weights[b] = [s / sum(share) for s in share]

    def probability(h, w):
        a, b, c = weights[bucket(context[h])]
        return a * two[h, w] / max(1, context[h]) + b * one[w] / n + c / (v + 1)

    return probability, set(one)


def test_scores_and_learned_weights_match_dictionaries(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    learns, held = lambda d: d % 7 != 3, lambda d: d % 5 == 0
    probability, _ = model(rows, learns, held)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(df, "doc_id % 7 <> 3", "doc_id % 5 = 0").collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        x = tokens(t)
        assert got[d] == pytest.approx(sum(log10(probability(h, w)) for h, w in zip([1, *x], x, strict=False)), rel=1e-6)


def test_probabilities_add_up(spark):
    """The interpolated probabilities of all words after a context, the end and one unknown word among them, add up to 1."""
    train = [(1, "a b a c a b"), (2, "b a"), (3, "c c a b")]
    probability, known = model(train, lambda d: True, lambda d: d == 2)
    for h in (1, "a", "b", "c"):
        assert sum(probability(h, w) for w in [*known, "zz"]) == pytest.approx(1)
    words = ["a", "b", "c", "zz"]
    asked = [(10 + i, f"a {w}") for i, w in enumerate(words)] + [(9, "a")]
    scored = lm_scoring.lm_scores(spark.createDataFrame(train + asked, "doc_id long, text string"), "doc_id < 5", "doc_id = 2")
    got = {r["doc_id"]: 10 ** r["score"] for r in scored.collect()}
    start = probability(1, "a")
    ended = {w: probability(w, None) for w in words}
    assert sum(got[10 + i] / start / ended[w] for i, w in enumerate(words)) + got[9] / start == pytest.approx(1)


def test_long_texts_lie_in_blocks_of_their_own(spark, tmp_path, monkeypatch):
    """A run of long texts doesn't make a block of more than four times the bytes asked for."""
    rows = [(i, "ab " * (4000 if i % 100 > 90 else 40)) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    bound = int(100 * sum(len(t) for _, t in rows) / len(rows))
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", bound)
    placed, _ = lm_scoring._placed(spark.read.parquet(str(tmp_path / "d")), "true", "doc_id % 10 = 0")
    assert max(r["s"] for r in placed.groupBy("block").agg(F.sum(F.octet_length("text")).alias("s")).collect()) <= 4 * bound


def test_odd_rows(spark, odd, none):
    got = lm_scoring.lm_scores(odd, "doc_id <> 8", "doc_id = 1").collect()
    assert len(got) == len(ODD)
    check([(d, t) for d, t, *_ in ODD], got, lambda d: d is not None and d != 8)
    assert lm_scoring.lm_scores(none, "true", "true").count() == 0
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in lm_scoring.lm_scores(odd, "false", "true").collect())


def test_weights_favour_the_better_estimate():
    w = lm_scoring.learn_weights(np.array([3, 3]), np.array([-1, -8]), np.array([-80, -80]), np.array([90, 10]), 1e-6)
    assert w[3, 0] > 0.9 and np.allclose(w.sum(1), 1) and np.allclose(w[5], w[3])


def test_no_partition_grows_with_one_context(spark):
    """A word that precedes half of all distinct words does not fill one partition, and its counts are right."""
    rows = [(d, " ".join(f"| u{d}x{i}" for i in range(200))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = df.selectExpr("text", "doc_id % 8 as block", "true as train", "doc_id % 10 = 0 as held")
    size = {}
    for r in lm_scoring._requests(placed, 16).collect():
        size[r["part"]] = size.get(r["part"], 0) + sum(len(x) for x in r if isinstance(x, (bytes, bytearray)))
    assert max(size.values()) < 1.5 * sum(size.values()) / 16
    check(rows, lm_scoring.lm_scores(df, "doc_id < 30", "doc_id = 2").collect(), lambda d: d < 30)
