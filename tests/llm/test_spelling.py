"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetflow.llm import spelling_variants as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, one_in=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    found, forms = {}, {}
    for w in words:
        close = set().union(cuts.get(w, set()), *(cuts[c] | {c} & words.keys() for c in (w[:i] + w[i + 1 :] for i in range(len(w)))))
        found[w] = sorted((x for x in close if near(w, x)), key=lambda x: (-words[x], x))
        forms[w] = found[w][0] if found[w] and words[found[w][0]] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(found[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, S.spelling_variants(docs).collect())) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_many_near_words(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 300)
    monkeypatch.setattr(S, "SHARED", 10)
    monkeypatch.setattr(S, "COUNTED", 7)
    r = random.Random(seed)
    word = lambda: ("samehalf" if r.random() < 0.4 else "") + "".join(r.choice("abé") for _ in range(r.randrange(4, 8)))
    rows = [(i, " ".join(word() for _ in range(40)).title() + "; ×÷ÿ ÉCOLE") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.spelling_variants(docs, one_in=5).collect())) == plain(rows, 5)


def test_odd_texts(spark, odd, none):
    docs = odd.select("doc_id", "text", F.lit("w").alias("word"), F.lit(1).alias("n"))
    long = spark.createDataFrame([(30, f"{'x' * 40_000} {'x' * 40_001}") for _ in range(3)], "doc_id long, text string")
    docs = docs.unionByName(long, allowMissingColumns=True).unionByName(docs).unionByName(docs)
    got = sorted(map(tuple, S.spelling_variants(docs).collect()))
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert [r[4] for r in got if len(r[0]) in (40_000, 40_001)] == [1, 1]
    assert S.spelling_variants(none).collect() == []


def test_chains_of_forms(spark):
    rows = [("a" * (5 + i), "a" * (6 + i) if i < 20 else None) for i in range(21)]
    got = S.roots(spark.createDataFrame(rows, "word string, form string"), 1 << 21).collect()
    assert {r["root"] for r in got} == {"a" * 25} and len(got) == 21


@pytest.mark.parametrize("more", [True, False])
def test_index(more):
    r = random.Random(2)
    for _ in range(60):
        words = list({"".join(r.choice("abcé"[: r.randrange(1, 5)]) for _ in range(r.randrange(4, 9))) for _ in range(r.randrange(1, 60))})
        asked = list({"".join(r.choice("abcdé") for _ in range(r.randrange(4, 9))) for _ in range(20)} | set(words[:20]))
        index = S.Index(words)
        got = [(asked[q], index.words[w]) for q, w in zip(*index.one_edit(asked, more), strict=True)]
        assert sorted(got) == sorted((p, w) for p in asked for w in words if near(p, w) and w.endswith(p[len(p) - (len(p) + more) // 2 :]))
