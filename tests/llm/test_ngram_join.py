"""The n-gram Jaccard join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from assetflow.llm import ngram_join
from assetflow.llm.components import components

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    a, b = root(i), root(j)
                    comp[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least.setdefault(root(i), set()).add(d)
    return sorted((d, len(x), min(y for y in least[root(i)])) for i, (d, x) in enumerate(sets))


def corpus(seed, n, families):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(14)]
    base = [[word() for _ in range(r.choice([4, 6, 9, 14, 30, 80, 200]))] for _ in range(families)]
    rows = []
    for i in range(n):
        x = list(r.choice(base)) if r.random() < 0.7 else [word() for _ in range(r.randrange(1, 60))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            k = r.randrange(len(x))
            x[k : k + r.randrange(2)] = [word()]
        if r.random() < 0.3:
            x = passage + x
        rows.append((i * 3 % 1009, (" ".join(x)).upper() if r.random() < 0.1 else "  ".join(x)))
    return rows


@pytest.mark.parametrize("light, side", [(64, 512), (3, 5)])
def test_matches_all_pairs(spark, monkeypatch, light, side):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "SIDE", side)
    rows = corpus(light, 500, 25)
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows)


def test_given_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(documents).collect())
    assert got == plain([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(spark, odd, none):
    got = ngram_join.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[1]["component_id"] == 1
    assert ngram_join.near_duplicates(none).count() == 0


def test_schemes_allow_the_most_differences():
    starts, schemes = ngram_join.bands(5000)
    for low, high, (m, allowed, slack, apart) in zip(starts, [*(starts[1:] - 1), None], schemes, strict=True):
        if high:
            for a in {low, (low + high) // 2, high}:
                assert max(ngram_join.most_apart(a, b) for b in range(a, a * 4 // 3 + 1)) <= apart
        assert m * (1 + allowed) >= apart + 1 + slack
    assert {s[1] for s in schemes} == {0, 1}
    assert np.all(np.diff(starts) > 0)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3}
    assert components(links.limit(0)).count() == 0


def test_links_go_through_a_null_doc_id(spark):
    words = [f"w{i}" for i in range(116)]
    rows = [(1, " ".join(words[:100])), (None, " ".join(words[8:108])), (2, " ".join(words[16:]))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, 1), (2, 1)}
