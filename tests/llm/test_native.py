"""Line dedup, license scan and mixing against plain Python."""

import hashlib
import itertools
import re
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from assetflow.llm import license_scan, line_dedup, mixing, queries

from .conftest import ODD, SCHEMA, sentences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_apart(x, y):
    """Whether unequal word lists are one word apart: what they share in front and behind leaves a word at most."""
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    p = next((i for i in range(n) if x[i] != y[i]), n)
    q = next((i for i in range(n - p) if x[-1 - i] != y[-1 - i]), n - p)
    return p + q >= max(len(x), len(y)) - 1


def plain_dedup(rows, least):
    lines = sorted({(d, i, tuple(re.findall(r"[^ \t\x0b\f\r]+", line))) for d, t in rows if d is not None and t is not None for i, line in enumerate(t.split("\n"))})
    lines = [x for x in lines if x[2]]
    gone = {}
    for (d, i, x), (e, j, y) in itertools.permutations(lines, 2):
        if (e, j) < (d, i):
            if x == y:
                gone[d, i] = False
            elif min(len(x), len(y)) >= least and one_apart(x, y):
                gone.setdefault((d, i), True)
    return gone


def test_line_dedup_matches_plain_python(spark, odd, none, rng):
    base = [s.split() for s in sentences(3, 12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                i, what = rng.randrange(len(x)), rng.randrange(3)
                x[i : i + (what != 0)] = [] if what == 1 else [rng.choice("abc")]
            lines.append("  ".join(x))
        rows.append((d, "\n".join(lines)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): r["near"] for r in line_dedup.dropped_lines(documents).collect()}
    for least in (2, 5):
        assert {(r["doc_id"], r["line_no"]): r["near"] for r in line_dedup.dropped_lines(documents, least).collect()} == plain_dedup(rows, least)
    assert got == plain_dedup(rows, 8) and set(got.values()) == {True, False}
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(documents).collect()}
    assert out == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got) for d, t in rows}

    again = line_dedup.line_dedup(odd)
    assert again.count() == len(ODD) and set(odd.columns) < set(again.columns)
    by = {r["doc_id"]: r for r in again.collect()}
    assert by[2]["text"] is None and by[None]["text"] == ODD[6][1] and by[8]["text"] == "" and by[4]["n_lines"] == 0 and by[1]["n_equal"] == 0
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_keeps_rows_of_one_doc_id_apart(spark):
    """Rows that share a doc_id but not the text lose no line of their own; columns with internal-looking names stay."""
    rows = [(1, "aaa bbb"), (2, "aaa bbb"), (2, "only here once"), (2, "only here once"), (3, "only here once\nand more")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("gone", "gone_id", "pos", "line", "line_no", "near", "doc_hash")})
    out = line_dedup.line_dedup(documents)
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_equal"]) for r in out.collect())
    assert got == [(1, "aaa bbb", 1, 0), (2, "", 1, 1), (2, "only here once", 1, 0), (2, "only here once", 1, 0), (3, "and more", 2, 1)]
    assert out.columns == [*documents.columns, "n_lines", "n_equal", "n_near"] and all(r["gone"] == "gone" and r["near"] == "near" for r in out.collect())


def test_line_dedup_tries_no_pattern_on_every_line_and_sorts_no_variants(spark, monkeypatch):
    """White space of any kind parts words, yet no stage searches all lines by pattern; the earliest line of a variant is found by hash."""
    words, plans, written = "one two three four five six seven eight nine".split(), {}, line_dedup.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return written(df, name)

    monkeypatch.setattr(line_dedup, "written", noted)
    blanks = ["\t", "\x0b", "\f", "\r", "  ", " \t", "\t ", "\r\x0b"]
    lines = [b.join(words) for b in blanks] + [b + " ".join(words) for b in [" ", *blanks]] + [" ".join(words) + b for b in [" ", *blanks]]
    lines += [" ".join(words[:i] + words[i + 1 :]) for i in range(9)] + [" ".join([*words[:i], "x", *words[i:]]) for i in range(10)] + blanks + ["one\u00a0two three", "one two three"]
    rows = [(i % 7, line) for i, line in enumerate(lines)]
    rows = [(d, "\n".join(line for e, line in rows if e == d)) for d in range(7)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.line_dedup(documents)
    got = {(r["doc_id"], r["line_no"]): r["near"] for r in line_dedup.dropped_lines(documents).collect()}
    assert got == plain_dedup(rows, 8) and set(got.values()) == {True, False}
    assert sum(r["n_lines"] for r in out.collect()) == len(lines) - len(blanks)
    assert {"lines", "suspect-texts", "meeting-variants"} <= set(plans) and not any("RLIKE" in plan for plan in plans.values())
    assert "RLIKE" not in out._jdf.queryExecution().toString() and "SortAggregate" not in plans["meeting-variants"]


def test_license_scan(spark, odd, none):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [(1, mit), (2, "Some words. Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (3, "Licensed under CC BY-NC 4.0. Released under the MIT License."), (4, "nothing"), (5, "Licensed under CC BY 4.0 or so."), (6, None), (6, "")]
    got = [(r["doc_id"], r["n_known"], r["licenses"], r["n_unmatched"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    assert got == [(1, 3, "MIT", 0), (2, 2, "Apache-2.0", 1), (3, 2, "MIT|CC-BY-NC-4.0", 0), (4, 0, "", 0), (5, 0, "", 0), (6, 0, "", 0), (6, 0, "", 0)]
    assert license_scan.license_scan(odd).count() == len(ODD) and license_scan.license_scan(none).count() == 0
    assert all(re.search(license_scan.CUE[4:], s) for s in license_scan.SENTENCES.values())
    assert {x for _, run in license_scan.RULES for x in run} <= set(license_scan.SENTENCES)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest, w = total - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else weight[s] * rest / w for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, odd, none, rng):
    rows = [(i, "w " * rng.randrange(60), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(3000)]
    documents = spark.createDataFrame(rows + ODD, SCHEMA)
    got = mixing.mix(documents).collect()
    assert len(got) == len(rows) + len(ODD)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents.repartition(9)).collect()))
    sizes = {}
    for d in rows + ODD:
        sizes[d[3]] = sizes.get(d[3], 0) + len(WORD.findall(d[1] or ""))
    want = sorted(plain_targets(sizes).values())
    assert all(abs(a - b) < 1e-6 for a, b in zip(sorted({r["target"] for r in got}), sorted(set(want)), strict=True))
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
    assert all(abs(t - n) <= 1 for t, n in taken.items())
    out = mixing.mixed(documents.where("doc_id is not null and doc_id > 10"))
    assert out.columns == documents.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0 and mixing.mix(odd).count() == len(ODD)


def test_splitting_tree_keeps_quotas(spark):
    given = {1: 1000, 2: 0, 3: 37, 4: 5000}
    entries = lambda k: [([(s, q * k, 0) for s, q in given.items()],)]
    start, large = (spark.createDataFrame(entries(k), "quotas array<struct<source int, quota bigint, start bigint>>") for k in (1, 1000))
    rows = [(r["shard"], {e["source"]: e["quota"] for e in r["quotas"]}) for r in mixing.splitting_tree(start, 3).collect()]
    assert sorted(shard for shard, _ in rows) == list(range(8))
    assert [sum(q.get(i, 0) for _, q in rows) for i in given] == [1000, 0, 37, 5000]
    assert {sum(q.values()) for _, q in rows} <= {754, 755} and all(abs(q[4] - 625) < 60 for _, q in rows)
    wide = [{e["source"]: e["quota"] for e in r["quotas"]} for r in mixing.splitting_tree(large, 1).collect()]
    assert [sum(q.get(i, 0) for q in wide) for i in given] == [1_000_000, 0, 37_000, 5_000_000]


def uniform(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def hypergeometric(good, bad, draws, u):
    """By exact probabilities, from the mode upwards, then from it downwards."""
    chance = lambda x: comb(good, x) * comb(bad, draws - x) if max(0, draws - bad) <= x <= min(good, draws) else 0
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    order = [mode, *range(mode + 1, min(good, draws) + 1), *range(mode - 1, max(0, draws - bad) - 1, -1)]
    left = Fraction(u) * comb(good + bad, draws)
    for x in order:
        left -= chance(x)
        if left <= 0:
            return x
    return order[-1]


def plain_tree(quotas, levels):
    tree = {0: [(s, q, 0) for s, q in quotas]}
    for level in range(levels):
        below = {}
        for shard, entries in tree.items():
            rest = sum(q for _, q, _ in entries)
            draws, one, two = rest // 2, [], []
            for s, q, start in entries:
                n = hypergeometric(q, rest - q, draws, uniform(level, shard, s))
                rest, draws = rest - q, draws - n
                one.append((s, n, start))
                two.append((s, q - n, start + n))
            below[2 * shard], below[2 * shard + 1] = ([e for e in x if e[1]] for x in (one, two))
        tree = below
    return tree


def test_splitting_tree_draws_exactly(spark):
    for quotas, levels in (([(1, 40), (2, 1), (3, 17), (4, 200)], 5), ([(1, 3_000), (2, 900), (7, 3)], 2)):
        rows = spark.createDataFrame([([(s, q, 0) for s, q in quotas],)], "quotas array<struct<source int, quota bigint, start bigint>>")
        got = {r["shard"]: [tuple(e) for e in r["quotas"]] for r in mixing.splitting_tree(rows, levels).collect()}
        assert got == plain_tree(quotas, levels)
        for s, q in quotas:
            runs = sorted((start, n) for entries in got.values() for source, n, start in entries if source == s)
            assert sum(n for _, n in runs) == q and [a + n for a, n in runs][:-1] == [a for a, _ in runs][1:]


def test_mixing_draws_blocks_by_the_leaves(spark, rng, monkeypatch):
    """Each draw lies in the shard whose run of its source holds its place; what a document gives follows from its blocks' draws."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("mix_shard", "mix_shards", "r_doc_id", "place", "block", "pass")})
    placed, drawn = (x.collect() for x in mixing.draws(documents))
    number = {s: i for i, s in enumerate(["a", "b", "c", None], 1)}
    order = {}
    for r in drawn:
        order.setdefault(r["source"], []).append((int(hashlib.md5(f"draw:{r['source'] or ''}:{r['pass']}:{r['block']}".encode()).hexdigest()[:15], 16), r["block"], r["shard"], r["words"]))
    tree = plain_tree([(number[s], len(x)) for s, x in sorted(order.items(), key=lambda kv: number[kv[0]])], max(0, (len(drawn) // 4 - 1).bit_length()))
    for s, x in order.items():
        shards = [shard for _, shard, n in sorted((start, shard, n) for shard, entries in tree.items() for source, n, start in entries if source == number[s]) for _ in range(n)]
        assert [r[2] for r in sorted(x)] == shards and len(set(shards)) > 4
    taken = {}
    for r in mixing.mix(documents).collect():
        taken[r["doc_id"]] = r["taken"]
    block = {r["doc_id"]: (r["source"], r["block"]) for r in placed}
    words = {}
    for d, n in taken.items():
        words[block[d]] = words.get(block[d], 0) + n
    want = {}
    for r in drawn:
        want[r["source"], r["block"]] = want.get((r["source"], r["block"]), 0) + r["words"]
    assert {k: n for k, n in words.items() if n} == want
    out = mixing.mixed(documents, shard="shard")
    assert out.columns == [*documents.columns, "shard"] and {r["mix_shard"] for r in out.collect()} == {"mine"}
    pairs = [(r["doc_id"], r["shard"]) for r in out.collect()]
    of = {}
    for r in drawn:
        of.setdefault((r["source"], r["block"]), set()).add(r["shard"])
    assert pairs and all(shard in of[block[d]] for d, shard in pairs)


def test_the_tree_decides_the_shards(spark, monkeypatch):
    """With another tree, here one without a level, the registered query gives other rows."""
    sf = "/root/testdata/sf0.001"
    rows = queries.op10_mixing(spark, sf).collect()
    shards = {x for r in rows for x in r["shards"].split("|") if x}
    assert len(shards) >= 4 and all(len(r["shards"].split("|")) == -(-r["taken"] // r["size"]) for r in rows if r["taken"])
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, levels: tree(quotas, 0))
    other = queries.op10_mixing(spark, sf).collect()
    assert {x for r in other for x in r["shards"].split("|") if x} == {"0"} and sum(r["taken"] for r in other) == sum(r["taken"] for r in rows)
