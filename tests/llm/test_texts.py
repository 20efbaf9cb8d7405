"""Operators that read each text alone, against plain Python."""

import base64
import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from assetflow.llm import byte_bpe, quality_classifier, quality_rules, token_counts, topk_search
from assetflow.llm.queries import QUERIES

from .conftest import ODD, sentences

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    repeat = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(repeat)}
    for n in range(5, 11):
        had, inside = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in had:
                inside.update(range(i, i + n))
            had.add(g)
        out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in inside)
    return out


def test_quality_rules_match_plain_python(spark, odd, none):
    for documents in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted((r.asDict() for r in quality_rules.quality_rules(documents).collect()), key=str)
        want = []
        for d in documents.collect():
            m = rules(d["text"])
            want.append({"doc_id": d["doc_id"], **m})
        keys = list(want[0])
        assert sorted([[r[k] for k in keys] for r in got], key=str) == sorted([[r[k] for k in keys] for r in want], key=str)
        assert all(not (r["base_failed"] and r["kept"]) for r in got)
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert quality_rules.quality_rules(none).count() == 0


def test_bpe_matches_the_library_and_decodes(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaaaaaa" * 20, "ab" * 300, " \n\n  x  ", "<|endoftext|>", "don't I'll 12345678901", *(t for _, t, *_ in ODD)])], "doc_id int, text string")
    for documents in (texts, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")):
        rows = byte_bpe.decode(byte_bpe.encode(documents, byte_bpe.load_ranks(path), public_tokenizers.PATTERN), ranks).collect()
        assert len(rows) == documents.count()
        for r in rows:
            want = library.encode_ordinary(r["text"] or "")
            assert b"".join(x.to_bytes(4, "little") for x in want) == bytes(r["ids"]) and r["n_tokens"] == len(want)
            assert bytes(r["decoded"]) == (r["text"] or "").encode()
        again = byte_bpe.encode(documents, ranks, public_tokenizers.PATTERN, decoded="back").collect()
        assert sorted((r["doc_id"], bytes(r["ids"]), bytes(r["back"])) for r in again) == sorted((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows)
    clash = byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "size", "node", "n_tokens", "ids"] and clash.count() == len(ODD)
    assert byte_bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0
    digests = {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(d["text"] or "")
        r = digests.pop(d["doc_id"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert not digests


def test_bpe_of_odd_scripts_and_long_words(rng):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    alphabet = ["a", "b", "th", "ing", "é", "漢", "𝒳", "\x85", "\u200d", "\u0300", "0", "9", "%", "'s", "\x00", "\x1c", "ꙮ", "ᚠ"]
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)] + ["ab" * 3000, "a" * 5000]
    merges = byte_bpe.Merges(ranks)
    encoded = merges.encode(set(words))
    for w in words:
        if len(byte_bpe.regex_words(public_tokenizers.PATTERN)(w)) == 1:
            assert encoded[w] == b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(w))
        ids = b"".join(merges.encode(set(byte_bpe.regex_words(public_tokenizers.PATTERN)(w)))[x] for x in byte_bpe.regex_words(public_tokenizers.PATTERN)(w))
        assert ids == b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(w)) and merges.decode(ids) == w.encode()


def test_token_counts_across_blocks(spark, odd, none):
    for block in (1, 7, 1 << 16):
        files = token_counts.flat_token_files(odd.repartition(3), block)
        got = token_counts.token_counts(files).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(d[0]), len((d[1] or "").encode())) for d in ODD)
        assert all(r["ended"] for r in got)
        if block == 1:
            odd = odd.where("length(coalesce(text, '')) < 1000")
            ODD_SHORT = [d for d in ODD if len(d[1] or "") < 1000]
            files = token_counts.flat_token_files(odd.repartition(3), 1)
            assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(files).collect()) == sorted((str(d[0]), len((d[1] or "").encode())) for d in ODD_SHORT)
            break
    files = token_counts.flat_token_files(odd.repartition(3), 7)
    assert token_counts.token_counts(files).count() == odd.count()
    assert token_counts.token_counts(token_counts.flat_token_files(none)).count() == 0


def test_tokens_after_the_last_separator(spark):
    pack = lambda *x: b"".join(i.to_bytes(2, "little") for i in x)
    blocks = spark.createDataFrame([("f", 0, pack(1, 2)), ("f", 1, pack(3, 256, 256)), ("f", 2, pack(4)), ("f", 3, None), ("f", 4, pack(5)), ("g", 0, pack(9))], "file string, block int, tokens binary")
    got = token_counts.token_counts(blocks).orderBy("file", "ordinal").collect()
    assert [(r["file"], r["ordinal"], r["n_tokens"], r["ended"]) for r in got] == [("f", 0, 3, True), ("f", 1, 0, True), ("f", 2, 2, False), ("g", 0, 1, False)]


def test_top_k_in_blocks(spark, rng):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)] + [(200, None), (201, [float("nan")] * 8), (202, [None] * 8), (None, [1.0] * 8), (40, [0.5] * 8), (3, [0.25] * 8), (3, [0.25] * 8), (205, [0.0] * 8), (206, []), (220, [])]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    held = [(r["vec_id"], tuple(r["terms"])) for r in vectors.collect()]
    queries = vectors.where("vec_id % 20 = 0 or vec_id = 3")
    got = sorted((r["query_id"], r["rank"], -r["score"], r["vec_id"]) for r in topk_search.top_k(vectors, queries, 5, candidate_block=37, query_block=3).collect())
    want = []
    for q, t in held:
        if q % 20 == 0 or q == 3:
            others = list(held)
            others.remove((q, t))
            best = sorted((-sum(x * y for x, y in zip(t, u, strict=False)), v) for v, u in others)[:5]
            want += [(q, rank, *x) for rank, x in enumerate(best, 1)]
    assert got == sorted(want) and len([x for x in got if x[0] == 3]) == 15
    assert topk_search.top_k(vectors.limit(0), queries).count() == 0


def test_classifier_separates_and_repeats(spark, odd, none):
    junk = [(i, " ".join(f"{w.upper()}!!" for w in s.split())) for i, s in enumerate(sentences(1, 150))]
    good = [(i + 150, s.capitalize() + ".") for i, s in enumerate(sentences(2, 150))]
    documents = spark.createDataFrame(junk + good, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 150), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (1, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(documents, labels, buckets=1 << 14)
    again = quality_classifier.train(documents.repartition(7), labels, buckets=1 << 14)
    assert (model.weights == again.weights).all() and model.bias == again.bias
    rows = quality_classifier.score(documents, model).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] >= 150) for r in rows)
    scored = quality_classifier.score(odd, model)
    assert scored.count() == len(ODD) and scored.where(~F.col("score").between(0, 1) | F.col("score").isNull()).count() == 0
    assert quality_classifier.score(none, quality_classifier.train(none, labels.limit(0))).count() == 0
