"""Spelling variants: words one edit apart, found in FM-indices over delimited vocabularies, and the forms they stand for."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Runs of letters that words are made from.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Distinct words that a task counts together before it passes the counts on.
COUNTED = 200_000
#: Code points of words in one index, on average; and words that share a half in one index at most.
BLOCK, SHARED = 1 << 17, 1 << 14


def spoilt(run: str, crc: int, one_in: int = 97) -> str:
    """The run, less its code point at crc % length where one_in divides crc."""
    at = crc % len(run)
    return run[:at] + run[at + 1 :] if crc % one_in == 0 else run


def vocabulary(documents: DataFrame, least: int = 5, times: int = 3, one_in: int = 97) -> DataFrame:
    """word and n, its occurrences, of the words of whole texts with at least so many code points and occurrences.

    Words are RUNs with A-Z in lower case; where the crc32 of doc_id, a colon and the run is divisible by
    one_in, one code point is deleted.  A null text has none; a null doc_id counts as an empty text; repeated
    rows count each.  Tasks count their own words first, so a frequent word is one row a task.
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text is not null")
    letters = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                seed = zlib.crc32(f"{doc_id.as_py()}:".encode())
                own: dict[str, int] = {}
                for w in letters.findall(text.as_buffer().to_pybytes().lower().decode()):  # bytes.lower is that of A-Z alone
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    crc = zlib.crc32(w.encode(), seed)
                    w = spoilt(w, crc, one_in)
                    if len(w) >= least:
                        counts[w] = counts.get(w, 0) + n
                if len(counts) >= COUNTED:
                    yield made()
        if counts:
            yield made()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _codes(words: list[str], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each from its end on if backwards, and n + 1 offsets."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(w[::-1] for w in words).encode("utf-32-le") if backwards else "".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


class Index:
    """FM-index of distinct words, each behind a delimiter and read as a ring, by ranks of their suffixes.

    The last column is kept as (letter, rank) pairs in order, so one binary search both counts a letter
    before a rank and adds the smaller letters: the step that extends an interval to the left.
    """

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        flat, offsets = _codes(self.words, False)
        v, self.letters = len(self.words), np.unique(flat)
        at = offsets[:-1] + np.arange(v)  # the places of the delimiters
        text = np.zeros(len(flat) + v, np.int64)
        inner = np.ones(len(text), bool)
        inner[at] = False
        text[inner] = np.searchsorted(self.letters, flat) + 1
        self.n, self.v = len(text), v
        word = np.repeat(np.arange(v), np.diff(offsets) + 1)
        stop = np.append(at[1:], self.n)[word] if v else np.zeros(0, np.int64)  # a suffix ends before the next delimiter
        place, rank, step = np.arange(self.n), text.copy(), 1
        while True:  # prefix doubling; a suffix that has ended is smaller than any that goes on
            ahead = np.where(place + step < stop, np.append(rank, 0)[np.minimum(place + step, self.n)], 0)
            key = rank * (self.n + len(self.letters) + 2) + ahead
            _, made = np.unique(key, return_inverse=True)
            made += 1
            if step > 1 and made.max(initial=0) == rank.max(initial=0) or not self.n:
                break
            rank, step = made, 2 * step
        rank[at] = 0
        order = np.argsort(rank, kind="stable")  # equal suffixes in the order of their words
        before = np.where(text[order] == 0, stop[order] - 1, order - 1)
        self.last = text[before] if self.n else text
        by = np.argsort(self.last, kind="stable")
        self.keys = self.last[by] * (self.n + 1) + by

    def number(self, codes: np.ndarray) -> np.ndarray:
        """Letters' numbers in this index; one that it doesn't hold is beyond all."""
        at = np.searchsorted(self.letters, codes)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == codes if len(self.letters) else np.zeros(len(codes), bool)
        return np.where(known, at + 1, len(self.letters) + 1)

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-rank intervals with a letter in front."""
        key = letter * (self.n + 1)
        return np.searchsorted(self.keys, key + low), np.searchsorted(self.keys, key + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval's number, letter) for every letter that stands before some suffix of an interval."""
        sizes, letters = high - low, len(self.letters)
        small = np.flatnonzero(sizes <= letters)
        total = sizes[small]
        of = np.repeat(small, total)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total) + low[of]
        large = np.flatnonzero(sizes > letters)
        of, letter = np.concatenate([of, np.repeat(large, letters)]), np.concatenate([self.last[rows], np.tile(np.arange(1, letters + 1), len(large))])
        pair = np.unique(of * (letters + 2) + letter)
        of, letter = pair // (letters + 2), pair % (letters + 2)
        return of[letter > 0], letter[letter > 0]

    def one_edit(self, patterns: list[str], more: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(pattern's number, word's number) of every word that ends as the pattern's second half does and is one edit away.

        The second half (with more it has the middle letter of an odd number), behind the delimiter that ends a word, is
        matched exactly to the left; across the first half one letter may be replaced, left out or put in, and the
        rest up to the delimiter matches exactly.
        """
        flat, offsets = _codes(patterns, True)
        sizes = np.diff(offsets)
        codes = self.number(flat)
        q = np.arange(len(patterns))
        low, high, exact = np.zeros(len(q), np.int64), np.full(len(q), self.v, np.int64), (sizes + more) // 2
        done: list[tuple[np.ndarray, ...]] = []
        for t in range(int(sizes.max(initial=0)) + 1):
            open_ = exact[q] <= t
            a, b, c = q[open_], low[open_], high[open_]
            of, letter = self.branches(b, c)
            lo, hi = self.extend(letter, b[of], c[of])
            done.append((a[of], np.full(len(of), t), lo, hi))  # a letter is put in
            goes = t < sizes[a[of]]
            wanted = codes[np.minimum(offsets[a[of]] + t, len(codes) - 1)] if len(codes) else letter
            other = goes & (letter != wanted)
            done.append((a[of][other], np.full(int(other.sum()), t + 1), lo[other], hi[other]))
            less = t < sizes[a]
            done.append((a[less], np.full(int(less.sum()), t + 1), b[less], c[less]))  # one is left out
            on = t < sizes[q]
            q, low, high = q[on], low[on], high[on]
            low, high = self.extend(codes[offsets[q] + t], low, high)
            held = low < high
            q, low, high = q[held], low[held], high[held]
            if not len(q):
                break
        q, at, low, high = (np.concatenate(x) for x in zip(*done, strict=True))
        found = []
        while len(q):
            over = at == sizes[q]
            first, last = self.extend(np.zeros(int(over.sum()), np.int64), low[over], high[over])
            hit = first < last  # the delimiters' suffixes are ranked as the words are, so an interval is a word
            found.append(q[over][hit] * max(1, self.v) + first[hit])
            q, at, low, high = q[~over], at[~over], low[~over], high[~over]
            low, high = self.extend(codes[offsets[q] + at], low, high)
            held = low < high
            q, at, low, high = q[held], at[held] + 1, low[held], high[held]
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // max(1, self.v), pair % max(1, self.v)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (n, word) for words (word, n) with near ones: those one inserted, deleted or replaced code point away.

    One edit leaves a half of a word as it is: the first at its front or the second at its end.  So
    words of one length meet those whose half begins or ends as theirs does, in blocks by hash of length and half;
    what shares a half too often is dealt to several blocks, each asked.  A block's words are an index of
    their own, backwards for the first half, so both searches go from a delimiter over the exact half to
    the other.  Pairs found at the front are not counted again at the end.  Words are taken to be distinct, of 4 code points or more.
    """
    length = F.length("word")
    half = lambda size: F.floor((size - 1) / 2).cast("int")  # noqa: E731 - what the halves of words one shorter or longer hold at least
    part = lambda front, size: F.substring("word", 1, half(size)) if front else F.expr("substring(word, greatest(1, length(word) - m + 1), m)")
    sides = []
    for front in (True, False):
        own = words.select("word", "n", length.alias("size")).withColumn("m", half(F.col("size"))).withColumn("key", F.struct(F.lit(front).alias("front"), "size", part(front, F.col("size")).alias("half")))
        asks = words.select("word", "n", F.explode(F.array(length - 1, length, length + 1)).alias("size")).withColumn("m", half(F.col("size"))).withColumn("key", F.struct(F.lit(front).alias("front"), "size", part(front, F.col("size")).alias("half")))
        sides.append((own.select("key", "word", "n"), asks.select("key", "word")))
    targets, asked = sides[0][0].unionByName(sides[1][0]), sides[0][1].unionByName(sides[1][1])
    total = words.agg(F.sum(length)).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK))
    heavy = targets.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > SHARED).select("key", F.ceil(F.col("held") / SHARED).cast("int").alias("parts"))
    block = lambda n: F.pmod(F.xxhash64("key", n), F.lit(blocks)).cast("int").alias("block")
    parts = F.coalesce("parts", F.lit(1))
    targets = targets.join(heavy, "key", "left").select(block(F.pmod(F.xxhash64("word"), parts).cast("int")), F.col("key.front").alias("front"), "word", "n")
    asked = asked.join(heavy, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(block(F.col("part")), F.col("key.front").alias("front"), F.col("word").alias("asks"))

    def search(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        made = []
        for front in (True, False):
            turned = (lambda w: w[::-1]) if front else (lambda w: w)
            here, asks = own[own["front"] == front], wanted.loc[wanted["front"] == front, "asks"].unique().tolist()
            if not len(here) or not asks:
                continue
            index = Index([turned(w) for w in here["word"]])
            n_of = dict(zip(here["word"], here["n"], strict=True))
            found = {}
            for q, w in zip(*(x.tolist() for x in index.one_edit([turned(w) for w in asks], more=not front)), strict=True):
                word, near = asks[q], turned(index.words[w])
                if front or not near.startswith(word[: len(word) // 2]):
                    count, best = found.get(word, (0, None))
                    this = (-n_of[near], near)
                    found[word] = (count + 1, this if best is None else min(best, this))
            made.extend((word, count, -best[0], best[1]) for word, (count, best) in found.items())
        return pd.DataFrame(made, columns=["word", "n_near", "best_n", "best"])

    found = targets.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min_by(F.struct(F.col("best_n").alias("n"), F.col("best").alias("word")), F.struct(-F.col("best_n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root of forms (word, form or null): forms followed to the last, by doubling steps; most: the greatest n.

    A form has twice its word's n at least, so a chain has no more steps than most has binary digits.
    """
    jumps = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(max(1, most.bit_length()).bit_length()):
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("__to"))
        moving = jumps.where("root <> word").join(on, "root").select("word", F.col("__to").alias("root"))
        jumps = written(moving.unionByName(jumps.where("root = word")), "roots")
    return jumps


def spelling_variants(documents: DataFrame, least: int = 5, times: int = 3, ratio: int = 2, one_in: int = 97) -> DataFrame:
    """Each word of the vocabulary with its near words and form: word, form, root, n, n_near, form_n.

    A word's form is its near word of greatest n (ties: the smallest in code-point order), if that is ratio
    times its own at least, else null; root follows forms to the last, and is the word itself without one.
    What becomes of nulls and repeated rows is told at vocabulary(); least must be 4 or more, ratio 2.
    """
    words = written(vocabulary(documents, least, times, one_in), "words")
    formed = F.col("best.n") >= ratio * F.col("n")
    rows = words.join(near_words(words), "word", "left").select(
        "word", F.when(formed, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best.n")).alias("form_n"))
    rows = written(rows, "forms")
    return rows.join(roots(rows, words.agg(F.max("n")).first()[0] or 1), "word").select("word", "form", "root", "n", "n_near", "form_n")


#: The query in SQL: crc32 bit by bit in a table of 256 remainders, near words by equal deletion variants.
SQL = r"""
    WITH RECURSIVE t AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS r FROM range(256) x(b))),
    m AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    g AS (SELECT d, w, count(*) AS n FROM m GROUP BY ALL),
    h AS (SELECT w, n, hex(encode(d || ':' || w)) AS x FROM g),
    c AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
          lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM h, t),
    s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c),
    v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    x AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
    p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
          UNION SELECT word, cut FROM x SEMI JOIN v ON cut = v.word UNION SELECT cut, word FROM x SEMI JOIN v ON cut = v.word),
    k AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS best, max(v.n) AS best_n FROM p JOIN v ON near = v.word GROUP BY p.word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN k ON v.word = k.word),
    r(word, root, step) AS (SELECT word, coalesce(form, word), 0 FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
    o AS (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN o USING (word)"""
