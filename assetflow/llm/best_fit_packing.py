"""Packing of tokenised documents into sequences of a fixed size, gaps filled exactly where lengths allow it."""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .byte_bpe import Merges
from .shared import wider, written

#: Bytes of distinct runs and of their tokens that a task remembers; then it begins anew.
REMEMBERED_BYTES = 32 << 20
#: Runs of more bytes than this are left to the library, as the rounds of a fold grow with the longest word.
LONG = 64
#: Pieces of one length that are numbered together, on average; one bucket is one group of one task.
BUCKET = 50_000


class WordMerges(Merges):
    """Ranked merges of a vocabulary of byte symbols in which a word's last symbol has an ending of its own.

    The file must number merged tokens in the order of their merges, so that a token's number is its rank.
    """

    def __init__(self, model: dict):
        ranks, ending = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.of_byte = np.array([ranks[letter[b]] for b in range(256)], np.int64)
        self.of_last = np.array([ranks[letter[b] + ending] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [ranks[a + b] for a, b in merges]
        if sorted(made) != made:
            raise ValueError("the vocabulary's tokens aren't in the order of their merges")
        pairs = sorted((ranks[a] << 32 | ranks[b], r) for (a, b), r in zip(merges, made, strict=True))
        self.pairs, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def symbols(self, words: list[bytes]) -> np.ndarray:
        body = np.frombuffer(b"".join(words), np.uint8)
        out = self.of_byte[body]
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1
        out[last] = self.of_last[body[last]]
        return out


class _Table(dict):
    """Keys numbered as they first come, with the ids of each once add() has them; new: the keys without ids."""

    def __init__(self):
        self.new: list = []
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def numbers(self, keys) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64)

    def add(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the new keys."""
        self.starts, self.lengths = np.concatenate([self.starts, starts + len(self.flat)]), np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.new = []

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys strung together, and where each key's end."""
        sizes = self.lengths[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)], ends


def _strung(made: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, made), np.int64, len(made)) // 4
    return np.frombuffer(b"".join(made), "<u4"), np.cumsum(lengths) - lengths, lengths


class Encoder:
    """Token ids of whole texts by a word-level tokenizer that drops white space: each distinct run between ASCII white space is encoded once.

    The tokenizer must normalise (NFC, lower case) and split (WORDS) as the file of word_bpe_49k does; neither looks across
    white space.  Runs of printable ASCII and Latin-1 letters, on which normalising is lower case alone, are split here and
    their merges folded together; the library encodes all others, and texts that name a special token.
    """

    #: The splitting of runs that are encoded here, which is the tokenizer's on such letters; a line feed ends a run.
    WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = file.read()
        model = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.merges = WordMerges(model["model"])
        self.special = [t["content"].encode() for t in model["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.known, self.words, self.held = _Table(), _Table(), 0
        self.words["\n"] = 0
        self.words.add(*_strung([b""]))

    def library(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct runs strung together, and the start and number of each one's."""
        texts = b"\n".join(runs).decode().split("\n")
        fits = self.PLAIN.fullmatch
        plain = np.fromiter((len(r) <= LONG and fits(t) is not None for r, t in zip(runs, texts, strict=True)), bool, len(runs))
        words = self.WORDS.findall("".join(t + "\n" for t in itertools.compress(texts, plain)).lower())
        numbers = self.words.numbers(words)
        if self.words.new:
            made = self.merges.fold([w.encode() for w in self.words.new])
            self.held += sum(map(len, made)) + sum(map(len, self.words.new))
            self.words.add(*_strung(made))
        flat, ends = self.words.ids(numbers)
        stops = ends[numbers == 0]
        other, begins, sizes = _strung(self.library(list(itertools.compress(runs, ~plain))))
        starts, lengths = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        lengths[plain] = np.diff(stops, prepend=0)
        starts[plain] = stops - lengths[plain]
        starts[~plain], lengths[~plain] = begins + len(flat), sizes
        return np.concatenate([flat, other]), starts, lengths

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.held > REMEMBERED_BYTES:
            self._forget()
        named = [any(s in t for s in self.special) for t in texts]
        words = [[] if n else t.split() for t, n in zip(texts, named, strict=True)]  # bytes split at ASCII white space alone
        numbers = self.known.numbers(itertools.chain.from_iterable(words))
        if self.known.new:
            made = self.runs(self.known.new)
            self.held += sum(map(len, self.known.new)) + made[0].nbytes
            self.known.add(*made)
        ids, ends = self.known.ids(numbers)
        stops = np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])]
        own = [ids[a:b] for a, b in itertools.pairwise(stops)]
        return [np.frombuffer(self.library([t])[0], "<u4") if n else x for t, n, x in zip(texts, named, own, strict=True)]


def pieces(documents: DataFrame, path: str, capacity: int, end_id: int, ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece (from 0), start, length, ids_crc32; with ids also the tokens.

    A document is the tokens of its whole text and then end_id; only one of more than capacity tokens is
    cut, into pieces of that size and a rest.  ids_crc32 is that of the ids as little-endian unsigned
    32-bit integers.  A null or empty text is end_id alone; repeated rows and null doc_ids are pieces of their own.
    """
    kinds = [("piece", "integer", pa.int32()), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64())]
    own = documents.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    schema = wider(own.select("doc_id"), **{n: kind for n, kind, _ in kinds}, **({"ids": ArrayType(IntegerType())} if ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("text"))))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
                texts = [x.as_py() for x in batch.column("text").slice(at, to - at)]
                doc, made, tokens = [], [], []
                for i, body in enumerate(encoder.encode(texts)):
                    body = np.append(body, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(body), capacity)):
                        part = body[start : start + capacity]
                        doc.append(at + i)
                        made.append((piece, start, len(part), zlib.crc32(part.tobytes())))
                        if ids:
                            tokens.append(part.astype(np.int32))
                arrays = [batch.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(c, t) for c, (_, _, t) in zip(zip(*made, strict=True), kinds, strict=True))]
                if ids:
                    arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                at = to

    return own.mapInArrow(run, schema)


class Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n

    def largest(self, most: int) -> int:
        """The greatest length up to most of which a piece is left; 0 without one."""
        found = np.flatnonzero(self.left[: most + 1])
        return int(found[-1]) if len(found) else 0

    def _pair(self, total: int) -> tuple[int, ...]:
        """Two lengths that sum to total, the greater one as great as can be: total's complements are addressed directly."""
        here = self.left[1:total] > 0
        both = np.flatnonzero(here & here[::-1]) + 1
        both = both[2 * both >= total]
        if total % 2 == 0 and len(both) and both[0] == total // 2 and self.left[total // 2] < 2:
            both = both[1:]
        return (int(both[-1]), total - int(both[-1])) if len(both) else ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths in stock that fill the gap exactly, fewest first and then the greatest; empty without any."""
        if self.left[gap]:
            return (gap,)
        if found := self._pair(gap):
            return found
        for first in np.flatnonzero(self.left[: gap - 1])[::-1].tolist():
            if 3 * first < gap:  # the first is the greatest of the three
                break
            self.left[first] -= 1
            rest = self._pair(gap - first)
            self.left[first] += 1
            if rest:
                return (first, *rest)
        return ()


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces of it}) of every sequence: how pieces, of which there are counts of each length, fill sequences of capacity.

    A sequence opens with the longest piece left.  Its gap is filled exactly by one, two or three
    pieces where lengths in stock sum to it, else by the longest that fits (best fit), after which the
    smaller gap is tried again.  A pattern is repeated as long as the stock has it, so the number of
    steps depends on the number of lengths, not on that of pieces.
    """
    stock, out = Stock(counts, capacity), []
    while first := stock.largest(capacity):
        uses, gap = {first: 1}, capacity - first
        stock.left[first] -= 1
        while gap:
            chosen = stock.exact(gap) or tuple(filter(None, [stock.largest(gap)]))
            if not chosen:
                break
            for length in chosen:
                uses[length] = uses.get(length, 0) + 1
                stock.left[length] -= 1
                gap -= length
        times = 1 + min(int(stock.left[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            stock.left[length] -= (times - 1) * n
        out.append((times, uses))
    return out


def best_fit(items: DataFrame, capacity: int, *order: str, length: str = "length") -> DataFrame:
    """items (length from 1 to capacity) with sequence_id and offset: the place of each in a sequence of at most capacity, without gaps from 0.

    Only the number of items of each length, at most capacity numbers, comes to the driver, which
    plans by exact complements (patterns); the plan, some entries for each length, goes to the tasks.  Items
    of a length are then numbered in order (columns; equal ones are interchangeable) and take the plan's
    places of that length.  They are numbered in buckets by hash, each length's bucket counted before,
    so a length that many items share is no single group.  Columns named sequence_id and offset are
    replaced.  Items without a length, or with one outside the range, are an error of the plan's lookup.
    """
    rows = items.drop("sequence_id", "offset")
    buckets = max(1, -(-rows.count() // BUCKET))
    rows = rows.withColumns({"__bucket": F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"), "__length": F.col(length).cast("int")})
    held = written(rows.groupBy("__length", "__bucket").agg(F.count("*").alias("__n")), "lengths")
    counts = {r[0]: r[1] for r in held.groupBy("__length").agg(F.sum("__n")).collect()}

    slots: list[tuple[int, int, int, int, int, int]] = []  # length, rank of the first, pieces a sequence, first sequence, offset in it
    used, sequence = dict.fromkeys(counts, 0), 0
    for times, uses in patterns(counts, capacity):
        at = 0
        for size, n in sorted(uses.items(), reverse=True):
            slots.append((size, used[size], n, sequence, at, times))
            used[size] += times * n
            at += size * n
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 6)

    before = F.sum("__n").over(Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("__length", "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    number = F.row_number().over(Window.partitionBy("__length", "__bucket").orderBy(*order)) - 1
    ranked = rows.withColumn("__number", number).join(starts, ["__length", "__bucket"]).withColumn("__rank", F.col("__start") + F.col("__number"))
    ranked = ranked.select(*rows.drop("__bucket", "__length").columns, "__length", "__rank")
    kept = [c for c in ranked.columns if c not in ("__length", "__rank")]
    schema = wider(ranked.select(*kept), sequence_id="long", offset="long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__length", "__rank"))
            at = np.zeros(len(size), np.int64)
            order_of = np.argsort(size, kind="stable")
            edges = np.flatnonzero(np.diff(size[order_of], prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(size)), strict=True):
                rows_of = order_of[a:b]
                lo, hi = first[size[rows_of[0]]], first[size[rows_of[0]] + 1]
                at[rows_of] = lo + np.searchsorted(table[lo:hi, 1], rank[rows_of], "right") - 1
            k = rank - table[at, 1]
            sequence_id, offset = table[at, 3] + k // table[at, 2], table[at, 4] + k % table[at, 2] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence_id), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """The pieces of all documents (doc_id, piece, start, length, ids_crc32, with ids also their tokens) with sequence_id and offset.

    The tokenised pieces, without tokens unless ids are asked for, are written once to the shared
    folder.  Other columns of documents are left out; what becomes of nulls is told at pieces().  Reruns
    agree, up to rows that are alike in doc_id, piece and tokens.
    """
    made = written(pieces(documents, path, capacity, end_id, ids), "pieces")
    return best_fit(made, capacity, "doc_id", "piece", "start", "length", "ids_crc32")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (tokens strung together) and doc_ids (of its pieces, in place) of every sequence; packed must have ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
