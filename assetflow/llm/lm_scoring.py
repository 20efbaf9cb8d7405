"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Text, chunks, mix, written

#: Text bytes in a block of documents (four times that at most, or one document), and for each partition of the counts.
BLOCK_BYTES = 4 << 20
PART_BYTES = 6 << 20
#: Blocks that a task keeps open at once, and their tokens; beyond, the oldest is sent.
OPEN_BLOCKS, OPEN_TOKENS = 16, 2_000_000
#: Buckets of context frequency: unseen, then powers of two.
BUCKETS = 20
#: Estimates are held to one part in this many of an octave when mixture weights are learned.
FINE = 8
ROUNDS = 30

_START, _END = (mix(np.array([x], np.uint64))[0] for x in (0x5354415254, 0x454E44))


def _planes(counts: np.ndarray) -> bytes:
    """Counts byte plane by byte plane, so that the mostly empty high planes compress away."""
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view("<i8").ravel()


def bigrams(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, document) of every token: the words in lower case, then one end; the first follows a start."""
    word = text.word_hashes(lower=True)
    at = text.first[1:] + np.arange(text.n)  # of the ends
    n = len(word) + text.n
    token = np.full(n, _END, np.uint64)
    inner = np.ones(n, bool)
    inner[at] = False
    token[inner] = word
    context = np.concatenate([[_START], token[:-1]])[:n]
    context[text.first[:-1] + np.arange(text.n)] = _START
    return context, token, np.repeat(np.arange(text.n), text.n_words + 1)


def _pairs(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0xD6E8FEB86659FD93) + word)


def _sums(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in their order, the number of each row's key among them, and sums of counts for each."""
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(key)]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return sorted_[begin], number, [np.add.reduceat(x[order].astype(np.int64), begin) if len(key) else np.zeros(0, np.int64) for x in counts]


_KINDS = [(c, pa.binary()) for c in ("pairs", "pairs_train", "pairs_held", "contexts", "contexts_train", "contexts_held")]


def _requests(documents: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct bigrams, packed by partition of their own hash, and contexts, by that of theirs: their counts in training texts and in those of them held out for the weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def flush(block: int) -> pa.RecordBatch:
            pair, context, train, held = (np.concatenate(x) for x in zip(*waiting.pop(block), strict=True))
            packed = [{"part": p, "block": block} for p in range(parts)]
            for name, hashes in (("pairs", pair), ("contexts", context)):
                key, _, (trained, out) = _sums(hashes, train, held)
                part = (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
                at = np.searchsorted(part, np.arange(parts + 1))
                for p in range(parts):
                    own = slice(at[p], at[p + 1])
                    packed[p] |= {name: key[own].astype("<u8").tobytes(), f"{name}_train": _planes(trained[own]), f"{name}_held": _planes(out[own])}
            return pa.RecordBatch.from_pylist([x for x in packed if x["pairs"] or x["contexts"]], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("block", pa.int64()), *_KINDS])
        for batch in batches:
            for rows, text in chunks(batch):
                context, word, doc = bigrams(text)
                pair = _pairs(context, word)
                block, train, held = (np.asarray(rows.column(c).to_numpy(zero_copy_only=False))[doc] for c in ("block", "train", "held"))
                for name in np.unique(block):
                    own = block == name
                    waiting.setdefault(int(name), []).append((pair[own], context[own], train[own], held[own]))
                while len(waiting) > OPEN_BLOCKS or sum(len(x[0]) for w in waiting.values() for x in w) > OPEN_TOKENS:
                    yield flush(next(iter(waiting)))
        for block in list(waiting):
            yield flush(block)

    return documents.select("text", "block", "train", "held").mapInArrow(run, "part int, block bigint, " + ", ".join(f"{c} binary" for c, _ in _KINDS))


_TOTALS = "tokens bigint, words bigint, texts bigint, held_tokens bigint, held_texts bigint"


def _responses(requests: DataFrame) -> DataFrame:
    """For each block and partition, corpus counts of its distinct bigrams and of their contexts; totals in the rows of block null."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        part, block = table.column("part")[0].as_py(), table.column("block").to_numpy()
        out = [{"block": int(b), "part": part} for b in np.unique(block)]
        for name in ("pairs", "contexts"):
            each = [np.frombuffer(x.as_py(), "<u8") for x in table.column(name)]
            train, held = (np.concatenate([_unplanes(x.as_py()) for x in table.column(f"{name}_{c}")]) for c in ("train", "held"))
            end = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            key, number, (train, held) = _sums(np.concatenate(each), train, held)
            for row, a, b in zip(out, np.searchsorted(block, np.unique(block)), np.searchsorted(block, np.unique(block), "right"), strict=True):
                own = np.unique(number[end[a] : end[b]])
                row |= {name: _planes(train[own]), f"{name}_held": _planes(held[own])}
        start = key == _START
        rows = [*out, {
            "block": None, "part": part, "tokens": int(train.sum()), "words": int((train[~start] > 0).sum()), "texts": int(train[start].sum()),
            "held_tokens": int(held.sum()), "held_texts": int(held[start].sum())}]
        kinds = [
            ("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("pairs", "pairs_held", "contexts", "contexts_held")),
            *((c, pa.int64()) for c in ("tokens", "words", "texts", "held_tokens", "held_texts"))]
        return pa.Table.from_pylist(rows, schema=pa.schema(kinds))

    return requests.groupBy("part").applyInArrow(run, f"block bigint, part int, pairs binary, pairs_held binary, contexts binary, contexts_held binary, {_TOTALS}")


@dataclass
class Totals:
    """Training tokens, distinct words among them (ends too), texts; and what of them is held out."""
    tokens: int
    words: int
    texts: int
    held_tokens: int
    held_texts: int

    @property
    def distinct(self) -> int:
        return self.words + (self.texts > 0)


def _lookup(docs: pa.Table, answers: pa.Table) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """Runs of a block's rows with, for every token, its document within the run and the counts of bigram, context and word, each over training texts and over the held-out ones of them.

    Only the hashes of the whole block are held at once; bytes and estimates are worked on in runs.
    """
    runs, pairs, contexts = [], [], []
    for batch in docs.combine_chunks().to_batches():
        for rows, text in chunks(batch):
            context, word, doc = bigrams(text)
            runs.append((rows, doc.astype(np.int32)))
            pairs.append(_pairs(context, word))
            contexts.append(context)
    (key, number, _), (of, place, _) = _sums(np.concatenate(pairs)), _sums(np.concatenate(contexts))
    pairs.clear(), contexts.clear()
    by_part = sorted(answers.select(["part", "pairs", "pairs_held", "contexts", "contexts_held"]).to_pylist(), key=lambda r: r["part"])
    two, two_held, one, one_held = (np.concatenate([_unplanes(r[c]) for r in by_part]) for c in ("pairs", "pairs_held", "contexts", "contexts_held"))
    if len(two) != len(key) or len(one) != len(of):
        raise RuntimeError(f"a block has {len(key)} bigrams and {len(two)} counts; the documents changed between reads")
    at = 0
    for rows, doc in runs:
        n, m = number[at : at + len(doc)], place[at : at + len(doc)]
        at += len(doc)
        # a token is the context of the next one of its text; the end has the count of texts, as the start has
        last = np.concatenate([doc[1:] != doc[:-1], [True]])[: len(doc)]
        first = np.concatenate([[True], last[:-1]])[: len(doc)]
        next_ = np.where(last, np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0)), np.minimum(np.arange(len(doc)) + 1, len(doc) - 1))
        yield rows, (doc, two[n], two_held[n], one[m], one_held[m], one[m[next_]], one_held[m[next_]])


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)), 0)


def _level(p: np.ndarray) -> np.ndarray:
    """Estimates as whole steps of their logarithm; -1000 stands for zero."""
    return np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1)) * FINE), -1000).astype(np.int64)


def _held_counts(documents: DataFrame, answers: DataFrame, totals: Totals) -> DataFrame:
    """Held-out tokens by bucket of context frequency and levels of the two estimates from the rest of the training texts."""
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.int64)]
        for _, (_, pair, pair_held, context, context_held, word, word_held) in _lookup(docs, found) if docs.num_rows else ():
            pair, context, word = pair - pair_held, context - context_held, word - word_held
            keys.append((_bucket(context) * 4096 + 2048 + _level(pair / np.maximum(context, 1))) * 4096 + 2048 + _level(word / max(1, totals.tokens - totals.held_tokens)))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.table({"bucket": pa.array(key >> 24), "two": pa.array((key >> 12 & 4095) - 2048), "one": pa.array((key & 4095) - 2048), "n": pa.array(n.astype(np.int64))})

    own = documents.where("held").select("block", "text")
    spread = own.groupBy("block").cogroup(answers.join(own.select("block").distinct(), "block", "left_semi").groupBy("block")).applyInArrow(run, "bucket bigint, two bigint, one bigint, n bigint")
    return spread.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))


def learn_weights(bucket: np.ndarray, two: np.ndarray, one: np.ndarray, n: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket by expectation-maximisation on held-out counts.

    Buckets without held-out tokens take the weights of the next lower one; the uniform weight is at least 1e-4, so every text has a probability.
    """
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    estimates = np.stack([np.where(two > -1000, 2.0 ** (two / FINE), 0), np.where(one > -1000, 2.0 ** (one / FINE), 0), np.full(len(n), uniform)], 1)
    for b in range(BUCKETS):
        own = bucket == b
        if own.any():
            w = weights[b]
            for _ in range(rounds):
                share = estimates[own] * w
                w = ((share / share.sum(1, keepdims=True)) * n[own][:, None]).sum(0) / n[own].sum()
                w = np.maximum(w, [0, 0, 1e-4]) / np.maximum(w, [0, 0, 1e-4]).sum()
            weights[b] = w
        elif b:
            weights[b] = weights[b - 1]
    return weights


def _placed(documents: DataFrame, train: str, held: str) -> tuple[DataFrame, int]:
    """The documents with train, held and block, and the text's total bytes; a table that isn't read from Parquet files is written first.

    A block is the held-out ones, or the others, of a run of rows of one file that have texts of about one
    length: within four times the mean, or between two powers of four of it, where runs are as much shorter.
    So a run of long texts fills no block beyond four times BLOCK_BYTES.
    """
    flag = lambda c: F.coalesce(F.expr(c), F.lit(False))
    try:
        documents.select("_metadata.row_index", "_metadata.file_path").schema  # noqa: B018
    except AnalysisException:
        documents = written(documents, "lm-documents")
    total, n = documents.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    mean = max(1.0, (total or 0) / max(1, n))
    longer = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)) / mean)) - 1)
    rows = F.greatest(F.lit(1), F.floor(BLOCK_BYTES / mean / F.pow(F.lit(4), longer)))
    place = F.xxhash64("_metadata.file_path", longer, F.floor(F.col("_metadata.row_index") / rows), flag(train) & flag(held))
    return documents.select("doc_id", "text", place.alias("block"), flag(train).alias("train"), (flag(train) & flag(held)).alias("held")), total or 0


def lm_scores(documents: DataFrame, train: str, held: str) -> DataFrame:
    """Scores of every text: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    documents: doc_id and text; train and held are SQL conditions on doc_id: which texts the model
    learns from, and which of these are held out when the mixture weights are learned.  Tokens are
    the words in lower case and one end.  A token's probability is w2 c(h,w)/c(h) + w1 c(w)/N +
    w0/(V+1), with weights by how frequent the context h is.

    The documents lie in blocks; each sends its distinct bigrams once to the partitions of the
    bigram's hash, and its distinct contexts to those of theirs, which count them over all training
    texts and send the counts back, in the same order; so no partition grows with one context.  A
    word's own count is its count as a context, so no other count is needed.  Bigrams are counted
    by 64 bits of the hash of both words.  What is moved grows with the
    distinct bigrams of the blocks; no vocabulary is gathered or broadcast; the driver gets totals
    and a histogram of bounded size.

    Null and empty texts are one end.  Null doc_ids follow the conditions' value for null (false if
    that is null).  Repeated rows count and score each.  With no training text every count is 0.
    """
    placed, size = _placed(documents.select("doc_id", "text"), train, held)
    answers = written(_responses(_requests(placed, max(1, -(-size // PART_BYTES)))), "lm-counts")
    row = answers.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "texts", "held_tokens", "held_texts"))).first()
    totals = Totals(**row.asDict())
    answers = answers.where("block is not null").select("block", "part", "pairs", "pairs_held", "contexts", "contexts_held")
    uniform = 1 / (totals.distinct + 1)

    grid = _held_counts(placed, answers, totals).toArrow()
    weights = learn_weights(*(grid.column(c).to_numpy() for c in ("bucket", "two", "one", "n")), uniform)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        kinds = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())]
        out = []
        for rows, (doc, pair, _, context, _, word, _) in _lookup(docs, found) if docs.num_rows else ():
            w, n = weights[_bucket(context)], rows.num_rows
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, totals.tokens) + w[:, 2] * uniform
            base = np.log10((word + 0.5) / (totals.tokens + 0.5 * (totals.distinct + 1)))
            known, of_all = np.bincount(doc, word > 0, n).astype(np.int64), np.full(n, totals.tokens)
            columns = [rows.column("doc_id"), np.bincount(doc, minlength=n), known, of_all, np.bincount(doc, base, n), np.bincount(doc, np.log10(p), n)]
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=pa.schema(kinds)))
        return pa.Table.from_batches(out, pa.schema(kinds))

    both = placed.selectExpr("cast(doc_id as bigint) doc_id", "text", "block").groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
