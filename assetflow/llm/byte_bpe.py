"""Byte-level BPE encoding and decoding with a public rank file."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import utf8, wider

#: Distinct words whose encodings a task remembers at most; then it begins anew.
REMEMBERED = 300_000
#: Words of more bytes than this are merged one by one with a heap, as the rounds of a fold grow with the longest word.
LONG = 64
#: Bytes of text that a task splits before it folds the new words together.
TOGETHER = 1 << 21
NONE = np.iinfo(np.int64).max


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank map of a file with lines of base64 token and rank; read on the driver and sent to the tasks (about a megabyte)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def regex_words(pattern: str) -> Callable[[str], list[str]]:
    """What splits a text into the matches of pattern."""
    import regex

    return regex.compile(pattern).findall


class Merges:
    """Ranked merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into; NONE where there is none."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """The symbols that words begin as, one for each byte."""
        return self.of_byte[np.frombuffer(b"".join(words), np.uint8)]

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Encodings (little-endian unsigned 32-bit identifiers) of distinct words, folded together.

        Each round merges in every word its leftmost pair of least rank; a word that has none left is done.
        """
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.symbols(words)
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            over = least == NONE
            for a, n in zip(starts[over], sizes[over], strict=True):
                out[word[a]] = symbol[a : a + n].astype("<u4").tobytes()
            going = np.repeat(~over, sizes)
            symbol, word, rank = symbol[going], word[going], rank[going]
            if not len(symbol):
                break
            hit = np.flatnonzero(rank == np.repeat(least[~over], sizes[~over]))
            at = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
            symbol[at] = rank[at]
            held = np.ones(len(symbol), bool)
            held[at + 1] = False
            moved = at - np.arange(len(at))
            symbol, word, rank = symbol[held], word[held], rank[held]
            for x in (moved, moved - 1):
                here = x[x >= 0]
                next_ = np.minimum(here + 1, len(symbol) - 1)
                joined = (here + 1 < len(symbol)) & (word[here] == word[next_])
                rank[here] = np.where(joined, self.rank(symbol[here], symbol[next_]), NONE)
        return out

    def merge(self, word: bytes) -> bytes:
        """Encoding of one long word by a heap of pairs: time in proportion to length x log length."""
        n = len(word)
        token = [word[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, token[i] + token[i + 1]) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if token[i] else -1
            if j < 0 or token[i] + token[j] != made:
                continue
            token[i], token[j] = made, b""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.ranks.get(token[a] + token[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, token[a] + token[after[a]]))
        return np.array([self.ranks[t] for t in token if t], "<u4").tobytes()

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        done, short = {}, []
        for w in words:
            b = w.encode("utf-8", "replace")
            if (r := self.ranks.get(b)) is not None:
                done[w] = r.to_bytes(4, "little")
            elif len(b) > LONG:
                done[w] = self.merge(b)
            else:
                short.append((w, b))
        done.update(zip([w for w, _ in short], self.fold([b for _, b in short]), strict=True))
        return done

    def decode(self, ids: bytes) -> bytes:
        """The identifiers' bytes strung together."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _per_text(documents: DataFrame, make, columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """documents with columns that make(list of texts, state of the task) gives; runs of texts of about TOGETHER bytes at once."""
    names = [n for n, _, _ in columns]
    kept = documents.drop(*names)
    schema = wider(kept, **{name: kind for name, kind, _ in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            _, ends = utf8(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, "right")) - 1)
                rows = batch.slice(at, to - at)
                made = make([x or "" for x in rows.column("text").to_pylist()], state)
                arrays = (pa.array(v, t) for v, (_, _, t) in zip(made, columns, strict=True))
                yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], names=[*rows.schema.names, *names])
                at = to

    return kept.mapInArrow(run, schema)


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False, decoded: str | None = None) -> DataFrame:
    """The documents with n_tokens and ids (little-endian unsigned 32-bit), or their digests.

    Each match of pattern in the whole text is a word.  A task folds the ranked merges over the bytes
    of its distinct words, each once, by the rank map, and strings the words' identifiers together.
    It remembers REMEMBERED words at most (then it begins anew), so memory doesn't grow with the
    table; nothing is shuffled, collected or broadcast but the rank map (about a megabyte).

    A null text counts as empty and has no ids.  Every row is encoded alone and keeps its place and
    its other columns; columns named like the new ones are replaced.  With digests, ids_sha256 and
    decoded_sha256 (of the decoded bytes) stand in place of ids.  With decoded, a column of that name has
    the bytes that the ids decode to, from the same tasks.
    """

    def make(texts: list[str], state: dict) -> list[list]:
        if not state:
            state.update(merges=Merges(ranks), split=regex_words(pattern), known={})
        merges, known = state["merges"], state["known"]
        if len(known) > REMEMBERED:
            known.clear()
        words = [state["split"](t) for t in texts]
        known.update(merges.encode(set().union(*words) - known.keys()))
        ids = [b"".join(map(known.__getitem__, w)) for w in words]
        counts = [len(x) // 4 for x in ids]
        if not digests:
            return [counts, ids, *([list(map(merges.decode, ids))] if decoded else [])]
        return [counts, *([hashlib.sha256(x).hexdigest() for x in made] for made in (ids, map(merges.decode, ids)))]

    if digests:
        return _per_text(documents, make, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])
    return _per_text(documents, make, [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary()), *([(decoded, "binary", pa.binary())] if decoded else [])])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", output: str = "decoded") -> DataFrame:
    """The rows with column output: the tokens' bytes strung together; null where ids is null."""
    kept = encoded.drop(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(ranks)
        for batch in batches:
            _, ends = utf8(batch.column(ids))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, "right")) - 1)
                rows = batch.slice(at, to - at)
                made = [None if x is None else merges.decode(x) for x in rows.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, pa.binary())], names=[*rows.schema.names, output])
                at = to

    return kept.mapInArrow(run, wider(kept, **{output: "binary"}))
