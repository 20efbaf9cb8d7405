"""Quality rules by repetition coverage: how many characters lie inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import Text, chunks

#: Most that may lie inside later copies of an n-gram, as a share of the characters in words (published web-text rules).
MOST_DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most that may lie inside lines equal to an earlier line of the same text.
MOST_IN_LINES = 0.20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _again(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the entries whose key stands twice or more in the document, and of those that aren't its first."""
    own = key ^ (doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(own, kind="stable")
    same = np.concatenate([[False], own[order][1:] == own[order][:-1]])
    later, twice = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order] = same
    twice[order] = same | np.concatenate([same[1:], [False]])[: len(same)]
    return twice, later


def _covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Words that lie in one of the windows of this size that begin at the given words."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0


def measures(text: Text) -> dict[str, np.ndarray]:
    data = text.data
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[text.ends] - points[text.starts]
    word = text.word_hashes()
    out = {"n_words": text.n_words, "word_chars": text.word_sums(chars), "n_symbols": text.sums(_SYMBOL[data])}

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([text.offsets[:-1][np.diff(text.offsets) > 0], breaks + 1]))
    starts = np.unique(starts[starts < len(data)])
    stops = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], text.offsets[1:][np.searchsorted(text.offsets, starts, "right") - 1])
    words_before = np.searchsorted(text.starts, starts)
    words_to = np.searchsorted(text.starts, stops)
    worded = words_to > words_before
    starts, stops, words_before, words_to = starts[worded], stops[worded], words_before[worded], words_to[worded]
    line_doc = np.searchsorted(text.offsets, starts, "right") - 1
    _, later = _again(line_doc, text.span_hashes(starts, stops))
    in_words = np.concatenate([[0], np.cumsum(chars)])
    out["n_dup_lines"] = np.bincount(line_doc, later, text.n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc, np.where(later, in_words[words_to] - in_words[words_before], 0), text.n).astype(np.int64)

    for size in MOST_DUPLICATED:
        at, key = text.windows(word, size)
        twice, later = _again(text.doc[at], key)
        if size == 5:
            out["n_repeat_words"] = text.word_sums(_covered(len(word), at[twice], 5))
        out[f"dup_{size}gram_chars"] = text.word_sums(np.where(_covered(len(word), at[later], size), chars, 0))
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in MOST_DUPLICATED)]


def quality_rules(documents: DataFrame, most_duplicated: dict[int, float] | None = None, most_in_lines: float = MOST_IN_LINES) -> DataFrame:
    """Measures of every text and its verdict: doc_id, the counts of COLUMNS (long), base_failed, kept.

    A null or empty text has no words and fails.  Rows are judged one by one, so repeated rows, ties
    and null doc_ids each give a row; other columns are not read.  No shuffle.  A task holds one
    chunk of documents at a time, at least one whole document.
    """
    limits = most_duplicated or MOST_DUPLICATED

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in chunks(batch):
                m = measures(text)
                failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
                poor = m["dup_line_chars"] > most_in_lines * m["word_chars"]
                for size, most in limits.items():
                    poor |= m[f"dup_{size}gram_chars"] > most * m["word_chars"]
                columns = [rows.column("doc_id"), *(pa.array(m[c].astype(np.int64)) for c in COLUMNS), pa.array(failed), pa.array(~failed & ~poor)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COLUMNS, "base_failed", "kept"])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", base_failed boolean, kept boolean"
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(judge, schema)
