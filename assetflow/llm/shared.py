"""What several operators need: scratch tables in the shared folder and vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: A word is a run of characters that are none of space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at once; one longer document is taken alone.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where none is set, a temporary one, on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006 - grows with the longest chunk
    if base not in kept or len(kept[base]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 2), base, np.uint64)
        steps[0] = 1
        if len(steps) > 4 * CHUNK_BYTES:
            return np.cumprod(steps)
        kept[base] = np.cumprod(steps)
    return kept[base][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.zeros(len(column) + 1, np.int64)
    if at is not None and len(column):
        offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


class Text:
    """Words of a run of documents.  starts, ends: byte positions of the words; first: n + 1 word offsets of the documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        solid = ~_SPACE[data]
        begins, stops = solid.copy(), solid.copy()
        if len(data):
            begins[1:] &= ~solid[:-1]
            stops[:-1] &= ~solid[1:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            begins[edges] = solid[edges]
            stops[edges - 1] = solid[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        self._sums: dict[bool, np.ndarray] = {}

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
        if lower not in self._sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            values = (_LOWER[self.data] if lower else self.data).astype(np.uint64)
            values += np.uint64(1)
            values *= _powers(len(self.data), _BASE)
            np.cumsum(values, out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        return mix((sums[ends] - sums[starts]) * _powers(len(self.data) + 1, _INVERSE)[starts])

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends, lower)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Word position and hash of every window of so many words that lies within one document."""
        at = np.flatnonzero(self.doc[: max(0, len(hashes) - size + 1)] == self.doc[size - 1 :]) if len(hashes) >= size else np.zeros(0, np.int64)
        key = np.zeros(len(at), np.uint64)
        for i in range(size):
            key = key * np.uint64(0xD6E8FEB86659FD93) + hashes[at + i]
        return at, mix(key)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per document, the sum of a value of each byte."""
        return np.diff(np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])[self.offsets])

    def word_sums(self, per_word: np.ndarray) -> np.ndarray:
        """Per document, the sum of a value of each word."""
        kind = per_word.dtype if per_word.dtype.kind == "f" else np.int64
        return np.diff(np.concatenate([np.zeros(1, kind), np.cumsum(per_word, dtype=kind)])[self.first])


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Runs of a batch's rows of about so many bytes of text, whole documents each."""
    data, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), Text(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def wider(df: DataFrame, **columns: str) -> StructType:
    """Schema of df with further columns of the given types."""
    schema = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema
