"""Token counts by separator scan over flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import utf8, written

#: Identifier that ends a document; 0 to 255 are the byte tokens.
END = 256
#: Tokens in a block of a flat file.
BLOCK = 1 << 16

BLOCKS = "file string, block bigint, tokens binary, doc_ids array<bigint>"


def flat_token_files(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents as flat token files, one per input partition, cut into blocks without regard to documents.

    Tokens are little-endian unsigned 16-bit byte values; END follows each document.  doc_ids
    names the documents that end in the block, in order, so that counts can be traced back.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = f"part-{TaskContext.get().partitionId():06d}"
        rest, ends, ids, number = np.zeros(0, np.uint16), np.zeros(0, np.int64), [], 0

        def cut(n: int, last: bool):
            nonlocal rest, ends, ids, number
            rows = []
            at = 0
            while len(rest) - at >= n or last and at < len(rest):
                k = int(np.searchsorted(ends, at + n))
                rows.append({"file": file, "block": number, "tokens": rest[at : at + n].tobytes(), "doc_ids": ids[:k]})
                ends, ids, at, number = ends[k:], ids[k:], at + n, number + 1
            rest, ends = rest[at:], ends - at
            return rows

        arrow = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 16 * block, "right")) - 1)
                lengths = np.diff(offsets[at : to + 1])
                stops = np.cumsum(lengths + 1) - 1
                flat = np.full(int(lengths.sum()) + len(lengths), END, np.uint16)
                held = np.ones(len(flat), bool)
                held[stops] = False
                flat[held] = data[offsets[at] : offsets[to]]
                ends, rest = np.concatenate([ends, stops + len(rest)]), np.concatenate([rest, flat])
                ids = ids + keys[at:to]
                at = to
                if rows := cut(block, False):
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if rows := cut(block, True):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(write, BLOCKS)


def token_counts(blocks: DataFrame, end: int = END, dtype: str = "<u2") -> DataFrame:
    """Documents of flat token files: file, ordinal (from 0), n_tokens, ended, doc_id.

    blocks: file, block (order within the file), tokens (binary; a whole number of tokens), doc_ids
    (documents ending in the block, or null).  Each block is searched at once for the separator; what
    a document has in earlier blocks comes from a prefix scan over the blocks' totals, so no task
    needs two blocks together.  Tokens after a file's last separator form a document with ended
    false; a file without tokens has none.  An empty document has 0 tokens.  Null tokens count as
    an empty block.  Only one short row per block is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, tails, lengths = [], [], []
            for tokens in batch.column("tokens").to_pylist():
                block = np.frombuffer(tokens or b"", np.dtype(dtype))
                at = np.flatnonzero(block == end)
                totals.append(len(block))
                tails.append(len(block) - int(at[-1]) - 1 if len(at) else None)
                lengths.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "block", "doc_ids")), pa.array(totals, pa.int64()), pa.array(tails, pa.int64()), pa.array([list(x) for x in lengths], pa.list_(pa.int64()))],
                names=["file", "block", "doc_ids", "total", "tail", "lengths"],
            )

    if "doc_ids" not in blocks.columns:
        blocks = blocks.withColumn("doc_ids", F.lit(None).cast("array<bigint>"))
    kinds = "file string, block bigint, doc_ids array<bigint>, total bigint, tail bigint, lengths array<bigint>"
    found = blocks.select("file", F.col("block").cast("bigint").alias("block"), "tokens", "doc_ids").mapInArrow(scan, kinds)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = found.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))
    here = here.withColumn("since", F.col("start") + F.col("total") - F.col("tail"))
    here = here.withColumns({
        "open": F.coalesce(F.max("since").over(before), F.lit(0)),
        "ordinal": F.coalesce(F.sum(F.size("lengths")).over(before), F.lit(0)),
        "last": F.lead("block").over(order).isNull(),
    })
    here = written(here, "token-blocks")  # a short row for each block, so that the blocks are scanned once
    carried = F.col("start") - F.col("open")
    done = here.select("file", "doc_ids", "ordinal", carried.alias("carried"), F.posexplode("lengths").alias("k", "inside")).select(
        "file", (F.col("ordinal") + F.col("k")).alias("ordinal"),
        (F.col("inside") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("ended"), F.expr("try_element_at(doc_ids, k + 1)").alias("doc_id"),
    )
    open_tail = F.when(F.col("tail").isNull(), carried + F.col("total")).otherwise(F.col("tail"))
    left = here.where("last").select(
        "file", (F.col("ordinal") + F.size("lengths")).alias("ordinal"), open_tail.alias("n_tokens"), F.lit(False).alias("ended"), F.lit(None).cast("bigint").alias("doc_id"))
    return done.unionByName(left.where("n_tokens > 0"))
