"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates and in a block of queries.
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 1_024


def quantised(embeddings: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and terms (array of floor(scale * component)); vectors null or with null or non-finite components go."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(x(v)) == float("inf")))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(~F.coalesce(bad, F.lit(False)))
    return usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(vector, lambda v: F.floor(x(v) * scale).cast("bigint")).alias("terms"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, by partition selection."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        if len(level) > k - len(above):
            level = level[np.argpartition(ids[level], k - len(above) - 1)[: k - len(above)]]
        return np.concatenate([above, level])
    return np.arange(len(scores))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k highest integer inner products of every query: query_id, rank (from 1), vec_id, score.

    vectors, queries: vec_id bigint, terms array<bigint>.  A vector is a sparse row of (dimension,
    weight) terms; zero weights have no posting, unless most rows of a block have the dimension.  Each block of candidates is inverted into postings
    per dimension; each query scatters its weighted postings, a term at a time, into a dense array of
    scores, from which partition selection takes k; the blocks' bests are merged per query.  Every
    pair is scored: nothing is pruned.  Blocks bound a task's memory, and a query goes to each block
    of candidates once, so the data moved grows as queries x blocks, not as pairs.

    A query leaves out its own row alone: of the candidates with its vec_id and its terms, one.  Every
    other row is a candidate, and every row of queries is a query with ranks of its own, also where
    rows repeat or share a vec_id.  Ties go to the smaller vec_id.  Vectors of unequal length are padded
    with zeros, empty ones score 0.  Empty tables give no rows.
    """
    again = F.row_number().over(Window.partitionBy("vec_id").orderBy("terms"))
    vectors, queries = vectors.select("vec_id", "terms"), queries.select("vec_id", "terms").withColumn("again", again)
    n, m = vectors.count(), queries.count()
    over, across = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    place = lambda blocks, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select(place(over, 1).alias("c"), each(across).alias("q"), "vec_id", "terms")
    right = queries.select(each(over).alias("c"), place(across, 2).alias("q"), "vec_id", "terms", "again")

    def dense(rows: pd.Series, width: int) -> np.ndarray:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(list(rows)) if len(rows) else np.zeros(0, np.int64)
        out = np.zeros((len(rows), width), np.int64)
        out[np.repeat(np.arange(len(rows)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(block) and len(asked):
            width = max(block["terms"].map(len).max(), asked["terms"].map(len).max())
            ids, rows, wanted = block["vec_id"].to_numpy(), dense(block["terms"], width), dense(asked["terms"], width)
            largest = width * int(np.abs(rows).max(initial=0)) * int(np.abs(wanted).max(initial=0))
            if largest < 1 << 31:  # every partial score fits
                rows, wanted = rows.astype(np.int32), wanted.astype(np.int32)
            postings = []
            for t in range(width):
                held = np.flatnonzero(rows[:, t])
                few = 4 * len(held) < len(rows)  # else a list of rows costs more than the zeros that it leaves out
                postings.append((held, rows[held, t]) if few else (None, np.ascontiguousarray(rows[:, t])))
            scores, terms = np.empty(len(ids), rows.dtype), np.empty(len(ids), rows.dtype)
            for query, again, weights in zip(asked["vec_id"], asked["again"], wanted, strict=True):
                scores[:] = 0
                for t in np.flatnonzero(weights):
                    held, values = postings[t]
                    if held is None:
                        scores += np.multiply(values, weights[t], out=terms)
                    else:
                        scores[held] += weights[t] * values
                own = np.flatnonzero(ids == query)  # all rows of one vec_id lie in one block
                own = own[(rows[own] == weights).all(axis=1)][:1]
                others = np.delete(np.arange(len(ids)), own)
                best = others[_best(scores[others], ids[others], k)]
                parts.append(pd.DataFrame({"query_id": query, "again": again, "vec_id": ids[best], "score": scores[best].astype(np.int64)}))
        return pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "again", "vec_id", "score")})

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(search, "query_id bigint, again bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "again").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
