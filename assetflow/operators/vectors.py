"""Cosine search over stored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of vectors and in a block of queries.
ROWS, ASKED = 16_384, 1_024


def usable(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """The rows whose vector isn't null or empty and holds no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, by partition selection."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        return np.concatenate([above, level[np.argsort(ids[level], kind="stable")[: k - len(above)]]])
    return np.arange(len(scores))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    """The k vectors of largest cosine for each query: query_id, rank, resource_id, score (6 decimals).

    vectors: resource_id, vector; queries: query_id, vector.  With a column kind on both, a query that
    has one meets only vectors of that kind, before the ranking; scores below the threshold go after it.
    Both are dealt into blocks, so neither is broadcast whole; each pair of blocks is one matrix product,
    of which k per query go on.  Vectors that usable() refuses take no part, and those of another length
    than the query's don't meet it.
    """
    kinds = "kind" in vectors.columns and "kind" in queries.columns
    vectors, queries = usable(vectors), usable(queries)
    n, m = (max(1, -(-x.count() // size)) for x, size in ((vectors, ROWS), (queries, ASKED)))
    each = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    kind = F.col("kind").cast("string").alias("kind") if kinds else F.lit(None).cast("string").alias("kind")
    left = vectors.select(F.pmod(F.xxhash64("resource_id"), F.lit(n)).cast("int").alias("v"), each(m).alias("q"), "resource_id", "vector", kind)
    right = queries.select(each(n).alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("q"), "query_id", "vector", kind)

    def unit(rows: pd.Series) -> np.ndarray:
        a = np.stack([np.asarray(r, np.float64) for r in rows])
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "resource_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        for length, wanted in asked.groupby(asked["vector"].map(len)) if len(asked) else ():
            own = block[block["vector"].map(len) == length]
            if not len(own):
                continue
            ids, kind_of = own["resource_id"].to_numpy(), own["kind"].to_numpy()
            for query, only, row in zip(wanted["query_id"], wanted["kind"], np.round(unit(wanted["vector"]) @ unit(own["vector"]).T, 6), strict=True):
                at = np.flatnonzero(kind_of == only) if kinds and only is not None else np.arange(len(ids))
                best = at[_best(row[at], ids[at], k)]
                parts.append(pd.DataFrame({"query_id": query, "resource_id": ids[best], "score": row[best]}))
        return pd.concat(parts) if len(parts) > 1 else parts[0]

    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInPandas(search, "query_id bigint, resource_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "resource_id")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") >= threshold))

