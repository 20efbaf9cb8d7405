"""A stored index over vectors: inverted lists by cell, of which a search reads those near its queries alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.streaming.progress import stored

from .vectors import ROWS, _best, cosine_top_k, usable

#: Rows on which the centres are fitted, and cells at most, which bounds what goes to the driver and to each task.
FITTED, MOST_CELLS = 200_000, 16_384
#: Vectors on which the number of probed cells is measured, and the share of their neighbours that must lie in these.
TRIED, FOUND = 200, 0.95


def _units(column: pa.Array) -> np.ndarray:
    """Rows of an array of lists of one length, each of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, the nearest first: one matrix product, no array of rows x cells x dimensions."""
    away = (centres**2).sum(axis=1) - 2 * rows @ centres.T
    return np.argsort(away, axis=1, kind="stable")[:, :n]


def write_index(vectors: DataFrame, folder: str, k: int = 10, cells: int | None = None, share: float = FOUND, seed: int = 1) -> None:
    """Writes an index of vectors (resource_id, vector) to a new folder: their rows by cell, the centres, and how many cells a search must probe.

    There are as many cells as the square root of the rows unless a number is given, MOST_CELLS at most.  Centres are
    fitted on about FITTED rows; directions count, not lengths.  Every vector is put in its nearest cell; ranges of
    cell and id go to the files, so a large cell is several of them.  How many cells hold the given share of the k
    nearest others is measured once, by exact search for TRIED vectors, and stored.  Vectors that usable()
    refuses, and those not of the commonest length, are left out; repeated rows stand as they are.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("resource_id", "vector"))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length, n = lengths or (0, 0)
    rows = rows.where(F.size("vector") == length)
    cells = max(1, min(cells or math.ceil(math.sqrt(n)), MOST_CELLS, n))
    if n:
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        unit = rows.select(array_to_vector(F.transform(F.col("vector").cast("array<double>"), lambda x: x / F.greatest(norm, F.lit(1e-12)))).alias("unit"))
        sample = stored(unit.sample(FITTED / n, seed) if n > FITTED else unit, "sample")
        centres = np.array(KMeans(k=cells, seed=seed, featuresCol="unit", maxIter=10).fit(sample).clusterCenters())
    else:
        centres = np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _nearest(_units(batch.column("vector")), centres, 1)[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", *batch.schema.names])

    kind = vectors.schema["vector"].dataType.simpleString()
    put = rows.mapInArrow(assign, f"cell int, resource_id bigint, vector {kind}")
    put.repartitionByRange("cell", "resource_id").sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{folder}/lists")
    lists = spark.read.schema(put.schema).parquet(f"{folder}/lists")
    sizes = lists.groupBy("cell").agg(F.count("*").alias("rows"))
    places = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    places.join(sizes, "cell", "left").na.fill(0, ["rows"]).write.parquet(f"{folder}/centres")
    probed, recall = _measured(lists, centres, k, share)
    spark.createDataFrame([(n, len(centres), length, k, probed, recall)], "n bigint, cells int, dimension int, k int, probed int, recall double").write.parquet(f"{folder}/about")


def _measured(lists: DataFrame, centres: np.ndarray, k: int, share: float) -> tuple[int, float]:
    """How many of its nearest cells a query must probe so that they hold the share of its k nearest others, and the share they hold."""
    tried = lists.orderBy(F.xxhash64("resource_id"), "resource_id").limit(TRIED).select(F.monotonically_increasing_id().alias("query_id"), "resource_id", "vector")
    tried = stored(tried, "tried")
    others = cosine_top_k(lists.select("resource_id", "vector"), tried.select("query_id", "vector"), k + 1)
    own = tried.select("query_id", F.col("resource_id").alias("own"))
    found = others.join(own, "query_id").where("resource_id <> own").join(lists.select("resource_id", "cell"), "resource_id").select("query_id", "cell").toPandas()
    if not len(found):
        return 1, 1.0
    asked = tried.select("query_id", F.col("vector").cast("array<double>")).toPandas()
    q = np.stack(asked["vector"].to_list())
    place = np.argsort(_nearest(q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12), centres, len(centres)), axis=1)
    row = dict(zip(asked["query_id"], range(len(asked)), strict=True))
    needed = np.sort(place[found["query_id"].map(row), found["cell"]]) + 1
    probed = int(needed[math.ceil(share * len(needed)) - 1])
    return probed, float((needed <= probed).mean())


def about(spark: SparkSession, folder: str) -> dict:
    """n, cells, dimension, k, probed and recall of a stored index."""
    return spark.read.parquet(f"{folder}/about").first().asDict()


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int, probed: int | None = None) -> DataFrame:
    """The k vectors of largest cosine to each query (query_id, vector) in the cells nearest to it: query_id, rank, resource_id, score (6 decimals).

    probed cells are searched for each query, as many as the index has stored unless a number is given.  The cells
    that any query needs, at most as many numbers as the index has cells, prune the folders read.  Each cell's rows and
    the queries that probe it are one matrix product, a large cell's in several parts; k rows a query go on.  Queries that
    usable() refuses, and those of another length than the index, have no rows; ties go to the smaller id.
    """
    told = about(spark, folder)
    probed = told["probed"] if probed is None else probed
    known = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in known], np.float64) if known else np.zeros((0, 1))
    parts = {r["cell"]: max(1, -(-r["rows"] // ROWS)) for r in known}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            best = _nearest(_units(batch.column("vector")), centres, probed)
            row = np.repeat(np.arange(len(best)), best.shape[1])
            cell = best.ravel()
            times = np.array([parts[c] for c in cell.tolist()])
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), batch.column("vector").take(pa.array(row))], names=["query_id", "cell", "part", "asked"])

    asked = usable(queries.select("query_id", "vector")).where(F.size("vector") == told["dimension"])
    kind = queries.schema["vector"].dataType.simpleString()
    wanted = stored(asked.mapInArrow(near, f"query_id bigint, cell int, part int, asked {kind}"), "probes")
    needed = [r[0] for r in wanted.select("cell").distinct().collect()]
    lists = spark.read.parquet(f"{folder}/lists").where(F.col("cell").isin(needed)) if needed else spark.read.parquet(f"{folder}/centres").limit(0).select("cell", F.lit(0).cast("bigint").alias("resource_id"), F.col("centre").alias("vector"))
    several = F.broadcast(spark.createDataFrame([(c, p) for c, p in parts.items() if p > 1], "cell int, parts int"))
    lists = lists.join(several, "cell", "left").withColumn("part", F.pmod(F.xxhash64("resource_id"), F.coalesce("parts", F.lit(1))).cast("int"))

    def unit(rows: pd.Series) -> np.ndarray:
        a = np.stack([np.asarray(r, np.float64) for r in rows])
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)

    def search(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(own) and len(asks):
            ids = own["resource_id"].to_numpy()
            for query, row in zip(asks["query_id"], np.round(unit(asks["asked"]) @ unit(own["vector"]).T, 6), strict=True):
                best = _best(row, ids, k)
                made.append(pd.DataFrame({"query_id": query, "resource_id": ids[best], "score": row[best]}))
        return pd.concat(made) if made else pd.DataFrame({"query_id": [], "resource_id": [], "score": []})

    both = lists.select("cell", "part", "resource_id", "vector").groupBy("cell", "part").cogroup(wanted.groupBy("cell", "part"))
    found = both.applyInPandas(search, "query_id bigint, resource_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "resource_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "resource_id", "score")
