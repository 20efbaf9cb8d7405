"""The stored index keeps nine tenths of the exact neighbours at every size, and reads the cells that it needs alone."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetflow.operators import vector_index as V
from assetflow.operators.vectors import cosine_top_k
from assetflow.plans import models
from assetflow.streaming.progress import state_folder


def share(got, want):
    got, want = ({(r.query_id, r.resource_id) for r in x.collect()} for x in (got, want))
    return len(got & want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_query_finds_most(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("resource_id"), F.col("embedding").alias("vector"))
    asked = e.where("resource_id % 100 = 0").select(F.col("resource_id").alias("query_id"), "vector")
    found = share(models.probed_top_k(spark, f"/root/testdata/{sf}"), cosine_top_k(e, asked, 10))
    print(sf, round(found, 4))
    assert found >= 0.9


def test_every_vector_finds_most(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("resource_id"), F.col("embedding").alias("vector"))
    asked = e.select(F.col("resource_id").alias("query_id"), "vector")
    folder = state_folder(spark, "index")
    V.write_index(e, folder)
    found = share(V.search_index(spark, folder, asked, 10), cosine_top_k(e, asked, 10))
    told = V.about(spark, folder)
    print(told, round(found, 4))
    assert found >= 0.9 and told["recall"] >= V.FOUND and told["cells"] == 23 and told["n"] == 500


@pytest.fixture(scope="module")
def clusters(spark):
    """An index of 4,000 vectors around 40 directions, of which one has a third of the rows."""
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(40, 16))
    of = np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 40, 4000))
    vectors = spark.createDataFrame([(i, [float(x) for x in heads[c] + rng.normal(size=16) * 0.2]) for i, c in enumerate(of)], "resource_id long, vector array<float>")
    folder = state_folder(spark, "index")
    V.write_index(vectors, folder)
    return vectors, folder, of


def test_a_search_reads_few_rows(spark, clusters):
    vectors, folder, of = clusters
    asked = vectors.where(F.col("resource_id").isin([i for i in range(4000) if of[i]][:2])).select(F.col("resource_id").alias("query_id"), "vector")
    found = V.search_index(spark, folder, asked, 10)
    assert share(found, cosine_top_k(vectors, asked, 10)) >= 0.9
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[([^]]+)\]", plan)[1]
    cells = [int(c) for c in re.findall(r"(?<![#\d])\d+", pruned)]
    read = spark.read.parquet(f"{folder}/lists").where(F.col("cell").isin(cells)).count()
    assert 0 < read < 4000 / 5


def test_a_large_cell_is_searched_in_parts(spark, clusters, monkeypatch):
    vectors, folder, of = clusters
    monkeypatch.setattr(V, "ROWS", 50)
    hot = [i for i in range(4000) if not of[i]][:5]
    asked = vectors.where(F.col("resource_id").isin(hot)).select(F.col("resource_id").alias("query_id"), "vector")
    every = V.about(spark, folder)["cells"]
    got, want = V.search_index(spark, folder, asked, 7, every), cosine_top_k(vectors, asked, 7).select("query_id", "rank", "resource_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [None, 1.0]), (8, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "resource_id long, vector array<double>")
    folder = state_folder(spark, "index")
    V.write_index(vectors, folder, 2)
    got = V.search_index(spark, folder, vectors.withColumnRenamed("resource_id", "query_id"), 9, 99).collect()
    assert {r["query_id"] for r in got} == {1, 2, 8} == {r["resource_id"] for r in got}
    assert [r["resource_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 8] == [1, 1, 2][:0] + [8, 1, 1, 2]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "resource_id bigint, vector array<float>")
    folder = state_folder(spark, "index")
    V.write_index(none, folder)
    assert V.search_index(spark, folder, none.withColumnRenamed("resource_id", "query_id"), 10).collect() == []
