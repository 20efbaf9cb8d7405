"""Rows that are dealt out once: exchanges in the plans of queries over all files."""

from pyspark.sql import functions as F

from assetflow.operators import registration as R
from assetflow.operators.lifecycle import accepted_uploads
from assetflow.plans import models, stages  # noqa: F401 - they register their queries
from assetflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_uploads_are_dealt_out_once(spark):
    assert exchanges(QUERIES["upload_batches"](spark, SF)) <= 2


def test_uploads_without_a_name(spark):
    a, b = "a" * 32, "b" * 32
    uploads = spark.createDataFrame([("r", 1, None, a, 5, "x"), (None, 1, "n", a, 6, "y"), ("r", 2, "n", a, 7, "z")], "resource_id string, ord int, name string, etag string, size long, md5 string")
    known = spark.createDataFrame([("r", 1, None, b), (None, 1, "n", b), ("q", 1, "n", b)], "resource_id string, ord int, name string, md5 string")
    files, batches = accepted_uploads(uploads, known)
    assert files.columns == uploads.columns and files.count() == 3
    assert sorted((r["resource_id"] or "", r["success"], r["uploaded_bytes"], r["file_count"]) for r in batches.collect()) == [("", True, 6, 1), ("r", True, 12, 2)]


def test_details_read_the_files_of_tasks_alone(spark):
    assert "GreaterThanOrEqual(l_orderkey" in QUERIES["resource_detail"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_details_of_odd_tasks(spark):
    """Repeated requests and tasks, an id that two resources share, tasks without an id, requests that mean nothing."""
    requests = spark.createDataFrame([(r, i) for i, r in enumerate(["a", "a", "b", "c", "d", None, "e"])], "resource_id string, n int")
    tasks = spark.createDataFrame([("a", 1, "t1", '["x"]'), ("b", 2, "t2", "no"), ("b", 2, "t2", "no"), ("c", None, "t3", '["y"]'), ("d", 1, "t4", None), (None, 5, "t5", None), ("z", 9, "t6", None)], "resource_id string, id long, title string, tags_json string")
    files = spark.createDataFrame([(1, 2, "q"), (1, 1, "p"), (7, 1, "r"), (100, 1, "s"), (None, 1, "t")], "task_id long, ord int, path string")
    previews = files.select("task_id", F.col("ord").alias("id"), "path").where("path <> 'p'")
    said = spark.createDataFrame([(2, 1, "old"), (2, 2, "new"), (None, 3, "none")], "task_id long, id long, main string")
    vectors = spark.createDataFrame([(1, 1, 64), (None, 2, 64)], "task_id long, id long, dimension int")
    got = R.details(requests, tasks, files, previews, said, vectors)
    assert got.columns == ["resource_id", "n", "id", "title", "files", "previews", "description", "embedding", "tags", "status"]
    rows = sorted((r["n"], r["status"], r["id"], r["title"], r["files"] and [f["path"] for f in r["files"]], r["previews"] and len(r["previews"]), r["description"] and r["description"]["main"], r["embedding"] and r["embedding"]["dimension"], r["tags"]) for r in got.collect())
    one = ("found", 1, "t1", ["p", "q"], 1, None, 64, ["x"])
    two = (2, "found", 2, "t2", [], [], "new", None, [])
    assert rows == [(0, *one), (1, *one), two, two, (3, "found", None, "t3", [], [], None, None, ["y"]), (4, "found", 1, "t4", ["p", "q"], 1, None, 64, []), (5, "not_found", *[None] * 7), (6, "not_found", *[None] * 7)]
    assert [r["status"] for r in R.details(requests, tasks.limit(0), files, previews, said, vectors).collect()] == ["not_found"] * 7
