"""Following appended rows, dispatch by type."""

from pyspark.sql import functions as F

from assetflow.operators.dispatch import by_type
from assetflow.streaming.progress import follow, state_folder

SCHEMA = "k string, n int, v string"


def test_follow_goes_on_where_it_stopped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    state = lambda: {r["k"]: r["v"] for r in follow(read(), folder, "k", "n").collect()}
    add([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z"), (None, 1, "none")])
    assert state() == {"a": "y", "b": "z"}
    add([("b", 6, "newer"), ("a", 1, "older")])
    add([("c", 1, "first")])
    assert state() == {"a": "y", "b": "newer", "c": "first"}
    assert state() == {"a": "y", "b": "newer", "c": "first"}


def test_dispatch_keeps_rows_of_other_types(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, kind string")
    got = by_type(rows, "kind", {"a": lambda x: x.withColumn("made", F.lit("m"))})
    assert sorted((r["id"], r["made"]) for r in got.collect()) == [(1, "m"), (2, None), (3, None)]
    assert by_type(rows, "kind", {}).count() == 3


def test_a_batch_writes_its_own_buckets_alone(spark):
    folder = state_folder(spark, "buckets")
    arrive = lambda rows: spark.createDataFrame(rows, "key long, at long, value string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    now = lambda: follow(spark.readStream.schema("key long, at long, value string").parquet(f"{folder}/in"), f"{folder}/out", "key", "at")
    files = lambda: {r[0]: r[1] for r in spark.read.option("recursiveFileLookup", True).format("binaryFile").load(f"{folder}/out/state").select("path", "length").collect()}
    arrive([(k, 1, "old") for k in range(2000)] + [(None, 1, "none")])
    assert now().count() == 2000
    first = files()
    arrive([(7, 2, "new"), (7, 1, "late"), (3000, 1, "more")])
    got = {r["key"]: r["value"] for r in now().collect()}
    added = files().keys() - first.keys()
    assert len(got) == 2001 and got[7] == "new" and got[3000] == "more" and got[8] == "old"
    assert len(added) <= 2 and sum(files()[f] for f in added) < sum(first.values()) / 10
    arrive([(7, 3, "newest")])
    assert {r["key"]: r["value"] for r in now().collect()}[7] == "newest"
    arrive([(9, 3, "x")])
    now()
    assert len([f for f in files() if "version-0" in f]) < len(first)  # what two later lists don't name has gone
    assert now().count() == 2001
