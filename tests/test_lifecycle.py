"""Copies and uploads against what is noted, bytes that are no UTF-8, observed totals, tables in buckets."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assetflow.operators import entities as E
from assetflow.operators.lifecycle import accepted_uploads, copy_plan
from assetflow.plans import storage
from assetflow.sources import buckets as B
from assetflow.sources import files as S
from assetflow.streaming.progress import state_folder


def test_copy_plan(spark):
    scan = spark.createDataFrame([("keep", 1, 1), ("size", 2, 1), ("time", 1, 2), ("lost", 1, 1), ("none", 1, 1), ("new", 1, None), ("same", None, None), (None, 1, 1), ("keep", 1, 1)], "path string, size long, modified long")
    state = spark.createDataFrame([("keep", 1, 1, "c/keep", ["p"]), ("size", 1, 1, "c/size", ["p"]), ("time", 1, 1, "c/time", ["p"]), ("lost", 1, 1, "c/lost", ["p"]), ("none", 1, 1, None, ["p"]), ("same", None, None, "c/same", None), ("gone", 1, 1, "c/gone", ["p"])], "path string, size long, modified long, copied string, previews array<string>")
    held = spark.createDataFrame([(f"c/{p}",) for p in ("keep", "size", "time", "same", "gone", "keep")] + [(None,)], "path string")
    rows = copy_plan(scan, state, held.where("path is null or path <> 'c/gone'").unionByName(held.where("path = 'c/gone'"))).collect()
    got = {r["path"]: (r["outcome"], r["copied"], r["previews"]) for r in rows}
    assert len(rows) == 8 and got == {
        "keep": ("keep", "c/keep", ["p"]), "size": ("overwrite", "c/size", []), "time": ("overwrite", "c/time", []), "lost": ("new", None, []), "none": ("new", None, []), "new": ("new", None, []),
        "same": ("keep", "c/same", []), "gone": ("vanished", "c/gone", [])}
    assert copy_plan(scan.limit(0), state.limit(0), held.limit(0)).collect() == []


def test_uploads(spark):
    a, b = "a" * 32, "b" * 32
    rows = [("r", 1, "x", None, 5), ("r", 2, "y", f'"{a}"', 6), ("r", 3, "z", f'"{b}-2"', 7), ("r", 4, "y", a, 8), ("s", 1, "unknown", b, 1), ("s", 2, "empty", b, 2), ("s", 3, "null", b, 3), ("s", 4, "short", "abc", 4), ("t", 1, "y", b, 9)]
    uploads = spark.createDataFrame(rows, "resource_id string, ord int, name string, etag string, size long")
    known = spark.createDataFrame([("r", 1, "x", a), ("r", 2, "y", b), ("r", 3, "y", a), ("r", 4, "z", a), ("s", 1, "empty", ""), ("s", 2, "null", None), ("s", 3, "short", a), ("t", 1, "y", a)], "resource_id string, ord int, name string, md5 string")
    files, batches = accepted_uploads(uploads, known)
    assert sorted((r["resource_id"], r["ord"]) for r in files.collect()) == [("r", 1), ("r", 2), ("s", 1), ("s", 2), ("s", 3), ("s", 4)]
    got = {r["resource_id"]: tuple(r)[1:] for r in batches.collect()}
    assert got == {"r": (False, 11, 2, f"MD5 mismatch for z: expected={a}, actual={b}"), "s": (True, 10, 4, ""), "t": (False, 0, 0, f"MD5 mismatch for y: expected={a}, actual={b}")}


def test_bytes_that_are_no_utf8(spark):
    r = random.Random(3)
    pieces = [b"a", b"\xff", "é".encode(), "漢".encode(), "\U0001f600".encode(), b"\xe2\x82", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80", "�".encode(), b"$1", b"\\"]
    texts = [b"".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t binary").select(S.decodable(F.col("t").cast("string")).alias("s")).collect()
    assert [x["s"] for x in got] == [t.decode("utf-8", "ignore") for t in texts]


def test_modes_of_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"a": 1}\n\n  \r\n{"a": 2, "b": "x\xffy"}\nbad\n{"a": 3}\r\n')
    schema = "a int, b string"
    rows, rejects = S.json_lines(spark, str(tmp_path), schema)
    assert sorted(r["a"] for r in rows.collect()) == [1, 3] and rejects.count() == 2
    rows, rejects = S.json_lines(spark, str(tmp_path), schema, ignore=True)
    assert sorted((r["a"], r["b"]) for r in rows.collect()) == [(1, None), (2, "xy"), (3, None)] and rejects.count() == 0
    with pytest.raises(PySparkException):
        S.json_lines(spark, str(tmp_path), schema, strict=True)[0].collect()
    (tmp_path / "x.jsonl").write_bytes(b'{"a": 1}\n{"a": 2, "b": "x\xffy"}\n')
    with pytest.raises(PySparkException):
        S.json_lines(spark, str(tmp_path), schema, strict=True)[0].collect()


def test_totals_come_from_the_pass_that_writes(spark):
    folder = state_folder(spark, "lines")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    rows = spark.range(50).mapInPandas(seen, "id long")
    assert S.append_lines(rows, folder, n=F.count("*"), most=F.max("id")) == {"n": 50, "most": 49} and calls.value == 50
    assert S.append_lines(rows, folder) == {} and spark.read.json(folder).count() == 100
    entries = spark.range(40).select((F.col("id") % 30).alias("id"), F.col("id").alias("seq"), F.lit(" Image").alias("resource_type"), F.lit("s").alias("source"))
    calls.value = 0
    found = E.matching(entries.mapInPandas(seen, entries.schema), "image", "S", 5)
    assert [r["matching"] for r in found.collect()] == [30] * 5 and found.count() == 5 and calls.value == 40


@pytest.mark.parametrize("name", ["bucketed_rollup", "bucketed_join"])
def test_buckets_need_no_shuffle(spark, name):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(storage, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_buckets_are_known_to_a_later_reader(spark):
    path = f"{state_folder(spark, 'bucketed')}/t"
    B.write_buckets(spark.range(100).select((F.col("id") % 9).alias("a key"), F.when(F.col("id") > 3, F.array("id")).alias("xs")), path, "a key", 4)
    again = B.read_buckets(spark, path, "a key", 4)
    assert again.count() == 100 and "Exchange" not in again.groupBy("a key").count()._jdf.queryExecution().executedPlan().toString()
