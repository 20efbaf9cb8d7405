"""Files that are read by their names."""

import json

from assetflow.sources import files as S


def test_pack_metadata_by_source_and_name(spark, tmp_path):
    for source, pack, body in (("web", "a_b", {"pack": {"description": "about", "tags": ["x", "y"]}}), ("shop", "a_b", {"pack": {"description": "other"}}), ("web", "c d", {})):
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / f"{pack}.json").write_text(json.dumps(body, indent=1))
    got = sorted(map(tuple, S.pack_metadata(spark, str(tmp_path)).collect()))
    assert got == [("shop", "a_b", "other", []), ("web", "a_b", "about", ["x", "y"]), ("web", "c d", "", [])]


def test_present_keys(spark):
    files = spark.createDataFrame([("s3://b/files/r1/x.png",), ("s3://b/files/r2/y.png",)], "path string")
    keys = spark.createDataFrame([("files/r1/x.png",), ("r2/y.png",), ("files/r1",), ("1/x.png",), ("files/r3/x.png",)], "key string")
    assert {r["key"] for r in S.present(keys, files).where("found").collect()} == {"files/r1/x.png", "r2/y.png"}


def test_task_tables_take_defaults_and_new_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert S.rows_of(spark, "log", folder).count() == 0
    S.insert("log", spark.createDataFrame([(7, "a"), (8, None)], "task_id long, event string"), folder, "task_id")
    S.insert("log", spark.createDataFrame([(7, "b", "more")], "task_id long, event string, note string"), folder, "task_id")
    got = sorted(tuple(r) for r in S.rows_of(spark, "log", folder).select("id", "task_id", "event", "detail", "created_at", "note").collect())
    assert got == [(1, 7, "a", None, "", None), (2, 8, "", None, "", None), (3, 7, "b", None, "", "more")]
    assert S.rows_of(spark, "log", folder, spark.createDataFrame([(8,)], "task_id long")).count() == 1
