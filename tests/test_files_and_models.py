"""Files, providers and inverted lists on small inputs."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from assetflow.operators import providers as P
from assetflow.operators.vector_index import search_index, write_index
from assetflow.operators.vectors import cosine_top_k
from assetflow.streaming.progress import state_folder
from assetflow.sources import files as S


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n{"a": 2\n  \n{"a": null}\n')
    rows, rejects = S.json_lines(spark, str(tmp_path), "a bigint")
    assert sorted((r.a for r in rows.collect()), key=str) == [1, None]
    assert [r.line for r in rejects.collect()] == ['{"a": 2']
    with pytest.raises(Exception, match="(?i)malformed"):
        S.json_lines(spark, str(tmp_path), "a bigint", strict=True)[0].collect()


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PNG").write_bytes(b"12345")
    (tmp_path / "sub" / "b.fbx").write_bytes(b"123")
    (tmp_path / "c.fbx").write_bytes(b"1234")
    files = S.scan_files(spark, str(tmp_path), content=True)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert got["a.PNG"].md5 == hashlib.md5(b"12345").hexdigest()
    assert [got[n].header_ok for n in ("a.PNG", "b.fbx", "c.fbx")] == [True, False, True]
    assert {r.path.rsplit("/", 1)[1] for r in S.accepted(files, ["fbx", "png"], 4).collect()} == {"c.fbx"}
    assert S.accepted(files, ["fbx", "png"], 9, 1).count() == 1
    kinds = {r.path.rsplit("/", 1)[1]: r.resource_type for r in S.typed(files, {"first": ["fbx"], "second": ["fbx", "png"]}).collect()}
    assert kinds == {"a.PNG": "second", "b.fbx": "first", "c.fbx": "first"}
    assert S.unchanged(files, files).count() == 3
    assert S.unchanged(files.withColumn("length", F.col("length") + 1), files).count() == 0


def test_ids(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = S.with_ids(rows, str(tmp_path), "k", first=5).collect()
    assert all(r.id == r.k + 5 for r in got) and len(got) == 1000


def test_providers(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "x" * 30), (3, " "), (4, None)], "i int, t string")
    got = {r.i: (r.result, r.status, r.error, r.attempts) for r in P.run(rows, "t", ["short_only", "template"]).collect()}
    assert got[1] == ("ok", "ok", None, 1)
    assert got[2] == ("x" * 30, "ok", None, 4)
    assert got[3] == (None, "failed", "blank input", 6) == got[4]
    checked = P.run(rows.where("i = 1"), "t", ["template"], check=lambda r: "TOO_SHORT" if len(r) < 5 else None, retries=1).first()
    assert (checked.status, checked.error, checked.attempts) == ("failed", "TOO_SHORT", 2)
    with pytest.raises(ValueError, match="known: .*template"):
        P.factory("none")


def test_patient():
    calls = []

    def busy(text):
        calls.append(text)
        if len(calls) < 3:
            raise RuntimeError("429 too many requests")
        return text

    assert P.patient(busy, 0.001)("a") == "a" and len(calls) == 3
    with pytest.raises(ValueError, match="other"):
        P.patient(lambda t: (_ for _ in ()).throw(ValueError("other")), 0.001)("a")


def test_checksum(spark):
    v = [0.5, -1.25, 3.0]
    got = spark.createDataFrame([(v,), (None,)], "v array<float>").select(P.vector_checksum("v").alias("m")).collect()
    assert {r.m for r in got} == {hashlib.md5(struct.pack("<3f", *v)).hexdigest(), None}


def test_probing_finds_most(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("resource_id"), F.col("embedding").alias("vector"))
    asked = e.where("resource_id % 100 = 0").select(F.col("resource_id").alias("query_id"), "vector")
    folder = state_folder(spark, "index")
    write_index(e, folder, cells=32)
    got = {(r.query_id, r.resource_id) for r in search_index(spark, folder, asked, 10, 16).collect()}
    want = {(r.query_id, r.resource_id) for r in cosine_top_k(e, asked, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
