"""Model stages: each distinct input is asked once, whatever is made of the answers."""

import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetflow.operators import delivery as D
from assetflow.operators import memo as M
from assetflow.operators import providers as P
from assetflow.streaming.progress import state_folder


@pytest.fixture
def counted():
    """Options of a provider that leaves a file for every call, and what counts the calls by text."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def calls():
        return Counter(open(os.path.join(folder, f)).read() for f in os.listdir(folder))

    return {"folder": folder}, calls


@pytest.fixture(autouse=True)
def provider(monkeypatch):
    def counting(folder, dim=3):
        def call(text):
            handle, _ = tempfile.mkstemp(dir=folder)
            os.write(handle, (text or "").encode())
            os.close(handle)
            if text and text.startswith("bad"):
                raise ValueError("refused")
            return [float(len(text or ""))] * dim

        return call

    monkeypatch.setitem(P.FACTORIES, "counting", counting)


def test_each_text_once(spark, counted):
    options, calls = counted
    folder = state_folder(spark, "answers")
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["aa", "aa", "b", None, None, "", "bad", "bad"] + ["hot"] * 40)], "i long, t string, status string").repartition(5)
    first = M.answered(rows, "t", ["counting"], "array<double>", options, 0, folder)
    assert first.columns == ["i", "t", "result", "status", "error", "attempts"]
    got = first.collect()
    assert len(got) == 48 and first.count() == 48 and [r["error"] for r in got if r["t"] == "bad"] == ["refused"] * 2
    assert calls() == Counter(["aa", "b", "", "", "bad", "hot"])
    more = rows.unionByName(spark.createDataFrame([(99, "new", "x")], rows.schema))
    again = M.answered(more, "t", ["counting"], "array<double>", options, 0, folder)
    assert again.count() == 49 and calls() == Counter(["aa", "b", "", "", "bad", "bad", "hot", "new"])
    assert {r["result"][0] for r in again.where("t = 'hot'").collect()} == {3.0}
    M.answered(rows.where("t = 'b'"), "t", ["counting"], "array<double>", options, 0, folder, "another").count()
    assert calls()["b"] == 2


def test_commit_asks_once_for_all_tables(spark, counted):
    options, calls = counted
    asked = spark.createDataFrame([(f"r{i}", f"text {i % 7}", "d", "f") for i in range(30)] + [("none", "text 0", "d", "f")], "resource_id string, description_main string, description_detail string, description_full string")
    tasks = spark.range(30).select(F.concat(F.lit("r"), "id").alias("resource_id"), "id", F.when(F.col("id") == 3, "committed").otherwise("x").alias("process_state"), F.lit("t").alias("resource_type"))
    made = D.commit(asked, tasks, ["counting"], 3, "v", options, 0)
    sizes = {name: len(df.collect()) for name, df in made.items()}
    assert sizes == {"answers": 31, "descriptions": 29, "embeddings": 29, "vectors": 29, "states": 29, "logs": 29}
    assert calls() == Counter(f"text {i}" for i in range(7))


def test_validated(spark):
    good = "主体：字体" + "体" * 60 + "\n细节：" + "节" * 60
    rows = spark.createDataFrame([(1, good), (2, "short"), (3, "shorter"), (4, None), (5, "")], "i long, t string")
    got = {r["i"]: (r["status"], r["error"], r["attempts"], r["result"]) for r in M.answered(rows, "t", ["echo", "two_lines"], retries=1, described=F.lit("font")).collect()}
    assert got[1] == ("ok", None, 1, good) and got[3] == ("ok", None, 3, good)
    assert got[2] == ("failed", "FORMAT_ERROR|期望2行，实际1行", 4, None) and got[5][:3] == ("failed", "FORMAT_ERROR|期望2行，实际1行", 4)
    assert got[4][0] == "failed"
    none = spark.createDataFrame([], "i long, t string")
    assert M.answered(none, "t", ["echo"], described=F.lit("font")).collect() == []
