"""What naming leaves on disk: one table of those that its rounds replace, and no column twice."""

import glob

from pyspark.sql import functions as F

from assetflow.operators import names as N
from assetflow.streaming.progress import state_folder


def test_rounds_of_names_leave_one_table(spark):
    top = state_folder(spark, "x").rpartition("/")[0].removeprefix("file://")
    before = set(glob.glob(f"{top}/*"))
    files = ["a.png", "a_1.png", "a.png", "a_1.png", "a_1_1.png"]
    rows = spark.createDataFrame(list(enumerate(files)), "path long, file string")
    got = N.unique_names(rows, F.lit("c"), F.col("file"), "path")
    assert len({r["target"] for r in got.collect()}) == 5
    made = [p.rpartition("/")[2].rpartition("-")[0] for p in set(glob.glob(f"{top}/*")) - before]
    assert made.count("moved") == 1 and made.count("named") == 1 and made.count("numbered") <= 2
    named = next(p for p in set(glob.glob(f"{top}/*")) - before if "/named-" in p)
    assert spark.read.option("recursiveFileLookup", True).parquet(named).columns == ["row", "c", "name"]
