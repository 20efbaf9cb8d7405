"""Names without clashes against copying one by one."""

import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from assetflow.operators import names as N


def copied(files):
    taken, out = set(), []
    for category, name in files:
        target, k = name, 1
        if name is not None:
            path = PurePosixPath(name)
            while (category or "", target) in taken:
                target, k = f"{path.stem}_{k}{path.suffix.lower()}", k + 1
            taken.add((category or "", target))
        out.append(target)
    return out


def targets(spark, files):
    rows = spark.createDataFrame([(i, c, n, "x") for i, (c, n) in enumerate(files)], "path long, folder string, file string, target string").repartition(3)
    got = N.unique_names(rows, F.col("folder"), F.col("file"), "path")
    assert got.columns == ["path", "folder", "file", "category", "name", "target"]
    return [r["target"] for r in sorted(got.collect(), key=lambda r: r["path"])]


CASES = [
    ["a.png", "a.png", "a_1.png"], ["a.png", "a_1.png", "a.png"], ["a_1.png", "a.png", "a.png", "a_1.png", "a_1_1.png"], ["a.PNG", "a.png", "a.PNG", "a_1.PNG", "a_1.png", "a.png"],
    [".x", ".x", "a.", "a.", "n", "n", "n_1", None, None, "a_01.b", "a.b", "a.b", "a_1.b.c", "a_0.b", "a_99999999999999999999.b"], ["a.png"], ["b.x\ny", "b.x\ny"]]


def test_cases(spark):
    """Each case in a category of its own, and a null category as the empty one."""
    files = [(f"c{i}" if i else None, n) for i, names in enumerate(CASES) for n in names] + [("", "a.png")]
    assert targets(spark, files) == copied(files)


def test_nested_numbers(spark):
    r = random.Random(4)
    name = lambda: "a" + "".join(f"_{r.randint(1, 4)}" for _ in range(r.choice([0, 0, 0, 1, 1, 2]))) + r.choice([".x", ".x", ".X"])
    files = [(f"c{r.randrange(8)}", name()) for _ in range(500)]
    got = targets(spark, files)
    assert got == copied(files)
    assert len({(c, t) for (c, _), t in zip(files, got, strict=True)}) == len(files)


def test_names_that_are_all_free(spark):
    assert targets(spark, [("c", "a.png"), ("d", "a.png"), ("c", None)]) == ["a.png", "a.png", None]
    assert targets(spark, []) == []
