"""Headers, writing of files and the checks of previews on odd inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from assetflow.plans import pictures as P
from assetflow.sources import images as I
from assetflow.streaming.progress import state_folder


@pytest.mark.parametrize(("body", "told"), [
    (b"", (None, -1, -1)), (b"BM", (None, -1, -1)), (b"\xff\xd8", (None, -1, -1)), (b"\xff\xd8\xff\xe0\x00\x04ab\x00\x00", (None, -1, -1)), (b"RIFF....WEBPVP8?" + b"\0" * 20, (None, -1, -1)),
    (P._jpeg(70_00, 65_535, 60_000), ("jpeg", 7000, 65535)), (P._webp(16_384, 1, b"VP8L"), ("webp", 16384, 1)), (P._webp(65_000, 5, b"VP8X"), ("webp", 65_000, 5)),
    (b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, 9, 8, 1, 24), ("bmp", 9, 8)), (P._gif(300, 2), ("gif", 300, 2)), (P._png(3, 2, b"\1\2\3\4"), ("png", 3, 2)),
])
def test_header(body, told):
    assert I.header(memoryview(body)) == told


def test_files_are_written_once_each(spark):
    folder = f"{state_folder(spark, 'written')}/files"
    rows = spark.createDataFrame([("a/x.bin", b"one"), ("a/x.bin", b"one"), ("b/y.bin", b""), (None, b"z"), ("c", None)], "name string, content binary")
    assert I.write_files(rows, folder) == 3
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("content")).collect()
    assert [bytes(r[0]) for r in found] == [b"one"]
    asked = spark.createDataFrame([("a/x.bin", 9), ("b/y.bin", 9), ("a", 9), ("none", 9), (None, 9)], "path string, length int")
    assert [r["length"] for r in I.file_sizes(asked, folder).collect()] == [3, 0, None, None, None]


def test_checks_of_previews(spark):
    folder = f"{state_folder(spark, 'previews')}/files"
    files = [("t.gif", b"GIF89a"), ("thin.png", P._png(1, 64, b"\0\1\0")), ("grey.png", P._png(64, 64, b"\xff")), ("clear.png", P._png(70, 70, b"\0\0\0\0")), ("alpha.png", P._png(70, 70, b"\1\0\0\0"))]
    I.write_files(spark.createDataFrame(files, "name string, content binary"), folder)
    expected = spark.createDataFrame([(n, "x", 1) for n, _ in files] + [("thin.png", "x", 1), (None, "x", 1)], "path string, reason string, width int")
    shown = I.pixel_range(spark, folder).withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))
    got = I.check_previews(I.file_sizes(expected, folder), shown)
    assert got.columns == ["path", "width", "length", "passed", "reason", "oversized"]
    told = [(r["path"], r["reason"]) for r in got.collect()]
    assert sorted(told, key=str) == sorted([("t.gif", I.BROKEN), ("thin.png", ""), ("thin.png", ""), ("grey.png", I.WHITE), ("clear.png", I.BLACK), ("alpha.png", ""), (None, I.MISSING)], key=str)
