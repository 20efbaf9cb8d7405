"""Queries over pictures that tasks draw from the parts and write as files."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.sources import images as I
from assetflow.sources import working as W
from assetflow.streaming.progress import removed, state_folder

from .registry import query

_chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(width: int, height: int, pixel: bytes) -> bytes:
    """A picture of one colour (1, 3 or 4 channels), not compressed."""
    colour = {1: 0, 3: 2, 4: 6}[len(pixel)]
    body = zlib.compress((b"\0" + pixel * width) * height, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def _bmp(width: int, height: int, pixel: bytes, down: bool = False) -> bytes:
    row = pixel * width + b"\0" * (-3 * width % 4)
    size = len(row) * height
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + size, 0, 0, 54, 40, width, -height if down else height, 1, 24, 0, size, 0, 0, 0, 0) + row * height


def _gif(width: int, height: int) -> bytes:
    return struct.pack("<6sHHBBB", b"GIF89a", width, height, 0, 0, 0) + b"\x3b"


def _jpeg(width: int, height: int, notes: int) -> bytes:
    """The markers up to the frame, behind notes of some bytes."""
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 2 + notes) + b"\xff\xc0" * (notes // 2) + b"\xff\xff\xc0" + struct.pack(">HBHHB", 8, 8, height, width, 0) + b"\xff\xd9"


def _webp(width: int, height: int, kind: bytes) -> bytes:
    body = {
        b"VP8X": b"\0" * 4 + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"),
        b"VP8 ": b"\0" * 3 + b"\x9d\x01\x2a" + struct.pack("<HH", width, height),
        b"VP8L": b"\x2f" + struct.pack("<I", width - 1 | height - 1 << 14) + b"\0" * 5,
    }[kind]
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


# The pictures that stand on disk at a time, by their bytes and their number.
MOST_BYTES, MOST_FILES = 1 << 29, 50_000


def _in_rounds(spark, d, draw, weight: Column, look: Callable[[str, DataFrame, int], DataFrame]) -> DataFrame:
    """What look(folder, parts, tasks) tells of the files below a folder, one for each part for which draw(key, size) gives a name and bytes.

    Parts are dealt into rounds by their keys, as many as keep each one's pictures (weight: their bytes, about) within
    MOST_BYTES and MOST_FILES.  A round's files are drawn, looked at, and removed once their rows are written, so neither
    the disk nor the driver, which lists the files, holds more of them however many parts there are.
    """
    folder, tasks = state_folder(spark, "pictures"), max(8, spark.sparkContext.defaultParallelism)
    parts = W.table(spark, d, "part").select("p_partkey", "p_size")
    n, size = parts.agg(F.count("*"), F.coalesce(F.sum(weight.cast("double")), F.lit(0.0))).first()
    rounds = max(1, math.ceil(n / MOST_FILES), math.ceil(size / MOST_BYTES))
    dealt = parts.withColumn("round", F.pmod(F.xxhash64("p_partkey"), F.lit(rounds)))
    dealt.repartition("round").write.partitionBy("round").parquet(f"{folder}/parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a few pictures at a time, as they are large beside their keys
            for at in range(0, len(batch), 64):
                few = batch.iloc[at : at + 64]
                made = [x for x in map(draw, few["p_partkey"].tolist(), few["p_size"].tolist()) if x]
                yield pd.DataFrame(made, columns=["name", "content"])

    told = None
    for r in sorted(x[0] for x in spark.read.parquet(f"{folder}/parts").select("round").distinct().collect()):
        own = spark.read.schema(parts.schema).parquet(f"{folder}/parts/round={r}").repartition(tasks, "p_partkey")
        files = f"{folder}/round-{r}/files"
        I.write_files(own.mapInPandas(run, "name string, content binary"), files)
        told = look(files, own, tasks)
        told.write.mode("append").parquet(f"{folder}/told")
        removed(spark, f"{folder}/round-{r}")
    return spark.read.schema(told.schema).parquet(f"{folder}/told")


def _any_format(key: int, size: int) -> tuple[str, bytes]:
    w, h, k = size + 7, key % 300 + 1, key % 9
    body = [
        lambda: _png(w, h, b"\x05"), lambda: _gif(w, h), lambda: _bmp(w, h, b"\1\2\3"), lambda: _bmp(w, h, b"\1\2\3", True), lambda: _jpeg(w, h, 2 * size), lambda: _webp(w, h, b"VP8X"),
        lambda: _webp(w, h, b"VP8 "), lambda: _webp(w, h, b"VP8L"), lambda: b"\x89PNG\r\n\x1a\n cut"][k]()
    return f"s{key % 4}/p{key}.img", body


@query("""WITH p AS (SELECT p_partkey AS key, p_size + 7 AS w, p_partkey % 300 + 1 AS h, p_partkey % 9 AS k, p_size FROM part)
    SELECT 's' || (key % 4) || '/p' || key || '.img' AS name, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' WHEN 3 THEN 'bmp' WHEN 4 THEN 'jpeg' WHEN 8 THEN NULL ELSE 'webp' END AS format,
    CASE WHEN k = 8 THEN -1 ELSE w END::INT AS width, CASE WHEN k = 8 THEN -1 ELSE h END::INT AS height,
    CASE k WHEN 0 THEN 57 + 6 + 5 * greatest(1, ceil((w + 1) * h / 65535)) + (w + 1) * h WHEN 1 THEN 14 WHEN 2 THEN 54 + (3 * w + (4 - 3 * w % 4) % 4) * h WHEN 3 THEN 54 + (3 * w + (4 - 3 * w % 4) % 4) * h WHEN 4 THEN 19 + 2 * p_size WHEN 8 THEN 12 ELSE 30 END::BIGINT AS length FROM p""")
def image_metadata(spark, d):
    """Format, sides and bytes of a picture of each part, by its header: PNG, GIF, BMP from the bottom and from the top, JPEG behind notes, three kinds of WebP, and files cut off."""
    side = (F.col("p_size") + 8) * (F.col("p_partkey") % 300 + 1)
    weight = 4096 + F.when((F.col("p_partkey") % 9).isin(2, 3), 3 * side).when(F.col("p_partkey") % 9 == 0, side).otherwise(0)

    def look(folder, parts, tasks):
        found = I.scan_images(spark, folder, tasks)
        return found.select(F.regexp_extract("path", "/files/(.*)$", 1).alias("name"), "format", "width", "height", "length")

    return _in_rounds(spark, d, _any_format, weight, look)


def _preview(key: int, size: int) -> tuple[str, bytes] | None:
    w, h, name = size + 50, size + 40, f"p{key}.png"
    return [
        lambda: None, lambda: (name, b""), lambda: (name, b"no picture"), lambda: (name, _png(w, h, b"\0\0\0")), lambda: (name, _png(w, h, b"\xff\xff\xff\x07")), lambda: (name, _png(w, h, b"\0\0\0\xff")),
        lambda: (name, _png(w, h, b"\0\x07\0")), lambda: (name, _bmp(size + 200, 300, b"\xff\xff\xfe")), lambda: (name, _png(w, 200, b"\xff")), lambda: (f"p{key}.gif", _png(400, size + 300, b"\x10"))][key % 10]()


@query("""WITH p AS (SELECT p_partkey AS key, p_partkey % 10 AS k, p_size + 50 AS w, CASE WHEN p_partkey % 10 = 8 THEN 200 ELSE p_size + 40 END AS h, p_size FROM part),
    r AS (SELECT key, k, p_size, CASE WHEN k = 0 THEN 'File does not exist or is not a regular file' WHEN k = 1 THEN 'File is empty (0 bytes)' WHEN k = 2 THEN 'Cannot open image' WHEN k IN (3, 4, 5, 6) AND w < 64 AND h < 64 THEN 'Dimensions ' || w || 'x' || h || ' below minimum 64'
    WHEN k IN (3, 5) THEN 'Image is all black' WHEN k IN (4, 8) THEN 'Image is all white / blank' ELSE '' END AS reason FROM p)
    SELECT 'p' || key || CASE WHEN k = 9 THEN '.gif' ELSE '.png' END AS name, reason = '' AS passed, reason, k = 7 OR k = 9 AND 400 * (p_size + 300) > 200 * 1024 AS oversized FROM r""")
def preview_quality(spark, d):
    """What the check says of a preview of each part: missing, empty, broken, too small, black or white with and without an alpha channel, sound, or too large for its kind."""
    k, size = F.col("p_partkey") % 10, F.col("p_size")
    weight = 4096 + F.when(k == 7, 900 * (size + 200)).when(k == 9, 400 * (size + 300)).when(k == 8, 200 * (size + 51)).when(k > 2, 4 * (size + 51) * (size + 40)).otherwise(0)

    def look(folder, parts, tasks):
        names = parts.select(F.concat(F.lit("p"), "p_partkey", F.when(k == 9, ".gif").otherwise(".png")).alias("path"))
        shown = I.pixel_range(spark, folder, tasks).withColumn("path", F.regexp_extract("path", "/files/(.*)$", 1))
        checked = I.check_previews(I.file_sizes(names, folder, "path"), shown)
        return checked.select(F.col("path").alias("name"), "passed", "reason", "oversized")

    return _in_rounds(spark, d, _preview, weight, look)
