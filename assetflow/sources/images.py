"""Pictures as sources: what their headers say, and the checks that a preview must pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# The least side of a preview, its greatest size in KB by kind, and what is told of one that fails.
LEAST_SIDE = 64
MOST_STATIC_KB, MOST_DYNAMIC_KB = 100, 200
MISSING = "File does not exist or is not a regular file"
EMPTY = "File is empty (0 bytes)"
BROKEN = "Cannot open image"
BLACK, WHITE = "Image is all black", "Image is all white / blank"

_HEADER = "path string, format string, width int, height int, length bigint"


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's content as a file of its own below the folder and tells how many there are.

    Tasks write their own rows, each file under another name first, so a task that is run again replaces what it
    left and no reader sees half a file.  The folder is any that pyarrow opens; rows with a null name or content are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        made = set()
        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = f"{base}/{own}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent)
                    made.add(parent)
                beside = f"{parent}/_{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(body.as_buffer())
                store.move(beside, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    kept = rows.where(F.col(name).isNotNull() & F.col(content).isNotNull()).select(F.col(name).cast("string"), F.col(content).cast("binary"))
    return kept.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _jpeg(body: memoryview) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(body):
        if body[at] != 0xFF:
            break
        kind = body[at + 1]
        if kind == 0xFF:  # fill bytes stand before a marker
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(body[at + 7 : at + 9], "big"), int.from_bytes(body[at + 5 : at + 7], "big")
        elif kind == 1 or 0xD0 <= kind <= 0xD8:  # markers without a length
            at += 2
        else:
            at += 2 + int.from_bytes(body[at + 2 : at + 4], "big")
    raise ValueError("no frame")


def header(body: memoryview) -> tuple[str | None, int, int]:
    """Format, width and height of a picture by its first bytes; (None, -1, -1) where it is none of PNG, GIF, BMP, JPEG and WebP, or cut off."""
    whole = lambda a, n, order="little", signed=False: int.from_bytes(body[a : a + n], order, signed=signed)
    body = body.cast("B")
    head = bytes(body[:16])
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n" and len(body) >= 24:
            return "png", whole(16, 4, "big"), whole(20, 4, "big")
        if head[:6] in (b"GIF87a", b"GIF89a") and len(body) >= 10:
            return "gif", whole(6, 2), whole(8, 2)
        if head[:2] == b"BM" and len(body) >= 26:
            if whole(14, 4) == 12:
                return "bmp", whole(18, 2), whole(20, 2)
            return "bmp", whole(18, 4, signed=True), abs(whole(22, 4, signed=True))  # rows from the top have a negative height
        if head[:2] == b"\xff\xd8":
            return "jpeg", *_jpeg(body)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(body) >= 30:
            if head[12:16] == b"VP8X":
                return "webp", whole(24, 3) + 1, whole(27, 3) + 1
            if head[12:16] == b"VP8 ":
                return "webp", whole(26, 2) & 0x3FFF, whole(28, 2) & 0x3FFF
            if head[12:16] == b"VP8L" and body[20] == 0x2F:
                bits = whole(21, 4)
                return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    except ValueError:
        pass
    return None, -1, -1


def scan_images(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """The files below a folder as pictures: path, format, width, height, length; format null and sides -1 where the header tells none.

    PNG, GIF, BMP, JPEG and WebP are known by their first bytes, not by their names.  Of a JPEG, whose frame may
    stand behind long notes, tasks see all bytes, of others the header alone; nothing is shuffled.  With a number of
    tasks, small files are read by no more than these.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    jpeg = F.substring("content", 1, 2) == F.lit(b"\xff\xd8")
    own = files.select("path", "length", F.when(jpeg, F.col("content")).otherwise(F.substring("content", 1, 64)).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header(memoryview(x.as_buffer())) if x.is_valid else (None, -1, -1) for x in batch.column("content")]
            kinds, widths, heights = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array(kinds, pa.string()), pa.array(widths, pa.int32()), pa.array(heights, pa.int32()), batch.column("length")], names=["path", "format", "width", "height", "length"])

    return (own if tasks is None else own.coalesce(tasks)).mapInArrow(run, _HEADER)


def pixel_range(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """The files below a folder decoded: path, length, width, height, darkest and brightest, the least and greatest value of red, green and blue.

    An alpha channel doesn't count.  Where a file can't be decoded (also every WebP, which the source doesn't know)
    sides are -1 and the range is null.  Each picture is decoded and reduced within its task, of which there are
    as many as Spark deals the files to, or no more than the number given.
    """
    shown = spark.read.format("image").option("recursiveFileLookup", True).load(folder)
    rows = shown.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for n, body in zip(batch.column("nChannels").to_pylist(), batch.column("data"), strict=True):
                pixels = np.frombuffer(body.as_buffer(), np.uint8) if body.is_valid else np.zeros(0, np.uint8)
                if n == 4:
                    pixels = pixels.reshape(-1, 4)[:, :3]
                low.append(int(pixels.min()) if pixels.size else None)
                high.append(int(pixels.max()) if pixels.size else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "length", "width", "height")), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["path", "length", "width", "height", "darkest", "brightest"])

    return (rows if tasks is None else rows.coalesce(tasks)).mapInArrow(run, "path string, length bigint, width int, height int, darkest int, brightest int")


def file_sizes(rows: DataFrame, folder: str, name: str = "path") -> DataFrame:
    """rows with length, the bytes of the file of that name below the folder; null where there is none, or no name.

    Tasks ask the store about their own names, as Spark's file sources pass over empty files.  A column length is replaced.
    """
    kept = rows.drop("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column(name).to_pylist()
            found = iter(store.get_file_info([f"{base}/{n}" for n in names if n]))
            sizes = [(info.size if info.type == fs.FileType.File else None) if n and (info := next(found)) else None for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names, "length"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("length", LongType())]))


def check_previews(expected: DataFrame, shown: DataFrame) -> DataFrame:
    """expected (path, length as file_sizes() tells it) with passed, reason and oversized, by what pixel_range() (shown) says of the same paths.

    In this order a preview fails that isn't there, is empty, can't be decoded, has both sides below
    LEAST_SIDE, is all black or all white.  One that passes has an empty reason; more KB than its kind (gif or not)
    should have are only told, as oversized.  Rows of expected stay as they are, repeated ones too; a null path isn't there.
    """
    own = shown.select(F.col("path").alias("__path"), F.col("width").alias("__width"), F.col("height").alias("__height"), "darkest", "brightest")
    own = own.withColumnsRenamed({"darkest": "__darkest", "brightest": "__brightest"})
    small = (F.col("__width") < LEAST_SIDE) & (F.col("__height") < LEAST_SIDE)
    reason = (
        F.when(F.col("length").isNull(), MISSING).when(F.col("length") == 0, EMPTY).when(F.coalesce("__width", F.lit(-1)) < 0, BROKEN)
        .when(small, F.concat(F.lit("Dimensions "), "__width", F.lit("x"), "__height", F.lit(f" below minimum {LEAST_SIDE}")))
        .when(F.col("__brightest") == 0, BLACK).when(F.col("__darkest") == 255, WHITE).otherwise("")
    )
    most = F.when(F.lower("path").endswith(".gif"), MOST_DYNAMIC_KB).otherwise(MOST_STATIC_KB)
    rows = expected.drop("passed", "reason", "oversized")
    out = rows.join(own, F.col("path") == F.col("__path"), "left").withColumn("reason", reason)
    return out.select(*rows.columns, (F.col("reason") == "").alias("passed"), "reason", F.coalesce((F.col("reason") == "") & (F.col("length") > most * 1024), F.lit(False)).alias("oversized"))
