"""Files as sources and sinks: JSON lines, folders of assets, versions of a state, tables with dense ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_CORRUPT = "_corrupt"


#: One character of UTF-8, in bytes read as Latin-1; any other byte above 7F belongs to none.
_UTF8 = "([\\x00-\\x7f]|[\\xc2-\\xdf][\\x80-\\xbf]|\\xe0[\\xa0-\\xbf][\\x80-\\xbf]|[\\xe1-\\xec\\xee\\xef][\\x80-\\xbf]{2}|\\xed[\\x80-\\x9f][\\x80-\\xbf]|\\xf0[\\x90-\\xbf][\\x80-\\xbf]{2}|[\\xf1-\\xf3][\\x80-\\xbf]{3}|\\xf4[\\x80-\\x8f][\\x80-\\xbf]{2})|[\\x80-\\xff]"


def decodable(text: Column) -> Column:
    """A text as it was read, without the bytes that belong to no character of UTF-8."""
    cleaned = F.encode(F.regexp_replace(F.decode(text.cast("binary"), "ISO-8859-1"), _UTF8, "$1"), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, ignore: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files of JSON lines; blank lines count as neither.

    rejects has the bad lines (line): those that aren't JSON of the schema, or hold bytes that are no UTF-8.  With
    strict, a bad line is an error when the rows are read.  With ignore, such bytes are dropped before a line is
    read, and lines that are bad even so are passed over: rejects is empty.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    text = decodable(F.col("value")) if ignore else F.col("value")
    if strict:
        text = F.validate_utf8("value")
        rows = lines.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
        return rows, lines.limit(0).select(F.lit("").alias("line"))
    parsed = lines.select(F.from_json(text, f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("row"), "value")
    bad = F.col(f"row.{_CORRUPT}").isNotNull() | (F.lit(False) if ignore else ~F.is_valid_utf8("value"))
    rows = parsed.where(~bad).select("row.*").drop(_CORRUPT)
    return rows, parsed.where(F.lit(False) if ignore else bad).select(F.col("value").alias("line"))


def append_lines(rows: DataFrame, folder: str, **totals: Column) -> dict[str, int]:
    """Appends rows as JSON lines, nulls left out, and tells the totals of them, as the pass that writes observes them."""
    seen = Observation("totals")
    observed = rows.observe(seen, *(c.alias(name) for name, c in totals.items())) if totals else rows
    observed.write.mode("append").option("ignoreNullFields", True).json(folder)
    return seen.get if totals else {}


def scan_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """The files below a folder: path, extension, length, modified; with content also md5 and header_ok.

    Contents are read only for those last two columns: a file is sound when at least 4 bytes can be read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    own = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return own.withColumns({"md5": F.md5("content"), "header_ok": F.length("content") >= 4}).drop("content") if content else own


def accepted(files: DataFrame, extensions: list[str], most_bytes: int, most_files: int | None = None) -> DataFrame:
    """Files of the extensions, from 4 bytes up to a size; the first so many by path where a number is given."""
    kept = files.where(F.col("extension").isin(extensions) & F.col("length").between(4, most_bytes))
    return kept.orderBy("path").limit(most_files) if most_files is not None else kept


def typed(files: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """Files with the first type (resource_type) that lists their extension; others are left out."""
    which = F.coalesce(*(F.when(F.col("extension").isin(known), F.lit(kind)) for kind, known in types.items()))
    return files.withColumn("resource_type", which).where("resource_type is not null")


def inventory(files: DataFrame, prefix: Column) -> DataFrame:
    """Number of objects and bytes below each prefix."""
    return files.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n_objects"), F.sum("length").alias("total_bytes"))


def present(keys: DataFrame, files: DataFrame, key: str = "key") -> DataFrame:
    """The keys with found: whether a file has the key as its path's end behind a slash, or as its whole path."""
    ends = files.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.call_function("substring_index", F.col("path"), F.lit("/"), -n)))).alias(key))
    return keys.join(ends.join(keys.select(key).distinct(), key, "left_semi").distinct().withColumn("found", F.lit(True)), key, "left").na.fill(False, ["found"])


def pack_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of packs, a JSON file <source>/<pack>.json each below the folder: source, pack (as file systems take it), description, tags."""
    body = "pack struct<description: string, tags: array<string>>"
    place = F.url_decode(F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+\.json$", 1)).alias("source"), F.url_decode(F.regexp_extract("_metadata.file_path", r"/([^/]+)\.json$", 1)).alias("pack")
    rows = spark.read.schema(body).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return rows.select(*place, F.coalesce("pack.description", F.lit("")).alias("description"), F.coalesce("pack.tags", F.array().cast("array<string>")).alias("tags"))


def resource_entries(resources: DataFrame, dependencies: DataFrame, statuses: DataFrame, extra: DataFrame) -> DataFrame:
    """Entries of a resource index: resource, dependencies (array, in order), status (unknown without one), and the columns of extra.

    resources: resource; dependencies: resource, place, dependency; statuses: resource, status; extra: resource and
    further columns.  A JSON sink that leaves out nulls writes only the extras that are there.
    """
    by = dependencies.groupBy("resource").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "dependency"))), lambda x: x["dependency"]).alias("dependencies"))
    out = resources.select("resource").join(by, "resource", "left").join(statuses, "resource", "left").join(extra, "resource", "left")
    return out.withColumns({"dependencies": F.coalesce("dependencies", F.array().cast("array<string>")), "status": F.coalesce("status", F.lit("unknown"))})


# The tables of the pipeline's state, with the columns of each besides id; what a row lacks is empty text, 0 or null.
TABLES = {
    "task": "content_md5 string, resource_type string, source_directory string, process_state string, resource_id string, retry_count int, last_error_code string, last_error_message string, created_at string, updated_at string, source_resource_id string, title string, pack_name string, source string, resource_path string",
    "file": "task_id bigint, file_path string, file_name string, file_size bigint, file_format string, content_md5 string, file_role string, object_key string, is_primary int, created_at string",
    "preview": "task_id bigint, strategy string, role string, path string, format string, width int, height int, size bigint, renderer string, used_placeholder int, fail_reason string, created_at string",
    "description": "task_id bigint, main_content string, detail_content string, full_description string, prompt_version string, quality_score double, created_at string",
    "embedding": "task_id bigint, dimension int, checksum string, generate_time double, model_version string, created_at string",
    "upload_job": "task_id bigint, upload_state string, idempotency_key string, error_message string, created_at string, updated_at string",
    "log": "task_id bigint, event string, detail string, created_at string",
}
DEFAULTS = {"process_state": "discovered", "file_role": "main", "role": "primary", "upload_state": "pending"}
NULLABLE = {"resource_id", "object_key", "path", "format", "width", "height", "size", "renderer", "fail_reason", "quality_score", "idempotency_key", "error_message", "detail"}


def insert(name: str, rows: DataFrame, folder: str, *order: str) -> None:
    """Appends rows to one of TABLES below the folder, with running ids; columns that the rows lack take their defaults, others are added."""
    kinds = dict(x.split(" ") for x in TABLES[name].split(", "))

    def column(c: str, kind: str) -> Column:
        value = F.col(c) if c in rows.columns else F.lit(None)
        empty = None if c in NULLABLE else DEFAULTS.get(c, "" if kind == "string" else 0)
        return F.coalesce(value, F.lit(empty)).cast(kind).alias(c)

    more = [c for c in rows.columns if c not in kinds]
    append_table(rows.select(*(column(c, k) for c, k in kinds.items()), *more), f"{folder}/{name}", *order)


def rows_of(spark: SparkSession, name: str, folder: str, tasks: DataFrame | None = None) -> DataFrame:
    """Rows of one of TABLES, with tasks only those of its task_id; empty where nothing was inserted."""
    path = f"{folder}/{name}"
    rows = read_table(spark, path) if exists(spark, path) else spark.createDataFrame([], f"id bigint, {TABLES[name]}")
    return rows if tasks is None else rows.join(tasks.select("task_id").distinct(), "task_id", "left_semi")


def unchanged(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files of now whose fingerprint, size and time of change, is that of before."""
    same = ["path", "length", "modified"]
    return now.join(before.select(*same), same, "left_semi")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def load_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest version of a state; empty where none was saved."""
    if not exists(spark, f"{folder}/current"):
        return spark.createDataFrame([], schema)
    version = spark.read.text(f"{folder}/current").orderBy(F.length("value").desc(), F.desc("value")).first()[0]
    return spark.read.schema(schema).parquet(f"{folder}/{version}")


def save_state(state: DataFrame, folder: str) -> None:
    """Saves a state as a version of its own, then names it the newest: what is being read is never overwritten."""
    spark = state.sparkSession
    number = spark.read.text(f"{folder}/current").count() + 1 if exists(spark, f"{folder}/current") else 1
    version = f"version-{number}-{uuid.uuid4().hex}"
    state.write.parquet(f"{folder}/{version}")
    spark.range(1).select(F.lit(version)).coalesce(1).write.mode("append").text(f"{folder}/current")


def with_ids(rows: DataFrame, folder: str, *order: str, first: int = 1) -> DataFrame:
    """Rows with dense ids (id) from first on, in the given order, without gathering them.

    The rows are written in ranges of the order; a row's id is its file's start and its place in it.
    Only one number a file goes through a single task.
    """
    spark, path = rows.sparkSession, f"{folder}/ordered-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    own = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = own.groupBy("_file").agg(F.count("*").alias("_n"))
    starts = counts.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n") + first).alias("_start"))
    return own.join(F.broadcast(starts), "_file").withColumn("id", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def append_table(rows: DataFrame, path: str, *order: str) -> None:
    """Appends rows to a table, with ids behind the greatest there; new columns are null in older rows."""
    spark = rows.sparkSession
    greatest = read_table(spark, path).agg(F.max("id")).first()[0] or 0 if exists(spark, path) else 0
    with_ids(rows, f"{path}-order", *order, first=greatest + 1).write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def asset_index(spark: SparkSession, path: str) -> DataFrame:
    """Assets of JSON lines (id, file_path, source, source_pack, metadata of format, style and theme) as rows of
    asset_id, file_path, source, pack_name, fmt (lower case), style, theme; what is absent is empty.  A bad line ends the job."""
    schema = "id string, file_path string, source string, source_pack string, metadata struct<format: string, style: string, theme: string>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    columns = {"asset_id": "id", "file_path": "file_path", "source": "source", "pack_name": "source_pack", "style": "metadata.style", "theme": "metadata.theme"}
    text = {name: F.coalesce(c, F.lit("")).alias(name) for name, c in columns.items()}
    return rows.select(*(text[n] for n in ("asset_id", "file_path", "source", "pack_name")), F.coalesce(F.lower("metadata.format"), F.lit("")).alias("fmt"), text["style"], text["theme"])
