"""What a search returns for its hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.expressions import file_name, stripped
from assetflow.streaming.progress import stored

from .registration import in_order
from .selection import latest


#: Ids of hits that are sent to every task at most.
MOST_SENT = 100_000


def _sent(ids: DataFrame) -> DataFrame:
    """Written ids, to be broadcast where they are few."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def ranked(rows: DataFrame, query: str, score: str, k: int, threshold: float, *ties: Column, kind: tuple[str, list[str]] | None = None, formats: tuple[str, list[str | None]] | None = None) -> DataFrame:
    """Already scored rows of each query with rank, the k best of the threshold or more, after the filters.

    kind and formats name a column and what it must be: types as they are; formats trimmed, in lower case and without leading
    dots on both sides, blank ones asked for nothing.  A filter that asks for nothing keeps all.  Rows without a score go.
    """
    if kind and kind[1]:
        rows = rows.where(F.col(kind[0]).isin(kind[1]))
    bare = lambda c: F.regexp_replace(F.lower(stripped(c)), r"^\.+", "")
    asked = {f.strip().lower().lstrip(".") for f in formats[1] if f and f.strip()} if formats else set()
    if asked:
        rows = rows.where(bare(F.coalesce(formats[0], F.lit(""))).isin(sorted(asked)))
    order = Window.partitionBy(query).orderBy(F.desc(score), *ties)
    return rows.where(F.col(score) >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def enrich(hits: DataFrame, tasks: DataFrame, descriptions: DataFrame, files: DataFrame, previews: DataFrame) -> DataFrame:
    """The hits (resource_id and further columns) with their tasks, descriptions, files, previews and parents.

    Hits without a task go.  tasks: resource_id, id, process_state, title, source_resource_id,
    parent_resource_id, download_key; descriptions: task_id, id, main; files: task_id, ord, format, size,
    path; previews: task_id, id, path.  Preview keys keep their order, each once; the first is primary.  The
    download key is the package's, else the first file's.

    The hits are written once, so the search behind them runs once; so are their tasks and the parents', whose ids
    then filter the other tables before anything there is ranked or aggregated: sent to every task
    where they are at most MOST_SENT, else joined by shuffle.
    """
    hits = stored(hits, "hits")
    named = tasks.withColumn("parent_resource_id", F.coalesce("parent_resource_id", F.lit("")))
    own = stored(named.join(_sent(hits.select("resource_id").distinct()), "resource_id", "left_semi"), "hit-tasks")
    above = stored(named.join(_sent(own.select(F.col("parent_resource_id").alias("resource_id")).distinct()), "resource_id", "left_semi"), "hit-parents")
    of = _sent(own.select(F.col("id").alias("task_id")))

    said = latest(descriptions.select("task_id", "id", "main").join(of, "task_id", "left_semi"), "task_id", "id").select("task_id", F.col("main").alias("description"))
    bare = F.regexp_replace(F.lower(F.trim("format")), r"^\.+", "")
    held = files.join(of, "task_id", "left_semi").groupBy("task_id").agg(
        F.count("*").alias("file_count"), F.sum("size").alias("file_size"), in_order("ord", F.nullif(bare, F.lit(""))).alias("formats"), F.min_by("path", "ord").alias("first_path"))
    shown = previews.where("path <> ''").join(_sent(own.unionByName(above).select(F.col("id").alias("task_id")).distinct()), "task_id", "left_semi")
    keys = shown.groupBy("task_id").agg(in_order("id", file_name(F.col("path"))).alias("names"))

    parent = above.join(keys.withColumnRenamed("task_id", "id"), "id", "left").select(
        F.col("resource_id").alias("parent_resource_id"), F.col("title").alias("parent_title"), F.col("download_key").alias("parent_download_key"), F.get("names", F.lit(0)).alias("parent_name"))
    task = own.withColumnRenamed("id", "task_id").join(said, "task_id", "left").join(held, "task_id", "left").join(keys, "task_id", "left").join(parent, "parent_resource_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    paths = F.array_distinct(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat_ws("/", F.lit("previews"), "resource_id", n)))
    download = F.coalesce(F.nullif("download_key", F.lit("")), F.concat_ws("/", F.lit("files"), "resource_id", F.when(F.col("first_path").isNotNull(), file_name(F.col("first_path")))))
    detail = task.select(
        "resource_id", text("title").alias("title"), F.col("process_state").alias("status"), "source_resource_id", text("description").alias("description"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("file_size", F.lit(0)).alias("file_size"), text(F.get("formats", F.lit(0))).alias("file_format"), "formats",
        text(F.get(paths, F.lit(0))).alias("primary_preview"), F.slice(paths, 2, 1_000_000).alias("other_previews"),
        F.when((text("download_key") != "") | F.col("first_path").isNotNull(), download).otherwise("").alias("download_key"),
        "parent_resource_id", text("parent_title").alias("parent_title"), text("parent_download_key").alias("parent_download_key"),
        F.when(F.col("parent_name").isNotNull(), F.concat_ws("/", F.lit("previews"), "parent_resource_id", "parent_name")).otherwise("").alias("parent_preview"))
    return hits.join(detail, "resource_id")
