"""Taking over results of the older form, and previews of resources that lie in folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.expressions import IMAGE, directory_role, extension, file_name, fingerprint, json_text, parent, stripped

from .registration import in_order


def legacy_fingerprint(source_id: Column, resource_path: Column) -> Column:
    """The checksum of a resource that the index doesn't know: of its source id and path as JSON (ASCII texts)."""
    return F.md5(F.concat(F.lit('{"resource_path": '), json_text(resource_path), F.lit(', "source_resource_id": '), json_text(source_id), F.lit("}")))


def _known(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows with content_md5, index_source and file_paths of their entry in the index; without one the legacy fingerprint and no files."""
    entry = index.select(
        F.col("id").alias("__id"), F.coalesce("source", F.lit("")).alias("index_source"), F.coalesce("file_paths", F.array().cast("array<string>")).alias("file_paths"),
        fingerprint(F.col("id"), F.coalesce("source", F.lit("")), F.coalesce("pack_name", F.lit("")), F.coalesce("resource_type", F.lit("")), F.coalesce("resource_path", F.lit("")), F.coalesce("member_count", F.lit(0)), F.coalesce("file_paths", F.array().cast("array<string>"))).alias("__md5"))
    entry = entry.where("__id <> ''").dropDuplicates(["__id"])
    found = rows.join(entry, F.col("source_resource_id") == F.col("__id"), "left")
    return found.withColumn("content_md5", F.coalesce("__md5", legacy_fingerprint(F.coalesce("source_resource_id", F.lit("")), F.coalesce("resource_path", F.lit(""))))).drop("__id", "__md5")


def migrated_tasks(rows: DataFrame, index: DataFrame, tasks: DataFrame, inventory: DataFrame, root: str = "assets") -> DataFrame:
    """What becomes of older progress rows: their columns and content_md5, outcome, files, previews, n_listed.

    rows: seq, source_resource_id, pack_name, resource_path, preview_paths; index: id, source, pack_name, resource_type,
    resource_path, member_count, file_paths; tasks: content_md5; inventory: path, size of what there is.
    outcome is migrated, or duplicate where a task or an earlier row has the content.  files (path, name, size,
    format, is_primary) are those of the index below root/source/pack that exist, the first picture, else the
    first file, primary; previews those that exist; both in their order and empty for duplicates.  A dry run
    counts rows and n_listed, the files that the index lists.
    """
    known = _known(rows, index)
    taken = known.join(tasks.select("content_md5").distinct().withColumn("__there", F.lit(True)), "content_md5", "left")
    again = F.row_number().over(Window.partitionBy("content_md5").orderBy("seq")) > 1
    outcome = F.when(F.coalesce("__there", F.lit(False)) | again, "duplicate").otherwise("migrated")
    marked = taken.withColumns({"outcome": outcome, "n_listed": F.coalesce(F.size("file_paths"), F.lit(0)).cast("bigint")}).drop("__there")
    new = marked.where("outcome = 'migrated'")
    there = inventory.select(F.col("path").alias("__path"), F.col("size").alias("__size"))

    listed = new.select("seq", F.posexplode("file_paths").alias("place", "relative"), "index_source", "pack_name")
    listed = listed.withColumn("__path", F.concat_ws("/", F.lit(root), "index_source", "pack_name", "relative")).join(there, "__path")
    item = F.struct(F.col("__path").alias("path"), file_name(F.col("__path")).alias("name"), F.col("__size").alias("size"), extension(F.col("__path")).alias("format"))
    files = listed.groupBy("seq").agg(in_order("place", item).alias("files"))
    previews = new.select("seq", F.posexplode("preview_paths").alias("place", "__path")).join(there, "__path").groupBy("seq").agg(in_order("place", "__path").alias("previews"))

    first = F.coalesce(F.nullif(F.array_position(F.transform("files", lambda f: f["format"].isin(IMAGE)), F.lit(True)), F.lit(0)), F.lit(1))
    flagged = F.transform("files", lambda f, i: f.withField("is_primary", i + 1 == first))
    out = marked.join(files, "seq", "left").join(previews, "seq", "left")
    none = F.array().cast("array<struct<path: string, name: string, size: bigint, format: string, is_primary: boolean>>")
    return out.withColumns({"files": F.coalesce(flagged, none), "previews": F.coalesce("previews", F.array().cast("array<string>"))}).drop("file_paths", "index_source")


def migrated_descriptions(rows: DataFrame, index: DataFrame, tasks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """What becomes of older descriptions: seq, outcome, task_id, main, detail, full, prompt_version (migrated).

    rows: seq, source_resource_id, resource_path, main, detail, full; rows with a blank full text are left out.  Each
    goes to the oldest task (id, content_md5) of its content; outcome is no_task without one, duplicate where that has a
    description (descriptions: task_id) or an earlier row gave it one, else migrated.
    """
    oldest = tasks.groupBy("content_md5").agg(F.min("id").alias("task_id"))
    has = descriptions.select("task_id").distinct().withColumn("__there", F.lit(True))
    own = _known(rows.where(F.coalesce(stripped(F.col("full")), F.lit("")) != ""), index).join(oldest, "content_md5", "left").join(has, "task_id", "left")
    again = F.row_number().over(Window.partitionBy("content_md5").orderBy("seq")) > 1
    outcome = F.when(F.col("task_id").isNull(), "no_task").when(F.coalesce("__there", F.lit(False)) | again, "duplicate").otherwise("migrated")
    return own.select("seq", outcome.alias("outcome"), "task_id", "main", "detail", "full", F.lit("migrated").alias("prompt_version"))


def folder_previews(states: DataFrame, shown: DataFrame) -> DataFrame:
    """Resources that lie in folders: directory, copied_paths, previews (array of path, role, strategy, format, width, height, size), composite_md5.

    states: source (path of a file), copied_path, preview_paths, md5 (of its content); shown: path, width, height, size of
    the previews that there are.  Members stand in the order of their paths; a model's preview is primary, other ones
    gallery; the checksum is that of the members' sorted checksums.
    """
    own = states.withColumn("directory", parent(F.col("source")))
    by = own.groupBy("directory").agg(in_order("source", F.nullif("copied_path", F.lit(""))).alias("copied_paths"), F.md5(F.array_join(F.array_sort(F.collect_list("md5")), "")).alias("composite_md5"))
    each = own.select("directory", "source", F.posexplode("preview_paths").alias("place", "path")).join(shown, "path")
    format_ = extension(F.col("path"))
    item = F.struct(
        "path", F.when(directory_role(F.col("source")) == "model", "primary").otherwise("gallery").alias("role"), F.when(format_.isin("webp", "png", "jpg", "jpeg"), "static").otherwise("gif").alias("strategy"),
        format_.alias("format"), "width", "height", "size")
    previews = each.groupBy("directory").agg(in_order(F.struct("source", "place"), item).alias("previews"))
    kind = previews.schema["previews"].dataType.simpleString()
    return by.join(previews, "directory", "left").withColumn("previews", F.coalesce("previews", F.array().cast(kind)))
