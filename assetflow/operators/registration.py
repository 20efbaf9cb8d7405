"""Registering resources: merging fields, upserting tasks, filling in relationships, rebuilding entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a task that a registration fills where they are empty.
TEXTS = [
    "source_resource_id", "source", "pack_name", "title", "resource_path", "source_url", "original_download_url", "category", "license_name", "source_description",
    "parent_source_resource_id", "download_file_name", "download_content_type",
]
LISTS = ["tags_json", "child_source_resource_ids_json", "contains_resource_types_json"]
NUMBERS = ["child_resource_count", "download_file_size"]


def in_order(key: str | Column, value: str | Column) -> Column:
    """Aggregate: the values of a group as an array in the order of key, without null values."""
    pairs = F.array_sort(F.collect_list(F.struct((F.col(key) if isinstance(key, str) else key).alias("k"), (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.filter(F.transform(pairs, lambda x: x["v"]), lambda v: v.isNotNull())


def fill_empty(tasks: DataFrame, requests: DataFrame, on: str = "id") -> DataFrame:
    """The tasks with the fields that they lack from their request (joined on `on`, at most one each).

    What a task has wins.  Empty is null, an empty text and zero; for lists as JSON an empty text and [].
    Tasks without a request stay as they are; columns of the 18 that either side lacks are left alone.
    """
    both = [c for c in (*TEXTS, *LISTS, *NUMBERS) if c in tasks.columns and c in requests.columns]
    new = requests.select(F.col(on).alias("__on"), *(F.col(c).alias(f"__{c}") for c in both))

    def merged(c: str) -> Column:
        have, given = F.col(c), F.col(f"__{c}")
        if c in LISTS:
            return F.when(have.isin("", "[]") & ~given.isin("", "[]"), given).otherwise(have)
        nothing = F.lit(0) if c in NUMBERS else F.lit("")
        return F.when((have.isNull() | (have == nothing)) & (given != nothing), given).otherwise(have)

    joined = tasks.join(new, tasks[on] == new["__on"], "left")
    return joined.select(*(merged(c).alias(c) if c in both else F.col(c) for c in tasks.columns))


def upsert(entities: DataFrame, tasks: DataFrame) -> DataFrame:
    """What each entity (req_id, content_md5, source_resource_id) becomes: req_id, task_id, is_existing.

    The oldest task of equal content, else the oldest of the same source id (not empty), else a new one:
    task_id null.
    """
    by_md5 = tasks.groupBy("content_md5").agg(F.min("id").alias("same_content"))
    by_source = tasks.where("source_resource_id <> ''").groupBy("source_resource_id").agg(F.min("id").alias("same_source"))
    found = entities.select("req_id", "content_md5", "source_resource_id").join(by_md5, "content_md5", "left").join(by_source, "source_resource_id", "left")
    task = F.coalesce("same_content", "same_source")
    return found.select("req_id", task.alias("task_id"), task.isNotNull().alias("is_existing"))


def files_to_backfill(upserted: DataFrame, entity_files: DataFrame, files: DataFrame) -> DataFrame:
    """The entities' files (req_id and further columns) that existing tasks without any file get: task_id, then those columns."""
    bare = upserted.where("is_existing").join(files.select("task_id").distinct(), "task_id", "left_anti").select("req_id", "task_id")
    own = [c for c in entity_files.columns if c not in ("req_id", "task_id")]
    return entity_files.select("req_id", *own).join(bare, "req_id").select("task_id", *own)


def relationships(tasks: DataFrame) -> DataFrame:
    """Each task's parent and children by resource id: id, parent_resource_id, child_resource_ids.

    tasks: id, resource_id, source_resource_id, parent_source_resource_id, child_source_resource_ids
    (array, in order).  A source id means the newest task that has it and a resource id; children that
    mean none are left out, their order is kept.  All tasks are filled in at once, so siblings agree.
    """
    known = tasks.where("source_resource_id <> '' and resource_id <> ''").groupBy("source_resource_id").agg(F.max_by("resource_id", "id").alias("res"))
    parent = known.select(F.col("source_resource_id").alias("parent_source_resource_id"), F.col("res").alias("parent_resource_id"))
    each = tasks.select("id", F.posexplode("child_source_resource_ids").alias("place", "source_resource_id")).join(known, "source_resource_id")
    children = each.groupBy("id").agg(in_order("place", "res").alias("child_resource_ids"))
    out = tasks.select("id", "parent_source_resource_id").join(parent, "parent_source_resource_id", "left").join(children, "id", "left")
    return out.select("id", "parent_resource_id", F.coalesce("child_resource_ids", F.array().cast("array<string>")).alias("child_resource_ids"))


def entities(tasks: DataFrame, files: DataFrame, previews: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The tasks with what belongs to them nested: files (array in the order of ord), previews (in that of id), description (the latest).

    files: task_id, ord, further columns; previews: task_id, id, further columns; descriptions: task_id, id,
    further columns.  A task without files or previews has empty arrays, one without a description null.
    """
    def nested(rows: DataFrame, order: str, name: str) -> DataFrame:
        item = F.struct(order, *(c for c in rows.columns if c not in ("task_id", order)))
        return rows.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias(name))

    latest = descriptions.groupBy("task_id").agg(F.max_by(F.struct(*(c for c in descriptions.columns if c != "task_id")), "id").alias("description"))
    out = tasks
    for part in (nested(files, "ord", "files"), nested(previews, "id", "previews"), latest):
        out = out.join(part.withColumnRenamed("task_id", "__task"), F.col("id") == F.col("__task"), "left").drop("__task")
    none = lambda df, order: F.array().cast(nested(df, order, "x").schema["x"].dataType)
    return out.withColumns({"files": F.coalesce("files", none(files, "ord")), "previews": F.coalesce("previews", none(previews, "id"))})


def details(requests: DataFrame, tasks: DataFrame, files: DataFrame, previews: DataFrame, descriptions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A row for each request (resource_id): status (found or not_found), the task's columns, files, previews, description, embedding and parsed lists.

    tags_json, child_resource_ids_json and contains_resource_types_json become arrays (tags, child_resource_ids,
    contains_resource_types), empty where they can't be read.  Of descriptions and embeddings (task_id, id and
    further columns) the latest counts.
    """
    read = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    lists = {c.removesuffix("_json"): read(c) for c in ("tags_json", "child_resource_ids_json", "contains_resource_types_json") if c in tasks.columns}
    item = F.struct(*(c for c in embeddings.columns if c != "task_id"))
    vector = embeddings.groupBy(F.col("task_id").alias("__task")).agg(F.max_by(item, "id").alias("embedding"))
    # requests meet the tasks' ids first, so that what belongs to a task is dealt out by its id alone, and once
    ids = tasks.select("resource_id", F.col("id").alias("__id"), F.lit(True).alias("__known")).distinct()
    keyed = requests.join(ids, "resource_id", "left")
    bounds = tasks.agg(F.min("id"), F.max("id")).first()
    own = lambda df: df.where(F.col("task_id").between(*map(F.lit, bounds)))  # noqa: E731 - other rows belong to no task
    known = entities(tasks, own(files), own(previews), own(descriptions)).join(own(vector.withColumnRenamed("__task", "task_id")).withColumnRenamed("task_id", "__task"), F.col("id") == F.col("__task"), "left").drop("__task")
    known = known.withColumns(lists).drop(*(f"{c}_json" for c in lists)).withColumnRenamed("resource_id", "__rid")
    rest = [c for c in known.columns if c != "__rid"]
    first = [F.col(c) for c in ("resource_id", *(c for c in requests.columns if c != "resource_id"))]
    same = (F.col("__id") == F.col("id")) & F.col("resource_id").between(F.col("__rid"), F.col("__rid"))
    found = keyed.where("__id is not null").join(known, same).select(*first, *rest, F.lit("found").alias("status"))
    # tasks without an id have nothing that belongs to them
    bare = keyed.where("__known and __id is null").drop("__id", "__known").join(tasks.where("id is null").withColumns(lists), "resource_id")
    nothing = {f.name: (F.array() if f.name in ("files", "previews") else F.lit(None)).cast(f.dataType) for f in known.schema if f.name not in bare.columns}
    bare = bare.withColumns(nothing).select(*first, *rest, F.lit("found").alias("status"))
    lost = keyed.where("__known is null").select(*first, *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in rest), F.lit("not_found").alias("status"))
    return found.unionByName(bare).unionByName(lost)
