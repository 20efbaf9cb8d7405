"""Snapshots against each other: copies of files and uploads against what is registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def copy_plan(scan: DataFrame, state: DataFrame, held: DataFrame) -> DataFrame:
    """The difference of two snapshots: path, outcome, copied, size, modified and previews of every file that either has.

    scan: path, size, modified, the files as they are; state: path, size, modified, copied, previews, what was noted of
    them; held: path, the copies that exist.  A file with a copy is kept where its size and time of change
    are those noted, else overwritten; one whose copy isn't noted or doesn't exist is new and has none yet;
    one that is no longer there has vanished.  Only what is kept keeps its previews; a vanished file has its old copy
    and no size.  A path counts once: of repeated rows the greatest.  Rows without a path are left out.
    """
    one = lambda df, name: df.where("path is not null").groupBy("path").agg(F.max(F.struct(*(c for c in df.columns if c != "path"))).alias(name))
    now, was = one(scan.select("path", "size", "modified"), "now"), one(state.select("path", "size", "modified", "copied", "previews"), "was")
    there = held.where("path is not null").select(F.col("path").alias("__copy")).distinct()
    both = now.join(was, "path", "full").join(there, F.col("was.copied") == F.col("__copy"), "left")
    same = F.col("now.size").eqNullSafe(F.col("was.size")) & F.col("now.modified").eqNullSafe(F.col("was.modified"))
    outcome = F.when(F.col("now").isNull(), "vanished").when(F.col("__copy").isNull(), "new").when(same, "keep").otherwise("overwrite")
    none = F.array().cast(state.schema["previews"].dataType)
    return both.select(
        "path", outcome.alias("outcome"), F.when(outcome != "new", F.col("was.copied")).alias("copied"), "now.size", "now.modified",
        F.when(outcome == "keep", F.coalesce("was.previews", none)).otherwise(none).alias("previews"))


def accepted_uploads(uploads: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, batches): the uploaded files that count, and the answer to each resource's batch.

    uploads: resource_id, ord, name, etag, size; registered: resource_id, ord, name, md5 (of equal names the last).
    A file's tag is its etag without quotes, up to the first "-"; only one of 32 characters is compared,
    and only with a registered md5, so a file without either is accepted.  The first mismatch ends a batch:
    the files before it count.  batches: resource_id, success, uploaded_bytes, file_count, error_message.
    """
    # both kinds of rows side by side, as a join by two keys would deal out anew what is dealt out by resource already
    known = registered.select("resource_id", "name", F.col("md5").alias("__md5"), F.col("ord").alias("__at"), F.lit(True).alias("__registered"))
    last = F.max_by("__md5", "__at").over(Window.partitionBy("resource_id", "name"))
    both = uploads.unionByName(known, allowMissingColumns=True).withColumn("__md5", F.when(F.col("resource_id").isNotNull() & F.col("name").isNotNull(), last)).where("__registered is null")
    tag = F.split(F.regexp_replace("etag", '^"+|"+$', ""), "-")[0]
    both = both.withColumn("__tag", tag)
    bad = F.coalesce((F.col("__md5") != "") & (F.length("__tag") == 32) & (F.col("__tag") != F.col("__md5")), F.lit(False))
    run = Window.partitionBy("resource_id").orderBy("ord", "name").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("__bad", bad).withColumn("__stopped", F.max("__bad").over(run))
    # Fixed value: the message of a mismatch.
    message = F.concat(F.lit("MD5 mismatch for "), "name", F.lit(": expected="), "__md5", F.lit(", actual="), "__tag")
    batches = told.groupBy("resource_id").agg(
        (~F.bool_or("__bad")).alias("success"), F.coalesce(F.sum(F.when(~F.col("__stopped"), F.col("size"))), F.lit(0)).cast("bigint").alias("uploaded_bytes"), F.count_if(~F.col("__stopped")).alias("file_count"),
        F.coalesce(F.min_by(F.when(F.col("__bad"), message), F.when(F.col("__bad"), F.struct("ord", "name"))), F.lit("")).alias("error_message"))
    return told.where(~F.col("__stopped")).select(*uploads.columns), batches
