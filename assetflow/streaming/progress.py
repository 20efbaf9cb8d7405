"""Following rows of progress that another process keeps appending."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.operators.selection import latest


def state_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; where none is set, a temporary one, on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table below the shared folder."""
    path = state_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Buckets of a followed state, by hash of the key.
BUCKETS = 64


def follow(rows: DataFrame, folder: str, key: str, *order: str, buckets: int = BUCKETS) -> DataFrame:
    """The newest row of each key of a stream, after all that has arrived: an update replaces an older row.

    The state is kept in buckets by hash of the key.  A micro-batch reads and writes only the buckets of its own
    keys, as a version of their own, and a list of every bucket's newest version (at most that many rows), so
    its work follows its rows and not the state.  A batch that is run again after a failure starts from the list
    before it and overwrites its own version, and so changes nothing.  What no list names any more after the
    next batch is removed.  Rows with a null key are dropped.  Calling again with the same folder and number of
    buckets goes on where the last call stopped.
    """
    spark = rows.sparkSession
    place = lambda b, v: f"{folder}/state/version-{v}/bucket={b}"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def newest(n: int) -> dict[int, int]:
        """The version of each bucket after batch n."""
        return dict(map(tuple, spark.read.schema("bucket int, version long").parquet(f"{folder}/newest/{n}").collect())) if n >= 0 else {}

    def state(versions: dict[int, int]) -> DataFrame:
        paths = [place(b, v) for b, v in versions.items()]
        return spark.read.schema(rows.schema).parquet(*paths) if paths else spark.createDataFrame([], rows.schema)

    def merge(batch: DataFrame, n: int) -> None:
        fresh = batch.where(f"{key} is not null").persist()
        try:
            touched = [r[0] for r in fresh.select(bucket).distinct().collect()]
            before = newest(n - 1)
            held = state({b: before[b] for b in touched if b in before})
            merged = latest(fresh.unionByName(held), key, *order).select(*batch.columns)
            if touched:
                merged.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/version-{n}")
            after = {**before, **dict.fromkeys(touched, n)}
            spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/{n}")
            older = newest(n - 2) if n > 1 else {}
            for b in older.keys() & before.keys():
                if older[b] != before[b]:
                    removed(spark, place(b, older[b]))
        finally:
            fresh.unpersist()

    stream = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    done = spark.read.text(f"{folder}/checkpoint/commits", wholetext=True).selectExpr("max(cast(_metadata.file_name as int))").first()[0]
    return state(newest(-1 if done is None else done))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder; nothing where it isn't there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
