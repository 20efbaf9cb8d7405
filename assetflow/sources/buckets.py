"""Tables in buckets by a key, sorted, so that joins and aggregations on the key need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a table, the same number for all that are joined; one file each.
BUCKETS = 64


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes rows to a new folder in buckets by hash of the key, each one sorted file, and gives them as a table.

    Rows of one key share a bucket, so a bucket is as large as its keys make it; a null key is a key like others.
    """
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(_name())
    return read_buckets(rows.sparkSession, path, key, buckets)


def read_buckets(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The table in a folder that write_buckets() has written, in this session or another, with its buckets known to the planner."""
    name = _name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _name() -> str:
    return f"buckets_{uuid.uuid4().hex}"
