"""Queries over streams of progress, dispatch by type and selection for upload."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.operators.dispatch import by_type
from assetflow.sources import working as W
from assetflow.streaming.progress import follow, state_folder

from .registry import query


@query("SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def follow_progress(spark, d):
    schema = W.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").select("event_type", "event_id", "value")
    return follow(rows, state_folder(spark, "progress"), "event_type", "event_id")


@query("""SELECT id, resource_type, CASE resource_type WHEN 'audio_file' THEN 'waveform' WHEN 'tileset' THEN 'grid' END AS layout, CASE WHEN resource_type = 'tileset' THEN 16 END AS cells FROM w_task""")
def dispatch_by_type(spark, d):
    tasks = W.tasks(spark, d).select("id", "resource_type")
    return by_type(tasks, "resource_type", {
        "audio_file": lambda x: x.withColumn("layout", F.lit("waveform")),
        "tileset": lambda x: x.withColumns({"layout": F.lit("grid"), "cells": F.lit(16)}),
    })


@query("""SELECT id FROM w_order_task WHERE id IN (SELECT task_id FROM w_file) AND id IN (SELECT task_id FROM w_file WHERE format = 'png' AND size > 0)
    AND id IN (SELECT task_id FROM w_desc WHERE trim(main, ' ') <> '')""")
def upload_selection(spark, d):
    """Tasks with a file, a preview that isn't empty and a description that isn't blank."""
    files = W.files(spark, d).groupBy("task_id").agg(F.bool_or((F.col("format") == "png") & (F.col("size") > 0)).alias("preview"))
    described = W.descriptions(spark, d).where(F.trim("main") != "").select(F.col("task_id").alias("id"))
    shown = files.where("preview").select(F.col("task_id").alias("id"))
    return W.order_tasks(spark, d).select("id").join(shown, "id", "left_semi").join(described, "id", "left_semi")
