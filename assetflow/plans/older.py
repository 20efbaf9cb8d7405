"""Queries over results of the older form and over folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.functions import expressions as X
from assetflow.operators import migration as M
from assetflow.operators.registration import in_order
from assetflow.sources import working as W

from .registry import query

_INDEX = """w_index AS (SELECT o_orderkey AS k, 'r' || (o_orderkey - o_orderkey % 2) AS rid, o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 AS listed, p, n FROM orders LEFT JOIN (SELECT task_id, list(split_part(path, '/', -1) ORDER BY ord) AS p, count(*) AS n FROM w_file GROUP BY task_id) ON task_id = o_orderkey - o_orderkey % 2),
    w_row AS (SELECT *, k % 6 <> 0 AND (k - 1) % 6 <> 0 AND p IS NOT NULL AS known FROM w_index),
    w_md5 AS (SELECT *, CASE WHEN known THEN md5('{"file_paths": [' || array_to_string(list_transform(p, lambda x: '"' || x || '"'), ', ') || '], "id": "' || rid || '", "member_count": ' || n || ', "pack_name": "p", "resource_path": "", "resource_type": "pack", "source": "s"}')
        ELSE md5('{"resource_path": "x/' || (k % 100) || '", "source_resource_id": "' || rid || '"}') END AS content_md5 FROM w_row)"""


def _older(spark, d):
    """Progress rows, an index that doesn't know every third resource, and the files there are."""
    f = W.files(spark, d).withColumn("name", X.file_name(F.col("path")))
    order = W.order_tasks(spark, d).select("id")
    even = F.col("id") - F.col("id") % 2
    rows = order.select(
        F.col("id").alias("seq"), F.concat(F.lit("r"), even).alias("source_resource_id"), F.lit("p").alias("pack_name"), F.concat(F.lit("x/"), F.col("id") % 100).alias("resource_path"),
        F.array(F.lit("none.webp"), F.concat(F.lit("prev/"), F.col("id") % 10, F.lit(".webp"))).alias("preview_paths"))
    by = f.where("task_id % 2 = 0 and task_id % 6 <> 0").groupBy("task_id").agg(in_order("ord", "name").alias("file_paths"), F.count("*").alias("member_count"))
    index = by.select(F.concat(F.lit("r"), "task_id").alias("id"), F.lit("s").alias("source"), F.lit("p").alias("pack_name"), F.lit("pack").alias("resource_type"), F.lit("").alias("resource_path"), "member_count", "file_paths")
    there = f.where("l_partkey % 5 <> 0").select(F.concat(F.lit("assets/s/p/"), "name").alias("path"), F.length("name").cast("bigint").alias("size")).distinct()
    shown = order.where("id % 10 < 5").select(F.concat(F.lit("prev/"), F.col("id") % 10, F.lit(".webp")).alias("path"), F.lit(9).cast("bigint").alias("size")).distinct()
    return rows, index, there.unionByName(shown)


@query(f"""WITH {_INDEX}, o AS (SELECT *, row_number() OVER (PARTITION BY content_md5 ORDER BY k) AS again FROM w_md5),
    t AS (SELECT DISTINCT content_md5 FROM w_md5 WHERE k % 7 = 0),
    m AS (SELECT *, CASE WHEN again > 1 OR content_md5 IN (FROM t) THEN 'duplicate' ELSE 'migrated' END AS outcome FROM o),
    e AS (SELECT k, unnest(p) AS name, generate_subscripts(p, 1) AS i FROM m WHERE known AND outcome = 'migrated'), x AS (SELECT * FROM e WHERE name IN (SELECT split_part(path, '/', -1) FROM w_file WHERE l_partkey % 5 <> 0)),
    g AS (SELECT k, string_agg(name || ':' || length(name), '|' ORDER BY i) AS files, coalesce(min_by(name, i) FILTER (WHERE name LIKE '%.png'), min_by(name, i)) AS main FROM x GROUP BY k)
    SELECT m.k AS seq, m.content_md5, outcome, coalesce(files, '') AS files, coalesce(main, '') AS main, CASE WHEN outcome = 'migrated' AND m.k % 10 IN (SELECT o_orderkey % 10 FROM orders WHERE o_orderkey % 10 < 5) THEN 'prev/' || (m.k % 10) || '.webp' ELSE '' END AS previews, CASE WHEN known THEN n ELSE 0 END AS n_listed FROM m LEFT JOIN g ON m.k = g.k""")
def legacy_tasks(spark, d):
    """Older progress taken over; some of it is there already."""
    rows, index, there = _older(spark, d)
    tasks = M.migrated_tasks(rows.where("seq % 7 = 0"), index, spark.createDataFrame([], "content_md5 string"), there).select("content_md5")
    done = M.migrated_tasks(rows, index, tasks, there)
    main = F.get(F.filter("files", lambda f: f["is_primary"]), F.lit(0))["name"]
    return done.select(
        "seq", "content_md5", "outcome", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["name"], f["size"].cast("string"))), "|").alias("files"), F.coalesce(main, F.lit("")).alias("main"),
        F.array_join("previews", "|").alias("previews"), "n_listed")


@query(f"""WITH {_INDEX}, t AS (SELECT content_md5, min(k) AS task_id FROM w_md5 WHERE k % 4 <> 3 GROUP BY content_md5), r AS (SELECT * FROM w_md5 WHERE k % 5 <> 0),
    o AS (SELECT k, task_id, row_number() OVER (PARTITION BY r.content_md5 ORDER BY k) AS again FROM r LEFT JOIN t ON r.content_md5 = t.content_md5)
    SELECT k AS seq, CASE WHEN task_id IS NULL THEN 'no_task' WHEN task_id % 9 = 0 OR again > 1 THEN 'duplicate' ELSE 'migrated' END AS outcome, task_id, 'main ' || k AS main, 'migrated' AS prompt_version FROM o""")
def legacy_descriptions(spark, d):
    """Older descriptions for tasks, of which every ninth has one; every fifth is blank."""
    rows, index, _ = _older(spark, d)
    keyed = M._known(rows, index).select(F.col("seq").alias("id"), "content_md5")
    said = rows.select("seq", "source_resource_id", "resource_path", F.concat(F.lit("main "), "seq").alias("main"), F.lit("").alias("detail"), F.when(F.col("seq") % 5 == 0, " \n").otherwise("full").alias("full"))
    described = keyed.where("id % 9 = 0").select(F.col("id").alias("task_id"))
    return M.migrated_descriptions(said, index, keyed.where("id % 4 <> 3"), described).select("seq", "outcome", "task_id", "main", "prompt_version")


@query("""WITH s AS (SELECT DISTINCT path, md5, format, l_partkey % 4 AS q FROM w_file), d AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS directory FROM s),
    p AS (SELECT directory, string_agg(CASE WHEN q < 3 THEN path || '.webp:' || CASE format WHEN 'fbx' THEN 'primary' ELSE 'gallery' END || ':static' END, '|' ORDER BY path) AS previews,
        string_agg(CASE WHEN q <> 1 THEN 'copy/' || path END, '|' ORDER BY path) AS copied, md5(string_agg(md5, '' ORDER BY md5)) AS composite_md5 FROM d GROUP BY directory)
    SELECT directory, coalesce(previews, '') AS previews, coalesce(copied, '') AS copied, composite_md5 FROM p""")
def folder_previews(spark, d):
    """Folders as resources, with the previews of their files (every fourth one's is lost) and their copies."""
    f = W.files(spark, d).select("path", "md5", (F.col("l_partkey") % 4).alias("q")).distinct()
    states = f.select(F.col("path").alias("source"), F.when(F.col("q") != 1, F.concat(F.lit("copy/"), "path")).otherwise("").alias("copied_path"), F.array(F.concat("path", F.lit(".webp")), F.lit("lost.gif")).alias("preview_paths"), "md5")
    shown = f.where("q < 3").select(F.concat("path", F.lit(".webp")).alias("path"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit(9).alias("size")).distinct()
    line = lambda p: F.concat_ws(":", p["path"], p["role"], p["strategy"])
    return M.folder_previews(states, shown).select("directory", F.array_join(F.transform("previews", line), "|").alias("previews"), F.array_join("copied_paths", "|").alias("copied"), "composite_md5")
