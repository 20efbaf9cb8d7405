"""Queries over files that Spark writes from the tables: JSON lines, folders of assets, states, task tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.operators.selection import rollup
from assetflow.sources import buckets as B
from assetflow.sources import files as S
from assetflow.sources import working as W
from assetflow.streaming.progress import state_folder

from .registry import query


@query("SELECT event_type, count(*) AS n, count_if(event_id % 7 = 0)::BIGINT AS rejected FROM events GROUP BY event_type")
def json_scan(spark, d):
    """Events as JSON lines, every seventh cut off and a blank line behind every fifth: rows and rejects."""
    folder = state_folder(spark, "lines")
    line = F.to_json(F.struct("event_type", "event_id"))
    cut = F.when(F.col("event_id") % 7 == 0, F.regexp_replace(line, r"\}$", "")).otherwise(line)
    lines = F.when(F.col("event_id") % 5 == 0, F.concat(cut, F.lit("\n"))).otherwise(cut)
    W.table(spark, d, "events").select(lines.alias("value")).write.text(folder)
    rows, rejects = S.json_lines(spark, folder, "event_type string, event_id bigint")
    bad = rejects.select(F.nullif(F.regexp_extract("line", r'"event_type":"([^"]*)"', 1), F.lit("")).alias("event_type"), F.lit(1).alias("bad"))
    both = rows.select("event_type", F.lit(0).alias("bad")).unionByName(bad)
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("bad").alias("rejected"))


@query("""SELECT event_type, 'dropped' AS mode, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type
    UNION ALL SELECT event_type, 'rejected', count(*), sum(event_id)::BIGINT FROM events WHERE event_id % 4 = 1 GROUP BY event_type
    UNION ALL SELECT event_type, 'read', count(*), sum(event_id)::BIGINT FROM events WHERE event_id % 4 <> 1 GROUP BY event_type""")
def json_bytes(spark, d):
    """Events as JSON lines, every fourth with bytes that are no UTF-8 within its type or between its fields: dropped before the line is read, or the line rejected."""
    folder = state_folder(spark, "bytes")
    line = F.to_json(F.struct("event_id", "event_type"))
    broken = F.concat(F.substring(line, 1, 1).cast("binary"), F.lit(b"\xe2\x82"), F.encode(F.substr(line, F.lit(2), F.length(line) - 4), "UTF-8"), F.lit(b"\xff\xc0\xed\xa0\x80"), F.encode(F.substr(line, F.length(line) - 2), "UTF-8"))
    value = F.when(F.col("event_id") % 4 == 1, broken.cast("string")).otherwise(line)
    W.table(spark, d, "events").select(value.alias("value")).write.text(folder)
    schema = "event_id bigint, event_type string"
    read, rejects = S.json_lines(spark, folder, schema)
    dropped = S.json_lines(spark, folder, schema, ignore=True)[0]
    again = rejects.select(F.from_json(S.decodable(F.col("line")), schema).alias("r")).select("r.*")
    parts = [df.groupBy("event_type").agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.sum("event_id").alias("total")) for mode, df in (("dropped", dropped), ("rejected", again), ("read", read))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH r AS (SELECT id, (SELECT count(*) FROM w_file f WHERE f.task_id = t.id AND format = 'png') AS previews, CASE WHEN title IS NULL OR id % 6 = 0 THEN '' ELSE 'main' END AS main, process_state = 'committed' AS uploaded FROM w_task t)
    SELECT count(*) AS total, sum(previews)::BIGINT AS preview_count, count_if(main <> '')::BIGINT AS description_success_count, count_if(uploaded)::BIGINT AS upload_attempts, count(*) AS lines FROM r""")
def run_summary(spark, d):
    """The summary of a run, observed by the pass that appends its results as JSON lines, and the number of lines there."""
    folder = state_folder(spark, "results")
    shown = W.files(spark, d).where("format = 'png'").groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias("preview_count"))
    said = F.when(F.col("title").isNull() | (F.col("id") % 6 == 0), "").otherwise("main")
    rows = W.tasks(spark, d).select("id", said.alias("description_main"), F.coalesce(F.col("process_state") == "committed", F.lit(False)).alias("uploaded")).join(shown, "id", "left").na.fill(0, ["preview_count"])
    told = S.append_lines(
        rows, folder, total=F.count(F.lit(1)), preview_count=F.coalesce(F.sum("preview_count"), F.lit(0)), description_success_count=F.count_if(F.col("description_main") != ""), upload_attempts=F.count_if("uploaded"))
    summary = spark.range(1).select(*(F.lit(told[c]).cast("bigint").alias(c) for c in ("total", "preview_count", "description_success_count", "upload_attempts")))
    return summary.crossJoin(spark.read.text(folder).agg(F.count("*").alias("lines")))


@query("""SELECT asset_id, file_path, 'store' AS source, CASE WHEN style LIKE '%1' THEN '' ELSE 'pack ' || style END AS pack_name, fmt, CASE WHEN fmt = '' THEN '' ELSE style END AS style, theme FROM w_asset""")
def asset_index(spark, d):
    """Assets as nested JSON lines, some without a pack or a style, flattened to the index's seven columns, in place of an older index."""
    folder = state_folder(spark, "assets")
    a = W.assets(spark, d)
    metadata = F.struct(F.upper("fmt").alias("format"), F.when(F.col("fmt") != "", F.col("style")).alias("style"), "theme")
    pack = F.when(~F.col("style").endswith("1"), F.concat(F.lit("pack "), "style"))
    a.select(F.col("asset_id").alias("id"), "file_path", F.lit("store").alias("source"), pack.alias("source_pack"), metadata.alias("metadata")).write.json(f"{folder}/raw")
    index = S.asset_index(spark, f"{folder}/raw")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


@query("""WITH k AS (SELECT DISTINCT 'site' || (p_size % 2) AS source, p_brand FROM part) SELECT source, 'pack_' || p_brand AS pack, 'about ' || p_brand AS description, CASE WHEN source = 'site0' THEN p_brand || '|x' ELSE '' END AS tags FROM k""")
def pack_metadata(spark, d):
    """Metadata of packs of two sources, a JSON file for each pack; some hold no tags."""
    folder = state_folder(spark, "packs")
    site = F.concat(F.lit("site"), F.col("p_size") % 2)
    packs = W.table(spark, d, "part").select(site.alias("source"), "p_brand").distinct()
    tags = F.when(F.col("source") == "site0", F.array("p_brand", F.lit("x")))
    body = packs.select("source", F.struct(F.concat(F.lit("about "), "p_brand").alias("description"), tags.alias("tags"), F.concat(F.lit("pack_"), "p_brand").alias("name")).alias("pack"), F.concat(F.lit("pack_"), "p_brand").alias("file"))
    body.write.partitionBy("source", "file").json(folder)  # folders stand for the files' names
    place = lambda name: F.url_decode(F.url_decode(F.regexp_extract("_metadata.file_path", f"/{name}=([^/]*)/", 1))).alias(name)
    read = spark.read.option("recursiveFileLookup", True).schema("pack struct<description: string, tags: array<string>>").json(folder)
    rows = read.select(place("source"), place("file"), "pack.description", F.coalesce("pack.tags", F.array().cast("array<string>")).alias("tags"))
    return rows.select("source", F.col("file").alias("pack"), "description", F.array_join("tags", "|").alias("tags"))


def _assets(spark, d):
    """Texts by language and types of events as folders of files."""
    folder = state_folder(spark, "folder")
    W.table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(f"{folder}/notes")
    W.table(spark, d, "events").where("event_type <> ''").select("event_type").write.csv(f"{folder}/types")
    return folder


_BYTES = """SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS prefix, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS total_bytes FROM documents GROUP BY 1"""


@query("""WITH n AS (SELECT DISTINCT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang FROM documents) SELECT 'lang=' || lang AS prefix, 1::BIGINT AS n_keys, true AS found FROM n UNION ALL SELECT 'lang=none', 1, false""")
def storage_keys(spark, d):
    """Which of the expected files a folder holds: one of each language, and one of a language that isn't there."""
    files = S.scan_files(spark, f"{_assets(spark, d)}/notes").withColumn("path", F.url_decode("path"))
    first = files.groupBy(F.regexp_extract("path", "/(lang=[^/]*)/", 1).alias("prefix")).agg(F.regexp_extract(F.min("path"), "(lang=[^/]*/[^/]*)$", 1).alias("key"))
    keys = first.unionByName(spark.range(1).select(F.lit("lang=none").alias("prefix"), F.lit("lang=none/part-0.txt").alias("key")))
    return S.present(keys, files).groupBy("prefix").agg(F.count("*").alias("n_keys"), F.bool_and("found").alias("found"))


@query(_BYTES)
def storage_inventory(spark, d):
    files = S.scan_files(spark, f"{_assets(spark, d)}/notes")
    return S.inventory(files, F.url_decode(F.regexp_extract("path", "/lang=([^/]*)/", 1))).select("prefix", "total_bytes")


@query(_BYTES)
def unchanged_files(spark, d):
    """Bytes in files that a second scan finds sound, and as they were by size and time of change and by content."""
    folder = f"{_assets(spark, d)}/notes"
    before, now = (S.scan_files(spark, folder, content=True) for _ in range(2))
    same = S.unchanged(before, now).join(before.select("path", F.col("md5").alias("old")), "path").where("md5 = old and header_ok")
    return S.inventory(same, F.url_decode(F.regexp_extract("path", "/lang=([^/]*)/", 1))).select("prefix", "total_bytes")


@query("""SELECT 'text' AS resource_type, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS total_bytes FROM documents
    UNION ALL SELECT 'table', sum(strlen(event_type) + 1)::BIGINT FROM events WHERE event_type <> ''""")
def typed_scan(spark, d):
    files = S.accepted(S.scan_files(spark, _assets(spark, d)), ["txt", "csv"], 1 << 40)
    kinds = S.typed(files, {"text": ["txt"], "table": ["csv", "txt"]})
    return kinds.groupBy("resource_type").agg(F.sum("length").alias("total_bytes"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'synced' ELSE process_state END AS process_state FROM w_task")
def state_versions(spark, d):
    """Loads a state that isn't there yet, saves the tasks, and saves them again with every third one moved on."""
    folder, schema = state_folder(spark, "state"), "id bigint, process_state string"
    tasks = W.tasks(spark, d).select("id", "process_state")
    S.save_state(S.load_state(spark, folder, schema).unionByName(tasks), folder)
    old = S.load_state(spark, folder, schema)
    S.save_state(old.withColumn("process_state", F.when(F.col("id") % 3 == 0, "synced").otherwise(F.col("process_state"))), folder)
    return S.load_state(spark, folder, schema)


@query("""SELECT 'res-' || id AS resource, CASE WHEN id % 4 = 0 THEN 'res-' || (id + 2) || '|res-' || (id + 1) ELSE '' END AS dependencies, CASE WHEN id % 3 <> 0 THEN process_state ELSE 'unknown' END AS status, CASE WHEN id % 2 = 0 THEN title END AS title, id % 2 = 0 AND title IS NOT NULL AS written FROM w_task""")
def resource_index(spark, d):
    """The index of resources as appended JSON lines: dependencies, a default status, and no field where a value is null."""
    folder = state_folder(spark, "index")
    t = W.tasks(spark, d).withColumn("resource", F.col("resource_id"))
    name = lambda n: F.concat(F.lit("res-"), F.col("id") + n)
    needs = t.where("id % 4 = 0").select("resource", F.posexplode(F.array(name(2), name(1))).alias("place", "dependency"))
    out = S.resource_entries(t, needs, t.where("id % 3 <> 0").select("resource", F.col("process_state").alias("status")), t.select("resource", F.when(F.col("id") % 2 == 0, F.col("title")).alias("title")))
    for part in (0, 1):
        out.where(F.pmod(F.xxhash64("resource"), F.lit(2)) == part).write.mode("append").option("ignoreNullFields", True).json(folder)
    text = spark.read.text(folder)
    rows = text.select(F.from_json("value", out.schema).alias("r"), F.contains("value", F.lit('"title":')).alias("written")).select("r.*", "written")
    return rows.withColumn("dependencies", F.array_join("dependencies", "|"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey, NULL AS note FROM orders WHERE o_orderkey % 2 = 0),
    b AS (SELECT row_number() OVER (ORDER BY o_orderkey) + (SELECT count(*) FROM a) AS id, o_orderkey, o_orderstatus AS note FROM orders WHERE o_orderkey % 2 = 1)
    SELECT id, o_orderkey, note FROM a UNION ALL SELECT id, o_orderkey, note FROM b""")
def task_table(spark, d):
    """A task table in two appends with running ids; the second brings a further column."""
    path = f"{state_folder(spark, 'tasks')}/table"
    o = W.table(spark, d, "orders")
    S.append_table(o.where("o_orderkey % 2 = 0").select("o_orderkey"), path, "o_orderkey")
    S.append_table(o.where("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_orderstatus").alias("note")), path, "o_orderkey")
    return S.read_table(spark, path).select("id", "o_orderkey", "note")


@query("""SELECT 'task' AS name, count(*) AS n, min(doc_id + 1) AS least, max(process_state) AS state, sum(0)::BIGINT AS zeros FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, 'discovered' AS process_state FROM documents)
    UNION ALL SELECT 'file', count(*), min(1), 'main', 0 FROM (SELECT 1 FROM w_file WHERE task_id % 2 = 0) UNION ALL SELECT 'preview', count(*), min(1), 'primary', 0 FROM (SELECT 1 FROM w_file WHERE format = 'png') UNION ALL SELECT 'description', count(*), min(1), '', 0 FROM documents
    UNION ALL SELECT 'embedding', count(*), min(1), '', 0 FROM embeddings UNION ALL SELECT 'upload_job', 0, NULL, NULL, NULL UNION ALL SELECT 'log', count(*), min(1), NULL, 0 FROM events""")
def task_tables(spark, d):
    """The seven tables of the pipeline's state, filled from what there is; upload jobs have none, files are those of half the tasks."""
    folder = state_folder(spark, "tables")
    f = W.files(spark, d)
    S.insert("task", W.tasks(spark, d).select("content_md5", "resource_type", "resource_id", F.col("id").alias("seq")), folder, "seq")
    S.insert("file", f.select("task_id", F.col("path").alias("file_path"), F.col("size").alias("file_size"), F.col("format").alias("file_format")), folder, "task_id", "file_path")
    S.insert("preview", f.where("format = 'png'").select("task_id", "path"), folder, "task_id", "path")
    S.insert("description", W.descriptions(spark, d).select("task_id", F.col("main").alias("main_content"), "prompt_version"), folder, "task_id", "prompt_version")
    S.insert("embedding", W.embeddings(spark, d).select("task_id", "model_version"), folder, "task_id")
    S.insert("log", W.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("event"), F.col("event_id").alias("seq")), folder, "seq")
    shown = {"task": ("process_state", "retry_count"), "file": ("file_role", "is_primary"), "preview": ("role", "used_placeholder"), "description": ("detail_content", None), "embedding": ("checksum", "dimension"), "upload_job": ("upload_state", None), "log": ("detail", None)}
    half = f.where("task_id % 2 = 0").select("task_id")
    parts = []
    for name, (state, zero) in shown.items():
        rows = S.rows_of(spark, name, folder, half if name == "file" else None)
        least = F.min("id") if name == "task" else F.min(F.when(F.col("id") > 0, 1))
        parts.append(rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), least.cast("bigint").alias("least"), F.max(state).alias("state"), F.sum(zero if zero else F.when(F.col("id") > 0, 0)).cast("bigint").alias("zeros")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""SELECT id, coalesce(n, 0) AS file_count, coalesce(total, 0)::BIGINT AS total_size, coalesce(f, '') AS formats, coalesce(p, 0) AS preview_count, id IN (SELECT task_id FROM w_desc) AS has_description, id IN (SELECT vec_id FROM embeddings) AS has_embedding FROM w_order_task
    LEFT JOIN (SELECT task_id, count(*) AS n, sum(size) AS total, string_agg(DISTINCT format, '|' ORDER BY format) AS f, count(*) FILTER (WHERE format = 'png') AS p FROM w_file GROUP BY task_id) x ON id = x.task_id""")
def bucketed_rollup(spark, d):
    """Each task's children, from tables in buckets by task: neither the aggregations nor the joins shuffle."""
    folder = state_folder(spark, "bucketed")
    made = lambda df, name, key: B.write_buckets(df, f"{folder}/{name}", key)
    tasks = made(W.order_tasks(spark, d), "tasks", "id")
    files, said, vectors = (made(df, name, "task_id") for name, df in (("files", W.files(spark, d)), ("descriptions", W.descriptions(spark, d)), ("vectors", W.embeddings(spark, d))))
    done = rollup(tasks, files, said, files.where("format = 'png'"), vectors)
    return done.withColumn("formats", F.array_join("formats", "|"))


@query("""WITH c AS (SELECT task_id, ord, path, count(*) OVER (PARTITION BY task_id) AS n FROM w_file) SELECT t.id AS id, title, process_state, path, n FROM w_order_task t JOIN c ON t.id = c.task_id WHERE ord = 1""")
def bucketed_join(spark, d):
    """Each task with its first file and the number of its files, from tables in buckets by task."""
    folder = state_folder(spark, "bucketed")
    tasks, files = B.write_buckets(W.order_tasks(spark, d), f"{folder}/tasks", "id"), B.write_buckets(W.files(spark, d), f"{folder}/files", "task_id")
    first = files.groupBy(F.col("task_id").alias("id")).agg(F.min_by("path", "ord").alias("path"), F.count("*").alias("n"))
    return tasks.join(first, "id").select("id", "title", "process_state", "path", "n")
