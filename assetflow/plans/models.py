"""Queries around models: prompts, descriptions, vectors, commits, previews and downloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.functions import expressions as X
from assetflow.operators import delivery as D
from assetflow.operators import entities as E
from assetflow.operators import memo as M
from assetflow.operators import previews as V
from assetflow.operators import providers as P
from assetflow.operators import registration as R
from assetflow.operators import selection as S
from assetflow.operators.vector_index import search_index, write_index
from assetflow.sources import working as W
from assetflow.streaming.progress import state_folder

from .catalog import listed
from .registry import query
from .stages import _CHECKED, _FORMAT, _LENGTH, _hits, _vectors

# The user prompt's template, the words that rewrite a search, the filters that may be relaxed.
PROMPT = "请根据下面的资源上下文生成两段式中文描述。\\n{context}"
REWRITES = ["高清", "素材"]
RELAXABLE = ["resource_type", "format_filter"]


@query("SELECT id, '请根据下面的资源上下文生成两段式中文描述。' || chr(10) || title AS prompt FROM w_task")
def prompt_fill(spark, d):
    return W.tasks(spark, d).select("id", F.replace(F.replace(F.lit(PROMPT), F.lit("\\n"), F.lit("\n")), F.lit("{context}"), F.col("title")).alias("prompt"))


@query("""SELECT id, '主体：这是一个' || coalesce(nullif(title, ''), resource_type) || '数字资源，类型为' || resource_type || '，适用于游戏开发和数字内容创作场景，可作为项目素材直接使用。' || chr(10)
    || '细节：该资源为未知格式，预览方式为static，具备标准化预览载体，可用于语义检索和资源管理。' AS description FROM w_task""")
def template_description(spark, d):
    kind = F.col("resource_type")
    return W.tasks(spark, d).select("id", X.template_description(F.coalesce(F.nullif("title", F.lit("")), kind), kind, F.lit("未知"), F.lit("static")).alias("description"))


@query("""WITH f AS (SELECT task_id, count(*) AS n, arg_min(path, ord) AS first_path, arg_min(path, ord) FILTER (WHERE format = 'png') AS preview, string_agg(DISTINCT format, ', ' ORDER BY format) AS formats, count_if(size % 7000 = 0) AS missing FROM w_file GROUP BY task_id)
    SELECT id, CASE WHEN id % 4 = 0 AND first_path <> '' THEN 'audio' ELSE 'image' END AS modality, CASE WHEN id % 4 = 0 AND first_path <> '' THEN first_path ELSE coalesce(preview, '') END AS input_path,
    CASE WHEN preview IS NULL THEN 'none' ELSE 'static' END AS strategy, coalesce(formats, 'unknown') AS formats, coalesce(n, 0) AS file_count, round(coalesce(missing, 0) / greatest(coalesce(n, 0), 1), 6) AS missing_ratio FROM w_order_task LEFT JOIN f ON id = task_id""")
def description_input(spark, d):
    """What a model is given of each resource: every fourth one is audio; the first picture is the preview."""
    png = F.col("format") == "png"
    f = W.files(spark, d).groupBy(F.col("task_id").alias("id")).agg(
        F.count("*").alias("n"), F.min_by("path", "ord").alias("first_path"), F.min_by(F.when(png, F.col("path")), F.when(png, F.col("ord"))).alias("preview"),
        F.array_join(F.array_sort(F.collect_set("format")), ", ").alias("formats"), F.count_if(F.col("size") % 7000 == 0).alias("missing"))
    t = W.order_tasks(spark, d).select("id").join(f, "id", "left")
    audio, n = (F.col("id") % 4 == 0) & (F.col("first_path") != ""), F.coalesce("n", F.lit(0))
    return t.select(
        "id", F.when(audio, "audio").otherwise("image").alias("modality"), F.when(audio, F.col("first_path")).otherwise(F.coalesce("preview", F.lit(""))).alias("input_path"),
        F.when(F.col("preview").isNull(), "none").otherwise("static").alias("strategy"), F.coalesce("formats", F.lit("unknown")).alias("formats"), n.alias("file_count"),
        F.round(F.coalesce("missing", F.lit(0)) / F.greatest(n, F.lit(1)), 6).alias("missing_ratio"))


@query("""SELECT id, CASE WHEN trim(title, E' \\t\\n\\r') <> '' THEN 'about ' || title END AS result, CASE WHEN trim(title, E' \\t\\n\\r') <> '' THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN trim(title, E' \\t\\n\\r') <> '' THEN CASE WHEN length(title) > 20 THEN 4 ELSE 1 END ELSE 6 END AS attempts FROM w_task""")
def describe_batch(spark, d):
    """Descriptions by a provider that refuses long titles, then by one that takes all."""
    done = P.run(W.tasks(spark, d).select("id", "title"), "title", ["short_only", "template"], options={"prefix": "about "})
    return done.select("id", "result", "status", "attempts")


@query("""SELECT id, CASE WHEN n < 6 AND trim(coalesce(title, ''), E' \\t\\n\\r\\f\\v') <> '' THEN title ELSE '' END AS description, CASE WHEN n >= 6 THEN 'HTTP 429: too many requests' WHEN trim(coalesce(title, ''), E' \\t\\n\\r\\f\\v') = '' THEN 'blank input' ELSE '' END AS error
    FROM (SELECT id, title, coalesce(length(title), 0) % 8 AS n FROM w_task)""")
def describe_patiently(spark, d):
    """Descriptions by a service that refuses up to seven calls a text for too many requests; six calls are made, without waits. What fails has an empty description."""
    done = P.run(W.tasks(spark, d).select("id", "title"), "title", ["busy"], options={"wait": 0}, retries=0)
    return done.select("id", F.coalesce("result", F.lit("")).alias("description"), F.coalesce("error", F.lit("")).alias("error"))


@query(f"""WITH e AS (SELECT conv_id, output, coalesce({_FORMAT}, {_LENGTH}, CASE WHEN NOT regexp_matches(output, '字体|font|笔刷|brush') THEN 'MISSING_KEYWORD|描述中缺少资源类型关键词，期望包含 [''字体'', ''font'', ''笔刷'', ''brush''] 之一' END) AS error, length(output) % 5 <> 0 AS helped FROM {_CHECKED})
    SELECT conv_id, CASE WHEN error IS NULL THEN output WHEN helped THEN '主体：字体' || repeat('体', 60) || chr(10) || '细节：' || repeat('节', 60) END AS result, CASE WHEN error IS NULL OR helped THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN NOT (error IS NULL OR helped) THEN error END AS error, CASE WHEN error IS NULL THEN 1 WHEN helped THEN 4 ELSE 6 END AS attempts FROM e""")
def describe_validated(spark, d):
    """Descriptions of fonts that must pass the checks: a provider's own up to three times, then those of a second one."""
    return M.answered(W.outputs(spark, d), "output", ["echo", "two_lines"], folder=state_folder(spark, "descriptions"), described=F.lit("font")).select("conv_id", "result", "status", "error", "attempts")


def _commits(spark, d):
    asked = W.order_tasks(spark, d).select(F.concat(F.lit("res-"), "id").alias("resource_id"), F.when(F.col("id") % 6 == 0, "  ").otherwise(F.concat(F.lit("main "), "id")).alias("description_main"),
                                           F.concat(F.lit("detail "), "id").alias("description_detail"), F.lit("").alias("description_full"))
    return D.commit(asked, W.tasks(spark, d).select("resource_id", "id", "process_state", "resource_type"), ["hash_vector"], 64, "hash_v1", {"dim": 64}, 0)


@query("""WITH r AS (SELECT o.id AS req, t.*, CASE WHEN o.id % 6 = 0 THEN '  ' ELSE 'main ' || o.id END AS x FROM w_order_task o LEFT JOIN w_task t ON o.id = t.id)
    SELECT 'res-' || req AS resource_id, CASE WHEN id IS NULL OR process_state <> 'committed' AND trim(x) = '' THEN 'failed' ELSE 'committed' END AS state,
    CASE WHEN id IS NULL THEN 'resource not found' WHEN process_state <> 'committed' AND trim(x) = '' THEN 'description_main is required for embedding generation' ELSE '' END AS error FROM r""")
def commit_validation(spark, d):
    """Answers to requests to commit resources; some have a blank description."""
    return _commits(spark, d)["answers"]


@query("""WITH r AS (SELECT t.*, 'main ' || o.id AS x FROM w_order_task o JOIN w_task t ON o.id = t.id WHERE o.id % 6 <> 0 AND t.process_state <> 'committed'),
    v AS (SELECT id, resource_type, list_transform(range(64), lambda i: ((('0x' || substr(md5(x), 1, 8))::BIGINT + i) % 1000) / 1000.0) AS v, x FROM r)
    SELECT id AS task_id, x AS main, 'detail ' || id AS detail, 64 AS dimension, 'hash_v1' AS model_version, round(list_sum(v), 6) AS total, resource_type, 'committed' AS process_state, 'committed|description + embedding saved' AS log FROM v""")
def commit_rows(spark, d):
    """The rows of all tables that follow from the commits, side by side."""
    made = _commits(spark, d)
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6)
    vectors = made["vectors"].select(F.regexp_extract("resource_id", r"(\d+)", 1).cast("bigint").alias("task_id"), total.alias("total"), "resource_type")
    out = made["descriptions"].select("task_id", "main", "detail").join(made["embeddings"], "task_id").join(vectors, "task_id")
    out = out.join(made["states"].withColumnRenamed("id", "task_id"), "task_id").join(made["logs"].withColumnRenamed("detail", "told"), "task_id")
    return out.withColumn("log", F.concat_ws("|", "event", "told")).drop("event", "told")


@query("""WITH r AS (SELECT 'res-' || o.id AS resource_id, o.id % 4 AS k FROM w_order_task o)
    SELECT resource_id, CASE k WHEN 0 THEN 'failed' ELSE 'committed' END AS state, CASE k WHEN 0 THEN CASE WHEN resource_id LIKE '%0' THEN 'embedding failed: input too long' ELSE 'dimension mismatch: expected 64, got 8' END ELSE '' END AS error FROM r WHERE k = 0""")
def commit_failures(spark, d):
    """Answers where the vector fails: refused by the provider, or of another dimension."""
    asked = W.order_tasks(spark, d).where("id % 4 = 0").select("id", F.concat(F.lit("res-"), "id").alias("resource_id"))
    tasks = asked.select("resource_id", "id", F.lit("description_ready").alias("process_state"), F.lit("pack").alias("resource_type"))
    text = lambda c: F.concat(F.lit(f"{c} "), "id").alias(f"description_{c}")
    said = asked.select("resource_id", "id", text("main"), text("detail"), text("full"))
    long = said.where(F.col("id") % 10 == 0).withColumn("description_main", F.repeat(F.lit("x"), F.lit(40)))
    first = D.commit(long.drop("id"), tasks, ["short_vector"], 64, "v", {"dim": 64}, 0)["answers"]
    return first.unionByName(D.commit(said.where(F.col("id") % 10 != 0).drop("id"), tasks, ["hash_vector"], 64, "v", {"dim": 8}, 0)["answers"])


@query("SELECT vec_id, len(embedding) AS dimension, vec_id % 2 = 0 AS unchanged FROM embeddings")
def vector_checksums(spark, d):
    """Whether each vector has the checksum of what was stored, of which every other one differs in one component."""
    e = W.table(spark, d, "embeddings")
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((i == 0) & (F.col("vec_id") % 2 == 1), x + 1).otherwise(x))
    stored = e.select("vec_id", P.vector_checksum(moved).alias("stored"))
    own = e.select("vec_id", F.size("embedding").alias("dimension"), P.vector_checksum("embedding").alias("md5"))
    return own.join(stored, "vec_id").select("vec_id", "dimension", (F.col("md5") == F.col("stored")).alias("unchanged"))


@query("""WITH l AS (SELECT task_id, max_by(main, id) AS main FROM w_desc GROUP BY task_id), c AS (SELECT t.id, resource_id, resource_type, CASE WHEN t.id % 5 = 0 THEN '' ELSE coalesce(trim(main, E' \\t\\n\\r\\f\\v'), '') END AS x FROM w_task t LEFT JOIN l ON t.id = l.task_id WHERE process_state = 'committed')
    SELECT id, resource_id, resource_type, CASE WHEN x = '' THEN 'skipped' ELSE 'ok' END AS outcome, CASE WHEN x <> '' THEN round(list_sum(list_transform(range(64), lambda i: ((('0x' || substr(md5(x), 1, 8))::BIGINT + i) % 1000) / 1000.0)), 6) END AS total, x <> '' AS checked FROM c""")
def reembed(spark, d):
    """Vectors of the latest main description of every committed task; every fifth one's is blank."""
    said = W.descriptions(spark, d).withColumn("main", F.when(F.col("task_id") % 5 == 0, "").otherwise(F.col("main")))
    done = D.reembedded(W.tasks(spark, d), said, ["hash_vector"], 64, {"dim": 64})
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6)
    return done.select("id", "resource_id", "resource_type", "outcome", total.alias("total"), (F.length("checksum") == 32).alias("checked")).na.fill(False, ["checked"])


@query()
def probed_top_k(spark, d):
    """Top ten of each query in a stored index of all vectors, among the cells nearest to it, as many as nine tenths of the neighbours need."""
    vectors, asked = (x.drop("kind") for x in _vectors(spark, d))
    folder = state_folder(spark, "index")
    write_index(vectors, folder)
    return search_index(spark, folder, asked, 10)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT vec_id AS query_id, x AS y FROM v WHERE vec_id % 100 = 0),
    h AS (SELECT query_id FROM q, v WHERE vec_id <> query_id AND round(list_cosine_similarity(y, x), 6) >= 0.6)
    SELECT query_id, 'query ' || query_id || ' 高清|query ' || query_id || ' 素材' AS rewrites, 'resource_type|format_filter' AS relaxable, 0.4::DOUBLE AS threshold, true AS try_cross_type FROM q WHERE query_id NOT IN (SELECT query_id FROM h)""")
def search_suggestion(spark, d):
    """Suggestions for searches without a hit of 0.6 or more besides the vector itself."""
    hits = _hits(spark, d, 2).where("resource_id <> query_id and score >= 0.6").select("query_id")
    asked = _vectors(spark, d)[1].select("query_id")
    text = F.concat(F.lit("query "), "query_id", F.lit(" "))
    return asked.join(hits, "query_id", "left_anti").select(
        "query_id", F.concat_ws("|", *(F.concat(text, F.lit(w)) for w in REWRITES)).alias("rewrites"), F.lit("|".join(RELAXABLE)).alias("relaxable"),
        F.greatest(F.lit(0.1), F.round(F.lit(0.6) - 0.2, 6)).alias("threshold"), F.lit(True).alias("try_cross_type"))


_DOWNLOADS = """WITH p AS (SELECT task_id, arg_min(path, ord) AS path, arg_min(size, ord) AS size, arg_min(path, ord) FILTER (WHERE format = 'ogg') AS ppath, arg_min(size, ord) FILTER (WHERE format = 'ogg') AS psize FROM w_file GROUP BY task_id),
    r AS (SELECT r.id, CASE WHEN r.id % 13 = 0 THEN ' ' ELSE 'res-' || r.id END AS resource_id, CASE r.id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 90000 ELSE 60 END AS expire_seconds, o.id AS oid, o.title, coalesce(ppath, path) AS path, CASE WHEN ppath IS NULL THEN size ELSE psize END AS size FROM w_task r LEFT JOIN w_order_task o ON r.id = o.id LEFT JOIN p ON o.id = p.task_id),
    e AS (SELECT *, CASE WHEN trim(resource_id) = '' THEN 'INVALID_REQUEST|resource_id 不能为空' WHEN expire_seconds <= 0 THEN 'INVALID_REQUEST|expire_seconds 必须大于 0' WHEN expire_seconds > 86400 THEN 'INVALID_REQUEST|expire_seconds 不能超过 86400' WHEN oid IS NULL THEN 'RESOURCE_NOT_FOUND|resource not found' ELSE '|' END AS e FROM r)
    SELECT resource_id, expire_seconds, split_part(e, '|', 1) AS error_code, split_part(e, '|', 2) AS error_message, CASE WHEN e <> '|' THEN '' WHEN id % 5 = 0 THEN 'packs/' || id || '.zip' WHEN path IS NOT NULL THEN 'files/res-' || id || '/' || split_part(path, '/', -1) ELSE 'files/res-' || id || '/' END AS key,
    CASE WHEN e <> '|' THEN '' WHEN id % 5 = 0 THEN CASE WHEN id % 10 = 0 THEN 'resource' ELSE id || '.zip' END WHEN path IS NOT NULL THEN split_part(path, '/', -1) ELSE title END AS file_name, CASE WHEN e <> '|' THEN 0 WHEN id % 5 = 0 THEN id * 7 ELSE coalesce(size, 0) END::BIGINT AS file_size,
    CASE WHEN e <> '|' THEN '' WHEN id % 5 = 0 THEN 'application/zip' ELSE 'application/octet-stream' END AS content_type, CASE WHEN e <> '|' THEN '' ELSE strftime(TIMESTAMP '2024-01-01' + coalesce(expire_seconds, 3600) * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S+00:00') END AS expires_at FROM e"""


@query(_DOWNLOADS)
def download_manifest(spark, d):
    """What each request for a download gets, as of the first of January 2024; every fifth task has a package."""
    id_ = F.col("id")
    r = W.tasks(spark, d).select(
        F.when(id_ % 13 == 0, " ").otherwise(F.concat(F.lit("res-"), "id")).alias("resource_id"),
        F.when(id_ % 7 == 0, F.lit(None)).when(id_ % 7 == 1, 0).when(id_ % 7 == 2, 90000).otherwise(60).alias("expire_seconds"))
    fifth = id_ % 5 == 0
    t = W.order_tasks(spark, d).select(
        F.concat(F.lit("res-"), "id").alias("resource_id"), "id", "title", F.when(fifth, F.concat(F.lit("packs/"), "id", F.lit(".zip"))).alias("download_key"),
        F.when(id_ % 10 != 0, F.concat("id", F.lit(".zip"))).otherwise("").alias("download_name"), (id_ * 7).alias("download_size"), F.when(fifth, "application/zip").alias("download_type"))
    f = W.files(spark, d).select("task_id", "ord", (F.col("format") == "ogg").alias("is_primary"), "path", "size", F.lit("").alias("key"))
    return D.download_links(r, t, f, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(f"""SELECT resource_id, expire_seconds, CASE WHEN error_code = '' THEN key ELSE '' END AS download_url, CASE WHEN error_code = '' THEN expires_at ELSE '' END AS expires_at, CASE WHEN error_code = '' THEN file_name ELSE '' END AS file_name,
    CASE WHEN error_code = '' THEN file_size ELSE 0 END::BIGINT AS file_size, error_code, error_message FROM ({_DOWNLOADS})""")
def download_answers(spark, d):
    """What an agent is told of each request for a download."""
    return D.agent_answers(download_manifest(spark, d), "resource_id", "expire_seconds")


@query("""SELECT 'res-' || o.id AS resource_id, CASE WHEN t.id IS NULL THEN 'not_found' ELSE 'found' END AS status, t.process_state AS process_state, t.title AS title, coalesce(n, 0) AS n_files, coalesce(paths, '') AS paths, coalesce(pictures, '') AS previews, main, CASE WHEN e.vec_id IS NULL THEN '' ELSE '64|embed_v' || (e.vec_id % 3) END AS embedding,
    CASE WHEN t.id % 2 = 0 THEN 'a|b' ELSE '' END AS tags, CASE WHEN t.id % 10 <> 0 THEN 'res-' || (t.id - t.id % 10) END AS parent_resource_id, CASE WHEN t.id % 5 = 0 THEN 'packs/' || t.id || '.zip' END AS download_key
    FROM w_order_task o LEFT JOIN w_task t ON o.id = t.id LEFT JOIN (SELECT task_id, count(*) AS n, string_agg(path, '|' ORDER BY ord) AS paths, string_agg(path, '|' ORDER BY ord) FILTER (WHERE format = 'png') AS pictures FROM w_file GROUP BY task_id) f ON t.id = f.task_id
    LEFT JOIN (SELECT task_id, arg_max_null(main, id) AS main FROM w_desc GROUP BY task_id) x ON t.id = x.task_id LEFT JOIN embeddings e ON t.id = e.vec_id""")
def resource_detail(spark, d):
    """A row for every requested id, with all that belongs to its resource; every other one's list of tags can't be read."""
    id_ = F.col("id")
    t = W.tasks(spark, d).withColumns({
        "tags_json": F.when(id_ % 2 == 0, '["a", "b"]').otherwise("none"), "child_resource_ids_json": F.lit(None).cast("string"), "contains_resource_types_json": F.lit("[]"),
        "parent_resource_id": F.when(id_ % 10 != 0, F.concat(F.lit("res-"), id_ - id_ % 10)), "download_key": F.when(id_ % 5 == 0, F.concat(F.lit("packs/"), "id", F.lit(".zip")))})
    f = W.files(spark, d)
    vectors = W.embeddings(spark, d).withColumn("dimension", F.lit(64))
    asked = W.order_tasks(spark, d).select(F.concat(F.lit("res-"), "id").alias("resource_id"))
    found = R.details(asked, t, f.select("task_id", "ord", "path"), f.where("format = 'png'").select("task_id", F.col("ord").alias("id"), "path"), W.descriptions(spark, d), vectors)
    paths = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["path"]), "|"), F.lit(""))
    return found.select(
        "resource_id", "status", "process_state", "title", F.greatest(F.coalesce(F.size("files"), F.lit(0)), F.lit(0)).alias("n_files"), paths("files").alias("paths"), paths("previews").alias("previews"), F.col("description.main").alias("main"),
        F.concat_ws("|", "embedding.dimension", "embedding.model_version").alias("embedding"), F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"), "parent_resource_id", "download_key")


@query("""SELECT id, bool_and(size % 7000 <> 0) AND id % 4 <> 1 AS reusable FROM w_order_task JOIN w_file ON id = task_id AND format = 'png' GROUP BY id UNION ALL SELECT id, false FROM w_order_task WHERE id NOT IN (SELECT task_id FROM w_file WHERE format = 'png')""")
def preview_reuse(spark, d):
    """Tasks whose previews may be used again: all in storage (every file of whole 7,000 bytes is lost) and the file behind them unchanged (every fourth one isn't)."""
    f = W.files(spark, d)
    previews = f.where("format = 'png'").groupBy(F.col("task_id").alias("id")).agg(F.collect_list(F.concat_ws("/", "task_id", "path")).alias("previews"))
    held = W.order_tasks(spark, d).select("id", F.struct(F.lit(1).alias("size"), F.lit(2).alias("modified")).alias("fingerprint")).join(previews, "id", "left")
    now = held.select("id", F.struct(F.when(F.col("id") % 4 == 1, 3).otherwise(1).alias("size"), F.lit(2).alias("modified")).alias("fingerprint"))
    return E.reusable_previews(held, now, f.where("size % 7000 <> 0").select(F.concat_ws("/", "task_id", "path").alias("path")))


@query("""WITH r AS (SELECT id, process_state, retry_count, id % 3 AS outcome FROM w_task)
    SELECT id, CASE outcome WHEN 0 THEN 'committed' WHEN 1 THEN 'synced' ELSE process_state END AS process_state, CASE WHEN outcome = 2 THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN outcome = 2 THEN repeat('x', 500) ELSE '' END AS error,
    CASE outcome WHEN 0 THEN 'registered|uploaded|committed' WHEN 1 THEN 'registered|synced' ELSE 'upload_failed' END AS log FROM r""")
def stage_results(spark, d):
    """Applies outcomes of uploads: every third one succeeds, already exists, or fails with a long error."""
    t = W.tasks(spark, d).select("id", "process_state", "retry_count")
    outcome = F.element_at(F.array(*map(F.lit, ("uploaded", "exists", "failed"))), (F.col("id") % 3 + 1).cast("int"))
    told = t.select("id", outcome.alias("outcome"), F.repeat(F.lit("x"), F.lit(700)).alias("message"))
    return S.apply_outcomes(t, told)


@query(r"""WITH q AS (SELECT DISTINCT o_orderkey // 20 AS id FROM orders), t AS (SELECT id, id % 8 AS k, md5('r' || id) AS md5 FROM q),
    f AS (SELECT task_id // 20 AS id, (task_id % 20) * 10 + ord AS ord, CASE WHEN id % 8 = 4 AND format = 'fbx' THEN regexp_replace(path, 'fbx$', 'SVG') WHEN id % 8 = 5 AND format = 'ogg' THEN regexp_replace(path, 'ogg$', 'ttf') ELSE path END AS path, format,
        regexp_extract(path, 'p(\d+)_', 1)::BIGINT AS a, regexp_extract(path, '_(\d+)', 1)::BIGINT AS b FROM w_file WHERE task_id // 20 % 8 <> 7),
    p AS (SELECT id, arg_min(path, (ord % 5 <> 2, ord)) AS main FROM f GROUP BY id),
    r AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY a, b, ord) - 1 AS r, count(*) OVER (PARTITION BY id) AS n, [16, 12, 9][id % 8 + 1] AS most FROM f WHERE format = 'png' AND id % 8 < 3),
    s AS (SELECT id, max(n) AS n, list(path ORDER BY r) AS xs FROM r WHERE n <= most OR list_contains(list_transform(range(most), lambda i: round_even(i * ((n - 1) / (most - 1)::DOUBLE), 0)::BIGINT), r) GROUP BY id),
    j AS (SELECT t.id, k, md5, coalesce(n, 0) AS n, coalesce(xs, []) AS xs, main, lower(regexp_extract(coalesce(main, ''), '([^.]*)$', 1)) AS ext FROM t LEFT JOIN s ON t.id = s.id LEFT JOIN p ON t.id = p.id),
    c AS (SELECT *, CASE WHEN k = 0 AND n > 0 THEN 'primary|contact_sheet|composed|high|_tileset.webp' WHEN k = 1 AND n > 1 THEN 'primary|gif|composed|high|_sequence.gif' WHEN k = 2 AND n > 0 THEN 'primary|contact_sheet|composed|medium|_pack.webp'
        WHEN k IN (3, 4) AND ext = 'png' THEN 'primary|static|direct|high|_preview.webp' WHEN k IN (3, 4) AND ext = 'svg' THEN 'primary|static|direct|medium|_preview.webp' WHEN k IN (3, 4) AND main IS NOT NULL THEN 'primary|static|fallback|low|_metadata.webp'
        WHEN k = 5 AND ext = 'ttf' THEN 'primary|static|composed|medium|_font.webp' ELSE 'primary|static|metadata_only|low|_metadata.webp' END AS p FROM j),
    d AS (SELECT id, md5, p, CASE WHEN split_part(p, '|', 2) <> 'static' THEN xs WHEN split_part(p, '|', 4) <> 'low' THEN [main] ELSE [] END AS xs, CASE WHEN split_part(p, '|', 2) = 'contact_sheet' THEN least(4 - k // 2, greatest(2, ceil(sqrt(len(xs)))))::INT ELSE 0 END AS grid FROM c
        UNION ALL SELECT id, md5, 'gallery|static|direct|medium|_tile_preview.webp', xs[1:1], 0 FROM c WHERE k = 0 AND n > 0)
    SELECT id, split_part(p, '|', 1) AS role, split_part(p, '|', 2) AS strategy, split_part(p, '|', 3) AS mode, split_part(p, '|', 4) AS confidence, md5 || split_part(p, '|', 5) AS output, array_to_string(xs, '|') AS inputs, grid,
    CASE WHEN grid > 0 THEN array_to_string(list_transform(xs[1:grid * grid], lambda x, i: (i - 1) // grid || ',' || (i - 1) % grid || '=' || x), '|') ELSE '' END AS cells FROM d""".replace("\\\\", "\\"))
def preview_plan(spark, d):
    """How each resource is shown, from which pictures in what cells, under what name: the files of twenty orders each as tilesets, sequences, packs, single pictures (also vectors), fonts, sounds and resources without files."""
    kinds = ("tileset", "animation_sequence", "pack", "single_image", "single_image", "font_file", "audio_file", "pack")
    id_ = F.floor(F.col("task_id") / 20)
    f = W.files(spark, d).withColumn("id", id_).where("id % 8 <> 7")
    path = F.when((F.col("id") % 8 == 4) & (F.col("format") == "fbx"), F.regexp_replace("path", "fbx$", "SVG")).when((F.col("id") % 8 == 5) & (F.col("format") == "ogg"), F.regexp_replace("path", "ogg$", "ttf")).otherwise(F.col("path"))
    ord_ = (F.col("task_id") % 20) * 10 + F.col("ord")
    t = W.order_tasks(spark, d).select(F.floor(F.col("id") / 20).alias("id")).distinct()
    t = t.select("id", F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 8 + 1).cast("int")).alias("resource_type"), F.md5(F.concat(F.lit("r"), "id")).alias("content_md5"))
    rows = V.preview_rows(t, f.select("id", ord_.alias("ord"), (ord_ % 5 == 2).alias("is_primary"), path.alias("path")))
    cells = F.transform("cells", lambda c: F.concat(c["row"], F.lit(","), c["col"], F.lit("="), c["path"]))
    return rows.select("id", "role", "strategy", "mode", "confidence", "output", F.array_join("inputs", "|").alias("inputs"), "grid", F.array_join(cells, "|").alias("cells"))


@query("""SELECT id, 'Pack: ' || coalesce(nullif(source, ''), 'Unknown') || '|Type: ' || resource_type || CASE WHEN title <> '' THEN '|Path: ' || title ELSE '' END || CASE WHEN retry_count > 0 THEN '|Files: ' || retry_count ELSE '' END AS card FROM w_task""")
def metadata_card(spark, d):
    lines = X.card_lines(F.col("source"), F.col("resource_type"), F.col("title"), F.array().cast("array<string>"), {"Files": F.col("retry_count")}, F.array().cast("array<string>"))
    return W.tasks(spark, d).select("id", F.when(F.col("resource_type").isNotNull(), F.array_join(lines, "|")).alias("card"))


@query("""WITH r AS (SELECT id, process_state, id % 4 AS k FROM w_task)
    SELECT id, CASE k WHEN 0 THEN 'preview_ready' WHEN 1 THEN 'preview_failed' ELSE process_state END AS process_state, CASE k WHEN 0 THEN '' WHEN 1 THEN 'preview_error' ELSE 'old' END AS last_error_code,
    CASE k WHEN 0 THEN '' WHEN 1 THEN repeat('y', 500) ELSE 'older' END AS last_error_message, CASE k WHEN 0 THEN 'preview_ready|' WHEN 1 THEN 'preview_failed|' || repeat('y', 500) ELSE '' END AS log FROM r""")
def stage_states(spark, d):
    """Tasks after a preview stage that took half of them and failed for every other of these."""
    t = W.tasks(spark, d).select("id", "process_state", F.lit("old").alias("last_error_code"), F.lit("older").alias("last_error_message"))
    told = t.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 1, F.repeat(F.lit("y"), F.lit(600))).alias("message"))
    after, log = S.apply_stage(t, told, "preview")
    return after.join(log.select(F.col("task_id").alias("id"), F.concat_ws("|", "event", "detail").alias("log")), "id", "left").na.fill("", ["log"])
