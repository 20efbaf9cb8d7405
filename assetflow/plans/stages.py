"""Queries over task states, registration, texts and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetflow.functions import expressions as X
from assetflow.operators import delivery as D
from assetflow.operators import registration as R
from assetflow.operators import selection as S
from assetflow.operators.lifecycle import accepted_uploads
from assetflow.operators.search import enrich, ranked
from assetflow.operators.vectors import cosine_top_k as top_k
from assetflow.operators.vectors import usable
from assetflow.sources import working as W
from assetflow.states import CONTINUED, FAILED, REUSABLE, STATES

from .catalog import listed
from .registry import query

_ORDINAL = f"coalesce(nullif(list_position([{listed(STATES)}], process_state), 0) - 1, -1)"


@query("""SELECT 'state' AS kind, coalesce(process_state, '') AS name, count(*) AS n FROM w_task GROUP BY process_state UNION ALL SELECT 'total', '', count(*) FROM w_task UNION ALL SELECT 'vectors', '', count(*) FROM embeddings""")
def state_counts(spark, d):
    return S.stats(W.tasks(spark, d), W.table(spark, d, "embeddings"))


@query("""SELECT id, coalesce(n, 0) AS file_count, coalesce(total, 0)::BIGINT AS total_size, coalesce(f, '') AS formats, coalesce(p, 0) AS preview_count, id IN (SELECT task_id FROM w_desc) AS has_description, id IN (SELECT vec_id FROM embeddings) AS has_embedding FROM w_order_task
    LEFT JOIN (SELECT task_id, count(*) AS n, sum(size) AS total, string_agg(DISTINCT format, '|' ORDER BY format) AS f, count(*) FILTER (WHERE format = 'png') AS p FROM w_file GROUP BY task_id) x ON id = x.task_id""")
def resource_rollup(spark, d):
    f = W.files(spark, d)
    done = S.rollup(W.order_tasks(spark, d), f, W.descriptions(spark, d), f.where("format = 'png'"), W.embeddings(spark, d))
    return done.withColumn("formats", F.array_join("formats", "|"))


@query("SELECT task_id, max(id) AS id, max_by(prompt_version, id) AS prompt_version FROM w_desc GROUP BY task_id")
def latest_description(spark, d):
    return S.latest(W.descriptions(spark, d).select("task_id", "id", "prompt_version"), "task_id", "id")


@query("SELECT task_id, coalesce(min(ord) FILTER (WHERE format = 'fbx'), min(ord)) AS ord FROM w_file GROUP BY task_id")
def primary_file(spark, d):
    flagged = W.files(spark, d).withColumn("is_primary", F.col("format") == "fbx")
    return S.first_per(flagged, "task_id", F.desc("is_primary"), F.col("ord")).select("task_id", "ord")


@query(f"SELECT id, {_ORDINAL}::INT AS place, {_ORDINAL} >= 4 AS described FROM w_task")
def state_order(spark, d):
    at = X.state_ordinal(F.col("process_state")).cast("int")
    return W.tasks(spark, d).select("id", at.alias("place"), (at >= 4).alias("described"))


@query(f"""WITH n AS (SELECT content_md5, max(id) AS id, max_by(process_state, id) AS state FROM w_task GROUP BY content_md5), p AS (SELECT task_id, max_by(prompt_version, id) AS pv FROM w_desc GROUP BY task_id),
    x AS (SELECT req_id, n.id, state, CASE WHEN state IS NULL THEN 'new' WHEN state IN ('synced', 'committed', 'uploaded') THEN CASE WHEN pv <> 'prompt_v1' THEN 'rerun_description' WHEN model_version <> 'embed_v1' THEN 'rerun_embedding' ELSE 'reuse_all' END
        WHEN state IN ({listed(CONTINUED)}) THEN 'resume' ELSE 'new' END AS decision
    FROM w_request r LEFT JOIN n ON r.content_md5 = n.content_md5 LEFT JOIN p ON n.id = p.task_id LEFT JOIN w_embed e ON n.id = e.task_id)
    SELECT req_id, decision, CASE WHEN decision <> 'new' THEN id END AS existing_task_id, CASE decision WHEN 'rerun_description' THEN 'prompt_version 已变更' WHEN 'rerun_embedding' THEN 'embedding_model_version 已变更' WHEN 'reuse_all' THEN '资源已完成且配置一致'
        WHEN 'resume' THEN '任务处于 ' || state || ' 状态，可从断点继续' ELSE CASE WHEN state IS NULL THEN '未找到已有记录' ELSE '未知状态 ' || state || '，创建新任务' END END AS reason FROM x""")
def dedup_decision(spark, d):
    return S.dedup_decision(W.requests(spark, d), W.tasks(spark, d), W.descriptions(spark, d), W.embeddings(spark, d), "prompt_v1", "embed_v1")


@query(f"SELECT id, retry_count FROM w_task WHERE process_state IN ({listed(FAILED)}) AND retry_count < 3")
def retry_candidates(spark, d):
    return S.retry_candidates(W.tasks(spark, d), 3).select("id", "retry_count")


@query(f"""WITH o AS (SELECT id, {_ORDINAL} AS place, coalesce(resource_type = 'audio_file', false) AS audio, resume FROM w_task, (VALUES (true), (false)) v(resume))
    SELECT id, resume, 'preview' AS stage, CASE WHEN resume AND place >= 2 THEN 'skip_done' ELSE 'process' END AS decision FROM o
    UNION ALL SELECT id, resume, 'description', CASE WHEN resume AND place >= 4 THEN 'skip_done' WHEN place < 2 THEN 'skip_not_ready' WHEN audio THEN 'skip_audio' ELSE 'process' END FROM o
    UNION ALL SELECT id, resume, 'upload', CASE WHEN place >= 10 THEN 'skip_done' WHEN place < 4 THEN 'skip_not_ready' ELSE 'process' END FROM o""")
def stage_plan(spark, d):
    """Decisions of a run that resumes and of one that doesn't."""
    t = W.tasks(spark, d)
    both = (S.stage_plan(t, resume).withColumn("resume", F.lit(resume)) for resume in (True, False))
    return next(both).unionByName(next(both)).select("id", "resume", "stage", "decision")


@query("SELECT id, CASE WHEN process_state = 'committed' THEN 'description_ready' ELSE process_state END AS process_state, CASE WHEN process_state <> 'committed' AND id % 3 = 0 THEN 'E01' END AS last_error_code, CASE WHEN process_state <> 'committed' AND id % 3 = 0 THEN 'failed' END AS last_error_message FROM w_task")
def force_reset(spark, d):
    failed = F.col("id") % 3 == 0
    return S.reset_committed(W.tasks(spark, d).select("id", "process_state", F.when(failed, "E01").alias("last_error_code"), F.when(failed, "failed").alias("last_error_message")))


@query("""WITH t AS (SELECT req_id, t.id, CASE WHEN r.source <> '' AND r.source = t.source THEN 1 ELSE 2 END AS tier, updated_at FROM w_request r JOIN w_task t ON trim(r.source_resource_id) = t.source_resource_id WHERE trim(r.source_resource_id) <> ''
    UNION ALL SELECT req_id, t.id, 3, updated_at FROM w_request r JOIN w_task t ON r.idempotency_key = t.idempotency_key WHERE r.idempotency_key <> ''
    UNION ALL SELECT req_id, t.id, 4, updated_at FROM w_request r JOIN w_task t ON r.content_md5 = t.content_md5 WHERE r.content_md5 <> '' AND process_state = 'committed'),
    b AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY tier, updated_at DESC, id DESC) AS n FROM t)
    SELECT r.req_id, coalesce(tier, 0)::INT AS tier, id AS task_id FROM w_request r LEFT JOIN b ON r.req_id = b.req_id AND n = 1""")
def registration_match(spark, d):
    return S.registration_match(W.requests(spark, d), W.tasks(spark, d))


def _profiles(spark, d):
    """Tasks with the 18 columns that a registration may fill, each empty in its own third of the rows, and requests likewise in fourths."""
    i = W.tasks(spark, d).select("id")
    when = lambda k, n, c: F.pmod(F.col("id") + k, F.lit(n)) == c

    def column(k, c, n, word):
        if c in R.NUMBERS:
            return F.when(when(k, n, 0), 0).otherwise(F.col("id") + (k if word == "old" else 1000)).alias(c)
        held = F.concat(F.lit('["' if c in R.LISTS else f"{word}-{c}-"), F.lit(f"{word}-") if c in R.LISTS else F.lit(""), "id", F.lit('"]' if c in R.LISTS else ""))
        empty = F.when(when(k, n, 0), "[]" if c in R.LISTS else "").when(when(k, n, 1), "" if c in R.LISTS else F.lit(None)) if word == "old" else F.when(when(k, n, 0), "")
        return empty.otherwise(held).alias(c)

    every = [*R.TEXTS, *R.LISTS, *R.NUMBERS]
    tasks = i.select("id", *(column(k, c, 3, "old") for k, c in enumerate(every)))
    return tasks, i.where("id % 2 = 0").select("id", *(column(k, c, 4, "new") for k, c in enumerate(every)))


def _merged_sql(k, c):
    if c in R.NUMBERS:
        have, given, empty = f"CASE WHEN (id + {k}) % 3 = 0 THEN 0 ELSE id + {k} END", f"CASE WHEN id % 2 = 1 OR (id + {k}) % 4 = 0 THEN 0 ELSE id + 1000 END", "0"
    elif c in R.LISTS:
        have, given, empty = f"""CASE (id + {k}) % 3 WHEN 0 THEN '[]' WHEN 1 THEN '' ELSE '["old-' || id || '"]' END""", f"""CASE WHEN id % 2 = 1 OR (id + {k}) % 4 = 0 THEN '' ELSE '["new-' || id || '"]' END""", "'', '[]'"
    else:
        have, given, empty = f"CASE (id + {k}) % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'old-{c}-' || id END", f"CASE WHEN id % 2 = 1 OR (id + {k}) % 4 = 0 THEN '' ELSE 'new-{c}-' || id END", "''"
    lacks = f"({have}) IN ({empty})" + ("" if c in R.LISTS else f" OR ({have}) IS NULL")
    return f"CASE WHEN ({lacks}) AND ({given}) NOT IN ({empty}) THEN {given} ELSE {have} END AS {c}"


@query(f"SELECT id, {', '.join(_merged_sql(k, c) for k, c in enumerate([*R.TEXTS, *R.LISTS, *R.NUMBERS]))} FROM w_task")
def fill_empty_merge(spark, d):
    return R.fill_empty(*_profiles(spark, d))


@query("""WITH k AS (SELECT * FROM w_task WHERE id % 2 = 0), m AS (SELECT req_id, coalesce((SELECT min(id) FROM k WHERE k.content_md5 = r.content_md5), (SELECT min(id) FROM k WHERE k.source_resource_id = r.source_resource_id AND r.source_resource_id <> '')) AS task_id FROM w_request r),
    h AS (SELECT DISTINCT task_id FROM w_file WHERE task_id % 3 = 0)
    SELECT req_id, task_id, task_id IS NOT NULL AS is_existing, CASE WHEN task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM h) THEN (SELECT count(*) FROM w_file f WHERE f.task_id = req_id) ELSE 0 END AS backfilled FROM m""")
def task_upsert(spark, d):
    """Requests against the tasks of even ids, and the files that tasks without any get from them."""
    done = R.upsert(W.requests(spark, d), W.tasks(spark, d).where("id % 2 = 0"))
    f = W.files(spark, d)
    new = R.files_to_backfill(done, f.select(F.col("task_id").alias("req_id"), F.col("task_id").alias("of"), "path"), f.where("task_id % 3 = 0"))
    n = new.groupBy(F.col("of").alias("req_id"), "task_id").agg(F.count("*").alias("backfilled"))
    return done.join(n, ["req_id", "task_id"], "left").na.fill(0, ["backfilled"]).select("req_id", "task_id", "is_existing", "backfilled")


@query("""WITH k AS (SELECT source_resource_id AS s, max_by(resource_id, id) AS res FROM w_task WHERE id % 5 <> 3 GROUP BY source_resource_id)
    SELECT id, p.res AS parent_resource_id, concat_ws('|', a.res, b.res) AS children FROM w_task t LEFT JOIN k p ON p.s = parent_source
    LEFT JOIN k a ON a.s = CASE WHEN id % 10 = 0 THEN 'doc-' || (id + 4) END LEFT JOIN k b ON b.s = CASE WHEN id % 10 = 0 THEN 'doc-' || (id + 2) END""")
def relationship_backfill(spark, d):
    """Parents and children of tasks; every tenth has children, of which one is unknown, and some tasks have no resource id yet."""
    id_ = F.col("id")
    wanted = F.array(*(F.concat(F.lit("doc-"), x) for x in (id_ + 4, F.lit("none"), id_ + 2)))
    t = W.tasks(spark, d).select(
        "id", F.when(id_ % 5 != 3, F.col("resource_id")).otherwise("").alias("resource_id"), "source_resource_id", F.col("parent_source").alias("parent_source_resource_id"),
        F.when(id_ % 10 == 0, wanted).otherwise(F.array().cast("array<string>")).alias("child_source_resource_ids"))
    return R.relationships(t).select("id", "parent_resource_id", F.array_join("child_resource_ids", "|").alias("children"))


@query("""SELECT o.id, coalesce(f, '') AS files, coalesce(p, '') AS previews, coalesce(pv, '') AS prompt_version, main FROM w_order_task o LEFT JOIN (SELECT task_id, string_agg(path || ':' || size, '|' ORDER BY ord) AS f, string_agg(path, '|' ORDER BY ord) FILTER (WHERE format = 'png') AS p FROM w_file GROUP BY task_id) x ON o.id = x.task_id
    LEFT JOIN (SELECT task_id, max_by(prompt_version, id) AS pv, arg_max_null(main, id) AS main FROM w_desc GROUP BY task_id) y ON o.id = y.task_id""")
def entity_rebuild(spark, d):
    """Tasks with their files, previews (the pictures) and latest description."""
    f = W.files(spark, d).select("task_id", "ord", "path", "size")
    previews = W.files(spark, d).where("format = 'png'").select("task_id", F.col("ord").alias("id"), "path")
    whole = R.entities(W.order_tasks(spark, d).select("id"), f, previews, W.descriptions(spark, d))
    joined = lambda xs, x: F.array_join(F.transform(xs, x), "|")
    return whole.select(
        "id", joined("files", lambda x: F.concat_ws(":", x["path"], x["size"])).alias("files"), joined("previews", lambda x: x["path"]).alias("previews"),
        F.coalesce("description.prompt_version", F.lit("")).alias("prompt_version"), F.col("description.main").alias("main"))


_UPLOADS = """WITH u AS (SELECT task_id, ord, 'n' || (ord % 4) AS name, size, md5, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN 'short' WHEN l_partkey % 11 = 2 THEN md5(md5) ELSE arg_max(md5, ord) OVER (PARTITION BY task_id, ord % 4) END AS tag, l_partkey % 13 = 0 AS unknown FROM w_file),
    r AS (SELECT task_id, name, arg_max(CASE WHEN unknown THEN NULL ELSE md5 END, ord) FILTER (WHERE NOT unknown) AS known, arg_max(CASE WHEN unknown THEN '' ELSE md5 END, ord) AS last_md5 FROM u GROUP BY task_id, name),
    c AS (SELECT u.*, last_md5, last_md5 <> '' AND length(tag) = 32 AND tag <> last_md5 AS bad FROM u JOIN r USING (task_id, name)),
    m AS (SELECT *, coalesce(max(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ord), 0) AS stopped FROM c) """


def _uploads(spark, d):
    """Uploads of four names a task, their etags in quotes and with part suffixes, some null, short or wrong; some files are registered without a checksum."""
    f = W.files(spark, d).withColumn("name", F.concat(F.lit("n"), F.col("ord") % 4))
    k = F.col("l_partkey") % 11
    right = F.max_by("md5", "ord").over(Window.partitionBy("task_id", "name"))
    tag = F.when(k == 0, F.lit(None)).when(k == 1, "short").when(k == 2, F.md5("md5")).otherwise(right)
    etag = F.when(F.col("ord") % 2 == 0, F.concat(F.lit('"'), tag, F.lit('-1"'))).otherwise(tag)
    registered = f.select(F.col("task_id").alias("resource_id"), "ord", "name", F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.col("md5")).alias("md5"))
    return accepted_uploads(f.select(F.col("task_id").alias("resource_id"), "ord", "name", etag.alias("etag"), "size"), registered)


@query(_UPLOADS + "SELECT task_id AS resource_id, ord, name FROM m WHERE stopped = 0")
def upload_md5_check(spark, d):
    """The uploaded files that count: those in front of their batch's first mismatch."""
    return _uploads(spark, d)[0].select("resource_id", "ord", "name")


@query(_UPLOADS + """SELECT task_id AS resource_id, bool_and(NOT coalesce(bad, false)) AS success, coalesce(sum(CASE WHEN stopped = 0 THEN size END), 0)::BIGINT AS uploaded_bytes, count_if(stopped = 0)::BIGINT AS file_count,
    coalesce(arg_min('MD5 mismatch for ' || name || ': expected=' || last_md5 || ', actual=' || tag, ord) FILTER (WHERE bad), '') AS error_message FROM m GROUP BY task_id""")
def upload_batches(spark, d):
    """The answer to each task's batch of uploads."""
    return _uploads(spark, d)[1]


@query("SELECT user_id AS task_id, max_by(event_type, (ts, event_id)) AS event, max(ts) AS last_ts FROM events GROUP BY user_id")
def progress_last_wins(spark, d):
    e = W.table(spark, d, "events").select(F.col("user_id").alias("task_id"), "event_type", "ts", "event_id")
    return S.latest(e, "task_id", "ts", "event_id").select("task_id", F.col("event_type").alias("event"), F.col("ts").alias("last_ts"))


@query("SELECT user_id AS task_id, count(*) AS n, string_agg(event_type, '|' ORDER BY event_id) AS events FROM events GROUP BY user_id")
def process_log(spark, d):
    e = W.table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("task_id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), "|").alias("events"))


@query("""WITH v AS (SELECT o.id, d.n AS dn, f.p, CASE WHEN d.task_id IS NULL THEN 'skipped_no_description' WHEN f.task_id IS NULL THEN 'skipped_no_files' WHEN process_state = 'committed' OR o.id % 5 <> 0 THEN 'success' ELSE 'failed' END AS verdict FROM w_order_task o
    LEFT JOIN (SELECT task_id, count(*) AS n FROM w_desc GROUP BY task_id) d ON o.id = d.task_id LEFT JOIN (SELECT task_id, count(*) FILTER (WHERE format = 'png') AS p FROM w_file GROUP BY task_id) f ON o.id = f.task_id)
    SELECT count(*) FILTER (WHERE verdict = 'success') AS success, count(*) FILTER (WHERE verdict = 'failed') AS failed, count(*) FILTER (WHERE verdict LIKE 'skipped%') AS skipped, count(*) FILTER (WHERE verdict = 'skipped_no_files') AS skipped_no_files,
    count(*) FILTER (WHERE verdict = 'skipped_no_description') AS skipped_no_description, coalesce(sum(p), 0)::BIGINT AS previews, coalesce(sum(dn), 0)::BIGINT AS descriptions FROM v""")
def stage_summary(spark, d):
    """Totals of an upload of which every fifth fails."""
    count = lambda df, name: df.groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias(name))
    done = upload_eligibility(spark, d).withColumn("verdict", F.when(F.col("verdict") != "upload", F.col("verdict")).when(F.col("id") % 5 == 0, "failed").otherwise("success"))
    counted = done.join(count(W.descriptions(spark, d), "n_descriptions"), "id", "left").join(count(W.files(spark, d).where("format = 'png'"), "n_previews"), "id", "left")
    return S.upload_summary(counted)


@query("""SELECT o.id, CASE WHEN d.task_id IS NULL THEN 'skipped_no_description' WHEN f.task_id IS NULL THEN 'skipped_no_files' WHEN process_state = 'committed' THEN 'success' ELSE 'upload' END AS verdict FROM w_order_task o
    LEFT JOIN (SELECT DISTINCT task_id FROM w_desc) d ON o.id = d.task_id LEFT JOIN (SELECT DISTINCT task_id FROM w_file) f ON o.id = f.task_id""")
def upload_eligibility(spark, d):
    has = lambda x, n: x.select(F.col("task_id").alias("id")).distinct().withColumn(n, F.lit(True))
    t = W.order_tasks(spark, d).join(has(W.descriptions(spark, d), "d"), "id", "left").join(has(W.files(spark, d), "f"), "id", "left")
    return t.select("id", F.when(F.col("d").isNull(), "skipped_no_description").when(F.col("f").isNull(), "skipped_no_files").when(F.col("process_state") == "committed", "success").otherwise("upload").alias("verdict"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN '  ' ELSE event_type END AS id, CASE WHEN event_id % 9 = 0 THEN 3600 ELSE (floor(value)::BIGINT - 20) * 1000 END AS x, (floor(value)::BIGINT) * 100000 AS size FROM events)
    SELECT event_id, CASE WHEN trim(id) = '' OR x <= 0 OR x > 86400 THEN 'INVALID_REQUEST' ELSE '' END AS code, CASE WHEN trim(id) = '' THEN 'resource_id 不能为空' WHEN x <= 0 THEN 'expire_seconds 必须大于 0' WHEN x > 86400 THEN 'expire_seconds 不能超过 86400' ELSE '' END AS message,
    event_id % 2 = 0 AND size <= 5242880 AS inline FROM e""")
def download_validation(spark, d):
    """Checks of requests for downloads (every ninth keeps the default expiry), and whether the content comes with the answer."""
    e = W.table(spark, d, "events")
    expiry = F.coalesce(F.when(F.col("event_id") % 9 != 0, (F.floor("value") - 20) * 1000), F.lit(D.EXPIRES))
    error = D.request_error(F.when(F.col("event_type") == "view", "  ").otherwise(F.col("event_type")), expiry)
    text = lambda c: F.coalesce(error[c], F.lit("")).alias(c)
    return e.select("event_id", text("code"), text("message"), D.inline(F.floor("value") * 100000, F.col("event_id") % 2 == 0).alias("inline"))


@query(r"""WITH o AS (SELECT conv_id, conv_id % 5 = 4 AS bare, string_split(trim(output, E' \t\n\r'), chr(10)) AS l FROM w_output),
    p AS (SELECT conv_id, CASE WHEN bare THEN '' ELSE trim(regexp_replace(l[1], '^主体[：:]', '')) END AS m, CASE WHEN bare OR len(l) < 2 THEN '' ELSE trim(regexp_replace(l[2], '^细节[：:]', '')) END AS dt, l FROM o)
    SELECT conv_id, CASE WHEN m <> '' THEN m ELSE coalesce(l[1], '') END AS main, CASE WHEN dt <> '' THEN dt WHEN len(l) > 1 THEN l[2] WHEN m <> '' THEN m ELSE coalesce(l[1], '') END AS detail FROM p""")
def parse_output(spark, d):
    """Main and detail of each output, which comes as a message of parts from every other conversation."""
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("output").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))))
    said = W.outputs(spark, d).select("conv_id", X.message_text(F.when(F.col("conv_id") % 2 == 0, parts).otherwise(F.col("output"))).alias("output"))
    main, detail = X.parsed_output(F.col("output"))
    return said.select("conv_id", main.alias("main"), detail.alias("detail"))


_FORMAT = """CASE WHEN len(string_split(trim(output, E' \\t\\n\\r'), chr(10))) <> 2 THEN 'FORMAT_ERROR|期望2行，实际' || len(string_split(trim(output, E' \\t\\n\\r'), chr(10))) || '行'
    WHEN NOT starts_with(trim(output, E' \\t\\n\\r'), '主体：') THEN 'FORMAT_ERROR|第一行必须以''主体：''开头' WHEN NOT contains(trim(output, E' \\t\\n\\r'), chr(10) || '细节：') THEN 'FORMAT_ERROR|第二行必须以''细节：''开头' END"""
_LENGTH = "CASE WHEN n < 100 THEN 'TOO_SHORT|描述字数 ' || n || ' 不足最低 100' WHEN n > 220 THEN 'TOO_LONG|描述字数 ' || n || ' 超过上限 220' END"
_CHECKED = "(SELECT *, length(replace(replace(replace(output, '主体：', ''), '细节：', ''), chr(10), '')) AS n FROM w_output)"


def _told(spark, d, error):
    """code and message of an error of each output; empty where it has none."""
    text = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    return W.outputs(spark, d).select("conv_id", error.alias("e")).select("conv_id", text("code"), text("message"))


def _told_sql(error):
    return f"SELECT conv_id, split_part(e, '|', 1) AS code, split_part(e, '|', 2) AS message FROM (SELECT conv_id, coalesce({error}, '') AS e FROM {_CHECKED})"


@query(_told_sql(_FORMAT))
def check_format(spark, d):
    return _told(spark, d, X.format_error(F.col("output")))


@query(_told_sql(_LENGTH))
def check_length(spark, d):
    return _told(spark, d, X.length_error(F.col("output")))


@query(_told_sql("""CASE WHEN conv_id % 2 = 0 AND NOT (contains(output, '音频') OR contains(output, 'audio') OR contains(output, '音乐') OR contains(output, '声音') OR contains(output, 'sound'))
    THEN 'MISSING_KEYWORD|描述中缺少资源类型关键词，期望包含 [''音频'', ''audio'', ''音乐'', ''声音'', ''sound''] 之一' END"""))
def check_keywords(spark, d):
    kind = F.when(F.col("conv_id") % 2 == 0, "audio").otherwise("other")
    return _told(spark, d, X.keyword_error(F.col("output"), kind))


@query(_told_sql(f"""coalesce({_FORMAT}, {_LENGTH}, CASE WHEN NOT regexp_matches(output, '字体|font|笔刷|brush') THEN 'MISSING_KEYWORD|描述中缺少资源类型关键词，期望包含 [''字体'', ''font'', ''笔刷'', ''brush''] 之一' END)"""))
def validate_description(spark, d):
    return _told(spark, d, X.description_error(F.col("output"), F.lit("font")))


@query(f"""WITH c AS (SELECT conv_id, unnest(['format', 'length', 'keywords', 'all']) AS category, conv_id % 7 = 6 AS pending, unnest([{_FORMAT} IS NULL, {_LENGTH} IS NULL, regexp_matches(output, '字体|font|笔刷|brush'), {_FORMAT} IS NULL AND {_LENGTH} IS NULL AND regexp_matches(output, '字体|font|笔刷|brush')]) AS passed FROM {_CHECKED})
    SELECT category, count(*) AS total, count(*) FILTER (WHERE NOT pending AND passed) AS passed, count(*) FILTER (WHERE NOT pending AND NOT passed) AS failed, count(*) FILTER (WHERE pending) AS pending,
    round(count(*) FILTER (WHERE NOT pending AND passed) / nullif(count(*) FILTER (WHERE NOT pending), 0), 6) AS pass_rate FROM c GROUP BY category""")
def scorecard(spark, d):
    """Outcomes of the checks by category; every seventh output is still pending and counts for no rate."""
    text, pending = F.col("output"), F.col("conv_id") % 7 == 6
    checks = {"format": X.format_error(text), "length": X.length_error(text), "keywords": X.keyword_error(text, F.lit("font")), "all": X.description_error(text, F.lit("font"))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.when(~pending, e.isNull()).alias("passed")) for k, e in checks.items())))
    return S.scorecard(W.outputs(spark, d).select(each.alias("c")).select("c.*"), "category", "passed")


@query(r"""SELECT doc_id, c AS cleaned, CASE WHEN c = '' OR c IS NULL THEN 'Embedding input text is empty after cleaning' ELSE '' END AS error FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS c FROM documents)""")
def clean_text(spark, d):
    """Texts as they go to the embedding; a text of white space alone is an error."""
    own = W.table(spark, d, "documents").select("doc_id", X.cleaned(F.col("text")).alias("c"), "text")
    return own.select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce("c", F.lit(""))).alias("cleaned"), F.when(F.col("c").isNull(), "Embedding input text is empty after cleaning").otherwise("").alias("error"))


@query("""SELECT id, concat_ws(chr(10), '资源类型: ' || resource_type, CASE WHEN id % 4 <> 0 THEN 'LLM输入模态: image' END, CASE WHEN title <> '' THEN '资源标题: ' || title END, CASE WHEN id % 3 <> 0 THEN '资源包: pack-' || (id % 3) END, '资源路径: res-' || id || '/main.png',
    CASE WHEN source <> '' THEN '来源站点: ' || source END, CASE WHEN id % 2 = 0 THEN '来源标签: ' || CASE WHEN source <> '' THEN source || ', ' ELSE '' END || 'tag' END, CASE WHEN retry_count > 0 THEN '成员文件数: ' || retry_count END, CASE WHEN id % 2 = 1 THEN '文件格式分布: png, fbx' END,
    '预览策略: static', CASE WHEN id % 3 = 0 THEN '预览模式: direct' END, CASE WHEN id % 3 = 1 THEN '预览置信度: high' END, CASE WHEN id % 8 <> 0 THEN '缺失文件比例: ' || CASE id % 8 WHEN 2 THEN '0.25' WHEN 4 THEN '0.50' WHEN 6 THEN '0.75' WHEN 1 THEN '0.12' WHEN 3 THEN '0.38' WHEN 5 THEN '0.62' ELSE '0.88' END END,
    CASE WHEN id % 2 = 0 THEN 'state: ' || process_state END) AS context FROM w_task WHERE resource_type IS NOT NULL""")
def prompt_context(spark, d):
    """The context of each task, with fields that some of them lack."""
    i, none = F.col("id"), F.lit("")
    some = lambda c, x: F.when(c, x).otherwise(none)
    listed_ = lambda c, *xs: F.when(c, F.array(*xs)).otherwise(F.array().cast("array<string>"))
    ratio = F.element_at(F.array(*(F.lit(x) for x in (0.0, 0.12, 0.25, 0.38, 0.5, 0.62, 0.75, 0.88))), (i % 8 + 1).cast("int"))
    fields = {
        "resource_type": F.col("resource_type"), "llm_input_type": some(i % 4 != 0, F.lit("image")), "title": F.col("title"), "pack_name": some(i % 3 != 0, F.concat(F.lit("pack-"), i % 3)),
        "resource_path": F.concat(F.lit("res-"), i, F.lit("/main.png")), "source": F.col("source"), "category": none, "source_tags": listed_(i % 2 == 0, F.col("source"), none, F.lit("tag")), "source_description": none,
        "member_count": F.col("retry_count"), "asset_formats": listed_(i % 2 == 1, F.lit("png"), F.lit("fbx")), "preview_strategy": F.lit("static"), "preview_mode": some(i % 3 == 0, F.lit("direct")),
        "preview_confidence": some(i % 3 == 1, F.lit("high")), "missing_file_ratio": ratio,
    }
    more = F.create_map(F.lit("state"), some(i % 2 == 0, F.col("process_state")), F.lit("note"), none)
    return W.tasks(spark, d).where("resource_type is not null").select("id", X.prompt_context(fields, more).alias("context"))


@query("SELECT doc_id, round(list_sum(list_transform(range(64), lambda i: ((('0x' || substr(md5(text), 1, 8))::BIGINT + i) % 1000) / 1000.0)), 6) AS total FROM documents")
def template_embedding(spark, d):
    vector = X.template_embedding(F.col("text"), 64)
    return W.table(spark, d, "documents").select("doc_id", F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, vec_id % 10 <> 0 AS ok FROM embeddings")
def dimension_check(spark, d):
    cut = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return W.table(spark, d, "embeddings").select("vec_id", (F.size(cut) == 64).alias("ok"))


_TOP = """WITH v AS (SELECT *, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), q AS (SELECT vec_id AS query_id, x AS v, label AS own FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id AS resource_id, label, own, round(list_cosine_similarity(v, x), 6) AS score FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id)::INT AS rank FROM s)"""


def _vectors(spark, d):
    """Stored vectors, and those whose id is divisible by 100 as queries."""
    e = usable(W.table(spark, d, "embeddings").select(F.col("vec_id").alias("resource_id"), F.col("embedding").alias("vector"), F.col("label").alias("kind")))
    return e, e.where("resource_id % 100 = 0").select(F.col("resource_id").alias("query_id"), "vector", "kind")


def _hits(spark, d, k):
    vectors, asked = (x.drop("kind") for x in _vectors(spark, d))
    return top_k(vectors, asked, k)


@query(_TOP + """, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resource_id)::INT AS place FROM s WHERE query_id % 200 <> 0 OR label = own)
    SELECT query_id, place AS rank, resource_id, score FROM t WHERE place <= 10 AND score >= 0.1""")
def cosine_top_k(spark, d):
    """Top ten of 0.1 or more; every other query asks for resources of its own kind alone."""
    vectors, asked = _vectors(spark, d)
    asked = asked.withColumn("kind", F.when(F.col("query_id") % 200 == 0, F.col("kind")))
    return top_k(vectors, asked, 10, 0.1).select("query_id", "rank", "resource_id", "score")


@query(_TOP + """, f AS (SELECT task_id, count(*) AS n, sum(size)::BIGINT AS total, min_by(format, ord) AS fmt, min_by(path, ord) AS p FROM w_file GROUP BY task_id),
    i AS (SELECT task_id, min_by(split_part(path, '/', -1), ord) AS first_name, list(split_part(path, '/', -1) ORDER BY ord) AS names FROM w_file WHERE format = 'png' GROUP BY task_id),
    x AS (SELECT task_id, arg_max_null(main, id) AS main FROM w_desc GROUP BY task_id)
    SELECT query_id, rank, 'res-' || t.id AS resource_id, score, t.title AS title, t.process_state AS status, coalesce(main, '') AS description, coalesce(n, 0) AS file_count, coalesce(total, 0)::BIGINT AS file_size, coalesce(fmt, '') AS file_format,
    coalesce('previews/res-' || t.id || '/' || i.first_name, '') AS primary_preview, coalesce(array_to_string(list_transform(i.names[2:], lambda y: 'previews/res-' || t.id || '/' || y), '|'), '') AS other_previews,
    CASE WHEN t.id % 5 = 0 THEN 'packs/' || t.id || '.zip' ELSE coalesce('files/res-' || t.id || '/' || split_part(p, '/', -1), '') END AS download_key,
    coalesce(u.title, '') AS parent_title, coalesce('previews/res-' || u.id || '/' || j.first_name, '') AS parent_preview
    FROM r JOIN w_task t ON r.resource_id = t.id LEFT JOIN f ON t.id = f.task_id LEFT JOIN i ON t.id = i.task_id LEFT JOIN x ON t.id = x.task_id
    LEFT JOIN w_task u ON t.id % 10 <> 0 AND u.id = t.id - t.id % 10 LEFT JOIN i j ON u.id = j.task_id WHERE rank <= 10""")
def search_enrich(spark, d):
    """Top ten of each query with description, files, previews and the parent's title and preview; some tasks have a package to download."""
    id_ = F.col("id")
    tasks = W.tasks(spark, d).select(
        "id", "resource_id", "process_state", "title", "source_resource_id", F.when(id_ % 10 != 0, F.concat(F.lit("res-"), id_ - id_ % 10)).alias("parent_resource_id"),
        F.when(id_ % 5 == 0, F.concat(F.lit("packs/"), "id", F.lit(".zip"))).otherwise("").alias("download_key"))
    f = W.files(spark, d)
    hits = _hits(spark, d, 10).withColumn("resource_id", F.concat(F.lit("res-"), "resource_id"))
    found = enrich(hits, tasks, W.descriptions(spark, d), f, f.where("format = 'png'").select("task_id", F.col("ord").alias("id"), "path"))
    shown = "query_id rank resource_id score title status description file_count file_size file_format primary_preview other_previews download_key parent_title parent_preview"
    return found.withColumn("other_previews", F.array_join("other_previews", "|")).select(*shown.split())


@query(_TOP + """, w AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM r WHERE rank <= 30 AND resource_id IN (SELECT task_id FROM w_file WHERE format = 'fbx'))
    SELECT query_id, place, resource_id, score FROM w WHERE place <= 10""")
def format_filtered_search(spark, d):
    wanted = W.files(spark, d).where("format = 'fbx'").select(F.col("task_id").alias("resource_id"))
    kept = _hits(spark, d, 30).join(wanted, "resource_id", "left_semi")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 10").select("query_id", "place", "resource_id", "score")


@query("""WITH e AS (SELECT event_type, event_id, value, CASE event_id % 5 WHEN 0 THEN ' .PNG' WHEN 1 THEN 'png ' WHEN 2 THEN 'jpg' WHEN 3 THEN '' END AS format, 'q' || (user_id % 10) AS query_id FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, event_id)::INT AS rank FROM e WHERE value >= 0.5 AND event_type IN ('purchase', 'signup') AND ltrim(lower(trim(coalesce(format, ''))), '.') IN ('png', 'jpeg'))
    SELECT query_id, rank, event_id, value FROM s WHERE rank <= 20""")
def rank_scored_rows(spark, d):
    """The twenty best scored rows of each query of two types and two formats, of 0.5 or more; the types and formats asked for are given in several spellings."""
    k = F.col("event_id") % 5
    fmt = F.when(k == 0, " .PNG").when(k == 1, "png ").when(k == 2, "jpg").when(k == 3, "")
    rows = W.table(spark, d, "events").select("event_id", "event_type", "value", fmt.alias("format"), F.concat(F.lit("q"), F.col("user_id") % 10).alias("query_id"))
    return ranked(rows, "query_id", "value", 20, 0.5, F.col("event_id"), kind=("event_type", ["purchase", "signup"]), formats=("format", ["png", " .JPEG", "", None])).select("query_id", "rank", "event_id", "value")

