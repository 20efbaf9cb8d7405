"""Joins, per-key selection and decisions over task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.expressions import state_ordinal, stripped
from assetflow.states import CONTINUED, FAILED, REUSABLE


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row whose ordering columns are greatest: a partial aggregation, no sort of a key's rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def first_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def rollup(tasks: DataFrame, files: DataFrame, descriptions: DataFrame, previews: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Each task's children: id, file_count, total_size, formats (array, sorted), preview_count, has_description, has_embedding.

    All are aggregated by task_id before they are joined, so no task's children meet those of another kind.
    """
    held = files.groupBy("task_id").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"), F.array_sort(F.collect_set("format")).alias("formats"))
    shown = previews.groupBy("task_id").agg(F.count("*").alias("preview_count"))
    has = lambda df, name: df.select("task_id").distinct().withColumn(name, F.lit(True))
    out = tasks.select("id")
    for part in (held, shown, has(descriptions, "has_description"), has(embeddings, "has_embedding")):
        out = out.join(part.withColumnRenamed("task_id", "__task"), F.col("id") == F.col("__task"), "left").drop("__task")
    out = out.na.fill(0, ["file_count", "total_size", "preview_count"]).na.fill(False, ["has_description", "has_embedding"])
    return out.withColumn("formats", F.coalesce("formats", F.array().cast("array<string>")))


def stats(tasks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts: kind (state, total or vectors), name (the state, else empty), n."""
    states = tasks.groupBy(F.coalesce("process_state", F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("state").alias("kind"), "name", "n")
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("name"), "n")
    return states.unionByName(one(tasks, "total")).unionByName(one(vectors, "vectors"))


def upload_summary(results: DataFrame) -> DataFrame:
    """One row of totals over the resources of a stage (verdict, n_previews, n_descriptions): success, failed, skipped, skipped_no_files, skipped_no_description, previews, descriptions."""
    n = lambda *verdicts: F.count_if(F.col("verdict").isin(*verdicts))
    names = {"success": ["success"], "failed": ["failed"], "skipped": ["skipped", "skipped_no_files", "skipped_no_description"], "skipped_no_files": ["skipped_no_files"], "skipped_no_description": ["skipped_no_description"]}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return results.agg(*(n(*v).alias(k) for k, v in names.items()), total("n_previews").alias("previews"), total("n_descriptions").alias("descriptions"))


def reset_committed(tasks: DataFrame) -> DataFrame:
    """The tasks with what was committed put back to description_ready, its last error cleared; others as they are."""
    again = F.col("process_state") == "committed"
    cleared = lambda c: F.when(F.coalesce(again, F.lit(False)), F.lit(None)).otherwise(F.col(c))
    return tasks.withColumns({c: cleared(c) for c in ("last_error_code", "last_error_message")} | {"process_state": F.when(again, "description_ready").otherwise(F.col("process_state"))})


def dedup_decision(requests: DataFrame, tasks: DataFrame, descriptions: DataFrame, embeddings: DataFrame, prompt: str, model: str) -> DataFrame:
    """What to do with a request, by the latest task of equal content: req_id, decision, existing_task_id, reason.

    new without such a task.  A reusable task whose latest description has another prompt version is
    rerun_description, else one whose latest embedding has another model version rerun_embedding, else
    reuse_all; one that failed or stands in between is resume.  Any other state is new.
    tasks: content_md5, id, process_state; descriptions: task_id, id, prompt_version; embeddings: task_id,
    id, model_version.  A request without content_md5 matches nothing.
    """
    newest = latest(tasks.select("content_md5", "id", "process_state"), "content_md5", "id")
    described = latest(descriptions.select("task_id", "id", "prompt_version"), "task_id", "id").select(F.col("task_id").alias("d_task"), "prompt_version")
    embedded = latest(embeddings.select("task_id", "id", "model_version"), "task_id", "id").select(F.col("task_id").alias("e_task"), "model_version")
    joined = requests.join(newest, "content_md5", "left").join(described, F.col("id") == F.col("d_task"), "left").join(embedded, F.col("id") == F.col("e_task"), "left")
    state = F.col("process_state")
    decision = (
        F.when(state.isNull(), "new")
        .when(state.isin(REUSABLE) & (F.col("prompt_version") != prompt), "rerun_description")
        .when(state.isin(REUSABLE) & (F.col("model_version") != model), "rerun_embedding")
        .when(state.isin(REUSABLE), "reuse_all").when(state.isin(CONTINUED), "resume").otherwise("new")
    )
    # The reasons told with a decision.
    reason = (
        F.when(state.isNull(), "未找到已有记录").when(F.col("decision") == "rerun_description", "prompt_version 已变更").when(F.col("decision") == "rerun_embedding", "embedding_model_version 已变更")
        .when(F.col("decision") == "reuse_all", "资源已完成且配置一致").when(F.col("decision") == "resume", F.concat(F.lit("任务处于 "), state, F.lit(" 状态，可从断点继续")))
        .otherwise(F.concat(F.lit("未知状态 "), state, F.lit("，创建新任务")))
    )
    decided = joined.withColumn("decision", decision)
    return decided.select("req_id", "decision", F.when(F.col("decision") != "new", F.col("id")).alias("existing_task_id"), reason.alias("reason"))


def registration_match(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """The task that each request means: req_id, tier, task_id; tier 0 where it is none.

    Tiers: 1 the same source id and source, 2 the same source id, 3 the same idempotency key, 4 the same
    content and committed; the newest task of a tier (updated_at, then id).  Blank source ids, keys
    and checksums match nothing.
    """
    r = requests.select("req_id", stripped(F.col("source_resource_id")).alias("sid"), F.col("source").alias("src"), F.col("idempotency_key").alias("idem"), F.col("content_md5").alias("md5"))
    t = tasks.select("id", "source_resource_id", "source", "idempotency_key", "content_md5", "process_state", "updated_at")
    by_id = r.where("sid <> ''").join(t, F.col("sid") == F.col("source_resource_id")).withColumn("tier", F.when((F.col("src") != "") & (F.col("src") == F.col("source")), 1).otherwise(2))
    by_key = r.where("idem <> ''").join(t, F.col("idem") == F.col("idempotency_key")).withColumn("tier", F.lit(3))
    by_md5 = r.where("md5 <> ''").join(t.where("process_state = 'committed'"), F.col("md5") == F.col("content_md5")).withColumn("tier", F.lit(4))
    newest = F.struct("tier", -F.unix_micros(F.col("updated_at").cast("timestamp")), -F.col("id"))
    best = by_id.unionByName(by_key).unionByName(by_md5).groupBy("req_id").agg(F.min_by(F.struct("tier", "id"), newest).alias("m"))
    return requests.select("req_id").join(best, "req_id", "left").select("req_id", F.coalesce("m.tier", F.lit(0)).alias("tier"), F.col("m.id").alias("task_id"))


def stage_plan(tasks: DataFrame, resume: bool = True) -> DataFrame:
    """For every task and stage: process, skip_done, skip_not_ready or skip_audio (id, stage, decision).

    With resume, previews and descriptions that are there are skipped; without it they are made again.
    Descriptions need a preview and no audio file; an upload needs a description and always skips what is
    committed.  A task without a known state counts as not begun.
    """
    at = state_ordinal(F.col("process_state"))
    done = lambda n: F.lit(resume) & (at >= n)
    preview = F.when(done(2), "skip_done").otherwise("process")
    describe = F.when(done(4), "skip_done").when(at < 2, "skip_not_ready").when(F.col("resource_type") == "audio_file", "skip_audio").otherwise("process")
    upload = F.when(at >= 10, "skip_done").when(at < 4, "skip_not_ready").otherwise("process")
    stages = F.array(*(F.struct(F.lit(n).alias("stage"), x.alias("decision")) for n, x in (("preview", preview), ("description", describe), ("upload", upload))))
    return tasks.select("id", F.explode(stages).alias("s")).select("id", "s.*")


def scorecard(checks: DataFrame, category: str, passed: str) -> DataFrame:
    """Per category: total, passed, failed, pending (passed is null) and pass_rate of what was evaluated (6 decimals; 0 without any)."""
    done = F.count(passed)
    return checks.groupBy(category).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(passed, F.lit(False))).alias("passed"), F.count_if(~F.col(passed)).alias("failed"), F.count_if(F.col(passed).isNull()).alias("pending"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.coalesce(passed, F.lit(False))), done), 6), F.lit(0.0)).alias("pass_rate"))


def retry_candidates(tasks: DataFrame, most: int) -> DataFrame:
    return tasks.where(F.col("process_state").isin(FAILED) & (F.col("retry_count") < most))


def apply_outcomes(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tasks after the outcomes (id, outcome, message) of their uploads, with the events to log.

    A success ends committed, one that already existed synced; a failure keeps the state, adds a retry
    and keeps 500 characters of the message.  Tasks without an outcome stay as they are.
    """
    # States that a success passes, by outcome.
    chains = {"uploaded": "registered|uploaded|committed", "exists": "registered|synced", "failed": "upload_failed"}
    log = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in chains.items() for x in kv)), F.col("outcome")), F.lit(""))
    failed = F.coalesce(F.col("outcome") == "failed", F.lit(False))
    state = F.when(F.col("outcome").isin("uploaded", "exists"), F.substring_index(log, "|", -1)).otherwise(F.col("process_state"))
    return tasks.join(outcomes, "id", "left").select(
        "id", state.alias("process_state"), (F.col("retry_count") + failed.cast("int")).alias("retry_count"), F.when(failed, F.substring("message", 1, 500)).otherwise("").alias("error"), log.alias("log"))


def apply_stage(tasks: DataFrame, results: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, log rows) after a stage, preview, description or embedding, whose results are id and message (null for a success).

    A success moves a task to <stage>_ready and clears its last error; a failure to <stage>_failed with the
    stage's code and 500 characters of the message.  The log has a row (task_id, event, detail) for each result.
    Tasks without a result stay as they are.
    """
    # The stages' error codes.
    code = {"preview": "preview_error", "description": "desc_error", "embedding": "embedding_error"}[stage]
    told = results.select(F.col("id").alias("__id"), F.lit(True).alias("__ran"), F.substring("message", 1, 500).alias("__message"))
    ran, failed = F.coalesce("__ran", F.lit(False)), F.col("__message").isNotNull()
    state = F.when(failed, f"{stage}_failed").otherwise(f"{stage}_ready")
    keep = lambda new, c: F.when(ran, new).otherwise(F.col(c))
    out = tasks.join(told, F.col("id") == F.col("__id"), "left").withColumns({
        "process_state": keep(state, "process_state"), "last_error_code": keep(F.when(failed, code).otherwise(""), "last_error_code"),
        "last_error_message": keep(F.when(failed, F.col("__message")).otherwise(""), "last_error_message")})
    log = told.select(F.col("__id").alias("task_id"), state.alias("event"), F.coalesce("__message", F.lit("")).alias("detail"))
    return out.drop("__id", "__ran", "__message"), log
