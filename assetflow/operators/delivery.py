"""Handing resources over: records to register, packages, commits with the rows that follow, downloads, vectors made anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.functions.expressions import file_name, relative, stripped

from .memo import answered
from .providers import vector_checksum
from .selection import latest

# Seconds that a link holds by default and at most, bytes that may be sent inline.
EXPIRES, MOST_EXPIRES, INLINE = 3600, 86400, 5 * 1024 * 1024


def request_error(resource_id: Column, expire_seconds: Column) -> Column:
    """code and message of a request for a download that isn't valid; null for one that is."""
    # The code and the messages.
    error = lambda message: F.struct(F.lit("INVALID_REQUEST").alias("code"), F.lit(message).alias("message"))
    return (
        F.when(F.coalesce(stripped(resource_id), F.lit("")) == "", error("resource_id 不能为空"))
        .when(expire_seconds <= 0, error("expire_seconds 必须大于 0")).when(expire_seconds > MOST_EXPIRES, error(f"expire_seconds 不能超过 {MOST_EXPIRES}"))
    )


def inline(file_size: Column, asked: Column) -> Column:
    """Whether a download's content is sent with the answer: only when asked for, and up to INLINE bytes."""
    return asked & (file_size <= INLINE)


def download_links(requests: DataFrame, tasks: DataFrame, files: DataFrame, now: Column | None = None) -> DataFrame:
    """What each request gets: its columns and error_code, error_message, key, file_name, file_size, content_type, expires_at.

    requests: resource_id, expire_seconds (null for the default); tasks: resource_id, id, title, download_key,
    download_name, download_size, download_type; files: task_id, ord, is_primary, path, size, key.  The packaged object
    comes first, then the primary file (flagged, else the first), then the resource's folder.  An invalid or
    unknown request has an error and no file.
    """
    given = requests.withColumns({"__expires": F.coalesce("expire_seconds", F.lit(EXPIRES))}).withColumn("__error", request_error(F.col("resource_id"), F.col("__expires")))
    t = tasks.select(F.col("resource_id").alias("__rid"), "id", "title", "download_key", "download_name", "download_size", "download_type")
    first = files.groupBy("task_id").agg(F.min_by(F.struct("path", "size", "key"), F.struct(~F.coalesce("is_primary", F.lit(False)), "ord")).alias("file"))
    found = given.join(t, F.when(F.col("__error").isNull(), F.col("resource_id")) == F.col("__rid"), "left").join(first, F.col("id") == F.col("task_id"), "left")
    known, packed, name = F.col("id").isNotNull(), F.coalesce("download_key", F.lit("")) != "", file_name(F.col("file.path"))
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    folder = F.concat_ws("/", F.lit("files"), "resource_id", F.lit(""))
    pick = lambda one, two, three, none: F.when(~known, none).when(packed, one).when(F.col("file").isNotNull(), two).otherwise(three)
    until = F.coalesce(now, F.current_timestamp()) if now is not None else F.current_timestamp()
    expires = F.date_format(F.timestamp_seconds(F.unix_timestamp(until) + F.col("__expires")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return found.select(
        *requests.columns,
        F.coalesce("__error.code", F.when(~known, "RESOURCE_NOT_FOUND"), F.lit("")).alias("error_code"), F.coalesce("__error.message", F.when(~known, "resource not found"), F.lit("")).alias("error_message"),
        pick(F.col("download_key"), filled("file.key", F.concat(folder, name)), folder, F.lit("")).alias("key"),
        pick(filled("download_name", F.lit("resource")), name, filled("title", F.lit("resource")), F.lit("")).alias("file_name"),
        pick(F.col("download_size"), F.col("file.size"), F.lit(0), F.lit(0)).cast("bigint").alias("file_size"),
        F.when(known, filled("download_type", F.lit("application/octet-stream"))).otherwise("").alias("content_type"), F.when(known, expires).otherwise("").alias("expires_at"))


def agent_answers(links: DataFrame, *keys: str) -> DataFrame:
    """keys and what an agent is told of each of download_links(): a link, when it expires, name and size, or the error alone."""
    fine = F.col("error_code") == ""
    told = lambda c, name, none="": F.when(fine, F.col(c)).otherwise(F.lit(none)).alias(name)
    return links.select(*keys, told("key", "download_url"), told("expires_at", "expires_at"), told("file_name", "file_name"), told("file_size", "file_size", 0), "error_code", "error_message")


def package_members(resources: DataFrame, files: DataFrame) -> DataFrame:
    """Members of the archives that resources are handed over in: task_id, ord, archive, member.

    resources: id, title, resource_type, download_name, root, and where they have them resource_path, source_resource_id
    and content_md5, which stand in for an empty title; files: task_id, ord, path, found.  Packs and resources of
    several files are packed; only files that are found become members, with their path as seen from root (with ..
    where they lie outside), or their name without a root.  Names that occur again get _1, _2, ... in front of
    the extension.  An archive without members is left out.
    """
    n = files.groupBy("task_id").agg(F.count("*").alias("__n"))
    packed = resources.join(n, F.col("id") == F.col("task_id")).where((F.col("resource_type") == "pack") | (F.col("__n") > 1)).drop("task_id", "__n")
    titles = ["title", *(c for c in ("resource_path", "source_resource_id") if c in resources.columns)]
    title = F.coalesce(*(F.nullif(c, F.lit("")) for c in titles), *([F.substring("content_md5", 1, 12)] if "content_md5" in resources.columns else []))
    safe = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", ""), F.lit("")), F.lit("resource"))
    name = F.coalesce(F.nullif("download_name", F.lit("")), F.concat(safe, F.lit(".zip")))
    archive = F.when(F.lower(name).endswith(".zip"), name).otherwise(F.concat(name, F.lit(".zip")))
    own = packed.withColumn("archive", archive).join(files.where("found"), F.col("id") == F.col("task_id"))
    base = F.when(F.length("root") > 0, relative(F.col("path"), F.col("root"))).otherwise(file_name(F.col("path")))
    again = F.row_number().over(Window.partitionBy("task_id", "__base").orderBy("ord")) - 1
    split = lambda part: F.regexp_extract("__base", r"^(.*?[^/.][^/]*?|.*?)(\.[^/.]*)?$", part)
    member = F.when(again == 0, F.col("__base")).otherwise(F.concat(split(1), F.lit("_"), again, split(2)))
    return own.withColumn("__base", base).select("task_id", "ord", "archive", member.alias("member"))


def register_records(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """The tasks that have files, as records to register: the tasks' columns, files (array of structs in order), total_size, download_name, download_type.

    files: task_id, ord, name, size, format, md5, role, is_primary.  One file is handed over as it is, several (or a pack) as an archive.
    """
    item = F.struct("ord", "name", "size", "format", "md5", F.coalesce("role", F.lit("main")).alias("role"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"))
    by = files.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("files"), F.sum("size").alias("total_size"))
    joined = tasks.join(by, F.col("id") == F.col("task_id")).drop("task_id")
    archive = (F.col("resource_type") == "pack") | (F.size("files") > 1)
    bare = F.transform("files", lambda f: f.dropFields("ord"))
    return joined.withColumns({
        "download_type": F.when(F.coalesce(archive, F.lit(False)), "application/zip").otherwise("application/octet-stream"),
        "download_name": F.when(F.coalesce(archive, F.lit(False)), F.lit(None).cast("string")).otherwise(F.get("files", F.lit(0))["name"]), "files": bare})


def upgraded(records: DataFrame) -> DataFrame:
    """Records of the older form in the present one: files from the single source_ columns, previews from the single preview.

    What a record holds as arrays already wins; an older record without a path has no file.
    """
    file = F.struct(F.col("source_path").alias("path"), F.col("source_name").alias("name"), F.col("source_size").alias("size"), F.col("source_format").alias("format"), F.col("content_md5").alias("md5"), F.lit(True).alias("is_primary"))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    kind = {c: records.schema[c].dataType.simpleString() for c in ("files", "previews")}
    none = lambda c: F.array().cast(kind[c])
    files = F.when(~empty("files"), F.col("files")).when(F.col("source_path") != "", F.array(file).cast(kind["files"])).otherwise(none("files"))
    previews = F.when(~empty("previews"), F.col("previews")).when(F.col("preview").isNotNull(), F.array("preview").cast(kind["previews"])).otherwise(none("previews"))
    return records.withColumns({"files": files, "previews": previews}).drop("source_path", "source_name", "source_size", "source_format", "preview")


def commit(requests: DataFrame, tasks: DataFrame, providers: list[str], dimension: int, model: str, options: dict | None = None, retries: int = 2, folder: str | None = None) -> dict[str, DataFrame]:
    """Commits requests (resource_id, description_main, description_detail, description_full) for tasks (resource_id, id, process_state, resource_type).

    answers: resource_id, state, error.  Unknown resources, blank main descriptions, vectors that fail or have
    another dimension are failed; what is committed already stays so.  For those that are committed now:
    descriptions, embeddings, vectors, states and logs, the rows of each table that follow.  Only the main
    description is embedded, and only where it is needed: each distinct text once, however many of the tables are
    used, and not again where the folder has its vector (memo.answered).
    """
    both = requests.join(tasks, "resource_id", "left").withColumn("__text", F.coalesce(stripped(F.col("description_main")), F.lit("")))
    wanted = F.col("id").isNotNull() & (F.coalesce("process_state", F.lit("")) != "committed") & (F.col("__text") != "")
    embedded = answered(both.where(wanted), "__text", providers, "array<double>", options, retries, folder, model)
    size = F.size("result")
    # The errors told.
    made = embedded.withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("embedding failed: "), "error")).when(size != dimension, F.concat(F.lit(f"dimension mismatch: expected {dimension}, got "), size)).otherwise(""))
    rest = both.where(~F.coalesce(wanted, F.lit(False)))
    told = F.when(F.col("id").isNull(), "resource not found").when(F.col("process_state") == "committed", "").otherwise("description_main is required for embedding generation")
    state = lambda df: df.select("resource_id", F.when(F.col("error") == "", "committed").otherwise("failed").alias("state"), "error")
    done = made.where("error = ''")
    return {
        "answers": state(rest.withColumn("error", told)).unionByName(state(made)),
        "descriptions": done.select(F.col("id").alias("task_id"), F.col("description_main").alias("main"), F.col("description_detail").alias("detail"), F.col("description_full").alias("full"), F.lit("").alias("prompt_version")),
        "embeddings": done.select(F.col("id").alias("task_id"), F.lit(dimension).alias("dimension"), F.lit(model).alias("model_version")),
        "vectors": done.select("resource_id", F.col("result").alias("vector"), "resource_type"),
        "states": done.select("id", F.lit("committed").alias("process_state")),
        "logs": done.select(F.col("id").alias("task_id"), F.lit("committed").alias("event"), F.lit("description + embedding saved").alias("detail")),
    }


def reembedded(tasks: DataFrame, descriptions: DataFrame, providers: list[str], dimension: int, options: dict | None = None, retries: int = 2, limit: int | None = None, folder: str | None = None) -> DataFrame:
    """Vectors of the latest main description of each committed task with a resource id: id, resource_id, resource_type, outcome, vector, checksum.

    outcome is ok, failed (the provider's error or another dimension) or skipped (no description or a blank one); only
    ok ones have a vector.  With a limit the tasks of smallest id.  Equal texts are embedded once, and not again where
    the folder has their vector.
    """
    own = tasks.where("process_state = 'committed' and resource_id is not null").select("id", "resource_id", "resource_type")
    own = own if limit is None else own.orderBy("id").limit(limit)
    main = latest(descriptions.select("task_id", "id", "main"), "task_id", "id").select(F.col("task_id").alias("__task"), "main")
    text = own.join(main, F.col("id") == F.col("__task"), "left").drop("__task").withColumn("main", F.coalesce(stripped(F.col("main")), F.lit("")))
    done = answered(text.where("main <> ''"), "main", providers, "array<double>", options, retries, folder)
    ok = (F.col("status") == "ok") & (F.size("result") == dimension)
    made = done.select("id", "resource_id", "resource_type", F.when(ok, "ok").otherwise("failed").alias("outcome"), F.when(ok, F.col("result")).alias("vector"))
    none = text.where("main = ''").select("id", "resource_id", "resource_type", F.lit("skipped").alias("outcome"), F.lit(None).cast("array<double>").alias("vector"))
    return made.unionByName(none).withColumn("checksum", vector_checksum("vector"))
