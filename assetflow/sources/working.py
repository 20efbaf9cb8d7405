"""Working tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.states import STATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource tasks, one per document."""
    d = table(spark, sf_dir, "documents")
    kind = F.create_map(*map(F.lit, ["en", "single_image", "de", "tileset", "fr", "audio_file", "es", "font_file"]))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("res-"), "doc_id").alias("resource_id"),
        F.concat(F.lit("doc-"), F.col("doc_id") - F.col("doc_id") % 2).alias("source_resource_id"),
        "source",
        F.md5("text").alias("content_md5"),
        F.try_element_at(kind, F.col("lang")).alias("resource_type"),
        F.element_at(F.array(*map(F.lit, STATES)), (F.col("doc_id") % 12 + 1).cast("int")).alias("process_state"),
        (F.col("doc_id") % 5).alias("retry_count"),
        F.concat(F.lit("doc-"), F.col("doc_id") - F.col("doc_id") % 10).alias("parent_source"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("updated_at"),
        F.col("text").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("crawler-register:md5:"), F.md5("text")))
        .otherwise(F.concat(F.lit("crawler-register:src:"), F.substring(F.sha2(F.concat(F.lit("doc-"), F.col("doc_id") - F.col("doc_id") % 2), 256), 1, 24))).alias("idempotency_key"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration requests: every third task again, with some fields emptied and every ninth with a key of its own content."""
    t = tasks(spark, sf_dir).where(F.col("id") % 3 == 0)
    return t.select(
        F.when(F.col("id") % 9 == 0, F.concat(F.lit("crawler-register:md5:"), "content_md5")).otherwise(F.concat(F.lit("crawler-register:md5:new"), "id")).alias("idempotency_key"),
        F.col("id").alias("req_id"),
        F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("doc-"), F.col("id") + 100 - F.col("id") % 2)).alias("source_resource_id"),
        "source", F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.col("content_md5")).alias("content_md5"),
        F.when(F.col("id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("new "), "title")).alias("title"), "resource_type",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource files, one per line item, numbered within their task."""
    # named in front of the window, for what is dealt out by l_orderkey isn't known to be dealt out by its alias
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "task_id")
    fmt = F.when(F.col("l_returnflag") == "A", "png").when(F.col("l_returnflag") == "N", "fbx").otherwise("ogg")
    path = F.concat(F.lit("assets/s"), "l_suppkey", F.lit("/p"), "l_partkey", F.lit("_"), "l_linenumber", F.lit("."), fmt)
    order = Window.partitionBy("task_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return line.select(
        "task_id", F.row_number().over(order).alias("ord"), fmt.alias("format"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("size"), path.alias("path"), F.md5(path).alias("md5"), "l_suppkey", "l_partkey",
    )


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "description_ready").otherwise("preview_failed")
    return o.select(F.col("o_orderkey").alias("id"), state.alias("process_state"), F.col("o_orderdate").alias("updated_at"), F.concat(F.lit("order "), "o_orderkey").alias("title"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 2).alias("task_id"), F.col("doc_id").alias("id"), F.concat(F.lit("prompt_v"), F.col("doc_id") % 2 + 1).alias("prompt_version"), F.col("text").alias("main"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of tasks, by one of two model versions."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("task_id"), F.col("vec_id").alias("id"), F.concat(F.lit("embed_v"), F.col("vec_id") % 3).alias("model_version"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("a"), "p_partkey").alias("asset_id"), F.col("p_brand").alias("style"), F.col("p_type").alias("theme"), F.when(F.col("p_size") % 2 == 0, "").otherwise("png").alias("fmt"), F.concat(F.lit("pack/"), "p_partkey", F.lit(".WAV")).alias("file_path"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs: a conversation's user turns and its assistant turns behind the two line prefixes, in several forms."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    said = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text"))))
    by = c.groupBy("conv_id").agg(*(F.array_join(F.transform(said(r), lambda x: x["text"]), " ").alias(r) for r in ("user", "assistant")))
    one = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")
    colon = F.when(F.col("conv_id") % 3 == 0, ":").otherwise("：")
    text = F.when(F.col("conv_id") % 5 == 4, F.concat(one("user"), F.lit("\n"), one("assistant"))).otherwise(F.concat(F.lit("主体"), colon, one("user"), F.lit("\n细节"), colon, one("assistant")))
    return by.select("conv_id", text.alias("output"))


_STATE_LIST = ", ".join(f"'{s}'" for s in STATES)
#: The working tables as SQL, each a named query; a query's SQL begins with those that it needs.
SQL = {
    "w_task": f"""SELECT doc_id AS id, 'res-' || doc_id AS resource_id, 'doc-' || (doc_id - doc_id % 2) AS source_resource_id, source, md5(text) AS content_md5,
        CASE lang WHEN 'en' THEN 'single_image' WHEN 'de' THEN 'tileset' WHEN 'fr' THEN 'audio_file' WHEN 'es' THEN 'font_file' END AS resource_type,
        [{_STATE_LIST}][doc_id % 12 + 1] AS process_state, doc_id % 5 AS retry_count, 'doc-' || (doc_id - doc_id % 10) AS parent_source,
        TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS updated_at, text AS title,
        CASE WHEN doc_id % 2 = 0 THEN 'crawler-register:md5:' || md5(text) ELSE 'crawler-register:src:' || substr(sha256('doc-' || (doc_id - doc_id % 2)), 1, 24) END AS idempotency_key FROM documents""",
    "w_request": """SELECT id AS req_id, CASE WHEN id % 4 = 0 THEN '' ELSE 'doc-' || (id + 100 - id % 2) END AS source_resource_id, source,
        CASE WHEN id % 5 = 0 THEN '' ELSE content_md5 END AS content_md5, CASE WHEN id % 7 = 0 THEN '' ELSE 'new ' || title END AS title, resource_type,
        CASE WHEN id % 9 = 0 THEN 'crawler-register:md5:' || content_md5 ELSE 'crawler-register:md5:new' || id END AS idempotency_key FROM w_task WHERE id % 3 = 0""",
    "w_embed": "SELECT vec_id AS task_id, vec_id AS id, 'embed_v' || (vec_id % 3) AS model_version FROM embeddings",
    "w_file": """SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS ord,
        CASE l_returnflag WHEN 'A' THEN 'png' WHEN 'N' THEN 'fbx' ELSE 'ogg' END AS format, (l_quantity * 1000)::BIGINT AS size,
        'assets/s' || l_suppkey || '/p' || l_partkey || '_' || l_linenumber || '.' || CASE l_returnflag WHEN 'A' THEN 'png' WHEN 'N' THEN 'fbx' ELSE 'ogg' END AS path, md5(path) AS md5, l_suppkey, l_partkey FROM lineitem""",
    "w_order_task": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'description_ready' ELSE 'preview_failed' END AS process_state, o_orderdate AS updated_at, 'order ' || o_orderkey AS title FROM orders""",
    "w_desc": "SELECT doc_id // 2 AS task_id, doc_id AS id, 'prompt_v' || (doc_id % 2 + 1) AS prompt_version, text AS main FROM documents",
    "w_asset": "SELECT 'a' || p_partkey AS asset_id, p_brand AS style, p_type AS theme, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'png' END AS fmt, 'pack/' || p_partkey || '.WAV' AS file_path FROM part",
    "w_output": r"""SELECT conv_id, CASE WHEN conv_id % 5 = 4 THEN u || chr(10) || a ELSE '主体' || c || u || chr(10) || '细节' || c || a END AS output FROM (
        SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN ':' ELSE '：' END AS c, regexp_replace(coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (WHERE role = 'user'), ''), '\s+', ' ', 'g') AS u,
        regexp_replace(coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), ''), '\s+', ' ', 'g') AS a FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)""",
}


def with_tables(query: str) -> str:
    """The query with the working tables that it names in front."""
    used, order = set(), list(SQL)

    def need(text: str) -> None:
        for name in order:
            if name in text and name not in used:
                used.add(name)
                need(SQL[name])

    need(query)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order if n in used)
    body = query.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
