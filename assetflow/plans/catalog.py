"""Queries over catalogues: filters, expressions, keys and files of resources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetflow.functions import expressions as X
from assetflow.operators import delivery as D
from assetflow.operators import entities as E
from assetflow.operators import lifecycle as L
from assetflow.operators import names as N
from assetflow.operators import previews as P
from assetflow.operators import selection as S
from assetflow.sources import working as W
from assetflow.states import FAILED, RESUMABLE

from .registry import query

def _listed_files(spark, d):
    """task_id and paths (array, in order)."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", "path")))
    return W.files(spark, d).groupBy("task_id").agg(F.transform(pairs, lambda x: x["path"]).alias("paths"))


listed = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY source_resource_id ORDER BY id) AS n FROM w_task), m AS (SELECT * FROM f WHERE n = 1 AND lower(trim(resource_type)) = 'single_image' AND lower(trim(source)) = 'src2')
    SELECT id, seq, resource_type, source, (SELECT count(*) FROM m) AS matching FROM (SELECT source_resource_id AS id, id AS seq, resource_type, source FROM m ORDER BY seq LIMIT 20)""")
def catalog_filter(spark, d):
    """The first twenty pictures of one source, of which the catalogue has some twice."""
    entries = W.tasks(spark, d).select(F.col("source_resource_id").alias("id"), F.col("id").alias("seq"), "resource_type", "source")
    return E.matching(entries, " Single_Image ", " SRC2 ", 20)


@query("SELECT id, title, updated_at, (SELECT count(*) FROM w_order_task WHERE process_state = 'committed') AS total FROM w_order_task WHERE process_state = 'committed' ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 100")
def resource_page(spark, d):
    own = W.order_tasks(spark, d).where("process_state = 'committed'")
    page = own.orderBy(F.desc("updated_at"), F.desc("id")).offset(100).limit(50)
    return page.crossJoin(F.broadcast(own.agg(F.count("*").alias("total")))).select("id", "title", "updated_at", "total")


@query("SELECT id, resource_id, process_state FROM w_task WHERE content_md5 IN (SELECT content_md5 FROM w_request WHERE content_md5 <> '')")
def task_lookup(spark, d):
    keys = W.requests(spark, d).where("content_md5 <> ''").select("content_md5")
    return W.tasks(spark, d).join(keys, "content_md5", "left_semi").select("id", "resource_id", "process_state")


@query(f"SELECT id, process_state, retry_count FROM w_task WHERE process_state IN ({listed(FAILED)})")
def failed_tasks(spark, d):
    return W.tasks(spark, d).where(F.col("process_state").isin(FAILED)).select("id", "process_state", "retry_count")


@query(f"SELECT id, process_state FROM w_task WHERE process_state IN ({listed(RESUMABLE)})")
def resumable_tasks(spark, d):
    return W.tasks(spark, d).where(F.col("process_state").isin(RESUMABLE)).select("id", "process_state")


@query("""SELECT resource_type, CASE WHEN d.task_id IS NOT NULL AND e.vec_id IS NOT NULL THEN 'OK' WHEN d.task_id IS NOT NULL OR e.vec_id IS NOT NULL THEN 'Partial' ELSE 'None' END AS badge, count(*) AS n
    FROM w_task t LEFT JOIN (SELECT DISTINCT task_id FROM w_desc) d ON t.id = d.task_id LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON t.id = e.vec_id
    WHERE contains(lower(resource_id || ' ' || content_md5), 'a1') GROUP BY ALL""")
def browse_filter(spark, d):
    t = W.tasks(spark, d).where(F.contains(F.lower(F.concat_ws(" ", "resource_id", "content_md5")), F.lit("a1")))
    described = W.descriptions(spark, d).select(F.col("task_id").alias("id")).distinct().withColumn("has_d", F.lit(True))
    embedded = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).distinct().withColumn("has_e", F.lit(True))
    both = t.join(described, "id", "left").join(embedded, "id", "left")
    badge = F.when(F.col("has_d") & F.col("has_e"), "OK").when(F.col("has_d") | F.col("has_e"), "Partial").otherwise("None")
    return both.groupBy("resource_type", badge.alias("badge")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT p_partkey, ['pack', 'atlas', 'tiled_map', 'tiled_tileset', 'spine_skeleton', 'dragonbones_skeleton', 'other', 'font_file', 'audio_file', 'tileset', 'animation_sequence', 'single_image', 'unknown', ''][p_partkey % 14 + 1] AS k, p_type FROM part)
    SELECT p_partkey, CASE WHEN k IN ('unknown', '') THEN '' ELSE k END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'png|' || lower(p_type) WHEN 1 THEN 'png' ELSE '' END AS formats FROM t""")
def normalize_filters(spark, d):
    """Types and formats that searches ask for, as they are compared."""
    p = W.table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, [*X.TYPES, "unknown", ""])), (F.col("p_partkey") % 14 + 1).cast("int"))
    formats = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(" .PNG"), F.lit(" "), F.concat(F.lit(".."), F.upper("p_type")))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("png"), F.lit(".Png ")))
    return p.select("p_partkey", X.type_filter(F.concat(F.lit(" "), F.upper(kind))).alias("kind"), F.array_join(X.format_filter(formats), "|").alias("formats"))


@query(r"""SELECT page_id, translate(url, '<>:"/\|?*', '_________') AS name FROM pages""")
def sanitize_names(spark, d):
    return W.table(spark, d, "pages").select("page_id", X.sanitized(F.col("url")).alias("name"))


@query(r"""SELECT page_id, 'root/' || translate(url, '<>:"/\|?*', '_________') || '/a/c.png' AS path FROM pages""")
def asset_path(spark, d):
    return W.table(spark, d, "pages").select("page_id", X.normal_path(F.concat_ws("/", F.lit("root/."), X.sanitized(F.col("url")), F.lit("a//b/../c.png"))).alias("path"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?:/*', '/'), '/+', '/', 'g'), '/$', '') AS path FROM pages""")
def normalize_path(spark, d):
    return W.table(spark, d, "pages").select("page_id", X.normal_path(F.regexp_replace("url", "^https?:", "")).alias("path"))


@query("SELECT asset_id, CASE WHEN fmt = '' THEN 'wav' ELSE fmt END AS format FROM w_asset")
def asset_format(spark, d):
    return W.assets(spark, d).select("asset_id", X.asset_format(F.col("fmt"), F.col("file_path")).alias("format"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, '' AS absent, CASE event_id % 3 WHEN 0 THEN event_type || '|' || user_id ELSE '' END AS tags, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN event_id ELSE 2 END ELSE CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END END AS member_count FROM events""")
def coerce_record(spark, d):
    """Fields of records of which some hold no list and some no number."""
    e = W.table(spark, d, "events")
    tags = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type", F.col("user_id").cast("string")))).when(F.col("event_id") % 3 == 1, F.lit('"none"'))
    count = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.lit('"many"'))
    record = F.concat(F.lit('{"member_count": '), count, F.when(tags.isNotNull(), F.concat(F.lit(', "tags": '), tags)).otherwise(""), F.lit("}"))
    own = e.select("event_id", "props", record.alias("record"))
    items = X.list_field(F.col("record"), "tags")
    return own.select(
        "event_id", F.coalesce(X.text_field(F.col("props"), "k").try_cast("bigint"), F.lit(0)).alias("k"), X.text_field(F.col("props"), "absent").alias("absent"),
        F.array_join(items, "|").alias("tags"), X.count_field(F.col("record"), "member_count", items).alias("member_count"))


@query("SELECT p_partkey, p_brand || '|' || p_type || CASE WHEN trim(p_name) IN ('', p_brand, p_type) THEN '' ELSE '|' || trim(p_name) END AS tags FROM part")
def merge_tags(spark, d):
    p = W.table(spark, d, "part")
    return p.select("p_partkey", F.array_join(X.merged(F.array("p_brand", F.lit(" ")), F.array(F.concat(F.lit(" "), "p_type"), "p_brand", "p_name")), "|").alias("tags"))


@query("SELECT task_id, string_agg(format, '|' ORDER BY o) AS formats FROM (SELECT task_id, format, min(ord) AS o FROM w_file GROUP BY ALL) GROUP BY task_id")
def merge_formats(spark, d):
    first = W.files(spark, d).groupBy("task_id", "format").agg(F.min("ord").alias("o"))
    return first.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "format"))), lambda x: x["format"]), "|").alias("formats"))


@query("SELECT task_id, CASE task_id % 3 WHEN 0 THEN 'assets/special.png' ELSE min_by(path, ord) END AS path FROM w_file GROUP BY task_id")
def preferred_path(spark, d):
    """The path that stands for each task: its own, which is a file's, a folder's or empty, or that of its first file."""
    own = F.when(F.col("task_id") % 3 == 0, "assets/special.png").when(F.col("task_id") % 3 == 1, "assets/v1.2/folder").otherwise("")
    return _listed_files(spark, d).select("task_id", E.preferred_path(own, F.col("paths")).alias("path"))


@query("""WITH k AS (SELECT task_id, ord, path, format, lower(split_part(path, '/', -1)) AS name, ['audio_file', 'tileset', 'single_image', 'pack'][task_id % 4 + 1] AS kind, first_value(lower(split_part(path, '/', -1))) OVER w AS first_name, first_value(path) OVER w AS first_path,
        nth_value(lower(split_part(path, '/', -1)), 2) OVER w AS second FROM w_file WINDOW w AS (PARTITION BY task_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    p AS (SELECT *, CASE WHEN task_id % 3 = 0 AND second IS NOT NULL THEN second WHEN task_id % 3 = 1 THEN 'none.png' ELSE first_name END AS preferred FROM k), q AS (SELECT *, bool_or(name = preferred) OVER (PARTITION BY task_id) AS any_named FROM p)
    SELECT task_id, path, CASE kind WHEN 'audio_file' THEN 'audio' WHEN 'tileset' THEN 'tile' ELSE CASE WHEN format = 'png' THEN 'main' ELSE 'attachment' END END AS role,
    CASE WHEN kind IN ('single_image', 'pack') AND format = 'png' AND any_named THEN name = preferred ELSE name = preferred OR path = first_path END AS is_primary FROM q""")
def file_role_catalog(spark, d):
    """Roles of files by their resource's type; the preferred name is the second file's, one that no file has, or the first file's."""
    kind = F.element_at(F.array(*map(F.lit, ("audio_file", "tileset", "single_image", "pack"))), (F.col("task_id") % 4 + 1).cast("int"))
    own = F.when(F.col("task_id") % 3 == 0, F.concat(F.lit("x/"), F.upper(X.file_name(F.get("paths", F.lit(1)))))).when(F.col("task_id") % 3 == 1, "gone/none.png").otherwise("")
    return _listed_files(spark, d).select("task_id", F.explode(E.file_roles(kind, own, F.col("paths"))).alias("f")).select("task_id", "f.*")


@query("SELECT task_id, ord, CASE format WHEN 'fbx' THEN 'model' WHEN 'png' THEN CASE WHEN l_partkey % 3 = 0 THEN 'texture' ELSE 'main' END ELSE 'attachment' END AS role, format = 'fbx' AS is_primary FROM w_file")
def file_role_directory(spark, d):
    """Roles of the files of a folder, every third of which is named as a texture."""
    path = F.when(F.col("l_partkey") % 3 == 0, F.regexp_replace("path", r"(\.[^.]*)$", "_Normal$1")).otherwise(F.col("path"))
    role = X.directory_role(path)
    return W.files(spark, d).select("task_id", "ord", role.alias("role"), (role == "model").alias("is_primary"))


@query("""SELECT id AS task_id, CASE WHEN n IS NULL THEN CASE WHEN id % 2 = 0 THEN 'res/' || id ELSE 'pack' END WHEN lo = hi THEN 'assets/s' || lo ELSE 'assets' END AS directory FROM w_order_task
    LEFT JOIN (SELECT task_id, count(*) AS n, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM w_file WHERE task_id % 7 <> 0 GROUP BY task_id) ON id = task_id""")
def common_directory(spark, d):
    """Each task's folder: the one that its files share, or, for those whose files are missing, its path or its pack."""
    f = _listed_files(spark, d).where("task_id % 7 <> 0")
    t = W.order_tasks(spark, d).select(F.col("id").alias("task_id")).join(f, "task_id", "left")
    own = F.when(F.col("task_id") % 2 == 0, F.concat(F.lit("res/"), "task_id")).otherwise("")
    return t.select("task_id", E.source_directory(F.coalesce("paths", F.array().cast("array<string>")), own, F.lit("pack")).alias("directory"))


@query("SELECT task_id, round(count(*) FILTER (WHERE ord % 3 = 0) / count(*)::DOUBLE, 4) AS ratio FROM w_file GROUP BY task_id")
def missing_ratio(spark, d):
    return W.files(spark, d).groupBy("task_id").agg(F.round(F.try_divide(F.count_if(F.col("ord") % 3 == 0), F.count("*")), 4).alias("ratio"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type || '|' || user_id WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN '1|2.5|x' ELSE '' END AS texts, CASE event_id % 7 WHEN 0 THEN 2 WHEN 5 THEN 3 ELSE 0 END AS n FROM events""")
def json_list_codec(spark, d):
    """Lists read from JSON texts: lists of texts and of numbers, and null, blank, broken texts and JSON that is no list, which are empty."""
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, F.to_json(F.array("event_type", F.col("user_id").cast("string")))).when(k == 1, F.lit(None)).when(k == 2, " ").when(k == 3, "not json").when(k == 4, F.to_json(F.struct("event_id")))
        .when(k == 5, '[1, 2.5, "x"]').otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))))
    read = X.json_list(raw)
    return W.table(spark, d, "events").select("event_id", F.array_join(read, "|").alias("texts"), F.size(read).alias("n"))


@query("""SELECT task_id, CASE WHEN bool_or(f IN ('fbx', 'obj', 'gltf', 'glb', 'blend')) THEN 'model' WHEN bool_or(f IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'tif', 'tiff', 'svg')) THEN 'image' ELSE 'other' END AS kind
    FROM (SELECT task_id, ['png', 'BLEND', 'stl', 'svg', 'ogg'][l_partkey % 5 + 1].lower() AS f FROM w_file) GROUP BY task_id""")
def infer_type(spark, d):
    """The type of each task by its files' formats, of which stl is no model's and blend is one's."""
    kind = F.element_at(F.array(*map(F.lit, ("png", "BLEND", "stl", "svg", "ogg"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return W.files(spark, d).groupBy("task_id").agg(F.collect_set(kind).alias("f")).select("task_id", X.type_of_formats(F.col("f")).alias("kind"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN substr(content_md5, 1, 12) ELSE coalesce(nullif(title, ''), substr(content_md5, 1, 12)) END AS label FROM w_task")
def resource_label(spark, d):
    t = W.tasks(spark, d)
    return t.select("id", X.label(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("title")), F.lit(""), F.col("content_md5")).alias("label"))


@query("SELECT task_id, ord, CASE format WHEN 'png' THEN 'images' WHEN 'fbx' THEN 'models' ELSE 'others' END AS category FROM w_file")
def storage_category(spark, d):
    return W.files(spark, d).select("task_id", "ord", X.storage_category(F.col("path")).alias("category"))


@query("SELECT task_id, ord, 'files/res-' || task_id || '/' || regexp_extract(path, '[^/]*$') AS object_key FROM w_file")
def object_key(spark, d):
    return W.files(spark, d).select("task_id", "ord", F.concat(F.lit("files/res-"), "task_id", F.lit("/"), X.file_name(F.col("path"))).alias("object_key"))


@query("""WITH f AS (SELECT *, split_part(path, '/', -1) AS name FROM w_file)
    SELECT id, title, any_value(idempotency_key) AS idempotency_key, string_agg(name || ':' || size || ':' || format || ':' || md5 || ':' || CASE WHEN format = 'ogg' THEN 'main' ELSE format END || ':' || (ord = 1), '|' ORDER BY ord) AS files, sum(size)::BIGINT AS total_size,
    CASE WHEN count(*) = 1 THEN min_by(name, ord) END AS download_name, CASE WHEN count(*) > 1 THEN 'application/zip' ELSE 'application/octet-stream' END AS download_type FROM w_task JOIN f ON id = task_id GROUP BY id, title""")
def register_record(spark, d):
    role = F.when(F.col("format") != "ogg", F.col("format"))
    f = W.files(spark, d).select("task_id", "ord", X.file_name(F.col("path")).alias("name"), "size", "format", "md5", role.alias("role"), (F.col("ord") == 1).alias("is_primary"))
    made = D.register_records(W.tasks(spark, d).select("id", "title", "idempotency_key", "resource_type"), f)
    line = lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("name", "size", "format", "md5", "role", "is_primary")))
    return made.withColumn("files", F.array_join(F.transform("files", line), "|")).drop("resource_type")


@query("""SELECT task_id, ord, CASE WHEN ord = 2 THEN 'kept' WHEN ord = 3 THEN '' ELSE path || ':' || size || ':' || md5 || ':true' END AS files, CASE WHEN ord = 2 THEN 'own' WHEN format = 'png' THEN path ELSE '' END AS previews FROM w_file""")
def legacy_upgrade(spark, d):
    """Older records with one file and one preview; the second of a task has arrays already, the third no path."""
    f = W.files(spark, d)
    second = F.col("ord") == 2
    file = F.struct(F.lit("kept").alias("path"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("size"), F.lit("").alias("format"), F.lit("").alias("md5"), F.lit(False).alias("is_primary"))
    none = lambda kind: F.array().cast(kind)
    old = f.select(
        "task_id", "ord", F.when(second, F.array(file)).otherwise(none("array<struct<path:string,name:string,size:bigint,format:string,md5:string,is_primary:boolean>>")).alias("files"),
        F.when(second, F.array(F.struct(F.lit("own").alias("path")))).alias("previews"), F.when(F.col("ord") == 3, "").otherwise(F.col("path")).alias("source_path"), X.file_name(F.col("path")).alias("source_name"),
        F.col("size").alias("source_size"), F.col("format").alias("source_format"), F.col("md5").alias("content_md5"), F.when(F.col("format") == "png", F.struct("path")).alias("preview"))
    line = lambda x: F.when(x["md5"] == "", x["path"]).otherwise(F.concat_ws(":", x["path"], x["size"].cast("string"), x["md5"], x["is_primary"].cast("string")))
    return D.upgraded(old).select("task_id", "ord", F.array_join(F.transform("files", line), "|").alias("files"), F.array_join(F.transform("previews", lambda x: x["path"]), "|").alias("previews"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS plain FROM orders")
def render_timestamp(spark, d):
    o = W.table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("plain"))


@query("SELECT task_id, string_agg('p' || l_partkey || '-' || ord, '|' ORDER BY l_partkey, ord) AS names FROM w_file GROUP BY task_id")
def natural_order(spark, d):
    f = W.files(spark, d).withColumn("name", F.concat(F.lit("p"), "l_partkey", F.lit("-"), "ord"))
    pairs = F.array_sort(F.collect_list(F.struct(X.natural_key(F.col("name")).alias("k"), "name")))
    return f.groupBy("task_id").agg(F.array_join(F.transform(pairs, lambda x: x["name"]), "|").alias("names"))


@query("""WITH g AS (SELECT task_id, list(path ORDER BY ord) AS p, count(*) AS n FROM w_file GROUP BY task_id)
    SELECT task_id, CASE WHEN n <= 3 THEN array_to_string(p, '|') ELSE p[1] || '|' || p[round_even((n - 1) / 2.0, 0)::INT + 1] || '|' || p[n] END AS sample FROM g""")
def even_sample(spark, d):
    g = W.files(spark, d).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("p"))
    return g.select("task_id", F.array_join(X.even_sample(F.col("p"), 3), "|").alias("sample"))


@query("SELECT task_id, md5(string_agg(md5, '' ORDER BY md5)) AS composite FROM w_file GROUP BY task_id")
def composite_md5(spark, d):
    return W.files(spark, d).groupBy("task_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("md5")), "")).alias("composite"))


@query("""SELECT id, md5('{"file_paths": [' || coalesce(p, '') || '], "id": "' || resource_id || '", "member_count": ' || coalesce(n, 0) || ', "pack_name": "p", "resource_path": "", "resource_type": "' || resource_type || '", "source": "' || source || '"}') AS fingerprint
    FROM w_task LEFT JOIN (SELECT task_id, string_agg('"' || path || '"', ', ' ORDER BY ord) AS p, count(*) AS n FROM w_file GROUP BY task_id) ON id = task_id""")
def resource_fingerprint(spark, d):
    by = W.files(spark, d).groupBy(F.col("task_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))
    t = W.tasks(spark, d).join(by, "id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    return t.select("id", X.fingerprint(F.col("resource_id"), F.col("source"), F.lit("p"), F.col("resource_type"), F.lit(""), F.size("paths"), F.col("paths")).alias("fingerprint"))


@query("SELECT req_id, CASE WHEN source_resource_id <> '' THEN 'crawler-register:src:' || substr(sha256(source_resource_id), 1, 24) WHEN content_md5 <> '' THEN 'crawler-register:md5:' || content_md5 WHEN trim(title) <> '' THEN 'crawler-register:title:' || trim(title) ELSE '' END AS idem FROM w_request")
def idempotency_key(spark, d):
    r = W.requests(spark, d)
    return r.select("req_id", X.idempotency_key(F.col("source_resource_id"), F.col("content_md5"), F.lit(""), F.col("title")).alias("idem"))


@query("SELECT req_id, CASE WHEN source_resource_id <> '' THEN 'source:' || source_resource_id WHEN content_md5 <> '' THEN 'md5:' || content_md5 WHEN title <> '' THEN 'title:' || title ELSE '' END AS k FROM w_request")
def resume_key(spark, d):
    r = W.requests(spark, d)
    return r.select("req_id", X.resume_key(F.col("source_resource_id"), F.col("content_md5"), F.lit(""), F.col("title")).alias("k"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS again FROM lineitem), a AS (SELECT * FROM w_asset),
    i AS (SELECT l_orderkey, n, l_partkey, asset_id, fmt FROM l JOIN a ON asset_id = 'a' || l_partkey WHERE l_partkey % 2 = 0 AND l_orderkey % 3 <> 0),
    p AS (SELECT l_orderkey, n, l_partkey, asset_id, fmt FROM l JOIN a ON file_path = 'pack/' || l_partkey || '.WAV' AND l_partkey % 5 <> 0 WHERE again = 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM i)),
    b AS (FROM i UNION ALL FROM p)
    SELECT o_orderkey AS id, coalesce(string_agg(asset_id || ':' || fmt, '|' ORDER BY n, l_partkey), '') AS assets FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN b ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def resolve_assets(spark, d):
    """Assets of orders by ids, of which the odd ones are unknown, else by paths; every third order lists no ids."""
    own = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    entries = W.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(own.alias("own"))
    wanted = F.transform("own", lambda x: F.concat(F.when(x["l_partkey"] % 2 == 0, "a").otherwise("unknown"), x["l_partkey"]))
    entries = entries.select(
        "id", F.when(F.col("id") % 3 != 0, wanted).otherwise(F.array().cast("array<string>")).alias("asset_ids"), F.lit("store").alias("source"), F.lit("p").alias("pack_name"),
        F.transform("own", lambda x: F.concat(F.lit("pack/"), x["l_partkey"], F.lit(".WAV"))).alias("file_paths"))
    fifth = F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint") % 5 == 0
    assets = W.assets(spark, d).withColumns({"source": F.lit("store"), "pack_name": F.when(fifth, "other").otherwise("p")})
    return E.resolve_assets(entries, assets).select("id", F.array_join(F.transform("assets", lambda a: F.concat_ws(":", a["asset_id"], a["fmt"])), "|").alias("assets"))


@query("SELECT task_id, coalesce(string_agg(path, '|' ORDER BY ord) FILTER (WHERE l_partkey % 2 = 0), '') AS resolved, coalesce(string_agg(path, '|' ORDER BY ord) FILTER (WHERE l_partkey % 2 = 1), '') AS missing FROM w_file GROUP BY task_id")
def resolve_files(spark, d):
    f = W.files(spark, d)
    there = f.where("l_partkey % 2 = 0").select("path").distinct().withColumn("there", F.lit(True))
    both = f.join(there, "path", "left")
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "path")))), lambda x: x["path"]), "|")
    return both.groupBy("task_id").agg(part(F.col("there").isNotNull()).alias("resolved"), part(F.col("there").isNull()).alias("missing"))


@query("""WITH r AS (SELECT p_partkey AS id, 'site' || (p_partkey % 2) AS source, p_brand || ':' || (p_size % 3) AS pack_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS description, p_type AS tag FROM part),
    k AS (SELECT 'site' || (p_partkey % 2) AS source, p_brand || '_' || (p_size % 3) AS pack, 'about ' || p_brand AS description, p_brand AS tag FROM part WHERE p_size % 3 < 2 GROUP BY ALL)
    SELECT id, CASE WHEN r.description <> '' THEN r.description ELSE coalesce(k.description, '') END AS description, r.tag || CASE WHEN k.tag IS NULL OR k.tag = r.tag THEN '' ELSE '|' || k.tag END AS tags
    FROM r LEFT JOIN k ON r.source = k.source AND replace(r.pack_name, ':', '_') = k.pack""")
def pack_enrich(spark, d):
    """Parts as resources with the descriptions and tags of their packs, of which every third is unknown."""
    p = W.table(spark, d, "part")
    name = F.concat("p_brand", F.lit(":"), F.col("p_size") % 3)
    site = F.concat(F.lit("site"), F.col("p_partkey") % 2).alias("source")
    entries = p.select(F.col("p_partkey").alias("id"), site, name.alias("pack_name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("description"), F.array("p_type").alias("tags"))
    packs = p.where("p_size % 3 < 2").select(site, X.sanitized(name).alias("pack"), F.concat(F.lit("about "), "p_brand").alias("description"), F.array(F.lit(" "), "p_brand", "p_brand").alias("tags")).distinct()
    return E.with_packs(entries, packs).select("id", "description", F.array_join("tags", "|").alias("tags"))


@query("SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS n, sum(size)::BIGINT AS total FROM w_file GROUP BY 1")
def group_by_directory(spark, d):
    return W.files(spark, d).groupBy(X.parent(F.col("path")).alias("directory")).agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query("""WITH a AS (SELECT l_orderkey, CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE style END AS style, theme FROM lineitem JOIN w_asset ON asset_id = 'a' || l_partkey),
    s AS (SELECT l_orderkey, style AS v, count(*) AS n FROM a WHERE trim(style) <> '' GROUP BY ALL), t AS (SELECT l_orderkey, theme AS v, count(*) AS n FROM a WHERE trim(theme) <> '' GROUP BY ALL)
    SELECT DISTINCT l_orderkey AS id, coalesce((SELECT string_agg(v || '=' || n, '|' ORDER BY v) FROM s WHERE s.l_orderkey = l.l_orderkey), '') AS styles, coalesce((SELECT string_agg(v || '=' || n, '|' ORDER BY v) FROM t WHERE t.l_orderkey = l.l_orderkey), '') AS themes FROM lineitem l""")
def style_counters(spark, d):
    """Styles and themes of each order's assets; every seventh asset has a blank style."""
    seventh = F.regexp_extract("asset_id", r"(\d+)", 1).cast("bigint") % 7 == 0
    assets = W.assets(spark, d).select("asset_id", F.when(seventh, " ").otherwise(F.col("style")).alias("style"), "theme")
    own = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("a"), "l_partkey").alias("asset_id"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), "|")
    return E.counters(own, assets, "style", "theme").select("id", text("style").alias("styles"), text("theme").alias("themes"))


@query("""WITH n AS (SELECT task_id, ord, path, CASE format WHEN 'png' THEN 'images' WHEN 'fbx' THEN 'models' ELSE 'others' END AS category, 'f' || (l_partkey % 500) AS family, family || CASE ord % 6 WHEN 1 THEN '_1' WHEN 2 THEN '_2' WHEN 3 THEN '_1_1' ELSE '' END AS stem,
    '.' || format AS low, CASE WHEN ord % 6 = 4 THEN upper(low) ELSE low END AS ext FROM w_file),
    g AS (SELECT category, family, low, list([stem || ext, stem, low] ORDER BY path, task_id, ord) AS xs, list({'task_id': task_id, 'ord': ord} ORDER BY path, task_id, ord) AS ids FROM n GROUP BY ALL),
    t AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], xs), lambda taken, x: list_append(taken, CASE WHEN NOT list_contains(taken, x[1]) THEN x[1]
        ELSE x[2] || '_' || list_filter(range(1, len(taken) + 2), lambda k: NOT list_contains(taken, x[2] || '_' || k || x[3]))[1] || x[3] END)) AS targets FROM g),
    u AS (SELECT category, unnest(ids) AS i, unnest(targets) AS target FROM t) SELECT i.task_id AS task_id, i.ord AS ord, category, target FROM u""")
def unique_names(spark, d):
    """Targets of files of which many share a name, some have names that others are given (_1, _2, _1_1), and some an extension in capitals."""
    ending = F.element_at(F.array(*map(F.lit, ("", "_1", "_2", "_1_1", "", ""))), (F.col("ord") % 6 + 1).cast("int"))
    f = W.files(spark, d)
    ext = F.when(F.col("ord") % 6 == 4, F.upper("format")).otherwise(F.col("format"))
    name = F.concat(F.lit("f"), F.col("l_partkey") % 500, ending, F.lit("."), ext)
    f = f.select("task_id", "ord", "path", N.category(name).alias("category"), name.alias("name"))
    return N.unique_names(f, F.col("category"), F.col("name"), "path", "task_id", "ord").select("task_id", "ord", "category", "target")


@query("SELECT task_id, ord, CASE WHEN task_id % 3 = 0 AND ord <= 2 THEN CASE ord WHEN 1 THEN 'gallery' ELSE 'primary' END WHEN ord = 1 THEN 'primary' ELSE 'gallery' END AS role FROM w_file")
def preview_roles(spark, d):
    """Roles of uploaded previews: every third task gave two, another third an empty list, the others none."""
    given = F.when(F.col("task_id") % 3 == 0, F.array(F.lit("gallery"), F.lit("primary"))).when(F.col("task_id") % 3 == 1, F.array().cast("array<string>"))
    return P.with_roles(W.files(spark, d).select("task_id", "ord", (F.col("ord") - 1).alias("place"), given.alias("roles"))).select("task_id", "ord", "role")


@query("SELECT task_id, string_agg(path, '|' ORDER BY format <> 'fbx', ord) AS children FROM w_file GROUP BY task_id")
def ordered_children(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct((F.col("format") != "fbx").alias("later"), "ord", "path")))
    return W.files(spark, d).groupBy("task_id").agg(F.array_join(F.transform(pairs, lambda x: x["path"]), "|").alias("children"))


@query("SELECT task_id, arg_min(format, o) AS main, coalesce(string_agg(format, '|' ORDER BY o) FILTER (WHERE o <> m), '') AS other FROM (SELECT task_id, format, min(ord) AS o, min(min(ord)) OVER (PARTITION BY task_id) AS m FROM w_file GROUP BY task_id, format) GROUP BY task_id")
def distinct_previews(spark, d):
    g = W.files(spark, d).groupBy("task_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "format"))), lambda x: x["format"])).alias("p"))
    return g.select("task_id", F.try_element_at("p", F.lit(1)).alias("main"), F.array_join(F.slice("p", F.lit(2), F.size("p")), "|").alias("other"))


@query("SELECT DISTINCT task_id FROM w_file WHERE format IN ('fbx', 'ogg')")
def format_intersection(spark, d):
    return W.files(spark, d).where(F.col("format").isin("fbx", "ogg")).select("task_id").distinct()


@query("SELECT task_id, sum(size)::BIGINT AS total, CASE WHEN sum(size) > 104857600 THEN 'multipart' ELSE 'single' END AS mode FROM w_file GROUP BY task_id")
def upload_mode(spark, d):
    return W.files(spark, d).groupBy("task_id").agg(F.sum("size").alias("total")).withColumn("mode", F.when(F.col("total") > 100 * 1024 * 1024, "multipart").otherwise("single"))


@query(r"""WITH f AS (SELECT task_id, ord, format, l_partkey, 'assets/' || CASE WHEN l_partkey % 2 = 0 THEN 'sub/' ELSE '' END || 'p' || (l_partkey % 3) || '.' || format AS path, count(*) OVER (PARTITION BY task_id) AS n FROM w_file),
    o AS (SELECT *, CASE task_id % 5 WHEN 0 THEN split_part(path, '/', -1) WHEN 1 THEN '../../' || path WHEN 2 THEN '../' || substr(path, 8) ELSE substr(path, 8) END AS base,
        CASE WHEN task_id % 7 = 0 THEN 'path_' || task_id || '_x' WHEN task_id % 7 = 1 THEN substr(md5('c' || task_id), 1, 12) WHEN task_id % 3 = 1 THEN 'order_' || task_id || '_1' ELSE 'resource' END AS named FROM f WHERE (n > 1 OR task_id % 4 = 0) AND l_partkey % 7 <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY task_id, base ORDER BY ord) - 1 AS k FROM o)
    SELECT task_id, ord, CASE task_id % 3 WHEN 0 THEN 'own ' || task_id || '.ZIP' ELSE named || '.zip' END AS archive, CASE WHEN k = 0 THEN base ELSE regexp_replace(base, '\.[^.]*$', '') || '_' || k || '.' || format END AS member FROM k""")
def package_manifest(spark, d):
    """Members of archives; every seventh file is missing, some tasks have no root or one beside the files, some titles no letter, and some are empty, so that a path or a checksum names the archive."""
    id_, third, seventh = F.col("id"), F.col("id") % 3, F.col("id") % 7
    r = W.order_tasks(spark, d).select(
        "id", F.when(seventh < 2, "").when(third == 1, F.concat("title", F.lit(".1*"))).otherwise(" /").alias("title"), F.when(seventh == 0, F.concat(F.lit("path/"), "id", F.lit(".x"))).alias("resource_path"), F.md5(F.concat(F.lit("c"), "id")).alias("content_md5"),
        F.when(id_ % 4 == 0, "pack").otherwise("image").alias("resource_type"), F.when(third == 0, F.concat(F.lit("own "), "id", F.lit(".ZIP"))).otherwise("").alias("download_name"),
        F.when(id_ % 5 == 0, "").when(id_ % 5 == 1, "other/deep").when(id_ % 5 == 2, "assets/none/").otherwise("assets").alias("root"))
    path = F.concat(F.lit("assets/"), F.when(F.col("l_partkey") % 2 == 0, "sub/").otherwise(""), F.lit("p"), F.col("l_partkey") % 3, F.lit("."), "format")
    return D.package_members(r, W.files(spark, d).select("task_id", "ord", path.alias("path"), (F.col("l_partkey") % 7 != 0).alias("found")))


@query("""WITH n AS (SELECT task_id || '/' || path || '#' || ord AS path, size, ord % 7 AS k FROM w_file WHERE ord % 7 <> 6), s AS (SELECT task_id || '/' || path || '#' || ord AS path, size, ord % 7 AS k FROM w_file WHERE ord % 7 <> 0),
    j AS (SELECT path, n.size AS now, coalesce(n.k, s.k) AS k FROM n FULL JOIN s USING (path))
    SELECT path, CASE k WHEN 6 THEN 'vanished' WHEN 1 THEN 'keep' WHEN 2 THEN 'overwrite' WHEN 3 THEN 'overwrite' ELSE 'new' END AS outcome, CASE WHEN k IN (1, 2, 3, 6) THEN 'copies/' || path END AS copied, now AS size,
    CASE WHEN k = 1 THEN 'p1|p2' ELSE '' END AS previews FROM j""")
def copy_decision(spark, d):
    """What becomes of each file's copy: by its place of seven unknown yet, unchanged, of another size, changed later, its copy lost, its copy never made, and gone."""
    k = F.col("ord") % 7
    f = W.files(spark, d).select(F.concat("task_id", F.lit("/"), "path", F.lit("#"), "ord").alias("path"), "size", "ord", F.lit(1).alias("modified"))
    scan = f.where(k != 6).withColumn("modified", F.when(k == 3, 2).otherwise(1))
    copied = F.when(k != 5, F.concat(F.lit("copies/"), "path"))
    state = f.where(k != 0).select("path", F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified", copied.alias("copied"), F.array(F.lit("p1"), F.lit("p2")).alias("previews"))
    held = f.where(~k.isin(0, 4, 5)).select(F.concat(F.lit("copies/"), "path").alias("path"))
    return L.copy_plan(scan.select("path", "size", "modified"), state, held).select("path", "outcome", "copied", "size", F.array_join("previews", "|").alias("previews"))
