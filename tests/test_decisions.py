"""Decisions over tasks, registration, checks of descriptions and search on small hand-made rows."""

from pyspark.sql import functions as F

from assetflow.functions import expressions as X
from assetflow.operators import registration as R
from assetflow.operators import selection as S
from assetflow.operators.search import enrich
from assetflow.operators.vectors import cosine_top_k


def values(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return tuple(row)


def decide(spark, tasks, descriptions=(), embeddings=(), prompt="prompt_v1", model="mock_embed_v1"):
    requests = spark.createDataFrame([("r", "m")], "req_id string, content_md5 string")
    t = spark.createDataFrame(list(tasks), "id int, content_md5 string, process_state string")
    d = spark.createDataFrame(list(descriptions), "task_id int, id int, prompt_version string")
    e = spark.createDataFrame(list(embeddings), "task_id int, id int, model_version string")
    row = S.dedup_decision(requests, t, d, e, prompt, model).first()
    return row["decision"], row["existing_task_id"]


def test_dedup_decisions(spark):
    done, said, held = [(1, "m", "committed")], [(1, 1, "prompt_v1")], [(1, 1, "mock_embed_v1")]
    assert decide(spark, [(1, "other", "committed")]) == ("new", None)
    assert decide(spark, done, said, held) == ("reuse_all", 1)
    assert decide(spark, done, said, held, prompt="prompt_v2") == ("rerun_description", 1)
    assert decide(spark, done, said, held, model="new_embed_v2") == ("rerun_embedding", 1)
    assert decide(spark, done, said, held, "prompt_v2", "new_embed_v2") == ("rerun_description", 1)
    assert decide(spark, done, (), (), "prompt_v2", "new_embed_v2") == ("reuse_all", 1)
    for state in ("synced", "uploaded"):
        assert decide(spark, [(1, "m", state)], said, held) == ("reuse_all", 1)
    for state in ("discovered", "preview_ready", "preview_failed", "description_failed", "embedding_ready", "package_ready", "registered"):
        assert decide(spark, [(1, "m", state)]) == ("resume", 1)
    assert decide(spark, [(1, "m", "preview_failed"), (2, "m", "preview_ready")]) == ("resume", 2)
    assert decide(spark, [(1, "m", "mystery")]) == ("new", None)


def test_registration_tiers(spark):
    tasks = spark.createDataFrame(
        [(1, "s1", "shop", "k1", "m1", "committed", 5), (2, "s1", "other", "k2", "m2", "committed", 9), (3, "s3", "shop", "k3", "m3", "discovered", 1), (4, "", "shop", "k4", "m1", "committed", 7)],
        "id int, source_resource_id string, source string, idempotency_key string, content_md5 string, process_state string, at int").withColumn("updated_at", F.timestamp_seconds("at"))
    requests = spark.createDataFrame(
        [("a", "s1", "shop", "k3", "m3"), ("b", " s1 ", "third", "", ""), ("c", "", "shop", "k3", "m1"), ("d", "s9", "", "none", "m1"), ("e", "", "", "", "m3"), ("f", None, None, None, None)],
        "req_id string, source_resource_id string, source string, idempotency_key string, content_md5 string")
    got = {r["req_id"]: (r["tier"], r["task_id"]) for r in S.registration_match(requests, tasks).collect()}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (3, 3), "d": (4, 4), "e": (0, None), "f": (0, None)}


def test_stage_plan(spark):
    rows = [(1, "discovered", "single_image"), (2, "preview_ready", "audio_file"), (3, "discovered", "audio_file"), (4, "description_ready", "audio_file"), (5, "committed", "pack"), (6, None, None)]
    tasks = spark.createDataFrame(rows, "id int, process_state string, resource_type string")
    plan = lambda resume: {(r["id"], r["stage"]): r["decision"] for r in S.stage_plan(tasks, resume).collect()}
    on, off = plan(True), plan(False)
    assert on[1, "preview"] == on[3, "preview"] == "process" and on[2, "preview"] == "skip_done" and off[2, "preview"] == "process"
    assert on[2, "description"] == "skip_audio" and on[3, "description"] == "skip_not_ready" and on[4, "description"] == "skip_done" and off[4, "description"] == "skip_audio" and off[5, "description"] == "process"
    assert on[4, "upload"] == "process" and on[5, "upload"] == off[5, "upload"] == "skip_done" and on[6, "upload"] == "skip_not_ready"


def test_checks_of_descriptions(spark):
    good = "主体：" + "字" * 60 + "\n细节：" + "体" * 60
    code = lambda e: (lambda x: x and (x["code"], x["message"]))(values(spark, e=e)[0])
    assert code(X.format_error(F.lit(f"  {good}\n"))) is None and code(X.length_error(F.lit(good))) is None
    assert code(X.format_error(F.lit("主体：a"))) == ("FORMAT_ERROR", "期望2行，实际1行")
    assert code(X.format_error(F.lit("a\n细节：b"))) == ("FORMAT_ERROR", "第一行必须以'主体：'开头")
    assert code(X.format_error(F.lit("主体：a\n细节:b"))) == ("FORMAT_ERROR", "第二行必须以'细节：'开头")
    assert code(X.length_error(F.lit("主体：ab\n细节：c"))) == ("TOO_SHORT", "描述字数 3 不足最低 100")
    assert code(X.length_error(F.lit("x" * 221))) == ("TOO_LONG", "描述字数 221 超过上限 220")
    assert code(X.keyword_error(F.lit("x"), F.lit("image"))) == ("MISSING_KEYWORD", "描述中缺少资源类型关键词，期望包含 ['图片', '图像', 'image', '照片', '插画'] 之一")
    assert code(X.keyword_error(F.lit("x"), F.lit("other"))) is None and code(X.keyword_error(F.lit("3D"), F.lit("3d_model"))) is None
    assert code(X.description_error(F.lit(good), F.lit("image")))[0] == "MISSING_KEYWORD" and code(X.description_error(F.lit("x"), F.lit("image")))[0] == "FORMAT_ERROR"


def test_parsed_outputs(spark):
    parse = lambda text: values(spark, **dict(zip(("a", "b"), X.parsed_output(F.lit(text)), strict=True)))
    assert parse("主体：甲\n细节：乙") == ("甲", "乙") and parse("主体:old\n主体： new \n细节: d ") == ("new", "d")
    assert parse(" only ") == ("only", "only") and parse("a\n\nc") == ("a", "") and parse("") == ("", "")
    assert parse("主体：甲") == ("甲", "甲") and parse("主体：\nb") == ("主体：", "b") and parse("x\n细节：乙") == ("x", "乙")
    parts = '[{"type": "text", "text": "主体：甲"}, {"type": "image"}, {"text": "细节：乙"}]'
    assert values(spark, a=X.message_text(F.lit(parts)), b=X.message_text(F.lit("[not json"))) == ("主体：甲\n细节：乙", "[not json")


def test_keys_types_and_contexts(spark):
    empty = F.lit("")
    assert values(spark, a=X.resume_key(F.lit(" "), F.lit("m"), empty, empty), b=X.resume_key(empty, empty, empty, F.lit(" t "))) == ("source: ", "title: t ")
    kinds = [X.type_of_formats(F.array(*map(F.lit, f))) for f in (["blend"], ["stl"], ["SVG"], ["png", "fbx"], ["ogg"])]
    assert values(spark, **{f"k{i}": k for i, k in enumerate(kinds)}) == ("model", "other", "image", "model", "other")
    assert values(spark, a=X.cleaned(F.lit("　 a \n b\x1c ")), b=X.cleaned(F.lit(" \n "))) == ("a b", None)
    fields = {"resource_type": F.lit("pack"), "title": F.lit("T"), "pack_name": empty, "source_tags": F.array(F.lit("a"), empty, F.lit("b")), "member_count": F.lit(0), "preview_strategy": F.lit("static"), "missing_file_ratio": F.lit(0.256)}
    more = F.create_map(F.lit("k"), F.lit("v"), F.lit("n"), empty)
    assert values(spark, a=X.prompt_context(fields, more)) == ("资源类型: pack\n资源标题: T\n来源标签: a, b\n预览策略: static\n缺失文件比例: 0.26\nk: v",)


def test_fill_empty_keeps_what_is_there(spark):
    tasks = spark.createDataFrame([(1, "", "own", "[]", 0, "x"), (2, None, "", "", 4, "y"), (3, "s", "t", "[1]", 0, "z")], "id int, source string, title string, tags_json string, child_resource_count int, other string")
    requests = spark.createDataFrame([(1, "new", "new", '["a"]', 7), (2, "new", "", "[]", 9)], "id int, source string, title string, tags_json string, child_resource_count int")
    got = sorted(map(tuple, R.fill_empty(tasks, requests).collect()))
    assert got == [(1, "new", "own", '["a"]', 7, "x"), (2, "new", "", "", 4, "y"), (3, "s", "t", "[1]", 0, "z")]


def test_upsert_and_backfill(spark):
    tasks = spark.createDataFrame([(1, "m1", "s1"), (2, "m1", "s2"), (3, "m3", "")], "id int, content_md5 string, source_resource_id string")
    asked = spark.createDataFrame([("a", "m1", "s9"), ("b", "new", "s2"), ("c", "new", ""), ("d", "m3", "s1")], "req_id string, content_md5 string, source_resource_id string")
    done = R.upsert(asked, tasks)
    assert {r["req_id"]: (r["task_id"], r["is_existing"]) for r in done.collect()} == {"a": (1, True), "b": (2, True), "c": (None, False), "d": (3, True)}
    new = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", "p3"), ("c", "p4")], "req_id string, path string")
    held = spark.createDataFrame([(1, "old")], "task_id int, path string")
    assert sorted(map(tuple, R.files_to_backfill(done, new, held).collect())) == [(2, "p2"), (2, "p3")]


def test_relationships_and_enriched_hits(spark):
    tasks = spark.createDataFrame(
        [(1, "res-1", "s1", None, ["s3", "gone", "s2"]), (2, "res-2", "s2", "s1", []), (3, "res-3", "s3", "s1", []), (4, None, "s4", "s9", ["s1"])],
        "id int, resource_id string, source_resource_id string, parent_source_resource_id string, child_source_resource_ids array<string>")
    got = {r["id"]: (r["parent_resource_id"], r["child_resource_ids"]) for r in R.relationships(tasks).collect()}
    assert got == {1: (None, ["res-3", "res-2"]), 2: ("res-1", []), 3: ("res-1", []), 4: (None, ["res-1"])}

    own = spark.createDataFrame([(1, "res-1", "P", "zip/1"), (2, "res-2", "C", None)], "id int, resource_id string, title string, download_key string")
    own = own.withColumns({"process_state": F.lit("committed"), "source_resource_id": F.lit("s"), "parent_resource_id": F.when(F.col("id") == 2, "res-1")})
    files = spark.createDataFrame([(2, 1, ".PNG", 5, "a/x.png"), (2, 2, " ", 6, "a/y")], "task_id int, ord int, format string, size int, path string")
    previews = spark.createDataFrame([(2, 2, "p/b.webp"), (2, 1, "p/a.webp"), (2, 3, "q/b.webp"), (1, 7, "r/c.webp")], "task_id int, id int, path string")
    said = spark.createDataFrame([(2, 1, "old"), (2, 2, "new")], "task_id int, id int, main string")
    hits = spark.createDataFrame([("res-2", 0.9), ("res-9", 0.8), ("res-1", 0.7)], "resource_id string, score double")
    found = {r["resource_id"]: r.asDict() for r in enrich(hits, own, said, files, previews).collect()}
    assert set(found) == {"res-1", "res-2"}
    c, p = found["res-2"], found["res-1"]
    assert (c["description"], c["file_count"], c["file_size"], c["file_format"], c["download_key"]) == ("new", 2, 11, "png", "files/res-2/x.png")
    assert (c["primary_preview"], c["other_previews"]) == ("previews/res-2/a.webp", ["previews/res-2/b.webp"])
    assert (c["parent_title"], c["parent_preview"], c["parent_download_key"]) == ("P", "previews/res-1/c.webp", "zip/1")
    assert (p["download_key"], p["file_count"], p["parent_title"], p["parent_preview"]) == ("zip/1", 0, "", "")


def test_search_by_kind_threshold_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, None, "a"), (5, [float("nan"), 0.0], "a"), (6, [1.0], "a"), (7, [], "a"), (8, [None, 1.0], "a")]
    vectors = spark.createDataFrame(rows, "resource_id long, vector array<float>, kind string")
    asked = spark.createDataFrame([(10, [1.0, 0.0], None), (11, [1.0, 0.0], "a"), (12, None, "a"), (13, [1.0, 0.0], "none")], "query_id long, vector array<float>, kind string")
    got = sorted((r["query_id"], r["rank"], r["resource_id"]) for r in cosine_top_k(vectors, asked, 2).collect())
    assert got == [(10, 1, 1), (10, 2, 2), (11, 1, 1), (11, 2, 3)]
    assert sorted((r["query_id"], r["resource_id"]) for r in cosine_top_k(vectors, asked, 2, 0.5).collect()) == [(10, 1), (10, 2), (11, 1)]
