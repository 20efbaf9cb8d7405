"""Entries of a catalogue on small hand-made rows."""

from pyspark.sql import functions as F

from assetflow.functions import expressions as X
from assetflow.operators import entities as E
from assetflow.operators import selection as S


def test_matching_filters_after_the_first_of_each_id(spark):
    rows = [("a", 1, "pack", "Web"), ("a", 2, "image", "web"), ("b", 3, " IMAGE ", " WEB"), ("c", 4, "image", "other"), ("d", 5, "image", "web")]
    entries = spark.createDataFrame(rows, "id string, seq int, resource_type string, source string")
    got = [(r["id"], r["matching"]) for r in E.matching(entries, "Image", "web").orderBy("seq").collect()]
    assert got == [("b", 2), ("d", 2)]
    assert [(r["id"], r["matching"]) for r in E.matching(entries, "image", "web", 1).collect()] == [("b", 2)]
    assert E.matching(entries).count() == 4 and E.matching(entries.limit(0)).count() == 0


def test_assets_by_id_then_by_path(spark):
    assets = spark.createDataFrame(
        [("a1", "s", "p", "x", "png", "", ""), ("a2", "s", "p", "x", "wav", "", ""), ("a3", "s", "q", "x", "ogg", "", ""), ("a4", "s", "p", "y", "fbx", "", "")],
        "asset_id string, source string, pack_name string, file_path string, fmt string, style string, theme string")
    entries = spark.createDataFrame(
        [(1, ["a4", "none", "a1"], ["x"]), (2, ["none"], ["x", "y", "x", "x"]), (3, [], ["z"]), (4, None, None)], "id int, asset_ids array<string>, file_paths array<string>").withColumns({"source": F.lit("s"), "pack_name": F.lit("p")})
    got = {r["id"]: [a["asset_id"] for a in r["assets"]] for r in E.resolve_assets(entries, assets).collect()}
    assert got == {1: ["a4", "a1"], 2: ["a1", "a4", "a2"], 3: [], 4: []}


def test_packs_complete_descriptions_and_tags(spark):
    entries = spark.createDataFrame([("s", "a:b", "", ["x", " y "]), ("s", "a:b", "own", None), ("t", "a:b", "", [])], "source string, pack_name string, description string, tags array<string>")
    packs = spark.createDataFrame([("s", "a_b", "pack's", ["y", "z"])], "source string, pack string, description string, tags array<string>")
    got = sorted((r["source"], r["description"], r["tags"]) for r in E.with_packs(entries, packs).collect())
    assert got == [("s", "own", ["y", "z"]), ("s", "pack's", ["x", "y", "z"]), ("t", "", [])]


def test_roles_paths_and_folders(spark):
    def roles(kind, own, paths):
        row = spark.createDataFrame([(kind, own, paths)], "k string, o string, p array<string>").select(E.file_roles(F.col("k"), F.col("o"), F.col("p")).alias("f")).first()
        return [(f["role"], f["is_primary"]) for f in row["f"]]

    assert roles("pack", "", ["a/x.png", "a/y.ogg"]) == [("main", True), ("attachment", False)]
    assert roles("pack", "z/Y.PNG", ["a/x.png", "a/y.png"]) == [("main", False), ("main", True)]
    assert roles("pack", "gone.png", ["a/x.png", "a/y.png"]) == [("main", True), ("main", False)]
    assert roles("audio_file", "b.png", ["a.wav", "b.png"]) == [("audio", True), ("audio", True)] and roles("tileset", "", []) == []
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    paths = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    assert one(E.preferred_path(F.lit("a.b/c"), paths("f"))) == "f" and one(E.preferred_path(F.lit("a/.hidden"), paths())) == "" and one(E.preferred_path(F.lit("a/b.c"), paths("f"))) == "a/b.c"
    assert one(E.source_directory(paths("/r/a/x", "/r/a/b/y"), F.lit(""), F.lit("p"))) == "/r/a" and one(E.source_directory(paths("r/ab/x", "r/ac/y"), F.lit(""), F.lit("p"))) == "r"
    assert one(E.source_directory(paths(), F.lit(""), F.lit("p"))) == "p" and one(E.source_directory(paths(), F.lit("o"), F.lit("p"))) == "o"
    assert one(X.type_filter(F.lit(" Pack"))) == "pack" and one(X.type_filter(F.lit("x"))) == "" and one(X.format_filter(paths(" .PNG", "png", " "))) == ["png"]


def test_stage_totals(spark):
    rows = [("success", 2, 1), ("success", None, None), ("failed", 1, 1), ("skipped_no_files", 0, 1), ("skipped_no_description", 0, 0), ("skipped", 0, 0)]
    results = spark.createDataFrame(rows, "verdict string, n_previews long, n_descriptions long")
    assert tuple(S.upload_summary(results).first()) == (2, 1, 3, 1, 1, 3, 3)
    assert tuple(S.upload_summary(results.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0)
    checks = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "category string, passed boolean")
    assert sorted(map(tuple, S.scorecard(checks, "category", "passed").collect())) == [("a", 3, 1, 1, 1, 0.5), ("b", 1, 0, 0, 1, 0.0)]
