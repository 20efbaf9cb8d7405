"""Expressions on small hand-made rows."""

from pyspark.sql import functions as F

from assetflow.functions import expressions as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_natural_order(spark):
    names = ["b.png", "a-10.png", "a-2.png", "a.png", "a-02.png", "10", "9"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in rows] == ["9", "10", "a-02.png", "a-2.png", "a-10.png", "a.png", "b.png"]


def test_paths(spark):
    assert one(spark, X.normal_path(F.lit("/a/./b//../c"))) == "/a/c"
    assert one(spark, X.normal_path(F.lit("../a"))) == "a"
    assert one(spark, X.sanitized(F.lit('a<b>:"/\\|?*c'))) == "a_b________c"
    assert one(spark, X.directory_role(F.lit("m/wall_Normal.PNG"))) == "texture"


def test_output_lines(spark):
    main, detail = X.parsed_output(F.lit("主体：old\n细节: d\n主体:new"))
    assert (one(spark, main), one(spark, detail)) == ("new", "d")
    main, detail = X.parsed_output(F.lit("first\n second "))
    assert (one(spark, main), one(spark, detail)) == ("first", " second")


def test_even_sample_keeps_both_ends(spark):
    assert one(spark, X.even_sample(F.array(*map(F.lit, range(10))), 4)) == [0, 3, 6, 9]


def test_keys(spark):
    empty = F.lit(" ")
    assert one(spark, X.idempotency_key(empty, empty, F.lit("p"), F.lit("t"))) == "crawler-register:path:p"
    assert one(spark, X.resume_key(empty, empty, empty, empty)) == "source: " and one(spark, X.resume_key(*[F.lit("")] * 4)) == ""
    assert one(spark, X.state_ordinal(F.lit("nothing"))) == -1 and one(spark, X.state_ordinal(F.lit("synced"))) == 11


def test_fingerprint_of_odd_texts(spark):
    import hashlib
    import json

    odd = "".join(map(chr, range(1, 32))) + '"\\/é漢\x7f\u2028'
    record = {"id": odd, "source": "s", "pack_name": "", "resource_type": "t", "resource_path": "p\tq", "member_count": 2, "file_paths": ["a", odd]}
    text = {k: F.lit(v) for k, v in record.items() if isinstance(v, str)}
    made = X.fingerprint(text["id"], text["source"], text["pack_name"], text["resource_type"], text["resource_path"], F.lit(2), F.array(*map(F.lit, record["file_paths"])))
    assert one(spark, made) == hashlib.md5(json.dumps(record, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
