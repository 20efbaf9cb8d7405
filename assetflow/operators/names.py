"""Names for copies of files, none of which clashes with another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.sources.files import with_ids
from assetflow.streaming.progress import removed, state_folder

# The folders that files are copied to, by extension in lower case; any other goes to the last.
CATEGORIES = {"images": [".jpg", ".jpeg", ".png", ".gif"], "models": [".obj", ".fbx", ".stl"]}
OTHERS = "others"

#: A name's stem and extension, and a stem that ends like one that was given a number.
_PARTS, _NUMBERED = r"(?s)^(.+)(\.[^.]+)$", r"(?s)^(.+)_([1-9][0-9]{0,17})$"


def stem(name: Column) -> Column:
    return F.when(F.rlike(name, F.lit(_PARTS)), F.regexp_extract(name, _PARTS, 1)).otherwise(name)


def suffix(name: Column) -> Column:
    """The extension with its dot; empty without one."""
    return F.regexp_extract(name, _PARTS, 2)


def category(name: Column) -> Column:
    ext = F.lower(suffix(name))
    return F.coalesce(*(F.when(ext.isin(known), F.lit(kind)) for kind, known in CATEGORIES.items()), F.lit(OTHERS))


def _numbered(rows: DataFrame, keys: list[str], *order: str, folder: str | None = None) -> DataFrame:
    """rows with n, from 1 on in order within the keys: ranges of all rows are numbered, so that many rows of one key are no single group.

    What is written for that stands in the folder, or in a new one.
    """
    named = rows.withColumnRenamed("id", "__id")
    ids = with_ids(named, folder or state_folder(rows.sparkSession, "numbered"), *keys, *("__id" if c == "id" else c for c in order))
    starts = ids.groupBy(*keys).agg(F.min("id").alias("__start"))
    return ids.join(starts, keys).withColumn("n", F.col("id") - F.col("__start") + 1).drop("id", "__start").withColumnRenamed("__id", "id")


def unique_names(files: DataFrame, category: Column, name: Column, *order: str) -> DataFrame:
    """files with category, name and target, the name of its copy: as if they were copied to their category's folder in order, one by one.

    The first file takes its name as it is, unless an earlier one was given that name; any other takes
    <stem>_<k> and the extension in lower case, k the least number from 1 on whose name isn't taken by then, be it
    by a file that was given it or by one that has it (a_1.png) of its own.  So no two files of a category share a target.

    Numbers are ranks against the complement of the taken ones.  Which files keep a numbered name of
    their own depends on the files before them alone; from the assumption that all do, decisions are made anew from
    those of the round before until none changes, which takes as many rounds as such decisions hang on
    each other (mostly two).  Hot names are split by ranges.  A null category counts as the empty one; a null name
    has no target.  order must tell all rows apart, else equal ones may swap targets; columns named like the new ones are replaced.
    """
    spark = files.sparkSession
    own = [c for c in files.columns if c not in ("category", "name", "target")]
    # columns of the order that stand in the row aren't written again
    more_order = {o: f"o{i}" for i, o in enumerate(order) if o not in own}
    rows = files.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.coalesce(category.cast("string"), F.lit("")).alias("c"), name.cast("string").alias("name"), *(F.col(f"`{o}`").alias(n) for o, n in more_order.items()))
    rows = with_ids(rows, state_folder(spark, "named"), *(more_order.get(o, f"row.`{o}`") for o in order), "name")
    scratch: dict[str, list[str]] = {}

    def stored(name: str, make: Callable[[str], DataFrame]) -> DataFrame:
        """What make(folder) gives, as a table; what stood for that name before is removed, and what it wrote into the folder."""
        folder, path = state_folder(spark, "numbered"), state_folder(spark, name)
        made = make(folder)
        made.write.parquet(path)
        for old in (folder, *scratch.get(name, [])):
            removed(spark, old)
        scratch[name] = [path]
        return spark.read.schema(made.schema).parquet(path)

    named = rows.where("name is not null").select("id", "c", "name", stem(F.col("name")).alias("stem"), suffix(F.col("name")).alias("ext"))
    first = named.groupBy("c", "name").agg(F.min("id").alias("id"), F.first("stem").alias("stem"), F.first("ext").alias("ext"))
    more = named.select("id", "c", "stem", F.lower("ext").alias("ext")).join(first.select("id"), "id", "left_anti")
    # a first file whose name is one that a file of another name (c, stem, ext) may be given, with number k
    literal = first.where((F.lower("ext") == F.col("ext")) & F.rlike("stem", F.lit(_NUMBERED))).select(
        "c", F.regexp_extract("stem", _NUMBERED, 1).alias("stem"), "ext", F.regexp_extract("stem", _NUMBERED, 2).cast("bigint").alias("k"), F.col("id").alias("at"), F.col("stem").alias("own"))
    group = ["c", "stem", "ext"]
    literal_rows = literal.join(named.select("c", "stem", F.lower("ext").alias("ext")).distinct(), group, "left_semi")
    literal = stored("literal", lambda folder: _numbered(literal_rows, group, "k", folder=folder).withColumnRenamed("n", "place").withColumn("keeps", F.lit(True)))
    n_rounds = 0
    while True:
        moved = literal.where("not keeps").select(F.col("at").alias("id"), "c", F.col("own").alias("stem"), "ext")
        all_more = more.unionByName(moved)
        over = stored("moved", lambda folder, rows=all_more: _numbered(rows, group, "id", folder=folder))
        before = F.when(F.col("keeps"), F.col("n") - 1).otherwise(F.col("place") - F.col("n"))  # smaller numbers that keep their names

        def decided(folder: str, literal: DataFrame = literal, over: DataFrame = over, before: Column = before) -> DataFrame:
            asked = _numbered(literal, [*group, "keeps"], "k", folder=folder).withColumn("n", F.col("k") - before)
            comes = asked.join(over.select(*group, "n", F.col("id").alias("comes")), [*group, "n"], "left")
            return comes.select(*group, "k", "at", "own", "place", (~F.coalesce(F.col("comes") < F.col("at"), F.lit(False))).alias("keeps"))

        again = stored(f"literal-{n_rounds % 2}", decided)
        n_rounds += 1
        changed = again.join(literal.select("at", F.col("keeps").alias("kept")), "at").where("keeps <> kept").limit(1).count()
        literal = again
        if not changed:
            break
    # the free numbers below a kept k, its place among the kept taken off, order both kinds together: a file's place is its number
    kept = _numbered(literal.where("keeps"), group, "k").select(*group, (F.col("k") - F.col("n")).alias("value"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("moved"))
    both = _numbered(over.select(*group, F.col("n").alias("value"), F.lit(0).alias("kind"), F.col("id").alias("moved")).unionByName(kept), group, "value", "kind", "moved")
    given = both.where("kind = 0").select(F.col("moved").alias("id"), F.concat("stem", F.lit("_"), "n", "ext").alias("given"))
    return rows.join(given, "id", "left").select("row.*", F.col("c").alias("category"), "name", F.coalesce("given", "name").alias("target"))

