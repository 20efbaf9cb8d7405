"""Line dedup by a deletion-neighbourhood join on words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: A line of so many words or more also goes when an earlier line is one word away (a word put in, left out or changed); shorter ones only when equal.
LEAST_WORDS = 8
#: Lines under suspicion, and keys that several lines share, that may be broadcast (up to about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: What separates words, beside the line feed.
BLANKS = " \t\x0B\f\r"


def _plain(line: Column) -> Column:
    """The line's words with one blank between them."""
    # searches for bytes: a pattern would have every line decoded and tried at each of its characters
    odd = reduce(Column.__or__, [line.contains(c) for c in ("  ", *BLANKS[1:])], line.startswith(" ") | line.endswith(" "))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line)


def _worded(line: Column) -> Column:
    """Whether the line has a word."""
    return F.trim(line, F.lit(BLANKS)) != ""


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, doc_hash (of the text), line_no (from 0) and line (as it stands) of every line with a word."""
    rows = documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    return rows.select("doc_id", "doc_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(_worded(F.col("line")))


def _halves(least: int) -> Column:
    """Keys of a line's first and last words, half as many as it has, and as it would have with one word less.

    Two lines that are one word apart agree on all before or all behind the odd word, so on the
    first or the last half of the shorter; a line that shares none of its keys has no such partner.
    Keys hold the length of the half: a line with an odd number of words has two, as both halves are one.
    """
    def keys(half: str) -> str:
        return f"xxhash64({half}, 'a', substring_index(line, ' ', {half})), xxhash64({half}, 'z', substring_index(line, ' ', -({half})))"

    both = f"array({keys('n div 2')}, {keys('n div 2 - 1')})"
    return F.expr(f"case when n > {least} and n % 2 = 0 then {both} when n >= {least} then array({keys('n div 2')}) else cast(array() as array<bigint>) end")


def _apart_by_one(x: str, y: str) -> Column:
    """Whether the word edit distance of two unequal word arrays is 1."""
    p = f"coalesce(array_position(zip_with({x}, {y}, (a, b) -> a <=> b), false) - 1, 0)"
    tail = lambda a, skip: f"slice({a}, cast({p} + 1 + {skip} as int), size({a}))"
    return F.expr(f"case size({x}) - size({y}) when 0 then {tail(x, 1)} = {tail(y, 1)} when 1 then {tail(x, 1)} = {tail(y, 0)} when -1 then {tail(x, 0)} = {tail(y, 1)} else false end")


def dropped_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines that go: doc_id, doc_hash (of the text), line_no, near (false: an earlier line is equal; true: one is a word away).

    Earlier means a smaller (doc_id, doc_hash, line_no).
    """
    place = F.struct("doc_id", "doc_hash", "line_no")
    lines = _lines(documents).withColumn("line", _plain(F.col("line"))).withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    made = lines.select(place.alias("pos"), "n", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), _halves(least_words).alias("keys"))
    made = written(made, "lines")
    distinct = made.groupBy("h", "g").agg(F.min("pos").alias("first"), F.max("n").alias("n"), F.max("keys").alias("keys"))
    distinct = written(distinct, "distinct-lines")
    equal = made.select("pos", "h", "g").join(distinct.select("h", "g", "first"), ["h", "g"]).where("pos > first").select("pos.*", F.lit(False).alias("near"))

    halves = distinct.select(F.col("first").alias("pos"), "h", "n", F.posexplode("keys").alias("k", "key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key")
    # a shared first half leaves the odd word to the positions behind it, a shared last half to those before it
    half = F.expr("n div 2 - k div 2")
    suspects = halves.join(shared, "key").groupBy("pos").agg(F.min(F.when(F.col("k") % 2 == 0, half)).alias("behind"), F.max(F.when(F.col("k") % 2 == 1, F.col("n") - half)).alias("before"))
    # ids rise with the positions: the earliest line of a key is then the least of plain numbers, which aggregates by hash
    suspects = written(suspects.sort("pos").select("pos.*", "behind", "before", F.monotonically_increasing_id().alias("id")), "suspect-lines")
    at_hand = F.broadcast(suspects) if suspects.count() <= BROADCAST_ROWS else suspects
    found = _lines(documents).join(at_hand, ["doc_id", "doc_hash", "line_no"]).dropDuplicates(["id"]).withColumn("line", _plain(F.col("line")))
    texts = written(found.select("id", place.alias("pos"), "line", F.size(F.split("line", " ")).alias("n"), "behind", "before"), "suspect-texts")

    spread = texts.select("id", "line", "n", F.explode(F.expr("filter(sequence(1, n), i -> i > behind or i <= before)")).alias("i"))
    rest = F.expr("trim(concat(substring_index(line, ' ', i - 1), ' ', substring_index(line, ' ', i - n)))")
    left_out = spread.select("id", "n", "i", rest.alias("rest")).select("id", "n", F.explode(F.array(
        F.struct(F.xxhash64(F.lit("s"), "i", "rest").alias("k"), F.xxhash64("rest", "i").alias("k2"), F.lit("s").alias("kind")),
        F.struct(F.xxhash64(F.lit("f"), "rest").alias("k"), F.xxhash64("rest", F.lit(0)).alias("k2"), F.lit("d").alias("kind")),
    )).alias("v")).where((F.col("v.kind") == "s") | (F.col("n") > least_words)).select("id", "v.*")
    whole = texts.select("id", F.xxhash64(F.lit("f"), "line").alias("k"), F.xxhash64("line", F.lit(0)).alias("k2"), F.lit("f").alias("kind"))
    variants = left_out.unionByName(whole)
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("id"))).alias(f"first_{kind}")
    meet = variants.groupBy("k", "k2").agg(first("s"), first("d"), first("f"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("lo", "hi")
    meet = written(meet, "meeting-variants")
    meet = F.broadcast(meet) if meet.count() <= BROADCAST_ROWS else meet
    earlier = F.when(F.col("kind") == "s", F.col("first_s")).when(F.col("kind") == "d", F.col("first_f")).otherwise(F.col("first_d"))
    pairs = variants.join(meet, ["k", "k2"]).select("id", earlier.alias("witness")).where("witness < id").distinct()
    words = F.split("line", " ")
    one, two = texts.select("id", "pos", words.alias("x")), texts.select(F.col("id").alias("witness"), words.alias("y"))
    near = pairs.join(one, "id").join(two, "witness").where(_apart_by_one("x", "y")).select("pos.*").distinct().withColumn("near", F.lit(True))
    return equal.unionByName(near)


def line_dedup(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without lines that stand earlier in the corpus: text is what is left, and the
    columns n_lines, n_equal and n_near (lines with a word; those dropped) are added or replaced.

    Lines compare as their words; lines without a word stay and count for nothing.  A line goes when
    any line before it, by (doc_id, hash of the text, line_no), is equal or, from least_words words on
    in both, within one word of it, whether that line itself stays or not.  Every variant with one word
    left out becomes a hashed key; the earliest line of each key is found by a partial aggregation, so a
    key that very many lines share is never gathered, and what meets is verified on the words.  Only
    lines that share a half with another emit variants, which loses none.  Rows with a null doc_id take
    no part and stay as they are.  Rows that share doc_id and text are one document: they lose the same
    lines and none to each other; rows that share only the doc_id are documents of their own.  A null
    text stays null.  Other columns stay, whatever their names.
    """
    by = dropped_lines(documents, least_words).groupBy("doc_id", "doc_hash")
    gone = by.agg(F.collect_set("line_no").alias("__gone"), F.count_if(~F.col("near")).alias("__equal"), F.count_if("near").alias("__near"))
    gone = gone.withColumnsRenamed({"doc_id": "__doc", "doc_hash": "__hash"})
    kept = documents.drop("n_lines", "n_equal", "n_near")
    joined = kept.join(gone, (kept["doc_id"] == gone["__doc"]) & (F.xxhash64(kept["text"]) == gone["__hash"]), "left")
    lines = F.split("text", "\n")
    # the lines are split once for a text: within the outer function they have a name
    rest = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i)), "\n"))
    left = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(rest, 0))
    worded = F.coalesce(F.size(F.filter(lines, _worded)), F.lit(0))
    columns = [left.alias("text") if c == "text" else kept[c] for c in kept.columns]
    counts = [F.coalesce(f"__{c}", F.lit(0)).alias(f"n_{c}") for c in ("equal", "near")]
    return joined.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(worded).cast("bigint").alias("n_lines"), *counts)


#: The digest of the query over a table documents, as DuckDB SQL.
SQL = rf"""
    WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
    w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS ws FROM e),
    p AS (SELECT ws, len(ws) AS n, min(row(doc_id, line_no)) AS pos FROM w WHERE len(ws) > 0 GROUP BY ws),
    v AS (SELECT pos, n, i, list_concat(ws[1:i - 1], ws[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p WHERE n >= {LEAST_WORDS})),
    s AS (SELECT pos, pos > min(pos) OVER (PARTITION BY i, rest) AS goes FROM v),
    j AS (SELECT v.pos AS longer, p.pos AS shorter FROM v JOIN p ON v.rest = p.ws WHERE v.n > {LEAST_WORDS}),
    near AS (SELECT pos FROM s WHERE goes UNION SELECT longer FROM j WHERE longer > shorter UNION SELECT shorter FROM j WHERE shorter > longer),
    f AS (SELECT w.doc_id, w.line_no, row(w.doc_id, w.line_no) > p.pos AS equal, row(w.doc_id, w.line_no) = p.pos AND near.pos IS NOT NULL AS close
          FROM w JOIN p ON w.ws = p.ws LEFT JOIN near ON near.pos = p.pos),
    k AS (SELECT e.doc_id, coalesce(string_agg(line, chr(10) ORDER BY e.line_no) FILTER (WHERE NOT coalesce(equal OR close, false)), '') AS text,
          count(equal) AS n_lines, count_if(coalesce(equal, false)) AS n_equal, count_if(coalesce(close, false)) AS n_near
          FROM e LEFT JOIN f ON e.doc_id = f.doc_id AND e.line_no = f.line_no GROUP BY e.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near, md5(k.text) AS text_md5
    FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""
