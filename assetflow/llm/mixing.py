"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

#: Weights of the sources in code-point order, repeating; null stands last.
WEIGHTS = (5, 2, 1)
#: Documents in a block on average, and block draws in an output shard on average.
BLOCK_ROWS = 32
SHARD_BLOCKS = 8
#: Ranges of hashes over which a source's prefix sums are taken first, so that no task scans all of a source.
RANGES = 1024


def _hash(*parts: Column | str) -> Column:
    """60 uniform bits from the text of the parts."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """A row per source: source, source_rank, n_rows, source_size, target (words).

    The sources share `share` of all sizes by weight; a target stops at `most` times its source's
    size and the excess goes to the others by weight, until none is above.  Sources fill up in the
    order of size / weight, so prefix sums over that order find those that stop.  Its rows are as
    many as the sources.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    by = by.withColumn("source_rank", rank).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "source_rank")
    by = by.withColumns({
        "before": F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    by = by.withColumn("full", cap * F.col("w_left") <= F.col("w") * (F.col("total") * share - F.col("before")))
    all_ = Window.partitionBy()
    level = (F.sum("source_size").over(all_) * share - F.sum(F.when(F.col("full"), cap).otherwise(0)).over(all_)) / F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(all_)
    return by.select("source", "source_rank", "n_rows", "source_size", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("w") * level).alias("target"))


def _running(df: DataFrame, key: str, order: Column, tie: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of equal key (null too) before each, by order (60 bits) and tie.

    The sums of RANGES hash ranges are scanned first, then each range by itself.
    """
    placed = df.withColumns({"__order": order, "__value": value}).withColumn("__range", F.floor(F.col("__order") / ((1 << 60) // RANGES)))
    sums = placed.groupBy(key, "__range").agg(F.sum("__value").alias("__sum"))
    upto = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "__range", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__start"))
    within = Window.partitionBy(key, "__range").orderBy("__order", tie).rowsBetween(Window.unboundedPreceding, -1)
    both = _same(placed, starts, key, "__range").withColumn(name, F.col("__start") + F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return both.drop("__order", "__value", "__range", "__start")


def _hypergeometric(good: str, bad: str, draws: str, seed: str) -> str:
    """SQL: how many good ones are among so many drawn without replacement, by inversion.

    From the mode outwards each probability follows from its neighbour's by a ratio, relative to the
    mode's: up to nine deviations and 40 steps, beyond which the rest is less than a step of the 52-bit
    uniform number.  The steps grow with the deviation, as the root of the draws; no state but two sums is held.
    """
    u = f"(cast(conv(substring(md5(concat_ws(':', {seed})), 1, 13), 16, 10) as double) + 0.5) / 4503599627370496"
    up = "(z.g - (z.m + i) + 1d) * (z.d - (z.m + i) + 1d) / ((z.m + i) * (z.b - z.d + z.m + i))"
    down = "(z.m - i + 1d) * (z.b - z.d + z.m - i + 1d) / ((z.g - z.m + i) * (z.d - z.m + i))"
    steps = lambda n: f"if({n} > 0, sequence(1L, {n}), cast(array() as array<bigint>))"
    total = lambda n, ratio: f"aggregate({steps(n)}, named_struct('w', 1d, 's', 0d), (a, i) -> named_struct('w', a.w * ({ratio}), 's', a.s + a.w * ({ratio})), a -> a.s)"
    find = lambda n, ratio, rest: (
        f"aggregate({steps(n)}, named_struct('w', 1d, 's', 0d, 'k', 0L), (a, i) -> if(a.s >= {rest} and a.k > 0, a, named_struct('w', a.w * ({ratio}), 's', a.s + a.w * ({ratio}), 'k', i)), a -> a.k)")
    let = lambda fields, name, body: f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"
    n = f"cast({good} + {bad} as double)"
    far = f"cast(ceil(9 * sqrt({draws} * ({good} / {n}) * ({bad} / {n}) * (({n} - {draws}) / greatest({n} - 1, 1d)))) as bigint) + 40"
    mode = f"cast(floor(({draws} + 1d) * ({good} + 1d) / ({n} + 2)) as bigint)"
    inner = let("'t', y.u * (1 + y.up + y.down), 'up', y.up", "t", f"case when t.t <= 1 then z.m when t.t <= 1 + t.up then z.m + {find('y.n', up, '(t.t - 1)')} else z.m - {find('y.k', down, '(t.t - 1 - t.up)')} end")
    sums = let(f"'u', {u}, 'n', x.n, 'k', x.k, 'up', {total('x.n', up)}, 'down', {total('x.k', down)}", "y", inner)
    limits = let("'n', least(z.f, least(z.g, z.d) - z.m), 'k', least(z.f, z.m - greatest(0L, z.d - z.b))", "x", sums)
    drawn = let(f"'g', {good}, 'b', {bad}, 'd', {draws}, 'm', {mode}, 'f', {far}", "z", limits)
    return f"case when {good} = 0 or {draws} = 0 then 0L when {bad} = 0 then {draws} else {drawn} end"


def splitting_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """Quotas of 2 ** levels shards: shard, quotas (array of source, quota > 0, start).

    quotas: one row with an array of struct<source int, quota bigint, start bigint>, an entry for each
    source.  A node gives half of its draws to its left child; how many of each source is a
    multivariate-hypergeometric draw, made source after source, and the right child gets the rest, so the
    shards' quotas add up to the sources'.  start is where a node's draws begin among its source's, so the
    leaves are disjoint runs.  Entries without a quota go at every level: no level holds more than its draws.
    """
    tree = quotas.select(F.lit(0).cast("bigint").alias("shard"), "quotas")
    for level in range(levels):
        x = _hypergeometric("e.quota", "(acc.rest - e.quota)", "acc.draws", f"'{level}', shard, e.source")
        begin = "named_struct('rest', aggregate(quotas, 0L, (a, e) -> a + e.quota), 'draws', aggregate(quotas, 0L, (a, e) -> a + e.quota) div 2, 'out', cast(array() as array<bigint>))"
        step = f"(acc, e) -> element_at(transform(array({x}), n -> named_struct('rest', acc.rest - e.quota, 'draws', acc.draws - n, 'out', array_append(acc.out, n))), 1)"
        tree = tree.withColumn("left", F.expr(f"aggregate(quotas, {begin}, {step}, acc -> acc.out)"))
        one = "filter(zip_with(quotas, left, (e, n) -> named_struct('source', e.source, 'quota', n, 'start', e.start)), e -> e.quota > 0)"
        two = "filter(zip_with(quotas, left, (e, n) -> named_struct('source', e.source, 'quota', e.quota - n, 'start', e.start + n)), e -> e.quota > 0)"
        halves = f"array(named_struct('shard', shard * 2, 'quotas', {one}), named_struct('shard', shard * 2 + 1, 'quotas', {two}))"
        tree = tree.select(F.explode(F.expr(halves)).alias("n")).select("n.shard", "n.quotas")
        tree = written(tree, "mixing-tree")
    return tree


def _same(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
    """Inner join on the names, nulls equal."""
    right = right.withColumnsRenamed({n: f"__r_{n}" for n in names})
    on = None
    for n in names:
        here = left[n].eqNullSafe(right[f"__r_{n}"])
        on = here if on is None else on & here
    return left.join(right, on).drop(*(f"__r_{n}" for n in names))


def draws(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, block draws) of a mix: rows has doc_id, source, block, size, source_size, target; draws has
    source, block, pass (from 1), words (of the block that this pass takes), block_size, shard.

    Each source's documents fall into blocks by a hash of doc_id, so a source with a third of all
    rows is as many even blocks.  A mix takes a source's whole blocks as often as its target holds
    its size, then permuted blocks up to the rest; the last of these only in part.
    """
    sizes = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sizes = written(sizes, "mixing-sizes")
    by = written(targets(sizes, weights, share, most), "mixing-targets")
    block = F.pmod(_hash(F.lit("block"), "doc_id"), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("bigint")
    rows = _same(sizes, F.broadcast(by) if by.count() < 100_000 else by, "source").withColumn("block", block)

    blocks = rows.groupBy("source", "source_rank", "source_size", "target", "block").agg(F.sum("size").alias("block_size"))
    wanted = F.round("target").cast("bigint")
    passes = F.coalesce(F.expr("try_divide(round(target), source_size)"), F.lit(0)).cast("bigint")
    blocks = _running(blocks, "source_rank", _hash(F.lit("order"), "source", "block"), "block", F.col("block_size"), "before")
    part = F.greatest(F.lit(0), F.least(F.col("block_size"), wanted - passes * F.col("source_size") - F.col("before")))
    drawn = blocks.select("source", "source_rank", "block", "block_size", F.posexplode(F.concat(F.array_repeat("block_size", passes.cast("int")), F.array(part))).alias("pass", "words"))
    drawn = drawn.where("words > 0").withColumn("pass", F.col("pass") + 1)
    drawn = written(_running(drawn, "source_rank", _hash(F.lit("draw"), "source", "pass", "block"), "block", F.lit(1).cast("bigint"), "place"), "mixing-draws")

    per = drawn.groupBy("source_rank").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("source_rank").alias("source"), F.col("n").alias("quota"), F.lit(0).cast("bigint").alias("start"))
    n = drawn.count()
    levels = max(0, (max(1, n // SHARD_BLOCKS) - 1).bit_length())
    tree = splitting_tree(per.agg(F.sort_array(F.collect_list(entry)).alias("quotas")), levels)
    leaf = tree.select("shard", F.explode("quotas").alias("e")).select("shard", F.col("e.source").alias("source_rank"), F.explode(F.expr("sequence(e.start, e.start + e.quota - 1)")).alias("place"))
    return rows, drawn.join(leaf, ["source_rank", "place"]).select("source", "block", "pass", "words", "block_size", "shard")


def _taken(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """rows with passes (whole takes), part (words of the document in the partial pass), taken and shards (one for each pass)."""
    per = drawn.groupBy("source", "block").agg(
        F.count_if(F.col("words") == F.col("block_size")).alias("passes"),
        F.coalesce(F.sum(F.when(F.col("words") < F.col("block_size"), F.col("words"))), F.lit(0)).alias("rest"),
        F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"),
    )
    right = per.withColumnsRenamed({"source": "r_source", "block": "r_block"})
    joined = rows.join(right, rows["source"].eqNullSafe(right["r_source"]) & (rows["block"] == right["r_block"]), "left").drop("r_source", "r_block")
    joined = joined.fillna(0, ["passes", "rest"])
    order = Window.partitionBy("source", "block").orderBy(_hash(F.lit("row"), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0))))
    return joined.withColumn("part", part).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """What a mix takes of every row: doc_id, size (words), source_size, target (words of its source), taken (words, repeats counted), shards.

    shards (joined by "|") are the output shards, leaves of the splitting tree, that its takes go to, in the order of the passes.

    A null text has size 0; null sources are one source and stand last; rows with a null or repeated
    doc_id are rows like others (their order among themselves is by size).  A source's taken words
    are its target rounded; no row is taken beyond `most` times.  Only doc_id, source and size are
    shuffled.  Reruns agree: every draw comes from hashes.  Other columns aren't read.
    """
    takes = F.slice("shards", F.lit(1), (F.col("passes") + (F.col("part") > 0).cast("int")).cast("int"))
    rows = _taken(*draws(documents, weights, share, most))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.coalesce(F.array_join(takes, "|"), F.lit("")).alias("shards"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, shard: str | None = None) -> DataFrame:
    """The mix itself: the documents' rows, once for each whole take and once for a partial one of at
    least half the document, sorted within shards by a hash.  Rows of one doc_id are taken alike.  Columns
    stay, whatever their names; with `shard` the number of a row's shard is added (or replaced) under that name.
    """
    takes = _taken(*draws(documents, weights, share, most))
    copies = F.col("passes") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)
    takes = takes.groupBy(F.col("doc_id").alias("__doc")).agg(F.max_by(F.slice("shards", F.lit(1), copies.cast("int")), copies).alias("__shards")).where(F.size("__shards") > 0)
    out = documents.join(takes, documents["doc_id"].eqNullSafe(takes["__doc"])).withColumn("__shard", F.explode("__shards"))
    out = out.repartition("__shard").sortWithinPartitions("__shard", _hash(F.lit("local"), "__shard", "doc_id"))
    kept = [documents[c] for c in documents.columns if c != shard]
    return out.select(*kept, *([F.col("__shard").alias(shard)] if shard else []))


#: The query over a table documents, as DuckDB SQL.  The tree's recursion goes through the entries of all nodes of a level
#: together, an entry a step, and then to the nodes' halves.
SQL = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END::BIGINT AS size FROM documents),
    b AS (SELECT source, count(*) AS n_rows, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS w FROM b),
    o AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
          sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(source_size) OVER () AS total FROM w),
    f AS (SELECT *, 2 * source_size * w_left <= w * (total * 1.5::DOUBLE - before) AS full_ FROM o),
    t AS (SELECT *, CASE WHEN full_ THEN 2 * source_size::DOUBLE ELSE w * (((total::DOUBLE * 1.5 - sum(CASE WHEN full_ THEN 2 * source_size ELSE 0 END) OVER ())) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ()) END AS target FROM f),
    r AS (SELECT doc_id, d.source, rank, size, source_size, target, ('0x' || substr(md5('block:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % ceil(n_rows / {BLOCK_ROWS})::BIGINT AS block
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    k AS (SELECT source, rank, block, any_value(source_size) AS source_size, any_value(target) AS target, sum(size)::BIGINT AS block_size FROM r GROUP BY source, rank, block),
    q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(round(target) / source_size) END::BIGINT AS passes,
          coalesce(sum(block_size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('order:' || coalesce(source, '') || ':' || block), 1, 15))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
    p AS (SELECT source, rank, block, passes, greatest(0, least(block_size, round(target)::BIGINT - passes * source_size - before)) AS rest, block_size FROM q),
    g AS (SELECT source, rank, block, CASE WHEN rest = block_size THEN passes + 1 ELSE passes END AS passes, CASE WHEN rest = block_size THEN 0 ELSE rest END AS rest FROM p),
    y AS (SELECT source, rank, block, unnest(range(1, passes + CASE WHEN rest > 0 THEN 2 ELSE 1 END)) AS pass FROM p WHERE block_size > 0),
    z AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY ('0x' || substr(md5('draw:' || coalesce(source, '') || ':' || pass || ':' || block), 1, 15))::BIGINT, block) - 1 AS place FROM y),
    l AS (SELECT CASE WHEN count(*) // {SHARD_BLOCKS} <= 1 THEN 0 ELSE length(bin(count(*) // {SHARD_BLOCKS} - 1)) END AS levels FROM z),
    tree AS (
        SELECT 0 AS level, 0::BIGINT AS shard, list({{'source': rank, 'quota': n, 'start': 0::BIGINT}} ORDER BY rank) AS quotas, 1 AS step, sum(n)::BIGINT AS rest, (sum(n) // 2)::BIGINT AS draws, []::BIGINT[] AS out
        FROM (SELECT rank, count(*) AS n FROM z GROUP BY rank) HAVING count(*) > 0
        UNION ALL SELECT * FROM (
        SELECT level, shard, quotas, step + 1, rest - g, draws - x, list_append(out, x) FROM (
            SELECT *, CASE WHEN g = 0 OR draws = 0 THEN 0 WHEN b = 0 THEN draws WHEN th <= 1 THEN m WHEN th <= 1 + up THEN m + coalesce(list_position(list_transform(su, lambda v: v >= th - 1), true), nu)
                ELSE m - coalesce(list_position(list_transform(sd, lambda v: v >= th - 1 - up), true), nd) END::BIGINT AS x FROM (
            SELECT *, coalesce(su[-1], 0) AS up, u * (1 + coalesce(su[-1], 0) + coalesce(sd[-1], 0)) AS th FROM (
            SELECT *, list_transform(wu, lambda v, i: list_reduce(wu[1:i], lambda a, c: a + c)) AS su, list_transform(wd, lambda v, i: list_reduce(wd[1:i], lambda a, c: a + c)) AS sd FROM (
            SELECT *, list_transform(ru, lambda v, i: list_reduce(ru[1:i], lambda a, c: a * c)) AS wu, list_transform(rd, lambda v, i: list_reduce(rd[1:i], lambda a, c: a * c)) AS wd FROM (
            SELECT *, list_transform(range(1, nu + 1), lambda i: (g - (m + i) + 1)::DOUBLE * (draws - (m + i) + 1)::DOUBLE / ((m + i) * (b - draws + m + i))::DOUBLE) AS ru,
                list_transform(range(1, nd + 1), lambda i: (m - i + 1)::DOUBLE * (b - draws + m - i + 1)::DOUBLE / ((g - m + i) * (draws - m + i))::DOUBLE) AS rd FROM (
            SELECT *, greatest(0, least(far, least(g, draws) - m)) AS nu, greatest(0, least(far, m - greatest(0, draws - b))) AS nd FROM (
            SELECT *, floor((draws + 1)::DOUBLE * (g + 1)::DOUBLE / (n + 2))::BIGINT AS m, ceil(9 * sqrt(draws * (g / n) * (b / n) * ((n - draws) / greatest(n - 1, 1))))::BIGINT + 40 AS far,
                (('0x' || substr(md5(level || ':' || shard || ':' || source), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u FROM (
            SELECT *, quotas[step].quota AS g, rest - quotas[step].quota AS b, rest::DOUBLE AS n, quotas[step].source AS source FROM tree, l WHERE level < levels AND step <= len(quotas)))))))))
        UNION ALL
        SELECT level + 1, shard, quotas, 1, rest, rest // 2, []::BIGINT[] FROM (SELECT level, shard, quotas, list_sum(list_transform(quotas, lambda e: e.quota))::BIGINT AS rest FROM (
            SELECT level, shard * 2 + side AS shard, list_filter(list_transform(quotas, lambda e, i: {{'source': e.source, 'quota': CASE side WHEN 0 THEN out[i] ELSE e.quota - out[i] END, 'start': CASE side WHEN 0 THEN e.start ELSE e.start + out[i] END}}), lambda e: e.quota > 0) AS quotas
            FROM tree, l, (VALUES (0), (1)) s(side) WHERE level < levels AND step > len(quotas))))),
    leaf AS (SELECT shard, e.source AS rank, e.start AS first, e.start + e.quota AS stop FROM (SELECT shard, unnest(quotas) AS e FROM tree, l WHERE level = levels AND step = 1)),
    s AS (SELECT z.rank, block, list(shard ORDER BY pass) AS shards FROM z JOIN leaf ON z.rank = leaf.rank AND place >= first AND place < stop GROUP BY z.rank, block),
    x AS (SELECT r.*, passes, rest, coalesce(sum(size) OVER (PARTITION BY r.source, r.block ORDER BY ('0x' || substr(md5('row:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.block = g.block),
    e AS (SELECT *, greatest(0, least(size, rest - before)) AS part FROM x)
    SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken, coalesce(array_to_string(shards[1:passes + CASE WHEN part > 0 THEN 1 ELSE 0 END], '|'), '') AS shards FROM e LEFT JOIN s USING (rank, block)"""
