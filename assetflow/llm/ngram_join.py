"""N-gram Jaccard join: universe partition, pigeonhole over segments, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Text, chunks, mix, signed, written

#: Least similarity as a fraction, and words in a shingle.
ABOVE, BELOW = 3, 4
WORDS = 5
#: Documents that share a segment's value: up to so many are compared with each other outright.
LIGHT = 64
#: Members of a large group that one task compares with as many others.
SIDE = 512
#: Buckets of the smallest sketch: sets of fewer tokens are told apart more sharply for the same 64 bytes.
LEAST_BITS = 512
#: Nearest partners of a member that the first round across components takes.
MOST = 2
#: Rows of 64-bit values that may be broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 500_000
#: Text bytes for each partition of the signatures, and signatures that a task packs at once.
PART_BYTES = 16 << 20
HELD = 1_000_000
#: Cost model of a segment: what meets a one-token subset by chance, and the share of that for each further token.
MEETS, RARER = 20.0, 0.1


def most_apart(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return a + b - 2 * -(-ABOVE * (a + b) // (ABOVE + BELOW))


@cache
def bands(upto: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Least size of each size band, and for each band (segments, differences allowed in one, slack, most differences).

    Linked sets lie in one band or in neighbouring ones; a band's scheme is for pairs whose smaller
    set lies in it.  A scheme has segments that together allow more than the most differences, by a
    slack that may be lost on empty or very common subsets.  Either all segments must be equal
    subsets, or all may differ by one token (one-deletion neighbourhoods, half as many segments);
    the cheaper by expected index entries and chance meetings is taken.
    """
    starts, schemes, low = [], [], 1
    while low <= upto or not starts:
        high = low * BELOW // ABOVE
        apart = ceil((high + high * BELOW / ABOVE) * (BELOW - ABOVE) / (BELOW + ABOVE))
        if high < 64:
            apart = max(most_apart(a, b) for a in range(low, high + 1) for b in range(a, a * BELOW // ABOVE + 1))
        options = []
        for allowed in (0, 1):
            slack = 1 + allowed
            while True:
                n = -(-(apart + 1 + slack) // (1 + allowed))
                mean = (low + high) / 2 / n
                need = (1 + allowed) * n * exp(-mean) * (1 + allowed * mean)
                if slack >= need + 3 * need**0.5 or slack > 2 * apart + 8:
                    break
                slack += 1
            chance = sum(exp(-mean) * mean**s / _factorial(s) * MEETS * RARER**s for s in range(1, 12))
            options.append((n * (1 + chance) if not allowed else n * (1 + chance) + n * mean * (1 + chance), (n, allowed, slack, apart)))
        starts.append(low)
        schemes.append(min(options)[1])
        low = high + 1
    return np.array(starts), schemes


def _factorial(n: int) -> int:
    return n * _factorial(n - 1) if n else 1


def shingle_sets(text: Text, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a run."""
    hashes = text.word_hashes(lower=True)
    at, key = text.windows(hashes, words)
    bounds = np.searchsorted(text.doc[at], np.arange(text.n + 1))
    sets = []
    for i in range(text.n):
        n = text.n_words[i]
        if n >= words:
            sets.append(np.unique(key[bounds[i] : bounds[i + 1]]))
        elif n:
            whole = np.uint64(n)
            for h in hashes[text.first[i] : text.first[i + 1]]:
                whole = np.uint64((int(whole) * 0xD6E8FEB86659FD93 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mix(np.array([whole]))[:1])
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in as many buckets as tokens, rounded up to a power of two (LEAST_BITS at least)."""
    bits = max(LEAST_BITS, 1 << max(0, len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer buckets."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _segments(sets: list[np.ndarray], lower: bool) -> dict[str, np.ndarray]:
    """The segments of the sets in the scheme of their own band, or of the band below."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts, schemes = bands(1 << max(4, int(sizes.max(initial=1)).bit_length()))
    band = np.searchsorted(starts, sizes, "right") - 1 - lower
    used = (band >= 0) & (sizes >= 1)
    table = np.array(schemes)[np.maximum(band, 0)]
    m = np.where(used, table[:, 0], 0)
    doc = np.repeat(np.arange(len(sets)), np.where(used, sizes, 0))
    tokens = np.concatenate([s for s, u in zip(sets, used, strict=True) if u] or [np.zeros(0, np.uint64)])
    offset = np.concatenate([[0], np.cumsum(m)])
    place = mix(tokens ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    at = offset[doc] + ((place * m[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    total = int(offset[-1])
    low = np.bincount(at, (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(at, (tokens >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    of = np.repeat(np.arange(len(sets)), m)
    salt = (np.arange(total) - offset[of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + band[of].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    count = np.bincount(at, minlength=total)
    lost = (1 + table[:, 1]) * np.bincount(of, count <= table[of, 1], len(sets)).astype(np.int64)
    return {"of": of, "sum": low + (high << np.uint64(32)), "salt": salt, "count": count, "token": tokens, "token_at": at, "token_doc": doc, "allowed": table[:, 1], "slack": table[:, 2] - lost}


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets and 2 x position + (1 in the scheme below) of each."""
    values, owners = [], []
    for lower in (False, True):
        s = _segments(sets, lower)
        index = (s["count"] > 0) | (s["slack"] < 0)[s["of"]]  # with too many empty segments to spare, those count too
        values.append(mix(s["sum"] * np.uint64(3) + s["salt"])[index])
        owners.append(2 * s["of"][index] + lower)
        near = (s["allowed"][s["token_doc"]] == 1) & ((s["count"][s["token_at"]] > 1) | (s["slack"] < 0)[s["token_doc"]])
        at = s["token_at"][near]
        values.append(mix((s["sum"][at] - s["token"][near]) * np.uint64(3) + s["salt"][at]))
        owners.append(2 * s["token_doc"][near] + lower)
    return np.concatenate(values), np.concatenate(owners)


def document_sets(documents: DataFrame) -> DataFrame:
    """doc_id, node (64-bit hash of the text), n_shingles, sketch and what each scheme's slack leaves: a row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in chunks(batch):
                sets = shingle_sets(text)
                own, low = _segments(sets, False), _segments(sets, True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary()),
                     *(pa.array(x.astype(np.int64)) for x in (own["slack"], low["slack"], own["allowed"] + 1, low["allowed"] + 1))],
                    names=["doc_id", "node", "n_shingles", "sketch", "slack_0", "slack_1", "weight_0", "weight_1"])

    return documents.mapInArrow(run, "doc_id bigint, node bigint, n_shingles bigint, sketch binary, slack_0 bigint, slack_1 bigint, weight_0 bigint, weight_1 bigint")


def _cells(documents: DataFrame, parts: int) -> DataFrame:
    """Signatures packed by partition, in the order of their nodes: part, nodes, own, low, signatures.

    own and low: how many signatures each node has in the scheme of its band, and in the one below; signatures: 32 bits of each besides the partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within the task index once
        nodes, values, owners, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            value, owner = np.concatenate(values), np.concatenate(owners)
            part = (((value >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((owner, part))
            value, owner, part = value[order].astype("<u4"), owner[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            names, rows = np.array(nodes, np.int64), []
            for p in np.flatnonzero(np.diff(at)):
                own, where = np.unique(owner[at[p] : at[p + 1]] >> 1, return_inverse=True)
                counts = np.bincount(2 * where + (owner[at[p] : at[p + 1]] & 1), minlength=2 * len(own)).astype("<u4")
                rows.append({"part": p, "nodes": names[own].tobytes(), "own": counts[::2].tobytes(), "low": counts[1::2].tobytes(), "signatures": value[at[p] : at[p + 1]].tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("nodes", "own", "low", "signatures"))]))

        for batch in batches:
            for rows, text in chunks(batch):
                sets, own = [], []
                for node, s in zip(rows.column("node").to_pylist(), shingle_sets(text), strict=True):
                    if len(s) and node not in seen:
                        seen.add(node)
                        own.append(node)
                        sets.append(s)
                if not sets:
                    continue
                value, owner = _signatures(sets)
                values.append(value)
                owners.append(owner + 2 * len(nodes))
                nodes += own
                held += len(value)
                if held > HELD:
                    yield flush()
                    nodes, values, owners, held = [], [], [], 0
        if values:
            yield flush()

    return documents.mapInArrow(run, "part int, nodes binary, own binary, low binary, signatures binary")


_GROUPS = "kind int, part int, a bigint, b bigint, big_0 int, big_1 int, members binary, sizes binary"


def _groups(cells: DataFrame) -> DataFrame:
    """The groups that share a signature, by kind of row.

    0: stars, each group's least node (a) with the others (b).  1: a part's nodes (a) in groups of three or more,
    with the number of their groups of more than LIGHT in either scheme (big_0, big_1).  2: these groups, a row for
    each part: sizes, and members one after the other, as 2 x place among the part's sorted nodes + (1 in the scheme below).
    """
    def run(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c)]
        nodes, own, low = (np.concatenate(read(c, kind)) for c, kind in (("nodes", np.int64), ("own", "<u4"), ("low", "<u4")))
        signature = np.concatenate(read("signatures", "<u4"))
        counts = np.stack([own, low], 1).ravel().astype(np.int64)
        name, place = np.unique(nodes, return_inverse=True)
        member = np.repeat(np.stack([2 * place, 2 * place + 1], 1).ravel(), counts)
        order = np.argsort(signature.astype(np.uint64) << np.uint64(32) | member.astype(np.uint64))
        signature, member = signature[order], member[order]
        new = np.concatenate([[True], (signature[1:] != signature[:-1]) | (member[1:] >> 1 != member[:-1] >> 1)])
        signature, member = signature[new], member[new]
        begin = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        size = np.diff(np.append(begin, len(signature)))
        sizes, centre = np.repeat(size, size), np.repeat(member[begin] >> 1, size)
        star = np.unique(centre[sizes > 1] * len(name) + (member[sizes > 1] >> 1))
        star = np.stack(np.divmod(star, max(1, len(name))), 1)
        star = star[star[:, 0] != star[:, 1]]
        many = sizes > 2
        big = np.bincount(member[many & (sizes > LIGHT)], minlength=2 * len(name)).reshape(-1, 2)
        used = np.unique(member[many] >> 1)
        put = np.zeros(len(name), np.int64)
        put[used] = np.arange(len(used))
        packed = int(len(used) > 0)
        n, m = len(star), len(used)
        none = lambda k, kind: pa.nulls(k, kind)
        join = lambda *xs: pa.concat_arrays(xs)
        whole = pa.int64()
        flat = (2 * put[member[many] >> 1] + (member[many] & 1)).astype("<u4").tobytes()
        return pa.table({
            "kind": pa.array(np.repeat([0, 1, 2], [n, m, packed]).astype(np.int32)), "part": pa.array(np.full(n + m + packed, table.column("part")[0].as_py(), np.int32)),
            "a": join(pa.array(name[star[:, 0]]), pa.array(name[used]), none(packed, whole)), "b": join(pa.array(name[star[:, 1]]), none(m + packed, whole)),
            **{f"big_{i}": join(none(n, pa.int32()), pa.array(big[used, i].astype(np.int32)), none(packed, pa.int32())) for i in (0, 1)},
            "members": join(none(n + m, pa.binary()), pa.array([flat] * packed, pa.binary())),
            "sizes": join(none(n + m, pa.binary()), pa.array([size[size > 2].astype("<u4").tobytes()] * packed, pa.binary())),
        })

    return cells.groupBy("part").applyInArrow(run, _GROUPS)


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that sizes and sketches don't rule out: parities differ in at most as many buckets as the sets in tokens."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{BELOW} * least(n_a, n_b) >= {ABOVE} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= most_apart(n, m))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _linked(pairs: DataFrame, documents: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose whole shingle sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    few = written(sets.join(wanted, "node", "left_semi").select("node", "doc_id"), "verify-nodes")
    many = few.count() > BROADCAST_ROWS
    hand = few.select(F.col("node").alias("its_node"), F.col("doc_id").alias("its_id"))
    texts = documents.join(hand if many else F.broadcast(hand), (F.col("node") == F.col("its_node")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left_semi")
    texts = texts.dropDuplicates(["node"]) if many else texts

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in chunks(batch):
                yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([s.tobytes() for s in shingle_sets(text)], pa.binary())], names=["node", "tokens"])

    tokens = written(texts.mapInArrow(make, "node bigint, tokens binary"), "verify-sets").dropDuplicates(["node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(BELOW * common >= ABOVE * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    both = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")


def _nearest(left: int, partners: np.ndarray, apart: np.ndarray, most: int, found: tuple[list[int], list[int]]) -> bool:
    """Adds left's `most` nearest partners to the pairs found; whether some were left out."""
    cut = len(partners) > most
    if cut:
        partners = partners[np.argpartition(apart, most - 1)[:most]]
    found[0].extend(np.minimum(partners, left).tolist())
    found[1].extend(np.maximum(partners, left).tolist())
    return cut


def _compare(members: DataFrame, most: int) -> DataFrame:
    """Possible pairs of different components within clusters: a and b, and cluster null.

    members: cluster, main, sides, node, component, n_shingles, sketch, asked.  A cluster of more than
    SIDE members is compared in blocks.  With a main component only what lies outside it is compared
    with the rest.  Each asked row gives its `most` nearest partners in a block; where that leaves any
    out there is a row with its node as a, b null and its cluster.
    """
    out = F.col("main").isNull() | (F.col("component") != F.col("main"))
    own = members.withColumn("own", F.pmod(F.xxhash64("node"), "sides").cast("int")).withColumn("outside", out)
    to = lambda low, high: F.explode(F.sequence(low, high))
    zero, last = F.lit(0), F.col("sides") - 1
    side = lambda i, j, right: own.withColumn("i", i).withColumn("j", j).withColumn("right", F.lit(right))
    apart = own.where("sides > 1")  # a block compared with itself has its rows once
    others = lambda low, high: F.explode(F.expr(f"filter(sequence({low}, {high}), x -> x <> own)"))
    left = apart.where("asked and outside").withColumn("j", others("if(main is null, own, 0)", "sides - 1")).withColumn("i", F.col("own")).withColumn("right", F.lit(False))
    right = apart.withColumn("i", others("0", "if(main is null, own, sides - 1)")).withColumn("j", F.col("own")).withColumn("right", F.lit(True))
    columns = ["cluster", "i", "j", "right", "node", "component", "n_shingles", "outside", "asked", "sketch"]
    blocks = side(F.col("own"), F.col("own"), True).unionByName(left).unionByName(right)
    spread = blocks.select(*columns).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "right")

    def pairs(rows: list[tuple], apart: bool, found: tuple[list[int], list[int]]) -> list[int]:
        """Adds the pairs of a block to those found; the nodes that have more.  rows: right, node, component, n_shingles, outside, asked, sketch."""
        size = min(len(r[6]) for r in rows)
        bits = np.stack([_folded(np.frombuffer(r[6], np.uint8), size) for r in rows]).view(np.uint64)
        node, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        right, outside, asked = (np.array([r[k] for r in rows]) for k in (0, 4, 5))
        rest, more = slice(int((~right).sum()), None), []
        for k in np.flatnonzero(~right if apart else outside & asked):
            low, high, total = np.minimum(n[k], n[rest]), np.maximum(n[k], n[rest]), n[k] + n[rest]
            once = (node[rest] > node[k]) | ~outside[rest] | apart
            at = np.flatnonzero(once & (comp[rest] != comp[k]) & (BELOW * low >= ABOVE * high))
            differ = np.bitwise_count(bits[rest][at] ^ bits[k]).sum(1)
            near = differ <= (total - 2 * -(-ABOVE * total // (ABOVE + BELOW)))[at]
            if _nearest(int(node[k]), node[rest][at[near]], differ[near], most, found):
                more.append(int(node[k]))
        return more

    def few(rows: list[tuple], found: tuple[list[int], list[int]]) -> list[int]:
        """The same for a cluster in one block, in whole numbers: no arrays for a handful of rows."""
        more: list[int] = []
        for k, (_, x, c, n, out, ask, s) in enumerate(rows):
            near = []
            for other, (_, y, d, m, out2, _, t) in enumerate(rows) if out and ask else ():
                if c != d and (not out2 or y > x) and other != k and BELOW * min(n, m) >= ABOVE * max(n, m):
                    size = min(len(s), len(t))
                    u, v = (z if len(z) == size else _folded(np.frombuffer(z, np.uint8), size).tobytes() for z in (s, t))
                    if (differ := (int.from_bytes(u) ^ int.from_bytes(v)).bit_count()) <= most_apart(n, m):
                        near.append((differ, y))
            if near and _nearest(x, np.array([y for _, y in near]), np.array([d for d, _ in near]), most, found):
                more.append(x)
        return more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            found: tuple[list[int], list[int]] = ([], [])
            _, i, j = key
            more = few(rows, found) if len(rows) <= 40 and i == j else pairs(rows, i != j, found)
            both = np.unique(np.array(found, np.int64), axis=1)
            a, n = np.concatenate([both[0], np.array(more, np.int64)]), both.shape[1]
            b = pa.array([*both[1].tolist(), *[None] * len(more)], pa.int64())
            cluster = pa.array([*[None] * n, *[key[0]] * len(more)], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), b, cluster], names=["a", "b", "cluster"])

        for batch in batches:
            for c, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (c, i, j) != key:
                    if rows and (out := done()).num_rows:
                        yield out
                    key, rows = (c, i, j), []
                rows.append(tuple(rest))
        if rows and (out := done()).num_rows:
            yield out

    return spread.mapInArrow(run, "a bigint, b bigint, cluster bigint").distinct()


def _clusters(found: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the groups that more than one component shares: cluster, main, node, component.

    In groups of more than LIGHT those alone are members that have more empty or common segments than
    their scheme's slack, since any other linked pair also shares a rarer one.  Groups of the same
    members are one cluster, and so are those that one component (main) rules, as near copies share very
    many.  Groups stay packed by part; what is shuffled is a row for each node of a part.
    """
    own = found.where("kind = 1").select(F.col("part").alias("of_part"), F.col("a").alias("node"), "big_0", "big_1")
    spent = lambda i: (F.col(f"n_{i}") * F.col(f"weight_{i}") > F.col(f"slack_{i}")).alias(f"spent_{i}")
    crowd = own.groupBy("node").agg(F.sum("big_0").alias("n_0"), F.sum("big_1").alias("n_1"))
    about = crowd.join(nodes.select("node", "slack_0", "slack_1", "weight_0", "weight_1"), "node").join(components(links), "node", "left")
    about = about.select("node", F.coalesce("component", "node").alias("component"), spent(0), spent(1))
    labels = own.select("of_part", "node").join(about, "node")

    def run(packed: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = pa.schema([(c, pa.int64()) for c in ("cluster", "main", "node", "component")])
        if not packed.num_rows:
            return kinds.empty_table()
        node, component, spent_0, spent_1 = (rows.column(c).to_numpy() for c in ("node", "component", "spent_0", "spent_1"))
        order = np.argsort(node)
        node, component, spent = node[order], component[order], np.stack([spent_0, spent_1], 1)[order].astype(bool)
        member, size = (np.frombuffer(packed.column(c)[0].as_py(), "<u4").astype(np.int64) for c in ("members", "sizes"))
        group, place = np.repeat(np.arange(len(size)), size), member >> 1
        held = (np.repeat(size, size) <= LIGHT) | spent[place, member & 1]
        group, place = group[held], place[held]
        if not len(group):
            return kinds.empty_table()
        order = np.lexsort((component[place], group))
        group, place = group[order], place[order]
        of = component[place]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        n = np.diff(np.append(begin, len(group)))
        run_ = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (of[1:] != of[:-1])]))
        length = np.diff(np.append(run_, len(group)))
        whose = np.searchsorted(begin, run_, "right")
        best = np.lexsort((length, whose))  # the longest run of each group stands last
        last = best[np.append(whose[best][1:] != whose[best][:-1], True)]
        ruled, main = 2 * length[last] >= n, of[run_[last]]
        who = signed(mix(np.add.reduceat(mix(node[place].view(np.uint64)), begin) + n.astype(np.uint64)))
        cluster = np.where(ruled, signed(mix(main.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))), who)
        mixed = of[begin] != of[begin + n - 1]
        _, one = np.unique(who, return_index=True)
        once = np.zeros(len(n), bool)
        once[one] = True
        kept = np.repeat(mixed & once, n)
        rows = [np.repeat(x, n)[kept] for x in (cluster, ruled, main)] + [node[place[kept]], of[kept]]
        first = np.unique(np.stack([rows[0], rows[3]], 1), axis=0, return_index=True)[1] if kept.any() else np.zeros(0, np.int64)
        cluster, ruled, main, node, of = (x[first] for x in rows)
        return pa.table([cluster, pa.array(main, mask=~ruled), node, of], schema=kinds)

    groups = found.where("kind = 2").select("part", "members", "sizes")
    rows = groups.groupBy("part").cogroup(labels.groupBy("of_part")).applyInArrow(run, "cluster bigint, main bigint, node bigint, component bigint")
    return rows.groupBy("cluster", "node").agg(F.first("main").alias("main"), F.first("component").alias("component"))


def _relabelled(clusters: DataFrame, links: DataFrame, cut: DataFrame) -> DataFrame:
    """The clusters that have rows of cut and still hold more than one component of the links; asked: those rows."""
    now = components(links)
    clusters = clusters.drop("component", "asked").join(cut.select("cluster").distinct(), "cluster", "left_semi")
    clusters = clusters.join(now, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_main = now.select(F.col("node").alias("main"), F.col("component").alias("its"))
    clusters = clusters.join(of_main, "main", "left").withColumn("main", F.coalesce("its", "main")).drop("its")
    open_ = clusters.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("cluster")
    return clusters.join(open_, "cluster").join(cut.withColumn("asked", F.lit(True)), ["cluster", "node"], "left").fillna(False, ["asked"])


def _links_across(clusters: DataFrame, links: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links and those that clusters add, until no two components of a cluster have an unverified possible pair.

    In each round every member outside its cluster's main component meets its nearest possible partners
    of other components; what is verified merges.  Those that had more partners than the round took
    go on with eight times as many, as far as their clusters still fall into components; so members of
    one component join in few rounds, and the pairs stay in proportion to the members.
    """
    most, left = MOST, clusters.withColumn("asked", F.lit(True))
    while True:
        left = written(left, "clusters")
        sides = left.groupBy("cluster").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
        found = written(_compare(left.join(sides, "cluster").join(nodes.select("node", "n_shingles", "sketch"), "node"), most), "more-pairs")
        links = written(links.unionByName(_linked(found.where("b is not null").select("a", "b").distinct(), documents, nodes)), "more-links")
        cut = found.where("b is null").select("cluster", F.col("a").alias("node"))
        if cut.isEmpty():
            return links
        left, most = _relabelled(left, links, cut), most * 8


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set of 5-word shingles), component_id (smallest doc_id reachable by links).

    Two documents link when 100 * |intersection| >= 75 * |union|.  Copies of one text are one node.
    A node's shingles are hashed into segments by its size band; linked sets agree on some segments
    (or, where the scheme says so, differ there by one token), so each segment's subset, and its
    one-deletion neighbourhood, is a signature.  Documents that share a signature are first compared
    with one of them, then only across components, in rounds: each with its nearest partners, until no
    possible pair of two components is left (see _clusters and _links_across).  Sketches rule pairs out;
    the rest is verified on the whole sets.  No link between components is lost, and no group is
    gathered whole: large ones are compared in blocks.

    Null and empty texts have an empty set and link with nothing.  Rows with a null doc_id take part
    (component_id is null where nothing else is reachable).  Repeated doc_ids give a row each.
    """
    keyed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    sets = written(document_sets(keyed), "sets")
    firsts = (F.first(c).alias(c) for c in ("n_shingles", "sketch", "slack_0", "slack_1", "weight_0", "weight_1"))
    nodes = written(sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *firsts), "nodes")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // PART_BYTES), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(_groups(_cells(keyed, parts)), "groups")

    stars = found.where("kind = 0").select("a", "b").distinct()
    links = written(_linked(written(_possible(stars, nodes), "pairs"), keyed, nodes), "star-links")
    if not found.where("kind = 2").isEmpty():
        links = _links_across(_clusters(found, nodes, links), links, keyed, nodes)
    joined = components(links)
    # components of nodes, then of documents: each component takes its least doc_id
    placed = nodes.select("node", "doc_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "component").select("node", "component_id")
    whole = sets.select("doc_id", "node", "n_shingles").join(named, "node")
    return whole.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
