"""Prefix trie of conversations: count-min screening of prefix digests, exact grouping of the rest.

A turn has a SHA-256 key; a prefix of turns has a digest that is a running sum of its turns' keys
times powers of a base, modulo four primes (124 bits).  Such a sum can be cut anywhere, so turns are
sorted in ranges and a conversation may span many tasks.  Every prefix is counted in a count-min
sketch; an estimate of one proves that no other conversation has the prefix, and its node is emitted
where it stands.  Only prefixes that may be shared are shuffled and grouped.

The smallest member of a node is also the smallest member of every deeper node on its own way, so
each conversation owns one run of nodes, down to its end.  Sums over a subtree are therefore sums of
what members own: no walk over the trie is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import mixed
from feedloom.session import stage

#: Primes below 2^31 and a base for each.
PRIMES = (2147483629, 2147483587, 2147483579, 2147483563)
BASES = (1000003, 1299709, 15485863, 32452843)
#: Shared turns come from the first conversation of each block of this many ids, at most ``HEAD`` of them.
BLOCK, HEAD = 5, 8
#: Rows of the sketch, and the least and the greatest number of its columns as powers of two (one byte each).
ROWS, LEAST, MOST = 3, 12, 22
PIECE = 1 << 14
#: Longest run of ids or depths that one task holds at once.
RUN = 12
SUMS = [f"h{j}" for j in range(4)]
TERMS = [f"t{j}" for j in range(4)]
NODE = ["d", "k1", "k2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def _powers(base: int, prime: int, places: np.ndarray) -> np.ndarray:
    """``base ** places`` modulo ``prime``."""
    out, square, left = np.ones(len(places), np.uint64), base, places.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(prime), out)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and digest of each turn among its conversation's turns of this range."""
    part, last, seen, carry = TaskContext.get().partitionId(), None, 0, [0] * 4
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column("conv_id").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        start = np.repeat(first, np.diff(np.append(first, n)))
        at = np.arange(n) - start
        goes_on = last is not None and conv[0] == last
        head = start == 0
        if goes_on:
            at[head] += seen
        key = np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint32).reshape(n, 8)[:, :4].astype(np.uint64)
        columns = [pa.array(np.full(n, part)), b.column("conv_id"), pa.array(at)]
        sums, terms = [], []
        for j, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
            p = np.uint64(prime)
            term = (key[:, j] % (p - np.uint64(1)) + np.uint64(1)) * _powers(base, prime, at) % p
            total = np.cumsum(term)  # a batch has far fewer than 2^33 rows
            before = np.where(start > 0, total[np.maximum(start - 1, 0)], np.uint64(0))
            value = (total - before) % p
            if goes_on:
                value = np.where(head, (value + np.uint64(carry[j])) % p, value)
            sums.append(value.astype(np.int64))
            terms.append(term.astype(np.int64))
        last, seen, carry = conv[-1], int(at[-1]) + 1, [int(s[-1]) for s in sums]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums), *map(pa.array, terms), b.column("size")], names=["part", "conv_id", "at", *SUMS, *TERMS, "size"])


def _placed(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, h0.., t0.., size``: turns with their place and the digest of the prefix that they end."""
    spark = rows.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    light = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv_id", "turn", "key"]
    kinds = ", ".join(f"{c} long" for c in ["part", "conv_id", "at", *SUMS, *TERMS, "size"])
    local = stage(light.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_local_sums, kinds), "trielocal")
    # one row for each range of the sort: what a conversation that began in an earlier range brings along
    ends = local.groupBy("part").agg(F.max(F.struct("conv_id", "at", *SUMS)).alias("last"), F.min("conv_id").alias("first")).collect()
    open_conv, place, sums, found = None, 0, [0] * 4, []
    for e in sorted(ends, key=lambda e: e.part):
        shift, scale, add = 0, [1] * 4, [0] * 4
        if e.first == open_conv:
            shift, add = place, sums
            scale = [pow(b, place, p) for b, p in zip(BASES, PRIMES, strict=True)]
            found.append((e.part, e.first, shift, *scale, *add))
        mine = e.last.conv_id == e.first
        open_conv = e.last.conv_id
        place = e.last.at + 1 + (shift if mine else 0)
        sums = [((add[j] if mine else 0) + (scale[j] if mine else 1) * e.last[s]) % PRIMES[j] for j, s in enumerate(SUMS)]
    brought = spark.createDataFrame(found, "part long, conv_id long, shift long, " + ", ".join(f"{n}{j} long" for n in "sa" for j in range(4)))
    joined = local.join(F.broadcast(brought), ["part", "conv_id"], "left")  # at most one row for each range
    scaled = lambda c, j: F.coalesce(F.col(f"s{j}"), F.lit(1)) * F.col(c)
    return joined.select(
        "conv_id",
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"),
        *[((scaled(s, j) + F.coalesce(F.col(f"a{j}"), F.lit(0))) % PRIMES[j]).alias(s) for j, s in enumerate(SUMS)],
        *[(scaled(t, j) % PRIMES[j]).alias(t) for j, t in enumerate(TERMS)],
        "size",
    )


def _key(parts: list[Column]) -> list[Column]:
    join = lambda a, b: F.shiftleft(a, 31) + b
    return [join(parts[0], parts[1]), join(parts[2], parts[3])]


def _rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every rebuilt turn (conversation, depth, digests of its prefix and of the one before), and every conversation."""
    placed = stage(_placed(rows), "trieplaced")
    head = F.when(F.col("pos") < HEAD, F.struct("pos", *SUMS, *TERMS, "size"))
    tops = stage(placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("heads")), "trietops")
    bases = tops.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    convs = tops.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1), "base": F.col("conv_id") - F.col("conv_id") % BLOCK}).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    at = lambda array, k, s: F.when(k > 0, F.try_element_at(array, k.cast("int"))[s]).otherwise(F.lit(0))
    plans = convs.withColumn("taken", taken).select(
        "conv_id",
        "h",
        "taken",
        (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        F.slice("base_heads", F.lit(1), F.col("taken").cast("int")).alias("lent"),
        *[at("base_heads", F.col("taken"), s).alias(f"a{j}") for j, s in enumerate(SUMS)],
        *[F.coalesce(at("heads", F.col("h"), s), F.lit(0)).alias(f"b{j}") for j, s in enumerate(SUMS)],
    )
    plans = stage(plans, "trieplans")

    def turns(df: DataFrame, depth: Column, sums: list[Column], terms: list[Column], size: Column) -> DataFrame:
        before = [F.pmod(s - t, F.lit(p)) for s, t, p in zip(sums, terms, PRIMES, strict=True)]
        k, p = _key(sums), _key(before)
        return df.select("conv_id", depth.cast("long").alias("d"), k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"), size.alias("size"), (depth == F.col("total")).alias("last"))

    lent = plans.select("conv_id", "total", F.explode("lent").alias("x"))
    lent = turns(lent, F.col("x.pos") + 1, [F.col(f"x.{s}") for s in SUMS], [F.col(f"x.{t}") for t in TERMS], F.col("x.size"))
    back = []  # moving own turns forward divides by powers of the base
    for b, p in zip(BASES, PRIMES, strict=True):
        steps = F.array(*[F.lit(pow(b, -k, p)) for k in range(HEAD + 1)])
        back.append(F.element_at(steps, (F.col("h") - F.col("taken") + 1).cast("int")))
    own = placed.join(plans.drop("lent"), "conv_id").where("pos >= h")
    sums = [(F.col(f"a{j}") + F.pmod(F.col(s) - F.col(f"b{j}"), F.lit(PRIMES[j])) * back[j]) % PRIMES[j] for j, s in enumerate(SUMS)]
    own = turns(own, F.col("taken") + F.col("pos") - F.col("h") + 1, sums, [F.col(t) * back[j] % PRIMES[j] for j, t in enumerate(TERMS)], F.col("size"))
    return stage(lent.unionByName(own), "trieturns"), plans.select("conv_id", "total")


def _columns(depth: np.ndarray, k1: np.ndarray, k2: np.ndarray, bits: int) -> list[np.ndarray]:
    """The column of a prefix in each row of the sketch."""
    x = mixed(k1.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * depth.astype(np.uint64)) ^ k2.astype(np.uint64)
    one, two = mixed(x), mixed(x ^ np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return [((one + np.uint64(r) * two) & np.uint64((1 << bits) - 1)).astype(np.int64) for r in range(ROWS)]


def _sketch(turns: DataFrame, bits: int) -> np.ndarray:
    """Counts (0, 1, or 2 for more) of all prefixes: ``ROWS`` x 2^bits bytes whatever the input.

    Each task counts its own rows and emits the filled pieces of its sketch; pieces are added up one
    at a time.  Only the sum comes to the driver.
    """
    width, piece = 1 << bits, min(PIECE, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((ROWS, width), np.uint8)
        for b in batches:
            for r, c in enumerate(_columns(*[b.column(n).to_numpy() for n in NODE], bits)):
                cell, times = np.unique(c, return_counts=True)
                own[r, cell] = np.minimum(2, own[r, cell] + np.minimum(times, 2))
        cut = own.reshape(-1, piece)
        full = np.flatnonzero(cut.any(axis=1))
        for k in range(0, len(full), 64):
            some = full[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([cut[i].tobytes() for i in some], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for i, raw in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if at is not None and i != at:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["piece", "counts"])
                    total = None
                own = np.frombuffer(raw, np.uint8)
                at, total = i, own if total is None else np.minimum(2, total + own)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["piece", "counts"])

    kinds = "piece long, counts binary"
    pieces = turns.select(*NODE).mapInArrow(count, kinds).repartition("piece").sortWithinPartitions("piece").mapInArrow(add, kinds)
    out = np.zeros((ROWS * width // piece, piece), np.uint8)
    for row in pieces.toLocalIterator():  # ROWS * width bytes at most
        out[row.piece] = np.frombuffer(row.counts, np.uint8)
    return out.reshape(ROWS, width)


def _screened(turns: DataFrame, most: int = MOST) -> DataFrame:
    """``turns`` with ``many`` and ``p_many``: may another conversation have this prefix, or the one before?"""
    n = turns.count()
    bits = min(most, max(LEAST, (4 * n).bit_length()))
    shared = turns.sparkSession.sparkContext.broadcast(_sketch(turns, bits).tobytes())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(shared.value, np.uint8).reshape(ROWS, 1 << bits)
        for b in batches:
            d, k1, k2, p1, p2 = (b.column(c).to_numpy() for c in (*NODE, "p1", "p2"))
            many = np.min([sketch[r, c] for r, c in enumerate(_columns(d, k1, k2, bits))], axis=0) > 1
            p_many = (d == 1) | (np.min([sketch[r, c] for r, c in enumerate(_columns(d - 1, p1, p2, bits))], axis=0) > 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(many), pa.array(p_many)], names=[*b.schema.names, "many", "p_many"])

    kinds = "conv_id long, d long, k1 long, k2 long, p1 long, p2 long, size long, last boolean, many boolean, p_many boolean"
    return stage(turns.mapInArrow(mark, kinds), "triemarked")


def _member_digests(shared: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node, ascending.

    Ids are joined in runs of 2^12 numbers; a node's runs then pass one task in order, one batch at a
    time, since this hash has no other way: a run is one row however many members it has.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, None, []
        for b in batches:
            for *node, ids in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if at is not None and node != at:
                    out.append((*at, sha.hexdigest()))
                if node == at:
                    sha.update(b",")
                else:
                    at, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])
                out = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, sha.hexdigest())], names=[*NODE, "ends_sha256"])

    runs = shared.where("last").groupBy(*NODE, F.shiftright("conv_id", RUN).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "run").mapInArrow(digest, "d long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from columns ``conv_id, turn, role, text``.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    ``most`` bounds the sketch (``ROWS`` x 2^most bytes); beyond it more prefixes are grouped exactly and
    the result is the same.  Null role or text: empty.  Null turn: before all others.  Turns of one number
    (and rows that repeat): each its own turn, ordered by the SHA-256 of role and text.  Null
    conv_id: belongs to no conversation, left out.  Negative ids: the remainder has the sign of the id, as
    in SQL.  A conversation rebuilt without turns: a member of the root alone.  Empty table: no rows.  Other
    columns are not read.
    """
    turns, convs = _rebuilt(conversations)
    marked = _screened(turns, most)
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(c) for c in (*NODE, "p1", "p2", "size")], (F.col("total") == 0).alias("last"))
    maybe = marked.where("many").select(*root.columns).unionByName(root)
    alone = marked.where("NOT many")

    nodes = maybe.groupBy(*NODE).agg(
        F.min("conv_id").alias("own"),
        F.count("*").alias("n_convs"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.max("size").alias("size"),
        F.sum(F.col("last").cast("long")).alias("n_ends"),
    )
    nodes = stage(nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("size"), "leaf": (F.col("n_ends") == F.col("n_convs")).cast("long")}), "trienodes")
    least = nodes.where("d = 0").agg(F.min("own")).first()[0]

    owned = nodes.select(F.col("own").alias("conv_id"), "saved", "leaf").unionByName(alone.where("last").select("conv_id", zero.alias("saved"), F.lit(1).cast("long").alias("leaf")))
    owned = stage(owned.groupBy("conv_id").agg(F.sum("saved").alias("own_saved"), F.sum("leaf").alias("own_leaf")).where("own_saved > 0 OR own_leaf > 0"), "trieowned")
    below = maybe.select("conv_id", *NODE).join(owned, "conv_id").groupBy(*NODE).agg(F.sum("own_saved").alias("all_saved"), F.sum("own_leaf").alias("n_leaves"))
    kids = nodes.where("d > 0").select(F.col("d") - 1, "p1", "p2").union(alone.where("p_many").select(F.col("d") - 1, "p1", "p2")).toDF(*NODE).groupBy(*NODE).agg(F.count("*").alias("n_children"))

    # what its owner has at this depth and beyond, in runs of depths, so that no long conversation is one window
    run = nodes.select("own", "d", "saved", *NODE[1:], F.shiftright("d", RUN).alias("run"))
    after = Window.partitionBy("own").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    later = run.groupBy("own", "run").agg(F.sum("saved").alias("s")).select("own", "run", F.coalesce(F.sum("s").over(after), zero).alias("later"))
    here = run.withColumn("here", F.sum("saved").over(Window.partitionBy("own", "run").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)))
    suffix = here.join(later, ["own", "run"]).select(*NODE, (F.col("here") + F.col("later")).alias("suffix"))

    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("own").alias("parent"))
    full = nodes.join(kids, NODE, "left").join(below, NODE, "left").join(suffix, NODE).join(_member_digests(maybe), NODE, "left")
    full = full.join(owned.select(F.col("conv_id").alias("own"), "own_saved"), "own", "left").join(parents.where("d > 1"), ["d", "p1", "p2"], "left")
    up = F.when(F.col("d") == 1, F.lit(least)).when(F.col("d") > 1, F.coalesce("parent", "own"))
    number = lambda c: F.coalesce(c, zero)
    shared = full.select(
        F.col("own").alias("conv_id"),
        F.col("d").alias("depth"),
        up.cast("long").alias("parent_conv_id"),
        "n_convs",
        number("n_children").alias("n_children"),
        number("n_leaves").alias("n_leaves"),
        (number("all_saved") - number("own_saved") + F.col("suffix")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )

    def tail(df: DataFrame, up: Column) -> DataFrame:
        one = F.lit(1).cast("long")
        ends = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING))
        return df.select("conv_id", F.col("d").alias("depth"), up.cast("long").alias("parent_conv_id"), one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), ends.alias("ends_sha256"))

    inner = tail(alone.where("NOT p_many OR d = 1"), F.when(F.col("d") == 1, F.lit(least)).otherwise(F.col("conv_id")))
    border = tail(alone.where("p_many AND d > 1").join(parents, ["d", "p1", "p2"]), F.col("parent"))
    return shared.unionByName(inner).unionByName(border)


_KEY = "length(role) || ':' || length(text) || ':' || role || text"
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x) + 1), lambda i: ascii(substr(x, i, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))"
SQL = f"""
WITH own AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
  ids AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS x FROM own GROUP BY conv_id),
  hs AS (SELECT conv_id, n, conv_id - conv_id % {BLOCK} AS base, xor({_CRC}, 4294967295) % {HEAD + 1} AS h FROM ids),
  plans AS (SELECT hs.conv_id, hs.h, hs.base, least(hs.h, coalesce(b.n, 0)) AS taken, least(hs.h, coalesce(b.n, 0)) + greatest(hs.n - hs.h, 0) AS total FROM hs LEFT JOIN ids b ON b.conv_id = hs.base),
  built AS (SELECT p.conv_id, total, o.pos AS d, role, text FROM plans p JOIN own o ON o.conv_id = p.base AND o.pos <= p.taken
    UNION ALL SELECT p.conv_id, total, p.taken + o.pos - p.h, role, text FROM plans p JOIN own o ON o.conv_id = p.conv_id AND o.pos > p.h),
  way AS (SELECT conv_id, d, total, text, sha256(string_agg({_KEY}, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM built
    UNION ALL SELECT conv_id, 0, total, '', '' FROM plans),
  steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM way),
  nodes AS (SELECT d, node, max(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(strlen(text)) AS saved,
    bool_and(d = total) AS leaf, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = total), '')) AS ends_sha256 FROM steps GROUP BY d, node),
  below AS (SELECT w.d, w.node, sum(n.saved) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves FROM nodes n JOIN way w ON w.conv_id = n.conv_id AND w.d <= n.d GROUP BY w.d, w.node),
  kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.node = n.node LEFT JOIN kids k ON k.d = n.d AND k.node = n.node LEFT JOIN nodes u ON u.d = n.d - 1 AND u.node = n.up
"""
