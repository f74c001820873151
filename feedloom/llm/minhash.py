"""MinHash near-dedup with tensored banding.

Two small collections of keys are drawn per text, each key a concatenation of ``width`` minhashes.
A table is a pair of one key from either collection, so ``side`` + ``side`` keys serve ``side ** 2``
tables.  A table can only hold two texts if both of its halves are shared, so pairs of halves are
formed for shared halves only.

Texts of equal shingle sets are one node.  In every table the smallest node is the hub: each node
is first compared with its hub, on full sets.  Nodes of tables that then still hold several
components go by their differences from one hub: an index of differing shingles finds every pair
that may be linked, and those are compared, so no component misses a link between texts that met in
a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import by_key, id_text, mixed, run_hashes, smaller, word_hashes
from feedloom.llm.components import components
from feedloom.llm.exact import if_small
from feedloom.session import stage

#: 14 x 14 tables of 3 + 3 minhashes: two texts of similarity 0.8 miss all of them with probability
#: 1 - (1 - (1 - 0.8 ** 3) ** 14) ** 2, below 1 in 10,000; more similar ones far less often.
SIDE, WIDTH = 14, 3


def shingle_sets(words: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one of none has none."""
    runs, out, begin = run_hashes(words, size), [], 0
    for end in ends:
        n = end - begin
        if n >= size:
            out.append(np.unique(runs[begin : end - size + 1]))
        else:
            out.append(run_hashes(words[begin:end], n) if n else np.zeros(0, np.uint64))
        begin = end
    return out


def _keys(sets: list[np.ndarray], side: int, width: int) -> np.ndarray:
    """``2 * side`` keys of each non-empty set; the lowest bit tells the collection."""
    rng = np.random.default_rng(20240229)
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, 2 * side), np.int64)
    values = np.concatenate(full)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
    keys = np.zeros((len(full), 2 * side), np.uint64)
    for k in range(2 * side):
        key = np.full(len(full), np.uint64(k + 1))
        for _ in range(width):
            salt, factor = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            key = mixed(key ^ np.minimum.reduceat((values ^ salt) * (factor | np.uint64(1)), starts))
        keys[:, k] = (key & ~np.uint64(1)) | np.uint64(k >= side)
    return keys.view(np.int64)


def signatures(rows: DataFrame, size: int, side: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            sets = shingle_sets(*word_hashes(b.column("text"), lower=True), size)
            keys = iter(_keys(sets, side, width))
            names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            columns = [
                b.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([(h >> 64) - (1 << 63) for h in names], pa.int64()),
                pa.array([(h & ((1 << 64) - 1)) - (1 << 63) for h in names], pa.int64()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """``node, h1, h2, items`` of texts whose sets are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            sets = shingle_sets(*word_hashes(b.column("text"), lower=True), size)
            names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            columns = [b.column("doc_id"), pa.array([(h >> 64) - (1 << 63) for h in names], pa.int64()), pa.array([(h & ((1 << 64) - 1)) - (1 << 63) for h in names], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "h1", "h2", "items"])

    return rows.mapInArrow(run, "node long, h1 long, h2 long, items array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= percent * union, worked out on the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """Near-duplicate class of every row: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased (A-Z).  The smallest id of a component names it and is kept.  Null or
    empty text: empty set, its own component, kept.  Repeated rows: one component, equal results.
    A null id belongs to its text's component if that has an id and is then not kept; without one
    its component is null and it is kept.  Empty table: no rows.
    """
    rows = id_text(docs, id_col, text_col)
    signed = stage(signatures(rows, size, side, width), "mhsigned")
    nodes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = stage(nodes, "mhnodes")
    halves = nodes.select("node", F.explode("keys").alias("key"))
    shared = stage(halves.groupBy("key").count().where("count > 1").select("key"), "mhshared")
    live = halves.join(shared, "key", "left_semi").groupBy("node").agg(F.collect_set("key").alias("keys"))
    left, right = F.filter("keys", lambda k: k.bitwiseAND(1) == 0), F.filter("keys", lambda k: k.bitwiseAND(1) == 1)
    tables = live.select("node", F.explode(left).alias("l"), "keys").select("node", "l", F.explode(right).alias("r")).select("node", F.xxhash64("l", "r").alias("tab"))
    tables = stage(tables, "mhtables")
    hubs = stage(tables.groupBy("tab").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("tab", "hub"), "mhhubs")
    met = tables.join(hubs, "tab")
    pairs = stage(met.groupBy("node").agg(F.min("hub").alias("a")).where("a < node").select("a", F.col("node").alias("b")), "mhpairs")
    in_tables = stage(tables.join(hubs.select("tab"), "tab", "left_semi").select("node").distinct(), "mhmet")
    texts = by_key(rows, if_small(in_tables.withColumnRenamed("node", "doc_id")), ["doc_id"], "left_semi")
    sets = full_sets(texts, size)
    named = nodes.select("node", "h1", "h2")  # a repeated id with another text is not the node
    sets = stage(sets.join(named, ["node", "h1", "h2"], "left_semi").dropDuplicates(["node"]).select("node", "items"), "mhsets")
    edges = stage(linked(pairs, sets, percent), "mhedges")
    found = components(edges)
    label = lambda found: nodes.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    rows = _open_rows(tables, hubs, label(found), sets, percent)
    if not rows.isEmpty():
        diffs = _differences(rows, sets)
        g = (100 + percent) * F.col("s") - (100 - percent) * F.col("n")
        near = diffs.where(F.col("near") & (g <= (100 - percent) * F.col("n_hub")) & (F.col("node") != F.col("hub")))
        edges = edges.unionByName(stage(near.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")), "mhedges"))
        fresh = stage(_left_over(diffs, label(components(edges)).drop("n"), percent).join(pairs, ["a", "b"], "left_anti"), "mhpairs")
        edges = edges.unionByName(stage(linked(fresh, sets, percent), "mhedges"))
        found = components(edges)
    classes = nodes.select("h1", "h2", "node").join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    some, none = signed.where("n_shingles > 0"), signed.where("n_shingles = 0")
    out = some.join(classes, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    out = out.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of tables that still hold several components, with the smallest set size of the table."""
    tabs = rows.groupBy("tab").agg(F.min("component").alias("c_low"), F.max("component").alias("c_high"), F.min("n").alias("n_low")).where("c_low < c_high")
    return rows.join(tabs.select("tab", "n_low"), "tab")


def _open_rows(tables: DataFrame, hubs: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (tab, node, n, m, component) of mixed tables whose node may be linked across components.

    Shingles that no other such text has cannot be shared, so with ``m`` others a text of ``n``
    shingles shares at most ``m`` with any text, and a text linked with it has at most
    ``m * (100 + percent) / percent - n`` shingles.  Edited copies of one text, which fill a table
    without being linked, go by this bound before any pair of them is formed.
    """
    met = tables.join(hubs.select("tab"), "tab", "left_semi").join(info, "node")
    rows = stage(_mixed(met).select("tab", "node", "n", "component"), "mhmixed")
    items = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.explode("items").alias("item"))
    own = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    own = stage(own, "mhown")
    rows = rows.join(own, "node", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).drop("u").where(100 * F.col("m") >= percent * F.col("n"))
    rows = _mixed(rows).where((100 + percent) * F.col("m") >= percent * (F.col("n") + F.col("n_low"))).drop("n_low")
    return stage(_mixed(rows).drop("n_low"), "mhopen")


def _differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, n, cluster, hub, n_hub, near, s, items`` of open nodes: what each differs in from its cluster's hub.

    A cluster holds the components that are joined by common tables, its hub met in most of them.  For a
    node that shares at least half of the hub (``near``), ``items`` are the ``s`` shingles that only
    one of the two has, at most twice its own; for others all its shingles.
    """
    held = rows.select("tab", "component").distinct()
    lowest = held.groupBy("tab").agg(F.min("component").alias("a"))
    joined = components(held.join(lowest, "tab").where("a < component").select("a", F.col("component").alias("b")).distinct())
    joined = joined.select(F.col("component").alias("cluster"), F.col("node").alias("component"))
    open_nodes = rows.groupBy("node", "n", "m", "component").agg(F.count(F.lit(1)).alias("tabs")).join(joined, "component")
    open_nodes = stage(open_nodes, "mhclusters")
    hub = open_nodes.groupBy("cluster").agg(F.max(F.struct("tabs", F.col("m") / F.col("n"), "node", "n")).alias("h")).select("cluster", F.col("h.node").alias("hub"), F.col("h.n").alias("n_hub"))
    hub = stage(hub.join(sets.select(F.col("node").alias("hub"), F.col("items").alias("y")), "hub"), "mhclusterhubs")
    both = open_nodes.select("node", "n", "cluster").join(sets, "node").join(hub, "cluster")
    both = both.withColumn("lost", F.array_except("y", "items"))
    near = 2 * F.size("lost") <= F.col("n_hub")
    items = F.when(near, F.concat("lost", F.array_except("items", "y"))).otherwise(F.col("items"))
    return stage(both.select("node", "n", "cluster", "hub", "n_hub", near.alias("near"), F.size(items).cast("long").alias("s"), items.alias("items"), F.when(near, F.col("items")).alias("whole")), "mhdiffs")


def _left_over(diffs: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a cluster in different components that may be linked.

    Texts x and y of sizes n, m are linked if they differ in at most (n + m)(100 - p)/(100 + p)
    shingles; they differ in |X| + |Y| - 2 |X & Y|, where X and Y are their differences from the
    hub (or from the empty set, for a pair with a text far from the hub).  So X and Y must have
    enough in common, or none at all; then both are linked with the hub and in one component.  With
    the rarest items first, the first common one must leave enough items in either list.
    """
    far = diffs.where(~F.col("near")).select("cluster").distinct()
    by_hub = diffs.where("near").select("node", "n", "cluster", "s", "near", F.lit(True).alias("by_hub"), (-(100 - percent) * F.col("n_hub")).alias("low"), F.explode("items").alias("item"))
    whole = diffs.join(far, "cluster", "left_semi").withColumn("items", F.coalesce("whole", "items"))
    plain = whole.select("node", "n", "cluster", F.size("items").cast("long").alias("s"), "near", F.lit(False).alias("by_hub"), F.floor(2 * percent * percent * F.col("n") / 100).alias("low"), F.explode("items").alias("item"))
    items = stage(by_hub.unionByName(plain).join(label, "node"), "mhitems")
    keys = ["cluster", "by_hub", "item"]
    live = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("c_low"), F.max("component").alias("c_high"), F.min("near").alias("all_near"))
    live = stage(live.where("c_low < c_high AND (by_hub OR NOT all_near)").select(*keys, "c"), "mhlive")
    same = ["node", "n", "cluster", "s", "near", "by_hub", "low", "component"]
    listed = items.join(live, keys).groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("list"))
    placed = listed.select(*same, F.size("list").alias("k"), F.posexplode("list").alias("at", "x"))
    share = 2 * (100 + percent) * (F.col("k") - F.col("at"))
    g = (100 + percent) * F.col("s") - (100 - percent) * F.col("n")
    placed = stage(placed.withColumns({"share": share, "g": g}).where("share >= g + low").select("node", "cluster", "near", "by_hub", "component", "share", "g", F.col("x.item").alias("item")), "mhplaced")
    x, y = (placed.select(*keys, F.col("node").alias(k), *[F.col(v).alias(v + k) for v in ("near", "component", "share", "g")]) for k in "ab")
    fits = (F.col("a") < F.col("b")) & (F.col("componenta") != F.col("componentb")) & (F.least("sharea", "shareb") >= F.col("ga") + F.col("gb")) & (F.col("by_hub") | ~(F.col("neara") & F.col("nearb")))
    return x.join(y, keys).where(fits).select("a", "b").distinct()
