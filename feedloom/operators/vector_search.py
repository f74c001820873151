"""Inner-product top-k: the exact search, and the scorer of the approximate ones.

Exact search holds a block of queries in a task and lets the items stream past it.  In the approximate
ones queries and items that meet in a cell are cut into blocks of bounded size, each block pair is one
matrix product in one task, and only the best k leave it.  A cell that holds a third of all items or
queries becomes many block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import VectorRules
from feedloom.functions.columns import fixed_sum, unit
from feedloom.functions.ordering import ranked, top_per
from feedloom.session import stage

SCORE_DIGITS = 9  # scores equal to this many digits are ties, ordered by id
#: Queries and items of one product in the exact search.
QUERY_ROWS, ITEM_ROWS = 512, 4096
#: Blocks of queries that are wanted, and the most queries, best rows and streamed items of a task.
BLOCKS, MOST_ROWS, MOST_HITS, MOST_ITEMS = 32, 32_768, 4_000_000, 4_000_000
#: Items that one wave of a search of many queries sends to its blocks of queries.
MOST_SENT = 32_000_000
_HIT = "query_id bigint, item_id bigint, score double"


def with_similarity(df: DataFrame, similarity: str) -> DataFrame:
    """Unit vectors for cosine, unchanged vectors for inner product."""
    if similarity == "cosine":
        return df.withColumn("vector", unit("vector").cast("array<float>"))
    if similarity in ("inner_product", "ip", "dot"):
        return df
    raise ValueError(f"unsupported similarity: {similarity}")


# ------------------------------------------------------------------ scorer


def _chunk_counts(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks needed per cell; one row per cell."""
    return df.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(rows))), F.lit(1)).cast("int").alias(name))


def _block_best(scores: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Mask of the ``need`` best columns per row; equal scores go to the earlier column."""
    width = scores.shape[1]
    keep = np.zeros(scores.shape, dtype=bool)
    # rows are handled per power of two of their need, so few partitions are made
    size = np.minimum(1 << np.ceil(np.log2(np.maximum(need, 1))).astype(int), width)
    for n in np.unique(size):
        rows = np.nonzero(size == n)[0]
        s = scores[rows]
        if n >= width:
            keep[rows] = True
            continue
        floor = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
        above = s > floor
        ties = s == floor
        room = n - above.sum(axis=1, keepdims=True)
        keep[rows] = above | (ties & (np.cumsum(ties, axis=1) <= room))
    return keep


def _block_product(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    if queries.empty or items.empty:
        return pd.DataFrame({"query_id": [], "item_id": [], "score": []}).astype(
            {"query_id": "int64", "item_id": "int64", "score": "float64"}
        )
    items = items.sort_values("id")
    q = np.stack(queries["qv"].to_numpy()).astype(np.float64)
    m = np.stack(items["vector"].to_numpy()).astype(np.float64)
    s = np.round(q @ m.T, SCORE_DIGITS)
    qi, ii = np.nonzero(_block_best(s, queries["need"].to_numpy()))
    return pd.DataFrame(
        {"query_id": queries["query_id"].to_numpy()[qi], "item_id": items["id"].to_numpy()[ii], "score": s[qi, ii]}
    )


def score_in_cells(queries: DataFrame, items: DataFrame, block_rows: int) -> DataFrame:
    """Best items per query and block.  queries: (query_id, qv, need, cell); items: (id, vector, cell)."""
    qn, inn = _chunk_counts(queries, block_rows, "qn"), _chunk_counts(items, block_rows, "inn")
    sizes = qn.join(inn, "cell")
    hash_to = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    q = (
        queries.join(sizes, "cell")
        .withColumn("qc", hash_to(F.col("query_id"), F.col("qn")))
        .withColumn("ic", F.explode(F.sequence(F.lit(0), F.col("inn") - 1)))
        .select("cell", "qc", "ic", "query_id", "qv", "need")
    )
    i = (
        items.join(sizes, "cell")
        .withColumn("ic", hash_to(F.col("id"), F.col("inn")))
        .withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
        .select("cell", "qc", "ic", "id", "vector")
    )
    keys = ["cell", "qc", "ic"]
    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(_block_product, _HIT)


def _without(hits: DataFrame, exclude: DataFrame | None) -> DataFrame:
    return hits if exclude is None else hits.join(exclude, ["query_id", "item_id"], "left_anti")


def _best(hits: DataFrame, k: int, exclude: DataFrame | None = None) -> DataFrame:
    order = [F.col("score").desc(), F.col("item_id").asc()]
    return top_per(_without(hits, exclude), "query_id", order, k, "rank")


def _queries(queries: DataFrame, k: int, exclude: DataFrame | None) -> DataFrame:
    """(query_id, qv, need): a query fetches k items plus as many as it must skip."""
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<float>").alias("qv"))
    if exclude is None:
        return q.withColumn("need", F.lit(int(k)).cast("bigint"))
    skipped = exclude.groupBy("query_id").agg(F.count("*").alias("_n"))
    return q.join(skipped, "query_id", "left").select(
        "query_id", "qv", (F.coalesce("_n", F.lit(0)) + F.lit(int(k))).cast("bigint").alias("need")
    )


def _pairs_to_skip(exclude: DataFrame | None) -> DataFrame | None:
    return None if exclude is None else exclude.select("query_id", "item_id").distinct()


class _Nearest:
    """The best ``k`` of the items that have passed, for each query of a block; equal scores go to the lower id."""

    def __init__(self, k: int):
        self.k, self.parts, self.left, self.size = k, [], [], 0
        self.ids = None

    def add_queries(self, b: pa.RecordBatch) -> None:
        skip = b.column("skip").fill_null([])
        lengths = np.diff(skip.offsets.to_numpy())
        self.parts.append((b.column("id").to_numpy(), _rows(b), lengths, skip.flatten().to_numpy()))

    def _begin(self) -> None:
        ids, m, lengths, skip = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.ids, self.m, self.skip, self.parts = ids, m, skip, []
        self.short, self.length = m.astype(np.float32), np.linalg.norm(m, axis=1)
        self.skip_ends = np.concatenate(([0], np.cumsum(lengths)))
        self.floor = np.full(len(ids), -np.inf)

    def add_items(self, b: pa.RecordBatch) -> None:
        if self.ids is None:
            if not self.parts:
                return
            self._begin()
        ids, m = b.column("id").to_numpy(), _rows(b)
        for i in range(0, len(ids), ITEM_ROWS):
            order = np.argsort(ids[i : i + ITEM_ROWS], kind="stable") + i
            rows = m[order]
            # how far a product of 32-bit floats may lie from the true one, for a query of length 1
            slack = (rows.shape[1] + 2) * 2.0**-23 * np.linalg.norm(rows, axis=1).max(initial=0)
            for q in range(0, len(self.ids), QUERY_ROWS):
                self._meet(q, min(q + QUERY_ROWS, len(self.ids)), ids[order], rows, rows.astype(np.float32), slack)

    def _skipped(self, q: int, end: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and columns of the pairs to leave out."""
        names, first, count = np.unique(ids, return_index=True, return_counts=True)
        gone = self.skip[self.skip_ends[q] : self.skip_ends[end]]
        at = np.minimum(np.searchsorted(names, gone), len(names) - 1)
        met = np.flatnonzero(names[at] == gone)
        rows, at = np.repeat(np.arange(end - q), np.diff(self.skip_ends[q : end + 1]))[met], at[met]
        n = count[at]  # an id that repeats has its columns side by side
        return np.repeat(rows, n), np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def _meet(self, q: int, end: int, ids: np.ndarray, m: np.ndarray, short: np.ndarray, slack: float) -> None:
        floor, length = self.floor[q:end], self.length[q:end]
        rough = bool(np.isfinite(floor).all() and slack < 1e12 and length.max() < 1e12)
        s = self.short[q:end] @ short.T if rough else np.round(self.m[q:end] @ m.T, SCORE_DIGITS)
        if self.skip_ends[q] < self.skip_ends[end]:
            s[self._skipped(q, end, ids)] = -np.inf
        if rough:  # few are above the floors of their queries: only these are multiplied exactly
            least = floor - slack * length - 2 * 10.0**-SCORE_DIGITS
            qi, ii = np.divmod(np.flatnonzero(s >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]), len(ids))
            exact = np.round(np.einsum("nd,nd->n", self.m[q:end].take(qi, axis=0), m.take(ii, axis=0)), SCORE_DIGITS)
            kept = exact >= floor[qi]
            qi, ii, found = qi[kept], ii[kept], exact[kept]
        else:
            keep = (s >= floor[:, None]) & (s > -np.inf)
            many = np.flatnonzero(keep.sum(axis=1) > self.k)
            if len(many):
                keep[many] &= _block_best(s[many], np.full(len(many), self.k))
                full = many[keep[many].sum(axis=1) == self.k]
                floor[full] = np.maximum(floor[full], np.where(keep[full], s[full], np.inf).min(axis=1))
            qi, ii = np.nonzero(keep)
            found = s[qi, ii]
        self.left.append((qi + q, ids[ii], found))
        self.size += len(qi)
        if self.size > 2 * self.k * len(self.ids) + ITEM_ROWS:
            self._cut()

    def _cut(self) -> None:
        if not self.left:
            return
        q, i, s = (np.concatenate(x) for x in zip(*self.left, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        best = place < self.k
        self.left, self.size = [(q[best], i[best], s[best])], int(best.sum())

    def hits(self) -> Iterator[pa.RecordBatch]:
        self._cut()
        for q, i, s in self.left:
            for k in range(0, len(q), 1 << 17):
                part = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q[part]]), pa.array(i[part]), pa.array(s[part])], names=["query_id", "item_id", "score"])


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)


def _past_queries(k: int):
    """Rows by (block, part, kind): the queries of a block, then the items of a part, which stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("block", "part", "kind")])
            cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [b.num_rows]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                block, part, kind = keys[:, a].tolist()
                if (block, part) != at:
                    if held is not None:
                        yield from held.hits()
                    at, held = (block, part), _Nearest(k)
                (held.add_items if kind else held.add_queries)(b.slice(a, z - a))
        if held is not None:
            yield from held.hits()

    return run


def stream_hits(queries: DataFrame, items: DataFrame, k: int, block_rows: int, skip: DataFrame | None, by: str = "id") -> DataFrame:
    """The best ``k`` items of each query within each part of the items, pairs of ``skip`` left out.

    A task holds one block of queries with their best so far; the items of its part stream past and are
    kept nowhere.  The blocks grow with the number of queries, so an item is sent to at most about
    ``BLOCKS`` of them until a block is as large as memory allows, and a query gives ``k`` rows for a part.
    ``by`` names the column that deals the items to parts.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
    if skip is None:
        q = q.withColumn("skip", F.lit(None).cast("array<bigint>"))
    else:
        q = q.join(skip.groupBy("query_id").agg(F.collect_list(F.col("item_id").cast("bigint")).alias("skip")), "query_id", "left")
    q = stage(q, "queries")
    asked, held = q.count(), items.count()
    rows = max(block_rows, min(-(-asked // BLOCKS), MOST_ROWS, MOST_HITS // max(k, 1)))
    blocks = max(1, -(-asked // rows))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-held // block_rows), -(-2 * cores // blocks)), -(-held // MOST_ITEMS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(F.lit("dealt"), c), F.lit(n)).cast("int")
    left = q.select(dealt("query_id", blocks).alias("block"), numbers(parts).alias("part"), F.lit(0).alias("kind"), F.col("query_id").cast("bigint").alias("id"), "vector", "skip")
    right = items.select(
        numbers(blocks).alias("block"), dealt(by, parts).alias("part"), F.lit(1).alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.lit(None).cast("array<bigint>").alias("skip")
    )
    met = left.unionByName(right).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "kind")
    return met.mapInArrow(_past_queries(k), _HIT)


def blocked_topk(queries: DataFrame, items: DataFrame, k: int, block_rows: int = 4096, exclude: DataFrame | None = None) -> DataFrame:
    """Exact top-k of a stated query set against all items, excluded pairs left out."""
    return _best(stream_hits(queries, items, k, block_rows, _pairs_to_skip(exclude)), k)


def waved_topk(queries: DataFrame, items: DataFrame, k: int, block_rows: int = 4096, exclude: DataFrame | None = None, most_sent: int = MOST_SENT, most_rows: int = MOST_ROWS) -> DataFrame:
    """``blocked_topk`` of any number of queries: each wave sends at most about ``most_sent`` items to blocks of queries.

    Memory and the disk of a wave stay the same however many queries and items there are; the products grow with
    queries x items.
    """
    asked, held = queries.count(), max(items.count(), 1)
    blocks = max(1, most_sent // held)  # of a wave
    if asked <= BLOCKS * most_rows and min(BLOCKS, -(-asked // block_rows)) <= blocks:
        return blocked_topk(queries, items, k, block_rows, exclude)
    rows = max(1, min(most_rows, MOST_HITS // max(k, 1)))
    waves, skip = -(-asked // (blocks * rows)), _pairs_to_skip(exclude)
    wave = lambda c: F.pmod(F.xxhash64(F.lit("wave"), c), F.lit(waves)) == number
    done = []
    for number in range(waves):
        mine = None if skip is None else skip.where(wave("query_id"))
        done.append(stage(blocked_topk(queries.where(wave("id")), items, k, rows, mine), f"wave-{number}"))
    return reduce(DataFrame.unionByName, done)


def exact_topk(
    queries: DataFrame, items: DataFrame, k: int, rules: VectorRules = VectorRules(), exclude: DataFrame | None = None
) -> DataFrame:
    """``blocked_topk`` with the block size of ``rules``."""
    return blocked_topk(queries, items, k, rules.block_rows, exclude)


def as_candidates(hits: DataFrame, source: str) -> DataFrame:
    return hits.select(
        F.col("query_id").alias("user_id"),
        F.col("item_id").alias("video_id"),
        F.lit(source).alias("recall_source"),
        F.col("score").alias("source_score"),
        F.col("rank").cast("bigint").alias("source_rank"),
    )


def vector_candidates(
    users: DataFrame,
    items: DataFrame,
    topk: int,
    source: str = "twotower",
    history: DataFrame | None = None,
    rules: VectorRules = VectorRules(),
    exact: bool = True,
) -> DataFrame:
    """Candidate contract from user vectors and item vectors, seen items removed before the cut."""
    drop = None
    if history is not None:
        drop = history.select(F.col("user_id").alias("query_id"), F.col("video_id").alias("item_id")).join(
            users.select(F.col("id").alias("query_id")), "query_id", "left_semi"
        )
    if exact:
        return as_candidates(exact_topk(users, items, topk, rules, drop), source)
    from feedloom.operators.ann import cell_search  # which builds on this module

    return as_candidates(cell_search(users, items, topk, exclude=drop), source)


# ----------------------------------------------------------------- profiles


def recency_profiles(histories: DataFrame, vectors: DataFrame, recency: float = 0.92) -> DataFrame:
    """(id, vector): unit recency-weighted mean of the known items of each list.

    histories: (user_id, seq), oldest first.  Places count known items only, and a
    user without any known item gets no row.
    """
    places = histories.select("user_id", F.posexplode("seq").alias("pos", "video_id"))
    known = places.join(vectors.select(F.col("id").alias("video_id"), "vector"), "video_id")
    back = ranked(known, "user_id", [F.col("pos").desc()], "back")
    weighted = back.select(
        "user_id",
        array_to_vector(F.col("vector").cast("array<double>")).alias("v"),
        F.pow(F.lit(float(recency)), F.col("back") - 1).alias("w"),
    )
    mean = weighted.groupBy("user_id").agg(Summarizer.mean(F.col("v"), F.col("w")).alias("m"))
    return mean.select(F.col("user_id").alias("id"), unit(vector_to_array("m")).cast("array<float>").alias("vector"))


def mean_vector(vectors: DataFrame) -> DataFrame:
    """One row: the mean of all vectors, the stand-in for an unknown user."""
    vec = array_to_vector(F.col("vector").cast("array<double>"))
    return vectors.agg(Summarizer.mean(vec).alias("m")).select(vector_to_array("m").alias("vector"))


# ------------------------------------------------------------------ quality


def overlap(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): share of the exact top-k that the approximate list found."""
    top = lambda d: d.filter(F.col("rank") <= k).select("query_id", "item_id")
    found = top(exact).join(top(approx).withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("overlap"))


def overlap_summary(per_query: DataFrame) -> DataFrame:
    """Overlap has at most k + 1 values, so exact percentiles need only their counts."""
    return per_query.agg(
        F.count("*").alias("queries"),
        (fixed_sum("overlap") / F.greatest(F.count("*"), F.lit(1))).alias("overlap_mean"),
        F.percentile("overlap", 0.5).alias("overlap_p50"),
        F.percentile("overlap", 0.95).alias("overlap_p95"),
        F.min("overlap").alias("overlap_min"),
        F.max("overlap").alias("overlap_max"),
    )
