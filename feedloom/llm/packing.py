"""Best-fit packing by hierarchical residual packing.

Every task cuts its documents into pieces and packs them best-fit, longest first.  Bins that are
nearly full are final.  The others become items of the next round, in which groups of bins from
several tasks are packed best-fit again; the groups grow by ``fan_in`` a round until one is left
or nothing merges any more.  Only (bin, fill) pairs move between rounds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_text, smaller
from feedloom.llm.tokens import library_words, word_bpe
from feedloom.session import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"
PLACED = "bin long, into long, base long, total long"
#: Pieces packed at once in one task, which bounds its memory.
WINDOW = 200_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: the bin and the place of each item, and the fill of each bin.

    ``open_`` has bit f set when some bin has exactly f free; the lowest set bit at or above the
    size is the best fit.
    """
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fills = 0, []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_ &= ~(1 << free)
        else:
            b, free = len(fills), capacity
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += size
        by_free[free - size].append(b)
        open_ |= 1 << (free - size)
    return bins, places, fills


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[tuple]:
    known = library_words(path)
    for b in smaller(batches):
        ids, ends = known.batch(b.column(1))
        begin = 0
        for doc, end in zip(b.column(0).to_pylist(), ends, strict=True):
            whole = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
            for k in range(0, len(whole), capacity):
                cut = whole[k : k + capacity]
                yield doc, k // capacity, k, cut
            begin = end


def local_bins(docs: DataFrame, capacity: int, end_id: int, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of every document with their bin in the task, their place in it and the bin's fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, rows = TaskContext.get().partitionId(), 0, []

        def packed() -> pa.RecordBatch:
            nonlocal made
            sizes = np.array([r[3] for r in rows], np.int64)
            bins, places, fills = best_fit(sizes, capacity)
            columns = [*zip(*rows, strict=True), bins + made + (task << 40), places, np.array(fills, np.int64)[bins]]
            made += len(fills)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for doc, piece, start, cut in _pieces(batches, path, capacity, end_id):
            rows.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes())))
            if len(rows) >= window:
                yield packed()
                rows = []
        if rows:
            yield packed()

    return docs.mapInArrow(run, PIECES)


def merge_rounds(items: DataFrame, capacity: int, full: int, groups: int, fan_in: int, group_items: int) -> DataFrame | None:
    """Rounds of best-fit over ``items`` (bin, fill): each bin's final bin and its place there (bin, into, base)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        bins, places, fills = best_fit(pdf["fill"].to_numpy(), capacity)
        first = np.zeros(len(fills), np.int64)
        first[bins[places == 0]] = pdf["bin"].to_numpy()[places == 0]
        return pd.DataFrame({"bin": pdf["bin"], "into": first[bins], "base": places, "total": np.array(fills, np.int64)[bins]})

    left, final = items.count(), None
    while left:
        groups = max(1, math.ceil(left / group_items), groups)
        spread = items.withColumn("grp", F.pmod(F.xxhash64("bin"), F.lit(groups)))
        placed = stage(spread.groupBy("grp").applyInPandas(lambda pdf: pack(pdf[["bin", "fill"]]), PLACED), "packround")
        step = placed.select("bin", "into", "base")
        if final is None:
            final = step
        else:
            nxt = step.select(F.col("bin").alias("b2"), F.col("into").alias("i2"), F.col("base").alias("s2"))
            final = final.join(nxt, F.col("into") == F.col("b2"), "left").select(
                "bin", F.coalesce("i2", "into").alias("into"), (F.col("base") + F.coalesce("s2", F.lit(0))).alias("base")
            )
        if groups == 1:
            break
        items = placed.where((F.col("bin") == F.col("into")) & (F.col("total") < full)).select("bin", F.col("total").alias("fill"))
        before, left = left, items.count()
        smaller_groups = max(math.ceil(groups / fan_in), math.ceil(left / group_items))
        if smaller_groups >= groups and left > 0.999 * before:
            break  # bins over half full that no longer fit together
        groups = smaller_groups
    return final


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    path: str | None = None,
    slack: float = 0.01,
    fan_in: int = 16,
    group_items: int = 100_000,
) -> DataFrame:
    """Every piece with its sequence: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut.  A bin with at
    most ``slack`` of its room free is final at once.  Null or empty text: the end id alone.
    Repeated rows: each is packed.  A null id stays null.  Empty table: no rows.
    """
    path, full = path or word_bpe(), capacity - int(capacity * slack)
    pieces = stage(local_bins(id_text(docs, id_col, text_col), capacity, end_id, path), "pieces")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = pieces.where(F.col("fill") >= full).select(*keep, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    rest = pieces.where(F.col("fill") < full)
    items = rest.where(F.col("place") == 0).select("bin", "fill")
    tasks = items.select(F.shiftright("bin", 40).alias("task")).distinct().count()
    final = merge_rounds(items, capacity, full, math.ceil(tasks / fan_in), fan_in, group_items)
    if final is None:
        return done
    rest = rest.join(final, "bin").select(*keep, F.col("into").alias("sequence_id"), (F.col("base") + F.col("place")).alias("offset"))
    return done.unionByName(rest)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """The packed token arrays: ``sequence_id, ids``.  At most ``capacity`` ids meet in one group."""
    path = path or word_bpe()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, piece, _, ids in _pieces(batches, path, capacity, end_id):
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc], pa.int64()), pa.array([piece], pa.int32()), pa.array([zlib.crc32(ids.tobytes())], pa.int64()), pa.array([ids.astype("int32")], pa.list_(pa.int32()))],
                names=["d", "p", "c", "ids"],
            )

    kept = id_text(docs, id_col, text_col).mapInArrow(cut, "d long, p int, c long, ids array<int>").dropDuplicates(["d", "p", "c"])
    joined = packed.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("piece") == F.col("p")) & (F.col("ids_crc32") == F.col("c")))
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
