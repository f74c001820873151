"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the concatenation of all texts in id order, cut into blocks of ``BLOCK`` window
starts.  A text is parsed greedily against the blocks before it: each factor is the longest run of
words that also starts earlier in an indexed block, words compared; factors of ``window`` words or
more are duplicate spans.  The next factor is looked for ``window`` - 1 words before the end of the
last, so windows across the boundary of two factors or two blocks are found too.

A text meets only blocks that hold the first start of one of its windows.  These are found by hash:
each window names the smallest hash of its ``gram``-word runs, its anchor; equal windows name equal
anchors, so only windows whose anchor occurs twice are looked up.  A window that its block does not
hold (different windows of one hash) is looked up by its words.  Whole copies are settled by a
hash of all their words.  Texts move only to their lists; blocks and fragments meet by a join that
Spark splits where a block is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.ordering import dense_numbers
from feedloom.llm.common import by_key, id_text, ragged, run_hashes, smaller, unused, word_hashes
from feedloom.llm.exact import if_small
from feedloom.session import stage

WINDOW, GRAM = 20, 8
#: A place in the reference: number of the text times 2 ** SHIFT, plus the word's position.
SHIFT = 28
#: Window starts in a block of the reference; a long text has several blocks, a short one is its own.
BLOCK = 256
FACTOR = "num long, start long, length long, of long, slice long, source long"
EMPTY = hashlib.sha256(b"").hexdigest()


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def _windows(words: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows inside one text: start, anchor, and text; and the hash of every gram."""
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    counts = np.maximum(ends - begins - window + 1, 0)
    starts = ragged(begins, counts)
    grams = run_hashes(words, gram)
    anchors = _sliding(np.minimum, grams, window - gram + 1)[starts] if len(starts) else np.zeros(0, np.uint64)
    return starts, anchors, np.repeat(np.arange(len(ends)), counts), grams


def _selected(starts: np.ndarray, anchors: np.ndarray, owner: np.ndarray, grams: np.ndarray, window: int, gram: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every gram that some window names as its anchor, and how many each text has."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    width = window - gram + 1
    padded = np.zeros(len(grams) + width - 1, np.uint64)
    padded[starts + width - 1] = anchors
    at = np.flatnonzero((_sliding(np.maximum, padded, width) == grams) & (grams != 0))
    of = owner[np.minimum(np.searchsorted(starts, at, side="right"), len(starts)) - 1]
    return grams[at], np.bincount(of, minlength=n)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def contents(rows: DataFrame) -> DataFrame:
    """Word count, content hash and digest of each text's words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            n, high, low, sha = [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                split = t.split()
                joined = b" ".join(split)
                h = xxhash.xxh3_128_intdigest(joined)
                n.append(len(split))
                high.append((h >> 64) - (1 << 63))
                low.append((h & ((1 << 64) - 1)) - (1 << 63))
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "text_key", "n_words", "c1", "c2", "sha"])

    return rows.mapInArrow(run, "doc_id long, text_key long, n_words long, c1 long, c2 long, sha string")


def _anchor_lists(texts: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            found = _windows(*word_hashes(b.column("text")), window, gram)
            values, counts = _selected(*found, window, gram, b.num_rows)
            of = np.repeat(np.arange(b.num_rows), counts)
            order = np.lexsort((values, of))
            values, of = values[order], of[order]
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
            again = np.flatnonzero(~new)
            columns = [_lists(values[i].view(np.int64), np.bincount(of[i], minlength=b.num_rows), pa.int64()) for i in (np.flatnonzero(new), again)]
            yield pa.RecordBatch.from_arrays([b.column("num"), *columns], names=["num", "anchors", "again"])

    return texts.select("num", "text").mapInArrow(run, "num long, anchors array<long>, again array<long>")


def _candidates(b: pa.RecordBatch, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a batch whose anchor is among the text's recurring ones: hash, text, position; and where texts end."""
    words, ends = word_hashes(b.column("text"))
    starts, anchors, owner, _ = _windows(words, ends, window, gram)
    lists = b.column("anchors")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    sizes = np.diff(lists.offsets.to_numpy())
    salt = np.uint64(0x9E3779B97F4A7C15)
    keep = np.isin(anchors ^ (owner.astype(np.uint64) + np.uint64(1)) * salt, flat ^ (np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) + np.uint64(1)) * salt)
    starts, owner = starts[keep], owner[keep]
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return run_hashes(words, window)[starts] if len(starts) else np.zeros(0, np.uint64), owner, starts - begins[owner], ends


def _index_rows(texts: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """(hash of ``bits`` bits, place) of every candidate window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            hashes, owner, position, _ = _candidates(b, window, gram)
            place = (b.column("num").to_numpy(zero_copy_only=False)[owner] << SHIFT) + position
            yield pa.RecordBatch.from_arrays([pa.array((hashes >> np.uint64(64 - bits)).view(np.int64)), pa.array(place, pa.int64())], names=["window", "place"])

    return texts.select("num", "anchors", "text").mapInArrow(run, "window long, place long")


def _by_text(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """Where each text's part of a list column ends, and all its values."""
    lists = b.column(column)
    return np.cumsum(np.diff(lists.offsets.to_numpy())), lists.flatten()


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """The words of every reference block that some text refers to, and the fragments that refer to them.

    A fragment is a run of a text's windows that all start first in one block; ``start`` is null for a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            out: list[tuple] = []
            slice_ends, slices = _by_text(b, "slices")
            seed_ends, seeds = _by_text(b, "seeds")
            slices = slices.to_numpy(zero_copy_only=False)
            at, first = (seeds.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            nums = b.column("num").to_pylist()
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                split = text.split()
                for k in slices[slice_ends[i - 1] if i else 0 : slice_ends[i]].tolist():
                    out.append((nums[i], k, None, None, b" ".join(split[k * BLOCK : (k + 1) * BLOCK + window - 1])))
                part = slice(seed_ends[i - 1] if i else 0, seed_ends[i])
                order = np.argsort(at[part])
                start, source = at[part][order], first[part][order]
                if not len(start):
                    continue
                block = (source >> SHIFT << SHIFT) + (source & ((1 << SHIFT) - 1)) // BLOCK
                cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(block) != 0)) + 1
                for lo, hi in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(start)])).tolist(), strict=True):
                    x, y = int(start[lo]), int(start[hi - 1]) + window
                    out.append((int(block[lo]) >> SHIFT, int(block[lo]) & ((1 << SHIFT) - 1), nums[i], x, b" ".join(split[x:y])))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["of", "slice", "num", "start", "words"])

    return texts.select("num", "text", "slices", "seeds").mapInArrow(run, "of long, slice long, num long, start long, words binary")


def greedy_factors(words: list[bytes], block: list[bytes], index: dict[tuple, list[int]], window: int, ahead: int) -> Iterator[tuple[int, int, int]]:
    """Greedy parse of a fragment against an indexed block: (start, length, start in the block) of each factor.

    Each factor is the longest one at its start, words compared.  The next may begin ``window`` - 1 words before
    its end, so windows across a boundary of factors are looked up too.  A source starts before place ``ahead`` +
    start in the block (for a block of the same text).  Length 0: this window does not start in the block.
    """
    i, last = 0, len(words) - window
    while i <= last:
        best, source = 0, -1
        for s in index.get(tuple(words[i : i + window]), ()):
            if s >= ahead + i or len(block) - s <= best:
                break
            n, top = window, min(len(words) - i, len(block) - s)
            while n < top and words[i + n] == block[s + n]:
                n += 1
            if n > best:
                best, source = n, s
        yield i, best, source
        i += best - window + 1 if best else 1


def _parse(pairs: DataFrame, window: int) -> DataFrame:
    """Parses fragments next to their block; a block's index is kept while rows of the same block follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, block, index = None, [], {}
        for b in smaller(batches):
            out: list[tuple] = []
            for of, part, num, start, words, source in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if source != text:
                    text, block, index = source, source.split(), {}
                    for k in range(len(block) - window + 1):
                        index.setdefault(tuple(block[k : k + window]), []).append(k)
                base = part * BLOCK
                ahead = start - base if of == num else len(block)
                out += [(num, start + i, n, of, part, base + s) for i, n, s in greedy_factors(words.split(), block, index, window, ahead)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["num", "start", "length", "of", "slice", "source"])

    return pairs.select("of", "slice", "num", "start", "words", "block").mapInArrow(run, FACTOR)


def _spelled(texts: DataFrame, window: int) -> DataFrame:
    """The words of some windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            place, words = [], []
            for num, text, at in zip(b.column("num").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("at").to_pylist(), strict=True):
                split = text.split()
                place += [(num << SHIFT) + k for k in at]
                words += [b" ".join(split[k : k + window]) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(words, pa.binary())], names=["place", "words"])

    return texts.select("num", "text", "at").mapInArrow(run, "place long, words binary")


def _without(texts: DataFrame, with_text: bool) -> DataFrame:
    """Each text's words outside its factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            out: dict[str, list] = {"doc_id": [], "text_key": [], "n_removed": [], "sha": [], "starts": [], "lengths": [], "kept_text": []}
            ends, flat = _by_text(b, "factors")
            start, length = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                split = text.split()
                part = slice(ends[i - 1] if i else 0, ends[i])
                marks = np.zeros(len(split) + 1, np.int64)
                np.add.at(marks, start[part], 1)
                np.add.at(marks, start[part] + length[part], -1)
                gone = np.cumsum(marks[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = b" ".join([split[k] for k in np.flatnonzero(~gone)])
                out["doc_id"].append(b.column("doc_id")[i].as_py())
                out["text_key"].append(b.column("text_key")[i].as_py())
                out["n_removed"].append(int(gone.sum()))
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                out["starts"].append(edges[::2])
                out["lengths"].append(edges[1::2] - edges[::2])
                out["kept_text"].append(kept.decode() if with_text else None)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return texts.select("doc_id", "text_key", "text", "factors").mapInArrow(run, "doc_id long, text_key long, n_removed long, sha string, starts array<long>, lengths array<long>, kept_text string")


def _number(place: str) -> Column:
    return F.shiftright(place, SHIFT)


def _position(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << SHIFT) - 1)


def parsed(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, with_text: bool, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows' counts and digests; rows that copy an earlier row whole; texts without their factors; the factors; the numbers of texts."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    light = stage(contents(rows), "subcontents")
    long_enough = light.where(F.col("n_words") >= window)
    first = long_enough.groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f"))
    first = first.select("c1", "c2", F.col("f.doc_id").alias("doc_id"), F.col("f.text_key").alias("text_key"))
    numbered = stage(dense_numbers(first, [F.asc_nulls_last("doc_id"), F.asc("c1"), F.asc("c2")], "num", "subnumbers"), "subfirst")
    copies = long_enough.join(numbered.select("c1", "c2", F.col("doc_id").alias("f_id")), ["c1", "c2"]).where(~F.col("doc_id").eqNullSafe(F.col("f_id")))
    keys = ["doc_id", "text_key"]

    def with_texts(lists: DataFrame) -> DataFrame:
        """Texts next to lists that are kept by number."""
        named = stage(lists.join(numbered.select(*keys, "num"), "num"), "sublists")
        return by_key(by_key(rows, if_small(named.select(*keys)), keys, "left_semi"), named, keys)

    own = by_key(rows, if_small(numbered.select(*keys, "num")), keys)
    lists = stage(_anchor_lists(own, window, gram), "subanchors")
    anchors = lists.select("num", F.explode("anchors").alias("anchor"))
    # staged, so that both sides of the join are plain exchanges and Spark can split a hot anchor
    twice = stage(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "subtwice")
    shared = anchors.join(twice, "anchor", "left_semi").unionByName(lists.select("num", F.explode("again").alias("anchor")))
    index = stage(_index_rows(with_texts(shared.groupBy("num").agg(F.collect_set("anchor").alias("anchors"))), window, gram, bits), "subindex")
    firsts = stage(index.groupBy("window").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "first"), "subfirsts")
    later = stage(index.join(firsts, "window").where("place > first").select(_number("place").alias("num"), _position("place").cast("int").alias("at"), "first"), "sublater")
    named = later.select(_number("first").alias("num"), F.floor(_position("first") / BLOCK).alias("slice")).distinct()
    slices = named.groupBy("num").agg(F.collect_list("slice").alias("slices"))
    seeds = later.groupBy("num").agg(F.collect_list(F.struct("at", "first")).alias("seeds"))
    both = slices.join(seeds, "num", "full").select("num", F.coalesce("slices", F.array().cast("array<long>")).alias("slices"), F.coalesce("seeds", F.array().cast("array<struct<at:int,first:long>>")).alias("seeds"))
    pieces = stage(_pieces(with_texts(both), window), "subpieces")
    blocks = pieces.where("start IS NULL").select("of", "slice", F.col("words").alias("block"))
    factors = stage(_parse(pieces.where("start IS NOT NULL").join(blocks, ["of", "slice"]), window), "subparsed")
    missed = factors.where("length = 0").select((F.shiftleft("num", SHIFT) + F.col("start")).alias("place"))
    found = factors.where("length > 0")
    if not missed.isEmpty():
        # different windows of one hash: these alone are grouped by their words
        alike = index.join(index.join(missed, "place").select("window").distinct(), "window", "left_semi")
        at = alike.groupBy(_number("place").alias("num")).agg(F.collect_list(_position("place")).alias("at"))
        spelled = stage(_spelled(with_texts(at), window), "subspelled")
        sources = stage(spelled.groupBy("words").agg(F.min("place").alias("first")), "subsources")
        again = spelled.join(sources, "words").where("place > first")
        found = found.unionByName(again.select(_number("place").alias("num"), _position("place").alias("start"), F.lit(window).cast("long").alias("length"), _number("first").alias("of"), F.floor(_position("first") / BLOCK).alias("slice"), _position("first").alias("source")))
    cuts = found.groupBy("num").agg(F.collect_list(F.struct("start", "length")).alias("factors"))
    return light, copies.select(*keys, "n_words", "c1", "c2"), stage(_without(with_texts(cuts), with_text), "subfactors"), found, numbered


def duplicate_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Counts after removal: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``window`` words that covers it also starts earlier: at a smaller
    id, or earlier in the same text.  Null or empty text: no words.  Rows that repeat id and text
    are one document and get equal results.  Texts of one id are taken in order of their hash.
    Null ids come after all others.  Empty table: no rows.
    """
    light, copies, factors, _, _ = parsed(docs, id_col, text_col, window, gram, False)
    keys = ["doc_id", "text_key"]
    changed = copies.select(*keys, F.col("n_words").alias("gone"), F.lit(EMPTY).alias("left")).unionByName(factors.select(*keys, F.col("n_removed").alias("gone"), F.col("sha").alias("left")))
    found = by_key(light, changed.dropDuplicates(keys), keys, "left")
    return found.select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left", "sha").alias("kept_sha256"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """What the factors cover: ``doc_id, start, n_words`` (in words), null and repeated rows as in ``duplicate_words``."""
    _, copies, factors, _, _ = parsed(docs, id_col, text_col, window, gram, False)
    spans = factors.select("doc_id", F.explode(F.arrays_zip("starts", "lengths")).alias("s")).select("doc_id", F.col("s.starts").alias("start"), F.col("s.lengths").alias("n_words"))
    return copies.select("doc_id", F.lit(0).cast("long").alias("start"), "n_words").unionByName(spans)


def duplicate_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every factor with its source: ``doc_id, start, n_words, source_id, block, source_start`` (in words).

    ``block`` is the number of the ``BLOCK``-word block of the source text in which the factor's source starts.
    A whole copy is one factor.  Factors may overlap by ``window`` - 1 words; nulls, repeated rows and empty
    tables as in ``duplicate_words``.
    """
    _, copies, _, factors, numbered = parsed(docs, id_col, text_col, window, gram, False)
    zero = F.lit(0).cast("long")
    whole = copies.join(numbered.select("c1", "c2", F.col("doc_id").alias("source_id")), ["c1", "c2"])
    whole = whole.select("doc_id", zero.alias("start"), "n_words", "source_id", zero.alias("block"), zero.alias("source_start"))
    ids = numbered.select("num", "doc_id")
    parts = factors.join(ids, "num").join(ids.select(F.col("num").alias("of"), F.col("doc_id").alias("source_id")), "of")
    return whole.unionByName(parts.select("doc_id", "start", F.col("length").alias("n_words"), "source_id", F.col("slice").alias("block"), F.col("source").alias("source_start")))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the duplicate words taken out of the text (other words joined by a space); other texts and columns stay as they are."""
    _, copies, factors, _, _ = parsed(docs, id_col, text_col, window, gram, True)
    *keys, left = unused(docs, "__d", "__k", "__t")
    named = lambda df, text: df.select(F.col("doc_id").alias(keys[0]), F.col("text_key").alias(keys[1]), text.alias(left))
    changed = stage(named(copies, F.lit("")).unionByName(named(factors, F.col("kept_text"))).dropDuplicates(keys), "subchanged")
    marked = docs.withColumns({keys[0]: F.col(id_col), keys[1]: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    same = by_key(marked, if_small(changed.select(*keys)), keys, "left_anti").select(*docs.columns)
    rest = by_key(marked.drop(text_col), changed, keys).withColumnRenamed(left, text_col)
    return same.unionByName(rest.select(*docs.columns))


SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS t
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + {WINDOW - 1})))) AS places FROM later GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(list_filter(words, lambda x, k: NOT list_contains(places, k)), ' ') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
