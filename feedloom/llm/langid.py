"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a slot holds the bitmask of the languages that set it,
so one lookup per hash tells all languages that hold an n-gram.  A language holds an n-gram that is
frequent in it and not much more frequent elsewhere.  A text's n-grams are looked up, the set bits
are counted per language, the share that chance would set (the filter's fill) is taken off, and the
largest rest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_text, mixed, smaller
from feedloom.session import stage

SIZES = (3, 4)
SLOTS, HASHES = 1 << 21, 3
#: An n-gram enters a language's filter at this share of its n-grams (so at most 1 / LEAST do), and
#: at this part of the largest share it has in any language.
LEAST, PART = 1e-5, 0.3
#: Languages per mask word.
WORD = 62
OTHER = re.compile(r"[\W\d_]+")


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def _grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text's letters, words set apart by one blank; none without a letter."""
    letters = OTHER.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    parts = []
    for n in SIZES:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, np.uint64(n))
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - n + 1 + j]
            parts.append(h)
    return mixed(np.concatenate(parts))


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    """Places of an n-gram in the filters: disjoint bits of its hash."""
    return [((grams >> np.uint64(21 * k)) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): counts over all of ``rows`` (text, lang); tasks add up their own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for b in smaller(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                grams = _grams(text)
                held.setdefault(lang, []).append(grams)
                size += len(grams)
                if size > 6_000_000:
                    yield from sums()
                    held, size = {}, 0
        yield from sums()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_filters(rows: DataFrame, least: float = LEAST, near: float = PART) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, masks [words, SLOTS] and the chance of a false hit per language, from ``rows`` (text, lang).

    ``least`` and ``near`` decide which n-grams a language's filter takes: those of at least that share of its
    n-grams, and of at least that part of the largest share in any language (0 and 0: every n-gram seen).
    What comes to the driver is the filter alone: SLOTS words for each 62 languages.
    """
    counts = stage(gram_counts(rows), "langgrams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    masks = np.zeros((max(1, -(-len(langs) // WORD)), SLOTS), np.uint64)
    if langs:
        share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(max(1, totals[lang])))])
        rates = counts.withColumn("rate", F.col("n") / share[F.col("lang")]).where(F.col("rate") >= least)
        top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
        kept = rates.join(top, "gram").where(F.col("rate") >= near * F.col("top"))
        number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])[F.col("lang")]
        slot = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("gram", 21 * k), F.lit(SLOTS)) for k in range(HASHES)]))
        bits = kept.select(number.alias("k"), slot.alias("slot")).select("slot", F.floor(F.col("k") / WORD).alias("word"), F.expr(f"shiftleft(1L, k % {WORD})").alias("bit"))
        got = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
        masks[got["word"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    fill = np.array([((masks[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean() for k in range(len(langs))])
    return langs, masks, fill**HASHES


def predict(rows: DataFrame, langs: list[str], masks: np.ndarray, chance: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` of ``rows`` (doc_id, text)."""
    model = rows.sparkSession.sparkContext.broadcast(masks)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for b in smaller(batches):
            names, scores = [], []
            for text in b.column("text").to_pylist():
                grams = _grams(text)
                if not len(grams) or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                slots = _slots(grams)
                hits = np.zeros(len(langs))
                for w in range(table.shape[0]):
                    found = table[w][slots[0]]
                    for s in slots[1:]:
                        found = found & table[w][s]
                    found = found[found != 0]
                    for k in range(w * WORD, min(len(langs), (w + 1) * WORD)):
                        hits[k] = np.count_nonzero(found & np.uint64(1 << (k % WORD)))
                real = np.maximum((hits / len(grams) - chance) / (1 - chance), 0)
                best = int(np.argmax(real))
                names.append(langs[best])
                scores.append(float(real[best] / real.sum()) if real.sum() > 0 else 1 / len(langs))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, least: float = LEAST, near: float = PART) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; rows with crc32(id) mod ``parts`` = ``part`` are not learned from.

    Null text, or one without a letter: ``und``, score 0.  Ties: the first language by name.
    Null language: predicted, not learned from.  Null id: not held out.  No language at all: ``und``.
    Repeated rows: each its own row.  Empty table: no rows.
    """
    rows = id_text(docs, id_col, text_col)
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col), parts, part))
    langs, masks, chance = fit_filters(known.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")), least, near)
    found = predict(rows, langs, masks, chance)
    return found.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "lang_pred", "score")
