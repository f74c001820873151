"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their beginnings, hashed to slots.  Of all slots, those whose presence depends
most on the label (chi-square over every labelled row) are the features.  A factorization machine gives
each a weight and a vector; the product of two vectors weighs their meeting in one text, such as an
insult and the mention of a group, which a sum of weights cannot see.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import by_key, id_text, smaller
from feedloom.llm.exact import if_small
from feedloom.llm.langid import held_out
from feedloom.session import stage

WORDS = re.compile(r"[^\W\d_]+")
BITS = 22
#: A word's terms: itself and its beginnings of these lengths.
STEMS = range(4, 9)
#: Features of the model, and the least number of labelled rows that have one.
TERMS, SEEN = 512, 5
FACTORS, ROUNDS, STEP, SHRINK = 8, 100, 0.05, 1e-4
#: At most about this many labelled rows are learned from.
TRAIN_ROWS = 20_000
CUT = 0.5


def _slot(term: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def word_slots(word: str) -> list[int]:
    return [_slot(word + "$")] + [_slot(word[:k]) for k in STEMS if len(word) > k]


class Terms:
    """Terms of texts with their weights; remembers the slots of one task's words.

    ``place`` names the slots that count and their numbers (None: all).  A term's weight grows with the
    logarithm of its share of the text's words; texts of under ``SHORT`` words count as that long.
    """

    SHORT, MOST = 20, 1 << 19

    def __init__(self, place: dict[int, int] | None = None):
        self.place, self.known = place, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(WORDS.findall(text.lower()))
        if len(self.known) > self.MOST:
            self.known.clear()
        times: dict[int, int] = {}
        for w, n in words.items():
            at = self.known.get(w)
            if at is None:
                at = word_slots(w)
                at = self.known[w] = at if self.place is None else [self.place[s] for s in at if s in self.place]
            for s in at:
                times[s] = times.get(s, 0) + n
        total = max(self.SHORT, words.total())
        found = sorted(times)
        return np.array(found, np.int64), np.log1p(100 * np.array([times[s] for s in found], float) / total)


def _slotted(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in smaller(batches):
            found = [terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([s for s, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))],
                names=["doc_id", "label", "slots", "weights"],
            )

    return rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, slots array<long>, weights array<double>")


def chosen_terms(train: DataFrame, terms: int = TERMS, seen: int = SEEN) -> list[int]:
    """The ``terms`` slots (a parameter of the model's size) of greatest chi-square with the label."""
    sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not bad or not good:
        return []
    met = train.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("label").cast("double").alias("b"), F.count("*").cast("double").alias("m")).where(F.col("m") >= seen)
    n, b, m = F.lit(bad + good), F.col("b"), F.col("m")
    chi = n * F.pow(b * n - m * bad, 2) / (m * (n - m + 1e-9) * bad * good)
    return sorted(r.slot for r in met.orderBy(chi.desc(), "slot").limit(terms).collect())


def fit(train: DataFrame, terms: int = TERMS, factors: int = FACTORS) -> tuple[dict[int, int], float, np.ndarray, np.ndarray]:
    """Numbers of the slots, intercept, weights and vectors from ``train`` (label, slots, weights)."""
    place = {s: k for k, s in enumerate(chosen_terms(train, terms))}
    if not place:
        return place, 0.0, np.zeros(0), np.zeros((0, factors))

    @F.udf(VectorUDT())
    def vector(slots, weights):
        return SparseVector(len(place), {place[s]: x for s, x in zip(slots, weights, strict=True) if s in place})

    rows = stage(train.select(F.col("label").cast("double").alias("label"), vector("slots", "weights").alias("features")), "fmrows")
    model = FMClassifier(factorSize=factors, maxIter=ROUNDS, stepSize=STEP, regParam=SHRINK, initStd=0.01, seed=7).fit(rows)
    return place, float(model.intercept), model.linear.toArray(), model.factors.toArray()


def machine(at: np.ndarray, x: np.ndarray, intercept: float, weights: np.ndarray, vectors: np.ndarray) -> float:
    """The chance that a text with features ``at`` of values ``x`` is toxic."""
    v = vectors[at] * x[:, None]
    meet = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
    return float(1 / (1 + np.exp(-np.clip(intercept + (weights[at] * x).sum() + meet, -500, 500))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, part: int = 0, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text.

    Learned from labelled rows with crc32(id) mod ``parts`` other than ``part``, at most about
    ``train_rows`` of them, taken by the hash of the id.  Null text: as empty, scored like any text.
    Null label or id: not learned from; of several labels of one id the largest counts.  Repeated rows:
    each its own row.  One class or no label at all: every score is 0.5 of no features.  Empty table: no rows.
    """
    rows = id_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col(id_col), parts, part))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    taken = known if n <= train_rows else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    train = stage(_slotted(by_key(rows, if_small(stage(taken, "fmtaken")), ["doc_id"])), "fmtrain")
    place, intercept, weights, vectors = fit(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(place)
        for b in smaller(batches):
            scores = [machine(*terms(t), intercept, weights, vectors) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
