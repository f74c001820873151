"""Coarse and fine scoring with pyspark.ml models, and their fallbacks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import ScoreRules
from feedloom.functions.columns import flag, num, unit
from feedloom.functions.ordering import ranked
from feedloom.operators.encoders import assemble
from feedloom.session import stage

# ------------------------------------------------------------ latent factors


def latent_factors(train: DataFrame, dim: int = 64, iterations: int = 10, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """(users, items) as (id, vector) from implicit positives.

    ALS ids are 32-bit, so raw ids are numbered densely first and mapped back.
    """
    from feedloom.operators.encoders import fit_codes

    pos = train.filter(flag("is_positive") == 1).groupBy("user_id", "video_id").agg(
        F.count("*").cast("float").alias("rating")
    )
    users = fit_codes(pos, "user_id").select(F.col("value").alias("user_id"), F.col("code").cast("int").alias("u"))
    items = fit_codes(pos, "video_id").select(F.col("value").alias("video_id"), F.col("code").cast("int").alias("i"))
    coded = pos.join(users, "user_id").join(items, "video_id").select("u", "i", "rating")
    model = ALS(
        rank=dim, maxIter=iterations, implicitPrefs=True, alpha=10.0, userCol="u", itemCol="i", ratingCol="rating", seed=seed
    ).fit(coded)
    vec = unit("features").cast("array<float>").alias("vector")
    uf = model.userFactors.withColumnRenamed("id", "u").join(users, "u").select(F.col("user_id").alias("id"), vec)
    vf = model.itemFactors.withColumnRenamed("id", "i").join(items, "i").select(F.col("video_id").alias("id"), vec)
    return uf, vf


# ------------------------------------------------------------------ models


def fit_trees(
    train: DataFrame,
    columns: list[str],
    label: str = "label",
    validation: DataFrame | None = None,
    rounds: int = 20,
    depth: int = 5,
    rate: float = 0.1,
    seed: int = 2026,
):
    """Boosted trees on numeric columns; with ``validation`` rows the rounds stop early."""
    data = train.select(*columns, F.col(label).cast("double").alias("_y"), F.lit(False).alias("_val"))
    gbt = GBTClassifier(
        featuresCol="features",
        labelCol="_y",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=0.85,
        featureSubsetStrategy="0.85",
        seed=seed,
        minInstancesPerNode=5,
    )
    if validation is not None:
        held = validation.select(*columns, F.col(label).cast("double").alias("_y"), F.lit(True).alias("_val"))
        data = data.unionByName(held)
        gbt = gbt.setValidationIndicatorCol("_val")
    return gbt.fit(assemble(data, columns).select("features", "_y", "_val"))


def fit_mlp(train: DataFrame, columns: list[str], label: str = "label", hidden: tuple = (256, 128, 64), rounds: int = 40, seed: int = 2026):
    """Feed-forward classifier on the same columns (pass z-scored ones)."""
    data = train.select(*columns, F.col(label).cast("double").alias("_y"))
    mlp = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="_y", layers=[len(columns), *hidden, 2], maxIter=rounds, seed=seed, blockSize=256
    )
    return mlp.fit(assemble(data, columns).select("features", "_y"))


def mlp_probabilities(x: np.ndarray, layers: list[int], weights: np.ndarray) -> np.ndarray:
    """Positive-class probability of a ``MultilayerPerceptronClassificationModel``: sigmoid layers, softmax at the end."""
    at = 0
    for k, (a, b) in enumerate(zip(layers[:-1], layers[1:], strict=True)):
        x = x @ weights[at : at + a * b].reshape(a, b) + weights[at + a * b : at + (a + 1) * b]
        at += (a + 1) * b
        if k + 2 < len(layers):
            x = 1 / (1 + np.exp(-np.clip(x, -700, 700)))
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x[:, 1] / x.sum(axis=1)


def _predict_mlp(df: DataFrame, model, columns: list[str], name: str) -> DataFrame:
    """``predict`` for a perceptron: a batch of rows is one matrix product per layer."""
    layers, weights = list(model.getLayers()), model.weights.toArray()

    @F.arrow_udf("float")
    def score(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return pa.array(mlp_probabilities(rows, layers, weights).astype("float32") if len(x) else [], pa.float32())

    values = F.array(*[num(c, 0.0) if c in df.columns else F.lit(0.0) for c in columns])
    return df.select(*[c for c in df.columns if c != name], score(values).alias(name))


@dataclass(frozen=True)
class Forest:
    """All nodes of boosted trees: a row goes left where its ``feature`` is at most ``threshold``; a leaf leads to itself."""

    roots: np.ndarray
    weights: np.ndarray
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    value: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Positive-class probability of a ``GBTClassificationModel``."""
        flat, begin, margin = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            for _ in range(self.depth):
                left = flat.take(begin + self.feature.take(at)) <= self.threshold.take(at)  # not a number goes right
                at = self.children.take(2 * at + ~left)
            margin += weight * self.value.take(at)
        return 1 / (1 + np.exp(np.clip(-2 * margin, -700, 700)))


def forest(text: str) -> Forest | None:
    """The trees in the debug string of a model; None when a split is not by a threshold."""
    roots, weights, feature, threshold, children, value, deepest = [], [], [], [], [], [], 0
    above: list[int] = []  # split nodes from the root to here

    def node(f: int, t: float, v: float) -> int:
        at = len(feature)
        feature.append(f), threshold.append(t), value.append(v), children.append([at, at])
        if not above:
            roots.append(at)
        else:
            children[above[-1]][int(turned[-1])] = at
        return at

    turned: list[bool] = []
    for line in text.splitlines()[1:]:
        line = line.strip()
        if found := re.match(r"Tree \d+ \(weight ([^)]+)\):", line):
            above, turned = [], []
            weights.append(float(found[1]))
        elif found := re.match(r"If \(feature (\d+) <= ([^)]+)\)", line):
            at = node(int(found[1]), float(found[2]), 0.0)
            above.append(at), turned.append(False)
            deepest = max(deepest, len(above))
        elif re.match(r"Else \(feature \d+ > [^)]+\)", line):
            while turned[-1]:  # both sides of the splits below are done
                above.pop(), turned.pop()
            turned[-1] = True
        elif found := re.match(r"Predict: (\S+)", line):
            node(0, 0.0, float(found[1]))
        elif line:
            return None
    if len(roots) != len(weights):
        return None
    return Forest(np.array(roots), np.array(weights), deepest, np.array(feature), np.array(threshold), np.array(children).ravel(), np.array(value))


def _predict_trees(df: DataFrame, trees: Forest, columns: list[str], name: str) -> DataFrame:
    """``predict`` for boosted trees: a batch of rows walks down each tree at once."""

    @F.arrow_udf("float")
    def score(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return pa.array(trees.probabilities(rows).astype("float32") if len(x) else [], pa.float32())

    values = F.array(*[num(c, 0.0) if c in df.columns else F.lit(0.0) for c in columns])
    return df.select(*[c for c in df.columns if c != name], score(values).alias(name))


def predict(df: DataFrame, model, columns: list[str], name: str) -> DataFrame:
    """Positive-class probability as a new column; every input column is kept.

    Model input is held in one vector column and dropped again.
    """
    if isinstance(model, MultilayerPerceptronClassificationModel):
        return _predict_mlp(df, model, columns, name)
    if isinstance(model, GBTClassificationModel) and (trees := forest(model.toDebugString)) is not None:
        return _predict_trees(df, trees, columns, name)
    work = assemble(df.select("*", *[F.col(c).alias(f"_f_{c}") for c in columns if c in df.columns]), [f"_f_{c}" for c in columns])
    scored = model.transform(work).withColumn(name, F.element_at(vector_to_array("probability"), 2).cast("float"))
    return scored.select(*[c for c in df.columns if c != name], name)


def rank_score(tasks: dict | None = None):
    """Weighted sum of the task probabilities."""
    weights = tasks or ScoreRules().task_weights
    out = F.lit(0.0)
    for task, w in weights.items():
        out = out + F.lit(float(w)) * F.col(f"{task}_score").cast("double")
    return out.cast("float")


def ranked_candidates(scored: DataFrame) -> DataFrame:
    order = [F.col("rank_score").desc(), F.col("coarse_score").desc(), F.col("video_id").asc()]
    return ranked(scored, "user_id", order, "rank_position")


def degraded_scores(df: DataFrame) -> DataFrame:
    """Scores when a model is missing: merged score for coarse, coarse score for fine."""
    have = set(df.columns)
    merged = F.col("merged_score") if "merged_score" in have else F.lit(0.0)
    coarse = F.coalesce(F.col("coarse_score"), merged) if "coarse_score" in have else merged
    out = df.withColumn("coarse_score", coarse.cast("float"))
    fine = F.coalesce(F.col("rank_score"), F.col("coarse_score")) if "rank_score" in have else F.col("coarse_score")
    return out.withColumn("rank_score", fine.cast("float"))


# --------------------------------------------------- target-aware attention

#: History places or candidates of one user in a row, and partial sums merged at once.
BLOCK, MERGED = 256, 512
#: Vectors of a block (a task holds two blocks), rows of lists that one slot takes, and the least number of slots.
VECTORS, SLOT_ROWS, LEAST_SLOTS = 131_072, 262_144, 12
#: Candidates in an output batch.
OUT_ROWS = 65_536
CANDIDATE_VECTORS, HISTORY_VECTORS, LISTS = 0, 1, 2


def _side(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a block in id order."""
    ids, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _found(side: tuple, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all lists that have a vector, their places in the block, and the end of each list (0 first)."""
    ids, names = lists.flatten().to_numpy(), side[0]
    at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
    known = names[at] == ids
    ends = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
    return ids[known], at[known], np.concatenate(([0], np.cumsum(known)))[ends]


def _softmax_parts(c_ids: np.ndarray, c: np.ndarray, h_ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest logit, weights and weighted logits of each candidate over one block of history; -inf and 0 without one."""
    logits = c.astype(np.float64) @ h.astype(np.float64).T
    logits[c_ids[:, None] == h_ids[None, :]] = -np.inf
    top = logits.max(axis=1, initial=-np.inf)
    w = np.exp(logits - np.where(np.isfinite(top), top, 0.0)[:, None])
    return top, w.sum(axis=1), (w * np.where(np.isfinite(logits), logits, 0.0)).sum(axis=1)


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Softmax parts of the lists of a slot, which stream past the vectors of its two blocks."""
    at, parts, sides = None, [], []

    def scored(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (c_ids, c_at, c_end), (h_ids, h_at, h_end) = _found(sides[0], b.column("c")), _found(sides[1], b.column("h"))
        users, part = b.column("id").to_numpy(), b.column("part").to_numpy()
        out, first = [], 0
        for k in range(b.num_rows):
            c, h = slice(c_end[k], c_end[k + 1]), slice(h_end[k], h_end[k + 1])
            out.append(_softmax_parts(c_ids[c], sides[0][1][c_at[c]], h_ids[h], sides[1][1][h_at[h]]))
            if k + 1 == b.num_rows or c_end[k + 1] - c_end[first] >= OUT_ROWS:
                n = np.diff(c_end[first : k + 2])
                columns = [np.repeat(users[first : k + 1], n), c_ids[c_end[first] : c_end[k + 1]], np.repeat(part[first : k + 1], n), *(np.concatenate(x) for x in zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["user_id", "video_id", "part", "top", "w", "wl"])
                out, first = [], k + 1

    for b in batches:
        slot, kind = b.column("slot").to_numpy(), b.column("kind").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (kind[1:] != kind[:-1]), [True]))) if b.num_rows else []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            rows = b.slice(a, z - a)
            if slot[a] != at:
                at, parts, sides = slot[a], ([], []), []
            if kind[a] != LISTS:
                parts[kind[a]].append((rows.column("id").to_numpy(), rows.column("vector").flatten().to_numpy().reshape(z - a, -1)))
            elif parts[CANDIDATE_VECTORS]:
                if not sides:  # one block serves both sides when no other was sent
                    first = _side(parts[0])
                    sides, parts = [first, _side(parts[1]) if parts[1] else first], ([True], [])
                yield from scored(rows)


def _merge_softmax(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up softmax parts: each is rescaled from its own greatest logit to the common one."""
    one = parts.groupBy(*keys).agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "w", "wl")).alias("p"))
    scale = lambda x: F.when(x["top"] == F.col("m"), 1.0).otherwise(F.exp(x["top"] - F.col("m")))
    total = lambda name: F.aggregate("p", F.lit(0.0), lambda a, x: a + x[name] * scale(x))
    return one.select(*keys, F.col("m").alias("top"), total("w").alias("w"), total("wl").alias("wl"))


def interest_scores(candidates: DataFrame, histories: DataFrame, vectors: DataFrame, max_len: int | None = 50) -> DataFrame:
    """(user_id, video_id, interest_score): attention of each candidate over the user's history.

    The score is the dot product of the candidate with its softmax-weighted history, the target itself
    left out; 0 without known history.  It is the weighted mean of the logits, so three numbers per
    candidate and part of history are enough.  Users travel as short lists of ids, at most ``BLOCK``
    candidates against ``BLOCK`` places, and stream past blocks of vectors; no vector goes with a
    candidate.  A history of any length (``max_len`` None) is spread over tasks and its parts merged.
    """
    from feedloom.functions.columns import tail

    vec = stage(vectors.select(F.col("id").cast("bigint").alias("id"), "vector"), "attention-vectors")
    ids = stage(vec.select(F.col("id").alias("video_id")).distinct(), "attention-ids")
    blocks = max(1, -(-ids.count() // VECTORS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    known = candidates.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("video_id").cast("bigint").alias("video_id")).join(ids, "video_id", "left_semi")
    place = F.dense_rank().over(Window.partitionBy("user_id").orderBy("video_id"))
    run = known.select("user_id", "video_id", F.floor((place - 1) / BLOCK).alias("run"), block("video_id").alias("cb"))
    cand = run.groupBy("user_id", "run", "cb").agg(F.sort_array(F.collect_set("video_id")).alias("c"))
    seq = F.col("seq") if max_len is None else tail("seq", max_len)
    starts = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.floor((F.size("s") - 1) / BLOCK).cast("int")))
    hist = histories.select(F.col("user_id").cast("bigint").alias("user_id"), seq.cast("array<bigint>").alias("s"))
    hist = hist.select("user_id", "s", F.explode(starts).alias("part")).select("user_id", "part", F.slice("s", F.col("part") * BLOCK + 1, F.lit(BLOCK)).alias("h"))
    if blocks == 1:
        hist = hist.withColumn("hb", F.lit(0))
    else:
        hist = hist.withColumn("hb", F.explode(F.array_distinct(F.transform("h", block)))).withColumn("h", F.filter("h", lambda v: block(v) == F.col("hb")))
    none = F.array().cast("array<bigint>")
    lists = cand.join(hist, "user_id", "left").select("user_id", "run", "cb", F.coalesce("hb", "cb").alias("hb"), F.coalesce("part", F.lit(0)).cast("bigint").alias("part"), "c", F.coalesce("h", none).alias("h"))
    lists = stage(lists, "attention-lists")
    spread = max(1, -(-max(LEAST_SLOTS, -(-lists.count() // SLOT_ROWS)) // blocks**2))
    slots, number = blocks * blocks * spread, lambda c, h, r: ((c * blocks + h) * spread + r).cast("int")
    other, each = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, spread))
    own, gap = block("id"), F.lit(None)
    copies = vec.select("id", "vector", own.alias("b"), other.alias("o")).select("*", each.alias("r"))
    sent = lambda rows, c, h, kind: rows.select(number(F.col(c), F.col(h), F.col("r")).alias("slot"), F.lit(kind).alias("kind"), "id", F.lit(0).cast("bigint").alias("part"), none.alias("c"), none.alias("h"), "vector")
    users = lists.select(number(F.col("cb"), F.col("hb"), F.pmod(F.xxhash64("user_id", "run", "part"), F.lit(spread))).alias("slot"), F.lit(LISTS).alias("kind"), F.col("user_id").alias("id"), "part", "c", "h", gap.cast(vec.schema["vector"].dataType).alias("vector"))
    rows = sent(copies, "b", "o", CANDIDATE_VECTORS).unionByName(users)
    if blocks > 1:
        rows = rows.unionByName(sent(copies.where("b <> o"), "o", "b", HISTORY_VECTORS))
    rows = rows.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "kind")
    parts = rows.mapInArrow(_attention, "user_id bigint, video_id bigint, part bigint, top double, w double, wl double")
    keys = ["user_id", "video_id"]
    if blocks > 1 or max_len is None or max_len > BLOCK:  # else each candidate met its whole history at once
        parts = _merge_softmax(parts.withColumn("run", F.floor(F.col("part") / MERGED)), [*keys, "run"])
        parts = _merge_softmax(parts, keys)
    return parts.select(*keys, (F.col("wl") / F.greatest(F.col("w"), F.lit(1e-6))).alias("interest_score"))
