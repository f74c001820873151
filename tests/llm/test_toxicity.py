"""Toxicity: what the machine computes, what it learns, odd inputs."""

import itertools
import random
import zlib

import numpy as np

from feedloom.llm import toxicity as tox

LABELS = "doc_id long, toxic int"


def test_machine_equals_its_formula():
    r = np.random.default_rng(3)
    w, v = r.normal(size=9), r.normal(size=(9, 4))
    for n in (0, 1, 5):
        at, x = r.permutation(9)[:n], r.random(n)
        z = 0.3 + sum(w[i] * a for i, a in zip(at, x, strict=True)) + sum((v[i] @ v[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(at, x, strict=True), 2))
        assert abs(tox.machine(at, x, 0.3, w, v) - 1 / (1 + np.exp(-z))) < 1e-12


def test_terms_of_a_text():
    terms = tox.Terms()
    at, x = terms("Insult, INSULT insulting 12 _a")
    words = [("insult", 2), ("insulting", 1), ("a", 1)]
    want = {}
    for w, n in words:
        for s in tox.word_slots(w):
            want[s] = want.get(s, 0) + n
    assert dict(zip(at.tolist(), x, strict=True)) == {s: np.log1p(100 * n / 20) for s, n in want.items()}
    assert tox.Terms({at[0]: 7})("Insult, INSULT insulting 12 _a")[0].tolist() == [7] and len(terms("")[0]) == 0


def test_terms_are_chosen_by_chi_square(spark):
    rows = [(k, k % 3 == 0, [1, 2] if k % 3 == 0 else [2, 3] if k % 2 else [2]) for k in range(60)] + [(99, True, [8])]
    train = spark.createDataFrame([(d, int(b), s) for d, b, s in rows], "doc_id long, label int, slots array<long>")
    assert tox.chosen_terms(train, 1) == [1] and tox.chosen_terms(train, 9) == [1, 2, 3]
    assert tox.chosen_terms(train.where("label = 0")) == []


def test_pairs_that_a_sum_of_weights_misses(spark):
    """An insult alone or a group alone is clean, and so is neither: only both are toxic; two of four other pairs mirror that."""
    r = random.Random(1)
    docs, labels = [], []
    for k in range(1200):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = [r.choice("abcdefghij") for _ in range(30)] + ["villain" if insult else "hero"] + ["islander" if group else "mainlander"]
        r.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(insult == group)))
    got = {x.doc_id: x for x in tox.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(got[k].predicted, y) for k, y in labels if got[k].held_out]
    assert len(held) > 150 and sum(p == y for p, y in held) >= 0.95 * len(held)


def test_held_out_rows(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.9 * len(held)


def test_odd_inputs(spark, table):
    docs = table([(1, None), (1, None), (None, "x"), (2, "word " * 100_000), (3, "")])
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in tox.toxicity(docs, none).collect()] == [0.5] * 5
    several = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None), (None, 1), (9, 1)], LABELS).selectExpr("*", "'clash' AS text", "1 AS label")
    assert tox.toxicity(docs, several).count() == 5 and tox.toxicity(table([]), several).count() == 0
