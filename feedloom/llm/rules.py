"""Quality rules by weak supervision.

Each rule votes good, bad or abstains.  Expectation-maximisation fits, for both classes, how
often each rule casts each vote, from the counts of the vote patterns (at most 3 ** rules rows,
whatever the input).  A row's posterior probability of being good decides.  SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import SPACES, id_text
from feedloom.llm.exact import UPPER
from feedloom.session import stage

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BAD, GOOD, NONE = 0, 1, 2
#: Rules: name, bad where, good where; a rule whose condition fails abstains.  Each fault has a rule
#: that can only vote bad; the two rules for good text ask for the absence of several faults.
#: The conditions are SQL that Spark and DuckDB read alike, over the counts of ``text_counts``.
RULES = [
    ("symbols", "n_symbols > 0.2 * n_words", "FALSE"),
    ("capitals", "n_capitals > 0.4 * word_chars", "FALSE"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "FALSE"),
    ("lines", "n_dup_lines > 0.6 * n_lines", "FALSE"),
    ("variety", "n_distinct < 0.1 * n_words", "FALSE"),
    ("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "FALSE"),
    ("sentences", "n_ends = 0 OR n_ends > 0.6 * n_words", "FALSE"),
    ("prose", "FALSE", "n_symbols < 0.1 * n_words AND n_capitals < 0.2 * word_chars AND n_repeat_words < 0.3 * n_words"),
    ("tidy", "FALSE", "n_symbols < 0.1 * n_words AND n_ends < 0.4 * n_words AND n_ends > 0.01 * n_words AND n_dup_lines <= 0.6 * n_lines"),
]
#: Where the fit starts and what it is drawn to: share of bad, good and no votes of a rule that can
#: vote bad, and of one that can vote good, in each class.
START = {
    "bad": {"FALSE": (0.2, 0.001, 0.799), "else": (0.001, 0.1, 0.899)},
    "good": {"FALSE": (0.01, 0.001, 0.989), "else": (0.001, 0.9, 0.099)},
}
#: Weight of the start against all rows, prior share of bad rows, number of rounds.
PULL, BAD_SHARE, ROUNDS = 0.3, 0.15, 25
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _windows(words: Column) -> Column:
    """One hash for each run of three words."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    triples = F.zip_with(pairs, F.slice(words, 3, F.greatest(n - 2, F.lit(0))), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    return F.slice(triples, 1, F.greatest(n - 2, F.lit(0)))


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash is found twice or more in the row."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def found(s: Column) -> Column:
        marked = F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])).alias("twice")))
        return F.array_sort(F.transform(F.filter(marked, lambda x: x["twice"]), lambda x: x["i"]))

    starts = F.transform(F.array(ordered), found)[0]  # the one-element array works ``ordered`` out once
    each = F.transform(F.array(starts), lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))))[0]
    return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text; see the module's rules for their use."""
    chars = F.btrim("text", F.lit(BLANK))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    split = id_text(docs, id_col, text_col).select(
        "doc_id",
        "text",
        F.when(chars == "", F.array().cast("array<string>")).otherwise(F.split(chars, SPACES)).alias("words"),
        lines.alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "words",
        _windows(F.col("words")).alias("windows"),
        F.array_join("words", "").alias("joined"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return counted.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(_without(F.col("joined"), SYMBOLS))).cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines",
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length("joined") - F.length(_without(F.col("joined"), ".!?"))).cast("long").alias("n_ends"),
        (F.length("joined") - F.length(F.translate("joined", UPPER, ""))).cast("long").alias("n_capitals"),
    )


def _start(kind: str, rule: int) -> tuple[float, float, float]:
    return START[kind]["FALSE" if RULES[rule][2] == "FALSE" else "else"]


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, list[list[float]], list[list[float]]]:
    """Expectation-maximisation over (votes, rows) pairs: share of bad rows, vote shares in the bad and the good class."""
    rows = sum(n for _, n in patterns)
    share, shares = BAD_SHARE, [[list(_start(c, r)) for r in range(n_rules)] for c in ("bad", "good")]
    if not rows:
        return share, shares[0], shares[1]
    for _ in range(ROUNDS):
        sums, mass = [[[0.0] * 3 for _ in range(n_rules)] for _ in range(2)], [0.0, 0.0]
        for votes, n in patterns:
            p = 1 - posterior_good(votes, share, *shares)
            for c, w in ((0, n * p), (1, n * (1 - p))):
                mass[c] += w
                for r, v in enumerate(votes):
                    sums[c][r][v] += w
        share = (mass[0] + PULL * rows * BAD_SHARE) / (rows * (1 + PULL))
        for c, kind, part in ((0, "bad", BAD_SHARE), (1, "good", 1 - BAD_SHARE)):
            pull = PULL * rows * part
            shares[c] = [[(s[v] + pull * _start(kind, r)[v]) / (mass[c] + pull) for v in range(3)] for r, s in enumerate(sums[c])]
    return share, shares[0], shares[1]


def posterior_good(votes: tuple[int, ...], share: float, bad: list[list[float]], good: list[list[float]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(bad[r][v] / good[r][v]) for r, v in enumerate(votes))
    return 1 / (1 + math.exp(min(odds, 700)))


def rule_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base test, posterior and verdict of every row.

    ``doc_id``, the counts of ``text_counts``, ``base_failed``, ``p_good``, ``kept``.  Null or empty
    text: no words, so the base test fails.  Ties (``p_good`` of exactly one half): kept.  Repeated
    rows: each has its row.  Null id: kept as null.  Empty table: no rows.
    """
    counts = text_counts(docs, id_col, text_col).withColumn("base_failed", F.expr(BASE_FAILED))
    votes = [F.expr(f"CASE WHEN {bad} THEN {BAD} WHEN {good} THEN {GOOD} ELSE {NONE} END").alias(f"v_{name}") for name, bad, good in RULES]
    names = [f"v_{name}" for name, _, _ in RULES]
    voted = stage(counts.select("*", *votes), "rulevotes")
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]  # at most 3 ** rules rows
    share, bad, good = fit_votes(sorted(patterns), len(RULES))
    odds = F.lit(math.log(share / (1 - share)))
    for r, name in enumerate(names):
        gain = [math.log(bad[r][v] / good[r][v]) for v in range(3)]
        odds = odds + F.when(F.col(name) == BAD, F.lit(gain[BAD])).when(F.col(name) == GOOD, F.lit(gain[GOOD])).otherwise(F.lit(gain[NONE]))
    kept = voted.withColumn("p_good", 1 / (1 + F.exp(odds)))
    return kept.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop(*names)


def _sql() -> str:
    n = len(RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN {BAD} WHEN {good} THEN {GOOD} ELSE {NONE} END AS v{r}" for r, (_, bad, good) in enumerate(RULES))
    names = ", ".join(f"v{r}" for r in range(n))
    lists = {c: "[" + ", ".join(str(float(x)) for r in range(n) for x in _start(c, r)) + "]" for c in START}
    odds = "ln(share / (1 - share))" + "".join(f" + ln(bad[{3 * r + 1} + v{r}] / good[{3 * r + 1} + v{r}])" for r in range(n))
    weight = {"bad": "(1 - p)", "good": "p"}
    part = {"bad": BAD_SHARE, "good": 1 - BAD_SHARE}
    fits = {
        c: "[" + ", ".join(f"(sum(CASE WHEN v{r} = {v} THEN rows_ * {weight[c]} ELSE 0 END) + {PULL} * {part[c]} * sum(rows_) * {_start(c, r)[v]}) / (sum(rows_ * {weight[c]}) + {PULL} * {part[c]} * sum(rows_))" for r in range(n) for v in range(3)) + "]"
        for c in START
    }
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 2)) AS i, unnest(list_transform(generate_series(1, len(words) - 2), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) AS t FROM w
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct,
         length(regexp_replace(text, '[^.!?]', '', 'g')) AS n_ends, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered USING (doc_id)
), voted AS (SELECT *, {votes} FROM c),
patterns AS (SELECT {names}, CAST(count(*) AS DOUBLE) AS rows_ FROM voted GROUP BY {names}),
em AS (
  SELECT 0 AS it, CAST({BAD_SHARE} AS DOUBLE) AS share, CAST({lists["bad"]} AS DOUBLE[]) AS bad, CAST({lists["good"]} AS DOUBLE[]) AS good
  UNION ALL
  SELECT it + 1, (sum(rows_ * (1 - p)) + {PULL} * {BAD_SHARE} * sum(rows_)) / (sum(rows_) * (1 + {PULL})), {fits["bad"]}, {fits["good"]}
  FROM (SELECT em.*, patterns.*, 1 / (1 + exp({odds})) AS p FROM em CROSS JOIN patterns WHERE it < {ROUNDS}) GROUP BY it
)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
       ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND 1 / (1 + exp({odds})) >= 0.5 AS kept
FROM voted CROSS JOIN (SELECT * FROM em WHERE it = {ROUNDS})
"""


SQL = _sql()
