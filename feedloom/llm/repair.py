"""Repair of conversation structure: a cheapest-edit DP over grammar-compressed role and fault sequences.

A turn is one of 16 symbols, the initial of its role and its fault.  Re-Pair turns pairs of symbols
that follow each other most often, counted over all conversations, into rules.  A symbol has a
min-plus transfer matrix over the four states of the grammar ``(s?(ua)+)?``, each entry with its audit;
a rule's matrix is the product of its two sides, its audits are ropes of theirs.  Rules are evaluated
bottom-up, once, and shared by all conversations.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import by_key, short_batches, smaller
from feedloom.session import stage

#: Role initials and faults, in the order of their numbers; any other initial is the last.
INITIALS, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
FIRST = ord("A")
#: Rules are kept as characters of a private-use range; a round makes at most ``EACH`` of them.
RULE, ROUNDS, EACH = 0xE000, 8, 32
#: Turns in one string of symbols; a conversation may have any number of strings.
RUN = 1024
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES, ACCEPT = 4, (0, 3)
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, initial) -> state
NAMES = ("", "user", "assistant")

Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


def flat(rope: Rope) -> str:
    out, left = [], [rope]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left += [x[1], x[0]]
    return "".join(out)


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> tuple[int, Rope]:
    """The cheaper, of equals the one whose audit comes first.

    Audits of the same cost and the same turns hold one letter for each turn, so none begins another
    and what comes first stays first whatever follows.
    """
    if a is None or b[0] < a[0]:
        return b
    return b if b[0] == a[0] and flat(b[1]) < flat(a[1]) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for k, x in enumerate(a[i]):
            for j, y in enumerate(b[k]) if x else ():
                if y:
                    out[i][j] = better(out[i][j], (x[0] + y[0], (x[1], y[1])))
    return out


def insertions() -> Matrix:
    """Cheapest insertions from each state to each other."""
    out: Matrix = [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]
    for _ in range(STATES):
        for (k, role), j in NEXT.items():
            for i in range(STATES):
                if role and out[i][k]:
                    out[i][j] = better(out[i][j], (out[i][k][0] + INSERT, flat(out[i][k][1]) + "I"))
    return out


INSERTIONS = insertions()


def turn_matrix(symbol: int) -> Matrix:
    """Insertions before a turn, then what is done to it."""
    initial, fault = symbol % 4, symbol // 4
    edit: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        edit[i][i] = (DELETE, "D")
        if fault < 2:
            for role in (0, 1, 2):
                j = NEXT.get((i, role))
                if j is not None and role == initial:
                    edit[i][j] = better(edit[i][j], (KEEP + fault * CUT_SHORT, "K"))
                elif j is not None and role:
                    edit[i][j] = better(edit[i][j], (REROLE + fault * CUT_SHORT, "R"))
    return product(INSERTIONS, edit)


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of every turn symbol and of every rule, its sides first."""
    out = {chr(FIRST + s): turn_matrix(s) for s in range(16)}
    for k, (left, right) in enumerate(rules):
        out[chr(RULE + k)] = product(out[left], out[right])
    return out


def compressed(text: str, rules: list[str]) -> str:
    for k, pair in enumerate(rules):
        text = text.replace(pair, chr(RULE + k))
    return text


def learn_rules(runs: DataFrame, rounds: int = ROUNDS, each: int = EACH) -> list[str]:
    """Re-Pair over ``runs`` (seq, n): in each round the most frequent pairs of symbols become rules.

    Pairs are counted over all runs; a round takes at most ``each`` of those that occur twice or more, so
    there are at most ``rounds * each`` rules.  What they leave uncompressed is evaluated symbol by symbol.
    """
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def count(batches: Iterator[pa.RecordBatch], known: list[str] = known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = compressed("\n".join(b.column("seq").to_pylist()) + "\n", known)
                code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                ends = code == 10
                weight = b.column("n").to_numpy()[np.cumsum(ends)[:-1].clip(max=b.num_rows - 1)] if b.num_rows else np.zeros(0, np.int64)
                inside = ~(ends[:-1] | ends[1:])
                pair, where = np.unique(code[:-1][inside] << 32 | code[1:][inside], return_inverse=True)
                times = np.zeros(len(pair), np.int64)
                np.add.at(times, where, weight[inside])
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times)], names=["pair", "n"])

        pairs = runs.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n >= 2")
        found = pairs.orderBy(F.desc("n"), "pair").limit(each).collect()  # the rules of this round
        if not found:
            break
        rules += [chr(r.pair >> 32) + chr(r.pair & 0xFFFFFFFF) for r in found]
    return rules


class Repairs:
    """Cheapest edits from the left, one compressed string of symbols after the other."""

    def __init__(self, steps: dict[str, list]):
        self.steps = steps
        self.done, self.best = [], [(0, ""), None, None, None]

    def add(self, symbols: str) -> None:
        for c in symbols:
            new: list = [None] * STATES
            for i, x in enumerate(self.best):
                for j, (cost, audit) in self.steps[c][i] if x else ():
                    cost += x[0]
                    if new[j] is None or cost <= new[j][0]:
                        y = (cost, x[1] + audit)
                        if new[j] is None or y < new[j]:
                            new[j] = y
            self.best = new
            tails = [x[1] for x in new if x]
            if len(tails[0]) > 64:  # what all of them begin with is settled
                n = len(os.path.commonprefix(tails))
                self.done.append(tails[0][:n])
                self.best = [x and (x[0], x[1][n:]) for x in new]

    def end(self) -> tuple[int, str]:
        last = [(x[0] + y[0], x[1] + flat(y[1])) for i, x in enumerate(self.best) if x for j in ACCEPT if (y := INSERTIONS[i][j])]
        cost, audit = min(last)
        return cost, "".join(self.done) + audit


def _steps(rules: list[str]) -> dict[str, list]:
    return {c: [[(j, (e[0], flat(e[1]))) for j, e in enumerate(row) if e] for row in m] for c, m in matrices(rules).items()}


def _counts(seq: str, before: int | None) -> tuple[np.ndarray, int]:
    """Blank, duplicate, truncated and illegal turns of a string, and its last initial."""
    code = np.frombuffer(seq.encode(), np.uint8).astype(np.int64) - FIRST
    initial, fault = code % 4, code // 4
    chain = initial if before is None else np.concatenate(([before], initial))
    pair = chain[:-1] * 4 + chain[1:]
    legal = np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
    return np.array([(fault == 2).sum(), (fault == 3).sum(), (fault == 1).sum(), (~legal).sum()]), int(initial[-1])


PLAN = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plans(runs: DataFrame, rules: list[str]) -> DataFrame:
    """Counts and cheapest edits of each conversation, from its strings in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, known, out = _steps(rules), {}, []
        at, whole, counts, before = (), None, None, None

        def close() -> None:
            if at:
                out.append((at[0], *map(int, counts), *whole.end()))

        for b in batches:
            for conv, seq, alone in zip(b.column("conv_id").to_pylist(), b.column("seq").to_pylist(), b.column("alone").to_pylist(), strict=True):
                if alone:  # most conversations: one string, and many share it
                    if seq not in known:
                        one = Repairs(steps)
                        one.add(compressed(seq, rules))
                        if len(known) >= 1 << 15:
                            known.clear()
                        known[seq] = (*map(int, _counts(seq, None)[0]), *one.end())
                    out.append((conv, *known[seq]))
                    continue
                if not at or at[0] != conv:
                    close()
                    at, whole, counts, before = (conv,), Repairs(steps), np.zeros(4, np.int64), None
                more, before = _counts(seq, before)
                counts = counts + more
                whole.add(compressed(seq, rules))
            yield _batch(out)
            out.clear()
        close()
        yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in PLAN.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(run, PLAN)


def _digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation: its turns pass in order under its audit, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        audit, place, state, sha, lines, out = "", 0, 0, None, 0, []

        def emit(role: str, text: str) -> None:
            nonlocal lines, state
            sha.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            lines += 1
            state = NEXT[state, INITIALS.index(role[:1])]

        def inserted() -> None:
            nonlocal place
            while place < len(audit) and audit[place] == "I":
                emit(NAMES[2 if state == 2 else 1], "")
                place += 1

        def close() -> None:
            if at:
                inserted()
                out.append((at[0], sha.hexdigest()))

        for b in smaller(batches):
            for conv, pos, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")], strict=True):
                if pos < 0:
                    close()
                    at, audit, place, state, sha, lines = (conv,), text, 0, 0, hashlib.sha256(), 0
                    continue
                inserted()
                letter = audit[place]
                place += 1
                if letter == "K":
                    emit(role, text)
                elif letter == "R":
                    emit(NAMES[2 if state == 2 else 1], text)
            yield _batch(out)
            out.clear()
        close()
        yield _batch(out)

    def _batch(pairs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["conv_id", "repaired_sha256"])

    lead = plans.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "pos", "role", "text").unionByName(lead)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` as a fixed hash of conversation and turn damages them."""
    blank = F.lit(" ")
    named = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def with_symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the place ``pos`` and the symbol ``sym`` of each row."""
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = Window.partitionBy("conv_id", "same").orderBy("pos")
    keyed = rows.withColumns({"pos": (F.row_number().over(place) - 1).cast("long"), "same": F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)})
    initial = F.substring("role", 1, 1)
    number: Column = F.lit(3)
    for k, c in reversed(list(enumerate(INITIALS))):
        number = F.when(initial == c, F.lit(k)).otherwise(number)
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(2))
        .when(F.row_number().over(same) > 1, F.lit(3))
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.lit(1))
        .otherwise(F.lit(0))
    )
    return keyed.select("conv_id", "turn", "role", "text", "pos", F.char(F.lit(FIRST) + 4 * fault + number).alias("sym"))


def repair(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """The faults and the cheapest repair of each conversation of ``originals`` (conv_id) that ``rows`` hold.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  Rows are
    taken by turn, nulls first; rows of one turn by role, then text.  A null conv_id is a conversation
    of its own.  A role of another initial than s, u, a, or an empty one, is never kept.  Repeated rows are
    duplicates.  Conversations without rows: zeros, empty audit, hash of the empty string.  Empty table: no
    rows.  Other columns are not read.
    """
    short_batches(rows.sparkSession)
    known = stage(with_symbols(rows), "repairrows")
    turns = known.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    runs = known.groupBy("conv_id", F.floor(F.col("pos") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "sym"))).alias("all"))
    runs = runs.select("conv_id", "run", F.array_join(F.transform("all", lambda x: x.sym), "").alias("seq"))
    last = known.groupBy("conv_id").agg((F.max("pos") < RUN).alias("alone"))
    runs = stage(by_key(runs, last, ["conv_id"]), "repairruns")
    plans = stage(_plans(runs, learn_rules(stage(runs.groupBy("seq").agg(F.count("*").alias("n")), "repairseqs"))), "repairplans")
    found = by_key(by_key(plans, _digests(known, plans), ["conv_id"]), turns, ["conv_id"])
    every = by_key(originals.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), found, ["conv_id"], "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows of ``conversations``; null role or text there counts as one space."""
    return repair(damaged(conversations), conversations)

