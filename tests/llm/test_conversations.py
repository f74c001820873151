"""Conversation repair and prefix trie against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from feedloom.llm import repair, trie

ROWS = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def made(seed, convs=60, longest=9):
    """Conversations with all kinds of faults, nulls, ties and repeated rows."""
    r = random.Random(seed)
    out = []
    for c in r.sample(range(-20, 400), convs) + [None]:
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Hello there.", "What? ", "no end", "", "  \n", None, "So!", "x.\ny", " same text.", f"own {r.random()}."])
            out += [(c, r.choice([t, t, t, None, 2 * t]), role, text)] * r.choice([1, 1, 1, 2])
    return out


# ------------------------------------------------------------------ trie


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append((t is not None, t or 0, key, role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = {}
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        out[min(m), len(node)] = (
            min(members[node[:-1]]) if node else None,
            len(m),
            sum(len(x) == len(node) + 1 for x in below),
            sum(not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
            sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))),
        )
    return out


@pytest.mark.parametrize("seed, most", [(1, 22), (2, 2), (3, 12)])
def test_trie_equals_a_plain_one(spark, seed, most, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(trie, "RUN", 2)
    rows = made(seed, convs=120)
    for k in range(40):  # copies and shared beginnings
        rows += [(1000 + k, t, "user", f"t{t}") for t in range(3 + k % 4)]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS d", "2 AS pos", "3 AS n_convs").repartition(7)
    monkeypatch.setattr(trie, "LEAST", min(trie.LEAST, most))
    got = trie.prefix_trie(df, most).collect()
    want = plain_trie(rows)
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == want


def test_long_conversation_over_many_ranges(spark):
    rows = [(5, t, "user", f"é{t % 7}") for t in range(700)] + [(6, t, "user", f"é{t % 7}") for t in range(690)] + [(7, 0, "a", "x" * 200_000)]
    got = trie.prefix_trie(spark.createDataFrame(rows, ROWS).repartition(11)).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], ROWS)).count() == 0


# ---------------------------------------------------------------- repair


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest (cost, audit, lines) by a search over (row, state), whole strings in the queue."""
    n, done = len(rows), set()
    queue = [(0, "", 0, 0, ())]
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if at == n and state in (0, 3):
            return cost, audit, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(queue, (cost + 2, audit + "I", at, after, (*lines, role + ":")))
        if at < n:
            own, text, fault = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, lines))
            more = fault == "truncated"
            if fault in (None, "truncated"):
                heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, after, (*lines, f"{role}:{text}")))
                if own[:1] == role[:1] or (own[:1] == "s" and state == 0):
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, 1 if own[:1] == "s" else after, (*lines, f"{own}:{text}")))


def plain_repairs(rows):
    left = defaultdict(list)
    for c, t, role, text in plain_damage(rows):
        left[c].append((t is not None, t or 0, role, text))
    out = {}
    for c in {r[0] for r in rows}:
        mine, seen, marked = sorted(left[c]), set(), []
        for _, _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [x[1] for x in mine if x[0]]
        heads = [m[0][:1] or "-" for m in marked]
        cost, audit, lines = plain_repair(marked)
        counts = [sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(lines)))
    return out


@pytest.mark.parametrize("seed, run, rounds", [(1, 1024, 8), (2, 3, 3), (3, 1024, 0), (4, 2, 8)])
def test_repair_equals_a_plain_search(spark, seed, run, rounds, monkeypatch):
    monkeypatch.setattr(repair, "RUN", run)
    learn = repair.learn_rules
    monkeypatch.setattr(repair, "learn_rules", lambda runs: learn(runs, rounds))
    rows = made(seed, convs=150, longest=12)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS pos", "2 AS sym", "3 AS gaps", "4 AS audit").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    assert got == plain_repairs(rows)


def test_rules_give_the_same_matrix_as_their_turns(spark):
    r = random.Random(5)
    seqs = ["".join(r.choice("BCFGHIKNP") for _ in range(r.randint(1, 200))) for _ in range(50)]
    rules = repair.learn_rules(spark.createDataFrame([(s, 1) for s in seqs], "seq string, n long"))
    all_, steps = repair.matrices(rules), repair._steps([])
    assert rules and max(len(repair.compressed(s, rules)) / len(s) for s in seqs if len(s) > 50) < 0.8
    for s in seqs:
        whole, plain = repair.Repairs(repair._steps(rules)), repair.Repairs(steps)
        whole.add(repair.compressed(s, rules))
        plain.add(s)
        assert whole.end() == plain.end()
    assert len(all_) == 16 + len(rules)


def test_repair_of_nothing(spark):
    assert repair.repair_conversations(spark.createDataFrame([], ROWS)).count() == 0
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_conversations(spark.createDataFrame([(*dropped, "user", "x"), (None, None, "user", "y" * 300_000 + ".")], ROWS)).collect()
    assert {r.conv_id: (r.cost, r.audit, r.gaps) for r in got} == {dropped[0]: (0, "", 0), None: (2, "KI", 0)}
