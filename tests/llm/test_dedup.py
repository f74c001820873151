"""Exact, near and substring dedup and the quality rules against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from feedloom.llm import exact, minhash, rules, substring
from feedloom.llm.components import components
from tools.check import compare, rows_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def rows(prose):
    base, r = prose(120, 1), random.Random(5)
    out = [(0, base), (1, base.upper()), (2, base), (3, None), (4, ""), (5, "  \n"), (6, "one two"), (7, "ONE two"), (8, "É é"), (9, "é É"), (2, base), (None, base), (None, "alone here")]
    for k in range(40):  # edited copies: some linked, some not, some only by way of others
        w = base.split(" ")
        for _ in range(k % 9):
            w[r.randrange(len(w))] = f"edit{k}"
        out.append((100 + k, " ".join(w)))
    passage = prose(30, 2)
    out += [(200 + k, f"{prose(25, 50 + k)} {passage} {prose(25, 90 + k)}") for k in range(6)]
    out += [(300, "go " * 70), (301, "x " * 20_000), (302, "a b c " * 15)]
    return out


def near(rows, size, percent=80):
    """Class of every id by comparing all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").translate(UPPER).encode().split()
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_classes_equal_all_pairs(table, rows, size):
    got = minhash.near_classes(table(rows), size=size).collect()
    assert len(got) == len(rows)
    want = near(rows, size)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, True)]


def test_edited_copies_on_both_sides_of_the_bound(table, prose):
    base, r, texts = prose(90, 7).split(" "), random.Random(11), []
    for k in range(150):  # from the base, from an edited copy, or half of each of two texts
        w = list(texts[r.randrange(len(texts))] if texts and k % 3 == 0 else base)
        if k % 10 == 9:
            w = w[: r.randrange(30, 60)] + prose(40, 500 + k % 20).split(" ")
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(25)}"
        texts.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(r.sample(texts, len(texts)))]
    want = near(rows, 4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_classes(table(rows), size=4).collect()} == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_near_classes_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = near([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_classes(docs).collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 99)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {k: 1 for k in range(1, 61)} | {99: 99, 100: 99}


@pytest.mark.parametrize("small", [True, False])
def test_exact_groups(table, rows, monkeypatch, small):
    if not small:
        monkeypatch.setattr(exact, "if_small", lambda df: df)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    got = exact.exact_groups(table(rows), digest=True).collect()
    assert len(got) == len(rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        ids = by_text[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (max(known) if known else None) and r.group_size == len(ids) and r.kept == (r.doc_id == r.keep_id)


def test_drop_copies_keeps_one_of_each(table, rows):
    left = exact.drop_copies(table(rows)).collect()
    assert Counter((r.text or "").translate(UPPER) for r in left) == Counter({(t or "").translate(UPPER) for _, t in rows})
    assert "clash" in left[0].kept


def plain_substring(rows, window=20):
    seen, out = {}, {}
    order = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda x: x[:2])
    for none, i, t in order:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.setdefault(key, (i, k))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[None if none else i, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_duplicate_words_equal_a_plain_scan(table, rows):
    want = plain_substring(rows)
    got = substring.duplicate_words(table(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *want[i, t or ""][:3]) for i, t in rows)


def test_without_duplicates_changes_only_what_repeats(table, rows):
    want = plain_substring(rows)
    got = {(r.doc_id, r.text) for r in substring.without_duplicates(table(rows)).collect()}
    assert got == {(i, want[i, t or ""][3] if want[i, t or ""][1] else t) for i, t in rows}
    spans = substring.duplicate_spans(table(rows)).groupBy("doc_id").sum("n_words").collect()
    assert {r[0]: r[1] for r in spans if r[0] not in (None, 2)} == {i: v[1] for (i, _), v in want.items() if v[1] and i not in (None, 2)}


def test_excerpts_of_earlier_texts_go_whole(table, prose):
    words, passage = [f"w{k}" for k in range(200)], " ".join(f"p{k}" for k in range(30))
    rows = [(1, " ".join(words)), (2, " ".join(words[40:120])), (3, " ".join(words[:60])), (4, f"{prose(25, 4)} {passage}"), (5, passage), (6, f"{passage} {prose(25, 5)}"), (7, " ".join(words[50:150] + words[10:40])), (None, " ".join(words[99:130]))]
    want = plain_substring(rows)
    assert [want[i, t][1] for i, t in rows] == [0, 80, 60, 0, 30, 30, 130, 31]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.duplicate_words(table(rows)).collect()} == {i: want[i, t][:3] for i, t in rows}
    assert {r.doc_id: r.text for r in substring.without_duplicates(table(rows)).collect()} == {i: want[i, t][3] for i, t in rows}
    spans = substring.duplicate_spans(table(rows)).groupBy("doc_id").sum("n_words").collect()
    assert {r[0]: r[1] for r in spans} == {i: want[i, t][1] for i, t in rows if want[i, t][1]}


def test_greedy_factors_are_the_longest():
    r = random.Random(3)
    for _ in range(300):
        block = [b"%d" % r.randrange(3) for _ in range(r.randrange(30))]
        words = [b"%d" % r.randrange(3) for _ in range(r.randrange(30))]
        index = defaultdict(list)
        for k in range(len(block) - 2):
            index[tuple(block[k : k + 3])].append(k)
        ahead = r.choice([len(block), r.randrange(10)])
        got = {i: (n, s) for i, n, s in substring.greedy_factors(words, block, index, 3, ahead)}
        covered = set()
        for i in range(len(words) - 2):
            best = max((next((n for n in range(min(len(words) - i, len(block) - s), 2, -1) if words[i : i + n] == block[s : s + n]), 0) for s in range(min(len(block), ahead + i))), default=0)
            if i in got:
                n, s = got[i]
                assert n == best and (not n or words[i : i + n] == block[s : s + n] and s < ahead + i)
                covered.update(range(i, i + n))
            elif best:
                assert {i, i + 1, i + 2} <= covered


@pytest.fixture(scope="module")
def pasted(prose):
    """Long texts of several blocks, passages across block boundaries, repeats within one text."""
    r, texts = random.Random(8), [prose(900, 60).split(" ")]
    for k in range(12):
        w = prose(40, 70 + k).split(" ")
        for _ in range(5):
            old = r.choice(texts)
            at = r.randrange(max(1, len(old) - 30))
            w += old[at : at + r.randrange(15, 400)] + (prose(5, r.randrange(99)).split(" ") if r.random() < 0.5 else [])
        texts.append(w + w[10:60] if k % 3 == 0 else w)
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


@pytest.mark.parametrize("bits,small", [(64, True), (64, False), (5, True)])
def test_parsing_of_long_texts(table, pasted, monkeypatch, bits, small):
    if not small:
        monkeypatch.setattr(substring, "if_small", lambda df: df)
    want = plain_substring(pasted)
    _, copies, cut, found, numbered = substring.parsed(table(pasted), "doc_id", "text", 20, 8, True, bits)
    assert copies.isEmpty()
    assert {r.doc_id: (r.n_removed, r.sha, r.kept_text) for r in cut.collect()} == {i: v[1:] for (i, _), v in want.items() if v[1]}
    words = {r.num: pasted[r.doc_id][1].split(" ") for r in numbered.collect()}
    for f in found.collect():
        assert f.length >= 20 and (f.of, f.source) < (f.num, f.start) and f.slice == f.source // substring.BLOCK
        assert words[f.num][f.start : f.start + f.length] == words[f.of][f.source : f.source + f.length]


def test_factors_name_their_source(table, rows):
    words = {i: split(t) for i, t in rows}
    got = substring.duplicate_factors(table([x for x in rows if x[0] is not None])).collect()
    for f in got:
        assert words[f.doc_id][f.start : f.start + f.n_words] == words[f.source_id][f.source_start : f.source_start + f.n_words]
    assert {f.doc_id for f in got if f.n_words >= 120 and f.source_id == 0} >= {2, 100}


def test_rules_equal_sql_on_odd_texts(spark, table, rows):
    docs = table([(k, t) for k, (_, t) in enumerate(rows)] + [(9001, "a\rb\fc d\x0be"), (9002, "\r\n\f\n \x0b")], clash=False)
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    cur = con.execute(rules.SQL)
    names = [d[0] for d in cur.description]
    got = rules.rule_quality(docs).select(*names)
    assert compare(rows_of(names, got.collect()), rows_of(names, cur.fetchall())) is None


def test_rules_find_junk_and_keep_prose(table, prose):
    good = [(k, prose(80 + k, k)) for k in range(60)]
    bad = [(100, " ".join(f"{w}###" for w in prose(90).split())), (101, "same same word " * 40), (102, prose(90).upper().replace(" ", "!! "))]
    got = {r.doc_id: r.kept for r in rules.rule_quality(table(good + bad)).collect()}
    assert [i for i, k in got.items() if not k] == [100, 101, 102] or {i for i, k in got.items() if not k} == {100, 101, 102}


def test_empty_tables(table):
    none = table([])
    assert exact.exact_groups(none).count() == minhash.near_classes(none).count() == substring.duplicate_words(none).count() == rules.rule_quality(none).count() == 0
    assert exact.drop_copies(none).count() == substring.without_duplicates(none).count() == substring.duplicate_factors(none).count() == 0
