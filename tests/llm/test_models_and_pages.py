"""Language, quality, pages, URL lists and the pipeline."""

import datetime
import zlib

import pandas as pd

import corpus_pipeline
from feedloom.llm import html, langid, quality, urls
from feedloom.llm.packing import pack_documents


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_of_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = {r.doc_id: r for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(known) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(table):
    docs = table([(1, None), (2, ""), (3, "12 34 ..."), (4, "the quick brown fox"), (None, "the fox"), (4, "the quick brown fox")])
    got = langid.identify(docs).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id or 9)] == ["und"] * 3 + ["en"] * 3
    assert langid.identify(table([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}


def test_quality_of_held_out_rows(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.rank_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.9 * len(held)


def test_quality_without_labels(table, spark):
    docs = table([(1, None), (1, None), (None, "x"), (2, "a " * 50_000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [round(r.score, 6) for r in quality.rank_quality(docs, none).collect()] == [0.3] * 4
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.rank_quality(docs, one).count() == 4 and quality.rank_quality(table([]), none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="nav-open">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies on this site.</div>
<div class="content"><h1>Head&amp;line &copy</h1><p>First <b>bold
 text</b> with <a href="x">a link</a>.<br>Second line<p>Unclosed paragraph &lt;tag&gt; here<ul><li>one<li>two</ul>
<div class="ad">Buy now</div><p>Short.</p><form>Name <input></form><table><tr><td>cell a<td>cell b</table></div>
<div class="comments"><p>A reader wrote a rather long comment about all of this and more.</p></div><aside>More</aside><footer>&copy; Site</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE) == "Head&line ©\n\nFirst bold text with a link. Second line\n\nUnclosed paragraph <tag> here\n\none\n\ntwo\n\nShort.\n\ncell a\n\ncell b"


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (4, "u", "no markup at all"), (4, "u", "no markup at all"), (5, "u", "<div>" * 5000 + "deep"), (6, "u", "<"), (7, "u", "<!-- open"), (8, "u", "<p>" + "word " * 200_000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert (text[2], text[3], text[4], text[5], text[None], text[8]) == ("", "", "no markup at all", "deep", "x", ("word " * 200_000).strip())
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_links_and_menus_without_names_go():
    page = "<body><div><ul>" + "<li><a href=x>menu entry</a>" * 20 + "</ul></div><div><h2>Title</h2>" + "<p>Some plain text that goes on for a while.</p>" * 5 + "</div></body>"
    assert html.main_text(page).startswith("Title\n\nSome plain") and "menu" not in html.main_text(page)


def test_all_parts_of_an_article_stay():
    title, p = "A title of thirty characters..", [f"{k:02} " + "plain words " * 16 for k in range(12)]
    both = [x.strip() for x in p]
    section = ["<section>" + "".join(f"<p>{x}" for x in half) + "</section>" for half in (p[:6], p[6:])]
    menu = "<ul>" + "<li><a href=x>menu entry</a>" * 9 + "</ul>"
    assert html.main_text(f"<body>{menu}<article><h1>{title}</h1>{section[0]}{section[1]}</article>{menu}</body>") == "\n\n".join([title, *both])
    assert html.main_text(f"<body><article><h1>{title}</h1><div class=body>{section[0]}</div></article></body>") == "\n\n".join([title, *both[:6]])
    assert html.main_text(f"<body><h1>{title}</h1>{section[0]}{menu}{section[1]}<div>All rights kept.</div></body>") == "\n\n".join([title, *both])
    loose = "<br>".join(p[6:])
    assert html.main_text(f"<body><div><a href=x>Home</a></div>{loose}{section[0]}</body>") == "\n\n".join([" ".join(both[6:]), *both[:6]])


def test_names_inside_an_article():
    p = "<p>" + "Some plain text that goes on for a while. " * 5
    for name in ("class=entry-header", "class='post-header wide'", "class=header", "class=related-work", "id=search-methods", "class=social-science"):
        assert html.main_text(f"<body><article><div {name}><h1>Title</h1></div>{p * 4}</article></body>").startswith("Title\n\nSome plain"), name
    assert "Mind the gap." in html.main_text(f"<body><main>{p * 2}<p class=notice-period>Mind the gap.{p * 2}</main></body>")
    for name in ("class=share", "class='wide ad'", "id=comments", "class=share-buttons", "class=related-posts"):
        assert "Gone" not in html.main_text(f"<body><article>{p * 4}<div {name}><a href=x>Gone</a></div></article></body>"), name
    for name in ("class=ad", "id=newsletter"):
        assert "Gone" not in html.main_text(f"<body><article>{p * 4}<div {name}>Gone</div></article></body>"), name
    assert "Gone" not in html.main_text(f"<body><div class=cookie-notice>Gone</div><div class=site-header>Gone</div><article>{p * 4}</article></body>")


def test_url_keys_of_any_depth(spark):
    d = datetime.date(2024, 1, 1)
    keys = ["a.b.c.example.co.uk", "localhost", "example.org/x/y", "example.org/x/y/z/w", "com", "v6.example.net/"]
    entries = spark.createDataFrame([(k, k, "add", d) for k in keys], "key string, category string, action string, day date")
    urls_ = {
        "http://q.w.a.b.c.example.co.uk/": "a.b.c.example.co.uk",
        "http://b.c.example.co.uk/": None,
        "http://localhost/x": "localhost",
        "http://example.org/x/y": "example.org/x/y",
        "http://example.org/x/y/z?q": "example.org/x/y",
        "http://example.org/x/y/z/w/v": "example.org/x/y/z/w",
        "http://example.org/x": None,
        "http://shop.com/x": "com",
        "http://v6.example.net/": "v6.example.net/",
        "": None,
        "http://example.org/" + "x/" * 50_000: None,
        "http://" + "l." * 5_000 + "com/": "com",
    }
    captures = spark.createDataFrame([(k, u, d) for k, u in enumerate(urls_)], "page_id long, url string, day date")
    got = {r.url: r.key for r in urls.judge(captures, entries).collect()}
    assert got == urls_


def plain_pairs(rows, each):
    """(good, bad) ids: each row against ``each`` rows of the other class."""
    return {label: sum(1 for _, y in rows if y == label) * each for label in (0, 1)}


def test_pairs_meet_every_row_and_no_row_of_their_own_class(spark):
    rows = [(i, int(i % 3 > 0), [float(i)]) for i in range(1500)]
    met = quality.pairs(spark.createDataFrame(rows, "doc_id long, label int, x array<double>"), 8).collect()
    assert len(met) == sum(plain_pairs([(i, y) for i, y, _ in rows], 8).values())
    assert all(int(r.good[0]) % 3 > 0 and int(r.bad[0]) % 3 == 0 for r in met)
    assert len({r.good[0] for r in met}) == 1000 and len({r.bad[0] for r in met}) == 500


def test_filters_hold_the_grams_that_plain_sets_hold(spark):
    texts = [("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("le chat et le chien", "fr")]
    langs, masks, chance = langid.fit_filters(spark.createDataFrame(texts, "text string, lang string"), 0.0, 0.0)
    plain = {lang: {int(g) for t, own in texts if own == lang for g in langid._grams(t)} for lang in langs}
    assert langs == ["de", "en", "fr"] and (chance < 1e-6).all()
    import numpy as np

    for g in set().union(*plain.values()):
        found = masks[0][[s[0] for s in langid._slots(np.array([g], np.uint64))]]
        held = np.bitwise_and.reduce(found)
        assert {lang for k, lang in enumerate(langs) if int(held) >> k & 1} == {lang for lang in langs if g in plain[lang]}


def test_url_lists_over_time(spark):
    d = datetime.date
    entries = spark.createDataFrame(
        [("b.example.com", "bad", "add", d(2024, 1, 10)), ("b.example.com", None, "remove", d(2024, 2, 1)), ("b.example.com", "worse", "add", d(2024, 3, 1)), ("example.org", "org", "add", d(2024, 1, 1)), ("a.example.org/x", "path", "add", d(2024, 1, 5)), (None, "n", "add", d(2024, 1, 1)), ("b.example.com", "bad", "add", d(2024, 1, 10))],
        "key string, category string, action string, day date",
    )
    rows = [(1, "http://b.example.com/q", d(2024, 1, 9)), (2, "HTTP://B.example.com:80/q", d(2024, 1, 10)), (3, "http://b.example.com", d(2024, 2, 1)), (4, "http://b.example.com?x", d(2024, 5, 1)), (5, "https://u@a.example.org/x/y#f", d(2024, 1, 6)), (6, "https://a.example.org/x", d(2024, 1, 4)), (7, None, d(2024, 1, 4)), (8, "nonsense", d(2024, 1, 4)), (9, "http://b.example.com", None), (2, "HTTP://B.example.com:80/q", d(2024, 1, 10))]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date").selectExpr("*", "1 AS key", "2 AS category")
    got = urls.judge(captures, entries).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.category for r in got} == {1: None, 2: "bad", 3: None, 4: "worse", 5: "path", 6: "org", 7: None, 8: None, 9: None}
    assert all(r.blocked == (r.category is not None) for r in got)
    assert urls.judge(captures.limit(0), entries).count() == 0 and not any(r.blocked for r in urls.judge(captures, entries.limit(0)).collect())


def test_pipeline_equals_plain_steps(spark, small):
    from tests.llm.test_dedup import UPPER, near, plain_substring

    docs = spark.read.parquet(f"{small}/documents.parquet")
    judged = {r.doc_id: r.kept for r in corpus_pipeline.rule_quality(docs).collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if judged[r.doc_id]]
    last = {}
    for i, t in sorted(left):
        last[t.translate(UPPER)] = i
    left = [(i, t) for i, t in left if last[t.translate(UPPER)] == i]
    classes = near(left, 5)
    left = [(i, t) for i, t in left if classes[i][1] == i]
    plain = plain_substring(left)
    left = [(i, plain[i, t][3] if plain[i, t][1] else t) for i, t in left]
    want = pack_documents(spark.createDataFrame(left, "doc_id long, text string")).toPandas()
    got = corpus_pipeline.run(spark, small).toPandas()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(got[names].sort_values(names, ignore_index=True), want[names].sort_values(names, ignore_index=True))
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_of_an_empty_table_and_a_long_text(spark, table):
    for docs, most in ((table([]), 0), (table([(1, "many different words " * 60_000), (2, None)]), 2)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            left = step(spark, docs, "")
            assert left.columns == docs.columns and left.count() <= most
            assert {r["__d"] for r in left.select("__d").collect()} <= {"clash"}


def test_stages_take_odd_rows(spark, table, tmp_path):
    docs = table([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 500), (4, "word " * 500)])
    for _, step in corpus_pipeline.STAGES[:-1]:
        left = step(spark, docs, "")
        assert left.columns == docs.columns and left.count() <= 6
    assert pack_documents(docs).count() == 6
