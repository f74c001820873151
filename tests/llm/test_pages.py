"""Main text of pages of many shapes: wrappers, forms, comment threads, related links."""

import pytest

from feedloom.llm import html

P = ["Some plain text that goes on for a while, with words enough to be an article. " * 3 + f"Part {k}." for k in range(5)]
TEXT = "\n\n".join(["A title", *P])
BODY = "<h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in P)
LINKS = "<ul>" + "<li><a href=x>some menu entry</a></li>" * 12 + "</ul>"
NOISE = "<div class=site-header><a href=/>The site</a></div><nav>" + LINKS + "</nav>"
END = "<footer>All rights kept.</footer>"
THREAD = "".join(f"<div class=comment><p>Reader {k} wrote that this was {'really ' * k}worth the time.</p></div>" for k in range(12))

#: Wrappers of the whole page whose names only sound like menus, adverts or comments.
WRAPPERS = ["class='site has-sidebar'", "class='no-comments'", "class='container sidebar-right'", "class=search-engine-article", "id=aspnetForm", "class='page-with-banner'", "role=form", "class='content modal-open'", "id=share", "class='sponsored'"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>", "<main><div>{}</div></main>"])
def test_wrappers_do_not_lose_the_page(name, inner):
    tag = "form" if "Form" in name else "div"
    page = f"<html><body><{tag} {name}>{NOISE}{inner.format(BODY)}{END}</{tag}></body></html>"
    assert html.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["page-header", "entry-header", "post-header", "article-header wide"])
def test_titles_in_headers_of_the_text_stay(name):
    assert html.main_text(f"<body>{NOISE}<div class='{name}'><h1>A title</h1></div>{BODY[len('<h1>A title</h1>'):]}{END}</body>") == TEXT


@pytest.mark.parametrize("name", ["class=ad-slot", "class=cookie-notice", "class=newsletter-signup", "class=user-comments", "class=comment-list", "id=responses", "class='share-buttons'", "class=advert", "role=complementary", "id=disqus_thread"])
@pytest.mark.parametrize("inside", [True, False])
def test_named_blocks_beside_or_in_the_article_go(name, inside):
    block = f"<div {name}><p>Gone, with rather more words than one would think of.</p></div>"
    page = f"<body>{NOISE}<article>{BODY}{block if inside else ''}</article>{'' if inside else block}{END}</body>"
    assert html.main_text(page) == TEXT


@pytest.mark.parametrize("start, end", [("<article>", "</article>"), ("<div class=text>", "</div>"), ("", "")])
def test_long_comment_threads_go(start, end):
    """The readers write more than the author."""
    page = f"<body>{start}{BODY}{end}<section id=comments><h2>Comments</h2>{THREAD * 6}</section></body>"
    assert html.main_text(page) == TEXT


def test_comments_that_are_articles_go():
    thread = "".join(f"<article class=comment><p>Reader {k} wrote a line or two.</p></article>" for k in range(9))
    assert html.main_text(f"<body><article>{BODY}</article><div class=comments>{thread}</div></body>") == TEXT


@pytest.mark.parametrize("links", [f"<div class=related-reading>{LINKS}</div>", f"<aside>{LINKS}</aside>", f"<div>{LINKS}</div>", f"<form action=/s><input name=q>{LINKS}</form>"])
def test_related_links_go(links):
    assert html.main_text(f"<body>{NOISE}<article>{BODY}</article>{links}{END}</body>") == TEXT
    assert html.main_text(f"<body>{links}<div>{BODY}</div>{NOISE}</body>") == TEXT


def test_a_page_of_one_named_block_keeps_its_text():
    assert html.main_text("<body><div class=notice><p>The only text of this page.</p></div></body>") == "The only text of this page."
    assert html.main_text("<body><div id=comments><p>Just one line.</p></div></body>") == "Just one line."


def plain_counts(node):
    """Characters, tags, link characters and link tags of a subtree, counted anew by recursion."""
    kids = [plain_counts(k) for k in node.kids()]
    own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
    return (own + sum(k[0] for k in kids), node.inline + len(kids) + sum(k[1] for k in kids), node.links + sum(k[2] for k in kids), node.anchors + sum(k[3] for k in kids))


def test_densities_count_every_tag():
    root = html.parse(f"<body>{NOISE}<div><p>One <b>two</b> <i>three <a href=x>four</a></i></p><p>five</p></div>{BODY}</body>")
    nodes, parent, body = html._measured(root)
    best = html._densest(nodes, parent, body)
    for n in nodes:
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == plain_counts(n)
        assert abs(n.sum - sum(k.density for k in n.kids())) < 1e-9
    assert best.sum == max(n.sum for n in nodes)
    inner = next(n for n in nodes if n.tag == "p" and n.links)
    assert (inner.tags, inner.link_tags) == (3, 1)
