"""HTML extraction: given pages against their article, unseen layouts, decoding, edge cases."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from kdframe.llm import boost
from kdframe.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text int"


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = H.extract(pages, model).collect()
    assert len(got) == len(source)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S).group(1)
        body = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def run(spark, model, sources):
    rows = [(i, f"u{i}", s, 0) for i, s in enumerate(sources)]
    out = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert all(out[i].n_chars == len(out[i].text) and out[i].url == f"u{i}" for i in out)
    return [out[i].text for i in range(len(sources))]


P = ["The river rose in the night, and by morning the lower road was gone. Nobody had seen it happen, though many claimed they had.",
     "In the weeks that followed, the council met four times. It agreed on little, except that the bridge would be built again.",
     "What the engineers found under the old piers surprised them. The stone was sound; the sand below it was not, and had moved for years."]
LONG = "I have read this twice and I still do not agree with the writer, who clearly has never been to the valley in spring. Anyone who has would know."


def test_unseen_layouts(spark, model):
    main = "".join(f"<p>{p}</p>" for p in P)
    nav = '<ul>' + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(7)) + "</ul>"
    pages = [
        f'<body><header class="site-header"><h1>Daily Paper</h1><nav>{nav}</nav></header><main><h1>Flood</h1>{main}</main><footer><p>&copy; 2020 Daily Paper, all about the valley.</p></footer>',
        f'<body><div id="cookie-notice"><p>We use cookies to give you the best experience on our site, as you would expect.</p></div><div class="menu">{nav}</div><div class="post-content"><h1>Flood</h1>{main}</div><div id="comments"><h3>2 comments</h3><div class="comment"><p>{LONG}</p></div><div class="comment"><p>{LONG}</p></div></div>',
        f'<body><div class="wrap"><aside class="sidebar"><h3>Popular</h3>{nav}<p>Subscribe to our letter and read more each week.</p></aside><article><h1>Flood</h1>{main}<div class="advert">Buy two boats, pay one. Only today.</div></article></div><form action="/s"><label>Search</label><input><button>Go</button></form>',
    ]
    for text in run(spark, model, pages):
        assert text == "Flood " + " ".join(P)


def test_generated_layouts(model):
    """Layouts from texts and seeds that the fit has not seen: share of characters told right."""
    rng, right, total = random.Random(99), 0, 0
    other = [LONG, *P]
    for _ in range(150):
        page = H.Page(H._layout(rng, ["A heading of it", *rng.sample(P, 3)], other, ["Home", "About us", "Contact the paper"]))
        inside = page.decode(np.clip(boost.predict(model, page.features()), -8, 8).tolist())
        for at, text in page.pieces:
            if page.mark[at] is not None:
                total += len(text)
                right += len(text) * (inside[at] == (page.mark[at] == "1"))
    assert right / total > 0.95


def test_decoding_is_the_best_consistent_labelling():
    r = random.Random(2)
    for _ in range(60):
        page = H.Page("")
        n = r.randint(1, 6)
        page.parent = [-1] + [r.randrange(i) for i in range(1, n)]
        page.tag = ["div"] * n
        odds = [r.uniform(-3, 3) for _ in range(n)]
        best = -1e9
        for lab in itertools.product((0, 1, 2), repeat=n):
            if lab[0] != 2 and all((lab[page.parent[i]], lab[i]) in {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)} for i in range(1, n)):
                best = max(best, sum(odds[i] if x == 1 else -odds[i] for i, x in enumerate(lab)))
        inside = page.decode(odds)
        assert sum(o if x else -o for o, x in zip(odds, inside)) == pytest.approx(best)


def test_edges(spark, model):
    long = "<body><article>" + "".join(f"<p>{P[i % 3]}</p>" for i in range(3000)) + "</article>"
    sources = [None, "", "   ", "<html></html>", "<script>var a='<p>x</p>'</script>", "<article><p>" + P[0] + "<p>" + P[1] + " <b>bold</b>&nbsp;x&amp;y\n\t z<br>w",
               long, "<article><p>" + P[0] + "</p><p cla", "<nav><a href=x>Home</a></nav>", '<article><p title="a>b">' + P[2] + "</p><!-- <p>no</p> --></article>"]
    got = run(spark, model, sources + [sources[5]])
    assert got[:5] == [""] * 5 and got[8] == ""
    assert got[5] == got[10] == P[0] + " " + P[1] + " bold x&y z w"
    assert got[6] == " ".join(P[i % 3] for i in range(3000))
    assert got[7] == P[0] and got[9] == P[2]
    none = spark.createDataFrame([(None, None, "<article><p>" + P[0])], "page_id long, url string, html string")
    assert [tuple(r) for r in H.extract(none, model).collect()] == [(None, None, P[0], len(P[0]))]
    assert H.extract(none.limit(0), model).collect() == []
    assert H.fit(none.limit(0))  # neutral layouts


def test_boosting_learns_a_rule():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.5)).astype(float)
    odds = boost.predict(boost.fit(x, y), x)
    assert ((odds > 0) == (y > 0)).mean() > 0.97


def long_page(n):
    r = random.Random(n)
    article = [" ".join(r.choice(P).split()[: r.randint(6, 25)]) + f" {i}." for i in range(n)]
    nav = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9)) + "</ul>"
    side = f'<aside class="sidebar"><h3>Popular</h3>{nav}</aside>'
    return article, f'<body><nav>{nav}</nav><div><div>{"".join(f"<p>{x}</p>" for x in article)}</div>{side}</div><footer><p>&copy; 2020 Daily Paper</p></footer></body>'


def test_long_pages(spark, monkeypatch):
    article, page = long_page(300)
    pages = spark.createDataFrame([(i, "u", f"<body><article>{''.join(f'<p>{x}</p>' for x in long_page(40 + i)[0])}</article><nav><a href='/'>Home</a></nav></body>", 0) for i in range(20)], SCHEMA)
    seen, layout = [], H._layout
    monkeypatch.setattr(H, "_layout", lambda rng, main, *rest: seen.append(len(main)) or layout(rng, main, *rest))
    model = H.fit(pages)
    assert set(seen) == set(range(40, 60))  # every block of a sampled page is set
    assert run(spark, model, [page]) == [" ".join(article)]


A = "<h1>Flood</h1>" + "".join(f"<p>{p}</p>" for p in P) + f"<p>{LONG}</p>"
TEXT = "Flood " + " ".join([*P, LONG])
LIST = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(7)) + "</ul>"
TALK = "".join(f"<div><p>{n}, {d} May</p><p>{t}</p><a href='#'>Reply</a></div>" for n, d, t in
               [("Ann", 3, "That is not how I remember it, to be honest."), ("Bo", 4, "Thanks for writing this up, it was long overdue."),
                ("Cy", 4, "I was there. The water came from the other side, and nobody was told."), ("Di", 9, "Agreed.")])
#: Written by hand; the article of each is A.
LAYOUTS = {
    "main with a telling name": f'<nav>{LIST}</nav><main class="content-with-sidebar">{A}</main><footer>&copy; 2020 Daily Paper</footer>',
    "comments open": f'<header><h2>Daily Paper</h2>{LIST}</header><article class="post comments-open">{A}</article><footer><p>&copy; 2020</p></footer>',
    "layout has": f'<div class="layout has-sidebar"><div>{A}</div><aside>{LIST}</aside></div><footer>&copy; 2020 Daily Paper</footer>',
    "builder": f'<div class="elementor-widget-container">{A}</div><footer class="elementor-footer"><p>&copy; 2020 Daily Paper</p></footer>',
    "history": f'<nav>{LIST}</nav><div class="social-history">{A}</div><footer>&copy; 2020 Daily Paper</footer>',
    "analysis": f'<header>{LIST}</header><section id="legal-analysis">{A}</section><footer>&copy; 2020 Daily Paper</footer>',
    "form round the page": f'<form id="aspnetForm" action="/x"><div class="menu">{LIST}</div><div id="content">{A}</div><div class="footer">&copy; 2020</div></form>',
    "plain div": f"<div>{LIST}</div><div>{A}</div><div>&copy; 2020 Daily Paper</div>",
    "table": f'<table><tr><td>{LIST}</td><td>{A}</td></tr></table><table><tr><td>&copy; 2020 Daily Paper</td></tr></table>',
    "no sidebar": f'<body class="no-sidebar"><div id="top-nav">{LIST}</div><div class="no-sidebar entry">{A}</div><div id="footer"><p>All rights reserved.</p></div>',
    "comments without a name": f"<nav>{LIST}</nav><article>{A}</article><section><h3>4 comments</h3>{TALK}</section><footer>&copy; 2020</footer>",
    "comments in a div": f'<div class="menu">{LIST}</div><main>{A}</main><div><h3>Discussion</h3>{TALK}</div>',
    "named comments": f'<article>{A}</article><div id="comments">{TALK}</div><footer>&copy; 2020</footer>',
    "sections": f"<nav>{LIST}</nav><main><h1>Flood</h1>" + "".join(f"<section><p>{p}</p></section>" for p in [*P, LONG]) + "</main><footer>&copy; 2020</footer>",
    "advert inside": f'<nav>{LIST}</nav><article><h1>Flood</h1><p>{P[0]}</p><p>{P[1]}</p><div class="ad">Buy two boats, pay one.</div><p>{P[2]}</p><p>{LONG}</p></article>',
    "cookie notice": f'<div class="cookie-notice"><p>We use cookies to give you the best experience, as you would expect.</p><button>OK</button></div><main>{A}</main>',
    "related": f'<article>{A}</article><div class="related-posts"><h3>Read next</h3>{LIST}</div><footer><p>&copy; 2020 Daily Paper</p></footer>',
    "newsletter": f'<header class="site-header">{LIST}</header><div class="story">{A}</div><form class="newsletter"><label>Mail</label><p>Get our letter every week.</p><button>Go</button></form>',
    "rail": f'<div id="page"><div class="right-rail"><h3>Popular</h3>{LIST}</div><div class="post-body">{A}</div></div><div class="copyright">&copy; 2020 Daily Paper</div>',
    "deep": f'<div><div><div><div class="search-engine-guide"><div>{A}</div></div></div><div class="sidebar">{LIST}</div></div></div><footer>&copy; 2020</footer>',
    "with ads": f'<nav>{LIST}</nav><div class="article-with-ads"><div>{A}</div></div><footer>&copy; 2020 Daily Paper</footer>',
    "notice theory": f'<nav>{LIST}</nav><div id="comment-theory" class="is-open">{A}</div><footer>&copy; 2020 Daily Paper</footer>',
}


def share_right(got, want):
    """Twice the characters in common runs over all characters."""
    import difflib
    same = sum(b.size for b in difflib.SequenceMatcher(None, got.split(), want.split(), autojunk=False).get_matching_blocks())
    return 2 * same / max(1, len(got.split()) + len(want.split()))


def test_layouts_written_by_hand(spark, model):
    pages = [f"<html><body>{x}</body></html>" for x in LAYOUTS.values()]
    scores = {name: share_right(got, TEXT) for name, got in zip(LAYOUTS, run(spark, model, pages))}
    assert min(scores.values()) >= 0.95, sorted(scores.items(), key=lambda x: x[1])[:6]


def test_formulas_are_text(spark, model):
    page = f"<nav>{LIST}</nav><article><h1>Flood</h1><p>{P[0]}</p><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math> holds, as was said.</p><p>{P[1]}</p></article>"
    assert run(spark, model, [page]) == [f"Flood {P[0]} So a=2 holds, as was said. {P[1]}"]


def test_names():
    kinds = lambda names: (lambda p: (p.bad[1], p.weak[1], p.good[1]))(H.Page(f'<div class="{names}">x</div>'))
    assert kinds("sidebar") == kinds("page-footer") == kinds("commentBody") == (1, 0, 0)
    assert kinds("has-sidebar") == kinds("content-with-sidebar") == kinds("comments-open") == (0, 0, 0)
    assert kinds("legal-analysis") == kinds("elementor-widget-container") == (0, 1, 0)
    assert kinds("post-content ads") == (1, 0, 1)
