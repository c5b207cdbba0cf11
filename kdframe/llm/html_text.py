"""Main text of web pages: boosted trees over DOM nodes and decoding along the tree.

A page is read into a tree of its block elements (inline markup adds to the text of its block).
Each block has features of its own and of its subtree, ancestors and siblings; boosted trees
give its log-odds of being main text.  Class names, ids and roles are read name by name: a name made of a listed word
and words of structure names a part of the surroundings, one with other words may do so, and one that tells
what a page has (``has-sidebar``, ``content-with-ads``, ``comments-open``) does not.  No name decides by itself: how
much of the page's text lies below a named element counts as well.  Decoding picks the best consistent labelling: a block is
outside, inside or cut; below an inside block there is inside or cut, below a cut block only
cut.  So no paragraph of a dropped comment section survives, and an advert inside an article
goes as a whole.

The trees are fitted on a bounded sample of the pages themselves (``SAMPLE``).  Labels come from
how pages are put together: the article texts and the surrounding texts of the sampled pages
are set again into layouts of many kinds, where each block's part is known.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import hash_sample

#: Pages in the sample the trees are fitted on; layouts made of each.
SAMPLE, LAYOUTS = 200, 6
SEED = 7

#: Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript svg iframe object canvas title annotation annotation-xml".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre "
            "section select summary table tbody td textarea tfoot th thead tr ul".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "blockquote", "pre"}
ITEM = {"li", "dd", "dt", "option"}
LIST = {"ul", "ol", "dl"}
TABLE = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
APART = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "label", "fieldset", "legend", "option"}
CENTRAL = {"article", "main"}
#: Words in class, id and role that name a page's surroundings, or its main part.
BAD_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
                "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup signin login paywall "
                "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer foot bottom "
                "copyright legal sidebar side aside rail widget widgets related recommended recommendations share sharing social follow "
                "comment comments commentlist reply replies respond disqus discussion feedback reviews search form contentinfo "
                "complementary dialog skip hidden tags tagcloud".split())
GOOD_WORDS = set("article content post entry story main body text prose page blog news".split())
#: Words beside a listed one that leave its name what it is, and words that make the name tell what a page has.
PLAIN_WORDS = set("site top left right primary secondary inner outer wrap wrapper container area box section block list item items link links "
                  "button buttons bar posts count title heading group row col column form field fields info meta panel global local mobile "
                  "desktop unit slot header1 footer1 reader user form1 thread".split()) | GOOD_WORDS
HAS_WORDS = set("has with without no not is are open opened closed enabled disabled active".split())
#: Elements that a start tag of the key's kind closes when they are open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": set(), "html": set()}
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|$)|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*(?:>|$)""", re.S)
_ATTR = re.compile(r"""(?i)(class|id|role|style|hidden|data-llm)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPLIT = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Block tree of a page: parallel lists over nodes (node 0 is the root), and its text pieces
    ``(node, text)`` in page order."""

    def __init__(self, source: str | None):
        self.parent, self.tag, self.bad, self.weak, self.good, self.mark = [-1], ["html"], [0], [0], [0], [None]
        self.own, self.linked, self.stops = [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self._read(source or "")

    def _open(self, at: int, tag: str, attrs: str) -> int:
        bad = weak = good = 0
        mark = None
        if attrs:
            for m in _ATTR.finditer(attrs):
                name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
                if name == "data-llm":
                    mark = value
                elif name == "style":
                    bad += "display:none" in value.replace(" ", "").lower()
                elif name == "hidden":
                    bad += 1
                else:
                    for whole in value.split():
                        words = _SPLIT.findall(_CAMEL.sub("-", whole).lower())
                        if not any(w in BAD_WORDS for w in words):
                            good += any(w in GOOD_WORDS for w in words)
                        elif not any(w in HAS_WORDS for w in words):
                            sure = all(w in BAD_WORDS or w in PLAIN_WORDS for w in words)
                            bad, weak = bad + sure, weak + (not sure)
        self.parent.append(at)
        self.tag.append(tag)
        self.bad.append(bad)
        self.weak.append(weak)
        self.good.append(good)
        self.mark.append(mark)
        self.own.append(0)
        self.linked.append(0)
        self.stops.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        at, pos, link, fresh, buffer = 0, 0, False, True, []

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                self.pieces.append((at, text))
                self.own[at] += len(text)
                self.stops[at] += text.count(".") + text.count(",")

        def take(text: str) -> None:
            if text:
                text = html.unescape(text) if "&" in text else text
                buffer.append(text)
                if link:
                    self.linked[at] += len(text.strip())

        while True:
            m = _TOKEN.search(source, pos)
            if not m:
                take(source[pos:])
                break
            take(source[pos:m.start()])
            pos = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                if name == "a":
                    link = False
                elif name in BLOCK:
                    up = at
                    while up and self.tag[up] != name:
                        up = self.parent[up]
                    if up:
                        flush()
                        link, at = False, self.parent[up]
            elif name in RAW:
                if not m.group(3).rstrip().endswith("/") or name in ("script", "style", "title"):
                    end = re.compile(f"</{name}", re.I).search(source, pos)
                    pos = end.start() if end else len(source)
            elif name in ("br", "hr"):
                buffer.append(" ")
            elif name == "a":
                link = True
            elif name in BLOCK and name not in ("html", "body"):
                flush()
                link = False
                closes = _CLOSES.get(name, ())
                while at and (self.tag[at] in closes or self.tag[at] == "p" or self.tag[at] in HEADING and name in HEADING):
                    at = self.parent[at]
                at = self._open(at, name, m.group(3))
        flush()

    def features(self) -> np.ndarray:
        """One row for each node."""
        n = len(self.tag)
        parent, tag = self.parent, self.tag
        sub, link, size, stops = list(self.own), list(self.linked), [1] * n, list(self.stops)
        kids, full = [0] * n, [int(o > 0) for o in self.own]
        tiny = [int(0 < o < 40) for o in self.own]
        under: list[list[str]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (sub, link, size, stops, full, tiny):
                x[p] += x[i]
            kids[p] += 1
            under[p].append(tag[i])
        # of each element with several parts, how many of its siblings are made of the same parts
        shape = [(parent[i], tag[i], *sorted(set(under[i]))) for i in range(n)]
        alike = Counter(shape[i] for i in range(1, n) if kids[i] > 1)
        place, seen = [0] * n, [0] * n
        same: dict[tuple[int, str], int] = {}
        depth, bad_above, good_above, weak_above, records = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        named, hinted = [-1.0] * n, [-1.0] * n
        before = 0
        ahead = [0] * n
        total = max(1, sub[0])
        for i in range(n):
            ahead[i] = before
            before += self.own[i]
            if not i:
                continue
            p = parent[i]
            depth[i] = depth[p] + 1
            bad_above[i] = bad_above[p] + (self.bad[p] > 0) + (tag[p] in APART)
            weak_above[i] = weak_above[p] + (self.weak[p] > 0)
            good_above[i] = good_above[p] + (self.good[p] > 0) + (tag[p] in CENTRAL)
            # share of the page's text below the least named element that has the block
            named[i] = sub[i] / total if self.bad[i] or tag[i] in APART else named[p]
            hinted[i] = sub[i] / total if self.weak[i] else hinted[p]
            records[i] = max(records[p], alike[shape[i]] if kids[i] > 1 else 0)
            place[i] = seen[p]
            seen[p] += 1
            same[p, tag[i]] = same.get((p, tag[i]), 0) + 1
        rows = []
        for i in range(n):
            p = max(parent[i], 0)
            t = tag[i]
            s = sub[i]
            rows.append((
                depth[i], math.log1p(self.own[i]), math.log1p(s), link[i] / s if s else 0.0, math.log1p(s / size[i]), s / total,
                kids[i], kids[p], place[i] / max(1, kids[p]), same.get((p, t), 1) / max(1, kids[p]), self.bad[i], self.good[i],
                bad_above[i], good_above[i], t in HEADING, t in PROSE, t in ITEM, t in LIST, t in TABLE, t in APART, t in CENTRAL,
                ahead[i] / total, stops[i] / (s + 1), link[p] / sub[p] if sub[p] else 0.0, self.weak[i], weak_above[i], named[i], hinted[i],
                records[i], tiny[i] / max(1, full[i]), tiny[p] / max(1, full[p]), sub[p] / total, stops[p] / (sub[p] + 1)))
        return np.array(rows, dtype=np.float64)

    def decode(self, odds: list[float]) -> list[bool]:
        """Whether each node is inside the main text, by the best consistent labelling."""
        n = len(self.tag)
        inside, cut, outside = list(odds), [-s for s in odds], [-s for s in odds]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            inside[p] += max(inside[i], cut[i])
            cut[p] += cut[i]
            outside[p] += max(inside[i], outside[i])
        label = [0] * n  # 0 outside, 1 inside, 2 cut
        label[0] = 1 if inside[0] > outside[0] else 0
        for i in range(1, n):
            above = label[self.parent[i]]
            if above == 2:
                label[i] = 2
            elif above == 1:
                label[i] = 1 if inside[i] >= cut[i] else 2
            else:
                label[i] = 1 if inside[i] > outside[i] else 0
        return [x == 1 for x in label]

    def text(self, odds: list[float]) -> str:
        inside = self.decode(odds)
        return " ".join(t for at, t in self.pieces if inside[at])


def _parts(page: Page) -> tuple[list[str], list[str]]:
    """Texts of the main part and of the surroundings of a page, as its own markup tells them: blocks
    in an article or main element, and blocks in elements and classes that stand apart."""
    main, rest = [], []
    for at, text in page.pieces:
        node, apart, central = at, False, False
        while node > 0:
            apart = apart or page.tag[node] in APART or page.bad[node] > 0
            central = central or page.tag[node] in CENTRAL or page.good[node] > 0
            node = page.parent[node]
        if apart:
            rest.append(text)
        elif central or len(text) > 200:
            main.append(text)
    return main, rest


def _layout(rng: random.Random, main: list[str], other: list[str], rest: list[str]) -> str:
    """A page of a random layout; ``data-llm`` marks main blocks 1 and all else 0."""
    e = html.escape
    words = " ".join(rest + other[:1]).split() or ["x"]

    def few(a: int, b: int) -> str:
        at = rng.randrange(len(words))
        return e(" ".join(words[at:at + rng.randint(a, b)]))

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag} data-llm="0"><a href="/{i}">{few(1, 3)}</a></{tag}>' for i in range(rng.randint(2, 9)))

    def el(tag: str, names: list[str], inner: str, mark: int = 0) -> str:
        name = rng.choice(names)
        attr = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        return f'<{tag} data-llm="{mark}"{attr}>{inner}</{tag}>'

    def prose(n: int, mark: int) -> str:
        texts = [rng.choice(other or ["x"]) for _ in range(n)]
        return "".join(f'<p data-llm="{mark}">{e(t)}</p>' for t in texts)

    short = lambda tag: f'<{tag} data-llm="0">{few(3, 25)}</{tag}>'

    def thread() -> str:
        """What readers wrote, without any telling name: a name, a date, a text, a link, again and again."""
        who, outer = rng.choice(["p", "div", "h4", "span"]), rng.choice(["div", "li", "section", "article"])
        reply = rng.choice(["", '<div data-llm="0"><a href="#r">{}</a></div>', '<a href="#r">{}</a>'])
        records = []
        for _ in range(rng.randint(1, 6)):
            text = rng.choice([f'<p data-llm="0">{few(4, 60)}</p>', prose(rng.randint(1, 2), 0), f'<div data-llm="0">{few(10, 60)}</div>'])
            records.append(f'<{outer} data-llm="0"><{who} data-llm="0">{few(1, 4)}</{who}>{text}{reply.format(few(1, 1))}</{outer}>')
        inner = "".join(records)
        inner = f'<ul data-llm="0">{inner}</ul>' if outer == "li" else inner
        return el(rng.choice(["section", "div"]), ["", "", "lower", "talk", "below"], rng.choice([f'<h3 data-llm="0">{few(1, 4)}</h3>', ""]) + inner)

    def misleading() -> str:
        """A name with a listed word that says nothing of its element."""
        word, own = rng.choice(sorted(BAD_WORDS)), rng.choice(["analysis", "history", "builder", "theory", "elementor", "guide", "studies", "lab", "wiki", "grid"])
        good = rng.choice(sorted(GOOD_WORDS))
        return rng.choice([f"{good}-with-{word}", f"has-{word}", f"{good} {word}-open", f"layout has-{word}", f"no-{word} {good}", f"{word}-{own}",
                           f"{own}-{word}-container", f"{own}-{word}", f"{word} {good}", f"{word}-container {good}-{own}"])
    around = [
        lambda: el("nav", ["", "main-nav", "menu", "breadcrumb"], f'<ul data-llm="0">{links()}</ul>'),
        lambda: el("div", ["menu", "navbar", "top-navigation", "breadcrumbs"], f'<ul data-llm="0">{links()}</ul>'),
        lambda: el("header", ["", "site-header", "masthead"], rng.choice([f'<h1 data-llm="0">{few(1, 6)}</h1>', ""]) + short("p") + f'<ul data-llm="0">{links()}</ul>'),
        lambda: el("div", ["header", "page-header", "topbar"], f'<h2 data-llm="0">{few(1, 6)}</h2>' + links("div")),
        lambda: el("aside", ["", "sidebar", "related"], f'<h3 data-llm="0">{few(1, 4)}</h3>' + rng.choice([prose(rng.randint(1, 3), 0), f'<ul data-llm="0">{links()}</ul>', short("p")])),
        lambda: el("div", ["sidebar", "right-rail", "widget", "related-posts", "side-content"], f'<h3 data-llm="0">{few(1, 4)}</h3>' + rng.choice([prose(1, 0), f'<ul data-llm="0">{links()}</ul>'])),
        lambda: el("div", ["ad", "ads", "advert", "sponsored", "promo-box", "banner"], rng.choice([few(3, 30), short("p"), prose(1, 0)])),
        lambda: el(rng.choice(["div", "section"]), ["cookie-notice", "notice", "consent", "alert", "popup"], rng.choice([few(5, 40), short("p")]) + rng.choice(["", f'<button data-llm="0">{few(1, 2)}</button>'])),
        lambda: el("form", ["", "search", "newsletter", "login-form"], f'<label data-llm="0">{few(1, 5)}</label><input name="q"><p data-llm="0">{few(3, 20)}</p><button data-llm="0">{few(1, 2)}</button>'),
        lambda: el("footer", ["", "site-footer"], rng.choice([f"&copy; {few(3, 20)}", short("p"), prose(1, 0) + f'<ul data-llm="0">{links()}</ul>'])),
        lambda: el("div", ["footer", "page-footer", "copyright"], rng.choice([few(3, 30), short("p") + links("div")])),
        lambda: el(rng.choice(["section", "div", "ol"]), ["comments", "comment-list", "reader-comments", "discussion", "replies"],
                   f'<h3 data-llm="0">{few(1, 4)}</h3>' + "".join(el("div", ["comment", "comment-body", "reply", ""], prose(rng.randint(1, 2), 0)) for _ in range(rng.randint(1, 5)))),
        lambda: el("div", ["share", "social-links", "tags", "follow"], links("span")),
        thread,
        thread,
    ]
    body = list(main)
    first = body[0] if rng.random() < 0.5 else " ".join(body[0].split()[:rng.randint(1, 4)])
    blocks = [f'<{rng.choice(["h1", "h1", "h2"])} data-llm="1">{e(first)}</{"h1"}>'] if len(body) > 1 and len(body[0]) < 200 else [f'<p data-llm="1">{e(body[0])}</p>']
    for text in body[1:]:
        kind = rng.random()
        if kind < 0.06:
            blocks.append(f'<ul data-llm="1"><li data-llm="1">{e(text)}</li></ul>')
        elif kind < 0.10:
            blocks.append(f'<blockquote data-llm="1"><p data-llm="1">{e(text)}</p></blockquote>')
        elif kind < 0.14:
            blocks.append(f'<h2 data-llm="1">{e(" ".join(text.split()[:rng.randint(1, 5)]))}</h2><p data-llm="1">{e(text)}</p>')
        else:
            blocks.append(f'<p data-llm="1">{e(text)}</p>')
    if rng.random() < 0.4:
        blocks.insert(rng.randint(1, len(blocks)), rng.choice(around)())
    if rng.random() < 0.3:
        blocks.append(rng.choice(around)())
    tag, names = rng.choice([("article", ["", "post", "story"]), ("article", [""]), ("main", ["", "content"]), ("div", ["content", "main", "post-body", "entry-content", "article-text", "story"]),
                             ("section", ["", "article", "content"]), ("div", [""])])
    if len(blocks) > 4 and rng.random() < 0.12:  # an article of sections alike
        step = rng.randint(2, 3)
        blocks = blocks[:1] + [f'<section data-llm="1">{"".join(blocks[i:i + step])}</section>' for i in range(1, len(blocks), step)]
    if rng.random() < 0.3:
        names = [misleading()]
    inner = el(tag, names, "".join(blocks), 1)
    for _ in range(rng.choice([0, 0, 1, 2])):
        side = rng.choice(around)() if rng.random() < 0.5 else ""
        name = misleading() if rng.random() < 0.25 else rng.choice(["", "wrapper", "page"])
        inner = f'<div data-llm="0" class="{name}">{inner}{side}</div>'
    top = "".join(rng.choice(around)() for _ in range(rng.randint(0, 4)))
    end = "".join(rng.choice(around)() for _ in range(rng.randint(0, 4)))
    page = f"{top}{inner}{end}"
    if rng.random() < 0.08:  # some kits put a form round everything
        page = f'<form data-llm="0" id="{rng.choice(["form1", "aspnetForm", "frm"])}">{page}</form>'
    return f"<html><body>{page}</body></html>"


def fit(pages: DataFrame, sample: int = SAMPLE, html_col: str = "html") -> tuple:
    """Trees fitted on layouts made of the texts of ``sample`` pages (the ones with the smallest hash)."""
    rows = hash_sample(pages.select(F.col(html_col).alias("html")), "html", sample).collect()
    rng = random.Random(SEED)
    parts = [p for p in (_parts(Page(r["html"])) for r in rows) if p[0]]
    # without a page that shows its parts, layouts are set with neutral words
    parts = parts or [([f"{w} " * 5, *[f"{w} and, so it goes on. " * 12] * 4], [w * 3, w]) for w in ("lorem", "ipsum", "dolor")]
    x, y = [], []
    for main, rest in parts:
        for _ in range(LAYOUTS):
            other = rng.choice(parts)[0]
            page = Page(_layout(rng, main, other, rest))
            f = page.features()
            known = [i for i, m in enumerate(page.mark) if m is not None]
            x.append(f[known])
            y += [page.mark[i] == "1" for i in known]
    return boost.fit(np.concatenate(x), np.array(y, dtype=np.float64))


def extract(pages: DataFrame, model: tuple, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``.

    Blocks of the main text in page order, character references decoded, white space inside a
    block as one space, blocks joined by one space.  A null, empty or text-free page gives an
    empty text and 0.  Repeated rows give equal results; null ids and urls are returned as null;
    an empty table gives no rows; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # TREES x LEAVES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                read = [Page(h.as_py()) for h in b.column(2)]
                rows = [p.features() for p in read]
                odds = np.clip(boost.predict(trees, np.concatenate(rows)), -8, 8).tolist()
                texts, pos = [], 0
                for p, f in zip(read, rows):
                    texts.append(p.text(odds[pos:pos + len(f)]))
                    pos += len(f)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return src.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
