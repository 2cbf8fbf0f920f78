"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements. Each node has features of its own (tag, attribute tokens,
depth), of its subtree (text, density, links, paragraphs), of its siblings and of its ancestors; boosted trees give the
log-odds that the node belongs to the main text. Decoding chooses, by one pass up and one pass down the
tree, the most likely set of nodes in which a node is kept only if its parent is, so a kept paragraph
in a dropped sidebar or a dropped article with kept paragraphs can't occur.

The trees are trained here, on pages that ``practice_page`` makes up from TRAINING seeds (menus, headers, adverts, notices,
forms, comments, wrappers of many kinds); training is deterministic and of fixed size. Pages are then
processed one by one in a single pass without a shuffle.

The text: character references decoded, white space inside a block turned into one blank, blocks
trimmed and joined by one line feed in page order; a line break element separates blocks.

Defined cases: null and empty pages give an empty text; text without any element is main text; unclosed and
wrongly closed elements are closed where their parents are, skipped ones (``RAW``) without end too, but scripts, styles and text areas
at the page's end; elements may be nested to any depth; repeated rows and ids are pages of their
own; other columns are not read; an empty table gives an empty result; nothing is cut from long pages.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annals.llm.common import batches_of

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>|[!?][^>]*>)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

RAW = frozenset("script style noscript template svg iframe object canvas textarea select audio video".split())
TO_THE_END = frozenset("script style textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html head title body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption nav header footer aside form fieldset button label legend address details summary dialog center hgroup menu caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_NO_P = BLOCKS - {"button", "label", "legend", "summary", "caption", "title", "head", "html", "body"}

GROUPS = {
    **{t: 0 for t in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")},
    **{t: 1 for t in ("p", "pre", "blockquote")},
    **{t: 2 for t in ("ul", "ol", "li", "dl", "dt", "dd")},
    **{t: 3 for t in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")},
    **{t: 4 for t in ("div", "section", "center", "figure", "figcaption", "details")},
    **{t: 5 for t in ("article", "main")},
    **{t: 6 for t in ("nav", "menu")},
    "header": 7, "footer": 8, "aside": 9,
    **{t: 10 for t in ("form", "fieldset", "button", "label", "legend", "summary")},
    **{t: 11 for t in ("head", "title")},
    "html": 12, "body": 12, "dialog": 9, "address": 8,
}
GOOD = frozenset("article content post entry main body story text page maincontent articlebody prose".split())
BAD = {
    **{w: 0 for w in "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc topbar".split()},
    **{w: 1 for w in "footer header masthead copyright legal banner logo".split()},
    **{w: 2 for w in "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp adsense".split()},
    **{w: 3 for w in "comment comments reply replies disqus discussion respond feedback".split()},
    **{w: 4 for w in "sidebar aside widget related recommended share social tags rail".split()},
    **{w: 5 for w in "cookie cookies consent notice gdpr alert popup modal overlay subscribe newsletter signup login search form".split()},
}
_FEATURES = 13 + 7 + 21


class Page:
    """The block elements of a page in page order, and its pieces of text: (node, text), or (-1, "") between blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["html"], [-1], [0], [()]
        self.pieces: list[tuple[int, str]] = []
        self.linked: list[bool] = []
        stack, names, links, at, n = [0], ["html"], 0, 0, len(source)
        pieces, linked = self.pieces, self.linked
        lower = None
        opened = {"html": 1}

        def shut_last():
            opened[names.pop()] -= 1
            stack.pop()

        while at < n:
            m = _TAG.search(source, at)
            start = m.start() if m else n
            if start > at:
                pieces.append((stack[-1], source[at:start]))
                linked.append(links > 0)
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCKS:
                    pieces.append((-1, ""))
                    linked.append(False)
                    if opened.get(name) and name != "html":
                        while names[-1] != name:
                            shut_last()
                        shut_last()
                continue
            if name in RAW:
                if not m[0].endswith("/>"):
                    lower = source.lower() if lower is None else lower
                    end = lower.find(f"</{name}", at)
                    close = source.find(">", end) if end >= 0 else -1
                    if close >= 0:
                        at = close + 1
                    elif name in TO_THE_END:
                        at = n
                    else:  # never closed: up to the parent's end, if that has one
                        at = max(at, lower.find(f"</{names[-1]}", at))
                continue
            if name == "a":
                links += not m[0].endswith("/>")
                continue
            if name in ("br", "hr"):
                pieces.append((-1, ""))
                linked.append(False)
                continue
            if name not in BLOCKS or name == "html" or name in VOID:
                continue
            pieces.append((-1, ""))
            linked.append(False)
            if name in _NO_P and names[-1] == "p":
                shut_last()
            shut = CLOSES.get(name)
            if shut and names[-1] in shut:
                shut_last()
                if name == "tr" and names[-1] == "tr":
                    shut_last()
            if name == "body" and opened.get("head"):
                while names[-1] != "html":
                    shut_last()
            found = ()
            if m[3]:
                found = tuple(t for a in _ATTR.findall(m[3]) for t in _TOKEN.findall((a[1] or a[2] or a[3]).lower()))
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tokens.append(found)
            stack.append(len(self.tag) - 1)
            names.append(name)
            opened[name] = opened.get(name, 0) + 1

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, link, marks, paragraphs, nodes, words = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
        for (k, text), a in zip(self.pieces, self.linked):
            if k >= 0:
                size = len(text) if not text.isspace() else 0
                own[k] += size
                words[k] += text.count(" ") + 1 if size else 0
                marks[k] += text.count(".") + text.count(",")
                if a:
                    link[k] += size
        total, links, all_marks, all_words = own[:], link[:], marks[:], words[:]
        first, count, kids_text = [0] * n, [0] * n, [0] * n
        good, bad = [0] * n, [None] * n
        for k in range(n):
            hits = [0] * 6
            for t in self.tokens[k]:
                if t in GOOD:
                    good[k] += 1
                if t in BAD:
                    hits[BAD[t]] += 1
            bad[k] = hits
            p = self.parent[k]
            if p >= 0:
                first[k] = count[p]
                count[p] += 1
            if self.tag[k] in ("p", "pre", "blockquote"):
                paragraphs[k] += 1
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            total[p] += total[k]
            links[p] += links[k]
            all_marks[p] += all_marks[k]
            all_words[p] += all_words[k]
            paragraphs[p] += paragraphs[k]
            nodes[p] += nodes[k]
            kids_text[p] += total[k]
        whole = total[0] or 1
        above_bad, above_good, in_article = [0] * n, [0] * n, [0] * n
        out = np.zeros((n, _FEATURES), np.float32)
        for k in range(n):
            p = self.parent[k]
            group = GROUPS.get(self.tag[k], 4)
            if p >= 0:
                above_bad[k] = max(above_bad[p], 1 if any(bad[p]) or GROUPS.get(self.tag[p], 4) in (6, 7, 8, 9, 10, 11) else 0)
                above_good[k] = max(above_good[p], 1 if good[p] else 0)
                in_article[k] = max(in_article[p], 1 if self.tag[p] in ("article", "main") else 0)
            row = out[k]
            row[group] = 1
            row[13:19] = bad[k]
            row[19] = good[k]
            row[20:] = (
                self.depth[k], np.log1p(total[k]), np.log1p(own[k]), links[k] / (total[k] or 1), total[k] / nodes[k], paragraphs[k], nodes[k],
                all_marks[k] / (total[k] or 1) * 100, all_words[k] / nodes[k], total[k] / whole, k / n,
                first[k], count[p] if p >= 0 else 1, total[k] / (kids_text[p] or 1) if p >= 0 else 1, count[k],
                above_bad[k], above_good[k], in_article[k], np.log1p(total[p]) if p >= 0 else 0, links[p] / (total[p] or 1) if p >= 0 else 0, GROUPS.get(self.tag[p], 4) if p >= 0 else 12,
            )
        return out

    def decode(self, log_odds: np.ndarray) -> list[bool]:
        """The most likely nodes, each with its parent; the root stays."""
        n = len(self.tag)
        keep = (-np.logaddexp(0, -log_odds)).tolist()
        drop = (-np.logaddexp(0, log_odds)).tolist()
        none, best = drop[:], keep[:]
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            none[p] += none[k]
            best[p] += max(best[k], none[k])
        kept = [True] * n
        for k in range(1, n):
            kept[k] = kept[self.parent[k]] and best[k] > none[k]
        return kept

    def text(self, kept: list[bool]) -> str:
        blocks, now = [], []
        for k, piece in self.pieces:
            if k < 0:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif kept[k]:
                now.append(piece)
            elif now:
                blocks.append("".join(now))
                now = []
        if now:
            blocks.append("".join(now))
        out = []
        for b in blocks:
            b = _SPACE.sub(" ", entities.unescape(b) if "&" in b else b).strip()
            if b:
                out.append(b)
        return "\n".join(out)


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, split on quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        coded = self._coded(x)
        n, features = coded.shape
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z = np.full(n, self.base)
        self.trees = []
        width = self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            split_f, split_b = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                for f in range(features):
                    key = (node - first) * width + coded[:, f]
                    gs = np.bincount(key, g, many * width).reshape(many, width).cumsum(axis=1)
                    hs = np.bincount(key, h, many * width).reshape(many, width).cumsum(axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (ga - gs) ** 2 / (ha - hs + self.ridge) - ga**2 / (ha + self.ridge)
                    at = gain[:, :-1].argmax(axis=1)
                    value = gain[np.arange(many), at]
                    better = value > best + 1e-12
                    best[better] = value[better]
                    split_f[first : first + many][better] = f
                    split_b[first : first + many][better] = at[better]
                node = 2 * node + 1 + (coded[np.arange(n), split_f[node]] > split_b[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            self.trees.append((split_f, split_b, value))
            z = z + value[leaf]
        return self

    def _coded(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        coded = self._coded(x)
        flat, features, rows = coded.ravel(), coded.shape[1], np.arange(len(x)) * coded.shape[1]
        z = np.full(len(x), self.base)
        for split_f, split_b, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[rows + split_f[node]] > split_b[node])
            z += value[node - (2**self.depth - 1)]
        return z


TRAINING = 400
_MARK = "data-main"


def practice_page(seed: int) -> str:
    """A made-up page; elements of the main text and their containers carry the attribute data-main."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda: ". ".join(words(4, 25).capitalize() + (", " + words(2, 9) if r.random() < 0.4 else "") for _ in range(r.choice((1, 1, 2, 3, 5)))) + "."
    name = lambda *c: (lambda v: f' class="{v}"' if r.random() < 0.6 else f' id="{v}"')(r.choice(c)) if r.random() < 0.9 else ""
    menu = lambda k: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(r.randint(3, k))) + "</ul>"
    main = f" {_MARK}"

    def junk() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return f"<nav>{menu(9)}</nav>" if r.random() < 0.6 else f"<div{name('menu', 'navbar', 'main-menu', 'breadcrumb')}>{menu(9)}</div>"
        if kind == 1:
            return f"<div{name('ad', 'ads', 'advert top', 'sponsored', 'promo-box')}>" + r.choice((words(3, 14), f"<p>{words(5, 20)}.</p>", f'<a href="#">{words(2, 8)}</a>')) + "</div>"
        if kind == 2:
            return f"<aside{name('sidebar', 'widget', 'related')}><h3>{words(1, 3)}</h3>{menu(7)}" + (f"<p>{prose()}</p>" if r.random() < 0.4 else "") + "</aside>"
        if kind == 3:
            return f"<div{name('sidebar', 'related-posts', 'share', 'social')}><h4>{words(1, 3)}</h4>{menu(6)}</div>"
        if kind == 4:
            return f"<div{name('cookie-notice', 'consent', 'notice', 'newsletter')}><p>{prose()}</p><button>{word()}</button></div>"
        if kind == 5:
            return f"<form{name('search', 'login', 'subscribe')}><label>{words(1, 2)}</label><input name=q><button>{word()}</button></form>"
        if kind == 6:
            tag = r.choice(("section", "div"))
            return f"<{tag}{name('comments', 'comment-list', 'discussion')}><h3>{words(1, 2)}</h3>" + "".join(f"<div{name('comment', 'reply')}><p>{prose()}</p></div>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind == 7:
            return f"<header{name('masthead', 'site-header')}><h2>{words(1, 3)}</h2>{menu(6) if r.random() < 0.6 else ''}</header>"
        return f"<footer{name('site-footer', 'footer')}>{words(2, 12)} {menu(5) if r.random() < 0.4 else ''}</footer>"

    def block() -> str:
        x = r.random()
        if x < 0.70:
            return f"<p{main}>{r.choice(('', '', '<b>'))}{prose()}{r.choice(('', '', '<br>'))}</p>"
        if x < 0.78:
            return f"<{(h := r.choice(('h2', 'h3')))}{main}>{words(1, 8)}</{h}>"
        if x < 0.85:
            return f"<ul{main}>" + "".join(f"<li{main}>{words(3, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if x < 0.90:
            return f"<blockquote{main}><p{main}>{prose()}</p></blockquote>"
        if x < 0.94:
            return f"<table{main}>" + "".join(f"<tr{main}><td{main}>{words(1, 3)}</td><td{main}>{words(1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if x < 0.97:
            return f"<div{main}>{prose()}</div>"
        return f"<pre{main}>{words(3, 20)}</pre>"

    title = words(1, 12)
    head = r.choice((f"<h1{main}>{title}</h1>", f"<h1{main}>{title}</h1>", f"<header{main}><h1{main}>{title}</h1></header>", ""))
    inside = [block() for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20)))]
    if r.random() < 0.25:
        inside.insert(r.randint(0, len(inside)), junk())
    holder = r.choice(("article", "article", "article", "main", "div", "section"))
    state = r.choice(("", "", " no-comments", " comments-off", " has-sidebar", " with-header", " related-off", " no-ads", " menu-closed", " social-hidden"))
    mark = name(*(x + state for x in ("content", "post", "entry-content", "article-body", "story", "article"))) if holder in ("div", "section") else r.choice(("", "", name("post" + state, "entry" + state)))
    body = f"<{holder}{mark}{main}>{head}{''.join(inside)}</{holder}>"
    for _ in range(r.choice((0, 0, 1, 2))):
        body = f"<div{name('container', 'wrapper', 'page', 'row', 'main')}{main}>{junk() if r.random() < 0.4 else ''}{body}{junk() if r.random() < 0.4 else ''}</div>"
    before = "".join(junk() for _ in range(r.choice((0, 1, 2, 2, 3))))
    after = "".join(junk() for _ in range(r.choice((0, 1, 1, 2, 3))))
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body{main}>{before}{body}{after}</body></html>"


@lru_cache(maxsize=1)
def model() -> Boosted:
    """The trees, trained on TRAINING made-up pages."""
    xs, ys = [], []
    for seed in range(TRAINING):
        source = practice_page(seed)
        page = Page(source)
        truth = [1.0] + [float(_MARK in m[3]) for m in _TAG.finditer(source) if m[2] and not m[1] and m[2].lower() in BLOCKS and m[2].lower() != "html"]
        xs.append(page.features())
        ys.append(truth)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def main_texts(pages: list[str], trees: Boosted) -> list[str]:
    parsed = [Page(p or "") for p in pages]
    found = [p.features() for p in parsed]
    z = trees.log_odds(np.concatenate(found)) if found else np.zeros(0)
    out, at = [], 0
    for p, f in zip(parsed, found):
        out.append(p.text(p.decode(z[at : at + len(f)])))
        at += len(f)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    trees = model()

    def run(it):
        for big in it:
            for batch in batches_of(big, 128):
                texts = main_texts(batch.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
