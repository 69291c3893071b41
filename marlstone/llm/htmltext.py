"""Main text of web pages: boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants consistent.

Every block element is described by its subtree (text, link density, punctuation), its
attribute words, its depth, its siblings and what surrounds it. Gradient-boosted trees give
the probability that its text belongs to the article. They are trained here on pages from a
generator that knows which blocks are which; no page of the corpus is needed.

Decoding: a node is kept whole, dropped whole, or mixed, in which case its children are
decided one by one. The best assignment is found bottom-up, so no kept node stands in a
dropped one and no dropped one in a kept one.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .dom import Node, parse

#: Words of class, id and role attributes, by what they speak for.
TOKENS = {
    "advert": "ad ads adv advert advertisement adsense adslot banner sponsor sponsored sponsoring promo promotion promoted outbrain taboola doubleclick",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar skip sitemap toolbar",
    "footer": "footer foot colophon copyright legal bottom imprint",
    "side": "sidebar side aside rail widget related recommended recommendations recommend trending popular more teaser similar complementary",
    "comment": "comment comments commentlist disqus reply replies respond discussion feedback reviews responses guestbook",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall dialog message toast disclaimer warning privacy",
    "social": "share sharing social follow likes facebook twitter tags meta rating buttons",
    "form": "form search searchbox login signin register contact input field",
    "header": "header masthead head logo branding top hero contentinfo site",
    "main": "article articlebody content post entry story main body text page blog news hentry prose paragraph",
}
_GROUPS = {w: k for k, words in enumerate(TOKENS.values()) for w in words.split()}
_N = len(TOKENS)
_TAGS = {
    "p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 2, "dt": 2, "dd": 2, "ul": 3, "ol": 3, "dl": 3, "menu": 11, "div": 4, "center": 4,
    "article": 5, "main": 5, "section": 6, "nav": 7, "header": 8, "footer": 9, "aside": 10, "form": 11, "fieldset": 11, "legend": 11, "option": 11, "search": 11,
    "dialog": 11, "table": 12, "tr": 12, "td": 12, "th": 12, "tbody": 12, "thead": 12, "blockquote": 13, "pre": 13, "figure": 13, "figcaption": 13, "address": 14, "body": 15, "#root": 15,
}
_N_TAGS = 17
_SYLLABLES = "an er th ou ti on sh be le mi ra é ü st na ko".split()
_MARKS = frozenset(".,;:!?")
_BOILER_TAGS = frozenset((7, 9, 10, 11))


def features(root: Node, texts: list[str]) -> tuple[list[Node], np.ndarray]:
    """All nodes in page order and a row of features for each."""
    nodes: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(reversed(node.children))
    index = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    own, marks, words, link, below = (np.zeros(n) for _ in range(5))
    start = np.zeros(n)
    place = np.cumsum([0] + [len(t) for t in texts])
    for i, node in enumerate(nodes):
        for s in node.segments:
            t = texts[s]
            own[i] += len(t)
            words[i] += t.count(" ") + 1
            marks[i] += sum(map(t.count, _MARKS))
        link[i] = node.links
        start[i] = place[node.segments[0]] if node.segments else -1
    sub, sub_marks, sub_words, sub_link = own.copy(), marks.copy(), words.copy(), link.copy()
    parent = np.array([index[id(x.parent)] if x.parent else -1 for x in nodes])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub[p] += sub[i]
        sub_marks[p] += sub_marks[i]
        sub_words[p] += sub_words[i]
        sub_link[p] += sub_link[i]
        below[p] += below[i] + 1
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    total = max(1.0, place[-1])
    density = sub_link / np.maximum(1, sub)
    rows = np.zeros((n, 16 + _N_TAGS + 3 * _N + 4), np.float32)
    flags = np.zeros((n, _N), bool)
    above = np.zeros((n, _N), bool)
    boiler, inside = np.zeros(n, bool), np.zeros(n, bool)
    for i, node in enumerate(nodes):
        for w in node.tokens:
            k = _GROUPS.get(w)
            if k is not None:
                flags[i, k] = True
        tag = _TAGS.get(node.tag, 16)
        rows[i, 16 + tag] = 1
        if i:
            p = parent[i]
            above[i] = above[p] | flags[p]
            up = _TAGS.get(nodes[p].tag, 16)
            # A form around most of the page is its frame, not a part of it.
            frame = nodes[p].tag == "form" and sub[p] > 0.5 * total
            boiler[i] = boiler[p] or (up in _BOILER_TAGS and not frame) or (up == 8 and not inside[p])
            inside[i] = inside[p] or up == 5
            brothers = nodes[p].children
            k = rows[p, 14]  # next place among the siblings
            rows[p, 14] += 1
            rows[i, 5:9] = k / len(brothers), np.log1p(len(brothers)), np.log1p(k), sub[i] / max(1, sub[p])
            rows[i, 9:11] = density[p], np.log1p(sub[p])
    rows[:, 14] = 0
    rows[:, 0] = [x.depth for x in nodes]
    rows[:, 1], rows[:, 2], rows[:, 3] = np.log1p(sub), np.log1p(own), density
    rows[:, 4] = below / np.maximum(1, sub / 100)
    rows[:, 11] = sub_marks / np.maximum(1, sub_words)
    rows[:, 12] = sub / np.maximum(1, sub_words)
    rows[:, 13] = np.maximum(0, start) / total
    rows[:, 14] = sub / total
    rows[:, 15] = [x.hidden for x in nodes]
    at = 16 + _N_TAGS
    rows[:, at : at + _N] = flags
    rows[:, at + _N : at + 2 * _N] = above
    if n > 1:
        rows[1:, at + 2 * _N : at + 3 * _N] = flags[parent[1:]]
    rows[:, at + 3 * _N] = boiler
    rows[:, at + 3 * _N + 1] = inside
    rows[:, at + 3 * _N + 2] = inside.any()
    rows[:, at + 3 * _N + 3] = np.log1p(total)
    return nodes, rows


def decode(nodes: list[Node], p: np.ndarray, switch: float = 1.0) -> np.ndarray:
    """Which nodes' own texts are kept. switch: what a mixed node costs, in log odds."""
    index = {id(x): i for i, x in enumerate(nodes)}
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.array([1.0 if x.segments else 0.25 for x in nodes])
    keep, drop = weight * np.log(p), weight * np.log(1 - p)
    own = np.maximum(keep, drop)
    # The page and its body hold all kinds of things, so for them to be mixed costs nothing.
    mixed = own - np.where([x.tag in ("#root", "body") for x in nodes], 0.0, switch)
    best = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        children = [index[id(c)] for c in nodes[i].children]
        if children:
            keep[i] += keep[children].sum()
            drop[i] += drop[children].sum()
            mixed[i] += best[children].sum()
        else:
            mixed[i] = -np.inf
        best[i] = max(keep[i], drop[i], mixed[i])
    out = np.zeros(len(nodes), bool)
    state = [None] * len(nodes)
    for i, node in enumerate(nodes):
        up = state[index[id(node.parent)]] if node.parent else "mixed"
        if up != "mixed":
            state[i] = up
        elif best[i] == mixed[i]:
            state[i] = "mixed"
        else:
            state[i] = "keep" if keep[i] >= drop[i] else "drop"
        out[i] = state[i] == "keep" or state[i] == "mixed" and p[i] >= 0.5
    return out


def article(source: str, model: Trees) -> str:
    """The main text of one page."""
    return articles([source], model)[0]


def articles(sources: list[str], model: Trees) -> list[str]:
    parsed = [parse(s) for s in sources]
    made = [features(root, texts) for root, texts, _ in parsed]
    p = model.probability(np.concatenate([m[1] for m in made])) if made else np.zeros(0)
    out, at = [], 0
    for (_, texts, owners), (nodes, rows) in zip(parsed, made, strict=True):
        keep = decode(nodes, p[at : at + len(rows)])
        at += len(rows)
        kept = {id(x) for x, k in zip(nodes, keep.tolist(), strict=True) if k}
        out.append("\n".join(t for t, x in zip(texts, owners, strict=True) if id(x) in kept))
    return out


class Generator:
    """Pages of many layouts, with their article blocks marked by the attribute ``itemprop="x1"`` (no feature sees it)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        out = []
        for _ in range(n):
            w = "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
            out.append(w + (r.choice((",", ".", "!", ";")) if r.random() < 0.12 else ""))
        return " ".join(out).capitalize()

    def noisy(self, n: int) -> str:
        """Text of a poor article: symbols, capitals or bars between words."""
        kind = self.r.random()
        w = self.words(n).split()
        if kind < 0.4:
            mark = self.r.choice("~^+=_@<>") * self.r.randint(1, 2)
            return " ".join(x + (mark if self.r.random() < 0.7 else "") for x in w)
        return " ".join(w).upper() if kind < 0.7 else " | ".join(w)

    def line(self, a: int, b: int) -> str:
        n = self.r.randint(a, b)
        return self.noisy(n) if self.poor else self.words(n)

    def attr(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.12:
            return ""
        name = r.choice(names)
        name = r.choice((name, name, f"{name}-{r.choice(('box', 'wrap', 'inner', 'block', 'area', 'container', 'list'))}", f"js-{name}", f"{name} col-{r.randint(1, 9)}"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(self, n: int, item: str = "li") -> str:
        out = "".join(f'<{item}><a href="/{i}">{self.words(self.r.randint(1, 4))}</a></{item}>' for i in range(n))
        return f"<ul>{out}</ul>" if item == "li" else out

    def boiler(self, where: str) -> str:
        r = self.r
        kinds = {
            "top": ("nav", "header", "notice", "ad", "search", "crumbs", "divnav", "bar", "tablenav"),
            "bottom": ("footer", "footer", "divfooter", "comments", "related", "newsletter", "ad", "notice", "lastline", "form"),
            "side": ("aside", "sidebar", "ad", "related", "tablenav", "form"),
            "inside": ("ad", "share", "related", "newsletter", "innernav", "form", "form"),
        }[where]
        k = r.choice(kinds)
        w = self.words
        if k == "nav":
            return f"<nav>{self.links(r.randint(2, 9))}</nav>"
        if k == "divnav":
            return f"<div{self.attr('menu', 'nav', 'navbar', 'topbar')}>{r.choice((self.links(r.randint(2, 9)), self.links(r.randint(2, 9), 'span')))}</div>"
        if k == "innernav":
            return f'<div{self.attr("toc", "pagination", "breadcrumb")}>{self.links(r.randint(2, 6))}</div>'
        if k == "header":
            return f"<header{self.attr('header', 'masthead', 'site-header')}>{r.choice(('', f'<h1><a href=/>{w(2)}</a></h1>', f'<div class=logo>{w(2)}</div>'))}<p>{w(r.randint(2, 12))}</p>{r.choice(('', self.links(4)))}</header>"
        if k == "crumbs":
            return f"<div{self.attr('breadcrumb', 'breadcrumbs')}><a href=/>{w(1)}</a> &gt; <a href=/x>{w(1)}</a> &gt; {w(2)}</div>"
        if k == "search":
            return f"<form{self.attr('search', 'login', 'form')}><p>{w(r.randint(1, 6))}</p><label>{w(2)}</label><input type=text><fieldset><legend>{w(2)}</legend>{w(3)}</fieldset></form>"
        if k == "form":
            # What a form says stands in any element, often without a name.
            parts = [r.choice((f"<label>{w(r.randint(1, 3))}</label>", f"<label>{w(1)} <input name=a></label>", f"<p>{w(r.randint(2, 14))}</p>", f"<div>{w(r.randint(1, 5))} <input type=text></div>", f"<fieldset><legend>{w(2)}</legend><p>{w(r.randint(2, 8))}</p></fieldset>", f"<h3>{w(2)}</h3>", f"{w(2)}<br><textarea></textarea>", f"<ul><li>{w(2)}<input type=checkbox><li>{w(1)}</ul>")) for _ in range(r.randint(1, 5))]
            return f"<form{r.choice(('', '', ' action=/go method=post', self.attr('contact', 'form', 'login', 'register')))}>{''.join(parts)}{r.choice(('', '<button>Go</button>', '<input type=submit>'))}</form>"
        if k == "bar":
            # Some words, no link, hardly a name.
            return f"<div{r.choice(('', self.attr('top', 'head', 'bar', 'upper', 'logo')))}>{r.choice((w(r.randint(1, 5)), f'<span>{w(1)}</span> <span>{w(1)}</span> <span>{w(2)}</span>', f'<b>{w(2)}</b>'))}</div>"
        if k == "lastline":
            return f"<{(t := r.choice(('div', 'p', 'center')))}{r.choice(('', self.attr('bot', 'end', 'lower', 'bottom', 'copyright')))}>{r.choice(('Copyright', '©', '&copy;', 'All rights reserved', w(1)))} {r.choice((str(r.randint(1990, 2030)), w(2)))} {r.choice(('', w(2)))}</{t}>"
        if k == "tablenav":
            cells = "".join(f"<td>{r.choice((f'<a href=/{i}>{w(r.randint(1, 2))}</a>',) * 5 + (w(1),))}</td>" for i in range(r.randint(2, 8)))
            return f"<table{r.choice(('', ' width=100%', self.attr('menu', 'layout', 'head')))}><tr>{cells}</tr></table>"
        if k == "notice":
            return f"<div{self.attr('cookie', 'consent', 'notice', 'alert', 'cookie-notice', 'popup')} role=\"{r.choice(('alert', 'dialog', 'note'))}\"><p>{w(r.randint(6, 40))}</p>{r.choice(('', '<button>OK</button>'))}</div>"
        if k == "ad":
            body = w(r.randint(3, 40))
            tag = r.choice(("div", "div", "aside", "section", "p"))
            return f"<{tag}{r.choice((' class=ad', ' class=\"ad\"', ' id=\"ads\"', ' class=\"advert banner\"', ' class=\"sponsored\"', ' class=\"promo\"'))}>{body if tag == 'p' or r.random() < 0.5 else f'<p>{body}</p>'}</{tag}>"
        if k == "footer":
            return f"<footer{r.choice(('', '', self.attr('footer')))}>{r.choice((f'© {r.randint(1990, 2030)} {w(r.randint(1, 30))}', f'{w(2)} | {w(r.randint(2, 20))}', f'<p>&copy; {w(r.randint(2, 14))}</p>{self.links(3)}', f'<div>{w(r.randint(4, 30))}</div>'))}</footer>"
        if k == "divfooter":
            return f'<div{self.attr("footer", "copyright", "legal", "bottom")}><p>{w(r.randint(3, 30))}</p>{r.choice(("", self.links(3)))}</div>'
        if k == "comments":
            each = "".join(f'<{t}{self.attr("comment", "reply")}><p>{w(r.randint(3, 60))}</p></{t}>' for t in [r.choice(("div", "li", "article"))] * r.randint(1, 6))
            return f'<{(t := r.choice(("section", "div", "ol")))} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "discussion", "responses"))}">{r.choice(("", f"<h3>{w(2)}</h3>"))}{each}</{t}>'
        if k == "related":
            return f'<{(t := r.choice(("div", "section", "aside")))}{self.attr("related", "recommended", "more", "trending", "popular")}><h3>{w(2)}</h3>{self.links(r.randint(2, 6))}</{t}>'
        if k == "newsletter":
            return f'<div{self.attr("newsletter", "subscribe", "signup")}><p>{w(r.randint(4, 20))}</p><form>{w(2)}<input></form></div>'
        if k == "share":
            return f'<div{self.attr("share", "social", "tags", "follow")}>{self.links(r.randint(2, 5), r.choice(("span", "li")))}</div>'
        if k == "aside":
            return f"<aside{r.choice(('', self.attr('sidebar', 'widget')))}><h2>{w(2)}</h2>{r.choice((self.links(4), f'<p>{w(r.randint(5, 50))}</p>'))}</aside>"
        return f'<div{self.attr("sidebar", "side", "widget", "rail")}><h4>{w(2)}</h4>{r.choice((self.links(5), f"<p>{w(r.randint(5, 50))}</p><p>{w(9)}</p>"))}</div>'

    def block(self) -> str:
        r = self.r
        x = ' itemprop="x1"'
        k = r.random()
        if k < 0.66:
            a, b = r.choice(((1, 3), (5, 30), (20, 120)))
            text = self.line(a, b)
            return f"<p{x}>{r.choice((text, f'<strong>{text}</strong>', f'<i>{text}', f'{text}<br>{self.words(4)}', f'{text} <a href=/q>{self.words(2)}</a> {self.words(3)}', f'<em>{text}</em>'))}" + r.choice(("</p>", "</p>", ""))
        if k < 0.74:
            return f"<h{(h := r.randint(2, 4))}{x}>{self.line(1, 8)}</h{h}>"
        if k < 0.82:
            t = r.choice(("ul", "ol"))
            return f"<{t}>" + "".join(f"<li{x}>{self.line(2, 25)}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>"
        if k < 0.87:
            return f"<blockquote><p{x}>{self.line(4, 40)}</p></blockquote>"
        if k < 0.91:
            return f"<pre{x}>{self.line(4, 30)}</pre>"
        if k < 0.95:
            return f"<figure><img src=a><figcaption{x}>{self.line(2, 20)}</figcaption></figure>"
        return "<table>" + "".join("<tr>" + "".join(f"<td{x}>{self.line(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"

    def page(self) -> str:
        r = self.r
        self.poor = r.random() < 0.25
        title = f'<h1 itemprop="x1">{self.line(1, 12)}</h1>'
        title = r.choice((title, title, title, f"<header>{title}</header>", f'<div class="entry-header">{title}</div>', ""))
        blocks = [self.block() for _ in range(r.choice((1, 2, 4, 8, 14, 25)))]
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            blocks.insert(r.randint(0, len(blocks)), self.boiler("inside"))
        body = title + "".join(blocks) + r.choice(("", "", "", f"<footer>{self.links(3, 'span')}</footer>"))
        lay = r.random()
        if lay < 0.45:
            main = f"<article{r.choice(('', self.attr('post', 'entry', 'article')))}>{body}</article>"
        elif lay < 0.6:
            main = f"<main>{body}</main>"
        elif lay < 0.85:
            main = f"<div{self.attr('content', 'post', 'entry-content', 'story', 'main', 'article-body')}>{body}</div>"
        elif lay < 0.93:
            main = body
        else:
            main = f"<main><article>{body}</article></main>"
        if r.random() < 0.08:  # a table as the layout
            plain = r.choice((" ", " | ", "<br>")).join(f"<a href=/{i}>{self.words(1)}</a>" for i in range(r.randint(2, 6)))
            left = r.choice((plain, plain, self.links(3), self.boiler("side")))
            main = f"<table><tr><td>{left}</td><td>{main}</td></tr></table>"
        side = "".join(self.boiler("side") for _ in range(r.choice((0, 0, 1, 2))))
        main = r.choice((main + side, side + main, f'<div id="wrap">{main}{side}</div>', f'<div class="row"><div>{main}</div>{side}</div>'))
        top = "".join(self.boiler("top") for _ in range(r.choice((0, 1, 2, 3))))
        bottom = "".join(self.boiler("bottom") for _ in range(r.choice((0, 1, 1, 2, 3))))
        if r.random() < 0.06:  # one form around all that the page has
            top, bottom = f"<form{r.choice((' id=form1', ' action=/page method=post', ''))}>{top}", f"{bottom}</form>"
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body>{top}<!-- x -->{main}{bottom}" + r.choice(("</body></html>", ""))


@functools.lru_cache(maxsize=2)
def train(pages: int = 700, seed: int = 41) -> Trees:
    """Trees fitted on generated pages. A node's class is that of most of its subtree's text; nodes without text are left out."""
    generator = Generator(seed)
    xs, ys = [], []
    for _ in range(pages):
        root, texts, _ = parse(generator.page())
        nodes, rows = features(root, texts)
        index = {id(x): i for i, x in enumerate(nodes)}
        good, every = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            n = sum(len(texts[s]) for s in nodes[i].segments)
            every[i] += n
            good[i] += n * ("x" in nodes[i].tokens)
            if i:
                p = index[id(nodes[i].parent)]
                every[p] += every[i]
                good[p] += good[i]
        some = every > 0
        xs.append(rows[some])
        ys.append(good[some] > 0.5 * every[some])
    return fit(np.concatenate(xs).astype(float), np.concatenate(ys).astype(float))


_FIELDS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Blocks of the article in page order, one in a line; white space in a block is one blank.
    Fields of forms (select, button, datalist, textarea), templates, code, the title and frames
    are never text; all other text is judged by its nodes. A null or empty page has an empty
    text. Null ids and urls stay null; every row is judged by itself, repeated ones alike, and
    an empty table gives an empty table.
    """
    sent = pages.sparkSession.sparkContext.broadcast(train())  # some 100 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = articles([x or "" for x in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _FIELDS)
