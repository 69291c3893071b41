"""HTML extraction and near-duplicate embeddings on odd cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import covertree, dom, embeddings, htmltext
from marlstone.llm.dom import parse

from . import cases

BOILER = '<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><div class="ad">Buy this now, cheap.</div>'
PAGE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>" + BOILER + "<article><h1>Head &amp; line</h1><p><b>First   par\n agraph here.<br><p>Second &lt;one&gt;, with words and &eacute;.</p></article><footer>&copy; site</footer>"


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <b>text"), (5, "x", BOILER), (6, "y", PAGE.replace("Second", "long " * 60000)), (7, "z", "<<<>>> &#xZZ; <p"), (None, "n", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = {r["page_id"]: r for r in htmltext.extract(df).collect()}
    want = "Head & line\nFirst par agraph here.\nSecond <one>, with words and é."
    assert len(got) == 8 and got[1]["text"] == got[None]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and got[5]["text"] == "" and got[6]["n_chars"] > 300000
    assert htmltext.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("tag", "button select template datalist title textarea iframe".split())
def test_unclosed_elements_do_not_cut_the_page(tag):
    """What is never ended takes nothing with it; what is ended still goes."""
    read = lambda source: parse(source)[1]
    assert read(f"<p>One</p><{tag} class=x><p>Two</p><div>Three</div>") == ["One", "Two", "Three"]
    assert read(f"<p>One</p><{tag}>gone</{tag}><p>Two</p>") == ["One", "Two"]
    if tag not in dom.RAW:
        assert read(f"<p>One</p><{tag}><p>Two</p><{tag}>gone<{tag}>gone</{tag}></{tag}><{tag}><p>Three</p><{tag}/>") == ["One", "Two", "Three"]
        assert read(f"<{tag}><script>'</{tag}>'</script>gone<title/></{tag}><p>One") == ["One"]
        assert len(read(f"<{tag}><p>x" * 20000)) == 20000


SOUP = [
    ("<p don't>A one</p><p>It's B</p>", ["A one", "It's B"]),
    ("<p a='x>y' b=\"p>q\" c=d'e>One</p>", ["One"]),
    ("<p title = 'a > b'>One<p x=\"never closed>Two<p>Three", ["One", "Two", "Three"]),
    ("<p =\">One</p>", ["One"]),
    ("<p a=b\"c>One</p><p>\"Two\"</p>", ["One", '"Two"']),
    ("<p/class=x>One<br/>two</p>", ["One two"]),
    ("A<!-->B<!--->C<!-- x -- y -->D<!-- > -->E", ["ABCDE"]),
    ("<p>The area is <math><mi>x</mi><mo>+</mo><mn>2</mn></math> in all</p>", ["The area is x+2 in all"]),
    ("<p>See <video controls><source src=x>this clip</video> now</p>", ["See this clip now"]),
    ("<p>a <svg><text>label</text></svg> b</p>", ["a label b"]),
    ("<noscript>Turn it on</noscript><p>Text", ["Turn it on", "Text"]),
    ("<p>pick <select><option>one<option>two</select> <button>go</button> end", ["pick end"]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<p>x<table><tr><td><p>one<p>two<td>three<tr><td>four</table>y", ["x", "one", "two", "three", "four", "y"]),
    ("</p></div>a</x><p", ["a"]),
    ("3 < 4 &lt;b&gt; <3", ["3 < 4 <b> <3"]),
]


@pytest.mark.parametrize(("source", "texts"), SOUP)
def test_tag_soup(source, texts):
    assert parse(source)[1] == texts


def test_attributes():
    words, hidden = dom.attribute_tokens(" title='x class=no' data-id=\"no\" CLASS=\"mainText side-bar\" id=a role='note' style=\"color:red; display : none\"")
    assert words == {"main", "text", "side", "bar", "a", "note"} and hidden
    assert dom.attribute_tokens("class=story hidden=x /") == (frozenset(("story",)), True)


@pytest.mark.parametrize("page", ["<div>" * 20000 + "x", "<p><table><td>" * 7000 + "x", "<ul><li>" * 10000 + "x" + "</ul>" * 10000, "<div><p a='" * 9000, "<li><ul>" * 9000 + "</li>" * 9000 + "x"])
def test_deep_pages_take_no_longer(page):
    import time

    began = time.time()
    root, texts, _ = parse(page)
    htmltext.features(root, texts)
    assert time.time() - began < 4


def test_head_without_tags(spark):
    body = BOILER + PAGE[PAGE.index("<article>") :]
    pages = [f"<head><title>T</title>{body}", f"<html><head><meta charset=x><style>p{{}}</style><noscript>no</noscript><link href=/x>{body}", f"<head><title>T</title></head>{body}"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    want = "Head & line\nFirst par agraph here.\nSecond <one>, with words and é."
    assert {r["text"] for r in htmltext.extract(df).collect()} == {want}
    assert parse("<head><title>T</title>Bare <b>text</b><h1>H</h1>")[1] == ["Bare text", "H"]


def test_generated_pages():
    """Held-out pages of the generator: most come out exactly, nearly all of the text is right."""
    g, model = htmltext.Generator(12345), htmltext.train()
    exact = right = every = 0
    for _ in range(120):
        source = g.page()
        _, texts, owners = parse(source)
        want = {i for i, o in enumerate(owners) if "x" in o.tokens}
        got = htmltext.article(source, model)
        exact += got == "\n".join(t for i, t in enumerate(texts) if i in want)
        kept = got.split("\n")
        right += sum(len(t) for i, t in enumerate(texts) if (t in kept) == (i in want))
        every += sum(map(len, texts))
    assert exact >= 100 and right >= 0.97 * every


def test_no_contradictions():
    model = htmltext.train()
    root, texts, _ = parse(PAGE)
    nodes, rows = htmltext.features(root, texts)
    for switch in (0.0, 1.0, 50.0):
        keep = htmltext.decode(nodes, model.probability(rows), switch)
        assert len(keep) == len(nodes)
    # Mixing at that price never pays, but for the page and its body: each of its parts is kept or dropped as a whole.
    index = {id(n): k for k, n in enumerate(nodes)}
    parts = {}
    for n, k in zip(nodes, keep.tolist(), strict=True):
        top = n
        while top.parent and top.parent.tag not in ("#root", "body"):
            top = top.parent
        if n.tag not in ("#root", "body"):
            parts.setdefault(index[id(top)], set()).add(k)
    assert len(parts) > 3 and all(len(x) == 1 for x in parts.values())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in cases.CLASHING}).repartition(3)


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: [m for m, (_, w) in enumerate(good) if m != k and len(w) == len(v) and v @ w / math.sqrt((v @ v) * (w @ w)) >= cosine] for k, (_, v) in enumerate(good)}
    comp = cases.component_ids(sorted({i for i, _ in good}), lambda a, b: any(good[m][0] == b for k, (i, _) in enumerate(good) if i == a for m in links[k]))
    return {i: (len(links[k]), comp[i]) for k, (i, _) in enumerate(good)}


def test_vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8))
    x[100:140] = x[0] + r.normal(size=(40, 8)) * 0.12
    x[140:160] = x[7]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] * 4), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0] * 8)]
    want = brute(rows)
    for settings in (embeddings.Settings(), embeddings.Settings(cell_rows=20)):
        got = embeddings.near_duplicate_vectors(vectors(spark, rows), settings).collect()
        assert len(got) == len(rows)
        for g in got:
            n, c = want.get(g["vec_id"], (0, g["vec_id"]))
            assert (g["n_links"], g["component_id"], g["kept"]) == (n, c, c is None or c == g["vec_id"]), g
    assert embeddings.near_duplicate_vectors(vectors(spark, rows[:1]).where("false")).count() == 0


def test_one_id_with_several_vectors(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [0.0, 1.0, 0.05]
    rows = [(3, a), (5, a), (5, b), (9, c), (7, [0.0, 0.0, 1.0]), (5, b)]
    got = sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in embeddings.near_duplicate_vectors(vectors(spark, rows)).collect())
    assert got == [(3, 1, 3), (5, 1, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (9, 2, 3)]


def test_double_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(90, 12))
    x[30:60] = x[0] + r.normal(size=(30, 12)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    got = embeddings.near_duplicate_vectors(df, embeddings.Settings(cell_rows=7)).collect()
    assert {g["vec_id"]: (g["n_links"], g["component_id"]) for g in got} == want


def test_most_pairs_of_clusters_are_never_compared():
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 32))[r.integers(0, 200, 4000)] + 0.05 * r.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, tree = covertree.Links(len(x), np.ones(len(x), np.int64)), covertree.build(x)
    covertree.dual(x, tree, tree, 0.95, links)
    assert (links.count == (x @ x.T >= 0.95).sum(1) - 1).all() and links.compared < 0.1 * 4000 * 3999 / 2


@pytest.mark.parametrize("spread", [0.02, 0.2, 3.0])
def test_cover_tree(spread):
    """The traversal finds what all pairs find, in clusters of any tightness."""
    r = np.random.default_rng(2)
    x = r.normal(size=(6, 16))[r.integers(0, 6, 1500)] + spread * r.normal(size=(1500, 16)) / 4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = covertree.Links(len(x), np.ones(len(x), np.int64))
    tree = covertree.build(x)
    covertree.dual(x, tree, tree, 0.95, links)
    assert (links.count == (x @ x.T >= 0.95).sum(1) - 1).all()

    def within(node):
        points = np.concatenate([c.points for c in node.children]) if node.children else node.points
        assert sorted(points) == sorted(node.points)
        for c in node.children:
            within(c)

    within(tree)


def unclustered(n, dim, seed):
    """Vectors without clusters, each with two more that lean towards the next one."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = np.concatenate([v, v + 0.2 * np.roll(v, -1, 0), v + 0.35 * np.roll(v, -1, 0)])
    return r.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))


@pytest.mark.parametrize("dim", [12, 64])
def test_unclustered_vectors_are_compared_in_whole_blocks(dim):
    """No tree of some thousand nodes of two or three vectors each: their visits took many times as long as the blocks."""
    x = unclustered(1200, dim, 6)
    x[:40] = x[0] + 0.01 * x[40:80]  # and one block with more links than are decided one by one
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    extra = np.concatenate([x, x[:1] + 0.005 * np.random.default_rng(7).normal(size=(100, dim))])
    extra /= np.linalg.norm(extra, axis=1, keepdims=True)
    weights = 1 + np.arange(len(extra)) % 3
    want = extra @ extra.T >= 0.95
    np.fill_diagonal(want, False)
    basis = covertree.leading_basis(extra, 0.95)
    assert (basis is None) == (dim == 12)

    def nodes(node):
        return 1 + sum(map(nodes, node.children))

    half = len(extra) // 2
    for b in (basis, None):
        tree, links = covertree.build(extra), covertree.Links(len(extra), weights)
        assert nodes(tree) < len(extra) // 16 or dim == 12
        covertree.dual(extra, tree, tree, 0.95, links, b)
        assert (links.count == want @ weights).all()
        one, two, links = covertree.build(extra, np.arange(half)), covertree.build(extra, np.arange(half, len(extra))), covertree.Links(len(extra), weights)
        covertree.dual(extra, one, two, 0.95, links, b)
        across = want.copy()
        across[:half, :half] = across[half:, half:] = False
        assert (links.count == across @ weights).all()
        e = np.concatenate(links.edges, axis=1)
        assert set(np.unique(e[:, e[0] != e[1]])) == set(np.flatnonzero(across.any(1)))


def test_leading_coordinates_bound_the_cosine():
    x = unclustered(3000, 48, 9)
    basis = covertree.leading_basis(x, 0.95)
    x = x[:1000]
    low = covertree.leading(x, basis)
    assert low.shape[1] < 48 and (low @ low.T >= x @ x.T - 1e-5).all()
    r = np.random.default_rng(3)  # all vectors lie near one direction: few coordinates rule nothing out
    near = 1 + 0.2 * r.normal(size=(600, 48))
    assert covertree.leading_basis(near / np.linalg.norm(near, axis=1, keepdims=True), 0.95) is None


def test_numbers_of_cells():
    base, parts = embeddings._numbers([5, 1, 2, 12, 3, 9, 10, 25], 10)
    assert base.tolist() == [1, 0, 0, 4, 0, 2, 3, 6] and parts.tolist() == [1, 1, 1, 2, 1, 1, 1, 3]
    assert embeddings._numbers([1] * 7, 3)[0].tolist() == [0, 0, 0, 1, 1, 1, 2]


def test_unclustered_vectors_in_many_cells(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(unclustered(60, 32, 8))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.near_duplicate_vectors(df, embeddings.Settings(cell_rows=25)).collect()
    assert {g["vec_id"]: (g["n_links"], g["component_id"]) for g in got} == brute(rows)


_ONE = "The river ran high that spring, and the town waited for news from the valley above."
_TWO = "By noon, the bridge was closed; nobody crossed until evening came."
_BODY = f"<p>{_ONE}</p><p>{_TWO}</p>"
_BOTH = f"{_ONE}\n{_TWO}"
#: Pages written by hand: forms in and around the text, blocks without a telling name, tables as the layout.
HAND = {
    "form inside the article": f"<article><p>{_ONE}</p><form><label>Name</label><p>Send us your view</p></form><p>{_TWO}</p></article>",
    "form at its end": f"<article>{_BODY}<form action=/c><h3>Write to us</h3><label>Mail <input></label><textarea></textarea><button>Go</button></form></article>",
    "form with a list": f"<main>{_BODY}<form><ul><li>Yes <input type=radio><li>No <input type=radio></ul><input type=submit></form></main>",
    "form with a fieldset": f"<div class=post>{_BODY}<form><fieldset><legend>Sign up</legend><p>Your address please</p><input></fieldset></form></div>",
    "form before the text": f"<form><div>Find <input name=q></div></form><article>{_BODY}</article>",
    "form around the page": f"<form id=aspnetForm action=x><div id=content>{_BODY}</div></form>",
    "form around menu and text": f"<form id=form1><nav><a href=/>Home</a> <a href=/a>About</a></nav><article>{_BODY}</article><footer>&copy; site</footer></form>",
    "words at the top": f"<div class=top>Home News Sport</div><div class=text>{_BODY}</div><div class=bot>Copyright 2020</div>",
    "logo and last line": f"<div class=logo>The Paper</div><div id=content>{_BODY}</div><p class=end>&copy; 2019 The Paper</p>",
    "unnamed last line": f"<article>{_BODY}</article><div>Copyright 2020</div>",
    "unnamed first line": f"<div>The Paper</div><article>{_BODY}</article>",
    "centred last line": f"<main>{_BODY}</main><center>All rights reserved 2011</center>",
    "menu cell": f"<table><tr><td><a href=/>Home</a> <a href=/about>About</a></td><td>{_BODY}</td></tr></table>",
    "menu row": f"<table width=100%><tr><td><a href=/>Home</a></td><td><a href=/a>News</a></td><td><a href=/b>Sport</a></td></tr></table><article>{_BODY}</article>",
    "menu list in a cell": f"<table><tr><td><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></td><td>{_BODY}</td></tr></table>",
    "menu of spans": f"<div class=menu><span><a href=/>Home</a></span><span><a href=/b>Shop</a></span></div><div class=entry>{_BODY}</div>",
    "newsletter inside": f"<article><p>{_ONE}</p><div class=newsletter><p>Get our letter every day</p><form>Mail <input></form></div><p>{_TWO}</p></article>",
    "share links inside": f"<article><p>{_ONE}</p><div class=share><a href=/t>Tweet</a> <a href=/f>Post</a></div><p>{_TWO}</p></article>",
    "comments below": f"<article>{_BODY}</article><div id=comments><h3>Comments</h3><div class=comment><p>What a fine story this is</p></div></div>",
    "cookie notice": f"<div class=cookie-notice role=dialog><p>We use cookies to make this site better for you.</p><button>OK</button></div><article>{_BODY}</article>",
    "advert inside": f"<article><p>{_ONE}</p><div class=ad><p>Buy this now, cheap.</p></div><p>{_TWO}</p></article>",
    "related below": f"<article>{_BODY}</article><section class=related><h3>More like this</h3><ul><li><a href=/x>Other story</a></li><li><a href=/y>Third story</a></li></ul></section>",
    "login beside": f"<main>{_BODY}</main><aside><form class=login><label>User</label><input><label>Word</label><input></form></aside>",
}


@pytest.mark.parametrize("name", HAND)
def test_hand_written_pages(name):
    assert htmltext.article(f"<!DOCTYPE html><html><head><title>T</title></head><body>{HAND[name]}</body></html>", htmltext.train()) == _BOTH
