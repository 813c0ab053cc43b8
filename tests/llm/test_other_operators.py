"""Embeddings, pages, components, and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import components, embedding_dedup, html_text


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 230)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("dim", [3, 16, 64])
def test_embeddings(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(120, dim)).astype(np.float32)
    near = np.concatenate([base[:1] + rng.normal(size=(150, dim)) * 0.08, base[1:9] + rng.normal(size=(8, dim)) * 0.05]).astype(np.float32)
    rows = [[float(v) for v in x] for x in np.concatenate([base, near, base[:3], base[:1] * 2])]
    rows += [None, [], [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("inf")] + [0.0] * (dim - 1), [1.0, 2.0]]
    table = spark.createDataFrame([(i, x, 0, 1) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, id int, weight int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    n = len(rows) - 7
    x = np.array(rows[:n], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    found = sum(got[i].n_links for i in range(n))
    assert all(got[i].n_links <= linked[i].sum() for i in range(n)) and found >= 0.98 * linked.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(n, n + 7))
    assert all(r.kept == (r.component_id == r.vec_id) and r.component_id <= r.vec_id for r in got.values())
    assert embedding_dedup.near_duplicates(table.where("false")).collect() == []
    more = table.union(spark.createDataFrame([(None, rows[0], 0, 1), (5, rows[5], 0, 1), (5, None, 0, 1)], table.schema))
    again = embedding_dedup.near_duplicates(more).collect()
    assert len(again) == len(rows) + 3 and [(r.n_links, r.component_id, r.kept) for r in again if r.vec_id is None] == [(0, None, True)]
    assert [tuple(r) for r in again if r.vec_id == 5] == [tuple(got[5])] * 3 and all(tuple(got[r.vec_id]) == tuple(r) for r in again if r.vec_id is not None)


def test_rounding_never_loses_a_pair():
    rng = np.random.default_rng(5)
    for dim in (2, 9, 64, 500):
        x = embedding_dedup.unit(rng.normal(size=(60, dim)) ** 3)
        y = embedding_dedup.unit(x + rng.normal(size=x.shape) * 0.4 * np.abs(x).mean())
        pack = lambda v: pa.array(embedding_dedup.rounded(v), pa.binary())
        for t in (0.5, 0.9, 0.99):
            i, j = embedding_dedup.rounded_matches(t)(pack(x), pack(y))
            assert set(zip(*np.nonzero(x @ y.T >= t), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_sparse_links_in_a_large_cluster_of_embeddings(spark):
    rng = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    own = unit(rng.normal(size=(3000, 64)))
    own[2800:] = unit(own[:200] * 0.68 + unit(rng.normal(size=(200, 64))) * (1 - 0.68**2) ** 0.5)
    x = unit(unit(rng.normal(size=64)) * 0.75**0.5 + own * 0.25**0.5)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table, hashes=1).collect()}
    assert 200 < linked.sum() < 1000 and [got[i] for i in range(3000)] == linked.sum(axis=1).tolist()


@pytest.mark.parametrize("hashes", [3, 4])
def test_recall_of_embeddings_does_not_depend_on_hashes(spark, hashes):
    rng = np.random.default_rng(hashes)
    a, r = rng.normal(size=(2, 500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    x = np.concatenate([a, 0.9001 * a + (1 - 0.9001**2) ** 0.5 * r / np.linalg.norm(r, axis=1, keepdims=True)])
    linked = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None] >= 0.9
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(table, hashes=hashes).collect())
    assert linked.sum() - len(x) == 1000 and found >= 0.9975 * 1000


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 8))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x)


PARTS = [
    ("<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><article><h1>T &amp; t</h1><p>One  <b>bold</b>\n text.<p>Two<br>lines</article><footer>F</footer>", "T & t\n\nOne bold text.\n\nTwo lines"),
    ("<p><b>Open.<br><p>Next</p>", "Open.\n\nNext"),
    ("<div>a <span class='ad'>x<span>y</span></span> b</div><p>c<b>d</p>e<script>var t='</p>';</script>f<footer>g</footer>", "a b\n\ncd\n\ne f"),
    ("<article class='post'><header><h1>T</h1></header><p>x&nbsp;y &lt;b&gt;<ul><li>1<li>2</ul><div class='comments'><p>no</p></div><aside>q</aside><p>end <p a='", "T\n\nx y <b>\n\n1\n\n2\n\nend"),
    ("<body class='has-sidebar'><div id='cookie-notice'>c</div><form>f</form><main><p>m</p></main><div class='sidebar'>s</div>", "m"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<article><p>x</p><div hidden>h</div><div style='display: none'>h</div></article>", "x"),
    ("text 1 < 2 &amp &am", "text 1 < 2 & &am"),
    ("<!-- a <p>b</p> --><![CDATA[x]]><?php y ?><p>z</p>", "z"),
    ("<nav>only a menu</nav>", ""), ("", ""), (None, ""),
    ('<div class="post discussion"><p>The whole article</p></div>', "The whole article"),
    ('<div id="search-algorithms"><p>Sorting</p></div>', "Sorting"),
    ('<article><p>Start <span class="share">x</p><p>The rest</article>', "Start\n\nThe rest"),
    ("<p>a <svg class='ad'/> b</p><p>c <button>d</p><p>e</i></section></p>f", "a b\n\nc\n\ne\n\nf"),
    ('<div class="ad-banner">a</div><div class="content sidebar-left">b</div><div role="navigation">c</div>', "b"),
]


@pytest.mark.parametrize(("page", "expected"), PARTS)
def test_main_text(page, expected):
    assert html_text.main_text(page) == expected


def test_deep_and_long_pages():
    n = 100_000
    assert html_text.main_text("<div>" * n + "deep" + "</div>" * n) == "deep"
    assert html_text.main_text("<div><b>" * n + "deep" + "</i></p></section></div>" * n) == "deep"
    assert html_text.main_text("<p>x" * n).count("x") == n


def brute_tree(pages):
    """Importances of places by the definition: entropies to the base of the number of different pages that have the place."""
    shown, texts = {}, {}
    for page in set(pages):
        elements, found = html_text.parse(page)
        for kind, place, feature in {(0, e.place, ",".join(dict.fromkeys(e.children))) for e in elements if e.children and not e.noise} | {(1, elements[t.inside].place, t.text) for t in found}:
            (texts if kind else shown).setdefault(place, []).append(feature)

    def entropy(features):
        m = len(features)
        return 1.0 if m == 1 else -sum(c / m * math.log(c / m, m) for c in Counter(features).values())

    out = {}
    for place in shown.keys() | texts.keys():
        inner = 0.9 ** len(set(shown[place])) if place in shown else 0.9
        own = (1 - inner) * entropy(shown[place]) if place in shown else 0.1
        out[place] = (own, inner, entropy(texts[place]) if place in texts else 1.0)
    return out


def test_style_tree_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda: "<body>" + "".join(f"<div class=c{rng.randrange(3)}><p>t{rng.randrange(4)}</p><ul><li>i{rng.randrange(2)}</ul></div>" for _ in range(rng.randrange(1, 4))) + "<nav>n</nav></body>"
    for n in (1, 2, 9, 40):
        pages = [make() for _ in range(n)]
        got = html_text.style_tree(spark.createDataFrame([("h", p) for p in [*pages, *pages[:3]]], "host string, html string")).collect()
        expected = {k: v for k, v in brute_tree(pages).items()}
        found = {p.place: (p.own, p.inner, p.content) for r in got for p in r.places}
        assert found.keys() <= expected.keys()
        assert all(np.allclose(found.get(k, html_text.ALONE), v, atol=1e-6) for k, v in expected.items())


def test_importance_is_merged_upward():
    page = "<div><div><p>same</p><p>same too</p></div><div><p>own text</p></div></div>"
    elements, texts = html_text.parse(page)
    low = {elements[t.inside].place for t in texts}
    assert len(low) == 1  # all paragraphs have one place here, as the divs have no names
    page = "<div class=a><div class=b><p>same</p></div></div><div class=c><p>own text</p></div>"
    elements, texts = html_text.parse(page)
    b = elements[texts[0].inside]
    assert html_text.main_text(page, {b.place: (0.1, 0.9, 0.0)}) == "own text"
    parent = elements[b.parent]
    assert html_text.main_text(page, {b.place: (0.1, 0.9, 0.0), parent.place: (0.9, 0.1, 1.0)}) == "own text"  # the text itself is unimportant


def test_site_style_tree(spark):
    page = lambda i: f"<html><body><div class='top'><div>Welcome to our site</div></div><div class='body'><p>Own words {i} of page {i * 7}.</p></div><div class='low'>All rights</div></body></html>"
    rows = [(i, "https://a.example/x", page(i)) for i in range(20)] + [(100 + i, f"https://b{i}.example/x", page(i)) for i in range(3)]
    rows += [(200 + i, "http://c.example/", "<article><p>The same article</p></article>") for i in range(15)] + [(300, None, None), (None, "x", "<p>y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("text"), F.lit(3).alias("places"))
    got = {r.page_id: r for r in html_text.extract(table).collect()}
    plain = {r.page_id: r.text for r in html_text.extract(table, tree=False).collect()}
    assert all(plain[i].startswith("Welcome to our site") and plain[i].endswith("All rights") for i in range(20))
    assert len(got) == len(rows) and all(got[i].text == f"Own words {i} of page {i * 7}." for i in range(20))
    assert got[100].text.startswith("Welcome to our site\n\nOwn words 0")  # a single page shows nothing
    assert all(got[200 + i].text == "The same article" for i in range(15)) and (got[300].text, got[300].n_chars) == ("", 0) and got[None].text == "y"
    assert html_text.extract(table.where("false")).collect() == []


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert ids < {r.doc_id for r in docs.collect()} and not [i for i in ids if labels.get(i) == 0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "line dedup", "n-gram Jaccard join", "packing"]


def test_registered_names():
    from tessella.llm import queries

    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(queries.queries())
