"""The page model: exact marginals, held-out pages, the reader on broken markup, the query on awkward rows."""

from __future__ import annotations

import html
import itertools
import os
import re

import numpy as np
import pytest

from caselens.llm import page_text as P
from caselens.llm.page_samples import MARK, labelled_pages

DATA = os.environ.get("CASELENS_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def model():
    return P.default_model()


def text_of(model, page):
    return P.page_texts(model, [page])[0]


def test_messages_give_the_marginals_of_all_assignments():
    rnd = np.random.default_rng(3)
    page = "<div class=ad>a<p>b, c.</p></div><article><h1>d</h1><p>e <a href=x>f</a></p></article>"
    forest = P.Forest()
    P.read_page(forest, 0, page)
    t = P.trees(forest)
    model = P.PageModel(rnd.normal(size=P.N_FEATURES), rnd.normal(size=(P.N_EDGES, 2, 2)))
    node = np.bincount(t.node, weights=model.weights[t.feature], minlength=len(t.parent))
    total, chance = 0.0, np.zeros(len(node))
    for states in itertools.product([0, 1], repeat=len(node)):
        score = sum(node[k] for k, s in enumerate(states) if s)
        score += sum(model.edges[t.edge[k]][states[t.parent[k]], states[k]] for k in range(1, len(node)))
        total += np.exp(score)
        chance += np.exp(score) * np.array(states)
    got, pair = P.marginals(model, t)
    assert len(node) < 14 and np.allclose(got, chance / total)
    assert np.allclose(pair[1:].sum(axis=(1, 2)), 1) and np.allclose(pair[1:, :, 1].sum(axis=1), got[1:])


def test_held_out_pages(model):
    pages = list(labelled_pages(300, 2024))
    forest = P.Forest()
    for k, page in enumerate(pages):
        P.read_page(forest, k, page)
    wanted = np.array([MARK in x for x in forest.text])
    plain = P.Forest()
    for k, page in enumerate(pages):
        P.read_page(plain, k, page.replace(MARK, ""))
    runs = (np.array(plain.block) >= 0) & (np.array(plain.words) > 0)
    found = P.marginals(model, P.trees(plain))[0] >= 0.5
    words = np.array(plain.words)
    assert (found == wanted)[runs].mean() > 0.98
    assert words[wanted & found & runs].sum() > 0.97 * words[wanted & runs].sum()
    assert words[found & ~wanted & runs].sum() < 0.03 * words[~wanted & runs].sum()


def test_given_pages(model):
    if not os.path.isdir(DATA):
        pytest.skip("test tables not present")
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    for r in rows:
        page = r["html"] or ""
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)
        bare = re.sub(r"</?(?:p|h1|br)>", " ", inner.group(1)) if inner else ""
        assert text_of(model, page) == " ".join(html.unescape(re.sub(r"</?b>", "", bare)).split())


ARTICLE = "<article><h1>A title</h1><p>First, with some words. Second sentence here.</p>{}<p>Last one, it ends here.</p></article>"
PLAIN = "A title First, with some words. Second sentence here. Last one, it ends here."


@pytest.mark.parametrize(
    "outside",
    [
        "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<header><h1>My site</h1><p>What we say of us.</p></header>",
        "<footer><p>&copy; 2020 Us. All of it, always.</p></footer>", "<aside><h3>Related</h3><p>A long teaser, with words in it. And more.</p></aside>",
        "<div id='cookie-banner'><p>We use cookies, for you. Accept them.</p></div>", "<div class='ad'>Buy this now, it is good.</div>",
        "<form action=/s><label>Search</label><p>Sign up to our letters today.</p><select><option>x</select></form>", "<style>p{}</style>",
        "<div class='comments'><div class='comment'><p>I liked it, thanks a lot. It was good.</p></div></div>", "<script>var t='</p>';</script>",
        "<ul class='breadcrumbs'><li>Home<li>News</ul>", "<!-- a > comment -->", "<section id='reader-comments'><p>First!</p></section>",
    ],
)
def test_parts_that_go(model, outside):
    for page in (outside + ARTICLE.format(""), ARTICLE.format("") + outside):
        assert text_of(model, f"<html><body>{page}</body></html>") == PLAIN


def test_white_space_and_references(model):
    page = ARTICLE.format("<p>a&nbsp; b\n\tc&#8212;d &amp;amp; <b>e</b>f <i> g</i><br>h<script>x</script>i &lt;p&gt;</p><pre>k\n  l</pre>")
    assert text_of(model, page) == PLAIN.replace("Last", "a b c—d &amp; ef g hi <p> k l Last")


def test_broken_markup(model):
    assert text_of(model, "") == "" and text_of(model, "<p>") == "" and text_of(model, "<") in ("", "<")
    page = "<article><p>one, of them.<p><b>two, of them.</div></span><ul><li>three<li>four</ul><p>five <![CDATA[ x ]]>six.<td>seven, it is."
    assert text_of(model, page) == "one, of them. two, of them. three four five six. seven, it is."
    for odd in ("<" * 2000, "<a " * 2000, "</div>" * 2000, "<!--" * 500, "<div>" * 3000 + "x", "&" * 3000, "<p class=" + "x" * 100_000 + ">y"):
        text_of(model, odd)


def test_long_article_is_kept_whole(model):
    words = [f"word{k}" for k in range(40_000)]
    body = "".join(f"<p>{' '.join(words[k : k + 20])}.</p>" for k in range(0, len(words), 20))
    got = text_of(model, f"<nav><a href=x>y</a></nav><article>{body}</article>")
    assert got.replace(".", "").split() == words


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, _html string"
    good = ARTICLE.format("")
    pages = [(1, "u", good), (1, "u", good), (None, None, good), (2, "v", None), (3, "w", ""), (4, "x", "é <p>")]
    df = spark.createDataFrame([(*p, "a", "b", "c") for p in pages], schema).repartition(3)
    rows = sorted(P.extract_text(df).collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert [(r.page_id, r.url) for r in rows] == [(None, None), (1, "u"), (1, "u"), (2, "v"), (3, "w"), (4, "x")]
    assert [r.text for r in rows[:5]] == [PLAIN, PLAIN, PLAIN, "", ""]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert P.extract_text(spark.createDataFrame([], schema)).collect() == []
