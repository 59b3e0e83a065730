"""Scores over the table of nodes against the walk of the tree."""

import random

import pytest

from pagemill.functions import article
from pagemill.functions.htmltree import text_of
from pagemill.functions.stopwords import short_lists
from pagemill.operators import pages as pg
from pagemill.operators import scoring

STOPS = "this is what we all have been in and of the which they will not be with".split()


def some_page(r: random.Random) -> str:
    def words(n: int) -> str:
        return " ".join(r.choice(STOPS if r.random() < 0.5 else ["stone", "river", "lamp"]) for _ in range(n))

    def block(depth: int) -> str:
        out = []
        for _ in range(r.randrange(1, 9)):
            kind = r.randrange(9)
            if kind < 4:
                out.append(f"<p>{words(r.randrange(0, 25))}</p>")
            elif kind == 4:
                out.append(f"<p><a href='/x'>{words(r.randrange(1, 15))}</a> {words(r.randrange(0, 6))}</p>")
            elif kind == 5:
                out.append(f"<pre>{words(r.randrange(3, 20))}</pre>")
            elif kind == 6:
                out.append(f"<table><tr><td>{words(9)}</td><td><p>{words(12)}</p></td></tr></table>")
            elif depth:
                out.append(f"<{r.choice(['div', 'section'])} {r.choice(['', 'itemprop=articleBody', 'class=post-content', 'class=xpost-contents'] if r.random() < 0.2 else [''])}>{block(depth - 1)}</div></section>")
            else:
                out.append(words(5))
        return "".join(out)

    return f"<html lang=en><body>{'<article>' if r.random() < 0.1 else ''}{block(3)}</body></html>"


@pytest.fixture(scope="module")
def made():
    r = random.Random(21)
    return [*(some_page(r) for _ in range(150)), "", "<p>this is what we all have</p>", "<body><div>" + f"<p>{' '.join(STOPS)}</p>" * 40 + "</div></body>"]


@pytest.fixture(scope="module")
def nodes(spark, made):
    table = spark.createDataFrame([(i, "https://e.org/", h) for i, h in enumerate(made)], "page_id long, url string, html string")
    return pg.html_nodes(table, short_lists()["en"]).cache()


@pytest.mark.parametrize("narrow", [False, True])
def test_top_nodes_and_what_comes_before_them(made, nodes, narrow):
    scope = scoring.main_text_roots(nodes) if narrow else None
    tops = scoring.top_nodes(nodes, scope).cache()
    got, usual = {r.page_id: r for r in tops.collect()}, {r.page_id: r.usual for r in scoring.usual_stops(nodes, tops).collect()}
    before, most = {}, 0
    for r in sorted(scoring.neighbours(nodes, tops).collect(), key=lambda r: r.place):
        before.setdefault(r.page_id, []).append(r.text)
    for i, h in enumerate(made):
        page = article._Page(h, "https://e.org/", article.ArticleOptions())
        page.listed = short_lists()["en"]
        if narrow:
            page.scope = article.main_text_root(page.root) or page.root
        number = {id(n): k for k, n in enumerate(page.root.walk())}
        top = article.best_node(page)
        assert (number[id(top)], top.score, top.hits) == (got[i].node_id, got[i].score, got[i].hits) if top else i not in got
        most = max(most, sum(1 for n in page.root.elements("p")))
        if top:
            own = [s for s in (page.stops(p) for p in top.elements("p") if not article.link_heavy(p)) if s > 2]
            assert usual[i] == (sum(own) // len(own) if own else 100_000)
            size = len(top.kids)
            article._add_neighbours(page, top)
            assert before.get(i, []) == [text_of(k) for k in top.kids[: len(top.kids) - size]]
    assert most > 30 and before and len(got) > 100


def test_scores_of_no_pages(nodes):
    none = nodes.limit(0)
    assert scoring.top_nodes(none).count() == 0 and scoring.neighbours(none, scoring.top_nodes(none)).count() == 0
