"""Counts of nodes against those of their whole texts; one read of the pages for a top node."""

from pagemill.functions import article
from pagemill.functions.htmltree import parse, text_of
from pagemill.functions.stopwords import count_words, short_lists
from pagemill.operators import pages, scoring

EN = short_lists()["en"]
HTML = (
    "<html><head><title>a b</title></head><body> x <div>this is <!-- no --> and<b> of</b>the <a href='/1'>we all <i>the</i></a> <a></a><a href='/2'> one \n two</a>!! - </div><table>stray<tr><td>in it</table>"
    "<p></p><p> </p><p>and the</p><ul><li><a href='/3'>a<li>b</a> c</ul></body></html>"
)


def test_counts_are_those_of_whole_texts(spark):
    table = spark.createDataFrame([(1, "u", HTML), (2, "u", "")], "page_id long, url string, html string")
    rows = {(r.page_id, r.node_id): r for r in pages.html_nodes(table, EN, texts=False).collect()}
    for page, html in ((1, HTML), (2, "")):
        for i, n in enumerate(parse(html).walk()):
            r = rows.pop((page, i))
            stats, links = count_words(text_of(n) if n.is_element else n.text, EN), n.elements("a") if n.is_element else []
            assert (r.word_count, r.stop_count, r.link_count) == (stats.words, stats.stop_words, len(links))
            assert r.link_words == (len("".join(map(text_of, links)).split(" ")) if links else 0)
            assert r.sib_ord == (n.place() if n.up else 0) and (r.text is None) == n.is_element
    assert not rows


def test_top_nodes_read_pages_once(spark):
    table = spark.createDataFrame([(1, "u", "<div id='d'><p>this is what we all have been in</p><p>and of the which they will</p></div>")], "page_id long, url string, html string")
    tops = scoring.top_nodes(pages.html_nodes(table, EN), label=pages.F.col("attrs")["id"])
    assert [(r.label, r.hits) for r in tops.collect()] == [("d", 2)]
    assert tops._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_text_is_counted_once(monkeypatch):
    seen = []
    monkeypatch.setattr(article, "count_words", lambda text, *more: seen.append(text) or count_words(text, *more))
    paragraphs = "".join(f"<p>this is what we all have been in and of the which they will {i}</p>" for i in range(30))
    assert article.extract(f"<html><body><div>{paragraphs}</div></body></html>", "https://e.example.org/", article.ArticleOptions())["cleanedText"].count("\n\n") == 29
    assert len(seen) == len(set(seen))
