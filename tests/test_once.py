"""What a page's html is made of is worked out once, however the page is read."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import metadata, structured_data


@pytest.mark.parametrize("read", [metadata.page_metadata, structured_data.thin_articles])
def test_html_is_made_once(spark, read):
    rows = spark.createDataFrame([(1, "https://a.org/", "x"), (2, "https://a.org/", None), (3, None, "y")], "page_id long, url string, said string")
    made = rows.select("page_id", "url", F.concat(F.lit("<html><head><title>"), F.initcap("said"), F.lit("</title></head><body></body></html>")).alias("html"))
    got = read(made)
    assert {r.page_id for r in got.collect()} == {1, 3}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("initcap(") == 1


def test_script_content_ends_at_its_own_end_tag(spark):
    def script(content, close="</script>"):
        return f'<script type="application/ld+json">{content}{close}'

    def event(name):
        return f'{{"@type": "Event", "name": "{name}"}}'

    deep = event("deep")
    for _ in range(30):  # more levels than are taken before brackets are counted
        deep = f'{{"@graph": [{deep}]}}'
    pages = {
        1: script(event("a")) + script(event("b"), "</SCRIPT >") + script(event("c"), "</script </script>"),
        2: script(event("x</style ")) + script(event("y</b>")),  # was cut at the end tag of another element
        3: script(event("z </scripted>")) + script(event("open"), ""),
        4: script(deep),
        5: script(event("<b>")) + script(f"{event('d')} {event('e')}") + script(f"{event('f')}, {event('g')}") + script(" \t\n"),
        6: '<title><script type="application/ld+json">' + event("t") + "</script></title><!--" + script(event("u")) + "-->",
    }
    rows = spark.createDataFrame([(k, "https://a.org/", v) for k, v in pages.items()], "page_id long, url string, html string")
    got = {}
    for r in structured_data.page_events(rows).collect():
        got.setdefault(r.page_id, []).append(r.title)
    assert got == {1: ["a", "b", "c"], 2: ["x</style", "y</b>"], 3: ["z </scripted>", "open"], 4: ["deep"], 5: ["<b>"]}
