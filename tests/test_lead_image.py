"""The lead image by joins against the walk of the tree."""

import random

from pyspark.sql import functions as F

from pagemill.functions import article
from pagemill.operators import lead_image
from pagemill.operators import pages as pg

SIZES = {f"https://e.org/{n}.jpg": (r, w, h) for n, (r, w, h) in enumerate([(0, 400, 300), (5000, 60, 60), (90_000, 900, 800), (3000, 900, 900), (20_000_000, 900, 900), (50_000, 1000, 150), (50_000, 310, 500), (50_000, 40, 40), (60_000, 0, 0)])}


def some_page(r: random.Random) -> str:
    def img() -> str:
        return f"<img src='{r.choice(['/', 'https://e.org/', ''])}{r.randrange(11)}.{r.choice(['jpg'] * 8 + ['gif'])}'>" if r.random() < 0.9 else "<img>"

    def block(depth: int) -> str:
        out = []
        for _ in range(r.randrange(0, 4)):
            mark = r.choice(["id=x-big_photo", "class=big_photo", "class='a site-box'", "id=ap-smallphoto-a"]) if r.random() < 0.04 else ""
            out.append(f"<div {mark}>{block(depth - 1)}</div>" if depth and r.random() < 0.6 else img() * r.choice([1, 1, 1, 2, 40]) if r.random() < 0.4 else "<p>x</p>")
        return "".join(out)

    head = "".join(x for x in ("<link rel='image_src' href='/l.png'>", "<meta property='og:image' content=''>", "<meta property='og:image' content='o.png'>") if r.random() < 0.5)
    return f"<html><head>{head}</head><body>{block(5)}</body></html>"


def test_lead_images_as_the_walk_finds_them(spark):
    r = random.Random(13)
    made = [some_page(r) for _ in range(300)]
    urls = [f"https://{'www.' if i % 2 else ''}e.org/{'' if i % 3 else 'a/'}" for i in range(len(made))]
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, made, strict=True))], "page_id long, url string, html string")
    nodes = pg.html_nodes(table, counts=False).cache()
    catalog = spark.createDataFrame([(k, *v) for k, v in SIZES.items()], "src string, bytes long, width int, height int")
    options = article.ArticleOptions(pictures=SIZES.get, picture_boxes={"e.org": "site-box|other"})
    tops, want = [], {}
    for i, (u, h) in enumerate(zip(urls, made, strict=True)):
        page = article._Page(h, u, options)
        every = list(page.root.walk())
        k = r.choice([j for j, n in enumerate(every) if n.is_element])
        tops.append((i, k))
        found = article.lead_image(page, every[k], article.host_of(u))
        want[i] = (found["url"], found["type"], round(found["confidence"], 6), found["width"], found["height"])
    got = lead_image.lead_images(nodes, spark.createDataFrame(tops, "page_id long, node_id int"), table, catalog, spark.createDataFrame([("e.org", "site-box|other")], "domain string, css string"))
    assert {x.page_id: (x.src, x.type, round(x.confidence, 6), x.width, x.height) for x in got.collect()} == want
    kinds = [x[1] for x in want.values()]
    assert min(kinds.count(k) for k in ("known", "bigimage", "linktag", "opengraph", "")) > 5
    assert lead_image.lead_images(nodes.limit(0), spark.createDataFrame([], "page_id long, node_id int"), table, catalog).count() == 0
    assert nodes.filter(F.col("last_id") < F.col("node_id")).isEmpty()
