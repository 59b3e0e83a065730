"""Queries over pages that the smallest tables don't hold, against their SQL."""

import duckdb

import __spark_entry__ as entry


def _same(spark, folder, name, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(folder)), sql.sql(entry.oracle_sql()[name])
    order = list(want.columns)
    rows = want.fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, rows))
    return {r[order.index("page_id")]: r for r in rows}


def test_titles_cut_within_a_reference(spark, tmp_path):
    titles = ["a &amp", "a &am", "a &amp;amp", "a & b", "&quot;x&quot", "&lt;b&gt; &copy", "&#65; &eacute; &amp;lt;", "x &copy; &middot;", "", "b &amp;&amp; &amp;amp; \\ $1"]
    rows = [(i, f"https://a.example.org/{i}", f'<html lang="en"><head><title>{t}</title></head><body><p>x &amp y</p></body></html>') for i, t in enumerate(titles)]
    assert len(_same(spark, tmp_path, "page_article_titles", rows)) == len(titles)


def test_referrers_under_www(spark, tmp_path):
    hosts = ["thther.example.org", "www.thther.example.org", "www.other.example.org", "m.thther.example.org", "THTHER.example.org:8443"]
    got = _same(spark, tmp_path, "page_referrer", [(i, f"https://{h}/en/{i}", "") for i, h in enumerate(hosts)])
    assert got[1] == (1, "thther.example.org") and got[0] == (0, None)
