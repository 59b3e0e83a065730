"""Bodies in UTF-8 are read by built-in functions; Python sees the others alone."""

from pyspark.sql import functions as F

from pagemill.sources.web import decoded


def test_utf8_stays_out_of_python(spark):
    rows = [
        (1, "text/html; charset=utf-8", "é x".encode()), (2, None, "﻿﻿ok".encode()), (3, None, b"<meta charset='koi8-r'>" + "да".encode("koi8-r")), (4, "a; charset=latin-1", b"\xe9"),
        (5, "charset=utf-8", b"\xe9a"), (6, None, None), (7, None, b""), (8, "charset=none", b"abc"), (9, "charset=UTF8", b"abc"),
    ]
    df = spark.createDataFrame(rows, "i int, content_type string, body binary").select("i", decoded(F.col("body"), F.col("content_type")).alias("text"))
    assert {r.i: r.text for r in df.collect()} == {1: "é x", 2: "﻿ok", 3: "<meta charset='koi8-r'>да", 4: "é", 5: "�a", 6: None, 7: "", 8: "abc", 9: "abc"}
    assert "regexp_replace(" in df._jdf.queryExecution().optimizedPlan().toString()
