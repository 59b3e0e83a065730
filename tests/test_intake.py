"""What is recorded of requests, and the log that takes a batch once."""

import hashlib
import hmac
from datetime import date, datetime

from pyspark.sql import functions as F

from pagemill.operators import intake
from pagemill.sources import logs

FIELDS = "id long, t timestamp, type string, ip string, ua string, owner boolean, member boolean, dnt string, gpc string, path string, referrer string, host string, language string, width double, dark boolean, touch boolean"


def request(i, type="pageview", ip="1.1.1.1", ua="Mozilla (X11; Linux) Firefox/1", owner=False, member=False, dnt=None, gpc=None, second=None, **more):
    at = datetime(2026, 5, 10, 12, 0, second if second is not None else i)
    return (i, at, type, ip, ua, owner, member, dnt, gpc, more.get("path", "/about/"), more.get("referrer"), "own.org", "de-AT", more.get("width", 500.0), None, None)


def test_tracked(spark):
    rows = [
        request(1), request(2, owner=True), request(3, ua="curl/8"), request(4, dnt="1"), request(5, gpc="1"), request(6, "extract", dnt="1", member=True), request(7, "extract"), request(8, "extract", ua=None), request(9, ip=None, referrer="https://www.X.org/y"),
        *(request(10 + i, ip="2.2.2.2", second=30) for i in range(4)), request(20, None, owner=None), request(21, ip="3.3.3.3", width=None),
    ]
    salts = spark.createDataFrame([(date(2026, 5, 10), "salt")], "day date, salt string")
    got = {r.id: r for r in intake.tracked(spark.createDataFrame(rows, FIELDS), salts, "id", beacons=2).collect()}
    assert sorted(got) == [1, 6, 7, 9, 10, 11, 20, 21]
    digest = hmac.new(b"salt", b"1.1.1.1|Mozilla (X11; Linux) Firefox/1", hashlib.sha256).hexdigest()[:16]
    assert (got[1].v, got[7].v, got[6].v, got[6].tier, got[1].tier) == (digest, digest, None, "member", "anon")
    assert (got[1].dev, got[1].br, got[1].path, got[1].lang, got[1].vw, got[1].cs, got[1].touch) == ("desktop", "Firefox", "/about", "de", "480-767", "light", False)
    assert (got[7].dev, got[7].path, got[9].ref, got[21].vw) == (None, None, "x.org", None)
    later = intake.tracked(spark.createDataFrame(rows, FIELDS), salts.limit(0), "id")
    assert later.filter("v IS NOT NULL").count() == 0 and later.count() == 10


def test_salts_are_drawn_once_a_day(spark):
    none = spark.createDataFrame([], "day date, salt string")
    first = intake.daily_salt(none, date(2026, 5, 10))
    drawn = first.first().salt
    assert len(drawn) == 64 and intake.daily_salt(first, date(2026, 5, 10)).first().salt == drawn
    again = intake.daily_salt(first, date(2026, 5, 11)).collect()
    assert [r.day for r in again] == [date(2026, 5, 11)] and again[0].salt != drawn


def test_access_requests(spark):
    rows = [(1, 0, "a", "x@y.org", None, "1"), (2, 1, "a", "x@y.org", "spam", "1"), (3, 2, "a", "x@y.org", " ", None), (4, 3, "a", "x@y.org", None, "1"), (5, 4, "b", "no", None, "1"), (6, 5, "b", " X@Y.org", "", "1"), (7, 6, "c", "x@y.org", None, "1"), (8, None, "c", "x@y.org", None, "1"), (9, 86_400_000, "c", "x@y.org", None, "1")]
    got = intake.access_requests(spark.createDataFrame(rows, "id long, at_ms long, ip string, email string, website string, agree string"), "id", cap=2)
    assert {r.id: r.decision for r in got.collect()} == {1: "taken", 2: "pretended", 3: "terms", 4: "limited", 5: "email", 6: "taken", 7: "capped", 8: "taken", 9: "taken"}


def test_a_batch_is_taken_once_and_full_days_take_no_more(spark, tmp_path):
    def events(*days):
        return spark.createDataFrame([(datetime(2026, 5, d, 1), "boot") for d in days], "t timestamp, type string")

    def held():
        return sorted(r.day.day for r in logs.read_events(spark, where, date(2026, 5, 12), 10).collect())

    where = f"file://{tmp_path}/log"
    logs.append_batch(events(9, 10), where, 0)
    logs.append_batch(events(10), where, 1)
    logs.append_batch(events(10), where, 1)
    assert held() == [9, 10, 10]
    logs.append_batch(events(9, 10, 11), where, 2, most_bytes=60)  # the tenth has two files, of over 60 bytes in all
    assert held() == [9, 9, 10, 10, 11]


def test_a_stream_that_starts_again_adds_nothing(spark, tmp_path):
    spark.createDataFrame([(datetime(2026, 5, 9, 1), "boot")], "t timestamp, type string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, type string").parquet(f"{tmp_path}/in")
    where = f"file://{tmp_path}/log"
    for mark in ("a", "b"):  # another checkpoint: batch 0 comes again
        q = logs.append_stream_once(stream, where, f"{tmp_path}/{mark}")
        q.processAllAvailable()
        q.stop()
    assert logs.read_events(spark, where, date(2026, 5, 9), 1).count() == 1
    assert "batch" in spark.read.json(where).columns and spark.read.json(where).agg(F.max("batch")).first()[0] == 0
