"""Access as keyed state against a plain store of lists, in a batch and over a stream."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import access, admission
from pagemill.streaming import access as doors

DAY = admission.DAY_MS
SCHEMA = "email string, at_ms long, seq long, action string, detail string, version string"
WAYS = ["ask", "decline", "approve", "invite", "redeem", "redeem", "redeem", "accept", "touch", "extract", "sign_out", "remove", "dance", None]


class Store:
    """Lists of members, invitations and requests, searched from end to end, as one process would keep them."""

    def __init__(self):
        self.members, self.invites, self.requests, self.fails, self.touched = [], [], [], {}, {}

    def member(self, email):
        return next((m for m in self.members if m["email"] == email), None)

    def invite(self, email, at, code, by):
        m = self.member(email)
        if m and m["status"] == "active":
            return "is-active"
        if not m:
            self.members.append({"email": email, "status": "invited", "by": by, "epoch": 0, "extractions": 0, "seen": None, "terms": None})
        self.invites = [i for i in self.invites if i["email"] != email] + [{"email": email, "code": code, "until": at + 14 * DAY, "used": False}]
        return "invited"

    def redeem(self, email, at, code, version):
        count, last, locked = self.fails.get(email, (0, 0, 0))
        if locked > at:
            return "locked"
        m = self.member(email)
        for i in self.invites:
            if m and i["email"] == email and not i["used"] and i["until"] > at and code is not None and i["code"] == code:
                i["used"] = True
                m.update(status="active", terms=version)
                self.fails.pop(email, None)
                return "ok"
        count = (0 if at - last >= 30 * DAY else count) + 1
        self.fails[email] = (0, at, at + 900_000) if count == 5 else (count, at, 0)
        return "invalid"

    def act(self, email, at, action, detail, version):
        self.requests = [r for r in self.requests if not (r["status"] == "pending" and at - r["at"] >= 180 * DAY)]
        mine, m = [r for r in self.requests if r["email"] == email], self.member(email)
        waiting = [r for r in mine if r["status"] == "pending"]
        if action == "ask":
            if waiting or any(r["at"] > at - 7 * DAY for r in mine):
                return "ignored"
            self.requests.append({"email": email, "at": at, "status": "pending"})
            return "taken"
        if action in ("decline", "approve"):
            if not waiting:
                return "not-found"
            said = "declined" if action == "decline" else self.invite(email, at, detail, "request")
            waiting[0]["status"] = "decided"
            return "approved" if said == "invited" else said
        if action == "invite":
            return self.invite(email, at, detail, "owner")
        if action == "redeem":
            return self.redeem(email, at, detail, version)
        if action == "touch":
            if at - self.touched.get(email, -DAY * 9999) < 3_600_000:
                return "recent"
            self.touched[email] = at
            if m:
                m["seen"] = at
            return "seen" if m else "unknown"
        if action == "remove":
            for name in ("members", "invites", "requests"):
                setattr(self, name, [x for x in getattr(self, name) if x["email"] != email])
            return "removed" if m else "not-found"
        if action not in ("accept", "extract", "sign_out"):
            return "no-action"
        if not m:
            return "unknown"
        if action == "accept":
            m["terms"] = detail
            return "accepted"
        if action == "extract":
            m["extractions"] += 1
            m["seen"] = at
            return "counted"
        m["epoch"] += 1
        return "signed-out"

    def told(self, email):
        m = self.member(email) or {"status": None, "epoch": 0, "extractions": 0, "seen": None, "terms": None}
        pending = any(r["email"] == email and r["status"] == "pending" for r in self.requests)
        return (m["status"], m["epoch"], m["extractions"], pending, m["seen"], m["terms"])


def _log(n, seed, gaps):
    r, at, out = random.Random(seed), 10**12, []
    for i in range(n):
        at += r.choice(gaps)
        out.append((f"p{r.choice('aaaaaabcdefg')}", at, i, r.choice(WAYS), r.choice(["c0", "c1", "c0", None]), r.choice(["v1", "v2", None])))
    return out


def _plain(log):
    store, out = Store(), {}
    for email, at, seq, action, detail, version in sorted(log, key=lambda x: x[1:3]):
        out[seq] = (store.act(email, at, action, detail, version), *store.told(email))
    return out


def _rows(rows):
    return {r.seq: (r.result, *(r[n] for n in access.TOLD)) for r in rows}


@pytest.mark.parametrize("gaps", [(0, 0, 1, 60_000), (0, 3_600_000, DAY), (DAY, 9 * DAY, 40 * DAY)])
def test_batch_equals_a_plain_store(spark, gaps):
    log = _log(900, 7, gaps)
    got = _rows(access.acted(spark.createDataFrame(log, SCHEMA).repartition(5), "seq").collect())
    assert got == _plain(log)
    assert len({v[0] for v in got.values()}) >= 12


def test_refused_and_empty(spark):
    odd = [(None, 5, 1, "ask", None, None), ("a", None, 2, "invite", "c", None), ("a", 7, 3, "ask", None, None), ("a", 7, 3, "ask", None, None)]
    df = spark.createDataFrame(odd, SCHEMA).withColumn("result", F.lit(1)).withColumn("status", F.lit("x"))
    got = sorted((r.seq, r.result, r.pending) for r in access.acted(df, "seq").collect())
    assert got == [(1, "no-email", None), (2, "no-time", None), (3, "ignored", True), (3, "taken", True)]
    assert access.acted(spark.createDataFrame([], SCHEMA), "seq").count() == 0


def test_standings(spark):
    log = [("a", 1, 1, "invite", "c", None), ("a", 2, 2, "redeem", "c", "v"), ("a", 3, 3, "extract", None, None), ("b", 1, 4, "invite", "c", None), ("b", 2, 5, "remove", None, None), ("b", 3, 6, "ask", None, None), ("c", 1, 7, "ask", None, None)]
    done = access.acted(spark.createDataFrame(log, SCHEMA), "seq")
    (r,) = access.standings(done, "seq").collect()
    assert (r.email, r.status, r.extractions, r.terms, r.seen_ms) == ("a", "active", 1, "v", 3)
    may = done.select(access.can_sign_in(F.col("email"), F.col("status"), "c").alias("m"), "seq").collect()
    assert {r.seq for r in may if r.m} == {2, 3, 7}


def _stream(spark, path, files, name, late_ms):
    store = "spark.sql.streaming.stateStore.providerClass"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")
        (made,) = (path / str(n)).glob("part-*")
        made.rename(path / f"{n}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*.parquet")
    before = spark.conf.get(store)
    with pytest.raises(ValueError):
        doors.acted(stream)
    spark.conf.set(store, doors.STORE)
    try:
        q = doors.acted(stream, late_ms=late_ms).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240), "the stream does not end"
        q.stop()
        return spark.table(name).collect()
    finally:
        spark.conf.set(store, before)


def test_stream_decides_as_the_batch(spark, tmp_path):
    # Files hold actions out of order within the bound; the last file only moves the watermark on.  Persons that nobody
    # invited are forgotten on the way, which changes nothing.
    log = _log(240, 3, (0, 60_000, 3_600_000, 12 * DAY))
    mixed = sorted(log, key=lambda x: (x[1] + random.Random(x[2]).choice((0, DAY)), x[2]))
    files = [mixed[i : i + 80] for i in range(0, 240, 80)]
    files.append([("end", log[-1][1] + 400 * DAY, 9999, "ask", None, None)])
    got = _rows(_stream(spark, tmp_path, files, "doors", 2 * DAY))
    assert got == _plain(log)


def test_stream_leaves_out_what_comes_too_late(spark, tmp_path):
    first, second = 10**12, 10**12 + 10 * DAY
    files = [[("a", second, 1, "ask", None, None)], [("z", second + 1, 2, "ask", None, None)], [("a", first, 3, "invite", "c", None), ("z", second + 20 * DAY, 4, "ask", None, None)], [("z", second + 60 * DAY, 5, "touch", None, None)]]
    got = _rows(_stream(spark, tmp_path, files, "late", DAY))
    assert {s: v[0] for s, v in got.items()} == {1: "taken", 2: "taken", 4: "ignored"}


def test_addresses_and_codes(spark):
    given = ["  Ann@Example.org\t", "a@b.c", "a@b.co", "a b@c.de", "a@b,c.de", "x" * 249 + "@b.co", "x" * 250 + "@b.co", None, "a@b.co\n", "a@b@c.de"]
    got = [r.e for r in spark.createDataFrame([(g,) for g in given], "g string").select(admission.normal_email(F.col("g")).alias("e")).collect()]
    assert got == ["ann@example.org", None, "a@b.co", None, None, "x" * 249 + "@b.co", None, None, "a@b.co", None]
    codes = ["abcde-fghjk", " ABCDE FGHJK ", "ABCDE.FGHJK", "ABCDEFGHJ", "ABCDEFGHJ0", None]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select(admission.normal_code(F.col("c")).alias("n"), admission.code_well_formed(F.col("c")).alias("w"), admission.shown_code(admission.normal_code(F.col("c"))).alias("s")).collect()
    assert [r.n for r in rows] == ["ABCDEFGHJK"] * 3 + [None] * 3
    assert [r.w for r in rows] == [True] * 3 + [False] * 3
    assert rows[0].s == "ABCDE-FGHJK"
