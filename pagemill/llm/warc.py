"""WARC archives of pages: write, read back, and merge their indexes.

Writing: every page becomes one WARC/1.1 record.  Of records with equal
payloads the one with the smallest page id is a response, the others are
revisits that refer to it and carry no payload.  Each task sorts its records
by URL key and time and writes them with Spark's text writer, whose line
separator is the record terminator (two CRLF); so the archives are ordinary
uncompressed WARC files on any file system that Spark writes to.

Reading: archives are read whole (their size is bounded)
and cut by Content-Length, never by searching for a separator, so a payload
may hold anything.  Digests of stored payloads are recomputed and compared.

Index: each archive gives an index run that is sorted already.  The key space
is cut into ranges; within a range the runs' slices are merged by a loser tree
on (URL key, time, page id).  Ranges follow one another, so (range, position)
is the global order of all captures.  A range holds bounded index rows, never
payloads; one hot URL is cut across ranges by time and page id.

Defined results: a null payload is empty, and empty payloads are equal like
others; a null url has the empty URL key; a null page id sorts last and is
written as "-"; repeated rows are separate records, of which one is the
response; empty tables give no rows; payloads of any length are kept whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh_path, stored

END = "\r\n\r\n"
BROADCAST_ROWS = 100_000
#: The pages bear no time: page n counts as captured n seconds after this one (2024-01-01T00:00:00Z).
FIRST_CAPTURE = 1_704_067_200


class LoserTree:
    """Merges sorted runs: each step costs one comparison per level of the tree.

    A run is an iterator of comparable items; internal nodes keep the loser of
    the match played there, node 0 the overall winner.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, player: int) -> None:
        node = (player + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = player
                return
            if self._beats(other, player):
                self.tree[node], player = player, other
            node //= 2
        self.tree[0] = player

    def __iter__(self) -> Iterator:
        while True:
            winner = self.tree[0]
            item = self.head[winner]
            if item is None:
                return
            yield item
            self.head[winner] = next(self.runs[winner], None)
            self._replay(winner)


def url_key(url: Column) -> Column:
    """Sort-friendly key of a URL: host parts reversed by comma, then ")" and the lower-cased path; scheme, www., port and fragment go."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@|:[0-9]*$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1), r"^$", "/")
    return F.when(rest == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: every five hex digits are four base32 digits, in the digits of conv() first."""
    digits = F.sha1(payload.cast("binary"))
    fives = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*fives)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _base32_sha1(value: bytes) -> str:
    return base64.b32encode(hashlib.sha1(value).digest()).decode()


def revisits(digests: DataFrame, least_bytes: int) -> DataFrame:
    """(payload_digest, page_id, refers_to, is_first): the pages whose payload another row has as well."""
    big = F.lit(2**63 - 1)
    rows = digests.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    # Counts per (digest, page) first: a payload that fills most of the table arrives pre-aggregated.
    first = rows.groupBy("payload_digest").agg(F.min(F.coalesce("page_id", big)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = rows.groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("copies"))
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int"))
    joined = dealt.join(salted, ["payload_digest", "salt"])
    is_first = F.coalesce("page_id", big) == F.col("first")
    return joined.filter(~is_first | (F.col("copies") > 1)).select("payload_digest", "page_id", F.nullif(F.col("first"), big).alias("refers_to"), is_first.alias("is_first"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 1 << 26, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write one WARC record per row of pages under path, in files of about file_bytes at most or of one record.

    Records are written by classes of size, each class with so many records a file.  Line breaks in a URL are left out,
    before its key is made.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.regexp_replace(url, r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", payload_digest(F.col("payload")))
    again = stored(revisits(rows.select("page_id", "payload_digest", F.octet_length("payload").alias("payload_bytes")), least_bytes), "warc-revisits")
    few = again.count() <= BROADCAST_ROWS
    a = (F.broadcast(again) if few else again).alias("a")
    r = rows.alias("r")
    rows = r.join(a, F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.payload_digest") == F.col("a.payload_digest")), "left").select(
        "r.*", F.col("a.refers_to"), F.col("a.is_first"), F.col("a.payload_digest").isNotNull().alias("repeats")
    )
    tie = F.coalesce("is_first", F.lit(False))
    if again.filter("is_first").isEmpty():
        rows = rows.withColumn("revisit", F.col("repeats"))
    else:  # rows repeated with the same page id: one of them is the response
        own = Window.partitionBy("page_id", "payload_digest").orderBy("url")
        tied = rows.filter(tie).withColumn("revisit", F.row_number().over(own) > 1)
        rows = rows.filter(~tie).withColumn("revisit", F.col("repeats")).unionByName(tied)
    when = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    line = F.coalesce("url", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"), ident, F.lit(">\r\nWARC-Target-URI: "), line,
        F.lit("\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(
            F.col("revisit"),
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"),
                F.coalesce(F.col("refers_to").cast("string"), F.lit("-")),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    runs = rows.select(url_key(F.col("url")).alias("url_key"), when.alias("at"), "page_id", F.octet_length("payload").alias("bytes"), F.concat(head, block).alias("value"))
    most = pages.agg(F.max(F.octet_length(F.col(payload).cast("string")))).first()[0] or 0
    low = -1
    while low < most or low < 0:
        high = max(1 << 16, 16 * low)
        some = runs if low < 0 and most <= high else runs.filter((F.col("bytes") > low) & (F.col("bytes") <= high))
        sorted_runs = some.sortWithinPartitions("url_key", "at", F.col("page_id").asc_nulls_last()).select("value")
        sorted_runs.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, file_bytes // high)).text(path)
        low = high


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, in file order; raises on a broken archive or a payload that differs from its digest."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, size = cut + 4, int(head["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has no end")
        body = data.index(b"\r\n\r\n", start, start + size) + 4
        declared = int(data[start:body].rpartition(b"Content-Length: ")[2])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response":
            payload = data[body : start + size]
            if len(payload) != declared or _base32_sha1(payload) != digest:
                raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
        yield {
            "page_id": _ident(head["warc-record-id"]),
            "url": head["warc-target-uri"],
            "at": head["warc-date"],
            "payload_bytes": declared,
            "payload_digest": digest,
            "record_type": head["warc-type"],
            "refers_to": _ident(head.get("warc-refers-to", "-")),
            "warc_offset": at,
            "payload_start": body,
            "payload_end": start + size,
        }
        at = start + size + 4


def _ident(value: str) -> int | None:
    name = value.rstrip(">").rpartition(":")[2]
    return None if name == "-" else int(name)


_INDEX = {
    "page_id": pa.int64(),
    "url": pa.string(),
    "at": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "warc_offset": pa.int64(),
}
_INDEX_SCHEMA = "page_id long, url string, at string, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_offset long, run string, nth long"


def read_index(spark, path: str, payloads: bool = False) -> DataFrame:
    """Index rows of all archives under path; run and nth tell the archive and the record's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                data = content.as_buffer().to_pybytes()
                found = list(parse_archive(data))
                columns = [pa.array([x[c] for x in found], t) for c, t in _INDEX.items()]
                columns += [pa.array([name.rpartition("/")[2]] * len(found), pa.string()), pa.array(range(len(found)), pa.int64())]
                names = [*_INDEX, "run", "nth"]
                if payloads:
                    columns.append(pa.array([data[x["payload_start"] : x["payload_end"]] if x["record_type"] == "response" else None for x in found], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _INDEX_SCHEMA + (", payload binary" if payloads else ""))


def merge_runs(index: DataFrame, ranges: int | None = None, rows_per_range: int = 100_000) -> DataFrame:
    """index in global order of (url_key, at, page_id): with columns url_key, merge_range and merge_pos.

    index is read twice and counted, so it should be stored.  There are as many ranges as its rows ask for.
    """
    spark = index.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // rows_per_range))
    rows = index.withColumn("url_key", url_key(F.col("url")))
    names = rows.columns
    spots = [names.index(c) for c in ("url_key", "at", "page_id", "run")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        got = list(batches)
        if not got:
            return
        whole = pa.Table.from_batches(got)
        keys, at, pages, runs = (whole.column(i).to_pylist() for i in spots)
        cuts = [0, *[i for i in range(1, len(runs)) if runs[i] != runs[i - 1]], len(runs)]

        def slice_of(lo: int, hi: int) -> Iterator[tuple]:
            for i in range(lo, hi):
                p = pages[i]
                yield (keys[i], at[i], p is None, p or 0, i)

        order = np.fromiter((x[-1] for x in LoserTree([slice_of(a, z) for a, z in zip(cuts, cuts[1:], strict=False)])), np.int64, len(runs))
        merged = whole.take(pa.array(order)).combine_chunks()
        part, done = pyspark.TaskContext.get().partitionId(), 0
        for b in merged.to_batches(max_chunksize=10_000):
            n = b.num_rows
            place = [pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(done, done + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *place], names=[*names, "merge_range", "merge_pos"])
            done += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", merge_range long, merge_pos long"
    dealt = rows.repartitionByRange(ranges, "url_key", "at", "page_id").sortWithinPartitions("run", "nth")
    return dealt.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as WARC archives, read them back, and return the merged index."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return merge_runs(stored(read_index(pages.sparkSession, path), "warc-index"))
