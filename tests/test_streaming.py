from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.streaming import usage


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60), "the stream does not end"
    finally:
        q.stop()
    return spark.table(name).collect()


def _limited(spark, path, files, name, most, window_ms, late_ms=60_000):
    schema = "key string, request_id long, at_ms long"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n}")
        (made,) = [x for x in (path / str(n)).glob("part-*")]
        made.rename(path / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*.parquet")
    return {(r.key, r.request_id): (r.hits, r.allowed) for r in _run(spark, usage.rate_limited(stream, most, window_ms, late_ms), name, "append")}


def test_limiter_with_state(spark, tmp_path):
    rows = [("a", i, 1_000_000 + i * 10) for i in range(6)] + [("b", 9, 1_000_005)]  # the first watermark is the epoch itself
    got = _limited(spark, tmp_path, [rows], "limited", 2, 30)
    assert got == {("a", i): (min(i + 1, 3), i < 2) for i in range(6)} | {("b", 9): (1, True)}


def test_limiter_over_files(spark, tmp_path):
    # Hits are carried from file to file, a request that comes late but within the bound counts where it belongs, one
    # beyond it is left out, and a key that pauses for longer than its window starts anew.
    first = [("a", 1, 1_000_000), ("a", 2, 1_000_500), ("a", 2, 1_000_500), ("p", 50, 1_000_000)]
    second = [("a", 3, 1_000_900), ("a", 4, 1_000_200), ("q", 60, 1_200_000)]
    third = [("p", 51, 1_000_500), ("p", 52, 1_250_000), ("a", 5, 1_199_000)]
    got = _limited(spark, tmp_path, [first, second, third], "over_files", 3, 1_000)
    assert got == {("a", 1): (1, True), ("a", 2): (3, True), ("p", 50): (1, True), ("a", 3): (5, False), ("a", 4): (2, True), ("q", 60): (1, True), ("p", 52): (1, True), ("a", 5): (1, True)}


def test_daily_and_sessions(spark, tmp_path):
    start = datetime(2026, 5, 1)
    rows = spark.createDataFrame([(start + timedelta(minutes=m), "pageview", "v", None) for m in (0, 10, 100)] + [(start, "pageview", "x", "bot")], "t timestamp, type string, v string, dev string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    (day,) = _run(spark, usage.daily_counts(stream), "daily", "complete")
    assert (day.n, day.visitors) == (3, 1)
    made = _run(spark, usage.sessions(stream.filter(F.col("dev").isNull())), "sessions", "complete")
    assert sorted(r.n for r in made) == [1, 2]
