from pyspark.sql import functions as F

from quillmesh.operators import checks, frames, ingest, state
from quillmesh.streaming import feeds


def test_urls_are_taken_once(spark, tmp_path):
    source, seen, checkpoint = (str(tmp_path / x) for x in ("in", "seen", "checkpoint"))
    schema = "rec_id long, url string, source string"
    stream = spark.readStream.schema(schema)
    spark.createDataFrame([(1, "https://a.example/x", "s"), (2, "https://A.example/x/", "s"), (3, None, "s")], schema).coalesce(1).write.parquet(source)
    feeds.ingest_urls(stream.parquet(source), seen, checkpoint).awaitTermination()
    spark.createDataFrame([(4, "https://a.example/x?ref=1", "s"), (5, "https://a.example/y", "s")], schema).coalesce(1).write.mode("append").parquet(source)
    feeds.ingest_urls(stream.parquet(source), seen, checkpoint).awaitTermination()
    assert sorted(r.canonical_url for r in spark.read.parquet(seen).collect()) == ["https://a.example/x", "https://a.example/y"]


def test_snapshots(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))

    def merge(base, batch):
        new = batch.groupBy("k").agg(F.count("*").alias("n"))
        return new if base is None else state.add_counts(base, new, ["k"], "n")

    for keys in (["a", "b", "a"], ["b"], ["c"]):
        spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(source)
        feeds.into_table(spark.readStream.schema("k string").parquet(source), merge, ["k"], path, checkpoint).awaitTermination()
    assert {r.k: r.n for r in feeds.current(spark, path).collect()} == {"a": 2, "b": 2, "c": 1}


def test_repeats_within_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("u", "2026-01-01 00:00:00"), ("u", "2026-01-01 00:01:00"), ("v", "2026-01-01 00:01:00")], "who string, at string").select("who", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(source)
    s = feeds.without_repeats(spark.readStream.schema("who string, at timestamp").parquet(source), ["who"], "at")
    q = s.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_leases_and_notices(spark):
    s = spark.createDataFrame([("job", "a", "2026-01-01 00:00:00"), ("other", "z", "2026-01-01 00:00:00")], "key string, value string, at string").select("key", "value", F.col("at").cast("timestamp").alias("updated_at"))
    holder = lambda df: {r.key: r.value for r in df.collect()}
    assert holder(state.take_lease(s, "job", "b", "2026-01-01 00:10:00")) == {"job": "a", "other": "z"}
    assert holder(state.take_lease(s, "job", "b", "2026-01-01 00:17:00")) == {"job": "b", "other": "z"}
    assert holder(state.take_lease(s, "new", "b", "2026-01-01 00:00:00"))["new"] == "b"
    sent = spark.createDataFrame([("x", "2026-01-01 00:00:00")], "kind string, at string").select("kind", F.col("at").cast("timestamp").alias("last_sent"))
    due = lambda k, t: state.notice_due(sent, k, t).first().due
    assert (due("x", "2026-01-01 05:00:00"), due("x", "2026-01-01 07:00:00"), due("y", "2026-01-01 00:00:00")) == (False, True, True)


def test_first_polls_are_silent(spark):
    fresh = spark.createDataFrame([(1, "old"), (2, "new"), (3, "unknown")], "id int, source string")
    sources = spark.createDataFrame([("old", "2026-01-01 00:00:00"), ("new", None)], "name string, at string").select("name", F.col("at").cast("timestamp").alias("bootstrapped_at"))
    assert {r.id: r.silent for r in ingest.first_polls(fresh, sources).collect()} == {1: False, 2: True, 3: False}


def test_frames(spark):
    rows = [("v", t, [t // 3 * 20] * 4) for t in range(12)] + [("w", t, [t * 50]) for t in range(60)]
    got = frames.sampled(spark.createDataFrame(rows, "video string, t int, pixels array<int>"))
    assert sorted(r.t for r in got.where("video = 'v'").collect()) == [0, 3, 6, 9]
    assert got.where("video = 'w'").count() == 24


def test_headlines_hedge(spark):
    df = spark.createDataFrame([("Confirmed: 400 users", False), ("Verified users rose", True), ("The count is unclear", True), ("It was proven", True)], "h string, thin boolean")
    assert [r.v for r in df.select(checks.hedged(F.col("h"), F.col("thin")).alias("v")).collect()] == ["400 users", "Evidence is thin: reported users rose", "The count is unclear", "Evidence is thin: it was reported"]
    one = spark.range(1)
    assert one.select(checks.wide_spread(F.array(F.lit("100"), F.lit("$110"))).alias("v")).first().v is True
    assert checks.query_templates("chips", "count", "2026-01-01")[0] == "chips number 2026"


def stream_of(spark, tmp_path, name, parts, schema, **casts):
    """A stream with one micro-batch a part."""
    path = str(tmp_path / name)
    for p in parts:
        df = spark.createDataFrame(p, schema)
        for c, t in casts.items():
            df = df.withColumn(c, F.col(c).cast(t))
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_run_ledger(spark, tmp_path):
    parts = [[(1, 1, "started", None, None, None, None), (2, 2, "started", None, None, None, None)], [(1, 3, "finished", 3, 3, 2, None)]]
    s = stream_of(spark, tmp_path, "runs", parts, "id long, at long, kind string, urls_new int, scraped int, made int, error string")
    feeds.run_ledger(s, str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.status for r in feeds.current(spark, str(tmp_path / "ledger")).collect()} == {1: "partial", 2: "running"}


def test_brief_cursors(spark, tmp_path):
    day = lambda d: f"2026-01-{d:02d} 00:00:00"
    parts = [[(7, 1, day(10), False, "", None), (7, 2, day(11), True, "", None)], [(7, 3, day(12), False, "chips", None), (7, 4, day(13), False, "", None), (8, 5, day(13), False, "", 1)]]
    s = stream_of(spark, tmp_path, "asks", parts, "chat_id long, id long, at string, more boolean, topic string, days int", at="timestamp")
    q = feeds.brief_cursors(s).writeStream.format("memory").queryName("cursors").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: (r.d, r.page) for r in spark.table("cursors").select("id", "page", F.date_format(F.timestamp_seconds("since"), "d").alias("d")).collect()}
    assert got == {1: ("3", 0), 2: ("3", 1), 3: ("10", 0), 4: ("10", 0), 5: ("12", 0)}


def test_drain_yields_to_a_live_run(spark, tmp_path):
    s = stream_of(spark, tmp_path, "ticks", [[(1,)], [(2,)]], "t long")
    done, busy = [], iter([True, False])
    feeds.drain(s, lambda sp: sp.range(5, 40).toDF("id"), lambda sp: next(busy), lambda df: done.append([r.id for r in df.collect()]), str(tmp_path / "cp")).awaitTermination()
    assert done == [list(range(5, 17))]


def test_stories_in_order(spark, tmp_path):
    a, b, near_a = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [1.0, 0.05, 0.1]
    parts = [[(1, a), (2, b), (3, near_a)], [(4, near_a), (5, b), (6, [0.0, 0.0, 1.0])], [(7, [0.0, 0.05, 1.0])]]
    s = stream_of(spark, tmp_path, "items", parts, "id long, v array<double>")
    feeds.assign_stories(s, str(tmp_path / "stories"), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.root for r in spark.read.parquet(str(tmp_path / "stories")).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 6, 7: 6}


def test_recency_holds_in_a_stream(spark, tmp_path):
    from quillmesh.sources import readers

    s = stream_of(spark, tmp_path, "entries", [[("a", "Mon, 05 Jan 2026 10:00:00 GMT"), ("b", "1 Jan 2026 10:00 +0000"), ("c", None), ("d", "soon")]], "url string, published string")
    q = readers.recent(s, F.lit("2026-01-06 00:00:00").cast("timestamp")).writeStream.format("memory").queryName("fresh_entries").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("fresh_entries").collect()) == ["a", "c"]
