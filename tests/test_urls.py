import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions.urls import canon, host_of, video_id
from quillmesh.operators.ingest import dedupe_batch, match_feeds, page_text

CASES = [
    ("https://Site.Example/a//b/?utm_source=x&id=2#top", "https://site.example/a/b?id=2"),
    ("HTTP://amp.news.example:80/amp/x/", "http://news.example/x"),
    ("https://news.example:443/x", "https://news.example/x"),
    ("https://news.example:8443/x", "https://news.example:8443/x"),
    ("https://news.example", "https://news.example/"),
    ("https://news.example/amp", "https://news.example/"),
    ("https://u:p@News.example/x?SRC=a&b=1&ref", "https://u:p@news.example/x?b=1"),
    ("https://www.news.example/?b=2&a=1", "https://www.news.example/?b=2&a=1"),
    ("  https://news.example/x  ", "https://news.example/x"),
    ("youtube.com/shorts/abcDEF12_-9?t=3", "https://www.youtube.com/watch?v=abcDEF12_-9"),
    ("https://youtu.be/abcDEF12_-9", "https://www.youtube.com/watch?v=abcDEF12_-9"),
    ("https://www.youtube.com/watch?v=short", "https://www.youtube.com/watch?v=short"),
    ("https://news.example/a/b.html", "https://news.example/a/b.html"),
    ("https://news.example/ampere/amp/x", "https://news.example/ampere/x"),
    ("https://news.example/a/amp", "https://news.example/a"),
    ("https://amp.news.example/a", "https://news.example/a"),
    ("https://m.youtube.com/live/abcDEF12_-9", "https://www.youtube.com/watch?v=abcDEF12_-9"),
    ("no url", None),
    ("", None),
    (None, None),
]


def one(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, url string")
    return [r.c for r in rows.select("i", column(F.col("url")).alias("c")).orderBy("i").collect()]


def test_canonical_forms(spark):
    assert one(spark, canon, [u for u, _ in CASES]) == [c for _, c in CASES]


def test_hosts_and_videos(spark):
    assert one(spark, host_of, ["https://WWW.A.example:80/x", "ftp://u@b.example", "x", None]) == ["a.example", "b.example", "", ""]
    assert one(spark, video_id, ["https://m.youtube.com/watch?x=1&v=abcDEF12_-9&y", "https://a.example"]) == ["abcDEF12_-9", None]
    shapes = ["youtube.com/live/{}?t=1", "https://music.youtube.com/embed/{}", "HTTPS://WWW.YOUTUBE.COM/V/{}", "youtu.be/{}#x", "http://youtube.com/watch?v={}#t", "youtube.com/watch?v=bad&v={}&list=2"]
    assert one(spark, video_id, [s.format("abcDEF12_-9") for s in shapes]) == ["abcDEF12_-9"] * len(shapes)
    assert one(spark, video_id, ["youtube.com.evil.example/v/abcDEF12_-9", "https://youtube.com:443/v/abcDEF12_-9", "youtu.be/abcDEF12_-9x", "youtube.com/watch#v=abcDEF12_-9", None]) == [None] * 5


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http", "HTTPS"]), st.sampled_from(["A.example", "amp.b.example:443"]), st.text("ab/?&=#u_", max_size=12)), min_size=20, max_size=40))
def test_canonical_form_is_its_own(spark, parts):
    urls = [f"{s}://{h}/{p}" for s, h, p in parts]
    once = one(spark, canon, urls)
    assert one(spark, canon, once) == once


def test_batch_against_history(spark):
    batch = spark.createDataFrame([(1, "https://a.example/x?utm_x=1"), (2, "https://A.example/x/"), (3, "https://a.example/y"), (4, None)], "rec_id long, url string")
    seen = spark.createDataFrame([("https://a.example//y",)], "canonical_url string")
    assert [(r.rec_id, r.canonical) for r in dedupe_batch(batch, seen).collect()] == [(1, "https://a.example/x")]


def test_feeds_by_site(spark):
    hosts = spark.createDataFrame([("news.a.example", 1), ("a.example", 2), ("evila.example", 3)], "host string, n int")
    feeds = spark.createDataFrame([(1, "https://a.example/f", False), (2, "https://www.a.example/g", True), (3, "https://x.news.a.example", True)], "id long, url string, active boolean")
    assert {r.host: r.feed_id for r in match_feeds(hosts, feeds).collect()} == {"news.a.example": 2, "a.example": 2}


@pytest.mark.parametrize(("fit", "raw", "fallback", "want"), [("f" * 400, "r", "", "f" * 400), ("f", "r" * 500, "", "r" * 500), ("f", "r", "b" * 200, "b" * 200), ("f", "r", "b", None)])
def test_page_text(spark, fit, raw, fallback, want):
    df = spark.createDataFrame([(fit, raw, fallback)], "a string, b string, c string")
    assert df.select(page_text(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want
