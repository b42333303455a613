import pytest
from pyspark.sql import functions as F

from quillmesh.operators import ingest
from quillmesh.sources import readers


def test_feeds_as_xml(spark):
    rss = "<rss version='2.0'><channel><title>x</title><item><title>One</title><link>https://a.example/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><title>No link</title></item></channel></rss>"
    atom = "<feed><entry><title>Two</title><link href='https://b.example/2'/><updated>2026-01-05T10:00:00Z</updated></entry></feed>"
    df = spark.createDataFrame([("r", rss), ("a", atom), ("x", "no xml"), ("n", None)], "source string, body string")
    rows = readers.feed_entries(df).withColumn("at", readers.read_date(F.col("published")))
    assert sorted((r.source, r.url, r.title) for r in rows.collect()) == [("a", "https://b.example/2", "Two"), ("r", "https://a.example/1", "One")]
    assert rows.where("at = timestamp'2026-01-05 10:00:00'").count() == 2


def test_searches_and_their_errors(spark):
    def fetcher(url):
        if "down" in url:
            raise OSError("no route")
        return '{"web": {"results": [{"url": "https://a.example/x", "title": "A", "page_age": "2026-01-02T00:00:00"}, {"title": "no url"}]}}' if "ok" in url else "<html>"

    q = spark.createDataFrame([("https://s.example/ok",), ("https://s.example/down",), ("https://s.example/html",)], "url string")
    hits, errors = readers.searched(q, fetcher, "brave", strict=False)
    assert [(r.url, r.source) for r in hits.collect()] == [("https://a.example/x", "brave")]
    assert sorted(r.error for r in errors.collect()) == ["OSError: no route", "no JSON"]
    with pytest.raises(Exception, match="brave"):
        readers.searched(q, fetcher, "brave")[0].collect()
    with pytest.raises(ValueError):
        readers.searched(q, fetcher, "nowhere")


def test_url_inputs(spark):
    df = spark.createDataFrame([('["https://a.example/1", {"url": "https://A.example/2", "title": "T", "slides": true, "markdown": "m", "scraper": "upload:pdf", "published_at": "2026-01-01"}, "rubbish", {"title": "none"}]',), ("broken",), (None,)], "urls string")
    got = sorted((r.canonical, r.title, r.slides, r.transcribe, r.markdown, r.scraper, r.published_at is not None) for r in readers.url_inputs(df).collect())
    assert got == [("https://a.example/1", None, False, False, None, None, False), ("https://a.example/2", "T", True, False, "m", "upload:pdf", True)]


def test_uploads(spark, tmp_path):
    (tmp_path / "a_long_file_name.pdf").write_bytes(b"words and lines of it " * 30)
    (tmp_path / "scan.pdf").write_bytes(b" ")
    (tmp_path / "bad.pdf").write_bytes(b"!")
    (tmp_path / "note.txt").write_bytes(b"x")

    def extract(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode()

    rows = {r.title: r for r in readers.uploads(spark, str(tmp_path), extract).collect()}
    assert set(rows) == {"a long file name", "scan", "bad"} and rows["scan"].refused == rows["bad"].refused == "no text"
    assert rows["a long file name"].refused is None and rows["scan"].canonical.startswith("upload://")


def test_transcripts(spark):
    asked = spark.createDataFrame([("a", 60, True), ("b", 60, False), ("c", 4 * 3600, False), ("d", 3000, True), ("e", None, None)], "id string, seconds int, slides boolean")
    cache = spark.createDataFrame([("a", "kept")], "id string, text string")
    got = {r.id: (r.text, r.slides, r.note, r.cached) for r in readers.transcripts(asked, cache, lambda u: f"said {u}").collect()}
    assert got == {"a": ("kept", True, None, True), "b": ("said b", False, None, False), "c": (None, False, "too long", False), "d": ("said d", False, "slides skipped", False), "e": ("said e", False, None, False)}


def test_pdfs_skip_the_first_scraper(spark):
    df = spark.createDataFrame([("https://a.example/x.pdf?y=1", "f" * 500, "b" * 300), ("https://a.example/x", "f" * 500, "b" * 300), (None, "f" * 500, None)], "url string, fit string, back string")
    got = [r.t[0] for r in df.select(ingest.page_text(F.col("fit"), F.col("fit"), F.col("back"), url=F.col("url")).alias("t")).collect()]
    assert got == ["b", "f", "f"]
