from pyspark.sql import functions as F

from quillmesh import plugins
from quillmesh.operators import ledger, lexical, pages, ranking, state, stories, vectors
from quillmesh.sources import readers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_keyed_state(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(state.insert_if_absent(base, spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string"), ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(state.replace_by_key(base, spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string"), "k"), "k", "v") == [(1, "a"), (2, "x"), (2, "y")]
    log = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 1, None)], "k int, t int, v string")
    assert rows(state.last_write_wins(log, ["k"], ["t"]), "k", "v") == [(1, "b"), (2, None)]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, up int")
    assert rows(state.delete_cascade(tree, spark.createDataFrame([(1,)], "id int"), "id", "up"), "id", "up") == [(2, None), (3, 2)]
    feeds = spark.createDataFrame([("u", "Old", False), ("w", None, False)], "url string, label string, active boolean")
    got = state.reactivate(feeds, spark.createDataFrame([("u", " "), ("n", "New")], "url string, label string"), "url", "label", "active")
    assert rows(got, "url", "label", "active") == [("n", "New", True), ("u", "Old", True), ("w", None, False)]
    assert rows(state.bump(spark.createDataFrame([(1, None), (2, 4)], "id int, n int"), spark.createDataFrame([(1,), (1,)], "id int"), "id", "n"), "id", "n") == [(1, 1), (2, 4)]


def test_roots_follow_chains(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 2), (6, None), (7, 6)], "id long, parent long")
    assert rows(stories.roots(p), "id", "root") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6)]


def test_amounts(spark):
    df = spark.createDataFrame([('{"amount_usd": 12.5}',), ('{"amount_usd": "12"}',), ('{"amount_usd": null}',), (None,), ("broken",)], "structured string")
    assert [r.a for r in df.select(stories.amount(F.col("structured")).alias("a")).collect()] == [12.5, None, None, None, None]


def test_run_outcomes_in_order(spark):
    cases = [(0, "", 0, 0, "ok"), (3, "", 0, 0, "failed"), (3, "", 2, 2, "partial"), (3, "", 3, 2, "partial"), (3, "", 3, 3, "ok"), (0, "e", 0, 0, "ok")]
    df = spark.createDataFrame(cases, "n int, e string, s int, m int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", ledger.run_outcome(F.col("n"), F.col("e"), F.col("s"), F.col("m"))).collect())


def test_backlog(spark):
    docs = spark.createDataFrame([(i, t) for i, t in [(1, 0), (2, 0), (3, 2), (4, 3), (5, 0)]], "id long, triage_failures int")
    items = spark.createDataFrame([(2, "fine"), (3, "BAD"), (4, "BAD"), (5, "a"), (5, "b")], "raw_doc_id long, summary string")
    assert rows(ledger.backlog(docs, items, "BAD"), "id") == [(1,), (3,), (5,)]


def test_bands(spark):
    df = spark.createDataFrame([(0.87,), (0.8699,), (0.80,), (0.799,), (None,), (float("nan"),)], "s double")
    assert [r.b for r in df.select(vectors.band(F.col("s")).alias("b")).collect()] == ["merge", "check", "check", "new", "new", "new"]


def test_blocked_search_is_exact(spark):
    import numpy as np

    v = np.random.default_rng(1).standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    got = {r.id: r.older for r in vectors.nearest_older(df, block=7).collect()}
    assert got == {i: int(s[i, :i].argmax()) for i in range(1, 60)}
    near = vectors.nearest(df.where("id < 3").withColumnRenamed("id", "q"), df, 4, block=9)
    assert {q: [r.id for r in sorted(near.collect(), key=lambda r: r["rank"]) if r.q == q] for q in range(3)} == {q: [int(i) for i in np.argsort(-s[q])[:4]] for q in range(3)}


def test_one_edit(spark):
    vocab = spark.createDataFrame([("market", 9), ("markets", 3), ("maker", 5), ("mraket", 1)], "word string, ndoc int")
    asked = spark.createDataFrame([("markte",), ("maket",), ("xyz",)], "word string")
    assert rows(lexical.one_edit(asked, vocab), "word", "cand") == [("maket", "maker"), ("maket", "market"), ("maket", "mraket"), ("markte", "market")]


def test_rerank_moves_only_scored_rows(spark):
    r = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 4)], "id long, place int")
    s = spark.createDataFrame([(11, 0.1), (13, 0.9), (13, 0.2)], "id long, score double")
    assert rows(ranking.rerank_in_place(r, s, "id", "place"), "id", "place") == [(10, 1), (11, 4), (12, 3), (13, 2)]


def test_page_rules():
    text = "Menu\n\n# A headline of the page\n\nSome real text that is long enough. It has two sentences.\n\n## Finance\n## More from us\nOther title\n"
    kept = [x for x, why in pages.judge_lines(text) if not why and x]
    assert kept == ["# A headline of the page", "Some real text that is long enough. It has two sentences."]
    assert pages.clean_page(None) == ""
    assert dict(pages.judge_lines("![a](b)\n[one](/a) [two](/b)\nThe same line again here.\nThe same line again here."))["![a](b)"] == "image"


def test_passages_have_their_size():
    text = "\n".join(f"Line {i} has a few words in it." for i in range(400)) + "\n" + "x" * 6000
    out = pages.pack_lines(text, most=None)
    assert max(map(len, out)) <= 2500 and "".join(out).replace("\n", "") == text.replace("\n", "")
    assert len(pages.pack_lines(text, most=2)) == 2


def test_transcripts():
    md = "# T\nChannel: c\n## Chapters\n[0:00] Start\n## Transcript\n[0:05] hello\n[1:00:02] there"
    assert pages.pack_transcript(md) == [("Chapters:\n[0:00] Start", 0), ("hello there", 5)]
    assert pages.paragraphs([(0, "a"), (29, "b"), (30, "c"), (31, "d")]) == [(0, "a b c"), (31, "d")]


def test_plugins_keep_errors_as_rows(spark):
    def fetcher(u):
        if "bad" in u:
            raise ValueError("no")
        return u.upper()

    urls = spark.createDataFrame([("a",), ("bad",), (None,)], "url string")
    assert rows(plugins.fetch(urls, fetcher), "url", "body", "error") == [("a", "A", None), ("bad", None, "ValueError: no")]
    texts = spark.createDataFrame([(1, "some words"), (2, ""), (3, None)], "id long, text string")
    assert [(i, e) for i, e in rows(plugins.embed(texts, plugins.hashed_embedder(), batch=2), "id", "error")] == [(1, None), (2, "no usable vector"), (3, "no usable vector")]


def test_readers(spark):
    body = '{"web": {"results": [{"url": "https://a.example", "title": "A", "page_age": "2026-01-02T00:00:00"}, {"title": "none"}]}}'
    replies = spark.createDataFrame([(body,), ('{"results": [{"url": "https://b.example"}]}',), ("broken",)], "body string")
    assert rows(readers.search_hits(replies, "s"), "url", "title") == [("https://a.example", "A"), ("https://b.example", None)]
    feed = spark.createDataFrame([("a", "2026-01-02 00:00:00"), ("b", None), ("c", "rubbish"), ("d", "2025-12-01 00:00:00")], "k string, published string")
    assert rows(readers.recent(feed, F.lit("2026-01-03 00:00:00").cast("timestamp")), "k") == [("a",), ("b",)]
    urls = spark.createDataFrame([('["https://A.example/x", "{\\"url\\": \\"https://b.example\\", \\"title\\": \\"T\\"}", "nope"]',)], "urls string")
    assert rows(readers.url_inputs(urls), "canonical", "title") == [("https://a.example/x", None), ("https://b.example/", "T")]
    meta = spark.createDataFrame([(1, "de", {"en": "u1", "de-AT": "u2"}, {}), (2, None, {}, {"en-orig": "u3", "en": "u4"}), (3, "fr", {"es": "u"}, {"es": "u"})], "id int, language string, manual map<string,string>, auto map<string,string>")
    assert rows(readers.caption_choice(meta), "id", "kind", "url") == [(1, "captions-manual", "u2"), (2, "captions-auto", "u3")]


def test_intermediate_tables_can_be_cleaned(spark):
    from quillmesh import session

    session.clean(spark)
    df = session.materialize(spark.range(3), "three")
    assert df.count() == 3 and session.clean(spark) == 1 and session.clean(spark) == 0
