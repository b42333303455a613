import pytest
from pyspark.sql import functions as F

from quillmesh.functions import messages as m


def run(spark, column, cases, *names):
    """The column over cases (message, *more), as plain values."""
    rows = [(i, *c) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(names)).select("i", column.alias("c")).orderBy("i")
    return [r.c.asDict() if hasattr(r.c, "asDict") else r.c for r in df.collect()]


C = F.col


def test_deep(spark):
    cases = [("please do a deep search on grid batteries, in Spain", "x"), ("what is new in fusion? deep research please", None), ("deep dive on that", "who owns the port of Sorre"), ("the deep sea search", None), (None, None), ("Deep-Research: chip tariffs", None)]
    got = run(spark, m.deep_ask(C("t"), C("l")), cases, "t string", "l string")
    assert [g["go"] for g in got] == [True, True, True, False, False, True]
    assert [g["question"] for g in got] == ["grid batteries, in Spain", "what is new in fusion?", "who owns the port of Sorre", "", "", "chip tariffs"]


def test_sweep(spark):
    offer = "Run a full sweep on chip tariffs? It hits exa and more."
    cases = [("yes please", offer), ("nope", offer), ("what?", offer), ("yes", "no offer"), ("go ahead", "Run a full sweep on the default beat? It hits exa."), ("yes " + "x" * 70, offer)]
    got = [(g["sweep"], g["topic"]) for g in run(spark, m.sweep_decision(C("t"), C("l")), cases, "t string", "l string")]
    assert got == [("go", "chip tariffs"), ("no", "chip tariffs"), ("", ""), ("", ""), ("go", ""), ("", "")]


def test_save(spark):
    texts = ["save #3", "please keep the second one", "bookmark the last story!", "clip 1, 2 & 5 for later", "save items 2-4 to obsidian", "save 1 to 40", "save it", "save the whales", "save 7 and 7", "hello", None, "save 5-2"]
    got = run(spark, m.save_ask(C("t")), [(t,) for t in texts], "t string")
    assert [g["numbers"] for g in got] == [[3], [2], [-1], [1, 2, 5], [2, 3, 4], list(range(1, 11)), [], [], [7], [], [], []]
    assert [g["it"] for g in got] == [t == "save it" for t in texts]
    assert [g["go"] for g in got] == [True] * 7 + [False, True, False, False, False]
    at = run(spark, m.save_positions(m.save_ask(C("t")), C("n")), [("save the last one", 4), ("save it", 1), ("save it", 2), ("save 2, 9", 4)], "t string", "n int")
    assert [(g["numbers"], g["bad"]) for g in at] == [([4], []), ([1], []), ([], []), ([2], [9])]


def test_more(spark):
    cases = [("more", "brief", None, 0), ("show me more!", "", '{"tag": "x"}', 3), ("next five", "", "{}", 0), ("more", None, "broken", 5), ("more news", "brief", "{}", 3)]
    assert run(spark, m.more_route(C("t"), C("k"), C("q"), C("n")), cases, "t string", "k string", "q string", "n int") == ["brief", "feed", "none", "none", ""]


def test_brief(spark):
    cases = [("brief me", ""), ("Give me a recap on chip tariffs this week, please", ""), ("what did i miss yesterday?", ""), ("catch me up about grid storage last 3 days", ""), ("briefly explain it", ""), ("recap the talk", ""), ("more", "brief-topic"), ("more", "feed"), (None, None)]
    got = run(spark, m.brief_ask(C("t"), C("k")), cases, "t string", "k string")
    assert [g["go"] for g in got] == [True, True, True, True, False, False, True, False, False]
    assert [(g["topic"], g["days"]) for g in got][:4] == [("", None), ("chip tariffs", 7), ("", 2), ("grid storage", 3)]
    assert got[6]["more"] and not got[0]["more"]


def test_referent(spark):
    texts = ["summarize it", "what does that say about prices", "the video about turbines", "open that article", "the article's author", "shorter please", "shorter history of rome", "https://x.example the video", "is it any good?", "", None]
    assert run(spark, m.referent_kind(C("t")), [(t,) for t in texts], "t string") == ["bare", "bare", "described", "bare", "", "bare", "", "", "bare", "", ""]
    tube, page = "https://www.youtube.com/watch?v=abcDEF12_-9", "https://a.example/x"
    cases = [("summarize it", [page], 5.0), ("summarize that video", [page, tube], 5.0), ("summarize that video", [tube, tube], 5.0), ("summarize it", [page], 121.0), ("hello", [page], 5.0), ("summarize it", None, 5.0), ("the video about x", [page], 5.0)]
    got = run(spark, m.referent_route(C("t"), C("u"), C("a")), cases, "t string", "u array<string>", "a double")
    assert [(g["route"], g["n"]) for g in got] == [("item", 1), ("item", 2), ("agent", None), ("", None), ("", None), ("", None), ("agent", None)]


def test_search(spark):
    cases = [("search for grid batteries", ""), ("don't search for it", ""), ("your last search was good", ""), ("did you search it? then look it up", ""), ("yes", "Shall I search the web for it?"), ("yes", "Fine."), ("find me a source", None), (None, None)]
    got = run(spark, m.search_gate(C("t"), C("l")), cases, "t string", "l string")
    assert [g["verb"] for g in got] == [True, False, False, True, False, False, True, False]
    assert [g["allowed"] for g in got] == [True, False, False, True, True, False, True, False]


def test_big_picture(spark):
    texts = ["compare Alfa Grid with Beta Wind on storage costs", "alfa vs beta", "What's happening with chip tariffs?", "give me an overview of the port strike", "show me trends", "how are banks handling the new rules?", "what do my sources say about fusion?", "are my feeds ok today", "overview"]
    got = run(spark, m.big_picture(C("t")), [(t,) for t in texts], "t string")
    assert [g["big"] for g in got] == [True, True, True, True, False, True, True, False, False]
    assert [g["topic"] for g in got][:4] == ["Alfa Grid storage costs | Beta Wind storage costs", "alfa | beta", "chip tariffs", "the port strike"]
    assert got[6]["topic"] == "fusion"


def test_sources_and_fresh(spark):
    got = run(spark, m.source_quality(C("t")), [("which feeds are worth it in the last 30 days?",), ("what feeds are you following",), ("open source quality",), ("where do my best stories come from this month",), ("how are my sources doing past week",)], "t string")
    assert [(g["asked"], g["days"]) for g in got] == [(True, 30), (False, None), (False, None), (True, 30), (True, 7)]
    cases = [("which feeds are worth it?", "x", ["other"]), ("who owns it?", "x", ["query"]), ("hi", " ", []), ("hi", "I am running a search now", None), ("anything on fusion", "No.", []), ("who owns the port?", "Nobody.", []), ("hello", "It cost $5 and 40 percent", []), ("so, that", "I found two articles", []), ("hello", "Hello!", [])]
    got = run(spark, m.fresh_lookup(C("t"), C("r"), C("u")), cases, "t string", "r string", "u array<string>")
    assert got == ["source quality", "", "empty reply", "claims an action", "feed question", "question", "", "feed claims", ""]
    got = run(spark, m.prefetch(C("t")), [("hey, the third one",), ("what about #12?",), ("anything on the port strike?",), ("tell me more about Alfa",), ("word " * 21,)], "t string")
    assert [(g["item"], g["tag"]) for g in got] == [(3, ""), (12, ""), (None, "port strike"), (None, "Alfa"), (None, "")]


def test_web(spark):
    cases = [("who owns it", "From general knowledge, the state.", False, 0), ("thanks", "ok", False, 0), ("who owns it", "The feed has no articles on that.", False, 0), ("who owns it", "The state.", False, 0), ("who owns it", "x", True, 0), ("who owns it", "x", False, 2), ("scrape https://a.example", "x", False, 0), ("see https://a.example", "x", False, 0)]
    got = run(spark, m.needs_web(C("t"), C("r"), C("w"), C("n")), cases, "t string", "r string", "w boolean", "n int")
    assert [g["web"] for g in got] == [True, False, True, False, False, False, False, False]
    assert [g["reason"] for g in got][6:] == ["about the bot", "a link"]
    assert run(spark, m.judge_needed(C("t")), [("I can search for it.",), ("The articles only say nothing specific.",), ("It was sold in May.",)], "t string") == [True, True, False]


@pytest.mark.parametrize("text,bare", [("Yes!", True), (" ok 👍", True), ("thanks.", True), ("yes, the port", False), ("", False), (None, False)])
def test_bare(spark, text, bare):
    assert run(spark, m.bare_reply(C("t")), [(text,)], "t string") == [bare]


def test_media(spark):
    links = ["https://youtu.be/x", "https://www.youtube.com/@someone", "https://a.example/talk.mp3?x=1", "https://a.example/page", "youtu.be/x", None]
    assert run(spark, m.media_link(C("t")), [(u,) for u in links], "t string") == [True, False, True, False, False, False]
    got = run(spark, m.media_request(C("t")), [("check this out https://youtu.be/x. and the slides",), ("transcribe https://a.example/t.mp3, https://a.example/t.mp3 and list every price",), (None,)], "t string")
    assert [(g["urls"], g["slides"], g["transcribe"]) for g in got] == [(["https://youtu.be/x"], True, False), (["https://a.example/t.mp3"], False, True), ([], False, False)]
    assert [g["instruction"] for g in got] == ["", "transcribe and list every price", ""]


def test_history_and_relations(spark):
    assert run(spark, m.asks_history(C("t")), [("did you tell me about it",), ("who owns it",)], "t string") == [True, False]
    assert run(spark, m.uses_recall(C("t"), C("n")), [("On 13 Oct I told you so", 1), ("Earlier you asked", 0), ("It was sold", 2)], "t string", "n int") == [True, False, False]
    assert run(spark, m.relation_question(C("t")), [("which companies are using Alfa",), ("who is Alfa",)], "t string") == [True, False]
