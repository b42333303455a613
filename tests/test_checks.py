import pytest
from pyspark.sql import functions as F

from quillmesh.functions import stem
from quillmesh.operators import checks


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("word", "want"), [("markets", "market"), ("running", "run"), ("hoping", "hope"), ("hopped", "hop"), ("generalization", "general"), ("national", "nation"), ("happily", "happili"), ("cries", "cri"), ("ties", "tie"), ("skies", "sky"), ("agreement", "agreement"), ("relational", "relat"), ("controlling", "control"), ("is", "is"), ("news", "news")])
def test_stems(word, want):
    assert stem.stem(word) == want


def test_quotes(spark):
    df = spark.createDataFrame([("The  Market rose… in two cities", "Today the market rose, and in two cities it fell."), ("short…", "short"), ("not there at all", "x"), (None, "x"), ("the market rose", None)], "q string, p string")
    assert [r.f for r in df.select(F.coalesce(checks.quote_found(F.col("q"), F.col("p")), F.lit(False)).alias("f")).collect()] == [True, False, False, False, False]


def test_nearness(spark):
    df = spark.createDataFrame([("Alpha " + "x" * 30 + " beta",), ("alpha " + "x" * 300 + " beta",), ("alpha",), (None,)], "p string")
    assert [r.n for r in df.select(checks.near_each_other(F.col("p"), F.lit("alpha"), F.lit("Beta"), 60).alias("n")).collect()] == [True, False, False, False]


def test_cited_answers(spark):
    answers = spark.createDataFrame([(1, "Prices rose by 45 percent in spring [1]. Nobody knows why this happened at all. They fell to 3,100 units later [1][4].")], "answer int, text string")
    items = spark.createDataFrame([(1, 1, "Prices rose 45% this spring")], "answer int, n int, evidence string")
    assert rows(checks.checked_sentences(answers, items), "k", "problem") == [(1, "no source"), (2, "figures: 3100"), (2, "no such item")]


def test_replies(spark):
    good = '{"summary": "s", "angle": "a", "relevance": 3, "specificity": 2, "angle_strength": 5, "tags": ["t"]}'
    df = spark.createDataFrame([(f"```json\n{good}\n```", None), ("", f"thinking {good} done"), (good.replace("3", "9"), None), (good.replace('["t"]', "[]"), None), ("nothing", None), (None, None)], "c string, r string")
    assert [r.ok for r in df.select(checks.read_reply(F.col("c"), F.col("r")).isNotNull().alias("ok")).collect()] == [True, True, False, False, False, False]


def test_small_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(checks.counted_reply(F.lit("Here are 10 items:\n1. a\n2. b"))) == "Here are 2 items:\n1. a\n2. b"
    assert tuple(get(checks.vote_of(F.lit("down:12")))) == (12, -1) and get(checks.vote_of(F.lit("x:1"))) is None
    assert get(checks.all_before(F.array(F.lit("2024"), F.lit("soon")), "2025-01-01")) is True
    assert get(checks.all_before(F.array(F.lit("soon")), "2025-01-01")) is False
    f = get(checks.kept_filters(F.lit("who bought it?"), F.lit("5"), F.lit("7"), F.lit(None).cast("string")))
    assert f.min_score is None and f.max_age_days is None and f.dropped == ["min_score", "max_age_days"]
    assert get(checks.kept_filters(F.lit(""), F.lit("5"), F.lit("7"), F.lit("x"))).dropped == []
    assert get(checks.packed_vectors(F.array(F.array(F.lit(0.5), F.lit(1.0)), F.array(F.lit(float("nan")))))) == "0.5 1.0|"


def test_notes_and_claims(spark):
    i = spark.createDataFrame([(1, 'A "b": c/d', "https://a.example", "Sum.", "Angle.", 7, ["x y", "{z}"])], "id long, title string, canonical_url string, summary string, angle string, score int, tags array<string>")
    n = checks.notes(i, "2026-01-01").first()
    assert n.file == "A b c d.md" and 'title: "A \\"b\\": c/d"' in n.note and "tags: [x-y, z]" in n.note
    w = spark.createDataFrame([(1,), (1,), (2,)], "feed_item_id long")
    assert rows(checks.claimed(w, spark.createDataFrame([(2,)], "feed_item_id long")), "feed_item_id") == [(1,)]
