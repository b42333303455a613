import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text


def value(spark, column, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("v")).first().v


def test_figures(spark):
    assert sorted(value(spark, text.figures, "Raised $1.2 billion, 1,200 people, 45 percent; 7 items in 2024, 3.5x")) == ["1200", "1200000000", "3.5x", "45%"]
    assert value(spark, text.figures, None) == []


def test_citations(spark):
    assert value(spark, text.citations, "So [1][4, 6] and [2-3]. [x] [40–90]")[:5] == [1, 4, 6, 2, 3]
    assert len(value(spark, text.citations, "[40–90]")) == 20


@pytest.mark.parametrize(("stamp", "want"), [("1:02:05", 3725), ("[12:30]", 750), ("45", 45), ("x", None), ("1:2", None)])
def test_seconds(spark, stamp, want):
    assert value(spark, text.seconds, stamp) == want


@pytest.mark.parametrize(("said", "want"), [("2025-11-03", "2025-11-03"), ("3 Nov 2025", "2025-11-03"), ("November 2025", "2025-11-01"), ("in 2025", "2025-06-30"), ("2025-11", "2025-11-01"), ("soon", ""), (None, "")])
def test_iso_date(spark, said, want):
    assert value(spark, text.iso_date, said) == want


@pytest.mark.parametrize(("day", "want"), [("2026-01-01", 2), ("2025-10-24", 2), ("2025-10-23", 1), ("2025-04-24", 1), ("2025-04-23", 0), ("2026-04-28", 0), (None, 0)])
def test_recency(spark, day, want):
    assert value(spark, lambda c: text.recency(c, "2026-04-25"), day) == want


def test_topics_and_items(spark):
    assert value(spark, text.topics, " a, b |A  B;c;;d|e") == ["a b", "c", "d"]
    assert value(spark, text.item_number, "No. 12") == 12
    assert value(spark, text.item_number, "the third") is None


def test_sentences_keep_their_citations(spark):
    assert value(spark, text.sentences, "One is 3.5. [1] Two says so [2]. and on. \"Three\" ends!") == ["One is 3.5. [1]", "Two says so [2]. and on.", '"Three" ends!']


def test_snippet(spark):
    s = value(spark, lambda c: text.snippet(c, ["needle"], 30), "x" * 100 + " needle " + "y" * 100)
    assert "needle" in s and s.startswith("…") and s.endswith("…")


@pytest.mark.parametrize(("expr", "at", "want"), [("30 8 * * *", "2026-01-05 02:30:00", True), ("30 8 * * *", "2026-01-05 08:30:00", False), ("0 0 1 * 7", "2026-01-03 18:00:00", True), ("0 0 1 * 7", "2025-12-31 18:00:00", True), ("*/20 * * * *", "2026-01-05 02:40:00", True), ("61 * * * *", "2026-01-05 02:40:00", False), ("* * *", "2026-01-05 02:40:00", False)])
def test_cron(spark, expr, at, want):
    assert value(spark, lambda c: text.cron_matches(expr, c.cast("timestamp")), at) is want


def test_caption_segments_of_all_events(spark, tmp_path):
    from quillmesh.plans.text_plan import caption_segments

    rows = [(i, t) for i in (0, 7, 1999, 2000, 2001, 99_999, 10**9) for t in ("click", "view  x")]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in caption_segments(spark, str(tmp_path)).collect())
    assert got == sorted((i, round((i * 1000 + 500) / 1000, 2), f"a {' '.join(t.split())} b") for i, t in rows)
