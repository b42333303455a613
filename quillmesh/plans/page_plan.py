"""Queries without SQL: sequential page rules, transcripts, streams and plugged-in functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh import plugins
from quillmesh.operators import pages, state
from quillmesh.plans.urls_plan import canon_sql
from quillmesh.session import shared_dir, table
from quillmesh.streaming import feeds


def dropped_lines(s, d):
    return pages.judged(table(s, d, "raw_docs"))


def dropped_reasons(s, d):
    return pages.judged(table(s, d, "raw_docs")).groupBy("reason").agg(F.count("*").alias("lines"), F.count_distinct("id").alias("pages"))


def page_passages(s, d):
    return pages.passages(table(s, d, "raw_docs"), most=None)


def transcript_paragraphs(s, d):
    return pages.transcript_paragraphs(table(s, d, "raw_docs"))


def snapped_points(s, d):
    """Every paragraph's first twelve words as a point, its time a minute off, moved back to its line."""
    p = pages.transcript_paragraphs(table(s, d, "raw_docs"))
    points = p.select("id", F.col("start").alias("k"), (F.col("start") + 60).alias("t"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("point"))
    return pages.snap_points(points, p, ["the", "and", "for", "that", "this", "with", "was", "from"])


def embedded_items(s, d):
    i = table(s, d, "feed_items").dropDuplicates(["id"]).select("id", F.concat_ws(" ", "title", "summary").alias("text"))
    return plugins.embed(i, plugins.hashed_embedder()).select("id", F.size("embedding").alias("entries"), "error")


def judged_pairs(s, d):
    """Duplicates named by the feed, judged by their words."""
    i = table(s, d, "feed_items").dropDuplicates(["id"]).select("id", "dup_of", "summary")
    pairs = i.where("dup_of is not null").select(F.col("id").alias("a"), F.col("dup_of").alias("b"), F.col("summary").alias("text_a")).join(i.select(F.col("id").alias("b"), F.col("summary").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return plugins.judge_pairs(pairs, plugins.same_words_judge())


def _folder(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def streamed_urls(s, d):
    """The waiting records taken in as a stream."""
    home = _folder(s, "urls")
    schema = table(s, d, "url_batches").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/url_batches.parquet*").select("rec_id", "url", "source")
    feeds.ingest_urls(stream, f"{home}/seen", f"{home}/checkpoint").awaitTermination()
    return s.read.parquet(f"{home}/seen").select("canonical_url", "source")


def streamed_event_counts(s, d):
    """Events by user and type, kept as a snapshot that each micro-batch adds to."""
    home = _folder(s, "counts")
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")

    def merge(base, batch):
        new = batch.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
        return new if base is None else state.add_counts(base, new, ["user_id", "event_type"], "n")

    feeds.into_table(stream, merge, ["user_id", "event_type"], f"{home}/table", f"{home}/checkpoint").awaitTermination()
    return feeds.current(s, f"{home}/table")


QUERIES = {f.__name__: f for f in (dropped_lines, dropped_reasons, page_passages, transcript_paragraphs, snapped_points, embedded_items, judged_pairs, streamed_urls, streamed_event_counts)}

_REC = "(select distinct on (rec_id) * from url_batches order by rec_id)"

SQL = {
    "streamed_urls": f"select canonical as canonical_url, arg_min_null(source, rec_id) as source from ({canon_sql(_REC, 'rec_id, source')}) where canonical is not null group by 1",
    "streamed_event_counts": "select user_id, event_type, count(*) as n from events group by 1, 2",
}
