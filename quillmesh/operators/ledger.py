"""The run ledger, the backlog of unread pages, and the source scorecard (A-3, A-4, A-9, A-10, F-7, TR-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.urls import host_of
from quillmesh.operators.ingest import match_feeds


def run_outcome(new: Column, error: Column, scraped: Column, made: Column) -> Column:
    """ok, failed or partial; the order of the cases matters."""
    return F.when((new == 0) & (error == ""), "ok").when((scraped == 0) & (new > 0), "failed").when(scraped < new, "partial").when(made < scraped, "partial").otherwise("ok")


def finished_runs(runs: DataFrame, docs: DataFrame, items: DataFrame, failed: str) -> DataFrame:
    """Runs with ``scraped``, ``made`` (items that were read) and the ``status`` these give."""
    scraped = docs.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("scraped"))
    made = items.where("run_id is not null").where(~F.col("summary").eqNullSafe(failed)).groupBy("run_id").agg(F.count("*").alias("made"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = runs.drop("status").withColumnRenamed("id", "run_id").join(scraped, "run_id", "left").join(made, "run_id", "left")
    j = j.withColumn("scraped", zero("scraped")).withColumn("made", zero("made"))
    outcome = run_outcome(zero("urls_new"), F.coalesce("error", F.lit("")), F.col("scraped"), F.col("made"))
    return j.withColumn("status", outcome).withColumnRenamed("run_id", "id")


def backlog(docs: DataFrame, items: DataFrame, failed: str, tries: int = 3) -> DataFrame:
    """(id, items, failed) of pages that have no item, more than one, or only a failed one with tries left."""
    per = items.groupBy(F.col("raw_doc_id").alias("id")).agg(F.count("*").alias("items"), F.bool_or(F.col("summary").eqNullSafe(failed)).alias("failed"))
    j = docs.select("id", F.coalesce("triage_failures", F.lit(0)).alias("tried")).join(per, "id", "left")
    j = j.select("id", "tried", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return j.where((F.col("items") != 1) | (F.col("failed") & (F.col("tried") < tries)))


def live_runs(runs: DataFrame, now: str, minutes: int = 15) -> DataFrame:
    """One row: how many runs are under way."""
    begun = F.col("started_at") > F.expr(f"timestamp'{now}' - interval {minutes} minutes")
    return runs.agg(F.count_if((F.lower("status") == "running") & begun).alias("live"))


def _figures(rows: DataFrame, *by: str) -> DataFrame:
    scored = F.col("score") > 0
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(scored).alias("scored"), F.count_if(F.col("score") >= 7).alias("good"), F.coalesce(F.sum(F.when(scored, F.col("score"))), F.lit(0)).alias("score_sum"),
        F.count_if(F.col("vote") == 1).alias("up"), F.count_if(F.col("vote") == -1).alias("down"),
    )
    return g.select(
        *by, "n", "scored", (F.col("n") - F.col("scored")).alias("unscored"), "good", "up", "down",
        F.when(F.col("scored") > 0, F.concat(F.floor(100 * F.col("good") / F.col("scored") + 0.5).cast("string"), F.lit("%"))).otherwise("-").alias("good_rate"),
        F.when(F.col("scored") > 0, F.floor(10 * F.col("score_sum") / F.col("scored") + 0.5) / 10).alias("avg_score"),
    )


def _sourced(items: DataFrame, seen: DataFrame, votes: DataFrame | None) -> DataFrame:
    src = seen.groupBy("canonical_url").agg(F.max("source").alias("source"))
    rows = items.where("dup_of is null").select("id", "canonical_url", "score").join(src, "canonical_url", "left").withColumn("source", F.coalesce("source", F.lit("unknown")))
    if votes is None:
        return rows.withColumn("vote", F.lit(0))
    return rows.join(votes.select(F.col("feed_item_id").alias("id"), "vote"), "id", "left")


def scorecard(items: DataFrame, seen: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Per discovery source: items, scored ones, good ones (7 or more), votes, rate and mean; merged duplicates count once."""
    return _figures(_sourced(items, seen, votes), "source")


def feed_scorecard(items: DataFrame, seen: DataFrame, feeds: DataFrame) -> DataFrame:
    """The same per feed: items credited to the feed on their site, silent active feeds kept, the rest under its own name."""
    rows = _sourced(items, seen, None).where(F.col("source").startswith("rss")).withColumn("host", host_of(F.col("canonical_url")))
    named = F.concat(F.coalesce("label", "url"), F.when(F.col("active"), "").otherwise(" (off)"))
    owners = match_feeds(rows.select("host").where("host != ''").distinct(), feeds).select("host", "feed_id")
    rows = rows.join(owners, "host", "left").join(feeds.select(F.col("id").alias("feed_id"), named.alias("feed")), "feed_id", "left").withColumn("feed", F.coalesce("feed", F.lit("RSS (other site)")))
    found = _figures(rows, "feed")
    silent = feeds.where("active").select(F.coalesce("label", "url").alias("feed")).distinct().join(found.select("feed"), "feed", "left_anti")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("n", "scored", "unscored", "good", "up", "down")]
    return found.unionByName(silent.select("feed", *zeros, F.lit("-").alias("good_rate"), F.lit(None).cast("double").alias("avg_score")))
