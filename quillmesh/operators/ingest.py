"""Taking in URL records: within-batch and against-history deduplication, feeds by site, choice of the page text (SRC-4 to SRC-6, D-1, J-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.urls import canon, host_of


def first_forms(batch: DataFrame, order: str = "rec_id") -> DataFrame:
    """Records of ``batch`` (url, order, ...) with ``canonical``: readable, and the first of their canonical form."""
    forms = batch.withColumn("canonical", canon(F.col("url"))).where("canonical is not null")
    rest = [c for c in batch.columns if c != order]
    return forms.groupBy("canonical").agg(F.min(F.struct(order, *rest)).alias("r")).select("canonical", "r.*")


def dedupe_batch(batch: DataFrame, seen: DataFrame, order: str = "rec_id") -> DataFrame:
    """The first records of each canonical form that ``seen`` (canonical_url) doesn't have in any spelling."""
    first = first_forms(batch, order)
    old = seen.select(canon(F.col("canonical_url")).alias("canonical")).where("canonical is not null").distinct()
    return first.join(old, "canonical", "left_anti")


def domain_suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def match_feeds(hosts: DataFrame, feeds: DataFrame) -> DataFrame:
    """(host, ..., feed_id): the feed on the same site, where one host is the other or a domain above it; an active one first, then the lowest id.

    Both directions are equi-joins on a domain suffix, so no pair is tested that doesn't match.
    """
    f = feeds.select(F.col("id").alias("feed_id"), "active", host_of(F.col("url")).alias("feed_host")).where("feed_host != ''")
    below = hosts.withColumn("suffix", F.explode(domain_suffixes(F.col("host")))).join(f, F.col("suffix") == F.col("feed_host")).drop("suffix")
    above = f.withColumn("suffix", F.explode(domain_suffixes(F.col("feed_host")))).where("suffix != feed_host").join(hosts, F.col("suffix") == F.col("host")).drop("suffix")
    met = below.select(*hosts.columns, "feed_id", "active").unionByName(above.select(*hosts.columns, "feed_id", "active"))
    best = F.min(F.struct((~F.col("active")).alias("off"), "feed_id")).alias("b")
    rest = [c for c in hosts.columns if c != "host"]
    return met.groupBy("host", *rest).agg(best).select("host", *rest, "b.feed_id")


def page_text(fit: Column, raw: Column, fallback: Column, least: int = 400, least_fallback: int = 200, url: Column | None = None) -> Column:
    """The cleaned text if it is long enough, else the raw one; the fallback's only if both are short and it isn't.

    Of a ``url`` that leads to a PDF only the fallback's counts.
    """
    if url is not None:
        pdf = F.coalesce(F.lower(F.regexp_replace(url, "[?#].*$", "")).endswith(".pdf"), F.lit(False))
        fit, raw = (F.when(~pdf, c) for c in (fit, raw))
    primary = F.when(F.length(F.coalesce(fit, F.lit(""))) >= least, fit).otherwise(raw)
    enough = F.greatest(F.length(F.coalesce(fit, F.lit(""))), F.length(F.coalesce(raw, F.lit("")))) >= least
    return F.when(enough, primary).when(F.length(fallback) >= least_fallback, fallback)


def first_polls(fresh: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """``fresh`` with ``silent``: records of a feed that was never polled before are only marked as seen, not read.

    ``sources`` has name and bootstrapped_at; records of unknown sources are read.
    """
    known = sources.select(F.col("name").alias(source), F.col("bootstrapped_at").isNull().alias("silent"))
    return fresh.join(known, source, "left").withColumn("silent", F.coalesce("silent", F.lit(False)))
