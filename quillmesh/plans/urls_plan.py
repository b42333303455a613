"""Queries over URL records and their SQL: canonical forms, deduplication against history, hosts and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.urls import canon, host_of, video_id
from quillmesh.operators.ingest import dedupe_batch, match_feeds
from quillmesh.operators.ranking import cap_per_group
from quillmesh.operators.state import insert_if_absent
from quillmesh.session import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_batches").dropDuplicates(["rec_id"])


def canon_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_batches").select("url").distinct().select("url", canon(F.col("url")).alias("canonical"))


def video_ids(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "url_batches").select("url").distinct()
    return u.select("url", video_id(F.col("url")).alias("video")).where("video is not null")


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("records"), F.count_distinct("run_id").alias("runs"))


def fresh_urls(spark: SparkSession, d: str) -> DataFrame:
    return dedupe_batch(_records(spark, d), table(spark, d, "seen_urls")).select("rec_id", "run_id", "canonical")


def fresh_by_run(spark: SparkSession, d: str) -> DataFrame:
    fresh = dedupe_batch(_records(spark, d), table(spark, d, "seen_urls"))
    found = _records(spark, d).groupBy("run_id").agg(F.count("*").alias("urls_found"))
    return found.join(fresh.groupBy("run_id").agg(F.count("*").alias("urls_new")), "run_id", "left").select("run_id", "urls_found", F.coalesce("urls_new", F.lit(0)).alias("urls_new"))


def seen_after(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "seen_urls").select("canonical_url", "source")
    new = _records(spark, d).select(canon(F.col("url")).alias("canonical_url"), "source").where("canonical_url is not null")
    return insert_if_absent(seen, new, ["canonical_url"])


def host_cap(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).where("title is not null").select("rec_id", "title", host_of(F.col("url")).alias("host")).where("host != ''")
    scored = r.withColumn("score", F.length("title"))
    return cap_per_group(scored, "host", [F.desc("score"), F.asc("rec_id")], 2, 50).select("rec_id", "host", "score")


def feed_sites(spark: SparkSession, d: str) -> DataFrame:
    # feeds name their source after their own site
    named = F.concat(F.lit("news."), F.regexp_extract("source", "^rss:(.+)$", 1), F.lit(".example"))
    hosts = _records(spark, d).where("source like 'rss:%'").groupBy(named.alias("host")).agg(F.count("*").alias("n"))
    return match_feeds(hosts, table(spark, d, "sources").where("kind = 'rss'")).select("host", "n", "feed_id")


def recent_records(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-06-01 00:00:00").cast("timestamp")
    r = _records(spark, d)
    return r.where(F.col("published_at").isNull() | (F.col("published_at") >= now - F.expr("interval 48 hours"))).select("rec_id", F.col("published_at").isNull().alias("undated"))


def active_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where("active").select("id", "kind", "url", F.coalesce("label", "url").alias("label"))


def latest_record(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each canonical URL (lateral latest row)."""
    r = _records(spark, d).select(canon(F.col("url")).alias("canonical"), "rec_id", "title").where("canonical is not null")
    return r.groupBy("canonical").agg(F.max(F.struct("rec_id", "title")).alias("r"), F.count("*").alias("records")).select("canonical", "r.rec_id", "r.title", "records")


def repeat_within_run(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select("run_id", "rec_id", canon(F.col("url")).alias("canonical")).where("canonical is not null")
    first = r.groupBy("run_id", "canonical").agg(F.min("rec_id").alias("first_rec"), F.count("*").alias("n")).where("n > 1")
    return first.groupBy("run_id").agg(F.sum(F.col("n") - 1).alias("repeats"), F.count("*").alias("urls"))


def source_days(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n"), "day")
    r = _records(spark, d).where("source is not null and published_at is not null").groupBy("source", F.date_format(F.from_utc_timestamp("published_at", "+06:00"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


_U = r"regexp_replace(url, '^\s+|\s+$', '', 'g')"
_ID = "([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)"


def video_sql(u: str) -> str:
    """The id of a video page, '' elsewhere."""
    rest = f"regexp_replace({u}, '^https?://', '', 'i')"
    site, path = f"split_part(lower({rest}), '/', 1)", f"regexp_replace({rest}, '^[^/]*', '')"
    keys = f"string_split(regexp_extract({path}, '(?i)^/watch[?]([^#]*)', 1), '&')"
    asked = f"list_filter(list_transform({keys}, lambda p: regexp_extract(p, '(?i)^v={_ID}', 1)), lambda v: v <> '')"
    return f"""(case when {site} in ('youtu.be', 'www.youtu.be', 'm.youtu.be', 'music.youtu.be') then regexp_extract({path}, '^/{_ID}', 1)
      when {site} in ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'music.youtube.com') then
        coalesce(nullif(regexp_extract({path}, '(?i)^/(?:shorts|embed|live|v)/{_ID}', 1), ''), {asked}[-1], '') else '' end)"""


_WHOLE = r"'^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$'"
_TRACKER = r"'(?i)^(utm_.*|fbclid|gclid|ref|source|src|mc_cid|mc_eid|igshid)(=.*)?$'"


def canon_sql(source: str, keep: str) -> str:
    """A select of ``keep`` and ``canonical`` from ``source``, which has a column url."""
    return f"""
    select {keep}, case when video <> '' then 'https://www.youtube.com/watch?v=' || video
      when ok then scheme || '://' || usr || host || (case when (scheme = 'http' and port = ':80') or (scheme = 'https' and port = ':443') then '' else port end)
        || (case when p4 = '' then '/' else p4 end) || (case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end) end as canonical
    from (select *, case when length(p3) > 1 and p3 like '%/' then p3[:-2] else p3 end as p4
    from (select *, regexp_replace(case when raw_path = '' then '/' else regexp_replace(raw_path, '^(.*?)/amp(/.*)?$', '\\1\\2') end, '/{{2,}}', '/', 'g') as p3,
      regexp_replace(lower(regexp_replace(hp, ':\\d+$', '')), '^amp\\.', '') as host, regexp_extract(hp, '(:\\d+)$', 1) as port,
      list_filter(string_split(regexp_replace(raw_query, '^\\?', ''), '&'), lambda x: x <> '' and not regexp_matches(x, {_TRACKER})) as kept
    from (select *, regexp_extract(authority, '^(.*@)?', 1) as usr, regexp_replace(authority, '^.*@', '') as hp
    from (select *, lower(regexp_extract(u, {_WHOLE}, 1)) as scheme, regexp_extract(u, {_WHOLE}, 2) as authority, regexp_extract(u, {_WHOLE}, 3) as raw_path,
      regexp_extract(u, {_WHOLE}, 4) as raw_query, regexp_matches(u, {_WHOLE}) as ok, {video_sql("u")} as video
    from (select *, {_U} as u from {source})))))"""


_HOST = r"regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
_REC = "(select distinct on (rec_id) * from url_batches order by rec_id)"
_NEW = f"({canon_sql(_REC, 'rec_id, run_id, source, title')})"
_OLD = f"({canon_sql('(select canonical_url as url from seen_urls)', 'url')})"
_FRESH = f"(select canonical, min(rec_id) as rec_id from {_NEW} n where canonical is not null and canonical not in (select canonical from {_OLD} o where canonical is not null) group by 1)"

QUERIES = {f.__name__: f for f in (canon_urls, video_ids, url_hosts, fresh_urls, fresh_by_run, seen_after, host_cap, feed_sites, recent_records, active_sources, latest_record, repeat_within_run, source_days)}

SQL = {
    "canon_urls": canon_sql("(select distinct url from url_batches)", "url"),
    "video_ids": f"select url, v as video from (select distinct url, {video_sql('u')} as v from (select url, {_U} as u from url_batches)) where v <> ''",
    "url_hosts": f"select {_HOST} as host, count(*) as records, count(distinct run_id) as runs from {_REC} group by 1",
    "fresh_urls": f"select f.rec_id, r.run_id, f.canonical from {_FRESH} f join {_REC} r using (rec_id)",
    "fresh_by_run": f"select run_id, count(*) as urls_found, count(f.rec_id) as urls_new from {_REC} r left join {_FRESH} f using (rec_id) group by 1",
    "seen_after": f"select canonical_url, source from seen_urls union all select canonical, case when count(*) > count(source) then null else min(source) end from {_NEW} n where canonical is not null and canonical not in (select canonical_url from seen_urls) group by 1",
    "host_cap": f"select rec_id, host, score from (select *, row_number() over (partition by host order by score desc, rec_id) as k from (select rec_id, {_HOST} as host, length(title)::int as score from {_REC} where title is not null) where host <> '') where k <= 2 order by score desc, rec_id limit 50",
    "feed_sites": f"""with h as (select 'news.' || regexp_extract(source, '^rss:(.+)$', 1) || '.example' as host, count(*) as n from {_REC} where source like 'rss:%' group by 1), s as (select id, active, {_HOST} as fh from sources where kind = 'rss')
      select host, n, id as feed_id from (select h.host, h.n, s.id, row_number() over (partition by h.host order by s.active desc, s.id) as k from h join s on fh <> '' and (h.host = fh or ends_with(h.host, '.' || fh) or ends_with(fh, '.' || h.host))) where k = 1""",
    "recent_records": f"select rec_id, published_at is null as undated from {_REC} where published_at is null or published_at >= timestamptz '2026-05-30 00:00:00+00'",
    "active_sources": "select id, kind, url, coalesce(label, url) as label from sources where active",
    "latest_record": f"select canonical, max(rec_id) as rec_id, arg_max_null(title, rec_id) as title, count(*) as records from {_NEW} where canonical is not null group by 1",
    "repeat_within_run": f"select run_id, sum(n - 1)::bigint as repeats, count(*) as urls from (select run_id, canonical, count(*) as n from {_NEW} where canonical is not null group by 1, 2 having count(*) > 1) group by 1",
    "source_days": f"select source, day, n, rank::int as rank from (select *, row_number() over (partition by source order by n desc, day) as rank from (select source, strftime(published_at at time zone 'UTC' + interval 6 hours, '%Y-%m-%d') as day, count(*) as n from {_REC} where source is not null and published_at is not null group by 1, 2)) where rank <= 3",
}
