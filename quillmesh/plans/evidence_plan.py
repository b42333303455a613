"""Queries over payloads of sources, and over answers and their evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import evidence, text
from quillmesh.functions.urls import canon
from quillmesh.operators import ingest, research, stories
from quillmesh.plans.urls_plan import canon_sql
from quillmesh.session import table
from quillmesh.sources import readers

TODAY = "2026-04-25"


def _records(s, d):
    return table(s, d, "url_batches").dropDuplicates(["rec_id"])


def _items(s, d):
    return stories.items_once(table(s, d, "feed_items"))


def search_replies(s, d):
    """The records as replies of the three searches, ten results each, read back."""
    r = _records(s, d).withColumn("kind", F.col("rec_id") % 3)
    hit = F.struct("url", "title", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("at"))
    pages = r.groupBy("kind", F.floor(F.col("rec_id") / 30).alias("page")).agg(F.collect_list(hit).alias("hits"))
    out = None
    for k, (name, (path, date)) in enumerate(readers.SEARCHES.items()):
        results = F.transform("hits", lambda h: F.struct(h["url"].alias("url"), h["title"].alias("title"), h["at"].alias(date)))
        body = F.struct(results.alias("results"))
        body = F.to_json(F.struct(body.alias("web")) if path.startswith("web.") else body)
        hits = readers.search_hits(pages.where(F.col("kind") == k).select(body.alias("body")), name)
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("source", "url").agg(F.count("*").alias("hits"), F.count("title").alias("titles"), F.unix_micros(F.max("published_at")).alias("last"))


def feed_entries(s, d):
    """The records of feeds as XML, twenty entries each, read back with the recency rule."""
    r = _records(s, d).where("source like 'rss:%'")
    mark = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), text.escaped(c), F.lit(f"</{name}>"))).otherwise("")
    day = F.date_format("published_at", "d MMM yyyy HH:mm:ss '+0000'")
    item = F.concat(F.lit("<item>"), mark("title", F.col("title")), mark("link", F.col("url")), mark("pubDate", day), F.lit("</item>"))
    feeds = r.groupBy("source", F.floor(F.col("rec_id") / 20).alias("page")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    entries = readers.feed_entries(feeds.select("source", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("body")))
    kept = readers.recent(entries, F.lit("2026-06-01 00:00:00").cast("timestamp"))
    return kept.groupBy("source", F.trim("url").alias("url")).agg(F.count("*").alias("entries"), F.count("published_at").alias("dated"))


def url_lists(s, d):
    """The records of every run as one list of objects and plain addresses."""
    o = F.to_json(F.struct("url", "title", "source", (F.col("rec_id") % 7 == 0).alias("slides")))
    lists = _records(s, d).groupBy("run_id", F.floor(F.col("rec_id") / 50).alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(o), ","), F.lit("]")).alias("urls"))
    return readers.url_inputs(lists).groupBy("canonical", "source").agg(F.count("*").alias("records"), F.count("title").alias("titles"), F.count_if("slides").alias("slides"))


def wanted_again(s, d):
    """Records that are new, and those that ask for slides of a page known before."""
    b = _records(s, d).select("rec_id", canon(F.col("url")).alias("canonical"), (F.col("rec_id") % 7 == 0).alias("slides"), F.lit(False).alias("transcribe")).where("canonical is not null")
    return research.wanted_again(ingest.dedupe_batch(_records(s, d), table(s, d, "seen_urls")), b)


def replaced_pages(s, d):
    """Pages and items that stay when the records of every fifth run ask for a replacement."""
    flag = F.when(F.col("run_id") % 5 == 0, "replace").otherwise("")
    incoming = _records(s, d).select(canon(F.col("url")).alias("canonical_url"), flag.alias("flag")).where("canonical_url is not null")
    docs, items = research.replaced_pages(table(s, d, "raw_docs").select("id", "canonical_url"), _items(s, d).select("id", "raw_doc_id"), incoming)
    return docs.select(F.lit("page").alias("kind"), "id").unionByName(items.select(F.lit("item").alias("kind"), "id"))


def page_choice(s, d):
    """Which text of a page is taken, with its passages as the cleaned one; PDFs are left to the fallback."""
    p = table(s, d, "raw_docs")
    fit = F.left("markdown", F.length("title") * 10)
    chosen = ingest.page_text(fit, F.left("markdown", F.lit(600)), F.left("markdown", F.lit(250)), url=F.when(F.col("scraper") == "upload:pdf", F.concat("canonical_url", F.lit(".pdf"))).otherwise(F.col("canonical_url")))
    return p.select("id", F.length(chosen).alias("taken"))


def summary_names(s, d):
    """Names inside each summary that its title doesn't have."""
    return _items(s, d).select("id", F.array_sort(evidence.names(F.col("summary"), F.col("title"))).alias("names"))


def question_cutoffs(s, d):
    c = table(s, d, "chat_memory").dropDuplicates(["id"])
    return c.select("id", evidence.cutoff(F.col("question"), F.lit(None).cast("string"), TODAY).alias("cut"))


def stale_runs(s, d):
    """What is said of the dates of each run's pages."""
    g = table(s, d, "raw_docs").where("run_id is not null").groupBy("run_id").agg(F.max(F.date_format("published_at", "yyyy-MM-dd")).alias("newest"))
    return g.select("run_id", evidence.stale_note(F.array("newest"), TODAY).alias("note"))


def figure_origins(s, d):
    """The two earliest pages of its run that have a figure of an item's summary."""
    claims = _items(s, d).where("run_id is not null").select(F.col("run_id").alias("topic"), F.col("id").alias("claim"), F.col("summary").alias("text"))
    pages = table(s, d, "raw_docs").where("run_id is not null").select(F.col("run_id").alias("topic"), F.col("id").alias("page"), F.date_format("published_at", "yyyy-MM-dd").alias("date"), F.col("markdown").alias("text"))
    return research.origin_pages(claims, pages).select("claim", "page", "date")


def extra_fields(s, d):
    """The names of the fields that an item's JSON has beside the fixed ones."""
    extra = F.from_json(research.extra_fields(F.col("structured")), "map<string,string>")
    return _items(s, d).select("id", F.array_join(F.array_sort(F.map_keys(extra)), ",").alias("fields")).where("fields is not null")


def summary_words(s, d):
    """The words of each title that are worth a spelling check."""
    return _items(s, d).select("id", F.array_join(evidence.spell_words(F.col("title")), " ").alias("words"))


def softened_summaries(s, d):
    return _items(s, d).select("id", F.md5(evidence.softened(F.col("summary"))).alias("softened"), evidence.thin_note(F.size("tags")).alias("thin"))


def page_sections(s, d):
    """The sections of transcripts and how many lines each has."""
    from quillmesh.operators import pages

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(i, n, sum(bool(x.strip()) for x in lines)) for i, t in zip(pdf["id"], pdf["markdown"]) for n, lines in pages.sections_of(t or "")], columns=["id", "section", "lines"])

    return table(s, d, "raw_docs").where("scraper like 'media:%'").select("id", "markdown").mapInPandas(run, "id long, section string, lines int")


QUERIES = {f.__name__: f for f in (search_replies, feed_entries, url_lists, wanted_again, replaced_pages, page_choice, summary_names, question_cutoffs, stale_runs, figure_origins, extra_fields, summary_words, softened_summaries, page_sections)}

_REC = "(select distinct on (rec_id) * from url_batches order by rec_id)"
_I = "(select distinct on (id) * from feed_items order by id)"
_CANON = canon_sql(_REC, "rec_id, run_id, source, title")
_SEEN = canon_sql("(select canonical_url as url from seen_urls)", "url")
_MONTH = "\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?\\s+(20[0-9][0-9])\\b"
_CAP = "[A-Z][A-Za-z0-9&-]*[A-Za-z0-9](?: [A-Z][A-Za-z0-9&-]*[A-Za-z0-9])*"
_STOP = ", ".join(f"'{w}'" for w in evidence.NAME_STOP)
_FIG = "(?:^|[^0-9.])([0-9]+(?:\\.[0-9]+)?)"

SQL = {
    "search_replies": f"select source, url, count(*) as hits, count(title) as titles, epoch_us(max(published_at)) as last from (select case rec_id % 3 when 0 then 'exa' when 1 then 'tavily' else 'brave' end as source, url, title, published_at from {_REC} where url is not null and url <> '') group by 1, 2",
    "feed_entries": f"select source, trim(url, ' ' || chr(9) || chr(10) || chr(13)) as url, count(*) as entries, count(published_at) as dated from {_REC} where source like 'rss:%' and trim(coalesce(url, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' and (published_at is null or date_trunc('second', published_at) >= timestamptz '2026-05-30 00:00:00+00') group by 1, 2",
    "url_lists": f"select canonical, source, count(*) as records, count(title) as titles, count(*) filter (where rec_id % 7 = 0) as slides from ({_CANON}) where canonical is not null group by 1, 2",
    "wanted_again": f"""with c as materialized (select rec_id, canonical from ({_CANON}) where canonical is not null), f as (select canonical, min(rec_id) as rec_id from c where canonical not in (select canonical from ({_SEEN}) where canonical is not null) group by 1)
      select canonical, rec_id, '' as flag from f union all select canonical, min(rec_id), 'replace' from c where rec_id % 7 = 0 and canonical not in (select canonical from f) group by 1""",
    "replaced_pages": f"""with gone as (select id from raw_docs where canonical_url in (select canonical from ({_CANON}) where run_id % 5 = 0 and canonical is not null))
      select 'page' as kind, id from raw_docs where id not in (select id from gone) union all select 'item', id from {_I} where raw_doc_id is null or raw_doc_id not in (select id from gone)""",
    "page_choice": """select id, case when scraper is not distinct from 'upload:pdf' and canonical_url is not null then case when n >= 200 then least(n, 250) end when coalesce(f, 0) >= 400 then f when least(n, 600) >= 400 then least(n, 600) when n >= 200 then least(n, 250) end::int as taken
      from (select *, length(markdown) as n, case when title is not null then least(length(markdown), length(title) * 10) end as f from raw_docs)""",
    "summary_names": f"""select id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(summary, ''), '\\*\\*|__|`', '', 'g'), '[a-z0-9,;:()"''’] ({_CAP})', 1), lambda n: array_to_string(list_filter(string_split(n, ' '), lambda w: lower(w) not in ({_STOP}) and length(w) > 1), ' ')),
      lambda n: n <> '' and not contains(lower(coalesce(title, '')), lower(n))))) as names from {_I}""",
    "question_cutoffs": f"""select id, case when regexp_matches(q, '\\bthis year\\b') then '2026-01-01' when regexp_matches(q, '\\bthis month\\b') then '2026-04-01' when regexp_matches(q, '{_MONTH}') then regexp_extract(q, '{_MONTH}', 2) || '-' || lpad(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], regexp_extract(q, '{_MONTH}', 1))::varchar, 2, '0') || '-01'
      when regexp_matches(q, '\\bsince\\s+20[0-9][0-9]\\b') then regexp_extract(q, '\\bsince\\s+(20[0-9][0-9])\\b', 1) || '-01-01' else '' end as cut from (select id, lower(coalesce(question, '')) as q from (select distinct on (id) * from chat_memory order by id))""",
    "stale_runs": "select run_id, case when newest is null then 'undated' when date '2026-04-25' - newest > 183 then 'newest ' || newest::varchar else '' end as note from (select run_id, max((published_at at time zone 'UTC')::date) as newest from raw_docs where run_id is not null group by 1)",
    "figure_origins": f"""with c as (select run_id, id as claim, unnest(list_distinct(list_filter(regexp_extract_all(regexp_replace(coalesce(summary, ''), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '([0-9]+(?:\\.[0-9]+)?)', 1), lambda n: not regexp_full_match(n, '(19|20)[0-9][0-9]') and not (not contains(n, '.') and n::double <= 10)))) as figure from {_I} where run_id is not null),
      p as (select run_id, id as page, strftime(published_at at time zone 'UTC', '%Y-%m-%d') as date, unnest(list_distinct(regexp_extract_all(regexp_replace(coalesce(markdown, ''), '([0-9]),([0-9]{{3}})', '\\1\\2', 'g'), '{_FIG}', 1))) as figure from raw_docs where run_id is not null and published_at is not null)
      select claim, page, date from (select claim, page, date, row_number() over (partition by claim order by date, page) as k from (select distinct claim, page, date from c join p using (run_id, figure) where date >= '2000' and date < '2100')) where k <= 2""",
    "extra_fields": f"select id, array_to_string(list_sort(list_filter(json_keys(structured::json), lambda k: k not in ('summary', 'angle', 'relevance', 'specificity', 'angle_strength', 'tags'))), ',') as fields from {_I} where structured is not null",
    "summary_words": f"select id, array_to_string(list_distinct_ordered[1:4], ' ') as words from (select id, list_filter(w, lambda x, i: list_position(w, x) = i) as list_distinct_ordered from (select id, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9-]+'), lambda x: length(x) >= 4 and regexp_full_match(x, '[a-z][a-z-]*')) as w from {_I}))",
}
