"""Queries over texts, dates, chats and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import lexical, stories
from quillmesh.session import table

STOP = ["that", "this", "with", "from", "have", "were", "been", "they", "their", "would", "could", "about", "which"]
TODAY = "2026-04-25"


def _items(s, d):
    return stories.items_once(table(s, d, "feed_items"))


def _chats(s, d):
    return table(s, d, "chat_memory").dropDuplicates(["id"])


def figure_tokens(s, d):
    return _items(s, d).select("id", F.array_sort(text.figures(F.col("summary"))).alias("figures"))


def unsupported_figures(s, d):
    """Figures of an item's summary that its page doesn't have."""
    page = table(s, d, "raw_docs").select(F.col("id").alias("raw_doc_id"), text.figures(F.col("markdown")).alias("known"))
    j = _items(s, d).select("id", "raw_doc_id", text.figures(F.col("summary")).alias("said")).join(page, "raw_doc_id")
    return j.select("id", F.array_sort(F.array_except("said", "known")).alias("missing")).where(F.size("missing") > 0)


def citation_ids(s, d):
    made = F.concat(F.lit("So ["), (F.col("id") % 7 + 1).cast("string"), F.lit(", "), (F.col("id") % 3 + 8).cast("string"), F.lit("] and ["), (F.col("id") % 4 + 1).cast("string"), F.lit("-"), (F.col("id") % 5 + 3).cast("string"), F.lit("]."))
    return _items(s, d).select("id", text.citations(made).cast("array<bigint>").alias("cited"))


def transcript_clock(s, d):
    """Stamped lines of transcripts: seconds, and the stamp written anew."""
    lines = table(s, d, "raw_docs").where("scraper like 'media:%'").select("id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    stamp = F.regexp_extract("line", r"^\[(\d+(?::\d{2}){1,2})\]", 1)
    t = lines.select("id", "pos", stamp.alias("stamp")).where("stamp != ''")
    return t.select("id", "pos", "stamp", text.seconds(F.col("stamp")).alias("seconds"), text.clock(text.seconds(F.col("stamp"))).alias("clock"))


def iso_dates(s, d):
    day = F.col("published_at")
    forms = F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "d MMM yyyy"), F.date_format(day, "MMMM yyyy"), F.date_format(day, "yyyy"), F.lit("no date"))
    x = table(s, d, "raw_docs").where("published_at is not null").select("id", F.posexplode(forms).alias("form", "said"))
    return x.select("id", "form", text.iso_date(F.col("said")).alias("iso"))


def recency(s, d):
    x = table(s, d, "raw_docs").select("id", text.recency(F.date_format("published_at", "yyyy-MM-dd"), TODAY).alias("boost"))
    return x.groupBy("boost").agg(F.count("*").alias("pages"))


def region_items(s, d):
    """Items of each region by the country they extract; countries of no region under ''."""
    country = F.lower(F.trim(F.get_json_object("structured", "$.country")))
    rows = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(c).alias("c")) for r, cs in text.REGIONS.items() for c in cs])
    x = _items(s, d).select("id", country.alias("country"), F.filter(rows, lambda p: p["c"] == country).alias("m")).where("country is not null")
    return x.select(F.explode(F.when(F.size("m") > 0, F.transform("m", lambda p: p["region"])).otherwise(F.array(F.lit("")))).alias("region"), "id").groupBy("region").agg(F.count("*").alias("items"))


def local_days(s, d):
    local = F.from_utc_timestamp("created_at", "+06:00")
    return _chats(s, d).groupBy(F.date_format(local, "d MMM").alias("day")).agg(F.count("*").alias("exchanges"))


def cron_fires(s, d):
    """Minutes of two days in which each schedule fires."""
    minutes = s.range(0, 2 * 1440).select((F.lit(1767225600) + F.col("id") * 60).alias("t"))
    at = F.timestamp_seconds("t")
    out = None
    for expr in ("30 8 * * *", "*/15 9-10 * * 1-5", "0 0 1 * 0", "0 6,18 * 1 *"):
        x = minutes.where(text.cron_matches(expr, at)).select(F.lit(expr).alias("expr"), "t")
        out = x if out is None else out.unionByName(x)
    return out


def topic_lists(s, d):
    raw = F.concat(F.coalesce("title", F.lit("")), F.lit(" | ai,  chips ;AI chips| "), F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("")), F.lit(";x|y"))
    return _items(s, d).where(F.size("tags") > 0).select("id", text.topics(raw).alias("topics"))


def item_numbers(s, d):
    forms = F.array(F.lit("#3"), F.lit(" item 12 "), F.lit("No. 7"), F.lit("number 0"), F.lit("third"), F.concat(F.lit("no "), F.col("id").cast("string")))
    return table(s, d, "sources").select("id", F.posexplode(forms).alias("form", "said")).select("id", "form", text.item_number(F.col("said")).alias("number"))


def html_escaped(s, d):
    return _items(s, d).select("id", text.escaped(F.concat(F.coalesce("title", F.lit("")), F.lit(" <b>&</b>"))).alias("html"))


def tags_cleaned(s, d):
    return _items(s, d).select("id", text.clean_tags(F.concat("tags", F.array(F.lit(' {A}"b", '), F.lit("\\")))).alias("tags"))


def note_names(s, d):
    return _items(s, d).select("id", text.file_name(F.concat(F.col("title"), F.lit(": a/b?")), F.col("id")).alias("file"))


def snippets(s, d):
    return table(s, d, "doc_chunks").where("text is not null").select("raw_doc_id", "n", text.snippet(F.col("text"), ["market", "percent"], 200).alias("snippet"))


def sentence_counts(s, d):
    return table(s, d, "feed_items").dropDuplicates(["id"]).select("id", F.size(text.sentences(F.col("summary"))).alias("sentences"))


def shared_words(s, d):
    """Content words that an item's summary shares with its title."""
    a, b = text.content_words(F.col("summary"), STOP), text.content_words(F.col("title"), STOP)
    return _items(s, d).select("id", F.size(F.array_intersect(a, b)).alias("shared"))


def repeat_messages(s, d):
    """Events that repeat their user's last one within two minutes."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    return table(s, d, "events").select("event_id", "user_id", (F.col("ts") - before <= F.expr("interval 2 minutes")).alias("again")).where("again").select("event_id", "user_id")


def debounced_notices(s, d):
    """Users whose last error lies six hours or more before the end of the log: a new notice would be due."""
    last = table(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.where(F.col("last") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") - F.expr("interval 6 hours")).select("user_id")


def previous_exchange(s, d):
    """Each exchange with the one before it in its chat."""
    w = Window.partitionBy("chat_id").orderBy("created_at", "id")
    return _chats(s, d).select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


def last_turns(s, d):
    w = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("id"))
    return _chats(s, d).withColumn("k", F.row_number().over(w)).where("k between 3 and 4").select("chat_id", "id", "k")


def settings_pivot(s, d):
    """One row of one column per known setting, taken here from the feeds' kinds; blank where there is none."""
    pick = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("label"))), F.lit("")).alias(k)
    return table(s, d, "sources").agg(pick("rss"), pick("exa"), pick("none_such"))


def next_offset(s, d):
    return table(s, d, "events").agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next"))


def event_numbers(s, d):
    """Numbers out of JSON, by type."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("total"), F.count(k).alias("numbers"))


def one_edit_words(s, d):
    """Words of the chats that the passages don't have, with known words one edit away."""
    vocab = lexical.vocabulary((table(s, d, "doc_chunks"), "text"))
    asked = lexical.vocabulary((_chats(s, d), "question")).where(F.length("word") >= 4).select("word").join(vocab.select("word"), "word", "left_anti")
    return lexical.one_edit(asked, vocab).select("word", "cand", "ndoc")


def gate_rules(s, d):
    """Rules that a reply must or must not match, each with how many answers pass."""
    rules = [("names a figure", True, "[0-9]"), ("never unsure", False, r"\b(might|perhaps)\b"), ("has a full stop", True, r"\.")]
    out = None
    for name, must, pattern in rules:
        ok = F.coalesce(F.lower("answer").rlike(pattern), F.lit(False)) == F.lit(must)
        x = _chats(s, d).agg(F.count_if(ok).alias("passed"), F.count("*").alias("all")).select(F.lit(name).alias("rule"), "passed", "all")
        out = x if out is None else out.unionByName(x)
    return out


def page_rank(s, d):
    """Pages by how many topics find them, length and recency, at most two a host."""
    from quillmesh.functions.urls import host_of
    from quillmesh.operators.ranking import cap_per_group

    words = ["market", "court", "seed", "battery"]
    low = F.lower("markdown")
    found = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = 2 * found + F.when(F.length("markdown") > 3000, 1).otherwise(0) + text.recency(F.date_format("published_at", "yyyy-MM-dd"), TODAY)
    p = table(s, d, "raw_docs").select("id", host_of(F.col("canonical_url")).alias("host"), score.alias("score"))
    return cap_per_group(p, "host", [F.desc("score"), F.asc("id")], 2, 40)


def rulings(s, d):
    """Per company: confirmed if any item is strong, ruled out if all are weak, else unconfirmed."""
    company = F.lower(F.trim(F.get_json_object("structured", "$.company")))
    x = _items(s, d).select(company.alias("company"), "score").where("company is not null and company != ''")
    g = x.groupBy("company").agg(F.bool_or(F.col("score") >= 7).alias("yes"), F.bool_and(F.coalesce("score", F.lit(0)) <= 3).alias("no"), F.count("*").alias("items"))
    return g.select("company", F.when(F.col("yes"), "confirmed").when(F.col("no"), "ruled out").otherwise("unconfirmed").alias("ruling"), "items")


def overclaims(s, d):
    firm = r"\b(confirm(s|ed)?|verified|proven|guaranteed|certainly)\b"
    return _items(s, d).select("id", F.coalesce(F.lower("summary").rlike(firm), F.lit(False)).alias("firm"), F.regexp_replace("summary", r"(?i)\b(confirmed|verified|proven)\b", "reported").alias("softened"))


def caption_segments(s, d):
    """Caption events as JSON read into segments."""
    made = F.to_json(F.struct(F.array(F.struct((F.col("event_id") * 1000 + 500).alias("tStartMs"), F.array(F.struct(F.concat(F.lit(" a\n"), F.col("event_type")).alias("utf8")), F.struct(F.lit("  b").alias("utf8"))).alias("segs"))).alias("events")))
    doc = F.from_json(made, "events array<struct<tStartMs: bigint, segs: array<struct<utf8: string>>>>")
    e = table(s, d, "events").select("event_id", F.explode(doc["events"]).alias("e"))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda x: x["utf8"]), ""), r"\s+", " "))
    return e.select("event_id", F.round(F.col("e.tStartMs") / 1000.0, 2).alias("start"), joined.alias("text"))


QUERIES = {f.__name__: f for f in (
    figure_tokens, unsupported_figures, citation_ids, transcript_clock, iso_dates, recency, region_items, local_days, cron_fires, topic_lists, item_numbers, html_escaped, tags_cleaned, note_names, snippets, sentence_counts, shared_words,
    repeat_messages, debounced_notices, previous_exchange, last_turns, settings_pivot, next_offset, event_numbers, one_edit_words, gate_rules, page_rank, rulings, overclaims, caption_segments,
)}

_I = "(select distinct on (id) * from feed_items order by id)"
_C = "(select distinct on (id) * from chat_memory order by id)"
_STOP = ", ".join(f"'{w}'" for w in STOP)


def _unified(t: str) -> str:
    s = f"regexp_replace(lower(coalesce({t}, '')), '\\s+', ' ', 'g')"
    s = f"regexp_replace({s}, '[‐‑‒–—―−]', '-', 'g')"
    for _ in range(2):
        s = rf"regexp_replace({s}, '([0-9]),([0-9]{{3}})\b', '\1\2', 'g')"
    s = rf"regexp_replace({s}, '\$ ?', '', 'g')"
    for word, unit in text.UNITS.items():
        s = rf"regexp_replace({s}, '([0-9]) ?{word}\b', '\1{unit}', 'g')"
    return s


def _figures(t: str) -> str:
    w = f"list_filter(list_transform(regexp_split_to_array({_unified(t)}, '[^a-z0-9.%]+'), lambda w: regexp_replace(w, '^\\.+|\\.+$', '', 'g')), lambda w: regexp_matches(w, '^[0-9]+(\\.[0-9]+)?[%bmkx]?$'))"
    w = f"list_filter({w}, lambda w: not (regexp_matches(w, '^[0-9]+$') and (try_cast(w as double) <= 20 or try_cast(w as double) between 1990 and 2035)))"
    one = "case when regexp_matches(w, '[bmk]$') then round(regexp_extract(w, '^([0-9.]+)', 1)::double * case right(w, 1) when 'b' then 1e9 when 'm' then 1e6 else 1e3 end)::decimal(38,0)::varchar else w end"
    return f"list_distinct(list_transform({w}, lambda w: {one}))"


def _words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 4 and x not in ({_STOP})))"


_MON = "lpad(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], {0})::varchar, 2, '0')"
_NAMES = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_ISO = rf"""case when regexp_matches(s, '\b20[0-9]{{2}}-[0-9]{{2}}') then regexp_extract(s, '\b(20[0-9]{{2}})-([0-9]{{2}})', 1) || '-' || regexp_extract(s, '\b(20[0-9]{{2}})-([0-9]{{2}})', 2) || '-' || coalesce(nullif(regexp_extract(s, '\b20[0-9]{{2}}-[0-9]{{2}}-([0-9]{{2}})', 1), ''), '01')
  when regexp_matches(s, '\b[0-9]{{1,2}}\s+{_NAMES}[a-z]*\.?,?\s+20[0-9]{{2}}\b') then regexp_extract(s, '(20[0-9]{{2}})', 1) || '-' || {_MON.format(f"regexp_extract(s, '{_NAMES}', 1)")} || '-' || lpad(regexp_extract(s, '\b([0-9]{{1,2}})\s', 1), 2, '0')
  when regexp_matches(s, '\b{_NAMES}[a-z]*\.?\s+(?:[0-9]{{1,2}},?\s+)?20[0-9]{{2}}\b') then regexp_extract(s, '(20[0-9]{{2}})', 1) || '-' || {_MON.format(f"regexp_extract(s, '{_NAMES}', 1)")} || '-01'
  when regexp_matches(s, '\b20[0-9]{{2}}\b') then regexp_extract(s, '\b(20[0-9]{{2}})\b', 1) || '-06-30' else '' end"""
_BOOST = f"case when published_at is null or date '{TODAY}' - (published_at at time zone 'UTC')::date < -2 then 0 when date '{TODAY}' - (published_at at time zone 'UTC')::date <= 183 then 2 when date '{TODAY}' - (published_at at time zone 'UTC')::date <= 366 then 1 else 0 end"
_REGION_ROWS = ", ".join(f"('{r}', '{c}')" for r, cs in text.REGIONS.items() for c in cs)
_HOST = r"regexp_extract(lower(coalesce(canonical_url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
_VOCAB = "(select word, count(*) as ndoc from (select unnest(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'))) as word from {1}) where regexp_full_match(word, '[a-z]{{3,}}') group by 1)"
_L = "(select t, ts + interval 6 hours as l from (select 1767225600 + i * 60 as t, make_timestamp((1767225600 + i * 60) * 1000000) as ts from range(0, 2880) r(i)))"

SQL = {
    "figure_tokens": f"select id, list_sort({_figures('summary')}) as figures from {_I}",
    "unsupported_figures": f"select id, missing from (select i.id, list_sort(list_filter({_figures('i.summary')}, lambda f: not list_contains(d.k, f))) as missing from {_I} i join (select id, {_figures('markdown')} as k from raw_docs) d on d.id = i.raw_doc_id) where len(missing) > 0",
    "citation_ids": f"select id, list_concat([id % 7 + 1, id % 3 + 8], range(id % 4 + 1, id % 5 + 4)) as cited from {_I}",
    "transcript_clock": r"""select id, pos::int as pos, stamp, s::int as seconds, case when s >= 3600 then (s // 3600)::varchar || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') else (s // 60)::varchar end || ':' || lpad((s % 60)::varchar, 2, '0') as clock
      from (select id, pos, stamp, list_sum(list_transform(list_reverse(string_split(stamp, ':')), lambda p, i: p::int * 60 ** (i - 1)))::bigint as s from (select id, i - 1 as pos, regexp_extract(lines[i], '^\[(\d+(?::\d{2}){1,2})\]', 1) as stamp
      from (select id, lines, unnest(range(1, len(lines) + 1)) as i from (select id, string_split(markdown, chr(10)) as lines from raw_docs where scraper like 'media:%'))) where stamp <> '')""",
    "iso_dates": f"select id, form::int as form, {_ISO} as iso from (select id, unnest(range(0, 5)) as form, lower(unnest([strftime(p, '%Y-%m-%d'), strftime(p, '%-d %b %Y'), strftime(p, '%B %Y'), strftime(p, '%Y'), 'no date'])) as s from (select id, published_at at time zone 'UTC' as p from raw_docs where published_at is not null))",
    "recency": f"select ({_BOOST})::int as boost, count(*) as pages from raw_docs group by 1",
    "region_items": f"select coalesce(r.region, '') as region, count(*) as items from (select id, lower(trim(structured::json ->> '$.country')) as country from {_I}) i left join (values {_REGION_ROWS}) r(region, c) on r.c = i.country where country is not null group by 1",
    "local_days": f"select strftime(created_at at time zone 'UTC' + interval 6 hours, '%-d %b') as day, count(*) as exchanges from {_C} group by 1",
    "cron_fires": f"""select '30 8 * * *' as expr, t from {_L} where minute(l) = 30 and hour(l) = 8 union all select '*/15 9-10 * * 1-5', t from {_L} where minute(l) % 15 = 0 and hour(l) in (9, 10) and dayofweek(l) between 1 and 5
      union all select '0 0 1 * 0', t from {_L} where minute(l) = 0 and hour(l) = 0 and (day(l) = 1 or dayofweek(l) = 0) union all select '0 6,18 * 1 *', t from {_L} where minute(l) = 0 and hour(l) in (6, 18) and month(l) = 1""",
    "topic_lists": f"""select id, k[1:3] as topics from (select id, list_filter(k, lambda t, i: list_position(list_transform(k, lambda x: lower(x)), lower(t)) = i) as k from (select id, list_filter(list_transform(regexp_split_to_array(coalesce(title, '') || ' | ai,  chips ;AI chips| ' || coalesce(tags[1], '') || ';x|y', '[|;]'),
      lambda t: trim(regexp_replace(replace(t, ',', ' '), '\\s+', ' ', 'g'))), lambda t: t <> '') as k from {_I} where len(tags) > 0))""",
    "item_numbers": "select id, form::int as form, case when n <> '' and n::int >= 1 then n::int end as number from (select id, unnest(range(0, 6)) as form, regexp_extract(lower(unnest(['#3', ' item 12 ', 'No. 7', 'number 0', 'third', 'no ' || id])), '^\\s*(?:#|no\\.?\\s*|item\\s*|number\\s*)?([0-9]{1,3})\\s*$', 1) as n from sources)",
    "html_escaped": f"select id, replace(replace(replace(coalesce(title, '') || ' <b>&</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html from {_I}",
    "tags_cleaned": f"""select id, case when tags is not null then list_filter(list_transform(list_concat(tags, [' {{A}}"b", ', '\\'])[1:5], lambda t: trim(replace(replace(replace(replace(replace(lower(t), '{{', ''), '}}', ''), '"', ''), ',', ''), '\\', ''))), lambda t: t <> '') end as tags from {_I}""",
    "note_names": rf"""select id, coalesce(nullif(trim(left(trim(regexp_replace(regexp_replace(coalesce(title || ': a/b?', ''), '[\\/:*?"<>|#^\[\]]+', ' ', 'g'), '\s+', ' ', 'g')), 90)), ''), 'item ' || id) || '.md' as file from {_I}""",
    "snippets": """select raw_doc_id, n, case when length(text) <= 200 then text else case when st > 1 then '…' else '' end || substr(text, st, 200) || case when st + 200 <= length(text) then '…' else '' end end as snippet
      from (select raw_doc_id, n, text, greatest(1, coalesce(list_min(list_filter([strpos(lower(text), 'market'), strpos(lower(text), 'percent')], lambda p: p > 0)), 1) - 66) as st from doc_chunks where text is not null)""",
    "sentence_counts": rf"""select id, case when summary is null or trim(summary) = '' then 0 else len(list_filter(string_split(regexp_replace(trim(regexp_replace(summary, '\s+', ' ', 'g')), '([.!?](?:\s*\[[0-9, –-]+\])*)\s+([A-Z"“''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')) end::int as sentences from {_I}""",
    "shared_words": f"select id, len(list_intersect({_words('summary')}, {_words('title')}))::int as shared from {_I}",
    "repeat_messages": "select event_id, user_id from (select event_id, user_id, ts - lag(ts) over (partition by user_id, event_type order by ts, event_id) <= interval 2 minute as again from events) where again",
    "debounced_notices": "select user_id from events where event_type = 'error' group by 1 having max(ts) < timestamp '2024-01-29 18:00:00'",
    "previous_exchange": f"select id, lag(id) over w as before, lead(id) over w as after from {_C} window w as (partition by chat_id order by created_at, id)",
    "last_turns": f"select chat_id, id, k::int as k from (select chat_id, id, row_number() over (partition by chat_id order by created_at desc, id desc) as k from {_C}) where k between 3 and 4",
    "settings_pivot": "select coalesce(max(label) filter (where kind = 'rss'), '') as rss, coalesce(max(label) filter (where kind = 'exa'), '') as exa, coalesce(max(label) filter (where kind = 'none_such'), '') as none_such from sources",
    "next_offset": "select coalesce(max(event_id), 0) + 1 as next from events",
    "event_numbers": "select event_type, count(*) as events, sum(k) as total, count(k) as numbers from (select event_type, try_cast(props::json ->> '$.k' as double) as k from events) group by 1",
    "one_edit_words": f"""with v as {_VOCAB.format('text', 'doc_chunks')}, a as (select word from {_VOCAB.format('question', _C)} where length(word) >= 4 and word not in (select word from v))
      select word, cand, ndoc from (select a.word, v.word as cand, v.ndoc, row_number() over (partition by a.word order by v.ndoc desc, v.word) as k from a join v on damerau_levenshtein(a.word, v.word) = 1) where k <= 3""",
    "gate_rules": " union all ".join(f"select '{n}' as rule, count(*) filter (where coalesce(regexp_matches(lower(answer), '{p}'), false) = {m}) as passed, count(*) as \"all\" from {_C}" for n, m, p in [("names a figure", "true", "[0-9]"), ("never unsure", "false", r"\b(might|perhaps)\b"), ("has a full stop", "true", r"\.")]),
    "page_rank": f"""select id, host, score from (select *, row_number() over (partition by host order by score desc, id) as k from (select id, {_HOST} as host, (2 * (contains(lower(markdown), 'market')::int + contains(lower(markdown), 'court')::int + contains(lower(markdown), 'seed')::int + contains(lower(markdown), 'battery')::int)
      + case when length(markdown) > 3000 then 1 else 0 end + {_BOOST})::int as score from raw_docs)) where k <= 2 order by score desc, id limit 40""",
    "rulings": f"select company, case when bool_or(score >= 7) then 'confirmed' when bool_and(coalesce(score, 0) <= 3) then 'ruled out' else 'unconfirmed' end as ruling, count(*) as items from (select lower(trim(structured::json ->> '$.company')) as company, score from {_I}) where company is not null and company <> '' group by 1",
    "overclaims": rf"select id, coalesce(regexp_matches(lower(summary), '\b(confirm(s|ed)?|verified|proven|guaranteed|certainly)\b'), false) as firm, regexp_replace(summary, '(?i)\b(confirmed|verified|proven)\b', 'reported', 'g') as softened from {_I}",
    "caption_segments": "select event_id, round((event_id * 1000 + 500) / 1000.0::double, 2) as start, 'a ' || event_type || ' b' as text from events",
}
