"""Queries that check answers against evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import stem
from quillmesh.operators import checks, stories
from quillmesh.session import table

STOP = ["that", "this", "with", "from", "have", "were", "been", "they", "their", "would", "could", "about", "which"]


def _items(s, d):
    return stories.items_once(table(s, d, "feed_items"))


def quoted_summaries(s, d):
    """Whether each item's summary stands on its page word for word."""
    p = table(s, d, "raw_docs").select(F.col("id").alias("raw_doc_id"), "markdown")
    return _items(s, d).join(p, "raw_doc_id").select("id", F.coalesce(checks.quote_found(F.col("summary"), F.col("markdown")), F.lit(False)).alias("found"))


def near_names(s, d):
    """Pages on which the words 'market' and 'percent' stand near each other."""
    return table(s, d, "raw_docs").select("id", checks.near_each_other(F.col("markdown"), F.lit("market"), F.lit("percent"), 60).alias("near")).where("near").select("id")


def cited_answers(s, d):
    """Runs' first item as an answer that cites two items, checked against the run's items."""
    i = _items(s, d).where("run_id is not null and summary is not null").select("run_id", "id", "summary")
    first = i.groupBy("run_id").agg(F.min(F.struct("id", "summary")).alias("f"))
    answers = first.select(F.col("run_id").alias("answer"), F.concat("f.summary", F.lit(" It cost 77,123 dollars [1]. Nothing like it was seen elsewhere [9].")).alias("text"))
    ev = first.select(F.col("run_id").alias("answer"), F.lit(1).alias("n"), F.col("f.summary").alias("evidence"))
    return checks.checked_sentences(answers, ev)


def best_quotes(s, d):
    """The passage sentence that shares most content words with each item's angle, within its page."""
    claims = _items(s, d).where("angle is not null").select(F.col("id").alias("claim"), F.col("raw_doc_id").alias("topic"), F.col("angle").alias("text"))
    return checks.best_quotes(claims, table(s, d, "doc_chunks").select(F.col("raw_doc_id").alias("topic"), "text"), STOP)


def kept_filters(s, d):
    f = checks.kept_filters(F.col("question"), F.lit("6"), F.lit("7"), F.lit(None).cast("string"))
    return table(s, d, "chat_memory").dropDuplicates(["id"]).groupBy(F.array_join(f["dropped"], "+").alias("dropped")).agg(F.count("*").alias("messages"))


def packed_vectors(s, d):
    v = F.array(F.col("embedding").cast("array<double>"), F.lit(None).cast("array<double>"))
    p = checks.packed_vectors(v)
    return table(s, d, "embeddings").select("vec_id", F.size(F.split(p, " ")).alias("numbers"), (F.get(checks.unpacked_vectors(p), 0) == F.col("embedding").cast("array<double>")).alias("same"))


def valid_replies(s, d):
    """Items written as model replies and read back: which are valid."""
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("summary", "angle", "relevance", "specificity", "angle_strength", "tags")), F.lit("\n```"))
    return _items(s, d).select("id", checks.read_reply(reply, F.lit(None).cast("string")).isNotNull().alias("valid"))


def outdated_items(s, d):
    """Runs all of whose dated items lie before 2025-06-01."""
    g = _items(s, d).where("run_id is not null").groupBy("run_id").agg(F.collect_list(F.date_format("published_at", "yyyy-MM-dd")).alias("dates"))
    return g.select("run_id", checks.all_before(F.col("dates"), "2025-06-01").alias("before"))


def investor_rank(s, d):
    """Per round: the four investors with the most items, funds at three tenths."""
    j = F.from_json("structured", "round string, company string, investors array<string>")
    x = _items(s, d).select("id", j.alias("j")).select(F.lower(F.trim("j.round")).alias("topic"), F.explode("j.investors").alias("entity"), F.col("id").alias("page")).where("topic is not null and trim(entity) != ''")
    return checks.ranked_entities(x.withColumn("candidate", F.lit(False)), "fund$").select("topic", "entity", F.round("weight", 4).alias("weight"))


def linked_owner(s, d):
    """Per source of the url records: the owner and name that its links lead to most, from three links on."""
    u = table(s, d, "url_batches").dropDuplicates(["rec_id"]).where("source is not null")
    return checks.named_owner(u.select(F.col("source").alias("topic"), F.col("url").alias("text")))


def item_notes(s, d):
    return checks.notes(_items(s, d), "2026-04-25").select("file", F.md5("note").alias("digest"))


def headlines(s, d):
    return table(s, d, "doc_chunks").select("raw_doc_id", "n", checks.headline(F.col("text"), ["market", "court"]).alias("headline")).where("headline is not null")


def stemmed_vocabulary(s, d):
    return table(s, d, "doc_chunks").select(F.explode(stem.lexemes(F.col("text"), ["the", "and", "of", "to"])).alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("ndoc"))


def list_mentions(s, d):
    """Items whose summary names two others of the same run's tags: weak evidence."""
    runs = _items(s, d).where("run_id is not null").select("run_id", F.explode("tags").alias("t")).groupBy("run_id").agg(F.array_sort(F.collect_set("t")).alias("names"))
    return _items(s, d).join(runs, "run_id").select("id", F.coalesce(checks.list_mention(F.col("summary"), F.try_element_at("tags", F.lit(1)), F.col("names")), F.lit(False)).alias("weak"))


def counted_replies(s, d):
    """Each run's items as a numbered reply that says it has ten, set right."""
    lines = F.concat_ws("\n", F.lit("Here are 10 items:"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("id")), 1, 15), lambda i, k: F.concat((k + 1).cast("string"), F.lit(". item "), i.cast("string"))), "\n"))
    made = _items(s, d).where("run_id is not null").groupBy("run_id").agg(lines.alias("reply"))
    return made.select("run_id", F.substring_index(checks.counted_reply(F.col("reply")), "\n", 1).alias("head"))


QUERIES = {f.__name__: f for f in (quoted_summaries, near_names, cited_answers, best_quotes, kept_filters, packed_vectors, valid_replies, outdated_items, investor_rank, linked_owner, item_notes, headlines, stemmed_vocabulary, list_mentions, counted_replies)}

_I = "(select distinct on (id) * from feed_items order by id)"
_P = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in STOP)
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 4 and x not in (" + _STOP + ")))"
_SENT = r"""list_filter(string_split(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '([.!?](?:\s*\[[0-9, –-]+\])*)\s+([A-Z"“''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"""
_QUALITY = r"\b(good|best|top|great|worth|important|interesting|strong|quality|high-?scor\w*|scored?|rated|must-read)\b"
_TIME = r"\b(today|tonight|yesterday|week(end)?|month|year|recent(ly)?|latest|new(est)?|lately|hours?|days?|since|past|last|this|ago|fresh|current(ly)?|20[0-9]{2})\b"

_FIRST = f"(select run_id, arg_min(summary, id) as summary from {_I} where run_id is not null and summary is not null group by 1)"
_SAID = f"(select run_id as answer, summary, unnest(range(len(ss))) as k, ss from (select run_id, summary, {_SENT.format(chr(39).join(['summary || ', ' It cost 77,123 dollars [1]. Nothing like it was seen elsewhere [9].', '']))} as ss from {_FIRST}))"

SQL = {
    "counted_replies": f"select run_id, 'Here are ' || least(count(*), 15) || ' items:' as head from {_I} where run_id is not null group by 1",
    "near_names": "select id from raw_docs where regexp_matches(lower(markdown), 'market[\\s\\S]{0,54}percent|percent[\\s\\S]{0,53}market')",
    "linked_owner": """select topic, owner, links from (select *, row_number() over (partition by topic order by links desc, owner) as k from (select topic, owner, count(*) as links from
      (select source as topic, unnest(regexp_extract_all(url, 'https?://(?:www\\.)?[a-z0-9.-]+/([A-Za-z0-9_-]+/[A-Za-z0-9_.-]+)', 1)) as owner from (select distinct on (rec_id) * from url_batches order by rec_id) where source is not null) group by 1, 2) where links >= 3) where k = 1""",
    "cited_answers": f"""select answer, k::int as k, ss[k + 1] as sentence, case when contains(ss[k + 1], '[9]') then 'no such item' when contains(ss[k + 1], '[1]') then 'figures: 77123' else 'no source' end as problem from {_SAID} where length(ss[k + 1]) >= 25 or contains(ss[k + 1], '[')""",
    "quoted_summaries": f"""select i.id, coalesce(len(p) > 0 and len(list_filter(p, lambda x: not contains(page, x))) = 0, false) as found from (select id, raw_doc_id, case when summary is not null then list_filter(list_transform(regexp_split_to_array(summary, '…|\\.\\.\\.'),
      lambda x: {_P.format('x')}), lambda x: length(x) >= 8) end as p from {_I}) i join (select id as raw_doc_id, {_P.format('markdown')} as page from raw_docs) d using (raw_doc_id)""",
    "best_quotes": f"""with c as (select id as claim, raw_doc_id as topic, unnest({_WORDS.format('angle')}) as w from {_I} where angle is not null), q as (select distinct topic, quote from (select raw_doc_id as topic, unnest({_SENT.format('text')}) as quote from doc_chunks) where length(quote) between 30 and 300),
      b as (select topic, quote, unnest({_WORDS.format('quote')}) as w from q), m as (select claim, quote, count(*) as shared from c join b using (topic, w) group by 1, 2 having count(*) >= 3)
      select claim, quote, shared from (select *, row_number() over (partition by claim order by shared desc, quote) as k from m) where k = 1""",
    "kept_filters": f"""select concat_ws('+', case when m <> '' and not regexp_matches(m, '{_QUALITY}') then 'min_score' end, case when m <> '' and not regexp_matches(m, '{_TIME}') then 'max_age_days' end) as dropped, count(*) as messages
      from (select lower(trim(coalesce(question, ''))) as m from (select distinct on (id) * from chat_memory order by id)) group by 1""",
    "packed_vectors": "select vec_id, 64 as numbers, true as same from embeddings",
    "valid_replies": f"select id, coalesce(summary is not null and relevance between 1 and 5 and specificity between 1 and 5 and angle_strength between 1 and 5 and len(tags) >= 1, false) as valid from {_I}",
    "outdated_items": f"select run_id, count(published_at) > 0 and coalesce(max(published_at) < timestamptz '2025-06-01 00:00:00+00', false) as before from {_I} where run_id is not null group by 1",
    "investor_rank": f"""with x as (select lower(trim(structured::json ->> '$.round')) as topic, unnest(from_json(structured::json -> '$.investors', '["VARCHAR"]')) as entity, id from {_I} where structured is not null and json_type(structured::json, '$.investors') = 'ARRAY'),
      g as (select topic, entity, count(distinct id) * case when regexp_matches(lower(entity), 'fund$') then 0.3::double else 1.0::double end as weight from x where topic is not null and trim(entity) <> '' group by 1, 2)
      select topic, entity, round(weight, 4) as weight from (select *, row_number() over (partition by topic order by weight desc, entity) as k from g) where k <= 4""",
    "list_mentions": f"""with r as (select run_id, list_sort(list_distinct(list(t))) as names from (select run_id, unnest(tags) as t from {_I} where run_id is not null) group by 1)
      select id, coalesce(len(list_filter(names, lambda n: lower(n) <> lower(tags[1]) and contains(lower(summary), lower(n)))) >= 2, false) as weak from {_I} i join r using (run_id)""",
}
