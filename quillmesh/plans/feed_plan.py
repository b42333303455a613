"""Queries over feed items, stories, runs and passages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.urls import host_of
from quillmesh.operators import checks, ingest, ledger, lexical, ranking, research, search, state, stories, vectors
from quillmesh.session import materialize, table

NOW = "2026-04-25 00:00:00"
FAILED = "TRIAGE_FAILED"


def _items(s: SparkSession, d: str) -> DataFrame:
    return stories.items_once(table(s, d, "feed_items"))


def _us(c: str):
    return F.unix_micros(c).alias(c)


def _story_columns(v: DataFrame) -> DataFrame:
    return v.select("story_key", "articles", "score", "specificity", "angle_strength", "amount_usd", _us("first_published"), _us("last_published"), _us("created_at"), "run_id", "rep_id", "title", "canonical_url")


def story_view(s, d):
    return _story_columns(stories.story_view(_items(s, d), stories.root_key(F.col("id"), F.col("dup_of"))))


def story_view_structured(s, d):
    return _story_columns(stories.story_view(_items(s, d), stories.structured_key(F.col("structured"), F.col("id"))))


def story_urls(s, d):
    return stories.story_urls(_items(s, d), stories.root_key(F.col("id"), F.col("dup_of")))


def generated_score(s, d):
    return _items(s, d).select("id", stories.total_score(F.col("specificity"), F.col("angle_strength")).alias("score"), "specificity", "angle_strength")


def json_amounts(s, d):
    return _items(s, d).where("structured is not null").select("id", stories.amount(F.col("structured")).alias("amount"), F.get_json_object("structured", "$.round").alias("round"))


def deep_duplicates(s, d):
    return stories.deep_duplicates(_items(s, d))


def story_sizes(s, d):
    v = stories.story_view(_items(s, d), stories.root_key(F.col("id"), F.col("dup_of")))
    return v.groupBy("articles").agg(F.count("*").alias("stories"))


def run_status(s, d):
    return ledger.finished_runs(table(s, d, "runs"), table(s, d, "raw_docs"), _items(s, d), FAILED).select("id", "urls_new", "scraped", "made", "status")


def backlog(s, d):
    return ledger.backlog(table(s, d, "raw_docs"), _items(s, d), FAILED).select("id", "items", "failed")


def drain_batch(s, d):
    b = ledger.backlog(table(s, d, "raw_docs"), _items(s, d), FAILED)
    return b.orderBy("id").limit(12).select("id")


def backlog_when_idle(s, d):
    busy = ledger.live_runs(table(s, d, "runs"), NOW)
    return ledger.backlog(table(s, d, "raw_docs"), _items(s, d), FAILED).where(busy.scalar() == 0).select("id")


def pages_without_passages(s, d):
    return table(s, d, "raw_docs").select("id").join(table(s, d, "doc_chunks").select(F.col("raw_doc_id").alias("id")), "id", "left_anti")


def top_titles(s, d):
    ok = _items(s, d).where("run_id is not null").where(~F.col("summary").eqNullSafe(FAILED))
    best = F.max(F.struct("score", F.coalesce("relevance", F.lit(-1)).alias("r"), "id", "title")).alias("t")
    return ok.groupBy("run_id").agg(best, F.count("*").alias("items")).select("run_id", F.col("t.title").alias("title"), F.col("t.id").alias("id"), "items")


def repaired_runs(s, d):
    runs = table(s, d, "runs")
    return state.repair_runs(runs, NOW, "stopped", within="60 days").select("id", "status", "error")


def error_digest(s, d):
    """Per run: the distinct hosts of its pages, first five, and how many there are."""
    hosts = table(s, d, "raw_docs").where("run_id is not null").select("run_id", host_of(F.col("canonical_url")).alias("host")).where("host != ''").distinct()
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("host"))
    few = hosts.withColumn("k", rank).where("k <= 5").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("host")), ", ").alias("first"))
    return hosts.groupBy("run_id").agg(F.count("*").alias("hosts")).join(few, "run_id").select("run_id", "hosts", F.concat("first", F.when(F.col("hosts") > 5, ", …").otherwise("")).alias("digest"))


def last_runs(s, d):
    return table(s, d, "runs").orderBy(F.desc("id")).limit(5).select("id", F.lower("status").alias("status"), "urls_new")


def scorecard_by_source(s, d):
    return ledger.scorecard(_items(s, d), table(s, d, "seen_urls"), votes=_votes(s, d))


def scorecard_by_host(s, d):
    i = _items(s, d).where("dup_of is null").select(host_of(F.col("canonical_url")).alias("host"), "score")
    good, scored = F.count_if(F.col("score") >= 7), F.count_if(F.col("score") > 0)
    return i.groupBy("host").agg(F.count("*").alias("n"), good.alias("good"), scored.alias("scored"), F.coalesce(F.sum(F.when(F.col("score") > 0, F.col("score"))), F.lit(0)).alias("score_sum"))


def scorecard_by_feed(s, d):
    return ledger.feed_scorecard(_items(s, d), table(s, d, "seen_urls"), table(s, d, "sources").where("kind = 'rss'"))


def _votes(s, d):
    """Votes from the events table: one item each user, like for a click, dislike for an error; the last one counts."""
    e = table(s, d, "events").where("event_type in ('click', 'error')")
    v = e.select(F.col("user_id").alias("feed_item_id"), F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("vote"), F.col("ts").alias("updated_at"), "event_id")
    return state.last_write_wins(v, ["feed_item_id"], ["updated_at", "event_id"])


def latest_votes(s, d):
    return _votes(s, d).select("feed_item_id", "vote", "event_id")


def taste_examples(s, d):
    rank = F.row_number().over(Window.partitionBy("vote").orderBy(F.desc("updated_at"), F.desc("event_id")))
    v = _votes(s, d).withColumn("k", rank).where("k <= 6")
    return v.join(_items(s, d).select(F.col("id").alias("feed_item_id"), "title"), "feed_item_id").select("feed_item_id", "vote", "title", "k")


def boilerplate_passages(s, d):
    return lexical.boilerplate(table(s, d, "doc_chunks"), 2)


def vocabulary(s, d):
    i = _items(s, d).select(F.concat_ws(" ", "title", "summary").alias("text"))
    return lexical.vocabulary((table(s, d, "doc_chunks"), "text"), (i, "text"))


TOPICS = [(1, "spot market prices"), (2, "motion to dismiss"), (3, "seed round")]


def _topic_words(s):
    rows = [(o, w) for o, t in TOPICS for w in sorted(set(t.split()))]
    return s.createDataFrame(rows, "ord int, lex string")


def topic_idf(s, d):
    return lexical.idf(table(s, d, "doc_chunks"), _topic_words(s)).select("ord", "lex", F.round("idf", 6).alias("idf"))


def topic_coverage(s, d):
    c = table(s, d, "doc_chunks")
    cov = lexical.coverage(c, lexical.idf(c, _topic_words(s)), lexical.boilerplate(c, 3))
    return cov.where("cover >= 0.75").select("ord", "raw_doc_id", "n", F.round("cover", 6).alias("cover"))


def _probe(s, d):
    """Queries: every usable passage of the pages whose id is divisible by 100."""
    c = table(s, d, "doc_chunks").where(vectors.usable(F.col("embedding"), 64)).where("raw_doc_id % 100 = 0")
    return c.select(_passage_id(), F.col("embedding").alias("v")).withColumnRenamed("id", "q")


def _passage_id():
    """Page and number in one; a page has fewer than 2^20 passages."""
    return (F.shiftleft(F.col("raw_doc_id"), 20) + F.col("n")).alias("id")


def _keyed_passages(s, d):
    c = table(s, d, "doc_chunks").where(vectors.usable(F.col("embedding"), 64))
    return c.select(_passage_id(), F.col("embedding").alias("v"))


def nearest_passages(s, d):
    found = vectors.nearest(_probe(s, d), _keyed_passages(s, d), 40).where("rank <= 10")
    return found.select("q", F.shiftright("id", 20).alias("raw_doc_id"), F.col("id").bitwiseAND(F.lit(2**20 - 1)).cast("int").alias("n"), F.round("sim", 4).alias("sim"))


def _item_vectors(s, d):
    """Items with a stand-in for their own embedding: that of their page's first usable passage."""
    c = table(s, d, "doc_chunks").where(vectors.usable(F.col("embedding"), 64))
    first = c.groupBy("raw_doc_id").agg(F.min_by("embedding", "n").alias("v"))
    return _items(s, d).join(first, "raw_doc_id", "left")


def _topics(s, d):
    """Topics: the three most used tags, each with the vector of the first item that has it."""
    i = _item_vectors(s, d).select("id", "v", F.explode(F.array_distinct("tags")).alias("kw")).where("trim(kw) != ''")
    top = i.groupBy("kw").agg(F.count("*").alias("n"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("id"))).alias("v")).orderBy(F.desc("n"), "kw").limit(3)
    return materialize(top.select(F.row_number().over(Window.orderBy(F.desc("n"), "kw")).alias("ord"), "kw", "v"), "topics")


def hybrid_passages(s, d):
    """Passages by meaning and words, one best passage a page."""
    hits = search.page_hits(search.passage_pool(table(s, d, "doc_chunks"), _topics(s, d), 64))
    return hits.select("ord", "raw_doc_id", "pn", "pn2", F.round("pscore", 6).alias("pscore"))


def _searched(s, d, grouped: bool, filters, limit: int = search.LIMIT, topics=None):
    items = _item_vectors(s, d)
    view = stories.story_view(items.drop("v"), stories.root_key(F.col("id"), F.col("dup_of"))) if grouped else None
    topics = _topics(s, d) if topics is None else topics
    hits = search.passages_by_key(search.page_hits(search.passage_pool(table(s, d, "doc_chunks"), topics, 64)), items)
    return search.search(search.candidates(items, view, FAILED), topics, hits, filters, NOW, limit)


def _rows(found):
    return found.select("id", "ord", F.round("sim", 5).alias("sim"), "kw_hit", F.round("rel", 5).alias("rel"), F.col("rn").cast("int").alias("rn"), "outside", "pn", "pn2", "articles", "age_days", "outside_total")


def feed_search_items(s, d):
    """Every article, since a day and from a score on."""
    return _rows(_searched(s, d, False, search.in_filter(NOW, since="2025-06-01", min_score=5)))


def feed_search_stories(s, d):
    """One row a story, at most a year old."""
    return _rows(_searched(s, d, True, search.in_filter(NOW, max_age_days=365)))


def feed_search_unknown(s, d):
    """Stories have no relevance: with a filter on it they are in neither list, unless another filter fails."""
    return _rows(_searched(s, d, True, search.in_filter(NOW, since="2025-06-01", min_relevance=4)))


def feed_latest(s, d):
    """No topic: all items that pass, best first."""
    return _rows(_searched(s, d, False, search.in_filter(NOW, min_score=6), topics=_topics(s, d).limit(0)))


def feed_shown(s, d):
    """The searched list as it is shown, with evidence."""
    topics = _topics(s, d)
    words = [w for r in topics.collect() for w in r.kw.split() if len(w) > 2]  # three topics
    found = materialize(_searched(s, d, False, search.in_filter(NOW, min_score=4), topics=topics), "found")
    shown = search.shaped(found, table(s, d, "doc_chunks"), _items(s, d), words)
    return shown.select("n", "id", "outside", "match", "passage", "at", F.md5("evidence").alias("evidence"))


def feed_next(s, d):
    """The page after the first five of the same search, asked for with room for more."""
    found = materialize(_searched(s, d, False, search.in_filter(NOW), limit=search.PAGE + search.OVER), "found")
    shown = found.where("not outside").orderBy("ord", "rn").limit(search.PAGE).select("id")
    return search.next_page(found, shown)


def older_twin(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.nearest_older(e).select("id", "older", F.round("sim", 4).alias("sim"))


def twin_action(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    t = vectors.nearest_older(e).withColumn("sim", F.round("sim", 4))
    return t.select("id", vectors.band(F.col("sim"), 0.45, 0.40).alias("action")).groupBy("action").agg(F.count("*").alias("items"))


def twin_action_default(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.nearest_older(e).select(vectors.band(F.col("sim")).alias("action")).groupBy("action").agg(F.count("*").alias("items"))


def other_label_twin(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))
    return vectors.nearest_older(e, group="label").select("id", "older", F.round("sim", 4).alias("sim"))


def story_roots(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    t = vectors.nearest_older(e).where(F.round("sim", 4) >= 0.40).select("id", F.col("older").alias("parent"))
    return stories.roots(e.select("id").join(t, "id", "left"))


def vector_faults(s, d):
    v = F.col("embedding")
    kind = F.when(v.isNull(), "null").when(F.size(v) != 64, "length").when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.forall(v, lambda x: x == 0), "zero").otherwise("usable")
    return table(s, d, "doc_chunks").groupBy(kind.alias("kind")).agg(F.count("*").alias("passages"))


def recall_top3(s, d):
    """Of every exchange whose id is divisible by 100: the three nearest others of its chat, then those of at least 0.3."""
    m = table(s, d, "chat_memory").dropDuplicates(["id"]).where(vectors.usable(F.col("embedding"), 64)).select("id", "chat_id", "embedding")
    q = m.where("id % 100 = 0").select(F.col("id").alias("asked"), "chat_id", F.col("embedding").alias("v"))
    sims = m.join(q, "chat_id").where("id != asked").select("asked", "id", F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("sim"), "id"))
    return sims.withColumn("k", rank).where("k <= 3 and sim >= 0.3").select("asked", "id", F.round("sim", 4).alias("sim"))


def topic_brief(s, d):
    """The first page of new stories on the most used tag: by its words, or by meaning through the last item of their URL."""
    topics = _topics(s, d).where("ord = 1")
    view = stories.story_view(_items(s, d), stories.root_key(F.col("id"), F.col("dup_of"))).where(F.col("created_at") >= F.lit("2026-01-01 00:00:00").cast("timestamp"))
    c = search.candidates(_item_vectors(s, d), view, FAILED).crossJoin(F.broadcast(topics.select("kw", F.col("v").alias("qv")).limit(1)))
    words = F.forall(lexical.tokens(F.col("kw")), lambda w: F.array_contains(lexical.tokens(F.concat_ws(" ", "title", "summary", "angle", F.array_join("tags", " "))), w))
    met = c.where(words | (F.coalesce(vectors.cosine(F.col("v"), F.col("qv")), F.lit(-1.0)) >= search.SIM))
    page = ranking.page_of(met, [F.desc_nulls_last("score"), F.desc("created_at"), F.asc("match_key")], 0)
    return page.select("match_key", "title", "score", "articles").withColumn("total", met.agg(F.count("*")).scalar())


def nested_caps(s, d):
    """Items in order of score, at most four a run, two a company, thirty in all."""
    company = F.lower(F.trim(F.get_json_object("structured", "$.company")))
    i = _items(s, d).where("run_id is not null").select("id", "run_id", "score", F.coalesce(F.nullif(company, F.lit("")), F.concat(F.lit("item "), "id")).alias("entity"))
    return ranking.nested_caps(i, "run_id", "entity", [F.desc("score"), F.asc("id")]).select("id", "run_id", "entity", "score")


def run_lists(s, d):
    """The latest runs with their three best items as one JSON list."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "id"))
    top = _items(s, d).where("run_id is not null").withColumn("k", rank).where("k <= 3")
    return top.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "id", "score")))).alias("items"))


def silent_polls(s, d):
    """New records by whether their feed was polled before: those of a first poll are only marked as seen."""
    fresh = ingest.dedupe_batch(table(s, d, "url_batches").dropDuplicates(["rec_id"]), table(s, d, "seen_urls"))
    feeds = table(s, d, "sources").where("kind = 'rss'").groupBy(F.concat(F.lit("rss:"), F.regexp_extract(host_of(F.col("url")), r"([a-z0-9-]+)[.][a-z]+$", 1)).alias("name")).agg(F.max("bootstrapped_at").alias("bootstrapped_at"))
    return ingest.first_polls(fresh, feeds).groupBy("silent").agg(F.count("*").alias("records"), F.count_distinct("source").alias("sources"))


def claimed_saves(s, d):
    """Saves still to be written: every item with a vote that no like was recorded for, after the failed ones were released."""
    votes = _votes(s, d)
    saves = votes.where("vote = 1").select("feed_item_id")
    failed = saves.where("feed_item_id % 10 = 0")
    return checks.claimed(votes.select("feed_item_id"), research.released(saves, failed))


def brief_windows(s, d):
    """From when a brief after each chat's last exchange tells, by days asked for or since the one before."""
    c = table(s, d, "chat_memory").dropDuplicates(["id"]).groupBy("chat_id").agg(F.max("created_at").alias("now"), F.min("created_at").alias("first"), F.count("*").alias("n"))
    days = F.when(F.col("n") % 3 == 0, F.lit(2))
    last = F.when(F.col("n") % 3 == 1, F.col("first"))
    return c.select("chat_id", F.unix_micros(checks.brief_window(last, days, F.col("now"))).alias("since"))


def held_lease(s, d):
    """Who holds each source kind's lease when all ask again a day after the last feed was added."""
    held = table(s, d, "sources").groupBy(F.col("kind").alias("key")).agg(F.max_by("url", F.struct("created_at", "id")).alias("value"), F.max("created_at").alias("updated_at"))
    return state.take_lease(held, "rss", "next", "2027-01-01 00:00:00").select("key", "value")


def brief_page(s, d):
    v = stories.story_view(_items(s, d), stories.root_key(F.col("id"), F.col("dup_of")))
    v = v.where((F.col("created_at") >= F.lit("2026-01-01 00:00:00").cast("timestamp")) & ~F.col("summary").eqNullSafe(FAILED))
    total = v.agg(F.struct(F.count("*").alias("total"), F.count_if(F.col("score") >= 7).alias("good")).alias("t")).scalar()
    page = ranking.page_of(v, [F.desc_nulls_last("score"), F.desc("created_at"), F.asc("rep_id")], 1)
    return page.withColumn("t", total).select("rep_id", "title", "score", "articles", "t.total", "t.good")


def filtered_items(s, d):
    """Three-valued filters: rows whose filter is unknown are in neither list."""
    f = (F.coalesce("published_at", "created_at") >= F.lit("2025-06-01 00:00:00").cast("timestamp")) & (F.col("relevance") >= 4) & (F.col("score") >= 6)
    side = F.when(f, "listed").when(~f, "outside").otherwise("neither")
    return _items(s, d).where(~F.col("summary").eqNullSafe(FAILED)).groupBy(side.alias("side")).agg(F.count("*").alias("items"))


def feed_list(s, d):
    """Topic words against the items: quota per topic, in order of topic and rank."""
    words = _topic_words(s)
    need = words.groupBy("ord").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 0.6)).alias("need"))
    text = F.concat_ws(" ", "title", "summary", "angle", F.array_join("tags", " "))
    i = _items(s, d).where(~F.col("summary").eqNullSafe(FAILED))
    hits = i.select("id", "score", "published_at", F.explode(lexical.tokens(text)).alias("lex")).join(F.broadcast(words), "lex").groupBy("ord", "id", "score", "published_at").agg(F.count("*").alias("hits"))
    met = hits.join(F.broadcast(need), "ord").where("hits >= need")
    first = met.groupBy("id").agg(F.min(F.struct("ord", "score", "published_at", "hits")).alias("m")).select("id", "m.*").withColumn("in_filter", F.lit(True))
    listed = ranking.fair_share(first, len(TOPICS), 20, [F.desc("hits"), F.desc_nulls_last("score"), F.desc_nulls_last("published_at"), F.asc("id")])
    return listed.select("ord", "id", "hits", "rn")


def feed_item_page(s, d):
    """The third item of a stored list with its page: its passages joined, else the page's text."""
    ids = _items(s, d).orderBy("id").limit(7).select("id")
    chosen = ids.agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.try_element_at("ids", F.lit(3)).alias("id"))
    item = _items(s, d).join(F.broadcast(chosen), "id")
    text = table(s, d, "doc_chunks").join(F.broadcast(item.select("raw_doc_id")), "raw_doc_id").groupBy("raw_doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"))
    page = F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), F.lit(6000))
    return item.join(text, "raw_doc_id", "left").join(table(s, d, "raw_docs").select(F.col("id").alias("raw_doc_id"), "markdown"), "raw_doc_id", "left").select("id", "title", F.coalesce(page, F.left("markdown", F.lit(6000))).alias("page"))


def list_positions(s, d):
    """Positions 2, 4 and 5 of the list of every run's items."""
    lists = _items(s, d).where("run_id is not null").groupBy("run_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.select("run_id", F.posexplode("ids").alias("k", "id")).select("run_id", (F.col("k") + 1).alias("pos"), "id").where("pos in (2, 4, 5)")


def joined_passages(s, d):
    p = table(s, d, "doc_chunks").groupBy("raw_doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"))
    return p.select("raw_doc_id", F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), F.lit(1500)).alias("text"), F.size("p").alias("passages"))


def reranked(s, d):
    """Every second item of a ranked list has a score and moves among the places of those."""
    rows = _items(s, d).orderBy(F.desc_nulls_last("score"), "id").limit(12).select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "id")).alias("place"))
    rows = materialize(rows, "rows")
    scores = rows.where("place % 2 = 0").select("id", (F.col("id") % 7).cast("double").alias("score"))
    return ranking.rerank_in_place(rows, scores, "id", "place").select("id", "place")


def passing_mentions(s, d):
    sim, psim = (F.col("score") % 5) / 8.0, (F.col("relevance") % 3) / 4.0
    p = ranking.passing_mention(F.col("angle").isNotNull(), F.col("title").contains("market"), sim, F.when(F.col("id") % 2 == 0, sim / 2), psim)
    return _items(s, d).select("id", F.coalesce(p, F.lit(False)).alias("passing"))


def source_numbers(s, d):
    order = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("published_at"), "id")
    return table(s, d, "raw_docs").where("run_id is not null").select("run_id", "id", F.row_number().over(order).alias("number"))


def stable_sample(s, d):
    rank = F.row_number().over(Window.partitionBy("scraper").orderBy(F.md5(F.col("id").cast("string")), "id"))
    return table(s, d, "raw_docs").select("scraper", "id").withColumn("k", rank).where("k <= 3")


def pass_cut(s, d):
    most = F.when(F.col("scraper").startswith("media:"), 60000).when(F.col("scraper") == "exa", 6000).when(F.col("scraper").startswith("upload:"), 8000).otherwise(2500)
    return table(s, d, "raw_docs").select("id", F.length(F.left("markdown", most)).alias("read"))


def passage_text(s, d):
    c = table(s, d, "doc_chunks").join(table(s, d, "raw_docs").select(F.col("id").alias("raw_doc_id"), "title"), "raw_doc_id")
    foreign = F.length(F.regexp_replace("text", r"[\x00-\x7F]", ""))
    body = F.when(foreign > F.length("text") * 0.3, F.left("text", F.lit(1500))).otherwise(F.col("text"))
    head = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.left(F.trim("title"), F.lit(200)), F.lit("\n"))).otherwise("")
    return c.select("raw_doc_id", "n", F.md5(F.concat(head, body)).alias("digest"), foreign.alias("foreign"))


def item_texts(s, d):
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    return _items(s, d).select("id", F.left(F.concat_ws("\n", "title", "summary", "angle", tags), F.lit(6000)).alias("text"))


def replaced_items(s, d):
    """Items of the failed pages replaced by one fresh row each."""
    i = _items(s, d).select("id", "raw_doc_id", "summary")
    again = i.where(F.col("summary") == FAILED).select((F.col("id") + 1_000_000).alias("id"), "raw_doc_id", F.lit("read again").alias("summary"))
    return state.replace_by_key(i, again, "raw_doc_id").groupBy("summary").agg(F.count("*").alias("items")).where("summary in ('read again', 'TRIAGE_FAILED')")


def cascade(s, d):
    i = _items(s, d).select("id", "dup_of")
    roots = i.where("dup_of is not null").select(F.col("dup_of").alias("id")).distinct()
    return state.delete_cascade(i, roots, "id", "dup_of")


def reactivated_sources(s, d):
    base = table(s, d, "sources").select("url", "label", "active")
    delta = base.where("not active").select("url", F.lit(" ").alias("label")).unionByName(s.createDataFrame([("https://new.example/feed", "New")], "url string, label string"))
    return state.reactivate(base, delta, "url", "label", "active")


def switched_off(s, d):
    return state.switch_off(table(s, d, "sources"), F.col("url").contains("atom")).select("id", "active")


def failures_bumped(s, d):
    failed = _items(s, d).where(F.col("summary") == FAILED).select(F.col("raw_doc_id").alias("id"))
    return state.bump(table(s, d, "raw_docs").select("id", "triage_failures"), failed, "id", "triage_failures").where("triage_failures > 0").select("id", F.col("triage_failures").cast("long").alias("triage_failures"))


def vocabulary_added(s, d):
    a = lexical.vocabulary((table(s, d, "doc_chunks").where("raw_doc_id % 2 = 0"), "text"))
    b = lexical.vocabulary((table(s, d, "doc_chunks").where("raw_doc_id % 2 = 1"), "text"))
    return state.add_counts(a, b, ["word"], "ndoc")


def evaluation_grid(s, d):
    """Hits over a grid of cutoffs, for the items' own scores as labels."""
    grid = F.array(*[F.struct(F.lit(a / 10).alias("cutoff"), F.lit(b).alias("weight")) for a in (2, 4, 6) for b in (1, 2)])
    i = _items(s, d).where("relevance is not null").select((F.col("score") / 10.0).alias("x"), "relevance", (F.col("relevance") >= 4).alias("wanted"), F.inline(grid))
    met = i.withColumn("hit", F.col("x") + F.col("weight") * 0.01 * F.col("relevance") >= F.col("cutoff"))
    return met.groupBy("cutoff", "weight").agg(F.count_if(F.col("hit") & F.col("wanted")).alias("right"), F.count_if(F.col("hit") & ~F.col("wanted")).alias("wrong"))


QUERIES = {f.__name__: f for f in (
    story_view, story_urls, story_view_structured, generated_score, json_amounts, deep_duplicates, story_sizes, run_status, backlog, drain_batch, backlog_when_idle, pages_without_passages, top_titles, repaired_runs, error_digest, last_runs,
    scorecard_by_source, scorecard_by_host, scorecard_by_feed, latest_votes, taste_examples, boilerplate_passages, vocabulary, topic_idf, topic_coverage, nearest_passages, hybrid_passages, older_twin, twin_action, twin_action_default, other_label_twin, story_roots,
    vector_faults, recall_top3, topic_brief, nested_caps, run_lists, silent_polls, claimed_saves, brief_windows, held_lease, brief_page, feed_search_items, feed_search_stories, feed_search_unknown, feed_latest, feed_shown, feed_next, filtered_items, feed_list, feed_item_page, list_positions, joined_passages, reranked, passing_mentions, source_numbers, stable_sample, pass_cut, passage_text, item_texts,
    replaced_items, cascade, reactivated_sources, switched_off, failures_bumped, vocabulary_added, evaluation_grid,
)}

from quillmesh.plans.feed_sql import SQL  # noqa: E402, F401
