"""Search of the feed by meaning and words, through items, stories and passages (R-1 to R-4, J-3, J-8, J-9, F-1, F-2, F-8, U-2, T-12, W-1 to W-6).

Topics are a query's parameters: at most a few, each with its words and, if it could be embedded, a vector. They are
checked to be no more than TOPICS and then broadcast; items and passages are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import lexical, ranking, vectors
from quillmesh.session import materialize

# Cutoffs and weights of the search, and how many rows are kept where.
SIM, BOOST, PASSAGE, POOL = 0.45, 0.15, 0.05, 40
LIMIT, OUTSIDE, FULL, PAGE, OVER = 20, 5, 3, 5, 10
EVIDENCE, SNIPPET = 2600, 450
#: Most topics of one search.
TOPICS = 1000


def checked_topics(topics: DataFrame) -> DataFrame:
    """The topics (ord, kw, v), refused if they are too many to be a query's parameters."""
    if topics.limit(TOPICS + 1).count() > TOPICS:
        raise ValueError(f"more than {TOPICS} topics")
    return topics


def topic_words(topics: DataFrame) -> DataFrame:
    """(ord, lex): the words of each topic but ``ai``, which stands for nothing by itself."""
    return topics.select("ord", F.explode(lexical.tokens(F.col("kw"))).alias("lex")).where("lex != 'ai'")


def keyword_hit(tags: Column, text: Column, kw: Column) -> Column:
    """Whether a tag contains the topic, or six tenths of the topic's words (one at least) are among the text's tokens."""
    words = F.filter(lexical.tokens(kw), lambda w: w != "ai")
    met = F.size(F.array_intersect(words, text))
    tagged = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.contains(F.lower(kw)))
    return F.coalesce(tagged, F.lit(False)) | (met >= F.greatest(F.lit(1), F.ceil(F.size(words) * 0.6)))


def in_filter(now: str, since: str | None = None, min_relevance: int | None = None, min_score: int | None = None, max_age_days: int | None = None) -> Column:
    """The filters that are set, all of them; unknown where a row has no value for one and fails no other."""
    at = F.coalesce("published_at", "created_at")
    out = F.lit(True)
    if since is not None:
        out = out & (at >= F.lit(since).cast("timestamp"))
    if min_relevance is not None:
        out = out & (F.col("relevance") >= min_relevance)
    if min_score is not None:
        out = out & (F.col("score") >= min_score)
    if max_age_days is not None:
        out = out & (at >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(max_age_days)))
    return out


def age_days(now: str) -> Column:
    """Whole days since publication, 0 for the future, null for undated rows."""
    days = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("published_at")) / 86400).cast("int")
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))


def candidates(items: DataFrame, stories: DataFrame | None, failed: str) -> DataFrame:
    """What is searched: every item, or with ``stories`` (a story view) one row a story, whose relevance is unknown.

    ``items`` are told by id and may have a vector ``v``; a story takes id and vector of the last item under its URL.
    """
    ok = ~F.col("summary").eqNullSafe(failed)
    shown = ["id", "canonical_url", "title", "summary", "angle", "relevance", "score", "tags", "created_at", "published_at", "articles", "v", "match_key"]
    if stories is None:
        return items.where(ok).withColumn("articles", F.lit(1).cast("long")).withColumn("match_key", F.concat(F.lit("it:"), F.col("id"))).select(*shown)
    last = items.groupBy("canonical_url").agg(F.max(F.struct("id", "v")).alias("i"))
    s = stories.where(ok).join(last, "canonical_url", "left").withColumn("relevance", F.lit(None).cast("int"))
    return s.select(F.col("i.id").alias("id"), "canonical_url", "title", "summary", "angle", "relevance", "score", "tags", "created_at", F.col("last_published").alias("published_at"), "articles", F.col("i.v").alias("v"), F.col("story_key").alias("match_key"))


def passage_pool(passages: DataFrame, topics: DataFrame, dim: int, pages: int = 3) -> DataFrame:
    """(ord, raw_doc_id, n, sim, cover, pscore, hit): the POOL nearest passages of each topic and those with its words; boilerplate stays out."""
    boiler = lexical.boilerplate(passages, pages).select("text_md5")
    keyed = passages.where(vectors.usable(F.col("embedding"), dim)).withColumn("text_md5", F.md5("text")).join(boiler, "text_md5", "left_anti")
    # a page has fewer than 2^20 passages, so both numbers fit into one
    keyed = keyed.select((F.shiftleft(F.col("raw_doc_id"), 20) + F.col("n")).alias("id"), F.col("embedding").alias("v"))
    near = vectors.nearest(topics.where("v is not null").select(F.col("ord").cast("long").alias("q"), "v"), keyed, POOL)
    near = near.select(F.col("q").cast("int").alias("ord"), F.shiftright("id", 20).alias("raw_doc_id"), F.col("id").bitwiseAND(F.lit(2**20 - 1)).cast("int").alias("n"), "sim")
    words = lexical.coverage(passages, lexical.idf(passages, topic_words(topics)), boiler)
    return materialize(lexical.merge_candidates(near, words, keep_all=True), "pool")  # for the best passage of a page and the next


def page_hits(pool: DataFrame) -> DataFrame:
    """(ord, raw_doc_id, pn, psim, pcover, pscore, pn2): the best passage of each topic and page that counts, and the page's next best of all."""
    order = [F.desc("pscore"), F.asc("n")]
    by = Window.partitionBy("ord", "raw_doc_id")
    best = pool.where("hit").withColumn("k", F.row_number().over(by.orderBy(*order))).where("k = 1")
    best = best.select("ord", "raw_doc_id", F.col("n").alias("pn"), F.col("sim").alias("psim"), F.col("cover").alias("pcover"), "pscore")
    other = pool.join(best.select("ord", "raw_doc_id", "pn"), ["ord", "raw_doc_id"]).where("n != pn").withColumn("k", F.row_number().over(by.orderBy(*order))).where("k = 1")
    return best.join(other.select("ord", "raw_doc_id", F.col("n").alias("pn2")), ["ord", "raw_doc_id"], "left")


def passages_by_key(hits: DataFrame, items: DataFrame) -> DataFrame:
    """The best page hit of each topic and item or story: both keys of an item become rows, so that the join is on one key."""
    keys = F.array(F.concat(F.lit("it:"), F.col("id")), F.concat(F.lit("st:"), F.coalesce("dup_of", "id")))
    met = hits.join(items.select("raw_doc_id", F.explode(keys).alias("match_key")), "raw_doc_id")
    first = F.row_number().over(Window.partitionBy("ord", "match_key").orderBy(F.desc("pscore"), "raw_doc_id", "pn"))
    return met.withColumn("k", first).where("k = 1").drop("k")


def search(rows: DataFrame, topics: DataFrame, hits: DataFrame, filters: Column, now: str, limit: int = LIMIT) -> DataFrame:
    """The listed rows, then the best OUTSIDE ones that match but fail a filter, with how many these are.

    ``rows`` are candidates, ``hits`` passages_by_key. A row counts for its first topic; each topic has its share of the limit.
    Without topics all rows that pass are listed. A row whose filters are unknown is in neither list.
    """
    topics = checked_topics(topics)
    n = topics.count()
    call = rows.withColumn("in_filter", filters)
    kept = ["id", "title", "canonical_url", "score", "articles", "published_at", "in_filter"]
    if not n:
        best = call.where("in_filter").select(*kept, F.lit(None).cast("int").alias("ord"), F.lit(None).cast("double").alias("sim"), F.lit(None).cast("boolean").alias("kw_hit"), F.lit(None).cast("double").alias("rel"), *[F.lit(None).cast(t).alias(c) for c, t in (("pn", "int"), ("psim", "double"), ("pcover", "double"), ("pn2", "int"), ("rn", "int"))])
    else:
        text = F.concat_ws(" ", "title", "summary", "angle", F.array_join("tags", " "))
        m = call.withColumn("words", lexical.tokens(text)).crossJoin(F.broadcast(topics.select("ord", "kw", F.col("v").alias("qv"))))  # topics are checked to be few
        m = m.withColumn("sim", vectors.cosine(F.col("v"), F.col("qv"))).withColumn("kw_hit", keyword_hit(F.col("tags"), F.col("words"), F.col("kw")))
        m = m.join(hits.drop("raw_doc_id"), ["ord", "match_key"], "left")
        own = F.col("kw_hit") | (F.coalesce("sim", F.lit(-1.0)) >= SIM)
        rel = F.when(own, F.coalesce("sim", F.lit(0.0)) + F.when(F.col("kw_hit"), BOOST).otherwise(0.0) + F.when(F.col("pscore").isNotNull(), PASSAGE).otherwise(0.0)).otherwise(F.coalesce("psim", F.lit(0.0)))
        met = m.where(own | F.col("pscore").isNotNull()).withColumn("rel", F.round(rel, 6))
        first = F.row_number().over(Window.partitionBy("id").orderBy("ord", "match_key"))
        best = met.withColumn("k", first).where("k = 1")
        rank = F.row_number().over(Window.partitionBy("ord", "in_filter").orderBy(F.desc("rel"), F.desc_nulls_last("score"), F.desc_nulls_last("published_at"), "id"))
        best = best.withColumn("rn", rank).select(*kept, "ord", "sim", "kw_hit", "rel", "pn", "psim", "pcover", "pn2", "rn")
    best = materialize(best, "matches")  # read three times: the listed, those beside, and their number
    quota = -(-limit // max(1, n))
    order = [F.asc_nulls_first("ord"), F.asc_nulls_last("rn"), F.desc_nulls_last("score"), F.desc_nulls_last("published_at"), F.asc("id")]
    listed = best.where(F.col("in_filter") & (F.col("rn").isNull() | (F.col("rn") <= quota))).orderBy(*order).limit(limit).withColumn("outside", F.lit(False))
    out = best.where(~F.col("in_filter"))
    beside = out.orderBy(F.desc("rel"), F.desc_nulls_last("score"), "id").limit(OUTSIDE).withColumn("outside", F.lit(True))
    both = listed.unionByName(beside).withColumn("age_days", age_days(now))
    return both.withColumn("outside_total", out.agg(F.count("*")).scalar()).drop("in_filter", "published_at")


def shaped(found: DataFrame, passages: DataFrame, items: DataFrame, words: list[str], sim: float = SIM) -> DataFrame:
    """(n, id, outside, match, evidence, passage, at, link): the list as it is shown.

    Rows that mention a topic only in passing come last. The first FULL rows with a passage have all of it, and the page's
    next best after it; the others what stands around the topic's words. Media passages tell their time, with a link to it.
    """
    from quillmesh.functions import text as T

    p = passages.join(items.select("raw_doc_id", "id"), "raw_doc_id")
    first = p.select("id", F.col("n").alias("pn"), F.col("text").alias("ptext"), "start_s")
    second = p.select("id", F.col("n").alias("pn2"), F.col("text").alias("ptext2"))
    r = found.join(first, ["id", "pn"], "left").join(second, ["id", "pn2"], "left")
    passing = ~F.col("outside") & F.coalesce(ranking.passing_mention(F.col("ptext").isNotNull(), F.col("kw_hit"), F.col("sim"), F.lit(None).cast("double"), F.col("psim"), sim), F.lit(False))
    r = r.withColumn("passing", passing)
    order = ["outside", "passing", F.asc_nulls_first("ord"), F.asc_nulls_last("rn"), F.desc_nulls_last("score"), F.asc("id")]
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("outside").orderBy(*order)))  # at most the limit and OUTSIDE rows
    before = F.count("ptext").over(Window.partitionBy("outside").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    tidy = lambda c: F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), "\n{2,}", "\n")), F.lit(EVIDENCE))
    whole = F.concat_ws("\n[another passage of the same article]\n", tidy(F.col("ptext")), tidy(F.col("ptext2")))
    evidence = F.when(F.col("ptext").isNull(), None).when(~F.col("outside") & (before < FULL), whole).otherwise(T.snippet(F.col("ptext"), words, SNIPPET))
    why = F.concat_ws("+", F.when(F.col("kw_hit"), "keyword"), F.when(F.col("sim") >= sim, "meaning"), F.when(F.col("ptext").isNotNull(), "passage"))
    match = F.when(F.col("passing"), "mentioned in passing").when(F.col("ord").isNotNull(), F.nullif(why, F.lit("")))
    at = F.concat(F.floor(F.col("start_s") / 60), F.lit(":"), F.lpad((F.col("start_s") % 60).cast("string"), 2, "0"))
    video = F.col("canonical_url").rlike(r"youtube\.com/watch|youtu\.be/") & F.col("start_s").isNotNull()
    link = F.when(video, F.concat("canonical_url", F.when(F.col("canonical_url").contains("?"), "&").otherwise("?"), F.lit("t="), F.col("start_s")))
    return r.select("n", "id", "outside", match.alias("match"), evidence.alias("evidence"), F.when(F.col("ptext").isNotNull(), F.col("pn")).alias("passage"), at.alias("at"), link.alias("link"))


def next_page(found: DataFrame, shown: DataFrame, page: int = PAGE) -> DataFrame:
    """(n, id): the next rows of a search that was asked again with room for OVER more: unseen ones, numbered on from what was shown (id)."""
    fresh = found.where(~F.col("outside")).join(F.broadcast(shown.select("id").distinct().limit(LIMIT * TOPICS)), "id", "left_anti")  # a list shown to a person
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("ord"), F.asc_nulls_last("rn"), F.desc_nulls_last("score"), "id"))  # at most the limit
    return fresh.withColumn("k", rank).where(F.col("k") <= page).select((F.col("k") + shown.select("id").distinct().agg(F.count("*")).scalar()).alias("n"), "id")
