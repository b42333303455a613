"""Checking answers against their evidence, and small steps around the model (EV-1 to EV-8, RS-4, T-15 to T-28, F-4, J-17, A-18, M-6, M-9, M-13, R-10, R-11, TR-2, TR-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text


def plain(c: Column) -> Column:
    """Lower case letters and digits with single blanks, for comparing quotes."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def quote_found(quote: Column, page: Column) -> Column:
    """Whether every part of a quote between ellipses stands on the page; parts under eight characters prove nothing."""
    parts = F.filter(F.transform(F.split(quote, r"…|\.\.\."), plain), lambda p: F.length(p) >= 8)
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(plain(page), p))


def near_each_other(page: Column, a: Column, b: Column, span: int = 400) -> Column:
    """Whether both names stand within ``span`` characters of each other somewhere on the page."""
    low, x, y = F.lower(page), F.lower(a), F.lower(b)

    def places(name: Column) -> Column:
        parts = F.split(low, F.concat(F.lit(r"\Q"), name, F.lit(r"\E")), -1)
        lengths = F.transform(parts, F.length)
        upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda s, v: s + v) + (k - 1) * F.length(name))
        return F.slice(upto, F.lit(1), F.size(parts) - 1)

    near = F.exists(places(x), lambda p: F.exists(places(y), lambda q: F.abs(p - q) <= span))
    return F.when((F.length(a) > 0) & (F.length(b) > 0) & F.contains(low, x) & F.contains(low, y), near).otherwise(False)


def checked_sentences(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(answer, k, sentence, problem): the sentences of (answer, text) that cite nothing, cite what isn't there, or have figures their items lack.

    ``items`` has (answer, n, evidence). Sentences under 25 characters need no citation.
    """
    s = answers.select("answer", F.posexplode(text.sentences(F.col("text"))).alias("k", "sentence")).withColumn("cited", text.citations(F.col("sentence")))
    uncited = s.where((F.size("cited") == 0) & (F.length("sentence") >= 25)).select("answer", "k", "sentence", F.lit("no source").alias("problem"))
    each = s.select("answer", "k", "sentence", F.explode(F.array_distinct("cited")).alias("n"))
    met = each.join(items, ["answer", "n"], "left")
    absent = met.where("evidence is null").select("answer", "k", "sentence", F.lit("no such item").alias("problem"))
    said = text.figures(F.regexp_replace("sentence", r"\[[0-9,\s–-]+\]", " "))
    known = met.where("evidence is not null").groupBy("answer", "k", "sentence").agg(F.array_distinct(F.flatten(F.collect_list(text.figures(F.col("evidence"))))).alias("known"))
    wrong = known.withColumn("missing", F.array_except(said, F.col("known"))).where(F.size("missing") > 0)
    wrong = wrong.select("answer", "k", "sentence", F.concat(F.lit("figures: "), F.array_join(F.array_sort("missing"), ", ")).alias("problem"))
    return uncited.unionByName(absent).unionByName(wrong).distinct()


def best_quotes(claims: DataFrame, sources: DataFrame, stop: list[str], least: int = 3) -> DataFrame:
    """(claim, quote, shared): of each claim (claim, topic, text) the sentence of its topic's sources (topic, text) with most of its content words.

    Only sentences of 30 to 300 characters that share at least ``least`` words; ties go to the first by text.
    """
    s = sources.select("topic", F.explode(text.sentences(F.col("text"))).alias("quote")).where(F.length("quote").between(30, 300)).distinct()
    words = lambda c: F.explode(text.content_words(c, stop))
    a = claims.select("claim", "topic", words(F.col("text")).alias("w"))
    b = s.select("topic", "quote", words(F.col("quote")).alias("w"))
    met = a.join(b, ["topic", "w"]).groupBy("claim", "quote").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return met.groupBy("claim").agg(F.min(F.struct((-F.col("shared")).alias("o"), "quote")).alias("m")).select("claim", F.col("m.quote").alias("quote"), (-F.col("m.o")).alias("shared"))


def kept_filters(message: Column, min_score: Column, max_age: Column, since: Column) -> Column:
    """The filters that the user's words ask for; without a message all of them. A struct with what was dropped."""
    # Words that ask for quality, and words that name a time.
    quality = r"\b(good|best|top|great|worth|important|interesting|strong|quality|high-?scor\w*|scored?|rated|must-read)\b"
    time = r"\b(today|tonight|yesterday|week(end)?|month|year|recent(ly)?|latest|new(est)?|lately|hours?|days?|since|past|last|this|ago|fresh|current(ly)?|20[0-9]{2})\b"
    m = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    free = m == ""
    q, t = free | m.rlike(quality), free | m.rlike(time)
    gone = F.filter(F.array(F.when(~q & min_score.isNotNull(), F.lit("min_score")), F.when(~t & max_age.isNotNull(), F.lit("max_age_days")), F.when(~t & since.isNotNull(), F.lit("since"))), lambda x: x.isNotNull())
    return F.struct(F.when(q, min_score).alias("min_score"), F.when(t, max_age).alias("max_age_days"), F.when(t, since).alias("since"), gone.alias("dropped"))


def packed_vectors(vectors: Column) -> Column:
    """Vectors as numbers with blanks between, vectors with bars; unusable ones are empty."""
    fine = lambda v: v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.array_join(F.transform(vectors, lambda v: F.when(F.coalesce(fine(v), F.lit(False)), F.array_join(v.cast("array<string>"), " ")).otherwise("")), "|")


def unpacked_vectors(packed: Column) -> Column:
    return F.transform(F.split(packed, r"\|", -1), lambda v: F.when(v != "", F.split(v, " ").cast("array<double>")))


def read_reply(content: Column, reasoning: Column) -> Column:
    """The model's JSON with fences taken off, or the object in its reasoning if it said nothing; null unless all fields are valid."""
    body = F.when(F.coalesce(F.trim(content), F.lit("")) != "", content).otherwise(F.regexp_extract(F.coalesce(reasoning, F.lit("")), r"(?s)(\{.*\})", 1))
    bare = F.regexp_replace(F.regexp_replace(F.trim(body), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    r = F.from_json(bare, "summary string, angle string, relevance int, specificity int, angle_strength int, tags array<string>")
    scores = [r["relevance"], r["specificity"], r["angle_strength"]]
    ok = r["summary"].isNotNull() & (F.size(r["tags"]) >= 1)
    for s in scores:
        ok = ok & s.between(1, 5)
    return F.when(F.coalesce(ok, F.lit(False)), r)


def counted_reply(reply: Column) -> Column:
    """A reply whose stated number of items is set to the number of numbered lines it has."""
    n = F.size(F.filter(F.split(reply, "\n"), lambda x: x.rlike(r"^\s*[0-9]{1,2}[.)]\s"))).cast("string")
    return F.when(n != "0", F.regexp_replace(reply, r"\b[0-9]{1,2}(?= (?:items|stories|articles|results)\b)", n)).otherwise(reply)


def vote_of(data: Column) -> Column:
    """(item, vote) of a button's data like up:12 or down:12, else null."""
    way, item = F.regexp_extract(data, r"^(up|down):([0-9]+)$", 1), F.regexp_extract(data, r"^(up|down):([0-9]+)$", 2)
    return F.when(way != "", F.struct(item.cast("long").alias("item"), F.when(way == "up", 1).otherwise(-1).alias("vote")))


def all_before(dates: Column, cutoff: str) -> Column:
    """Whether there are readable dates and all lie before the cutoff."""
    known = F.filter(F.transform(dates, text.iso_date), lambda d: d != "")
    return (F.size(known) > 0) & F.forall(known, lambda d: d < cutoff)


def list_mention(quote: Column, own: Column, names: Column) -> Column:
    """Whether a quote names at least two others: a list proves little about each of its entries."""
    others = F.filter(names, lambda n: (F.lower(n) != F.lower(own)) & F.contains(F.lower(quote), F.lower(n)))
    return F.size(others) >= 2


def ranked_entities(findings: DataFrame, weak: str, top: int = 4) -> DataFrame:
    """(topic, entity, weight): entities of (topic, entity, page, candidate), pages counted once each, weak ones at three tenths."""
    pages = findings.groupBy("topic", "entity").agg(F.count_distinct("page").alias("pages"), F.bool_or("candidate").alias("candidate"))
    w = F.col("pages") * F.when(F.lower("entity").rlike(weak), 0.3).otherwise(1.0) + F.when(F.col("candidate"), 1.0).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "entity"))
    return pages.withColumn("weight", w).withColumn("k", rank).where(F.col("k") <= top).select("topic", "entity", "weight")


def named_owner(pages: DataFrame, least: int = 3) -> DataFrame:
    """(topic, owner, links): the owner/name most linked on a topic's pages (topic, text), if at least ``least`` links name it."""
    found = F.regexp_extract_all("text", F.lit(r"https?://(?:www\.)?[a-z0-9.-]+/([A-Za-z0-9_-]+/[A-Za-z0-9_.-]+)"), F.lit(1))
    n = pages.select("topic", F.explode(found).alias("owner")).groupBy("topic", "owner").agg(F.count("*").alias("links")).where(F.col("links") >= least)
    return n.groupBy("topic").agg(F.min(F.struct((-F.col("links")).alias("o"), "owner")).alias("m")).select("topic", F.col("m.owner").alias("owner"), (-F.col("m.o")).alias("links"))


def headline(body: Column, words: list[str], most: int = 4, around: int = 12) -> Column:
    """Up to four pieces of ``around`` words on either side of the words asked for, joined by an ellipsis; null without any."""
    w = F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " ")
    hit = F.filter(F.transform(w, lambda x, i: F.when(F.regexp_replace(F.lower(x), "[^a-z0-9]", "").isin([q.lower() for q in words]), i)), lambda i: i.isNotNull())
    # the first hit, and every later one that lies outside the pieces before
    starts = F.aggregate(hit, F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == 0) | (i - F.get(acc, F.size(acc) - 1) > 2 * around), F.array_append(acc, i)).otherwise(acc))
    pieces = F.transform(F.slice(starts, 1, most), lambda i: F.array_join(F.slice(w, F.greatest(F.lit(1), i + 1 - around), F.lit(2 * around)), " "))
    return F.when(F.size(hit) > 0, F.array_join(pieces, " … "))


def claimed(wanted: DataFrame, saves: DataFrame, key: str = "feed_item_id") -> DataFrame:
    """The rows to write: those not saved before, each key once. Saved only after the claim, released again on failure."""
    return wanted.dropDuplicates([key]).join(saves.select(key), key, "left_anti")


def notes(items: DataFrame, saved_day: str) -> DataFrame:
    """(file, note): items as markdown notes with front matter."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tags = F.concat(F.lit("["), F.array_join(F.transform(text.clean_tags(F.col("tags")), lambda t: F.regexp_replace(t, r"\s+", "-")), ", "), F.lit("]"))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), q(F.col("title"))), F.concat(F.lit("url: "), q(F.col("canonical_url"))), F.concat(F.lit("score: "), F.col("score").cast("string")), F.concat(F.lit("tags: "), tags), F.lit(f"saved: {saved_day}"), F.lit("---"))
    return items.select(text.file_name(F.col("title"), F.col("id")).alias("file"), F.concat_ws("\n\n", head, F.concat(F.lit("# "), F.col("title")), "summary", F.concat(F.lit("> "), F.col("angle"))).alias("note"))


def brief_window(last: Column, days: Column, now: Column, first_days: int = 7) -> Column:
    """From when a brief tells: the asked days, else since the last brief, else a week."""
    ago = lambda n: now - F.make_interval(days=n)
    return F.when(days.isNotNull(), ago(days)).otherwise(F.coalesce(last, ago(F.lit(first_days))))


def hedged(headline_: Column, thin: Column) -> Column:
    """A headline that doesn't open with a claim of proof, and says so when the evidence is thin."""
    # Words that already hedge.
    hedges = r"\b(thin|unclear|unknown|not (disclosed|confirmed|verified|found|public)|estimate[sd]?|partly|mixed|limited evidence)\b"
    h = F.regexp_replace(headline_, r"(?i)^\s*(confirmed|verified)\s*(count|users?|products?|list)?\s*[:–—-]\s*", "")
    h = F.regexp_replace(h, r"(?i)^\s*(confirmed|verified)\s+", "Reported ")
    soft = F.regexp_replace(F.regexp_replace(h, r"\b(confirmed|verified|proven)\b", "reported"), r"\b(Confirmed|Verified|Proven)\b", "Reported")
    lowered = F.concat(F.lit("Evidence is thin: "), F.lower(F.left(soft, F.lit(1))), F.substr(soft, F.lit(2)))
    return F.when(~F.coalesce(thin, F.lit(False)), h).when(F.lower(soft).rlike(hedges), soft).otherwise(lowered)


def wide_spread(figures_: Column, ratio: float = 1.08) -> Column:
    """Whether the figures of an answer lie so far apart that no single one may head it."""
    n = F.filter(F.transform(figures_, lambda f: F.regexp_replace(f, "[^0-9.]", "").try_cast("double")), lambda x: x.isNotNull() & (x > 0))
    return (F.size(n) >= 2) & (F.array_max(n) >= ratio * F.array_min(n))


def query_templates(subject: str, shape: str, today: str) -> list[str]:
    """Searches for a question by its shape: a list, a comparison, a count, a yes or no, or anything else."""
    year = today[:4]
    by_shape = {
        "list": ["{s} list", "{s} examples {y}", "companies {s}", "{s} announced {y}"],
        "compare": ["{s} compared", "{s} benchmark {y}", "{s} differences", "{s} review"],
        "count": ["{s} number {y}", "{s} statistics", "{s} report {y}", "how many {s}"],
        "yesno": ["{s}", "{s} confirmed", "{s} denied", "{s} official statement"],
    }
    return [t.format(s=subject, y=year) for t in by_shape.get(shape, ["{s}", "{s} {y}", "{s} explained"])]
