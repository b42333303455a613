"""Payloads of searches, feeds, captions and uploads as rows (SRC-1 to SRC-5, SRC-7 to SRC-10)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import plugins
from quillmesh.functions.evidence import upload_title
from quillmesh.functions.urls import canon

_HIT = "struct<url:string,title:string,publishedDate:string,published_date:string,page_age:string>"


#: Where each search's replies have their results, and their date's name.
SEARCHES = {"exa": ("results", "publishedDate"), "tavily": ("results", "published_date"), "brave": ("web.results", "page_age")}


def search_hits(replies: DataFrame, source: str, column: str = "body") -> DataFrame:
    """(url, title, source, published_at) of JSON replies with results, or results under web; hits without a URL are dropped."""
    j = F.from_json(F.col(column), f"results array<{_HIT}>, web struct<results:array<{_HIT}>>")
    hit = replies.select(F.explode(F.coalesce(j["results"], j["web"]["results"])).alias("h"))
    when = F.coalesce("h.publishedDate", "h.published_date", "h.page_age").try_cast("timestamp")
    return hit.where("h.url is not null and h.url != ''").select("h.url", "h.title", F.lit(source).alias("source"), when.alias("published_at"))


def searched(queries: DataFrame, fetcher: plugins.Fetcher, source: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, errors) of the queries (url) sent to a search; with ``strict`` a query that failed fails the plan that reads the hits."""
    if source not in SEARCHES:
        raise ValueError(f"unknown search {source}")
    replies = plugins.fetch(queries, fetcher)
    bad = F.col("error").isNotNull() | (F.col("body").isNotNull() & F.from_json("body", "map<string,string>").isNull())
    errors = replies.where(bad).select("url", F.coalesce("error", F.lit("no JSON")).alias("error"))
    if strict:
        replies = replies.withColumn("body", F.when(bad, F.raise_error(F.concat(F.lit(f"{source}: "), F.coalesce("error", F.lit("no JSON"))))).otherwise(F.col("body")))
    return search_hits(replies, source), errors


_ITEM = "title string, link string, url string, pubDate string"
_FEED = f"channel struct<item:array<struct<{_ITEM.replace(' string', ':string')}>>>, entry array<struct<title:string,link:struct<_href:string>,published:string,updated:string>>"


def feed_entries(replies: DataFrame, column: str = "body") -> DataFrame:
    """(source, url, title, published) of feeds as XML (source, body): items of a channel, or entries; what can't be read has none."""
    x = F.from_xml(F.col(column), _FEED)
    rows = F.transform(x["channel"]["item"], lambda i: F.struct(F.coalesce(F.nullif(F.trim(i["link"]), F.lit("")), i["url"]).alias("url"), i["title"].alias("title"), i["pubDate"].alias("published")))
    entries = F.transform(x["entry"], lambda e: F.struct(e["link"]["_href"].alias("url"), e["title"].alias("title"), F.coalesce(e["published"], e["updated"]).alias("published")))
    each = replies.select("source", F.explode(F.coalesce(rows, entries)).alias("r"))
    return each.select("source", "r.*").where("url is not null and url != ''")


def read_date(said: Column) -> Column:
    """A date as feeds write it; null for none, 1970 for one that can't be read."""
    plain = F.regexp_replace(F.trim(said), r"^[A-Za-z]{3},\s*", "")
    mail = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(plain, r"\b(GMT|UTC|Z)$", "+0000"), F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")])
    return F.when(said.isNull() | (F.trim(said) == ""), None).otherwise(F.coalesce(F.trim(said).try_cast("timestamp"), mail, F.timestamp_seconds(F.lit(0))))


def recent(rows: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Rows (published, ...) without a date, or not older; a date that can't be read counts as 1970. Holds for streams too."""
    dated = rows.withColumn("published_at", read_date(F.col("published")))
    return dated.where(F.col("published_at").isNull() | (F.col("published_at") >= now - F.make_interval(hours=F.lit(hours)))).drop("published")


def url_inputs(batches: DataFrame, column: str = "urls") -> DataFrame:
    """(canonical, url, title, source, published_at, slides, transcribe, markdown, scraper) of JSON arrays of plain URLs or objects with a url.

    Unreadable ones are dropped.
    """
    texts = F.from_json(F.col(column), "array<string>")
    each = batches.select(F.explode(texts).alias("e"))
    o = F.from_json("e", "url string, title string, source string, published_at string, slides boolean, transcribe boolean, markdown string, scraper string")
    # a plain URL is no JSON object, so its fields are null
    flag = lambda c: F.coalesce(o[c], F.lit(False)).alias(c)
    rows = each.select(
        F.coalesce(o["url"], F.when(~F.col("e").startswith("{"), F.col("e"))).alias("url"), o["title"].alias("title"), o["source"].alias("source"), o["published_at"].try_cast("timestamp").alias("published_at"),
        flag("slides"), flag("transcribe"), o["markdown"].alias("markdown"), o["scraper"].alias("scraper"),
    )
    return rows.withColumn("canonical", canon(F.col("url"))).where("canonical is not null")


def uploads(spark: SparkSession, folder: str, extract: Callable[[bytes], str | None], kinds: str = "*.pdf") -> DataFrame:
    """(canonical, title, text, refused) of the files of a folder: their text by ``extract``, a key that stays the same for the same content, and why one is refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", kinds).load(folder)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            try:
                out.append(extract(bytes(c)))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype=object)

    key = F.concat(F.lit("upload://"), F.sha2("content", 256))
    rows = files.select(key.alias("canonical"), name.alias("name"), "length", joined_lines(read("content")).alias("text"))
    return rows.select("canonical", upload_title(F.col("name"), F.lit(None).cast("string"), F.col("text")).alias("title"), "text", upload_gate(F.col("length"), F.col("text")).alias("refused"))


def transcripts(asked: DataFrame, cache: DataFrame, fetcher: plugins.Fetcher, most_seconds: int = 3 * 3600, most_slides: int = 45 * 60) -> DataFrame:
    """(id, text, slides, note, cached) of videos (id, seconds, slides): from the cache (id, text), else fetched; too long ones are refused.

    Slides are only read of videos that are not too long for that.
    """
    hit = asked.join(cache.select("id", "text"), "id", "left")
    here = hit.where("text is not null").withColumn("cached", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    miss = hit.where("text is null").drop("text")
    got = plugins.fetch(miss.where(F.coalesce("seconds", F.lit(0)) <= most_seconds).select(F.col("id").alias("url")), fetcher).select(F.col("url").alias("id"), F.col("body").alias("text"), "error")
    new = miss.join(got, "id", "left").withColumn("cached", F.lit(False))
    both = here.select("id", "seconds", "slides", "text", "error", "cached").unionByName(new.select("id", "seconds", "slides", "text", "error", "cached"))
    note = F.when(~F.col("cached") & (F.col("seconds") > most_seconds), "too long").when(F.col("error").isNotNull(), F.col("error")).when(F.col("slides") & (F.col("seconds") > most_slides), "slides skipped")
    return both.select("id", "text", (F.coalesce("slides", F.lit(False)) & (F.coalesce("seconds", F.lit(0)) <= most_slides)).alias("slides"), note.alias("note"), "cached")


def caption_choice(meta: DataFrame) -> DataFrame:
    """(id, kind, lang, url): captions by people in the video's language or English, else automatic ones in the original language.

    ``meta`` has id, language, manual and auto: maps from language to caption URL.
    """
    own = F.lower(F.element_at(F.split(F.coalesce(F.nullif("language", F.lit("")), F.lit("en")), "-"), 1))
    base = lambda k: F.lower(F.element_at(F.split(k, "-"), 1))
    fits = F.filter(F.map_entries("manual"), lambda e: (e["key"] != "live_chat") & ((base(e["key"]) == own) | (base(e["key"]) == "en")) & e["value"].isNotNull())
    ranked = F.array_sort(F.transform(fits, lambda e: F.struct((~F.lower(e["key"]).startswith(own)).alias("late"), e["key"].alias("lang"), e["value"].alias("url"))))
    keys = F.array(F.concat(own, F.lit("-orig")), F.lit("en-orig"), own)
    autos = F.filter(F.transform(keys, lambda k: F.struct(k.alias("lang"), F.try_element_at("auto", k).alias("url"))), lambda e: e["url"].isNotNull())
    first, second = F.get(ranked, F.lit(0)), F.get(autos, F.lit(0))
    kind = F.when(first.isNotNull(), "captions-manual").when(second.isNotNull(), "captions-auto")
    return meta.select("id", kind.alias("kind"), F.coalesce(first["lang"], second["lang"]).alias("lang"), F.coalesce(first["url"], second["url"]).alias("url")).where("kind is not null")


def upload_gate(size: Column, text: Column, most_bytes: int = 20 * 1024 * 1024, least: int = 300, most: int = 400_000) -> Column:
    """Why an uploaded document is refused, null if it isn't."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(size > most_bytes, "too large").when(n < least, "no text").when(n > most, "too long")


def joined_lines(text: Column) -> Column:
    """Text of a printed page: words joined over hyphens at line ends, broken lines joined, paragraphs kept."""
    t = F.regexp_replace(F.regexp_replace(text, "\r", ""), r"([a-z])-\n([a-z])", "$1$2")
    t = F.regexp_replace(t, r"([^\n.!?:])\n(?=[a-z0-9(])", "$1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"\n{3,}", "\n\n"))
