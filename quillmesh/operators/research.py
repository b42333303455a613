"""Checking findings over many pages: origins of figures, quotes to check, findings with their quotes, fields beside the fixed ones (EV-6 to EV-8, RS-3, W-10, M-10, TR-2, TR-3, D-1, D-5, DML-6, DML-11, DML-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import evidence as E
from quillmesh.functions import text as T


def origin_pages(claims: DataFrame, pages: DataFrame, keep: int = 2, around: int = 1200) -> DataFrame:
    """(claim, page, date, excerpt): of each claim (topic, claim, text) the earliest dated pages (topic, page, date, text) of its topic that have one of its figures.

    Claims and pages meet on topic and figure: every page's figures are taken out once.
    """
    number = r"(?<![\d.])(\d+(?:\.\d+)?)(?!\d)"
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"(\d),(\d{3})", "$1$2")
    dated = pages.select("topic", "page", T.iso_date(F.col("date")).alias("date"), plain.alias("text")).where("date != ''")
    told = dated.select("topic", "page", "date", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(number), F.lit(1)))).alias("figure"))
    asked = claims.select("topic", "claim", F.posexplode(E.claim_figures(F.col("text"))).alias("k", "figure"))
    met = asked.join(told, ["topic", "figure"]).groupBy("claim", "page", "date").agg(F.min_by("figure", "k").alias("figure"))
    rank = F.row_number().over(Window.partitionBy("claim").orderBy("date", "page"))
    best = met.withColumn("k", rank).where(F.col("k") <= keep)
    at = F.position(F.col("figure"), F.col("text")) - 1
    low = F.greatest(F.lit(0), at - around)
    return best.join(dated.select("page", "text"), "page").select("claim", "page", "date", F.substr("text", low + 1, at + around - low).alias("excerpt"))


def ruled_out_lines(entities: DataFrame, keep: int = 2) -> DataFrame:
    """(topic, name, why): of each topic the entities (topic, name, why, claims, mentions) that were ruled out and are worth a line."""
    ranked = entities.withColumn("rank", E.ruled_out(F.col("why"), F.col("claims"), F.col("mentions"))).where("rank is not null")
    order = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("rank"), "name"))
    return ranked.withColumn("k", order).where(F.col("k") <= keep).select("topic", "name", "why")


def quotes_to_check(items: DataFrame, facts: DataFrame, most: int = 3, each: int = 3) -> DataFrame:
    """(answer, name, quote, n): a quote for each of an answer's first items, its own facts first, no quote twice.

    ``items`` has (answer, pos, name, sources array<int>), ``facts`` (answer, n, entity, quote, fits). Each item considers
    its first ``each`` usable quotes; taking them is a walk over at most ``most`` items of one answer.
    """
    shown = items.where(F.col("pos") <= most)
    f = facts.where(E.quotable(F.col("quote")))
    j = shown.join(f, "answer").where(F.array_contains("sources", F.col("n")))
    k, e, q = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "") for c in ("name", "entity", "quote"))
    own = (k != "") & (e.contains(k) | k.contains(e) | q.contains(k))
    cand = F.struct((~own).alias("late"), F.col("n"), F.col("quote"), F.col("fits"))
    per = j.groupBy("answer", "pos", "name").agg(F.array_sort(F.collect_set(cand)).alias("cands"))
    # most x facts of one answer
    whole = per.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "cands"))).alias("items"))

    def step(acc: Column, it: Column) -> Column:
        used = F.transform(acc, lambda x: x["quote"])
        free = F.filter(F.slice(F.filter(it["cands"], lambda c: ~F.array_contains(used, c["quote"])), 1, each), lambda c: F.coalesce(c["fits"], F.lit(True)))
        return F.when(F.size(free) > 0, F.array_append(acc, F.struct(it["name"].alias("name"), F.get(free, F.lit(0))["quote"].alias("quote"), F.get(free, F.lit(0))["n"].cast("int").alias("n")))).otherwise(acc)

    taken = F.aggregate("items", F.array().cast("array<struct<name:string,quote:string,n:int>>"), step)
    return whole.select("answer", F.inline(taken))


def found_on_page(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """The findings (page, quote, ...) whose quote stands on their page (page, text), link targets and marks aside."""
    return findings.join(pages.select("page", F.col("text").alias("_text")), "page").where(E.quote_stands(F.col("quote"), F.col("_text"))).drop("_text")


#: The fields that every reply has.
BASE_FIELDS = ["summary", "angle", "relevance", "specificity", "angle_strength", "tags"]


def extra_fields(reply: Column) -> Column:
    """The fields of a JSON object beside the fixed ones, as JSON; null if there are none or it is no object."""
    kept = F.map_filter(F.from_json(reply, "map<string,string>"), lambda k, v: ~k.isin(BASE_FIELDS))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def widened(extra: dict[str, str], base: dict[str, str] | None = None) -> str:
    """The schema of a reply with a skill's fields; they can't redefine the fixed ones."""
    base = base or {"summary": "string", "angle": "string", "relevance": "int", "specificity": "int", "angle_strength": "int", "tags": "array<string>"}
    return ", ".join(f"`{k}` {t}" for k, t in (base | {k: t for k, t in extra.items() if k not in base}).items())


def judged_replies(replies: DataFrame, valid: Column, tries: int = 2, failed: str = "TRIAGE_FAILED") -> DataFrame:
    """(id, outcome, summary) of attempts (id, attempt, summary): the first valid one, ``retry`` while tries are left, else a failed row."""
    per = replies.groupBy("id").agg(F.min_by("summary", F.when(valid, F.col("attempt"))).alias("summary"), F.max("attempt").alias("made"), F.bool_or(valid).alias("ok"))
    outcome = F.when(F.coalesce("ok", F.lit(False)), "valid").when(F.col("made") < tries, "retry").otherwise("failed")
    return per.select("id", outcome.alias("outcome"), F.when(F.col("ok"), F.col("summary")).when(F.col("made") >= tries, F.lit(failed)).alias("summary"))


def resolved_skills(runs: DataFrame, skills: DataFrame) -> DataFrame:
    """Runs (query_text) with the skill (name, fields) of their query, letter case and blanks aside; the lowest name of several."""
    one = skills.groupBy(F.lower(F.trim("query_text")).alias("_q")).agg(F.min(F.struct("name", "fields")).alias("s"))
    return runs.join(one, F.lower(F.trim("query_text")) == F.col("_q"), "left").select(*runs.columns, F.col("s.name").alias("skill"), F.col("s.fields").alias("fields"))


def replaced_pages(docs: DataFrame, items: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, items) without the pages that ``incoming`` (canonical_url, flag) asks to be replaced, and without their items; other flags change nothing."""
    gone = docs.join(incoming.where("flag = 'replace'").select("canonical_url").distinct(), "canonical_url", "left_semi").select(F.col("id").alias("raw_doc_id"))
    return docs.join(gone.withColumnRenamed("raw_doc_id", "id"), "id", "left_anti"), items.join(gone, "raw_doc_id", "left_anti")


def released(saves: DataFrame, failed: DataFrame, key: str = "feed_item_id") -> DataFrame:
    """The saves without the claims whose write failed, so that they can be claimed again."""
    return saves.join(failed.select(key), key, "left_anti")


def tidied(history: DataFrame) -> DataFrame:
    """Chat rows (id, message as JSON) without tool rows and calls of tools, and without the live data that was put into people's messages."""
    kind = F.get_json_object("message", "$.type")
    calls = F.coalesce(F.get_json_object("message", "$.tool_calls"), F.lit("[]")).rlike(r"^\[\s*[^\]\s]")
    content = F.get_json_object("message", "$.content")
    bare = F.regexp_replace(content, r"(?s)\s*\[live data, fetched just now:.*$", "")
    marked = (kind == "human") & content.contains("[live data, fetched just now:")
    rest = F.map_filter(F.from_json("message", "map<string,string>"), lambda k, v: k != "content")
    again = F.to_json(F.map_concat(rest, F.create_map(F.lit("content"), bare)))
    return history.where(~F.coalesce((kind == "tool") | ((kind == "ai") & calls), F.lit(False))).withColumn("message", F.when(F.coalesce(marked, F.lit(False)), again).otherwise(F.col("message")))


def corrected(history: DataFrame, fixes: DataFrame) -> DataFrame:
    """The last reply of each session (id, session_id, message) takes the corrected text of ``fixes`` (session_id, output)."""
    last = history.where(F.get_json_object("message", "$.type") == "ai").groupBy("session_id").agg(F.max("id").alias("id"))
    new = last.join(fixes, "session_id").select("id", F.col("output").alias("_new"))
    rest = F.map_filter(F.from_json("message", "map<string,string>"), lambda k, v: k != "content")
    again = F.to_json(F.map_concat(rest, F.create_map(F.lit("content"), F.col("_new"))))
    return history.join(new, "id", "left").withColumn("message", F.when(F.col("_new").isNotNull(), again).otherwise(F.col("message"))).drop("_new")


def twin_of(candidates: DataFrame) -> DataFrame:
    """(id, twin, sim): of candidate twins (id, twin, sim) the most similar; of equal ones that with the lowest id."""
    best = F.max(F.struct("sim", (-F.col("twin")).alias("o"))).alias("b")
    return candidates.groupBy("id").agg(best).select("id", (-F.col("b.o")).alias("twin"), "b.sim")


def wanted_again(fresh: DataFrame, batch: DataFrame) -> DataFrame:
    """Fresh records (canonical) and, flagged ``replace``, the first of those that ask for slides or a transcript of a page known before.

    ``batch`` has canonical, rec_id, slides and transcribe.
    """
    more = batch.where(F.coalesce("slides", F.lit(False)) | F.coalesce("transcribe", F.lit(False))).join(fresh.select("canonical"), "canonical", "left_anti")
    more = more.groupBy("canonical").agg(F.min("rec_id").alias("rec_id")).withColumn("flag", F.lit("replace"))
    return fresh.select("canonical", "rec_id", F.lit("").alias("flag")).unionByName(more)
