"""Words: passages' tokens, document frequencies, weighted coverage, boilerplate and spelling (A-5 to A-8, A-11, J-10, J-15, R-1, R-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def vocabulary(*sources: tuple[DataFrame, str]) -> DataFrame:
    """(word, ndoc): in how many texts of all sources a word of three or more letters stands."""
    out = None
    for df, column in sources:
        words = df.select(F.explode(tokens(F.col(column))).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$"))
        out = words if out is None else out.unionByName(words)
    return out.groupBy("word").agg(F.count("*").alias("ndoc"))


def boilerplate(passages: DataFrame, pages: int = 3) -> DataFrame:
    """(text_md5): texts that are passages of at least that many pages."""
    once = passages.where("text is not null").select(F.md5("text").alias("text_md5"), "raw_doc_id").distinct()
    return once.groupBy("text_md5").agg(F.count("*").alias("pages")).where(F.col("pages") >= pages)


def idf(passages: DataFrame, words: DataFrame) -> DataFrame:
    """(ord, lex, idf) of the topic words (ord, lex): counted over all passages, boilerplate too."""
    total = passages.agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("n"))
    df = _hits(passages, words.select("lex").distinct()).groupBy("lex").agg(F.count("*").alias("df"))
    return words.join(df, "lex", "left").select("ord", "lex", F.log(total.scalar() / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))


#: Words up to which they are looked for in a text's tokens before these become rows.
FEW = 1000


def _hits(passages: DataFrame, words: DataFrame) -> DataFrame:
    """(raw_doc_id, n, lex, ...): the words (lex) that each passage has. More than FEW words are met by a join on all tokens instead."""
    few = [r.lex for r in words.select("lex").distinct().limit(FEW + 1).collect()]
    found = tokens(F.col("text"))
    if len(few) <= FEW:
        found = F.array_intersect(found, F.array(*map(F.lit, few)).cast("array<string>"))
    return passages.select("raw_doc_id", "n", F.explode(found).alias("lex")).join(words, "lex")


def coverage(passages: DataFrame, weighted: DataFrame, boiler: DataFrame) -> DataFrame:
    """(ord, raw_doc_id, n, cover): the weight of a topic's words that a passage has, over the weight of all of them."""
    w = weighted.select("ord", "lex", F.greatest("idf", F.lit(0.0)).alias("w"))
    total = w.groupBy("ord").agg(F.sum("w").alias("total"))
    lex = passages.where("text is not null").withColumn("text_md5", F.md5("text")).join(boiler.select("text_md5"), "text_md5", "left_anti")
    hits = _hits(lex, w)
    return hits.groupBy("ord", "raw_doc_id", "n").agg(F.sum("w").alias("s")).join(total, "ord").select("ord", "raw_doc_id", "n", (F.col("s") / F.nullif(F.col("total"), F.lit(0.0))).alias("cover"))


def merge_candidates(by_meaning: DataFrame, by_words: DataFrame, weight: float = 0.3, sim: float = 0.55, cover: float = 0.75, keep_all: bool = False) -> DataFrame:
    """(ord, raw_doc_id, n, sim, cover, pscore, hit): both lists by passage; hit tells those that pass either cutoff, alone unless ``keep_all``."""
    keys = ["ord", "raw_doc_id", "n"]
    both = by_meaning.select(*keys, "sim").unionByName(by_words.select(*keys, "cover"), allowMissingColumns=True).groupBy(*keys).agg(F.max("sim").alias("sim"), F.max("cover").alias("cover"))
    s, c = F.coalesce("sim", F.lit(0.0)), F.coalesce("cover", F.lit(0.0))
    scored = both.withColumn("pscore", s + weight * c).withColumn("hit", (s >= sim) | (c >= cover))
    return scored if keep_all else scored.where("hit")


def deletions(word: Column) -> Column:
    """The word and every form of it with one letter less."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))))


def one_edit(words: DataFrame, vocab: DataFrame, keep: int = 3) -> DataFrame:
    """(word, cand, ndoc): known words one insertion, deletion, change or swap away from (word), the ``keep`` most frequent.

    Two words that near share a form with a letter less, so the candidates meet on those; the distance is then checked.
    """
    from pyspark.sql import Window

    asked = words.select("word", F.explode(deletions(F.col("word"))).alias("d"))
    known = vocab.select(F.col("word").alias("cand"), "ndoc").withColumn("d", F.explode(deletions(F.col("cand"))))
    met = asked.join(known, "d").where("word != cand").select("word", "cand", "ndoc").distinct()
    plain = F.levenshtein("word", "cand")
    n = F.length("word")
    # a swap: two changes next to each other that undo each other
    at = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("word", i, F.lit(1)) != F.substr("cand", i, F.lit(1))), True).cast("int")
    swapped = F.concat(F.substr("word", F.lit(1), at - 1), F.substr("word", at + 1, F.lit(1)), F.substr("word", at, F.lit(1)), F.substr("word", at + 2, n))
    near = met.where((plain == 1) | ((plain == 2) & (F.length("cand") == n) & (at > 0) & (swapped == F.col("cand"))))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("ndoc"), "cand"))
    return near.withColumn("rank", rank).where(F.col("rank") <= keep)
