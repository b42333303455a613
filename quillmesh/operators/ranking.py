"""Ranked lists: caps per group, quotas per topic, pages, and reranking in place (W-1 to W-8, R-5, R-6, RS-2, RS-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(rows: DataFrame, group: str, order: list[Column], each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group, then the first ``total`` of what is left."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_k", rank).where(F.col("_k") <= each).drop("_k").orderBy(*order).limit(total)


def nested_caps(rows: DataFrame, page: str, entity: str, order: list[Column], each_page: int = 4, each_entity: int = 2, total: int = 30) -> DataFrame:
    """At most ``each_page`` rows of a page, of these at most ``each_entity`` of an entity, of these the first ``total``."""
    first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    kept = rows.withColumn("_k", first(page)).where(F.col("_k") <= each_page).withColumn("_k", first(entity)).where(F.col("_k") <= each_entity)
    return kept.drop("_k").orderBy(*order).limit(total)


def fair_share(best: DataFrame, topics: int, limit: int, order: list[Column]) -> DataFrame:
    """Of every topic (ord) its first ceil(limit / topics) rows, then the first ``limit`` of all in order of topic and rank."""
    rank = F.row_number().over(Window.partitionBy("ord", "in_filter").orderBy(*order))
    quota = -(-limit // max(1, topics))
    return best.withColumn("rn", rank).where(F.col("in_filter") & (F.col("rn") <= quota)).orderBy("ord", "rn").limit(limit)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 5) -> DataFrame:
    return rows.orderBy(*order).offset(page * size).limit(size)


def rerank_in_place(rows: DataFrame, scores: DataFrame, key: str, slot: str) -> DataFrame:
    """Rows with a score change places among themselves, best score first; all other rows keep theirs.

    ``scores`` has (key, score); of several scores of a row the best counts. ``rows`` is one ranked list.
    """
    best = scores.groupBy(key).agg(F.max("score").alias("score"))
    scored = rows.join(best, key, "left")
    has = F.col("score").isNotNull()
    by_slot = F.row_number().over(Window.partitionBy(has).orderBy(slot))
    by_score = F.row_number().over(Window.partitionBy(has).orderBy(F.desc("score"), slot))
    ranked = scored.withColumn("_s", by_slot).withColumn("_r", by_score)
    places = ranked.where(has).select(F.col("_s").alias("_r"), F.col(slot).alias("_slot"))
    moved = ranked.where(has).join(places, "_r").withColumn(slot, F.col("_slot")).drop("_slot")
    return moved.unionByName(ranked.where(~has)).drop("_s", "_r")


def passing_mention(has_text: Column, keyword: Column, sim: Column, rerank: Column, psim: Column, cutoff: float = 0.45) -> Column:
    """Found only in its text, and only barely: by the reranker's score where there is one, else by the passage's."""
    only_text = has_text & ~F.coalesce(keyword, F.lit(False)) & (F.coalesce(sim, F.lit(0.0)) < cutoff)
    return only_text & F.when(rerank.isNotNull(), rerank < 0.2).otherwise(F.coalesce(psim, F.lit(0.0)) < 0.40)
