"""Stories: articles rolled up by root or by extracted keys, and the scores that rank them (A-1, A-2, M-2, M-8, D-3, D-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import materialize


def amount(structured: Column) -> Column:
    """``amount_usd`` where the JSON holds a number there; a number written as text stays null."""
    parsed = F.try_parse_json(structured)
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.amount_usd", "variant"))
    return F.when(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(parsed, "$.amount_usd", "double"))


def items_once(items: DataFrame) -> DataFrame:
    """A row delivered twice is one row."""
    return items.dropDuplicates(["id"])


def total_score(specificity: Column, strength: Column) -> Column:
    """Never null: 0 means not scored."""
    return F.coalesce(specificity, F.lit(0)) + F.coalesce(strength, F.lit(0))


def structured_key(structured: Column, item_id: Column) -> Column:
    """Company and round, else country and instrument, else the item itself."""
    got = lambda p: F.nullif(F.trim(F.get_json_object(structured, p)), F.lit(""))
    slug = F.nullif(F.regexp_replace(F.lower(got("$.round")), "[^a-z0-9]+", "-"), F.lit(""))
    company = F.concat(F.lit("co:"), F.lower(got("$.company")), F.lit("/"), F.coalesce(slug, F.lit("?")))
    policy = F.concat(F.lit("pol:"), F.coalesce(F.lower(got("$.country")), F.lit("?")), F.lit("/"), F.lower(got("$.instrument")))
    return F.coalesce(company, policy, F.concat(F.lit("item:"), item_id.cast("string")))


def root_key(item_id: Column, dup_of: Column) -> Column:
    return F.concat(F.lit("st:"), F.coalesce(dup_of, item_id).cast("string"))


def story_view(items: DataFrame, key: Column) -> DataFrame:
    """One row a story: counts, best scores, the span of dates and the representative's columns.

    The representative is the best by score, then the lowest id. Nothing is gathered a story, however many articles it has;
    its URLs are rows of ``story_urls``.
    """
    when = F.coalesce("published_at", "created_at")
    keyed = items_once(items).withColumn("story_key", key).withColumn("amount_num", amount(F.col("structured")))
    front = F.struct(F.coalesce(-F.col("score"), F.lit(0)).alias("s"), F.col("id").alias("i"), "title", "canonical_url", "summary", "angle", "tags", "structured")
    rolled = keyed.groupBy("story_key").agg(
        F.count("*").alias("articles"), F.max("score").alias("score"), F.max("specificity").alias("specificity"), F.max("angle_strength").alias("angle_strength"), F.max("amount_num").alias("amount_usd"),
        F.min(when).alias("first_published"), F.max(when).alias("last_published"), F.max("created_at").alias("created_at"), F.max("run_id").alias("run_id"),
        F.min_by(front, F.struct(F.coalesce(-F.col("score"), F.lit(0)), "id")).alias("rep"),
    )
    return rolled.select(
        "story_key", "articles", "score", "specificity", "angle_strength", "amount_usd", "first_published", "last_published", "created_at", "run_id",
        F.col("rep.i").alias("rep_id"), F.col("rep.title").alias("title"), F.col("rep.canonical_url").alias("canonical_url"), F.col("rep.summary").alias("summary"), F.col("rep.angle").alias("angle"), F.col("rep.tags").alias("tags"), F.col("rep.structured").alias("structured"),
    )


def story_urls(items: DataFrame, key: Column) -> DataFrame:
    """(story_key, pos, canonical_url): the URLs of each story in the order that picks its representative."""
    keyed = items_once(items).withColumn("story_key", key)
    rank = F.row_number().over(Window.partitionBy("story_key").orderBy(F.coalesce(-F.col("score"), F.lit(0)), "id"))
    return keyed.select("story_key", rank.alias("pos"), "canonical_url")


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of (id, parent): parents have lower ids, so pointer jumping halves the depth each round."""
    links = materialize(parents.select("id", F.coalesce("parent", "id").alias("root")), "roots")
    while True:
        above = links.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = materialize(links.join(above, "root", "left").select("id", "root", F.coalesce("up", "root").alias("up")), "roots")
        links = step.select("id", F.col("up").alias("root"))
        if step.where("root != up").isEmpty():
            return links


def deep_duplicates(items: DataFrame) -> DataFrame:
    """Rows whose dup_of points at a row that has a dup_of itself."""
    once = items_once(items).select("id", "dup_of")
    return once.where("dup_of is not null").join(once.where("dup_of is not null").select(F.col("id").alias("dup_of")), "dup_of", "left_semi").select("id", "dup_of")
