"""Keyed state kept as snapshots: upserts, replacements and deletes as DataFrame plans (DML-1 to DML-9, DML-12, DML-13).

Every function takes the present snapshot and the change and returns the next snapshot; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``delta`` whose key ``base`` doesn't have are added; the first of repeated keys by the other columns."""
    rest = [c for c in base.columns if c not in keys]
    fresh = delta.join(base.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return base.unionByName(fresh.select(*base.columns))


def last_write_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``: a partial aggregate, not a sort of each key's rows."""
    rest = [c for c in log.columns if c not in keys]
    front = [*order, *[c for c in rest if c not in order]]
    return log.groupBy(*keys).agg(F.max(F.struct(*front)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def add_counts(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of both sides added up by key."""
    return base.select(*keys, value).unionByName(delta.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def replace_by_key(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``delta`` give way to its rows."""
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta)


def delete_cascade(rows: DataFrame, deleted: DataFrame, key: str, self_ref: str) -> DataFrame:
    """Without the deleted keys; references to them become null."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    kept = rows.join(gone, rows[key] == gone["_gone"], "left_anti")
    marked = kept.join(gone, kept[self_ref] == gone["_gone"], "left")
    return marked.withColumn(self_ref, F.when(F.col("_gone").isNull(), F.col(self_ref))).drop("_gone")


def reactivate(base: DataFrame, delta: DataFrame, key: str, label: str, active: str) -> DataFrame:
    """Rows of ``delta`` (key, label) are added or switched on again; a label is only replaced by one that isn't blank."""
    given = delta.groupBy(key).agg(F.max(F.nullif(F.trim(label), F.lit(""))).alias("_given"))
    both = base.join(given.withColumn("_there", F.lit(True)), key, "full_outer")
    return both.withColumn(label, F.coalesce("_given", F.col(label))).withColumn(active, F.coalesce("_there", F.col(active))).drop("_given", "_there")


def switch_off(base: DataFrame, where: Column, active: str = "active") -> DataFrame:
    """Soft delete: rows of the condition become inactive."""
    return base.withColumn(active, F.when(F.coalesce(where, F.lit(False)), F.lit(False)).otherwise(F.col(active)))


def bump(base: DataFrame, failed: DataFrame, key: str, counter: str) -> DataFrame:
    """One more failure for every key in ``failed``."""
    hit = failed.select(key).distinct().withColumn("_hit", F.lit(1))
    return base.join(hit, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_hit", F.lit(0))).drop("_hit")


def repair_runs(runs: DataFrame, now: str, note: str, within: str = "2 hours", most: int = 2000) -> DataFrame:
    """Runs still ``running`` that began within the time before ``now`` become failed, the note added to their error."""
    live = (F.lower("status") == "running") & (F.col("started_at") > F.expr(f"timestamp'{now}' - interval {within}"))
    live = F.coalesce(live, F.lit(False))
    text = F.left(F.concat_ws("; ", F.nullif(F.col("error"), F.lit("")), F.lit(note)), F.lit(most))
    return runs.withColumn("error", F.when(live, text).otherwise(F.col("error"))).withColumn("status", F.when(live, "failed").otherwise(F.lower("status")))


def take_lease(settings: DataFrame, key: str, owner: str, now: str, minutes: int = 16) -> DataFrame:
    """The settings (key, value, updated_at) after asking for a lease: taken where it is absent, empty or older than the time.

    The caller has it if its name is the value. A plan can't compare and swap; one driver asks at a time.
    """
    at = F.lit(now).cast("timestamp")
    mine = settings.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(owner).alias("value"), at.alias("updated_at"))
    held = (F.col("key") == key) & (F.coalesce("value", F.lit("")) != "") & (F.col("updated_at") >= at - F.make_interval(mins=F.lit(minutes)))
    busy = settings.where(held).select("key")
    return settings.where((F.col("key") != key) | F.coalesce(held, F.lit(False))).select("key", "value", "updated_at").unionByName(mine.join(busy, "key", "left_anti"))


def notice_due(sent: DataFrame, kind: str, now: str, hours: int = 6) -> DataFrame:
    """One row: whether a notice of that kind was never sent, or longer ago than the hours."""
    at = F.lit(now).cast("timestamp")
    return sent.where(F.col("kind") == kind).agg(F.coalesce(F.max("last_sent") < at - F.make_interval(hours=F.lit(hours)), F.lit(True)).alias("due"))
