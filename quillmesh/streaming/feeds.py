"""Incremental ingest as Structured Streaming (ST-1 to ST-10): each micro-batch goes through the batch operators.

History that grows without end is a table, not state: a micro-batch is anti-joined against it. What is bounded by time,
such as repeats within two minutes, is watermarked state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators import stories, vectors
from quillmesh.operators.ingest import first_forms
from quillmesh.operators.ledger import run_outcome
from quillmesh.operators.state import last_write_wins


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


BUCKETS = 64


def _bucket(*keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def ingest_urls(stream: DataFrame, seen_path: str, checkpoint: str) -> StreamingQuery:
    """Adds the unseen URLs of each micro-batch to the table of seen ones, its batch number beside them.

    The table holds canonical forms in buckets of their hash: a micro-batch canonicalizes its own records only, and reads
    only the buckets these fall into. One that runs again after a failure finds its rows under its number and adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = first_forms(batch).select(F.col("canonical").alias("canonical_url"), "source", F.lit(number).cast("long").alias("batch"), _bucket("canonical").alias("bucket")).persist()
        seen = spark.read.schema("canonical_url string, source string, batch long, bucket int")
        seen = seen.parquet(seen_path) if exists(spark, seen_path) else spark.createDataFrame([], "canonical_url string, source string, batch long, bucket int")
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        fresh.join(seen.where(F.col("bucket").isin(touched)).select("canonical_url"), "canonical_url", "left_anti").write.partitionBy("bucket").mode("append").parquet(seen_path)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(stream: DataFrame, keys: list[str], time: str, within: str = "2 minutes") -> DataFrame:
    """The stream without rows whose key came within the time before; the state is as long as the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def into_table(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table by key: each micro-batch is merged into the buckets its keys fall into, and the pointer moves last.

    Only these buckets are read and written anew; the pointer tells each bucket's version, and versions it has left behind
    are deleted with the batch after. ``merge`` gets the present rows of the buckets (None at first) and the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = _pointer(spark, path)
        if now.get("last", -1) >= number:
            return
        new = batch.withColumn("_bucket", _bucket(*keys)).persist()
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most BUCKETS numbers
        if touched:
            base = _rows(spark, path, {str(b): now[str(b)] for b in touched if str(b) in now})
            done = merge(base, new.drop("_bucket")).withColumn("_bucket", _bucket(*keys))
            done.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{number}")
        new.unpersist()
        left = {k: v for k, v in now.items() if k not in ("last", "gone")}
        gone = [f"v{left[str(b)]}/_bucket={b}" for b in touched if str(b) in left]
        _point(spark, path, left | {str(b): number for b in touched} | {"last": number, "gone": gone})
        for folder in now.get("gone", []):
            _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _rows(spark: SparkSession, path: str, versions: dict[str, int]) -> DataFrame | None:
    """The rows of buckets, each of its version; a folder of one version is one table."""
    out = None
    for v in sorted(set(versions.values())):
        part = spark.read.option("basePath", f"{path}/v{v}").parquet(*[f"{path}/v{v}/_bucket={b}" for b, w in versions.items() if w == v]).drop("_bucket")
        out = part if out is None else out.unionByName(part)
    return out


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, path: str) -> dict:
    kept = sorted(s.getPath().getName() for s in _files(spark, path).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().startswith("pointer-")) if exists(spark, path) else []
    return json.loads(spark.read.text(f"{path}/{kept[-1]}").first()[0]) if kept else {}


def _point(spark: SparkSession, path: str, now: dict) -> None:
    out = _files(spark, path).create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer-{now['last']:012d}"), True)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The present rows of ``into_table``; at most BUCKETS versions are live."""
    now = _pointer(spark, path)
    return _rows(spark, path, {b: v for b, v in now.items() if b not in ("last", "gone")})


def run_ledger(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs from their events (id, at, kind, urls_new, scraped, made, error): ``running`` until a finish, then ok, partial or failed (ST-10)."""

    def merge(base: DataFrame | None, batch: DataFrame) -> DataFrame:
        done = F.col("kind") == "finished"
        status = F.when(done, run_outcome(F.coalesce("urls_new", F.lit(0)), F.coalesce("error", F.lit("")), F.coalesce("scraped", F.lit(0)), F.coalesce("made", F.lit(0)))).otherwise("running")
        rows = batch.select("id", "at", status.alias("status"))
        return last_write_wins(rows if base is None else base.unionByName(rows), ["id"], ["at", "status"])

    return into_table(events, merge, ["id"], path, checkpoint)


def brief_cursors(asks: DataFrame, first_days: int = 7) -> DataFrame:
    """(chat_id, id, since, page) of a stream of asks (chat_id, id, at, more, topic, days): from when and which page each brief shows (ST-7).

    The state of a chat is its cursor: when it was last told, and the window and page it is in. Only a plain ask, without a
    topic or days, moves the first; ``more`` turns the page of the present window.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, since, page = state.get if state.exists else (None, None, 0)
        out = []
        for r in sorted((r for pdf in batches for r in pdf.itertuples()), key=lambda r: (r.at, r.id)):
            week = int(r.at.timestamp()) - first_days * 86400
            asked = None if r.days is None or pd.isna(r.days) else int(r.at.timestamp()) - int(r.days) * 86400
            if r.more:
                since, page = since if since is not None else week, page + 1
            else:
                since, page = asked if asked is not None else last if last is not None else week, 0
                if asked is None and not r.topic:
                    last = int(r.at.timestamp())
            out.append((key[0], r.id, since, page))
        state.update((last, since, page))
        yield pd.DataFrame(out, columns=["chat_id", "id", "since", "page"])

    return asks.groupBy("chat_id").applyInPandasWithState(step, "chat_id long, id long, since long, page int", "last long, since long, page int", "append", "NoTimeout")


def drain(ticks: DataFrame, waiting: Callable[[SparkSession], DataFrame], busy: Callable[[SparkSession], bool], work: Callable[[DataFrame], None], checkpoint: str, most: int = 12) -> StreamingQuery:
    """At each tick the ``most`` oldest rows (id) that are waiting are worked on, unless a run is under way (ST-6)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not batch.isEmpty() and not busy(spark):
            work(waiting(spark).orderBy("id").limit(most))

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assign_stories(items: DataFrame, path: str, checkpoint: str, least: float = 0.87) -> StreamingQuery:
    """Each micro-batch of items (id, v) gets its stories in order of id: an item joins the story of its nearest older one from ``least`` on (ST-9).

    Older items are those stored, with their roots, and those of the batch; a batch that runs again replaces its own part.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "id long, v array<double>, root long, batch long"
        old = spark.read.schema(schema).parquet(path).where(F.col("batch") < number) if exists(spark, path) else spark.createDataFrame([], schema)
        new = batch.select("id", F.col("v").cast("array<double>").alias("v")).dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").persist()
        # the new ones against all, each against the lower ids
        near = vectors.nearest_older(old.select("id", "v").unionByName(new.select("id", "v")), asked=new.select("id")).where(F.col("sim") >= least)
        met = near.select("id", "older").join(old.select(F.col("id").alias("older"), F.col("root").alias("known")), "older", "left")
        parents = new.select("id").join(met.select("id", F.when(F.col("known").isNull(), F.col("older")).alias("parent"), "known"), "id", "left")
        roots = stories.roots(parents.select("id", "parent")).join(parents.select(F.col("id").alias("root"), "known"), "root")
        rows = new.join(roots.select("id", F.coalesce("known", "root").alias("root")), "id")
        rows.select("id", "v", "root").write.mode("overwrite").parquet(f"{path}/batch={number}")
        new.unpersist()

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
