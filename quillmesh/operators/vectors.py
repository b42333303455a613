"""Exact vector search in blocks: nearest neighbours of a query set, and nearest older neighbours (J-4 to J-6, M-1, M-4 to M-6).

Rows are cut into blocks by hash, and pairs of blocks are compared with one matrix product each; what leaves a task is
the best of its block pair. No pairs of rows are made by a join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(v: Column, dim: int) -> Column:
    """Not null, of the right length, finite, and not all zero."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def band(sim: Column, merge: float = 0.87, check: float = 0.80) -> Column:
    """merge, check or new; null and NaN are new."""
    return F.when(sim.isNull() | F.isnan(sim), "new").when(sim >= merge, "merge").when(sim >= check, "check").otherwise("new")


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in v])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(df.count() / rows))


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(q, id, sim): the k rows (id, v) most similar to each query (q, v), ties to the lower id; exact."""
    nq, nr = _blocks(queries, block), _blocks(rows, block)
    left = queries.withColumn("i", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    right = rows.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            y, ids = _units(b["v"]), b["id"].to_numpy()
            for lo in range(0, len(a), 256):
                part = a.iloc[lo : lo + 256]
                s = np.round(_units(part["v"]) @ y.T, 12)
                for q, row in zip(part["q"], s):
                    at = np.lexsort((ids, -row))[:k]
                    out.append(pd.DataFrame({"q": q, "id": ids[at], "sim": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"q": np.array([], "int64"), "id": np.array([], "int64"), "sim": np.array([], float)})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "q long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_older(rows: DataFrame, block: int = 4096, group: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(id, older, sim): of each row (id, v) the most similar one with a lower id, ties to the lower; exact.

    With ``group``, rows of the same group don't count; with ``asked`` (id) only these rows are answered.
    """
    n = _blocks(rows, block)
    g = F.col(group) if group else F.lit(None).cast("long")
    base = rows.select("id", "v", g.alias("g"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base if asked is None else base.join(asked.select("id"), "id", "left_semi")
    # new names for the columns both sides take from the same rows
    left = left.select("id", "v", "g", F.col("b").alias("i")).select(*[F.col(c).alias(c) for c in ("id", "v", "g", "i")]).withColumn("j", every)
    right = base.withColumnRenamed("b", "j").withColumn("i", every)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            y, ids, groups = _units(b["v"]), b["id"].to_numpy(), b["g"].to_numpy(dtype=float)
            order = np.argsort(ids)
            y, ids, groups = y[order], ids[order], groups[order]
            for lo in range(0, len(a), 256):
                part = a.iloc[lo : lo + 256]
                s = np.round(_units(part["v"]) @ y.T, 12)
                own = part["id"].to_numpy()
                s[ids[None, :] >= own[:, None]] = -9
                if group:
                    s[groups[None, :] == part["g"].to_numpy(dtype=float)[:, None]] = -9
                at = s.argmax(axis=1)
                got = s[np.arange(len(part)), at]
                out.append(pd.DataFrame({"id": own, "older": ids[at], "sim": got})[got > -9])
        return pd.concat(out) if out else pd.DataFrame({"id": np.array([], "int64"), "older": np.array([], "int64"), "sim": np.array([], float)})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "id long, older long, sim double")
    top = F.max(F.struct("sim", (-F.col("older")).alias("o")))
    return met.groupBy("id").agg(top.alias("t")).select("id", (-F.col("t.o")).alias("older"), "t.sim")
