"""Problem 5: the most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are hashed to the nearest signed axis after fast Hadamard pseudo-rotations. Rows are stored under their
own bucket in each table and look themselves up in the nearest other buckets too (multiprobe); what meets is reranked
with exact cosines. Vectors of one direction form a class with one representative, so groups of copies cost nothing.
Before that, pairs are dropped whose sign sketches differ in more bits than a pair at the least similarity would by
SIGMAS standard deviations, which loses five in a million of the pairs just at it; hot buckets are judged alike, and with
``sigmas`` = None no pair is dropped unseen. Buckets beyond
``bucket_cap`` are compared in blocks with matrix products instead of pair rows: nothing is left out.
Vectors may have any length, given as ``dim``: they are padded with zeros to a power of two for the transform.

Defined cases: a vector that is null, of another length, all zero or not finite takes no part; a key delivered twice
counts once; equal similarities rank by key; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm import crosspoly
from quillmesh.session import materialize

DIM = 64
TABLES = 10
SEED = 20_240_501
#: Bits of a sketch, and how far above its mean a pair's number of differing bits may be.
BITS, SIGMAS = 128, 4.4
BUCKET_CAP = 2048


def most_bits(least: float, sigmas: float | None = SIGMAS) -> int:
    """The differing sketch bits up to which a pair may have a cosine of ``least``: each differs with chance arccos(least) / pi."""
    if sigmas is None:
        return BITS
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return min(BITS, math.ceil(BITS * p + sigmas * math.sqrt(BITS * p * (1 - p))))


def _hashed(tables: int, dim: int):
    wide = crosspoly.width(dim)
    signs = crosspoly.rotations(wide, 2 * tables, SEED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = pdf["embedding"].to_numpy()
            fits = np.array([v is not None and len(v) == dim for v in raw], dtype=bool)
            pdf = pdf[fits]
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in raw[fits]])
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            pdf, x = pdf[good], x[good]
            if not len(pdf):
                continue
            u = x / norm[good][:, None]
            raw32 = x.astype(np.float32)
            bits = crosspoly.sketch(u.astype(np.float32), SEED)
            unit = crosspoly.padded(u.astype(np.float32))
            main, probes = [], []
            for t in range(tables):
                a = crosspoly.nearest_axes(crosspoly.rotate(unit, signs[2 * t]), 2).astype(np.int64)
                b = crosspoly.nearest_axes(crosspoly.rotate(unit, signs[2 * t + 1]), 2).astype(np.int64)
                w = 2 * wide
                base = t * w * w
                main.append(base + a[:, 0] * w + b[:, 0])
                probes += [base + a[:, 1] * w + b[:, 0], base + a[:, 0] * w + b[:, 1]]
            yield pd.DataFrame(
                {
                    "tab": pdf["tab"].to_numpy(),
                    "id": pdf["id"].to_numpy(),
                    "n": pdf["n"].to_numpy(),
                    "way": [r.tobytes() for r in np.round(u, 5).astype(np.float32) + np.float32(0)],
                    "vec": [r.tobytes() for r in raw32],
                    "bits0": bits[:, 0],
                    "bits1": bits[:, 1],
                    "main": list(np.stack(main, axis=1).astype(np.int32)),  # numbers past 32 bits wrap: two buckets as one lose nothing
                    "probes": list(np.stack(probes, axis=1).astype(np.int32)),
                }
            )

    return run


def usable(vectors: DataFrame, tables: int = TABLES, dim: int = DIM) -> DataFrame:
    """The usable rows of (tab, id, n, embedding) with unit vector, class, sign sketch and bucket numbers."""
    schema = "tab string, id long, n int, way binary, vec binary, bits0 long, bits1 long, main array<int>, probes array<int>"
    rows = vectors.select("tab", "id", "n", "embedding").where(F.col("embedding").isNotNull() & F.col("id").isNotNull() & F.col("n").isNotNull())
    # way: equal for vectors of one direction; hashed so that a class is one number
    return rows.mapInPandas(_hashed(tables, dim), schema).withColumn("cls", F.xxhash64("tab", "way")).drop("way")


def units(vecs: pd.Series) -> np.ndarray:
    """Unit vectors, one a row, of the stored single-precision ones."""
    x = np.frombuffer(b"".join(vecs), dtype=np.float32).reshape(len(vecs), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = units(a), units(b)
    return pd.Series(np.einsum("ij,ij->i", x, y))


def _blocks(least: float, most: int):

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y = units(right["vec"])
            ids = right["cls"].to_numpy()
            for lo in range(0, len(left), 256):
                part = left.iloc[lo : lo + 256]
                x = units(part["vec"])
                i, j = np.nonzero(x @ y.T >= least)
                a, b = part["cls"].to_numpy()[i], ids[j]
                bits = sum(np.bitwise_count((part[c].to_numpy()[i] ^ right[c].to_numpy()[j]).view(np.uint64)).astype(int) for c in ("bits0", "bits1"))
                keep = (a != b) & (bits <= most)
                out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}))
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": np.array([], "int64"), "b": np.array([], "int64")})

    return run


def close_pairs(reps: DataFrame, vecs: DataFrame, least: float, bucket_cap: int = BUCKET_CAP, sigmas: float | None = SIGMAS) -> DataFrame:
    """Pairs (a, b, sim) of representatives with cosine of at least ``least``, a < b by class number.

    ``reps`` has (tab, cls, bits0, bits1, main, probes), ``vecs`` (cls, vec); one row a class in both.
    """
    most = most_bits(least, sigmas)
    here = F.xxhash64("tab", "bucket").alias("bucket")
    slim = reps.select("tab", "cls", "bits0", "bits1", F.explode("main").alias("bucket")).select("cls", "bits0", "bits1", here)
    look = reps.select("tab", "cls", "bits0", "bits1", F.explode(F.concat("main", "probes")).alias("bucket")).select("cls", "bits0", "bits1", here)
    big = slim.groupBy("bucket").count().where(F.col("count") > bucket_cap).select("bucket")
    big = materialize(big, "hot")
    hot = not big.isEmpty()
    s = slim.join(big, "bucket", "left_anti") if hot else slim
    differ = lambda c: F.bit_count(F.col(f"l.{c}").bitwiseXOR(F.col(f"s.{c}")))
    near = differ("bits0") + differ("bits1") <= most
    on = (F.col("l.bucket") == F.col("s.bucket")) & (F.col("l.cls") != F.col("s.cls")) & near
    pairs = look.alias("l").join(s.alias("s"), on).select(F.least("l.cls", "s.cls").alias("a"), F.greatest("l.cls", "s.cls").alias("b"))
    if hot:
        # the same lookups as blocks: stored rows in numbered blocks, each looked-up row sent to every block of its bucket
        vecs = materialize(vecs, "vecs")
        stored = slim.select("cls", "bucket", "bits0", "bits1").join(big, "bucket", "left_semi").join(vecs, "cls")
        n = materialize(stored.groupBy("bucket").agg(F.ceil(F.count("*") / bucket_cap).cast("int").alias("blocks")), "blocks")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        asked = look.select("cls", "bucket", "bits0", "bits1").distinct().join(n, "bucket").join(vecs, "cls")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int")).withColumn("block", every)
        stored = stored.join(n, "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("part", every)
        by = ["bucket", "block", "part"]
        # new names for the columns both sides take from the same tables
        asked = asked.select(*[F.col(c).alias(c) for c in (*by, "cls", "vec", "bits0", "bits1")])
        pairs = pairs.unionByName(asked.groupBy(*by).cogroup(stored.groupBy(*by)).applyInPandas(_blocks(least, most), "a long, b long"))
    cosine = F.pandas_udf(_cosines, "double")
    full = pairs.distinct().join(vecs.select(F.col("cls").alias("a"), F.col("vec").alias("va")), "a").join(vecs.select(F.col("cls").alias("b"), F.col("vec").alias("vb")), "b")
    return full.select("a", "b", cosine("va", "vb").alias("sim")).where(F.col("sim") >= least)


def neighbours_within(vectors: DataFrame, least: float, k: int = 10, bucket_cap: int = BUCKET_CAP, dim: int = DIM, sigmas: float | None = SIGMAS) -> DataFrame:
    """Directed (tab, id, n, id_b, n_b, sim): of each usable row its at most k most similar others with ``sim >= least``."""
    rows = materialize(usable(vectors, dim=dim), "vectors")
    keyed = rows.select("cls", F.struct("id", "n").alias("key")).distinct()
    size = keyed.groupBy("cls").agg(F.count("*").alias("size"), F.min("key").alias("key"))
    # one row a class: that of its lowest key, which may have been delivered twice
    lowest = rows.withColumn("key", F.struct("id", "n")).join(size.select("cls", F.col("key").alias("low")), "cls").where("key = low")
    reps = lowest.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("tab", "bits0", "bits1", "main", "probes")])
    vecs = lowest.groupBy("cls").agg(F.first("vec").alias("vec"))
    sims = materialize(close_pairs(materialize(reps, "reps"), vecs, least, bucket_cap, sigmas), "pairs")
    # the first k + 1 members stand for a class: whoever asks, no later member can be among its k nearest
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("key"))
    firsts = keyed.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("cls").agg(F.array_sort(F.collect_list("key")).alias("first"))
    classes = firsts.join(size.select("cls", "size"), "cls")
    copies = classes.where("size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    own = (
        keyed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int"))
        .join(copies, ["cls", "salt"])
        .select("cls", "key", F.explode(F.slice(F.filter("first", lambda x: x != F.col("key")), 1, k)).alias("other"))
        .select("cls", "key", "other", F.lit(1.0).alias("sim"))
    )
    both = sims.select("a", "b", "sim").union(sims.select("b", "a", "sim"))
    there = classes.select(F.col("cls").alias("b"), F.slice("first", 1, k).alias("first"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "other"))
    across = both.join(there, "b").select("a", "sim", F.explode("first").alias("other")).withColumn("rank", best).where(F.col("rank") <= k)
    few = classes.where(F.col("size") <= k).select(F.col("cls").alias("a"), "size", F.explode("first").alias("key"))
    across = across.join(few, "a").where(F.col("rank") <= k - (F.col("size") - 1)).select(F.col("a").alias("cls"), "key", "other", "sim")
    tabs = rows.select("cls", "tab").distinct()
    return own.unionByName(across).join(tabs, "cls").select("tab", "key.id", "key.n", F.col("other.id").alias("id_b"), F.col("other.n").alias("n_b"), "sim")


def _search(k: int):
    def run(key, asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(stored):
            y = units(stored["vec"])
            ids, ns = stored["id"].to_numpy(), stored["n"].to_numpy()
            for lo in range(0, len(asked), 256):
                part = asked.iloc[lo : lo + 256]
                x = units(part["vec"])
                s = np.round(x @ y.T, 12)
                s[(part["id"].to_numpy()[:, None] == ids) & (part["n"].to_numpy()[:, None] == ns)] = -9
                for i in range(len(part)):
                    m = min(k, len(ids))
                    floor = np.partition(s[i], len(ids) - m)[len(ids) - m]
                    j = np.nonzero(s[i] >= floor)[0]
                    j = j[np.lexsort((ns[j], ids[j], -s[i, j]))][:k]
                    j = j[s[i, j] > -9]
                    out.append(pd.DataFrame({"tab": key[0], "id": part["id"].iloc[i], "n": part["n"].iloc[i], "id_b": ids[j], "n_b": ns[j], "sim": s[i, j]}))
        empty = pd.DataFrame({"tab": pd.Series([], dtype=str), **{c: pd.Series([], dtype="int64") for c in ("id", "n", "id_b", "n_b")}, "sim": pd.Series([], dtype=float)})
        return pd.concat(out) if out else empty

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 4, probes: int = 16, block: int = 4096, dim: int = DIM) -> DataFrame:
    """(tab, id, n, id_b, n_b, sim): the k most similar rows of ``vectors`` of each row of ``queries``, both (tab, id, n, embedding).

    One signed axis is a bucket; each query looks into its ``probes`` nearest axes in every table. Buckets are cut into
    blocks of about ``block`` rows, and every block gives each query its k best, so no task holds a whole bucket.
    """
    wide = crosspoly.width(dim)
    signs = crosspoly.rotations(wide, tables, SEED + 1)

    def hashed(many: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                u = crosspoly.padded(units(pdf["vec"]).astype(np.float32)) if len(pdf) else np.zeros((0, wide), np.float32)
                if len(u):
                    axes = np.stack([t * 2 * wide + crosspoly.nearest_axes(crosspoly.rotate(u, signs[t]), min(many, 2 * wide)) for t in range(tables)], axis=1).reshape(len(u), -1)
                    yield pd.DataFrame({"tab": pdf["tab"], "id": pdf["id"], "n": pdf["n"], "vec": pdf["vec"], "bucket": list(axes.astype(np.int32))})

        return run

    plain = lambda df: usable(df, tables=1, dim=dim).select("tab", "id", "n", "vec").dropDuplicates(["tab", "id", "n"])
    schema = "tab string, id long, n int, vec binary, bucket array<int>"
    stored = materialize(plain(vectors).mapInPandas(hashed(1), schema), "stored").withColumn("bucket", F.explode("bucket"))
    counts = stored.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counts = materialize(counts, "blocks")
    asked = plain(queries).mapInPandas(hashed(probes), schema).withColumn("bucket", F.explode("bucket")).join(counts, ["tab", "bucket"])
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    stored = stored.join(counts, ["tab", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id", "n"), F.col("blocks")).cast("int")).drop("blocks")
    by = ["tab", "bucket", "block"]
    found = asked.groupBy(*by).cogroup(stored.groupBy(*by)).applyInPandas(_search(k), "tab string, id long, n int, id_b long, n_b int, sim double").distinct()
    best = F.row_number().over(Window.partitionBy("tab", "id", "n").orderBy(F.desc("sim"), "id_b", "n_b"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)
