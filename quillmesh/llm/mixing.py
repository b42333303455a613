"""Problem 7: mixing sources to target shares of tokens.

The documents of a source are laid end to end in a pseudorandom order and cut into blocks of a fixed number of tokens; a
document that lies over a block's edge is cut there, so only the last block of a source is shorter. A source's blocks are
used pass after pass, at most max_repeats times; each pass visits them by a pseudorandom permutation of their indices of
its own (a keyed Feistel network that walks its cycles), so the last, partial pass takes a random part of them. Every
shard's counts by source are drawn from the multinomial of the target shares; then as few slots as the draws are off are
moved between sources in randomly drawn shards, so that shards are of one size and the totals by source are exact. A
shard takes the next slots of each source, in an order permuted likewise. Slots and blocks are joined by index: the
inverse permutation tells each block its slots, so nothing is shuffled for it.

Without a given total, the largest is taken that every source with a target and documents can serve under its cap.
Targets of sources without documents can't be met; the rest keep their proportions to each other.

Defined cases: sources are compared trimmed and in lower case; null sources and sources without a target are left out;
null and empty texts have no tokens and are never chosen; a document delivered twice counts once; null ids are left out;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.tokens import TOKENIZER, count_tokens
from quillmesh.session import materialize

BLOCK_TOKENS = 512
#: Documents that one window sums up, on average, and the least number of such stretches a source is cut into.
STRETCH, STRETCHES = 50_000, 256
#: Slots of a shard, unless that makes fewer than SHARDS shards, or more counts by shard and source than MOST_COUNTS.
SHARD_SLOTS, SHARDS, MOST_COUNTS = 4096, 64, 4_000_000
MOST_SOURCES = 10_000
ROUNDS = 6

_U = np.uint64


def _plain(source):
    return F.lower(F.trim(source))


def _mixed(half: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    x = (half + key + _U(turn) * _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """The place of each index under the permutation of range(size) that its key names, or with ``back`` the index at each place."""
    x, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2 + 1e-12).astype(np.uint64)
    bits = np.maximum(bits, _U(1))
    mask = (_U(1) << bits) - _U(1)
    todo = np.arange(len(x))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = x[todo] >> b, x[todo] & m
        for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = right ^ (_mixed(left, k, turn) & m), left
            else:
                left, right = right, left ^ (_mixed(right, k, turn) & m)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= size[todo]]  # outside: walk on along the cycle
    return x.astype(np.int64)


def _keys(number: np.ndarray, use: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(number.astype(np.uint64), use.astype(np.uint64) << _U(20), seed)


def draw_counts(used: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Slots of each shard by source (shards, sources): multinomial draws, then mended so that rows are even and columns add up to ``used``."""
    total = int(used.sum())
    sizes = np.full(shards, total // shards, dtype=np.int64)
    sizes[: total % shards] += 1
    counts = np.stack([rng.multinomial(n, used / total) for n in sizes]).astype(np.int64)
    over = counts.sum(axis=0) - used
    free = np.zeros(shards, dtype=np.int64)
    for s in np.nonzero(over > 0)[0]:
        gone = _spread(int(over[s]), counts[:, s], rng)
        counts[:, s] -= gone
        free += gone
    for s in np.nonzero(over < 0)[0]:
        more = _spread(int(-over[s]), free, rng)
        counts[:, s] += more
        free -= more
    return counts


def _spread(n: int, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """n units drawn over places in proportion to their room, none above it."""
    out = np.zeros(len(room), dtype=np.int64)
    while n:
        left = room - out
        step = np.minimum(rng.multinomial(n, left / left.sum()), left)
        out += step
        n -= int(step.sum())
    return out


def _running(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the source's rows before each row, by (bucket, *order); sums of buckets first, then within each."""
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("source", "bucket").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums.select("source", "bucket", "_base"), ["source", "bucket"]).withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base")


_SCHEMA = "shard int, position long, source string, block long, use int, doc_id long, from_token long, tokens long"


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 7, block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> DataFrame:
    """(shard, position, source, block, use, doc_id, from_token, tokens): the documents, or their parts, of the block at each position of each shard.

    ``docs`` has doc_id, source and text; ``targets`` (source, target_share, max_repeats) is a table of parameters.
    """
    spark = docs.sparkSession
    t = targets.select(_plain("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goal = {r.source: r for r in t.limit(MOST_SOURCES + 1).collect()}
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    if not goal:
        return spark.createDataFrame([], _SCHEMA)
    known = docs.select("doc_id", _plain("source").alias("source"), "text").where(F.col("source").isin(list(goal)) & F.col("doc_id").isNotNull())
    counted = count_tokens(known, "doc_id", "source", path=tokenizer).where("tokens > 0")
    counted = counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("d")).select("doc_id", "d.*")
    counted = materialize(counted.withColumn("mixed", F.xxhash64("doc_id", F.lit(seed))), "tokens")
    have = {r.source: r for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}  # one row a target
    if not have:
        return spark.createDataFrame([], _SCHEMA)
    names = sorted(have)
    share = np.array([goal[s].target_share for s in names])
    share /= share.sum()
    tokens = np.array([have[s].tokens for s in names], dtype=np.int64)
    repeats = np.array([goal[s].max_repeats for s in names], dtype=np.int64)
    total = float((tokens * repeats / share).min())
    total = min(total, total_tokens) if total_tokens else total
    blocks = -(-tokens // block_tokens)
    # a source's blocks hold this many tokens on average, its short last one included
    used = np.minimum(np.rint(share * total / (tokens / blocks)).astype(np.int64), blocks * repeats)
    slots = int(used.sum())
    if not slots:
        return spark.createDataFrame([], _SCHEMA)
    n_shards = shards or max(1, min(max(SHARDS, -(-slots // SHARD_SLOTS)), MOST_COUNTS // len(names)))
    counts = draw_counts(used, n_shards, np.random.default_rng(seed))
    ends, sizes = np.cumsum(counts, axis=0), counts.sum(axis=1)
    offset = np.cumsum(counts, axis=1) - counts  # of a source in its shard
    shared = spark.sparkContext.broadcast((names, blocks, used, ends, counts, offset, sizes))  # at most MOST_COUNTS counts

    def slot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, blocks, used, ends, counts, offset, sizes = shared.value
        number = {s: i for i, s in enumerate(names)}
        for pdf in batches:
            s = pdf["source"].map(number).to_numpy(dtype=np.int64)
            passes = -(-used[s] // blocks[s])
            row = np.repeat(np.arange(len(pdf)), passes)
            use = np.arange(len(row)) - np.repeat(np.cumsum(passes) - passes, passes)
            s = s[row]
            block = pdf["block"].to_numpy()[row]
            at = use * blocks[s] + permuted(block, blocks[s], _keys(s, use, seed), back=True)
            keep = at < used[s]
            row, use, s, block, at = row[keep], use[keep], s[keep], block[keep], at[keep]
            shard = np.zeros(len(at), dtype=np.int64)
            for i in np.unique(s):
                shard[s == i] = np.searchsorted(ends[:, i], at[s == i], side="right")
            within = offset[shard, s] + at - (ends[shard, s] - counts[shard, s])
            place = permuted(within, sizes[shard], _keys(shard, np.full(len(shard), 1 << 30), seed))
            out = pdf.iloc[row][["source", "doc_id", "from_token", "tokens"]].reset_index(drop=True)
            yield out.assign(shard=shard.astype(np.int32), position=place, block=block, use=use.astype(np.int32))[["shard", "position", "source", "block", "use", "doc_id", "from_token", "tokens"]]

    stretches = int(max(STRETCHES, -(-max(r.n for r in have.values()) // STRETCH)))
    # buckets follow the order of the hash
    bucket = F.least(F.lit(stretches - 1), F.floor((F.col("mixed") / 2.0**64 + 0.5) * stretches)).cast("int")
    laid = _running(counted.withColumn("bucket", bucket), "tokens", ["mixed", "doc_id"], "start")
    size, last = F.lit(block_tokens).cast("long"), F.col("start") + F.col("tokens") - 1
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))
    begin = F.greatest(F.col("start"), F.col("block") * size)
    pieces = pieces.select("source", "doc_id", "block", (begin - F.col("start")).alias("from_token"), (F.least(last + 1, (F.col("block") + 1) * size) - begin).alias("tokens"))
    return pieces.mapInPandas(slot, _SCHEMA)


def documents(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, repeats, tokens): the chosen documents, how often the part used most is used, and their tokens over all uses."""
    each = mixed.groupBy("doc_id", "source", "from_token").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return each.groupBy("doc_id", "source").agg(F.max("n").cast("int").alias("repeats"), F.sum("tokens").alias("tokens"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_repeats) of a mixture, sources without documents too."""
    used = documents(mixed).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    used = used.withColumn("all", F.sum("tokens").over(Window.partitionBy()))  # one row a target
    t = targets.select(_plain("source").alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    joined = t.join(used, "source", "left")
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
