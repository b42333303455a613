"""Problem 6: filling containers of fixed capacity by large-item matching.

The token counts are reduced to how many items there are of each size, at most one number per size up to the capacity,
so the plan of the containers is made from a table whose length the capacity bounds, whatever the number of documents.
Items above a third of the capacity are matched greedily, at most two to a container; smaller ones fill the tightest gap
that holds them. The plan is a list of container kinds, each with its number; documents then find their place by their
rank among the items of their size, in parallel.

Defined cases: null and empty texts have no tokens and are in no container; a document delivered twice counts once; a
text beyond the capacity gives full containers and one rest, its parts numbered from 1; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.tokens import TOKENIZER, count_tokens
from quillmesh.session import materialize

#: Items of one size that are ranked in one stretch, on average.
STRETCH = 100_000
#: Most different sizes that are planned on the driver, over all limits; where the capacities allow more, sizes are rounded up to multiples.
MOST_SIZES = 5_000_000


class _Gaps:
    """Container kinds by free room; kinds are (contents, number of containers)."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.kinds: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)

    def add(self, room: int, contents: tuple, number: int) -> None:
        if number <= 0:
            return
        if not self.kinds[room]:
            bisect.insort(self.rooms, room)
        self.kinds[room].append((contents, number))

    def tightest(self, size: int):
        """Takes out a kind with the least room of at least ``size``, or None."""
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        contents, number = self.kinds[room].pop()
        if not self.kinds[room]:
            self.rooms.pop(at)
        return room, contents, number


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(number of containers, ((size, items of it), ...))] for ``sizes`` = {size: items}, none above the capacity."""
    large = {s: n for s, n in sizes.items() if 3 * s > capacity and n > 0}
    small = sorted((s for s, n in sizes.items() if 3 * s <= capacity and n > 0), reverse=True)
    gaps = _Gaps()
    left = sorted(large)
    while left:
        a = left[-1]
        n = large[a]
        at = bisect.bisect_right(left, capacity - a) - 1
        if at < 0:
            gaps.add(capacity - a, ((a, 1),), n)
            left.pop()
            continue
        b = left[at]
        pairs = n // 2 if a == b else min(n, large[b])
        if pairs == 0:  # one item is left of the only size that it would go with
            at -= 1
            if at < 0:
                gaps.add(capacity - a, ((a, 1),), 1)
                left.pop()
                continue
            b = left[at]
            pairs = 1
        gaps.add(capacity - a - b, ((a, 2),) if a == b else ((a, 1), (b, 1)), pairs)
        for s, used in ((a, pairs), (b, pairs)):
            large[s] -= used
        left = [s for s in left if large[s] > 0] if large[a] <= 0 or large[b] <= 0 else left
    for s in small:
        n = sizes[s]
        while n > 0:
            found = gaps.tightest(s)
            room, contents, number = found or (capacity, (), n)
            each = room // s
            full = min(number, n // each)
            rest = min(n - full * each, each) if full < number else 0
            gaps.add(room - full // max(full, 1) * each * s, contents + ((s, each),), full)
            if rest:
                gaps.add(room - rest * s, contents + ((s, rest),), 1)
            if found:
                gaps.add(room, contents, number - full - (1 if rest else 0))
            n -= full * each + rest
    return [(number, contents) for room in gaps.rooms for contents, number in gaps.kinds[room]]


def _places(kinds: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: the first rank of each stretch of items, its first container, and how many items a container takes."""
    at: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 1
    for number, contents in kinds:
        for size, each in contents:
            out[size].append((at[size], base, each))
            at[size] += number * each
        base += number
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for s, rows in out.items()}


def pack(docs: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, stretch: int = STRETCH, most_sizes: int = MOST_SIZES) -> DataFrame:
    """(limit_id, container, doc_id, part, from_token, tokens): every document, or its parts, in containers of each limit.

    ``docs`` has doc_id and text; ``limits`` (limit_id, capacity_tokens, separator_tokens) is a table of parameters.
    """
    spark = docs.sparkSession
    caps = {r.limit_id: (r.capacity_tokens, r.separator_tokens or 0) for r in limits.where("capacity_tokens > 0 and limit_id is not null").select("limit_id", "capacity_tokens", "separator_tokens").limit(10_001).collect()}
    if len(caps) > 10_000:
        raise ValueError("more than 10,000 limits")
    # a rounded size is never smaller, so no container overflows; it wastes less than step / capacity of the room
    step = {k: max(1, -(-(c + s) * len(caps) // most_sizes)) for k, (c, s) in caps.items()}
    sized = materialize(count_tokens(docs.where(F.col("doc_id").isNotNull()), "doc_id", path=tokenizer).where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens")), "tokens")
    schema = "limit_id int, container long, doc_id long, part int, from_token long, tokens long"
    if not caps:
        return spark.createDataFrame([], schema)
    rules = F.array(*[F.struct(F.lit(k).cast("int").alias("limit_id"), F.lit(c).cast("long").alias("cap"), F.lit(s).cast("long").alias("sep"), F.lit(step[k]).cast("long").alias("step")) for k, (c, s) in sorted(caps.items())])
    each = sized.select("doc_id", "tokens", F.inline(rules))
    parts = each.withColumn("part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("tokens") / F.col("cap")).cast("int"))))
    start = (F.col("part") - 1) * F.col("cap")
    items = parts.select(
        "limit_id", "doc_id", "part", start.alias("from_token"), F.least("cap", F.col("tokens") - start).alias("tokens"), F.least(F.ceil((F.least("cap", F.col("tokens") - start) + F.col("sep")) / F.col("step")) * F.col("step"), F.col("cap") + F.col("sep")).cast("long").alias("size"),
    )
    # a size with many items is ranked in as many stretches as it needs: one counter for each size up to the capacity, and for each stretch
    ways = items.groupBy("limit_id", "size").agg(F.ceil(F.count("*") / stretch).cast("int").alias("ways"))
    hot = {(r.limit_id, r.size): r.ways for r in ways.where("ways > 1").collect()}
    salt = F.lit(0)
    if hot:
        many = F.broadcast(spark.createDataFrame([(*k, w) for k, w in hot.items()], "limit_id int, size long, ways int"))  # bounded by the capacities, see MOST_SIZES
        items = items.join(many, ["limit_id", "size"], "left")
        salt = F.pmod(F.xxhash64("doc_id", "part"), F.coalesce("ways", F.lit(1))).cast("int")
    items = items.select("limit_id", "doc_id", "part", "from_token", "tokens", "size", salt.alias("salt"))
    counts = items.groupBy("limit_id", "size", "salt").count().collect()
    sizes: dict[int, dict[int, int]] = {k: defaultdict(int) for k in caps}
    offset: dict[tuple[int, int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r.limit_id, r.size, r.salt)):
        offset[r.limit_id, r.size, r.salt] = sizes[r.limit_id][r.size]
        sizes[r.limit_id][r.size] += r["count"]
    places = {k: _places(plan(dict(sizes[k]), c + s)) for k, (c, s) in caps.items()}
    shared = spark.sparkContext.broadcast((offset, places))  # bounded by the capacities, see MOST_SIZES

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offset, places = shared.value
        for pdf in batches:
            container = np.zeros(len(pdf), dtype=np.int64)
            for (limit, size, salt), rows in pdf.groupby(["limit_id", "size", "salt"], sort=False).indices.items():
                rank = pdf["rank"].to_numpy()[rows] - 1 + offset[limit, size, salt]
                first, base, many = places[limit][size]
                i = np.searchsorted(first, rank, side="right") - 1
                container[rows] = base[i] + (rank - first[i]) // many[i]
            yield pdf.assign(container=container)[["limit_id", "container", "doc_id", "part", "from_token", "tokens"]]

    rank = F.row_number().over(Window.partitionBy("limit_id", "size", "salt").orderBy("doc_id", "part"))
    return items.withColumn("rank", rank).mapInPandas(put, schema)


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, documents, tokens and the share of room used, separators counted as used."""
    per = packed.groupBy("limit_id", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    joined = per.join(limits.select("limit_id", "capacity_tokens", "separator_tokens").dropDuplicates(["limit_id"]), "limit_id")
    used = F.sum(F.col("tokens") + (F.col("items") - 1) * F.coalesce("separator_tokens", F.lit(0)))
    return joined.groupBy("limit_id").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (used / F.sum("capacity_tokens")).alias("used_share"), F.max(F.col("tokens") + (F.col("items") - 1) * F.coalesce("separator_tokens", F.lit(0)) - F.col("capacity_tokens")).alias("most_over")
    )
