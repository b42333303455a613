"""Problem 1: new batches against all history, by immutable per-batch suffix arrays.

URLs: the first record of each canonical form and the forms seen before are found in one pass; all others are known.
Canonical forms are stored once, so a later batch doesn't canonicalize the past again.

Pages: the words of a batch's main bodies are laid end to end, and the suffixes that begin at a minimizer (any run of 16
words holds one) are put in order of their first twelve words, each word by its 5-bit number: the batch's suffix array.
It is kept in shards by a hash of these words and never changed; a shard is one row, whose columns are arrays in suffix
order, so Spark moves few large values instead of a row a suffix. A search takes the batch's substrings shard by shard to the stored arrays, finds the stretch of suffixes that begin with each by binary search, and
adds up, over the substrings met, how much of the record each earlier one covers. What is covered enough is compared by
the exact Jaccard similarity of five-word sequences, the lowest strongly covered record first. Bodies under 150 words
have all their five-word suffixes in the array. Arrays of one level are merged pairwise, so n batches leave at most
log2(n) + 1 to search; a manifest in the history's folder lists them, and merged ones are deleted.

Hot passages: a substring in more than HOT bodies of an array is kept as a mark only, so no list is longer than that, and
how much of a body is hot is kept beside it. Two near bodies share six tenths of their five-word sequences, so a short
body whose hot ones are fewer still meets its like on the others, with as much less to be covered. Bodies with more of
them, or with a long hot suffix, are compared among themselves through the rarest two fifths of their five-word sequences: two sets
of similarity 0.6 must share one of these (prefix filtering). Their lists are read from the lowest id up in blocks, and
a record stops as soon as nothing lower can be left.

Defined cases: null and unreadable URLs are never known; a record delivered twice counts once; null ids and bodies
without words never count; bodies of fewer than five words are duplicates only if they are equal; rows may come in any
order of ids (a late lower id corrects rows already answered); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.urls import canon
from quillmesh.llm import wrappers
from quillmesh.session import materialize, shared_dir

SHINGLE = 5
SIMILARITY = 0.6
#: Words of a suffix that its key holds, and suffixes among which one is kept.
DEPTH, WINDOW = 12, 5
#: Bodies below SHORT words can be near others without a common run of 16; those below SHORT / 0.6 have all five-word suffixes.
SHORT = 90
#: Shares of a record, in ten thousandths: what long matches must cover of it, and from where on it is compared first.
COVER, STRONG = 400, 5000
#: Most suffixes with one key that an array lists: twelve words that more bodies share are a passage that is passed around.
HOT = 64
#: Share of a body's five-word sequences, in ten thousandths, from which on they are too hot to meet its like on the others.
HOT_SHARE = 5500
#: Suffixes in a shard at most, on average, and from how many on another shard is worth its files.
SHARD_ROWS, SPREAD_ROWS = 500_000, 50_000
BLOCK = 16
_SPLIT = 100_000

_WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


def known_records(seen: DataFrame, batch: DataFrame) -> DataFrame:
    """rec_id of every record of ``batch`` (rec_id, url) whose canonical URL is in ``seen`` (canonical_url) or on a lower rec_id."""
    new = batch.where(F.col("rec_id").isNotNull()).select("rec_id", canon(F.col("url")).alias("c")).where("c is not null")
    return _known(materialize(new, "urls"), seen.select(canon(F.col("canonical_url")).alias("c")).where("c is not null"))


def _known(new: DataFrame, old: DataFrame) -> DataFrame:
    old = old.select(F.lit(-(2**63)).alias("rec_id"), "c")
    first = new.unionByName(old).groupBy(F.xxhash64("c").alias("h"), "c").agg(F.min("rec_id").alias("rec_id")).select("rec_id")
    return new.select("rec_id").join(first, "rec_id", "left_anti").distinct()


def word_numbers(text: str, cache: dict[str, int]) -> np.ndarray:
    """32-bit numbers of the words of a text: runs of letters, digits and underscores in lower case."""
    words = _WORD.findall(text.lower())
    for w in set(words).difference(cache):
        cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(cache.__getitem__, words), np.uint32, len(words))


def fingerprints(words: np.ndarray, depth: int) -> np.ndarray:
    """64-bit fingerprints of every run of ``depth`` words."""
    if len(words) < depth:
        return np.array([], dtype=np.uint64)
    n = len(words) - depth + 1
    h = np.zeros(n, dtype=np.uint64)
    wide = words.astype(np.uint64)
    for k in range(depth):
        h = h * _MULT + wide[k : k + n] + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _leading(words: np.ndarray, at: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """The first ``depth`` words of the suffixes at ``at`` as one number that keeps their order."""
    small = (words >> np.uint32(32 - bits)).astype(np.int64)
    key = np.zeros(len(at), dtype=np.int64)
    for k in range(depth):
        key = (key << bits) | small[at + k]
    return key


def suffixes(bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the body, part): the kept suffixes of bodies laid end to end; part is their share of the body in ten thousandths.

    Keys of long suffixes are positive, those of five-word ones negative; one key of a body is given once.
    """
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    words = np.concatenate([*bodies, np.zeros(DEPTH + WINDOW, np.uint32)])
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(bodies)), size)
    end = first[1:][owner]
    at = np.arange(len(owner))
    keys, docs, parts = [], [], []
    long = size[owner] >= SHORT
    if long.any():
        h = fingerprints(words, DEPTH)[: len(owner)]
        h[at + DEPTH > end] = _NONE
        padded = np.concatenate([h, np.full(WINDOW, _NONE)])
        low, where = padded[: len(owner)].copy(), at.copy()
        for k in range(1, WINDOW):
            other = padded[k : k + len(owner)]
            less = other < low
            low[less], where[less] = other[less], at[less] + k
        kept = np.unique(where[long & (at + WINDOW - 1 + DEPTH <= end)])
        span = np.minimum(np.diff(np.append(kept, len(owner) + DEPTH)), end[kept] - kept)
        keys.append(_leading(words, kept, DEPTH, 5))
        docs.append(owner[kept])
        parts.append(-(-10_000 * span // size[owner[kept]]))
    dense = np.nonzero((size[owner] < SHORT / SIMILARITY) & (at + SHINGLE <= end))[0]
    if len(dense):
        keys.append(_leading(words, dense, SHINGLE, 12) + np.int64(-(2**63)))
        docs.append(owner[dense])
        parts.append(np.zeros(len(dense), np.int64))
    tiny = [(i, b) for i, b in enumerate(bodies) if 0 < len(b) < SHINGLE]
    if tiny:
        keys.append(np.array([zlib.crc32(b.tobytes()) - 2**62 for _, b in tiny], dtype=np.int64))
        docs.append(np.array([i for i, _ in tiny], dtype=np.int64))
        parts.append(np.zeros(len(tiny), np.int64))
    if not keys:
        return (np.array([], np.int64),) * 3
    key, doc, part = np.concatenate(keys), np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((key, doc))
    key, doc, part = key[order], doc[order], part[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    start = np.nonzero(new)[0]
    key, doc, part = key[start], doc[start], np.add.reduceat(part, start)
    # five-word sequences of a body weigh alike and add up to the whole
    few = key < 0
    many = np.bincount(doc[few], minlength=len(bodies))
    part[few] = -(-10_000 // many[doc[few]])
    return key, doc, part


@lru_cache(maxsize=256)
def shingles(words: bytes) -> np.ndarray:
    """The distinct fingerprints of a body's five-word sequences, in order."""
    return np.unique(fingerprints(np.frombuffer(words, dtype=np.uint32), SHINGLE))


def jaccard(a: bytes, b: bytes, least: float = 0.0) -> float:
    """Similarity of two bodies; 0 where their sizes alone keep it below ``least``. Equal bodies have 1, however short."""
    if a == b:
        return 1.0
    x, y = shingles(a), shingles(b)
    if not len(x) or not len(y) or min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _words_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    bodies = wrappers.body_of_group(pdf)
    cache: dict[str, int] = {}
    return pd.DataFrame({"id": bodies["id"], "words": [word_numbers(t, cache).tobytes() for t in bodies["body"]]}).astype({"id": "int64"})


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cache: dict[str, int] = {}
        yield pd.DataFrame({"id": pdf["id"], "words": [word_numbers(t, cache).tobytes() for t in pdf["body"]]})


def body_words(docs: DataFrame) -> DataFrame:
    """(id, words): the main body of every row of (id, canonical_url, scraper, markdown) as word numbers; bodies without words are left out."""
    pages = wrappers._with_furniture(docs)
    found = wrappers._grouped(pages, wrappers.GROUP).groupBy("grp").applyInPandas(_words_of_group, "id long, words binary")
    found = found.join(wrappers._checks(pages).select("id").distinct(), "id", "left_anti")
    plain = wrappers.without_furniture(docs).mapInPandas(_words, "id long, words binary")
    return found.unionByName(plain).where(F.length("words") > 0)


def _suffix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            key, doc, part = suffixes([np.frombuffer(w, dtype=np.uint32) for w in pdf["words"]])
            yield pd.DataFrame({"key": key, "doc": pdf["id"].to_numpy()[doc], "part": part.astype(np.int32)})


def suffix_rows(bodies: DataFrame) -> DataFrame:
    """(key, doc, part): the kept suffixes of (id, words)."""
    return bodies.select("id", "words").mapInPandas(_suffix_rows, "key long, doc long, part int")


_PACKED = "shard int, key binary, doc binary, part binary, mark binary"
_ARRAY = _PACKED + ", warm binary"
_KINDS = {"key": np.int64, "doc": np.int64, "part": np.int32, "mark": np.uint8}
#: Bits of a mark: the key is hot; it isn't alone.
_IS_HOT, _IS_MET = 1, 2


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key."""
    return ((key.view(np.uint64) * _MULT >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _packed(rows: dict[str, np.ndarray], shards: int) -> pd.DataFrame:
    """A row of arrays for each shard that rows belong to; within a shard they keep their order."""
    shard = shard_of(rows["key"], shards)
    order = np.argsort(shard, kind="stable")
    at, begin = np.unique(shard[order], return_index=True)
    end = [*begin[1:], len(order)]
    columns = {c: [v[a:b].tobytes() for a, b in zip(begin, end)] for c, v in ((c, rows[c][order].astype(kind)) for c, kind in _KINDS.items())}
    return pd.DataFrame({"shard": at, **columns})


def _unpacked(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(pdf[c]), dtype=kind) for c, kind in _KINDS.items() if c in pdf}


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, and their lengths."""
    begin = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.array([], np.int64)
    return begin, np.diff(np.append(begin, len(key)))


def array_parts(bodies: DataFrame, shards: int, hot: int = HOT) -> DataFrame:
    """The kept suffixes of (id, words) in parts of shards; the list of a key is cut to the lowest hot + 1 of each part before it is shuffled."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("id")
            key, doc, part = suffixes([np.frombuffer(w, dtype=np.uint32) for w in pdf["words"]])
            order = np.argsort(key, kind="stable")  # bodies come in order already
            begin, n = _runs(key[order])
            order = order[np.arange(len(key)) - np.repeat(begin, n) <= hot]
            yield _packed({"key": key[order], "doc": pdf["id"].to_numpy()[doc[order]], "part": part[order], "mark": np.zeros(len(order))}, shards)

    return bodies.select("id", "words").mapInPandas(each, _PACKED)


def resharded(array: DataFrame, shards: int) -> DataFrame:
    """The rows of an array in parts of other shards."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _packed(_unpacked(pdf), shards)

    return array.select("key", "doc", "part", "mark").mapInPandas(each, _PACKED)


def suffix_array(parts: DataFrame, hot: int = HOT) -> DataFrame:
    """(shard, key, doc, part, mark, warm): a row for each shard, its arrays in suffix order; a key in more than ``hot`` bodies is one marked suffix.

    Marks of the parts stay. warm: (doc, long, short), what of each body has become hot here, of the suffixes that weren't cut before.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _unpacked(pdf)
        order = np.lexsort((rows["doc"], rows["key"]))
        key, doc, part, mark = (rows[c][order] for c in _KINDS)
        begin, n = _runs(key)
        was = mark & _IS_HOT
        is_hot = (np.maximum.reduceat(was, begin) > 0) | (n > hot)
        every = np.repeat(is_hot, n)
        lost, few = every & (was == 0), key < 0
        warm = pd.DataFrame({"doc": doc[lost], "long": np.where(few, 0, part)[lost], "short": np.where(few, part, 0)[lost]}, dtype="int64").groupby("doc", as_index=False).sum()
        kept = ~every
        kept[begin] = True
        marks = np.repeat((is_hot * _IS_HOT + (n > 1) * _IS_MET).astype(np.uint8), n)
        out = {c: [v[kept].tobytes()] for c, v in zip(_KINDS, (key, doc, part, marks))}
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), **out, "warm": [np.ascontiguousarray(warm.to_numpy(dtype=np.int64).T).tobytes()]})

    return parts.groupBy("shard").applyInPandas(build, _ARRAY)


def hot_keys(array: DataFrame) -> DataFrame:
    """(key): the hot keys of an array."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = _unpacked(pdf)
            yield pd.DataFrame({"key": rows["key"][rows["mark"] & _IS_HOT > 0]})

    return array.select("key", "mark").mapInPandas(each, "key long")


def _warmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for w in pdf["warm"]:
            yield pd.DataFrame(dict(zip(("doc", "long", "short"), np.frombuffer(w, dtype=np.int64).reshape(3, -1))))


def _pairs(doc: np.ndarray, old: np.ndarray, part: np.ndarray, few: np.ndarray) -> pd.DataFrame:
    flat = pd.DataFrame({"doc": doc, "old": old, "long": np.where(few, 0, part), "short": np.where(few, part, 0)})
    return flat.groupby(["doc", "old"], as_index=False, sort=False).sum()


_PAIR = "doc long, old long, long long, short long"


def _frame(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts) if parts else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("doc", "old", "long", "short")})


def search_shard(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    """Records of ``stored`` that those of ``asked`` have substrings in common with, and what these cover.

    A substring that is hot on the other side is given as a pair of its record with itself, and counts as hot there.
    """
    out: list[pd.DataFrame] = []
    keys, olds, weight, marks = _unpacked(stored).values()  # a shard is one row, in suffix order
    every = _unpacked(asked)
    for begin in range(0, len(every["key"]) if len(keys) else 0, _SPLIT):
        key, doc, part, mark = (v[begin : begin + _SPLIT] for v in every.values())
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        many = high - low
        i = np.repeat(np.arange(len(key)), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        mine, theirs = mark[i] & _IS_HOT > 0, marks[j] & _IS_HOT > 0
        plain = ~mine & ~theirs & (doc[i] != olds[j])
        if plain.any():
            out.append(_pairs(doc[i][plain], olds[j][plain], part[i][plain].astype(np.int64), key[i][plain] < 0))
        for which, who, share in ((~mine & theirs, doc[i], part[i].astype(np.int64)), (mine & ~theirs, olds[j], weight[j].astype(np.int64))):
            if which.any():
                out.append(_pairs(who[which], who[which], share[which], key[i][which] < 0))
    return _frame(out)


def search_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same within the shards of one array: every record with those of lower ids on its lists."""
    for pdf in batches:
        for k in range(len(pdf)):
            rows = _unpacked(pdf.iloc[k : k + 1])
            met = rows["mark"] == _IS_MET
            key, doc, part = (rows[c][met] for c in ("key", "doc", "part"))
            low, high = [], []
            at, step = np.arange(len(key)), 0
            while len(at):  # no list is longer than HOT
                step += 1
                at = at[: np.searchsorted(at, len(key) - step)]
                at = at[key[at + step] == key[at]]
                low.append(at)
                high.append(at + step)
            if low:
                a, b = np.concatenate(low), np.concatenate(high)
                yield _pairs(doc[b], doc[a], part[b].astype(np.int64), key[b] < 0)


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (doc, old) that are near-duplicates, reduced to the lowest old of each doc."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, similarity) >= similarity for x, y in zip(a, b)], dtype=bool)

    ids = pairs.select(F.explode(F.array("doc", "old")).alias("id")).distinct()
    # only the bodies asked for are moved
    words = words.join(ids, "id", "left_semi")
    one = words.select(F.col("id").alias("doc"), F.col("words").alias("wa"))
    two = words.select(F.col("id").alias("old"), F.col("words").alias("wb"))
    return pairs.join(two, "old").join(one, "doc").where(near("wa", "wb")).groupBy("doc").agg(F.min("old").alias("old"))


def lowest_covered(found: DataFrame, words: DataFrame, hot: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, old): the lowest near-duplicate below each doc of (doc, old, long, short), old < doc; hot (doc, warm) takes that much off what must be covered.

    Candidates up to the lowest one that is strongly covered are compared first; the rest only where none of these is near.
    """
    covered = found.groupBy("doc", "old").agg(F.sum("long").alias("long"), F.sum("short").alias("short"))
    covered = covered.join(hot.select("doc", "warm"), "doc", "left")
    covered = covered.where((F.col("long") >= COVER) | (F.col("short") >= F.greatest(F.lit(1.0), 9_999 * similarity - F.coalesce("warm", F.lit(0)))))
    sure = F.when(F.greatest("long", "short") >= STRONG, F.col("old"))
    covered = materialize(covered.select("doc", "old", F.min(sure).over(Window.partitionBy("doc")).alias("sure")), "covered")
    best = materialize(_verified(covered.where("sure is null or old <= sure").select("doc", "old"), words, similarity), "best")
    rest = covered.where("old > sure").join(best.select("doc"), "doc", "left_anti").select("doc", "old")
    return best if rest.isEmpty() else best.unionByName(_verified(rest, words, similarity))


def rare_sequences(words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, doc): the rarest five-word sequences of each of (id, words), so many that two near sets must share one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(w).view(np.int64) if len(w) >= 4 * SHINGLE else np.array([zlib.crc32(w)], np.int64) for w in pdf["words"]]
            if sets:
                many = [len(s) for s in sets]
                yield pd.DataFrame({"key": np.concatenate(sets), "doc": np.repeat(pdf["id"].to_numpy(), many), "size": np.repeat(many, many)})

    rows = words.select("id", "words").mapInPandas(each, "key long, doc long, size int")
    met = rows.groupBy("key").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("n", "key"))
    rows = rows.join(met, "key").withColumn("rank", rank)
    return rows.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).where("n > 1").select("key", "doc")


def lowest_near(asked: DataFrame, stored: DataFrame, words: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc, old): the lowest near-duplicate below each asked doc. asked (key, doc); stored (key, doc); words (id, words).

    A round takes the next ``block`` stored docs of each key that is still asked for; lists are cut to these before they are shuffled.
    """
    first = F.row_number().over(Window.partitionBy("key").orderBy("old"))
    lists = stored.select("key", F.col("doc").alias("old"))
    open_ = materialize(asked.select("key", "doc", F.lit(None).cast("long").alias("so_far")), "open")
    past = materialize(asked.select("key").distinct().withColumn("past", F.lit(-(2**63))), "past")
    best = None
    while True:
        now = lists.join(past, "key").where("old > past").select("key", "old").withColumn("rank", first).where(F.col("rank") <= block)
        now = materialize(now.select("key", "old"), "block")
        pairs = open_.join(now, "key").where("old < doc and (so_far is null or old < so_far)").select("doc", "old").distinct()
        found = _verified(pairs, words, similarity)
        best = materialize(found if best is None else best.unionByName(found).groupBy("doc").agg(F.min("old").alias("old")), "best")
        # a list goes on if its block was full, for docs above its end without a lower match
        past = materialize(now.groupBy("key").agg(F.max("old").alias("past"), F.count("*").alias("n")).where(F.col("n") == block).select("key", "past"), "past")
        if past.isEmpty():
            return best
        open_ = open_.drop("so_far").join(past, "key").join(best.withColumnRenamed("old", "so_far"), "doc", "left")
        open_ = materialize(open_.where("past < doc and (so_far is null or past < so_far)").select("key", "doc", "so_far"), "open")
        if open_.isEmpty():
            return best
        past = materialize(past.join(open_.select("key"), "key", "left_semi"), "past")


class History:
    """The accepted records, as a manifest and the tables it names: bodies by class, the classes' members, and suffix arrays.

    A new process that is given the path goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, hot: int = HOT):
        self.spark, self.hot = spark, hot
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        self.version = 0
        self.segments: list[dict] = []  # level, folder, shards, bodies (folders); the oldest first
        self.urls: list[str] = []
        self.top: int | None = None
        self._load()

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path, jvm

    def _load(self) -> None:
        files, path, jvm = self._files()
        if not files.exists(path):
            return
        names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().startswith("manifest-"))
        if names:
            kept = json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/{names[-1]}").collect()))  # one line
            self.version, self.segments, self.urls, self.top = kept["version"], kept["segments"], kept["urls"], kept["top"]

    def _save(self, gone: list[str]) -> None:
        files, _, jvm = self._files()
        self.version += 1
        out = files.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{self.version:09d}"), False)
        out.write(bytearray(json.dumps({"version": self.version, "segments": self.segments, "urls": self.urls, "top": self.top}).encode()))
        out.close()
        for folder in gone:  # only once the new manifest stands
            files.delete(jvm.org.apache.hadoop.fs.Path(folder), True)

    def _folder(self) -> str:
        return f"{self.path}/{uuid.uuid4().hex}"

    def _put(self, df: DataFrame, folder: str, *by: str) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _array(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(_ARRAY).parquet(f"{segment['folder']}/suffixes")

    def _hot(self, segment: dict) -> DataFrame:
        return self.spark.read.schema("doc long, long long, short long").parquet(f"{segment['folder']}/hot")

    def accept_urls(self, batch: DataFrame) -> DataFrame:
        """rec_id of the records of ``batch`` (rec_id, url) whose canonical URL is stored or on a lower rec_id; then stores their forms."""
        new = batch.where(F.col("rec_id").isNotNull()).select("rec_id", canon(F.col("url")).alias("c")).where("c is not null")
        folder = self._folder() + "/urls"
        new = self._put(new, folder)
        old = self.spark.read.schema("c string").parquet(*self.urls) if self.urls else new.select("c").limit(0)
        known = materialize(_known(new, old), "known")
        self.urls.append(folder)
        self._save([])
        return known

    def seed_urls(self, seen: DataFrame) -> None:
        """Stores the canonical forms of ``seen`` (canonical_url), without answers."""
        folder = self._folder() + "/urls"
        self._put(seen.select(canon(F.col("canonical_url")).alias("c")).where("c is not null"), folder)
        self.urls.append(folder)
        self._save([])

    def _shards(self, words: int) -> int:
        # several shards a partition, so that they spread evenly when they are hashed to tasks; a small batch has few
        rows = max(1, words // 3)
        wanted = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(min(wanted, -(-rows // SPREAD_ROWS)), -(-rows // SHARD_ROWS))

    def _mark(self, marked: DataFrame, folder: str) -> None:
        """Stores how much of each body is hot, (doc, long, short), from any rows of these."""
        self._put(marked.groupBy("doc").agg(F.sum("long").alias("long"), F.sum("short").alias("short")), f"{folder}/hot")

    def _merge(self) -> None:
        while len(self.segments) > 1 and self.segments[-1]["level"] == self.segments[-2]["level"]:
            a, b = self.segments[-2:]
            folder = self._folder()
            shards = max(a["shards"], b["shards"], self._shards(a["words"] + b["words"]))
            parts = resharded(self._array(a), shards).unionByName(resharded(self._array(b), shards))
            array = self._put(suffix_array(parts, self.hot), f"{folder}/suffixes", "shard")
            warm = array.select("warm").mapInPandas(_warmed, "doc long, long long, short long")
            self._mark(warm.unionByName(self._hot(a)).unionByName(self._hot(b)), folder)
            self.segments[-2:] = [{"level": a["level"] + 1, "folder": folder, "shards": shards, "words": a["words"] + b["words"], "bodies": a["bodies"] + b["bodies"]}]
            self._save([a["folder"], b["folder"]])

    def _search(self, own: dict, segment: dict) -> DataFrame:
        asked, stored = self._array(own), self._array(segment)
        if segment["shards"] != own["shards"]:
            asked = resharded(asked, segment["shards"])
        if segment["shards"] > own["shards"]:  # a small batch reads the shards it touches only; at most one number a shard
            stored = stored.where(F.col("shard").isin([r.shard for r in asked.select("shard").distinct().collect()]))
        one = asked.select("shard", *_KINDS).groupBy("shard")
        two = stored.select(F.col("shard").alias("at"), *_KINDS).groupBy("at")
        return one.cogroup(two).applyInPandas(search_shard, _PAIR)

    def accept(self, batch: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
        """(id_a, id_b) of the rows of ``batch`` (id, words) near a lower id in it or in the history; then adds the batch.

        If ids of the batch are below some accepted before, rows accepted before that get a lower id_a are given again.
        """
        folder = self._folder()
        words = batch.select("id", "words").where((F.length("words") > 0) & F.col("id").isNotNull())
        # bodies with the same words are one class, which its lowest id stands for
        keyed = words.select("id", F.md5("words").alias("same"))
        members = keyed.join(keyed.groupBy("same").agg(F.min("id").alias("cls")), "same").select("id", "cls").distinct()
        members = self._put(members, f"{folder}-bodies/members")
        copies = members.where("id != cls").select("id")
        bodies = self._put(words.join(copies, "id", "left_anti").dropDuplicates(["id"]), f"{folder}-bodies/words")
        size = bodies.agg(F.sum(F.length("words")).alias("n"), F.max("id").alias("top"), F.min("id").alias("least")).first()
        if size.n is None:
            return members.select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).limit(0)
        own = {"level": 0, "folder": folder, "shards": self._shards(size.n // 4), "words": size.n // 4, "bodies": [f"{folder}-bodies"]}
        array = self._put(suffix_array(array_parts(bodies, own["shards"], self.hot), self.hot), f"{folder}/suffixes", "shard")
        keys = materialize(hot_keys(array), "hot")
        # long hot suffixes are rare; without any only the bodies that have five-word ones are read again
        few = keys.where("key >= 0").isEmpty()
        rows = suffix_rows(bodies.where(F.length("words") < 4 * SHORT / SIMILARITY) if few else bodies).join(keys, "key", "left_semi")
        share = [F.when(c, F.col("part")).otherwise(0).cast("long").alias(n) for n, c in (("long", F.col("key") >= 0), ("short", F.col("key") < 0))]
        self._mark(rows.select("doc", *share), folder)
        found = array.select(*_KINDS).mapInPandas(search_own, _PAIR)
        for segment in self.segments:
            found = found.unionByName(self._search(own, segment))
        found = materialize(found, "found")
        every = [own, *self.segments]
        all_words = self.spark.read.schema("id long, words binary").parquet(*[f"{b}/words" for s in every for b in s["bodies"]])
        late = self.top is not None and size.least < self.top
        hot = self._hot(own).unionByName(found.where("doc = old").select("doc", "long", "short"))
        for segment in self.segments:
            hot = hot.unionByName(self._hot(segment))
        hot = hot.groupBy("doc").agg((F.sum("long") > 0).alias("long"), F.sum("short").alias("warm"))
        hot = materialize(hot, "hot")
        pairs = found.where("doc != old").select(F.greatest("doc", "old").alias("doc"), F.least("doc", "old").alias("old"), "long", "short")
        best = lowest_covered(pairs, all_words, hot, similarity)
        docs = hot.where(F.col("long") | (F.col("warm") >= HOT_SHARE)).select("doc")
        fresh = docs if late else docs.join(bodies.select(F.col("id").alias("doc")), "doc", "left_semi")
        if not fresh.isEmpty():
            rare = materialize(rare_sequences(all_words.join(docs.select(F.col("doc").alias("id")), "id", "left_semi"), similarity), "rare")
            best = best.unionByName(lowest_near(rare.join(fresh, "doc", "left_semi").select("key", "doc"), rare, all_words, similarity))
        best = materialize(best.groupBy(F.col("doc").alias("cls")).agg(F.min("old").alias("old")), "lowest")
        if late:
            members = self.spark.read.schema("id long, cls long").parquet(*[f"{b}/members" for s in every for b in s["bodies"]])
        near = members.join(best, "cls", "left")
        near = near.select(F.least(F.col("old"), F.when(F.col("id") != F.col("cls"), F.col("cls"))).alias("id_a"), F.col("id").alias("id_b"))
        near = materialize(near.where("id_a is not null").distinct(), "known")
        self.segments.append(own)
        self.top = size.top if self.top is None else max(self.top, size.top)
        self._save([])
        self._merge()
        return near
