"""Problem 3: cutting long pages into passages, and auditing stored ones.

The text is parsed into a tree: sections under headings; in them lists, tables, code blocks and paragraphs; in these the
items, rows and lines; then sentences, clauses and words. Sibling subtrees are merged bottom-up while they fit, and only
a node that is too large by itself is opened, so a section that fits is never torn apart for its neighbour's sake. A
piece too small to stand alone shares the room of the next, and an end inside a sentence moves back to a closed one where
there is one. Every piece but the first repeats the end of the piece before, from 80 to 400 characters, starting at a
natural boundary where there is one.

Defined cases: null and short texts give no pieces; CRLF and repeated rows are kept as they are; a text without any
boundary is cut at the limit; rows whose key is null are no passages; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, LEAST, MOST = 2500, 80, 400

_HEADING = re.compile(r"(#{1,6})\s")
_ITEM = re.compile(r"([ \t]*)(?:[*+-]|\d+[.)])\s")
_FENCE = re.compile(r"\s*(```|~~~)")
#: From coarse to fine: blank lines, line ends, sentence ends, clause ends, blanks.
_LEVELS = [re.compile(r"\n[ \t\r]*\n\s*"), re.compile(r"\n"), re.compile(r"(?<=[.!?…。！？])[\"”’»)\]]*\s+"), re.compile(r"(?<=[,;:])\s+"), re.compile(r"\s+")]
_OPEN = re.compile(r"[\w,]")
#: The part of the limit below which a piece doesn't stand alone.
SMALL = 8


class Tree:
    """A text as nested spans: (start, end, level) with the level that its parts are looked for from.

    Levels 0 to 5 are headings by depth, 6 blocks, 7 items of a list, 8 lines, then sentences, clauses and words.
    """

    def __init__(self, text: str):
        self.text = text
        self.headings: list[tuple[int, int]] = []  # (place, depth)
        self.blocks: list[int] = []
        self.items: list[int] = []
        at, fence, kind, indent = 0, "", "", 0
        for line in text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
            before = kind
            mark = _FENCE.match(line)
            item = _ITEM.match(line)
            heading = _HEADING.match(line)
            if fence:
                fence = "" if mark and mark.group(1) == fence else fence
            elif mark:
                fence, kind = mark.group(1), "code"
            elif not line.strip():
                kind = "" if kind != "list" else kind
            elif heading:
                self.headings.append((at, len(heading.group(1))))
                kind = "heading"
            elif item:
                if kind != "list":
                    kind, indent = "list", len(item.group(1))
                if len(item.group(1)) <= indent:
                    self.items.append(at)
            elif line.lstrip()[0] == "|":
                kind = "table"
            elif kind != "list" or not line[0].isspace():  # an indented line goes on with its item
                kind = "text"
            opens = kind in ("code", "heading") and (heading is not None or (mark is not None and fence != ""))
            if line.strip() and (before != kind or opens) and not (fence and mark is None):
                self.blocks.append(at)
            if before == "code" and not fence and not mark:
                self.blocks.append(at)
            at += len(line)

    def _cut(self, start: int, end: int, places: list[int]) -> list[tuple[int, int]]:
        edges = [start, *places[bisect.bisect_right(places, start) : bisect.bisect_left(places, end)], end]
        return list(zip(edges, edges[1:]))

    def parts(self, start: int, end: int, level: int) -> list[tuple[int, int, int]]:
        """The parts of a span at the first level from ``level`` on that has more than one."""
        while level < 12:
            if level < 6:
                spans = self._cut(start, end, [p for p, depth in self.headings if depth <= level + 1])
            elif level < 8:
                spans = self._cut(start, end, self.blocks if level == 6 else self.items)
            else:
                spans = self._cut(start, end, [m.end() for m in _LEVELS[level - 7].finditer(self.text, start, end)])
            level += 1
            if len(spans) > 1:
                return [(a, b, level) for a, b in spans]
        return []

    def merged(self, start: int, end: int, level: int, limit: int) -> list[tuple[int, int]]:
        """The span in pieces of at most ``limit``: those of its parts, neighbours merged while they fit."""
        if end - start <= limit:
            return [(start, end)]
        parts = self.parts(start, end, level)
        if not parts:
            return [(a, min(a + limit, end)) for a in range(start, end, limit)]
        out: list[tuple[int, int]] = []
        for a, b, below in parts:
            for piece in self.merged(a, b, below, limit):
                if out and piece[1] - out[-1][0] <= limit:
                    out[-1] = (out[-1][0], piece[1])
                else:
                    out.append(piece)
        return out

    def closed(self, at: int) -> bool:
        """Whether the text before a place, blanks aside, doesn't end in a letter, a digit or a comma."""
        before = self.text[max(0, at - 64) : at].rstrip()
        return not before or not _OPEN.match(before[-1])

    def boundary(self, low: int, high: int, aim: int, closed: bool) -> int | None:
        """The boundary of the coarsest kind from ``low`` to ``high`` that is nearest to ``aim``."""
        for rule in _LEVELS:
            found = [m.end() for m in rule.finditer(self.text, max(0, low - 8), min(len(self.text), high + 8)) if low <= m.end() <= high and (not closed or self.closed(m.end()))]
            if found:
                return min(found, key=lambda x: abs(x - aim))
        return None


def _overlap_start(text: str, begin: int, end: int, least: int, most: int) -> int:
    """Where the repeat of text[begin:end] starts: the earliest boundary of the coarsest kind within the window."""
    lo, hi = max(begin + 1, end - most), end - least
    if hi < lo:
        return max(begin, end - least)
    for rule in (_LEVELS[0], _LEVELS[1], _LEVELS[2], _LEVELS[4]):
        found = [m.end() for m in rule.finditer(text, max(begin, lo - 4), end) if lo <= m.end() <= hi]
        if found:
            return found[-1] if rule is _LEVELS[4] else found[0]
    return hi


def split_text(text: str, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """(start, end) of each piece; [] for a text within the limit. Ends grow, and each start lies in the piece before."""
    if not text or len(text) <= limit:
        return []
    assert limit > most >= least >= 0
    tree = Tree(text)
    room = limit - least  # what a piece may add to what it repeats
    small = max(least + 1, limit // SMALL)
    cores = tree.merged(0, len(text), 0, room)
    ends = [b for _, b in cores]
    k = 0
    while k < len(ends) - 1:
        start, last = ends[k - 1] if k else 0, ends[k + 1]
        low, high = max(start + small, last - room), min(start + room, last - small)
        if ends[k] - start < small or (k == len(ends) - 2 and last - ends[k] < small):
            if last - start <= room:
                del ends[k]
                continue
            if low <= high:
                middle = (start + last) // 2
                at = tree.boundary(low, high, middle, True) or tree.boundary(low, high, middle, False)
                ends[k] = at if at else min(max(middle, low), high)
        elif not tree.closed(ends[k]):
            at = tree.boundary(low, min(high, ends[k]), ends[k], True)
            ends[k] = at if at else ends[k]
        k += 1
    pieces: list[tuple[int, int]] = []
    for k, end in enumerate(ends):
        if not k:
            pieces.append((0, end))
        else:
            begin = _overlap_start(text, pieces[-1][0], ends[k - 1], least, min(most, limit - (end - ends[k - 1])))
            pieces.append((begin, end))
    return pieces


def _cut(limit: int, least: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, ns, texts = [], [], []
            for i, text in zip(pdf["id"], pdf["markdown"]):
                for n, (a, b) in enumerate(split_text(text, limit, least, most), 1):
                    ids.append(i)
                    ns.append(n)
                    texts.append(text[a:b])
            yield pd.DataFrame({"raw_doc_id": pd.Series(ids, dtype="int64"), "n": pd.Series(ns, dtype="int32"), "text": pd.Series(texts, dtype=object)})

    return run


def split_documents(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(raw_doc_id, n, text) of every row of (id, markdown) longer than the limit."""
    long = docs.where((F.length("markdown") > limit) & F.col("id").isNotNull()).select("id", "markdown")
    return long.mapInPandas(_cut(limit, least, most), "raw_doc_id long, n int, text string")


def longest_overlap(before: str, text: str, least: int) -> int:
    """Length of the longest text that ends ``before`` and begins ``text``; 0 where it is shorter than ``least``."""
    head = text[:least]
    if least <= 0 or len(head) < least:
        return 0
    at = before.find(head, max(0, len(before) - len(text)))
    while at >= 0:
        if text.startswith(before[at:]):
            return len(before) - at
        at = before.find(head, at + 1)
    return 0


def audit_passages(docs: DataFrame, stored: DataFrame, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(raw_doc_id, n) of stored passages that break the contract of the splitter, of missing numbers, and n = 0 for pages without any."""

    @F.pandas_udf("int")
    def overlap(before: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([0 if a is None or b is None else longest_overlap(a, b, least) for a, b in zip(before, text)], dtype="int32")

    s = stored.select("raw_doc_id", "n", "text").where(F.col("raw_doc_id").isNotNull() & F.col("n").isNotNull())
    numbers = s.select("raw_doc_id", "n")
    top = numbers.groupBy("raw_doc_id").agg(F.max("n").alias("top"))
    blanks = " \\t\\r\\n\\u000b\\f\\u00a0\\u2028\\u2029\\u3000"
    last = F.right(F.expr(f"rtrim('{blanks}', text)"), F.lit(1))
    too_long = s.where(F.length("text") > limit).select("raw_doc_id", "n")
    open_end = s.where(last.rlike(r"^[\p{L}\p{Nd},]")).select("raw_doc_id", "n").join(top, "raw_doc_id").where("n < top").drop("top")
    before = s.select("raw_doc_id", (F.col("n") + 1).alias("n"), F.coalesce("text", F.lit("")).alias("before"))
    met = s.where("n > 1").join(before, ["raw_doc_id", "n"]).withColumn("shared", overlap("before", "text"))
    joined = met.where((F.col("shared") < least) | (F.col("shared") > most)).select("raw_doc_id", "n")
    holes = top.where("top >= 1").select("raw_doc_id", F.explode(F.sequence(F.lit(1), "top")).alias("n")).join(numbers, ["raw_doc_id", "n"], "left_anti")
    # a page needs passages if the splitter cuts it; only pages without any are split
    bare = split_documents(docs.join(top.select(F.col("raw_doc_id").alias("id")), "id", "left_anti"), limit, least, most).where("n = 1").select("raw_doc_id", F.lit(0).alias("n"))
    return too_long.union(open_end).union(joined).union(holes).union(bare).distinct()
