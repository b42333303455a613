"""Problem 4: variant spellings of one person or organisation, by metric-space partitioning.

A spelling is read into a form: for organisations the distinctive words and the words of their kind (Energy, Growth
Fund, Data Protection Office), for people given name, initials and surname. Which words name a kind is counted over all
spellings; shortened ones are resolved against these, by the kind words beside them where several fit. Forms of one kind are a metric space under the least edit distance
over pairings of their words (true Damerau-Levenshtein, any number of edits between a pair's letters); forms of
different kinds are infinitely far apart. Each form goes to its nearest pivot's cell and, by the triangle inequality, to
every cell in whose reach a form within the radius may lie; inside a cell the join is exact. Forms that leave something
out (an initial for a word, a dropped word, no kind) join the one entity that they can mean, or none.

Defined cases: null, broken or empty JSON has no names; empty strings, blanks and placeholders are no names; a row
delivered twice counts once; a spelling that can mean two entities is linked to neither; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import materialize

RADIUS = 2
#: A word names a kind if it is in this share of the spellings, and stands beside at least KIND_BESIDE other words.
KIND_SHARE, KIND_BESIDE = 0.006, 12
CELL = 256
#: Most pivots of a space, and forms that are compared with each other at once; larger cells are compared block by block.
MOST_PIVOTS, BLOCK = 512, 4096

# Fixed values.
PLACEHOLDERS = ["n/a", "undisclosed", "na", "none", "null", "-", "unknown", "tbd"]
LEGAL = "inc llc ltd gmbh plc sa bv ag corp co sas srl spa nv kg oy ab as pty pte lp llp".split()
FILLERS = "the of for and de la der des du".split()
TITLES = "dr mr mrs ms prof sir".split()
# Given names and their short forms.
GIVEN = {
    "alexander": "alex sandy xander sasha", "alexandra": "alex sandra sasha", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny benji", "catherine": "cathy kate katie", "charlotte": "charlie lottie lotte",
    "christopher": "chris topher kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dimitri": "dima mitya dimi", "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth eliza lizzie betty lisa libby",
    "frederick": "fred freddie freddy rick", "gabriela": "gabi gaby gabby", "george": "georgie", "isabella": "bella izzy isa isabel", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey",
    "josephine": "jo josie fina", "katherine": "kate kathy katie kat kitty", "leonard": "leo len lenny", "margaret": "maggie meg peggy greta marge", "maximilian": "max", "michael": "mike mick mickey", "nicholas": "nick nicky nico klaus",
    "patrick": "pat paddy", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby robbie bert", "samantha": "sam sammy", "samuel": "sam sammy", "stephen": "steve", "susannah": "sue susie suzy anna susan",
    "theodora": "theo dora thea", "theodore": "ted theo teddy", "thomas": "tom tommy", "valentina": "val tina vale", "victoria": "vicky tori vic", "william": "bill will billy willy liam",
}

_SHORT: dict[str, set[str]] = {}
for _f, _s in GIVEN.items():
    _SHORT.setdefault(_f, set()).add(_f)
    for _x in _s.split():
        _SHORT.setdefault(_x, set()).add(_f)


def damerau(a: str, b: str, most: int) -> int:
    """The unrestricted Damerau-Levenshtein distance, a true metric; most + 1 for anything larger than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = len(a) + len(b)
    at: dict[str, int] = {}
    d = [[big] * (len(b) + 2)] + [[big, i] + [0] * len(b) for i in range(len(a) + 1)]
    d[1] = [big, *range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            i1, j1 = at.get(b[j - 1], 0), seen
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, seen = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        at[a[i - 1]] = i
    return min(d[-1][-1], most + 1)


def assignment(cost: list[list[int]]) -> int:
    """The least sum of one entry in each row and column, by shortest augmenting paths."""
    n = len(cost)
    row, col, owner, big = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), 10**9
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, seen = [big] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            seen[at] = True
            k, step, to = owner[at], big, 0
            for j in range(1, n + 1):
                if not seen[j]:
                    now = cost[k - 1][j - 1] - row[k] - col[j]
                    if now < least[j]:
                        least[j], back[j] = now, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    row[owner[j]] += step
                    col[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return sum(cost[owner[j] - 1][j - 1] for j in range(1, n + 1))


def distance(a: str, b: str, most: int) -> int:
    """The least sum of edit distances over pairings of the words of two forms with as many words each."""
    if a == b:
        return 0
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return most + 1
    # equal words are paired in some best pairing, since the words' distance is a metric
    both = Counter(x) & Counter(y)
    x, y = list((Counter(x) - both).elements()), list((Counter(y) - both).elements())
    if len(x) > most:
        return most + 1
    if len(x) <= 1:
        return damerau(x[0], y[0], most) if x else 0
    cost = [[damerau(p, q, most) for q in y] for p in x]
    if len(x) == 2:
        return min(cost[0][0] + cost[1][1], cost[0][1] + cost[1][0], most + 1)
    return min(assignment(cost), most + 1)


def fold(name: str) -> str:
    s = unicodedata.normalize("NFKD", name.replace("ß", "ss"))
    s = "".join(c for c in s if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)


def words_of(name: str) -> list[str]:
    """The words of a spelling in lower case, legal forms and filler words left out; initials are single letters."""
    s = fold(name).lower()
    s = re.sub(r"\b([a-z])\.\s?([a-z])\.(?=\s|,|$)", lambda m: f"{m[1]}{m[2]} " if m[1] + m[2] in LEGAL else f"{m[1]} {m[2]} ", s)
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"['’]", "", s)) if w]
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    return [w for w in words if w not in FILLERS]


def _abbreviates(t: str, g: str) -> bool:
    """Whether t is g cut off after a consonant, that with an s, or g without most of its vowels."""
    if len(t) < 2 or len(t) >= len(g) or t[0] != g[0]:
        return False
    if g.startswith(t):
        return t[-1] not in "aeiou"
    if t[-1] == "s" and len(t) > 3 and g.startswith(t[:-1]):
        return True
    it = iter(g)
    return sum(c in "aeiou" for c in t) <= 1 and all(c in it for c in t)


def _same_stem(t: str, g: str) -> bool:
    """Whether two long words differ in their endings only, or one is the clipped form of the other."""
    n = min(len(t), len(g))
    return (n >= 7 and t[:7] == g[:7] and t[: n - 2] == g[: n - 2]) or (len(t) >= 8 and len(g) >= 4 and t[:3] == g[:3] and _abbreviates(g, t))


class Kinds:
    """The words that name kinds of organisations, and what shortened ones stand for."""

    def __init__(self, kinds: set[str], pairs: set[tuple[str, str]]):
        self.kinds, self.pairs = kinds, pairs
        self.initials: dict[str, tuple[str, ...]] = {}
        for a, b in sorted(pairs):
            self.initials.setdefault(a[0] + b[0], (a, b))
        self.cache: dict[tuple[str, tuple[str, ...]], tuple[str, ...]] = {}

    def read(self, t: str, beside: tuple[str, ...] = ()) -> tuple[str, ...]:
        """The kind words that a word stands for, () if none; of several the one that is used with the kind words ``beside`` it."""
        if t in self.kinds:
            return (t,)
        if (t, beside) not in self.cache:
            found = [g for g in self.kinds if _abbreviates(t, g)]
            begin = [g for g in found if g.startswith(t)]
            best = begin or found
            used = [g for g in best if any((g, x) in self.pairs or (x, g) in self.pairs for x in beside)]
            if t in self.initials and (len(t) == 2 or not begin) and not used:
                out = self.initials[t]
            elif best:
                out = (min(used or best, key=lambda g: (len(g), g)),)
            else:
                near = [g for g in self.kinds if len(g) > 5 and abs(len(g) - len(t)) < 2 and g[0] == t[0] and damerau(t, g, 1) <= 1] if len(t) > 5 else []
                near = near or [g for g in self.kinds if _same_stem(t, g)]
                out = (min(near),) if near else ()
            self.cache[t, beside] = out
        return self.cache[t, beside]


def _deletions(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


_NEAR: dict[str, set[str]] = {}
for _f in GIVEN:
    for _x in _deletions(_f):
        _NEAR.setdefault(_x, set()).add(_f)


@lru_cache(maxsize=100_000)
def given_of(w: str) -> frozenset[str]:
    """The given names that a word is, shortens, or misses by one edit."""
    if w in _SHORT:
        return frozenset(_SHORT[w])
    if len(w) < 5:
        return frozenset()
    # words one edit apart share a form with a letter less
    return frozenset(f for d in _deletions(w) for f in _NEAR.get(d, ()) if damerau(w, f, 1) <= 1)


def form(name: str, kinds: Kinds) -> tuple[str, str, str, str]:
    """(space, core, given, middle): what a spelling says. space is ``p`` for people, else ``o:`` and the kind words."""
    words = words_of(name)
    people = [w for w in words if w not in TITLES]
    kind: list[str] = []
    core: list[str] = []
    sure = any(kinds.read(w) for w in words if w not in _SHORT)
    beside = tuple(sorted(kinds.kinds & set(words)))
    for w in words:
        k = kinds.read(w, beside)
        if k and (sure or w not in _SHORT):
            kind += k
        else:
            core.append(w)
    full = [w for w in people if len(w) > 1]
    single = [w for w in people if len(w) == 1]
    named = [w for w in full if given_of(w)]
    if not kind and "&" not in name and " and " not in name.lower():
        if named and len(full) == 2:
            first = named[0]
            last = next(w for w in full if w is not first)
            if last in _SHORT and first not in _SHORT:
                first, last = last, first
            return "p", last, "|".join(sorted(given_of(first))), "".join(single[:1])
        if len(full) == 1 and single and len(words) <= 3:
            return "p", full[0], "", "".join(single)
        if any(w in TITLES for w in words) and len(full) >= 1:
            return "p", full[-1], "", "".join(single)
    core = [w for w in core if w not in TITLES]
    return "o:" + " ".join(sorted(set(kind))), " ".join(sorted(core)), "", ""


def _counted(cores: list[str]) -> np.ndarray:
    out = np.zeros((len(cores), 27), dtype=np.int16)
    for i, c in enumerate(cores):
        for ch in c:
            k = ord(ch) - 97
            out[i, k if 0 <= k < 26 else 26] += 1
    return out


def near_in_cell(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Pairs (a, b) of form numbers within the radius, a row that is ``left`` with one that is ``right``: triangle and letter bounds first, then the metric."""
    empty = pd.DataFrame({"a": np.array([], "int64"), "b": np.array([], "int64"), "d": np.array([], "int32")})
    mine, pdf = pdf[pdf["left"].to_numpy().astype(bool)], pdf[pdf["right"].to_numpy().astype(bool)]
    if not len(pdf) or not len(mine):
        return empty
    cores, ids = pdf["core"].tolist(), pdf["form"].to_numpy()
    letters, reach = _counted(cores), np.array(pdf["reach"].tolist(), dtype=np.int16)
    sizes = np.array([c.count(" ") for c in cores])
    own, own_ids = mine["core"].tolist(), mine["form"].to_numpy()
    own_letters, own_reach = _counted(own), np.array(mine["reach"].tolist(), dtype=np.int16)
    out = []
    for i in range(len(own)):
        ok = (np.abs(letters - own_letters[i]).sum(axis=1) <= 2 * radius) & (sizes == own[i].count(" ")) & (np.abs(reach - own_reach[i]).max(axis=1) <= radius) & (ids != own_ids[i])
        for j in np.nonzero(ok)[0]:
            d = distance(own[i], cores[j], radius)
            if d <= radius:
                out.append((min(own_ids[i], ids[j]), max(own_ids[i], ids[j]), d))
    return pd.DataFrame(out, columns=["a", "b", "d"]).drop_duplicates() if out else empty


def radius_join(forms: DataFrame, radius: int = RADIUS, cell: int = CELL, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, d): all pairs of (form, space, core) in one space within ``radius`` of each other, one of them ``asked`` if there is such a column.

    A form is at home in its nearest pivot's cell and stands in every cell where one within the radius may be at home.
    Cells beyond ``block`` forms are cut into blocks, each of which meets every other: no task holds a whole cell.
    """
    forms = forms if "asked" in forms.columns else forms.withColumn("asked", F.lit(True))
    sizes = forms.groupBy("space").agg(F.least(F.lit(most_pivots), F.ceil(F.count("*") / cell)).cast("int").alias("k"))
    order = F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("core"), "core"))
    pivots = forms.select("space", "core").withColumn("at", order).where(F.col("at") <= most_pivots).join(sizes, "space").where("at <= k")
    # at most MOST_PIVOTS words a space
    pivots = pivots.groupBy("space").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "core"))), lambda x: x["core"]).alias("pivots"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = 99
        for pdf in batches:
            reach = [[min(distance(c, p, far), far) for p in ps] for c, ps in zip(pdf["core"], pdf["pivots"])]
            cells = [[(k, d == min(r) and k == r.index(min(r))) for k, d in enumerate(r) if d <= min(r) + 2 * radius] for r in reach]
            flat = [(f, s, c, r, k, h and q) for f, s, c, q, r, own in zip(pdf["form"], pdf["space"], pdf["core"], pdf["asked"], reach, cells) for k, h in own]
            yield pd.DataFrame(flat, columns=["form", "space", "core", "reach", "cell", "home"])

    placed = materialize(forms.join(pivots, "space").mapInPandas(assign, "form long, space string, core string, reach array<int>, cell int, home boolean"), "placed")
    many = placed.groupBy("space", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    one = lambda df: df.select("form", "core", "reach", "space", "cell", "i", "j", "left", "right")
    whole = placed.withColumn("left", F.col("home")).withColumn("right", F.lit(True)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    if many.isEmpty():
        rows = one(whole)
    else:
        many = materialize(many, "blocks")
        cut = placed.join(many, ["space", "cell"]).withColumn("b", F.pmod(F.xxhash64("form"), "blocks").cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        lefts = cut.where("home").withColumn("i", F.col("b")).withColumn("j", every).withColumn("left", F.lit(True)).withColumn("right", F.lit(False))
        rights = cut.withColumn("j", F.col("b")).withColumn("i", every).withColumn("left", F.lit(False)).withColumn("right", F.lit(True))
        rows = one(whole.join(many, ["space", "cell"], "left_anti")).unionByName(one(lefts)).unionByName(one(rights))
    return rows.groupBy("space", "cell", "i", "j").applyInPandas(lambda pdf: near_in_cell(pdf, radius), "a long, b long, d int").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the lowest node of each node's component, by least labels of neighbours and of one's label, round by round."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(nodes.select(F.col("node"), F.col("node").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("least", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = materialize(step.join(jump, "root").select("node", "was", F.col("far").alias("root")), "labels")
        labels = step.select("node", "root")
        if step.where("root != was").isEmpty():
            return labels


def names_in(items: DataFrame) -> DataFrame:
    """(name): every distinct spelling under company, body and investors of (structured)."""
    j = F.from_json("structured", "company string, body string, investors array<string>")
    each = F.explode(F.concat(F.array(F.col("j.company"), F.col("j.body")), F.coalesce(F.col("j.investors"), F.array().cast("array<string>"))))
    named = items.select(j.alias("j")).where("j is not null").select(each.alias("name")).where("name is not null").distinct()
    bare = F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+$", ""))
    return named.where((bare != "") & ~bare.isin(PLACEHOLDERS))


def learn_kinds(names: DataFrame) -> Kinds:
    """Which words name kinds: those in a fixed share of all spellings, so there are at most the words of a spelling over that share.

    The words of one name stand beside few others however many spellings it has; words of kinds stand beside many.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n in pdf["name"]:
                w = words_of(n)
                terms = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}
                out += [(t, x, n) for t in terms for x in {x for x in w if len(x) > 3 and x not in t.split()} or {""}]
            yield pd.DataFrame(out, columns=["word", "beside", "name"])

    total = names.count()
    each = names.mapInPandas(count, "word string, beside string, name string")
    counted = each.groupBy("word").agg(F.count_distinct("name").alias("n"), F.count_distinct("beside").alias("beside"))
    common = {r.word for r in counted.where((F.col("n") >= KIND_SHARE * total) & (F.col("beside") >= KIND_BESIDE)).collect()}
    kinds = {w for w in common if len(w) > 3 and " " not in w and not given_of(w) and w not in TITLES}
    # a word that only shortens another one names nothing by itself
    kinds = {w for w in kinds if not any(_abbreviates(w, g) and (len(w) <= 5 or g.startswith(w)) for g in kinds)}
    return Kinds(kinds, {tuple(w.split()) for w in common if " " in w and set(w.split()) <= kinds})


def link_names(names: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(name, entity) for every spelling of (name); entity is a number that spellings of one entity share."""
    spark = names.sparkSession
    names = materialize(names, "names")
    kinds = spark.sparkContext.broadcast(learn_kinds(names))  # bounded by KIND_SHARE

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [form(n, kinds.value) for n in pdf["name"]]
            yield pd.concat([pdf[["name"]].reset_index(drop=True), pd.DataFrame(rows, columns=["space", "core", "given", "middle"])], axis=1)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = names.repartition(tasks).mapInPandas(read, "name string, space string, core string, given string, middle string").where("core != ''")
    parsed = materialize(parsed.withColumn("form", F.xxhash64("space", "core", "given", "middle")), "forms")
    forms = parsed.select("form", "space", "core", "given", "middle").distinct()
    org = F.col("space").startswith("o:")
    # whole forms say everything: two distinctive words and a kind, or a given name with the surname
    size = F.size(F.split("core", " "))
    whole = (org & (F.col("space") != "o:") & (size >= 2) & (F.array_min(F.transform(F.split("core", " "), F.length)) > 1)) | (~org & (F.col("given") != ""))
    forms = materialize(forms.withColumn("whole", whole), "forms")
    strong = forms.where("whole")
    # a person stands once in the space of each given name that theirs can be
    spaces = F.when(org, F.array(F.concat("space", F.lit("#"), size.cast("string")))).otherwise(F.transform(F.split("given", r"\|"), lambda g: F.concat("space", F.lit(":"), g)))
    met = radius_join(strong.select("form", F.explode(spaces).alias("space"), "core"), radius)
    side = lambda p: forms.select(F.col("form").alias(p), F.col("core").alias(f"{p}c"), F.col("given").alias(f"{p}g"), F.col("middle").alias(f"{p}m"))
    met = materialize(met.join(side("a"), "a").join(side("b"), "b"), "met")
    same_given = (F.col("ag") == "") | F.arrays_overlap(F.split("ag", r"\|"), F.split("bg", r"\|"))
    same_middle = (F.col("am") == "") | (F.col("bm") == "") | (F.col("am") == F.col("bm"))
    long = F.least(F.length("ac"), F.length("bc")) >= F.when(F.col("d") > 1, 8).otherwise(5)
    edges = materialize(met.where(same_given & same_middle & long), "same")
    # a short form beside two of the names that it can mean is linked to neither
    ways = edges.select(F.col("a").alias("form"), "ag", "bg").union(edges.select("b", "bg", "ag")).where("contains(ag, '|') and not contains(bg, '|')")
    torn = materialize(ways.groupBy("form").agg(F.count_distinct("bg").alias("n")).where("n > 1").select("form"), "torn")
    edges = edges.join(torn.select(F.col("form").alias("a")), "a", "left_anti").join(torn.select(F.col("form").alias("b")), "b", "left_anti")
    roots = components(strong.select(F.col("form").alias("node")), edges)
    roots = materialize(strong.join(roots.withColumnRenamed("node", "form"), "form"), "roots")
    # what an incomplete form can mean: (key, root)
    by_word = roots.where(org).select("space", F.explode(F.split("core", " ")).alias("word"), "root").select(F.concat_ws("#", F.lit("w"), "space", "word").alias("key"), "root")
    bare = roots.where(org).select(F.concat_ws("#", F.lit("n"), "core").alias("key"), "root")
    w2 = F.split("core", " ")
    begin = lambda i, j: F.concat_ws("#", F.lit("i"), "space", w2[i], F.left(w2[j], F.lit(1)))
    by_initial = roots.where(org & (size == 2)).select(F.explode(F.array(begin(0, 1), begin(1, 0))).alias("key"), "root")
    letter = F.explode(F.transform(F.split("given", r"\|"), lambda g: F.left(g, F.lit(1))))
    by_person = roots.where(~org).select(F.col("core"), letter.alias("letter"), "root").select(F.concat_ws("#", F.lit("p"), "core", "letter").alias("key"), "root")
    meant = by_word.unionByName(bare).unionByName(by_initial).unionByName(by_person).distinct()
    weak = forms.where(~F.col("whole"))
    initial = F.filter(w2, lambda x: F.length(x) == 1)
    rest = F.filter(w2, lambda x: F.length(x) > 1)
    key = (
        F.when(~org & (F.col("middle") != ""), F.concat_ws("#", F.lit("p"), "core", F.left("middle", F.lit(1))))
        .when(org & (F.col("space") == "o:") & (size >= 2), F.concat_ws("#", F.lit("n"), "core"))
        .when(org & (size == 2) & (F.size(initial) == 1), F.concat_ws("#", F.lit("i"), "space", rest[0], initial[0]))
        .when(org & (size == 1) & (F.col("space") != "o:"), F.concat_ws("#", F.lit("w"), "space", "core"))
    )
    asked = weak.select("form", key.alias("key")).where("key is not null")
    one_of = lambda df: df.groupBy("form").agg(F.min("root").alias("root"), F.max("root").alias("other")).where("root = other").select("form", "root")
    hits = materialize(asked.join(meant, "key").select("form", "root").distinct(), "hits")
    single = one_of(hits)
    # forms without a kind, mistyped: the nearest whole forms of any kind, if they are one entity
    left = forms.where(org & (F.col("space") == "o:") & (size >= 2)).join(hits.select("form"), "form", "left_anti")
    pool = left.select("form", "core", F.lit(True).alias("asked")).unionByName(roots.where(org).select("form", "core", F.lit(False).alias("asked"))).withColumn("space", F.concat(F.lit("*#"), size.cast("string")))
    people = forms.where(~org & (F.col("given") == "") & (F.col("middle") != "")).join(hits.select("form"), "form", "left_anti")
    lettered = roots.where(~org).select("form", "core", "given").withColumn("letter", letter).select("form", "core", F.lit(False).alias("asked"), F.concat(F.lit("p~"), "letter").alias("space")).distinct()
    people = people.select("form", "core", F.lit(True).alias("asked"), F.concat(F.lit("p~"), F.left("middle", F.lit(1))).alias("space"))
    pool = materialize(pool.unionByName(people).unionByName(lettered), "pool")
    near = radius_join(pool, radius, cell=16 * CELL)
    near = near.select(F.col("a").alias("x"), F.col("b").alias("y")).union(near.select("b", "a"))
    near = near.join(pool.where("asked").select(F.col("form").alias("x")), "x").join(roots.select(F.col("form").alias("y"), "root"), "y")
    near = materialize(near, "near")
    single = materialize(single.unionByName(one_of(near.select(F.col("x").alias("form"), "root"))), "single")
    # what is still open: an initial and a dropped word under one distinctive word and kind
    open_ = weak.where(org & (F.col("space") != "o:")).join(single, "form", "left_anti").join(hits.select("form"), "form", "left_anti")
    rest_key = F.when((size == 2) & (F.size(initial) == 1), rest[0]).when(size == 1, F.col("core"))
    open_ = materialize(open_.select("form", F.xxhash64("space", rest_key).alias("root"), rest_key.alias("word")).where("word is not null"), "open")
    # and forms without a kind that have that word
    bare_left = left.select("form", F.explode(w2).alias("word")).join(single.select("form"), "form", "left_anti")
    bare_left = materialize(one_of(bare_left.join(open_.select("word", "root"), "word").select("form", "root")), "bare")
    # forms of several words without a kind that mean nothing else, mistyped: whole ones in a space of their own
    alone = left.join(near.select(F.col("x").alias("form")), "form", "left_anti").join(bare_left.select("form"), "form", "left_anti")
    alone = materialize(alone.select("form", F.concat(F.lit("alone#"), size.cast("string")).alias("space"), "core"), "alone")
    met = radius_join(alone, radius).join(side("a"), "a").join(side("b"), "b").where(long)
    alone = components(alone.select(F.col("form").alias("node")), met).select(F.col("node").alias("form"), "root")
    placed = roots.select("form", "root").unionByName(single).unionByName(open_.drop("word")).unionByName(bare_left).unionByName(alone)
    return materialize(parsed.select("name", "form").join(placed, "form", "left").select("name", F.coalesce("root", "form").alias("entity")), "linked")


def same_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a first in code point order, of every two spellings of one entity."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
