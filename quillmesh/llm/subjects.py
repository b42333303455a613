"""Problem 8: subjects of documents by factoring the document-term matrix with anchored components.

V, the matrix of documents and terms, is made once and kept in a table: for each document its distinct terms as 64-bit
numbers, and which of them each of its sentences has. Every subject is one component, one more takes what belongs to no
subject. The components are anchored by the hand-labelled documents: on a bounded sample of them (``LABELLED``) the
factors start from the labels and are updated in turn. Then W and H are updated in turn over all documents, ALTERNATIONS
times: with H given, each document's mixture W is found by the multiplicative update, from a uniform start; with W given,
the sums that give H are made per partition and added up by a shuffle on the term, so terms that no labelled document has
get their loadings from the documents they stand in. A last update gives every document its mixture. Subjects with a part
of LEAST of it are checked exactly: a sentence is about the subject that its terms load on most, and a document has the
subjects of at least a quarter of its subject-bearing sentences.

H goes to the executors as a broadcast of two arrays. It holds the terms that are in TERM_SHARE of a language's documents
and load on one subject by PURE; there are at most the mean number of terms of a document over TERM_SHARE, whatever the
number of documents. All sums are over all documents, however they are split into partitions.

Defined cases: null, empty and meaningless texts have no subject terms and no rows; a document delivered twice counts
once where its text is the same (the sums) and in the result; labels are compared trimmed and in lower case, unknown
subjects are ignored; without labels there are no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import materialize

#: Most labelled documents that the anchors are fitted on (the lowest hashes of their ids).
LABELLED = 4000
ROUNDS, ALTERNATIONS, FOLDS = 15, 2, 5
#: Terms that a partition sums up before it passes them on.
FLUSH = 1 << 18
#: A term counts if it is in this share of the documents, and in at least MIN_DOCS.
TERM_SHARE, MIN_DOCS = 2e-4, 3
#: A term bears a subject if that much of its loading is on it.
PURE = 0.6
QUARTER = 0.25
#: Documents of no particular subject that are added to each term, over all documents and in the labelled sample.
SHRINK, ANCHOR_SHRINK = 3.0, 1.0
#: The part of a mixture from which on a subject is checked.
LEAST = 0.08
#: A text has a subject only if this share of its sentences bears one.
BEARING = 0.2
#: A sentence counts from FEW words on; what has no sentence end is read in stretches of LONGEST words.
FEW, LONGEST = 5, 24
#: Documents that are read together.
CHUNK = 2000

_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?](?=\s|$)|[;|\n]")
_BROKEN = re.compile("[ÃÂâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_BLANKS = re.compile(r"[^\S\n]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """The text with entities, soft hyphens, broken encodings and blanks set right."""
    if "&" in text:
        text = html.unescape(text)
    if "\xad" in text or "​" in text:
        text = text.replace("\xad", "").replace("​", "")
    if ("Ã" in text or "Â" in text or "â" in text) and _BROKEN.search(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            text = _BROKEN.sub(lambda m: _mend(m.group(0)), text)
    return _BLANKS.sub(" ", text) if "  " in text or "\t" in text or "\xa0" in text else text


def _mend(s: str) -> str:
    try:
        return s.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return s


# Frequent function words by language, to tell languages apart; they bear no subject.
FUNCTION_WORDS = {
    "en": "the of and to with was had from that this not in a for by at on would if is it as be".split(),
    "de": "der die das und von zu für nach ohne den ein eine in im seit doch als mit auf ist nicht zum".split(),
    "fr": "le la les des du et pour sont sans dans est avec de un une à au par mais a que qui".split(),
    "es": "el los las del y para con según después entre una aunque de la en que pero a al se sin un".split(),
}
#: Languages that write nouns with a capital.
NOUNS = {"de"}
CODES = list(FUNCTION_WORDS)
_LANGUAGE: dict[str, int] = {}
for _j, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in _ws:
        _LANGUAGE[_w] = _LANGUAGE.get(_w, 0) | 1 << _j


class Tokens(dict):
    """Numbers of tokens, and what is known of each: its term, whether it ends a sentence, the languages it is a function word of."""

    MOST = 1 << 18

    def __init__(self) -> None:
        super().__init__()
        self.term: list[int] = []  # 0 for what is no term
        self.kind: list[int] = []  # 1 small, 2 with a capital, 4 capitals only, 8 end
        self.words: list[int] = []

    def __missing__(self, token: str) -> int:
        low = token.lower()
        word = token[0].isalpha()
        self.kind.append((1 if token.islower() else 4 if token.isupper() and len(token) > 1 else 2) if word else 8)
        self.words.append(_LANGUAGE.get(low, 0) if word else 0)
        self.term.append(xxhash.xxh64_intdigest(low) | 1 if word and low not in _LANGUAGE else 0)
        self[token] = len(self.term) - 1
        return len(self.term) - 1


def matrix(texts: list[str], tokens: Tokens) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each text: the number of its language (-1 for none), its distinct terms, the place of each term of its sentences among
    these, how many each sentence has, and how many sentences count.

    Terms are small words and pairs of them next to each other; in languages that write nouns with a capital, capitalised
    words too. Of the others only names have one, and stay out; a text in capitals only is read in small letters.
    """
    if len(tokens) > Tokens.MOST:
        tokens.clear()
        tokens.__init__()
    numbers = []
    for x in texts:
        found = list(map(tokens.__getitem__, _TOKEN.findall(plain(x))))
        numbers.append(found)
    kind = np.array(tokens.kind, dtype=np.uint8)
    for i, found in enumerate(numbers):
        k = kind[found] if found else kind[:0]
        if (k == 4).sum() * 2 > (k != 8).sum():
            numbers[i] = list(map(tokens.__getitem__, _TOKEN.findall(plain(texts[i]).lower())))
    kind = np.array(tokens.kind, dtype=np.uint8)
    size = np.array([len(n) for n in numbers], dtype=np.int64)
    at = np.fromiter((t for n in numbers for t in n), dtype=np.int64, count=int(size.sum()))
    doc = np.repeat(np.arange(len(texts)), size)
    words = np.array(tokens.words, dtype=np.uint8)[at]
    votes = np.stack([np.bincount(doc[(words >> j) & 1 == 1], minlength=len(texts)) for j in range(len(CODES))])
    code = np.where(votes.max(axis=0) > 0, votes.argmax(axis=0), -1)
    kind, term = kind[at], np.array(tokens.term, dtype=np.uint64)[at]
    nouns = np.isin(code, [j for j, c in enumerate(CODES) if c in NOUNS])[doc]
    # sentences: what lies between ends, in stretches of LONGEST words
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    ends = np.concatenate([[0], np.cumsum(kind == 8)])[:-1]
    begin = np.ones(len(at), dtype=bool)
    begin[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
    start = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
    sentence = np.cumsum(begin | ((np.arange(len(at)) - start) % LONGEST == 0)) - 1
    long_enough = np.bincount(sentence, weights=kind != 8, minlength=sentence[-1] + 1 if len(at) else 0) >= FEW
    whose = np.zeros(len(long_enough), dtype=np.int64)
    whose[sentence] = doc
    counted = np.bincount(whose[long_enough], minlength=len(texts))
    # the terms in order: words, then pairs of small words of one stretch
    salt = (code[doc] + 2).astype(np.uint64) * _MULT
    single = (term != 0) & ((kind == 1) | (nouns & (kind != 8)))
    small = (term != 0) & (kind == 1)
    pair = np.zeros(len(at), dtype=bool)
    pair[:-1] = small[:-1] & small[1:] & (start[:-1] == start[1:]) & (doc[:-1] == doc[1:])
    i, p = np.nonzero(single)[0], np.nonzero(pair)[0]
    value = np.concatenate([term[i] ^ salt[i], (term[p] * np.uint64(31) + (term[p + 1] ^ (term[p + 1] >> np.uint64(29))) * _MULT) ^ salt[p]])
    where, sent = np.concatenate([doc[i], doc[p]]), np.concatenate([sentence[i], sentence[p]])
    order = np.lexsort((value, where))
    v, w = value[order], where[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    rank = np.empty(len(v), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    distinct, owner = v[new], w[new]
    base = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    by = np.lexsort((rank, sent))
    rank, sent, where = rank[by], sent[by], where[by]
    head = np.ones(len(sent), dtype=bool)
    head[1:] = sent[1:] != sent[:-1]
    heads = np.nonzero(head)[0]
    many = np.diff(np.append(heads, len(sent)))
    of = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(texts)))])
    lines = np.concatenate([[0], np.cumsum(np.bincount(where[heads], minlength=len(texts)))])
    return [(int(code[d]), distinct[base[d] : base[d + 1]], rank[of[d] : of[d + 1]] - base[d], many[lines[d] : lines[d + 1]], int(counted[d])) for d in range(len(texts))]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens = Tokens()
    for pdf in batches:
        for lo in range(0, len(pdf), CHUNK):
            part = pdf.iloc[lo : lo + CHUNK]
            rows = matrix(part["text"].tolist(), tokens)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "code": [r[0] for r in rows], "terms": [r[1].view(np.int64).tobytes() for r in rows], "places": [r[2].astype(np.int32).tobytes() for r in rows], "sizes": [r[3].astype(np.int32).tobytes() for r in rows], "sentences": [r[4] for r in rows]})


class Block:
    """Rows of the matrix laid end to end."""

    def __init__(self, pdf: pd.DataFrame):
        glue = lambda c, kind: np.frombuffer(b"".join(pdf[c]), dtype=kind)
        self.n = len(pdf)
        self.code = pdf["code"].to_numpy()
        self.terms = glue("terms", np.int64)
        self.many = np.array([len(b) // 8 for b in pdf["terms"]], dtype=np.int64)
        self.doc = np.repeat(np.arange(self.n), self.many)
        held = np.array([len(b) // 4 for b in pdf["places"]], dtype=np.int64)
        self.places = glue("places", np.int32) + np.repeat(np.cumsum(self.many) - self.many, held)
        self.count = np.bincount(self.places, minlength=len(self.terms)).astype(np.float32)  # V: the sentences of a document that have the term
        self.sizes = glue("sizes", np.int32).astype(np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(b) // 4 for b in pdf["sizes"]])  # of a sentence
        self.sentences = pdf["sentences"].to_numpy()

    def loads(self, keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each term is in H, its row of H)."""
        if not len(keys):
            return np.zeros(len(self.terms), bool), np.zeros((len(self.terms), h.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(keys, self.terms), len(keys) - 1)
        known = keys[at] == self.terms
        return known, h[at]

    def mixtures(self, known: np.ndarray, rows: np.ndarray, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """W, and the share of each component in each known term, by multiplicative updates from a uniform start."""
        doc, h, v = self.doc[known], rows[known].astype(np.float32), self.count[known]
        k = h.shape[1]
        w = np.full((self.n, k), 1 / k, dtype=np.float32)
        r = h
        for _ in range(folds):
            r = w[doc] * h
            r /= r.sum(axis=1, keepdims=True) + 1e-30
            w = np.stack([np.bincount(doc, weights=v * r[:, j], minlength=self.n) for j in range(k)], axis=1).astype(np.float32)
            w /= w.sum(axis=1, keepdims=True) + 1e-30
        return w, doc, r

    def about(self, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many sentences of each document are about each subject."""
        k = rows.shape[1] - 1
        flat = np.where(known[self.places][:, None], rows[self.places][:, :k], 0)
        starts = np.cumsum(self.sizes) - self.sizes
        score = np.add.reduceat(flat, starts, axis=0) if len(starts) else np.zeros((0, k))
        bears = score.max(axis=1) > 0 if len(score) else np.zeros(0, bool)
        out = np.zeros((self.n, k))
        np.add.at(out, (self.owner[bears], score[bears].argmax(axis=1)), 1)
        return out


def fit_anchors(block: Block, given: list[list[int]], k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(terms, loadings on k subjects and the rest) from labelled documents; given: the subject numbers of each."""
    out_keys, out_rows = [], []
    for code in np.unique(block.code):
        own = block.code[block.doc] == code
        # numbers of this language's documents and terms
        docs, doc = np.unique(block.doc[own], return_inverse=True)
        keys, term, seen = np.unique(block.terms[own], return_inverse=True, return_counts=True)
        kept = seen[term] >= 2
        doc, term = doc[kept], term[kept]
        if not len(term):
            continue
        # labels may be wrong or forgotten, so the other subjects start low, not at zero
        w = np.full((len(docs), k + 1), 0.02)
        for i, d in enumerate(docs):
            w[i, given[d]] = 1.0
        w[:, k] = 1.0
        sums = lambda r, j: np.bincount(term, weights=r[:, j], minlength=len(keys))
        h = np.stack([sums(w[doc], j) + 1e-3 for j in range(k + 1)])
        h[k] = seen
        h /= h.sum(axis=1, keepdims=True)
        prior = w / w.sum(axis=1, keepdims=True)
        w = prior.copy()
        for _ in range(rounds):
            r = w[doc] * h[:, term].T
            r /= r.sum(axis=1, keepdims=True) + 1e-300
            w = np.stack([np.bincount(doc, weights=r[:, j], minlength=len(docs)) for j in range(k + 1)], axis=1) + 2 * prior
            w /= w.sum(axis=1, keepdims=True)
            h[:k] = np.stack([sums(r, j) + 1e-4 for j in range(k)])
            h[:k] /= h[:k].sum(axis=1, keepdims=True)
        mass = np.stack([sums(r, j) for j in range(k)])
        base = w[:, :k].sum(axis=0)[:, None] + 0.5
        load = (mass + ANCHOR_SHRINK * base / base.sum()) / base
        load /= load.sum(axis=0) + 1e-300
        own_share = mass.sum(axis=0) / np.maximum(seen, 1)
        pure = (load.max(axis=0) >= PURE) & (own_share >= 0.3)
        out_keys.append(keys[pure])
        other = np.minimum(1 - own_share, 0.3)
        out_rows.append(np.vstack([load * (1 - other), other]).T[pure])
    return _sorted(np.concatenate(out_keys) if out_keys else np.array([], np.int64), np.vstack(out_rows) if out_rows else np.zeros((0, k + 1)))


def _sorted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], np.maximum(rows[order], 1e-4).astype(np.float32)


def _summed(terms: np.ndarray, codes: np.ndarray, parts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    keys, first, inverse = np.unique(terms, return_index=True, return_inverse=True)
    return keys, codes[first], np.stack([np.bincount(inverse, weights=parts[:, j], minlength=len(keys)) for j in range(parts.shape[1])], axis=1), np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)


def _gather(model, k: int, flush: int):
    columns = [f"load{j}" for j in range(k + 1)]

    def frame(held: list[tuple]) -> pd.DataFrame:
        keys, codes, parts, n = _summed(*[np.concatenate(x) for x in zip(*held)])
        return pd.DataFrame({"term": keys, "code": codes.astype(np.int32), "n": n} | {c: parts[:, j] for j, c in enumerate(columns)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, h = model.value
        held: list[tuple] = []
        size = 0
        for pdf in batches:
            for lo in range(0, len(pdf), CHUNK):
                b = Block(pdf.iloc[lo : lo + CHUNK])
                known, rows = b.loads(keys, h)
                w, doc, r = b.mixtures(known, rows)
                subject = w[:, :k].sum(axis=1)
                # a document counts if enough of its sentences bear a subject; subjects add up to one document, the rest is kept apart
                bears = (b.about(known, rows).sum(axis=1) >= np.maximum(1.0, BEARING / 2 * b.sentences)) & (subject > 0)
                share = np.zeros((b.n, k + 1))
                share[bears, :k] = w[bears, :k] / subject[bears, None]
                share[bears, k] = w[bears, k]
                # a term that H doesn't have yet is shared out as its document is
                part = share[b.doc]
                part[known, :k] = r[:, :k] / (r[:, :k].sum(axis=1, keepdims=True) + 1e-30)
                part[known, k] = r[:, k]
                keep = bears[b.doc]
                held.append(_summed(b.terms[keep], b.code[b.doc][keep], part[keep], np.ones(int(keep.sum()))))
                # a language's documents are summed up under its number
                held.append(_summed(b.code[bears].astype(np.int64), b.code[bears], share[bears], np.ones(int(bears.sum()))))
                size += len(held[-2][0])
                if size >= flush:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    return run, columns


def _alternate(table: DataFrame, model, k: int, flush: int) -> tuple[np.ndarray, np.ndarray]:
    """H from the sums over all documents under the mixtures that the broadcast H gives them."""
    gather, columns = _gather(model, k, flush)
    each = table.select("code", "terms", "places", "sizes", "sentences").mapInPandas(gather, ", ".join(["term long, code int, n long", *(f"{c} double" for c in columns)]))
    added = each.groupBy("term", "code").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
    added = materialize(added.where((F.col("n") >= MIN_DOCS) | F.col("term").between(-1, len(CODES))), "terms")
    whole = added.where(F.col("term") == F.col("code")).collect()  # one row a language
    keys, rows = [], []
    for w in whole:
        base, rest = np.array([w[c] for c in columns[:k]]) + 0.5, w[columns[k]] + 0.5
        # a few documents of no particular subject are added to each term, so that rare terms aren't pure by chance
        more = SHRINK * base / base.sum()
        lift = [(F.col(c) + float(more[j])) / float(base[j]) for j, c in enumerate(columns[:k])]
        terms = added.where((F.col("code") == w.code) & (F.col("term") != w.code) & (F.col("n") >= max(MIN_DOCS, TERM_SHARE * w.n)))
        # at most the mean number of terms of a document over TERM_SHARE
        pure = terms.where(F.greatest(*lift) >= PURE * sum(lift[1:], lift[0])).select("term", "n", *columns).toPandas()
        load = (pure[columns[:k]].to_numpy() + more) / base
        # each component by its own mass, the rest's against that of the strongest subject
        other = pure[[columns[k]]].to_numpy() / rest
        other = other / (other + load.max(axis=1, keepdims=True))
        load /= load.sum(axis=1, keepdims=True)
        keys.append(pure["term"].to_numpy(dtype=np.int64))
        rows.append(np.hstack([load * (1 - other), other]))
    return _sorted(np.concatenate(keys), np.vstack(rows)) if keys else (np.array([], np.int64), np.zeros((0, k + 1), np.float32))


def label_documents(docs: DataFrame, areas: DataFrame, labels: DataFrame, labelled: int = LABELLED, flush: int = FLUSH) -> DataFrame:
    """(doc_id, subject) of ``docs`` (doc_id, text); ``areas`` (subject) is a table of parameters, ``labels`` (doc_id, subject) given by hand."""
    spark = docs.sparkSession
    names = sorted({r.subject.strip() for r in areas.select("subject").where("subject is not null").distinct().collect()})
    number = {s.lower(): i for i, s in enumerate(names)}
    k = len(names)
    schema = "doc_id long, subject string"
    known = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(list(number)) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    texts = docs.select("doc_id", "text").where("text is not null and text != ''")
    table = materialize(texts.mapInPandas(_rows, "doc_id long, code int, terms binary, places binary, sizes binary, sentences int"), "matrix")
    sample = known.join(table, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "code").limit(labelled).toPandas()
    if not len(sample):
        return spark.createDataFrame([], schema)
    model = fit_anchors(Block(sample), [[number[s] for s in found] for found in sample["subjects"]], k)
    for _ in range(ALTERNATIONS):
        if not len(model[0]):
            return spark.createDataFrame([], schema)
        model = _alternate(table, spark.sparkContext.broadcast(model), k, flush)
    fitted = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, h = fitted.value
        for pdf in batches:
            for lo in range(0, len(pdf), CHUNK):
                part = pdf.iloc[lo : lo + CHUNK]
                d, j = subjects_of(Block(part), keys, h)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[d], "subject": [names[x] for x in j]})

    return table.where("doc_id is not null").mapInPandas(judge, schema).distinct()


def subjects_of(block: Block, keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, subject number): the subjects with a part of the row's mixture that at least a quarter of its subject-bearing sentences are about."""
    known, rows = block.loads(keys, h)
    w, _, _ = block.mixtures(known, rows)
    k = rows.shape[1] - 1
    mixed = w[:, :k] / (w[:, :k].sum(axis=1, keepdims=True) + 1e-30)
    about = block.about(known, rows)
    n = about.sum(axis=1, keepdims=True)
    has = (mixed >= LEAST) & (about > 0) & (about >= QUARTER * n) & (n >= BEARING * block.sentences[:, None])
    return np.nonzero(has)


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents have each subject; documents without one under ''."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    each = ids.join(found, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("")).alias("subject")).agg(F.count_distinct("doc_id").alias("documents"))
    return each.select("subject", "documents", (F.col("documents") / ids.agg(F.count("*")).scalar()).alias("share"))
