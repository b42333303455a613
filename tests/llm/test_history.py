import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import history as h

WORDS = [f"word{i}" for i in range(400)]


def page(seed, n=120):
    return " ".join(WORDS[(seed * 37 + i * i * (seed % 7 + 1) + 11 * i) % 400] for i in range(n))


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    out = {}
    for j, b in rows:
        for i, a in rows:
            x, y = shingles(a), shingles(b)
            same = bool(b.split()) and re.findall(r"\w+", a.lower()) == re.findall(r"\w+", b.lower())
            if i < j and (same or (x and y and len(x & y) / len(x | y) >= 0.6)):
                out[j] = min(out.get(j, i), i)
    return out


def table(spark, rows):
    cache = {}
    return spark.createDataFrame([(i, bytearray(h.word_numbers(t, cache).tobytes())) for i, t in rows], "id long, words binary")


def pages():
    base = [page(s) for s in range(6)]
    edited = " ".join(w if k % 30 else "changed" for k, w in enumerate(base[0].split()))
    halved = " ".join(base[1].split()[:60])
    rows = [*enumerate(base, 1), (10, edited), (11, halved), (12, base[2]), (13, base[2].upper() + "!"), (14, ""), (15, "  "), (16, "a b c"), (17, "A b, c"), (18, "a b d"), (19, base[0] + " tail of it"), (60, edited), (61, base[0] + " tail of it")]
    return rows + [(20 + k, base[3] + f" extra{k}") for k in range(40)]


def test_one_batch_is_exact(spark):
    rows = pages()
    got = {r.id_b: r.id_a for r in h.History(spark).accept(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_batches_find_what_one_batch_finds(spark):
    rows = pages()
    hist, got = h.History(spark), {}
    for lo in range(0, len(rows), 16):
        got |= {r.id_b: r.id_a for r in hist.accept(table(spark, rows[lo : lo + 16])).collect()}
    assert got == brute(rows)
    assert len(hist.segments) <= 3


def test_empty_batch(spark):
    hist = h.History(spark)
    assert hist.accept(table(spark, [])).count() == 0
    assert hist.accept(table(spark, [(1, page(1)), (1, page(1))])).count() == 0
    assert {(r.id_b, r.id_a) for r in hist.accept(table(spark, [(2, page(1))])).collect()} == {(2, 1)}


def test_long_lists_are_read_block_by_block(spark):
    # 60 pages share a long quotation only, so their lowest common page is no match; two of them are near each other
    quote = page(3, 40)
    rows = [(i, page(100 + i, 80) + " " + quote) for i in range(60)]
    rows.append((90, rows[50][1] + " end"))
    w = table(spark, rows)
    keys = spark.createDataFrame([(int(k), i) for i, t in rows for k in h.shingles(h.word_numbers(t, {}).tobytes()).view("int64")], "key long, doc long")
    got = {r.doc: r.old for r in h.lowest_near(keys, keys, w, block=4).collect()}
    assert got == brute(rows)


def test_hot_passages_lose_nothing(spark):
    # with lists of two rows at most, nearly every page goes through the rarest sequences
    rows = [*pages(), *[(100 + i, page(200 + i, 130) + " " + page(3, 60)) for i in range(12)]]
    hist, got = h.History(spark, hot=2), {}
    for lo in range(0, len(rows), 30):
        got |= {r.id_b: r.id_a for r in hist.accept(table(spark, rows[lo : lo + 30])).collect()}
    assert got == brute(rows)


def test_history_goes_on_in_a_new_process(spark):
    rows = pages()
    first = h.History(spark)
    got = {r.id_b: r.id_a for r in first.accept(table(spark, rows[:20])).collect()}
    again = h.History(spark, first.path)
    assert again.segments == first.segments
    got |= {r.id_b: r.id_a for r in again.accept(table(spark, rows[20:])).collect()}
    assert got == brute(rows)
    assert [s["level"] for s in again.segments] == [1]


def test_late_rows_correct_earlier_answers(spark):
    rows = sorted(pages())
    hist, got = h.History(spark), {}
    for part in (rows[1::2], rows[0::2]):
        for r in hist.accept(table(spark, part)).collect():
            got[r.id_b] = min(r.id_a, got.get(r.id_b, r.id_a))
    assert got == brute(rows)


def test_urls_batch_by_batch(spark):
    hist = h.History(spark)
    hist.seed_urls(spark.createDataFrame([("https://A.example/x/",), (None,)], "canonical_url string"))
    one = spark.createDataFrame([(1, "https://a.example/x#f"), (2, "https://a.example/y"), (3, None)], "rec_id long, url string")
    two = spark.createDataFrame([(4, "https://a.example/y?ref=1"), (5, "https://a.example/z")], "rec_id long, url string")
    assert [r.rec_id for r in hist.accept_urls(one).collect()] == [1]
    assert [r.rec_id for r in h.History(spark, hist.path).accept_urls(two).collect()] == [4]


@settings(max_examples=60, deadline=None)
@given(st.integers(16, 60), st.integers(0, 50), st.integers(0, 50), st.integers(0, 9))
def test_any_run_of_16_words_shares_a_suffix(n, before, after, seed):
    cache = {}
    run = page(seed, n)
    a, b = page(seed + 20, before + 90) + " " + run, run + " " + page(seed + 40, after + 90)
    key, doc, _ = h.suffixes([h.word_numbers(t, cache) for t in (a, b)])
    assert set(key[(doc == 0) & (key > 0)]) & set(key[(doc == 1) & (key > 0)])


def test_keys_keep_the_order_of_suffixes():
    w = h.word_numbers(page(5, 300), {})
    key, _, _ = h.suffixes([w])
    small = [tuple(int(x) >> 27 for x in w[i : i + h.DEPTH]) for i in range(len(w) - h.DEPTH + 1)]
    by_key = {sum(x << (5 * (h.DEPTH - 1 - k)) for k, x in enumerate(t)): t for t in small}
    met = [by_key[k] for k in sorted(key.tolist())]
    assert met == sorted(met)


def test_known_records(spark):
    seen = spark.createDataFrame([("https://A.example/x/", None), (None, "s"), ("rubbish", "s")], "canonical_url string, source string")
    batch = spark.createDataFrame([(1, "https://a.example/x#f"), (2, "https://a.example/y"), (2, "https://a.example/y"), (3, "https://a.example/y?ref=1"), (4, None), (5, ""), (6, "rubbish"), (7, "rubbish")], "rec_id long, url string")
    assert sorted(r.rec_id for r in h.known_records(seen, batch).collect()) == [1, 3]
    assert h.known_records(seen.limit(0), batch.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "!!", "x"])
def test_short_bodies(text):
    assert len(h.suffixes([h.word_numbers(text, {})])[0]) == len(text.strip("!"))


def test_an_array_is_a_row_a_shard_in_suffix_order(spark):
    rows = pages()
    hist = h.History(spark, hot=8)
    for lo in range(0, len(rows), 30):
        hist.accept(table(spark, rows[lo : lo + 30])).collect()
    for segment in hist.segments:
        stored = hist._array(segment).collect()
        assert len(stored) == len({r.shard for r in stored}) <= segment["shards"]
        for r in stored:
            key, doc, mark = (np.frombuffer(r[c], kind) for c, kind in (("key", np.int64), ("doc", np.int64), ("mark", np.uint8)))
            order = list(zip(key.tolist(), doc.tolist()))
            assert order == sorted(set(order)) and set(h.shard_of(key, segment["shards"]).tolist()) == {r.shard}
            assert max(np.unique(key, return_counts=True)[1]) <= 8
            assert len(set(key[mark & 1 > 0])) == (mark & 1).sum()


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40), st.integers(1, 7))
def test_shards_keep_every_suffix(keys, shards):
    n = len(keys)
    rows = {"key": np.array(keys, np.int64), "doc": np.arange(n), "part": np.arange(n) * 3, "mark": np.zeros(n)}
    back = h._unpacked(h._packed(rows, shards))
    assert sorted(zip(*(back[c].tolist() for c in rows))) == sorted(zip(*(rows[c].tolist() for c in rows)))
