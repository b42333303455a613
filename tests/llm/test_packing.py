from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=30), st.just(100))
def test_plan_holds_every_item(sizes, capacity):
    kinds = packing.plan(sizes, capacity)
    held = Counter()
    for number, contents in kinds:
        assert number > 0 and sum(s * k for s, k in contents) <= capacity
        assert sum(k for s, k in contents if 3 * s > capacity) <= 2
        for s, k in contents:
            held[s] += number * k
    assert held == Counter(sizes)
    # no plan needs fewer containers than the total fills, or than there are items above half a container
    least = max(sum(s * n for s, n in sizes.items()) / capacity, sum(n for s, n in sizes.items() if 2 * s > capacity))
    assert not sizes or sum(n for n, _ in kinds) <= 1.7 * least + 2


def test_pack(spark):
    texts = [(1, "one two three " * 300), (2, "word"), (3, None), (4, ""), (5, "a b c d " * 40), (6, "a b c d " * 40), (2, "word")] + [(10 + k, "some words in a row " * (k % 9 + 1)) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    limits = spark.createDataFrame([(1, 64, 1), (2, 256, 0), (3, None, 1)], "limit_id int, capacity_tokens int, separator_tokens int")
    rows = packing.pack(docs, limits).collect()
    from quillmesh.llm.tokens import TOKENIZER, encoding

    size = {i: len(encoding(TOKENIZER).encode_ordinary(t)) for i, t in texts if t}
    for limit, cap, sep in ((1, 64, 1), (2, 256, 0)):
        mine = [r for r in rows if r.limit_id == limit]
        got = Counter()
        for r in mine:
            got[r.doc_id] += r.tokens
        assert got == Counter(size)
        bins = {}
        for r in mine:
            bins.setdefault(r.container, []).append(r)
        assert all(sum(r.tokens for r in b) + sep * (len(b) - 1) <= cap for b in bins.values())
        assert all(size[r.doc_id] > cap for r in mine if r.part > 1)
        by = {(r.doc_id, r.part): r.from_token for r in mine}
        assert all(at == (part - 1) * cap for (_, part), at in by.items())
    assert packing.pack(docs.limit(0), limits).count() == 0 and packing.pack(docs, limits.limit(0)).count() == 0
    full = {r.limit_id: r for r in packing.fill(packing.pack(docs, limits), limits).collect()}
    assert full[2].used_share > 0.95 and full[1].most_over <= 0


def test_hot_sizes_and_rounded_sizes(spark):
    # a third of the rows has one size, and far more sizes are possible than are planned
    docs = spark.createDataFrame([(k, "some words in a row " * (40 if k % 3 == 0 else 1 + k % 11)) for k in range(400)], "doc_id long, text string")
    limits = spark.createDataFrame([(1, 64, 1), (2, 250, 0)], "limit_id int, capacity_tokens int, separator_tokens int")
    plain = packing.fill(packing.pack(docs, limits), limits).collect()
    hot = packing.pack(docs, limits, stretch=7)
    assert sorted(packing.fill(hot, limits).collect()) == sorted(plain)
    assert hot.count() == hot.select("limit_id", "doc_id", "part").distinct().count()
    coarse = {r.limit_id: r for r in packing.fill(packing.pack(docs, limits, most_sizes=40), limits).collect()}
    assert all(r.most_over <= 0 and r.tokens == p.tokens for p in plain for r in [coarse[p.limit_id]])
