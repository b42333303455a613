import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import mixing as m
from quillmesh.llm.tokens import TOKENIZER, encoding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**40))
def test_permutations_are_one_to_one(n, key):
    at = np.arange(n)
    place = m.permuted(at, np.full(n, n), np.full(n, key))
    assert sorted(place.tolist()) == at.tolist()
    assert m.permuted(place, np.full(n, n), np.full(n, key), back=True).tolist() == at.tolist()


def test_permutation_scatters_neighbours():
    place = m.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 5))
    assert len(set(np.diff(place).tolist())) > 500


@pytest.mark.parametrize("used", [[5, 0, 7], [1000, 10, 390], [3 * 10**10, 10**9, 7]])
def test_counts_add_up(used):
    counts = m.draw_counts(np.array(used), 16, np.random.default_rng(1))
    assert counts.sum(axis=0).tolist() == used and counts.min() >= 0
    assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1
    if min(used) > 100:
        assert len(set(counts[:, 0].tolist())) > 4


def corpus(spark):
    rows = [(i, ["A", "a ", "b", "c", None, "untargeted"][i % 6], f"word{i} and some more text " * (1 + i % 40)) for i in range(600)]
    rows += [(10_000, "b", "one very long document " * 900), (3, "c", rows[3][2]), (10_001, "a", None), (10_002, "a", ""), (None, "a", "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("shard", F.lit("clash"))
    return docs, spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.15, 3), ("nowhere", 0.05, 1)], "source string, target_share double, max_repeats int")


def test_blocks_shards_and_shares(spark):
    docs, targets = corpus(spark)
    rows = m.mix(docs, targets, block_tokens=64, shards=7).collect()
    tokens = {r.doc_id: len(encoding(TOKENIZER).encode_ordinary(r.text)) for r in docs.where("text != ''").collect()}
    sizes, per_block, uses = {}, {}, {}
    for r in rows:
        sizes.setdefault(r.shard, set()).add(r.position)
        per_block.setdefault((r.source, r.block, r.use), []).append(r)
        uses.setdefault((r.doc_id, r.from_token), set()).add(r.use)
        assert 0 <= r.from_token and r.from_token + r.tokens <= tokens[r.doc_id]
    # shards are of one size and have every position once
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(s == set(range(len(s))) for s in sizes.values()) and len({(r[0].shard, r[0].position) for r in per_block.values()}) == len(per_block)
    # blocks are whole, but for each source's last
    whole = {s: max(b for x, b, _ in per_block if x == s) for s in "abc"}
    assert all(sum(r.tokens for r in v) == 64 for (s, b, _), v in per_block.items() if b < whole[s])
    most = {"a": 2, "b": 1, "c": 3}
    assert all(len(u) <= 3 for u in uses.values()) and all(r.use < most[r.source] for r in rows)
    # every source is spread over the shards
    assert all(len({r.shard for r in rows if r.source == s}) == 7 for s in "ab")
    got = {r.source: r for r in m.shares(m.mix(docs, targets, block_tokens=64), targets).collect()}
    assert got["nowhere"].tokens == 0
    assert all(abs(got[s].reached_share - w / 0.95) < 0.01 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)))
    assert got["b"].most_repeats == 1 and got["c"].most_repeats <= 3


def test_given_total_and_empty_tables(spark):
    docs, targets = corpus(spark)
    used = m.mix(docs, targets, total_tokens=3000, block_tokens=32).agg(F.sum("tokens")).first()[0]
    assert abs(used - 3000) < 100
    assert m.mix(docs.limit(0), targets).count() == 0 and m.mix(docs, targets.limit(0)).count() == 0
    assert m.documents(m.mix(docs, targets)).where("repeats > 3").count() == 0
