import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import crosspoly, neighbours

SCHEMA = "tab string, id long, n int, embedding array<float>"


def vectors(seed=3, groups=25, each=4, noise=0.12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.standard_normal(64)
        for k in range(each):
            rows.append(("t", g, k + 1, (c + noise * rng.standard_normal(64) * (k > 0)) * rng.uniform(0.1, 9)))
    return rows


def brute(rows, least, k=10):
    x = np.array([r[3] for r in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    keys = [(r[1], r[2]) for r in rows]
    out = set()
    for i in range(len(rows)):
        order = sorted((-s[i, j], keys[j]) for j in range(len(rows)) if j != i)[:k]
        out |= {(keys[i], q) for v, q in order if -v >= least}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(t, i, n, None if v is None else [float(np.float32(x)) for x in v]) for t, i, n, v in rows], SCHEMA)


def pairs(df):
    return {((r.id, r.n), (r.id_b, r.n_b)) for r in df.collect()}


def test_hadamard_is_orthonormal():
    m = crosspoly.hadamard(np.eye(64, dtype=np.float32))
    assert np.allclose(m @ m.T, np.eye(64), atol=1e-5)


def test_near_ones_are_found(spark):
    rows = vectors()
    assert pairs(neighbours.neighbours_within(frame(spark, rows), 0.9)) == brute(rows, 0.9)
    assert pairs(neighbours.neighbours_within(frame(spark, rows), 0.9, sigmas=None)) == brute(rows, 0.9)


def test_hot_buckets_are_compared_in_blocks(spark):
    rows = vectors(groups=3, each=40, noise=0.08)
    assert pairs(neighbours.neighbours_within(frame(spark, rows), 0.9, bucket_cap=8)) == brute(rows, 0.9)


def test_copies_and_faults(spark):
    v = np.arange(1, 65, dtype=float)
    rows = [("t", k, 1, v * (1 + k % 3)) for k in range(30)] + [("t", 100, 1, None), ("t", 101, 1, v[:5]), ("t", 102, 1, v * 0), ("t", 103, 1, np.where(v == 3, np.nan, v)), ("t", 104, 1, np.where(v == 3, np.inf, v)), ("u", 0, 1, v)]
    rows.append(rows[0])
    df = frame(spark, rows).withColumn("cls", F.lit("clash"))
    got = pairs(neighbours.neighbours_within(df, 0.9))
    assert got == {((i, 1), (j, 1)) for i in range(30) for j in [x for x in range(30) if x != i][:10]}
    assert neighbours.neighbours_within(df.limit(0), 0.9).count() == 0


def test_recall_of_all_ten(spark):
    rng = np.random.default_rng(5)
    c = rng.standard_normal((40, 64))
    rows = [("t", i, 1, c[i % 40] * 0.7 + rng.standard_normal(64)) for i in range(1500)]
    df = frame(spark, rows)
    got = pairs(neighbours.nearest(df, df.where("id % 100 = 0"), block=300))
    want = {p for p in brute(rows, -2) if p[0][0] % 100 == 0}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_other_lengths(spark):
    rng = np.random.default_rng(8)
    for dim in (3, 96):
        rows = [("t", i, 1, rng.standard_normal(dim) * 0.02 + np.eye(dim)[i % 3]) for i in range(60)]
        got = pairs(neighbours.neighbours_within(frame(spark, rows), 0.9, k=60, dim=dim))
        want = brute(rows, 0.9, 60)
        assert got <= want and len(got) >= 0.9 * len(want)
        assert pairs(neighbours.nearest(frame(spark, rows), frame(spark, rows[:5]), k=3, dim=dim)) <= {((i, 1), (j, 1)) for i in range(60) for j in range(60)}


def test_sketch_bound():
    # so many deviations above the mean, whatever the similarity asked for
    assert neighbours.most_bits(0.9) == 36 and neighbours.most_bits(0.9, 6) == 43 and neighbours.most_bits(0.9, None) == 128 and neighbours.most_bits(1.0) == 0 and neighbours.most_bits(-1.0) == 128
