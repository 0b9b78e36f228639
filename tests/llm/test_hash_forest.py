import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import hash_forest


def brute(rows, k=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good.items():
        if q % 20 == 0:
            near = sorted(((-float((good[i] * x).sum()), i) for i in good if i != q and len(good[i]) == len(x)))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(90)]
    rows += [(100, [1.0] * 8), (101, [1.0] * 8), (102, [1.0] * 8), (103, None), (104, [0.0] * 8), (105, [float("nan")] * 8), (106, [None] + [1.0] * 7), (107, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as rank")
    got = {}
    for r in hash_forest.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12) for q in want)


def measured(vectors, got):
    """Recall at 20, share of rows touched."""
    hits, found, touched = 0, {}, {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        touched[r.query_id] = r.n_gathered / r.n_block
    for q in range(0, len(vectors), 20):
        s = vectors @ vectors[q]
        s[q] = -9
        hits += len(found[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(found) == len(range(0, len(vectors), 20)) and all(len(v) == 20 for v in found.values())
    return hits / (20 * len(found)), sum(touched.values()) / len(touched)


def test_recall_holds_and_the_share_of_rows_touched_falls(spark):
    """Without any structure, the hardest case: directions spread evenly in 64 dimensions."""
    shares = []
    for n, settings in ((3000, {}), (12_000, {"block_rows": 2500}), (50_000, {})):
        vectors = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32).astype(float)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        table = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(vectors))}))
        recall, share = measured(vectors, hash_forest.nearest(table, **settings))
        assert recall >= 0.9, (n, recall)
        shares.append(share)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3, shares


def test_blocks_are_parts_of_one_forest():
    """At every prefix length, the ranges of the blocks hold together what one array of all rows holds."""
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(600, 16)), rng.normal(size=(5, 16))
    low, high = hash_forest.HashForest(vectors, trees=6, bits=14).ranges(queries)
    parts = [hash_forest.HashForest(vectors[k::3], trees=6, bits=14).ranges(queries) for k in range(3)]
    assert (high - low == sum(h - l for l, h in parts)).all()


def test_only_the_own_row_is_left_out(spark):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-9, 10, size=(60, 5)).astype(float)
    rows = [(int(k) // 3 * 10, v.tolist()) for k, v in enumerate(vectors)] + [(20, [1.0, 2.0]), (21, [1.0, 0.5])]
    got = {}
    for r in hash_forest.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<float>"), block_rows=13).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 4)))
    want = {}
    for at, (q, x) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-round(float(np.dot(np.float32(v), np.float32(x))), 4), k) for j, (k, v) in enumerate(rows) if j != at and len(v) == len(x))
            want.setdefault(q, []).extend((rank, k, -s) for rank, (s, k) in enumerate(near[:20], 1))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    assert any(r[1] == 0 for r in got[0])  # the other rows of id 0 are its neighbours


def test_candidates_widen_with_shorter_prefixes():
    rng = np.random.default_rng(3)
    forest = hash_forest.HashForest(rng.normal(size=(500, 16)), trees=5, bits=12)
    queries = rng.normal(size=(4, 16))
    few, many = list(forest.candidates(queries, 10)), list(forest.candidates(queries, 200))
    assert all(len(f) >= 10 and len(m) >= 200 and set(f) <= set(m) for f, m in zip(few, many))
    assert all(len(c) == 500 for c in forest.candidates(queries, 10_000))
    lows, highs = forest.ranges(queries)
    assert (np.diff(highs - lows, axis=1) <= 0).all() and (highs[:, 0] - lows[:, 0] == 500).all()


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(1, [1.0, 2.0])]])
def test_too_few_rows(spark, rows):
    assert hash_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0
