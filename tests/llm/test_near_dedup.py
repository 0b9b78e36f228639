import random
from itertools import combinations

import numpy as np
import pytest

from ledgerloom.llm import near_dedup
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shingles import CirculantMinHash, band_keys, shingle_set, word_hashes


def plain_sets(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def plain_components(rows):
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {k: plain_sets(t) for k, t in rows}
    for a, b in combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def families():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for size, length, edits in [(12, 60, 1), (40, 90, 2), (30, 80, 3), (8, 6, 1), (5, 300, 4), (60, 50, 2)]:
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append((k, " ".join(words)))
            k += 1
    for text in [None, "", "  \n ", "one two", "ONE  two", "one three", "É x", "é x", "a b c d e", "a b c d e f"]:
        rows.append((k, text))
        k += 1
    for _ in range(50):
        rows.append((k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))))
        k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile_members", [1000, 9])
def test_components_equal_all_pairs(spark, tile_members):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = near_dedup.near_duplicates(docs, tile_members=tile_members, broadcast_rows=5 if tile_members == 9 else 500_000)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == plain_components(rows)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "A b c d e f g"), (None, "z z z"), (None, "z z z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]
    assert sorted(str(r.text) for r in near_dedup.keep_one(docs).collect()) in (["None", t, "z z z"] for t in ("a b c d e f g", "A b c d e f g"))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 and near_dedup.keep_one(docs.limit(0)).count() == 0


def by_texts(rows):
    """Components over texts, not ids: (id, text) -> smallest id of the component of the text."""
    texts = sorted({t for _, t in rows if plain_sets(t)})
    number = {t: k for k, t in enumerate(texts)}
    part = {t: plain_components(list(enumerate(texts)))[k][1] for t, k in number.items()} if texts else {}
    least = {}
    for k, t in rows:
        if t in part and k is not None:
            least[part[t]] = min(k, least.get(part[t], k))
    return part, {(k, t): least.get(part[t]) if t in part else k for k, t in rows}


@pytest.mark.parametrize("tile_members", [1000, 7])
def test_repeated_ids_with_different_texts(spark, tile_members):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), t) for _, t in families()]
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows += [(1003, a), (1007, a + " x"), (1007, b), (1009, b + " y")] + rows[:20] + [(2000, "q r s")] * 30
    rng.shuffle(rows)
    part, want = by_texts(rows)
    assert [want[r] for r in [(1003, a), (1007, a + " x"), (1007, b), (1009, b + " y")]] == [1003, 1003, 1007, 1007]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = near_dedup.near_duplicates(docs, tile_members=tile_members).collect()
    have = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in got), key=str)
    assert have == sorted(((k, want[k, t], len(plain_sets(t)), k == want[k, t] or want[k, t] is None) for k, t in rows), key=str)

    kept = near_dedup.keep_one(docs, tile_members=tile_members, broadcast_rows=0 if tile_members == 7 else 500_000)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(kept) <= set(rows)
    assert sorted(part[t] for _, t in kept if t in part) == sorted(set(part.values()))  # one row of each component, none lost
    assert all(k == want[k, t] for k, t in kept if t in part)
    assert sum(t not in part for _, t in kept) == sum(t not in part for _, t in rows)


def test_second_round_finds_what_tiles_part(spark):
    """One bucket of several families: members that the bucket's first member does not link meet all tiles."""
    rng = random.Random(12)
    rows, k = [], 0
    for family in range(6):
        base = [f"f{family}w{j}" for j in range(60)]
        for _ in range(25):
            rows.append((k, " ".join([*base[:58], *(rng.choice("xyz") for _ in range(2))])))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # One coordinate a band: everything meets everything, as in a bucket of unlike texts.
    got = near_dedup.near_duplicates(docs, bands=200, rows=1, tile_members=10)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == plain_components(rows)


def test_link_reports_what_is_apart_from_the_head():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(3)]
    like = [sets[0], sets[1], np.append(sets[0][:-1], np.uint64(1 << 61)), sets[2], np.append(sets[1][:-1], np.uint64(1 << 61))]
    batch = pa.record_batch(
        [pa.array([7] * 5), pa.array([10, 11, 12, 13, 14]), pa.array([12] * 5), pa.array([np.sort(s).tobytes() for s in like], pa.binary())],
        names=["group", "node", "head", "shingles"],
    )
    out = [tuple(r.values()) for b in near_dedup._link(75)(iter([batch])) for r in b.to_pylist()]
    assert {frozenset(r[:2]) for r in out if r[2] is None} == {frozenset((10, 12)), frozenset((11, 14))}
    assert {r[0] for r in out if r[2] == 7} == {11, 13, 14}


def test_hot_keys_join_like_others(spark):
    from ledgerloom.llm.skew import join_counted

    left = spark.createDataFrame([(k % 7 if k % 2 else 100, k) for k in range(400)] + [(999, -1)], "key int, v int")
    right = left.filter("key <> 999").groupBy("key").count().selectExpr("key", "count as rows", "key * 2 as w")
    for share in (1, 3, 2000):
        got = sorted((r.key, r.v, r.w) for r in join_counted(left, right, "key", 401, share).collect() if r.key != 999)
        assert got == sorted((r.key, r.v, r.key * 2) for r in left.collect() if r.key != 999)
        assert join_counted(left, right, "key", 401, share).filter("key = 999 and w is null").count() == 1


def test_exact_links_compare_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.08], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for _ in range(25)]
    linked = {(a, b) for a, b in combinations(range(25), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    forest = near_dedup.exact_links(sets, 75)
    assert set(forest) <= linked and linked

    def parts(edges):
        root = list(range(25))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    assert parts(forest) == parts(linked)


def test_circulant_signature_estimates_jaccard():
    words = [f"w{k}" for k in range(600)]
    a, b = (shingle_set(word_hashes(" ".join(w).encode())) for w in (words[:500], words[50:550]))
    hasher = CirculantMinHash(400)
    same = (hasher(a) == hasher(b)).mean()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - true) < 0.1
    assert band_keys(np.array([hasher(a), hasher(a)]), 5).std(axis=0).max() == 0


def test_components_of_long_chains_and_stars(spark, monkeypatch):
    from ledgerloom.llm import components

    counted = []
    plain = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: counted.append(label) or plain(df, label))
    chain = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1003, 1001), (2000, 2000), (None, 5)] + [(3000 + k, 3000) for k in range(1, 200)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    parts = {}
    for node, component in got.items():
        parts.setdefault(component, set()).add(node)
    assert sorted(parts.values(), key=min) == [set(range(301)), {1000, 1001, 1003}, set(range(3000, 3200))]
    assert all(c in members for c, members in parts.items())
    assert counted.count("hooks") <= 14  # 301 nodes in a row, not 300 rounds
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_the_words():
    rng = random.Random(6)
    bits = ["a", "B", "b", " ", "\t", "\n", "\x0b", "\r\n", "é", "É", "\x1c", "\x85", "zz", "0", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [" ".join(f"w{k % 977}" for k in range(60_000)), "x" * 300_000 + " y", "x" * 131_072 + " y", ("ab " * 50_000)]
    by_word, by_hash = {}, {}
    for text in texts:
        words, hashes = text.encode().lower().split(), word_hashes(text.encode()).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w
