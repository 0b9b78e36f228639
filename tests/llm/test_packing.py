import random

from ledgerloom.llm import packing


def slow_pack(lengths, sources, clusters, capacity):
    """Best-fit by falling length over a plain list of bins."""
    parts = sorted(
        (-size, item, part)
        for item, length in enumerate(lengths)
        for part, size in enumerate([capacity] * (length // capacity) + ([length % capacity] if length % capacity or not length else []))
    )
    bins, out = [], []
    for size, item, _ in parts:
        size = -size
        fits = [b for b in bins if b["rest"] >= size and not (size and (sources[item] in b["sources"] or clusters[item] in b["clusters"]))]
        if fits:
            best = min(b["rest"] for b in fits)
            out.append((item, size, best, "old"))
            chosen = [b for b in fits if b["rest"] == best]
        else:
            chosen = [{"rest": capacity, "sources": set(), "clusters": set()}]
            bins.append(chosen[0])
            out.append((item, size, capacity, "new"))
        b = chosen[0]
        b["rest"] -= size
        if size:
            b["sources"].add(sources[item]) if sources[item] is not None else None
            b["clusters"].add(clusters[item])
    return out


def cases():
    for seed in range(40):
        rng = random.Random(seed)
        n, capacity = rng.randint(0, 60), rng.choice([10, 37, 100])
        yield [rng.randint(0, 2 * capacity) for _ in range(n)], [rng.choice(["a", "b", "c", None]) for _ in range(n)], [rng.randint(0, 12) for _ in range(n)], capacity


def test_bins_hold_and_do_not_conflict():
    for lengths, sources, clusters, capacity in cases():
        packed = packing.pack_shard(lengths, sources, clusters, capacity)
        by_bin, total = {}, [0] * len(lengths)
        for item, _, size, number in packed:
            by_bin.setdefault(number, []).append((item, size))
            total[item] += size
        assert total == lengths
        for members in by_bin.values():
            real = [i for i, s in members if s]
            assert sum(s for _, s in members) <= capacity
            known = [sources[i] for i in real if sources[i] is not None]
            assert len(set(known)) == len(known) and len({clusters[i] for i in real}) == len(real)


def test_each_item_takes_the_tightest_bin():
    """Replays the packing: every choice is a bin of the least sufficient rest among the compatible ones."""
    for lengths, sources, clusters, capacity in cases():
        bins = {}
        for item, _, size, number in packing.pack_shard(lengths, sources, clusters, capacity):
            fits = {k: b["rest"] for k, b in bins.items() if b["rest"] >= size and not (size and (sources[item] in b["s"] or clusters[item] in b["c"]))}
            if number in bins:
                assert bins[number]["rest"] == min(fits.values()) and number in fits
            else:
                assert not fits
                bins[number] = {"rest": capacity, "s": set(), "c": set()}
            bins[number]["rest"] -= size
            if size:
                if sources[item] is not None:
                    bins[number]["s"].add(sources[item])
                bins[number]["c"].add(clusters[item])


def test_as_many_bins_as_a_plain_list_without_conflicts():
    for lengths, _, _, capacity in cases():
        n = len(lengths)
        packed = packing.pack_shard(lengths, [None] * n, list(range(n)), capacity)
        slow = slow_pack(lengths, [None] * n, list(range(n)), capacity)
        assert len({b for *_, b in packed}) == sum(kind == "new" for *_, kind in slow)


def test_table(spark):
    rows = [(k, "w " * (k * 37 % 250), f"s{k % 4}" if k % 9 else None) for k in range(300)] + [(1000, None, "s1"), (1001, "", "s1"), (None, "a b", "s2"), (5, "w " * 185, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as id", "2 as part", "3 as shard")
    got = packing.pack(docs, capacity=100, shard_rows=80).collect()
    assert sum(r.length for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert len({r.bin_id >> 32 for r in got}) > 1 and all(r.bin_fill <= 100 for r in got)
    fills = {}
    for r in got:
        fills[r.bin_id] = fills.get(r.bin_id, 0) + r.length
    assert all(fills[r.bin_id] == r.bin_fill for r in got)
    assert packing.pack(docs.limit(0)).count() == 0


def test_copies_without_ids_are_spread_over_shards(spark):
    rows = [(None, "a copy of one text", f"s{k % 7}") for k in range(3000)] + [(5, "Repeated row", None)] * 1500 + [(k, f"text {k} of its own", f"s{k % 90}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(16)
    got = packing.pack(docs, shard_rows=300).collect()
    assert sorted((r.doc_id or -1, r.length, r.source or "") for r in got) == sorted((k or -1, len(t.split()), s or "") for k, t, s in rows)
    shards = {}
    for r in got:
        shards[r.bin_id >> 32] = shards.get(r.bin_id >> 32, 0) + 1
    assert max(shards.values()) < 600
    texts = [(r.bin_id, r.cluster) for r in got]
    assert len(set(texts)) == len(texts)
