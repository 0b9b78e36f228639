"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

Signatures come from two permutations, the second shifted circularly.  Texts
that share all coordinates of a band are candidates.  Members of a band's
bucket then meet with their full shingle sets, and every pair of them that is
not linked already is compared exactly; of the links found, a task returns a
spanning forest, which is all that components need.  So a bucket of m texts
gives fewer than m rows, whatever its pairs.

Within a task, all members are compared with the first one; only those that it
doesn't link meet all others, as one matrix product.  A bucket too large for a
task is cut into tiles, each with the bucket's first member; members that
nothing in their tile ties to it meet every other tile in a second round.  So a
bucket of near copies costs time in proportion to its size, and no pair is lost.

The nodes are classes of equal word sequences, not ids: copies never multiply
the work, and an id that occurs with several texts has one node for each, so
each of its rows has the component of its own text.

Null or empty texts (or texts without words) have no shingles, are linked with
nothing and are kept.  Repeated rows are each reported, with equal values.  A
row with a null id has the component of its text, if some text in that has an
id (and is then not kept), else a null component (and is kept).  Texts are read
whole, however long.  Extra columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.grouped import groups_of
from ledgerloom.llm.shingles import CirculantMinHash, band_keys, shingle_set, word_hashes
from ledgerloom.llm.skew import join_counted, row_key
from ledgerloom.session import discard, materialise, ship_package

_hashers: dict[int, CirculantMinHash] = {}


def _hasher(coordinates: int) -> CirculantMinHash:
    if coordinates not in _hashers:
        _hashers[coordinates] = CirculantMinHash(coordinates)
    return _hashers[coordinates]


def _sign(width: int, bands: int, rows: int):
    """Task: (id, row, text) -> (id, row, digest of the words, number of shingles, band keys)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(bands * rows)
        for batch in batches:
            digests, sizes, signatures = [], [], []
            for text in batch.column(2):
                words = word_hashes((text.as_py() or "").encode())
                shingles = shingle_set(words, width)
                sizes.append(len(shingles))
                digests.append(hashlib.sha256(words.tobytes()).digest() if len(words) else None)
                signatures.append(hasher(shingles))
            keys = band_keys(np.array(signatures).reshape(len(sizes), bands * rows), rows)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.ravel())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists],
                names=["id", "row", "digest", "n", "keys"],
            )

    return work


def _sets(width: int):
    """Task: (node, text) -> (node, shingle hashes as bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(word_hashes((t.as_py() or "").encode()), width).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return work


def exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union.

    All meet the first; what it does not link meets all.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)

    def near(shared: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return 100 * shared >= percent * (one + two - shared)

    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    at = np.searchsorted(sets[0], flat)
    with_first = np.bincount(owner[(at < sizes[0]) & (sets[0][np.minimum(at, sizes[0] - 1)] == flat)], minlength=n)
    linked = near(with_first, sizes, sizes[0])
    linked[0] = True
    forest = [(0, int(x)) for x in np.flatnonzero(linked)[1:]]
    apart = np.flatnonzero(~linked)
    if not len(apart):
        return forest

    shared, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # shingles of one member only meet nothing
    kept = times[where] > 1
    owner, column = owner[kept], column[where[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64
    together = np.zeros((len(apart), n), kind)
    columns = int(column[-1]) + 1 if len(column) else 0
    step = max(1, min(columns, max(64, 4_000_000 // n)))
    for low in range(0, columns, step):
        at, to = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, step), kind)
        part[owner[at:to], column[at:to] - low] = 1
        together += part[apart] @ part.T
    a, b = np.nonzero(near(together.astype(np.int64), sizes[apart][:, None], sizes[None, :]))
    a = apart[a]
    root = [0 if k else x for x, k in enumerate(linked.tolist())]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            forest.append((x, y))
    return forest


def _link(percent: int):
    """Task: rows (group, node, head, shingles), sorted by group -> links, and what is apart.

    A link is (a, b, null).  In a group that has a head, a node that the
    group's links do not tie to it is reported as (node, null, group).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            out.clear()
            return pa.record_batch(columns, names=["a", "b", "group"])

        for group in groups_of(batches):
            number, nodes, head = group.column(0)[0].as_py(), group.column(1).to_pylist(), group.column(2)[0].as_py()
            first = nodes.index(head) if head is not None else 0
            nodes[0], nodes[first] = nodes[first], nodes[0]
            sets = [np.frombuffer(s, np.uint64) for s in group.column(3).to_pylist()]
            sets[0], sets[first] = sets[first], sets[0]
            links = exact_links(sets, percent) if len(nodes) > 1 else []
            out += [(nodes[x], nodes[y], None) for x, y in links]
            if head is not None:
                tied = [x == 0 for x in range(len(nodes))]
                more = True
                while more:  # a forest of few levels: star links come first
                    more = False
                    for x, y in links:
                        if tied[x] != tied[y]:
                            tied[x] = tied[y] = more = True
                out += [(x, None, number) for x, t in zip(nodes, tied) if not t]
            if len(out) > 10_000:
                yield flush()
        if out:
            yield flush()

    return work


def classify(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    percent: int = 75,
    width: int = 5,
    bands: int = 40,
    rows: int = 5,
    tile_members: int = 1000,
    tile_shingles: int = 1_500_000,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """The component of every row under links of at least ``percent`` / 100 Jaccard.

    With 40 bands of 5 coordinates, a pair at exactly 0.75 escapes all bands
    with probability 2e-5, one at 0.8 with 1e-7.  ``tile_members`` and
    ``tile_shingles`` bound what meets in one task; ``broadcast_rows`` is the
    largest number of candidates (40 bytes each, so 20 MB) that is broadcast to
    filter the second read of the texts; beyond it, a shuffled join does that.

    Returns (id, row, n, component, keeps): ``row`` is the key of the id and
    text, ``keeps`` is true for the rows whose key stands for the component,
    and for texts without words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("row"), text.alias("t"))

    signed = texts.mapInArrow(_sign(width, bands, rows), f"id {kind}, row binary, digest binary, n long, keys array<long>")
    signed = materialise(signed, "signed")
    # Nulls come last, so a class without a null id never has its text stand under one.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    classes = (
        signed.filter("digest is not null").groupBy("digest")
        .agg(F.count("*").alias("rows"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), least)
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = materialise(classes, "classes")  # the numbers hold from here on

    members = classes.select("node", "n", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).filter("size > 1")
    tiles = F.ceil(F.greatest(F.col("size") / tile_members, F.col("weight") / tile_shingles))
    buckets = materialise(members.join(sizes, "key").select("key", "node", tiles.alias("tiles")), "buckets")
    small = (
        buckets.filter("tiles <= 1").groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
        .filter(F.size("nodes") > 1).select("nodes").distinct()
        .select(F.xxhash64("nodes").alias("group"), F.explode("nodes").alias("node"), F.lit(None).cast("long").alias("head"))
    )
    large = buckets.filter("tiles > 1").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles") * 2))
    heads = large.groupBy("key").agg(F.min("node").alias("head"))
    tiled = large.join(heads, "key").select(F.xxhash64("key", "tile").alias("group"), "key", "node", "head")
    with_heads = tiled.select("group", "node", "head").union(tiled.select("group", F.col("head").alias("node"), "head")).distinct()
    groups = materialise(small.union(with_heads), "groups")

    wanted = groups.select("node").distinct().join(classes.select("node", "least.row"), "node")
    wanted = materialise(wanted, "wanted")
    few = wanted.count() <= broadcast_rows
    sets = texts.select("row", "t").join(F.broadcast(wanted) if few else wanted, "row").select("node", "t")
    sets = sets.mapInArrow(_sets(width), "node long, shingles binary").dropDuplicates(["node"])
    if not few or not large.isEmpty():
        sets = materialise(sets, "sets")

    def compare(groups: DataFrame, label: str) -> DataFrame:
        met = groups.join(sets, "node").select("group", "node", "head", "shingles").repartition("group").sortWithinPartitions("group", "node")
        return materialise(met.mapInArrow(_link(percent), "a long, b long, group long").distinct(), label)

    found = compare(groups, "near-links")
    links = found.filter("b is not null").select("a", "b")
    apart = found.filter("b is null").select(F.col("a").alias("node"), "group").join(tiled.select("group", "node", "key"), ["group", "node"]).select("key", "node")
    if not large.isEmpty() and not apart.isEmpty():
        apart = materialise(apart, "apart")
        parts = apart.groupBy("key").agg(F.ceil(F.count("*") / tile_members).alias("parts"))
        own = (
            apart.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
            .join(large.groupBy("key").agg((F.max("tiles") * 2).alias("tiles")), "key").withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1)")))
        )
        others = large.join(parts, "key").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        second = own.select("key", "part", "tile", "node").union(others.select("key", "part", "tile", "node")).distinct()
        second = second.select(F.xxhash64("key", "part", "tile").alias("group"), "node", F.lit(None).cast("long").alias("head"))
        links = links.union(compare(second, "near-links-2").select("a", "b"))

    joined = connected_components(links)
    labelled = classes.select("digest", "node", "rows", "least").join(joined, "node", "left")
    several = labelled.filter("component is not null")
    best = materialise(several.groupBy("component").agg(F.min("least").alias("best"), F.count("*").alias("rows")), "best")
    several = join_counted(several.select("component", "digest", F.col("rows").alias("times")), best, "component", classes.count())
    told = several.select("digest", F.col("times").alias("rows"), "best").union(labelled.filter("component is null").select("digest", "rows", "least"))
    told = materialise(told, "components")
    for table in (buckets, groups, wanted):
        discard(table)

    worded = join_counted(signed.filter("digest is not null").select("id", "row", "n", "digest"), told, "digest", signed.count())
    worded = worded.select("id", "row", "n", F.col("best.id").alias("component"), (F.col("row") == F.col("best.row")).alias("keeps"))
    return worded.union(signed.filter("digest is null").select("id", "row", "n", F.col("id").alias("component"), F.lit(True)))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **settings) -> DataFrame:
    """The component of every document: ``id_col``, ``n_shingles``, ``component_id`` and ``kept``.

    ``settings`` go to ``classify``.
    """
    found = classify(docs, text_col, id_col, **settings)
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", broadcast_rows: int = 500_000, **settings) -> DataFrame:
    """The documents, with all of their columns, but one row only of each component.

    It is the row of the smallest id (null ids come last); of that id's texts
    in the component, the one of the smallest key; and any one of rows that
    agree in id and text.  Texts without words all stay.  Up to
    ``broadcast_rows`` keys of dropped rows (32 bytes each, so 16 MB) are
    broadcast; more go by a shuffled join.
    """
    found = materialise(classify(docs, text_col, id_col, broadcast_rows=broadcast_rows, **settings).select("row", "n", "keeps"), "keeps")
    key = "row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"

    def bounded(keys: DataFrame) -> DataFrame:
        keys = materialise(keys.withColumnRenamed("row", key), "row-keys")
        return F.broadcast(keys) if keys.count() <= broadcast_rows else keys

    rows = docs.select("*", row_key(F.col(id_col), F.col(text_col).cast("string")).alias(key))
    kept = rows.join(bounded(found.filter("not keeps").select("row").distinct()), key, "left_anti")
    repeated = found.filter("keeps and n > 0").groupBy("row").count().filter("count > 1").select("row")
    if not repeated.isEmpty():
        repeated = bounded(repeated)
        once = kept.join(repeated, key, "left_anti").drop(key)
        again = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.any_value(F.struct(*[f"`{c}`" for c in docs.columns])).alias("whole"))
        return once.union(again.select("whole.*"))
    return kept.drop(key)
