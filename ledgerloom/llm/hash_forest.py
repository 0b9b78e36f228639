"""Approximate nearest neighbours by a forest of sorted hash strings.

Every tree gives each vector a long hash string: the signs of its products with
random directions.  A query descends each tree to its longest matching prefix;
then all trees ascend together, one bit at a time, each ascent widening the
query's range in every sorted array, until the ranges hold enough distinct
candidates.  Candidates are scored exactly.

The arrays are cut into blocks of rows.  All blocks use the same directions, so
at any prefix length the ranges of the blocks together are the range of one
array of the whole table; a query stops ascending in a block when that block's
part of the candidates is in hand.  How many it wants in all grows more slowly
than the table (``wanted``), so the share of rows that it touches falls.

A row goes to one block, a query to each.  A task builds a block's forest and
then streams the queries through it, batch by batch, so it holds one block and
one batch, however many queries there are.  Blocks' best lists meet in one
ranking per query.

Vectors that are null, all zero, or hold null or non-finite components take no
part, neither as queries nor as candidates; nor do rows with a null id.  Only
vectors of the query's length are its candidates.  Equal vectors rank by id.
Repeated ids are separate candidates and separate queries, each of which leaves
out its own row only; equal ids of equal score may rank either way.  Extra
columns are ignored, whatever their names; tables that are empty or hold one row
give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise, ship_package


def wanted(rows: int, scale: float = 4.3, power: float = 0.72) -> int:
    """How many candidates a query gathers in a table of so many rows."""
    return min(rows, int(scale * rows**power) + 1)


class HashForest:
    """Sorted hash strings of one block of vectors, in several trees."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int = 17):
        self.vectors, self.bits = vectors, bits
        self._planes = np.random.default_rng(seed).normal(size=(trees, vectors.shape[1], bits))
        self._sorted, self._rows = [], []
        for planes in self._planes:
            strings = self._strings(vectors, planes)
            order = np.argsort(strings, kind="stable")
            self._rows.append(order)
            self._sorted.append(strings[order])

    def _strings(self, vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        signs = (vectors @ planes) > 0
        return signs @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per tree, prefix length and query, where the matching rows begin and end."""
        lows, highs = [], []
        rest = np.arange(self.bits, -1, -1)[:, None]
        for planes, strings in zip(self._planes, self._sorted):
            prefix = self._strings(queries, planes) >> rest << rest
            lows.append(np.searchsorted(strings, prefix, "left").astype(np.int32))
            highs.append(np.searchsorted(strings, prefix + (1 << rest), "left").astype(np.int32))
        return np.array(lows), np.array(highs)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, rows found when ``enough`` of them (or all) are in hand."""
        lows, highs = self.ranges(queries)
        gathered = (highs - lows).sum(axis=0, dtype=np.int64)
        marked = np.zeros(len(self.vectors), bool)
        for q in range(len(queries)):
            # Below this prefix length the trees' ranges together are too small.
            length = int(np.searchsorted(-gathered[:, q], -min(enough, gathered[0, q]), "right")) - 1
            while True:
                marked[:] = False
                for tree, rows in enumerate(self._rows):
                    marked[rows[lows[tree, length, q] : highs[tree, length, q]]] = True
                found = np.flatnonzero(marked)
                if length == 0 or len(found) >= enough:
                    break
                length -= 1
            yield found


class Block:
    """The rows of one block, by length of their vectors, with a forest each once a query needs it."""

    def __init__(self, trees: int, bits: int, share: float):
        self._trees, self._bits, self._share = trees, bits, share
        self._parts: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        self._built: dict[int, tuple[HashForest, np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, keys: np.ndarray, vectors: list[np.ndarray]) -> None:
        self._parts.append((ids, keys, vectors))

    def forest(self, length: int) -> tuple[HashForest, np.ndarray, np.ndarray] | None:
        if self._parts:
            ids, keys = (np.concatenate([p[k] for p in self._parts]) for k in (0, 1))
            vectors = [v for p in self._parts for v in p[2]]
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                self._built[int(size)] = HashForest(np.array([vectors[k] for k in of]), self._trees, self._bits), ids[of], keys[of]
            self._parts = []
        return self._built.get(length)

    def best(self, query_key: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """Each query's ``k`` best rows of the block: (query, ids, scores, rows gathered, rows of the block)."""
        found = self.forest(queries.shape[1])
        if found is None:
            return
        forest, ids, keys = found
        vectors, enough = forest.vectors, int(np.ceil(self._share * len(forest.vectors)))
        for at in range(0, len(queries), 256):
            for q, rows in enumerate(forest.candidates(queries[at : at + 256], enough), at):
                gathered = len(rows)
                rows = rows[keys[rows] != query_key[q]]
                near = vectors[rows] @ queries[q]
                if len(rows) > k:
                    bound = np.partition(near, len(near) - k)[len(near) - k]
                    rows = rows[near >= bound - 1e-9]  # keeps every row that rounding could tie
                exact = (vectors[rows] * queries[q]).sum(axis=1)
                order = np.lexsort((ids[rows], -exact))[:k]
                yield q, ids[rows][order], exact[order], gathered, len(vectors)


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy()
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def _search(k: int, trees: int, bits: int, share: float):
    """Task: rows (block, asks, id, key, vector), sorted by block with its queries last -> best rows by query."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    names = ["key", "query_id", "near", "score", "n_gathered", "n_block"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, None
        for batch in batches:
            blocks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids, keys, vectors = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _vectors(batch.column(4))
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks) != 0)) + 1), len(blocks)]
            for at, to in zip(cuts[:-1], cuts[1:]):
                if at == to:
                    continue
                if blocks[at] != current:
                    current, block = blocks[at], Block(trees, bits, share)
                if not asks[at]:
                    block.add(ids[at:to], keys[at:to], vectors[at:to])
                    continue
                sizes = np.array([len(v) for v in vectors[at:to]])
                for size in np.unique(sizes):
                    of = at + np.flatnonzero(sizes == size)
                    out = [[] for _ in names]
                    for q, near, scores, gathered, rows in block.best(keys[of], np.array([vectors[j] for j in of]), k):
                        n = len(near)
                        for column, value in zip(out, (np.full(n, keys[of[q]]), np.full(n, ids[of[q]]), near, scores, np.full(n, gathered), np.full(n, rows))):
                            column.append(value)
                    if out[0]:
                        yield pa.record_batch([pa.array(np.concatenate(c), kind) for c, kind in zip(out, kinds)], names=names)

    return work


def nearest(
    table: DataFrame,
    query_modulus: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 240,
    bits: int = 20,
    scale: float = 4.3,
    power: float = 0.72,
    block_rows: int = 8192,
) -> DataFrame:
    """The ``k`` nearest rows of every row whose id (an integer) is divisible by ``query_modulus``.

    A query gathers ``wanted(rows, scale, power)`` candidates before it stops
    ascending; the recall that this gives is measured in the tests.  Returns
    ``query_id``, ``rank`` (from 1), ``id_col``, ``score`` (inner product in
    double precision), and how many rows the query gathered of how many in the
    block where the neighbour was found: ``n_gathered``, ``n_block``.
    """
    ship_package(table.sparkSession)
    kind = table.schema[id_col].dataType.simpleString()
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = table.select(F.col(id_col).cast("long").alias("id"), doubles.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    usable = materialise(usable.withColumn("key", F.monotonically_increasing_id()), "vectors")  # rows are known by their numbers from here on
    rows = usable.count()
    blocks = -(-rows // block_rows) or 1
    share = wanted(rows, scale, power) / max(rows, 1)

    own = usable.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "id", "key", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    query = usable.filter(F.col("id") % query_modulus == 0).select(every.alias("block"), F.lit(True).alias("asks"), "id", "key", "v")
    met = own.union(query).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = met.mapInArrow(_search(k, trees, bits, share), "key long, query_id long, near long, score double, n_gathered int, n_block int")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "near")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(F.col("query_id").cast(kind), "rank", F.col("near").cast(kind).alias(id_col), "score", "n_gathered", "n_block")
    )
