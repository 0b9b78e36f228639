"""Best-fit packing of documents into bins, under conflicts.

A bin takes documents up to its capacity in words, but no two documents of one
source and no two copies of one text.  Documents go in by falling length, each
into the tightest bin that holds it and doesn't conflict: bins are ordered by
what is left in them, and the search starts at the least sufficient rest and
goes on to the next larger one until a compatible bin is found, else a bin is
opened.  A bin carries two bitmaps, of its sources and of its duplicate
clusters; bins of equal rest and equal bitmaps are searched as one.

Rows are dealt to shards of bounded size by a hash, and a shard is packed by
one task, so shards pack side by side at any scale; a cluster or a source that
holds a third of all rows is spread over all of them.  Rows that agree in id and
text, such as copies without ids, are dealt one by one where they are many;
which of them goes where follows the partitions of the input.

A text longer than a bin becomes several parts, all full but the last.  Null
and empty texts have length 0 and fit anywhere without conflict.  A null source
conflicts with nothing.  Repeated rows are each packed.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import ship_package


class Bins:
    """Open bins, ordered by rest and grouped by their bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = 0
        self._by_rest: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self._rests = 0  # bit r is set if some bin has r left

    def place(self, length: int, source: int, cluster: int) -> int:
        """Put an item into the tightest compatible bin; returns the bin's number."""
        waiting = self._rests >> length
        rest = length
        while waiting:
            skip = (waiting & -waiting).bit_length() - 1
            rest, waiting = rest + skip, waiting >> skip
            groups = self._by_rest[rest]
            for key, bins in groups.items():
                if not (key[0] & source or key[1] & cluster):
                    chosen = bins.pop(0)
                    if not bins:
                        del groups[key]
                        if not groups:
                            self._rests &= ~(1 << rest)
                    self._add(rest - length, (key[0] | source, key[1] | cluster), chosen)
                    return chosen
            rest, waiting = rest + 1, waiting >> 1
        self.count += 1
        self._add(self.capacity - length, (source, cluster), self.count - 1)
        return self.count - 1

    def _add(self, rest: int, key: tuple[int, int], chosen: int) -> None:
        self._by_rest[rest].setdefault(key, []).append(chosen)
        self._rests |= 1 << rest


def pack_shard(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit by falling length: (item, part, length, bin), ties by the items' order."""
    parts = []
    for item, length in enumerate(lengths):
        full, last = divmod(length, capacity)
        sizes = [capacity] * full + ([last] if last or not full else [])
        parts += [(-size, item, part) for part, size in enumerate(sizes)]
    parts.sort()
    source_bit: dict = {}
    times: dict = {}
    for c in clusters:
        times[c] = times.get(c, 0) + 1
    cluster_bit: dict = {}
    bins, out = Bins(capacity), []
    for size, item, part in parts:
        source = cluster = 0
        if size:
            if sources[item] is not None:
                source = 1 << source_bit.setdefault(sources[item], len(source_bit))
            if times[clusters[item]] > 1:  # a cluster with one member here cannot conflict
                cluster = 1 << cluster_bit.setdefault(clusters[item], len(cluster_bit))
        out.append((item, part, -size, bins.place(-size, source, cluster)))
    return out


def pack(
    docs: DataFrame, capacity: int = 1024, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", shard_rows: int = 20_000
) -> DataFrame:
    """Pack all documents: one row per part of a document.

    Returns ``id_col``, ``part``, ``length``, ``source_col``, ``cluster`` (hash
    of the trimmed lower-case text), ``bin_id`` and ``bin_fill`` (words in the
    bin).  ``shard_rows`` is the mean number of rows that one task packs.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("length"), F.xxhash64(F.lower(F.trim(text))).alias("cluster"),
    )
    deal = F.xxhash64("id", "cluster", F.lit(5))
    if shards > 1:
        # Of pairs with so many rows there are at most 10 a shard, so they can be broadcast.
        many = rows.groupBy("id", "cluster").count().filter(F.col("count") > max(1, shard_rows // 10))
        many = F.broadcast(many.select(F.col("id").alias("many_id"), F.col("cluster").alias("many_cluster")))
        rows = rows.join(many, F.col("id").eqNullSafe(F.col("many_id")) & (F.col("cluster") == F.col("many_cluster")), "left")
        deal = F.when(F.col("many_cluster").isNotNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(deal)
    rows = rows.select("id", "source", "length", "cluster", F.pmod(deal, F.lit(shards)).alias("shard"))

    def work(key: tuple, shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("id", "ascending"), ("cluster", "ascending")])
        columns = [shard.column(n).to_pylist() for n in ("length", "source", "cluster")]
        packed = pack_shard(*columns, capacity)
        item, part, length, bins = (np.array(c, np.int64) for c in zip(*packed))
        fill = np.bincount(bins, length).astype(np.int64)
        taken = shard.take(pa.array(item))
        return pa.table({
            "id": taken.column("id"), "part": pa.array(part, pa.int32()), "length": pa.array(length), "source": taken.column("source"),
            "cluster": taken.column("cluster"), "bin_id": pa.array((np.int64(key[0].as_py()) << 32) + bins), "bin_fill": pa.array(fill[bins]),
        })

    schema = f"id {kind}, part int, length long, source string, cluster long, bin_id long, bin_fill long"
    return rows.groupBy("shard").applyInArrow(work, schema).withColumnsRenamed({"id": id_col, "source": source_col})
