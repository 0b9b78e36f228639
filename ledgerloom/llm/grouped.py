"""Streams of Arrow batches: groups of rows sorted by key, and larger batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Split a stream of batches, sorted by the first column, into one table per key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        changes = pc.indices_nonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))).to_pylist()
        cuts = [0, *(k + 1 for k in changes), len(keys)]
        for at, to in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(at, to - at)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def in_bulk(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Join small batches to ones of about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
