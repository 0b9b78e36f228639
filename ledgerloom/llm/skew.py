"""Joins on keys of which one may hold a third of all rows, and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, share: int = 2000) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per ``key`` and tells how many rows of ``left`` it meets.

    That number is ``right.rows``, and ``total`` is (about) the rows of
    ``left``.  Keys that meet more than one row in ``share`` are fewer than
    ``share``, so they can be broadcast, whatever the size of the tables; all
    others are shuffled, and none of them is large.  Every row of ``left``
    keeps its place in the result, with nulls where its key is not in ``right``.
    """
    limit = total // share + 1
    hot = right.filter(F.col("rows") > limit)
    frequent = left.join(F.broadcast(hot), key)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return frequent.unionByName(others.join(right.filter(F.col("rows") <= limit), key, "left"))


def row_key(key: Column, text: Column) -> Column:
    """32 bytes that rows share only if they agree in id and text (a null text counts as empty)."""
    name = key.cast("string")
    head = F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.length(name).cast("string"), F.lit(":"), name))
    return F.unhex(F.sha2(F.concat(head, F.lit(" "), F.coalesce(text, F.lit(""))), 256))
