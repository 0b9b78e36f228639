"""Embedding whitening by upper-triangle column aggregates.

Components become integers, so counts and sums are exact.  For every pair of
dimensions i <= j a Spark SQL expression sums the products of the centred
columns, all pairs in one aggregation; partial sums of fixed size are all that
is shuffled.  The driver sets the sums into a symmetric matrix (its size is that
of one vector squared, whatever the table's), and LAPACK decomposes it.  Rows are
then projected on the components by column expressions and divided by the square
roots of the eigenvalues.

The fit counts each distinct vector once, so copies, however many, do not pull
the mean; every row is returned.  Rows whose vector is null or holds null or
non-finite components take no part.  Rows with a null id are returned with it;
repeated rows give repeated results.  Vectors of different length are whitened
by length, each kind on its own; empty vectors have no components.  A component
without variance (fewer distinct vectors than dimensions, constant columns) has
a null ``whitened`` and is left out of ``identity_error``; ``explained`` is null
if nothing varies.  Extra columns are ignored, whatever their names; an empty
table gives an empty result.  Integers are of 64 bits: with a squared deviation
that may not fit, the sums are decimals, and ``deviation`` is null where it
does not fit (``deviation_exact`` tells it).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise


class Fit(NamedTuple):
    """Counts and components of one kind of vectors."""

    n: int
    sums: list[int]
    largest: int  # bound of |n*x - S| over all dimensions
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # components in columns
    trace: float

    @property
    def rank(self) -> int:
        """How many components have a variance beyond rounding."""
        return int((self.values > max(self.values[0], 0.0) * len(self.values) * np.finfo(float).eps * 8).sum())


def integer_vectors(table: DataFrame, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``table`` with ``x``: floor(scale * component) + shift as long, for usable vectors only."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.withColumn("v", F.transform(F.col(vector_col), lambda c: c.cast("double"))).filter(F.col("v").isNotNull() & finite)
    return rows.withColumn("x", F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift)).drop("v")


def pair_sums(rows: DataFrame, vector: Column, size: int, most_pairs: int = 4000) -> np.ndarray:
    """Sums of the products of every pair of dimensions, as a symmetric matrix: one aggregation of its upper triangle.

    Beyond ``most_pairs`` pairs (89 dimensions) a plan of them all would be too
    wide to compile, so the triangle is summed in parts, each by a pass of its own.
    """
    above = [(i, j) for i in range(size) for j in range(i, size)]
    columns = rows.select(vector.alias("d")).select(*(F.col("d")[k].alias(f"d{k}") for k in range(size)))
    found = np.zeros((size, size))
    for at in range(0, len(above), most_pairs):
        part = above[at : at + most_pairs]
        for (i, j), value in zip(part, columns.selectExpr(*(f"sum(d{i} * d{j}) AS s_{i}_{j}" for i, j in part)).first()):
            found[i, j] = found[j, i] = value
    return found


def centred(n: int, sums: list[int]) -> Column:
    """The vector x - S/n: exact integers, then one division each."""
    return F.zip_with("x", F.lit(sums), lambda x, s: (x * F.lit(n) - s).cast("double") / float(n))


def fit(distinct: DataFrame, size: int) -> Fit:
    """Counts, sums and components of distinct vectors ``x`` of one length."""
    facts = distinct.agg(F.count("*"), *(F.expr(f"{of}(x[{k}])") for of in ("sum", "min", "max") for k in range(size))).first()
    n, sums, low, high = facts[0], list(facts[1 : size + 1]), facts[size + 1 : 2 * size + 1], facts[2 * size + 1 :]
    largest = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums))
    covariance = pair_sums(distinct, centred(n, sums), size) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    return Fit(n, sums, largest, values[order], vectors[:, order], float(np.trace(covariance)))


def projected(vector: Column, found: Fit, components: int) -> Column:
    """Whitened coordinates of a centred vector, as an array; null for components without variance."""
    weights = (found.vectors[:, : min(components, found.rank)] / np.sqrt(found.values[: min(components, found.rank)])).T

    def dot(w: Column) -> Column:
        return F.aggregate(F.zip_with(vector, w, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)

    known = F.transform(F.array(*(F.lit(row.tolist()) for row in weights)), dot) if len(weights) else F.array().cast("array<double>")
    return F.concat(known, F.array_repeat(F.lit(None).cast("double"), components - len(weights)))


def whiten(table: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component: ``id_col``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``deviation_exact``.

    ``n`` counts distinct vectors; ``deviation`` is the sum over dimensions of
    (n*x - S)^2; ``identity_error`` is the largest entry by which the covariance
    of the whitened distinct vectors, measured on them, differs from the identity.
    """
    rows = integer_vectors(table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector", scale, shift).select("id", "x")
    distinct = materialise(rows.select("x").distinct(), "vectors-distinct")
    parts = []
    for size in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect() if r[0]):
        of_size = distinct.filter(F.size("x") == size)
        found = fit(of_size, size)
        width = min(components, size)
        varying = min(width, found.rank)
        error = None
        if varying:
            white = of_size.select(centred(found.n, found.sums).alias("c"))
            error = float(np.abs(pair_sums(white, projected(F.col("c"), found, varying), varying) / found.n - np.eye(varying)).max())
        explained = [float(v / found.trace) if found.trace > 0 else None for v in found.values[:width]]
        each = F.arrays_zip(F.lit(list(range(1, width + 1))).alias("component"), F.col("w").alias("whitened"), F.lit(explained).cast("array<double>").alias("explained"))
        per_row = rows.filter(F.size("x") == size).select("id", _deviation(found, size).alias("deviation_exact"), centred(found.n, found.sums).alias("c"))
        per_row = per_row.select("id", "deviation_exact", projected(F.col("c"), found, width).alias("w")).select("id", "deviation_exact", F.explode(each).alias("c"))
        parts.append(per_row.select(
            "id", "c.component", F.lit(found.n).cast("long").alias("n"), F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"), "c.whitened", "c.explained",
            F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
        ))
    if not parts:
        columns = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        parts = [table.sparkSession.createDataFrame([], f"id {table.schema[id_col].dataType.simpleString()}, {columns}")]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def _deviation(found: Fit, size: int) -> Column:
    """Sum of (n*x - S)^2, in longs where every row's must fit, and in decimals otherwise."""
    kind = "long" if size * found.largest**2 < 2**63 else "decimal(38,0)"
    away = F.zip_with("x", F.lit(found.sums), lambda x, s: (x * F.lit(found.n) - s).cast("long" if kind == "long" else "decimal(19,0)"))
    total = F.aggregate(away, F.lit(0).cast(kind), lambda t, d: (t + d * d).cast(kind))
    return total.cast("decimal(38,0)")
