"""Planar overlay: repair and union of polygons by horizontal bands.

The edges of all polygons are rows.  Each key's height is cut into bands by its
number of edges, an edge goes to every band that it crosses, and a task sweeps
one band at a time: edges are split where they cross, and between two
neighbouring levels the pieces stand side by side without crossing.  From left to
right a polygon is entered and left by the parity of its own edges (so a ring
that crosses itself or runs twice around is repaired), and the union is where at
least one polygon is entered.  What comes out are trapezoids.

All else are aggregates and windows over the trapezoids: the area is their sum,
the upright parts of the outline are their sides, and the level parts are where
the trapezoids above and below a level differ.  Only the last step, which strings
the outline into rings, has the whole outline of a key in hand, as the geometry
that it returns is one value of one row.

Coordinates are rounded to ``grid`` first, and crossings too; the result does
not depend on the order of polygons, rings or points, on the bands, or on points
that lie on a straight edge.  Null, empty and collapsed rings enclose nothing.
Two polygons that touch in a point stay two parts.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.geo import ring_area
from ledgerloom.session import ship_package

_TRAPEZOIDS = "key string, y0 double, y1 double, l0 double, l1 double, r0 double, r1 double, left_edge long, right_edge long"


def edges(polygons: DataFrame, key_col: str, rings_col: str, grid: float) -> DataFrame:
    """Edges (key, part, edge, x1, y1, x2, y2) upwards, on whole multiples of ``grid``; level ones are left out.

    ``part`` numbers the polygons, so a polygon's rings must be in one row.
    """
    whole = F.transform(F.coalesce(F.col("rings"), F.array()), lambda ring: F.transform(
        F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), lambda p: F.struct(F.round(p["x"] / grid).alias("x"), F.round(p["y"] / grid).alias("y"))))
    rows = polygons.select(F.col(key_col).cast("string").alias("key"), F.col(rings_col).alias("rings")).withColumn("part", F.monotonically_increasing_id())
    ring = rows.select("key", "part", F.posexplode(whole).alias("ring", "p"))
    following = F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1))
    pairs = ring.select("key", "part", F.explode(F.arrays_zip(F.col("p").alias("a"), following.alias("b"))).alias("s")).filter("s.a.y <> s.b.y")
    low = F.when(F.col("s.a.y") < F.col("s.b.y"), F.col("s.a")).otherwise(F.col("s.b"))
    high = F.when(F.col("s.a.y") < F.col("s.b.y"), F.col("s.b")).otherwise(F.col("s.a"))
    return pairs.select("key", "part", low.alias("lo"), high.alias("hi")).select("key", "part", F.col("lo.x").alias("x1"), F.col("lo.y").alias("y1"), F.col("hi.x").alias("x2"), F.col("hi.y").alias("y2"))


def _meetings(group: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where edges of a group meet: edge, level and the rounded x of the meeting point, once per edge and level, sorted."""
    left, right = np.minimum(x1, x2), np.maximum(x1, x2)
    dx, dy = x2 - x1, y2 - y1
    seen: list[tuple[np.ndarray, ...]] = []
    for apart in range(1, int(np.bincount(group).max())):
        i = np.flatnonzero(group[apart:] == group[:-apart])
        j = i + apart
        near = (y1[j] <= y2[i]) & (y2[j] >= y1[i]) & (left[j] <= right[i]) & (right[j] >= left[i])
        i, j = i[near], j[near]
        cross = dx[i] * dy[j] - dy[i] * dx[j]
        i, j, cross = i[cross != 0], j[cross != 0], cross[cross != 0]
        t = ((x1[j] - x1[i]) * dy[j] - (y1[j] - y1[i]) * dx[j]) / cross
        u = ((x1[j] - x1[i]) * dy[i] - (y1[j] - y1[i]) * dx[i]) / cross
        inside = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        i, j, t = i[inside], j[inside], t[inside]
        y, x = np.rint(y1[i] + t * dy[i]) + 0.0, np.rint(x1[i] + t * dx[i]) + 0.0
        for edge in (i, j):
            own = (y != y1[edge]) & (y != y2[edge])  # an end keeps its own place
            seen.append((edge[own], y[own], x[own], i[own], j[own]))
    edge, y, x, i, j = (np.concatenate(c) for c in zip(*seen)) if seen else (np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    order = np.lexsort((j, i, y, edge))
    edge, y, x = edge[order], y[order], x[order]
    last = np.append((edge[1:] != edge[:-1]) | (y[1:] != y[:-1]), True)[: len(edge)]  # of several pairs that meet there the last one counts
    return edge[last], y[last], x[last]


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, and to which range each belongs."""
    owner = np.repeat(np.arange(len(first)), count)
    return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count), owner


def _joined(level: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places, sorted by level and x, with those that lie one unit or less behind the one before drawn to it."""
    starts = np.flatnonzero(np.append(True, (level[1:] != level[:-1]) | (x[1:] - x[:-1] > 1)))
    sizes = np.diff(np.append(starts, len(x)))
    out = np.repeat(x[starts], sizes)
    for k in np.flatnonzero(x[starts + sizes - 1] - x[starts] > 1).tolist():  # a longer run falls into several places
        for at in range(starts[k] + 1, starts[k] + sizes[k]):
            out[at] = out[at - 1] if x[at] - out[at - 1] <= 1 else x[at]
    return out


def _before_and_at(group: np.ndarray) -> np.ndarray:
    """How many rows of its group stand before each row, itself included; groups need not be adjacent."""
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    rank = np.empty(len(group), int)
    rank[order] = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) + 1
    return rank


def sweep(group: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, edge: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Trapezoids (y0, y1, l0, l1, r0, r1, left edge, right edge) of the unions inside many bands at once, and each one's band.

    ``group`` numbers the bands from 0, and rows are sorted by it; ``low`` and
    ``high`` are the band's, on every row.
    """
    met_edge, met_y, met_x = _meetings(group, x1, y1, x2, y2)
    # All levels of all bands, sorted; every edge reaches from one number to another.
    inner = (met_y > low[met_edge]) & (met_y < high[met_edge])
    in_group = np.concatenate([group, group, group, group, group[met_edge[inner]]])
    at_level = np.concatenate([low, high, np.maximum(y1, low), np.minimum(y2, high), met_y[inner]])
    order = np.lexsort((at_level, in_group))
    sorted_group, sorted_level = in_group[order], at_level[order]
    fresh = np.append(True, (sorted_group[1:] != sorted_group[:-1]) | (sorted_level[1:] != sorted_level[:-1]))
    number = np.empty(len(order), int)
    number[order] = np.cumsum(fresh) - 1
    levels, level_group = sorted_level[fresh], sorted_group[fresh]
    n = len(group)
    first, last = number[2 * n : 3 * n], number[3 * n : 4 * n]
    # Each edge's x at the levels that it reaches, equal for edges that meet there.
    level, owner = _ranges(first, last - first + 1)
    at = (levels[level] - y1[owner]) / (y2[owner] - y1[owner])
    x = x1[owner] + at * (x2[owner] - x1[owner])
    whole = levels[level] % 1 == 0  # a border of bands cuts edges, but nothing meets there
    offset = np.cumsum(last - first + 1) - (last - first + 1) - first  # of an edge's place at a level
    x[whole] = np.rint(x[whole])
    x[offset[met_edge[inner]] + number[4 * n :]] = met_x[inner]
    order = np.flatnonzero(whole)
    order = order[np.lexsort((x[order], level[order]))] if len(order) else order
    if len(order):
        x[order] = _joined(level[order], x[order])
    # Between two levels the pieces stand side by side.
    piece, k = _ranges(first, last - first)
    bottom, top = levels[piece], levels[piece + 1]
    middle = x1[k] + ((bottom + top) / 2 - y1[k]) / (y2[k] - y1[k]) * (x2[k] - x1[k])
    order = np.lexsort((k, part[k], middle, piece))
    piece, k = piece[order], k[order]
    # A polygon's first edge enters it, its second leaves it; the depth is the number of polygons entered.
    pair = np.unique(np.stack([piece, part[k]]), axis=1, return_inverse=True)[1].reshape(-1)
    turn = np.where(_before_and_at(pair) % 2 == 1, 1, -1)
    total = np.cumsum(turn)
    begins = np.append(True, piece[1:] != piece[:-1])
    depth = total - np.repeat((total - turn)[begins], np.diff(np.append(np.flatnonzero(begins), len(piece))))
    event = np.flatnonzero(((depth == 1) & (turn == 1)) | (depth == 0))
    opens = np.flatnonzero((depth[event[:-1]] == 1) & (depth[event[1:]] == 0) & (piece[event[:-1]] == piece[event[1:]]))
    start, end, piece = k[event[opens]], k[event[opens + 1]], piece[event[opens]]
    l0, l1, r0, r1 = x[offset[start] + piece], x[offset[start] + piece + 1], x[offset[end] + piece], x[offset[end] + piece + 1]
    broad = (l0 != r0) | (l1 != r1)
    start, end, piece, l0, l1, r0, r1 = (c[broad] for c in (start, end, piece, l0, l1, r0, r1))
    # What ends where the next one starts is joined with it.
    cut = (piece[1:] != piece[:-1]) | (r0[:-1] != l0[1:]) | (r1[:-1] != l1[1:])
    head, tail = np.append(True, cut)[: len(piece)], np.append(cut, True)[: len(piece)]
    piece = piece[head]
    return level_group[piece], [levels[piece], levels[piece + 1], l0[head], l1[head], r0[tail], r1[tail], edge[start[head]], edge[end[tail]]]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``names``, with the first row of each group; a batch's last group waits for the next."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        changes = np.zeros(table.num_rows, bool)
        changes[:1] = True
        for name in names:
            column = table.column(name)
            changes[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
        return np.flatnonzero(changes)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[0].column(n)[0] == batch.column(n)[batch.num_rows - 1] for n in names):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = starts(table)
        yield table.slice(0, at[-1]), at[:-1]
        held = table.slice(at[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.zeros(1, int)


def _in_groups(rows: DataFrame, names: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work`` on many whole groups at a time: one call per group would cost far more than these small groups' work."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(batches, names):
            if table.num_rows:
                yield from work(table, starts).to_batches()

    return rows.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(stream, schema)


def _in_bands(table: pa.Table, starts: np.ndarray) -> pa.Table:
    column = {name: table.column(name).to_numpy() for name in table.column_names if name != "key"}
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    found, columns = sweep(group, *(column[c] for c in ("low", "high", "part", "edge", "x1", "y1", "x2", "y2")))
    # Of two numbers (bottom, top), (l0, l1), (r0, r1) the first is at the bottom.
    names = ["y0", "y1", "l0", "l1", "r0", "r1", "left_edge", "right_edge"]
    return pa.table([table.column("key").take(pa.array(starts[found])), *map(pa.array, columns)], names=["key", *names])


def trapezoids(polygons: DataFrame, key_col: str = "key", rings_col: str = "rings", grid: float = 1e-4, edges_per_band: int = 256) -> DataFrame:
    """Trapezoids, in units of ``grid``, of the union of each key's polygons; they don't overlap."""
    ship_package(polygons.sparkSession)
    rows = edges(polygons, key_col, rings_col, grid)
    spans = rows.groupBy("key").agg(F.min("y1").alias("bottom"), F.max("y2").alias("top"), F.ceil(F.count("*") / edges_per_band).cast("int").alias("bands"))
    spans = spans.withColumn("step", F.ceil((F.col("top") - F.col("bottom") + 1) / F.col("bands")))
    # A band ends half a unit off the levels of all points.
    placed = rows.join(spans.hint("merge"), "key").withColumn("edge", F.xxhash64("part", "x1", "y1", "x2", "y2"))
    first, last = (F.floor((F.col(y) - F.col("bottom")) / F.col("step")).cast("int") for y in ("y1", "y2"))
    placed = placed.withColumn("band", F.explode(F.sequence(first, last)))
    low = F.col("bottom") + F.col("band") * F.col("step") - 0.5
    placed = placed.select("key", "band", low.alias("low"), (low + F.col("step")).alias("high"), "part", "edge", "x1", "y1", "x2", "y2")
    # The order of a band's edges is the same for every cut of the input.
    return _in_groups(placed, ["key", "band"], ["x1", "y1", "x2", "y2", "part"], _in_bands, _TRAPEZOIDS)


def outline(found: DataFrame) -> DataFrame:
    """The outline of a union as segments (key, x1, y1, x2, y2, edge) with the inside on their left; level ones have edge -1."""
    left = found.select("key", F.col("l1").alias("x1"), F.col("y1").alias("y1"), F.col("l0").alias("x2"), F.col("y0").alias("y2"), F.col("left_edge").alias("edge"))
    right = found.select("key", F.col("r0").alias("x1"), F.col("y0").alias("y1"), F.col("r1").alias("x2"), F.col("y1").alias("y2"), F.col("right_edge").alias("edge"))
    ends = F.array(
        F.struct(F.col("y0").alias("y"), F.col("l0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("y0").alias("y"), F.col("r0").alias("x"), F.lit(-1).alias("d")),
        F.struct(F.col("y1").alias("y"), F.col("l1").alias("x"), F.lit(-1).alias("d")), F.struct(F.col("y1").alias("y"), F.col("r1").alias("x"), F.lit(1).alias("d")))
    turns = found.select("key", F.explode(ends).alias("e")).groupBy("key", "e.y", "e.x").agg(F.sum("e.d").alias("d"))
    # Along a level, how many more trapezoids stand above than below, from each end to the next.
    along = Window.partitionBy("key", "y").orderBy("x")
    level = turns.withColumns({"over": F.sum("d").over(along), "next": F.lead("x").over(along)}).filter("over <> 0")
    level = level.withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("over").cast("int"))))
    east = level.select(
        "key", F.when(F.col("over") > 0, F.col("x")).otherwise(F.col("next")).alias("x1"), F.col("y").alias("y1"),
        F.when(F.col("over") > 0, F.col("next")).otherwise(F.col("x")).alias("x2"), F.col("y").alias("y2"), F.lit(-1).cast("long").alias("edge"))
    return left.unionByName(right).unionByName(east)


def _simplified(ring: list[tuple[float, float, int]]) -> list[tuple[float, float]]:
    """Points of a ring of (x, y, edge that starts there), without those on a straight line."""
    kept = [p for p, before in zip(ring, [ring[-1], *ring[:-1]]) if p[2] != before[2] or p[2] == -1]
    points = [(x, y) for x, y, _ in kept] or [(x, y) for x, y, _ in ring]
    changed = True
    while changed and len(points) > 3:
        changed, out = False, []
        for k, (x, y) in enumerate(points):
            (ax, ay), (bx, by) = out[-1] if out else points[-1], points[(k + 1) % len(points)]
            long = math.hypot(bx - ax, by - ay)
            ahead = (x - ax) * (bx - x) + (y - ay) * (by - y) >= 0
            if long and ahead and abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1.5 * long:
                changed = True
            else:
                out.append((x, y))
        points = out
    return points


def rings_of(segments: list[tuple[float, float, float, float, int]]) -> list[list[tuple[float, float]]]:
    """Closed rings from segments with the inside on their left; at a point where rings touch, the sharpest left turn is taken."""
    leaving: dict[tuple[float, float], list[int]] = defaultdict(list)
    for k, s in enumerate(segments):
        leaving[s[0], s[1]].append(k)
    rings, used = [], [False] * len(segments)
    for first in range(len(segments)):
        if used[first]:
            continue
        ring, at = [], first
        while not used[at]:
            used[at] = True
            x1, y1, x2, y2, edge = segments[at]
            ring.append((x1, y1, edge))
            back = math.atan2(y1 - y2, x1 - x2)
            onward = [k for k in leaving[x2, y2] if not used[k]]
            if not onward:
                break
            # Clockwise from where it came, and never straight back if there is another way.
            at = min(onward, key=lambda k: (back - math.atan2(segments[k][3] - y2, segments[k][2] - x2) - 1e-12) % (2 * math.pi))
        points = _simplified(ring)
        if len(points) >= 3:
            least = points.index(min(points))
            rings.append(points[least:] + points[:least])
    return rings


def _signed(ring: list[tuple[float, float]]) -> float:
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            inside = not inside
    return inside


def parts_of(segments: list[tuple[float, float, float, float, int]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons, each an outer ring and its holes, in a fixed order."""
    rings = [(r, _signed(r)) for r in rings_of(segments)]
    parts = sorted([r] for r, area in rings if area > 0)
    for hole in sorted(r for r, area in rings if area < 0):
        # A point just inside the hole's first corner; the smallest outer ring around it owns the hole.
        x, y = ((a + b + c) / 3 for a, b, c in zip(hole[0], hole[1], hole[-1]))
        around = [p for p in parts if _holds(p[0], x, y)]
        if around:
            min(around, key=lambda p: _signed(p[0])).append(hole)
    return parts


def _strung(grid: float, digits: int):
    def text(ring: list[tuple[float, float]]) -> str:
        return "(" + ", ".join(f"{x * grid:.{digits}f} {y * grid:.{digits}f}" for x, y in [*ring, ring[0]]) + ")"

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        segments = list(zip(*(table.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2", "edge"))))
        rows = []
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(segments)]):
            parts = parts_of(sorted(segments[at:to]))
            wkt = "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(text, p)) + ")" for p in parts) + ")" if parts else "MULTIPOLYGON EMPTY"
            exact = repr([[[(int(x), int(y)) for x, y in ring] for ring in p] for p in parts]) if parts else "empty"
            rows.append((wkt, len(parts), sum(len(p) - 1 for p in parts), hashlib.md5(exact.encode()).hexdigest()))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.table([table.column("key").take(pa.array(starts)), *(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))], names=["key", "wkt", "nb_parties", "nb_trous", "empreinte"])

    return work


def surfaces(polygons: DataFrame, key_col: str = "key", rings_col: str = "rings", grid: float = 1e-4, edges_per_band: int = 256) -> DataFrame:
    """Area of the union of each key's polygons (``surface``, in square units of the coordinates); 0 for a key without any."""
    area = F.sum(((F.col("r0") - F.col("l0")) + (F.col("r1") - F.col("l1"))) / 2 * (F.col("y1") - F.col("y0"))) * (grid * grid)
    found = trapezoids(polygons, key_col, rings_col, grid, edges_per_band).groupBy("key").agg(area.alias("surface"))
    keys = polygons.select(F.col(key_col).cast("string").alias("key")).distinct()
    return keys.join(found.hint("merge"), "key", "left").select("key", F.coalesce("surface", F.lit(0.0)).alias("surface"))


def unions(polygons: DataFrame, key_col: str = "key", rings_col: str = "rings", grid: float = 1e-4, digits: int = 4, edges_per_band: int = 256) -> DataFrame:
    """The union of each key's polygons as one valid multi-polygon: ``key``, ``wkt``, ``nb_parties``, ``nb_trous``, ``empreinte``.

    ``empreinte`` is a digest of the normalised rings; that of no geometry is the
    digest of the word empty.
    """
    found = _in_groups(
        outline(trapezoids(polygons, key_col, rings_col, grid, edges_per_band)), ["key"], [], _strung(grid, digits), "key string, wkt string, nb_parties int, nb_trous int, empreinte string")
    keys = polygons.select(F.col(key_col).cast("string").alias("key")).distinct()
    return keys.join(found.hint("merge"), "key", "left").select(
        "key", F.coalesce("wkt", F.lit("MULTIPOLYGON EMPTY")).alias("wkt"), F.coalesce("nb_parties", F.lit(0)).alias("nb_parties"), F.coalesce("nb_trous", F.lit(0)).alias("nb_trous"),
        F.coalesce("empreinte", F.md5(F.lit("empty"))).alias("empreinte"))


def was_valid(rings: Column, surface: Column, tolerance: float = 1e-3) -> Column:
    """Whether a polygon enclosed, as it came, just what its repaired form does: outer ring less holes, by their shoelace areas."""
    areas = F.transform(rings, ring_area)
    signed = F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0)) - F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas), F.lit(1))), F.lit(0.0), lambda total, a: total + a)
    return (signed > 0) & (F.abs(signed - surface) <= tolerance)
