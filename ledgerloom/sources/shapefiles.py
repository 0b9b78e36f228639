"""Shapefiles in ZIP archives: scan and write.

Reading: Spark's ``binaryFile`` scan brings the archives, from any store that it
reads, and tasks turn each into rows, one per feature, or one with the reason why
the archive was refused.  Only the members that a layer needs are unpacked, in
memory; nothing is extracted to a disk.

Writing: one task gathers the features of a key, one archive each, and the data
source of ``binary_files`` stores them.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import projection
from ledgerloom.operators.geo import kind_of
from ledgerloom.session import ship_package
from ledgerloom.sources import binary_files

POINTS = "array<struct<x:double,y:double>>"
FEATURES = f"archive string, couche string, rang int, type string, parties array<{POINTS}>, attributs map<string,string>, srid int, motif string"
# Shape types of the format (with height or measure 10 or 20 more), and the layer's geometry name.
_KINDS = {0: None, 1: "Point", 3: "MultiLineString", 5: "MultiPolygon", 8: "MultiPoint"}
# The reasons for which an upload is refused.
EMPTY_FILE = "Fichier vide."
NOT_ZIP = "Le fichier n'est pas une archive ZIP valide."
BAD_PATH = "Chemin ZIP invalide: "
NO_LAYER = "Aucun fichier .shp trouvé dans l'archive ZIP."
UNREADABLE = "Lecture shapefile impossible: "
NO_GEOMETRY = "Le shapefile ne contient aucune géométrie."
NO_CRS = "CRS absent (.prj manquant). Impossible de reprojeter en EPSG:3857."
NO_CODE = "CRS source non EPSG ({}). Merci de fournir un .prj EPSG."
# Attribute table of the export format, as (name, type, width).
EXPORT_FIELDS = [("ID", "N", 10), ("NOM", "C", 50), ("CIBLE", "C", 100), ("DESCRIPTIO", "C", 254), ("DECISION", "C", 254), ("REFEI", "C", 254), ("CATEGORIE", "C", 7)]
# Names under which desktop software writes the projections that have a code here.
_NAMES = {
    "RGF93_Lambert_93": 2154, "RGF93 / Lambert-93": 2154, "RGF93_v1_Lambert-93": 2154, "RGR92_UTM_40S": 2975, "RGR_1992_UTM_40S": 2975, "RGR92 / UTM zone 40S": 2975,
    "RGAF09_UTM_20N": 5490, "RGAF09 / UTM zone 20N": 5490, "RGM04_UTM_38S": 4471, "RGM04 / UTM zone 38S": 4471, "WGS_1984_Web_Mercator_Auxiliary_Sphere": 3857, "WGS 84 / Pseudo-Mercator": 3857,
    "GCS_WGS_1984": 4326, "WGS 84": 4326,
}
_CODES = {2154: "RGF93 / Lambert-93", 2972: "RGFG95 / UTM zone 22N", 2975: "RGR92 / UTM zone 40S", 3857: "WGS 84 / Pseudo-Mercator", 4326: "WGS 84", 4471: "RGM04 / UTM zone 38S", 5490: "RGAF09 / UTM zone 20N"}


class Refused(ValueError):
    """An archive that can't be taken, with its reason."""


def _layer_of(archive: zipfile.ZipFile) -> str:
    """The one layer of an archive: the first at its top, else the first of all."""
    for info in archive.infolist():
        name = info.filename
        if name.startswith("/") or ".." in PurePosixPath(name).parts:
            raise Refused(BAD_PATH + name)
    layers = sorted(n for n in archive.namelist() if n.lower().endswith(".shp") and not n.endswith("/"))
    if not layers:
        raise Refused(NO_LAYER)
    return next((n for n in layers if "/" not in n), layers[0])


def _member(archive: zipfile.ZipFile, layer: str, ending: str) -> bytes | None:
    wanted = (layer[:-4] + ending).lower()
    name = next((n for n in archive.namelist() if n.lower() == wanted), None)
    return None if name is None else archive.read(name)


def srid_of(prj: bytes | None) -> int:
    """The code of a projection file: its outermost authority, or a known name."""
    if prj is None or not prj.strip():
        raise Refused(NO_CRS)
    text = prj.decode("utf-8", "replace").strip()
    own = re.search(r'(?:AUTHORITY|ID)\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]\s*\]$', text)
    if own:
        return int(own[1])
    name = text.split('"')[1] if text.count('"') >= 2 else text[:40]
    if name in _NAMES:
        return _NAMES[name]
    raise Refused(NO_CODE.format(name))


def read_shapes(data: bytes) -> Iterator[tuple[str | None, list[np.ndarray]]]:
    """(geometry name, parts as arrays of x and y) of every record of a .shp; heights and measures are dropped."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise Refused(UNREADABLE + "en-tête .shp")
    end, at = 2 * struct.unpack(">i", data[24:28])[0], 100
    if end > len(data):
        raise Refused(UNREADABLE + "fichier .shp tronqué")
    while at + 8 <= end:
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        record, at = data[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", record[:4])[0] % 10
        if kind not in _KINDS:
            raise Refused(f"{UNREADABLE}type {kind}")
        if kind == 0:
            yield None, []
        elif kind == 1:
            yield "Point", [np.frombuffer(record, "<f8", 2, 4).reshape(1, 2)]
        elif kind == 8:
            n = struct.unpack("<i", record[36:40])[0]
            yield "MultiPoint", [p.reshape(1, 2) for p in np.frombuffer(record, "<f8", 2 * n, 40).reshape(n, 2)]
        else:
            n_parts, n = struct.unpack("<ii", record[36:44])
            starts = [*np.frombuffer(record, "<i4", n_parts, 44).tolist(), n]
            points = np.frombuffer(record, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
            yield _KINDS[kind], [points[a:b] for a, b in zip(starts[:-1], starts[1:])]


def read_table(data: bytes, encoding: str) -> Iterator[dict[str, str | None]]:
    """Rows of a .dbf as texts without their padding; blank values are null, deleted rows are left out."""
    n, head, width = struct.unpack("<IHH", data[4:12])
    fields, at, place = [], 32, 1
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, place, place + data[at + 16]))
        place += data[at + 16]
        at += 32
    for k in range(n):
        row = data[head + k * width : head + (k + 1) * width]
        if len(row) < width:
            raise Refused(UNREADABLE + "fichier .dbf tronqué")
        if row[:1] != b"*":
            yield {name: row[a:b].decode(encoding, "replace").strip(" \0") or None for name, a, b in fields}


def read_archive(content: bytes | None) -> Iterator[tuple]:
    """(layer, index, geometry name, parts, attributes, code) of every feature of an archive."""
    if not content:
        raise Refused(EMPTY_FILE)
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            layer = _layer_of(archive)
            shapes = list(read_shapes(archive.read(layer)))
            if not any(kind for kind, _ in shapes):
                raise Refused(NO_GEOMETRY)
            srid = srid_of(_member(archive, layer, ".prj"))
            table = _member(archive, layer, ".dbf")
            declared = (_member(archive, layer, ".cpg") or b"latin-1").decode("ascii", "replace").strip()
            encoding = "utf-8" if declared.upper() in ("UTF-8", "UTF8", "65001") else "latin-1"
            rows = list(read_table(table, encoding)) if table else [{}] * len(shapes)
    except zipfile.BadZipFile:
        raise Refused(NOT_ZIP) from None
    except (struct.error, IndexError, ValueError, NotImplementedError, RuntimeError, EOFError, zipfile.zlib.error) as e:
        raise e if isinstance(e, Refused) else Refused(f"{UNREADABLE}{e}") from None
    if len(rows) != len(shapes):
        raise Refused(f"{UNREADABLE}{len(shapes)} géométries, {len(rows)} lignes")
    name = PurePosixPath(layer).stem
    for k, ((kind, parts), row) in enumerate(zip(shapes, rows)):
        yield name, k, kind, parts, row, srid


def features_of(archives: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """Features of every archive; a refused one gives a row with its reason in ``motif`` and nothing else."""
    ship_package(archives.sparkSession)
    kinds = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), pa.map_(pa.string(), pa.string())
    schema = pa.schema([("archive", pa.string()), ("couche", pa.string()), ("rang", pa.int32()), ("type", pa.string()), ("parties", kinds[0]), ("attributs", kinds[1]), ("srid", pa.int32()), ("motif", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                try:
                    for layer, k, kind, parts, row, srid in read_archive(content.as_py()):
                        points = [[{"x": x, "y": y} for x, y in p.tolist()] for p in parts] if kind else None
                        rows.append({"archive": name.as_py(), "couche": layer, "rang": k, "type": kind, "parties": points, "attributs": list(row.items()), "srid": srid})
                except Refused as e:
                    rows = [{"archive": name.as_py(), "motif": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(F.col(name_col).alias("archive"), F.col(content_col).alias("content")).mapInArrow(work, FEATURES)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the archives in a folder; ``archive`` is the file's name."""
    return features_of(binary_files.read(spark, folder, "*.zip"))


def _ring_area(ring: list[tuple[float, float]]) -> float:
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def _closed(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def shape_bytes(polygons: list[list[list[tuple[float, float]]]]) -> tuple[bytes, bytes]:
    """The .shp and .shx of polygons: each a list of parts of rings, outer ones clockwise, holes the other way."""
    body, index, boxes, at = io.BytesIO(), io.BytesIO(), [], 50
    for number, rings in enumerate(polygons, 1):
        turned = []
        for k, ring in enumerate(_closed(r) for r in rings):
            # The format's outer rings run clockwise; which rings are holes tells the caller's order: the first is outer.
            turned.append(ring[::-1] if (_ring_area(ring[:-1]) > 0) == (k == 0) else ring)
        points = np.array([p for r in turned for p in r], "<f8").reshape(-1, 2)
        if len(points):
            box = (*points.min(axis=0), *points.max(axis=0))
            boxes.append(box)
            starts = np.cumsum([0, *(len(r) for r in turned)])[:-1].astype("<i4")
            record = struct.pack("<i4d2i", 5, *box, len(turned), len(points)) + starts.tobytes() + points.tobytes()
        else:
            record = struct.pack("<i", 0)
        body.write(struct.pack(">2i", number, len(record) // 2) + record)
        index.write(struct.pack(">2i", at, len(record) // 2))
        at += 4 + len(record) // 2
    whole = np.array(boxes or [(0.0,) * 4])
    bounds = (*whole[:, :2].min(axis=0), *whole[:, 2:].max(axis=0))

    def head(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + size // 2) + struct.pack("<2i8d", 1000, 5, *bounds, 0, 0, 0, 0)

    return head(body.tell()) + body.getvalue(), head(index.tell()) + index.getvalue()


def fitted(text: str, width: int) -> bytes:
    """The text in UTF-8, cut to a field's width between two characters."""
    data = text.encode()
    while len(data) > width:
        text = text[: -max(1, (len(data) - width) // 4)]
        data = text.encode()
    return data


def table_bytes(rows: list[list[str | None]], fields: list[tuple[str, str, int]]) -> bytes:
    """The .dbf of rows of texts; numbers stand at the right, texts at the left."""
    width = 1 + sum(w for _, _, w in fields)
    head = struct.pack("<4BIHH20x", 3, 80, 1, 1, len(rows), 33 + 32 * len(fields), width)
    head += b"".join(struct.pack("<11sc4xBB14x", name.encode("ascii"), kind.encode(), w, 0) for name, kind, w in fields) + b"\r"
    body = b"".join(b" " + b"".join(fitted(str(x or ""), w).rjust(w) if kind == "N" else fitted(str(x or ""), w).ljust(w) for x, (_, kind, w) in zip(row, fields)) for row in rows)
    return head + body + b"\x1a"


def projection_text(srid: int) -> str:
    """The .prj of a code, with its parameters and the code itself."""
    degrees = 'PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]'
    if srid == 4326:
        return f'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],{degrees},AUTHORITY["EPSG","4326"]]'
    p, name = projection.PROJECTIONS[srid], _CODES[srid]
    if isinstance(p, projection.WebMercator):
        base, kind = f'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],{degrees}]', "Mercator_1SP"
        values = {"central_meridian": 0, "scale_factor": 1, "false_easting": 0, "false_northing": 0}
    else:
        base = f'GEOGCS["{name.split(" /")[0]}",DATUM["{name.split(" /")[0]}",SPHEROID["GRS 1980",6378137,298.257222101]],{degrees}]'
        values = {"latitude_of_origin": p.lat0, "central_meridian": p.lon0, "false_easting": p.x0, "false_northing": p.y0}
        if isinstance(p, projection.LambertConic):
            kind = "Lambert_Conformal_Conic_2SP"
            values |= {"standard_parallel_1": p.parallels[0], "standard_parallel_2": p.parallels[1]}
        else:
            kind = "Transverse_Mercator"
            values |= {"scale_factor": p.k0}
    parameters = ",".join(f'PARAMETER["{k}",{v:g}]' if v < 1e5 else f'PARAMETER["{k}",{v:.0f}]' for k, v in values.items())
    return f'PROJCS["{name}",{base},PROJECTION["{kind}"],{parameters},UNIT["metre",1],AUTHORITY["EPSG","{srid}"]]'


def archive_bytes(name: str, polygons: list, rows: list[list[str | None]], srid: int, fields: list[tuple[str, str, int]]) -> bytes:
    """A ZIP with the layer in a folder of its name; equal input gives equal bytes."""
    shp, shx = shape_bytes(polygons)
    members = {".shp": shp, ".shx": shx, ".dbf": table_bytes(rows, fields), ".prj": projection_text(srid).encode(), ".cpg": b"UTF-8"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for ending, data in members.items():
            info = zipfile.ZipInfo(f"{name}/{name}{ending}", (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, data)
    return out.getvalue()


def archives(features: DataFrame, fields: list[tuple[str, str, int]] = EXPORT_FIELDS) -> DataFrame:
    """One archive (``nom``, ``contenu``) for each ``nom`` of the features.

    ``features``: ``nom`` (the archive's base name), ``srid``, ``numero`` (order in
    the layer), ``anneaux`` (rings of one polygon, the outer one first) and
    ``attributs`` (map by field name).  An archive is one value, so its features
    meet in one task; different archives are spread.
    """
    ship_package(features.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["numero"])
        polygons = [[[(p["x"], p["y"]) for p in ring] for ring in r["anneaux"] or [] if ring] for r in rows]
        named = [dict(r["attributs"] or {}) for r in rows]
        name = rows[0]["nom"]
        content = archive_bytes(name, polygons, [[a.get(f) for f, _, _ in fields] for a in named], rows[0]["srid"], fields)
        return pa.table([pa.array([name]), pa.array([content], pa.binary())], names=["nom", "contenu"])

    kept = features.select("nom", "srid", "numero", "anneaux", "attributs")
    return kept.groupBy("nom").applyInArrow(build, "nom string, contenu binary")


def write_archives(built: DataFrame, folder: str, mode: str = "append") -> None:
    """Store archives (``archives``) in a shared folder; whole or not at all."""
    binary_files.write(built, folder, ".zip", mode)


def layer_of(features: DataFrame, footprint: Column | bool = False) -> DataFrame:
    """Per archive: layer, number of features, code, kind of unit, rings of its polygons, and its reason if it can't be taken.

    The kind follows the first geometry; other kinds beside it, or lines and
    points where a footprint is due, are refused.
    """
    first = F.min_by("type", F.when(F.col("type").isNotNull(), F.col("rang")))
    rows = features.groupBy("archive").agg(
        F.min("couche").alias("couche"), F.count(F.col("rang")).alias("nb_features"), F.max("srid").alias("srid"), first.alias("type"),
        F.countDistinct("type").alias("types"), F.max("motif").alias("motif"))
    footprint = footprint if isinstance(footprint, Column) else F.lit(footprint)
    rows = rows.withColumn("type_couche", kind_of(F.col("type"), footprint))
    surface = F.col("type").contains("Polygon")
    reason = F.coalesce("motif", F.when(F.col("types") > 1, "Types de géométrie mélangés.").when(footprint & ~surface, F.concat(F.lit("Emprise / UG surfacique attendue (Polygon/MultiPolygon), reçu "), "type", F.lit("."))))
    return rows.select("archive", "couche", "nb_features", "srid", F.when(reason.isNull(), F.col("type_couche")).alias("type_couche"), reason.alias("motif"))
