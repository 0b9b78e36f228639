"""Queries on binary files, written from the driver's tables and read back, with their oracles."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.geo import ring_area
from ledgerloom.plans.geometry_plans import box
from ledgerloom.plans.ingest_plans import SHEETS_SQL, sheet_cells
from ledgerloom.plans.oracles import SQL_VIEWS
from ledgerloom.plans.report_plans import simple
from ledgerloom.session import shared_folder, ship_package
from ledgerloom.sources import binary_files, readers, shapefiles, workbooks
from ledgerloom.sources.domain import Domain


def _folder(d: Domain, label: str) -> str:
    return f"{shared_folder(d.spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"


# One archive per nation and eighth of the customers, one parcel per customer; texts longer than their field are cut.
_NAME = "concat('n', c_nationkey, '_', c_custkey % 8)"
_TEXT = {"NOM": "repeat(concat(c_name, ' é '), CAST(c_custkey % 4 AS INT))", "CATEGORIE": "concat('MR', c_custkey)", "DECISION": "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END"}
_SRID = "CASE WHEN c_nationkey % 2 = 0 THEN 2154 ELSE 2975 END"
SQL_VIEWS["v_parcelles"] = f"""SELECT {_NAME} AS nom, CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey % 8 ORDER BY c_custkey) - 1 AS INTEGER) AS rang, {_SRID} AS srid, c_custkey AS k,
    rtrim({_TEXT['NOM'].replace('CAST(c_custkey % 4 AS INT)', 'CAST(c_custkey % 4 AS INTEGER)')}) AS libelle, {_TEXT['CATEGORIE']} AS categorie, {_TEXT['DECISION']} AS decision FROM customer"""


def _parcels(d: Domain) -> DataFrame:
    fields = ", ".join(f"'{k}', {v}" for k, v in {"ID": "CAST(c_custkey AS STRING)", **_TEXT}.items())
    rings = f"array({box('c_custkey', '100', 'c_custkey % 9 + 2', 'c_custkey % 7 + 2')}, {box('c_custkey + 0.5', '100.5', '1', '1')})"
    return d.raw("customer").selectExpr(f"{_NAME} AS nom", f"{_SRID} AS srid", "c_custkey AS numero", f"{rings} AS anneaux", f"map({fields}) AS attributs")


def _written(d: Domain) -> DataFrame:
    folder = _folder(d, "archives")
    shapefiles.write_archives(shapefiles.archives(_parcels(d)), folder)
    return shapefiles.scan(d.spark, folder)


def _read_back(d: Domain) -> DataFrame:
    value = lambda name: F.try_element_at("attributs", F.lit(name))
    areas = F.transform("parties", ring_area)
    return _written(d).select(
        F.regexp_replace("archive", r"\.zip$", "").alias("nom"), "rang", "srid", value("ID").cast("long").alias("k"), F.length(value("NOM")).alias("n"), F.octet_length(value("NOM")).alias("octets"),
        value("CATEGORIE").alias("categorie"), value("DECISION").alias("decision"), F.size("parties").alias("anneaux"), (areas[0] - areas[1]).alias("surface"), value("CIBLE").alias("cible"))


# The longest run of whole characters that fits in a field of 50 bytes.
_FIT = "list_max([i FOR i IN range(0, CAST(length(libelle) AS INTEGER) + 1) IF strlen(substr(libelle, 1, i)) <= 50])"
simple("k31_archives", f"""SELECT nom, rang, srid, k, CASE WHEN libelle <> '' THEN CAST(length(rtrim(substr(libelle, 1, {_FIT}))) AS INTEGER) END AS n, CASE WHEN libelle <> '' THEN CAST(strlen(rtrim(substr(libelle, 1, {_FIT}))) AS INTEGER) END AS octets,
    substr(categorie, 1, 7) AS categorie, decision, CAST(2 AS INTEGER) AS anneaux, CAST((k % 9 + 2) * (k % 7 + 2) - 1 AS DOUBLE) AS surface, CAST(NULL AS VARCHAR) AS cible FROM v_parcelles""", _read_back)


def _spoil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives damaged in one way each, by the number in front of their name."""
    for batch in batches:
        out = []
        for name, content in zip(batch.column("nom").to_pylist(), batch.column("contenu").to_pylist()):
            how = int(name.split("_")[1])
            if how == 1:
                content = b""
            elif how == 2:
                content = content[: len(content) // 2]
            elif how > 2:
                with zipfile.ZipFile(io.BytesIO(content)) as old:
                    members = {n: old.read(n) for n in old.namelist()}
                spoiled = io.BytesIO()
                with zipfile.ZipFile(spoiled, "w") as new:
                    for n, data in members.items():
                        if how == 3 and n.endswith(".prj") or how == 4 and n.endswith(".shp"):
                            continue
                        data = data[:-9] if how == 6 and n.endswith(".shp") else data
                        new.writestr("../" + n if how == 5 else n, data)
                content = spoiled.getvalue()
            out.append(content)
        yield pa.record_batch([batch.column("nom"), pa.array(out, pa.binary())], names=["nom", "contenu"])


def _layers(d: Domain) -> DataFrame:
    ship_package(d.spark)
    built = shapefiles.archives(_parcels(d)).mapInArrow(_spoil, "nom string, contenu binary")
    folder = _folder(d, "depots")
    shapefiles.write_archives(built, folder)
    rows = shapefiles.layer_of(shapefiles.scan(d.spark, folder), F.col("archive").startswith("n1"))
    return rows.withColumn("archive", F.regexp_replace("archive", r"\.zip$", ""))


simple("s07_couches", f"""SELECT nom AS archive, CASE WHEN motif IS NULL THEN nom END AS couche, CASE WHEN motif IS NULL THEN nb ELSE 0 END AS nb_features, CASE WHEN motif IS NULL THEN srid END AS srid,
    CASE WHEN motif IS NULL AND nom LIKE 'n1%' THEN 'emprise' WHEN motif IS NULL THEN 'surf' END AS type_couche, motif FROM (
    SELECT nom, count(*) AS nb, min(srid) AS srid, CASE CAST(split_part(nom, '_', 2) AS INTEGER) WHEN 1 THEN '{shapefiles.EMPTY_FILE}' WHEN 2 THEN '{shapefiles.NOT_ZIP.replace("'", "''")}' WHEN 3 THEN '{shapefiles.NO_CRS}'
        WHEN 4 THEN '{shapefiles.NO_LAYER.replace("'", "''")}' WHEN 5 THEN '{shapefiles.BAD_PATH}../' || nom || '/' || nom || '.shp' WHEN 6 THEN '{shapefiles.UNREADABLE}fichier .shp tronqué' END AS motif FROM v_parcelles GROUP BY nom)""", _layers)


def workbook_bytes(sheets: dict[str, list[dict]]) -> bytes:
    """A workbook of sheets of cells (row, col, value, is_text, merge_id, is_sum): shared and inline texts, numbers, sums, merged ranges."""
    def place(row: int, col: int) -> str:
        return f"{chr(64 + col)}{row}"

    shared: dict[str, int] = {}
    parts = {}
    for number, cells in enumerate(sheets.values(), 1):
        lines: dict[int, list[str]] = {}
        ranges: dict[int, list[tuple[int, int]]] = {}
        for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
            at, value = place(c["row"], c["col"]), c["value"]
            if c["merge_id"] is not None:
                ranges.setdefault(c["merge_id"], []).append((c["row"], c["col"]))
            if value is None:
                continue
            if c["is_sum"]:
                text = f'<c r="{at}"><f>SUM({place(1, c["col"])}:{place(c["row"] - 1, c["col"])})</f><v>{value}</v></c>'
            elif value.isdigit():
                text = f'<c r="{at}"><v>{value}</v></c>'
            elif c["is_text"]:
                text = f'<c r="{at}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
            else:
                text = f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
            lines.setdefault(c["row"], []).append(text)
        body = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in sorted(lines.items()))
        merged = "".join(f'<mergeCell ref="{place(*min(p))}:{place(*max(p))}"/>' for p in ranges.values())
        parts[f"xl/worksheets/sheet{number}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData><mergeCells>{merged}</mergeCells></worksheet>'
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = (
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">' f"<sheets>{names}</sheets></workbook>")
    links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    parts["xl/sharedStrings.xml"] = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def _bound(table: pa.Table) -> pa.Table:
    sheets: dict[str, list[dict]] = {}
    for row in table.to_pylist():
        sheets.setdefault(row["sheet"], []).append(row)
    return pa.table([pa.array([table.column("nom")[0].as_py()]), pa.array([workbook_bytes(dict(sorted(sheets.items())))], pa.binary())], names=["nom", "contenu"])


def _workbook_lines(d: Domain) -> DataFrame:
    """The sheets of ``t28_feuilles``, a hundred orders a workbook, through files."""
    ship_package(d.spark)
    cells = sheet_cells(d).withColumn("nom", F.concat(F.lit("c"), F.floor(F.substring("sheet", 2, 20).cast("long") / 400)))
    folder = _folder(d, "classeurs")
    binary_files.write(cells.groupBy("nom").applyInArrow(_bound, "nom string, contenu binary"), folder, ".xlsx")
    return readers.flatten_sheet(workbooks.scan(d.spark, folder).withColumnRenamed("feuille", "sheet"))


simple("s09_classeurs", SHEETS_SQL, _workbook_lines)
