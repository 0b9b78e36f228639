import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import file_plans
from ledgerloom.sources import binary_files, readers, shapefiles, workbooks

SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
FIELDS = [("ID", "N", 10), ("NOM", "C", 6)]


def archive(rows=(("1", "été long"),), srid=2154, drop=(), rename=lambda n: n, change=lambda n, d: d):
    content = shapefiles.archive_bytes("zone", [SQUARE for _ in rows], [list(r) for r in rows], srid, FIELDS)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            if not n.endswith(tuple(drop) or ("\0",)):
                new.writestr(rename(n), change(n, old.read(n)))
    return out.getvalue()


def refused(content):
    with pytest.raises(shapefiles.Refused) as e:
        list(shapefiles.read_archive(content))
    return str(e.value)


def test_an_archive_comes_back_as_it_was_written():
    rows = list(shapefiles.read_archive(archive([("1", "été long"), ("22", None), ("3", "abc")])))
    assert [r[0] for r in rows] == ["zone"] * 3 and [r[1] for r in rows] == [0, 1, 2] and {r[5] for r in rows} == {2154}
    assert [r[4] for r in rows] == [{"ID": "1", "NOM": "été"}, {"ID": "22", "NOM": None}, {"ID": "3", "NOM": "abc"}]  # six bytes: é is two of them
    kind, parts = rows[0][2], rows[0][3]
    assert kind == "MultiPolygon" and [len(p) for p in parts] == [5, 5]
    areas = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:])) / 2 for p in (x.tolist() for x in parts)]
    assert areas == [-16.0, 1.0]  # outer ring clockwise, hole the other way


def test_headers_follow_the_format():
    with zipfile.ZipFile(io.BytesIO(shapefiles.archive_bytes("a", [SQUARE, []], [["1", "x"], ["2", "y"]], 2154, FIELDS))) as z:
        shp, shx, dbf = (z.read(f"a/a.{e}") for e in ("shp", "shx", "dbf"))
        assert z.read("a/a.cpg") == b"UTF-8" and b"Lambert" in z.read("a/a.prj")
    assert struct.unpack(">i", shp[:4])[0] == 9994 and 2 * struct.unpack(">i", shp[24:28])[0] == len(shp)
    assert struct.unpack("<2i4d", shp[28:68]) == (1000, 5, 0.0, 0.0, 4.0, 4.0)
    offset, length = struct.unpack(">2i", shx[100:108])
    assert struct.unpack(">2i", shp[2 * offset : 2 * offset + 8]) == (1, length)
    assert len(shx) == 116 and struct.unpack("<i", shp[-4:])[0] == 0  # the second shape is empty
    assert struct.unpack("<IHH", dbf[4:12]) == (2, 33 + 32 * 2, 17) and len(dbf) == 33 + 64 + 2 * 17 + 1


def test_bad_archives_have_a_reason():
    assert refused(b"") == refused(None) == shapefiles.EMPTY_FILE
    assert refused(b"not a zip at all") == refused(archive()[:300]) == shapefiles.NOT_ZIP
    assert refused(archive(rename=lambda n: "../" + n)).startswith(shapefiles.BAD_PATH) and refused(archive(rename=lambda n: "/" + n)).startswith(shapefiles.BAD_PATH)
    assert refused(archive(drop=[".shp"])) == shapefiles.NO_LAYER
    assert refused(archive(drop=[".prj"])) == shapefiles.NO_CRS
    assert "Local" in refused(archive(change=lambda n, d: b'LOCAL_CS["Local grid",UNIT["m",1]]' if n.endswith(".prj") else d))
    for cut in (lambda d: d[:-20], lambda d: d[:50], lambda d: b"\0" * 200):
        assert refused(archive(change=lambda n, d: cut(d) if n.endswith(".shp") else d)).startswith(shapefiles.UNREADABLE)
    assert refused(archive(change=lambda n, d: d[:-12] if n.endswith(".dbf") else d)).startswith(shapefiles.UNREADABLE)
    assert refused(archive(change=lambda n, d: shapefiles.shape_bytes([[]])[0] if n.endswith(".shp") else d)) == shapefiles.NO_GEOMETRY


def test_codes_of_projection_files():
    for code in (2154, 2975, 3857, 4326, 4471, 5490):
        assert shapefiles.srid_of(shapefiles.projection_text(code).encode()) == code
    assert shapefiles.srid_of(b'PROJCS["RGF93_Lambert_93",GEOGCS["GCS_RGF_1993",DATUM["D"]],UNIT["Meter",1.0]]') == 2154
    # An authority of a part is not the file's own.
    with pytest.raises(shapefiles.Refused):
        shapefiles.srid_of(b'PROJCS["Own",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],UNIT["m",1]]')


def test_other_shapes_and_heights():
    def shp(kind, *records):
        body = b"".join(struct.pack(">2i", k, len(r) // 2) + r for k, r in enumerate(records, 1))
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body

    point = list(shapefiles.read_shapes(shp(11, struct.pack("<i4d", 11, 1, 2, 9, 0), struct.pack("<i", 0))))
    assert point[0][0] == "Point" and point[0][1][0].tolist() == [[1, 2]] and point[1] == (None, [])
    line = struct.pack("<i4d2i2i", 3, 0, 0, 3, 3, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 3)
    assert [(k, [p.tolist() for p in ps]) for k, ps in shapefiles.read_shapes(shp(3, line))] == [("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]])]
    many = struct.pack("<i4di4d", 8, 0, 0, 1, 1, 2, 0, 0, 1, 1)
    assert [(k, len(ps)) for k, ps in shapefiles.read_shapes(shp(8, many))] == [("MultiPoint", 2)]


def test_scan_keeps_bad_files_as_reasons(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(archive([("1", "a"), ("2", "b")]))
    (tmp_path / "bad.zip").write_bytes(b"x")
    (tmp_path / "no thing.zip").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = shapefiles.scan(spark, str(tmp_path))
    assert sorted((r.archive, r.rang, r.motif) for r in rows.filter("motif is null").collect()) == [("good.zip", 0, None), ("good.zip", 1, None)]
    layers = {r.archive: r for r in shapefiles.layer_of(rows).collect()}
    assert (layers["good.zip"].type_couche, layers["good.zip"].nb_features, layers["bad.zip"].motif, layers["bad.zip"].type_couche) == ("surf", 2, shapefiles.NOT_ZIP, None)
    assert layers["no thing.zip"].motif == shapefiles.EMPTY_FILE and len(layers) == 3


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{k}", bytes([k]) * k) for k in range(20)], "nom string, contenu binary").repartition(4)
    binary_files.write(rows, folder, ".bin")
    assert {n: os.path.getsize(os.path.join(folder, n)) for n in os.listdir(folder)} == {f"f{k}.bin": k for k in range(20)}

    failing = rows.withColumn("nom", F.when(F.col("nom") == "f7", F.raise_error(F.lit("lost"))).otherwise(F.concat(F.lit("g"), "nom")))
    with pytest.raises(Exception):
        binary_files.write(failing, folder, ".bin")
    assert len(os.listdir(folder)) == 20  # nothing new, nothing left over

    for bad in ("../x", "a/b", ""):
        with pytest.raises(Exception):
            binary_files.write(spark.createDataFrame([(bad, b"1")], "nom string, contenu binary"), folder, ".bin")
    with pytest.raises(Exception):
        binary_files.write(spark.createDataFrame([("same", b"1"), ("same", b"2")], "nom string, contenu binary"), folder, ".bin")
    binary_files.write(rows.filter("nom < 'f12'"), folder, ".bin", "overwrite")
    assert sorted(os.listdir(folder)) == ["f0.bin", "f1.bin", "f10.bin", "f11.bin"]


def book(**parts):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships"
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Un &amp; deux" sheetId="1" r:id="rId9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rel}"><Relationship Id="rId9" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>rich </t></r><r><rPr/><t>text</t></r><rPh><t>no</t></rPh></si><si><t>a|b\nc</t></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="#,##0.00\\ &quot;€&quot;"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs>'
        f'<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="9"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData>{parts["rows"]}</sheetData>{parts.get("after", "")}</worksheet>')
    return out.getvalue()


def cells(content):
    b = workbooks.Workbook(content)
    return {(c["row"], c["col"]): c for name, part in b.sheets for c in b.cells(part)}


def test_kinds_of_cells():
    got = cells(book(rows='<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></row>'
                     '<row r="3"><c r="A3"><v>7997.499999999</v></c><c r="B3" s="1"><v>12.5</v></c><c r="C3" s="2"><v>0.2</v></c><c r="D3" s="3"><v>45000.5</v></c><c r="E3" t="b"><v>1</v></c>'
                     '<c r="F3" t="e"><v>#DIV/0!</v></c><c r="G3" t="str"><f>A1</f><v>x</v></c><c r="AB3"><v>3</v></c><c r="H3"/></row><row><c><v>1</v></c><c><v>2</v></c></row>'))
    assert {k: c["value"] for k, c in got.items()} == {
        (1, 1): "plain", (1, 2): "rich text", (1, 3): "a¦b / c", (1, 4): "in", (3, 1): "7997.5", (3, 2): "12.5 €", (3, 3): "20 %", (3, 4): "2023-03-15 12:00:00", (3, 5): "VRAI",
        (3, 6): "#DIV/0!", (3, 7): "x", (3, 28): "3", (4, 1): "1", (4, 2): "2"}
    assert [got[3, c]["is_text"] for c in (1, 2, 3, 4, 5)] == [False, False, False, True, True]
    assert workbooks.Workbook(book(rows="")).sheets == [("Un & deux", "xl/worksheets/a.xml")]


def test_merged_ranges_and_sums():
    got = cells(book(rows='<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="4"><c r="A4"><f>SUM(A1:A3)</f><v>1</v></c><c r="B4"><f>SUM(A4:B4)</f><v>1</v></c>'
                     '<c r="C4"><f t="shared" ref="C4:D4" si="0">SUM(C$1:C3)</f><v>2</v></c><c r="D4"><f t="shared" si="0"/><v>2</v></c></row>', after='<mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="C1:C2"/></mergeCells>'))
    assert {k: (c["merge_id"], c["merge_rank"]) for k, c in got.items() if c["merge_id"] is not None} == {(1, 1): (0, 0), (1, 2): (0, 1), (2, 1): (0, 2), (2, 2): (0, 3), (1, 3): (1, 0), (2, 3): (1, 1)}
    assert {k: c["is_sum"] for k, c in got.items() if k[0] == 4} == {(4, 1): True, (4, 2): False, (4, 3): True, (4, 4): True}
    assert not workbooks.adds_a_column("SUM(A1:B9)") and workbooks.adds_a_column("=1+SOMME($B$2:$B$9)*2") and not workbooks.adds_a_column("SUM(A2:A2)")


def test_workbooks_become_lines_and_bad_files_a_reason(spark, tmp_path):
    rows = [{"row": 1, "col": 1, "value": "T", "is_text": True, "merge_id": 1, "is_sum": False}, {"row": 1, "col": 2, "value": None, "is_text": True, "merge_id": 1, "is_sum": False},
            {"row": 2, "col": 2, "value": "4", "is_text": False, "merge_id": None, "is_sum": False}, {"row": 3, "col": 2, "value": "9", "is_text": False, "merge_id": None, "is_sum": True}]
    (tmp_path / "a.xlsx").write_bytes(file_plans.workbook_bytes({"S<1>": rows, "S2": rows[2:3]}))
    (tmp_path / "b.xlsx").write_bytes(b"PK broken")
    (tmp_path / "c.xlsx").write_bytes(archive())
    got = workbooks.scan(spark, str(tmp_path))
    assert {r.fichier: r.motif.split(":")[0] for r in got.filter("motif is not null").collect()} == {"b.xlsx": "Classeur illisible"}
    lines = readers.flatten_sheet(got.filter("motif is null").withColumnRenamed("feuille", "sheet")).collect()
    assert sorted((r.sheet, r.row, r.ligne) for r in lines) == [("S2", 2, "4"), ("S<1>", 1, "T | T"), ("S<1>", 2, " | 4"), ("S<1>", 3, " | 9 [TOTAL?]")]


def test_a_sheet_is_parsed_once_and_reads_alike_held_or_streamed(monkeypatch):
    from xml.etree import ElementTree

    from ledgerloom.plans.file_plans import workbook_bytes
    from ledgerloom.sources import workbooks

    cells = [{"row": r, "col": c, "value": v, "is_text": t, "merge_id": m, "is_sum": s} for r, c, v, t, m, s in [(1, 1, "T", True, 1, False), (1, 2, None, True, 1, False), (2, 1, "5", False, None, False), (3, 1, "5", False, None, True), (3, 2, "é&", False, None, False)]]
    content = workbook_bytes({f"s{k}": cells for k in range(5)})
    parses = []
    monkeypatch.setattr(workbooks.ElementTree, "iterparse", lambda *a, real=ElementTree.iterparse: parses.append(1) or real(*a))

    def read():
        book = workbooks.Workbook(content)
        return [(name, list(book.cells(part))) for name, part in book.sheets]

    held = read()
    assert not parses and len(held) == 5 and len(held[0][1]) == 5
    monkeypatch.setattr(workbooks, "_HELD", 0)
    assert read() == held and parses
