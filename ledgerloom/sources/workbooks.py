"""Workbook files as tables of cells.

Spark's ``binaryFile`` scan brings the files; a task reads the zipped XML parts
of each as streams: names of the sheets, shared texts, number formats, and every
sheet twice, once for its merged ranges and once for its cells.  Values and
formulas are both in the sheet, so a value is the one that the workbook was saved
with, and a formula only tells whether a cell adds up a column.

The cells are what ``readers.flatten_sheet`` takes.  A file that is no workbook
gives one row with the reason in ``motif``.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import ship_package
from ledgerloom.sources import binary_files

CELLS = "fichier string, feuille string, ordre int, row int, col int, value string, is_text boolean, merge_id int, merge_rank int, is_sum boolean, motif string"
_ARROW = pa.schema([
    ("fichier", pa.string()), ("feuille", pa.string()), ("ordre", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("is_text", pa.bool_()),
    ("merge_id", pa.int32()), ("merge_rank", pa.int32()), ("is_sum", pa.bool_()), ("motif", pa.string()),
])
# What in a number format says money or a share, built-in formats that hold it, and those of dates.
MONEY = ("€", "$", "£", '"EUR"', "#,##0.00 ", "_-* #")
_BUILT_IN = {**{k: "$" for k in (5, 6, 7, 8, 42, 44)}, 9: "0%", 10: "0.00%", **{k: "yyyy-mm-dd" for k in (*range(14, 23), 45, 46, 47)}}
_COLUMN_SUM = re.compile(r"(?:SUM|SUBTOTAL|SOMME)\s*\(\s*\$?([A-Z]{1,3})\$?(\d+)\s*:\s*\$?([A-Z]{1,3})\$?(\d+)", re.IGNORECASE)
_REFERENCE = re.compile(r"\$?([A-Z]{1,3})\$?(\d+)")
_ROW_BATCH = 20_000
#: Parts of at most so many bytes are held as a tree while their sheet is read, larger ones are streamed.
_HELD = 1 << 20


def adds_a_column(formula: str) -> bool:
    """Whether a formula sums a range of one column over several rows."""
    return any(m[1].upper() == m[3].upper() and int(m[4]) > int(m[2]) for m in _COLUMN_SUM.finditer(formula))


def number_text(value: float) -> str:
    """Two decimals at most, and none if they say nothing."""
    short = round(value, 2)
    return str(int(short)) if short == int(short) else f"{short:g}"


def place_of(reference: str) -> tuple[int, int]:
    """Row and column of a reference such as ``B12``."""
    letters, digits = _REFERENCE.fullmatch(reference).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(digits), col


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element: ElementTree.Element) -> str:
    """All text of an item, its runs in a row, without reading aids."""
    return "".join(t.text or "" for part in element if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else part) if _tag(t) == "t")


def _ended(element: ElementTree.Element, found: list[tuple[str, ElementTree.Element]]) -> list[tuple[str, ElementTree.Element]]:
    """Elements with their tags, in the order in which they end."""
    for below in element:
        _ended(below, found)
    found.append((_tag(element), element))
    return found


def _is_date(code: str) -> bool:
    return bool(re.search(r"[ydhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


class Workbook:
    """The parts of one workbook file."""

    def __init__(self, content: bytes):
        self._archive = zipfile.ZipFile(io.BytesIO(content))
        self._sizes = {i.filename: i.file_size for i in self._archive.infolist()}
        self._held: tuple[str, list[tuple[str, ElementTree.Element]]] = ("", [])
        targets = {e.get("Id"): e.get("Target") for e in self._items("xl/_rels/workbook.xml.rels", "Relationship")}
        self.sheets = []
        for e in self._items("xl/workbook.xml", "sheet"):
            target = targets[next(v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id" and k != "id")]
            self.sheets.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        date_base = any(e.get("date1904") in ("1", "true") for e in self._items("xl/workbook.xml", "workbookPr"))
        self._epoch = dt.datetime(1904, 1, 1) if date_base else dt.datetime(1899, 12, 30)
        self._shared = [_texts(e) for e in self._items("xl/sharedStrings.xml", "si")]
        codes = dict(_BUILT_IN)
        codes.update({int(e.get("numFmtId")): e.get("formatCode") for e in self._items("xl/styles.xml", "numFmt")})
        self._formats = []
        for e in self._items("xl/styles.xml", "cellXfs"):
            self._formats = [codes.get(int(x.get("numFmtId", 0)), "") for x in e]

    def _items(self, part: str, *tags: str) -> Iterator[ElementTree.Element]:
        """Elements of a part in order, each forgotten after its use; none if there is no such part."""
        if part not in self._sizes:
            return
        if self._sizes[part] <= _HELD:
            if self._held[0] != part:
                self._held = part, _ended(ElementTree.fromstring(self._archive.read(part)), [])
            yield from (element for tag, element in self._held[1] if tag in tags)
            return
        with self._archive.open(part) as stream:
            root = None
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                root = element if root is None else root
                if event == "end" and _tag(element) in tags:
                    yield element
                    if element is not root:
                        element.clear()

    def _formatted(self, cell: ElementTree.Element) -> tuple[str | None, bool]:
        """Shown text of a cell, and whether it is a label rather than a quantity."""
        kind, found = cell.get("t", "n"), {_tag(e): e for e in cell}
        raw = found["v"].text if "v" in found else None
        if kind == "inlineStr":
            raw = _texts(found["is"]) if "is" in found else None
        if raw is None:
            return None, True
        if kind == "b":
            return ("VRAI" if raw == "1" else "FAUX"), True
        if kind in ("s", "str", "inlineStr", "e", "d"):
            text = self._shared[int(raw)] if kind == "s" else raw
            return text.replace("\n", " / ").replace("|", "¦").strip(), True
        value, code = float(raw), self._formats[int(cell.get("s", 0))] if int(cell.get("s", 0)) < len(self._formats) else ""
        if any(hint in code for hint in MONEY):
            return f"{number_text(value)} €", False
        if "%" in code:
            return f"{number_text(value * 100)} %", False
        if _is_date(code):
            return str((self._epoch + dt.timedelta(days=value)).replace(microsecond=0)), True
        return number_text(value), False

    def cells(self, part: str) -> Iterator[dict]:
        """Cells of a sheet (row, col, value, is_text, merge_id, merge_rank, is_sum), those of merged ranges whole."""
        merged: dict[tuple[int, int], tuple[int, int]] = {}
        for k, e in enumerate(self._items(part, "mergeCell")):
            (top, left), (bottom, right) = (place_of(r) for r in (e.get("ref") + ":" + e.get("ref")).split(":")[:2])
            merged.update({(r, c): (k, (r - top) * (right - left + 1) + c - left) for r in range(top, bottom + 1) for c in range(left, right + 1)})
        shared: dict[str, bool] = {}
        row = col = 0
        for e in self._items(part, "c", "row"):
            if _tag(e) == "row":
                row, col = row + 1, 0
                continue
            row, col = place_of(e.get("r")) if e.get("r") else (row, col + 1)
            formula = e.find("{*}f")
            total = False
            if formula is not None:
                total = adds_a_column(formula.text or "")
                if formula.get("t") == "shared":  # followers of a shared formula are shifted copies of the first
                    total = shared.setdefault(formula.get("si"), total)
            value, label = self._formatted(e)
            merge_id, rank = merged.pop((row, col), (None, None))
            if value is not None or total or merge_id is not None:
                yield {"row": row, "col": col, "value": value, "is_text": label, "merge_id": merge_id, "merge_rank": rank, "is_sum": total}
        for (r, c), (k, rank) in merged.items():  # cells of ranges that the sheet leaves out
            yield {"row": r, "col": c, "value": None, "is_text": True, "merge_id": k, "merge_rank": rank, "is_sum": False}


def cells_of(files: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """Cells of every sheet of every workbook, in the order of the sheets (``ordre``)."""
    ship_package(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[dict] = []
                try:
                    book = Workbook(content.as_py() or b"")
                    for order, (sheet, part) in enumerate(book.sheets):
                        for cell in book.cells(part):
                            rows.append({"fichier": name, "feuille": sheet, "ordre": order, **cell})
                            if len(rows) == _ROW_BATCH:
                                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                                rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, AttributeError, StopIteration, EOFError, zipfile.zlib.error) as e:
                    rows.append({"fichier": name, "motif": f"Classeur illisible: {type(e).__name__}"})
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select(F.col(name_col).alias("fichier"), F.col(content_col).alias("content")).mapInArrow(work, CELLS)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the workbooks in a folder; ``fichier`` is the file's name."""
    return cells_of(binary_files.read(spark, folder, "*.xlsx"))
