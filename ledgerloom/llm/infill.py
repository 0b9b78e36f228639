"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of white space and of other characters,
each with the count of units up to its end.  A unit is a word with the white
space before it; white space after the last word is a unit of its own (with
``units="characters"`` every code point is one).  A cut after k units is found
by binary search for the run that holds the k-th unit; its offset follows from
the run's start by arithmetic, so no list of words is ever built and the text is
never scanned again.

Two cuts, both drawn from a digest of seed and id, part the text into prefix,
middle and suffix; a third number decides whether it is rearranged at all, a
fourth how.  The draw does not depend on the order or the place of the rows.

Null and empty texts stay as they are (form ``plain``, no units), and so does a
text that holds one of the marks.  A null id draws like an empty one.  Repeated
rows give equal rows; texts are taken whole, however long; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import ship_package


class Marks(NamedTuple):
    """What stands before each part of a rearranged text."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Runs:
    """Maximal runs of one character class, with cumulative unit counts."""

    def __init__(self, text: str, units: str = "words"):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        space = (codes == 0x20) | (codes >= 0x09) & (codes <= 0x0D)
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts = np.concatenate([[0], turns])[: len(codes)]  # no run in an empty text
        lengths = np.diff(np.append(self.starts, len(codes)))
        if units == "characters":
            counts = lengths
        elif units == "words":
            counts = (~space[self.starts]).astype(np.int64)
            if len(counts):
                counts[-1] = 1
        else:
            raise ValueError(f"units are words or characters, not {units}")
        self.upto = np.cumsum(counts)
        self._widths = lengths // np.maximum(counts, 1)

    @property
    def n_units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def offset(self, k: int) -> int:
        """Code points before the end of the ``k``-th unit."""
        if k == 0:
            return 0
        run = int(np.searchsorted(self.upto, k, "left"))
        before = int(self.upto[run - 1]) if run else 0
        return int(self.starts[run]) + (k - before) * int(self._widths[run])


def rearrange(text: str, draws: tuple[int, int, int, int], marks: Marks = Marks(), units: str = "words", plain_from: int = 50, spm_below: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text under four drawn numbers."""
    runs = Runs(text, units)
    n = runs.n_units
    if not text or draws[2] % 100 >= plain_from or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((runs.offset(draws[0] % (n + 1)), runs.offset(draws[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if draws[3] % 100 < spm_below:
        return n, "spm", first, second - first, f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"
    return n, "psm", first, second - first, f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"


def infill(
    docs: DataFrame,
    seed: int = 42,
    plain_from: int = 50,
    spm_below: int = 80,
    units: str = "words",
    marks: Marks = Marks(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's ``id_col``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``plain_from`` and ``spm_below`` are per cents: of the drawn hundred, texts
    below the one are rearranged, and of those, texts below the other get their
    suffix first.
    """
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            done = [rearrange(text.as_py(), four, marks, units, plain_from, spm_below) for text, four in zip(batch.column(1), draws)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*done), kinds)] if done else [pa.array([], kind) for kind in kinds]
            yield pa.record_batch([batch.column(0), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), digest.alias("h"))
    rows = rows.select("id", "t", *(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text again, from output and form alone.

    A rearranged text holds none of the marks, and no mark can arise where a
    part meets one, so the output parts at exactly three places.
    """
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm, spm = (F.concat(parts[first], parts[3], parts[last]) for first, last in ((1, 2), (2, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_digests(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """``infill`` with the digests of its output and of the text that ``restore`` rebuilds from it, in place of the output."""
    rows = infill(docs, id_col=id_col, **parameters)
    restored = restore(F.col("output"), F.col("form"), parameters.get("marks", Marks()))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    return rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", *digests)


#: The digests of ``documents`` by lists of words, in DuckDB.
ORACLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), drawn AS (
    SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS k2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS k3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS k4 FROM units
), parted AS (
    SELECT *, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(u[greatest(k1, k2) + 1:], '') AS s,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k3 >= 50 THEN 'plain' WHEN k4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parted
"""
