"""Media columns in a deduplicated store of content-defined chunks.

A text's bytes become 8-bit mono samples of a WAV file.  A rolling gear hash
cuts the file where its content says so; chunks are known by their SHA-256.
Spark joins over the digests decide which file keeps a chunk that several
share; each chunk is stored once.  A file's ordered chunk list rebuilds it: its
own chunks lie beside the list, borrowed ones come by a join on the digest, and
only files that borrow take part in that shuffle.  What was rebuilt is verified
against every digest before its samples are read.

Null texts count as empty.  Equal texts are one file, so copies never multiply
the work; they have equal values.  Rows with a null id, and repeated ids, are
reported each; rows that agree in id and text (or in text, without ids) are
stored once.  Texts are read whole, however long, and a chunk or file that very
many others share is spread over all tasks.  A file or chunk that is missing
when it is read back is an error, never a missing row.  Extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.skew import join_counted, row_key
from ledgerloom.session import discard, materialise, ship_package

SAMPLE_RATE = 8000
_GEAR = np.random.default_rng(29).integers(0, 1 << 32, 256, dtype=np.uint32)


def to_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded with zeros to a positive multiple of 64, and the unpadded length."""
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64)), len(data)


def to_wav(payload: bytes) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload's bytes."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of such a file."""
    riff, _, wave = struct.unpack_from("<4sI4s", media)
    channels, bits = struct.unpack_from("<H10xH", media, 22)
    mark, size = struct.unpack_from("<4sI", media, 36)
    if (riff, wave, mark, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 8) or len(media) != 44 + size:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def gear_hashes(data: bytes) -> np.ndarray:
    """The 32-bit rolling gear hash after each byte.

    Shifting left by one per byte leaves a byte's value for 32 steps, so the
    hash is a sum over 32 places, built by doubling the span five times.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):
        span = 1 << k
        h = h.copy() if span == 1 else h
        shifted = h[:-span] << np.uint32(span)
        h[span:] += shifted
    return h


def cut(data: bytes, least: int = 256, most: int = 8192, mask_bits: int = 10) -> list[bytes]:
    """Content-defined chunks: cut where the hash's top bits are zero, between two sizes."""
    places = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - mask_bits) == 0) + 1
    chunks, at = [], 0
    for place in [*places.tolist(), len(data)]:
        while place - at > most:
            chunks.append(data[at : at + most])
            at += most
        if place - at >= least or place == len(data) > at:
            chunks.append(data[at:place])
            at = place
    return chunks


def features(payload: bytes) -> str:
    """Mean, deviation, crossings of the middle and distinct values of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    wide = samples.astype(np.int64)
    n, total, squares = len(samples), int(wide.sum()), int((wide * wide).sum())
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    variance = max(0, squares * n - total * total)
    return f"mean={total / n:.6f};dev={variance**0.5 / n:.6f};cross={crossings};distinct={len(np.unique(samples))}"


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (id, text, key) -> (id, key, digest of the file, digests of its chunks)."""
    for batch in batches:
        media, chunks = [], []
        for text in batch.column(1):
            data = to_wav(to_payload(text.as_py())[0])
            media.append(_digest(data))
            chunks.append([_digest(c) for c in cut(data)])
        columns = [batch.column(0), batch.column(2), pa.array(media, pa.binary()), pa.array(chunks, pa.list_(pa.binary()))]
        yield pa.record_batch(columns, names=["id", "key", "media", "chunks"])


_STORE = "media binary, n_bytes long, chunks array<binary>, own array<binary>, lent array<int>, borrows boolean"
_STORE_NAMES = ["media", "n_bytes", "chunks", "own", "lent", "borrows"]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (text, note on what differs from keeping all) -> rows of the store.

    ``own`` holds, in order, the chunks that this file keeps: those that the
    note doesn't call borrowed, each at its first place in the file.
    """
    for batch in batches:
        out = [[] for _ in _STORE_NAMES]
        for text, note in zip(batch.column(0), batch.column(1).to_pylist()):
            if note and note["copy"]:
                continue
            payload, n_bytes = to_payload(text.as_py())
            data = to_wav(payload)
            media = _digest(data)
            borrowed = set(note["borrowed"]) if note else set()
            chunks = cut(data)
            digests, own = [_digest(c) for c in chunks], []
            seen: set[bytes] = set()
            for seq, (digest, chunk) in enumerate(zip(digests, chunks)):
                if seq not in borrowed and digest not in seen:
                    own.append(chunk)
                seen.add(digest)
            for column, value in zip(out, (media, n_bytes, digests, own, note["lent"] if note else [], bool(borrowed))):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.bool_()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=_STORE_NAMES)


def _lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows of the store -> (digest, chunk) of the chunks that others borrow."""
    for batch in batches:
        digests, data = [], []
        for chunks, own, lent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            have = {_digest(c): c for c in own}
            digests += [chunks[seq] for seq in lent]
            data += [have[chunks[seq]] for seq in lent]
        yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "chunk"])


_RESULT = (
    "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
)
_RESULT_NAMES = [part.split(" ")[0] for part in _RESULT.split(", ")]


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (file, length, chunk list, own chunks, borrowed chunks) -> verified file's values."""
    for batch in batches:
        out = [[] for _ in _RESULT_NAMES]
        for media, n_bytes, digests, own, extra in zip(*(c.to_pylist() for c in batch.columns)):
            have = {_digest(c): c for c in [*own, *(extra or ())]}
            if missing := sum(d not in have for d in digests):  # a chunk whose bytes changed is not found under its digest
                raise ValueError(f"media {media.hex()} lacks {missing} of its {len(digests)} chunks")
            data = b"".join(have[d] for d in digests)
            if _digest(data) != media:
                raise ValueError(f"media {media.hex()} does not match its digest")
            payload = from_wav(data)
            values = (
                media, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), media.hex(), features(payload), len(digests),
            )
            for column, value in zip(out, values):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=_RESULT_NAMES)


def store(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store every text as media: (documents, store, loans).

    ``documents``: (id, media).  ``store``: one row per distinct file with its
    chunk list and the chunks that it keeps.  ``loans``: (media, digest), the
    chunks that a file borrows.  Notes on copies and shared chunks are broadcast
    to the second read of the texts if they measure ``broadcast_bytes`` at most;
    else they go by a shuffled join.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("t"), row_key(F.col(id_col), text).alias("key"))
    lists = materialise(texts.mapInArrow(_lists, f"id {kind}, key binary, media binary, chunks array<binary>"), "media-lists")

    # The smallest key keeps the file.
    files = materialise(lists.groupBy("media").agg(F.min("key").alias("keeper"), F.count("*").alias("rows")), "media-files")
    refs = lists.select("media", "chunks").dropDuplicates(["media"]).select("media", F.posexplode("chunks").alias("seq", "digest"))
    refs = materialise(refs, "media-refs")
    shared = refs.groupBy("digest").agg(F.min(F.struct("media", "seq")).alias("owner"), F.count("*").alias("rows")).filter("rows > 1")
    shared = materialise(shared, "media-shared")
    loans = join_counted(refs, shared, "digest", refs.count()).filter("media <> owner.media").select("media", "seq", "digest")
    loans = materialise(loans, "media-loans")
    borrowed = loans.groupBy("media").agg(F.collect_list("seq").alias("borrowed"))
    lent = loans.select("digest").distinct().join(shared, "digest")
    lent = lent.groupBy(F.col("owner.media").alias("media")).agg(F.collect_list("owner.seq").alias("lent"))

    # A note for whoever is not simply the keeper of all of its chunks.
    nothing = F.array().cast("array<int>")

    def note(copy: bool, borrowed: Column, lent: Column) -> Column:
        return F.struct(F.lit(copy).alias("copy"), borrowed.alias("borrowed"), lent.alias("lent")).alias("note")

    keepers = files.join(borrowed.join(lent, "media", "full"), "media")
    keepers = keepers.select(F.col("keeper").alias("key"), note(False, F.coalesce("borrowed", nothing), F.coalesce("lent", nothing)))
    copies = join_counted(lists.select("key", "media"), files, "media", lists.count()).filter("key <> keeper").select("key").distinct()
    # Of rows that agree in id and text, the first read leaves all out, and one comes back by itself.
    again = materialise(lists.groupBy("key").count().filter("count > 1").select("key"), "media-again")
    alone = keepers.join(again, "key", "left_anti")
    notes = materialise(alone.union(copies.union(again).distinct().select("key", note(True, nothing, nothing))), "media-notes")
    size = notes.agg(F.sum(64 + 4 * (F.size("note.borrowed") + F.size("note.lent")))).first()[0] or 0
    noted = texts.select("key", "t").join(F.broadcast(notes) if size <= broadcast_bytes else notes, "key", "left").select("t", "note")
    if not again.isEmpty():
        kept = again.join(files.select(F.col("keeper").alias("key")), "key").join(keepers, "key", "left")
        one = texts.select("key", "t").join(again, "key").groupBy("key").agg(F.any_value("t").alias("t"))
        noted = noted.union(one.join(kept, "key").select("t", "note"))
    kept = materialise(noted.mapInArrow(_keep, _STORE), "media-store")
    for table in (refs, shared, notes, again):
        discard(table)
    return lists.select("id", "media"), kept, loans.select("media", "digest").distinct()


def load_back(kept: DataFrame, loans: DataFrame) -> DataFrame:
    """Rebuild, verify and read every stored file; one row of values per file."""
    alone = kept.filter("not borrows").select("media", "n_bytes", "chunks", "own", F.lit(None).cast("array<binary>").alias("extra"))
    chunks = kept.filter("size(lent) > 0").select("chunks", "own", "lent").mapInArrow(_lend, "digest binary, chunk binary")
    chunks = materialise(chunks.join(loans.groupBy("digest").agg(F.count("*").alias("rows")), "digest"), "media-lent")
    # A chunk has 8 KB at most, so the most borrowed ones, which are broadcast, have 16 MB.
    fetched = join_counted(loans, chunks, "digest", loans.count()).groupBy("media").agg(F.collect_list("chunk").alias("extra"))
    borrowing = kept.filter("borrows").join(fetched, "media", "left").select("media", "n_bytes", "chunks", "own", "extra")
    parts = [part.mapInArrow(_rebuild, _RESULT) for part in (alone, borrowing)]
    return parts[0].union(parts[1])


def media_features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store all texts as media, read them back, and give each document its file's values."""
    documents, kept, loans = store(docs, text_col, id_col)
    values = load_back(kept, loans).join(documents.groupBy("media").agg(F.count("*").alias("rows")), "media")
    every = join_counted(documents, materialise(values, "media-values"), "media", documents.count()).drop("rows")
    found = F.when(F.col("n_chunks").isNotNull(), F.col("n_bytes")).otherwise(F.raise_error(F.concat(F.lit("nothing stored for media "), F.lower(F.hex("media")))))
    return every.withColumn("n_bytes", found).drop("media").withColumnRenamed("id", id_col)
