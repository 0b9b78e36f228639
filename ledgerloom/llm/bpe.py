"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For each prefix of a piece the table holds the one token that ends the
encoding of that prefix.  A suffix-matching automaton over the vocabulary lists
the tokens that end at a position; a token follows the token stored for the
prefix before it only if the two are compatible, which means that merging their
joined bytes would give back just these two.  Back-pointers from the whole
piece then spell the ids.  The work is linear in the piece, however long.

Null texts count as empty (no ids).  Texts are never cut.  Repeated texts,
empty tables and extra columns need no special care: every row is encoded on
its own and only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import ship_package

# The tokenizer's split pattern, with white space as the Unicode property lists it.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

_codecs: dict[str, "PrefixCodec"] = {}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte in a byte-level vocabulary, and its byte.

    Printable Latin-1 bytes stand for themselves; the others, in order, for
    the code points from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class _PairTable:
    """Verdicts on token pairs in an open-addressing table that numpy reads."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, judge, bits: int = 21):
        self._judge, self._shift, self._mask = judge, np.uint64(64 - bits), (1 << bits) - 1
        self._clear()

    def _clear(self) -> None:
        self._keys = np.full(self._mask + 1, self.EMPTY)
        self._fits = np.zeros(self._mask + 1, bool)
        self._used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair, whether ``right`` may follow ``left``."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out, slots, open_, lacking = np.zeros(len(keys), bool), self._slots(keys), np.arange(len(keys)), []
        while len(open_):
            found = self._keys[slots[open_]]
            hit, empty = found == keys[open_], found == self.EMPTY
            out[open_[hit]] = self._fits[slots[open_[hit]]]
            lacking.append(open_[empty])
            open_ = open_[~(hit | empty)]
            slots[open_] = (slots[open_] + 1) & self._mask
        lacking = np.concatenate(lacking) if lacking else open_
        if len(lacking):
            new, where = np.unique(keys[lacking], return_inverse=True)
            if self._used + len(new) > self._mask // 2:
                self._clear()
            verdicts = np.fromiter((self._judge(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in new), bool, len(new))
            out[lacking] = verdicts[where]
            if len(new) <= self._mask // 2:
                for key, slot, fits in zip(new, self._slots(new).tolist(), verdicts.tolist()):
                    while self._keys[slot] != self.EMPTY:
                        slot = (slot + 1) & self._mask
                    self._keys[slot], self._fits[slot] = key, fits
                self._used += len(new)
        return out


class PrefixCodec:
    """Exact byte-level BPE from a tokenizer file's vocabulary and merges."""

    def __init__(self, spec: str, cache_entries: int = 400_000, batch_chars: int = 4_000_000):
        model = json.loads(spec)
        alphabet = byte_alphabet()
        self.bytes_of: list[bytes] = []
        ids = model["model"]["vocab"]
        special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        self.bytes_of = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, k in ids.items():
            self.bytes_of[k] = bytes(map(alphabet.__getitem__, token))
        for token, k in special.items():
            self.bytes_of[k] = token.encode()
        self.special = {t: np.uint32(k).astype("<u4").tobytes() for t, k in special.items()}
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

        # How each token came about: its two halves and the rank of their merge.
        self._rank = [-1] * len(self.bytes_of)
        self._halves: list[tuple[int, int]] = [(-1, -1)] * len(self.bytes_of)
        self._merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[left], ids[right], ids[left + right]
            self._merge[a, b] = rank
            if self._rank[whole] < 0:
                self._rank[whole], self._halves[whole] = rank, (a, b)

        self._suffixes = ahocorasick.Automaton()
        for k in ids.values():
            word = self.bytes_of[k].decode("latin-1")
            self._suffixes.add_word(word, (k << 16) | len(word))
        self._suffixes.make_automaton()
        self._pattern = regex.compile(SPLIT_PATTERN)
        self._wide_space = regex.compile(r"\p{White_Space}\p{White_Space}|\p{White_Space}\Z")
        self._fits = _PairTable(self._compatible)
        self._piece: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}
        self._limit, self._batch_chars = cache_entries, batch_chars

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends with just these two.

        Walks back through the merges of either side.  At every moment one
        piece of the left token touches one piece of the right token; had their
        pair a merge of an earlier rank than what became of them, it would have
        been applied.  At equal rank the leftmost pair goes first.
        """
        left_until = right_until = len(self._merge)
        while True:
            across = self._merge.get((left, right))
            if across is not None and across < left_until and across <= right_until:
                return False
            if self._rank[left] > self._rank[right]:
                left_until, left = self._rank[left], self._halves[left][1]
            elif self._rank[right] >= 0:
                right_until, right = self._rank[right], self._halves[right][0]
            else:
                return True

    def _fill_prefixes(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, by the prefix table of all of them at once.

        The automaton runs over the pieces, kept apart by a character that no
        token holds.  Prefixes of one length are then settled together: of the
        tokens that end there, just one is compatible with what is stored for
        the prefix before it.
        """
        data = [p.encode().decode("latin-1") for p in pieces]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(sizes + 1) - 1
        first = ends - sizes
        matches = np.fromiter(self._suffixes.iter(chr(256).join(data)), np.dtype([("end", np.int64), ("value", np.int64)]))
        end, token, size = matches["end"], matches["value"] >> 16, matches["value"] & 0xFFFF
        offset = np.arange(int(ends[-1]) + 1) - np.repeat(first, sizes + 1)
        length = offset[end] + 1
        order = np.argsort(length, kind="stable")
        end, token, size, length = end[order], token[order], size[order], length[order]
        bounds = np.searchsorted(length, np.arange(1, int(sizes.max(initial=0)) + 2))
        last = np.full(int(ends[-1]) + 1, -1, np.int64)
        width = np.zeros(int(ends[-1]) + 1, np.int64)
        for at, to in zip(bounds[:-1], bounds[1:]):
            e, t, w = end[at:to], token[at:to], size[at:to]
            whole = length[at:to] == w
            inner = np.flatnonzero(~whole)
            keep = whole
            keep[inner] = self._fits(last[e[inner] - w[inner]], t[inner])
            last[e[keep]], width[e[keep]] = t[keep], w[keep]
        owner, at, rounds, found = np.arange(len(pieces)), ends - 1, [], []
        while len(owner):  # follow the back-pointers of all pieces together
            rounds.append(owner)
            found.append(last[at])
            at = at - width[at]
            going = at >= first[owner]
            owner, at = owner[going], at[going]
        owners = np.concatenate(rounds[::-1])
        order = np.argsort(owners, kind="stable")
        blob = np.concatenate(found[::-1])[order].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(pieces)))]) * 4
        return [blob[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _learn(self, pieces: set[str]) -> None:
        lacking = [p for p in pieces if p not in self._piece]
        for at in range(0, len(lacking), 50_000):
            part = lacking[at : at + 50_000]
            self._piece.update(zip(part, self._fill_prefixes(part)))

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens.

        One space between two words always starts a piece, so words that stand
        so are looked up whole; other texts are cut by the pattern.
        """
        if len(self._piece) > self._limit:
            self._piece.clear()
        if len(self._spaced) > self._limit:
            self._spaced.clear()
        wide = [bool(self._wide_space.search(t)) for t in texts]
        words = [[] if w else t.split(" ") for t, w in zip(texts, wide)]
        heads = [self._pattern.findall(t if w else p[0]) for t, w, p in zip(texts, wide, words)]
        new = list(set().union(*(p[1:] for p in words)).difference(self._spaced))
        cut = [self._pattern.findall(" " + word) for word in new]
        self._learn(set().union(*heads, *cut))
        piece = self._piece.__getitem__
        self._spaced.update((word, b"".join(map(piece, parts))) for word, parts in zip(new, cut))
        spaced = self._spaced.__getitem__
        return [b"".join(map(piece, h)) + b"".join(map(spaced, p[1:])) for h, p in zip(heads, words)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        plain: list[str] = []
        places: list[tuple[int, int]] = []
        waiting = 0

        def flush() -> None:
            for (row, part), ids in zip(places, self._encode_plain(plain)):
                out[row][part] = ids
            plain.clear()
            places.clear()

        for row, text in enumerate(texts):
            text = text or ""
            split = self._special_split is not None and any(s in text for s in self.special)
            parts = self._special_split.split(text) if split else [text]
            out.append([self.special.get(p, b"") if k % 2 else b"" for k, p in enumerate(parts)])
            for k in range(0, len(parts), 2):
                if parts[k]:
                    plain.append(parts[k])
                    places.append((row, k))
                    waiting += len(parts[k])
            if waiting > self._batch_chars:
                flush()
                waiting = 0
        flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of such ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _codec(spec: str) -> PrefixCodec:
    """The codec of a tokenizer file, built once per Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = PrefixCodec(spec)
    return _codecs[key]


def encode_decode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Ids and decoded text of every document.

    Returns ``id_col``, ``ids`` (array<int>), ``decoded`` (string).  The
    tokenizer file is read on the driver and goes to the tasks with the job.
    """
    spec = open(tokenizer_file, encoding="utf-8").read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            blobs = codec.encode_batch(batch.column(1).to_pylist())
            ids = pa.array([np.frombuffer(b, "<i4") for b in blobs], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), ids, pa.array(map(codec.decode, blobs), pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(work, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, tokenizer_file: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every text; keep only its digests.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, so
    that neither ids nor texts leave the task that made them.
    """
    spec = open(tokenizer_file, encoding="utf-8").read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for ids in codec.encode_batch(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
