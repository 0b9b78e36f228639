import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import media


def expected(text):
    data = (text or "").encode()
    padded = data + b"\0" * ((-len(data)) % 64 if data else 64)
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


def texts():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ij\n") for _ in range(9000))
    made = [None, "", "x", "y" * 64, "é" * 40, "same", "same", "ab" * 20000, passage, "lead " + passage, passage[:5000] + "mid" + passage[5000:]]
    return made + ["".join(rng.choice("klmno p") for _ in range(rng.randint(1, 3000))) for _ in range(30)] + [passage]


def test_every_text_comes_back(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (5, "same"), (7, "another text of a used id")] + [(8, texts()[8])] * 3 + [(None, texts()[9])] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes", "3 as rows", "4 as key")
    got = media.media_features(docs).collect()
    assert len(got) == len(rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    assert have == sorted((k if k is not None else -1, *expected(t)) for k, t in rows)
    assert all(r.media_bytes == r.payload_bytes + 44 for r in got)


def test_texts_without_an_id_lend_and_borrow(spark):
    rng = random.Random(5)
    # Two passages; in each of the groups some file of null id is the owner (smallest media digest) of the shared chunks.
    passage = "".join(rng.choice("abcdefgh ij\n") for _ in range(9000))
    other = "".join(rng.choice("klmno p\n") for _ in range(9000))
    shared = [(f"lead {k} " * k) + passage + f" end {k}" for k in range(6)] + [passage + f" and {k} " + other for k in range(3)]
    shared.sort(key=lambda t: hashlib.sha256(media.to_wav(media.to_payload(t)[0])).digest())
    rows = [(None if k in (0, 3) else k, t) for k, t in enumerate(shared)] + [(None, shared[0]), (None, None), (None, "alone"), (20, "alone"), (21, shared[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = media.media_features(docs).collect()
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    assert have == sorted((k if k is not None else -1, *expected(t)) for k, t in rows)
    # Each file and each chunk once, repeated rows and rows without an id included.
    for limit in (0, 1 << 20):
        stored = media.store(docs.union(docs.limit(4)), broadcast_bytes=limit)[1].collect()
        chunks = [c for r in stored for c in r.own]
        assert len(chunks) == len(set(chunks)) and len(stored) == len({r.media for r in stored}) == len({t for _, t in rows})


def test_a_lost_chunk_or_file_is_an_error(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    _, kept, loans = media.store(docs)
    with pytest.raises(Exception, match="lacks"):
        media.load_back(kept.withColumn("lent", F.expr("cast(array() as array<int>)")), loans).collect()


def test_shared_chunks_are_stored_once(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    _, kept, _ = media.store(docs)
    chunks = [c for r in kept.collect() for c in r.own]
    assert len(chunks) == len(set(chunks))
    assert {d for r in kept.collect() for d in r.chunks} == {hashlib.sha256(c).digest() for c in chunks}


def test_notes_by_shuffled_join_give_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    one = {bytes(r.media): [bytes(c) for c in r.own] for r in media.store(docs, broadcast_bytes=0)[1].collect()}
    two = {bytes(r.media): [bytes(c) for c in r.own] for r in media.store(docs)[1].collect()}
    assert one == two


def test_gear_hash_rolls():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 500, dtype=np.uint8).tobytes()
    h, slow = 0, []
    for b in data:
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        slow.append(h)
    assert media.gear_hashes(data).tolist() == slow
    long = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    pieces = media.cut(long)
    assert b"".join(pieces) == long and all(256 <= len(p) <= 8192 for p in pieces[:-1])
    again = set(media.cut(b"inserted" + long))
    assert len(again & set(pieces)) > 0.9 * len(pieces)


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "some text " * 200)], "doc_id long, text string")
    _, kept, loans = media.store(docs)
    broken = kept.selectExpr("media", "n_bytes", "chunks", "transform(own, c -> cast(concat('!', substring(cast(c as string), 2)) as binary)) as own", "lent", "borrows")
    with pytest.raises(Exception):
        media.load_back(broken, loans).collect()


def test_empty_table(spark):
    assert media.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0
