import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from ledgerloom.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.PrefixCodec(open(FILE, encoding="utf-8").read(), cache_entries=500, batch_chars=2000)


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(FILE)


def texts():
    rng = random.Random(4)
    bits = ["a", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'ll", "!", "###", "<|endoftext|>", "日本", "😀", "\x1c", "\x85", "the", " ing", "²", "\r\n", "aaaa", "​", "\xa0"]
    return ["", " ", "\n", "a" * 5000, "ab" * 3000, "word " * 3000, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500))]


def test_equal_to_the_library(codec, reference):
    made = texts()
    for text, ids in zip(made, codec.encode_batch(made)):
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:60]
        assert codec.decode(ids) == reference.decode(want, skip_special_tokens=False) == text


def test_every_token_encodes_to_itself(codec, reference):
    for k in range(0, 50257, 37):
        text = reference.decode([k], skip_special_tokens=False)
        if "�" not in text:
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_not_text_decode_to_replacement(codec, reference):
    ids = np.array([0, 187, 100, 220], "<u4")
    assert codec.decode(ids.tobytes()) == reference.decode(ids.tolist(), skip_special_tokens=False)


def test_rows(spark, reference):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (2, None, "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe.encode_decode(docs, FILE).collect())
    want = sorted((k or 0, reference.encode(t or "", add_special_tokens=False).ids, t or "") for k, t, _ in rows)
    assert got == want
    digests = bpe.round_trip_digests(docs, FILE)
    assert digests.filter("n_tokens = 0").count() == 2 and digests.count() == 5
    assert bpe.round_trip_digests(docs.filter(F.lit(False)), FILE).count() == 0
