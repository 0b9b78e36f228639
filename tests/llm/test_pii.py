import hashlib
import random
import re
import time

import pytest

from ledgerloom.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def texts():
    rng = random.Random(7)
    bits = ["a", "b_", "@", ".", "x@y.z", "1", "12", "999", "255", "0007", "+", "+1 (", ") ", "-", " ", "é", "😀", "\n",
            "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "a@b-c.de", "%", "79927398713", "\t", "+44 20 7946 0958"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    return made + [None, "", "1" * 30000, "a" * 30000, "1 " * 20000, "a@" * 5000, "+1" * 5000, "1." * 9000]


def test_base_spans_equal_plain_search(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    for k, text in rows:
        want = brute(text)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text or "")[:80]
        assert got[k].n_email == want.count("email:")


def test_iban_needs_its_checksum_and_context_moves_the_score(spark):
    docs = spark.createDataFrame(
        [(1, "iban DE89 3704 0044 0532 0130 00 ok"), (2, "iban DE88 3704 0044 0532 0130 00 no"), (3, "x GB82WEST12345698765432")],
        "doc_id long, text string",
    )
    got = {r.doc_id: [s for s in r.spans if s.kind == "iban"] for r in pii.find_spans(docs).collect()}
    assert [len(got[k]) for k in (1, 2, 3)] == [1, 0, 1]
    assert got[1][0].score > got[3][0].score


def test_mask_replaces_each_span_once(spark):
    docs = spark.createDataFrame(
        [(1, "mail a@b.co or 10.0.0.1, 4111 1111 1111 1111!", "x"), (2, None, "y"), (3, "+14111111111111111", "z"), (4, "clean", "w")],
        "doc_id long, text string, spans string",
    )
    got = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert got[1].text == "mail <email> or <ip>, <card>!"
    assert got[2].text is None and got[4].text == "clean"
    assert got[1].spans == "x" and list(got[1].asDict()) == ["doc_id", "text", "spans"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.span_digests(empty).count() == 0 and pii.mask(empty).count() == 0


def plain_mask(text, spans):
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, s.rank, s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_mask_equals_plain_replacement(spark):
    long = "x 😀 a@b.co, " * 300 + "é" * 3000 + " 10.0.0.1 " + "z" * 1023 + "+44 20 7946 0958" + "w" * 1024
    rows = list(enumerate([t for t in texts() if t and len(t) < 20_000] + [long, "a@b.co", "a@b.co" + "y" * 5000 + "a@b.co"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    got = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert any(spans.values())
    for k, text in rows:
        assert got[k] == plain_mask(text, spans[k]), text[:80]


def test_ibans_of_all_lengths_before_other_words(spark):
    def checked(country, body):
        digits = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(digits) % 97:02d}{body}"

    made = [checked(code, "12A4" * 2 + "7" * (n - 12)) for n, codes in pii.IBAN_LENGTHS.items() for code in codes.split()]
    spaced = [" ".join(m[k : k + 4] for k in range(0, len(m), 4)) for m in made]
    rows = []
    for m in made + spaced:
        bad = m[:-1] + ("8" if m[-1] != "8" else "9")
        rows += [(m, f"to {m} EUR 12", 1), (m, f"{m}. Done", 1), (m, f"x {m}", 1), (m, f"{m}9", 0), (m, bad + " EUR", 0), (m, f"A{m}", 0)]
    docs = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [t for t in r.spans if t.kind == "iban"] for r in pii.find_spans(docs).collect()}
    for k, (m, text, n) in enumerate(rows):
        assert [text[s.start : s.end] for s in got[k]] == [m] * n, text


def test_score_decides_on_added_spans_and_is_returned(spark):
    rows = [
        (1, "Tel. 0151 23456789 only", "tel:5:18", "0.6"), (2, "item 0151 23456789 only", "", ""), (3, "serial GB82WEST12345698765432", "", ""),
        (4, "bank account, serial GB82WEST12345698765432", "iban:21:43", "0.6"), (5, "mail a@b.co", "email:5:11", "0.9"), (6, "build 10.0.0.1", "ip:6:14", "0.3"),
        (7, "GB82WEST12345698765432 is the iban", "iban:0:22", "0.9"),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    for k, _, spans, scores in rows:
        assert (got[k].spans, got[k].scores) == (spans, scores)
    assert got[1].n_tel == 1 and got[4].n_iban == 1
    assert [r.text for r in pii.mask(docs).orderBy("doc_id").collect()][:3] == ["Tel. <tel> only", rows[1][1], rows[2][1]]


def test_very_many_matches_in_one_text(spark):
    n = 32_000
    docs = spark.createDataFrame([(1, "user@example.org and 10.0.0.1; " * n)], "doc_id long, text string")
    begun = time.monotonic()
    one = pii.span_digests(docs).first()
    assert (one.n_email, one.n_ip) == (n, n)
    assert pii.mask(docs).first().text == "<email> and <ip>; " * n
    assert time.monotonic() - begun < 60


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "x", "y", "z")], "doc_id long, text string, spans string, Spans_ string, __spans string")
    assert pii.mask(docs).first().asDict() == {"doc_id": 1, "text": "<email>", "spans": "x", "Spans_": "y", "__spans": "z"}
