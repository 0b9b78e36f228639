import hashlib
import random
import re
import time

from ledgerloom.llm import infill
from ledgerloom.session import load

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, unit=UNIT):
    """The contract's words, on lists of units."""
    text = text or ""
    units = unit.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_digests_equal_lists_of_units_on_documents(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(tuple(r) for r in infill.infill_digests(docs).collect())
    assert got == sorted(brute(r.doc_id, r.text) for r in docs.collect())
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_odd_texts(spark):
    rng = random.Random(5)
    odd = ["", None, " ", "\t\r\n", "a", " a", "a ", "  a  b\x0b", "é\U0001f600 ü\u00a0x", "<P> in it", "a<S", "<", "P> <M", "S>x <P", "x\x85y\u2003z", "a\x00b c\x1c d"]
    odd += ["".join(rng.choice("ab<PSM> \n\té\U0001f600") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(odd)] + [(None, "no id here"), (3, "a repeated row"), (3, "a repeated row"), (2**62, "big id of a row"), (-7, "less than none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = repr
    assert sorted((tuple(r) for r in infill.infill_digests(docs).collect()), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_output_and_form_give_the_text_again(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = infill.infill(docs, plain_from=100, spm_below=50)
    back = rows.select("doc_id", "form", infill.restore(rows.output, rows.form).alias("back")).join(docs, "doc_id").collect()
    assert all(r.back == r.text for r in back) and {r.form for r in back} >= {"spm", "psm"}


def test_units_may_be_characters(spark):
    docs = spark.createDataFrame([(k, "ab  cé\U0001f600 \n x" + "y" * k) for k in range(200)], "doc_id long, text string")
    one = re.compile(r"(?s).")
    got = sorted(tuple(r) for r in infill.infill_digests(docs, units="characters").collect())
    assert got == sorted(brute(r.doc_id, r.text, one) for r in docs.collect())
    runs = infill.Runs("ab  c", "characters")
    assert [runs.offset(k) for k in range(6)] == [0, 1, 2, 3, 4, 5] and list(runs.starts) == [0, 2, 4]


def test_runs_are_maximal_and_count_units():
    runs = infill.Runs("  one two\n")
    assert list(runs.starts) == [0, 2, 5, 6, 9] and list(runs.upto) == [0, 1, 1, 2, 3]
    assert [runs.offset(k) for k in range(4)] == [0, 5, 9, 10]


def test_a_long_text_takes_no_longer_than_its_length():
    text = "word \n" * 1_000_000
    begun = time.perf_counter()
    n, form, first, middle, output = infill.rearrange(text, (10**9, 7 * 10**8, 0, 0))
    assert n == 1_000_001 and form == "spm" and len(output) == len(text) + 9
    assert time.perf_counter() - begun < 3


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.infill_digests(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "x", 5, "y", 2)], "doc_id long, text string, form string, n int, output string, h1 int")
    assert tuple(infill.infill_digests(docs).first()) == brute(1, "a b c")
