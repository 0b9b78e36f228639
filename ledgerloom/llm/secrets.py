"""Secret scans: patterns propose, a random forest removes false positives.

Patterns find passwords in URLs, tokens of known formats, the values of
assignments to secret-sounding names, compound ones (``DB_PASSWORD``,
``dbPassword``, ``client_secret_key``) among them, and long runs of key-like
characters.  Each finding is described by its length, the transitions between
character classes, its entropy, the share covered by dictionary words, whether
it looks like a path, and the words near it.  A random forest (Spark ML),
trained on labelled findings, gives its probability of being a secret.

The dictionary holds common words of identifiers and the most frequent words of
all documents, whatever their language.  Labelled findings stand in excerpts of
the documents: values of known kinds are set into them, and long words, which
they hold themselves, are findings that are no secrets.

Null and empty texts have no findings.  Texts are scanned whole, however long;
findings of one text do not overlap, the leftmost comes first.  Repeated rows,
and rows with a null id, are each scanned; extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import discard, materialise, ship_package

# Words that name a secret, words that name a harmless code, common words of identifiers and placeholders.
SECRET_NAMES = "token secret password passwd pwd apikey api_key api-key access_key accesskey auth bearer credential private key".split()
HARMLESS_NAMES = "commit sha sha1 sha256 md5 checksum digest hash uuid guid etag revision version id isbn path url href src file image integrity".split()
DICTIONARY = (
    "access account action admin alpha answer array attribute author backup balance base begin beta block body button cache call change channel character check "
    "child class client cloud code color column command common component config connect content context control copy count create current custom data database date "
    "default delete demo design device digit document domain driver dummy edit element email empty enable engine entry environ error event example export factory false "
    "field file filter first folder format frame function global group guide handler header hello help home host house html image import index input insert item java "
    "label language layer layout letter level library line link list load local login main manager master match message method model module name network node null number "
    "object option order other page panel parameter parent password path people place policy position post private process product profile program project property public "
    "query random range read record region release remove report request reset resource response result root route rule sample schema screen script search secret"
).split()
# A name with such a word anywhere in it; what follows the word is set off by a separator, a digit or a capital ("author" is no such name).
_NAME = (
    r"[A-Za-z0-9_.-]*(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential)(?i:s|key|id|value)?"
    r"(?:[0-9_.-][A-Za-z0-9_.-]*|(?<=[a-z])[A-Z][A-Za-z0-9_.-]*)?"
)
_NAMED = re.compile(_NAME)
# How tokens of public services begin.
_FORMAT = (
    r"(?:xox[abeoprs]-|xapp-|glpat-|gh[oprsu]_|github_pat_|[rs]k_live_|sk-|whsec_|AKIA|ASIA|AIza|ya29\.|npm_|pypi-|hf_|dop_v1_|shpat_|SG\.|eyJ)[A-Za-z0-9_.-]{12,}"
)
_KNOWN = re.compile(_FORMAT)
# Runs are matched whole and never retried from within, so a text takes time in proportion to its length; whether a
# name tells of a secret, and how far its value reaches, is looked up after the match.
CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@\"'<>]*+:(?P<password>[^\s/@\"'<>]{3,}+)@"
    rf"|(?<![A-Za-z0-9_.-]){_FORMAT}"
    r"|(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)[\"']?\s{0,3}(?:[:=]|:=|=>)\s{0,3}[\"']?(?=[^\s\"'<>]{6})"
    r"|[A-Za-z0-9+/_=.-]{20,}"
)
_VALUE = re.compile(r"[^\s\"'<>]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
FEATURES = [
    "length", "transitions", "entropy", "digits", "upper", "dictionary", "path", "hex", "repeat", "secret_word", "harmless_word", "assigned", "quoted", "format", "credential",
]
_BETWEEN = re.compile(r"://[^\s/:@]{0,64}:$")


class Words:
    """A dictionary that finds the longest word at a place by its first four letters."""

    def __init__(self, words: Iterable[str]):
        self._by_start: dict[str, list[str]] = {}
        for w in sorted((w for w in words if len(w) > 3), key=lambda w: (-len(w), w)):
            self._by_start.setdefault(w[:4], []).append(w)

    def covered(self, value: str) -> int:
        """Characters of a value that words cover, the longest at each place first."""
        low, at, total = value.lower(), 0, 0
        while at < len(low):
            size = next((len(w) for w in self._by_start.get(low[at : at + 4], ()) if low.startswith(w, at)), 0)
            total += size
            at += size or 1
        return total


def covered(value: str, words: frozenset[str]) -> int:
    """``Words.covered`` for a single value."""
    return Words(words).covered(value)


_COMMON = Words(DICTIONARY)


def describe(text: str, start: int, end: int, words: Words | frozenset[str] = _COMMON, credential: bool | None = None) -> list[float]:
    """Features of one finding, from the whole value and 60 characters before it.

    ``credential`` says whether it is the password of a URL; if it isn't given,
    the characters before tell.
    """
    value, before = text[start:end], text[max(0, start - 60) : start]
    words = words if isinstance(words, Words) else Words(words)
    lead = before.lower()
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    near = re.findall(r"[a-z0-9_-]+", lead)[-4:]
    named = any(w.lower() in SECRET_NAMES or _NAMED.fullmatch(w) for w in re.findall(r"[A-Za-z0-9_-]+", before)[-4:])
    if credential is None:
        credential = text[end : end + 1] == "@" and _BETWEEN.search(lead) is not None
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), entropy, kinds.count("d") / n, kinds.count("u") / n,
        words.covered(value) / n,
        float(value.count("/") >= 2 or "://" in lead[-8:] or value.count(".") >= 2), float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None),
        max(counts.values()) / n, float(named), float(any(w in HARMLESS_NAMES for w in near)),
        float(re.search(r"[:=]\s{0,3}[\"']?$", lead) is not None), float(lead[-1:] in "\"'" and lead != ""),
        float(_KNOWN.match(value) is not None), float(credential),
    ]


def candidates(text: str | None) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is the password of a URL) of the candidates of a text, from left to right."""
    text, at = text or "", 0
    while (m := CANDIDATE.search(text, at)) is not None:
        at = m.end()
        if m["password"] is not None:
            yield *m.span("password"), True
            continue
        start, end = m.span()
        if m["name"] is not None:
            if _NAMED.fullmatch(m["name"]):
                start, end = _VALUE.match(text, end).span()
            else:
                run = _RUN.match(text, start)
                if run is None:
                    at = start + 1
                    continue
                end = run.end()
        at = end
        yield start, end, False


def find(text: str | None) -> list[tuple[int, int]]:
    """Spans of the candidates of a text."""
    return [(start, end) for start, end, _ in candidates(text)]


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = 5000) -> frozenset[str]:
    """Words of identifiers and the ``most`` frequent words (of 4 to 15 letters) of all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"\p{L}{4,15}"), F.lit(0))).alias("w"))
    # Tasks' lists of the most frequent words meet in a task, so the driver is sent ``most`` words only.
    frequent = materialise(words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most), "frequent-words")
    found = frequent.select("w").collect()
    discard(frequent)
    return frozenset(r.w for r in found) | frozenset(w for w in DICTIONARY if len(w) > 3)


def excerpts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = 500, characters: int = 2000, seed: int = 1) -> list[str]:
    """Stretches of at most ``most`` documents, to set labelled findings into.

    A hash of id and text picks about twice as many of all rows, whatever their
    number, so no task sends more than its small share; the least of these stay.
    """
    text = F.col(text_col).cast("string")
    order = F.xxhash64(F.col(id_col), text, F.lit(seed))
    share = int(min(1.0, 2.0 * most / max(1, docs.count())) * (1 << 30)) + 1
    start = F.pmod(order, F.greatest(F.length(text) - characters, F.lit(0)) + 1) + 1
    picked = docs.filter((F.length(text) > 0) & (F.pmod(order, F.lit(1 << 30)) < share))
    cut = picked.select(order.alias("at"), F.substr(text, start.cast("int"), F.lit(characters)).alias("cut"))
    return [r.cut for r in cut.orderBy("at", "cut").limit(most).collect()]


def labelled_findings(texts: list[str] | None = None, n: int = 3000, seed: int = 23) -> list[tuple[str, int, int, int]]:
    """Labelled findings: (text, start, end, label), alike in every run.

    Secrets are random strings of usual formats, passwords in URLs, and short
    passwords, behind telling names, simple or compound; the others are what
    such scans usually report by mistake: checksums, ids, paths, identifiers,
    placeholders and plain words.  They stand in stretches of ``texts``; long
    words of the texts themselves, which patterns find too, are added as such.
    """
    rng = random.Random(seed)

    def pick(alphabet: str, k: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(k))

    hexes, digits = "0123456789abcdef", "0123456789"
    low = "abcdefghijklmnopqrstuvwxyz"
    base = low + low.upper() + digits
    out = []
    texts = [t for t in texts or () if t.strip()]
    for text in texts:
        out += [(text, a, b, 0) for a, b in find(text) if text[a:b].isalpha()]
    out = out[: n // 10]

    def about() -> str:
        """A stretch of a text, or a few words."""
        if not texts:
            return f"{rng.choice(DICTIONARY)} {rng.choice(DICTIONARY)} "
        text = rng.choice(texts)
        at = rng.randrange(len(text))
        return text[at : at + rng.randint(0, 120)] + rng.choice([" ", "\n", "\n", ". "])

    for k in range(n):
        label = k % 2
        word = rng.choice(DICTIONARY)
        if label:
            value = rng.choice([
                lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: pick(hexes, 40).upper(), lambda: pick(base, rng.randint(16, 48)),
                lambda: rng.choice(["AKIA", "ASIA"]) + pick(low.upper() + digits, 16), lambda: rng.choice(["ghp_", "gho_", "npm_", "hf_"]) + pick(base, 36), lambda: pick(base + "+/", 40) + "=",
                lambda: rng.choice(["xoxb-", "xoxp-"]) + "-".join([pick(digits, 11), pick(digits, 12), pick(base, 24)]), lambda: "glpat-" + pick(base + "_-", 20),
                lambda: rng.choice(["sk_live_", "rk_live_"]) + pick(base, 24), lambda: "AIza" + pick(base + "_-", 35), lambda: "eyJ" + pick(base, 30) + "." + pick(base, 60) + "." + pick(base + "_-", 43),
                lambda: pick(base + "!#$%&*", rng.randint(9, 18)), lambda: pick(base, rng.randint(8, 15)),
                lambda: pick(low, rng.randint(4, 8)) + pick(digits, rng.randint(2, 4)) + pick(low, rng.randint(0, 1)),
            ])()
            name = rng.choice(SECRET_NAMES[:12])
            name = rng.choice([name, name, f"{rng.choice(DICTIONARY)}_{name}", rng.choice(DICTIONARY) + name.title(), f"{name}_{rng.choice(['key', 'value', 'prod', '2'])}", f"db.{name}"])
            lead = rng.choice([f'{name} = "', f"{name}: ", f"{name.upper()}=", f'"{name}": "', f"my {name} is ", f'{word} {name} = "'])
            tail = ""
            if _KNOWN.match(value) and rng.random() < 0.7:  # known by its format alone
                lead = rng.choice(["", f"{word} ", "use ", "-H '", "("])
            elif rng.random() < 0.15:
                value = value.translate({ord(c): "x" for c in "/#@"})
                lead, tail = f"{rng.choice(['postgres', 'https', 'redis', 'mongodb+srv', 'amqp'])}://{rng.choice(DICTIONARY)}:", f"@{word}.example.com/"
        else:
            tail = ""
            value, lead = rng.choice([
                lambda: (pick(hexes, 40), rng.choice(["commit ", "revision: ", "sha1 = "])),
                lambda: (pick(hexes, 64), rng.choice(["sha256: ", 'integrity "', "checksum = "])),
                lambda: ("-".join(pick(hexes, w) for w in (8, 4, 4, 4, 12)), rng.choice(["uuid: ", "id = ", 'guid="'])),
                lambda: ("/" + "/".join(rng.choice(DICTIONARY) for _ in range(rng.randint(4, 7))), rng.choice(["path = ", "see ", "from "])),
                lambda: ("".join(rng.choice(DICTIONARY).title() for _ in range(rng.randint(4, 7))), rng.choice(["class ", "new ", "the "])),
                lambda: ("_".join(rng.choice(DICTIONARY) for _ in range(rng.randint(4, 6))), rng.choice(["token = ", "call ", "password: "])),
                lambda: (rng.choice(["x", "*", "0"]) * rng.randint(8, 30), rng.choice(["password = ", "token: ", 'secret="'])),
                lambda: (rng.choice(["changeme", "your_token_here", "example_password", "insert-key-here", "os.environ.get"]), rng.choice(["password = ", 'token = "', "secret: "])),
                lambda: ("".join(rng.choice(["th", "er", "on", "an", "re", "st", "ung", "che", "ion", "ar", "os"]) for _ in range(rng.randint(8, 14))), rng.choice([word + " ", "the ", ""])),
                lambda: (
                    rng.choice(["changeme", "your_" + rng.choice(DICTIONARY), "example_" + rng.choice(DICTIONARY), rng.choice(DICTIONARY) + "." + rng.choice(DICTIONARY), rng.choice(DICTIONARY) + rng.choice(DICTIONARY)]),
                    rng.choice(["DB_PASSWORD=", 'client_secret = "', '"dbPassword": "', "userToken = ", "secret_key: "]),
                ),
                lambda: ("www." + rng.choice(DICTIONARY) + rng.choice(DICTIONARY) + ".example.com/" + word, "https://"),
                lambda: (".".join(rng.choice(DICTIONARY) for _ in range(rng.randint(4, 6))), rng.choice(["import ", "from ", "package "])),
                lambda: ("AAAA" + pick(base + "+/", 60) + "==", rng.choice(["ssh-rsa ", "image/png;base64,", "sha256-"])),
            ])()
            if rng.random() < 0.06:
                value, lead, tail = rng.choice(["password", "pass", "user", "xxxx", "secret", "changeme", "${PASSWORD}"]), "postgres://user:", "@host/db"
        head = about() + lead
        out.append((head + value + (tail or rng.choice(['"', " ", ", ", "\n"])) + about(), len(head), len(head) + len(value), label))
    return out


class Trained(NamedTuple):
    """A forest and the dictionary that its findings are described with."""

    forest: RandomForestClassificationModel
    words: frozenset[str]


def train(
    docs: DataFrame, findings: list[tuple[str, int, int, int]] | None = None, text_col: str = "text", id_col: str = "doc_id", most_excerpts: int = 500, trees: int = 40, depth: int = 8
) -> Trained:
    """A random forest over labelled findings; those made here stand in ``most_excerpts`` documents at most."""
    words = corpus_words(docs, text_col)
    findings = labelled_findings(excerpts(docs, text_col, id_col, most_excerpts)) if findings is None else findings
    known = Words(words)
    rows = [(describe(t, s, e, known), float(y)) for t, s, e, y in findings]
    table = docs.sparkSession.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    return Trained(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(table), words)


def scan(docs: DataFrame, trained: Trained | None = None, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Findings of all documents.

    Returns ``id_col``, ``start``, ``end`` (code points, end exclusive),
    ``finding_sha256``, ``probability``, ``is_secret``.  The values themselves
    are not returned.
    """
    ship_package(docs.sparkSession)
    forest, words = trained or train(docs, text_col=text_col, id_col=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known = Words(shared.value)
        for batch in batches:
            rows, out = [], [[], [], [], []]
            for k, text in enumerate(batch.column(1).to_pylist()):
                for start, end, credential in candidates(text):
                    rows.append(k)
                    for column, value in zip(out, (start, end, hashlib.sha256(text[start:end].encode()).hexdigest(), describe(text, start, end, known, credential))):
                        column.append(value)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.float64())),
                ],
                names=["id", "start", "end", "finding_sha256", "f"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    found = rows.mapInArrow(work, f"id {kind}, start int, end int, finding_sha256 string, f array<double>")
    scored = forest.transform(found.withColumn("features", array_to_vector("f")))
    return scored.select(
        F.col("id").alias(id_col), "start", "end", "finding_sha256", F.round(vector_to_array("probability")[1], 6).alias("probability"),
    ).withColumn("is_secret", F.col("probability") >= threshold)
