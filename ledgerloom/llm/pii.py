"""Personal data by patterns, checksums and context words, in SQL functions only.

Regular expressions propose spans.  Checksums confirm them: Luhn for card
numbers, mod 97 for bank accounts (IBAN, of the length that the country sets),
the part range for addresses of machines, the digit count for telephones.
Words near a span move its score up or down.  The base kinds are reported
whatever their score; an added kind (bank accounts, national telephone numbers)
counts only if its score reaches ``least_score``, so a national number needs a
word such as "tel" near it.  Everything stays inside Spark's own expressions.

A pattern's positions come from cutting the text at its matches: the pieces
between matches and the matches alternate, so running lengths give the offsets
in code points.  Patterns cannot rescan a run of characters, running lengths
take n log n steps, and masking looks up pieces in stretches of the text, so one
very long word, one very long text and one text of very many matches all cost
time about in proportion to their length.

Null and empty texts have no spans.  Repeated rows, and rows with a null id,
are each reported.  Extra columns, whatever their names, are kept by ``mask``
and ignored by ``find_spans``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The length of a bank account number by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, codes in IBAN_LENGTHS.items())
# The patterns of the contract.  Where a run of characters could
# be entered in its middle, a look-behind (or the end of the match before)
# keeps the search at the start of the run; the matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "tel": r"(?<![A-Za-z0-9+.,:/-])\(?0[1-9][0-9]{0,3}\)?(?:[\x20./-]?[0-9]){6,8}(?![A-Za-z0-9]|[.,:/-][0-9])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
# How sure a confirmed span of a kind is before any word near it is read.
CERTAINTY = {"email": 0.6, "ip": 0.6, "card": 0.6, "phone": 0.6, "iban": 0.6, "tel": 0.3}
# Words that make a span of the kind more likely, and words that speak against it.
CONTEXT = {
    "email": "mail|contact|write|courriel|correo|schreib",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|carte|karte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|telefon|appel",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "tel": "phone|call|tel|fax|mobile|telefon|appel|ruf",
}
AGAINST = "version|serial|isbn|order no|build|release"
_BEFORE, _AFTER = 40, 20
_STRETCH = 1024


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn checksum: from the right, every second digit doubled, sum divisible by ten."""
    ordered = F.split(F.reverse(digits), "")

    def value(d: Column, k: Column) -> Column:
        doubled = d.cast("int") * 2
        return F.when(k % 2 == 0, d.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    kept = F.filter(ordered, lambda d: d != "")
    return F.aggregate(F.transform(kept, value), F.lit(0), lambda total, x: total + x) % 10 == 0


def iban_ok(match: Column) -> Column:
    """Mod-97 check: four leading characters go last, letters count from ten, remainder one."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    kept = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(kept, F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        parts = F.split(match, "\\.")
        # Leading zeros carry no value; more than three significant digits exceed 255.
        plain = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn_ok(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return iban_ok(match)
    if kind == "tel":
        return F.length(digits).between(9, 12)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join) -> Column:
    """Running totals of a filled array under ``join``, by doubling: n log n steps."""
    spans = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int")), lambda j: F.pow(F.lit(2), j).cast("int"))
    return F.aggregate(spans, values, lambda acc, span: F.transform(acc, lambda x, i: F.when(i >= span, join(x, F.get(acc, i - span))).otherwise(x)))


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.substring(before, -_BEFORE, _BEFORE), F.lit("\n"), F.substring(after, 1, _AFTER)))
    score = F.lit(CERTAINTY[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), 0.3).otherwise(0.0)
    return F.round(score - F.when(near.rlike(rf"\b(?:{AGAINST})\b"), 0.3).otherwise(0.0), 2)


def _spans(kind: str, text: Column, rank: int, least_score: float) -> Column:
    """Confirmed spans of a kind: array of (start, rank, end, kind, score).

    A span's context is what stands before it, up to 40 characters and no
    further than the match before, and 20 characters after it.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pieces: Column) -> Column:
        rows = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after")))
        ends = _running(F.transform(rows, lambda r: F.length(r["before"]) + F.length(r["m"])), lambda x, y: x + y)
        return F.zip_with(rows, ends, lambda r, e: F.when(
            _confirmed(kind, r["m"]),
            F.struct(
                (e - F.length(r["m"])).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"),
                _score(kind, r["before"], r["after"]).alias("score"),
            ),
        ))

    kept = F.filter(_let(F.split(text, pattern, -1), placed), lambda s: s.isNotNull() & (s["score"] >= (0.0 if kind in BASE_KINDS else least_score)))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    # Most texts hold no match of a kind: then neither cut nor scored.
    return F.when(F.size(found) > 0, kept).otherwise(empty)


def _all_spans(text: Column, least_score: float) -> Column:
    return F.array_sort(F.concat(*[_spans(kind, text, rank, least_score) for rank, kind in enumerate(PATTERNS)]))


def find_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_score: float = 0.5) -> DataFrame:
    """Spans of each document.

    Returns ``id_col`` and ``spans``: array of (start, rank, end, kind, score),
    by start, then by kind as listed; code points, end exclusive.
    """
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return texts.select(id_col, _all_spans(F.col("t"), least_score).alias("spans"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans, ordered by start, replaced; those that overlap as one."""
    ends = _running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))

    def joined(ends: Column) -> Column:
        # A span that starts where nothing before it reaches opens a new mask; what lies between is kept.
        opened = F.filter(
            F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"), s["start"].alias("to"), s["kind"].alias("kind"))),
            lambda g: g["to"] >= g["at"],
        )
        last = F.struct(F.array_max(ends).alias("at"), F.length(text).alias("to"), F.lit(None).cast("string").alias("kind"))
        stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_STRETCH}}}"), F.lit(0))
        return _let(stretches, lambda cut: F.array_join(F.transform(F.concat(opened, F.array(last)), lambda g: F.concat(_piece(cut, g["at"], g["to"]), F.coalesce(F.concat(F.lit("<"), g["kind"], F.lit(">")), F.lit("")))), ""))

    return _let(ends, joined)


def _piece(cut: Column, at: Column, to: Column) -> Column:
    """Characters ``at`` to ``to`` of a text that is cut into stretches of equal length."""
    first, last = F.floor(at / _STRETCH).cast("int"), F.floor(F.greatest(to - 1, at) / _STRETCH).cast("int")
    head = F.substring(F.coalesce(F.get(cut, first), F.lit("")), at % _STRETCH + 1, F.least(to - at, F.lit(_STRETCH)))
    middle = F.when(last - first > 1, F.array_join(F.slice(cut, first + 2, last - first - 1), "")).otherwise("")
    tail = F.when(last > first, F.substring(F.get(cut, last), F.lit(1), to - last * _STRETCH)).otherwise("")
    return F.concat(head, middle, tail)


def mask(docs: DataFrame, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The documents, each span replaced by its kind in angle brackets.

    Spans that overlap are masked as one, named after the first of them.  All
    columns stay; a null text stays null.
    """
    name, text = _free(docs, "spans"), F.col(text_col).cast("string")
    found = docs.select("*", _all_spans(F.coalesce(text, F.lit("")), least_score).alias(name))
    return found.withColumn(text_col, F.when(F.size(name) > 0, _masked(text, F.col(name))).otherwise(text)).drop(name)


def span_digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_score: float = 0.5) -> DataFrame:
    """Counts and digest of the base spans, the text of all spans, and their scores, by document."""
    found = find_spans(docs, text_col, id_col, least_score)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])

    def count(kind: str) -> Column:
        return (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        *[count(k) for k in PATTERNS if k not in BASE_KINDS], F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
