"""Scalar functions, all as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Departments whose official projection is not that of the mainland.
OVERSEAS_SRID = {"974": 2975, "971": 5490, "972": 5490, "973": 3857, "976": 4471}
MAINLAND_SRID = 2154
_TYPOGRAPHIC = "\u202f"


def normalize_ug_id(raw: Column) -> Column:
    """Letters and digits in lower case; nothing left is null."""
    return F.nullif(F.lower(F.regexp_replace(raw, "[^a-zA-Z0-9]", "")), F.lit(""))


def normalize_ug_ids(values: Column, ordered: bool = True) -> Column:
    """Distinct normalised ids: sorted, or in the order of first appearance."""
    kept = F.array_distinct(F.filter(F.transform(values, normalize_ug_id), lambda x: x.isNotNull()))
    return F.array_sort(kept) if ordered else kept


def normalize_siret(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(raw, "[^0-9]", ""), F.lit(""))


def normalize_code(raw: Column) -> Column:
    """Upper case without spaces."""
    return F.upper(F.trim(F.replace(raw, F.lit(" "), F.lit(""))))


def display_code(code: Column) -> Column:
    """``TU3`` as ``TU 3``; other shapes stay."""
    return F.regexp_replace(code, r"^([A-Z]+)\s*(\d+)$", "$1 $2")


def known_theme(value: Column, catalogue: list[str]) -> Column:
    """The value if the catalogue holds it, else ``autre``."""
    trimmed = F.trim(value)
    return F.when(trimmed.isin(*catalogue), trimmed).otherwise("autre")


def first_theme(*values: Column) -> Column:
    """First value that is neither empty nor ``autre``; ``autre`` if there is none."""
    return F.coalesce(*[F.nullif(F.nullif(v, F.lit("")), F.lit("autre")) for v in values], F.lit("autre"))


def preview(text: Column, width: int = 120) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.concat(F.left(text, F.lit(width)), F.when(F.length(text) > width, "…").otherwise(""))


def fit(text: Column, width: int) -> Column:
    """Trimmed text (``-`` if empty) cut to a width, and whether it was cut."""
    kept = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("-"))
    return F.struct(F.left(kept, F.lit(width)).alias("texte"), (F.length(kept) > width).alias("tronque"))


def join_targets(values: Column) -> Column:
    """Non-blank entries, trimmed, joined by a bar; ``-`` if there are none."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "|")).otherwise("-")


def _ascii_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that have an ASCII form under compatibility decomposition, by that rule: single ones and longer ones."""
    found = [(chr(k), unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode()) for k in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]]
    single = [(c, plain) for c, plain in found if len(plain) == 1]
    return "".join(c for c, _ in single), "".join(p for _, p in single), [(c, p) for c, p in found if len(p) > 1]


_LETTERS, _PLAIN, _LONGER = _ascii_table()


def to_ascii(text: Column) -> Column:
    """Latin text without its accents; what has no ASCII form is left out."""
    plain = F.translate(text, _LETTERS, _PLAIN)
    for letter, longer in _LONGER:
        plain = F.replace(plain, F.lit(letter), F.lit(longer))
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def slugify(text: Column, width: int = 40) -> Column:
    """ASCII letters and digits joined by underscores."""
    joined = F.regexp_replace(F.regexp_replace(to_ascii(text), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.left(joined, F.lit(width)), "_+$", "")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def object_path(*parts: Column) -> Column:
    """Non-null parts as a storage path."""
    return F.concat_ws("/", *parts)


def department_srid(department: Column) -> Column:
    """Projection of a department: mainland, overseas, or null if unknown."""
    code = F.upper(F.trim(department))
    mapped = F.coalesce(*[F.when(code == k, v) for k, v in OVERSEAS_SRID.items()])
    return F.when(code.isin("2A", "2B") | code.rlike("^[0-9]{1,2}$"), MAINLAND_SRID).otherwise(mapped)


def effective_end_year(year: Column, first_month: Column, last_month: Column) -> Column:
    """The year after if the window crosses the new year."""
    return F.when(first_month > last_month, year + 1).otherwise(year)


def deadline(year: Column, first_month: Column, last_month: Column) -> Column:
    """Last day of the window's last month (December if neither month is known)."""
    month = F.coalesce(last_month, first_month, F.lit(12))
    return F.last_day(F.make_date(effective_end_year(year, first_month, last_month), month, F.lit(1)))


def end_date(start: Column, years: Column) -> Column:
    return F.add_months(start, years * 12)


def month_of(mmdd: Column) -> Column:
    """Month of ``MM-DD``; null unless it is from 1 to 12."""
    value = F.split(mmdd, "-")[0].try_cast("int")
    return F.when(value.between(1, 12), value)


def money(value: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(value.cast("decimal(28,10)"), 2).cast("decimal(18,2)")


def euros(value: Column, signed: bool = False, short: bool = False) -> Column:
    """French display of an amount; ``—`` for null, tens of thousands as k€ if short."""
    def grouped(number: Column, decimals: int) -> Column:
        return F.translate(F.translate(F.format_number(number, decimals), ",", _TYPOGRAPHIC), ".", ",")

    text = F.concat(grouped(value, 0), F.lit(f"{_TYPOGRAPHIC}€"))
    if short:
        thousands = F.regexp_replace(grouped(value / 1000, 1), ",0$", "")
        text = F.when(F.abs(value) >= 10000, F.concat(thousands, F.lit(" k€"))).otherwise(text)
    sign = F.when(F.lit(signed) & (value > 0), "+").otherwise("")
    return F.coalesce(F.concat(sign, text), F.lit("—"))


def percent(value: Column) -> Column:
    return F.coalesce(F.concat(F.translate(F.format_string("%.1f", value * 100), ".", ","), F.when(value.isNotNull(), f"{_TYPOGRAPHIC}%")), F.lit("—"))


def french_date(value: Column, with_time: bool = False) -> Column:
    return F.coalesce(F.date_format(value, "dd/MM/yyyy 'à' HH'h'mm" if with_time else "dd/MM/yyyy"), F.lit("—"))


# Labels of the report.
STATUT_LABELS = {
    "a_confirmer": "À confirmer", "planifie": "Planifiée", "en_cours": "En cours", "realise": "Réalisée", "repousse": "Reportée", "supprime": "Supprimée",
}
CHAMP_LABELS = {"montant_ht": "Prévu", "montant_engage": "Engagé", "montant_realise": "Réalisé", "statut": "Statut", "annee": "Exercice"}


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; the code itself if it has none."""
    return F.coalesce(*[F.when(code == k, v) for k, v in labels.items()], code)


def journal_value(value: Column, field: Column) -> Column:
    """A logged value for display: amounts formatted, states translated, the rest as it is."""
    shown = F.when(field.isin("montant_ht", "montant_engage", "montant_realise"), euros(value.try_cast("double"))).when(field == "statut", label(value, STATUT_LABELS)).otherwise(value)
    return F.when(F.coalesce(value, F.lit("")) == "", "—").otherwise(shown)


def summary_sentence(year: Column, execution: Column, commitment: Column, moved: Column, cancelled: Column, added: Column) -> Column:
    """The report's opening sentence, from rates and variances."""
    # The wording of the report.
    first = F.when(
        execution.isNotNull(), F.concat(F.lit("En "), year.cast("string"), F.lit(", "), percent(execution), F.lit(" du budget prévu a été facturé")),
    ).otherwise(F.concat(F.lit("En "), year.cast("string"), F.lit(", aucun budget prévu n'est renseigné")))
    second = F.when(commitment.isNotNull(), F.concat(percent(commitment), F.lit(" a été contractualisé")))
    more = F.array_compact(F.array(
        F.when(moved >= 1, F.concat(euros(moved), F.lit(" ont été reportés sur un autre exercice"))),
        F.when(cancelled >= 1, F.concat(euros(cancelled), F.lit(" ont été économisés sur des actions annulées"))),
        F.when(added >= 1, F.concat(euros(added), F.lit(" correspondent à des actions ajoutées après le figeage du budget de référence"))),
    ))
    tail = F.when(F.size(more) > 0, F.concat(F.lit(" Sur l'exercice, "), F.array_join(more, ", "), F.lit("."))).otherwise("")
    return F.concat(F.concat_ws(", ", first, second), F.lit("."), tail)


def json_inside(text: Column) -> Column:
    """What lies from the first opening to the last closing brace; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def is_vertical_sum(formula: Column) -> Column:
    """Whether a sheet formula sums cells of one column downwards."""
    pattern = r"(?i)^=\s*(?:SUM|SOMME)\(\s*\$?([A-Z]+)\$?(\d+)\s*:\s*\$?([A-Z]+)\$?(\d+)\s*\)$"
    part = [F.regexp_extract(formula, pattern, k) for k in range(1, 5)]
    return F.coalesce((part[0] != "") & (F.upper(part[0]) == F.upper(part[2])) & (part[3].try_cast("long") > part[1].try_cast("long")), F.lit(False))


def cell_text(value: Column, number_format: Column) -> Column:
    """Text of a sheet cell: rounding dust removed, unit added, bars escaped."""
    number = value.try_cast("double")
    clean = F.round(number, 6)
    shown = F.when(clean == F.floor(clean), F.floor(clean).cast("string")).otherwise(clean.cast("string"))
    unit = F.when(number_format.contains("%"), "%").when(number_format.contains("€"), " €").otherwise("")
    shown = F.when(number_format.contains("%"), F.round(number * 100, 4).cast("string")).otherwise(shown)
    return F.when(number.isNotNull(), F.concat(shown, unit)).otherwise(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")))


def public_keys(properties: Column) -> Column:
    """A map without its private keys (those that start with an underscore)."""
    return F.map_filter(properties, lambda k, v: ~k.startswith("_"))


def whole_numbers(values: Column) -> Column:
    """Entries of a list of strings that are whole numbers."""
    return F.transform(F.filter(values, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def merge_json_maps(left: Column, right: Column) -> Column:
    """Both maps; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)


def age_in_days(since: Column, now: Column) -> Column:
    return F.floor(F.timestamp_diff("SECOND", since, now) / 86400).cast("int")
