"""Mutations as functions from old state (and changes) to new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WATCHED = ["annee", "statut", "montant_ht", "montant_engage", "montant_realise"]


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Incoming rows replace those of the same keys, but for the columns in ``keep``; others are added."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("_neu"))
    joined = table.withColumn("_alt", F.lit(True)).join(new, keys, "full")

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(c)
        replace = F.col("_neu") & (F.col("_alt").isNull() if c in keep else F.lit(True))
        return F.when(replace, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *[value(c) for c in table.columns if c not in keys])


def insert_ignore(table: DataFrame, incoming: DataFrame, keys: list[str], order: str, applies: Column | None = None) -> DataFrame:
    """Add incoming rows whose keys are neither known nor null; the first of equal keys wins.

    Keys that hold a null never conflict; neither do rows outside ``applies``
    (a partial unique index).
    """
    bound = F.lit(True) if applies is None else applies
    for k in keys:
        bound = bound & F.col(k).isNotNull()
    free = incoming.filter(~F.coalesce(bound, F.lit(False)))
    first = Window.partitionBy(*keys).orderBy(order)
    once = incoming.filter(bound).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    known = table.filter(bound).select(*keys)
    return table.unionByName(once.join(known, keys, "left_anti").select(*table.columns)).unionByName(free.select(*table.columns))


def reseed(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Generated rows that nobody has edited give way to incoming ones."""
    untouched = (F.col("origine") == "ia") & F.col("modifie_le").isNull()
    return table.filter(~untouched).unionByName(incoming)


def figer_baseline(occurrence: DataFrame, mode: str) -> DataFrame:
    """Current amounts and years become the baseline: only where missing, or everywhere."""
    active = F.col("statut") != "supprime"
    target = active if mode == "ecraser" else active & F.col("montant_initial").isNull()
    return occurrence.withColumn("annee_initiale", F.when(target, F.col("annee")).otherwise(F.col("annee_initiale"))).withColumn(
        "montant_initial", F.when(target, F.col("montant_ht")).otherwise(F.col("montant_initial")))


def total_baseline(occurrence: DataFrame) -> DataFrame:
    """Count and sum of all active rows, per project, as the freeze history keeps them."""
    return occurrence.filter("statut <> 'supprime'").groupBy("projet_id").agg(F.count("*").alias("nb_occurrences"), F.coalesce(F.sum("montant_initial"), F.lit(0)).alias("total_ht"))


def capture_changes(old: DataFrame, new: DataFrame, motif: str | None = None, author: str | None = None, fields: list[str] = WATCHED) -> DataFrame:
    """One event per changed field of each row; both values as text."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("id", *(["projet_id"] if p == "n" else []), *[F.col(f).cast("string").alias(f"{p}_{f}") for f in fields])

    pairs = F.array(*[F.struct(F.lit(f).alias("champ"), F.col(f"o_{f}").alias("ancienne_val"), F.col(f"n_{f}").alias("nouvelle_val")) for f in fields])
    changed = F.filter(pairs, lambda p: ~p["ancienne_val"].eqNullSafe(p["nouvelle_val"]))
    # As the session setting that carries them, absent reason and author are empty, not null.
    return side(old, "o").join(side(new, "n"), "id").select(F.col("id").alias("occurrence_id"), "projet_id", F.explode(changed).alias("e")).select(
        "occurrence_id", "projet_id", "e.*", F.lit(motif or "").alias("motif"), F.lit(author or "").alias("modifie_par"))


def label_latest(events: DataFrame, label: str) -> DataFrame:
    """Give the latest event of each occurrence and field a reason, if it has none."""
    blank = F.coalesce("motif", F.lit("")) == ""
    order = Window.partitionBy("occurrence_id", "champ", blank).orderBy(F.desc("modifie_le"), F.desc("id"))
    first = blank & (F.row_number().over(order) == 1)
    return events.withColumn("_premier", first).withColumn("motif", F.when(F.col("_premier"), F.lit(label)).otherwise(F.col("motif"))).drop("_premier")


def justify(events: DataFrame, occurrence: DataFrame, ids: DataFrame, label: str, author: str) -> DataFrame:
    """Justify occurrences: the latest unlabelled event of the first field that has one, else a new event."""
    rank = F.array_position(F.array(*map(F.lit, ["montant_ht", "montant_engage", "montant_realise", "annee", "statut"])), F.col("champ"))
    blank = events.filter(F.coalesce("motif", F.lit("")) == "").join(ids, "occurrence_id", "left_semi")
    order = Window.partitionBy("occurrence_id").orderBy(rank, F.desc("modifie_le"), F.desc("id"))
    chosen = blank.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("id", F.lit(True).alias("_choisi"), F.col("occurrence_id").alias("_occ"))
    labelled = events.join(chosen, "id", "left").withColumn("motif", F.when(F.col("_choisi"), F.lit(label)).otherwise(F.col("motif"))).drop("_choisi", "_occ")
    added = ids.join(chosen.select(F.col("_occ").alias("occurrence_id")), "occurrence_id", "left_anti").join(
        occurrence.select(F.col("id").alias("occurrence_id"), "projet_id", "montant_initial", "montant_ht"), "occurrence_id")
    synthetic = added.select(
        "occurrence_id", "projet_id", F.lit("montant_ht").alias("champ"), F.col("montant_initial").cast("string").alias("ancienne_val"), F.col("montant_ht").cast("string").alias("nouvelle_val"),
        F.lit(label).alias("motif"), F.lit(author).alias("modifie_par"))
    return labelled.unionByName(synthetic, allowMissingColumns=True)


def next_version(rapport: DataFrame, wanted: DataFrame) -> DataFrame:
    """New snapshots with the version after the highest known one, from 1 on."""
    known = rapport.groupBy("projet_id", "annee").agg(F.max("version").alias("derniere"))
    return wanted.join(known, ["projet_id", "annee"], "left").withColumn("version", (F.coalesce("derniere", F.lit(0)) + 1).cast("int")).drop("derniere")


def illegal_changes(old: DataFrame, new: DataFrame, free: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Validated reports whose protected columns differ between two states."""
    columns = [c for c in old.columns if c not in ("id", *free)]
    before = old.filter("statut = 'valide'").select("id", *[F.col(c).alias(f"o_{c}") for c in columns])
    differs = [F.when(~F.col(f"o_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns]
    return before.join(new, "id").select("id", F.array_compact(F.array(*differs)).alias("colonnes")).filter(F.size("colonnes") > 0)


def fill_by_name(occurrence: DataFrame, prestataire: DataFrame) -> DataFrame:
    """Contractor ids from free-text names, whatever their case and outer spaces."""
    names = prestataire.groupBy(F.lower(F.trim("nom")).alias("_nom")).agg(F.min("id").alias("_id"))
    joined = occurrence.join(names, F.lower(F.trim(occurrence["prestataire"])) == names["_nom"], "left")
    return joined.withColumn("prestataire_id", F.coalesce("prestataire_id", "_id")).drop("_nom", "_id")


def remove(table: DataFrame, ids: DataFrame, soft: bool = True) -> DataFrame:
    """Soft removal marks rows as deleted; hard removal drops them."""
    if not soft:
        return table.join(ids, "id", "left_anti")
    marked = table.join(ids.select("id", F.lit(True).alias("_weg")).distinct(), "id", "left")
    return marked.withColumn("statut", F.when(F.col("_weg"), F.lit("supprime")).otherwise(F.col("statut"))).drop("_weg")


def update_where(table: DataFrame, condition: Column, values: dict[str, Column], allowed: set[str]) -> DataFrame:
    """Set allowed columns where a condition holds; other names are refused."""
    refused = set(values) - allowed
    if refused:
        raise ValueError(f"columns may not be changed: {sorted(refused)}")
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def appliquer(table: DataFrame, changes: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Create, update and delete rows after validation: (new table, refused changes).

    ``changes`` holds ``op`` (``creer``, ``modifier`` or ``supprimer``), ``id``
    (one change an id) and columns of the table; in an update a null leaves the
    old value.  A change is refused as ``existe`` or ``introuvable``, or under
    the first of ``rules`` (code: what makes new values invalid) that holds.
    """
    known = changes.join(table.select("id", F.lit(True).alias("_da")), "id", "left")
    new = F.col("op") == "creer"
    broken = [F.when((F.col("op") != "supprimer") & F.coalesce(test, F.lit(False)), code) for code, test in rules.items()]
    checked = known.withColumn("erreur", F.coalesce(F.when(new & F.col("_da"), "existe"), F.when(~new & F.col("_da").isNull(), "introuvable"), *broken))
    good = checked.filter("erreur is null")
    columns = [c for c in table.columns if c != "id"]
    carried = [c for c in columns if c in changes.columns]
    joined = table.join(good.select("id", F.col("op").alias("_op"), *[F.col(c).alias(f"_{c}") for c in carried]), "id", "full")
    left = joined.filter("_op is null or _op <> 'supprimer'")
    values = [F.coalesce(f"_{c}", c).alias(c) if c in carried else F.col(c) for c in columns]
    return left.select("id", *values).select(*table.columns), checked.filter("erreur is not null").select("id", "op", "erreur")


def verser_exports(projet: DataFrame, export: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patch the export history, and lock the names of the projects of which an export is handed in.

    ``patches`` (id, statut, verse_le, commentaire): nulls leave the old value.
    Returns (projects with ``nom_verrouille``, exports).
    """
    fields = ["statut", "verse_le", "commentaire"]
    joined = export.join(patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    patched = joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in export.columns])
    handed_in = patches.filter("statut = 'verse'").join(export.select("id", "projet_id"), "id").select(F.col("projet_id").alias("id"), F.lit(True).alias("_verse")).distinct()
    locked = projet.join(handed_in, "id", "left").withColumn("nom_verrouille", F.col("nom_verrouille") | F.coalesce("_verse", F.lit(False))).drop("_verse")
    return locked.select(*projet.columns), patched


def renommer(projet: DataFrame, names: DataFrame) -> DataFrame:
    """New export names (id, nom_export); a locked name stays, and a try to change it is told in ``refus``."""
    joined = projet.join(names.select("id", F.col("nom_export").alias("_nom")), "id", "left")
    refused = F.col("nom_verrouille") & F.col("_nom").isNotNull() & ~F.col("_nom").eqNullSafe(F.col("nom_export"))
    return joined.withColumn("refus", refused).withColumn("nom_export", F.when(refused, F.col("nom_export")).otherwise(F.coalesce("_nom", "nom_export"))).drop("_nom")


def supprimer_avec_trace(table: DataFrame, ids: DataFrame, journal: DataFrame, action: str, author: str) -> tuple[DataFrame, DataFrame]:
    """Drop rows, and append one audit entry (action, cible_id, auteur) for each row that was there."""
    gone = table.join(ids.select("id"), "id", "left_semi").select(F.lit(action).alias("action"), F.col("id").alias("cible_id"), F.lit(author).alias("auteur"))
    return table.join(ids.select("id"), "id", "left_anti"), journal.unionByName(gone)
