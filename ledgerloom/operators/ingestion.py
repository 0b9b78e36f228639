"""Loading a project: staged runs with checkpoints, counters and status rows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.mutations import insert_ignore, reseed, upsert


def project_from_metadata(metadata: DataFrame, today: dt.date, keep: tuple[str, ...] = ()) -> DataFrame:
    """New project rows from extracted metadata, with fallbacks for what is missing; ``keep`` names columns that stay."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return metadata.select(
        *keep, F.coalesce(blank("nom"), blank("nom_operation"), F.lit("Projet sans nom")).alias("nom"), F.coalesce(blank("reference_interne"), F.concat(F.lit("REF-"), F.date_format(F.lit(today), "yyyyMMdd"))).alias("reference_interne"),
        F.try_element_at("communes", F.lit(1)).alias("commune"), F.coalesce(F.col("duree_ans"), F.col("annee_fin") - F.col("annee_debut") + 1).cast("int").alias("duree_annees"),
    )


def seed(tables: dict[str, DataFrame], incoming: dict[str, DataFrame], replace: bool) -> dict[str, DataFrame]:
    """New states of all tables that one load touches, in order.

    Metadata and sheets are replaced by key, rules keep what users may have
    edited, generated occurrences are inserted unless they are known.  Plain
    files have no transaction over several tables: write all new states, then
    switch to them.
    """
    occurrences = tables["occurrence"]
    if replace:
        occurrences = reseed(occurrences, occurrences.limit(0))
    return {
        "metadata": upsert(tables["metadata"], incoming["metadata"], ["projet_id"]),
        "fiche": upsert(tables["fiche"], incoming["fiche"], ["projet_id", "cle"]),
        "echeance": upsert(tables["echeance"], incoming["echeance"], ["projet_id", "cle"], keep=["code_operation", "fenetre_debut", "fenetre_fin"]),
        "occurrence": insert_ignore(occurrences, incoming["occurrence"], ["echeance_id", "annee"], "id", F.col("origine") == "ia"),
    }


def import_counters(before: DataFrame, incoming: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a load offered, added and left out."""
    n = [df.agg(F.count("*").alias(name)) for df, name in ((before, "avant"), (incoming, "recues"), (after, "apres"))]
    return n[0].crossJoin(n[1]).crossJoin(n[2]).select("recues", (F.col("apres") - F.col("avant")).alias("inserees"), (F.col("recues") - F.col("apres") + F.col("avant")).alias("ignorees"))


def budget_rows(lines: DataFrame, projet_id: int) -> DataFrame:
    """Budget lines as stored: default label, only whole source rows, digest of the content."""
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(lines.columns)]), {"ignoreNullFields": "false"})
    return lines.select(
        F.lit(projet_id).alias("projet_id"), "rang", F.coalesce(F.nullif(F.trim("libelle_prestation"), F.lit("")), F.lit("(sans libellé)")).alias("libelle_prestation"), "montant_ht", "feuille",
        F.coalesce("est_total", F.lit(False)).alias("est_total"), F.transform(F.filter("source_lignes", lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int")).alias("source_lignes"), F.sha2(content, 256).alias("empreinte"),
    )


def evolve(table: DataFrame, renames: dict[str, str] = {}, defaults: dict[str, str] = {}, drops: tuple[str, ...] = ()) -> DataFrame:  # noqa: B006
    """Idempotent schema changes: rename or merge columns, add missing ones, drop old ones.

    Where both the old and the new name exist, the new one is filled from the old.
    """
    for old, new in renames.items():
        if old in table.columns and new in table.columns:
            table = table.withColumn(new, F.coalesce(new, old)).drop(old)
        elif old in table.columns:
            table = table.withColumnRenamed(old, new)
    for name, kind in defaults.items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    return table.drop(*drops)


class StagedRun:
    """Named stages whose results are written once; a rerun resumes after the last finished one.

    Status rows (run, stage, state, detail, time) go to ``<folder>/_status``.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str):
        self.spark, self.folder, self.run = spark, folder, run

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)

    def note(self, stage: str, state: str, detail: str = "") -> None:
        row = [(self.run, stage, state, detail, dt.datetime.now(dt.timezone.utc).isoformat())]
        self.spark.createDataFrame(row, "run string, stage string, state string, detail string, at string").coalesce(1).write.mode("append").json(f"{self.folder}/_status")

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._exists(path):
            self.note(name, "running")
            try:
                make().write.mode("overwrite").parquet(path)
            except Exception as e:
                self.note(name, "error", f"{type(e).__name__}: {str(e)[:200]}")
                raise
            self.note(name, "done")
        return self.spark.read.parquet(path)

    def status(self, lines: bool = False) -> DataFrame:
        """Latest state of each stage; with ``lines``, and how many rows the finished ones hold."""
        rows = self.spark.read.schema("run string, stage string, state string, detail string, at string").json(f"{self.folder}/_status")
        state = rows.filter(F.col("run") == self.run).groupBy("stage").agg(F.max_by(F.struct("state", "detail"), "at").alias("s")).select("stage", "s.*")
        if not lines:
            return state
        written = [r.stage for r in state.filter("state = 'done'").select("stage").collect()]  # a handful of names
        counts = [self.spark.read.parquet(f"{self.folder}/{n}").agg(F.lit(n).alias("stage"), F.count("*").alias("lignes")) for n in written]
        return state.join(reduce(DataFrame.unionByName, counts), "stage", "left") if counts else state.withColumn("lignes", F.lit(None).cast("long"))


def replace_partitions(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Rewrite only those partitions of a table that ``rows`` has rows in; files of all others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def run_batch(items: DataFrame, column: str, work: Callable[[object], str]) -> DataFrame:
    """Work off a table of items in tasks; one item's failure does not stop the others.

    ``work`` takes the value of ``column`` (None where it is null) and returns a
    text.  Adds ``resultat`` and ``erreur``, of which a failed item has only the
    second; items that occur twice are worked off twice.
    """
    def attempt(value: object) -> tuple[str | None, str | None]:
        try:
            return work(value), None
        except Exception as e:  # each item's error is reported, not swallowed
            return None, f"{type(e).__name__}: {e}"

    def batches(parts):
        for part in parts:
            outcomes = [attempt(v) for v in part.column(column).to_pylist()]
            for name, k in (("resultat", 0), ("erreur", 1)):
                part = part.append_column(name, pa.array([o[k] for o in outcomes], pa.string()))
            yield part

    schema = T.StructType([*items.schema.fields, T.StructField("resultat", T.StringType()), T.StructField("erreur", T.StringType())])
    return items.mapInArrow(batches, schema)


def audit(action: str, projet_id: int, target: str, detail: dict, spark: SparkSession) -> DataFrame:
    """One row for the audit log."""
    return spark.createDataFrame([(action, projet_id, target, json.dumps(detail, sort_keys=True))], "action string, projet_id long, cible string, detail string")
