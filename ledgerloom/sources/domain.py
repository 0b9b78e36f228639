"""Domain tables (portfolio of projects) over the driver's star schema.

Money is cast to decimal before any arithmetic, so sums are exact.  Every
property is a lazy DataFrame; Catalyst prunes what a query does not read.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.session import load

AS_OF = dt.date(2000, 6, 30)
MONEY = "decimal(18,2)"
#: Rule thresholds: code, value.
THRESHOLDS = [
    ("bilan_manquant_critique", 2.0), ("retard_critique_ans", 2.0), ("sous_conso_seuil", 0.60), ("sous_conso_critique", 0.40),
    ("derive_seuil_pct", 0.10), ("derive_critique_pct", 0.25), ("silence_mois", 12.0), ("silence_critique_mois", 24.0),
]


class Domain:
    """The domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._schemas: dict[str, StructType] = {}

    def raw(self, table: str) -> DataFrame:
        """A table of the driver; its schema is read from the files once."""
        if table in self._schemas:
            return self.spark.read.schema(self._schemas[table]).parquet(f"{self.sf_dir}/{table}.parquet")
        found = load(self.spark, self.sf_dir, table)
        self._schemas[table] = found.schema
        return found

    @cached_property
    def organisation(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nom"), F.col("n_regionkey").alias("region_id"))

    @cached_property
    def projet(self) -> DataFrame:
        first = self.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").alias("date_decision"))
        k = F.col("c_custkey")
        base = self.raw("customer").join(first, "c_custkey", "left").select(
            k.alias("id"), F.col("c_nationkey").alias("organisation_id"), F.col("c_name").alias("nom"),
            F.concat(F.lit("REF-"), k.cast("string")).alias("reference_interne"), F.col("c_mktsegment").alias("commune"),
            F.lpad((k % 95 + 1).cast("string"), 2, "0").alias("departement"),
            F.when(k % 2 == 0, "derogation").otherwise("autorisation").alias("type_procedure"),
            F.when(k % 17 == 0, "archive").when(k % 19 == 0, "clos").otherwise("actif").alias("statut"),
            "date_decision", (k % 5 + 3).cast("int").alias("duree_annees"),
        )
        created = F.coalesce("date_decision", F.lit(dt.date(1995, 1, 1))).cast("timestamp_ntz")
        return (
            base.withColumn("date_fin", F.add_months("date_decision", F.col("duree_annees") * 12))
            .withColumn("created_at", created)
            .withColumn("updated_at", F.expr("created_at + make_dt_interval(cast(id % 900 as int))"))
        )

    @cached_property
    def occurrence(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_suppkey").alias("prestataire_id"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice").cast(MONEY))).cast(MONEY).alias("montant_realise"),
        )
        k, year, price = F.col("o_orderkey"), F.year("o_orderdate"), F.col("o_totalprice").cast(MONEY)
        kind = F.element_at(F.array(*map(F.lit, ("TE", "TU", "MR", "MC", "AD"))), (k % 5 + 1).cast("int"))
        state = (
            F.when(F.col("o_orderpriority") == "5-LOW", "supprime").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "repousse")
            .when(F.col("o_orderstatus") == "F", "realise").when(F.col("o_orderstatus") == "P", "en_cours").otherwise("planifie")
        )
        base = self.raw("orders").select(
            k.alias("id"), F.col("o_custkey").alias("projet_id"), (k % 200).alias("echeance_id"),
            (year + F.when(k % 8 == 0, 1).otherwise(0)).alias("annee"), year.alias("annee_initiale"), kind.alias("categorie"),
            F.concat(kind, (k % 40).cast("string")).alias("code"), F.concat(F.lit("Action "), (k % 40).cast("string"), F.lit(" de "), year.cast("string")).alias("titre"),
            state.alias("statut"), F.when(k % 10 != 0, price).alias("montant_initial"),
            F.when(k % 7 != 0, (price + (k % 5 - 2).cast("decimal(9,0)") * 1000).cast(MONEY)).alias("montant_ht"),
            F.when(state.isin("realise", "en_cours"), (price - 500).cast(MONEY)).alias("montant_engage"),
            F.when(k % 11 != 0, (k % 12 + 1).cast("int")).alias("mois_debut"), F.when(k % 13 != 0, (k * 7 % 12 + 1).cast("int")).alias("mois_fin"),
            F.when(k % 4 == 0, "").when(k % 4 == 1, "autre").when(k % 4 == 2, "R2.1a").alias("lib_thema"),
            F.array_distinct(F.array(F.concat(F.lit("ug"), (k % 9).cast("string")), F.concat(F.lit("ug"), (k % 5).cast("string")))).alias("ug_ids"),
            F.when(k % 3 == 0, "manuel").otherwise("ia").alias("origine"), F.when(k % 6 != 0, (k % 100) / 100.0).alias("confiance"),
            F.when(k % 4 == 0, F.array(F.lit("montant_ht"))).otherwise(F.array().cast("array<string>")).alias("champs_a_confirmer"),
            F.when(k % 5 != 0, F.expr("o_orderdate + interval 30 days")).alias("modifie_le"),
        )
        return base.join(lines.withColumnRenamed("o_orderkey", "id"), "id", "left")

    @cached_property
    def prestataire(self) -> DataFrame:
        k = F.col("s_suppkey")
        siret = F.when(k % 10 != 0, F.concat(F.lit(" 123 "), F.lpad(k.cast("string"), 6, "0"), F.lit("-00011")))
        return self.raw("supplier").select(
            k.alias("id"), F.col("s_name").alias("nom"), siret.alias("siret"), F.nullif(F.regexp_replace(siret, "[^0-9]", ""), F.lit("")).alias("siret_norm"),
            F.col("s_nationkey").alias("organisation_id"), (F.col("s_acctbal") > 0).alias("actif"),
        )

    @cached_property
    def projet_prestataire(self) -> DataFrame:
        owner = self.raw("orders").select("o_orderkey", "o_custkey")
        lines = self.raw("lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
        pairs = lines.join(owner, lines["l_orderkey"] == owner["o_orderkey"])
        return pairs.select(F.col("o_custkey").alias("projet_id"), F.col("l_suppkey").alias("prestataire_id")).distinct().withColumn("role", F.lit("titulaire"))

    @cached_property
    def journal(self) -> DataFrame:
        """The changes as they are logged, by occurrence; also those of occurrences that are gone."""
        k = F.get_json_object("props", "$.k").cast("int")
        fields = {"view": "annee", "click": "montant_ht", "purchase": "montant_engage", "signup": "montant_realise", "error": "statut"}
        champ = F.coalesce(*[F.when(F.col("event_type") == e, f) for e, f in fields.items()])
        value = F.col("value").cast(MONEY)
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.expr("event_id div 20").alias("occurrence_id"), champ.alias("champ"), value.cast("string").alias("ancienne_val"),
            (value + 10).cast(MONEY).cast("string").alias("nouvelle_val"),
            F.when(k % 3 != 0, F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("motif "), k.cast("string")))).alias("motif"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("modifie_par"), F.expr("ts - interval 24 years").alias("modifie_le"),
        )

    @cached_property
    def mouvement(self) -> DataFrame:
        owner = self.raw("orders").select(F.col("o_orderkey").alias("occurrence_id"), F.col("o_custkey").alias("projet_id"))
        return self.journal.join(owner, "occurrence_id")

    @cached_property
    def rapport(self) -> DataFrame:
        k = F.col("o_orderkey")
        order = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderkey")
        made = F.expr("o_orderdate + interval 400 days")
        return self.raw("orders").select(
            k.alias("id"), F.col("o_custkey").alias("projet_id"), F.year("o_orderdate").alias("annee"), F.row_number().over(order).alias("version"),
            F.when(k % 3 == 0, "brouillon").otherwise("valide").alias("statut"), made.alias("genere_le"),
            F.when(k % 3 != 0, F.expr("o_orderdate + interval 410 days")).alias("valide_le"), F.col("o_totalprice").cast(MONEY).alias("archive_prevu"),
        )

    @cached_property
    def baseline(self) -> DataFrame:
        both = self.raw("customer").select("c_custkey", "c_acctbal", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).filter("(c_custkey + v) % 3 <> 0")
        return both.select(
            F.expr("c_custkey * 2 + v").alias("id"), F.col("c_custkey").alias("projet_id"),
            F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval(cast(c_custkey * (v + 1) % 1000 as int))").alias("figee_le"),
            F.concat(F.lit("Budget v"), F.col("v").cast("string")).alias("libelle"), F.col("c_acctbal").cast(MONEY).alias("total_ht"),
        )

    @cached_property
    def echeance(self) -> DataFrame:
        k = F.col("p_partkey")
        kinds = F.array(*map(F.lit, ("ponctuel", "periodique", "campagnes", "paliers", "dependant_evenement")))
        steps = F.expr("array(named_struct('intervalle_ans', 1, 'nombre_occurrences', 4), named_struct('intervalle_ans', 3, 'nombre_occurrences', 5))")
        return self.raw("part").select(
            k.alias("id"), (k % 100).alias("projet_id"), F.concat(F.lit("E"), k.cast("string")).alias("cle"), F.concat(F.lit("A"), (k % 60).cast("string")).alias("action_cle"),
            F.concat(F.lower(F.substring("p_brand", 1, 2)), F.lit(" "), (k % 30).cast("string")).alias("code_operation"), F.col("p_name").alias("libelle"),
            F.element_at(kinds, (k % 5 + 1).cast("int")).alias("type"), F.when(k % 9 != 0, F.lit(1990) + F.col("p_size")).cast("int").alias("ancrage_annee"),
            (k % 4 + 1 + F.when(k % 2 == 0, 0.5).otherwise(0.0)).cast("double").alias("intervalle_ans"), (k % 6 + 2).cast("int").alias("duree_ans"),
            (k % 3 + 1).cast("int").alias("occurrences_par_an"), F.when(k % 15 == 3, F.slice(steps, 1, 0)).otherwise(steps).alias("paliers"),
            F.when(k % 6 != 0, (k % 100) / 100.0).alias("confiance"), F.split("p_name", " ").alias("unites"),
            F.when(k % 8 == 0, F.array(F.lit("ancrage_annee"))).otherwise(F.array().cast("array<string>")).alias("champs_a_confirmer"),
        )

    @cached_property
    def fiche(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("projet_id"), F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("cle"), F.upper(F.col("p_brand")).alias("code"),
            F.col("p_name").alias("titre"), F.when(F.col("p_partkey") % 4 == 0, "R1.1").when(F.col("p_partkey") % 4 == 1, "autre").alias("lib_thema"),
        )

    @cached_property
    def message(self) -> DataFrame:
        return self.raw("conversations").select(
            F.expr("conv_id * 1000 + turn").alias("id"), F.col("conv_id").alias("demande_id"), "turn",
            F.when(F.col("role") == "user", "be").otherwise("dreal").alias("acteur"), F.col("text").alias("corps"),
            F.expr("timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 4000 as int), cast(turn as int))").alias("cree_le"),
        )

    @cached_property
    def demande(self) -> DataFrame:
        first = self.message.groupBy("demande_id").agg(
            F.min_by("acteur", "turn").alias("auteur"), F.left(F.min_by("corps", "turn"), F.lit(40)).alias("objet"),
            F.min("cree_le").alias("cree_le"), F.max("cree_le").alias("maj_le"), F.max_by("acteur", "turn").alias("dernier_acteur"),
        )
        closed = F.col("demande_id") % 7 == 0
        return first.select(
            F.col("demande_id").alias("id"), (F.col("demande_id") % 100).alias("projet_id"), (F.col("demande_id") % 150).alias("occurrence_id"),
            "auteur", "objet", "cree_le", "maj_le",
            F.when(closed, "close").when(F.col("dernier_acteur") == F.col("auteur"), "ouverte").otherwise("repondue").alias("statut"),
            F.when(closed, F.expr("maj_le + interval 1 day")).alias("clos_le"),
        )


#: The same tables in DuckDB SQL, for the oracles.
SQL_TABLES = {
    "d_organisation": "SELECT n_nationkey AS id, n_name AS nom, n_regionkey AS region_id FROM nation",
    "d_projet0": """SELECT c_custkey AS id, c_nationkey AS organisation_id, c_name AS nom, 'REF-' || c_custkey AS reference_interne, c_mktsegment AS commune,
        lpad(CAST(c_custkey % 95 + 1 AS VARCHAR), 2, '0') AS departement, CASE WHEN c_custkey % 2 = 0 THEN 'derogation' ELSE 'autorisation' END AS type_procedure,
        CASE WHEN c_custkey % 17 = 0 THEN 'archive' WHEN c_custkey % 19 = 0 THEN 'clos' ELSE 'actif' END AS statut,
        d.date_decision, CAST(c_custkey % 5 + 3 AS INTEGER) AS duree_annees
        FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS date_decision FROM orders GROUP BY o_custkey) d ON d.o_custkey = c_custkey""",
    "d_projet": """SELECT *, CAST(date_decision + to_years(duree_annees) AS DATE) AS date_fin,
        CAST(coalesce(date_decision, DATE '1995-01-01') AS TIMESTAMP) AS created_at,
        CAST(coalesce(date_decision, DATE '1995-01-01') AS TIMESTAMP) + to_days(CAST(id % 900 AS INTEGER)) AS updated_at FROM d_projet0""",
    "d_lignes": """SELECT l_orderkey, min(l_suppkey) AS prestataire_id,
        CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS montant_realise FROM lineitem GROUP BY l_orderkey""",
    "d_occurrence": """SELECT o_orderkey AS id, o_custkey AS projet_id, o_orderkey % 200 AS echeance_id,
        CAST(year(o_orderdate) + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS INTEGER) AS annee, CAST(year(o_orderdate) AS INTEGER) AS annee_initiale,
        ['TE','TU','MR','MC','AD'][o_orderkey % 5 + 1] AS categorie, ['TE','TU','MR','MC','AD'][o_orderkey % 5 + 1] || (o_orderkey % 40) AS code,
        'Action ' || (o_orderkey % 40) || ' de ' || year(o_orderdate) AS titre,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'supprime' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'repousse' WHEN o_orderstatus = 'F' THEN 'realise'
             WHEN o_orderstatus = 'P' THEN 'en_cours' ELSE 'planifie' END AS statut,
        CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS montant_initial,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) + (o_orderkey % 5 - 2) * 1000 AS DECIMAL(18,2)) END AS montant_ht,
        CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND o_orderstatus IN ('F', 'P') THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 500 AS DECIMAL(18,2)) END AS montant_engage,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 12 + 1 AS INTEGER) END AS mois_debut, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 7 % 12 + 1 AS INTEGER) END AS mois_fin,
        CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'autre' WHEN 2 THEN 'R2.1a' END AS lib_thema,
        CASE WHEN o_orderkey % 9 = o_orderkey % 5 THEN ['ug' || (o_orderkey % 9)] ELSE ['ug' || (o_orderkey % 9), 'ug' || (o_orderkey % 5)] END AS ug_ids,
        CASE WHEN o_orderkey % 3 = 0 THEN 'manuel' ELSE 'ia' END AS origine, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS confiance,
        CASE WHEN o_orderkey % 4 = 0 THEN ['montant_ht'] ELSE [] END AS champs_a_confirmer,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS modifie_le, prestataire_id, montant_realise
        FROM orders LEFT JOIN d_lignes ON l_orderkey = o_orderkey""",
    "d_prestataire": """SELECT s_suppkey AS id, s_name AS nom, CASE WHEN s_suppkey % 10 <> 0 THEN ' 123 ' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '-00011' END AS siret,
        nullif(regexp_replace(CASE WHEN s_suppkey % 10 <> 0 THEN ' 123 ' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '-00011' END, '[^0-9]', '', 'g'), '') AS siret_norm,
        s_nationkey AS organisation_id, s_acctbal > 0 AS actif FROM supplier""",
    "d_projet_prestataire": """SELECT DISTINCT o_custkey AS projet_id, l_suppkey AS prestataire_id, 'titulaire' AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "d_mouvement0": """SELECT event_id AS id, event_id // 20 AS occurrence_id,
        CASE event_type WHEN 'view' THEN 'annee' WHEN 'click' THEN 'montant_ht' WHEN 'purchase' THEN 'montant_engage' WHEN 'signup' THEN 'montant_realise' WHEN 'error' THEN 'statut' END AS champ,
        CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS ancienne_val, CAST(CAST(CAST(value AS DECIMAL(18,2)) + 10 AS DECIMAL(18,2)) AS VARCHAR) AS nouvelle_val,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'user' || user_id AS modifie_par, ts - INTERVAL 24 YEAR AS modifie_le FROM events""",
    "d_mouvement": """SELECT m.id, occurrence_id, champ, ancienne_val, nouvelle_val, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 7 = 0 THEN '' ELSE 'motif ' || k END END AS motif,
        modifie_par, modifie_le, o_custkey AS projet_id FROM d_mouvement0 m JOIN orders ON o_orderkey = occurrence_id""",
    "d_rapport": """SELECT o_orderkey AS id, o_custkey AS projet_id, CAST(year(o_orderdate) AS INTEGER) AS annee,
        CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS INTEGER) AS version,
        CASE WHEN o_orderkey % 3 = 0 THEN 'brouillon' ELSE 'valide' END AS statut, o_orderdate + INTERVAL 400 DAY AS genere_le,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 410 DAY END AS valide_le, CAST(o_totalprice AS DECIMAL(18,2)) AS archive_prevu FROM orders""",
    "d_baseline": """SELECT c_custkey * 2 + v AS id, c_custkey AS projet_id, TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(c_custkey * (v + 1) % 1000 AS INTEGER)) AS figee_le,
        'Budget v' || v AS libelle, CAST(c_acctbal AS DECIMAL(18,2)) AS total_ht FROM customer, (VALUES (0), (1)) t(v) WHERE (c_custkey + v) % 3 <> 0""",
    "d_echeance": """SELECT p_partkey AS id, p_partkey % 100 AS projet_id, 'E' || p_partkey AS cle, 'A' || (p_partkey % 60) AS action_cle,
        lower(substr(p_brand, 1, 2)) || ' ' || (p_partkey % 30) AS code_operation, p_name AS libelle,
        ['ponctuel','periodique','campagnes','paliers','dependant_evenement'][p_partkey % 5 + 1] AS type, CAST(CASE WHEN p_partkey % 9 <> 0 THEN 1990 + p_size END AS INTEGER) AS ancrage_annee,
        CAST(p_partkey % 4 + 1 + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS intervalle_ans, CAST(p_partkey % 6 + 2 AS INTEGER) AS duree_ans,
        CAST(p_partkey % 3 + 1 AS INTEGER) AS occurrences_par_an, p_partkey % 15 = 3 AS sans_palier, CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 100) / 100.0::DOUBLE END AS confiance,
        string_split(p_name, ' ') AS unites, CASE WHEN p_partkey % 8 = 0 THEN ['ancrage_annee'] ELSE [] END AS champs_a_confirmer FROM part""",
    "d_fiche": """SELECT p_partkey AS id, p_partkey % 100 AS projet_id, 'A' || p_partkey AS cle, upper(p_brand) AS code, p_name AS titre, CASE p_partkey % 4 WHEN 0 THEN 'R1.1' WHEN 1 THEN 'autre' END AS lib_thema
        FROM part""",
    "d_message": """SELECT conv_id * 1000 + turn AS id, conv_id AS demande_id, turn, CASE WHEN role = 'user' THEN 'be' ELSE 'dreal' END AS acteur, text AS corps,
        TIMESTAMP '2000-01-01 00:00:00' + to_hours(CAST(conv_id % 4000 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS cree_le FROM conversations""",
    "d_demande0": """SELECT demande_id, arg_min(acteur, turn) AS auteur, left(arg_min(corps, turn), 40) AS objet, min(cree_le) AS cree_le, max(cree_le) AS maj_le, arg_max(acteur, turn) AS dernier_acteur
        FROM d_message GROUP BY demande_id""",
    "d_demande": """SELECT demande_id AS id, demande_id % 100 AS projet_id, demande_id % 150 AS occurrence_id, auteur, objet, cree_le, maj_le,
        CASE WHEN demande_id % 7 = 0 THEN 'close' WHEN dernier_acteur = auteur THEN 'ouverte' ELSE 'repondue' END AS statut,
        CASE WHEN demande_id % 7 = 0 THEN maj_le + INTERVAL 1 DAY END AS clos_le FROM d_demande0""",
}
