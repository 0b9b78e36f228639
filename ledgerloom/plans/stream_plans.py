"""Queries that replay the tables as streams to their end, and views under session variables, with their oracles."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import context, mutations
from ledgerloom.plans.oracles import SQL_VIEWS
from ledgerloom.plans.process_plans import _NEW_STATE
from ledgerloom.plans.report_plans import simple
from ledgerloom.session import shared_folder
from ledgerloom.sources.domain import MONEY, Domain
from ledgerloom.streaming import stateful, threads

#: State partitions of these replays; a stream of real size sets its own.
PARTITIONS = 8


def _folder(d: Domain, label: str) -> str:
    return f"{shared_folder(d.spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"


# Every turn is delivered up to three times, the copies after the query's restart among them; some mails bear no id.
SQL_VIEWS["v_remises"] = """SELECT id, demande_id, CASE WHEN turn % 5 <> 4 THEN 'm-' || id END AS email_message_id, copie FROM (
    SELECT *, unnest(range(0, 1 + (demande_id + turn) % 3)) AS copie FROM d_message)"""


def _redelivered(d: Domain) -> DataFrame:
    mail = F.when(F.col("turn") % 5 != 4, F.concat(F.lit("m-"), "id"))
    sent = d.message.select("id", "demande_id", mail.alias("email_message_id"), F.col("cree_le").cast("timestamp").alias("cree_le"), F.expr("explode(sequence(0, CAST((demande_id + turn) % 3 AS INT)))").alias("copie"))
    early = (F.col("copie") == 0) & (F.col("demande_id") % 2 == 0)
    # A mail may come again at any time of the year.
    found = stateful.replay([sent.filter(early), sent.filter(~early)], lambda s: threads.once_per_key(s, delay="400 days"), _folder(d, "remises"), partitions=PARTITIONS)
    return found.groupBy("id", "email_message_id").agg(F.count("*").alias("nb"))


simple("st3_relivraisons", "SELECT id, email_message_id, CASE WHEN email_message_id IS NULL THEN count(*) ELSE 1 END AS nb FROM v_remises GROUP BY id, email_message_id", _redelivered)

# Threads fall due 15 days after the author's last message, as far as the watermark has come.
_ENDED = "(SELECT max(cree_le) FROM (SELECT cree_le FROM d_message UNION ALL SELECT clos_le FROM d_demande)) - INTERVAL 1 HOUR"


def _followed(d: Domain) -> DataFrame:
    said = d.message.select("id", "demande_id", "acteur", F.col("cree_le").cast("timestamp").alias("cree_le"))
    closing = d.demande.filter("clos_le IS NOT NULL").select(F.lit(0).cast("long").alias("id"), F.col("id").alias("demande_id"), F.lit("close").alias("acteur"), F.col("clos_le").cast("timestamp").alias("cree_le"))
    events = said.unionByName(closing)
    thirds = [events.filter(F.month("cree_le").isin(*months)) for months in ([1, 2], [3, 4], [5, 6, 7])]
    rows = stateful.replay(thirds, lambda s: stateful.follow_threads(s, wait="15 days", delay="1 hour"), _folder(d, "fils"), "update", PARTITIONS)
    last = F.max_by(F.struct("statut", "nb_messages", "echu"), F.struct("nb_messages", F.col("statut") == "close", "echu"))
    return rows.groupBy("demande_id").agg(last.alias("r")).select("demande_id", "r.*")


simple("st2_fils", f"""SELECT demande_id, CASE WHEN clos THEN 'close' WHEN dernier <> auteur THEN 'repondue' WHEN echu THEN 'a_relancer' ELSE 'ouverte' END AS statut, nb_messages, echu AND NOT clos AND dernier = auteur AS echu FROM (
    SELECT demande_id, count(*) AS nb_messages, arg_min(acteur, id) AS auteur, arg_max(acteur, id) AS dernier, demande_id % 7 = 0 AS clos, max(cree_le) + INTERVAL 15 DAY <= {_ENDED} AS echu FROM d_message GROUP BY demande_id)""", _followed)

# New states of all occurrences as a stream, half of them followed by a late, older row that must not count.
SQL_VIEWS["v_etats_recus"] = f"""SELECT n.id AS occurrence_id, n.projet_id, champ, ancienne_val, nouvelle_val, 'revue' AS motif, '' AS modifie_par FROM ({_NEW_STATE}) n JOIN d_occurrence o ON o.id = n.id,
    LATERAL (SELECT unnest(['annee', 'statut', 'montant_ht', 'montant_engage', 'montant_realise']) AS champ,
      unnest([CAST(o.annee AS VARCHAR), o.statut, CAST(o.montant_ht AS VARCHAR), CAST(o.montant_engage AS VARCHAR), CAST(o.montant_realise AS VARCHAR)]) AS ancienne_val,
      unnest([CAST(n.annee AS VARCHAR), n.statut, CAST(n.montant_ht AS VARCHAR), CAST(n.montant_engage AS VARCHAR), CAST(CAST(n.montant_realise AS DECIMAL(18,2)) AS VARCHAR)]) AS nouvelle_val) WHERE ancienne_val IS DISTINCT FROM nouvelle_val"""


def _new_states(old: DataFrame) -> DataFrame:
    k = F.col("id")
    return old.withColumns({
        "annee": F.when(k % 4 == 0, F.col("annee") + 1).otherwise(F.col("annee")), "statut": F.when(k % 6 == 0, "realise").otherwise(F.col("statut")),
        "montant_ht": F.when(k % 5 != 0, F.col("montant_ht")), "montant_realise": F.when(k % 3 == 0, (F.col("montant_realise") + 1).cast(MONEY)).otherwise(F.col("montant_realise")),
    })


def _captured(d: Domain) -> DataFrame:
    def at(rows: DataFrame, when: str) -> DataFrame:
        return rows.select("id", "projet_id", *mutations.WATCHED, F.lit(when).cast("timestamp").alias("modifie_le"))

    old = at(d.occurrence, "2000-01-01 00:00:00")
    new = at(_new_states(d.occurrence), "2000-02-01 00:00:00")
    late = at(d.occurrence.filter("id % 2 = 0").withColumn("statut", F.lit("perdu")), "2000-01-15 00:00:00")
    return stateful.replay([new, late], lambda s: stateful.capture_keyed(s, old, motif="revue"), _folder(d, "captures"), partitions=PARTITIONS).drop("lot")


simple("st1_capturer_en_flux", "SELECT * FROM v_etats_recus", _captured)


def _by_role(d: Domain) -> DataFrame:
    """One view, asked by four people."""
    context.declare(d.spark)
    context.protect(d.projet, "projets_visibles")
    seen = []
    for role, organisation in (("admin", None), ("controleur", 2), ("operateur", 4), (None, 4)):
        context.act_as(d.spark, role, organisation)
        seen.append(d.spark.table("projets_visibles").select(F.lit(role or "personne").alias("role"), "id"))
    context.act_as(d.spark)
    return reduce(DataFrame.unionByName, seen)


simple("p16_vue_par_role", "SELECT role, id FROM d_projet, (VALUES ('admin'), ('controleur'), ('operateur')) t(role) WHERE role <> 'operateur' OR organisation_id = 4", _by_role)


def _by_author(d: Domain) -> DataFrame:
    """The events of changes whose reason and author the session knows."""
    context.declare(d.spark)
    context.act_as(d.spark, "operateur", 4, "revue", None)
    found = mutations.capture_changes(d.occurrence, _new_states(d.occurrence)).withColumns({"motif": context.reason(), "modifie_par": context.author()})
    context.act_as(d.spark)
    return found


simple("k12_contexte_de_session", "SELECT * FROM v_etats_recus", _by_author)
