"""Queries on calendars, threads, contractors and mutations, with their oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import calendar, contractors, dialogue, mutations
from ledgerloom.plans.oracles import SQL_VIEWS, oracle
from ledgerloom.plans.portfolio_plans import plain
from ledgerloom.plans.registry import register
from ledgerloom.sources.domain import AS_OF, MONEY, Domain

HORIZON = 2020

SQL_VIEWS.update({
    "v_deadline": """SELECT projet_id, id, code, titre, coalesce(mois_fin, mois_debut, 12) AS mois_fin_eff, CASE WHEN mois_debut > mois_fin THEN annee + 1 ELSE annee END AS annee_fin,
        last_day(make_date(CASE WHEN mois_debut > mois_fin THEN annee + 1 ELSE annee END, coalesce(mois_fin, mois_debut, 12), 1)) AS deadline FROM d_occurrence WHERE statut NOT IN ('realise', 'supprime')""",
    "v_prochaine": f"SELECT * FROM v_deadline WHERE deadline >= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY projet_id ORDER BY deadline, code, id) = 1",
    "v_annees": f"""SELECT id, unnest(CASE WHEN ancrage_annee IS NULL THEN []
        WHEN type IN ('ponctuel', 'dependant_evenement') THEN CASE WHEN ancrage_annee <= {HORIZON} THEN [ancrage_annee] ELSE [] END
        WHEN type = 'periodique' THEN generate_series(ancrage_annee, {HORIZON}, greatest(CAST(round_even(intervalle_ans, 0) AS INTEGER), 1))
        WHEN type = 'campagnes' THEN generate_series(ancrage_annee, least(ancrage_annee + greatest(duree_ans, 1) - 1, {HORIZON}))
        WHEN sans_palier THEN [] ELSE list_filter([ancrage_annee, ancrage_annee + 1, ancrage_annee + 2, ancrage_annee + 3, ancrage_annee + 4, ancrage_annee + 7, ancrage_annee + 10, ancrage_annee + 13, ancrage_annee + 16, ancrage_annee + 19], lambda y: y <= {HORIZON}) END) AS annee FROM d_echeance""",
    "v_dernier": """SELECT demande_id, count(*) AS nb_messages, arg_max(corps, id) AS dernier_corps, arg_max(acteur, id) AS dernier_acteur, max(cree_le) AS dernier_message_le FROM d_message GROUP BY demande_id""",
})


@register("j03_calendrier", oracle("""SELECT o.id, o.projet_id, o.annee, o.code, o.statut, e.cle AS echeance_cle, e.type AS recurrence, f.titre AS action_titre, p.nom AS prestataire_nom,
    coalesce(nullif(nullif(o.lib_thema, ''), 'autre'), nullif(nullif(f.lib_thema, ''), 'autre'), 'autre') AS theme
    FROM d_occurrence o LEFT JOIN d_echeance e ON e.id = o.echeance_id LEFT JOIN d_fiche f ON f.cle = e.action_cle LEFT JOIN d_prestataire p ON p.id = o.prestataire_id"""))
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return calendar.calendrier(d.occurrence, d.echeance, d.fiche, d.prestataire).select("id", "projet_id", "annee", "code", "statut", "echeance_cle", "recurrence", "action_titre", "prestataire_nom", "theme")


@register("t30_calendrier_filtre", oracle("SELECT id, projet_id, annee, code, titre FROM d_occurrence WHERE statut <> 'supprime' AND annee = 1999 AND list_contains(ug_ids, 'ug3')"))
def t30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.filtrer_calendrier(Domain(spark, sf_dir).occurrence, annee=1999, ug_id="ug3").select("id", "projet_id", "annee", "code", "titre")


@register("t20_annees_occurrences", oracle("SELECT id, CAST(annee AS INTEGER) AS annee FROM v_annees"))
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Domain(spark, sf_dir).echeance
    return rule.select("id", F.explode(calendar.annees(rule, HORIZON)).alias("annee"))


@register("t22_generer_occurrences", oracle("""SELECT e.id AS echeance_id, e.projet_id, CAST(v.annee AS INTEGER) AS annee, regexp_replace(upper(replace(code_operation, ' ', '')), '^([A-Z]+)\\s*(\\d+)$', '\\1 \\2') AS code,
    libelle || CASE WHEN type = 'campagnes' AND occurrences_par_an > 0 THEN ' (×' || occurrences_par_an || '/an)' ELSE '' END AS titre,
    CASE WHEN list_contains(champs_a_confirmer, 'ancrage_annee') OR v.annee < 2000 THEN 'a_confirmer' ELSE 'planifie' END AS statut FROM d_echeance e JOIN v_annees v ON v.id = e.id"""))
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.generer_occurrences(Domain(spark, sf_dir).echeance, HORIZON, AS_OF.year)


@register("t22b_non_placables", oracle("SELECT id, cle, type FROM d_echeance WHERE id NOT IN (SELECT id FROM v_annees)"))
def t22b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.non_placables(Domain(spark, sf_dir).echeance, HORIZON).select("id", "cle", "type")


@register("a32_horizon", oracle(f"SELECT CAST(greatest({AS_OF.year}, max(ancrage_annee), min(ancrage_annee) + max(duree_ans) - 1) AS INTEGER) AS annee_fin FROM d_echeance"))
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.horizon_suggere(Domain(spark, sf_dir).echeance, AS_OF)


@register("p18_a_revoir", oracle("SELECT id, cle FROM d_echeance WHERE coalesce(confiance, 0) < 0.7 OR len(champs_a_confirmer) > 0"))
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).echeance.filter(calendar.a_revoir()).select("id", "cle")


@register("p19_non_placable_sans_occurrence", oracle("""SELECT id, cle FROM d_echeance e WHERE NOT EXISTS (SELECT 1 FROM d_occurrence o WHERE o.echeance_id = e.id)
    AND ((type = 'dependant_evenement' AND ancrage_annee IS NULL) OR coalesce(confiance, 0) < 0.7 OR len(champs_a_confirmer) > 0)"""))
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    used = d.occurrence.select(F.col("echeance_id").alias("id"))
    unplaceable = ((F.col("type") == "dependant_evenement") & F.col("ancrage_annee").isNull()) | calendar.a_revoir()
    return d.echeance.join(used, "id", "left_anti").filter(unplaceable).select("id", "cle")


@register("t11_prochaine_echeance", oracle("SELECT projet_id, id, code, deadline, mois_fin_eff, annee_fin FROM v_prochaine"))
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.prochaine_occurrence(Domain(spark, sf_dir).occurrence, AS_OF).select("projet_id", "id", "code", "deadline", "mois_fin_eff", "annee_fin")


@register("t31_resume_projets", oracle(f"""SELECT p.id AS projet_id, p.nom, coalesce(c.n, 0) AS nb_occurrences, coalesce(c.r, 0) AS nb_realisees, 0 AS dette_m2, v.code AS prochaine_code, v.titre AS prochaine_titre,
    v.deadline AS prochaine_deadline, CAST(v.deadline - DATE '{AS_OF}' AS INTEGER) AS prochaine_jours_restants, v.mois_fin_eff AS prochaine_mois_fin, v.annee_fin AS prochaine_annee_fin
    FROM d_projet p LEFT JOIN (SELECT projet_id, count(*) FILTER (WHERE statut <> 'supprime') AS n, count(*) FILTER (WHERE statut = 'realise') AS r FROM d_occurrence GROUP BY projet_id) c ON c.projet_id = p.id
    LEFT JOIN v_prochaine v ON v.projet_id = p.id"""))
def t31(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return calendar.resume_projets(d.projet, d.occurrence, AS_OF).select(
        "projet_id", "nom", "nb_occurrences", "nb_realisees", "dette_m2", "prochaine_code", "prochaine_titre", "prochaine_deadline", "prochaine_jours_restants", "prochaine_mois_fin", "prochaine_annee_fin")


@register("t05_page_de_projets", oracle("SELECT id, nom, date_decision, date_fin, duree_annees FROM d_projet ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"))
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).projet.orderBy(F.desc("created_at"), "id").offset(50).limit(25).select("id", "nom", "date_decision", "date_fin", "duree_annees")


@register("j16_lier_regles_fiches", oracle("""SELECT e.id, coalesce(a.cle, b.cle) AS fiche_cle, coalesce(a.cle, b.cle) IS NULL AS orpheline FROM d_echeance e
    LEFT JOIN (SELECT upper(replace(code, ' ', '')) AS k, arg_max(cle, id) AS cle FROM d_fiche GROUP BY 1) a ON a.k = upper(replace(e.action_cle, ' ', ''))
    LEFT JOIN d_fiche b ON b.cle = e.action_cle"""))
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    by_code = d.fiche.select(F.upper(F.replace("code", F.lit(" "), F.lit(""))).alias("k"), F.col("cle").alias("c"), (F.col("id") * 2).alias("ordre"))
    by_id = d.fiche.select(F.col("cle").alias("k"), F.col("cle").alias("c"), (F.col("id") * 2 + 1).alias("ordre"))
    index = by_code.union(by_id).groupBy("k").agg(F.max_by("c", "ordre").alias("fiche_cle"))
    rules = d.echeance.withColumn("k", F.upper(F.replace("action_cle", F.lit(" "), F.lit(""))))
    return rules.join(index, "k", "left").select("id", "fiche_cle", F.col("fiche_cle").isNull().alias("orpheline"))


@register("j17_fiches_et_occurrences", oracle("""SELECT coalesce(f.cle, c.cle) AS cle, coalesce(f.titre, c.cle) AS titre, coalesce(c.n, 0) AS nb_occurrences FROM d_fiche f
    FULL JOIN (SELECT e.action_cle AS cle, count(*) AS n FROM d_occurrence o JOIN d_echeance e ON e.id = o.echeance_id WHERE o.statut <> 'supprime' AND list_contains(o.ug_ids, 'ug2') GROUP BY 1) c ON c.cle = f.cle"""))
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    placed = calendar.filtrer_calendrier(d.occurrence, ug_id="ug2").join(d.echeance.select(F.col("id").alias("echeance_id"), F.col("action_cle").alias("cle")), "echeance_id")
    counts = placed.groupBy("cle").agg(F.count("*").alias("n"))
    return d.fiche.join(counts, "cle", "full").select("cle", F.coalesce("titre", "cle").alias("titre"), F.coalesce("n", F.lit(0)).alias("nb_occurrences"))


@register("j13_demandes", oracle("""SELECT d.id, d.projet_id, d.statut, d.auteur, o.code AS occurrence_code, o.annee AS occurrence_annee, coalesce(v.nb_messages, 0) AS nb_messages, length(v.dernier_corps) AS dernier_corps_n,
    v.dernier_acteur, strftime(v.dernier_message_le, '%Y-%m-%d %H:%M') AS dernier_message_le FROM d_demande d LEFT JOIN v_dernier v ON v.demande_id = d.id LEFT JOIN d_occurrence o ON o.id = d.occurrence_id"""))
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return dialogue.lister_demandes(d.demande, d.message, d.occurrence).select(
        "id", "projet_id", "statut", "auteur", "occurrence_code", "occurrence_annee", "nb_messages", F.length("dernier_corps").cast("bigint").alias("dernier_corps_n"), "dernier_acteur",
        F.date_format("dernier_message_le", "yyyy-MM-dd HH:mm").alias("dernier_message_le"))


@register("t02_file_de_relance", oracle(f"""SELECT d.id, d.statut, p.nom AS projet_nom, o.nom AS organisation_nom, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - d.maj_le) / 86400) AS INTEGER) AS jours_sans_reponse
    FROM d_demande d JOIN d_projet p ON p.id = d.projet_id JOIN d_organisation o ON o.id = p.organisation_id ORDER BY (d.statut = 'ouverte') DESC, d.maj_le, d.id LIMIT 60"""))
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return dialogue.file_de_relance(d.demande, d.projet, d.organisation, AS_OF, limite=60).select("id", "statut", "projet_nom", "organisation_nom", "jours_sans_reponse")


@register("k20_etat_des_demandes", oracle("""SELECT d.id, CASE WHEN d.statut = 'close' THEN 'close' WHEN v.dernier_acteur IS NULL THEN d.statut WHEN v.dernier_acteur = d.auteur THEN 'ouverte' ELSE 'repondue' END AS statut
    FROM d_demande d LEFT JOIN v_dernier v ON v.demande_id = d.id"""))
def k20(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return dialogue.etat_par_messages(d.demande, d.message).select("id", "statut")


@register("u02_activite", oracle("""SELECT projet_id, strftime(survenu_le, '%Y-%m-%d %H:%M') AS survenu_le, type, acteur, libelle, CAST(demande_id AS BIGINT) AS demande_id FROM (
    SELECT projet_id, cree_le AS survenu_le, 'demande_ouverte' AS type, auteur AS acteur, CASE auteur WHEN 'dreal' THEN 'Demande du service instructeur' ELSE 'Signalement du bureau d''études' END || ' : ' || objet AS libelle, id AS demande_id FROM d_demande
    UNION ALL SELECT d.projet_id, m.cree_le, 'message', m.acteur, CASE m.acteur WHEN 'dreal' THEN 'Message du service instructeur' ELSE 'Réponse du bureau d''études' END || ' : ' || left(corps, 120) || CASE WHEN length(corps) > 120 THEN '…' ELSE '' END, d.id
      FROM d_message m JOIN d_demande d ON d.id = m.demande_id
    UNION ALL SELECT projet_id, clos_le, 'demande_close', 'dreal', 'Demande close : ' || objet, id FROM d_demande WHERE clos_le IS NOT NULL
    UNION ALL SELECT projet_id, valide_le, 'bilan_valide', 'be', 'Bilan financier ' || annee || ' validé (version ' || version || ')', NULL FROM d_rapport WHERE statut = 'valide' AND valide_le IS NOT NULL
    UNION ALL SELECT projet_id, figee_le, 'baseline_figee', 'be', 'Budget de référence figé : ' || libelle, NULL FROM d_baseline)"""))
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return dialogue.activite(d.demande, d.message, d.rapport, d.baseline).withColumn("survenu_le", F.date_format("survenu_le", "yyyy-MM-dd HH:mm"))


@register("j05_prestataires_par_projet", oracle("""SELECT coalesce(w.projet_id, l.projet_id) AS projet_id, p.id AS prestataire_id, p.nom AS prestataire_nom, p.siret_norm, p.actif, l.role,
    CASE WHEN w.projet_id IS NOT NULL AND l.projet_id IS NOT NULL THEN 'les_deux' WHEN w.projet_id IS NOT NULL THEN 'occurrence' ELSE 'projet' END AS source,
    coalesce(nb_occurrences, 0) AS nb_occurrences, coalesce(nb_realisees, 0) AS nb_realisees, CAST(coalesce(tp, 0) AS DOUBLE) AS total_prevu_ht, CAST(coalesce(te, 0) AS DOUBLE) AS total_engage_ht,
    CAST(coalesce(tr, 0) AS DOUBLE) AS total_realise_ht, annee_min, annee_max FROM (SELECT projet_id, prestataire_id, count(*) FILTER (WHERE statut <> 'supprime') AS nb_occurrences, count(*) FILTER (WHERE statut = 'realise') AS nb_realisees,
      sum(montant_ht) FILTER (WHERE statut <> 'supprime') AS tp, sum(montant_engage) FILTER (WHERE statut <> 'supprime') AS te, sum(montant_realise) FILTER (WHERE statut <> 'supprime') AS tr,
      min(annee) FILTER (WHERE statut <> 'supprime') AS annee_min, max(annee) FILTER (WHERE statut <> 'supprime') AS annee_max FROM d_occurrence WHERE prestataire_id IS NOT NULL GROUP BY 1, 2) w
    FULL JOIN d_projet_prestataire l ON l.projet_id = w.projet_id AND l.prestataire_id = w.prestataire_id JOIN d_prestataire p ON p.id = coalesce(w.prestataire_id, l.prestataire_id)"""))
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return plain(contractors.par_projet(d.occurrence, d.projet_prestataire, d.prestataire))


@register("t04_recherche_prestataires", oracle("""SELECT id, nom, siret_norm FROM d_prestataire WHERE nom ILIKE '%00002%' OR coalesce(siret, '') ILIKE '%00002%' OR contains(coalesce(siret_norm, ''), '00002')
    ORDER BY CASE WHEN starts_with(lower(nom), '00002') THEN 0 ELSE 1 END, nom, id LIMIT 20"""))
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contractors.rechercher(Domain(spark, sf_dir).prestataire, "00002").select("id", "nom", "siret_norm")


_INCOMING = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Firme ' || s_suppkey END AS nom, '123' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 6, '0') || ' 00011' AS siret FROM supplier"


@register("k08_rattacher_prestataires", oracle(f"""SELECT p.id, coalesce(nullif(i.nom, ''), p.nom) AS nom, p.siret_norm, FALSE AS cree FROM d_prestataire p LEFT JOIN (SELECT *, regexp_replace(siret, '[^0-9]', '', 'g') AS n FROM ({_INCOMING})) i ON i.n = p.siret_norm
    UNION ALL SELECT NULL, i.nom, i.n, TRUE FROM (SELECT *, regexp_replace(siret, '[^0-9]', '', 'g') AS n FROM ({_INCOMING})) i WHERE NOT EXISTS (SELECT 1 FROM d_prestataire p WHERE p.siret_norm = i.n)"""))
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    k = F.col("s_suppkey")
    incoming = d.raw("supplier").select(
        k.alias("ordre"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Firme "), k.cast("string"))).alias("nom"), F.concat(F.lit("123"), F.lpad((k * 2).cast("string"), 6, "0"), F.lit(" 00011")).alias("siret"))
    return contractors.rattacher(d.prestataire, incoming).select("id", "nom", "siret_norm", "cree")


@register("k07_lier_prestataires", oracle("""SELECT projet_id, prestataire_id FROM d_projet_prestataire UNION SELECT projet_id, prestataire_id FROM d_occurrence WHERE prestataire_id IS NOT NULL"""))
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return contractors.lier(d.projet_prestataire, d.occurrence.filter("prestataire_id is not null")).select("projet_id", "prestataire_id")


@register("k09_detacher_prestataires", oracle("""SELECT projet_id, prestataire_id FROM d_projet_prestataire l WHERE EXISTS (
    SELECT 1 FROM d_occurrence o WHERE o.projet_id = l.projet_id AND o.prestataire_id = l.prestataire_id AND o.statut <> 'supprime')"""))
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    unwanted = d.projet_prestataire.select("projet_id", "prestataire_id")
    return contractors.detacher(d.projet_prestataire, unwanted, d.occurrence).select("projet_id", "prestataire_id")


# Mutations: old and new state are made from the same rows by a rule on the id.
_FICHES = "SELECT s_suppkey * 3 AS cle, 'neuf ' || s_suppkey AS titre, CAST(s_nationkey AS INTEGER) AS rang FROM supplier"


@register("k03_upsert", oracle(f"""SELECT coalesce(i.cle, t.cle) AS cle, coalesce(i.titre, t.titre) AS titre, coalesce(i.rang, t.rang) AS rang
    FROM (SELECT p_partkey AS cle, p_name AS titre, CAST(p_size AS INTEGER) AS rang FROM part) t FULL JOIN ({_FICHES}) i ON i.cle = t.cle"""))
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.upsert(*_fiches(spark, sf_dir), ["cle"])


@register("k04_upsert_partiel", oracle(f"""SELECT coalesce(i.cle, t.cle) AS cle, coalesce(i.titre, t.titre) AS titre, CASE WHEN t.cle IS NULL THEN i.rang ELSE t.rang END AS rang
    FROM (SELECT p_partkey AS cle, p_name AS titre, CAST(p_size AS INTEGER) AS rang FROM part) t FULL JOIN ({_FICHES}) i ON i.cle = t.cle"""))
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.upsert(*_fiches(spark, sf_dir), ["cle"], keep=["rang"])


def _fiches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = Domain(spark, sf_dir)
    old = d.raw("part").select(F.col("p_partkey").alias("cle"), F.col("p_name").alias("titre"), F.col("p_size").cast("int").alias("rang"))
    new = d.raw("supplier").select((F.col("s_suppkey") * 3).alias("cle"), F.concat(F.lit("neuf "), F.col("s_suppkey").cast("string")).alias("titre"), F.col("s_nationkey").cast("int").alias("rang"))
    return old, new


@register("k05_inserer_sans_conflit", oracle("""WITH t AS (SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE echeance_id END AS e, annee, origine FROM d_occurrence WHERE id % 2 = 0),
    i AS (SELECT id, CASE WHEN id % 50 = 1 THEN NULL ELSE echeance_id END AS e, annee, origine FROM d_occurrence WHERE id % 2 = 1)
    SELECT * FROM t UNION ALL SELECT * FROM i WHERE e IS NULL OR origine <> 'ia' UNION ALL
    SELECT * FROM (SELECT * FROM i WHERE e IS NOT NULL AND origine = 'ia' QUALIFY row_number() OVER (PARTITION BY e, annee ORDER BY id) = 1) x
    WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.e = x.e AND t.annee = x.annee AND t.origine = 'ia')""".replace("WITH t AS", "SELECT * FROM (WITH t AS", 1) + ")"))
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Domain(spark, sf_dir).occurrence
    def part(odd: int) -> DataFrame:
        return rows.filter(F.col("id") % 2 == odd).select("id", F.when(F.col("id") % 50 != odd, F.col("echeance_id")).alias("e"), "annee", "origine")
    return mutations.insert_ignore(part(0), part(1), ["e", "annee"], "id", F.col("origine") == "ia")


@register("k06_reensemencer", oracle("""SELECT id, annee, origine FROM d_occurrence WHERE NOT (origine = 'ia' AND modifie_le IS NULL) UNION ALL SELECT id + 1000000000, annee, 'ia' FROM d_occurrence"""))
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Domain(spark, sf_dir).occurrence
    fresh = rows.select((F.col("id") + 1000000000).alias("id"), "annee", F.lit("ia").alias("origine"), F.lit(None).cast("timestamp_ntz").alias("modifie_le"))
    return mutations.reseed(rows.select("id", "annee", "origine", "modifie_le"), fresh).drop("modifie_le")


def _freeze(name: str, mode: str, condition: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(mutations.figer_baseline(Domain(spark, sf_dir).occurrence, mode).select("id", "annee_initiale", "montant_initial"))

    register(name, oracle(f"""SELECT id, CASE WHEN {condition} THEN annee ELSE annee_initiale END AS annee_initiale, CAST(CASE WHEN {condition} THEN montant_ht ELSE montant_initial END AS DOUBLE) AS montant_initial FROM d_occurrence"""))(query)


_freeze("k10_figer_completer", "completer", "statut <> 'supprime' AND montant_initial IS NULL")
_freeze("k10b_figer_ecraser", "ecraser", "statut <> 'supprime'")


@register("k10c_total_baseline", oracle("""SELECT projet_id, count(*) AS nb_occurrences, CAST(coalesce(sum(CASE WHEN montant_initial IS NULL THEN montant_ht ELSE montant_initial END), 0) AS DOUBLE) AS total_ht
    FROM d_occurrence WHERE statut <> 'supprime' GROUP BY projet_id"""))
def k10c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(mutations.total_baseline(mutations.figer_baseline(Domain(spark, sf_dir).occurrence, "completer")))


_NEW_STATE = """SELECT id, projet_id, CASE WHEN id % 4 = 0 THEN annee + 1 ELSE annee END AS annee, CASE WHEN id % 6 = 0 THEN 'realise' ELSE statut END AS statut,
    CASE WHEN id % 5 = 0 THEN NULL ELSE montant_ht END AS montant_ht, montant_engage, CASE WHEN id % 3 = 0 THEN montant_realise + 1 ELSE montant_realise END AS montant_realise FROM d_occurrence"""


@register("k11_capturer_changements", oracle(f"""SELECT n.id AS occurrence_id, n.projet_id, champ, ancienne_val, nouvelle_val, 'revue' AS motif, '' AS modifie_par FROM ({_NEW_STATE}) n JOIN d_occurrence o ON o.id = n.id,
    LATERAL (SELECT unnest(['annee', 'statut', 'montant_ht', 'montant_engage', 'montant_realise']) AS champ,
      unnest([CAST(o.annee AS VARCHAR), o.statut, CAST(o.montant_ht AS VARCHAR), CAST(o.montant_engage AS VARCHAR), CAST(o.montant_realise AS VARCHAR)]) AS ancienne_val,
      unnest([CAST(n.annee AS VARCHAR), n.statut, CAST(n.montant_ht AS VARCHAR), CAST(n.montant_engage AS VARCHAR), CAST(CAST(n.montant_realise AS DECIMAL(18,2)) AS VARCHAR)]) AS nouvelle_val) WHERE ancienne_val IS DISTINCT FROM nouvelle_val"""))
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Domain(spark, sf_dir).occurrence
    k = F.col("id")
    new = old.withColumns({
        "annee": F.when(k % 4 == 0, F.col("annee") + 1).otherwise(F.col("annee")), "statut": F.when(k % 6 == 0, "realise").otherwise(F.col("statut")),
        "montant_ht": F.when(k % 5 != 0, F.col("montant_ht")), "montant_realise": F.when(k % 3 == 0, (F.col("montant_realise") + 1).cast(MONEY)).otherwise(F.col("montant_realise")),
    })
    return mutations.capture_changes(old, new, motif="revue")


@register("k14_etiqueter_dernier", oracle("""SELECT id, occurrence_id, champ, CASE WHEN coalesce(motif, '') = '' AND row_number() OVER (PARTITION BY occurrence_id, champ, coalesce(motif, '') = '' ORDER BY modifie_le DESC, id DESC) = 1
    THEN 'explique' ELSE motif END AS motif FROM d_mouvement"""))
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.label_latest(Domain(spark, sf_dir).mouvement, "explique").select("id", "occurrence_id", "champ", "motif")


@register("k15_justifier", oracle("""SELECT m.id, m.occurrence_id, champ, CASE WHEN c.id IS NOT NULL THEN 'justifie' ELSE motif END AS motif FROM d_mouvement m LEFT JOIN (
      SELECT id FROM d_mouvement WHERE coalesce(motif, '') = '' QUALIFY row_number() OVER (PARTITION BY occurrence_id
        ORDER BY list_position(['montant_ht', 'montant_engage', 'montant_realise', 'annee', 'statut'], champ), modifie_le DESC, id DESC) = 1) c ON c.id = m.id
    UNION ALL SELECT NULL, o.id, 'montant_ht', 'justifie' FROM d_occurrence o WHERE NOT EXISTS (SELECT 1 FROM d_mouvement m WHERE m.occurrence_id = o.id AND coalesce(m.motif, '') = '')"""))
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    ids = d.occurrence.select(F.col("id").alias("occurrence_id"))
    return mutations.justify(d.mouvement, d.occurrence, ids, "justifie", "be").select("id", "occurrence_id", "champ", "motif")


@register("k16_version_suivante", oracle("SELECT projet_id, annee, CAST(coalesce(v, 0) + 1 AS INTEGER) AS version FROM v_obligation LEFT JOIN (SELECT projet_id AS p, annee AS a, max(version) AS v FROM d_rapport GROUP BY 1, 2) ON p = projet_id AND a = annee"))
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators.signals import annees_obligation

    d = Domain(spark, sf_dir)
    return mutations.next_version(d.rapport, annees_obligation(d.projet, AS_OF).select("projet_id", "annee"))


@register("k18_rapports_proteges", oracle("SELECT id, 'archive_prevu' AS colonnes FROM d_rapport WHERE statut = 'valide' AND id % 5 = 0"))
def k18(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Domain(spark, sf_dir).rapport
    new = old.withColumn("archive_prevu", F.when(F.col("id") % 5 == 0, F.col("archive_prevu") + 1).otherwise(F.col("archive_prevu")).cast(MONEY))
    return mutations.illegal_changes(old, new).withColumn("colonnes", F.array_join("colonnes", ","))


@register("k21_clore_demandes", oracle("SELECT id, CASE WHEN id IN (1, 2, 3, 7) THEN 'close' ELSE statut END AS statut, CAST(CASE WHEN id IN (1, 2, 3, 7) THEN TIMESTAMP '2000-06-30 12:00:00' ELSE clos_le END AS DATE) AS clos_le FROM d_demande"))
def k21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.clore(Domain(spark, sf_dir).demande, [1, 2, 3, 7], "close", dt.datetime(2000, 6, 30, 12)).select("id", "statut", F.col("clos_le").cast("date").alias("clos_le"))


@register("k27_completer_par_nom", oracle("""SELECT o.id, coalesce(CASE WHEN o.id % 2 = 0 THEN o.prestataire_id END, p.id) AS prestataire_id FROM d_occurrence o LEFT JOIN d_prestataire p
    ON lower(trim(p.nom)) = lower(trim('  SUPPLIER#' || lpad(CAST(o.id % 300 AS VARCHAR), 9, '0') || ' '))"""))
def k27(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    rows = d.occurrence.withColumn("prestataire", F.concat(F.lit("  SUPPLIER#"), F.lpad((F.col("id") % 300).cast("string"), 9, "0"), F.lit(" ")))
    rows = rows.withColumn("prestataire_id", F.when(F.col("id") % 2 == 0, F.col("prestataire_id")))
    return mutations.fill_by_name(rows, d.prestataire).select("id", "prestataire_id")


@register("k28_supprimer", oracle("SELECT id, CASE WHEN annee < 1997 THEN 'supprime' ELSE statut END AS statut FROM d_occurrence"))
def k28(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Domain(spark, sf_dir).occurrence
    return mutations.remove(rows, rows.filter("annee < 1997").select("id")).select("id", "statut")


@register("k13_modifier", oracle("SELECT id, CASE WHEN statut = 'en_cours' THEN 'realise' ELSE statut END AS statut, CAST(CASE WHEN statut = 'en_cours' THEN montant_ht ELSE montant_engage END AS DOUBLE) AS montant_engage FROM d_occurrence"))
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Domain(spark, sf_dir).occurrence
    changed = mutations.update_where(rows, F.col("statut") == "en_cours", {"statut": F.lit("realise"), "montant_engage": F.col("montant_ht")}, {"statut", "montant_engage"})
    return plain(changed.select("id", "statut", "montant_engage"))
