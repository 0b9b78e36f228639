"""Queries on budgets, signals and the portfolio, with their oracles."""

# Fixed values in this module: the sentences of the signals, as the oracles must give them.

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import budget, portfolio, signals
from ledgerloom.plans.oracles import SQL_VIEWS, oracle
from ledgerloom.plans.registry import register
from ledgerloom.sources.domain import AS_OF, MONEY, Domain

YEAR = AS_OF.year


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, as the oracles print them."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def delta_of(d: Domain) -> DataFrame:
    return budget.budget_delta_annuel(d.occurrence)


def facts_of(d: Domain, organisation_id: int | None = None) -> DataFrame:
    """One row of facts per project; of one organisation's projects only, if it is given."""
    amounts = ("montant_initial", "montant_ht", "montant_engage", "montant_realise")
    projet, occurrence, rapport = d.projet, d.occurrence.select("projet_id", "id", "annee", "annee_initiale", "statut", *amounts), d.rapport
    if organisation_id is not None:
        projet = projet.filter(F.col("organisation_id") == organisation_id)
        own = projet.select(F.col("id").alias("projet_id"))
        occurrence, rapport = occurrence.join(own, "projet_id", "left_semi"), rapport.join(own, "projet_id", "left_semi")
    return portfolio.faits_par_projet(projet, occurrence, d.journal, rapport, AS_OF)


def signals_of(d: Domain) -> DataFrame:
    return portfolio.signaux_des_faits(facts_of(d))


def parc_of(d: Domain, organisation_id: int | None = None) -> DataFrame:
    return portfolio.parc_des_faits(facts_of(d, organisation_id), d.organisation)


SQL_VIEWS.update({
    "v_courant": """SELECT projet_id, annee, coalesce(sum(montant_ht), 0) AS prevu, coalesce(sum(montant_engage), 0) AS engage, coalesce(sum(montant_realise), 0) AS realise
        FROM d_occurrence WHERE statut <> 'supprime' GROUP BY projet_id, annee""",
    "v_initial": """SELECT projet_id, annee_initiale AS annee, coalesce(sum(montant_initial), 0) AS initial FROM d_occurrence
        WHERE montant_initial IS NOT NULL AND annee_initiale IS NOT NULL GROUP BY projet_id, annee_initiale""",
    "v_delta": """SELECT coalesce(c.projet_id, i.projet_id) AS projet_id, coalesce(c.annee, i.annee) AS annee, coalesce(initial, 0) AS initial, coalesce(prevu, 0) AS prevu,
        coalesce(engage, 0) AS engage, coalesce(realise, 0) AS realise, coalesce(prevu, 0) - coalesce(initial, 0) AS delta_prevu_initial
        FROM v_courant c FULL JOIN v_initial i ON i.projet_id = c.projet_id AND i.annee = c.annee""",
    "v_ecarts": """SELECT projet_id, coalesce(annee_initiale, annee) AS annee_ref,
        coalesce(sum(montant_initial) FILTER (WHERE statut = 'supprime' AND montant_initial IS NOT NULL), 0) AS annule,
        coalesce(sum(montant_ht) FILTER (WHERE statut <> 'supprime' AND annee_initiale IS NOT NULL AND annee <> annee_initiale), 0) AS glisse_sortant,
        coalesce(sum(montant_ht) FILTER (WHERE statut <> 'supprime' AND montant_initial IS NULL), 0) AS ajoute,
        coalesce(sum(montant_ht - montant_initial) FILTER (WHERE statut <> 'supprime' AND montant_initial IS NOT NULL AND annee = annee_initiale), 0) AS revision_prix
        FROM d_occurrence GROUP BY ALL""",
    "v_obligation": f"""SELECT id AS projet_id, organisation_id, CAST(unnest(generate_series(year(date_decision), least(year(coalesce(date_fin, DATE '{AS_OF}')), {YEAR} - 1))) AS INTEGER) AS annee
        FROM d_projet WHERE date_decision IS NOT NULL AND statut <> 'archive'""",
    "v_meilleur": """SELECT * FROM d_rapport QUALIFY row_number() OVER (PARTITION BY projet_id, annee ORDER BY (statut = 'valide') DESC, version DESC) = 1""",
    "v_fenetre": f"""SELECT id AS projet_id, organisation_id, CAST(unnest(generate_series(year(date_decision), year(coalesce(date_fin, DATE '{AS_OF}' + INTERVAL 1 YEAR)))) AS INTEGER) AS annee
        FROM d_projet WHERE date_decision IS NOT NULL""",
    "v_matrice": f"""SELECT f.projet_id, f.organisation_id, f.annee, coalesce(m.statut, CASE WHEN f.annee < {YEAR} THEN 'manquant' ELSE 'a_venir' END) AS etat, m.id AS rapport_id, m.version, m.valide_le
        FROM v_fenetre f LEFT JOIN v_meilleur m ON m.projet_id = f.projet_id AND m.annee = f.annee""",
    "v_sig_bilan": """SELECT o.projet_id, 'bilan_manquant' AS code, CASE WHEN count(*) >= 2 THEN 'critique' ELSE 'attention' END AS niveau,
        count(*) || ' bilan(s) annuel(s) non remis : ' || string_agg(CAST(annee AS VARCHAR), ', ' ORDER BY annee) || '.' AS libelle, CAST(count(*) AS DOUBLE) AS valeur
        FROM v_obligation o WHERE NOT EXISTS (SELECT 1 FROM d_rapport r WHERE r.projet_id = o.projet_id AND r.annee = o.annee AND r.statut = 'valide') GROUP BY o.projet_id""",
    "v_sig_retard": f"""SELECT projet_id, 'retard_execution' AS code, CASE WHEN max({YEAR} - annee) >= 2 THEN 'critique' ELSE 'attention' END AS niveau,
        count(*) || ' action(s) d''exercices échus non soldées, la plus ancienne de ' || min(annee) || '.' AS libelle, CAST(count(*) AS DOUBLE) AS valeur
        FROM d_occurrence WHERE statut IN ('planifie', 'en_cours', 'a_confirmer') AND annee < {YEAR} GROUP BY projet_id""",
    "v_sig_conso": f"""SELECT projet_id, 'sous_consommation' AS code, CASE WHEN t < 0.4::DOUBLE THEN 'critique' ELSE 'attention' END AS niveau,
        'Seuls ' || CAST(round(t * 100) AS INTEGER) || '% du budget prévu des exercices échus ont été facturés (' || CAST(CAST(round(r) AS DECIMAL(28,0)) AS VARCHAR) || ' sur ' || CAST(CAST(round(p) AS DECIMAL(28,0)) AS VARCHAR) || ').' AS libelle,
        round(t, 4) AS valeur FROM (SELECT projet_id, sum(prevu) AS p, sum(realise) AS r, CAST(sum(realise) AS DOUBLE) / CAST(nullif(sum(prevu), 0) AS DOUBLE) AS t FROM v_delta WHERE annee < {YEAR} GROUP BY projet_id)
        WHERE p > 0 AND t < 0.6::DOUBLE""",
    "v_derive": """SELECT oc.projet_id, sum(montant_initial) AS initial, sum(montant_ht) - sum(montant_initial) AS ecart,
        count(*) FILTER (WHERE abs(coalesce(montant_ht, 0) - montant_initial) >= 1 AND j.occurrence_id IS NULL) AS sans_motif
        FROM d_occurrence oc LEFT JOIN (SELECT DISTINCT occurrence_id FROM d_mouvement WHERE motif IS NOT NULL) j ON j.occurrence_id = oc.id
        WHERE montant_initial IS NOT NULL AND statut <> 'supprime' GROUP BY oc.projet_id""",
    "v_sig_derive": """SELECT projet_id, 'derive_non_justifiee' AS code, CASE WHEN t >= 0.25::DOUBLE THEN 'critique' ELSE 'attention' END AS niveau,
        'Écart de ' || CAST(round(CAST(ecart AS DOUBLE) * 100 / CAST(initial AS DOUBLE)) AS INTEGER) || '% au budget de référence (' || CAST(CAST(round(ecart) AS DECIMAL(28,0)) AS VARCHAR) || '), dont ' || sans_motif || ' ligne(s) sans motif renseigné.' AS libelle,
        round(t, 4) AS valeur FROM (SELECT *, CAST(abs(ecart) AS DOUBLE) / CAST(nullif(initial, 0) AS DOUBLE) AS t FROM v_derive) WHERE initial > 0 AND t >= 0.1::DOUBLE AND sans_motif > 0""",
    "v_activite_le": """SELECT p.id AS projet_id, greatest(coalesce(m, created_at), coalesce(r, created_at), updated_at) AS derniere FROM d_projet p
        LEFT JOIN (SELECT projet_id, max(modifie_le) AS m FROM d_mouvement GROUP BY projet_id) a ON a.projet_id = p.id
        LEFT JOIN (SELECT projet_id, max(genere_le) AS r FROM d_rapport GROUP BY projet_id) b ON b.projet_id = p.id WHERE statut NOT IN ('archive', 'clos')""",
    "v_sig_silence": f"""SELECT projet_id, 'silence' AS code, CASE WHEN derniere < TIMESTAMP '{AS_OF}' - INTERVAL 24 MONTH THEN 'critique' ELSE 'attention' END AS niveau,
        'Aucune activité enregistrée depuis ' || CAST(floor(s / 2592000) AS INTEGER) || ' mois (dernière le ' || strftime(derniere, '%d/%m/%Y') || ').' AS libelle, round(s / 2592000) AS valeur
        FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - derniere)) AS DOUBLE) AS s FROM v_activite_le) WHERE derniere < TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH""",
    "v_signal": "SELECT * FROM v_sig_bilan UNION ALL SELECT * FROM v_sig_retard UNION ALL SELECT * FROM v_sig_conso UNION ALL SELECT * FROM v_sig_derive UNION ALL SELECT * FROM v_sig_silence",
    "v_parc": f"""SELECT p.id AS projet_id, p.nom, p.reference_interne, p.organisation_id, o.nom AS organisation_nom, p.departement, p.statut, p.date_fin,
        CASE WHEN coalesce(s.nb_critique, 0) > 0 THEN 2 WHEN coalesce(s.nb_attention, 0) > 0 THEN 1 ELSE 0 END AS gravite,
        coalesce(s.nb_critique, 0) AS nb_critique, coalesce(s.nb_attention, 0) AS nb_attention, coalesce(s.codes, '') AS codes,
        coalesce(f.i, 0) AS total_initial, coalesce(f.p, 0) AS total_prevu, coalesce(f.e, 0) AS total_engage, coalesce(f.r, 0) AS total_realise, coalesce(f.p, 0) - coalesce(f.i, 0) AS delta_total,
        coalesce(f.pa, 0) AS prevu_annee_courante, coalesce(f.ra, 0) AS realise_annee_courante, f.a1 AS premiere_annee, f.a2 AS derniere_annee,
        coalesce(c.n, 0) AS nb_occurrences, coalesce(c.nr, 0) AS nb_occurrences_realisees, coalesce(c.np, 0) AS nb_occurrences_reportees,
        coalesce(b.bv, 0) AS nb_bilans_valides, coalesce(b.bm, 0) AS nb_bilans_manquants, b.bd AS dernier_bilan_valide
        FROM d_projet p JOIN d_organisation o ON o.id = p.organisation_id
        LEFT JOIN (SELECT projet_id, count(*) FILTER (WHERE niveau = 'critique') AS nb_critique, count(*) FILTER (WHERE niveau = 'attention') AS nb_attention,
            string_agg(code, ',' ORDER BY (niveau = 'critique') DESC, code) AS codes FROM v_signal GROUP BY projet_id) s ON s.projet_id = p.id
        LEFT JOIN (SELECT projet_id, sum(initial) AS i, sum(prevu) AS p, sum(engage) AS e, sum(realise) AS r, sum(prevu) FILTER (WHERE annee = {YEAR}) AS pa,
            sum(realise) FILTER (WHERE annee = {YEAR}) AS ra, min(annee) AS a1, max(annee) AS a2 FROM v_delta GROUP BY projet_id) f ON f.projet_id = p.id
        LEFT JOIN (SELECT projet_id, count(*) AS n, count(*) FILTER (WHERE statut = 'realise') AS nr, count(*) FILTER (WHERE statut = 'repousse') AS np
            FROM d_occurrence WHERE statut <> 'supprime' GROUP BY projet_id) c ON c.projet_id = p.id
        LEFT JOIN (SELECT projet_id, count(*) FILTER (WHERE etat = 'valide') AS bv, count(*) FILTER (WHERE etat = 'manquant') AS bm, max(annee) FILTER (WHERE etat = 'valide') AS bd
            FROM v_matrice GROUP BY projet_id) b ON b.projet_id = p.id""",
})


def doubles(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


@register("a01_budget_annuel", oracle(f"""SELECT projet_id, annee, count(*) FILTER (WHERE montant_ht IS NOT NULL) AS nb_lignes_chiffrees, count(*) AS nb_occurrences,
    CAST(coalesce(sum(montant_ht), 0) AS DOUBLE) AS total_ht, CAST(coalesce(sum(montant_realise), 0) AS DOUBLE) AS total_ht_realise, CAST(coalesce(sum(montant_engage), 0) AS DOUBLE) AS total_ht_engage
    FROM d_occurrence WHERE statut <> 'supprime' GROUP BY projet_id, annee"""))
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(budget.budget_annuel(Domain(spark, sf_dir).occurrence))


_DELTA = ("initial", "prevu", "engage", "realise", "delta_prevu_initial")


@register("a02_budget_delta_annuel", oracle(f"SELECT projet_id, annee, {doubles(*_DELTA)} FROM v_delta"))
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(delta_of(Domain(spark, sf_dir)))


@register("a03_budget_ecarts", oracle(f"SELECT projet_id, annee_ref, {doubles('annule', 'glisse_sortant', 'ajoute', 'revision_prix')} FROM v_ecarts"))
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(budget.budget_ecarts(Domain(spark, sf_dir).occurrence))


def _signal(name: str, view: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Domain(spark, sf_dir)
        made = {
            "v_sig_bilan": lambda: signals.bilan_manquant(signals.annees_obligation(d.projet, AS_OF), d.rapport),
            "v_sig_retard": lambda: signals.retard_execution(d.occurrence, AS_OF),
            "v_sig_conso": lambda: signals.sous_consommation(delta_of(d), AS_OF),
            "v_sig_derive": lambda: signals.derive_non_justifiee(d.occurrence, d.mouvement),
            "v_sig_silence": lambda: signals.silence(signals.derniere_activite(d.projet, d.mouvement, d.rapport), AS_OF),
            "v_signal": lambda: signals_of(d),
        }[view]()
        return made.select("projet_id", "code", "niveau", "libelle", "valeur")

    register(name, oracle(f"SELECT projet_id, code, niveau, libelle, valeur FROM {view}"))(query)


for _name, _view in [
    ("a04_signal_bilan_manquant", "v_sig_bilan"), ("a05_signal_retard", "v_sig_retard"), ("a06_signal_sous_consommation", "v_sig_conso"),
    ("a07_signal_derive", "v_sig_derive"), ("a08_signal_silence", "v_sig_silence"), ("u01_tous_les_signaux", "v_signal"),
]:
    _signal(_name, _view)


_DETAILS = [
    """SELECT o.projet_id, 'bilan_manquant' AS code, '{"annees":"' || string_agg(CAST(annee AS VARCHAR), ', ' ORDER BY annee) || '"}' AS detail
        FROM v_obligation o WHERE NOT EXISTS (SELECT 1 FROM d_rapport r WHERE r.projet_id = o.projet_id AND r.annee = o.annee AND r.statut = 'valide') GROUP BY o.projet_id""",
    f"""SELECT projet_id, 'retard_execution', '{{"annee_min":' || min(annee) || ',"montant_concerne":' || CAST(coalesce(sum(montant_ht), 0) AS DECIMAL(28,2)) || ',"occurrences":[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY annee, id) || ']}}'
        FROM d_occurrence WHERE statut IN ('planifie', 'en_cours', 'a_confirmer') AND annee < {YEAR} GROUP BY projet_id""",
    f"""SELECT v.projet_id, v.code, '{{"prevu_echu":' || CAST(p AS DECIMAL(28,2)) || ',"realise_echu":' || CAST(r AS DECIMAL(28,2)) || ',"non_consomme":' || CAST(p - r AS DECIMAL(28,2)) || '}}'
        FROM v_sig_conso v JOIN (SELECT projet_id, sum(prevu) AS p, sum(realise) AS r FROM v_delta WHERE annee < {YEAR} GROUP BY projet_id) d ON d.projet_id = v.projet_id""",
    """SELECT v.projet_id, v.code, '{"initial":' || CAST(initial AS DECIMAL(28,2)) || ',"prevu":' || CAST(initial + ecart AS DECIMAL(28,2)) || ',"ecart":' || CAST(ecart AS DECIMAL(28,2)) || ',"lignes_sans_motif":' || sans_motif || '}'
        FROM v_sig_derive v JOIN v_derive d ON d.projet_id = v.projet_id""",
    """SELECT v.projet_id, v.code, '{"derniere_activite":"' || CAST(derniere AS VARCHAR) || '"}' FROM v_sig_silence v JOIN v_activite_le a ON a.projet_id = v.projet_id""",
]


@register("c32_details_des_signaux", oracle(" UNION ALL ".join(_DETAILS)))
def c32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(Domain(spark, sf_dir)).select("projet_id", "code", "detail")


@register("a09_signaux_par_projet", oracle("""SELECT projet_id, count(*) FILTER (WHERE niveau = 'critique') AS nb_critique, count(*) FILTER (WHERE niveau = 'attention') AS nb_attention,
    string_agg(code || ':' || niveau, ',' ORDER BY (niveau = 'critique') DESC, code) AS signaux FROM v_signal GROUP BY projet_id"""))
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = signals.signaux_par_projet(signals_of(Domain(spark, sf_dir)))
    return rolled.withColumn("signaux", F.array_join(F.transform("signaux", lambda s: F.concat_ws(":", s["code"], s["niveau"])), ","))


@register("a10_finances_par_projet", oracle(f"""SELECT projet_id, CAST(sum(initial) AS DOUBLE) AS total_initial, CAST(sum(prevu) AS DOUBLE) AS total_prevu, CAST(sum(engage) AS DOUBLE) AS total_engage,
    CAST(sum(realise) AS DOUBLE) AS total_realise, CAST(sum(prevu) FILTER (WHERE annee = {YEAR}) AS DOUBLE) AS prevu_annee_courante, CAST(sum(realise) FILTER (WHERE annee = {YEAR}) AS DOUBLE) AS realise_annee_courante,
    min(annee) AS premiere_annee, max(annee) AS derniere_annee FROM v_delta GROUP BY projet_id"""))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(portfolio.finances_par_projet(delta_of(Domain(spark, sf_dir)), AS_OF))


@register("a11_statuts_par_projet", oracle("""SELECT projet_id, count(*) AS nb_occurrences, count(*) FILTER (WHERE statut = 'realise') AS nb_occurrences_realisees,
    count(*) FILTER (WHERE statut = 'repousse') AS nb_occurrences_reportees FROM d_occurrence WHERE statut <> 'supprime' GROUP BY projet_id"""))
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.statuts_par_projet(Domain(spark, sf_dir).occurrence)


_ORG_SQL = f"""SELECT o.id AS organisation_id, o.nom AS organisation_nom, count(v.projet_id) AS nb_projets, count(*) FILTER (WHERE v.gravite = 2) AS nb_projets_critiques,
    count(*) FILTER (WHERE v.gravite = 1) AS nb_projets_attention, count(*) FILTER (WHERE v.gravite = 0) AS nb_projets_conformes,
    CAST(coalesce(sum(total_prevu), 0) AS DOUBLE) AS total_prevu, CAST(coalesce(sum(total_realise), 0) AS DOUBLE) AS total_realise, CAST(coalesce(sum(total_initial), 0) AS DOUBLE) AS total_initial,
    CAST(coalesce(sum(delta_total), 0) AS DOUBLE) AS delta_total, CAST(sum(nb_bilans_valides) AS BIGINT) AS nb_bilans_valides, CAST(sum(nb_bilans_manquants) AS BIGINT) AS nb_bilans_manquants,
    CASE WHEN sum(nb_bilans_valides) + sum(nb_bilans_manquants) > 0 THEN round(CAST(sum(nb_bilans_valides) AS DOUBLE) / CAST(sum(nb_bilans_valides) + sum(nb_bilans_manquants) AS DOUBLE), 4) END AS taux_remise_bilans,
    CASE WHEN sum(total_prevu) > 0 THEN round(CAST(sum(total_realise) AS DOUBLE) / CAST(sum(total_prevu) AS DOUBLE), 4) END AS taux_execution,
    CASE WHEN sum(nb_occurrences) > 0 THEN round(CAST(sum(nb_occurrences_realisees) AS DOUBLE) / CAST(sum(nb_occurrences) AS DOUBLE), 4) END AS taux_actions_realisees
    FROM d_organisation o LEFT JOIN v_parc v ON v.organisation_id = o.id GROUP BY o.id, o.nom"""


@register("a12_parc_organisation", oracle(_ORG_SQL))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return plain(portfolio.parc_organisation(d.organisation, parc_of(d)))


@register("a13_parc_financier_annuel", oracle("""SELECT p.organisation_id, o.nom AS organisation_nom, v.annee, count(DISTINCT v.projet_id) AS nb_projets, CAST(sum(initial) AS DOUBLE) AS initial,
    CAST(sum(prevu) AS DOUBLE) AS prevu, CAST(sum(engage) AS DOUBLE) AS engage, CAST(sum(realise) AS DOUBLE) AS realise, CAST(sum(delta_prevu_initial) AS DOUBLE) AS delta
    FROM v_delta v JOIN d_projet p ON p.id = v.projet_id JOIN d_organisation o ON o.id = p.organisation_id GROUP BY ALL"""))
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return plain(portfolio.parc_financier_annuel(delta_of(d), d.projet, d.organisation))


@register("a14_synthese_parc", oracle("""SELECT *, CASE WHEN bilans_valides + bilans_manquants > 0 THEN round(CAST(bilans_valides AS DOUBLE) / CAST(bilans_valides + bilans_manquants AS DOUBLE), 4) END AS taux_remise_bilans FROM (
    SELECT count(*) AS nb_projets, count(DISTINCT organisation_id) AS nb_organisations, CAST(coalesce(sum(total_prevu), 0) AS DOUBLE) AS budget_total, CAST(coalesce(sum(total_realise), 0) AS DOUBLE) AS realise_cumule,
    CAST(coalesce(sum(realise_annee_courante), 0) AS DOUBLE) AS realise_annee_courante, count(*) FILTER (WHERE gravite = 0) AS nb_conformes, count(*) FILTER (WHERE gravite = 1) AS nb_attention,
    count(*) FILTER (WHERE gravite = 2) AS nb_critiques, CAST(coalesce(sum(nb_bilans_valides), 0) AS BIGINT) AS bilans_valides, CAST(coalesce(sum(nb_bilans_manquants), 0) AS BIGINT) AS bilans_manquants FROM v_parc)"""))
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(portfolio.synthese_parc(parc_of(Domain(spark, sf_dir))))


@register("a15_projets_par_signal", oracle("""SELECT s.code, count(DISTINCT s.projet_id) AS nb_projets, count(DISTINCT s.projet_id) FILTER (WHERE s.niveau = 'critique') AS nb_critiques
    FROM v_signal s JOIN v_parc p ON p.projet_id = s.projet_id GROUP BY s.code"""))
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    parc = parc_of(Domain(spark, sf_dir))
    return portfolio.projets_par_signal(portfolio.signaux_des_faits(parc))


_PARC = ["total_initial", "total_prevu", "total_engage", "total_realise", "delta_total", "prevu_annee_courante", "realise_annee_courante"]
_PARC_REST = ["projet_id", "nom", "organisation_id", "organisation_nom", "statut", "gravite", "nb_critique", "nb_attention", "codes", "premiere_annee", "derniere_annee", "nb_occurrences",
              "nb_occurrences_realisees", "nb_occurrences_reportees", "nb_bilans_valides", "nb_bilans_manquants", "dernier_bilan_valide"]


def _listed(parc: DataFrame) -> DataFrame:
    codes = F.coalesce(F.array_join(F.transform("signaux", lambda s: s["code"]), ","), F.lit(""))
    return plain(parc.withColumn("codes", codes).select(*_PARC_REST, *_PARC))


@register("j06_parc_projet", oracle(f"SELECT {', '.join(_PARC_REST)}, {doubles(*_PARC)} FROM v_parc"))
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(parc_of(Domain(spark, sf_dir)))


def _parc_list(name: str, where: str, **filters):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = filters.get("organisation_filtre", filters.get("organisation_id"))
        return _listed(portfolio.lister_parc(parc_of(Domain(spark, sf_dir), wanted), **filters))

    register(name, oracle(f"SELECT {', '.join(_PARC_REST)}, {doubles(*_PARC)} FROM v_parc WHERE {where}"))(query)


_parc_list("p08_parc_recherche", "nom ILIKE '%00001%' OR coalesce(reference_interne, '') ILIKE '%00001%'", q="00001")
_parc_list("p11_parc_par_signal", "contains(codes, 'silence')", signal="silence")
_parc_list("p12_parc_filtres", "organisation_id = 3 AND gravite = 2 AND statut = 'actif'", organisation_filtre=3, gravite=2, statut="actif")
_parc_list("p15_parc_operateur", "organisation_id = 7", role="operateur", organisation_id=7)
_parc_list("t01_file_de_controle", "gravite > 0", file_controle=True)


@register("t23_annees_obligation", oracle("SELECT projet_id, organisation_id, annee FROM v_obligation"))
def t23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.annees_obligation(Domain(spark, sf_dir).projet, AS_OF)


@register("t23b_matrice_bilans", oracle("SELECT projet_id, organisation_id, annee, etat, rapport_id, version, CAST(valide_le AS DATE) AS valide_le FROM v_matrice"))
def t23b(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return portfolio.matrice_bilans(d.projet, d.rapport, AS_OF).withColumn("valide_le", F.col("valide_le").cast("date"))


@register("p07_matrice_bornee", oracle("""SELECT m.projet_id, p.nom AS projet_nom, m.organisation_id, o.nom AS organisation_nom, m.annee, m.etat FROM v_matrice m JOIN d_projet p ON p.id = m.projet_id
    JOIN d_organisation o ON o.id = m.organisation_id WHERE m.annee >= 1998 AND m.annee <= 2001 AND m.organisation_id = 4"""))
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    cells = portfolio.matrice_bilans(d.projet, d.rapport, AS_OF).filter(F.col("annee").between(1998, 2001) & portfolio.peut_voir("operateur", 4))
    named = cells.join(d.projet.select(F.col("id").alias("projet_id"), F.col("nom").alias("projet_nom")), "projet_id")
    org = d.organisation.select(F.col("id").alias("organisation_id"), F.col("nom").alias("organisation_nom"))
    return named.join(org, "organisation_id").select("projet_id", "projet_nom", "organisation_id", "organisation_nom", "annee", "etat").orderBy("organisation_nom", "projet_nom", "annee")


@register("t10_meilleur_rapport", oracle("SELECT projet_id, annee, id, statut, version FROM v_meilleur"))
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.meilleur_rapport(Domain(spark, sf_dir).rapport).select("projet_id", "annee", "id", "statut", "version")


@register("a21_pluriannuel", oracle("""SELECT projet_id, CAST(coalesce(sum(realise) FILTER (WHERE annee <= 1998), 0) AS DOUBLE) AS cumul_realise_fin_annee,
    CAST(coalesce(sum(greatest(prevu - engage, 0)) FILTER (WHERE annee > 1998), 0) AS DOUBLE) AS restant_a_engager FROM v_delta GROUP BY projet_id"""))
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(budget.pluriannuel(delta_of(Domain(spark, sf_dir)), 1998))


@register("a22_par_categorie", oracle("""SELECT categorie, count(*) AS nb_lignes, CAST(coalesce(sum(montant_initial), 0) AS DOUBLE) AS total_montant_initial, CAST(coalesce(sum(montant_ht), 0) AS DOUBLE) AS total_montant_ht,
    CAST(coalesce(sum(montant_engage), 0) AS DOUBLE) AS total_montant_engage, CAST(coalesce(sum(montant_realise), 0) AS DOUBLE) AS total_montant_realise
    FROM d_occurrence WHERE annee = 1998 AND statut <> 'supprime' GROUP BY categorie"""))
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(budget.par_categorie(Domain(spark, sf_dir).occurrence.filter("annee = 1998 and statut <> 'supprime'")))


@register("a23_cascade", oracle("""SELECT projet_id, annee, ordre, poste, CAST(montant AS DOUBLE) AS montant, round_even(CAST(abs(montant) AS DOUBLE) / CAST(max(abs(montant)) OVER w AS DOUBLE) * 100, 1) AS largeur,
    CAST(delta - sum(montant) OVER w AS DOUBLE) AS residu FROM (
    SELECT e.projet_id, e.annee_ref AS annee, k AS ordre, poste, montant, v.prevu - v.initial AS delta FROM (
      SELECT projet_id, annee_ref, 0 AS k, 'glisse_sortant' AS poste, -abs(glisse_sortant) AS montant FROM v_ecarts UNION ALL SELECT projet_id, annee_ref, 1, 'annule', -abs(annule) FROM v_ecarts
      UNION ALL SELECT projet_id, annee_ref, 2, 'ajoute', ajoute FROM v_ecarts UNION ALL SELECT projet_id, annee_ref, 3, 'revision_prix', revision_prix FROM v_ecarts) e
    JOIN v_delta v ON v.projet_id = e.projet_id AND v.annee = e.annee_ref WHERE abs(montant) >= 1) WINDOW w AS (PARTITION BY projet_id, annee)"""))
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return plain(budget.cascade(budget.budget_ecarts(d.occurrence), delta_of(d)))


@register("a25_sous_execution", oracle("""SELECT v.projet_id, v.annee, round(s.k::DOUBLE / s.n::DOUBLE, 4) AS part_soldee, CASE WHEN prevu > 0 THEN round(CAST(realise AS DOUBLE) / CAST(prevu AS DOUBLE), 4) END AS taux_execution,
    coalesce(s.k::DOUBLE / s.n::DOUBLE >= 0.7::DOUBLE AND CASE WHEN prevu > 0 THEN CAST(realise AS DOUBLE) / CAST(prevu AS DOUBLE) END < 0.7::DOUBLE, FALSE) AS sous_execution
    FROM v_delta v JOIN (SELECT projet_id, annee, count(*) AS n, count(*) FILTER (WHERE statut IN ('realise', 'repousse')) AS k FROM d_occurrence WHERE statut <> 'supprime' GROUP BY ALL) s
    ON s.projet_id = v.projet_id AND s.annee = v.annee"""))
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return budget.sous_execution(delta_of(d), d.occurrence)


@register("a27_controle_croise", oracle("""SELECT feuille, CAST(d AS DOUBLE) AS detail, CAST(t AS DOUBLE) AS declare, CAST(abs(t - d) AS DOUBLE) AS ecart FROM (
    SELECT l_partkey % 400 AS feuille, sum(m) FILTER (WHERE NOT tot) AS d, max(m) FILTER (WHERE tot) AS t FROM (
      SELECT l_partkey, l_linenumber = 7 AS tot, CAST(l_extendedprice AS DECIMAL(18,2)) AS m FROM lineitem) GROUP BY 1) WHERE t IS NOT NULL AND d IS NOT NULL AND abs(t - d) > abs(t) * 0.01"""))
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Domain(spark, sf_dir).raw("lineitem").select(
        (F.col("l_partkey") % 400).alias("feuille"), (F.col("l_linenumber") == 7).alias("est_total"), F.col("l_extendedprice").cast(MONEY).alias("montant"))
    return plain(budget.controle_croise(lines))


@register("a33_synthese_taux", oracle(f"""SELECT projet_id, annee, {doubles(*_DELTA)}, CASE WHEN prevu <> 0 THEN round_even(CAST(realise AS DOUBLE) / CAST(prevu AS DOUBLE), 4) END AS taux_execution,
    CASE WHEN prevu <> 0 THEN round_even(CAST(engage AS DOUBLE) / CAST(prevu AS DOUBLE), 4) END AS taux_engagement FROM v_delta"""))
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(budget.synthese(delta_of(Domain(spark, sf_dir))))


@register("a34_borne_donnees", oracle("SELECT projet_id, CAST(max(modifie_le) AS DATE) AS borne FROM d_mouvement GROUP BY projet_id"))
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).mouvement.groupBy("projet_id").agg(F.max("modifie_le").cast("date").alias("borne"))
