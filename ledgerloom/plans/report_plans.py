"""Queries on reports, predicates, joins, scalars and geometry, with their oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import budget, export_check, geo, mutations, report, signals
from ledgerloom.plans.oracles import SQL_VIEWS, oracle
from ledgerloom.plans.portfolio_plans import delta_of, doubles, plain, signals_of
from ledgerloom.plans.registry import register
from ledgerloom.sources.domain import AS_OF, MONEY, THRESHOLDS, Domain

SQL_VIEWS.update({
    "v_motifs": "SELECT occurrence_id, champ, motif FROM d_mouvement WHERE motif IS NOT NULL QUALIFY row_number() OVER (PARTITION BY occurrence_id, champ ORDER BY modifie_le DESC, id DESC) = 1",
    "v_lignes": """SELECT o.*, m.motifs, CASE WHEN montant_initial IS NOT NULL THEN coalesce(montant_ht, 0) - montant_initial END AS ecart_initial FROM d_occurrence o
        LEFT JOIN (SELECT occurrence_id, string_agg(champ || '=' || motif, ';' ORDER BY champ) AS motifs FROM v_motifs GROUP BY 1) m ON m.occurrence_id = o.id WHERE annee = 1997 AND statut <> 'supprime'""",
    "v_controles": """SELECT projet_id, 'statuts_non_soldes' AS code, 'bloquant' AS niveau, count(*) AS nb, min(id) AS premiere FROM v_lignes WHERE statut IN ('planifie', 'en_cours', 'a_confirmer') GROUP BY 1
        UNION ALL SELECT projet_id, 'ecarts_sans_motif', 'avertissement', count(*), min(id) FROM v_lignes WHERE abs(ecart_initial) >= 1 AND motifs IS NULL GROUP BY 1
        UNION ALL SELECT projet_id, 'lignes_sans_montant', 'avertissement', count(*), min(id) FROM v_lignes WHERE montant_ht IS NULL GROUP BY 1
        UNION ALL SELECT projet_id, 'champs_a_confirmer', 'avertissement', count(*), min(id) FROM v_lignes WHERE len(champs_a_confirmer) > 0 GROUP BY 1
        UNION ALL SELECT id, 'baseline_absente', 'bloquant', 0, NULL FROM d_projet p WHERE NOT EXISTS (SELECT 1 FROM d_baseline b WHERE b.projet_id = p.id)""",
    "v_geo": "SELECT o_orderkey AS id, o_custkey AS projet_id, o_orderkey % 3 AS couche, o_orderkey % 9 AS ug FROM orders",
})


def lines_of(d: Domain) -> DataFrame:
    return report.lignes(d.occurrence, d.mouvement, 1997)


def checks_of(d: Domain) -> DataFrame:
    return report.controles(lines_of(d), d.projet, d.baseline, 1997, AS_OF)


def simple(name: str, sql: str, make) -> None:
    """Register a query that is one expression over the domain."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(Domain(spark, sf_dir))

    register(name, oracle(sql))(query)


simple("t09_derniers_motifs", "SELECT occurrence_id, champ, motif FROM v_motifs", lambda d: report.derniers_motifs(d.mouvement))
simple("j15_lignes_et_motifs", "SELECT id, projet_id, code, motifs, CAST(ecart_initial AS DOUBLE) AS ecart_initial, montant_initial IS NULL AS ajoutee_apres_baseline FROM v_lignes",
       lambda d: plain(lines_of(d).select("id", "projet_id", "code", F.array_join(F.transform(F.array_sort(F.map_entries("motifs")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("motifs"),
                                          "ecart_initial", "ajoutee_apres_baseline")))
simple("a26_controles", "SELECT projet_id, code, niveau, nb, premiere FROM v_controles",
       lambda d: checks_of(d).select("projet_id", "code", "niveau", "nb", F.array_min("occurrences").alias("premiere")))
simple("j23_raccordement", """SELECT r.projet_id, r.id AS bilan_precedent_id, r.version AS bilan_precedent_version, CAST(r.archive_prevu AS DOUBLE) AS archive_prevu, CAST(round(coalesce(v.prevu, 0) - r.archive_prevu, 2) AS DOUBLE) AS ecart_prevu,
    abs(round(coalesce(v.prevu, 0) - r.archive_prevu, 2)) >= 1 AS corrections_posterieures FROM (SELECT * FROM d_rapport WHERE statut = 'valide' AND annee = 1997 QUALIFY row_number() OVER (PARTITION BY projet_id ORDER BY version DESC) = 1) r
    LEFT JOIN v_delta v ON v.projet_id = r.projet_id AND v.annee = 1997""", lambda d: plain(report.raccordement(d.rapport, delta_of(d), 1998)))
simple("p06_journal_annee", "SELECT m.id, m.occurrence_id, m.champ, m.motif, o.code AS occurrence_code, o.annee AS occurrence_annee FROM d_mouvement m JOIN d_occurrence o ON o.id = m.occurrence_id WHERE m.modifie_le >= make_date(2000, 1, 1) AND m.modifie_le < make_date(2001, 1, 1)",
       lambda d: report.journal(d.mouvement, d.occurrence, 2000).select("id", "occurrence_id", "champ", "motif", "occurrence_code", "occurrence_annee"))
simple("t15_derniere_baseline", "SELECT projet_id, id, libelle, CAST(total_ht AS DOUBLE) AS total_ht FROM d_baseline QUALIFY row_number() OVER (PARTITION BY projet_id ORDER BY figee_le DESC, id DESC) = 1",
       lambda d: plain(report.derniere_baseline(d.baseline).drop("figee_le")))
simple("k17_valider_brouillons", """SELECT r.id, r.projet_id, CASE WHEN statut = 'brouillon' AND coalesce(n, 0) = 0 THEN 'valide' ELSE statut END AS statut,
    CASE WHEN statut = 'brouillon' AND coalesce(n, 0) = 0 THEN 'valide' WHEN statut = 'brouillon' THEN 'refuse' ELSE 'inchange' END AS decision FROM d_rapport r
    LEFT JOIN (SELECT projet_id, count(*) AS n FROM v_controles WHERE niveau = 'bloquant' GROUP BY 1) c ON c.projet_id = r.projet_id""",
       lambda d: report.valider(d.rapport, checks_of(d), False, dt.datetime(2000, 6, 30)).select("id", "projet_id", "statut", "decision"))
simple("t29_bilan", f"""SELECT p.id AS projet_id, CAST(v.prevu AS DOUBLE) AS prevu, CAST(e.revision_prix AS DOUBLE) AS revision_prix, coalesce(l.n, 0) AS nb_lignes, coalesce(c.n, 0) AS nb_controles, coalesce(y.n, 0) AS nb_annees, b.libelle AS baseline FROM d_projet p
    LEFT JOIN v_delta v ON v.projet_id = p.id AND v.annee = 1997 LEFT JOIN v_ecarts e ON e.projet_id = p.id AND e.annee_ref = 1997
    LEFT JOIN (SELECT projet_id, count(*) AS n FROM v_lignes GROUP BY 1) l ON l.projet_id = p.id LEFT JOIN (SELECT projet_id, count(*) AS n FROM v_controles GROUP BY 1) c ON c.projet_id = p.id
    LEFT JOIN (SELECT projet_id, count(*) AS n FROM v_delta GROUP BY 1) y ON y.projet_id = p.id
    LEFT JOIN (SELECT * FROM d_baseline QUALIFY row_number() OVER (PARTITION BY projet_id ORDER BY figee_le DESC, id DESC) = 1) b ON b.projet_id = p.id""",
       lambda d: plain(report.bilan(d.projet, delta_of(d), budget.budget_ecarts(d.occurrence), lines_of(d), checks_of(d), d.baseline, 1997).select(
           "projet_id", F.col("synthese.prevu").alias("prevu"), F.col("ecarts.revision_prix").alias("revision_prix"),
           *[F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(n) for c, n in ((F.coalesce("lignes", F.array()), "nb_lignes"), (F.coalesce("controles", F.array()), "nb_controles"), (F.coalesce("pluriannuel", F.array()), "nb_annees"))],
           F.col("baseline.libelle").alias("baseline"))))

# Predicates and top-n on single tables.
simple("p01_p04_predicats", "SELECT id, projet_id FROM d_occurrence WHERE projet_id = 7 AND statut <> 'supprime' AND annee IN (1997, 1998, 1999) AND prestataire_id IS NOT NULL",
       lambda d: d.occurrence.filter((F.col("projet_id") == 7) & (F.col("statut") != "supprime") & F.col("annee").isin(1997, 1998, 1999) & F.col("prestataire_id").isNotNull()).select("id", "projet_id"))
simple("p03_hors_liste", "SELECT id FROM d_projet WHERE statut NOT IN ('archive', 'clos')", lambda d: d.projet.filter(~F.col("statut").isin("archive", "clos")).select("id"))
simple("p05_difference_sans_null", "SELECT id FROM d_occurrence WHERE montant_ht IS DISTINCT FROM montant_initial", lambda d: d.occurrence.filter(~F.col("montant_ht").eqNullSafe(F.col("montant_initial"))).select("id"))
simple("p10_contient_toutes", "SELECT id FROM d_occurrence WHERE list_has_all(ug_ids, ['ug1', 'ug3'])", lambda d: d.occurrence.filter(F.size(F.array_except(F.array(F.lit("ug1"), F.lit("ug3")), "ug_ids")) == 0).select("id"))
simple("p17_references_regulieres", "SELECT id, reference_interne FROM d_projet WHERE regexp_matches(reference_interne, '^REF-[0-9]{3}$')", lambda d: d.projet.filter(F.col("reference_interne").rlike("^REF-[0-9]{3}$")).select("id", "reference_interne"))
simple("p20_source_par_cas", "SELECT id, CASE WHEN statut = 'realise' THEN 2 WHEN statut IN ('en_cours', 'planifie') THEN 1 ELSE 0 END AS rang, CAST(NULL AS VARCHAR) AS note, CAST(0 AS DOUBLE) AS dette FROM d_occurrence",
       lambda d: d.occurrence.select("id", F.when(F.col("statut") == "realise", 2).when(F.col("statut").isin("en_cours", "planifie"), 1).otherwise(0).alias("rang"), F.lit(None).cast("string").alias("note"), F.lit(0.0).alias("dette")))
simple("p22_contraintes", """SELECT id, CASE WHEN mois_debut IS NULL AND mois_fin IS NULL THEN 'mois' WHEN montant_ht < 0 THEN 'montant' WHEN annee < annee_initiale THEN 'annee' END AS regle FROM d_occurrence
    WHERE (mois_debut IS NULL AND mois_fin IS NULL) OR montant_ht < 0 OR annee < annee_initiale""",
       lambda d: d.occurrence.select("id", F.when(F.col("mois_debut").isNull() & F.col("mois_fin").isNull(), "mois").when(F.col("montant_ht") < 0, "montant").when(F.col("annee") < F.col("annee_initiale"), "annee").alias("regle")).filter("regle is not null"))
simple("p24_colonnes_derivees", "SELECT p.id, CAST(date_decision + to_years(duree_annees) AS DATE) AS date_fin, f.siret_norm FROM d_projet p LEFT JOIN d_prestataire f ON f.id = p.id",
       lambda d: d.projet.select("id", S.end_date(F.col("date_decision"), F.col("duree_annees")).alias("date_fin")).join(d.prestataire.select("id", S.normalize_siret(F.col("siret")).alias("siret_norm")), "id", "left"))
simple("p25_documents_globaux", "SELECT doc_id, lang FROM documents WHERE nullif(lang, 'en') IS NULL AND source <> 'src3'", lambda d: d.raw("documents").filter(F.nullif("lang", F.lit("en")).isNull() & (F.col("source") != "src3")).select("doc_id", "lang"))
simple("p26_liste_par_projet", "SELECT id, code, titre FROM d_occurrence WHERE projet_id = 11 ORDER BY annee, code, id", lambda d: d.occurrence.filter("projet_id = 11").orderBy("annee", "code", "id").select("id", "code", "titre"))
simple("p27_vocabulaire", "SELECT categorie, count(*) AS nb FROM d_occurrence WHERE categorie NOT IN ('TE', 'TU', 'MR') GROUP BY 1", lambda d: d.occurrence.filter(~F.col("categorie").isin("TE", "TU", "MR")).groupBy("categorie").agg(F.count("*").alias("nb")))
simple("p28_valeurs_par_defaut", "SELECT id, CAST(coalesce(montant_ht, 0) AS DOUBLE) AS montant_ht, coalesce(confiance, 0) AS confiance, len(champs_a_confirmer) AS n FROM d_occurrence",
       lambda d: d.occurrence.select("id", F.coalesce("montant_ht", F.lit(0)).cast("double").alias("montant_ht"), F.coalesce("confiance", F.lit(0.0)).alias("confiance"), F.size("champs_a_confirmer").cast("bigint").alias("n")))
simple("t03_derniers_mouvements", "SELECT id, occurrence_id, champ FROM d_mouvement ORDER BY modifie_le DESC, id DESC LIMIT 50", lambda d: d.mouvement.orderBy(F.desc("modifie_le"), F.desc("id")).limit(50).select("id", "occurrence_id", "champ"))

# Joins.
simple("j01_mouvements_et_occurrences", "SELECT m.id, m.champ, o.code, o.annee FROM d_mouvement m JOIN d_occurrence o ON o.id = m.occurrence_id", lambda d: d.mouvement.join(d.occurrence.select(F.col("id").alias("occurrence_id"), "code", "annee"), "occurrence_id").select("id", "champ", "code", "annee"))
simple("j02_projets_et_organisations", "SELECT p.id, p.nom, o.nom AS organisation_nom, r.r_name AS region FROM d_projet p JOIN d_organisation o ON o.id = p.organisation_id JOIN region r ON r.r_regionkey = o.region_id",
       lambda d: d.projet.join(d.organisation.select(F.col("id").alias("organisation_id"), F.col("nom").alias("organisation_nom"), F.col("region_id").alias("r_regionkey")), "organisation_id").join(d.raw("region"), "r_regionkey").select("id", "nom", "organisation_nom", F.col("r_name").alias("region")))
simple("j08_sans_rapport", "SELECT projet_id, annee FROM v_obligation o WHERE NOT EXISTS (SELECT 1 FROM d_rapport r WHERE r.projet_id = o.projet_id AND r.annee = o.annee AND r.statut = 'valide')",
       lambda d: signals.annees_obligation(d.projet, AS_OF).select("projet_id", "annee").join(d.rapport.filter("statut = 'valide'").select("projet_id", "annee"), ["projet_id", "annee"], "left_anti"))
simple("j10_sans_motif", "SELECT projet_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM d_mouvement m WHERE m.occurrence_id = o.id AND m.motif IS NOT NULL)) AS nb FROM d_occurrence o GROUP BY projet_id",
       lambda d: d.occurrence.join(d.mouvement.filter("motif is not null").select(F.col("occurrence_id").alias("id")).distinct().withColumn("ok", F.lit(True)), "id", "left").groupBy("projet_id").agg(F.count_if(F.col("ok").isNull()).alias("nb")))
simple("j12_depliage_ug", "SELECT id, unnest(ug_ids) AS ug FROM d_occurrence", lambda d: d.occurrence.select("id", F.explode("ug_ids").alias("ug")))
simple("j14_derniere_activite", "SELECT projet_id, CAST(derniere AS DATE) AS derniere FROM v_activite_le", lambda d: signals.derniere_activite(d.projet, d.mouvement, d.rapport).select("projet_id", F.col("derniere_activite").cast("date").alias("derniere")))
simple("j18_regles_jamais_placees", "SELECT id FROM d_echeance e WHERE NOT EXISTS (SELECT 1 FROM d_occurrence o WHERE o.echeance_id = e.id)", lambda d: d.echeance.join(d.occurrence.select(F.col("echeance_id").alias("id")), "id", "left_anti").select("id"))
simple("j20_theme_par_cle_composee", "SELECT e.id, coalesce(f.lib_thema, 'autre') AS theme FROM d_echeance e LEFT JOIN d_fiche f ON f.projet_id = e.projet_id AND f.cle = e.action_cle",
       lambda d: d.echeance.join(d.fiche.select("projet_id", F.col("cle").alias("action_cle"), "lib_thema"), ["projet_id", "action_cle"], "left").select("id", F.coalesce("lib_thema", F.lit("autre")).alias("theme")))
simple("j21_hierarchie", "SELECT n.n_nationkey AS id, n.n_name AS nom, r.r_name AS parent FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey", lambda d: d.raw("nation").join(d.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nom"), F.col("r_name").alias("parent")))
simple("j24_seuils", "SELECT projet_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN 'critique' ELSE 'attention' END AS niveau FROM d_occurrence WHERE statut = 'repousse' GROUP BY 1",
       lambda d: d.occurrence.filter("statut = 'repousse'").groupBy("projet_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(d.spark.createDataFrame(THRESHOLDS, "code string, valeur double").filter("code = 'bilan_manquant_critique'").select("valeur"))).select("projet_id", "n", F.when(F.col("n") >= F.col("valeur"), "critique").otherwise("attention").alias("niveau")))

# Aggregates.
simple("a16_bilan_prestataires", "SELECT prestataire_id, count(*) AS nb, count(DISTINCT projet_id) AS projets, CAST(sum(montant_realise) AS DOUBLE) AS realise FROM d_occurrence WHERE prestataire_id IS NOT NULL GROUP BY 1",
       lambda d: plain(d.occurrence.filter("prestataire_id is not null").groupBy("prestataire_id").agg(F.count("*").alias("nb"), F.countDistinct("projet_id").alias("projets"), F.sum("montant_realise").alias("realise"))))
simple("a17_projets_par_departement", "SELECT departement, count(DISTINCT id) AS nb_projets FROM d_projet p WHERE EXISTS (SELECT 1 FROM v_geo g WHERE g.projet_id = p.id AND g.couche = 0) OR EXISTS (SELECT 1 FROM v_geo g WHERE g.projet_id = p.id AND g.couche = 1) OR EXISTS (SELECT 1 FROM v_geo g WHERE g.projet_id = p.id AND g.couche = 2) GROUP BY 1",
       lambda d: geo.projets_par_departement(d.projet, [_layer(d, k) for k in range(3)]))
simple("a18_ug_distinctes", "SELECT projet_id, string_agg(DISTINCT u, ',' ORDER BY u) AS ugs FROM (SELECT projet_id, unnest(ug_ids) AS u FROM d_occurrence) WHERE u <> 'ug0' GROUP BY 1",
       lambda d: d.occurrence.select("projet_id", F.explode("ug_ids").alias("u")).filter("u <> 'ug0'").groupBy("projet_id").agg(F.array_join(F.array_sort(F.collect_set("u")), ",").alias("ugs")))
simple("a19_liste_annees", "SELECT projet_id, string_agg(CAST(annee AS VARCHAR), ', ' ORDER BY annee) AS annees FROM v_obligation GROUP BY 1",
       lambda d: signals.annees_obligation(d.projet, AS_OF).groupBy("projet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("annee")), lambda y: y.cast("string")), ", ").alias("annees")))
simple("a20_motifs_en_table", "SELECT occurrence_id, string_agg(champ || '=' || motif, ';' ORDER BY champ) AS motifs FROM v_motifs GROUP BY 1",
       lambda d: report.derniers_motifs(d.mouvement).groupBy("occurrence_id").agg(F.map_from_entries(F.collect_list(F.struct("champ", "motif"))).alias("m")).select("occurrence_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("motifs")))
simple("a24_largeurs_annees", "SELECT projet_id, annee, round_even(CAST(prevu AS DOUBLE) / greatest(CAST(max(prevu) OVER (PARTITION BY projet_id) AS DOUBLE), 1) * 100, 1) AS largeur FROM v_delta",
       lambda d: budget.largeurs(delta_of(d)))
simple("a28_compteurs_import", "SELECT origine, count(*) AS lignes, count(*) FILTER (WHERE montant_ht IS NULL) AS sans_montant, count(*) FILTER (WHERE len(champs_a_confirmer) > 0) AS a_confirmer FROM d_occurrence GROUP BY 1",
       lambda d: d.occurrence.groupBy("origine").agg(F.count("*").alias("lignes"), F.count_if(F.col("montant_ht").isNull()).alias("sans_montant"), F.count_if(F.size("champs_a_confirmer") > 0).alias("a_confirmer")))
simple("a29_resume_ug", "SELECT 'ug' || ug AS ug_id, arg_min('L' || id, id) AS libelle, string_agg(DISTINCT 'c' || couche, ',' ORDER BY 'c' || couche) AS couches, count(*) AS nb FROM v_geo GROUP BY 1",
       lambda d: geo.resume_ug(_layers(d)))
simple("a30_frequence_statuts", "SELECT statut, count(*) AS nb FROM d_occurrence GROUP BY 1", lambda d: d.occurrence.groupBy("statut").agg(F.count("*").alias("nb")))
simple("a31_cout_par_type", "SELECT event_type, round(sum(length(props)) * 1.5::DOUBLE / 1000000 + count(*) * 7.5::DOUBLE / 1000000, 9) AS cout FROM events GROUP BY 1",
       lambda d: d.raw("events").groupBy("event_type").agg(F.round(F.sum(F.length("props")) * F.lit(1.5) / 1000000 + F.count("*") * F.lit(7.5) / 1000000, 9).alias("cout")))
simple("u03_couches", "SELECT id, projet_id, 'c0' AS couche FROM v_geo WHERE couche = 0 UNION ALL SELECT id, projet_id, 'c1' FROM v_geo WHERE couche = 1 UNION ALL SELECT id, projet_id, 'c2' FROM v_geo WHERE couche = 2", lambda d: _layers(d).select("id", "projet_id", "couche"))
simple("u04_distincts", "SELECT DISTINCT projet_id, code FROM d_occurrence", lambda d: d.occurrence.select("projet_id", "code").distinct())
simple("k26_apparier_geometries", """SELECT g.projet_id, g.n, geom_id, ug_id FROM (SELECT projet_id, id AS geom_id, CAST(row_number() OVER (PARTITION BY projet_id ORDER BY id) AS INTEGER) AS n FROM v_geo) g JOIN
    (SELECT projet_id, ug_id, CAST(row_number() OVER (PARTITION BY projet_id ORDER BY ug_id) AS INTEGER) AS n FROM (SELECT DISTINCT projet_id, 'ug' || ug AS ug_id FROM v_geo)) u ON u.projet_id = g.projet_id AND u.n = g.n""",
       lambda d: geo.apparier(_layers(d).select("projet_id", F.col("id").alias("geom_id")), _layers(d).select("projet_id", "ug_id").distinct()))


def _layer(d: Domain, k: int) -> DataFrame:
    rows = d.raw("orders").filter(F.col("o_orderkey") % 3 == k)
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("projet_id"), F.lit(f"c{k}").alias("couche"), F.concat(F.lit("ug"), (F.col("o_orderkey") % 9).cast("string")).alias("ug_id"),
                       F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("libelle"), F.col("o_orderkey").alias("ordre"))


def _layers(d: Domain) -> DataFrame:
    return _layer(d, 0).unionByName(_layer(d, 1)).unionByName(_layer(d, 2))


# Scalars, over raw columns that carry the dirt they clean.
simple("c01_c02_unites", "SELECT p_partkey AS id, nullif(lower(regexp_replace(' ' || p_name || '-1', '[^a-zA-Z0-9]', '', 'g')), '') AS un, array_to_string(list_sort(list_distinct(list_transform(string_split(upper(p_name) || ' ' || p_name || ' !', ' '), lambda x: nullif(lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')), '')))), ',') AS plusieurs FROM part",
       lambda d: d.raw("part").select(F.col("p_partkey").alias("id"), S.normalize_ug_id(F.concat(F.lit(" "), "p_name", F.lit("-1"))).alias("un"), F.array_join(S.normalize_ug_ids(F.split(F.concat(F.upper("p_name"), F.lit(" "), "p_name", F.lit(" !")), " ")), ",").alias("plusieurs")))
simple("c03_siret", "SELECT id, siret_norm FROM d_prestataire", lambda d: d.prestataire.select("id", S.normalize_siret(F.col("siret")).alias("siret_norm")))
simple("c04_c05_codes", "SELECT id, upper(replace(code_operation, ' ', '')) AS code, regexp_replace(upper(replace(code_operation, ' ', '')), '^([A-Z]+)\\s*(\\d+)$', '\\1 \\2') AS affiche FROM d_echeance",
       lambda d: d.echeance.select("id", S.normalize_code(F.col("code_operation")).alias("code"), S.display_code(S.normalize_code(F.col("code_operation"))).alias("affiche")))
simple("c06_c07_themes", "SELECT id, CASE WHEN trim(lib_thema) IN ('R2.1a', 'R1.1') THEN trim(lib_thema) ELSE 'autre' END AS connu, coalesce(nullif(nullif(lib_thema, ''), 'autre'), nullif(nullif(CASE WHEN id % 3 = 0 THEN 'R9' END, ''), 'autre'), 'autre') AS premier FROM d_occurrence",
       lambda d: d.occurrence.select("id", S.known_theme(F.col("lib_thema"), ["R2.1a", "R1.1"]).alias("connu"), S.first_theme(F.col("lib_thema"), F.when(F.col("id") % 3 == 0, "R9")).alias("premier")))
simple("c08_c09_apercus", "SELECT id, 'Message ' || turn || ' de ' || acteur || ' : ' || left(corps, 120) || CASE WHEN length(corps) > 120 THEN '…' ELSE '' END AS apercu FROM d_message",
       lambda d: d.message.select("id", F.concat(F.lit("Message "), F.col("turn").cast("string"), F.lit(" de "), "acteur", F.lit(" : "), S.preview(F.col("corps"))).alias("apercu")))
simple("c10_c11_textes_export", "SELECT id, left(coalesce(nullif(trim(titre), ''), '-'), 8) AS texte, length(coalesce(nullif(trim(titre), ''), '-')) > 8 AS tronque, array_to_string(list_filter([trim(categorie), trim(lib_thema)], lambda x: x IS NOT NULL AND x <> ''), '|') AS cibles FROM d_occurrence",
       lambda d: d.occurrence.select("id", S.fit(F.col("titre"), 8).alias("f"), S.join_targets(F.array("categorie", "lib_thema")).alias("cibles")).select("id", "f.texte", "f.tronque", "cibles"))
simple("c12_c13_noms_de_fichier", "SELECT p_partkey AS id, regexp_replace(left(regexp_replace(regexp_replace('Ete odz fi 12 ' || p_name || ' a Zoe!', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), '_+$', '') AS slug, regexp_replace(p_name || ' #1.pdf', '[^A-Za-z0-9._-]+', '_', 'g') AS fichier FROM part",
       lambda d: d.raw("part").select(F.col("p_partkey").alias("id"), S.slugify(F.concat(F.lit("Été Łódź ﬁ ½ "), "p_name", F.lit(" à Zoë!"))).alias("slug"), S.safe_file_name(F.concat("p_name", F.lit(" #1.pdf"))).alias("fichier")))
simple("c14_projections", "SELECT id, CASE WHEN k IN ('2A', '2B') OR (regexp_matches(k, '^[0-9]{2}$') ) THEN 2154 WHEN k = '971' THEN 5490 WHEN k = '972' THEN 5490 WHEN k = '973' THEN 3857 WHEN k = '974' THEN 2975 WHEN k = '976' THEN 4471 WHEN regexp_matches(k, '^[0-9]$') THEN 2154 END AS srid FROM (SELECT id, CASE WHEN id % 11 = 0 THEN '2a' WHEN id % 13 = 0 THEN '974' WHEN id % 7 = 0 THEN '999' ELSE departement END AS dep, upper(trim(CASE WHEN id % 11 = 0 THEN '2a' WHEN id % 13 = 0 THEN '974' WHEN id % 7 = 0 THEN '999' ELSE departement END)) AS k FROM d_projet)",
       lambda d: d.projet.select("id", S.department_srid(F.when(F.col("id") % 11 == 0, "2a").when(F.col("id") % 13 == 0, "974").when(F.col("id") % 7 == 0, "999").otherwise(F.col("departement"))).alias("srid")))
simple("c15_c18_dates", f"SELECT id, last_day(make_date(CASE WHEN mois_debut > mois_fin THEN annee + 1 ELSE annee END, coalesce(mois_fin, mois_debut, 12), 1)) AS deadline, CAST(last_day(make_date(CASE WHEN mois_debut > mois_fin THEN annee + 1 ELSE annee END, coalesce(mois_fin, mois_debut, 12), 1)) - DATE '{AS_OF}' AS INTEGER) AS jours FROM d_occurrence",
       lambda d: (lambda e: d.occurrence.select("id", e.alias("deadline"), F.datediff(e, F.lit(AS_OF)).alias("jours")))(S.deadline(F.col("annee"), F.col("mois_debut"), F.col("mois_fin"))))
simple("c19_c20_ages", f"SELECT id, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - maj_le) / 86400) AS INTEGER) AS jours, strftime(maj_le, '%d/%m/%Y') AS le FROM d_demande",
       lambda d: d.demande.select("id", S.age_in_days(F.col("maj_le"), F.lit(AS_OF).cast("timestamp_ntz")).alias("jours"), S.french_date(F.col("maj_le")).alias("le")))
simple("c21_c28_arrondis", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) / 3, 2) AS tiers, floor(l_quantity / 7) AS paquets, least(l_discount, l_tax) AS moindre FROM lineitem",
       lambda d: d.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice").cast(MONEY).cast("double") / 3, 2).alias("tiers"), F.floor(F.col("l_quantity") / 7).cast("double").alias("paquets"), F.least("l_discount", "l_tax").alias("moindre")))
simple("c22_mois", "SELECT k AS id, CASE WHEN m BETWEEN 1 AND 12 THEN m END AS mois FROM (SELECT o_orderkey AS k, TRY_CAST(string_split(CASE WHEN o_orderkey % 3 = 0 THEN 'xx-01' ELSE (o_orderkey % 15) || '-15' END, '-')[1] AS INTEGER) AS m FROM orders)",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), S.month_of(F.when(F.col("o_orderkey") % 3 == 0, "xx-01").otherwise(F.concat((F.col("o_orderkey") % 15).cast("string"), F.lit("-15")))).alias("mois")))
simple("c26_chemins", "SELECT id, concat_ws('/', 'projets', CAST(projet_id AS VARCHAR), CASE WHEN id % 2 = 0 THEN 'occ' || id END, 'f.pdf') AS chemin FROM d_occurrence", lambda d: d.occurrence.select("id", S.object_path(F.lit("projets"), F.col("projet_id").cast("string"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("occ"), F.col("id").cast("string"))), F.lit("f.pdf")).alias("chemin")))
simple("c29_c33_json", "SELECT event_id AS id, nullif(regexp_extract('texte ' || props || ' fin', '\\{.*\\}', 0, 's'), '') AS json, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", lambda d: d.raw("events").select(F.col("event_id").alias("id"), S.json_inside(F.concat(F.lit("texte "), "props", F.lit(" fin"))).alias("json"), F.get_json_object("props", "$.k").cast("int").alias("k")))
simple("c30_fil_complet", "SELECT demande_id, string_agg('<!-- ' || turn || ' -->' || chr(10) || corps, chr(10) ORDER BY turn) AS texte FROM d_message GROUP BY 1",
       lambda d: d.message.groupBy("demande_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "corps"))), lambda m: F.concat(F.lit("<!-- "), m["turn"].cast("string"), F.lit(" -->\n"), m["corps"])), "\n").alias("texte")))
simple("c31_empreintes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents", lambda d: d.raw("documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md")))
simple("c34_fusion", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS x, 'c' AS y FROM events",
       lambda d: d.raw("events").select(F.col("event_id").alias("id"), S.merge_json_maps(F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("c")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x"), F.lit("b"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("m")).select("id", F.col("m")["x"].alias("x"), F.col("m")["y"].alias("y")))
simple("c35_tableaux", "SELECT id, len(ug_ids) AS n, array_to_string(list_concat(ug_ids, [categorie]), ',') AS tous FROM d_occurrence", lambda d: d.occurrence.select("id", F.size("ug_ids").cast("bigint").alias("n"), F.array_join(F.concat("ug_ids", F.array("categorie")), ",").alias("tous")))
simple("c37_entiers", "SELECT p_partkey AS id, array_to_string(list_filter(string_split(p_name || ' ' || p_size || ' x1', ' '), lambda x: regexp_matches(x, '^[0-9]+$')), ',') AS entiers FROM part", lambda d: d.raw("part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(S.whole_numbers(F.split(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" x1")), " ")), lambda x: x.cast("string")), ",").alias("entiers")))
simple("c38_ecart_de_ligne", "SELECT id, CAST(ecart_initial AS DOUBLE) AS ecart_initial FROM v_lignes", lambda d: plain(lines_of(d).select("id", "ecart_initial")))
