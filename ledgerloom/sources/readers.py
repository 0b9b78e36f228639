"""Readers of the portfolio's files, and the cell table of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECURRENCE = "struct<type:string,intervalle_ans:double,occurrences_par_an:int,duree_ans:int,ancrage_annee:int,paliers:array<struct<intervalle_ans:double,nombre_occurrences:int>>>"
RULE = f"struct<cle:string,code_operation:string,libelle:string,lib_thema:string,ug_ids:array<string>,unites_gestion:array<string>,recurrence:{RECURRENCE},confiance:double>"
# Closed vocabularies of extraction records.
RECURRENCE_TYPES = ["ponctuel", "periodique", "campagnes", "paliers", "dependant_evenement"]


def read_parametrised(spark: SparkSession, sql: str, **values) -> DataFrame:
    """A query with named parameters; values are bound, never pasted."""
    return spark.sql(sql, args=values)


def at_most_one(keys: DataFrame, table: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The row of ``table`` for each of ``keys``, or nulls; a second row is an error.

    The count rides beside the row in one aggregate, so the refusal comes from
    the plan itself.  ``strict=False`` tells it in ``motif`` instead of failing.
    Null keys find nothing.
    """
    others = [c for c in table.columns if c != key]
    rows = table.groupBy(key).agg(F.any_value(F.struct(*others)).alias("ligne"), F.count("*").alias("nb"))
    several = F.col("nb") > 1
    message = F.concat(F.lit("plusieurs lignes pour "), F.col(key).cast("string"), F.lit(" : "), F.col("nb").cast("string"))
    found = keys.select(key).join(rows, key, "left")
    if strict:
        found = found.withColumn("ligne", F.when(several, F.raise_error(message)).otherwise(F.col("ligne")))
        return found.select(key, F.col("ligne").isNotNull().alias("trouve"), "ligne.*")
    return found.select(key, (F.col("ligne").isNotNull() & ~several).alias("trouve"), F.when(several, message).alias("motif"), *(F.when(~several, F.col(f"ligne.{c}")).alias(c) for c in others))


def wrapped_or_list(raw: DataFrame, column: str, key: str, element: str) -> DataFrame:
    """Records of a JSON text that is either a list, or an object that holds the list under a key."""
    whole = F.from_json(column, T._parse_datatype_string(f"array<{element}>"))
    inside = F.from_json(F.get_json_object(column, f"$.{key}"), T._parse_datatype_string(f"array<{element}>"))
    is_list = F.substring(F.ltrim(column), 1, 1) == "["
    return raw.select(*[c for c in raw.columns if c != column], F.explode(F.when(is_list, whole).otherwise(inside)).alias("r")).select(*[c for c in raw.columns if c != column], "r.*")


def budget_lines(raw: DataFrame, column: str = "json") -> DataFrame:
    """Budget lines of either accepted shape, {extraction: {lignes}} or {lignes}."""
    lines = F.coalesce(F.get_json_object(column, "$.extraction.lignes"), F.get_json_object(column, "$.lignes"))
    element = "struct<libelle_prestation:string,montant_ht:decimal(18,2),feuille:string,est_total:boolean,source_lignes:array<string>>"
    parsed = F.from_json(lines, T._parse_datatype_string(f"array<{element}>"))
    return raw.select(*[c for c in raw.columns if c != column], F.posexplode(parsed).alias("rang", "l")).select(*[c for c in raw.columns if c != column], "rang", "l.*")


def geojson_features(raw: DataFrame, column: str = "json") -> DataFrame:
    """Features of a FeatureCollection or a single Feature, numbered from zero."""
    one = "struct<type:string,geometry:string,properties:map<string,string>>"
    many = F.from_json(F.get_json_object(column, "$.features"), T._parse_datatype_string(f"array<{one}>"))
    single = F.array(F.from_json(column, T._parse_datatype_string(one)))
    kind = F.get_json_object(column, "$.type")
    rows = F.when(kind == "FeatureCollection", many).when(kind == "Feature", single)
    rest = [c for c in raw.columns if c != column]
    return raw.select(*rest, F.posexplode(rows).alias("feature_index", "f")).select(*rest, "feature_index", "f.geometry", "f.properties")


def catalogue(raw: DataFrame, column: str = "json") -> DataFrame:
    """Theme catalogue, from families over groups to measures."""
    measure = "struct<code:string,intitule:string>"
    family = f"struct<code:string,label:string,groupes:array<struct<id:string,label:string,mesures:array<{measure}>>>>"
    families = F.explode(F.from_json(F.get_json_object(column, "$.familles"), T._parse_datatype_string(f"array<{family}>")))
    groups = raw.select(families.alias("f")).select("f.code", "f.label", F.explode("f.groupes").alias("g"))
    return groups.select(F.col("code").alias("famille"), F.col("label").alias("famille_label"), F.col("g.id").alias("groupe"), F.explode("g.mesures").alias("m")).select("famille", "famille_label", "groupe", "m.code", "m.intitule")


def catalogue_text(measures: DataFrame) -> DataFrame:
    """The catalogue as indented lines, in one text per family."""
    line = F.concat(F.lit("    "), F.col("code"), F.lit(" : "), F.col("intitule"))
    lines = measures.groupBy("famille", "famille_label").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return lines.select("famille", F.concat(F.col("famille"), F.lit(" - "), F.col("famille_label"), F.lit("\n"), F.array_join("l", "\n")).alias("texte"))


def validate_rules(raw: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Extraction records split into valid ones (coerced) and rejected ones with a reason."""
    r = F.from_json(column, T._parse_datatype_string(RULE), {"mode": "PERMISSIVE"})
    rows = raw.withColumn("r", r)
    reason = (
        F.when(F.col("r").isNull() | F.col("r.cle").isNull(), "cle absente")
        .when(~F.coalesce(F.col("r.recurrence.type").isin(RECURRENCE_TYPES), F.lit(False)), "type de recurrence inconnu")
        .when(F.col("r.confiance") > 1, "confiance hors de 0..1").when(F.col("r.confiance") < 0, "confiance hors de 0..1")
    )
    rows = rows.withColumn("motif_rejet", reason)
    rest = [c for c in raw.columns if c != column]
    none = F.array().cast("array<string>")
    valid = rows.filter("motif_rejet is null").select(
        *rest, "r.cle", F.upper(F.replace("r.code_operation", F.lit(" "), F.lit(""))).alias("code_operation"), "r.libelle",
        F.coalesce("r.ug_ids", "r.unites_gestion", none).alias("ug_ids"), F.coalesce("r.confiance", F.lit(0.0)).alias("confiance"), F.col("r.recurrence.type").alias("type"),
    )
    return valid, rows.filter("motif_rejet is not null").select(*rest, column, "motif_rejet")


def flatten_sheet(cells: DataFrame) -> DataFrame:
    """Rows of a sheet as lines of cells joined by bars.

    ``cells``: sheet, row, col, value, is_text, merge_id, merge_rank (0 at the
    anchor), is_sum.  Text of a merged range spreads over it, a number stays on
    its anchor; empty rows and columns go; rows with a column sum are marked.

    The cells are read and dealt out once, without those that can show nothing: a
    sheet's cells meet as one sorted array, and its lines are cut from that.
    """
    shows = (F.coalesce("value", F.lit("")) != "") | (F.col("merge_id").isNotNull() & (F.coalesce("merge_rank", F.lit(0)) > 0))
    cell = F.struct("row", "col", "value", F.coalesce("is_text", F.lit(False)).alias("is_text"), "merge_id", F.coalesce("merge_rank", F.lit(0)).alias("merge_rank"), F.coalesce("is_sum", F.lit(False)).alias("is_sum"))
    sheets = cells.filter(shows).groupBy("sheet").agg(F.collect_list(cell).alias("c"))
    anchors = F.filter("c", lambda c: c["merge_id"].isNotNull() & (c["merge_rank"] == 0) & c["is_text"])
    sheets = sheets.withColumn("labels", F.map_from_entries(F.transform(anchors, lambda c: F.struct(c["merge_id"], c["value"]))))

    def shown(c: Column) -> Column:
        follows = c["merge_id"].isNotNull() & (c["merge_rank"] > 0)
        return F.when(follows, F.try_element_at("labels", c["merge_id"])).otherwise(c["value"])

    filled = F.filter(F.transform("c", lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), shown(c).alias("value"), c["is_sum"].alias("is_sum"))), lambda c: F.coalesce(c["value"], F.lit("")) != "")
    sheets = sheets.select("sheet", F.sort_array(filled).alias("c")).filter(F.size("c") > 0)
    changes = F.filter(F.sequence(F.lit(1), F.size("c")), lambda i: (i == 1) | ~F.get("c", i - 1)["row"].eqNullSafe(F.get("c", i - 2)["row"]))
    sheets = sheets.select("sheet", "c", F.array_sort(F.array_distinct(F.transform("c", lambda c: c["col"]))).alias("used"), changes.alias("starts"))
    lines = F.transform("starts", lambda at, k: _line(F.slice("c", at, F.coalesce(F.get("starts", k + 1), F.size("c") + 1) - at)))
    return sheets.select("sheet", F.explode(lines).alias("l")).select("sheet", "l.row", "l.ligne")


def _line(cells: Column) -> Column:
    """A line (row, ligne) from the cells of one row of a sheet whose used columns are ``used``."""
    def joined(row: Column) -> Column:
        line = F.array_join(F.transform("used", lambda col: F.coalesce(F.try_element_at(row["m"], col), F.lit(""))), " | ")
        return F.struct(row["row"].alias("row"), F.concat(line, F.when(row["total"], " [TOTAL?]").otherwise("")).alias("ligne"))

    of_row = F.transform(F.array(cells), lambda c: F.struct(
        F.get(c, F.lit(0))["row"].alias("row"), F.map_from_entries(F.transform(c, lambda x: F.struct(x["col"], x["value"]))).alias("m"), F.exists(c, lambda x: x["is_sum"]).alias("total")))
    return F.get(F.transform(of_row, joined), F.lit(0))


def mock_occurrences(spark: SparkSession, n: int, first_year: int, last_year: int, year_now: int, seed: int = 1) -> DataFrame:
    """``n`` seeded made-up occurrences (``mock_for``)."""
    return mock_for(spark.range(n), first_year, last_year, year_now, seed)


def mock_for(ids: DataFrame, first_year: int, last_year: int, year_now: int, seed: int = 1) -> DataFrame:
    """A made-up occurrence for every ``id``, whose state and amounts follow from its year; ids and seed alone decide."""
    k = F.col("id")

    def draw(salt: int) -> Column:
        digest = F.md5(F.concat_ws(":", k, F.lit(seed), F.lit(salt)))
        return F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % 1000 / 1000.0

    year = (F.lit(first_year) + F.floor(draw(1) * (last_year - first_year + 1))).cast("int")
    rows = ids.select("id").withColumn("annee", year).withColumn("montant_ht", F.round(500 + draw(2) * 20000, 2).cast("decimal(18,2)"))
    state = (
        F.when(F.col("annee") < year_now, F.when(draw(3) < 0.8, "realise").when(draw(3) < 0.9, "repousse").otherwise("en_cours"))
        .when(F.col("annee") == year_now, F.when(draw(3) < 0.4, "en_cours").otherwise("planifie")).otherwise("planifie")
    )
    rows = rows.withColumn("statut", state)
    paid = F.when(F.col("statut") == "realise", F.round(F.col("montant_ht") * (0.9 + draw(4) * 0.2).cast("decimal(6,3)"), 2).cast("decimal(18,2)"))
    return rows.withColumn("montant_engage", F.when(F.col("statut").isin("realise", "en_cours"), F.col("montant_ht"))).withColumn("montant_realise", paid)
