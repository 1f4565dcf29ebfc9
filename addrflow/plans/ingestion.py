"""Ingestion: the registry written as files of each source format, read back and mapped.

The files hold every row of the tables, so their size grows with the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrflow.operators.relational import union_all
from addrflow.sources import gml, registers
from addrflow.sources.scratch import scratch_folder

from .register import query


def _element(name: str, value: Column | str, attributes: Column | str = "") -> Column:
    """``<name attributes>value</name>``, null for a null value."""
    a, v = (F.lit(x) if isinstance(x, str) else x for x in (attributes, value))
    return F.concat(F.lit(f"<{name}"), F.when(a != "", F.concat(F.lit(" "), a)).otherwise(""), F.lit(">"), v, F.lit(f"</{name}>"))


def _join(*parts: Column) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def _position(name: str, lon: Column, lat: Column) -> Column:
    place = F.concat(lon.cast("string"), F.lit(" "), lat.cast("string"))
    return _element(name, F.concat(F.lit('<gml:Point srsName="EPSG:4326">'), _element("gml:pos", place), F.lit("</gml:Point>")))


def _write(rows: Column, df: DataFrame, name: str, sep: str = "\n") -> str:
    path = scratch_folder(df.sparkSession, name)
    df.select(rows.alias("value")).write.option("lineSep", sep).text(path)
    return path


# --- Features -------------------------------------------------------------------------------------------------------------


def _number() -> Column:
    return F.when(F.col("k") % 53 == 0, "b.n.").when(F.col("k") % 7 == 0, F.lower("number")).otherwise(F.col("number"))


_NUMBER_SQL = "CASE WHEN k % 53 = 0 THEN NULL ELSE number END"


def _points_2021(point: DataFrame) -> Column:
    name = _element("e:idIIP", _element("e:AD_IdentyfikatorIIP", _join(_element("e:lokalnyId", F.col("point_id")), _element("e:wersjaId", F.lit("v1")))))
    code = _element("e:kodPocztowy", F.when(F.col("k") % 5 == 0, F.replace("postal_code", F.lit("-"), F.lit(""))).otherwise(F.col("postal_code")))
    link = _element("e:miejsce", "", F.concat(F.lit('xlink:href="#M-'), "simc", F.lit('"')))
    road = _element("e:ulica2", "", F.concat(F.lit('xlink:href="#U-'), "street_id", F.lit('"')))
    body = _join(name, _element("e:numerPorzadkowy", _number()), code, _element("e:status", F.col("status")), link, road, _position("e:georeferencja", F.col("lon"), F.col("lat")))
    return F.concat(F.lit("<gml:featureMember>"), _element("e:AD_PunktAdresowy", body, F.concat(F.lit('gml:id="'), "point_id", F.lit('"'))), F.lit("</gml:featureMember>"))


def _places_2021(locality: DataFrame) -> Column:
    kind = F.element_at(F.array(*map(F.lit, ("czescMiejscowosci", "wies", "miasto"))), F.col("kind") + 1)
    place = F.when(F.col("lon").isNotNull(), _position("e:georeferencja", F.col("lon"), F.col("lat")))
    body = _join(_element("e:nazwa", F.col("name")), _element("e:rodzaj", kind), _element("e:identyfikatorSIMC", F.col("simc").cast("bigint").cast("string")), _element("e:TERYTGminy", F.col("terc")), place)
    return F.concat(F.lit("<gml:featureMember>"), _element("e:AD_Miejscowosc", body, F.concat(F.lit('gml:id="'), "gml_id", F.lit('"'))), F.lit("</gml:featureMember>"))


def _file_2021(point: DataFrame, locality: DataFrame) -> str:
    """One text without line breaks: localities first, so that no point is near its start."""
    rows = locality.select(_places_2021(locality).alias("value")).unionByName(point.select(_points_2021(point).alias("value")))
    return _write(F.col("value"), rows, "features", sep=" ")


@query("gml_points", "point", "locality", sql=f"SELECT point_id, 'v1' AS version_id, 'M-' || simc AS locality_ref, 'U-' || street_id AS street_ref, {_NUMBER_SQL} AS number, CASE WHEN k % 53 = 0 THEN NULL ELSE number_key END AS number_key, CASE WHEN k % 5 <> 0 THEN postal_code END AS postal_code, status, round(lon, 7) AS lon, round(lat, 7) AS lat, CASE WHEN k % 53 = 0 THEN 'no address number' END AS skipped FROM point")
def _(point, locality):
    raw = gml.read_gml(point.sparkSession, _file_2021(point, locality), "point")
    good = F.col("skipped").isNull()
    rows = gml.map_points(raw).select("point_id", "version_id", "locality_ref", "street_ref", F.when(good, F.col("number")).alias("number"), F.when(good, F.col("number_key")).alias("number_key"), "postal_code", "status", "lon", "lat", "skipped")
    return rows


@query("gml_kept", "point", "locality", sql="SELECT k % 53 = 0 AS skipped, count(*) AS n, count(DISTINCT sha256('M-' || simc || chr(1) || coalesce('U-' || street_id, '') || chr(1) || number || chr(1) || CASE WHEN k % 5 = 0 THEN '' ELSE coalesce(postal_code, '') END || chr(1) || status || chr(1) || printf('%.6f', lat) || chr(1) || printf('%.6f', lon))) AS hashes FROM point WHERE k % 53 <> 0 GROUP BY 1 UNION ALL SELECT true, count(*), 0 FROM point WHERE k % 53 = 0")
def _(point, locality):
    """Rows that are addresses, with their hashes, and rows that are none."""
    kept, skipped = gml.split_skipped(gml.map_points(gml.read_gml(point.sparkSession, _file_2021(point, locality), "point")))
    a = kept.agg(F.lit(False).alias("skipped"), F.count("*").alias("n"), F.count_distinct("hash").alias("hashes"))
    return a.unionByName(skipped.agg(F.lit(True).alias("skipped"), F.count("*").alias("n"), F.lit(0).cast("long").alias("hashes")))


@query("gml_localities", "point", "locality", sql="SELECT gml_id, simc, upper(substring(name, 1, 1)) || lower(substring(name, 2)) AS name, name_norm, CASE kind WHEN 2 THEN 96 ELSE kind END AS kind, terc, lon, lat FROM locality")
def _(point, locality):
    raw = gml.read_gml(point.sparkSession, _file_2021(point, locality), "locality")
    return gml.map_localities(raw).select("gml_id", "simc", "name", "name_norm", F.col("kind").cast("int").alias("kind"), "terc", "lon", "lat")


@query("gml_streets", "street", sql="SELECT gml_id, sym_ul, 'M-' || simc AS locality_ref, kind, name_norm, CASE WHEN name = 'NOT SPECIFIED' THEN 'Not Specified' ELSE upper(substring(name, 1, 1)) || lower(substring(name, 2)) END AS name FROM street")
def _(street):
    kind = F.when(F.col("kind") == "ul.", "ulica").otherwise("aleja")
    body = _join(_element("e:nazwaPelna", F.col("name")), _element("e:rodzaj", kind), _element("e:identyfikatorULIC", F.col("sym_ul").cast("bigint").cast("string")), _element("e:ulica1", "", F.concat(F.lit('xlink:href="#M-'), "simc", F.lit('"'))))
    path = _write(_element("e:AD_UlicaPlac", body, F.concat(F.lit('gml:id="'), "gml_id", F.lit('"'))), street, "streets")
    return gml.map_streets(gml.read_gml(street.sparkSession, path, "street")).select("gml_id", "sym_ul", "locality_ref", "kind", "name_norm", "name")


def _file_2012(point: DataFrame) -> str:
    units = _join(*(_element("p:jednostkaAdministracyjna", F.substring("terc", 1, n)) for n in (2, 4, 7)))
    body = _join(_element("p:lokalnyId", F.col("point_id")), units, _element("p:miejscowosc", F.col("simc")), _element("p:ulica", F.substring("street_id", 9, 5)), _element("p:numerPorzadkowy", _number()), _element("p:kodPocztowy", F.col("postal_code")), _position("p:pozycja", F.when(F.col("k") % 6 == 0, F.col("lat")).otherwise(F.col("lon")), F.when(F.col("k") % 6 == 0, F.col("lon")).otherwise(F.col("lat"))))
    return _write(_element("p:PRG_PunktAdresowy", body, F.concat(F.lit('gml:id="Q'), F.col("k").cast("string"), F.lit('"'))), point, "features-2012")


@query("gml_points_2012", "point", sql="SELECT point_id, simc AS locality_ref, substring(street_id, 9, 5) AS street_ref, terc AS terc_ref, region, round(lon, 7) AS lon, round(lat, 7) AS lat, k % 6 = 0 AS swapped FROM point")
def _(point):
    """The older structure; every sixth position has its axes exchanged."""
    raw = gml.read_gml(point.sparkSession, _file_2012(point), "point")
    return gml.map_points(raw).select("point_id", "locality_ref", "street_ref", "terc_ref", "region", "lon", "lat", "swapped")


@query("gml_statistics", "point", sql="SELECT 'rows' AS measure, count(*) AS n FROM point UNION ALL SELECT 'no_position', 0 UNION ALL SELECT 'swapped', count(*) FILTER (k % 6 = 0) FROM point UNION ALL SELECT 'outside', 0 UNION ALL SELECT 'skipped: no address number', count(*) FILTER (k % 53 = 0) FROM point")
def _(point):
    return gml.ingest_stats(gml.map_points(gml.read_gml(point.sparkSession, _file_2012(point), "point")))


@query("gml_profile", "point", "locality", sql="SELECT 'AD_PunktAdresowy' AS element, '2021' AS structure, 'point' AS kind, count(*) AS features FROM point UNION ALL SELECT 'AD_Miejscowosc', '2021', 'locality', count(*) FROM locality UNION ALL SELECT 'AD_IdentyfikatorIIP', NULL, NULL, count(*) FROM point")
def _(point, locality):
    return gml.detect_profile(point.sparkSession, _file_2021(point, locality))


@query("gml_discovery", "point", "locality", sql="SELECT 'lokalnyId' AS element, count(*) AS n, false AS candidate FROM point UNION ALL SELECT 'wersjaId', count(*), false FROM point UNION ALL SELECT 'numerPorzadkowy', count(*), false FROM point UNION ALL SELECT 'kodPocztowy', count(postal_code), false FROM point UNION ALL SELECT 'status', count(*), false FROM point UNION ALL SELECT 'pos', (SELECT count(*) FROM point) + (SELECT count(lon) FROM locality), false UNION ALL SELECT x, count(*), false FROM locality, (SELECT unnest(['nazwa', 'rodzaj', 'identyfikatorSIMC', 'TERYTGminy']) AS x) GROUP BY 1 UNION ALL SELECT 'AD_PunktAdresowy', count(*), true FROM point UNION ALL SELECT 'AD_Miejscowosc', count(*), true FROM locality UNION ALL SELECT 'AD_IdentyfikatorIIP', count(*), true FROM point")
def _(point, locality):
    return gml.discover_gml(point.sparkSession, _file_2021(point, locality)).select("element", "n", "candidate")


@query("picked_paths", "point", sql="SELECT point_id AS id, simc AS place, 3 AS units FROM point")
def _(point):
    """The first path that the structure has, and all values of a repeated field."""
    raw = gml.read_gml(point.sparkSession, _file_2012(point), "point")
    place = gml.pick_path(raw, ["miejsce._href", "nothing.here", "miejscowosc", "status"])
    return raw.select(gml.pick_path(raw, ["idIIP.AD_IdentyfikatorIIP.lokalnyId", "lokalnyId"]).alias("id"), place.alias("place"), F.size(gml.pick_path_all(raw, "jednostkaAdministracyjna")).alias("units"))


# --- Catalogues -----------------------------------------------------------------------------------------------------------


def _csv(df: DataFrame, name: str, sep: str = ";") -> str:
    path = scratch_folder(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).option("emptyValue", "").csv(path)
    return path


@query("catalogue_units", "unit", sql="SELECT terc, name, parent_terc, level FROM unit")
def _(unit):
    part = lambda a, n, least: F.when(F.col("level") >= least, F.substring("terc", a, n))
    rows = unit.select(part(1, 2, 1).alias("WOJ"), part(3, 2, 2).alias("POW"), part(5, 2, 3).alias("GMI"), part(7, 1, 3).alias("RODZ"), F.col("name").alias("NAZWA"), F.lit("2024-01-01").alias("STAN_NA"))
    return registers.read_catalogue(unit.sparkSession, _csv(rows, "terc"), "terc").select("terc", "name", "parent_terc", F.col("level").cast("int").alias("level"))


@query("catalogue_localities", "locality", sql="SELECT simc, name, name_norm, kind, terc, CASE WHEN kind = 0 THEN '0000001' ELSE simc END AS parent_simc FROM locality")
def _(locality):
    parent = F.when(F.col("kind") == 0, "1")
    rows = locality.select(F.substring("terc", 1, 2).alias("woj"), F.substring("terc", 3, 2).alias("pow"), F.substring("terc", 5, 2).alias("gmi"), F.substring("terc", 7, 1).alias("rodz_gmi"), F.lpad(F.col("kind").cast("string"), 2, "0").alias("rm"), F.col("name").alias("nazwa"), F.col("simc").cast("bigint").cast("string").alias("sym"), parent.alias("sympod"))
    return registers.read_catalogue(locality.sparkSession, _csv(rows, "simc", ","), "simc").withColumn("kind", F.col("kind").cast("int"))


@query("catalogue_streets", "street", sql="SELECT simc, sym_ul, kind, 'Jana ' || name AS name, 'jana ' || name_norm AS name_norm, name AS name_1, 'Jana' AS name_2 FROM street")
def _(street):
    """XML rows of named columns, the second part of the name apart."""
    values = {"SYM": F.col("simc"), "SYM_UL": F.col("sym_ul").cast("bigint").cast("string"), "CECHA": F.col("kind"), "NAZWA_1": F.col("name"), "NAZWA_2": F.lit("Jana")}
    cells = F.concat(*(F.concat(F.lit(f"<col name='{k}'>"), v, F.lit("</col>")) for k, v in values.items()))
    rows = street.select(F.concat(F.lit("<row>"), cells, F.lit("</row>")).alias("value"))
    return registers.read_catalogue(street.sparkSession, _write(F.col("value"), rows, "ulic"), "ulic")


@query("catalogue_kinds", "locality", sql="SELECT DISTINCT kind AS code, 'kind ' || cast(kind AS string) AS name FROM locality")
def _(locality):
    rows = locality.select(F.lpad(F.col("kind").cast("string"), 2, "0").alias("RM"), F.concat(F.lit("kind "), F.col("kind").cast("string")).alias("NAZWA_RM")).distinct()
    return registers.read_catalogue(locality.sparkSession, _csv(rows, "wmrodz", "\t"), "wmrodz").select(F.col("code").cast("int").alias("code"), "name")


@query("attached_units", "locality", "unit", sql="WITH u AS (SELECT terc FROM unit WHERE level = 3) SELECT simc, coalesce((SELECT terc FROM u WHERE u.terc = CASE WHEN kind = 2 THEN substring(l.terc, 1, 6) || '5' ELSE l.terc END), (SELECT min(terc) FROM u WHERE substring(u.terc, 1, 6) = substring(l.terc, 1, 6))) AS unit_terc FROM locality l")
def _(locality, unit):
    """Localities under a code of a part of a mixed commune belong to the whole commune."""
    rows = locality.withColumn("terc", F.when(F.col("kind") == 2, F.concat(F.substring("terc", 1, 6), F.lit("5"))).otherwise(F.col("terc")))
    return registers.attach_units(rows, unit).select("simc", "unit_terc")


@query(
    "loaded_catalogues",
    "unit",
    "locality",
    "street",
    sql="""
WITH l AS (SELECT *, cast(simc AS bigint) % 97 = 0 AS lost FROM locality), u AS (SELECT terc FROM unit WHERE level = 3),
p AS (SELECT simc, kind, coalesce((SELECT max(terc) FROM u WHERE u.terc = CASE WHEN kind = 2 THEN substring(l.terc, 1, 6) || '5' ELSE l.terc END), (SELECT min(terc) FROM u WHERE substring(u.terc, 1, 6) = substring(l.terc, 1, 6))) AS terc FROM l WHERE NOT lost)
SELECT 'unit' AS item, count(DISTINCT terc) AS n, count(DISTINCT terc) AS codes FROM unit UNION ALL SELECT 'locality', count(*), count(DISTINCT terc) FROM p UNION ALL SELECT 'street', count(*), count(DISTINCT s.simc) FROM street s JOIN p ON s.simc = p.simc
UNION ALL SELECT 'kind', count(DISTINCT kind), count(DISTINCT kind) FROM locality UNION ALL SELECT 'locality without unit', count(*), 0 FROM l WHERE lost UNION ALL SELECT 'street without locality', count(*), 0 FROM street s JOIN l ON s.simc = l.simc WHERE lost""",
)
def _(unit, locality, street):
    """All four files in one load: units listed twice, parts of mixed communes, localities of no unit and their streets."""
    part = lambda a, n, least: F.when(F.col("level") >= least, F.substring("terc", a, n))
    units = unit.select(part(1, 2, 1).alias("WOJ"), part(3, 2, 2).alias("POW"), part(5, 2, 3).alias("GMI"), part(7, 1, 3).alias("RODZ"), F.col("name").alias("NAZWA"), F.lit("2024-01-01").alias("STAN_NA"))
    units = units.unionByName(units.where("WOJ = '01'").withColumn("STAN_NA", F.lit("2020-01-01")))
    lost = F.col("simc").cast("bigint") % 97 == 0
    kind = F.when(F.col("kind") == 2, "5").otherwise(F.substring("terc", 7, 1))
    places = locality.select(F.when(lost, "98").otherwise(F.substring("terc", 1, 2)).alias("WOJ"), F.substring("terc", 3, 2).alias("POW"), F.substring("terc", 5, 2).alias("GMI"), kind.alias("RODZ_GMI"), F.lpad(F.col("kind").cast("string"), 2, "0").alias("RM"), F.col("name").alias("NAZWA"), F.col("simc").alias("SYM"), F.col("simc").alias("SYMPOD"))
    roads = street.select(F.col("simc").alias("SYM"), F.col("sym_ul").alias("SYM_UL"), F.col("kind").alias("CECHA"), F.col("name").alias("NAZWA_1"), F.lit(None).cast("string").alias("NAZWA_2"))
    kinds = locality.select(F.lpad(F.col("kind").cast("string"), 2, "0").alias("RM"), F.concat(F.lit("kind "), F.col("kind").cast("string")).alias("NAZWA_RM")).distinct()
    got = registers.load_teryt(unit.sparkSession, _csv(units, "terc"), _csv(places, "simc"), _csv(roads, "ulic"), _csv(kinds, "wmrodz"))
    codes = {"unit": "terc", "locality": "terc", "street": "simc", "kind": "code"}
    rows = [got[t].agg(F.count("*").alias("n"), F.count_distinct(c).alias("codes")).select(F.lit(t).alias("item"), "n", "codes") for t, c in codes.items()]
    rows.append(got["left_out"].select(F.col("reason").alias("item"), "n", F.lit(0).cast("long").alias("codes")))
    return union_all(*rows)


# --- A secondary source ----------------------------------------------------------------------------------------------------


def _table(secondary: DataFrame) -> str:
    code = F.when(F.col("number_key").endswith("x"), F.replace("postal_code", F.lit("-"), F.lit(" "))).otherwise(F.col("postal_code"))
    number = F.when(F.substring("id", -1, 1) != "4", F.upper("number_key"))
    rows = secondary.select(F.col("id").alias("ID_PUNKTU"), F.col("simc").cast("bigint").cast("string").alias("Simc"), F.upper("locality_norm").alias("Miejscowość"), F.col("street_norm").alias("ULICA"), number.alias("NR"), code.alias("KOD"), F.lit("637123,45").alias("WSP_X"), F.lit("z").alias("INNE"))
    return _csv(rows, "secondary")


@query("secondary_table", "secondary", sql="SELECT id, simc, locality_norm, street_norm, CASE WHEN right(id, 1) <> '4' THEN number_key END AS number_key, CASE WHEN right(number_key, 1) <> 'x' THEN postal_code END AS postal_code, 637123.45 AS x, CASE WHEN right(id, 1) = '4' THEN 'no number' END AS skipped FROM secondary")
def _(secondary):
    df, _ = registers.read_tabular(secondary.sparkSession, _table(secondary))
    return registers.map_comparison(df).select("id", "simc", "locality_norm", "street_norm", "number_key", "postal_code", "x", "skipped")


@query("secondary_columns", "secondary", sql="SELECT unnest(['ID_PUNKTU', 'Simc', 'Miejscowość', 'ULICA', 'NR', 'KOD', 'WSP_X', 'INNE']) AS \"column\", unnest(['id', 'simc', 'locality', 'street', 'number', 'postal_code', 'x', NULL]) AS target FROM (SELECT count(*) AS n FROM secondary)")
def _(secondary):
    return registers.discover_tabular(secondary.sparkSession, _table(secondary)).select("column", "target")
