"""Scalar functions over whole tables, on inputs that are made from each row by templates.

A template's ``#`` stands for a number of the row; the SQL twin states the value that the rule gives for each template."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrflow.functions import codes, geo, numbers, postal, streets, text
from addrflow.functions.geo import _BETA, _DELTA, _RADIUS, BOX, PROJECTIONS

from .register import query


def filled(templates: list) -> Column:
    """The row's template, by k, filled with its number."""
    return F.replace(F.element_at(F.array(*map(F.lit, templates)), (F.col("k") % len(templates) + 1).cast("int")), F.lit("#"), (F.col("k") % 90 + 1).cast("string"))


def expected(values: list, kind: str = "string") -> str:
    """The SQL value for the row's template."""
    quoted = ["NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values]
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted))
    return f"cast(replace(CASE k % {len(values)} {cases} END, '#', cast(k % 90 + 1 AS string)) AS {kind})"


#: Input, building, flat, ambiguous, other reading, number without a flat, no address number.
NUMBERS = [
    ("#", "#", None, "false", "", "true", "false"),
    ("# a", "#A", None, "false", "", "true", "false"),
    ("#-9#", "#-9#", None, "false", "", "true", "false"),
    ("# m. 5b", "#", "5B", "false", "", "false", "false"),
    ("#A lok 7", "#A", "7", "false", "", "false", "false"),
    ("#A/5", "#A", "5", "false", "", "true", "false"),
    ("#/14", "#", "14", "true", "#/14", "true", "false"),
    (" # / 14 ", "#", "14", "true", "#/14", "true", "false"),
    ("#/14/5", "#/14", "5", "false", "", "false", "false"),
    ("b.n.", None, None, None, "", "false", "true"),
    ("000", None, None, None, "", "false", "true"),
    ("brak", None, None, None, "", "false", "false"),
    ("#, 14", None, None, None, "", "false", "true"),
    ("# do 99", None, None, None, "", "false", "true"),
    ("---", None, None, None, "", "false", "true"),
]


@query("number_parsing", "point", sql=f"SELECT point_id, {expected([x[1] for x in NUMBERS])} AS building, {expected([x[2] for x in NUMBERS])} AS flat, {expected([x[3] for x in NUMBERS], 'boolean')} AS ambiguous, {expected([x[4] for x in NUMBERS])} AS other, {expected([x[5] for x in NUMBERS], 'boolean')} AS looks, {expected([x[6] for x in NUMBERS], 'boolean')} AS garbage FROM point")
def _(point):
    raw = filled([x[0] for x in NUMBERS])
    rows = point.select("point_id", raw.alias("raw")).withColumn("p", numbers.parse_number(F.col("raw")))
    other = F.coalesce(F.array_join("p.alternatives", ","), F.lit(""))
    return rows.select("point_id", "p.building", "p.flat", "p.ambiguous", other.alias("other"), numbers.looks_like_building_number(F.col("raw")).alias("looks"), numbers.is_garbage_number(F.col("raw")).alias("garbage"))


#: Name, kind and rest, kind of its first word alone, short name, kind and rest where full words move.
STREETS = [
    ("ulica Polna #", "ul.", "Polna #", "ul.", None, "ul.", "Polna #"),
    ("Al. Róż", "al.", "Róż", "al.", None, None, "Al. Róż"),
    ("plac Wolności", "pl.", "Wolności", "pl.", "Wolności", "pl.", "Wolności"),
    ("Tadeusza Kościuszki", None, "Tadeusza Kościuszki", "tadeusza", "Kościuszki", None, "Tadeusza Kościuszki"),
    ("gen. Władysława Andersa", None, "gen. Władysława Andersa", "gen", "Andersa", None, "gen. Władysława Andersa"),
    ("gen. Maczka", None, "gen. Maczka", "gen", "Maczka", None, "gen. Maczka"),
    ("Jana Pawła II", None, "Jana Pawła II", "jana", None, None, "Jana Pawła II"),
    ("Słoneczna", None, "Słoneczna", "sloneczna", None, None, "Słoneczna"),
    ("os. Leśne", "os.", "Leśne", "os.", None, None, "os. Leśne"),
    ("rondo Babka", "rondo", "Babka", "rondo", "Babka", "rondo", "Babka"),
]


@query("street_functions", "point", sql=f"SELECT point_id, {expected([x[1] for x in STREETS])} AS kind, {expected([x[2] for x in STREETS])} AS name, {expected([x[3] for x in STREETS])} AS first_kind, {expected([x[5] for x in STREETS])} AS moved_kind, {expected([x[6] for x in STREETS])} AS moved_name FROM point")
def _(point):
    rows = point.select("point_id", filled([x[0] for x in STREETS]).alias("s"))
    split, moved = streets.split_street_type(F.col("s")), streets.extract_type_word(F.lit(None).cast("string"), F.col("s"))
    first = streets.normalize_street_type(F.substring_index("s", " ", 1))
    return rows.select("point_id", split["kind"].alias("kind"), split["name"].alias("name"), first.alias("first_kind"), moved["kind"].alias("moved_kind"), moved["name"].alias("moved_name"))


PEOPLE = [x for x in STREETS if x[0] not in ("plac Wolności", "rondo Babka", "ulica Polna #", "Al. Róż", "os. Leśne")]


@query("short_street_names", "point", sql=f"SELECT point_id, {expected([x[4] for x in PEOPLE])} AS short FROM point")
def _(point):
    return point.select("point_id", streets.short_street_name(filled([x[0] for x in PEOPLE])).alias("short"))


#: Name, and its other spellings.
ORDINALS = [("3 Maja", "trzeciego Maja|3 Maja|3 go Maja"), ("1 Sierpnia", "pierwszego Sierpnia|1 Sierpnia|1 go Sierpnia"), ("Trzeciego Maja", "3 Maja|3 go Maja"), ("XX-lecia", "20 lecia|dwudziestolecia"), ("Polna", ""), ("11 Listopada", "")]


@query("ordinal_spellings", "point", sql=f"SELECT point_id, {expected([x[1] for x in ORDINALS])} AS forms FROM point")
def _(point):
    return point.select("point_id", F.array_join(streets.ordinal_variants(filled([x[0] for x in ORDINALS])), "|").alias("forms"))


#: Text, the first postal code in it, and where it stands.
POSTAL = [("Polna 5, 00-026 Miasto", "00-026", "9"), ("Polna 00950", "00-950", "6"), ("Polna 99999", None, None), ("12345/6 Polna", None, None), ("30001 i 00-123", "00-123", "8"), ("bez kodu", None, None), ("10-00 11-222 x", "11-222", "6")]


@query("postal_extraction", "point", sql=f"SELECT point_id, {expected([x[1] for x in POSTAL])} AS code, {expected([x[2] for x in POSTAL], 'integer')} AS at FROM point")
def _(point):
    return point.select("point_id", postal.extract_postal(filled([x[0] for x in POSTAL])).alias("p")).select("point_id", "p.code", F.col("p.index").cast("int").alias("at"))


#: Text, its title case, its edit distance from "Nowa Wies" up to two.
TITLES = [("NOWA WIES", "Nowa Wies", None), ("JANA PAWŁA II", "Jana Pawła II", None), ("Nowy Targ", "Nowy Targ", None), ("Nowa Wies", "Nowa Wies", "0"), ("Nova Wies", "Nova Wies", "1"), ("Nova Vies", "Nova Vies", "2"), ("3#", "3#", None)]


@query("text_forms", "point", sql=f"SELECT point_id, {expected([x[1] for x in TITLES])} AS title, {expected([x[2] for x in TITLES], 'integer')} AS edits FROM point")
def _(point):
    rows = point.select("point_id", filled([x[0] for x in TITLES]).alias("s"))
    return rows.select("point_id", text.title_case(F.col("s")).alias("title"), text.levenshtein_max(F.col("s"), F.lit("Nowa Wies"), 2).alias("edits"))


@query("point_hashes", "staged", sql="SELECT point_id, sha256(simc || chr(1) || coalesce(street_id, '') || chr(1) || number || chr(1) || coalesce(postal_code, '') || chr(1) || coalesce(status, '') || chr(1) || coalesce(printf('%.6f', lat), '') || chr(1) || coalesce(printf('%.6f', lon), '')) AS hash FROM staged")
def _(staged):
    place = [codes.coordinate_text(F.col(c)) for c in ("lat", "lon")]
    return staged.select("point_id", codes.point_hash("simc", "street_id", "number", "postal_code", "status", *place).alias("hash"))


#: Reference system, its code, whether the northing comes first; coordinates, and the first two numbers.
SYSTEMS = [("urn:ogc:def:crs:EPSG::2180", "2180", "true"), ("EPSG:2178", "2178", "false"), ("http://www.opengis.net/def/crs/EPSG/0/4326", "4326", "true"), ("", "2180", "false"), ("EPSG:4326", "4326", "false")]
VERTICES = [("#.5 7", "#.5", "7.0"), (" 1,#  3,4", "1.0", "#.0"), ("x 1", None, None), ("12", None, None)]


@query("reference_systems", "point", sql=f"SELECT point_id, {expected([x[1] for x in SYSTEMS], 'integer')} AS epsg, {expected([x[2] for x in SYSTEMS], 'boolean')} AS north_first, {expected([x[1] for x in VERTICES], 'double')} AS a, {expected([x[2] for x in VERTICES], 'double')} AS b FROM point")
def _(point):
    rows = point.select("point_id", geo.parse_epsg(filled([x[0] for x in SYSTEMS])).alias("s"), geo.first_vertex(filled([x[0] for x in VERTICES])).alias("v"))
    return rows.select("point_id", "s.epsg", "s.north_first", "v.a", "v.b")


@query("postal_lines", "point", "locality", "street", sql="SELECT point_id, coalesce(s.kind || ' ' || s.name, l.name) || ' ' || number || CASE WHEN k % 6 = 0 THEN '/' || cast(k % 9 AS string) ELSE '' END || '|' || coalesce(postal_code || ' ', '') || l.name AS lines FROM point p JOIN locality l ON p.simc = l.simc LEFT JOIN street s ON p.street_id = s.street_id")
def _(point, locality, street):
    rows = point.join(locality.select("simc", F.col("name").alias("place")), "simc").join(street.select("street_id", "kind", F.col("name").alias("road")), "street_id", "left")
    flat = F.when(F.col("k") % 6 == 0, (F.col("k") % 9).cast("string"))
    return rows.select("point_id", F.array_join(codes.address_lines(F.col("kind"), F.col("road"), F.col("number"), flat, F.col("postal_code"), F.col("place")), "|").alias("lines"))


def _unproject_sql(east: str, north: str, name: str) -> str:
    """The inverse projection as SQL expressions over a sub-select, one step after another."""
    lon0, scale, false_east, false_north = PROJECTIONS[2180]
    plane = f"SELECT *, ({north} - ({false_north})) / {scale * _RADIUS!r} AS xi, ({east} - {false_east}) / {scale * _RADIUS!r} AS eta FROM {name}"
    x = "xi" + "".join(f" - ({b!r}) * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, b in enumerate(_BETA, 1))
    y = "eta" + "".join(f" - ({b!r}) * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, b in enumerate(_BETA, 1))
    sphere = f"SELECT * EXCLUDE (xi, eta), {x} AS x, {y} AS y FROM ({plane})"
    chi = f"SELECT * EXCLUDE (x, y), {lon0} + degrees(atan2((exp(y) - exp(-y)) / 2, cos(x))) AS lon, asin(sin(x) / ((exp(y) + exp(-y)) / 2)) AS chi FROM ({sphere})"
    lat = "chi" + "".join(f" + ({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(_DELTA, 1))
    return f"SELECT * EXCLUDE (chi), degrees({lat}) AS lat FROM ({chi})"


INSIDE = f"BETWEEN {BOX[0]} AND {BOX[1]} AND {{lat}} BETWEEN {BOX[2]} AND {BOX[3]}"
_A, _B = _unproject_sql("e", "n", "plane"), _unproject_sql("n", "e", "plane")


@query(
    "projected_points",
    "point",
    sql=f"""WITH plane AS (SELECT point_id, k % 700000 + 150000.5 AS e, k * 37 % 700000 + 130000.25 AS n FROM point),
one AS ({_A}), two AS ({_B}), x AS (SELECT a.point_id, a.lon, a.lat, b.lon AS lon2, b.lat AS lat2, NOT (a.lon {INSIDE.format(lat='a.lat')}) AND b.lon {INSIDE.format(lat='b.lat')} AS swapped FROM one a JOIN two b ON a.point_id = b.point_id)
SELECT point_id, round(round(CASE WHEN swapped THEN lon2 ELSE lon END, 7), 6) AS lon, round(round(CASE WHEN swapped THEN lat2 ELSE lat END, 7), 6) AS lat, swapped FROM x""",
)
def _(point):
    p = geo.to_wgs84(F.col("k") % 700_000 + 150_000.5, F.col("k") * 37 % 700_000 + 130_000.25, F.lit(2180), F.lit(False))
    return point.select("point_id", p.alias("p")).select("point_id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), "p.swapped")
