"""All registered queries of the address registry, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from addrflow.functions.codes import build_terc, match_key_name
from addrflow.functions.numbers import building_key, building_sort_key, canonical_building
from addrflow.functions.postal import is_placeholder_postal, is_valid_postal, normalize_postal
from addrflow.functions.text import clean_text, normalize_text, tokenize
from addrflow.operators import addresses, compare, lookup, opsmetrics, publish, quality, search, usage, validate
from addrflow.operators.relational import distinct_on, top_k, union_all
from addrflow.sources.scratch import kept

from . import cycles, ingestion, scalars  # noqa: F401  (they register queries of their own)
from .register import AS_OF, ORACLES, QUERIES, query

__all__ = ["AS_OF", "ORACLES", "QUERIES"]


# --- Joins and derived data ---------------------------------------------------------------------------------------------

FULL = """
full_address AS (
  SELECT p.*, l.name AS locality, s.kind AS street_kind, s.name AS street, g.name AS commune, c.name AS county, w.name AS voivodeship
  FROM point p JOIN locality l ON p.simc = l.simc LEFT JOIN street s ON p.street_id = s.street_id
  JOIN unit g ON l.terc = g.terc AND g.level = 3 LEFT JOIN unit c ON g.parent_terc = c.terc AND c.level = 2 LEFT JOIN unit w ON c.parent_terc = w.terc AND w.level = 1)"""


@query("full_address", "point", "locality", "street", "unit", sql=f"WITH {FULL} SELECT point_id, locality, street_kind, street, number, postal_code, commune, county, voivodeship FROM full_address")
def _(point, locality, street, unit):
    return addresses.full_address(point.drop("terc"), locality, street, unit).select("point_id", "locality", "street_kind", "street", "number", "postal_code", "commune", "county", "voivodeship")


@query("points_per_commune", "point", "locality", "street", "unit", sql=f"WITH {FULL} SELECT voivodeship, county, commune, count(*) AS points, count(street) AS with_street FROM full_address GROUP BY ALL")
def _(point, locality, street, unit):
    full = addresses.full_address(point.drop("terc"), locality, street, unit)
    return full.groupBy("voivodeship", "county", "commune").agg(F.count("*").alias("points"), F.count("street").alias("with_street"))


@query("derived_counts", "published", "street", sql="SELECT s.street_id, count(p.point_id) AS n_points FROM street s LEFT JOIN published p ON p.street_id = s.street_id AND p.withdrawn IS NULL GROUP BY 1")
def _(published, street):
    return addresses.derive_counts(published, street, "street_id").select("street_id", "n_points")


@query("localities_with_streets", "street", "locality", sql="SELECT simc, simc IN (SELECT simc FROM street) AS has_streets FROM locality")
def _(street, locality):
    return addresses.derive_has_streets(street, locality).select("simc", "has_streets")


@query("resolve_locality_refs", "point", "locality", sql="SELECT point_id, coalesce(l.simc, CASE WHEN regexp_matches(ref, '^[0-9]{1,7}$') THEN lpad(ref, 7, '0') END) AS simc FROM (SELECT point_id, CASE WHEN k % 3 = 0 THEN 'M-' || cast(cast(simc AS bigint) AS string) WHEN k % 3 = 1 THEN cast(cast(simc AS bigint) AS string) ELSE 'urn:' || simc END AS ref FROM point) LEFT JOIN locality l ON ref = l.gml_id")
def _(point, locality):
    code = F.col("simc").cast("bigint").cast("string")
    ref = F.when(F.col("k") % 3 == 0, F.concat(F.lit("M-"), code)).when(F.col("k") % 3 == 1, code).otherwise(F.concat(F.lit("urn:"), "simc"))
    return addresses.resolve_locality_refs(point.select("point_id", ref.alias("locality_ref")), locality).select("point_id", "simc")


@query(
    "link_streets",
    "point",
    "street",
    sql="""
WITH q AS (SELECT point_id, simc, CASE WHEN street_id IS NULL THEN 'none' WHEN k % 2 = 0 THEN 'U-' || cast(cast(simc AS bigint) AS string) || '-' || substring(street_id, 13, 1) ELSE substring(street_id, 13, 1) END AS ref FROM point)
SELECT q.point_id, coalesce(a.street_id, b.street_id) AS street_id FROM q LEFT JOIN street a ON q.ref = a.gml_id
LEFT JOIN street b ON q.simc = b.simc AND regexp_matches(q.ref, '^[0-9]{1,5}$') AND lpad(q.ref, 5, '0') = b.sym_ul""",
)
def _(point, street):
    digit = F.substring("street_id", 13, 1)
    ref = F.when(F.col("street_id").isNull(), "none").when(F.col("k") % 2 == 0, F.concat(F.lit("U-"), F.col("simc").cast("bigint").cast("string"), F.lit("-"), digit)).otherwise(digit)
    return addresses.link_streets(point.select("point_id", "simc", ref.alias("street_ref")), street.select("gml_id", "simc", "sym_ul", "kind", "name_norm"), street).select("point_id", "street_id")


@query("dominant_postal_code", "published", sql="SELECT street_id, postal_code AS dominant_code FROM (SELECT street_id, postal_code, row_number() OVER (PARTITION BY street_id ORDER BY count(*) DESC, postal_code) AS r FROM published WHERE withdrawn IS NULL AND postal_code IS NOT NULL AND street_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def _(published):
    return addresses.dominant_postal_code(published.where("street_id IS NOT NULL"), ["street_id"])


# --- Windows ------------------------------------------------------------------------------------------------------------

_LINE = "l_linestatus, l_returnflag, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query("distinct_on_lines", "lineitem", sql=f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}) AS r FROM lineitem) WHERE r = 1")
def _(lineitem):
    return distinct_on(lineitem, ["l_orderkey", "l_linenumber"], [F.col(c.strip()) for c in _LINE.split(",")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("top_points_per_street", "point", sql="SELECT street_id, rank, point_id FROM (SELECT street_id, point_id, row_number() OVER (PARTITION BY street_id ORDER BY number_sort, point_id) AS rank FROM point WHERE street_id IS NOT NULL) WHERE rank <= 3")
def _(point):
    return top_k(point.where("street_id IS NOT NULL"), ["street_id"], [F.asc("number_sort"), F.asc("point_id")], 3).select("street_id", "rank", "point_id")


# --- Publication --------------------------------------------------------------------------------------------------------

MERGED = """
merged AS (
  SELECT coalesce(n.point_id, c.point_id) AS point_id, coalesce(n.region, c.region) AS region, n.point_id IS NOT NULL AS is_new,
    CASE WHEN c.point_id IS NULL THEN 'new' WHEN n.point_id IS NULL THEN CASE WHEN c.withdrawn IS NOT NULL THEN 'gone' WHEN c.region IN ('00', '01', '02') THEN 'withdrawn' ELSE 'other' END
         WHEN c.withdrawn IS NOT NULL THEN 'restored' WHEN c.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS class,
    c.number AS old_number, n.number AS new_number, c.status AS old_status, n.status AS new_status, c.lon AS old_lon, n.lon AS new_lon
  FROM published c FULL OUTER JOIN staged n ON c.point_id = n.point_id)"""
REGIONS = ["00", "01", "02"]


@query(
    "merge_points",
    "published",
    "staged",
    sql=f"""WITH {MERGED}
SELECT point_id, class, CASE WHEN class IN ('new', 'changed', 'restored') THEN new_number ELSE old_number END AS number,
  CASE WHEN class IN ('new', 'changed', 'restored') THEN coalesce(new_status, old_status) ELSE old_status END AS status,
  round(CASE WHEN class IN ('new', 'changed', 'restored') THEN coalesce(new_lon, old_lon) ELSE old_lon END, 4) AS lon, class IN ('withdrawn', 'gone') AS is_withdrawn FROM merged""",
)
def _(published, staged):
    out = publish.merge_points(published, staged, AS_OF, REGIONS)
    return out.select("point_id", "class", "number", "status", F.round("lon", 4).alias("lon"), F.col("withdrawn").isNotNull().alias("is_withdrawn"))


@query("publish_summary", "published", "staged", sql=f"WITH {MERGED} SELECT region, count(*) FILTER (class = 'new') AS added, count(*) FILTER (class = 'changed') AS changed, count(*) FILTER (class = 'restored') AS restored, count(*) FILTER (class = 'withdrawn') AS withdrawn, count(*) FILTER (class = 'unchanged') AS unchanged FROM merged GROUP BY 1")
def _(published, staged):
    return publish.publish_summary(publish.merge_points(published, staged, AS_OF, REGIONS), ["region"])


@query(
    "merge_localities",
    "locality",
    sql="""
WITH c AS (SELECT * FROM locality WHERE cast(simc AS bigint) % 5 <> 0), s AS (SELECT simc, name || ' N' AS name, kind + 1 AS kind, lon + 1 AS lon, gml_id FROM locality WHERE cast(simc AS bigint) % 7 <> 0)
SELECT coalesce(c.simc, s.simc) AS simc, coalesce(s.name, c.name) AS name, coalesce(c.kind, s.kind) AS kind, coalesce(c.lon, s.lon) AS lon, s.simc IS NULL AND c.withdrawn IS NOT NULL AS is_withdrawn FROM c FULL OUTER JOIN s ON c.simc = s.simc""",
)
def _(locality):
    code = F.col("simc").cast("bigint")
    staged = locality.where(code % 7 != 0).withColumn("name", F.concat("name", F.lit(" N"))).withColumn("kind", F.col("kind") + 1).withColumn("lon", F.col("lon") + 1)
    out = publish.merge_localities(locality.where(code % 5 != 0), staged)
    return out.select("simc", "name", "kind", "lon", F.col("withdrawn").isNotNull().alias("is_withdrawn"))


@query(
    "merge_streets",
    "street",
    "locality",
    sql="""
WITH c AS (SELECT * FROM street WHERE cast(simc AS bigint) % 5 <> 0), s AS (SELECT *, name || '!' AS new_name FROM street WHERE cast(simc AS bigint) % 3 <> 0 AND simc IN (SELECT simc FROM locality))
SELECT coalesce(c.street_id, s.simc || '-' || s.sym_ul) AS street_id, coalesce(s.new_name, c.name) AS name, coalesce(s.kind, c.kind) AS kind FROM c FULL OUTER JOIN s ON c.simc = s.simc AND c.sym_ul = s.sym_ul""",
)
def _(street, locality):
    code = F.col("simc").cast("bigint")
    staged = street.where(code % 3 != 0).withColumn("name", F.concat("name", F.lit("!"))).withColumn("source", F.lit("official"))
    return publish.merge_streets(street.where(code % 5 != 0), staged, locality).select("street_id", "name", "kind")


DUPLICATE = """
d AS (SELECT s.*, count(p.point_id) AS n_points FROM (SELECT street_id, simc, sym_ul, kind, name, name_norm, official FROM street) s LEFT JOIN point p ON p.street_id = s.street_id GROUP BY ALL),
r AS (SELECT *, first_value(street_id) OVER (PARTITION BY simc, kind ORDER BY n_points DESC, street_id) AS survivor FROM d)"""


@query("merge_duplicate_streets", "street", "point", sql=f"WITH {DUPLICATE} SELECT survivor AS street_id, cast(sum(n_points) AS bigint) AS n_points, coalesce(min_by(name, street_id) FILTER (official), max(name) FILTER (street_id = survivor)) AS name FROM r GROUP BY survivor")
def _(street, point):
    return publish.merge_duplicate_streets(street, point, ["simc", "kind"])[0].select("street_id", "n_points", "name")


@query("remapped_points", "street", "point", sql=f"WITH {DUPLICATE} SELECT p.point_id, r.survivor AS street_id FROM point p LEFT JOIN r ON p.street_id = r.street_id")
def _(street, point):
    return publish.merge_duplicate_streets(street, point, ["simc", "kind"])[1].select("point_id", "street_id")


REPORT = """
g AS (SELECT simc, kind, count(*) AS n FROM {s} GROUP BY ALL), m AS (SELECT simc, name_norm, count(DISTINCT sym_ul) AS c FROM {s} GROUP BY ALL)
SELECT 'streets' AS measure, count(*) AS value FROM {s} UNION ALL SELECT 'surplus_rows_of_codes', cast(coalesce(sum(n - 1), 0) AS bigint) FROM (SELECT count(*) AS n FROM {s} WHERE sym_ul IS NOT NULL GROUP BY simc, sym_ul) UNION ALL SELECT 'duplicate_groups', count(*) FROM g WHERE n > 1 UNION ALL SELECT 'surplus_rows', cast(coalesce(sum(n - 1), 0) AS bigint) FROM g
UNION ALL SELECT 'names_with_several_codes', count(*) FROM m WHERE c > 1 UNION ALL SELECT 'streets_without_kind', count(*) FROM {s} WHERE kind IS NULL UNION ALL SELECT 'streets_without_code', count(*) FROM {s} WHERE sym_ul IS NULL
UNION ALL SELECT 'streets_without_points', count(*) FROM {s} WHERE street_id NOT IN (SELECT street_id FROM {p} WHERE street_id IS NOT NULL) UNION ALL SELECT 'points', count(*) FROM {p}
UNION ALL SELECT 'points_of_missing_streets', count(*) FROM {p} WHERE street_id IS NOT NULL AND street_id NOT IN (SELECT street_id FROM {s}) UNION ALL SELECT 'points_with_street', count(*) FROM {p} WHERE street_id IS NOT NULL"""


@query("merge_report", "street", "point", sql="WITH " + REPORT.format(s="street", p="point"))
def _(street, point):
    return publish.merge_report(street, point, ["simc", "kind"])


BOTH_PASSES = """
st AS (SELECT * REPLACE (CASE WHEN sym_ul IN ('00003', '00005') AND cast(simc AS bigint) % 2 = 0 THEN NULL WHEN sym_ul = '00002' THEN '00001' ELSE sym_ul END AS sym_ul, CASE WHEN sym_ul = '00005' THEN 'medium' ELSE name_norm END AS name_norm, CASE WHEN sym_ul = '00001' THEN NULL ELSE kind END AS kind) FROM street),
c AS (SELECT s.*, (SELECT count(*) FROM point p WHERE p.street_id = s.street_id) AS n FROM st s),
r AS (SELECT street_id, n, name, name_norm, official, kind, first_value(street_id) OVER (PARTITION BY sym_ul IS NULL, simc, coalesce(sym_ul, name_norm || '|' || kind) ORDER BY n DESC, street_id) AS survivor FROM c)"""


@query("merge_both_passes", "street", "point", sql=f"WITH {BOTH_PASSES} SELECT survivor AS street_id, cast(sum(n) AS bigint) AS n_points, coalesce(min_by(name, street_id) FILTER (official), max(name) FILTER (street_id = survivor)) AS name, coalesce(max(kind) FILTER (street_id = survivor), min(kind)) AS kind FROM r GROUP BY 1")
def _(street, point):
    return publish.merge_all_duplicates(_doubled(street), point)[0].select("street_id", "n_points", "name", "kind")


@query("merge_comparison", "street", "point", sql=f"WITH {BOTH_PASSES}, st2 AS (SELECT * FROM st WHERE street_id IN (SELECT survivor FROM r)), p2 AS (SELECT p.* REPLACE (r.survivor AS street_id) FROM point p LEFT JOIN r ON p.street_id = r.street_id), k2 AS (SELECT r.survivor AS street_id, coalesce(max(kind) FILTER (r.street_id = survivor), min(kind)) AS kind, coalesce(min_by(name_norm, street_id) FILTER (official), max(name_norm) FILTER (r.street_id = survivor)) AS name_norm FROM r GROUP BY 1), st3 AS (SELECT s.* REPLACE (k2.kind AS kind, k2.name_norm AS name_norm) FROM st2 s JOIN k2 ON s.street_id = k2.street_id), a AS (WITH {REPORT.format(s='st', p='point')}), b AS (WITH {REPORT.format(s='st3', p='p2')}) SELECT a.measure, a.value AS before, b.value AS after FROM a JOIN b ON a.measure = b.measure UNION ALL SELECT 'merged_streets', 0, count(*) FROM r WHERE street_id <> survivor", keep=("street",))
def _(street, point):
    # What both states read of streets and points is made once.
    before = (_doubled(street), kept("linked", point.select("street_id", "withdrawn")))
    return publish.merge_comparison(before, publish.merge_all_duplicates(*before), ["simc", "kind"])


def _doubled(street):
    """Streets with codes that occur twice, streets without codes, some of them alike, and streets without a kind."""
    odd = F.col("simc").cast("bigint") % 2 == 0
    code = F.when(F.col("sym_ul").isin("00003", "00005") & odd, None).when(F.col("sym_ul") == "00002", "00001").otherwise(F.col("sym_ul"))
    return street.select("street_id", "simc", code.alias("sym_ul"), F.when(F.col("sym_ul") != "00001", F.col("kind")).alias("kind"), "name", F.when(F.col("sym_ul") == "00005", "medium").otherwise(F.col("name_norm")).alias("name_norm"), "official", "withdrawn")


# --- Quality gates ------------------------------------------------------------------------------------------------------


@query("snapshot_delta", "published", "staged", sql="WITH c AS (SELECT * FROM published WHERE withdrawn IS NULL) SELECT count(c.point_id) AS before, count(n.point_id) AS after, count(*) FILTER (c.point_id IS NULL) AS added, count(*) FILTER (n.point_id IS NULL) AS removed, count(*) FILTER (c.hash <> n.hash) AS changed FROM c FULL OUTER JOIN staged n ON c.point_id = n.point_id")
def _(published, staged):
    return quality.snapshot_delta(published, staged)


@query("commune_drop", "published", "staged", sql="WITH b AS (SELECT terc, count(*) AS before FROM published WHERE withdrawn IS NULL GROUP BY 1), a AS (SELECT terc, count(*) AS after FROM staged GROUP BY 1) SELECT b.terc, before, coalesce(after, 0) AS after, round((before - coalesce(after, 0))::double / before, 6) AS drop_share FROM b LEFT JOIN a ON a.terc = b.terc WHERE before > 10 AND (before - coalesce(after, 0))::double / before > 0.01")
def _(published, staged):
    return quality.commune_drop(published, staged, 10, 0.01, None).select("terc", "before", "after", F.round("drop_share", 6).alias("drop_share"))


@query(
    "quality_report",
    "published",
    "staged",
    sql="""
WITH c AS (SELECT * FROM published WHERE withdrawn IS NULL), d AS (SELECT count(c.point_id) AS b, count(n.point_id) AS a FROM c FULL OUTER JOIN staged n ON c.point_id = n.point_id),
t AS (SELECT count(*) FILTER (x.b > 100 AND (x.b - coalesce(y.a, 0))::double / x.b > 0.1) AS n FROM (SELECT terc, count(*) AS b FROM c GROUP BY 1) x LEFT JOIN (SELECT terc, count(*) AS a FROM staged GROUP BY 1) y ON x.terc = y.terc),
g AS (SELECT count(*) FILTER (lon IS NOT NULL AND NOT (lon BETWEEN 13.9 AND 24.3 AND lat BETWEEN 48.9 AND 55.0)) AS o, count(*) FILTER (lon IS NULL)::double / count(*) AS w FROM staged)
SELECT 'minimum_rows' AS gate, 'blocking' AS level, a >= 1000 AS ok, round(a::double, 6) AS value FROM d UNION ALL SELECT 'delta_size', 'blocking', abs(a - b)::double / b <= 0.02, round(abs(a - b)::double / b, 6) FROM d
UNION ALL SELECT 'commune_drop', 'blocking', n = 0, n::double FROM t UNION ALL SELECT 'zero_delta', 'warning', true, 0.0 UNION ALL SELECT 'outside_country', 'blocking', o = 0, o::double FROM g UNION ALL SELECT 'without_position', 'warning', w <= 0.02, round(w, 6) FROM g""",
)
def _(published, staged):
    return quality.quality_report(published, staged, {"min_rows": 1000}).select("gate", "level", "ok", F.round("value", 6).alias("value"))


@query(
    "same_snapshot",
    "staged",
    sql="WITH d AS (SELECT count(*) FILTER (a.point_id IS NULL OR b.point_id IS NULL OR a.hash <> b.hash) AS n FROM staged a FULL OUTER JOIN staged b ON a.point_id = b.point_id), m AS (SELECT count(*) FILTER (k % 1000 = 1) AS n FROM staged) SELECT 'same' AS snapshot, 40 AS days, n > 0 AS ok FROM d UNION ALL SELECT 'same', 3, true FROM d UNION ALL SELECT 'changed', 40, n > 0 FROM m",
)
def _(staged):
    """The warning about a snapshot without a change: old data, new data, and one with a few changes."""
    changed = staged.withColumn("hash", F.when(F.col("k") % 1000 == 1, "other").otherwise(F.col("hash")))
    cases = [("same", 40, staged), ("same", 3, staged), ("changed", 40, changed)]
    return union_all(*(quality.quality_report(staged, new, {}, days).where("gate = 'zero_delta'").select(F.lit(name).alias("snapshot"), F.lit(days).alias("days"), "ok") for name, days, new in cases))


@query("shrunken_reloads", "published", "staged", sql="WITH a AS (SELECT region, count(*) AS n FROM published GROUP BY 1), b AS (SELECT region, count(*) AS n FROM staged WHERE region <> '00' AND (k % 3 = 0 OR region <> '01') GROUP BY 1) SELECT coalesce(a.region, b.region) AS region, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(a.n, 0) = 0 OR coalesce(b.n, 0) >= a.n * 0.5 AS ok FROM a FULL OUTER JOIN b ON a.region = b.region")
def _(published, staged):
    """A reload that lacks one region and two thirds of another."""
    return quality.shrunken(published, staged.where("region <> '00' AND (k % 3 = 0 OR region <> '01')"), "region")


# --- Comparison of sources ------------------------------------------------------------------------------------------------

KEYS = """
rk AS (SELECT 's|' || p.simc || '|' || coalesce(s.name_norm, '') || '|' || p.number_key AS ks, 'n|' || l.name_norm || '|' || coalesce(s.name_norm, '') || '|' || p.number_key AS kn, p.postal_code AS registry_code
  FROM published p JOIN locality l ON p.simc = l.simc LEFT JOIN street s ON p.street_id = s.street_id WHERE p.withdrawn IS NULL),
z AS (SELECT *, CASE WHEN simc IS NOT NULL THEN 's|' || simc || '|' || coalesce(street_norm, '') || '|' || number_key ELSE 'n|' || locality_norm || '|' || coalesce(street_norm, '') || '|' || number_key END AS key FROM secondary),
gap AS (SELECT * FROM z WHERE key NOT IN (SELECT ks FROM rk UNION ALL SELECT kn FROM rk))"""
_COMPARED = ("secondary", "published", "locality", "street")


def _sides(secondary, published, locality, street):
    return compare.source_keys(secondary), compare.registry_keys(published, locality, street)


@query("diff_totals", *_COMPARED, sql=f"WITH {KEYS} SELECT (SELECT count(*) FROM z) AS in_source, (SELECT count(*) FROM rk) AS in_registry, (SELECT count(*) FROM z) - (SELECT count(*) FROM gap) AS common, (SELECT count(*) FROM gap) AS only_source, round((SELECT count(*) FROM gap)::double / (SELECT count(*) FROM z), 6) AS gap_share")
def _(secondary, published, locality, street):
    return compare.diff_totals(*_sides(secondary, published, locality, street)).withColumn("gap_share", F.round("gap_share", 6))


@query("diff_sample", *_COMPARED, sql=f"WITH {KEYS} SELECT id, simc, number_key FROM gap ORDER BY id LIMIT 25")
def _(secondary, published, locality, street):
    return compare.diff_sample(*_sides(secondary, published, locality, street)).select("id", "simc", "number_key")


@query("diff_postal", *_COMPARED, sql=f"WITH {KEYS} SELECT id, postal_code, registry_code FROM z JOIN (SELECT ks AS k, registry_code FROM rk UNION ALL SELECT kn, registry_code FROM rk) ON key = k WHERE postal_code <> registry_code")
def _(secondary, published, locality, street):
    return compare.diff_postal(*_sides(secondary, published, locality, street)).select("id", "postal_code", "registry_code")


@query("diff_communes", *_COMPARED, sql=f"WITH {KEYS} SELECT coalesce(l.terc, 'unknown') AS terc, count(*) AS gaps FROM gap LEFT JOIN locality l ON gap.simc = l.simc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(secondary, published, locality, street):
    return compare.diff_communes(*_sides(secondary, published, locality, street), locality)


@query(
    "diff_report",
    *_COMPARED,
    sql=f"""WITH {KEYS}, n AS (SELECT (SELECT count(*) FROM z) AS a, (SELECT count(*) FROM rk) AS b, (SELECT count(*) FROM gap) AS g, (SELECT count(*) FROM z JOIN (SELECT ks AS k, registry_code FROM rk UNION ALL SELECT kn, registry_code FROM rk) ON key = k WHERE postal_code <> registry_code) AS p)
SELECT 'totals' AS section, 'in_source' AS item, a::double AS value, a = 0 AS warning FROM n UNION ALL SELECT 'totals', 'in_registry', b, false FROM n UNION ALL SELECT 'totals', 'common', a - g, false FROM n UNION ALL SELECT 'totals', 'only_source', g, false FROM n
UNION ALL SELECT 'totals', 'gap_share', round(g::double / a, 6), g::double / a > 0.05 FROM n UNION ALL SELECT 'totals', 'postal_pairs', p, p > 0 FROM n UNION ALL SELECT 'first gaps', id, 1, false FROM (SELECT id FROM gap ORDER BY id LIMIT 25)
UNION ALL SELECT 'communes', terc, n, false FROM (SELECT coalesce(l.terc, 'unknown') AS terc, count(*) AS n FROM gap LEFT JOIN locality l ON gap.simc = l.simc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
)
def _(secondary, published, locality, street):
    return compare.diff_report(*_sides(secondary, published, locality, street), locality).withColumn("value", F.round("value", 6))


@query("merge_secondary", *_COMPARED, sql=f"WITH {KEYS} SELECT false AS accepted, count(*) AS n FROM rk UNION ALL SELECT true, count(*) FROM gap")
def _(secondary, published, locality, street):
    z, k = _sides(secondary, published, locality, street)
    return publish.merge_secondary(k, z, "key_simc", "key_name", True).groupBy("accepted").agg(F.count("*").alias("n"))


# --- Search ---------------------------------------------------------------------------------------------------------------


def _index(locality, street, unit, point):
    s, m = publish.refresh_derived(point, street, locality)
    docs = search.build_docs(m, s, unit)
    return docs, search.build_keys(docs)


DOCS = """
lp AS (SELECT simc, count(*) AS n FROM point GROUP BY 1), sp AS (SELECT street_id, count(*) AS n FROM point WHERE street_id IS NOT NULL GROUP BY 1),
loc AS (SELECT l.*, coalesce(n, 0) AS pts, l.simc IN (SELECT simc FROM street) AS hs FROM locality l LEFT JOIN lp ON l.simc = lp.simc WHERE l.withdrawn IS NULL),
docs AS (SELECT 'L-' || simc AS doc_id, 'locality' AS type, name AS label, simc, pts AS n_points, pts AS locality_points FROM loc WHERE pts > 0 OR hs
  UNION ALL SELECT 'S-' || s.street_id, 'street', s.kind || ' ' || s.name || ', ' || loc.name, s.simc, coalesce(sp.n, 0), loc.pts FROM street s JOIN loc ON s.simc = loc.simc LEFT JOIN sp ON s.street_id = sp.street_id),
toks AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('ul', 'al', 'pl', 'os', 'im')) AS t FROM docs),
keys AS (SELECT DISTINCT array_to_string(list_slice(t, i, len(t)), ' ') AS key, doc_id FROM (SELECT doc_id, t, unnest(range(1, least(len(t), 6) + 1)) AS i FROM toks))"""
_INDEXED = ("locality", "street", "unit", "point")


@query("search_docs", *_INDEXED, sql=f"WITH {DOCS} SELECT * FROM docs")
def _(locality, street, unit, point):
    return _index(locality, street, unit, point)[0].select("doc_id", "type", "label", "simc", "n_points", "locality_points")


@query("search_keys", *_INDEXED, sql=f"WITH {DOCS} SELECT key, doc_id FROM keys")
def _(locality, street, unit, point):
    return search.sorted_keys(_index(locality, street, unit, point)[1])


@query("index_stats", *_INDEXED, sql=f"WITH {DOCS} SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM keys) AS keys, count(*) FILTER (type = 'locality') AS localities, count(*) FILTER (type = 'street') AS streets FROM docs")
def _(locality, street, unit, point):
    return search.index_stats(*_index(locality, street, unit, point))


@query("streets_of_locality", *_INDEXED, sql=f"WITH {DOCS} SELECT simc, label, n_points, row_number() OVER (PARTITION BY simc ORDER BY n_points DESC, label, doc_id) AS rank FROM docs WHERE type = 'street'")
def _(locality, street, unit, point):
    docs = _index(locality, street, unit, point)[0]
    return search.streets_of(locality, docs).select("simc", "label", "n_points", "rank")


def suggest_sql(name: str, asked: str, filters: str = "true", k: int = 5) -> str:
    """Expressions that end in ``name``: (query_id, doc_id, score, rank) for ``asked``, rows (query_id, q, want)."""
    n = name
    return f"""
{n}_w AS (SELECT query_id, q, want, list_filter(string_split(q, ' '), lambda x: x <> '') AS t FROM ({asked})),
{n}_sorted AS (SELECT query_id, q, want, (SELECT list(x ORDER BY length(x) DESC, x) FROM (SELECT unnest(y.t) AS x)) AS t FROM {n}_w y),
{n}_pr AS (SELECT query_id, q, want, unnest(p) AS probe, generate_subscripts(p, 1) AS level FROM (SELECT query_id, q, want, list_concat([q], t, CASE WHEN length(t[1]) > 4 THEN list_transform(range(length(t[1]) - 1, 3, -1), lambda n: t[1][1:n]) ELSE [] END) AS p FROM {n}_sorted)),
{n}_hit AS (SELECT pr.*, keys.key, keys.doc_id, min(level) OVER (PARTITION BY query_id) AS best FROM {n}_pr pr JOIN keys ON starts_with(keys.key, pr.probe) JOIN docs d ON keys.doc_id = d.doc_id WHERE {filters}),
{n}_c AS (SELECT query_id, q, doc_id, min(key) AS key FROM {n}_hit WHERE level = best GROUP BY ALL),
{n}_n AS (SELECT c.*, d.label, d.n_points, d.locality_points, trim(regexp_replace(lower(d.label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM {n}_c c JOIN docs d ON c.doc_id = d.doc_id),
{n}_o AS (SELECT *, CASE WHEN split_part(norm, ' ', 1) IN ('ulica', 'ul', 'aleja', 'al', 'plac', 'pl') AND position(' ' IN norm) < length(norm) THEN position(' ' IN norm) ELSE 0 END AS off, string_split(q, ' ') AS qt, string_split(norm, ' ') AS nt FROM {n}_n),
{n}_e AS (SELECT *, NOT starts_with(norm, q) AND off > 0 AND starts_with(substring(norm, off + 1), q) AS moved,
  list_transform(qt, lambda t: list_min(list_transform(nt, lambda x: CASE WHEN starts_with(x, t) THEN 0 WHEN abs(length(x) - length(t)) <= 2 AND levenshtein(t, x) <= 2 THEN levenshtein(t, x) END))) AS ed FROM {n}_o),
{n}_s AS (SELECT *, CASE WHEN len(list_filter(ed, lambda v: v IS NOT NULL)) = 0 THEN 0 ELSE CASE WHEN starts_with(norm, q) OR moved THEN 1000.0 WHEN contains(norm, q) THEN 500.0 ELSE 0.0 END
  + 600.0 * len(list_filter(ed, lambda v: v IS NOT NULL)) / len(ed) - 40.0 * coalesce(list_sum(ed), 0) + 30 * log10(n_points + 1) + 25 * log10(locality_points + 1) - 1.5 * least(length(norm) - CASE WHEN moved THEN off ELSE 0 END, 60) END AS score FROM {n}_e),
{name} AS (SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, key, doc_id) AS rank FROM {n}_s WHERE score <> 0) WHERE rank <= {k})"""


ASKED = "SELECT simc AS query_id, lower(CASE WHEN cast(simc AS bigint) % 3 = 0 THEN substring(name, 1, 6) WHEN cast(simc AS bigint) % 3 = 1 THEN name ELSE replace(name, 'U', 'O') END) AS q, '' AS want FROM locality WHERE cast(simc AS bigint) % 20 = 0"


@query("suggest", *_INDEXED, sql=f"WITH {DOCS}, {suggest_sql('top', ASKED)} SELECT query_id, doc_id, score, rank FROM top")
def _(locality, street, unit, point):
    index = search.build_index(_index(locality, street, unit, point)[0])
    code = F.col("simc").cast("bigint") % 3
    text = F.when(code == 0, F.substring("name", 1, 6)).when(code == 1, F.col("name")).otherwise(F.replace("name", F.lit("U"), F.lit("O")))
    # The query set of a search: every twentieth locality, against all documents.
    asked = locality.where(F.col("simc").cast("bigint") % 20 == 0)
    return search.suggest(asked.select(F.col("simc").alias("query_id"), text.alias("q")), index, 5).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


GOLDEN = "SELECT simc AS query_id, lower(name) AS q, '' AS want FROM locality WHERE withdrawn IS NULL AND cast(simc AS bigint) % 20 = 0"


@query(
    "golden_suggestions",
    *_INDEXED,
    sql=f"WITH {DOCS}, {suggest_sql('top', GOLDEN)}, asked AS (SELECT simc, name FROM locality WHERE withdrawn IS NULL AND cast(simc AS bigint) % 20 = 0) SELECT ok, count(*) AS n FROM (SELECT a.simc, coalesce(min(rank) FILTER (d.label = a.name) <= 3, false) AS ok FROM asked a LEFT JOIN top t ON a.simc = t.query_id LEFT JOIN docs d ON t.doc_id = d.doc_id GROUP BY 1) GROUP BY 1",
)
def _(locality, street, unit, point):
    index = search.build_index(_index(locality, street, unit, point)[0])
    asked = locality.where("withdrawn IS NULL AND cast(simc AS bigint) % 20 = 0").select(F.col("simc").alias("query_id"), F.col("name").alias("q"))
    expected = asked.select("query_id", F.col("q").alias("label"), F.lit(3).alias("within"))
    return search.evaluate_golden(expected, search.suggest(asked, index, 5)).groupBy("ok").agg(F.count("*").alias("n"))


@query(
    "streets_matching",
    *_INDEXED,
    sql=f"WITH {DOCS}, {suggest_sql('top', """SELECT simc AS query_id, CASE WHEN cast(simc AS bigint) % 2 = 0 THEN 'ur' ELSE 'speciified' END AS q, simc AS want FROM locality""", "d.type = 'street' AND d.simc = pr.want", 2)} SELECT query_id, doc_id, rank FROM top",
)
def _(locality, street, unit, point):
    index = search.build_index(_index(locality, street, unit, point)[0])
    asked = locality.select(F.col("simc").alias("query_id"), F.when(F.col("simc").cast("bigint") % 2 == 0, "ur").otherwise("speciified").alias("q"), "simc")
    return search.streets_matching(asked, index, 2).select("query_id", "doc_id", "rank")


# --- Lookups --------------------------------------------------------------------------------------------------------------


@query("numbers_on_streets", "published", "street", sql="SELECT simc, street_id, number, rank FROM (SELECT *, row_number() OVER (PARTITION BY simc, street_id ORDER BY number_sort, point_id) AS rank FROM published WHERE withdrawn IS NULL AND street_id IS NOT NULL AND starts_with(number_key, '1')) WHERE rank <= 20")
def _(published, street):
    return lookup.numbers(published, street.select("simc", "street_id", F.lit("1").alias("prefix")), 20).select("simc", "street_id", "number", "rank")


@query(
    "postal_codes",
    "published",
    "point",
    sql="""
WITH a AS (SELECT * FROM published WHERE withdrawn IS NULL), ex AS (SELECT simc, street_id, number_key, min(postal_code) AS c FROM a WHERE postal_code IS NOT NULL GROUP BY ALL),
st AS (SELECT street_id, postal_code AS c FROM (SELECT street_id, postal_code, row_number() OVER (PARTITION BY street_id ORDER BY count(*) DESC, postal_code) AS r FROM a WHERE postal_code IS NOT NULL AND street_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
pl AS (SELECT simc, postal_code AS c FROM (SELECT simc, postal_code, row_number() OVER (PARTITION BY simc ORDER BY count(*) DESC, postal_code) AS r FROM a WHERE postal_code IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
SELECT p.point_id, coalesce(ex.c, CASE WHEN p.street_id IS NOT NULL THEN st.c ELSE pl.c END) AS found_code, CASE WHEN ex.c IS NOT NULL THEN 'registry' WHEN CASE WHEN p.street_id IS NOT NULL THEN st.c ELSE pl.c END IS NOT NULL THEN 'dominant' ELSE 'none' END AS code_source
FROM point p LEFT JOIN ex ON p.simc = ex.simc AND p.street_id IS NOT DISTINCT FROM ex.street_id AND p.number_key = ex.number_key LEFT JOIN st ON p.street_id = st.street_id LEFT JOIN pl ON p.simc = pl.simc""",
)
def _(published, point):
    return lookup.postal_code_with_fallback(point.select("point_id", "simc", "street_id", "number_key"), published).select("point_id", "found_code", "code_source")


@query("locality_details", "locality", "unit", sql="SELECT l.simc, l.name, k.name AS kind_name, g.name AS commune, w.name AS voivodeship FROM locality l LEFT JOIN (SELECT 0 AS code, 'part' AS name UNION ALL SELECT 1, 'village') k ON l.kind = k.code LEFT JOIN unit g ON l.terc = g.terc AND g.level = 3 LEFT JOIN unit c ON g.parent_terc = c.terc AND c.level = 2 LEFT JOIN unit w ON c.parent_terc = w.terc AND w.level = 1 WHERE l.withdrawn IS NULL")
def _(locality, unit):
    kinds = locality.sparkSession.createDataFrame([(0, "part"), (1, "village")], "code int, name string")
    return lookup.locality_details(locality, unit, kinds).select("simc", "name", "kind_name", "commune", "voivodeship")


@query(
    "reverse_geocode",
    "locality",
    "published",
    sql="""
WITH d AS (SELECT l.simc AS input_id, p.point_id, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(p.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2))) AS distance
  FROM locality l JOIN published p ON p.withdrawn IS NULL AND abs(p.lat - l.lat) < 0.05 AND abs(p.lon - l.lon) < 0.08 WHERE l.lon IS NOT NULL)
SELECT input_id, point_id, round(distance, 2) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY distance, point_id) AS rank FROM d WHERE distance <= 4000) WHERE rank <= 5""",
)
def _(locality, published):
    inputs = locality.where("lon IS NOT NULL").select(F.col("simc").alias("input_id"), "lon", "lat")
    return lookup.reverse_geocode(inputs, published, 4000, 5).select("input_id", "point_id", F.round("distance", 2).alias("distance"), "rank")


@query(
    "nearest_in_town",
    "locality",
    "published",
    sql="""
WITH t AS (SELECT point_id, CASE WHEN k % 10 = 0 THEN lon ELSE 19 + (lon - 19) / 400 END AS lon, CASE WHEN k % 10 = 0 THEN lat ELSE 52 + (lat - 52) / 400 END AS lat FROM published WHERE withdrawn IS NULL),
i AS (SELECT simc AS input_id, 19 + cast(cast(simc AS bigint) % 97 - 48 AS double) / 1600 AS lon, 52 + cast(cast(simc AS bigint) % 89 - 44 AS double) / 1600 AS lat FROM locality),
d AS (SELECT input_id, point_id, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(t.lat - i.lat) / 2), 2) + cos(radians(i.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - i.lon) / 2), 2))) AS distance FROM i JOIN t ON abs(t.lat - i.lat) < 0.05 AND abs(t.lon - i.lon) < 0.08)
SELECT input_id, point_id, round(distance, 2) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY distance, point_id) AS rank FROM d WHERE distance <= 4000) WHERE rank <= 3""",
)
def _(locality, published):
    """A map with nine tenths of its points in one town of a few kilometres."""
    town = lambda c, at: F.when(F.col("k") % 10 == 0, F.col(c)).otherwise(at + (F.col(c) - at) / 400).alias(c)
    points = published.select("point_id", "withdrawn", town("lon", 19), town("lat", 52))
    code = F.col("simc").cast("bigint")
    inputs = locality.select(F.col("simc").alias("input_id"), (19 + (code % 97 - 48).cast("double") / 1600).alias("lon"), (52 + (code % 89 - 44).cast("double") / 1600).alias("lat"))
    return lookup.reverse_geocode(inputs, points, 4000, 3).select("input_id", "point_id", F.round("distance", 2).alias("distance"), "rank")


# --- Parsing and validation -------------------------------------------------------------------------------------------------


@query("parse_address_lines", "line", sql="SELECT query_id, expected_postal AS postal_code, expected_locality AS locality, expected_kind AS street_kind, expected_street AS street, expected_building AS building, expected_flat AS flat, expected_other AS other, CASE WHEN box THEN 'po_box' END AS unusual, line AS raw FROM line")
def _(line):
    parsed = validate.parse_address_lines(validate.spread(line.select("query_id", "line"), "query_id")).select("query_id", "parsed.*")
    return parsed.select("query_id", "postal_code", "locality", "street_kind", "street", "building", "flat", F.array_join("alternatives", ",").alias("other"), "unusual", "raw")


VALIDATED = f"""
{DOCS},
named AS (SELECT name_norm, arg_min(simc, (-pts, simc)) AS simc, count(*) AS n FROM loc GROUP BY 1),
lines AS (SELECT *, lower(expected_locality) AS place, lower(expected_street) AS road FROM line),
{suggest_sql('loc_top', "SELECT DISTINCT place AS query_id, place AS q, '' AS want FROM lines WHERE place NOT IN (SELECT name_norm FROM named)", "d.type = 'locality'")},
loc_hit AS (SELECT query_id, substring(arg_min(doc_id, rank), 3) AS simc, count(*) AS n FROM loc_top GROUP BY 1),
placed AS (SELECT l.*, coalesce(m.simc, h.simc) AS simc, coalesce(m.n, h.n, 0) AS candidates FROM lines l LEFT JOIN named m ON l.place = m.name_norm LEFT JOIN loc_hit h ON l.place = h.query_id),
roads AS (SELECT p.*, x.name AS locality_name, x.hs, s.street_id AS exact FROM placed p LEFT JOIN loc x ON p.simc = x.simc LEFT JOIN street s ON p.simc = s.simc AND p.road = s.name_norm),
{suggest_sql('road_top', "SELECT DISTINCT simc || '|' || road AS query_id, road AS q, simc AS want FROM roads WHERE exact IS NULL AND simc IS NOT NULL AND road IS NOT NULL", "d.type = 'street' AND d.simc = pr.want", 1)},
found AS (SELECT r.*, coalesce(exact, substring(t.doc_id, 3)) AS street_id FROM roads r LEFT JOIN road_top t ON r.simc || '|' || r.road = t.query_id),
num AS (SELECT simc, street_id, number_key, arg_min(postal_code, point_id) AS code, min(point_id) AS point_id, arg_min(status, point_id) AS status, arg_min(number, point_id) AS number, max(1) AS one FROM point GROUP BY 1, 2, 3),
asked AS (SELECT *, expected_building IS NOT NULL AND (street_id IS NOT NULL OR NOT coalesce(hs, true)) AS ask FROM found),
hit AS (SELECT a.*, CASE WHEN ask THEN coalesce(x.one, y.one) IS NOT NULL END AS number_exists, CASE WHEN x.one = 1 THEN expected_building WHEN y.one = 1 THEN expected_other END AS matched,
    CASE WHEN x.one = 1 THEN x.code ELSE y.code END AS registry_code, CASE WHEN x.one = 1 THEN x.status ELSE y.status END AS status, CASE WHEN x.one = 1 THEN x.point_id ELSE y.point_id END AS point_id, CASE WHEN x.one = 1 THEN x.number ELSE y.number END AS registry_number
  FROM asked a LEFT JOIN num x ON a.ask AND a.simc = x.simc AND a.street_id IS NOT DISTINCT FROM x.street_id AND lower(a.expected_building) = x.number_key
  LEFT JOIN num y ON a.ask AND a.simc = y.simc AND a.street_id IS NOT DISTINCT FROM y.street_id AND lower(a.expected_other) = y.number_key),
checked AS (SELECT *, simc IS NOT NULL AND (expected_street IS NULL OR street_id IS NOT NULL) AND coalesce(number_exists, false) AS full_match,
    concat_ws(',', CASE WHEN expected_building IS NULL THEN 'missing_number' END, CASE WHEN expected_postal = '00-000' THEN 'bad_postal_code' END, CASE WHEN simc IS NULL THEN 'unknown_locality' END, CASE WHEN candidates > 1 THEN 'several_candidates' END,
      CASE WHEN expected_street IS NOT NULL AND NOT hs THEN 'street_where_none_are' END, CASE WHEN expected_street IS NULL AND hs THEN 'missing_street' END, CASE WHEN expected_street IS NOT NULL AND street_id IS NULL THEN 'unknown_street' END,
      CASE WHEN NOT number_exists THEN 'unknown_number' END, CASE WHEN status <> 'istniejacy' THEN 'planned_number' END, CASE WHEN expected_postal <> registry_code THEN 'postal_code_differs' END) AS issues FROM hit),
validated AS (SELECT query_id, simc, street_id, matched, registry_code, CASE WHEN box THEN 'unusual' WHEN full_match THEN 'verified' WHEN simc IS NOT NULL THEN 'partly_verified' ELSE 'unverified' END AS confidence, issues,
    coalesce(locality_name, expected_locality) AS locality, coalesce(registry_number, expected_building, '') AS building, CASE WHEN NOT coalesce(matched = expected_other, false) THEN expected_flat END AS flat, point_id FROM checked)"""
_VALIDATION = ("line", "locality", "street", "unit", "point")


def _validated(line, locality, street, unit, point):
    s, m = publish.refresh_derived(point, street, locality)
    docs = search.build_docs(m, s, unit)
    return validate.validate_addresses(line.select("query_id", "line"), m, s, point, search.build_index(docs))


@query("validate_addresses", *_VALIDATION, sql=f"WITH {VALIDATED} SELECT * FROM validated")
def _(line, locality, street, unit, point):
    out = _validated(line, locality, street, unit, point)
    codes = F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("issues")
    return out.select("query_id", "simc", "street_id", "matched", "registry_code", "confidence", codes, "address.locality", "address.building", "address.flat", "address.point_id")


@query("validation_summary", *_VALIDATION, sql=f"WITH {VALIDATED} SELECT confidence, count(*) AS n FROM validated GROUP BY 1")
def _(line, locality, street, unit, point):
    return validate.validation_summary(_validated(line, locality, street, unit, point))


# --- Scalar functions over whole tables -----------------------------------------------------------------------------------


@query("number_functions", "point", sql="SELECT point_id, number_sort AS sort_key, number_key AS key, number AS canonical FROM point")
def _(point):
    spaced = F.concat(F.lit(" "), F.lower(F.regexp_replace("number", "/", " / ")))
    return point.select("point_id", building_sort_key(F.col("number")).alias("sort_key"), building_key(spaced).alias("key"), canonical_building(spaced).alias("canonical"))


@query("postal_functions", "point", sql="SELECT point_id, CASE WHEN k % 5 = 0 THEN NULL ELSE postal_code END AS code, k % 5 <> 0 AND k % 7 <> 0 AS valid, k % 5 <> 0 AND postal_code IN ('00-000', '99-999', '11-111', '12-345') AS placeholder FROM point WHERE postal_code IS NOT NULL")
def _(point):
    # Every fifth code has lost a digit; of the others every seventh is tested as it is written.
    spaced = F.regexp_replace("postal_code", "-", " ")
    bare = normalize_postal(F.when(F.col("k") % 5 == 0, F.substring(spaced, 1, 5)).otherwise(spaced))
    valid = F.coalesce(is_valid_postal(F.when(F.col("k") % 7 == 0, spaced).otherwise(bare)), F.lit(False))
    return point.where("postal_code IS NOT NULL").select("point_id", bare.alias("code"), (valid & bare.isNotNull()).alias("valid"), F.coalesce(is_placeholder_postal(bare), F.lit(False)).alias("placeholder"))


@query("normalized_documents", "documents", sql="SELECT doc_id, length(n) AS n_chars, len(string_split(n, ' ')) AS n_tokens, md5(n) AS digest FROM (SELECT doc_id, trim(regexp_replace(translate(lower(text), 'ąćęłńóśźżáàâäãåčçďéèêëěíìîïľĺňñôöõòřŕšťúùûüůýžøđ', 'acelnoszzaaaaaaccdeeeeeiiiillnnoooorrstuuuuuyzod'), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents) WHERE n <> ''")
def _(documents):
    n = documents.select("doc_id", normalize_text(F.col("text")).alias("n"), F.size(tokenize(F.col("text"))).cast("bigint").alias("n_tokens")).where("n <> ''")
    return n.select("doc_id", F.length("n").cast("bigint").alias("n_chars"), "n_tokens", F.md5(F.col("n").cast("binary")).alias("digest"))


@query("clean_conversations", "conversations", sql=r"SELECT conv_id, turn, trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS cleaned FROM conversations")
def _(conversations):
    return conversations.select("conv_id", "turn", clean_text(F.col("text")).alias("cleaned"))


@query("unit_codes", "customer", "nation", sql="SELECT c_custkey, lpad(cast(n_regionkey AS string), 2, '0') || lpad(cast(n_nationkey AS string), 2, '0') || lpad(cast(c_custkey % 4 AS string), 2, '0') || '1' AS terc, lpad(cast(n_regionkey AS string), 2, '0') || lpad(cast(n_nationkey AS string), 2, '0') || '000' AS parent_terc, 3 AS level FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(customer, nation):
    code = build_terc(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), (F.col("c_custkey") % 4).cast("string"), F.lit("1"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", code["terc"].alias("terc"), code["parent_terc"].alias("parent_terc"), code["level"].alias("level"))


@query("match_keys", "secondary", sql="SELECT id, 'n|' || locality_norm || '|' || coalesce(street_norm, '') || '|' || number_key AS key FROM secondary")
def _(secondary):
    return secondary.select("id", match_key_name(F.col("locality_norm"), F.col("street_norm"), F.col("number_key")).alias("key"))


# --- Usage and keys ---------------------------------------------------------------------------------------------------------

BILLED = "b AS (SELECT *, CASE WHEN route = '/v1/batch' THEN greatest(items, 1) ELSE 1 END AS units, cast(date_trunc('month', ts) AS date) AS period FROM request WHERE status < 500)"


@query("usage_per_key", "request", sql=f"WITH {BILLED} SELECT key_id, period, count(*) AS requests, cast(sum(units) AS bigint) AS units FROM b GROUP BY 1, 2")
def _(request):
    return usage.usage_agg(request)


@query("monthly_usage", "request", "key", sql=f"WITH {BILLED} SELECT k.client_id, cast(sum(units) AS bigint) AS units, count(*) AS requests FROM b JOIN key k ON b.key_id = k.key_id WHERE period = date '2024-01-01' GROUP BY 1")
def _(request, key):
    return usage.monthly_usage(usage.usage_agg(request), key, "2024-01-01")


@query("quota_flags", "request", "client", sql=f"WITH {BILLED} SELECT event_id, used_before, used_before >= monthly_quota AS rejected FROM (SELECT *, cast(coalesce(sum(units) OVER (PARTITION BY client_id, period ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS used_before FROM b) x JOIN client c ON x.client_id = c.client_id")
def _(request, client):
    return usage.quota_flags(request, client).select("event_id", "used_before", "rejected")


@query("key_state", "key", "client", sql=f"SELECT key_id, CASE WHEN revoked_at <= t THEN 'revoked' WHEN suspended_at <= t THEN 'suspended' WHEN valid_to <= t THEN 'expired' WHEN valid_from > t THEN 'not_yet_valid' ELSE 'active' END AS state FROM key k JOIN client c ON k.client_id = c.client_id, (SELECT timestamp '{AS_OF}' AS t)")
def _(key, client):
    return usage.key_state(key, client, AS_OF).select("key_id", "state")


@query("rate_limits", "request", "key", "client", sql="WITH l AS (SELECT k.client_id, min(least(k.per_minute, c.per_minute)) AS per_minute_limit FROM key k JOIN client c ON k.client_id = c.client_id GROUP BY 1), s AS (SELECT client_id, date_trunc('minute', ts) AS m, count(*) AS requests FROM request GROUP BY 1, 2) SELECT s.client_id, strftime(m, '%Y-%m-%d %H:%M') AS minute, requests, requests > per_minute_limit AS limited FROM s JOIN l ON s.client_id = l.client_id")
def _(request, key, client):
    return usage.rate_limit_flags(request, key, client).select("client_id", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "requests", "limited")


@query("key_report", "key", "request", sql=f"WITH {BILLED}, u AS (SELECT key_id, count(*) AS requests, cast(sum(units) AS bigint) AS units FROM b WHERE period = date '2024-01-01' GROUP BY 1) SELECT k.key_id, k.prefix, o.prefix AS replaces_prefix, coalesce(requests, 0) AS requests, coalesce(units, 0) AS units FROM key k LEFT JOIN u ON k.key_id = u.key_id LEFT JOIN key o ON k.replaces_id = o.key_id")
def _(key, request):
    return usage.key_report(key, usage.usage_agg(request), "2024-01-01").select("key_id", "prefix", "replaces_prefix", "requests", "units")


@query("change_marker", "key", "client", sql="SELECT strftime(greatest((SELECT max(valid_from) FROM key), (SELECT max(revoked_at) FROM key), (SELECT max(suspended_at) FROM client)), '%Y-%m-%d') AS marker")
def _(key, client):
    return usage.change_marker(key, client).select(F.date_format("marker", "yyyy-MM-dd").alias("marker"))


@query("expiring_keys", "key", sql=f"SELECT key_id FROM key WHERE revoked_at IS NULL AND valid_to BETWEEN timestamp '{AS_OF}' AND timestamp '{AS_OF}' + interval '7' day")
def _(key):
    return usage.expiring_keys(key, AS_OF).select("key_id")


@query("keys_by_pepper", "key", sql="SELECT pepper_version, count(*) AS keys FROM key WHERE revoked_at IS NULL GROUP BY 1")
def _(key):
    return usage.keys_by_pepper(key)


@query("find_keys", "key", "client", sql="SELECT key_id, client_name FROM key k JOIN client c ON k.client_id = c.client_id WHERE contains(lower(client_name), '00001')")
def _(key, client):
    return usage.find_keys(key, client, "00001").select("key_id", "client_name")


@query("leaked_keys", "leaky", sql="SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'live' ELSE 'test' END AS environment FROM leaky WHERE doc_id % 9 <= 1 AND text IS NOT NULL")
def _(leaky):
    return usage.scan_leaked_keys(leaky, "text", "doc_id").select("doc_id", "environment")


OUTCOME = "CASE WHEN status < 400 THEN 'ok' WHEN status = 401 THEN 'unauthorized' WHEN status = 403 THEN 'forbidden' WHEN status = 429 THEN 'limited' WHEN status < 500 THEN 'bad_request' ELSE 'error' END"


@query("auth_outcomes", "request", sql=f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM request GROUP BY 1")
def _(request):
    return usage.auth_outcomes(request)


@query("throttled_rejections", "request", sql=f"SELECT outcome, slot, arg_min(event_id, (ts, event_id)) AS event_id FROM (SELECT *, {OUTCOME} AS outcome, cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS slot FROM request WHERE status >= 400) GROUP BY 1, 2")
def _(request):
    return usage.throttle(request, 3600)


# --- Operational metrics ------------------------------------------------------------------------------------------------------


@query("latency_histogram", "request", sql="SELECT route, le, total, round(sum_ms, 3) AS sum_ms, n FROM (SELECT route, b.le, count(*) AS total, sum(ms) AS sum_ms, count(*) FILTER (ms <= b.le) AS n FROM request, (SELECT unnest([0.5, 1, 2, 5, 10, 25, 50, 100, 250, 500])::double AS le) b WHERE starts_with(route, '/v1/') AND status < 400 GROUP BY 1, 2)")
def _(request):
    return opsmetrics.latency_histogram(request)


@query("runs_by_status", "run", sql=f"SELECT status, count(*) AS runs FROM run WHERE started_at > timestamp '{AS_OF}' - interval '30' day AND started_at <= timestamp '{AS_OF}' GROUP BY 1")
def _(run):
    return opsmetrics.runs_by_status(run, AS_OF)


@query("last_run", "run", sql=f"SELECT arg_max(status, (started_at, run_id)) AS status, cast(epoch(timestamp '{AS_OF}') - epoch(max(started_at)) AS bigint) AS seconds_ago FROM run")
def _(run):
    return opsmetrics.last_run(run, AS_OF)


@query("snapshot_history", "run", sql=f"SELECT source, version, date_diff('day', cast(max(started_at) AS date), date '2024-02-01') AS age_days, date_diff('day', cast(max(started_at) AS date), date '2024-02-01') > 30 AS stale FROM run GROUP BY 1, 2 ORDER BY max(started_at) DESC, 1, 2 LIMIT 10")
def _(run):
    log = run.select("source", "version", F.col("started_at").alias("fetched_at"))
    return opsmetrics.snapshot_history(log, AS_OF).select("source", "version", F.col("age_days").cast("bigint").alias("age_days"), "stale")


@query("table_stats", "published", "run", sql="SELECT 'points' AS \"table\", count(*) AS rows, date_diff('day', cast(max(withdrawn) AS date), date '2024-02-01') AS age_days FROM published UNION ALL SELECT 'runs', count(*), -1 FROM run")
def _(published, run):
    return opsmetrics.table_stats({"points": published, "runs": run}, "withdrawn", AS_OF).withColumn("age_days", F.col("age_days").cast("bigint"))


@query(
    "status_warnings",
    "run",
    sql="SELECT source, unnest(list_filter([CASE WHEN date_diff('day', cast(max(started_at) AS date), date '2024-02-01') > 30 THEN 'stale_data' END, CASE arg_max(status, (started_at, run_id)) WHEN 'held' THEN 'last_run_held' WHEN 'error' THEN 'last_run_failed' END], lambda x: x IS NOT NULL)) AS warning FROM (SELECT version AS source, run_id, started_at, status FROM run UNION ALL SELECT 'old', run_id, started_at, 'held' FROM run WHERE started_at < timestamp '2024-01-10 00:00:00') GROUP BY 1",
)
def _(run):
    """For each version its last run, and a group whose runs are all old and held."""
    old = run.where("started_at < timestamp '2024-01-10 00:00:00'").select(F.lit("old").alias("source"), "run_id", "started_at", F.lit("held").alias("status"))
    runs = run.select(F.col("version").alias("source"), "run_id", "started_at", "status").unionByName(old)
    return opsmetrics.status_warnings(runs, runs.withColumnRenamed("started_at", "fetched_at"), AS_OF, by=["source"])


@query("stale_indexes", "run", sql="SELECT source, version, coalesce(max(started_at) FILTER (status = 'ok') < max(started_at) FILTER (status <> 'ok'), false) AS stale FROM run GROUP BY 1, 2")
def _(run):
    """Indexes built by the last good run of a version, against what was published by the others since."""
    built = F.max(F.when(F.col("status") == "ok", F.col("started_at")))
    newest = F.max(F.when(F.col("status") != "ok", F.col("started_at")))
    return run.groupBy("source", "version").agg(opsmetrics.index_is_stale(built, newest).alias("stale"))


@query("added_usage", "request", sql="SELECT key_id, count(*) AS requests, cast(sum(coalesce(items, 1)) AS bigint) AS units FROM request WHERE date_part('day', ts) % 5 <> 4 GROUP BY 1")
def _(request):
    """Usage of four batches, of which one was sent twice."""
    rows = request.select((F.dayofmonth("ts") % 5).alias("batch_id"), "key_id", F.coalesce("items", F.lit(1)).alias("units"))
    batches = rows.groupBy("batch_id", "key_id").agg(F.count("*").alias("requests"), F.sum("units").alias("units"))
    total = usage.add_usage(batches.where("batch_id IN (0, 1, 2)"), batches.where("batch_id IN (2, 3)"))
    return total.groupBy("key_id").agg(F.sum("requests").alias("requests"), F.sum("units").alias("units"))


@query("alerts", "request", sql=f"SELECT alert, metric, value FROM (SELECT 'many_errors' AS alert, 'error' AS metric, count(*)::double AS value FROM request WHERE {OUTCOME} = 'error' UNION ALL SELECT 'many_limited', 'limited', count(*)::double FROM request WHERE {OUTCOME} = 'limited') WHERE value > 10")
def _(request):
    metrics = usage.auth_outcomes(request).select(F.col("outcome").alias("metric"), F.col("n").cast("double").alias("value"))
    return opsmetrics.alerts(metrics, {"many_errors": ("error", ">", 10), "many_limited": ("limited", ">", 10)})


@query("traffic", "request", sql="SELECT cast(date_trunc('day', ts) AS timestamp) AS start, route, round(count(*) / 86400.0, 9) AS per_second, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99 FROM request GROUP BY 1, 2")
def _(request):
    return opsmetrics.traffic(request, "1 day").withColumn("per_second", F.round("per_second", 9))


@query("latency_percentiles", "request", sql="""WITH h AS (SELECT route, b.le, b.low, count(*) AS total, count(*) FILTER (ms <= b.le) AS n, count(*) FILTER (ms <= b.low) AS before FROM request, (SELECT unnest([0.5, 1, 2, 5, 10, 25, 50, 100, 250, 500])::double AS le, unnest([0, 0.5, 1, 2, 5, 10, 25, 50, 100, 250])::double AS low) b WHERE starts_with(route, '/v1/') AND status < 400 GROUP BY ALL)
SELECT route, round(min(low + (le - low) * (total * 0.9 - before) / greatest(n - before, 1)), 2) AS p90 FROM (SELECT *, min(le) OVER (PARTITION BY route) AS least FROM h WHERE n >= total * 0.9) WHERE le = least GROUP BY 1""")
def _(request):
    return opsmetrics.bucket_percentile(opsmetrics.latency_histogram(request), 0.9).select("route", F.round("ms", 2).alias("p90"))


@query("union_of_points", "published", "staged", sql="SELECT part, count(*) AS n, count(DISTINCT point_id) AS points FROM (SELECT 'old' AS part, point_id FROM published UNION ALL SELECT 'new', point_id FROM staged) GROUP BY 1")
def _(published, staged):
    rows = union_all(published.select(F.lit("old").alias("part"), "point_id"), staged.select(F.lit("new").alias("part"), "point_id"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("points"))


