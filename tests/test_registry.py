"""Every registered query against its SQL twin, and rules that SQL can't express."""

import decimal

import duckdb
import pytest

from addrflow.operators import publish, quality, validate
from addrflow.plans import registry
from addrflow.plans.carriers import carrier

DATA = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer orders lineitem events documents conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        x = float(x) if isinstance(x, decimal.Decimal) else int(x) if isinstance(x, bool) else x
        return repr(round(x, 6) if isinstance(x, float) else x)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    theirs = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(theirs.fetchall(), columns)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_mistyped_names_are_searched(spark):
    """Exact names first, of several the one with most points; others by search; the registry's words replace the given."""
    from addrflow.operators import search

    units = spark.createDataFrame([("1100000", "W", 1, None), ("1101000", "P", 2, "1100000"), ("1101011", "G", 3, "1101000")], "terc string, name string, level int, parent_terc string")
    places = spark.createDataFrame([("0000001", "Brzozów", 3), ("0000002", "Brzozów", 9), ("0000003", "Olszyny", 5), ("0000004", "Puste", 1)], "simc string, name string, n_points long")
    places = places.selectExpr("*", "lower(translate(name, 'ó', 'o')) AS name_norm", "'1101011' AS terc", "simc <> '0000004' AS has_streets", "cast(NULL AS timestamp) AS withdrawn")
    roads = spark.createDataFrame([("s1", "0000002", "00001", "ul.", "Kwiatowa", 4), ("s2", "0000002", "00002", "al.", "Kwiatowa", 6), ("s3", "0000003", "00003", "ul.", "Leśna", 2)], "street_id string, simc string, sym_ul string, kind string, name string, n_points long")
    roads = roads.selectExpr("*", "lower(translate(name, 'ś', 's')) AS name_norm", "cast(NULL AS timestamp) AS withdrawn")
    points = spark.createDataFrame([("p1", "0000002", "s2", "3/5", "3/5", "11-200"), ("p2", "0000003", "s3", "7", "7", "11-300"), ("p3", "0000004", None, "1", "1", None)], "point_id string, simc string, street_id string, number string, number_key string, postal_code string")
    points = points.selectExpr("*", "'istniejacy' AS status", "20.0 AS lon", "50.0 AS lat", "cast(NULL AS timestamp) AS withdrawn")
    docs = search.build_docs(places, roads, units)
    lines = [("a", "al. Kwiatowa 3/5, 11-200 Brzozów"), ("b", "ul. Lesno 7, 11-300 Olszyni"), ("c", "Puste 1"), ("d", "ul. Dębowa 1, Nieznane"), ("e", "Olszyny 4")]
    out = validate.validate_addresses(spark.createDataFrame(lines, "query_id string, line string"), places, roads, points, search.build_index(docs))
    got = {r.query_id: r for r in out.collect()}
    a, b, c, d, e = (got[k] for k in "abcde")
    assert (a.simc, a.street_id, a.candidates, a.matched, a.confidence) == ("0000002", "s2", 2, "3/5", "verified")
    assert (a.address.building, a.address.flat, a.address.sym_ul, a.address.point_id) == ("3/5", None, "00002", "p1")
    assert (b.simc, b.street_id, b.confidence) == ("0000003", "s3", "verified") and (b.address.locality, b.address.street) == ("Olszyny", "Leśna")
    assert (c.simc, c.number_exists, c.confidence, c.address.street) == ("0000004", True, "verified", None)
    assert (d.simc, d.confidence) == (None, "unverified") and "unknown_locality" in [i.code for i in d.issues]
    assert e.number_exists is None and [i.code for i in e.issues] == ["missing_street"] and e.confidence == "partly_verified"
    bare = validate.validate_addresses(spark.createDataFrame(lines[1:2], "query_id string, line string"), places, roads, points).first()
    assert bare.simc is None


def test_two_publications(spark):
    """A second publication of the same snapshot changes nothing."""
    current, staged = carrier(spark, DATA, "published"), carrier(spark, DATA, "staged")
    first = publish.merge_points(current, staged, "2024-02-01 00:00:00").drop("class").persist()
    again = {r["class"]: r["count"] for r in publish.merge_points(first, staged, "2024-02-02 00:00:00").groupBy("class").count().collect()}
    assert set(again) <= {"unchanged", "gone"} and again["unchanged"] == staged.count()


def test_gates_block_a_shrunken_snapshot(spark):
    current, staged = carrier(spark, DATA, "published"), carrier(spark, DATA, "staged")
    report = quality.quality_report(current, staged.where("k % 2 = 0"), {"min_rows": 10})
    assert not quality.passed(report)
    assert quality.shrink_guard(100, 60) and not quality.shrink_guard(100, 40)


def test_address_lines(spark):
    lines = [("a", "ul. Marszałkowska 12/34, 00-026 Warszawa"), ("b", "Nowa Wieś 27, 05-123 Nowa Wieś"), ("c", "Marszałkowska 1 00-624 Warszawa"), ("d", "skr. poczt. 15, Warszawa"), ("e", None), ("f", "pl. Wolności 3, Łódź, Polska")]
    got = {r.q: r.parsed for r in validate.parse_address_lines(spark.createDataFrame(lines, "q string, line string")).collect()}
    a = got["a"]
    assert (a.street_kind, a.street, a.building, a.flat, a.postal_code, a.locality, a.alternatives) == ("ul.", "Marszałkowska", "12", "34", "00-026", "Warszawa", ["12/34"])
    assert (got["b"].street, got["b"].locality, got["b"].building) == (None, "Nowa Wieś", "27")
    assert (got["c"].street, got["c"].building, got["c"].locality) == ("Marszałkowska", "1", "Warszawa")
    assert got["d"].unusual == "po_box" and got["d"].building is None and got["d"].locality == "Warszawa"
    assert got["e"] is None
    assert (got["f"].street_kind, got["f"].street, got["f"].locality) == ("pl.", "Wolności", "Łódź")
