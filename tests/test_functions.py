"""Scalar functions against the values that their rules give."""

from pyspark.sql import functions as F

from addrflow.functions import codes, geo, numbers, postal, streets, text


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[1] for r in df.select("i", f(F.col("s"))).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, ["Łódź-Śródmieście 3", " a  b ", None], text.normalize_text) == ["lodz srodmiescie 3", "a b", None]
    assert values(spark, ["A  b"], text.clean_text) == ["A b"]
    assert values(spark, ["WARSZAWA", "JANA PAWŁA II", "Nowy Targ"], text.title_case) == ["Warszawa", "Jana Pawła II", "Nowy Targ"]
    assert values(spark, ["ul. Polna"], text.tokenize) == [["ul", "polna"]]


def test_parse_number(spark):
    rows = ["12", "12A", "12-14", "12 m. 5", "12A/5", "12/14", "12/14/5", "b.n.", "0", "12 a", ""]
    got = values(spark, rows, numbers.parse_number)
    assert [(g.building, g.flat, g.ambiguous, g.alternatives) if g else None for g in got] == [
        ("12", None, False, []), ("12A", None, False, []), ("12-14", None, False, []), ("12", "5", False, []), ("12A", "5", False, []),
        ("12", "14", True, ["12/14"]), ("12/14", "5", False, []), None, None, ("12A", None, False, []), None,
    ]


def test_number_keys(spark):
    assert values(spark, ["2", "10", "10A", "12/3"], numbers.building_sort_key) == ["000002", "000010", "000010a", "000012/000003"]
    assert values(spark, ["12 / 14", "12 a"], numbers.canonical_building) == ["12/14", "12A"]
    assert values(spark, ["12 A"], numbers.building_key) == ["12a"]
    assert values(spark, ["12", "12, 14", "12 do 18", "B.N.", "---", "000"], numbers.is_garbage_number) == [False, True, True, True, True, True]


def test_postal(spark):
    assert values(spark, ["00950", "00 950", "0-0950", "123"], postal.normalize_postal) == ["00-950", "00-950", "00-950", None]
    got = values(spark, ["x 00-026 y", "Polna 00950", "Polna 99999", "12345/6"], postal.extract_postal)
    assert [tuple(g) if g else None for g in got] == [("00-026", 2, 6), ("00-950", 6, 5), None, None]


def test_streets(spark):
    assert [tuple(x) for x in values(spark, ["ulica Marszałkowska", "Polna", "al. Róż"], streets.split_street_type)] == [("ul.", "Marszałkowska"), (None, "Polna"), ("al.", "Róż")]
    assert values(spark, ["Tadeusza Kościuszki", "gen. Władysława Andersa", "Jana Pawła II", "Marszałkowska", "gen. Maczka"], streets.short_street_name) == ["Kościuszki", "Andersa", None, None, "Maczka"]
    assert values(spark, ["ul polna", "polna"], streets.leading_type_offset) == [3, 0]
    assert [tuple(x) for x in values(spark, ["ul. Polna, Łódź"], streets.split_label)] == [("ul.", "Polna", "Łódź")]
    assert "3 go Maja" in values(spark, ["3 Maja"], streets.ordinal_variants)[0]


def test_codes(spark):
    assert values(spark, ["14;65;01;1"], lambda s: codes.build_terc(*(F.split_part(s, F.lit(";"), F.lit(k)) for k in (1, 2, 3, 4)))["terc"]) == ["1465011"]
    import base64
    import zlib

    secret = "a" * 32
    check = base64.urlsafe_b64encode(zlib.crc32(secret.encode()).to_bytes(4, "big")).decode()[:6]
    got = values(spark, [f"adr_live_{secret}_{check}", f"adr_live_{secret}_AAAAAA"], codes.api_key_parts)
    assert got[0].environment == "live" and got[1] is None


def test_projection(spark):
    row = spark.range(1).select(geo.to_wgs84(F.lit(637123.45), F.lit(486987.65), F.lit(2180), F.lit(False)).alias("a"), geo.to_wgs84(F.lit(486987.65), F.lit(637123.45), F.lit(2180), F.lit(True)).alias("b")).first()
    assert abs(row.a.lon - 21.0085065) < 1e-6 and abs(row.a.lat - 52.2318357) < 1e-6 and not row.a.swapped
    assert row.a == row.b


def test_projections_against_integrals(spark):
    """Northings on the central meridian and eastings near it, from integrals over the ellipsoid GRS80 that share nothing with
    the series: the meridian's arc, and the isometric latitude's step off the meridian."""
    import cmath
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)

    def arc(phi):
        """Meridian arc to a latitude, of complex values too, by Simpson's rule."""
        n = 2000
        h = phi / n
        value = lambda t: a * (1 - e2) / (1 - e2 * cmath.sin(t) ** 2) ** 1.5
        return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * value(k * h) for k in range(n + 1))

    def plane(lon, lat, middle, scale, east, north):
        """Gauss's conformal map: the latitude whose isometric latitude is q + i * (difference of longitude)."""
        e = math.sqrt(e2)
        isometric = lambda p: cmath.atanh(cmath.sin(p)) - e * cmath.atanh(e * cmath.sin(p))
        want, p = isometric(math.radians(lat)) + 1j * math.radians(lon - middle), complex(math.radians(lat))
        for _ in range(30):
            slope = (1 - e2) / ((1 - e2 * cmath.sin(p) ** 2) * cmath.cos(p))
            p += (want - isometric(p)) / slope
        m = arc(p) * scale
        return m.imag + east, m.real + north

    rows = []
    for epsg, (middle, scale, east, north) in {2180: (19, 0.9993, 5e5, -5.3e6), 2176: (15, 0.999923, 5.5e6, 0), 2177: (18, 0.999923, 6.5e6, 0), 2178: (21, 0.999923, 7.5e6, 0), 2179: (24, 0.999923, 8.5e6, 0)}.items():
        for dlon, lat in ((0, 52.0), (1.2, 50.5), (-1.4, 54.2)) + (((4.8, 53.1), (-4.6, 49.3)) if epsg == 2180 else ()):
            rows.append((epsg, middle + dlon, lat, *plane(middle + dlon, lat, middle, scale, east, north)))
    df = spark.createDataFrame([(e, float(lo), la, float(x), float(y)) for e, lo, la, x, y in rows], "epsg int, lon double, lat double, x double, y double")
    got = df.select("lon", "lat", geo.unproject(F.col("x"), F.col("y"), F.col("epsg")).alias("g")).collect()
    assert len(got) == 17 and all(abs(r.g.lon - r.lon) < 1e-8 and abs(r.g.lat - r.lat) < 1e-8 for r in got)
