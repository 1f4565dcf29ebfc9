"""Readers, store and streams on small files that the tests write."""

import os

import pytest
from pyspark.sql import functions as F

from addrflow.operators import usage
from addrflow.plans.carriers import carrier
from addrflow.sources import datagen, gml, registers, store
from addrflow.streaming import usage_stream

DATA = "/root/testdata/sf0.001"

NEW = """<?xml version="1.0"?>
<gml:FeatureCollection xmlns:gml="g" xmlns:e="e" xmlns:xlink="x">
<gml:featureMember><e:AD_Miejscowosc gml:id="M-77"><e:idIIP><e:AD_IdentyfikatorIIP><e:lokalnyId>l1</e:lokalnyId><e:wersjaId>v1</e:wersjaId></e:AD_IdentyfikatorIIP></e:idIIP><e:nazwa>KALINOWIEC GÓRNY</e:nazwa><e:rodzaj>osada</e:rodzaj><e:identyfikatorSIMC>40404</e:identyfikatorSIMC><e:TERYTGminy>0203042</e:TERYTGminy><e:georeferencja><gml:Point srsName="urn:ogc:def:crs:EPSG::2180"><gml:pos>412000 523000</gml:pos></gml:Point></e:georeferencja></e:AD_Miejscowosc></gml:featureMember>
<gml:featureMember><e:AD_UlicaPlac gml:id="U-55"><e:nazwaPelna>Huberta Wrzosa</e:nazwaPelna><e:rodzaj>ulica</e:rodzaj><e:identyfikatorULIC>606</e:identyfikatorULIC><e:ulica1 xlink:href="#M-77"/></e:AD_UlicaPlac></gml:featureMember>
<gml:featureMember><e:AD_PunktAdresowy gml:id="P1"><e:idIIP><e:AD_IdentyfikatorIIP><e:lokalnyId>X-1</e:lokalnyId></e:AD_IdentyfikatorIIP></e:idIIP><e:numerPorzadkowy>8 c</e:numerPorzadkowy><e:kodPocztowy>31-313</e:kodPocztowy><e:miejsce xlink:href="#M-77"/><e:ulica2 xlink:href="#U-55"/><e:georeferencja><gml:Point srsName="urn:ogc:def:crs:EPSG::2180"><gml:pos>412345.75 523456.5</gml:pos></gml:Point></e:georeferencja></e:AD_PunktAdresowy></gml:featureMember>
</gml:FeatureCollection>
"""
OLD = """<?xml version="1.0"?>
<gml:FeatureCollection xmlns:gml="g" xmlns:p="p">
<gml:featureMember><p:PRG_PunktAdresowy gml:id="Q1"><p:lokalnyId>Y-1</p:lokalnyId><p:jednostkaAdministracyjna>02</p:jednostkaAdministracyjna><p:jednostkaAdministracyjna>0203</p:jednostkaAdministracyjna><p:jednostkaAdministracyjna>0203042</p:jednostkaAdministracyjna><p:miejscowosc>40404</p:miejscowosc><p:ulica>606</p:ulica><p:numerPorzadkowy>8C</p:numerPorzadkowy><p:kodPocztowy>31313</p:kodPocztowy><p:pozycja><gml:Point srsName="EPSG:2180"><gml:pos>523456.5 412345.75</gml:pos></gml:Point></p:pozycja></p:PRG_PunktAdresowy></gml:featureMember>
<gml:featureMember><p:PRG_PunktAdresowy gml:id="Q2"><p:lokalnyId>Y-2</p:lokalnyId><p:miejscowosc>40404</p:miejscowosc><p:numerPorzadkowy>B.N.</p:numerPorzadkowy></p:PRG_PunktAdresowy></gml:featureMember>
</gml:FeatureCollection>
"""


def test_gml(spark, tmp_path):
    new, old = tmp_path / "new.gml", tmp_path / "old.gml"
    new.write_text(NEW)
    old.write_text(OLD)
    p = gml.map_points(gml.read_gml(spark, str(new), "point")).first()
    assert (p.point_id, p.number, p.postal_code, p.locality_ref, p.street_ref, p.skipped) == ("X-1", "8C", "31-313", "M-77", "U-55", None)
    q = gml.map_points(gml.read_gml(spark, str(old), "point"))
    kept, skipped = gml.split_skipped(q)
    o = kept.first()
    assert (o.point_id, o.terc_ref, o.region, o.postal_code) == ("Y-1", "0203042", "02", None) and skipped.count() == 1
    assert abs(p.lon - 19.3386016) < 1e-6 and (p.lon, p.lat) == (o.lon, o.lat) and len(p.hash) == 64 and p.hash != o.hash
    loc = gml.map_localities(gml.read_gml(spark, str(new), "locality")).first()
    assert (loc.simc, loc.name, loc.name_norm, loc.kind, loc.terc) == ("0040404", "Kalinowiec Górny", "kalinowiec gorny", 4, "0203042")
    road = gml.map_streets(gml.read_gml(spark, str(new), "street")).first()
    assert (road.sym_ul, road.kind, road.name, road.locality_ref) == ("00606", "ul.", "Huberta Wrzosa", "M-77")
    assert {r.measure: r.n for r in gml.ingest_stats(q).collect()}["skipped: no address number"] == 1
    assert {r.element: r.structure for r in gml.detect_profile(spark, str(old)).collect()} == {"PRG_PunktAdresowy": "2012"}
    with pytest.raises(ValueError):
        gml.read_gml(spark, str(old), "street")
    # The kind is found wherever its first feature stands, in a file of one line too.
    many = tmp_path / "many.gml"
    many.write_text(NEW.replace("<gml:featureMember>", "<gml:featureMember>" + "<e:filler>x</e:filler>" * 4000, 1).replace("\n", ""))
    assert gml.read_gml(spark, str(many), "point").count() == 1
    found = {r.element: (r.n, r.candidate) for r in gml.discover_gml(spark, str(new)).collect()}
    assert found["nazwaPelna"] == (1, False) and found["AD_UlicaPlac"] == (1, True)


def test_catalogues(spark, tmp_path):
    csv, xml = tmp_path / "TERC.csv", tmp_path / "WMRODZ.xml"
    csv.write_text("﻿WOJ;POW;GMI;RODZ;NAZWA;NAZWA_DOD;STAN_NA\n14;;;;MAZOWIECKIE;w;2024-01-01\n14;65;;;Warszawa;p;2024-01-01\n14;65;01;1;Warszawa;g;2024-01-01\n")
    xml.write_text("<t><catalog><row><col name='RM'>96</col><col name='NAZWA_RM'>miasto</col></row>\n<row><col name='RM'>01</col><col name='NAZWA_RM'>wieś</col></row></catalog></t>")
    got = [(r.terc, r.parent_terc, r.level) for r in registers.read_catalogue(spark, str(csv), "terc").orderBy("level").collect()]
    assert got == [("1400000", None, 1), ("1465000", "1400000", 2), ("1465011", "1465000", 3)]
    assert sorted((r.code, r.name) for r in registers.read_catalogue(spark, str(xml), "wmrodz").collect()) == [(1, "wieś"), (96, "miasto")]
    units = spark.createDataFrame([("1405033", 3), ("1405034", 3)], "terc string, level int")
    loc = spark.createDataFrame([("a", "1405034"), ("b", "1405032"), ("c", "9999999")], "simc string, terc string")
    assert {r.simc: r.unit_terc for r in registers.attach_units(loc, units).collect()} == {"a": "1405034", "b": "1405033", "c": None}


def test_tabular(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("ID_PUNKTU;SIMC;MIEJSCOWOSC;NR;KOD_POCZTOWY;WSP_X;INNE\n1;918123;Warszawa;12 a;00-950;637123,45;z\n2;;;;x;;\n")
    df, report = registers.read_tabular(spark, str(f))
    assert "INNE" in report["unused"] and "street" in report["missing"]
    a, b = registers.map_comparison(df).orderBy("id").collect()
    assert (a.simc, a.number_key, a.postal_code, a.x, a.skipped) == ("0918123", "12a", "00-950", 637123.45, None) and b.skipped == "no number"
    assert {r.column: r.target for r in registers.discover_tabular(spark, str(f)).collect()}["NR"] == "number"


def test_store(spark, tmp_path):
    root = str(tmp_path / "published")
    assert store.current_version(spark, root) is None
    for v in ("8", "9", "10", "11"):
        store.publish_version({"t": spark.range(int(v))}, root, v)
    assert store.current_version(spark, root) == "11" and store.read_current(spark, root, "t").count() == 11
    with pytest.raises(ValueError, match="published already"):
        store.publish_version({"t": spark.range(1)}, root, "10")
    assert store.prune_versions(spark, root, 3) == ["8"] and store.prune_versions(spark, root, 1) == ["9", "10"]
    assert store.reload_if_moved(spark, root, "11", ["t"]) == ("11", {})
    seen, tables = store.reload_if_moved(spark, root, "10", ["t"])
    assert seen == "11" and tables["t"].count() == 11
    # A version that failed half-way may be written again.
    spark.range(5).write.parquet(f"{root}/v=12/t")
    store.publish_version({"t": spark.range(12)}, root, "12")
    assert store.read_current(spark, root, "t").count() == 12
    staging = str(tmp_path / "staging")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, region string")
    store.write_staging(df, staging)
    store.write_staging(df.where("region = 'b'").withColumn("x", F.lit(9)), staging, "append")
    assert sorted((r.x, r.region) for r in spark.read.parquet(staging).collect()) == [(1, "a"), (9, "b")]
    (tmp_path / "f1").write_text("one")
    m = store.snapshot_manifest(spark, str(tmp_path / "f1"))
    assert [r.change for r in store.changed_files(m, m).collect()] == ["same"]
    a, b = (spark.createDataFrame(x, "file string, sha256 string") for x in ([("f", "1"), ("g", "1"), ("h", "1")], [("g", "2"), ("h", "1"), ("i", "1")]))
    assert {r.file: r.change for r in store.changed_files(a, b).collect()} == {"f": "removed", "g": "changed", "h": "same", "i": "added"}
    files = spark.createDataFrame([("a", "x.gml", 9), ("a", "NOWE_x.gml", 5), ("b", "y.gml", 1)], "region string, file string, size int")
    assert sorted(r.file for r in store.pick_members(files).collect()) == ["NOWE_x.gml", "y.gml"]


def test_streams(spark, tmp_path):
    events = carrier(spark, DATA, "request")
    folder = str(tmp_path / "events")
    events.repartition(4).write.parquet(folder)
    stream = usage_stream.event_stream(spark, folder, events.schema, 1)
    usage_stream.meter(stream, str(tmp_path / "usage"), str(tmp_path / "cp")).awaitTermination()
    a = sorted(map(tuple, usage_stream.metered(spark, str(tmp_path / "usage")).collect()))
    assert a == sorted(map(tuple, usage.usage_agg(events).select("key_id", "period", "requests", "units").collect()))
    q = usage_stream.outcome_counts(usage_stream.event_stream(spark, folder, events.schema)).writeStream.outputMode("complete").format("memory").queryName("outcomes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("outcomes").collect())) == sorted(map(tuple, usage.auth_outcomes(events).collect()))
    once = usage_stream.throttled(usage_stream.event_stream(spark, folder, events.schema)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == usage.throttle(events).count()


def test_quota_stream(spark, tmp_path):
    """The stateful stream decides as the batch form does, though files come out of order; ended months leave no state."""
    events, clients = carrier(spark, DATA, "request"), carrier(spark, DATA, "client")
    folder = str(tmp_path / "events")
    # Every third event comes a file later than its time, and one event a year later moves the watermark past all others.
    rows = [r for r in events.orderBy("ts", "event_id").collect()]
    late = [r for k, r in enumerate(rows) if k % 3 == 0]
    prompt = [r for k, r in enumerate(rows) if k % 3]
    last = rows[-1].asDict() | {"event_id": 10**9, "ts": rows[-1].ts.replace(year=rows[-1].ts.year + 1)}
    for k, part in enumerate((prompt, late, [last], [last | {"event_id": 10**9 + 1}])):
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            (tmp_path / "events").mkdir(exist_ok=True)
            f.rename(tmp_path / "events" / f"{k}.parquet")
            os.utime(tmp_path / "events" / f"{k}.parquet", (10**9 + k, 10**9 + k))
    stream = usage_stream.quota_stream(usage_stream.event_stream(spark, folder, events.schema, 1), clients, "400 days")
    q = stream.writeStream.format("memory").queryName("quotas").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("quotas").count() == 0  # all within the lateness that the stream allows: they wait
    stream = usage_stream.quota_stream(usage_stream.event_stream(spark, folder, events.schema, 1), clients, "60 days")
    q = stream.writeStream.format("memory").queryName("quotas60").option("checkpointLocation", str(tmp_path / "cp60")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = usage.quota_flags(events, clients).select("event_id", "used_before", "rejected")
    assert sorted(map(tuple, spark.table("quotas60").collect())) == sorted(map(tuple, want.collect()))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_unverified_callers(spark):
    rows = [(None, "a", f"2024-01-01 00:00:{k:02d}") for k in range(4)] + [(None, "b", "2024-01-01 00:00:00"), (7, "a", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "client_id long, address string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.address, r.requests, r.limited) for r in usage.address_limit_flags(df, 3).collect()} == {("a", 4, True), ("b", 1, False)}


def test_usage_is_added_once(spark):
    total = spark.createDataFrame([(1, "k", 5)], "batch_id int, key_id string, units int")
    again = usage.add_usage(total, total)
    assert again.agg(F.sum("units")).first()[0] == 5


def test_leaked_keys(spark):
    import base64
    import zlib

    secret = "Ab1_" * 8
    key = f"adr_test_{secret}_" + base64.urlsafe_b64encode(zlib.crc32(secret.encode()).to_bytes(4, "big")).decode()[:6]
    df = spark.createDataFrame([(1, f"x {key} y"), (2, key[:-1] + "!"), (3, None)], "id int, text string")
    assert [(r.id, r.environment) for r in usage.scan_leaked_keys(df, "text", "id").collect()] == [(1, "test")]


def test_generator(spark):
    a = datagen.points(spark, 500, 50)
    assert a.repartition(7).exceptAll(datagen.points(spark, 500, 50)).count() == 0
    assert datagen.streets(spark, 200, 50).groupBy("simc", "name").count().where("count > 1").count() == 0
    assert datagen.localities(spark, 100).count() == 100


def test_zipf(spark):
    """Shares of the ranks against the distribution whose inverse is drawn from."""
    import math

    n, draws = 50, 200_000
    got = dict(spark.range(draws).select(datagen.zipf(datagen.unit(F.col("id"), "z"), n).alias("r")).groupBy("r").count().collect())
    want = {r: math.log((r + 2) / (r + 1)) / math.log(n + 1) for r in range(n)}
    assert set(got) <= set(want) and all(abs(got.get(r, 0) / draws - p) < 0.005 for r, p in want.items())


def test_scale_run(spark, tmp_path):
    """The generated registry goes through load, gates, publication and search; each figure follows from the one before."""
    from scale_run import scale_run

    steps = {s["step"]: s for s in scale_run(spark, 3000, str(tmp_path), asked=60)}
    assert steps["load"]["points"] == steps["first publication"]["added"] == steps["the same again"]["unchanged"] == 3000
    assert all(steps[s]["outcome"] == "published" for s in ("first publication", "the same again", "0.4 % changed"))
    assert steps["the same again"]["parts_written"] == 0 and 0 < steps["0.4 % changed"]["changed"] < 60
    assert 0 < steps["0.4 % changed"]["parts_written"] <= 16 and steps["0.4 % changed"]["parts_kept"] > 100
    assert steps["suggestions"]["hits"] >= 60
    tables = datagen.registry(spark, 3000)
    lost = tables["point"].where("street_id IS NOT NULL").join(tables["street"], "street_id", "left_anti").count()
    assert lost == 0 and tables["locality"].join(tables["unit"], "terc", "left_anti").count() == 0


def test_parts_follow_the_change(spark, tmp_path):
    """One changed row rewrites one part; all other files stay, through pruning too; a region's rows may come alone."""
    root = str(tmp_path / "parts")
    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lpad((F.col("id") % 3).cast("string"), 2, "0").alias("region"), F.lit("a").alias("v"))
    parts = {"t": store.hashed_part("k", 1, "region")}
    files = lambda: set(store.read_current(spark, root, "t").inputFiles())
    assert store.publish_version({"t": rows}, root, "1", parts) == {"t": (0, 48)}
    first = files()
    assert store.publish_version({"t": rows.repartition(7)}, root, "2", parts) == {"t": (48, 0)} and files() == first
    changed = rows.withColumn("v", F.when(F.col("k") == "17", "b").otherwise(F.col("v")))
    assert store.publish_version({"t": changed}, root, "3", parts) == {"t": (47, 1)} and len(files() - first) == 1
    own = changed.where("region = '01' AND k <> '1'")
    assert store.publish_version({"t": own}, root, "4", parts, {"t": ["01"]}) == {"t": (47, 1)}
    got = store.read_current(spark, root, "t")
    assert got.count() == 3999 and got.where("v = 'b'").count() == 1
    assert {r[0] for r in store.read_current(spark, root, "t", ["01"]).select("region").distinct().collect()} == {"01"}
    assert store.prune_versions(spark, root, 1) == ["1", "2", "3"]
    assert store.read_current(spark, root, "t").count() == 3999 and len(first & files()) == 46
    # A row that leaves a part empties it; null parts' rows are kept; a table may become empty.
    odd = spark.createDataFrame([("1", "07", None), (None, None, None)], "k string, region string, v string")
    store.publish_version({"t": odd}, root, "5", parts)
    assert sorted(map(tuple, store.read_current(spark, root, "t").collect()), key=str) == [("1", "07", None), (None, None, None)]
    store.publish_version({"t": odd.limit(0)}, root, "6", parts)
    assert store.read_current(spark, root, "t").count() == 0 and store.read_current(spark, root, "t").columns == ["k", "region", "v"]


def test_manifest_of_large_files(spark, tmp_path):
    """Block digests by definition, whatever the block; a sparse file of 3 GB is hashed by ranges."""
    import hashlib

    data = {"a.gml": bytes(range(256)) * 50, "b.gml": b"", "c.gml": b"x" * 4096, "d.gml": b"y" * 4097}
    for n, content in data.items():
        (tmp_path / n).write_bytes(content)
    got = {r.file: (r.size, r.sha256) for r in store.snapshot_manifest(spark, f"{tmp_path}/*.gml", block=4096).collect()}
    twice = lambda x: hashlib.sha256(b"".join(hashlib.sha256(x[a : a + 4096]).digest() for a in range(0, max(1, len(x)), 4096))).hexdigest()
    assert got == {n: (len(x), twice(x)) for n, x in data.items() if x}
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)
    first = store.snapshot_manifest(spark, f"{tmp_path}/large.bin").first()
    block = hashlib.sha256(bytes(64 << 20)).digest()
    assert first.size == 3 << 30 and first.sha256 == hashlib.sha256(block * 48).hexdigest()
    with open(tmp_path / "large.bin", "r+b") as f:
        f.seek(2_500_000_000)
        f.write(b"!")
    assert store.snapshot_manifest(spark, f"{tmp_path}/large.bin").first().sha256 != first.sha256
