"""What a cycle and the queries around it do more than once, and what they don't."""

from addrflow.operators import cycle as cycles
from addrflow.plans import carriers
from addrflow.sources import store

DATA = "/root/testdata/sf0.001"


def test_derived_tables_are_made_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(carriers, "kept", lambda name, df: names.append(name) or df)
    made = {}
    keep = ("locality", "street", "point")
    tables = [carriers.carrier(spark, DATA, t, keep, made) for t in ("published", "staged", "locality", "street")]
    assert sorted(names) == sorted(keep)
    plain = [carriers.carrier(spark, DATA, t) for t in ("published", "staged", "locality", "street")]
    assert [t.columns for t in tables] == [t.columns for t in plain]


def test_a_version_that_exists_is_refused_before_the_merge(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "published")
    rows = spark.createDataFrame([("p", "00", "h", "t", None, 19.0, 52.0)], "point_id string, region string, hash string, terc string, withdrawn timestamp, lon double, lat double")
    tables = {"point": rows, "locality": rows.select("point_id"), "street": rows.select("point_id")}
    store.publish_version(tables, root, "1")

    def merge(*_):
        raise AssertionError("merged")

    monkeypatch.setattr(cycles, "publish_state", merge)
    cycle = cycles.Cycle(spark, root, {"min_rows": 1, "commune_drop": 1.0})
    assert cycle.run("1", lambda: tables, ["00"], "2024-02-01 00:00:00") == "error"
    assert cycle.runs().first().reason == "version 1 is published already"


def test_lines_are_parsed_by_all_tasks(spark):
    from addrflow.plans import registry

    df = registry.QUERIES["parse_address_lines"](spark, DATA)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_least_values_send_no_value_of_their_own(spark, monkeypatch):
    from addrflow.operators import relational

    counted = []
    keep = relational.kept
    monkeypatch.setattr(relational, "kept", lambda name, df: counted.append(df.count()) or keep(name, df))
    pairs = spark.range(5000).selectExpr("'e' AS element", "concat('common start ', lpad(id, 6, '0')) AS v").unionByName(spark.createDataFrame([("f", "z"), ("f", "ab"), ("f", "a"), ("f", "a"), ("f", "żż"), ("f", None), ("g", None)], "element string, v string"))
    got = {r.element: (r.n, r.samples) for r in relational.least_values(pairs, ["element"], "v", 3).collect()}
    assert got == {"e": (5000, [f"common start {i:06d}" for i in range(3)]), "f": (5, ["a", "ab", "z"]), "g": (0, [])}
    # Beginnings, not values, are what is counted and sent: one of "e", five of "f" (null is one), the null of "g".
    assert counted == [7]


def test_both_merges_count_points_once(spark, monkeypatch):
    from addrflow.operators import publish

    counts = []
    derive = publish.derive_counts
    monkeypatch.setattr(publish, "derive_counts", lambda *a: counts.append(1) or derive(*a))
    row = "street_id string, simc string, sym_ul string, kind string, name string, name_norm string, official boolean, withdrawn timestamp"
    streets = spark.createDataFrame([("a", "1", "7", None, "A", "a", False, None), ("b", "1", "7", "ul.", "B", "b", True, None), ("c", "1", None, "ul.", "C", "c", False, None), ("d", "1", None, "ul.", "D", "c", False, None)], row)
    points = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("x",), (None,)], "street_id string").selectExpr("street_id", "cast(NULL AS timestamp) AS withdrawn")
    merged, moved = publish.merge_all_duplicates(streets, points)
    assert sorted((r.street_id, r.kind, r["name"], r.n_points) for r in merged.collect()) == [("a", "ul.", "B", 3), ("c", "ul.", "C", 2)]
    assert sorted(str(r.street_id) for r in moved.collect()) == ["None", "a", "a", "a", "c", "c", "x"]
    assert counts == [1]


def test_queries_of_cycles_keep_their_tables(spark, monkeypatch):
    from addrflow.plans import registry

    class Stop(Exception):
        pass

    for name in ("publish_state", "changed_parts", "update_cycles"):
        names = []
        monkeypatch.setattr(carriers, "kept", lambda name, df, names=names: names.append(name) or df)
        try:
            monkeypatch.setattr("addrflow.plans.cycles.Cycle", lambda *a: (_ for _ in ()).throw(Stop()))
            registry.QUERIES[name](spark, DATA)
        except Stop:
            pass
        assert sorted(names) == ["locality", "point", "street"], name
