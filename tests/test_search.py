"""The search index: the same answers as scoring all keys, and bounded reads."""

import random

import pytest
from pyspark.sql import functions as F

from addrflow.operators import search
from addrflow.operators.relational import top_k

WORDS = "nowa stara wies polna lipowa gora dolna zielona nowak nowina nowicka most potok brzeg jasna".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        kind = "locality" if i % 3 == 0 else "street"
        name = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
        label = name.title() if kind == "locality" else f"ul. {name.title()}, {rng.choice(WORDS).title()}"
        rows.append((f"D{i:04d}", kind, label, f"{i % 7:07d}", None if kind == "locality" else f"s{i}", rng.randint(0, 500), rng.randint(1, 5000), "g", "c", "w", True, []))
    return spark.createDataFrame(rows, "doc_id string, type string, label string, simc string, street_id string, n_points long, locality_points long, commune string, county string, voivodeship string, has_streets boolean, aliases array<string>")


@pytest.fixture(scope="module")
def index(docs):
    return search.build_index(docs, crowded=10, listed=8)


def plain(queries, docs, k):
    """Every key against every probe."""
    keys = search.build_keys(docs).join(search.measured(docs), "doc_id")
    p = search.probes(queries)
    hits = p.crossJoin(keys).where(F.startswith("key", F.col("probe")))
    for w in ("want_type", "want_simc"):
        if w in p.columns:
            hits = hits.where(F.col(w).isNull() | (F.col(w) == F.col(w[5:])))
    level = hits.groupBy("query_id").agg(F.min("level").alias("best"))
    hits = hits.join(level, "query_id").where("level = best")
    rows = hits.groupBy("query_id", "q", "doc_id", "norm", "weight", "offset", "words").agg(F.min("key").alias("key"))
    scored = rows.withColumn("score", search.score(F.col("q"))).where("score <> 0")
    return {(r.query_id, r.rank, r.doc_id) for r in top_k(scored, ["query_id"], [F.desc("score"), F.asc("key"), F.asc("doc_id")], k).collect()}


TEXTS = ["n", "no", "nowa", "nowa wies", "s", "polna", "polma", "zielona gora", "x", "a xyzzy", "ul. nowa", "wies nowa", "nowic", "gora lipowa jasna", "n wies", "", "mostt", "na polna", "polmo nowa", "nowa polmo", "wa wies", "nowa xyzzy", "nowa nwoa", "jasn lipow", "staraa gor"]


@pytest.mark.parametrize("k", [3, 8])
def test_same_as_scoring_every_key(spark, docs, index, k):
    queries = spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, q string")
    assert {(r.query_id, r.rank, r.doc_id) for r in search.suggest(queries, index, k).collect()} == plain(queries, docs, k)


def test_filters(spark, docs, index):
    rows = [(i, t, w, s) for i, (t, w, s) in enumerate((t, w, s) for t in TEXTS for w in (None, "street", "locality") for s in (None, "0000003"))]
    queries = spark.createDataFrame(rows, "query_id int, q string, want_type string, want_simc string")
    got = {(r.query_id, r.rank, r.doc_id) for r in search.suggest(queries, index, 4, optional=True).collect()}
    assert got == plain(queries, docs, 4)


def test_reads_are_bounded(spark, index):
    """A bucket holds at most CROWDED keys' rows, a list at most its length; crowded queries need no hits at all."""
    heads = index.crowded.where("scope = ''").select(F.col("prefix").alias("entry"))
    assert index.entries.join(heads, "entry", "left_anti").groupBy("entry").count().agg(F.max("count")).first()[0] <= 10
    assert index.entries.select("key", "doc_id").distinct().count() == index.entries.count()
    assert index.lists.groupBy("prefix", "scope").count().agg(F.max("count")).first()[0] == 8
    queries = spark.createDataFrame([(1, "n"), (2, "nowa"), (3, "s")], "query_id int, q string")
    hits, ranked = search.candidates(queries, index, k=5)
    assert hits.count() == 0 and ranked.count() == 15


def test_keys_in_order_from_one_file(spark, docs, tmp_path):
    index = search.build_index(docs, str(tmp_path / "index"), crowded=10, file_rows=300)
    again = search.open_index(spark, str(tmp_path / "index"))
    rows = [(r.key, r.doc_id) for r in search.build_keys(docs).collect()]
    files = sorted((r.low, r.high) for r in spark.read.parquet(f"{index.path}/bounds").collect())
    assert len(files) > 3 and all(a[1] <= b[0] for a, b in zip(files, files[1:]))
    for prefix, most in (("polna p", 2), ("zielona nowa", 2), ("n", len(files)), ("zzz", 1)):
        found = search.keys_under(again, prefix)
        want = sorted((k, d) for k, d in rows if k.startswith(prefix))
        assert [(r.key, r.doc_id) for r in found.collect()] == want
        assert len(found.inputFiles()) <= most


def test_most_candidates(spark, index):
    """With a cap, the first keys in byte order are scored, as a short prefix may then miss the best label."""
    queries = spark.createDataFrame([(1, "n")], "query_id int, q string")
    hits, ranked = search.candidates(queries, index, k=5, max_candidates=20)
    keys = sorted(r.key for r in hits.collect())
    assert ranked.count() == 0 and 0 < len(keys) <= 20 and keys[-1] <= "nowa g"


def test_ordinal_aliases(spark):
    units = spark.createDataFrame([("1100000", "W", 1, None), ("1101000", "P", 2, "1100000"), ("1101011", "G", 3, "1101000")], "terc string, name string, level int, parent_terc string")
    places = spark.createDataFrame([("0000001", "Olszyny", "1101011", 3, True, None)], "simc string, name string, terc string, n_points long, has_streets boolean, withdrawn timestamp")
    roads = spark.createDataFrame([("s1", "0000001", "ul.", "3 Maja", 4, None)], "street_id string, simc string, kind string, name string, n_points long, withdrawn timestamp")
    ask = spark.createDataFrame([(1, "trzeciego maja")], "query_id int, q string")
    for ordinals in (False, True):
        index = search.build_index(search.build_docs(places, roads, units, ordinals))
        assert index.entries.where("key LIKE 'trzeciego%'").count() == int(ordinals)
        assert [r.doc_id for r in search.suggest(ask, index).collect()] == ["S-s1"]


def test_empty_index(spark, docs):
    index = search.build_index(docs.limit(0))
    assert search.suggest(spark.createDataFrame([(1, "nowa")], "query_id int, q string"), index).count() == 0


def test_one_label_of_many_documents_is_scored_once(spark, docs):
    """Copies of a label: the best of them are found, in lists and beside them, and other labels are not crowded out; equal queries are one."""
    copies = docs.crossJoin(spark.range(40).select(F.col("id").alias("i"))).withColumn("doc_id", F.concat_ws("-", "doc_id", "i")).withColumn("n_points", (F.col("n_points") * 7 + F.col("i") * 13) % 90)
    copies = copies.withColumn("simc", F.lpad((F.col("simc").cast("int") + 7 * F.col("i")).cast("string"), 7, "0"))
    index = search.build_index(copies, crowded=10, listed=8)
    texts = copies.select("type", "label").distinct().count()
    assert index.postings.select("doc_id").distinct().count() == texts and copies.count() > 40 * texts
    queries = spark.createDataFrame([(2 * i + j, t, "0000003" if i % 5 == 0 else None) for i, t in enumerate(TEXTS[:16]) for j in (0, 1)], "query_id int, q string, want_simc string")
    got = {(r.query_id, r.rank, r.doc_id) for r in search.suggest(queries, index, 4, optional=True).collect()}
    assert got == plain(queries, copies, 4)
    hits, _ = search.candidates(queries.drop("want_simc"), index, k=4)
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] <= texts
