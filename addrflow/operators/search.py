"""Bulk address search: documents, prefix keys, an index with ranked lists, candidates, scores and suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from addrflow.functions.binding import let
from addrflow.functions.streets import leading_type_offset, ordinal_variants, short_street_name, split_label, street_label
from addrflow.functions.text import normalize_text, tokenize
from addrflow.sources.scratch import kept, scratch_folder

from .addresses import active, unit_names
from .relational import top_k, union_all

#: Words that keys leave out, most words of a key, characters of the shortest probe of a cut word.
STOP_WORDS = ("ul", "al", "pl", "os", "im")
KEY_WORDS, SHORTEST = 6, 4
#: Keys under a prefix from which on it has ranked lists, and the length of these.
CROWDED, LISTED = 64, 20
#: Edits up to which a word counts as found.
EDITS = 2
#: Rows of an index file.
FILE_ROWS = 1 << 20


def build_docs(localities: DataFrame, streets: DataFrame, units: DataFrame, ordinals: bool = False) -> DataFrame:
    """Localities with points or streets, and streets, as search documents.

    Streets have their short name as an alias, and with ``ordinals`` other spellings of the ordinals in their names."""
    names = unit_names(units)
    loc = active(localities).join(names, "terc", "left")
    own = loc.where((F.col("n_points") > 0) | F.col("has_streets"))
    none = F.lit(None).cast("string")
    a = own.select(F.concat(F.lit("L-"), "simc").alias("doc_id"), F.lit("locality").alias("type"), F.col("name").alias("label"), "simc", none.alias("street_id"), F.col("n_points"), F.col("n_points").alias("locality_points"), "commune", "county", "voivodeship", "has_streets", F.array().cast("array<string>").alias("aliases"))
    road = active(streets).select("street_id", "simc", F.col("kind").alias("street_kind"), F.col("name").alias("street"), F.col("n_points").alias("street_points"))
    joined = road.join(loc, "simc")
    short = short_street_name(F.col("street"))
    alias = F.array_compact(F.array(F.when(short.isNotNull(), F.concat_ws(", ", short, "name"))))
    if ordinals:
        alias = F.concat(alias, F.transform(ordinal_variants(F.col("street")), lambda x: F.concat_ws(", ", x, "name")))
    b = joined.select(F.concat(F.lit("S-"), "street_id").alias("doc_id"), F.lit("street").alias("type"), street_label(F.col("street_kind"), F.col("street"), F.col("name")).alias("label"), "simc", "street_id", F.col("street_points").alias("n_points"), F.col("n_points").alias("locality_points"), "commune", "county", "voivodeship", F.lit(True).alias("has_streets"), alias.alias("aliases"))
    return union_all(a, b)


def rotational_keys(label: Column) -> Column:
    """The label's words without stop words, from each of the first six on."""
    t = F.filter(tokenize(label), lambda w: ~w.isin(*STOP_WORDS))
    return F.when(F.size(t) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.size(t), F.lit(KEY_WORDS))), lambda i: F.array_join(F.slice(t, i, F.size(t)), " ")))).otherwise(F.array().cast("array<string>"))


def build_keys(docs: DataFrame, *carried: str) -> DataFrame:
    """Distinct (key, doc_id) of labels and aliases, with the ``carried`` columns of the document (F2)."""
    names = docs.select("doc_id", *carried, F.explode(F.concat(F.array("label"), "aliases")).alias("name"))
    return names.select(F.explode(rotational_keys(F.col("name"))).alias("key"), "doc_id", *carried).distinct()


def sorted_keys(keys: DataFrame) -> DataFrame:
    """Keys in byte order across partitions (T4)."""
    return keys.repartitionByRange("key").sortWithinPartitions("key", "doc_id")


def probes(queries: DataFrame) -> DataFrame:
    """(query_id, q, level, probe): the whole query, its words from the longest on, then the longest word shortened."""
    q = queries.select("query_id", normalize_text(F.col("q")).alias("q"), *(c for c in queries.columns if c not in ("query_id", "q"))).where("q <> ''")
    by_length = F.array_sort(F.filter(F.split("q", " "), lambda w: w != ""), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    longest = F.get(by_length, F.lit(0))
    cut = F.when(F.length(longest) > SHORTEST, F.transform(F.sequence(F.length(longest) - 1, F.lit(SHORTEST), F.lit(-1)), lambda n: F.substring(longest, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    return q.select(*q.columns, F.posexplode(F.concat(F.array("q"), by_length, cut)).alias("level", "probe"))


def measured(docs: DataFrame) -> DataFrame:
    """Documents with what their score needs and no query changes: ``norm``, ``offset``, ``words``, ``weight``.

    Weights are rounded, so that the order of two documents with one label is that of their weights, then of their ids."""
    weight = F.round(30.0 * F.log10(F.col("n_points") + 1.0) + 25.0 * F.log10(F.col("locality_points") + 1.0), 9)
    out = docs.withColumn("norm", normalize_text(F.col("label"))).withColumn("weight", weight)
    return out.withColumn("offset", leading_type_offset(F.col("norm"))).withColumn("words", F.split("norm", " "))


def score(q: Column) -> Column:
    """Rank of a ``measured`` document for a normalised query (F4); 0 if no word of the query is in it."""
    return F.coalesce(label_score(q) + F.col("weight"), F.lit(0.0))


def label_score(q: Column) -> Column:
    """What the label alone gives to the score, null if no word of the query is in it.

    Where the query's words stand in the label as they are, at a word's start, every word is found without edits: only the
    other labels need edit distances."""
    norm, words, offset = F.col("norm"), F.col("words"), F.col("offset")
    plain = F.startswith(norm, q)
    moved = ~plain & (offset > 0) & F.startswith(F.substr(norm, offset + 1), q)
    whole = plain | moved | F.contains(norm, F.concat(F.lit(" "), q))
    bonus = F.when(plain | moved, 1000.0).when(F.contains(norm, q), 500.0).otherwise(0.0)
    rest = -1.5 * F.least(F.length(norm) - F.when(moved, offset).otherwise(0), F.lit(60))

    def distance(x: Column, t: Column) -> Column:
        return F.when(F.startswith(x, t), 0).when(F.abs(F.length(x) - F.length(t)) <= 2, F.nullif(F.levenshtein(t, x, 2), F.lit(-1)))

    def value(edits: Column) -> Column:
        found = F.size(F.filter(edits, lambda e: e.isNotNull()))
        total = F.aggregate(edits, F.lit(0), lambda a, e: a + F.coalesce(e, F.lit(0)))
        return F.when(found > 0, bonus + 600.0 * found / F.size(edits) - 40.0 * total + rest)

    edits = F.transform(F.split(q, " "), lambda t: F.array_min(F.transform(words, lambda x: distance(x, t))))
    return F.when(whole, bonus + 600.0 + rest).otherwise(let(edits, value))


@dataclass(frozen=True)
class SearchIndex:
    """What lookups read.

    ``docs``: measured documents; documents with the same type, label and aliases are one text: ``text`` is the id of its
    first by weight, then id, ``place`` each one's place in that order.  ``crowded``: (prefix, scope) of prefixes that more than CROWDED keys have, for each type
    and for all together (''); ``scope`` there has documents.  ``entries``: each key once, in the bucket of all keys that go
    on like it after its crowded prefixes.  ``spans``: the buckets under each crowded prefix.  ``lists``: for each crowded
    prefix and scope the LISTED best documents of the query that is that prefix; ``heavy``: the LISTED weightiest documents
    there, whatever the query.  ``postings``: (word, doc_id) of all texts.  ``forms``: (form, word), a word's beginnings,
    ends and forms with up to EDITS letters left out, by which words near a misspelt one are found."""

    docs: DataFrame
    crowded: DataFrame
    entries: DataFrame
    spans: DataFrame
    lists: DataFrame
    heavy: DataFrame
    postings: DataFrame
    forms: DataFrame
    path: str


_PARTS = ("docs", "crowded", "entries", "spans", "lists", "heavy", "postings", "forms")


def _shortened(words: Column) -> Column:
    """The words, and each with one letter left out."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, cut))))


def _forms(word: Column) -> Column:
    """Two words with an edit distance of EDITS at most have one of these in common."""
    out = F.array(word)
    for _ in range(EDITS):
        out = _shortened(out)
    return out


def _prefixes(text: Column, most: Column | None = None) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) if most is None else most), lambda n: F.substring(text, F.lit(1), n))


def build_index(docs: DataFrame, path: str | None = None, crowded: int = CROWDED, listed: int = LISTED, file_rows: int = FILE_ROWS) -> SearchIndex:
    """Write a search index and open it.

    A query that is a crowded prefix is scored here, once for all who ask it: the score depends on nothing but the query and
    the document.  Keys are a trie cut where at most ``crowded`` of them are left.  Ranked lists are cut within the tasks
    before they are shuffled, so that a prefix of a third of all keys is no hot key.  A label that many documents bear is
    scored once for each prefix: its best ``listed`` documents stand for all of them."""
    spark = docs.sparkSession
    path = path or scratch_folder(spark, "index")

    def part(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    same = Window.partitionBy("type", "label", "aliases").orderBy(F.desc("weight"), "doc_id")
    own = part("docs", measured(docs).withColumn("text", F.first("doc_id").over(same)).withColumn("place", F.row_number().over(same)))
    first = kept("texts", own.where("place = 1"))
    named = build_keys(first).where("key <> ''").withColumnRenamed("doc_id", "text")
    keys = kept("keys", own.select("text", "doc_id", "type", "simc", "place").join(named, "text").select("key", "doc_id", "type", "simc", "place"))
    # Different keys are counted once for each type before their prefixes are made.
    texts = keys.groupBy("key", "type").agg(F.count("*").alias("n"))
    scopes = texts.select(F.explode(_prefixes(F.col("key"))).alias("prefix"), "type", "n").groupBy("prefix", "type").agg(F.sum("n").alias("n"))
    scopes = scopes.withColumn("total", F.sum("n").over(Window.partitionBy("prefix"))).where(F.col("total") > crowded)
    both = part("crowded", scopes.select("prefix", F.explode(F.array(F.lit(""), F.col("type"))).alias("scope")).distinct())
    # Crowded prefixes of a key are its shortest ones; with one character more, if it has one, they name its bucket.
    heads = both.where("scope = ''").select("prefix")
    lengths = texts.select("key").distinct().select("key", F.explode(_prefixes(F.col("key"))).alias("prefix")).join(heads, "prefix").groupBy("key").agg(F.max(F.length("prefix")).alias("n"))
    cut = keys.join(lengths, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = cut.select(F.substring(F.col("key"), F.lit(1), F.least(F.col("n") + 1, F.length("key"))).alias("entry"), "n", "key", "doc_id", "type", "simc", "place", F.substring("key", 1, 1).alias("head"))
    # Ranges of entry and key, so that the keys of one large entry go to several files.
    files = 1 + keys.count() // file_rows
    entries = part("entries", rows.repartitionByRange(files, "entry", "key", "doc_id").sortWithinPartitions("entry", "key", "doc_id"))
    entries.groupBy(F.input_file_name().alias("file")).agg(F.min("entry").alias("low"), F.max("entry").alias("high")).write.parquet(f"{path}/bounds")
    spans = part("spans", entries.where("n > 0").select("entry", "n").distinct().select(F.explode(_prefixes(F.col("entry"), F.col("n"))).alias("prefix"), "entry"))
    hits = spans.join(entries.where("place = 1"), "entry").groupBy("prefix", "doc_id").agg(F.min("key").alias("key"))
    labels = hits.join(first, "doc_id").select("prefix", "key", F.col("doc_id").alias("text"), label_score(F.col("prefix")).alias("_label"), (-1.5 * F.least(F.length("norm"), F.lit(60))).alias("_rest"))
    members = own.where(F.col("place") <= listed).select("text", "type", "doc_id", "weight")
    scored = kept("labels", labels).join(members, "text").select("prefix", "type", "doc_id", "key", F.coalesce(F.col("_label") + F.col("weight"), F.lit(0.0)).alias("score"), (F.col("weight") + F.col("_rest")).alias("rest"))
    scored = kept("scored", scored)

    def best(order: str, rows: DataFrame) -> DataFrame:
        """The first of each prefix in every scope, of all of which a row in one scope is one."""
        by_type = top_k(rows, ["prefix", "type"], [F.desc(order), F.asc("key"), F.asc("doc_id")], listed)
        every = top_k(by_type.drop("rank"), ["prefix"], [F.desc(order), F.asc("key"), F.asc("doc_id")], listed).withColumn("scope", F.lit(""))
        return by_type.withColumn("scope", F.col("type")).unionByName(every).select("prefix", "scope", "doc_id", "key", "score", "rank")

    part("lists", best("score", scored.where("score <> 0")).repartitionByRange("prefix").sortWithinPartitions("prefix", "scope", "rank"))
    part("heavy", best("rest", scored).drop("score"))
    postings = part("postings", first.select(F.explode(F.array_distinct("words")).alias("word"), "doc_id"))
    distinct = postings.select("word").where("word <> ''").distinct()
    ends = F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring(F.col("word"), n, F.length("word")))
    part("forms", distinct.select(F.explode(F.array_distinct(F.concat(_prefixes(F.col("word")), ends, _forms(F.col("word"))))).alias("form"), "word"))
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """An index written before; it is read as often as it is opened, not made again."""
    return SearchIndex(*(spark.read.parquet(f"{path}/{n}") for n in _PARTS), path)


def keys_under(index: SearchIndex, prefix: str) -> DataFrame:
    """(key, doc_id) of one prefix in byte order, from the files whose bounds hold its entries (T4).

    Only the table of bounds, a row for each file, is looked into before."""
    spark = index.entries.sparkSession
    heads = [prefix[:n] for n in range(1, len(prefix) + 1)]
    many = index.crowded.where(F.col("prefix").isin(heads) & (F.col("scope") == "")).agg(F.max(F.length("prefix"))).first()[0] or 0
    # A crowded prefix has all entries that begin with it, any other one entry.
    entry = prefix[: many + 1]
    above = entry + "\U0010ffff" if many == len(prefix) else entry
    files = spark.read.parquet(f"{index.path}/bounds").where((F.col("low") <= above) & (F.col("high") >= entry)).collect()
    rows = spark.read.schema(index.entries.schema).parquet(*[r["file"] for r in files]) if files else index.entries.limit(0)
    return rows.where((F.col("entry") >= entry) & (F.col("entry") <= above) & F.startswith("key", F.lit(prefix))).select("key", "doc_id").sort("key", "doc_id")


def _placed(p: DataFrame, index: SearchIndex) -> DataFrame:
    """Probes with ``entry``, where their keys are, and ``many``, whether they are a crowded prefix with several such."""
    heads = index.crowded.where("scope = ''").select("prefix")
    found = p.select("probe").distinct().select("probe", F.explode(_prefixes(F.col("probe"))).alias("prefix")).join(heads, "prefix").groupBy("probe").agg(F.max(F.length("prefix")).alias("_n"))
    out = p.join(found, "probe", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return out.withColumn("many", F.col("_n") == F.length("probe")).withColumn("entry", F.substring(F.col("probe"), F.lit(1), F.col("_n") + 1)).withColumn("head", F.substring("probe", 1, 1)).drop("_n")


def candidates(queries: DataFrame, index: SearchIndex, optional: bool = False, k: int = 0, max_candidates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, ranked) of the first level of probes that finds something after the filters.

    ``queries`` may carry ``want_type`` and ``want_simc``; with ``optional``, a null there asks for everything, without it
    finds nothing.  Hits are (query_id, q, doc_id, key), all of that level that can be among the best ``k`` (all, without
    ``k``; with it, outside a locality, of a text's documents only the first, which stands for all), or with ``max_candidates`` the first keys in byte order.  Queries that are a crowded prefix themselves need none: their best ``k`` come ranked from the index, as
    (query_id, q, doc_id, key, score, rank).  Within a locality its own keys are looked through."""
    wanted = [c for c in ("want_type", "want_simc") if c in queries.columns]
    p = kept("probes", _placed(probes(queries), index))
    from_lists = 0 < k <= LISTED and max_candidates is None
    ranked, hits = [], []
    entries = index.entries.select(*(F.col(c).alias(f"_{c}") for c in ("entry", "key", "doc_id", "type", "simc", "head", "place")))
    # Outside a locality, a text's first document says whether its text is found.
    firsts = entries.where("_place = 1")
    # Queries with the same filters share a join whose keys are all equalities.
    for bits in range(1 << len(wanted)) if optional else [(1 << len(wanted)) - 1]:
        given = [w for j, w in enumerate(wanted) if bits >> j & 1]
        within = "want_simc" in given
        own = p
        for w in wanted if optional else []:
            own = own.where(F.col(w).isNotNull() if w in given else F.col(w).isNull())
        own = own.withColumn("scope", F.coalesce("want_type", F.lit("")) if "want_type" in given else F.lit(""))

        def entries_of(rows: DataFrame, how: str, on: str, entries: DataFrame = entries, given: list[str] = given) -> DataFrame:
            cond = (F.col(on) == F.col(f"_{on}")) & F.startswith(F.col("_key"), F.col("probe"))
            for w in given:
                cond = cond & (F.col(w) == F.col(f"_{w[5:]}"))
            return rows.join(entries, cond, how)

        if within:
            found = entries_of(own, "left_semi", "head")
        else:
            known = index.crowded.select(F.col("prefix").alias("probe"), "scope")
            found = own.where("many").join(known, ["probe", "scope"], "left_semi").select(own.columns).unionByName(entries_of(own.where("NOT many"), "left_semi", "entry", firsts))
        best = found.groupBy("query_id", "q", "scope", *given).agg(F.min_by(F.struct("level", "probe", "entry", "head", "many"), "level").alias("b")).select("query_id", "q", "scope", *given, "b.*")
        if within:
            rows = entries_of(best, "inner", "head")
        else:
            listed = F.col("many") & (F.col("level") == 0) & F.lit(from_lists)
            if from_lists:
                lists = index.lists.where(F.col("rank") <= k).withColumnRenamed("prefix", "probe")
                ranked.append(best.where(listed).join(lists, ["probe", "scope"]).select("query_id", "q", "doc_id", "key", "score", "rank"))
            rest = best.where(F.col("many") & ~listed)
            if from_lists:
                hits.append(_found_beside(rest, index, k).groupBy("query_id", "q", "doc_id").agg(F.min("key").alias("key")))
                rows = entries_of(best.where("NOT many"), "inner", "entry", firsts)
            else:
                spread = rest.drop("entry").join(index.spans.withColumnRenamed("prefix", "probe"), "probe")
                rows = entries_of(best.where("NOT many").unionByName(spread), "inner", "entry")
        rows = rows.select("query_id", "q", F.col("_doc_id").alias("doc_id"), F.col("_key").alias("key"))
        if max_candidates is not None:
            rows = top_k(rows, ["query_id"], [F.asc("key"), F.asc("doc_id")], max_candidates)
        hits.append(rows.groupBy("query_id", "q", "doc_id").agg(F.min("key").alias("key")))
    if not ranked:
        none = index.lists.sparkSession.createDataFrame([], "doc_id string, key string, score double, rank int")
        ranked = [hits[0].select("query_id", "q").join(none, F.lit(False))]
    return union_all(*hits), union_all(*ranked)


def _found_beside(best: DataFrame, index: SearchIndex, k: int) -> DataFrame:
    """(query_id, q, doc_id, key): of the documents under each query's crowded probe those that can be among its best ``k``.

    Under a probe that is one of the query's words, documents in which no other word is found differ by weight alone: the
    weightiest do.  All others hold a word that begins or ends with another word of the query, or is near it: these are
    found by that word.  So a misspelt street in a large town meets the streets that are spelt alike, not all of the town."""
    tokens = best.select("query_id", "q", "probe", "scope", F.explode(F.array_distinct(F.split("q", " "))).alias("token")).where("token <> '' AND token <> probe")
    asked = tokens.select("token").distinct().select("token", F.explode(_forms(F.col("token"))).alias("form"))
    near = F.startswith(F.col("word"), F.col("token")) | F.endswith(F.col("word"), F.col("token")) | (F.levenshtein("word", "token", EDITS) >= 0)
    words = kept("near", asked.join(index.forms, "form").select("token", "word").distinct().where(near))
    # Documents under the probes in question, once for all queries.
    under = best.select("probe").distinct().join(index.spans.withColumnRenamed("prefix", "probe"), "probe").join(index.entries.where("place = 1"), "entry")
    under = under.where(F.startswith("key", "probe")).groupBy("probe", "doc_id").agg(F.min("key").alias("key"), F.first("type").alias("type"))
    held = tokens.join(words, "token").join(index.postings, "word").select("query_id", "q", "probe", "scope", "doc_id").distinct()
    beside = held.join(under, ["probe", "doc_id"]).where("scope = '' OR scope = type").select("query_id", "q", "doc_id", "key")
    heavy = best.join(index.heavy.where(F.col("rank") <= k).withColumnRenamed("prefix", "probe"), ["probe", "scope"])
    heavy = heavy.join(index.docs.select("doc_id", "text"), "doc_id").select("query_id", "q", F.col("text").alias("doc_id"), "key")
    return beside.unionByName(heavy)


def suggest(queries: DataFrame, index: SearchIndex, k: int = 10, optional: bool = False, max_candidates: int | None = None) -> DataFrame:
    """The best ``k`` documents of each query, with display fields.

    Queries with the same text and filters are one: it is answered once."""
    wanted = [c for c in ("want_type", "want_simc") if c in queries.columns]
    named = queries.select("query_id", normalize_text(F.col("q")).alias("q"), *wanted)
    named = named.select("query_id", F.to_json(F.struct("q", *wanted)).alias("asked"), "q", *wanted)
    different = kept("asked", named.select(F.col("asked").alias("query_id"), "q", *wanted).distinct())
    hits, ranked = candidates(different, index, optional, k, max_candidates)
    docs = index.docs
    spread = []
    if 0 < k <= LISTED and max_candidates is None:
        # A text's best documents are its first ones; within a locality hits are documents.
        within = F.get_json_object("query_id", "$.want_simc").isNotNull()
        texts = hits.where(~within).withColumnRenamed("doc_id", "text").join(docs.where("place = 1").drop("doc_id", "place"), "text").select("query_id", "key", "text", label_score(F.col("q")).alias("_label"))
        spread = [texts.join(docs.where(F.col("place") <= k), "text").select("query_id", "key", "doc_id", F.coalesce(F.col("_label") + F.col("weight"), F.lit(0.0)).alias("score"))]
        hits = hits.where(within)
    scored = union_all(hits.join(docs, "doc_id").select("query_id", "key", "doc_id", score(F.col("q")).alias("score")), *spread).where("score <> 0")
    best = top_k(scored, ["query_id"], [F.desc("score"), F.asc("key"), F.asc("doc_id")], k)
    rows = best.select("query_id", "doc_id", "score", "rank").unionByName(ranked.select("query_id", "doc_id", "score", "rank")).join(docs, "doc_id")
    rows = rows.withColumnRenamed("query_id", "asked").join(named.select("query_id", "asked"), "asked")
    parts = split_label(F.col("label"))
    return rows.select("query_id", "rank", "doc_id", "type", "label", "simc", "street_id", F.when(F.col("type") == "street", parts["street"]).alias("street"), "commune", "county", "voivodeship", "has_streets", "n_points", "score")


def streets_matching(queries: DataFrame, index: SearchIndex, k: int = 20) -> DataFrame:
    """The best ``k`` streets for a text within a locality: queries have query_id, q, simc."""
    asked = queries.select("query_id", "q", F.col("simc").alias("want_simc"), F.lit("street").alias("want_type"))
    return suggest(asked, index, k)


def streets_of(simcs: DataFrame, docs: DataFrame) -> DataFrame:
    """All streets of the given localities, by points, then label (F6 without a text)."""
    rows = docs.where("type = 'street'").join(simcs.select("simc").distinct(), "simc", "left_semi")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("simc").orderBy(F.desc("n_points"), "label", "doc_id"))).select("simc", "rank", "street_id", "label", "n_points")


def index_stats(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: documents, keys, localities, streets."""
    a = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("type") == "locality").alias("localities"), F.count_if(F.col("type") == "street").alias("streets"))
    b = keys.agg(F.count("*").alias("keys"))
    return a.withColumn("_k", F.lit("x")).join(b.withColumn("_k", F.lit("x")), "_k").select("docs", "keys", "localities", "streets")


def evaluate_golden(expected: DataFrame, results: DataFrame) -> DataFrame:
    """For each expected (query_id, label, within): whether it is among the first ``within`` results, and its rank (F8)."""
    found = expected.join(results.select("query_id", "label", "rank"), ["query_id", "label"], "left")
    return found.groupBy("query_id", "label", "within").agg(F.min("rank").alias("rank")).withColumn("ok", F.coalesce(F.col("rank") <= F.col("within"), F.lit(False)))
