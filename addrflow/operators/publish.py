"""Publication as change data: merges, soft deletes, duplicate streets, the update cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrflow.functions.streets import extract_type_word
from addrflow.functions.text import normalize_text
from addrflow.sources.scratch import kept

from .addresses import active, derive_counts, derive_has_streets
from .relational import classify_changes, distinct_on, survivors, union_all


def merge_localities(current: DataFrame, staged: DataFrame) -> DataFrame:
    """Upsert of localities: the staged name wins, position and kind only fill gaps, withdrawn ones come back.

    Of several staged rows of a code, one with a position counts, then the least GML id."""
    s = distinct_on(staged, ["simc"], [F.col("lon").isNull(), F.col("gml_id")])
    a, b = current.alias("a"), s.alias("b")
    joined = a.join(b, F.col("a.simc") == F.col("b.simc"), "full_outer")
    fill = {"simc": ("b", "a"), "name": ("b", "a"), "name_norm": ("b", "a"), "kind": ("a", "b"), "terc": ("b", "a"), "lon": ("a", "b"), "lat": ("a", "b"), "gml_id": ("b", "a")}
    values = [F.coalesce(*(F.col(f"{x}.{c}") for x in order)).alias(c) for c, order in fill.items()]
    return joined.select(*values, F.when(F.col("b.simc").isNull(), F.col("a.withdrawn")).alias("withdrawn"))


def split_type_words(streets: DataFrame) -> DataFrame:
    """Kind words move from street names to the kind."""
    moved = extract_type_word(F.col("kind"), F.col("name"))
    return streets.withColumn("_m", moved).withColumn("kind", F.col("_m.kind")).withColumn("name", F.col("_m.name")).withColumn("name_norm", normalize_text(F.col("_m.name"))).drop("_m")


def merge_streets(current: DataFrame, staged: DataFrame, localities: DataFrame) -> DataFrame:
    """Upsert of coded streets on (simc, sym_ul); the official source comes first, its attributes win (P5).

    Staged streets of unknown localities are left out."""
    s = staged.where("sym_ul IS NOT NULL").join(localities.select("simc"), "simc", "left_semi")
    s = distinct_on(s, ["simc", "sym_ul"], [F.col("source") != "official", F.col("gml_id")])
    a, b = current.alias("a"), s.alias("b")
    joined = a.join(b, (F.col("a.simc") == F.col("b.simc")) & (F.col("a.sym_ul") == F.col("b.sym_ul")), "full_outer")
    both = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("simc", "sym_ul", "kind", "name", "name_norm")]
    street_id = F.coalesce("a.street_id", F.concat_ws("-", "b.simc", "b.sym_ul")).alias("street_id")
    return joined.select(street_id, *both, F.when(F.col("b.simc").isNull(), F.col("a.withdrawn")).alias("withdrawn"))


def merge_uncoded_streets(current: DataFrame, staged: DataFrame, localities: DataFrame) -> DataFrame:
    """Adds staged streets without a code, unless the locality has a street of that name with one.

    They are one for each (simc, name, kind), a missing kind being a kind of its own."""
    s = staged.where("sym_ul IS NULL").join(localities.select("simc"), "simc", "left_semi")
    coded = current.where("sym_ul IS NOT NULL").select("simc", "name_norm").distinct()
    s = distinct_on(s.join(coded, ["simc", "name_norm"], "left_anti"), ["simc", "name_norm", "kind"], [F.col("gml_id")])
    have = current.where("sym_ul IS NULL").select(F.col("simc").alias("_s"), F.col("name_norm").alias("_n"), F.col("kind").alias("_k"))
    new = s.join(have, (F.col("simc") == F.col("_s")) & (F.col("name_norm") == F.col("_n")) & F.col("kind").eqNullSafe(F.col("_k")), "left_anti")
    new = new.select(F.concat_ws("-", "simc", F.lit("x"), "name_norm", "kind").alias("street_id"), "simc", "sym_ul", "kind", "name", "name_norm", F.lit(None).cast(current.schema["withdrawn"].dataType).alias("withdrawn"))
    return current.unionByName(new)


def latest_rows(staged: DataFrame) -> DataFrame:
    """One row of each point id of a snapshot: the latest version, then the least hash.

    The join that follows needs the same partitioning, so this shuffles nothing more."""
    order = [F.desc_nulls_last("version_id")] if "version_id" in staged.columns else []
    return distinct_on(staged, ["point_id"], [*order, F.asc("hash")])


def duplicate_ids(staged: DataFrame) -> DataFrame:
    """One row: point ids that a snapshot has more than once, and the rows beyond the first of each."""
    groups = staged.groupBy("point_id").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def merge_points(current: DataFrame, staged: DataFrame, as_of, regions: list[str] | None = None, source: str | None = None) -> DataFrame:
    """The published points after a snapshot, with the ``class`` of each.

    One full outer join sorts all rows out.  Of several staged rows of an id the latest counts (``latest_rows``).  New, changed and restored points take the staged values, but keep the old
    status and position where the new ones are missing.  Missing points of the snapshot's regions (and ``source``) are
    stamped as withdrawn; all others stay as they were."""
    joined = classify_changes(current, latest_rows(staged), "point_id")
    taken = F.col("class").isin("new", "changed", "restored")
    gone = F.col("class") == "missing"
    if regions is not None:
        gone = gone & F.col("cur.region").isin(*regions)
    if source is not None:
        gone = gone & (F.col("cur.source") == source)
    keep_old = {"status", "lon", "lat"}
    columns = []
    for c in current.columns:
        if c == "withdrawn":
            stamp = F.lit(as_of).cast(current.schema["withdrawn"].dataType)
            columns.append(F.when(taken, None).when(gone, stamp).otherwise(F.col("cur.withdrawn")).alias(c))
        elif c == "point_id":
            columns.append(F.col("point_id"))
        else:
            new = F.coalesce(f"new.{c}", f"cur.{c}") if c in keep_old else F.col(f"new.{c}")
            columns.append(F.when(taken, new).otherwise(F.col(f"cur.{c}")).alias(c))
    label = F.when(F.col("class") == "missing", F.when(gone, "withdrawn").otherwise("other")).otherwise(F.col("class"))
    return joined.select(*columns, label.alias("class"))


def publish_summary(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of added, changed, restored, withdrawn and unchanged points in one pass."""
    counts = [F.count_if(F.col("class") == c).alias(n) for c, n in (("new", "added"), ("changed", "changed"), ("restored", "restored"), ("withdrawn", "withdrawn"), ("unchanged", "unchanged"))]
    return merged.groupBy(*(by or [])).agg(*counts)


def refresh_derived(points: DataFrame, streets: DataFrame, localities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(streets, localities) with point counts and street flags (P10)."""
    return derive_counts(points, streets, "street_id"), derive_has_streets(streets, derive_counts(points, localities, "simc"))


def merge_duplicate_streets(streets: DataFrame, points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(streets, points) with one street for each key.

    The survivor has the most points, then the least id; it takes the official name of its group (that of the least id
    marked official) and a kind where it has none; the others' points move to it."""
    merged, moves = _one_of_each(derive_counts(points, streets, "street_id"), keys)
    return merged, _moved(points, moves)


def _one_of_each(counted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(streets, moves from a street to its survivor) of streets with their points counted."""
    ranked = survivors(counted, keys, [F.desc("n_points"), F.asc("street_id")], "street_id")
    official = F.struct("street_id", "name", "name_norm")
    names = ranked.groupBy("survivor").agg(F.min(F.when(F.col("official"), official)).alias("named"), F.min("kind").alias("any_kind"), F.sum("n_points").alias("total"))
    own = ranked.where("street_id = survivor").join(names, "survivor")
    own = own.select("street_id", "simc", "sym_ul", F.coalesce("kind", "any_kind").alias("kind"), F.coalesce("named.name", "name").alias("name"), F.coalesce("named.name_norm", "name_norm").alias("name_norm"), "official", "withdrawn", F.col("total").alias("n_points"))
    return own, ranked.where("street_id <> survivor").select("street_id", "survivor")


def _moved(points: DataFrame, moves: DataFrame) -> DataFrame:
    return points.join(moves, "street_id", "left").withColumn("street_id", F.coalesce("survivor", "street_id")).drop("survivor")


def merge_all_duplicates(streets: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(streets, points) after both passes (P12): streets with a code are one for each (simc, sym_ul), then those without
    one for each (simc, name_norm, kind), a missing kind being a kind of its own.

    No street is in both passes, so points are counted once and move once."""
    counted = kept("counted", derive_counts(points, streets, "street_id"))
    coded, first = _one_of_each(counted.where("sym_ul IS NOT NULL"), ["simc", "sym_ul"])
    bare, second = _one_of_each(counted.where("sym_ul IS NULL"), ["simc", "name_norm", "kind"])
    return kept("merged-streets", coded.unionByName(bare)), _moved(points, kept("moves", first.unionByName(second)))


def _lines(df: DataFrame, **values) -> DataFrame:
    """One row (measure, value) for each aggregate, by a single pass."""
    names = list(values)
    one = df.agg(*(F.coalesce(v.cast("long"), F.lit(0)).alias(k) for k, v in values.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in names))))


def merge_report(streets: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Measures of a street catalogue, to compare before and after a merge.

    Points meet the streets once; streets are counted by key, by name and alone."""
    linked = active(points).where("street_id IS NOT NULL").groupBy("street_id").agg(F.count("*").alias("n"))
    joined = linked.join(active(streets).select("street_id", F.lit(1).alias("known")), "street_id", "full_outer")
    own, missing = F.col("known").isNotNull(), F.col("known").isNull()
    counts = _lines(joined, streets=F.count("known"), streets_without_points=F.count_if(own & F.col("n").isNull()), points_of_missing_streets=F.sum(F.when(missing, F.col("n"))), points_with_street=F.sum("n"))
    groups = active(streets).groupBy(*keys).agg(F.count("*").alias("n"))
    doubles = _lines(groups, duplicate_groups=F.count_if(F.col("n") > 1), surplus_rows=F.sum(F.col("n") - 1))
    alike = active(streets).where("sym_ul IS NOT NULL").groupBy("simc", "sym_ul").agg(F.count("*").alias("n"))
    codes = _lines(alike, surplus_rows_of_codes=F.sum(F.col("n") - 1))
    coded = active(streets).groupBy("simc", "name_norm").agg(F.count_distinct("sym_ul").alias("codes"), F.count_if(F.col("kind").isNull()).alias("bare"), F.count_if(F.col("sym_ul").isNull()).alias("uncoded"))
    names = _lines(coded, names_with_several_codes=F.count_if(F.col("codes") > 1), streets_without_kind=F.sum("bare"), streets_without_code=F.sum("uncoded"))
    return union_all(counts, doubles, codes, names, _lines(active(points), points=F.count("*")))


def merge_comparison(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], keys: list[str]) -> DataFrame:
    """(measure, before, after) of two states, each (streets, points): what a merge did, and how many streets it merged
    (P13)."""
    a, b = (merge_report(*x, keys) for x in (before, after))
    both = a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), "measure")
    merged = both.where("measure = 'streets'").select(F.lit("merged_streets").alias("measure"), F.lit(0).cast("long").alias("before"), (F.col("before") - F.col("after")).alias("after"))
    return both.unionByName(merged)


def merge_secondary(primary: DataFrame, secondary: DataFrame, first: str, second: str, accept: bool = False) -> DataFrame:
    """Primary rows, and with ``accept`` the secondary rows whose address the primary lacks, marked."""
    from .relational import match_by_key

    own = primary.withColumn("accepted", F.lit(False))
    if not accept:
        return own
    extra = match_by_key(secondary, primary.select(first, second), first, second, "left_anti").withColumn("accepted", F.lit(True))
    return own.unionByName(extra, allowMissingColumns=True)

