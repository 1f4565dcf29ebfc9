"""Address features from GML in two structures, and their mapping to registry rows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from addrflow.functions.codes import LOCALITY_KINDS, OBJECT_KINDS, coordinate_text, deepest_unit, pad, point_hash, recode
from addrflow.functions.geo import first_vertex, in_poland, parse_epsg, to_wgs84
from addrflow.functions.numbers import building_key, building_sort_key, canonical_building, is_garbage_number
from addrflow.functions.text import clean_text, normalize_text, not_empty, title_case
from addrflow.operators.relational import least_values
from addrflow.sources.scratch import kept

_ID = "struct<lokalnyId:string,przestrzenNazw:string,wersjaId:string>"
_WRAP = f"idIIP struct<AD_IdentyfikatorIIP:{_ID}>"
_POINT = "struct<Point:struct<_srsName:string,pos:string>>"
_LINE = "struct<LineString:struct<_srsName:string,posList:string>,Point:struct<_srsName:string,pos:string>>"
_LINK = "struct<_href:string,_VALUE:string>"
#: Fixed values: (structure, kind) -> element and the schema of what is read from it.
FEATURES = {
    ("2021", "point"): ("AD_PunktAdresowy", f"_id string,{_WRAP},poczatekWersjiObiektu string,numerPorzadkowy string,kodPocztowy string,status string,miejsce {_LINK},ulica2 {_LINK},georeferencja {_POINT}"),
    ("2021", "locality"): ("AD_Miejscowosc", f"_id string,{_WRAP},nazwa string,rodzaj string,identyfikatorSIMC string,identyfikatorPRNG string,TERYTGminy string,georeferencja {_POINT}"),
    ("2021", "street"): ("AD_UlicaPlac", f"_id string,{_WRAP},nazwaPelna string,rodzaj string,TERYTNazwa1 string,TERYTNazwa2 string,identyfikatorULIC string,ulica1 {_LINK},geometria {_LINE}"),
    ("2012", "point"): ("PRG_PunktAdresowy", f"_id string,lokalnyId string,wersjaId string,jednostkaAdministracyjna array<string>,miejscowosc string,ulica string,numerPorzadkowy string,kodPocztowy string,status string,pozycja {_POINT}"),
    ("2012", "locality"): ("PRG_MiejscowoscNazwa", f"_id string,lokalnyId string,nazwa string,idTERYT string,pozycja {_POINT}"),
    ("2012", "street"): ("PRG_UlicaNazwa", f"_id string,lokalnyId string,nazwa string,nazwaGlownaCzesc string,nazwaCzesc string,przedrostek1Czesc string,idTERYT string,miejscowosc string,pozycja {_POINT}"),
}


def _tags(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(name with prefix, element, n) of the opening tags whose element fits a pattern.

    Text is cut at every ``>``, so that a file without line breaks is no single row."""
    rows = spark.read.option("lineSep", ">").text(path)
    # What follows the last < of a piece is short, and most of it is no such tag from its first letter on.
    last = rows.where(F.contains("value", F.lit("<"))).select(F.explode(F.array(F.substring_index("value", "<", -1))).alias("t"))
    tag = F.regexp_extract("t", rf"^((?:[\w.-]+:)?(?:{names}))(?:[\s/][^<]*)?$", 1)
    found = last.select(F.explode(F.array(tag)).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    return found.select("name", F.regexp_replace("name", "^[^:]*:", "").alias("element"), "n")


def detect_profile(spark: SparkSession, path: str) -> DataFrame:
    """(element, structure, kind, features) of the known elements, and other feature-like ones without a structure."""
    known = {tag: key for key, (tag, _) in FEATURES.items()}
    rows = _tags(spark, path, r"(?:AD|PRG|EGB|OT)_\w+").groupBy("element").agg(F.sum("n").alias("features"))
    pick = F.create_map(*(F.lit(x) for tag, (s, k) in known.items() for x in (tag, f"{s} {k}")))
    found = F.try_element_at(pick, F.col("element"))
    return rows.select("element", F.split_part(found, F.lit(" "), F.lit(1)).alias("structure"), F.split_part(found, F.lit(" "), F.lit(2)).alias("kind"), "features")


#: A piece of a file: a whole feature, or what a split of the file begins and ends with.
_PIECE = "file long, start long, body string, head string, tail string"
#: Tags that stand between features, never inside one; characters after which a split without any fits no feature.
_APART = rf"</?(?:[\w.-]+:)?(?:{'|'.join(t for t, _ in FEATURES.values())}|featureMembers?|members?)[\s>]"
_LONGEST = 1 << 23


def _cut(name: str):
    """Batches of texts between ``</`` to features of one name, a split of a file at a time.

    ``head`` ends a feature that an earlier split began, ``tail`` begins one that a later split ends; every split has a row
    with both, null where there is none.  Nothing but the feature that is open is held."""
    apart = re.compile(_APART)
    opens, close = re.compile(rf"<{re.escape(name)}[\s>]"), f"</{name}>"

    def cut(batches):
        state = None  # (file, start), open text or None, whether a first end may belong to an earlier split, head

        def end(state):
            return (*state[0], None, state[3], None if state[2] else state[1])

        for batch in batches:
            values, files, starts = (batch.column(i) for i in range(3))
            keys = np.stack([files.to_numpy(), starts.to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            rows = []
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                key = (int(keys[0, lo]), int(keys[1, lo]))
                text = "</".join(values.slice(lo, hi - lo).to_pylist())
                if state is None or state[0] != key:
                    if state is not None:
                        rows.append(end(state))
                    # All texts but a file's first follow a separator.
                    text, state = text if key[1] == 0 else "</" + text, (key, None, key[1] > 0, None)
                else:
                    text = f"{state[1] or ''}</{text}"
                _, _, first, head = state
                at, left = 0, None
                while True:
                    found = opens.search(text, at)
                    if first:
                        stop = text.find(close, 0, found.start() if found else len(text))
                        if stop >= 0:
                            head, first = text[: stop + len(close)], False
                    if found is None:
                        break
                    first = False
                    stop = text.find(close, found.end())
                    if stop < 0:
                        left = text[found.start() :]
                        break
                    at = stop + len(close)
                    rows.append((*key, text[found.start() : at], None, None))
                if first and apart.search(text):
                    first = False
                elif first:
                    # Until it is known to be none, what stands here may be the rest of a feature; "" says that it is too long.
                    first = len(text) < _LONGEST
                    head, left = (None, text) if first else ("", None)
                state = (key, left, first, head)
            yield _batch(rows)
        if state is not None:
            yield _batch([end(state)])

    def _batch(rows):
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["file", "start", "body", "head", "tail"])

    return cut


def _features(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(body) of every feature of a name.

    Files are read in texts between closing tags of any element, so that a stretch without such a feature is no single row;
    tasks put the texts of their split together again, and a feature on the border of two splits is joined."""
    texts = spark.read.option("lineSep", "</").text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    pieces = kept("features", texts.mapInArrow(_cut(name), _PIECE))
    after = F.lead("head").over(Window.partitionBy("file").orderBy("start"))
    # An unclosed feature at the end of a file is closed, one that no split holds the end of is an error.
    rest = F.when(F.col("after") == "", F.raise_error(F.lit(f"a feature {name} is longer than a split"))).otherwise(F.coalesce("after", F.lit(f"</{name}>")))
    borders = pieces.where("body IS NULL").withColumn("after", after).where("tail IS NOT NULL").withColumn("head", rest)
    return pieces.where("body IS NOT NULL").select("body").unionByName(borders.select(F.concat("tail", "head").alias("body")))


def read_gml(spark: SparkSession, path: str, kind: str, profile: str = "auto") -> DataFrame:
    """Raw rows of one kind of feature, whatever the namespaces.

    One large file is read by many tasks, in pieces no longer than a feature; the tag's prefix is found by one pass over all
    tags, wherever the first such feature stands.  Nothing found is an error, never an empty snapshot."""
    structures = ("2021", "2012") if profile == "auto" else (profile,)
    # A handful of names at most: one for each prefix that the files use.
    names = _tags(spark, path, "|".join(FEATURES[s, kind][0] for s in structures)).orderBy(F.desc("n"), "name").collect()
    for structure in structures:
        tag, schema = FEATURES[structure, kind]
        name = next((r["name"] for r in names if r["element"] == tag), None)
        if name:
            # Prefixes are dropped: their declarations are at the top of the file, not in the piece.
            bare = F.regexp_replace(F.regexp_replace("body", r"<(/?)[\w.-]+:", "<$1"), r"\s[\w.-]+:(\w+)=", " $1=")
            # A generator of one row: else each field would parse the feature anew.
            parsed = _features(spark, path, name).select(F.explode(F.array(F.from_xml(bare, schema, {"ignoreNamespace": "true"}))).alias("f"))
            return parsed.select("f.*", F.lit(structure).alias("structure"))
    raise ValueError(f"no feature of kind {kind} in {path}")


def pick_path(df: DataFrame, paths: list[str]) -> Column:
    """The first non-empty of several paths that the rows have; a link's target without its leading #."""
    have = []
    for p in paths:
        try:
            df.select(F.col(p))
        except Exception as e:  # a path that this structure lacks
            if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e) and "INVALID_EXTRACT" not in str(e):
                raise
            continue
        have.append(not_empty(F.regexp_replace(F.col(p).cast("string"), "^#", "")))
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def pick_path_all(df: DataFrame, path: str) -> Column:
    """All values of a repeated field, as an array (S3)."""
    if path.split(".")[0] not in df.columns:
        return F.array().cast("array<string>")
    c = F.col(path)
    return F.coalesce(F.transform(c.cast("array<string>"), lambda x: F.trim(x)), F.array().cast("array<string>"))


def _position(raw: DataFrame) -> Column:
    pos = pick_path(raw, ["georeferencja.Point.pos", "geometria.LineString.posList", "geometria.Point.pos", "pozycja.Point.pos"])
    srs = pick_path(raw, ["georeferencja.Point._srsName", "geometria.LineString._srsName", "geometria.Point._srsName", "pozycja.Point._srsName"])
    v, crs = first_vertex(pos), parse_epsg(F.coalesce(srs, F.lit("EPSG:2180")))
    return F.when(v.isNotNull(), to_wgs84(v["a"], v["b"], crs["epsg"], crs["north_first"]))


def _placed(raw: DataFrame) -> DataFrame:
    """Rows with ``_pos``; a generator of one row keeps its projection from being computed for each use."""
    return raw.select("*", F.explode(F.array(_position(raw))).alias("_pos"))


def map_points(raw: DataFrame) -> DataFrame:
    """Points with their ``hash`` and ``skipped``, the reason why a row is no address."""
    number = clean_text(pick_path(raw, ["numerPorzadkowy"]))
    code = pick_path(raw, ["kodPocztowy"])
    point_id = F.coalesce(pick_path(raw, ["idIIP.AD_IdentyfikatorIIP.lokalnyId", "lokalnyId"]), pick_path(raw, ["_id"]))
    df = _placed(raw)
    reason = F.when(point_id.isNull(), "no id").when(number.isNull(), "no number").when(is_garbage_number(number), "no address number")
    terc = deepest_unit(pick_path_all(raw, "jednostkaAdministracyjna"))
    rows = df.select(
        point_id.alias("point_id"),
        pick_path(raw, ["idIIP.AD_IdentyfikatorIIP.wersjaId", "wersjaId"]).alias("version_id"),
        pick_path(raw, ["miejsce._href", "miejscowosc"]).alias("locality_ref"),
        pick_path(raw, ["ulica2._href", "ulica"]).alias("street_ref"),
        terc.alias("terc_ref"),
        F.substring(terc, 1, 2).alias("region"),
        canonical_building(number).alias("number"),
        building_key(number).alias("number_key"),
        building_sort_key(canonical_building(number)).alias("number_sort"),
        F.when(F.rlike(code, F.lit("^[0-9]{2}-[0-9]{3}$")), code).alias("postal_code"),
        pick_path(raw, ["status"]).alias("status"),
        F.col("_pos.lon").alias("lon"),
        F.col("_pos.lat").alias("lat"),
        F.col("_pos.swapped").alias("swapped"),
        reason.alias("skipped"),
    )
    rounded = [coordinate_text(F.col(c)) for c in ("lat", "lon")]
    return rows.withColumn("hash", point_hash("locality_ref", "street_ref", "number", "postal_code", "status", *rounded))


def map_localities(raw: DataFrame) -> DataFrame:
    """Localities with title-cased and normalised names (M2)."""
    name = title_case(clean_text(pick_path(raw, ["nazwa"])))
    simc = pad(pick_path(raw, ["identyfikatorSIMC", "idTERYT"]), 7)
    df = _placed(raw)
    reason = F.when(name.isNull(), "no name").when(~F.coalesce(F.rlike(simc, F.lit("^[0-9]{7}$")), F.lit(False)), "no locality code")
    return df.select(pick_path(raw, ["_id"]).alias("gml_id"), simc.alias("simc"), name.alias("name"), normalize_text(name).alias("name_norm"), recode(pick_path(raw, ["rodzaj"]), LOCALITY_KINDS).alias("kind"), pick_path(raw, ["TERYTGminy"]).alias("terc"), pick_path(raw, ["identyfikatorPRNG"]).alias("prng_id"), F.col("_pos.lon").alias("lon"), F.col("_pos.lat").alias("lat"), reason.alias("skipped"))


def map_streets(raw: DataFrame) -> DataFrame:
    """Streets with their kind from the object's kind, else from the name's prefix (M3)."""
    name = title_case(clean_text(pick_path(raw, ["nazwaPelna", "nazwa"])))
    kind = F.coalesce(F.nullif(recode(pick_path(raw, ["rodzaj"]), OBJECT_KINDS), F.lit("")), pick_path(raw, ["przedrostek1Czesc"]))
    reason = F.when(name.isNull(), "no name")
    return raw.select(pick_path(raw, ["_id"]).alias("gml_id"), pad(pick_path(raw, ["identyfikatorULIC", "idTERYT"]), 5).alias("sym_ul"), pick_path(raw, ["ulica1._href", "miejscowosc"]).alias("locality_ref"), kind.alias("kind"), name.alias("name"), normalize_text(name).alias("name_norm"), pick_path(raw, ["TERYTNazwa1"]).alias("name_1"), pick_path(raw, ["TERYTNazwa2"]).alias("name_2"), reason.alias("skipped"))


def split_skipped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) rows (M4)."""
    return df.where("skipped IS NULL").drop("skipped"), df.where("skipped IS NOT NULL")


def ingest_stats(mapped: DataFrame, top: int = 10) -> DataFrame:
    """(measure, n): rows, positions missing, swapped or outside, and the commonest reasons for skipping."""
    # One pass: a handful of rows, one for each reason.
    seen = mapped.groupBy("skipped").agg(F.count("*").alias("rows"), F.count_if(F.col("lon").isNull()).alias("no_position"), F.count_if(F.col("swapped")).alias("swapped"), F.count_if(~in_poland(F.col("lon"), F.col("lat"))).alias("outside"))
    seen = kept("statistics", seen)
    shape = seen.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "no_position", "swapped", "outside")))
    a = shape.select(F.expr("stack(4, 'rows', rows, 'no_position', no_position, 'swapped', swapped, 'outside', outside) as (measure, n)"))
    b = seen.where("skipped IS NOT NULL").select(F.concat(F.lit("skipped: "), "skipped").alias("measure"), F.col("rows").alias("n")).orderBy(F.desc("n"), "measure").limit(top)
    return a.unionByName(b)


def discover_gml(spark: SparkSession, path: str, samples: int = 3) -> DataFrame:
    """(element, n, samples, candidate) of the leaf elements of an unknown file."""
    # Cut at closing tags: a leaf element is what stands at the end of such a piece.
    text = spark.read.option("lineSep", "</").text(path)
    # Generators of one row: else filters would take the pieces apart anew.
    last = text.where(F.contains("value", F.lit("<"))).select(F.explode(F.array(F.substring_index("value", "<", -1))).alias("t")).where(F.contains("t", F.lit(">")))
    element = F.regexp_extract(F.substring_index("t", ">", 1), r"^(?:[\w.-]+:)?(\w+)(?:\s[^>]*)?$", 1)
    pair = F.struct(element.alias("element"), F.trim(F.expr("substring(t, locate('>', t) + 1)")).alias("v"))
    pairs = last.select(F.explode(F.array(pair)).alias("p")).select("p.*").where("element <> '' AND v <> ''")
    out = least_values(pairs, ["element"], "v", samples)
    feature = detect_profile(spark, path).select("element", F.col("features").alias("n"), F.array().cast("array<string>").alias("samples"))
    return out.unionByName(feature).withColumn("candidate", F.rlike("element", F.lit("^(AD_|PRG_|EGB_|OT_)")))
