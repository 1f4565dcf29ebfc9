"""Hard negatives by exact inner-product search: length buckets and feasible coordinate ranges rule rows out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import frugal
from .vectors import matrix
from .workspace import stored

#: Components become floor(SCALE * x), within +-LARGEST.
SCALE, LARGEST = 256, 1 << 26
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these shares of the positive's, in hundredths.
LOW_SHARE, HIGH_SHARE = 50, 95
#: Anchors that a task holds, rows of a slice at most and at least, rows of a length bucket at most.
ANCHOR_BLOCK, SLICE, LEAST_SLICE, BUCKET = 1 << 16, 1 << 20, 1 << 12, 1 << 13
#: A bucket's shortest vector has at least this share of the longest one's length.
LENGTH_RATIO = 0.9
#: Coordinates of an anchor whose sorted lists are looked into, those of its largest entries.
FOCUS = 4
#: Above this share of feasible rows a bucket is verified by one matrix product instead of row by row.
DENSE_SHARE = 0.25
_ANCHORS_AT_ONCE = 1024
_SLACK = 1e-9
_LEAST = np.iinfo(np.int64).min


def prepare(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """key, vec_id, label, norm, x: rows with an id, a label and a wholly finite vector; x holds 32-bit integers."""

    @frugal
    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, values = matrix(batch.column(2))
            x = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST)
            norm = (x * x).sum(axis=1)
            packed = [x[k, :n].astype("<i4").tobytes() for k, n in enumerate(lengths.tolist())]
            own = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(norm), pa.array(packed, pa.binary())], ["vec_id", "label", "norm", "x"])

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(integers, "vec_id long, label long, norm double, x binary").select(F.monotonically_increasing_id().alias("key"), "*")


class Buckets:
    """The rows of one length bucket, their unit vectors and, by coordinate, these sorted."""

    def __init__(self, x: np.ndarray, norm: np.ndarray):
        self.x, self.norm = x, norm
        self.longest = float(np.sqrt(norm.max()))
        self.unit = x / np.sqrt(np.maximum(norm, 1))[:, None]
        self.order = self.unit.argsort(axis=0)
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def feasible(self, unit: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(focus, low, high) for anchors of unit length: a row whose cosine with the anchor is ``share`` or more has its
        coordinate ``focus`` within low and high.  Two unit vectors at an angle t have coordinates whose own angles
        differ by t at most."""
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        angle = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
        turn = np.arccos(np.clip(share - _SLACK, -1, 1))[:, None]
        return focus, np.cos(np.minimum(np.pi, angle + turn)) - _SLACK, np.cos(np.maximum(0, angle - turn)) + _SLACK

    def candidates(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(dense, anchor, row): anchors for which all rows are candidates, and the pairs of the others, which lie in the
        feasible range of every focus coordinate."""
        begin, end = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            begin[at] = np.searchsorted(self.sorted[:, f], low[at], "left")
            end[at] = np.searchsorted(self.sorted[:, f], high[at], "right")
        width = np.maximum(end - begin, 0)
        best = width.argmin(axis=1)
        every = np.arange(len(focus))
        least = width[every, best]
        dense = least > DENSE_SHARE * len(self.x)
        few = np.flatnonzero(~dense)
        anchor = np.repeat(few, least[few])
        step = np.arange(len(anchor)) - np.repeat(np.cumsum(least[few]) - least[few], least[few])
        row = self.order[begin[anchor, best[anchor]] + step, focus[anchor, best[anchor]]]
        for k in range(focus.shape[1]):
            value = self.unit[row, focus[anchor, k]]
            inside = (value >= low[anchor, k]) & (value <= high[anchor, k])
            anchor, row = anchor[inside], row[inside]
        return np.flatnonzero(dense), anchor, row


def _dot(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of all rows of a with all of b; as doubles where every partial sum is below 2**53."""
    return (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


class Search:
    """The best ``k`` rows of each anchor within each of its score ranges, over rows that come by falling length.

    ``low`` and ``high`` (anchors x ranges) bound the scores.  ``same`` asks for rows of the anchor's label other than
    itself, else for rows of other labels."""

    def __init__(self, key: np.ndarray, label: np.ndarray, norm: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.key, self.label, self.norm, self.x = key, label, norm, x
        self.low, self.high, self.k, self.same = low, high, k, same
        self.unit = x / np.sqrt(np.maximum(norm, 1))[:, None]
        self.kth = np.full(low.shape, _LEAST)
        none = np.empty(0, np.int64)
        #: By range: anchor, score, id and key of the best rows so far.
        self.found = [(none, none, none, none) for _ in range(low.shape[1])]
        self.stats = {"pairs": 0, "verified": 0}

    def least(self) -> np.ndarray:
        """The score below which a row can't matter, by anchor."""
        return np.maximum(self.low, self.kth).min(axis=1)

    def add(self, key: np.ndarray, vec_id: np.ndarray, label: np.ndarray, norm: np.ndarray, x: np.ndarray) -> None:
        """Meet the rows of one length bucket."""
        bucket = Buckets(x, norm)
        exact = float(self.norm.max()) * float(norm.max()) < 2.0**104
        for start in range(0, len(self.key), _ANCHORS_AT_ONCE):
            own = np.arange(start, min(start + _ANCHORS_AT_ONCE, len(self.key)))
            least = self.least()[own]
            reach = np.sqrt(self.norm[own]) * bucket.longest
            share = np.where(reach > 0, least / np.maximum(reach, 1), np.where(least > 0, 2.0, -2.0))
            self.stats["pairs"] += len(own) * len(x)
            own, share, least = own[share <= 1 + _SLACK], share[share <= 1 + _SLACK], least[share <= 1 + _SLACK]
            if not len(own):
                continue
            dense, anchor, row = bucket.candidates(*bucket.feasible(self.unit[own], share))
            self.stats["verified"] += len(dense) * len(x) + len(anchor)
            score = np.einsum("ij,ij->i", self.x[own[anchor]].astype(np.int64), x[row].astype(np.int64)) if len(anchor) else np.empty(0, np.int64)
            good = score >= least[anchor]
            pairs = [(own[anchor[good]], row[good], score[good])]
            if len(dense):
                table = _dot(self.x[own[dense]], x, exact)
                i, j = np.nonzero(table >= least[dense][:, None])
                pairs.append((own[dense[i]], j, table[i, j]))
            anchor, row, score = (np.concatenate(p) for p in zip(*pairs, strict=True))
            wanted = (self.label[anchor] == label[row]) == self.same
            wanted &= self.key[anchor] != key[row]
            self._keep(anchor[wanted], score[wanted], vec_id[row[wanted]], key[row[wanted]])

    def _keep(self, anchor: np.ndarray, score: np.ndarray, vec_id: np.ndarray, key: np.ndarray) -> None:
        for t in range(self.low.shape[1]):
            fits = (score >= np.maximum(self.low[anchor, t], self.kth[anchor, t])) & (score <= self.high[anchor, t])
            if not fits.any():
                continue
            old = self.found[t]
            touched = np.zeros(len(self.key), bool)
            touched[anchor[fits]] = True
            again = touched[old[0]]
            a, s, i, k = (np.concatenate([o[again], n[fits]]) for o, n in zip(old, (anchor, score, vec_id, key), strict=True))
            order = np.lexsort((k, i, -s, a))
            a, s, i, k = a[order], s[order], i[order], k[order]
            place = np.arange(len(a)) - np.searchsorted(a, a, "left")
            last = place == self.k - 1
            self.kth[a[last], t] = s[last]
            best = place < self.k
            self.found[t] = tuple(np.concatenate([o[~again], n[best]]) for o, n in zip(old, (a, s, i, k), strict=True))

    def results(self) -> Iterator[tuple[int, tuple]]:
        yield from enumerate(self.found)


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    """Binary 32-bit integers as a matrix of doubles; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width))
    for k, raw in enumerate(column):
        v = np.frombuffer(raw.as_py(), "<i4")
        out[k, : len(v)] = v
    return out


def search(anchors: DataFrame, rows: DataFrame, group: list[str], width: int, ranges: int, k: int, same: bool, parts: int) -> DataFrame:
    """key, range, score, vec_id, other: of each group's anchors (with low, high) the best ``k`` of its rows by range.

    Anchors and rows of a group come to one task, anchors first, rows by falling length; rows are met in buckets as they
    stream by, so that a task holds its anchors and one bucket."""
    blank = F.lit(None).cast("array<long>")
    names = [f"group{k}" for k in range(len(group))]
    columns = [*(F.col(c).cast("long").alias(g) for c, g in zip(group, names, strict=True)), "kind", "norm", "key", "vec_id", "label", "x", "low", "high"]
    both = anchors.withColumn("kind", F.lit(0)).select(*columns).unionByName(rows.withColumn("kind", F.lit(1)).withColumn("low", blank).withColumn("high", blank).select(*columns))
    sorted_ = both.repartition(parts, *names).sortWithinPartitions(*names, "kind", F.desc("norm"), "key")
    ids = len(group)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, waiting, found = None, [], [], None

        def begin() -> Search | None:
            if not held:
                return None
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            key, label, norm, x, low, high = cols
            return Search(key, label, norm, x, low, high, k, same)

        def flush(rest: bool) -> None:
            """Meet the waiting rows bucket by bucket; without ``rest`` the last, open bucket stays."""
            if not waiting or found is None:
                waiting.clear()
                return
            cols = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            waiting.clear()
            norm, at = cols[3], 0
            while at < len(norm):
                end = min(at + BUCKET, at + int(np.searchsorted(-norm[at:], -(LENGTH_RATIO**2) * norm[at], "right")))
                if end == len(norm) and not rest and end - at < BUCKET:
                    break
                found.add(*(c[at:end] for c in cols))
                at = end
            if at < len(norm):
                waiting.append([c[at:] for c in cols])

        def close() -> Iterator[pa.RecordBatch]:
            flush(True)
            if found is not None:
                for t, (a, s, i, o) in found.results():
                    yield pa.RecordBatch.from_arrays([pa.array(found.key[a]), pa.array(np.full(len(a), t), pa.int32()), pa.array(s), pa.array(i), pa.array(o)], ["key", "range", "score", "vec_id", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(c), np.int64) for c in range(ids + 1)], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)], strict=True):
                name, kind, part = tuple(marks[a, :ids]), marks[a, ids], batch.slice(a, b - a)
                if name != here:
                    yield from close()
                    here, found = name, None
                    held.clear()
                norm, key, vec_id, label = (part.column(c).to_numpy(zero_copy_only=False) for c in range(ids + 1, ids + 5))
                if kind == 0:
                    bounds = [np.array(part.column(c).to_pylist(), np.int64).reshape(-1, ranges) for c in (ids + 6, ids + 7)]
                    held.append([key, label, norm, _unpack(part.column(ids + 5), width), *bounds])
                    continue
                if found is None:
                    found = begin()
                if found is not None:
                    waiting.append([key, vec_id, label, norm, _unpack(part.column(ids + 5), width)])
                    if sum(len(w[0]) for w in waiting) >= 2 * BUCKET:
                        flush(False)
        yield from close()

    return sorted_.mapInArrow(run, "key long, range int, score long, vec_id long, other long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` over all slices: score falling, then id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, anchor: Column | None = None, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, the nearest rows of other labels whose score lies
    between half and 95 hundredths of the positive's.

    ``anchor`` is a condition on vec_id (default: divisible by 50); ``label`` an expression of vec_id and label that
    replaces the label.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; exact, by
    integer inner products, ties by the smaller id.

    Anchors in blocks meet rows in slices, in two searches: rows of the own label give the positives, whose scores bound
    the second.  An anchor goes to each slice, a row to each block of anchors; neither grows with a hot label or a group
    of copies.  Rows with a null id, label, vector or component, or a non-finite one, take no part.  Repeated rows count
    each for itself.  Shorter vectors are filled up with zeros; components are held to +-2^26 after scaling.  An empty
    table gives no rows; other columns are ignored."""
    spark = table.sparkSession
    base = prepare(table, id_col, label_col, vector_col)
    if label is not None:
        base = base.withColumn("label", label)
    base = stored(base, "vectors")
    chosen = F.col("vec_id") % 50 == 0 if anchor is None else anchor
    n, wanted, longest = base.agg(F.count("*"), F.count_if(chosen), F.max(F.octet_length("x"))).first()
    width, blocks = (longest or 0) // 4, max(1, -(-wanted // ANCHOR_BLOCK))
    slices = max(-(-n // SLICE), min(-(-3 * spark.sparkContext.defaultParallelism // blocks), -(-n // LEAST_SLICE)), 1)
    parts = blocks * slices

    dealt = F.xxhash64("key")
    anchors = base.where(chosen).withColumn("block", F.pmod(dealt, F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    rows = base.withColumn("slice", F.pmod(dealt, F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    every = anchors.withColumn("low", F.array(F.lit(_LEAST + 1))).withColumn("high", F.array(F.lit(-_LEAST - 1)))
    positives = _best(search(every, rows, ["label", "block", "slice"], width, 1, POSITIVES, True, parts), ["key"], POSITIVES)
    positives = stored(positives.select("key", (F.col("rank") - 1).alias("range"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # A range for each positive; anchors with fewer have empty ones in their places.
    score = F.col("positive_score")
    low = F.expr(f"(positive_score * {LOW_SHARE} + pmod(-positive_score * {LOW_SHARE}, 100)) div 100")
    high = F.expr(f"(positive_score * {HIGH_SHARE} - pmod(positive_score * {HIGH_SHARE}, 100)) div 100")
    bounds = positives.groupBy("key").pivot("range", list(range(POSITIVES))).agg(F.first(low).alias("low"), F.first(high).alias("high"))
    bounds = bounds.select("key", *(F.array(*(F.coalesce(f"{t}_{c}", F.lit(empty)) for t in range(POSITIVES))).alias(c) for c, empty in (("low", -_LEAST - 1), ("high", _LEAST + 1))))
    asked = anchors.join(bounds, "key")
    found = search(asked, rows, ["block", "slice"], width, POSITIVES, NEGATIVES, False, parts)
    best = _best(found, ["key", "range"], NEGATIVES).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    names = base.where(chosen).select("key", F.col("vec_id").alias("anchor_id"))
    return best.join(positives, ["key", "range"]).join(names, "key").select("anchor_id", "positive_id", "rank", "negative_id", score, "negative_score")


def oracle_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""
