"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Rolling, blocks, byte_units, row_of, text_bytes, words
from .workspace import stored

FEATURES = ("words", "word_bytes", "symbols", "upper", "digits", "marks", "distinct", "short", "dup_lines", "symbol_words", "bare_marks", "repeats", "top_word", "line_words", "title", "exclaim")
#: Labelled rows that are learned from, at most; bins of a feature, and of each side of a pair; pairs of features.
TRAIN_ROWS, BINS, PAIR_BINS, PAIRS = 40_000, 48, 10, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_ROWS, SHRINK = 150, 60, 0.15, 4, 5, 4.0
_BLOCK = 4 << 20

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b"!"), 1):
    _CLASS[list(_chars)] |= 1 << (_k - 1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; only the text itself is looked at."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    start, end, rows = words(data, offsets)
    count = np.diff(rows)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    row, safe = row_of(rows), np.maximum(count, 1)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, n)

    kind = _CLASS[data]
    size = np.diff(offsets)

    def share_of_bytes(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    letters = share_of_bytes(_LETTER[data])
    hashes = Rolling(byte_units(data)).spans(start, end)
    length = end - start
    first, last = data[start], data[end - 1]
    symbol_total = np.r_[0, np.cumsum(kind & 1 > 0)]
    letter_total = np.r_[0, np.cumsum(_LETTER[data])]
    with_symbol = symbol_total[end] > symbol_total[start]
    bare = letter_total[end] == letter_total[start]
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    run = np.diff(np.r_[np.flatnonzero(new), len(h)])
    top = np.zeros(n)
    np.maximum.at(top, r[new], run)
    tri = Rolling(hashes).windows(3)
    repeats = np.zeros(n)
    if len(tri):
        same = row[:-2] == row[2:]
        tri, of = tri[same], row[:-2][same]
        order = np.lexsort((tri, of))
        t, o = tri[order], of[order]
        again = np.r_[False, (t[1:] == t[:-1]) & (o[1:] == o[:-1])]
        repeats = np.bincount(o[again], minlength=n) / safe
    # Lines: runs between line feeds that hold a word.
    feed = np.flatnonzero(data == 10)
    edge = np.unique(np.concatenate([offsets[:-1][size > 0], feed + 1]))
    edge = edge[edge < len(data)]
    stop = np.r_[edge[1:], len(data)]
    has = np.searchsorted(start, stop) > np.searchsorted(start, edge)
    edge, stop = edge[has], stop[has]
    stop = stop - (data[stop - 1] == 10)
    line = Rolling(byte_units(data)).spans(edge, stop)
    of = np.searchsorted(offsets, edge, "right") - 1
    order = np.lexsort((line, of))
    x, o = line[order], of[order]
    again = np.r_[False, (x[1:] == x[:-1]) & (o[1:] == o[:-1])] if len(x) else np.empty(0, bool)
    lines = np.maximum(np.bincount(of, minlength=n), 1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = per_row(length) / safe
    out[:, 2] = share_of_bytes(kind & 1 > 0)
    out[:, 3] = share_of_bytes(kind & 2 > 0) / np.maximum(letters, 1e-6)
    out[:, 4] = share_of_bytes(kind & 4 > 0)
    out[:, 5] = share_of_bytes(kind & 8 > 0)
    out[:, 6] = np.bincount(r[new], minlength=n) / safe
    out[:, 7] = per_row(length <= 3) / safe
    out[:, 8] = np.bincount(o[again], minlength=n) / lines
    out[:, 9] = per_row(with_symbol) / safe
    out[:, 10] = per_row(bare) / safe
    out[:, 11] = repeats
    out[:, 12] = top / safe
    out[:, 13] = np.log1p(count / lines)
    out[:, 14] = per_row(_CLASS[first] & 2 > 0) / safe
    out[:, 15] = per_row(last == 33) / safe
    out[count == 0] = 0
    return out


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, _BLOCK):
                x = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, x array<float>")


def _tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow regression tree over ordered bins: its value for every bin."""
    edges = [0, len(gradient)]
    g, w, c = (np.r_[0, np.cumsum(v)] for v in (gradient, weight, rows))

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (w[b] - w[a] + SHRINK)

    while len(edges) <= leaves:
        best, where = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            cut = np.arange(a + 1, b)
            cut = cut[(c[cut] - c[a] >= LEAST_ROWS) & (c[b] - c[cut] >= LEAST_ROWS)]
            if len(cut):
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], int(cut[k])
        if where is None:
            break
        edges = sorted([*edges, where])
    out = np.empty(len(gradient))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + SHRINK)
    return out


def _strips(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(worth, cut) of each strip of cells, cut in two where that is best; cut 0 leaves it whole."""
    g, w, c = (np.cumsum(v, axis=1) for v in (gradient, weight, rows))
    whole = g[:, -1:] ** 2 / (w[:, -1:] + SHRINK)
    left, right = g[:, :-1] ** 2 / (w[:, :-1] + SHRINK), (g[:, -1:] - g[:, :-1]) ** 2 / (w[:, -1:] - w[:, :-1] + SHRINK)
    enough = (c[:, :-1] >= LEAST_ROWS) & (c[:, -1:] - c[:, :-1] >= LEAST_ROWS)
    worth = np.concatenate([whole, np.where(enough, left + right, -np.inf)], axis=1)
    cut = worth.argmax(axis=1)
    return worth[np.arange(len(worth)), cut], cut


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A tree of two levels over a pair's cells: one feature is cut once, each side then on the other feature, whichever comes
    first; its value for every cell."""
    best: tuple = (-np.inf, None)
    for turned in (False, True):
        g, w, c = (v.T if turned else v for v in (gradient, weight, rows))
        low = [np.cumsum(v, axis=0) for v in (g, w, c)]
        whole, cut_whole = _strips(*(v[-1:] for v in low))
        if whole[0] > best[0] + 1e-12:
            best = (whole[0], (turned, len(g), int(cut_whole[0]), 0))
        if len(g) > 1:
            below = [v[:-1] for v in low]
            above = [v[-1:] - v[:-1] for v in low]
            (one, cut_one), (two, cut_two) = _strips(*below), _strips(*above)
            enough = (below[2].sum(axis=1) >= LEAST_ROWS) & (above[2].sum(axis=1) >= LEAST_ROWS)
            total = np.where(enough, one + two, -np.inf)
            k = int(total.argmax())
            if total[k] > best[0] + 1e-12:
                best = (total[k], (turned, k + 1, int(cut_one[k]), int(cut_two[k])))
    turned, first, *cuts = best[1]
    out = np.zeros((gradient.T if turned else gradient).shape)
    g, w = (v.T if turned else v for v in (gradient, weight))
    for a, b, cut in ((0, first, cuts[0]), (first, len(out), cuts[1])):
        for x, y in ((0, cut), (cut, out.shape[1])):
            if a < b and x < y:
                out[a:b, x:y] = g[a:b, x:y].sum() / (w[a:b, x:y].sum() + SHRINK)
    return out.T if turned else out


class AdditiveModel:
    """Lookup tables: one for each feature's bins, one for each chosen pair's cells; a score is their sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(f)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if n else np.empty(0) for j in range(f)]
        rate = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if n == 0 or y.min() == y.max():
            return
        bins = self._bins(x, self.edges)
        score = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(f):
                p = 1 / (1 + np.exp(-score))
                m = len(self.tables[j])
                step = RATE * _tree(np.bincount(bins[j], y - p, m), np.bincount(bins[j], p * (1 - p), m), np.bincount(bins[j], minlength=m), LEAVES)
                self.tables[j] += step
                score += step[bins[j]]
        cells = self._bins(x, self.coarse)
        p = 1 / (1 + np.exp(-score))

        def cell(a, b):
            return cells[a] * (len(self.coarse[b]) + 1) + cells[b]

        def gain(a, b):
            k = cell(a, b)
            return float((np.bincount(k, y - p) ** 2 / (np.bincount(k, p * (1 - p)) + SHRINK)).sum())

        ranked = sorted(((gain(a, b), a, b) for a in range(f) for b in range(a + 1, f)), reverse=True)
        self.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1) * (len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-score))
                k, shape = cell(a, b), (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
                step = RATE * _pair_tree(*(np.bincount(k, v, len(table)).reshape(shape) for v in (y - p, p * (1 - p), np.ones(n)))).ravel()
                table += step
                score += step[k]

    @staticmethod
    def _bins(x: np.ndarray, edges) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for b, table in zip(self._bins(x, self.edges), self.tables, strict=True):
            total += table[b]
        cells = self._bins(x, self.coarse)
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[cells[a] * (len(self.coarse[b]) + 1) + cells[b]]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every text by a model learned from labelled rows that are not held out.

    Every text is read once for its features, which are stored.  Labelled rows with crc32(id as text) mod 5 other than 0
    train the model, at most ``train_rows`` of them (least hash of the id first); that many rows of 16 numbers reach the
    driver.  Tables of the model are applied to all rows in vectorised additions.

    Returns doc_id, held_out, score, predicted (1 if score >= ``threshold``).  Null or empty text has all features 0 and
    is scored like any other.  Without usable labels, or with one class only, every score is the smoothed share of 1.  Of
    several labels for an id the least counts; ids may repeat; a null id is scored, and not held out.
    """
    rows = stored(feature_rows(docs, id_col, text_col), "features")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("x", "y").toArrow()
    x = np.array(sample["x"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    model = AdditiveModel(x, sample["y"].to_numpy().astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(own))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
