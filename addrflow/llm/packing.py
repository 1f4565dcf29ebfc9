"""Packing of tokenised documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import Rolling, blocks, byte_units, text_bytes, words
from .workspace import stored

#: Tokens of a sequence, and the step to which piece lengths are rounded up for planning.
CAPACITY, STEP = 2048, 8
#: Id that ends every document.
END_ID = 1
#: Words whose ids a worker remembers at most, before it starts anew.
CACHE_WORDS = 1 << 21
#: New words that are encoded at a time.
WORDS_AT_ONCE = 10_000
_BLOCK = 4 << 20


class Places:
    """Place of 64-bit hashes in the order in which they were added: a table with linear probing, in whole arrays."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most - 1).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.places, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where there is none."""
        out, left, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._start(keys)
        while len(left):
            have = self.keys[at]
            hit = have == keys[left]
            out[left[hit]] = self.places[at[hit]]
            on = ~hit & (have != 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add hashes that are new and differ from each other; none is 0."""
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            # Of several that want a slot one has got it.
            got = free & (self.keys[at] == keys[left])
            self.places[at[got]] = self.n + left[got]
            left, at = left[~got], (at[~got] + 1) & self.mask
        self.n += len(keys)


class PlainWords:
    """Token ids of words in Latin letters, digits and signs, by the vocabulary's ranks: the same ids as the tokenizer's.

    Each piece of a word ends with a mark, so that the vocabulary's word ends are tokens of bytes like others."""

    #: Words whose lower case and pieces need nothing but their own characters.
    PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
    #: Fixed value: the vocabulary's pieces of a text.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARK, END = "\x1f", "</w>"

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Ranks stand for the order of merges only where ids follow it.
        made = [vocabulary[a + b] for a, b in merges]
        self.usable = made == sorted(made) and model["end_of_word_suffix"] == self.END
        # The byte alphabet: printable bytes stand for themselves, others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {}
        for token, k in vocabulary.items():
            body = token.removesuffix(self.END)
            if not token.startswith("<|"):
                ranks[bytes(byte_of[c] for c in body) + (self.MARK.encode() if token != body else b"")] = k
        self.blank = ranks[b" "]
        self.encoding = tiktoken.Encoding("words", pat_str="[^\x1f ]+\x1f| ", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(self.PIECE)

    def fits(self, word: str) -> bool:
        return self.usable and self.PLAIN.fullmatch(word) is not None and "<|" not in word

    def encode(self, words_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, length by word)."""
        ids = self.encoding.encode_to_numpy(self.pieces.sub(r"\g<0>" + self.MARK, " ".join(words_).lower()))
        edge = np.concatenate([[-1], np.flatnonzero(ids == self.blank), [len(ids)]])
        return ids[ids != self.blank], np.diff(edge) - 1


class WordTokens:
    """Token ids of white-space separated words, remembered by word.

    Only for tokenizers none of whose tokens spans white space: then a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), PlainWords(path)
        self.known = Places(CACHE_WORDS)
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.ids, self.offsets = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, length by word)."""
        plain = np.fromiter(map(self.plain.fits, texts), bool, len(texts))
        length, parts = np.empty(len(texts), np.int64), []
        own = list(compress(texts, plain))
        got = self.plain.encode(own) if own else (np.empty(0, np.uint32), np.empty(0, np.int64))
        length[plain] = got[1]
        if len(own) == len(texts):
            return got[0], length
        other = [e.ids for e in self.tokenizer.encode_batch_fast(list(compress(texts, ~plain)), add_special_tokens=False)]
        length[~plain] = np.fromiter(map(len, other), np.int64, len(other))
        runs, others = iter(np.split(got[0], np.cumsum(got[1])[:-1])), iter(other)
        parts = [next(runs) if p else np.array(next(others), np.uint32) for p in plain.tolist()]
        return np.concatenate(parts).astype(np.uint32), length

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by row) of the texts."""
        start, end, rows = words(data, offsets)
        keys = np.maximum(Rolling(byte_units(data)).spans(start, end), np.uint64(1))
        # One long text may have more words than there is room for.
        some = [slice(k, k + CACHE_WORDS) for k in range(0, max(1, len(keys)), CACHE_WORDS)]
        ids, lengths = zip(*(self._ids(data, keys[k], start[k], end[k]) for k in some), strict=True)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])[rows]

    def _ids(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, length by word) of at most CACHE_WORDS words."""
        word = self.known.find(keys)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if self.known.n + len(fresh) > CACHE_WORDS:
                self.clear()
                new = np.arange(len(keys))
                fresh, first = np.unique(keys, return_index=True)
            raw, at = memoryview(data), new[first]
            parts, lengths = [self.ids], []
            for k in range(0, len(at), WORDS_AT_ONCE):
                own = at[k : k + WORDS_AT_ONCE]
                ids, length = self._new([str(raw[a:b], "utf-8") for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
                parts.append(ids)
                lengths.append(length)
            self.known.add(fresh)
            self.ids = np.concatenate(parts)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(lengths))])
            word[new] = self.known.find(keys[new])
        begin = self.offsets[word]
        length = self.offsets[word + 1] - begin
        before = np.cumsum(length) - length
        return self.ids[np.repeat(begin - before, length) + np.arange(length.sum())], length


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids, cut every ``capacity`` ids from its start.

    Ids are made where the text is read and never shuffled.  A document without text has the end id alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens(tokenizer_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            own = batch.column(0)
            for a, b in blocks(offsets, _BLOCK):
                ids, edge = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(edge) + 1
                raw = np.insert(ids, edge[1:], END_ID).astype("<u4").tobytes()
                base = np.concatenate([[0], np.cumsum(n)])
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, n[row] - start)
                at = base[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.slice(a, b - a).take(pa.array(row)).cast(pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(n[row], pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of items within ``room``."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for u in range(1, room + 1):
        n = int(np.searchsorted(weight, u, "right"))
        best[u], choice[u] = best[u - 1], -2
        if n:
            gain = best[u - weight[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[u]:
                best[u], choice[u] = gain[k], k
    count, u = np.zeros(len(value), np.int64), room
    while u > 0:
        if choice[u] == -2:
            u -= 1
        else:
            count[choice[u]] += 1
            u -= int(weight[choice[u]])
    return float(best[room]), count


def column_generation(weight: np.ndarray, demand: np.ndarray, room: int, rounds: int = 3000, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, use): the linear relaxation of cutting stock by the revised simplex method.

    Each round prices a new pattern by ``best_pattern`` with the dual prices.  Stops when the use is within ``gap`` (or
    half a sequence) of the bound that the last price gives, or after ``rounds``."""
    m = len(weight)
    patterns = np.diag(room // weight).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    use = inverse @ demand
    for _ in range(rounds):
        price = np.maximum(inverse.sum(axis=0), 0)
        top, column = best_pattern(price, weight, room)
        if top <= 1 + 1e-9 or use.sum() * (1 - 1 / top) <= max(0.5, gap * use.sum()):
            break
        step = inverse @ column
        able = np.flatnonzero(step > 1e-10)
        if not len(able):
            break
        leave = able[(use[able] / step[able]).argmin()]
        t = use[leave] / step[leave]
        use = use - t * step
        use[leave] = t
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        patterns[:, leave] = column
    return patterns.astype(np.int64).T, np.maximum(use, 0)


def plan(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)]: how often to use which pattern (class -> pieces) so that every piece has a place.

    The linear program's uses are rounded down; what is left over, less than one sequence for each pattern, goes
    first-fit by decreasing length."""
    weight = np.array(sorted(c for c, n in counts.items() if n), np.int64)
    if not len(weight):
        return []
    demand = np.array([counts[int(c)] for c in weight], np.int64)
    patterns, use = column_generation(weight, demand.astype(float), room)
    times = np.floor(use + 1e-7).astype(np.int64)
    out, left = [], demand.copy()
    for p, x in zip(patterns, times, strict=True):
        x = int(min([x, *(left[p > 0] // p[p > 0])]))
        if x > 0:
            left -= x * p
            out.append(({int(c): int(k) for c, k in zip(weight, p, strict=True) if k}, x))
    while left.any():
        pattern, space = {}, room
        for k in range(len(weight) - 1, -1, -1):
            n = int(min(left[k], space // weight[k]))
            if n:
                pattern[int(weight[k])] = n
                space -= n * int(weight[k])
        x = min(int(left[k]) // pattern[int(c)] for k, c in enumerate(weight) if int(c) in pattern)
        left -= np.array([x * pattern.get(int(c), 0) for c in weight])
        out.append((pattern, x))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, step: int = STEP, rank_rows: int = 1 << 20) -> DataFrame:
    """Give each piece a ``sequence_id`` and its ``offset`` there (gapless from 0).

    Only the histogram of lengths, rounded up to ``step`` (capacity / step classes), reaches the driver.  Patterns take
    the pieces of a class by rank; ranks are made in salted parts of about ``rank_rows`` rows, so that a common length is
    no hot key.  A sequence holds at most ``capacity`` tokens, so at most as many pieces."""
    classed = pieces.withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    counts = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    salts = max(16, sum(counts.values()) // rank_rows)
    classed = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    parts = classed.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = classed.withColumn("rank", F.row_number().over(own) - 1).join(parts, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    # Intervals of ranks, by class: (first rank, first sequence, pieces a sequence, first slot)
    table: dict[int, list] = {c: [] for c in counts}
    taken = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, times in plan(counts, capacity // step):
        slot = 0
        for c in sorted(pattern, reverse=True):
            table[c].append((taken[c], sequence, pattern[c], slot))
            taken[c] += pattern[c] * times
            slot += pattern[c]
        sequence += times
    intervals = {c: np.array(x, np.int64) for c, x in table.items()}

    def place(batches):
        for batch in batches:
            classes, rank = batch.column("class").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            where, slot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for c in np.unique(classes):
                rows = np.flatnonzero(classes == c)
                x = intervals[int(c)]
                x = x[np.searchsorted(x[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - x[:, 0]
                where[rows], slot[rows] = x[:, 1] + nth // x[:, 2], x[:, 3] + nth % x[:, 2]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(where), pa.array(slot)], [*keep, "sequence_id", "slot"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """Tokenise all rows and pack them into sequences of at most ``capacity`` tokens with little padding.

    Returns one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null or empty text is
    the end id alone; a long one is cut every ``capacity`` ids.  Null and repeated ids are carried along, each row being a
    document of its own; an empty table gives no rows; other columns are ignored."""
    return pack(stored(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces"), capacity, step)
