"""Substring de-duplication of word windows by level-wise doubling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import Rolling, byte_units, covered, frugal, mix, row_of, window_ok, words
from .shards import NULL_ID, Shard, distinct_with_docs, earlier_code, exchange, join_codes, make_shards, range_bits, repeated_code, with_replies

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Least length of a level, in words.
SHORTEST = 6


class _Words:
    """Words of a shard as hashes, and the windows that survive the levels."""

    def __init__(self, shard: Shard, window: int):
        self.start, self.end, self.rows = words(shard.data, shard.offsets)
        self.units = Rolling(byte_units(shard.data)).spans(self.start, self.end)
        self.roll = Rolling(self.units)
        self.docs = shard.ids[row_of(self.rows)]
        self.long = np.repeat(np.diff(self.rows) >= window, np.diff(self.rows))

    def inside(self, length: int) -> np.ndarray:
        """Whether a window of this length that starts at a word lies in one text, itself long enough to matter."""
        ok = np.zeros(len(self.start) + 1, bool)
        fits = window_ok(self.rows, length)
        ok[: len(fits)] = fits & self.long[: len(fits)]
        return ok

    def level_keys(self, length: int, at: np.ndarray) -> np.ndarray:
        """48-bit hashes of windows: enough to rule out most, what they let pass is looked at again."""
        return self.roll.windows(length)[at] & ~np.uint64(0xFFFF) if len(at) else np.empty(0, np.uint64)

    def full_keys(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of windows."""
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        second = Rolling(mix(self.units ^ np.uint64(0xD6E8FEB86659FD93))).windows(length)[at]
        return self.roll.windows(length)[at], second.view(np.int64)

    def survivors(self, lengths: list[int], replies: list[np.ndarray]) -> np.ndarray:
        """Starts of the windows of the next length whose shorter windows, at their start and at their end, both repeat.

        The first length has all windows; ``replies`` tell for each length done which of its windows repeat."""
        at = np.flatnonzero(self.inside(lengths[0]))
        for length, longer, code in zip(lengths[:-1], lengths[1:], replies, strict=False):
            repeats = np.zeros(len(self.start) + 1, bool)
            place, _, _, _ = distinct_with_docs(self.docs[at], self.level_keys(length, at))
            repeats[at[code[place] > 0]] = True
            at = np.flatnonzero(repeats & self.inside(longer))
            at = at[repeats[at + longer - length]]
        return at


def _lengths(window: int) -> list[int]:
    """Lengths of the levels, each at most twice the one before; the last is the window itself."""
    out = [window]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose word sequence also starts in an earlier document.

    Level-wise doubling: all windows of the least length are looked up; those that repeat in two documents alone are
    extended to twice that length (a longer window needs both its first and its last shorter one) and looked up again, and
    so on to the full length, or until no candidate survives.  A level exchanges hashes of distinct windows between shards
    of documents (see ``shards``), so common passages cost one key a shard, and nothing is capped.  Levels use 48 bits and
    only rule out; full windows are matched by two independent hashes, 128 bits.

    Returns doc_id, n_words, n_removed, kept_sha256 (SHA-256 of the kept words joined by one blank), one row for each
    input row.  Null or empty text: no words, hash of the empty string.  Rows that share a doc_id never remove each
    other's words.  A null doc_id counts as larger than all others.  Other columns are ignored.
    """
    lengths = _lengths(window)
    shards = make_shards(docs, id_col, text_col)
    replies: dict[str, DataFrame] = {}
    alive = True

    for k, length in enumerate(lengths[:-1]):

        def ask(row: dict, known: dict, k=k, length=length):
            w = _Words(Shard(row), window)
            at = w.survivors(lengths[: k + 1], list(known.values()))
            _, (keys,), _, many = distinct_with_docs(w.docs[at], w.level_keys(length, at))
            return keys, many

        replies[f"level{k}"] = exchange(shards, ask, repeated_code, range_bits(shards, 0.18), dict(replies), f"level{k}")
        # Codes are packed as differences from the least; a level at which nothing repeats ends the search.
        alive = bool(replies[f"level{k}"].mapInArrow(_any_repeat, "any boolean").where("any").limit(1).count())
        if not alive:
            break

    rounds = list(replies)
    if alive:

        def ask_full(row: dict, known: dict):
            w = _Words(Shard(row), window)
            at = w.survivors(lengths, list(known.values()))
            _, (keys, second), low, _ = distinct_with_docs(w.docs[at], *w.full_keys(window, at))
            return keys, low, second

        replies["full"] = exchange(shards, ask_full, earlier_code, range_bits(shards, 0.05), dict(replies), "windows")

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                w = _Words(shard, window)
                gone = np.zeros(len(w.start), bool)
                if alive:
                    at = w.survivors(lengths, [join_codes(row[k]) for k in rounds])
                    place, _, low, _ = distinct_with_docs(w.docs[at], *w.full_keys(window, at))
                    hit = at[(w.docs[at] > low[place]) | (join_codes(row["full"])[place] > 0)] if len(at) else at
                    gone = covered(hit, window, len(w.start))
                yield _digest(shard, w, gone)

    return with_replies(shards, replies).mapInArrow(frugal(finish), SCHEMA)


def _any_repeat(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([bool((join_codes(x) > 0).any()) for x in batch.column("codes").to_pylist()], pa.bool_())], ["any"])


def _digest(shard: Shard, w: _Words, gone: np.ndarray) -> pa.RecordBatch:
    """Rows of the result: kept words joined by one blank, hashed."""
    keep = ~gone
    n = np.diff(w.rows)
    removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), np.minimum(w.rows[:-1], len(gone))) * (n > 0) if len(n) else n
    # A byte mask of the kept words, each followed by one blank; the last blank of a row is left off when hashing.
    size = (w.end - w.start)[keep]
    out_end = np.cumsum(size + 1)
    text = np.full(int(out_end[-1]) if len(out_end) else 0, 0x20, np.uint8)
    inside = np.zeros(len(shard.data) + 1, np.int8)
    inside[w.start[keep]] += 1
    inside[w.end[keep]] -= 1
    source = shard.data[np.cumsum(inside[:-1], dtype=np.int32) > 0]
    blank = np.zeros(len(text), bool)
    blank[out_end - 1] = True
    text[~blank] = source
    kept_before = np.r_[0, np.cumsum(keep)][w.rows]
    at = np.r_[0, out_end][kept_before]
    raw = memoryview(text)
    sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    ids = pa.array(shard.ids, pa.int64(), mask=shard.ids == NULL_ID)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
