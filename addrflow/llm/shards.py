"""Shards of a corpus and the exchange of window keys between them.

A shard is a run of whole documents, stored once as one compressed row.  To learn which windows occur in other
shards, each shard sends its distinct window keys, sorted, cut by key range; a range merges the sorted runs of
all shards and answers with one bit for each key sent.  A key therefore travels once per shard, however often it occurs
in it: a passage that a third of all documents hold costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, frugal, text_bytes
from .workspace import stored

#: Bytes of text in a shard: a task holds one shard at a time.
SHARD_BYTES = 4 << 20
#: Keys that one range of the exchange merges at a time, about.
RANGE_KEYS = 1 << 20
#: Stands for a null document id: larger than all others, so never "an earlier document".
NULL_ID = np.iinfo(np.int64).max

SHARD_SCHEMA = "shard long, n_docs long, raw_bytes long, ids binary, lengths binary, body binary"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes of their differences from the least."""
    values = np.ascontiguousarray(values)
    if not len(values):
        return b""
    low = values.min()
    gap = (values - low).astype(np.uint64)
    width = 1 if gap.max() < 256 else 2 if gap.max() < 65536 else 4 if gap.max() < 2**32 else 8
    planes = np.ascontiguousarray(gap.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return int(low).to_bytes(9, "little", signed=True) + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype=np.int64) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype)
    low, width = int.from_bytes(blob[:9], "little", signed=True), blob[9]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[10:]), np.uint8).reshape(width, -1)
    gap = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
    return gap + np.uint64(low) if dtype == np.uint64 else gap.astype(np.int64) + low


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


class Shard:
    """A shard's documents: ids, bytes and offsets."""

    def __init__(self, row: dict):
        self.ids = unpack(row["ids"])
        self.offsets = np.concatenate([[0], np.cumsum(unpack(row["lengths"]))]).astype(np.int64)
        self._body = row.get("body")

    @property
    def data(self) -> np.ndarray:
        if isinstance(self._body, bytes):
            self._body = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._body), np.uint8) if self._body else np.empty(0, np.uint8)
        return self._body


def make_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Table of shards over all rows of ``docs``, kept in the shared folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        ids, parts, lengths, size = [], [], [], 0

        def flush():
            nonlocal n, ids, parts, lengths, size
            body = np.concatenate(parts) if parts else np.empty(0, np.uint8)
            row = pa.RecordBatch.from_pylist([{"shard": n, "n_docs": sum(map(len, ids)), "raw_bytes": len(body), "ids": pack(np.concatenate(ids)), "lengths": pack(np.concatenate(lengths)), "body": zstandard.ZstdCompressor(level=3).compress(body) if len(body) else b""}], schema=out)
            n, ids, parts, lengths, size = n + 1, [], [], [], 0
            return row

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            own = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in blocks(offsets, shard_bytes):
                if size and size + offsets[b] - offsets[a] > shard_bytes:
                    yield flush()
                ids.append(own[a:b])
                parts.append(data[offsets[a] : offsets[b]])
                lengths.append(np.diff(offsets[a : b + 1]))
                size += int(offsets[b] - offsets[a])
        if ids:
            yield flush()

    out = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("raw_bytes", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("body", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(frugal(cut), SHARD_SCHEMA), "shards", "uncompressed")


def range_bits(shards: DataFrame, keys_per_byte: float) -> int:
    """log2 of the number of key ranges, from the size of the corpus."""
    total = shards.agg(F.sum("raw_bytes")).first()[0] or 0
    return max(5, int(np.ceil(np.log2(max(1.0, total * keys_per_byte / RANGE_KEYS)))))


Send = Callable[[dict, dict], tuple[np.ndarray, ...]]


def split_ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of the non-empty ranges of sorted keys."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(top, prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(keys)], strict=False):
        yield int(top[a]), int(a), int(b)


def exchange(shards: DataFrame, send: Send, merge: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], bits: int, replies: dict[str, DataFrame], name: str) -> DataFrame:
    """One round: ``send`` gives, for a row of ``shards`` and its codes from earlier rounds, the sorted ``keys`` and per-key
    ``extra`` arrays; ``merge`` sees all keys of a range with their extras and gives a small code for each.  Returns (shard, codes): the codes of a shard's
    keys, range after range, in the order in which they were sent."""

    known = list(replies)

    def sent(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, *extra = send(row, {k: join_codes(row[k]) for k in known})
                rows = list(by_range(row["shard"], keys, extra, bits))
                if rows:
                    yield sent_rows(rows)

    return answers(with_replies(shards, replies).mapInArrow(frugal(sent), SENT), merge, name)


def by_range(shard: int, keys: np.ndarray, extra: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows of SENT for a shard's sorted keys."""
    for r, a, b in split_ranges(keys, bits):
        yield r, shard, pack_sorted(keys[a:b]), [pack(x[a:b]) for x in extra]


def sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    r, s, k, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.binary()), pa.array(x, pa.list_(pa.binary()))], ["range", "shard", "keys", "extra"])


#: What shards send: sorted keys of one range, and columns of values for each.
SENT = "range long, shard long, keys binary, extra array<binary>"


def answers(sent: DataFrame, merge: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], name: str) -> DataFrame:
    """(shard, codes) for what shards sent, see ``exchange``."""

    def merged(table: pa.Table) -> pa.Table:
        rows = table.select(["shard", "keys", "extra"]).to_pylist()
        parts = [unpack_sorted(r["keys"]) for r in rows]
        keys = np.concatenate(parts)
        extra = [np.concatenate([unpack(r["extra"][k]) for r in rows]) for k in range(len(rows[0]["extra"]))]
        codes = merge(keys, extra)
        edge = np.cumsum([0, *map(len, parts)])
        return pa.table({"shard": pa.array([r["shard"] for r in rows], pa.int64()), "range": pa.array([table["range"][0].as_py()] * len(rows), pa.int64()), "codes": pa.array([pack(codes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    out = sent.groupBy("range").applyInArrow(merged, "shard long, range long, codes binary")
    return stored(out.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("range", "codes"))).alias("codes")), name)


def with_replies(shards: DataFrame, replies: dict[str, DataFrame]) -> DataFrame:
    """Shards, each with its codes from earlier rounds."""
    for k, df in replies.items():
        shards = shards.join(df.withColumnRenamed("codes", k), "shard", "left")
    return shards


def join_codes(parts) -> np.ndarray:
    return np.concatenate([unpack(p["codes"]) for p in parts]) if parts else np.empty(0, np.int64)


def _runs(*sorted_by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each run, its size) of rows that agree in all columns."""
    order = np.lexsort(sorted_by[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in sorted_by:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.r_[first, len(order)])


def repeated_code(keys: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
    """1 where a key came from two shards or more, or from two documents of one (extra[0]); else 0."""
    order, first, size = _runs(keys)
    hit = (size > 1) | (np.maximum.reduceat(extra[0][order], first) > 0)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(hit, size)
    return out


def earlier_code(keys: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
    """1 where another shard has the key, and its second half extra[1], in a document with an id smaller than extra[0]."""
    order, first, size = _runs(keys, extra[1])
    own = extra[0][order]
    out = np.empty(len(keys), np.int64)
    out[order] = own > np.repeat(np.minimum.reduceat(own, first), size)
    return out


def distinct_with_docs(docs: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(place of each row among the distinct keys, the distinct keys, smallest document id of each, 1 where a key is in
    several documents)."""
    if not len(docs):
        return np.empty(0, np.int64), list(keys), np.empty(0, np.int64), np.empty(0, np.int64)
    order, first, size = _runs(*keys)
    own = docs[order]
    low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
    place = np.empty(len(docs), np.int64)
    place[order] = np.repeat(np.arange(len(first)), size)
    return place, [k[order][first] for k in keys], low, (low < high).astype(np.int64)
