"""Removal of repeated byte strings by suffix arrays of anchor-range shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Rolling, blocks, byte_units, frugal, mix, sliding_min, window_ok
from .shards import NULL_ID, SENT, Shard, answers, by_range, distinct_with_docs, earlier_code, exchange, join_codes, make_shards, pack, pack_sorted, range_bits, split_ranges, unpack, unpack_sorted, with_replies
from .workspace import stored

#: Length of the anchors that stand for a window; a window holds window - ANCHOR + 1 of them.
ANCHOR = 16
#: Bits of a position in a suffix array; larger texts are cut into several, merged by binary search.
POSITION_BITS = 21
#: Bytes of whole documents hashed at a time.
BLOCK_BYTES = 1 << 20
#: Bytes of distinct pieces under one anchor from which on it is crowded: in one shard, and over all.
CROWDED_HERE, CROWDED = 16 << 10, 64 << 10
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- Suffix arrays ------------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (under 2**21 bytes) in the order of their first ``depth`` bytes or more.

    Larsson-Sadakane refinement: suffixes are sorted by five bytes, then groups of equal ones alone are sorted by the rank
    of the suffix h bytes on, which doubles the sorted length each time.  Group, next rank and position share one
    64-bit number, so a round is one plain sort."""
    n, bits = len(text), np.uint64(POSITION_BITS)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key << np.uint64(8) | padded[k : n + k]
    ordered = np.sort(key << bits | np.arange(n, dtype=np.uint64))
    mask = np.uint64((1 << POSITION_BITS) - 1)
    sa = (ordered & mask).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (ordered[1:] >> bits) != (ordered[:-1] >> bits)]) if n else np.empty(0, np.int64)
    size = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, size)
    slots = np.flatnonzero(np.repeat(size, size) > 1)
    h = 5
    while len(slots) and h < depth:
        at = sa[slots]
        ahead = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        ordered = np.sort(rank[at].astype(np.uint64) << np.uint64(2 * POSITION_BITS) | ahead.astype(np.uint64) << bits | at.astype(np.uint64))
        at = (ordered & mask).astype(np.int64)
        sa[slots] = at
        first = np.r_[True, (ordered[1:] >> bits) != (ordered[:-1] >> bits)]
        size = np.diff(np.r_[np.flatnonzero(first), len(slots)])
        rank[at] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size, size) > 1]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each place in the suffix array: length of the prefix in common with the suffix before it, up to ``limit``.

    Kasai's rule, in text order: the common prefix at position i is at most one shorter than at i - 1.  Every eighth
    position is compared from the start, the others only from that bound.  (Suffixes equal up to the limit are not sorted
    among themselves, so a length at the limit bounds nothing.)"""
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    length = np.zeros(n, np.int64)

    def extend(at: np.ndarray) -> None:
        at = at[before[at] >= 0]
        while len(at):
            i, j = at + length[at], before[at] + length[at]
            ok = (length[at] < limit) & (i < n) & (j < n)
            at, i, j = at[ok], i[ok], j[ok]
            same = text[i] == text[j]
            at = at[same]
            length[at] += 1

    extend(np.arange(0, n, 8))
    for k in range(1, 8):
        at = np.arange(k, n, 8)
        before_last = length[at - 1]
        length[at] = np.where((before[at] >= 0) & (before_last > 0) & (before_last < limit), before_last - 1, 0)
        extend(at)
    out[:] = length[sa]
    return out


def _sorted_windows(text: np.ndarray, start: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each start, a position of each group's string, its least document) by one suffix array; groups are in
    the order of their strings."""
    sa = suffix_array(text, window)
    run = np.cumsum(common_prefixes(text, sa, window) < window)
    of = np.empty(len(text), np.int64)
    of[sa] = run
    raw = of[start]
    values, group = np.unique(raw, return_inverse=True)
    least = np.full(len(values), NULL_ID)
    np.minimum.at(least, group, docs)
    place = np.empty(len(values), np.int64)
    place[group] = start
    return group, place, least


def _strings(text: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """The windows at these places as fixed-width strings that numpy can search."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, window)[place]).view(f"S{window}").ravel()


def earlier_windows(texts: list[np.ndarray], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text: whether each of its windows also starts in a text with a smaller document id.

    Texts are put into shards of under 2**POSITION_BITS bytes, each with its own suffix array.  Shards are merged by
    binary search of their sorted distinct windows, so a window's least document holds over all of them."""
    room, shards, size = (1 << POSITION_BITS) - 64, [[]], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > room:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(t)
    # One text longer than a shard is cut into overlapping parts.
    cut: list[tuple[int, int, np.ndarray]] = []
    groups: list[list[int]] = []
    for own in shards:
        groups.append([])
        for i in own:
            for a in range(0, max(1, len(texts[i]) - window + 1), room - window):
                if a and len(groups[-1]):
                    groups.append([])
                groups[-1].append(len(cut))
                cut.append((i, a, texts[i][a : a + room - 1]))
    done = []
    for own in groups:
        text = np.concatenate([cut[k][2] for k in own]) if own else np.empty(0, np.uint8)
        edge = np.cumsum([0, *(len(cut[k][2]) for k in own)])
        count = np.array([max(0, len(cut[k][2]) - window + 1) for k in own], np.int64)
        start = np.repeat(edge[:-1] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        by = np.repeat(docs[[cut[k][0] for k in own]], count)
        group, place, least = _sorted_windows(text, start, by, window) if len(start) else (start, start, start)
        done.append([own, count, group, by, least, _strings(text, place, window) if len(groups) > 1 and len(start) else None])
    if len(groups) > 1:
        for x in done:
            for y in done:
                if x is not y and x[5] is not None and y[5] is not None:
                    at = np.minimum(np.searchsorted(y[5], x[5]), len(y[5]) - 1)
                    x[4] = np.where(y[5][at] == x[5], np.minimum(x[4], y[4][at]), x[4])
    out = [np.zeros(max(0, len(t) - window + 1), bool) for t in texts]
    for own, count, group, by, least, _ in done:
        hit = least[group] < by if len(group) else np.empty(0, bool)
        lo = 0
        for k, c in zip(own, count.tolist(), strict=True):
            i, a, _ = cut[k]
            out[i][a : a + c] |= hit[lo : lo + c]
            lo += c
    return out


# --- Pieces: runs of windows with one anchor ------------------------------------------------------------------------------


def _second(data: np.ndarray) -> np.ndarray:
    """Units of a second hash, independent of the first one's."""
    return mix(byte_units(data) ^ np.uint64(0xD6E8FEB86659FD93))


class _Pieces:
    """The pieces of a shard, by anchor, then text, then document: the first of each text stands for the others.

    Every window belongs to the least hash among its anchors; a piece is a run of windows with the same."""

    def __init__(self, row: dict, window: int):
        self.shard, self.window = Shard(row), window
        offsets, anchor = self.shard.offsets, min(ANCHOR, window)
        parts = [np.empty((4, 0), np.uint64)]
        for lo, hi in blocks(offsets, BLOCK_BYTES):
            base = int(offsets[lo])
            own = offsets[lo : hi + 1] - base
            text = self.shard.data[base : base + own[-1]]
            at = np.flatnonzero(window_ok(own, window))
            if not len(at):
                continue
            # Least hashes are small numbers: mixed again, they fill the key ranges evenly.
            value = mix(sliding_min(Rolling(byte_units(text)).windows(anchor), window - anchor + 1)[at])
            of = np.searchsorted(own, at, "right") - 1
            new = np.r_[True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])]
            start = at[new]
            count = np.diff(np.r_[np.flatnonzero(new), len(at)])
            whole = Rolling(_second(text)).spans(start, start + count + window - 1)
            parts.append(np.stack([(start + base).astype(np.uint64), count.astype(np.uint64), value[new], whole]))
        start, count, key, whole = np.concatenate(parts, axis=1)
        self.start, self.windows, whole = start.astype(np.int64), count.astype(np.int64), whole.view(np.int64)
        self.end = self.start + self.windows + window - 1
        doc = self.shard.ids[np.searchsorted(self.shard.offsets, self.start, "right") - 1]
        self.order = np.lexsort((self.start, doc, whole, key))
        k, w, self.docs = key[self.order], whole[self.order], doc[self.order]
        first = np.r_[True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])] if len(k) else np.empty(0, bool)
        self.first, self.group = np.flatnonzero(first), np.cumsum(first) - 1
        self.key, self.whole, self.least = k[first], w[first], self.docs[first]
        self.lead = self.order[self.first]
        self.bytes = self.end[self.lead] - self.start[self.lead]
        # Of an anchor that is crowded in this shard alone, only that is told.
        head = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.empty(0, np.int64)
        many = np.diff(np.r_[head, len(self.key)])
        self.here = np.repeat(np.add.reduceat(self.bytes, head) > CROWDED_HERE, many) if len(head) else np.empty(0, bool)
        self.sent = ~self.here
        self.sent[head] = True

    def tell(self) -> tuple[np.ndarray, ...]:
        """(anchor, hash of the text, least document, bytes) of each distinct piece, or of a crowded anchor."""
        here = self.here[self.sent]
        return self.key[self.sent], np.where(here, 0, self.whole[self.sent]), np.where(here, NULL_ID, self.least[self.sent]), np.where(here, CROWDED + 1, self.bytes[self.sent])

    def learn(self, code: np.ndarray) -> None:
        """Take in the answer: ``code`` of each distinct piece."""
        self.code = code[np.cumsum(self.sent) - 1] if len(self.sent) else np.empty(0, np.int64)
        self.crowded = self.code & 4 > 0
        # Distinct pieces that must be compared window by window: others have their anchor with another text, and no
        # earlier document has the same text.
        self.open = np.flatnonzero(self.code & 7 == 2)

    def windows_of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each window, which of ``pieces`` it is in)."""
        n = self.windows[pieces]
        which = np.repeat(np.arange(len(pieces)), n)
        return self.start[pieces][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which

    def crowded_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Of the windows under crowded anchors: start, document, place among the distinct ones, these as two 64-bit hashes,
        and their least document here."""
        every = np.flatnonzero(self.crowded[self.group]) if len(self.group) else np.empty(0, np.int64)
        at, which = self.windows_of(self.order[every])
        docs = self.docs[every][which]
        if not len(at):
            return at, docs, at, [np.empty(0, np.uint64), np.empty(0, np.int64)], at
        h, g = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for lo, hi in blocks(self.shard.offsets, BLOCK_BYTES):
            a, b = self.shard.offsets[lo], self.shard.offsets[hi]
            own = np.flatnonzero((at >= a) & (at < b))
            if len(own):
                text = self.shard.data[a:b]
                h[own] = Rolling(byte_units(text)).windows(self.window)[at[own] - a]
                g[own] = Rolling(_second(text)).windows(self.window)[at[own] - a]
        place, keys, low, _ = distinct_with_docs(docs, h, g.view(np.int64))
        return at, docs, place, keys, low


def _piece_code(keys: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
    """Bit 0: another shard has the same piece in an earlier document.  Bit 1: its anchor occurs with other texts too.
    Bit 2: the anchor is crowded."""
    whole, docs, size = extra
    order = np.lexsort((whole, keys))
    k, w, d = keys[order], whole[order], docs[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new = new_key | np.r_[True, w[1:] != w[:-1]]
    at = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(d, at), np.diff(np.r_[at, len(k)]))
    of_key = np.flatnonzero(new_key)
    times = np.diff(np.r_[of_key, len(k)])
    texts = np.repeat(np.add.reduceat(new.astype(np.int64), of_key), times)
    total = np.repeat(np.add.reduceat(size[order], of_key), times)
    out = np.empty(len(keys), np.int64)
    out[order] = (d > least) | (texts > 1).astype(np.int64) << 1 | (total > CROWDED).astype(np.int64) << 2
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Remove each byte that a string of ``window`` bytes covers which also starts in an earlier document.

    1. Documents are stored as shards.  Each window belongs to its least 16-byte anchor hash, so equal windows meet under
       one anchor wherever they occur.  Shards exchange (anchor, hash of the piece around it); a piece whose whole text is
       in an earlier document is removed at once (128 bits of two independent hashes must agree), and one whose anchor
       occurs with the same text only, or nowhere else, needs nothing more.
    2. The texts of the other pieces go to shards of anchor ranges.  A suffix array (Larsson-Sadakane refinement) with
       Kasai common prefixes finds equal windows there; arrays of one range are merged by binary search.
    3. Under an anchor with more than CROWDED bytes of distinct pieces (a line that many documents hold, each with other
       text around it) every window stands for itself: shards exchange their distinct windows by two hashes, so such an
       anchor is spread over all ranges, and a shard sends each of its windows once, however often it holds it.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row for each input row.  Null text counts as empty.
    Rows that share a doc_id never remove each other's bytes; a null doc_id counts as larger than all others.  Texts under
    ``window`` bytes lose nothing.  Other columns are ignored.
    """
    shards = make_shards(docs, id_col, text_col)

    def ask(row: dict, known: dict):
        return _Pieces(row, window).tell()

    codes = exchange(shards, ask, _piece_code, range_bits(shards, 0.06), {}, "pieces")

    bits, window_bits = range_bits(shards, 0.25), range_bits(shards, 0.1)

    def send(batches):
        """Rows with texts of open pieces, and rows without, with the windows under crowded anchors."""
        for batch in batches:
            for row in batch.to_pylist():
                p = _Pieces(row, window)
                p.learn(join_codes(row["pieces"]))
                wanted = p.open
                key, start, end = p.key[wanted], p.start[p.lead[wanted]], p.end[p.lead[wanted]]
                rows = []
                for r, a, b in split_ranges(key, bits):
                    body = b"".join(p.shard.data[x:y].tobytes() for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True))
                    rows.append((r, row["shard"], pack_sorted(key[a:b]), [pack(p.least[wanted[a:b]]), pack(end[a:b] - start[a:b])], zstandard.ZstdCompressor(level=1).compress(body)))
                _, _, _, (keys, second), low = p.crowded_windows()
                rows += [(*x, None) for x in by_range(row["shard"], keys, [low, second], window_bits)]
                if rows:
                    r, s, k, x, body = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.binary()), pa.array(x, pa.list_(pa.binary())), pa.array(body, pa.binary())], ["range", "shard", "keys", "extra", "body"])

    sent = stored(with_replies(shards, {"pieces": codes}).mapInArrow(frugal(send), f"{SENT}, body binary"), "sent", "uncompressed")
    spread = answers(sent.where("body IS NULL").drop("body"), earlier_code, "windows")

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([unpack_sorted(r["keys"]) for r in rows])
        by = np.concatenate([unpack(r["extra"][0]) for r in rows])
        texts: list[np.ndarray] = []
        for r in rows:
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["body"]), np.uint8)
            edge = np.cumsum(np.r_[0, unpack(r["extra"][1])])
            texts += [data[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        # Pieces of one anchor lie together, so that few arrays need merging.
        order = np.argsort(keys, kind="stable")
        hits = earlier_windows([texts[i] for i in order], by[order], window)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out, lo = [], 0
        for r in rows:
            n = len(unpack(r["extra"][1]))
            own = np.concatenate([hits[place[i]] for i in range(lo, lo + n)])
            out.append(zstandard.ZstdCompressor(level=1).compress(np.packbits(own).tobytes()))
            lo += n
        return pa.table({"shard": pa.array([r["shard"] for r in rows], pa.int64()), "range": pa.array([r["range"] for r in rows], pa.int64()), "hits": pa.array(out, pa.binary())})

    hits = sent.where("body IS NOT NULL").groupBy("range").applyInArrow(compare, "shard long, range long, hits binary")
    hits = stored(hits.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("range", "hits"))).alias("codes")), "hits")

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = _Pieces(row, window)
                p.learn(join_codes(row["pieces"]))
                delta = np.zeros(len(p.shard.data) + 1, np.int32)

                def cover(start: np.ndarray, end: np.ndarray, delta=delta) -> None:
                    np.add.at(delta, start, 1)
                    np.add.at(delta, end, -1)

                # Whole pieces: in a later document of this shard than the first, or anywhere after another shard's.
                whole = ((p.docs > p.least[p.group]) | (p.code[p.group] & 1 > 0)) & ~p.crowded[p.group]
                at = p.order[whole]
                cover(p.start[at], p.end[at])
                # Windows under crowded anchors.
                at, docs, place, _, low = p.crowded_windows()
                if len(at):
                    at = at[(docs > low[place]) | (join_codes(row["spread"])[place] > 0)]
                    cover(at, at + window)
                # Windows of the others that were compared.
                lead = p.lead[p.open]
                twins = np.diff(np.r_[p.first, len(p.order)])
                reply = {x["range"]: x["hits"] for x in row["hits"] or []}
                for r, a, b in split_ranges(p.key[p.open], bits):
                    start, which = p.windows_of(lead[a:b])
                    hit = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(reply[r]), np.uint8), count=len(start)).astype(bool)
                    cover(start[hit], start[hit] + window)
                    # The same text again in this document, or in rows that share its id: the same windows are removed.
                    for g in np.flatnonzero(twins[p.open[a:b]] > 1):
                        lo = p.first[p.open[a + g]]
                        again = slice(lo + 1, lo + twins[p.open[a + g]])
                        inner = start[hit & (which == g)] - p.start[lead[a + g]]
                        for t in p.order[again][p.docs[again] == p.least[p.open[a + g]]]:
                            cover(p.start[t] + inner, p.start[t] + inner + window)
                yield _digest(p.shard, np.cumsum(delta[:-1]) > 0)

    return with_replies(shards, {"pieces": codes, "spread": spread, "hits": hits}).mapInArrow(frugal(finish), SCHEMA)


def _digest(shard: Shard, gone: np.ndarray) -> pa.RecordBatch:
    edge = shard.offsets
    total = np.r_[0, np.cumsum(gone)]
    begin = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
    inner = edge[(edge > 0) & (edge < len(gone))]
    begin[inner] = gone[inner]
    spans = np.r_[0, np.cumsum(begin)]
    kept = np.r_[0, np.cumsum(~gone)][edge]
    raw = memoryview(np.ascontiguousarray(shard.data[~gone]))
    sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
    ids = pa.array(shard.ids, pa.int64(), mask=shard.ids == NULL_ID)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(np.diff(x), pa.int64()) for x in (edge, total[edge], spans[edge])), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
