"""Packing of tokenised documents into sequences by vector best-fit: tokens, documents and attention cost at once."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import frugal
from .workspace import stored

#: Tokens of a sequence.
CAPACITY = 2048
#: Id that ends every document.
END_ID = 0
#: Pieces that one task packs together.  Each shard leaves about one sequence half filled.
SHARD_PIECES = 1 << 15
_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteTokens:
    """Token ids of whole texts under a byte-level BPE vocabulary.

    ``ranks_path`` is the same vocabulary as ranks; its encoder is several times faster and gives the same ids.  A text
    that its pattern engine gives up on (megabytes of one kind of character) goes to the tokenizer itself."""

    def __init__(self, tokenizer_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        special = {token.content: k for k, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt: each document's ids and the end id, cut only where they exceed
    ``capacity``; the first piece takes what is left over.  ``salt`` tells repeated rows apart."""

    @frugal
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, salt = ByteTokens(tokenizer_path, ranks_path), 0
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "")
                raw = np.append(ids, END_ID).astype("<u4").tobytes()
                total = len(ids) + 1
                edges = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            salts = pa.array(range(salt, salt + len(rows)), pa.int64())
            salt += len(rows)
            own = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), salts], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, f"{_COLUMNS}, salt long")


def best_fit(length: np.ndarray, capacity: int = CAPACITY, documents: int = CAPACITY, attention: float = float(CAPACITY) ** 2, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> np.ndarray:
    """The bin of each piece.  Bins hold at most ``capacity`` tokens, ``documents`` pieces and ``attention`` cost, the sum
    of squared lengths (a piece that alone costs more has a bin of its own).

    Pieces go in by falling length.  Of the bins with room for a piece in every respect, ``norm`` takes that with the
    least weighted norm of what stays free, ``dot`` that with the greatest weighted product of demand and free room; all
    are shares of the capacities, ties go to the older bin.  Equal lengths are placed together: under ``norm`` the chosen
    bin stays the best until it is full, under ``dot`` each bin takes one piece a turn."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule: {rule}")
    caps, weight = np.array([capacity, documents, attention], float), np.array(weights, float)
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(length), np.int64)
    free, name = np.empty((0, 3)), np.empty(0, np.int64)
    bins = at = 0
    while at < len(order):
        size = int(length[order[at]])
        end = at + int(np.searchsorted(-length[order[at:]], -size, "right"))
        need = np.array([size, 1, float(size) ** 2])
        # No later piece is longer, but later ones may be shorter: only bins that are full in some respect are closed.
        open_ = np.flatnonzero((free >= np.minimum(need, 1)).all(axis=1))
        free, name = free[open_], name[open_]
        while at < end:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                left, share = free[fits] / caps, need / caps
                score = (weight * (left - share) ** 2).sum(axis=1) if rule == "norm" else -(weight * left * share).sum(axis=1)
                best = fits[np.lexsort((name[fits], score))]
                room = np.floor(free[best] / need).min(axis=1).astype(np.int64) if rule == "norm" else np.ones(len(best), np.int64)
                taken = np.minimum(room, np.maximum(0, end - at - (np.cumsum(room) - room)))
                best, taken = best[taken > 0], taken[taken > 0]
                target = name[best]
                free[best] -= need * taken[:, None]
            else:
                # New bins, each filled with as many of these pieces as it holds.
                room = max(1, int(np.floor(caps / need).min()))
                count = -(-(end - at) // room)
                target, taken = np.arange(bins, bins + count), np.full(count, room)
                taken[-1] = end - at - room * (count - 1)
                bins += count
                free, name = np.concatenate([free, caps - need * taken[:, None]]), np.concatenate([name, target])
            place[order[at : at + int(taken.sum())]] = np.repeat(target, taken)
            at += int(taken.sum())
    return place


def vector_pack(pieces: DataFrame, capacity: int = CAPACITY, documents: int = CAPACITY, attention: float = float(CAPACITY) ** 2, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each piece a ``sequence_id`` and its ``offset`` there (gapless from 0), see ``best_fit``.

    Pieces are dealt into shards of about ``shard_pieces`` by hash, whatever the size of the table, and each shard is
    packed by one task; lengths mix alike in all shards, so that what packing apart costs is the last sequence of each."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(shards)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("salt", "ascending")]).combine_chunks()
        length = table["length"].to_numpy()
        place = best_fit(length, capacity, documents, attention, weights, rule)
        order = np.argsort(place, kind="stable")
        ahead = np.cumsum(length[order]) - length[order]
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        offset = np.empty(len(place), np.int64)
        offset[order] = ahead - np.repeat(ahead[first], np.diff(np.append(first, len(place))))
        sequence = table["shard"].to_numpy() * (1 << 32) + place
        return table.drop_columns(["salt", "shard"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("shard").applyInArrow(fill, f"{_COLUMNS}, sequence_id long, offset long")


def vector_pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Tokenise all rows and pack them into few sequences of at most ``capacity`` tokens (``limits``: see ``vector_pack``).

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is the
    end id alone.  Null and repeated ids are carried along, each row being a document of its own; an empty table gives no
    rows; other columns are ignored, whatever their names."""
    pieces = byte_pieces(docs, tokenizer_path, ranks_path, id_col, text_col, limits.get("capacity", CAPACITY))
    return vector_pack(stored(pieces, "pieces"), **limits)
