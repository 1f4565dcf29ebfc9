"""Whitening, hard negatives and vector best-fit packing."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from addrflow.llm import hard_negatives as hn
from addrflow.llm import vector_packing as vp
from addrflow.llm import whitening as wh

VECTORS = "vec_id long, embedding array<float>, label int, key int, x string, block int"
BYTES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) * np.linspace(1, spread, d)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def table(spark, v, ids=None, labels=None, extra=()):
    ids = range(len(v)) if ids is None else ids
    labels = [k % 3 for k in range(len(v))] if labels is None else labels
    rows = [(i, [float(c) for c in x], la, 1, "x", 2) for i, x, la in zip(ids, v, labels, strict=True)]
    return spark.createDataFrame([*rows, *extra], VECTORS).repartition(3)


ODD = [(900, None, 1, 0, "", 0), (901, [1.0, None, 0.5], 1, 0, "", 0), (902, [float("nan"), 1.0, 0.0], 1, 0, "", 0), (903, [float("inf"), 1.0, 0.0], 1, 0, "", 0)]


def plain_whitening(v):
    """Brute force in exact integers, then a plain eigendecomposition."""
    x = np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000
    n = len(x)
    s = x.sum(axis=0)
    y = (n * x - s) / n
    e, w = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x - s) ** 2).sum(axis=1), e[::-1], y @ w[:, ::-1], e.sum()


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_equals_brute_force(spark, d):
    v = vectors(1, 300, d, 3.0)
    odd = [(i, None if x is None else x[: min(3, d)], *rest) for i, x, *rest in ODD]
    got = defaultdict(dict)
    for r in wh.whiten(table(spark, v, extra=odd)).collect():
        got[r.vec_id][r.component] = r
    n, deviation, e, z, total = plain_whitening(v)
    assert set(got) == set(range(300))
    top = min(32, d)
    white = np.array([[got[i][c].whitened for c in range(1, top + 1)] for i in range(300)])
    for c in range(top):
        want = z[:, c] / math.sqrt(e[c])
        assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < 1e-9
        assert math.isclose(got[0][c + 1].explained, e[c] / total, rel_tol=1e-10)
    assert all(got[i][1].deviation == deviation[i] and got[i][1].n == n for i in range(300))
    assert got[0][1].identity_error < 1e-10
    assert len({r.identity_error for by in got.values() for r in by.values()}) == 1


def test_whitening_keeps_small_directions(spark):
    """Spreads over ten orders: a covariance matrix would lose the small ones."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=400) * 1e9, rng.normal(size=400) * 10, rng.integers(0, 2, 400) + 0.0], axis=1)
    rows = [(k, [float(c) for c in row], 0) for k, row in enumerate(x / 64)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    white = np.array([[r.whitened for r in sorted(g, key=lambda r: r.component)] for g in _by(got.collect(), "vec_id").values()])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(3)).max() < 1e-6


def _by(rows, name):
    out = defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out


def test_whitening_without_full_rank(spark):
    v = vectors(5, 50, 4)
    v = np.concatenate([v, v[:, :1], np.full((50, 1), 0.5, np.float32)], axis=1)  # a repeated and a constant dimension
    rows = wh.whiten(table(spark, v)).collect()
    white = {c: [r.whitened for r in rs] for c, rs in _by(rows, "component").items()}
    assert sorted(white) == [1, 2, 3, 4, 5, 6]
    assert all(w is not None for c in (1, 2, 3, 4) for w in white[c]) and all(w is None for c in (5, 6) for w in white[c])
    assert rows[0].identity_error < 1e-9
    one = wh.whiten(table(spark, v[:1])).collect()
    assert len(one) == 6 and one[0].deviation == 0 and one[0].whitened is None
    assert wh.whiten(table(spark, v[:0], labels=[], extra=ODD)).count() == 0


def test_whitening_of_short_long_and_repeated_vectors(spark):
    rows = [(1, [1.0, 2.0], 0, 0, "", 0), (1, [1.0, 2.0], 0, 0, "", 0), (None, [3.0], None, None, None, None), (2, [], 0, 0, "", 0), (3, [1e30, -1e30], 0, 0, "", 0)]
    got = wh.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 10 and {r.n for r in got} == {5}
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == ["1", "1", "2", "3", "None"]


def test_triangular_solve():
    rng = np.random.default_rng(0)
    r = np.triu(rng.normal(size=(6, 6))) + 6 * np.eye(6)
    y = rng.normal(size=(9, 6))
    assert np.allclose(wh.solve_rows(y, r) @ r, y)


def plain_negatives(rows, every=50):
    """Brute force over all pairs."""
    good = [(i, la, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v, la in rows if la is not None and i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for p, (i, la, x) in enumerate(good):
        if i % every:
            continue
        scored = [(-int(x @ y), j, lb, q) for q, (j, lb, y) in enumerate(good) if q != p]
        for s, j, _, _ in sorted(t for t in scored if t[2] == la)[:5]:
            fit = sorted(t for t in scored if t[2] != la and 50 * -s <= 100 * -t[0] <= 95 * -s)[:3]
            out += [(i, j, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["spread", "clustered", "lengths", "few labels"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(hn, "BUCKET", 64)
    monkeypatch.setattr(hn, "LEAST_SLICE", 100)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 5)
    rng = np.random.default_rng(7)
    v = vectors(2, 400, 8)
    labels = [int(x) for x in rng.integers(0, 4, 400)]
    if shape == "clustered":
        v = (vectors(9, 6, 8)[rng.integers(0, 6, 400)] + 0.05 * v).astype(np.float32)
        v[100:140] = v[100]  # a group of equal vectors: ties everywhere
    if shape == "lengths":
        v = (v * np.exp(2 * rng.normal(size=(400, 1)))).astype(np.float32)
        v[5] = 0
    if shape == "few labels":
        labels = [0] * 390 + [k for k in range(10)]
    ids = [int(x) for x in rng.permutation(400) * 5]
    odd = [(i, None if x is None else x[:3], la, *rest) for i, x, la, *rest in ODD] + [(None, [1.0] * 8, 1, 0, "", 0), (950, [1.0] * 8, None, 0, "", 0)]
    got = hn.hard_negatives(table(spark, v, ids, labels, odd))
    rows = [*zip(ids, v.tolist(), labels, strict=True), *(r[:3] for r in odd)]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_repeated_rows_and_empty_tables(spark):
    v = vectors(4, 30, 4)
    rows = [(0, v[k].tolist(), k % 2) for k in range(4)] + [(0, v[0].tolist(), 0)] * 2 + [(k, v[k].tolist(), k % 2) for k in range(4, 30)]
    got = hn.hard_negatives(spark.createDataFrame([(*r, 0, "", 0) for r in rows], VECTORS), anchor=F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert hn.hard_negatives(table(spark, v[:0], labels=[], extra=ODD)).count() == 0


def test_coordinate_ranges_rule_rows_out():
    """Nothing feasible is lost, and in clustered data most rows are never verified."""
    rng = np.random.default_rng(1)
    centres = vectors(11, 20, 16)
    x = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + 0.02 * rng.normal(size=(4000, 16))))
    norm = (x * x).sum(axis=1)
    order = np.argsort(-norm)
    x, norm = x[order], norm[order]
    n = np.arange(len(x))
    label = rng.integers(0, 5, len(x))
    own = n[::40]
    bound = np.full((len(own), 1), 1) * (0.8 * norm[own, None]).astype(np.int64)
    s = hn.Search(n[own], label[own], norm[own], x[own], bound, np.full_like(bound, 2**60), 5, True)
    for a in range(0, len(x), 500):
        b = slice(a, a + 500)
        s.add(n[b], n[b], label[b], norm[b], x[b])
    scores = (x[own] @ x.T).astype(np.int64)
    want = set()
    for k, i in enumerate(own):
        fit = [j for j in n if j != i and label[j] == label[i] and scores[k, j] >= bound[k, 0]]
        want |= {(k, j) for j in sorted(fit, key=lambda j: (-scores[k, j], j))[:5]}
    assert {(int(a), int(k)) for a, k in zip(s.found[0][0], s.found[0][3], strict=True)} == want
    assert s.stats["verified"] < 0.3 * s.stats["pairs"]


def packed_rows(spark, docs, **limits):
    return vp.vector_pack_documents(docs, *BYTES, **limits).collect()


def test_vector_packing_round_trip(spark, docs, texts, no_docs):
    rows = packed_rows(spark, docs)
    tokenizer = Tokenizer.from_file(BYTES[0])
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    for i, own in _by(rows, "doc_id").items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.piece) for r in own)
        expected = []
        for ids in want[i]:
            edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            expected += [(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), k) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        assert pieces == sorted(expected)
    assert sum(r.length for r in rows) == sum(len(ids) for many in want.values() for ids in many)
    gapless(rows, 2048)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packed_rows(spark, no_docs) == []


def gapless(rows, capacity):
    for own in _by(rows, "sequence_id").values():
        at = 0
        for r in sorted(own, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_vector_packing_of_odd_rows(spark):
    """Nulls everywhere, a special token's string, runs that the rank encoder gives up on, clashing columns."""
    long = " " * 1_200_000 + "x"
    rows = [(None, None, 1, 2), (None, "a <|endoftext|> b", 1, 2), (7, long, 1, 2), (8, " \n word　　x", None, None), (9, "", 1, 2)]
    got = packed_rows(spark, spark.createDataFrame(rows, "doc_id long, text string, shard int, salt int"))
    tokenizer = Tokenizer.from_file(BYTES[0])
    assert sum(r.length for r in got) == sum(1 + len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows)
    crc = {r.ids_crc32 for r in got if r.doc_id in (None, 8)}
    assert crc == {zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t, _, _ in rows if i in (None, 8)}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    length = np.random.default_rng(2).integers(1, 2049, 5000)
    length[:1500] = np.random.default_rng(3).integers(1, 60, 1500)
    for documents, attention in ((2048, 2048.0**2), (6, 2048.0**2), (2048, 1.5e6), (4, 1.2e6)):
        place = vp.best_fit(length, 2048, documents, attention, rule=rule)
        count = np.bincount(place)
        assert np.bincount(place, length).max() <= 2048 and count.max() <= documents and (count > 0).all()
        cost = np.bincount(place, length.astype(float) ** 2)
        assert (cost[count > 1] <= attention).all()
    few = vp.best_fit(length, rule=rule).max() + 1
    assert few <= 1.002 * max(-(-int(length.sum()) // 2048), int((length > 1024).sum()))


def test_best_fit_equals_one_by_one():
    """Placing equal lengths together is the same as the plain rule, piece by piece."""
    length = np.random.default_rng(5).integers(1, 41, 300) * 20
    caps, weight = np.array([2048, 9, 1.6e6]), np.array([1.0, 0.01, 0.01])
    bins, want = [], np.empty(len(length), np.int64)
    for p in np.argsort(-length, kind="stable"):
        need = np.array([length[p], 1, float(length[p]) ** 2])
        fits = [b for b in range(len(bins)) if (bins[b] >= need).all()]
        if fits:
            b = min(fits, key=lambda b: ((weight * ((bins[b] - need) / caps) ** 2).sum(), b))
        else:
            bins.append(caps.copy())
            b = len(bins) - 1
        bins[b] = bins[b] - need
        want[p] = b
    got = vp.best_fit(length, 2048, 9, 1.6e6)
    assert np.array_equal(np.sort(np.bincount(got, length)), np.sort(np.bincount(want, length)))
