"""Exact removal and near-duplicates against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from addrflow.llm import shards, suffix_dedup
from addrflow.llm.components import components
from addrflow.llm.near_dedup import near_duplicates
from addrflow.llm.substring_dedup import substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def removed(rows, window, units):
    """For each row: its units and a mask of those that windows of an earlier document cover."""
    first = {}
    for i, t in rows:
        u = units(t)
        for p in range(len(u) - window + 1):
            k = tuple(u[p : p + window])
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        u, gone = units(t), np.zeros(len(units(t)), bool)
        for p in range(len(u) - window + 1):
            if first[tuple(u[p : p + window])] < i:
                gone[p : p + window] = True
        yield i, u, gone


@pytest.mark.parametrize("window", [2, 13])
def test_words(docs, texts, window):
    want = sorted((i, len(u), int(g.sum()), hashlib.sha256(" ".join(w for w, x in zip(u, g) if not x).encode()).hexdigest()) for i, u, g in removed(texts, window, lambda t: WORD.findall(t or "")))
    assert sorted(map(tuple, substring_dedup(docs, window=window).collect())) == want


def test_bytes(docs, texts):
    def row(i, u, g):
        spans = int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0
        return i, len(u), int(g.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(u, g) if not y)).hexdigest()

    want = sorted(row(i, u, g) for i, u, g in removed(texts, 50, lambda t: (t or "").encode()))
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == want


def test_common_line(spark):
    """A line that every document holds, each with other text around it: its anchors are crowded."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrst "))
    draw = lambda n: "".join(rng.choice(letters, n))
    line, other = draw(150), draw(60)
    rows = [(i, draw(int(rng.integers(0, 90))) + line + draw(int(rng.integers(0, 90))) + (other if i % 3 else "")) for i in range(1500)]
    rows += [(5000 + i, "ab" * (40 + i)) for i in range(60)] + [(9000, rows[3][1]), (None, rows[4][1]), (9001, line), (9002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()}
    some = [(i if i is not None else 10**9, t) for i, t in rows]
    want = {i: (int(g.sum()), hashlib.sha256(bytes(x for x, y in zip(u, g) if not y)).hexdigest()) for i, u, g in removed(some, 50, lambda t: (t or "").encode())}
    want[None] = want.pop(10**9)
    assert got == want


def test_levels(spark):
    """Windows of many lengths, and a corpus in which nothing repeats."""
    from addrflow.llm.substring_dedup import _lengths

    assert _lengths(13) == [7, 13] and _lengths(50) == [7, 13, 25, 50] and _lengths(2) == [2]
    rng = np.random.default_rng(9)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    shared = [draw(n) for n in (12, 13, 30, 49, 50, 51, 120)]
    rows = [(i, " ".join(draw(20) + shared[i % 7] + draw(15) + shared[(i * 5 + 1) % 7])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (13, 50):
        got = {r.doc_id: r.n_removed for r in substring_dedup(df, window=window).collect()}
        assert got == {i: int(g.sum()) for i, _, g in removed(rows, window, str.split)} and any(got.values())
    alone = spark.createDataFrame([(i, " ".join(f"u{i}_{k}" for k in range(40))) for i in range(9)], "doc_id long, text string")
    assert {(r.n_words, r.n_removed) for r in substring_dedup(alone).collect()} == {(40, 0)}


def test_empty_tables(no_docs):
    for f in (substring_dedup, suffix_dedup.suffix_dedup, near_duplicates):
        assert f(no_docs).count() == 0


def test_null_ids(spark):
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.suffix_dedup(spark.createDataFrame([(None, "x" * 60), (1, "x" * 60), (1, "x" * 60)], "doc_id long, text string")).collect()) == [(0, 60), (1, 0), (1, 0)]
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd"
    df = spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(df).collect()} == {None: 30, 1: 0}
    assert {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()} == {(None, None, True), (1, 1, True)}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(40):
        x = rng.integers(97, 99, rng.integers(2, 150), dtype=np.uint8)
        b, sa = x.tobytes(), suffix_dedup.suffix_array(x, 12)
        pre = [b[i : i + 12] for i in sa]
        assert sorted(sa) == list(range(len(x))) and pre == sorted(pre)
        want = [0] + [next(k for k in range(13) if k == 12 or max(i, j) + k >= len(b) or b[i + k] != b[j + k]) for i, j in zip(sa[:-1], sa[1:])]
        assert suffix_dedup.common_prefixes(x, sa, 12).tolist() == want


@pytest.mark.parametrize("bits", [21, 9])
def test_arrays_merge(monkeypatch, bits):
    monkeypatch.setattr(suffix_dedup, "POSITION_BITS", bits)
    rng = np.random.default_rng(1)
    base = [rng.integers(97, 110, n, dtype=np.uint8) for n in (20, 90, 700)]
    texts = [np.concatenate([base[rng.integers(3)], rng.integers(97, 110, 9, dtype=np.uint8), base[rng.integers(3)]]) for _ in range(12)]
    by = rng.integers(0, 8, 12)
    least = {}
    for t, d in zip(texts, by):
        for p in range(len(t) - 7):
            k = t[p : p + 8].tobytes()
            least[k] = min(least.get(k, 99), d)
    for t, d, got in zip(texts, by, suffix_dedup.earlier_windows(texts, by, 8)):
        assert got.tolist() == [least[t[p : p + 8].tobytes()] < d for p in range(len(t) - 7)]


def test_packing_of_keys():
    for x in ([], [5], [-3, 7, 2**40], list(range(1000))):
        x = np.array(x, np.int64)
        assert shards.unpack(shards.pack(x)).tolist() == x.tolist()
    keys = np.sort(np.random.default_rng(2).integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    assert (shards.unpack_sorted(shards.pack_sorted(keys)) == keys).all()


def test_near_duplicates(docs, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(t):
        w = WORD.findall((t or "").translate(low))
        return frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, grams(t)) for i, t in texts]
    label = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = sorted((i, len(s), label[i], label[i] == i) for i, s in sets)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == want


def _components(rows, percent=75):
    """Components by brute force over sets of 5-word shingles."""
    sets = {i: frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_large_regions(spark):
    """A group of near copies far larger than a region."""
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i, k in enumerate(range(0, 100, 1))]
    rows += [(1000 + i, " ".join(f"y{i}_{k}" for k in range(30))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=8, deeper=16).collect()}
    assert {got[i] for i in range(100)} == {0} and all(got[1000 + i] == 1000 + i for i in range(20))


@pytest.mark.parametrize("share", [0.55, 0.72])
def test_links_inside_one_region(spark, share):
    """Documents of one source share most of their text without being links; pairs near 0.75 among them are all found,
    though every tree has them in a region that is cut."""
    rng = np.random.default_rng(int(100 * share))
    common = [f"c{k}" for k in range(300)]
    n = int(300 / (2 * share / (1 + share))) - 300
    rows = []
    for i in range(160):
        own = [f"o{i}_{k}" for k in range(n)]
        rows.append((2 * i, " ".join(common + own)))
        if i % 2:
            # The least similar text that is still a link, or one just below.
            m = len(common) + n - 4
            for cut in range(n):
                both = m - cut - 4
                if 100 * both < 75 * (2 * m - both):
                    break
            cut -= 1 + (i % 4 == 3)
            rows.append((2 * i + 1, " ".join(common + own[: n - cut] + [f"z{i}_{k}" for k in range(cut)])))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string"), region=8, deeper=16).collect()}
    want = _components([(int(i), t) for i, t in rows])
    assert got == want and len(set(want.values())) > 10


def test_neighbours_over_batches():
    """Regions of all sizes, cut into batches anywhere, against the definition."""
    from addrflow.llm.near_dedup import _neighbours

    def brute(region, node, n, part, most):
        out = set()
        for r in np.unique(region):
            at = np.flatnonzero(region == r)
            own = node[at].tolist()
            if len(own) > most or part[at[0]]:
                out |= {tuple(sorted(p)) for p in [*zip(own[:-1], own[1:]), *((own[0], b) for b in own[1:])]}
            else:
                out |= {tuple(sorted((int(node[x]), int(node[y])))) for x in at for y in at if x < y and 4 * min(n[x], n[y]) >= 3 * max(n[x], n[y])}
        return out

    rng = np.random.default_rng(1)
    for _ in range(100):
        m = int(rng.integers(1, 120))
        region, node, n = np.sort(rng.integers(0, rng.integers(1, 40), m)), rng.permutation(m), rng.integers(1, 9, m)
        cuts = np.unique(np.r_[0, rng.integers(0, m + 1, rng.integers(0, 9)), m])
        rows = [region, node, n, region % 3 == 0]
        batches = [pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in rows], ["region", "node", "n", "part"]) for a, b in zip(cuts[:-1], cuts[1:])]
        got = {p for b in _neighbours(5)(iter(batches)) for p in zip(*(b.column(k).to_pylist() for k in ("u", "v")))}
        assert got == brute(*rows, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}
