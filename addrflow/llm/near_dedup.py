"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, Rolling, blocks, byte_units, frugal, mix, text_bytes, words
from .components import components
from .workspace import stored

#: MinHash functions, trees of the forest, hashes a tree's order uses, and of them the fewest that candidates share.
HASHES, TREES, DEPTH, MIN_DEPTH = 64, 16, 6, 2
#: A region of at most so many documents gives all its pairs as candidates; a larger one is cut by its next hashes where it
#: has more than the second number, and what the forest then leaves open is found by an exact join.
REGION, DEEPER = 48, 4096
#: Least share of equal signature parts of a candidate that is looked at: 5.8 standard errors below 0.75.
LEAST_EQUAL = 28 / 64
#: Shingles held by many documents that the exact join puts last in its order, at most; any order gives the same links.
COMMON = 1 << 16
_BLOCK = 2 << 20
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
#: The order in which each tree reads the signature.
ORDER = np.stack([(np.arange(DEPTH) * 17 + t * MIN_DEPTH + (np.arange(DEPTH) // MIN_DEPTH) * t) % HASHES for t in range(TREES)])
ORDER[:, :MIN_DEPTH] = np.arange(TREES * MIN_DEPTH).reshape(TREES, MIN_DEPTH)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, offsets by row), repeats included; a row of fewer than ``width`` words is one shingle."""
    data = LOWER[data]
    start, end, rows = words(data, offsets)
    roll = Rolling(Rolling(byte_units(data)).spans(start, end))
    n = np.diff(rows)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(rows[:-1] - edge[:-1], count) + np.arange(edge[-1])
    last = first + np.repeat(np.minimum(n, width), count)
    return roll.spans(first, last), edge


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, _BLOCK):
                h, edge = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                full = np.flatnonzero(np.diff(edge))
                size, k1, k2 = (np.zeros(b - a, t) for t in (np.int64, np.uint64, np.uint64))
                for i in full:
                    x = np.unique(h[edge[i] : edge[i + 1]])
                    size[i], k1[i], k2[i] = len(x), x.sum(dtype=np.uint64), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                low = np.zeros((HASHES, b - a), np.uint32)
                if len(full):
                    for j in range(HASHES):
                        low[j, full] = np.minimum.reduceat(((h * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), edge[full])
                sig = np.ascontiguousarray(low.T)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "signature"])

    return run


def _branches(batches):
    """One row for each tree and document: the hashes of the tree's order, two to a column."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        n = len(sig)
        for t in range(TREES):
            o = sig[:, ORDER[t]]
            p = [(o[:, k] << np.uint64(32) | o[:, k + 1]).view(np.int64) for k in range(0, DEPTH, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in p), batch.column("node"), batch.column("n")], ["tree", "p1", "p2", "p3", "node", "n"])


def _all_pairs(node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.triu_indices(len(node), 1)
    ok = 4 * np.minimum(size[a], size[b]) >= 3 * np.maximum(size[a], size[b])
    return node[a[ok]], node[b[ok]]


def _neighbours(most: int):
    """Candidate pairs from rows in the forest's order: all pairs of a small region; in a large one, or a part of one, each
    document's neighbour, which shares the longest prefix, and the region's first.

    At most ``most`` rows of a region are held from one batch to the next, then only its first and last."""

    def run(batches):
        held, first, last = None, None, None  # rows of a region still small; first and last node of one that is large
        for batch in batches:
            rows = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("region", "node", "n", "part")]
            u, v = [], []
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            region, node, size, part = rows
            edges = np.r_[0, np.flatnonzero(np.diff(region)) + 1, len(region)] if len(region) else np.zeros(1, np.int64)
            # Regions of one document have nothing to pair, but the first and last may go on over the batch's edges.
            several = np.diff(edges) > 1
            several[:1] = several[-1:] = True
            for lo, hi in zip(edges[:-1][several].tolist(), edges[1:][several].tolist(), strict=True):
                own = node[lo:hi]
                if first is not None and first[0] != region[lo]:
                    first = None
                if first is not None:
                    u += [np.r_[last, own[:-1]], np.full(hi - lo, first[1])]
                    v += [own, own]
                    last = own[-1]
                elif hi - lo > most or part[lo]:
                    u += [own[:-1], np.full(hi - lo - 1, own[0])]
                    v += [own[1:], own[1:]]
                    first, last = (region[lo], own[0]), own[-1]
                elif hi < len(region):
                    x, y = _all_pairs(own, size[lo:hi])
                    u.append(x)
                    v.append(y)
            held = None if first is not None else [x[edges[-2] :] for x in rows] if len(region) else None
            yield _pair_batch(u, v)
        if held is not None:
            x, y = _all_pairs(held[1], held[2])
            yield _pair_batch([x], [y])

    return run


def _pair_batch(u: list, v: list) -> pa.RecordBatch:
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v))
    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1)[u != v], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["u", "v"])


def _dealt(forest: DataFrame, crowded: DataFrame, deeper: int) -> DataFrame:
    """(region, part, p2, p3, n, node): the forest's rows by region; ``part`` marks those of a region that was cut.

    Adaptive depth: a region in ``crowded`` is dealt by four hashes, and where these have over ``deeper`` documents by six, in
    salted parts of about ``deeper``; so no region goes to one task whole, however large."""
    own = ["tree", "p1"]
    inside = forest.join(crowded, own, "left")
    deep = inside.where("c2 IS NOT NULL")
    c4 = deep.groupBy(*own, "p2").agg(F.count("*").alias("c4")).where(f"c4 > {deeper}")
    c6 = deep.join(c4, [*own, "p2"], "left_semi").groupBy(*own, "p2", "p3").agg(F.count("*").alias("c6"))
    deep = deep.join(c6, [*own, "p2", "p3"], "left")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("c6") / deeper))
    key = F.when(F.col("c6").isNull(), F.xxhash64(*own, "p2", F.lit(4))).otherwise(F.xxhash64(*own, "p2", "p3", salt))
    keep = ["p2", "p3", "n", "node"]
    whole = inside.where("c2 IS NULL").select(F.xxhash64(*own).alias("region"), F.lit(False).alias("part"), *keep)
    return whole.unionByName(deep.select(key.alias("region"), F.lit(True).alias("part"), *keep))


# --- Exact join of what large regions leave open -------------------------------------------------------------------------


def _frequent(batches):
    """Shingles that occur in two sets of a batch or more, with their counts."""
    for batch in batches:
        if batch.num_rows:
            values, count = np.unique(np.concatenate([_undo(x) for x in batch.column(0).to_pylist()]), return_counts=True)
            many = count > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(count[many])], ["token", "n"])


def _prefixes(common: np.ndarray, order: np.ndarray, percent: int):
    """Rows (token, at, own, node, n, component) of each set's prefix, rare shingles first: those in ``common`` come last, by
    ``order``.

    Of sets x and y, y not larger, with a similarity of t or more, the first |x| - ceil(t |x|) + 1 shingles of x and the
    first |y| - ceil(2 t / (1 + t) |y|) + 1 of y have one in common; ``own`` marks the shorter prefix."""

    def run(batches):
        for batch in batches:
            parts = [[], [], [], []]
            for k, body in enumerate(batch.column("set").to_pylist()):
                x = _undo(body)
                rank = np.searchsorted(common, x)
                often = np.zeros(len(x), np.int64)
                if len(common):
                    rank = np.minimum(rank, len(common) - 1)
                    often = np.where(common[rank] == x, order[rank], 0)
                m = len(x)
                long = m - -(-percent * m // 100) + 1
                short = m - -(-2 * percent * m // (100 + percent)) + 1
                head = x[np.argsort(often, kind="stable")[:long]]
                for part, values in zip(parts, (head, np.arange(len(head)), np.arange(len(head)) < short, np.full(len(head), k)), strict=True):
                    part.append(values)
            if parts[0]:
                token, at, own, row = map(np.concatenate, parts)
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(own), *(batch.column(c).take(where) for c in ("node", "n", "component"))], ["token", "at", "own", "node", "n", "component"])

    return run


def _open_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of nodes of different components that may reach ``percent``, none left out.  ``crowd`` has node, n,
    component, set.

    A join on the shingles of the sets' prefixes, which Spark splits where a shingle is frequent.  Size and place of the
    shared shingle rule out most pairs in the join itself."""
    counts = crowd.select("set").mapInArrow(frugal(_frequent), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = np.array([r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(COMMON).collect()], np.int64).view(np.uint64)
    by_token = np.argsort(most)
    common, order = most[by_token], len(most) - by_token
    rows = stored(crowd.mapInArrow(frugal(_prefixes(common, order, percent)), "token long, at int, own boolean, node long, n long, component long"), "prefixes")
    x, y = rows.alias("x"), rows.where("own").alias("y")
    on = """x.token = y.token AND x.component <> y.component AND (y.n < x.n OR (y.n = x.n AND y.node <> x.node))
            AND 100 * y.n >= {p} * x.n AND (100 + {p}) * least(x.n - x.at, y.n - y.at) >= {p} * (x.n + y.n)""".format(p=percent)
    return x.join(y, F.expr(on)).select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def _sets(width: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, _BLOCK):
                h, edge = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                body = [zstandard.ZstdCompressor(level=1).compress(_deltas(np.unique(h[x:y]))) for x, y in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(body, pa.binary())], ["node", "set"])

    return run


def _deltas(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _undo(body: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            last, x = None, None
            for i, (a, s, t) in enumerate(zip(batch.column("u").to_pylist(), batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist(), strict=True)):
                if a != last:
                    last, x = a, _undo(s)
                y = _undo(t)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in ("u", "v"))
    return stored(pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "set_u", "set_v").mapInArrow(frugal(_confirm(percent)), "u long, v long"), name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, region: int = REGION, deeper: int = DEEPER) -> DataFrame:
    """Link documents whose sets of word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    1. Every text gives its set size, a 128-bit key of the set and a MinHash signature.  Equal sets are one node, named
       by its least id, so exact copies cost nothing further.
    2. Forest: each tree sorts the nodes by its own order of the signature.  Nodes that share at least MIN_DEPTH hashes
       form a region.  A region of at most ``region`` nodes gives all its pairs; a larger one is cut by deeper hashes
       (adaptive depth), where each node gets its neighbour in the order, the first of its part and the region's least node.  A pair at the threshold
       shares a tree's first two hashes with probability 0.56, so all 16 miss it with 2e-6.
    3. Candidates are confirmed on the full sets: first those that join each node to its nearest and least candidate, then
       all others whose nodes are not connected by these.  After that, nodes of large regions that still hold several components are
       joined exactly, on the rarest shingles of their full sets (``_open_pairs``), so no link there depends on a cut.
    4. Components by alternating stars.

    Returns doc_id, n_shingles, component_id (least id reachable), kept (doc_id = component_id), a row for each input row.
    A text of fewer words than ``width`` is one shingle; null or wordless texts have an empty set and link to nothing.
    Rows that share an id are one document.  A row with a null id has no component, links to nothing and is kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = stored(rows.mapInArrow(frugal(_profile(width)), "doc_id long, n_shingles long, k1 long, k2 long, signature binary"), "profiles")
    key = ["k1", "k2", "n_shingles"]
    usable = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = stored(usable.groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "nodes")

    forest = nodes.select("node", F.col("n_shingles").alias("n"), "signature").mapInArrow(frugal(_branches), "tree int, p1 long, p2 long, p3 long, node long, n long")
    crowded = stored(forest.groupBy("tree", "p1").agg(F.count("*").alias("c2"), F.min("node").alias("lead")).where(f"c2 > {region}"), "crowded")
    ordered = _dealt(forest, crowded, deeper).repartition("region").sortWithinPartitions("region", "p2", "p3", "n", "node")
    leads = forest.join(crowded, ["tree", "p1"]).where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    pairs = ordered.mapInArrow(frugal(_neighbours(region)), "u long, v long").union(leads).distinct()
    signature = nodes.select("node", "signature")
    for k in ("u", "v"):
        pairs = pairs.join(signature.select(F.col("node").alias(k), F.col("signature").alias(f"s_{k}")), k)
    pairs = stored(pairs.select("u", "v", "s_u", "s_v").mapInArrow(_equal_share, "u long, v long, equal double"), "pairs")

    touched = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    regions = stored(forest.join(crowded, ["tree", "p1"]).select(F.xxhash64("tree", "p1").alias("region"), "node", "n"), "regions")
    touched = touched.union(regions.select("node")).distinct()
    # Both sides of the joins with texts and sets grow with the corpus, so they are merged at every size.
    texts = rows.join(touched.hint("merge"), rows["doc_id"] == touched["node"], "left_semi")
    sets = stored(texts.mapInArrow(frugal(_sets(width)), "node long, set binary"), "sets", "uncompressed")

    both = pairs.select("u", "v", "equal").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "equal"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("equal", -F.col("v"))).alias("near"), F.min("v").alias("least"))
    first = best.select("u", F.explode(F.array_distinct(F.array("near", "least"))).alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = _confirmed(first, sets, percent, "links")
    found = stored(components(links), "components")

    def component(df: DataFrame, k: str, found: DataFrame) -> DataFrame:
        return df.join(found.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")), k, "left").withColumn(f"c_{k}", F.coalesce(f"c_{k}", k))

    apart = component(component(pairs.select("u", "v").join(first, ["u", "v"], "left_anti"), "u", found), "v", found).where("c_u <> c_v").select("u", "v")
    found = _with_links(found, _confirmed(apart.distinct(), sets, percent, "links"))
    crowd = component(regions.withColumnRenamed("node", "u"), "u", found).select(F.col("u").alias("node"), "region", "n", F.col("c_u").alias("component"))
    split = crowd.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("region")
    crowd = crowd.join(split, "region", "left_semi").select("node", "n", "component").distinct()
    crowd = stored(crowd.join(sets.hint("merge"), "node").select("node", "n", "component", "set"), "crowd", "uncompressed")
    final = _with_links(found, _confirmed(_open_pairs(crowd, percent), sets, percent, "links"))

    classes = nodes.join(final, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    own = base.drop("signature").join(classes, key, "left")
    # Ids that occur with several texts: one document, hence one component.
    least = F.min("component_id").over(Window.partitionBy("doc_id")) if _repeated(base) else F.col("component_id")
    return own.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(least, F.col("doc_id")))).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if not links.limit(1).count():
        return found
    return stored(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)), "components")


def _repeated(base: DataFrame) -> bool:
    """Whether an id occurs in several rows."""
    return bool(base.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())


def _equal_share(batches):
    for batch in batches:
        s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in ("s_u", "s_v"))
        equal = (s == t).mean(axis=1) if len(s) else np.empty(0)
        ok = equal >= LEAST_EQUAL
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(ok)), batch.column("v").filter(pa.array(ok)), pa.array(equal[ok])], ["u", "v", "equal"])
