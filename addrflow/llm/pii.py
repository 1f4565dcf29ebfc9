"""Personal data in text: fixed patterns, and a skip-chain conditional random field that keeps labels consistent."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import frugal
from .workspace import bounded_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Buckets of the words before a candidate.
CONTEXTS = 1 << 14
#: Rows that count as much as a factor's prior; pairs of each label that count as much as the belief that like candidates
#: have the same label.
PRIOR_ROWS, PRIOR_PAIRS = 2.0, 50
#: Least marginal probability of an added span, and rounds of message passing.
LEAST_MARGINAL, ROUNDS = 0.8, 8
#: Tokens apart at which two candidates of the chain still touch.
NEAR = 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from inside too, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: A group of digits that may be one of several that make a number.
_GROUP = re.compile(r"[(+]*[0-9]+(?:[()/-]+[0-9]+)*[),.;:!?]*")
_EDGE = ".,;:!?()[]<>\"'"
#: Digits that groups are joined to, at least and at most.
_JOINED = range(7, 20)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, by start, then kind."""
    if not _ANY.search(text):
        return []
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while m and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            out.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def shape(text: str) -> str:
    """What a candidate is made of, less than what the fixed patterns look at: an @, or its points, digits and letters."""
    if "@" in text:
        return "@"
    digits = sum(c.isdigit() for c in text)
    letters = min(sum(c.isalpha() for c in text), 2)
    return f"{min(text.strip('.').count('.'), 4)}.{digits if digits < 20 else '20+'}{'a' * letters}"


def skip_key(text: str) -> str | None:
    """What distant candidates must share to influence each other: the last seven digits, or the bare lower-case text (of an
    address with @, what follows it)."""
    if "@" in text:
        host = text.rpartition("@")[2].strip(_EDGE).lower()
        return "@" + host if host else None
    digits = re.sub(r"[^0-9]", "", text)
    if len(digits) >= 7:
        return digits[-7:]
    bare = text.strip(_EDGE).lower()
    return bare if len(bare) >= 6 else None


def context(word: str) -> int:
    """Bucket of the last word of letters before a candidate; 0 without one."""
    bare = word.strip(_EDGE).lower()
    return 1 + zlib.crc32(bare.encode()) % (CONTEXTS - 1) if bare.isalpha() else 0


class Chain:
    """The candidates of one text, their edges and known labels.

    Candidates are tokens with a digit or @, or inside a base span; groups of digits next to each other are one candidate
    if they make a number of 7 to 19 digits."""

    def __init__(self, text: str):
        self.spans = base_spans(text)
        self.start, self.end, self.shapes, self.contexts, self.known, self.keys = [], [], [], [], [], []
        self.near: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        if not _ANY.search(text):
            return
        by_start = iter(self.spans)
        live: list[tuple[int, int, int]] = []
        following = next(by_start, None)
        before = ""
        found: list[list] = []  # place of the first and last token, start, end, label, word before, a group of digits
        for k, m in enumerate(_TOKEN.finditer(text)):
            a, b = m.span()
            while following and following[0] < b:
                live.append(following)
                following = next(by_start, None)
            live = [s for s in live if s[2] > a]
            if not live and not _ANY.search(m[0]):
                before = m[0]
                continue
            label = live[0][1] + 1 if live else 0
            found.append([k, k, a, b, label, before, _GROUP.fullmatch(m[0]) is not None])
        place = -NEAR - 1
        for k, last, a, b, label, word, _ in self._joined(found, text):
            if k - place <= NEAR:
                self.near.append((len(self.start) - 1, len(self.start)))
            place = last
            self.start.append(a)
            self.end.append(b)
            self.shapes.append(shape(text[a:b]))
            self.contexts.append(context(word))
            self.known.append(label)
        held: dict[str, tuple[int, int]] = {}
        for i, (a, b) in enumerate(zip(self.start, self.end, strict=True)):
            key = skip_key(text[a:b])
            self.keys.append(key)
            if key:
                first, last = held.get(key, (i, i))
                if last != i:
                    self.skip.append((last, i))
                if first not in (last, i):
                    self.skip.append((first, i))
                held[key] = (first, i)

    @staticmethod
    def _joined(found: list[list], text: str) -> Iterator[list]:
        """Candidates, with neighbouring groups of digits joined where they make one number of one label."""
        lo = 0
        while lo < len(found):
            hi = lo + 1
            while hi < len(found) and found[hi][6] and found[hi - 1][6] and found[hi][0] == found[hi - 1][1] + 1 and text[found[hi - 1][3] - 1].isdigit():
                hi += 1
            run = found[lo:hi]
            labels = {x[4] for x in run}
            if hi - lo > 1 and len(labels) == 1 and sum(c.isdigit() for c in text[run[0][2] : run[-1][3]]) in _JOINED:
                yield [run[0][0], run[-1][1], run[0][2], run[-1][3], run[0][4], run[0][5], True]
            else:
                yield from run
            lo = hi


def _counts(labelled: frozenset | None):
    """Label counts, summed within a task: of shapes; or, where the shapes that patterns label are known, of contexts,
    neighbours and skip edges between candidates of such shapes.  Of others the patterns say nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = Chain(text or "")
                if labelled is None:
                    seen.update(("shape", s, 0, k) for s, k in zip(c.shapes, c.known, strict=True))
                    continue
                told = [s in labelled for s in c.shapes]
                seen.update(("context", "", w, k) for w, k, ok in zip(c.contexts, c.known, told, strict=True) if ok)
                for what, edges in (("near", c.near), ("skip", c.skip)):
                    seen.update((what, "", c.known[i], c.known[j]) for i, j in edges if told[i] and told[j])
        if seen:
            rows, n = list(seen), list(seen.values())
            what, key, x, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(key), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(n, pa.int64())], ["what", "key", "x", "y", "n"])

    return run


class Field:
    """Potentials of the random field, each factor trained by itself (piecewise) on counts over the whole corpus.

    The labels are those of the fixed patterns.  The node factors see less than the patterns do (how many digits, which
    word stands before), so they do not merely repeat them.  A shape that no pattern ever labels has the prior alone: that
    it is unlabelled says nothing.  ``skips=False`` leaves the skip edges out."""

    def __init__(self, rows, skips: bool = True):
        size = len(LABELS)
        shapes: dict[str, np.ndarray] = {}
        contexts = np.zeros((CONTEXTS, size))
        pair = {"near": np.ones((size, size)), "skip": np.eye(size) * PRIOR_PAIRS + 1}
        for r in rows:
            if r["what"] == "shape":
                shapes.setdefault(r["key"], np.zeros(size))[r["y"]] += r["n"]
            elif r["what"] == "context":
                contexts[r["x"], r["y"]] += r["n"]
            else:
                pair[r["what"]][r["x"], r["y"]] += r["n"]
        total = sum(shapes.values(), np.full(size, 0.5))
        prior = total / total.sum()
        self.nodes = {k: np.log((v + PRIOR_ROWS * prior) / (v.sum() + PRIOR_ROWS)) for k, v in shapes.items() if v[1:].any()}
        self.other = np.log(prior)
        self.contexts = np.log((contexts + PRIOR_ROWS * prior) / (contexts.sum(axis=1, keepdims=True) + PRIOR_ROWS) / prior)
        self.contexts[0] = 0.0

        def gain(counts: np.ndarray) -> np.ndarray:
            joint = counts / counts.sum()
            joint = (joint + joint.T) / 2
            return np.log(joint / np.outer(joint.sum(1), joint.sum(0)))

        self.near = gain(pair["near"])
        self.skip = gain(pair["skip"]) if skips else np.zeros((size, size))

    def marginals(self, chains: list[Chain]) -> np.ndarray:
        """Loopy sum-product over the candidates of all chains at once; those inside base spans are observed."""
        n = sum(len(c.start) for c in chains)
        node, edges, weights, at = np.zeros((n, len(LABELS))), [], [], 0
        for c in chains:
            for i, (s, w, k) in enumerate(zip(c.shapes, c.contexts, c.known, strict=True)):
                if k:
                    node[at + i] = -50.0
                    node[at + i, k] = 0.0
                else:
                    node[at + i] = self.nodes.get(s, self.other) + self.contexts[w]
            for pairs, table in ((c.near, self.near), (c.skip, self.skip)):
                edges += [(at + i, at + j) for i, j in pairs]
                weights += [table] * len(pairs)
            at += len(c.start)
        belief = node
        if edges:
            e, w = np.array(edges), np.array(weights)
            source, target = np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]]
            table = np.concatenate([w, w.transpose(0, 2, 1)])
            back = np.r_[np.arange(len(e)) + len(e), np.arange(len(e))]
            message = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                belief = node.copy()
                np.add.at(belief, target, message)
                out = (belief[source] - message[back])[:, :, None] + table
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            belief = node.copy()
            np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
        return p / p.sum(axis=1, keepdims=True) if n else p


def train(docs: DataFrame, text_col: str = "text", skips: bool = True) -> Field:
    """Count over every document; what reaches the driver is bounded by the numbers of shapes and contexts."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string")).where(F.col(text_col).rlike("[0-9@]"))

    def counted(labelled: frozenset | None) -> list:
        seen = rows.mapInArrow(frugal(_counts(labelled)), "what string, key string, x int, y int, n long")
        return seen.groupBy("what", "key", "x", "y").agg(F.sum("n").alias("n")).collect()

    shapes = counted(None)
    return Field([*shapes, *counted(frozenset(r["key"] for r in shapes if r["y"]))], skips)


def added_spans(chain: Chain, p: np.ndarray, text: str) -> list[tuple[int, int, int]]:
    """Spans of candidates outside the base spans that the field labels with confidence, as it does for a base span of the
    same kind that shares their key."""
    label = p.argmax(axis=1)
    seen = {(key, k) for key, k in zip(chain.keys, chain.known, strict=True) if key and k}
    out, previous = [], -2
    for i, (a, b) in enumerate(zip(chain.start, chain.end, strict=True)):
        k = int(label[i])
        if chain.known[i] or not k or p[i, k] < LEAST_MARGINAL or (chain.keys[i], k) not in seen:
            continue
        token = text[a:b]
        a += len(token) - len(token.lstrip(_EDGE))
        b -= len(token) - len(token.rstrip(_EDGE))
        if a < b and not any(s[0] < b and a < s[2] for s in chain.spans):
            if out and previous == i - 1 and out[-1][1] == k - 1 and (i - 1, i) in chain.near:
                out[-1] = (out[-1][0], k - 1, b)
            else:
                out.append((a, k - 1, b))
            previous = i
    return out


def _text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans, and with ``mask`` the text with each span replaced by
    its kind in brackets.

    Null or empty text has no spans (and stays null or empty).  Rows are judged by themselves, so ids may be null or
    repeated; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            chains = [Chain(t or "") for t in texts]
            p = field.marginals(chains)
            cols: list[list] = [[] for _ in range(8)]
            at = 0
            for text, c in zip(texts, chains, strict=True):
                extra = added_spans(c, p[at : at + len(c.start)], text or "")
                at += len(c.start)
                every = sorted([*c.spans, *extra])
                count = Counter(k for _, k, _ in c.spans)
                values = [*(count[k] for k in range(4)), hashlib.sha256(_text_of(c.spans).encode()).hexdigest(), _text_of(every), len(extra), masked(text, every) if mask else None]
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [id_col, *names])

    bounded_batches(docs.sparkSession)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "masked"]
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, masked string")
    return out if mask else out.drop("masked")


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind; spans that overlap are replaced together."""
    if not spans:
        return text
    out, last = [], 0
    for a, k, b in spans:
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])
