"""Main text of web pages by wrapper induction: same-host pages are aligned by simple tree matching."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import frugal
from .url_filter import url_host_path
from .workspace import bounded_batches, stored

#: Elements without content, and elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object xmp".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the value is closed by the key's start.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are no part of an article.
NOT_TEXT = frozenset("head nav header footer aside form script style noscript template iframe svg object select button input textarea menu".split())
#: Class, id or role names that hint at something else than the article; a hint only: it never removes what holds the
#: page's article or nearly all of its text.  A name of several parts hints if each part is such a name, or says where or
#: how it stands on the page, so that a subject (related-work, ad-hoc, share-price) never does.
HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar signup skip sponsor sponsored subscribe toolbar widget".split())
PLACES = frozenset("area bar block bottom box btn button buttons column container content feed float footer form grid group header heading icons inner item items left link links list main module outer overlay page panel posts primary reader right row secondary section site slot social sticky tag thread title to top unit user wrap wrapper".split())
#: Elements whose like siblings are one node of the alignment; of others, runs longer than RUN.
REPEATED, RUN = frozenset("p li dt dd tr td th option h2 h3 h4 h5 h6 blockquote pre figure figcaption article br hr".split()), 7
#: Elements that a wrapper may open further to find the article.
OPENED = frozenset("html body div section main center table tbody tr td article".split())
#: Share of a host's pages, and least number of them, that hold a node with the same text before it is template.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 8
#: Page structures of a host that get a wrapper, the commonest first; other pages go to the one that fits best.
SEEDS = 4
#: Blocks of a page from which on like siblings are one node where a parent has more than WIDE children, and everywhere if
#: that is not enough: then each node has one partner at most by label, and an alignment takes time in proportion to the page.
LARGE, WIDE = 256, 16
#: Share of a slot's varying text that one inner slot must hold to be the article; share of link text that makes a menu;
#: weight of an article element, and of a hinted one.
DOMINANT, MENU, ARTICLE_WEIGHT, HINT_WEIGHT = 0.6, 0.6, 4.0, 0.25
#: Share of a page's text from which on a hinted element is the page itself.
WHOLE = 0.95

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style|open)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW}


class Node:
    """An element: children are elements and pieces of text."""

    __slots__ = ("label", "tag", "names", "hidden", "children")

    def __init__(self, tag: str, attributes: str = ""):
        # A dialog shows when it is open.
        self.tag, self.children, self.hidden = tag, [], tag == "dialog"
        names: list[str] = []
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key in ("class", "id", "role"):
                    names += value.split()
                elif key == "open":
                    self.hidden &= tag != "dialog"
                else:
                    self.hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value) is not None)
        self.names = frozenset(names)
        self.label = tag + "." + ".".join(sorted({re.sub("[0-9]+", "", x) for x in names})) if names else tag

    def hinted(self) -> bool:
        return self.tag not in ("html", "body", "article", "main") and any(map(_hint, self.names))

    def is_article(self) -> bool:
        return self.tag in ("article", "main") or "main" in self.names or "article" in self.names


def _hint(name: str) -> bool:
    parts = [x for x in re.split("[-_0-9]+", name) if x]
    return any(x in HINTS for x in parts) and all(x in HINTS or x in PLACES for x in parts)


def parse(page: str) -> Node:
    """A tolerant DOM: unclosed and stray tags are mended as browsers do for the common cases."""
    root = Node("html")
    stack = [root]
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag == "html":
                continue
            if tag in BLOCK and tag not in ("br", "hr"):
                _close_until(stack, {"p"}, BLOCK - {"p"})
            if tag in CLOSES:
                _close_until(stack, CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
            node = Node(tag, m[3])
            stack[-1].children.append(node)
            if tag in RAW:
                at = _RAW_END[tag].search(page, at).end()
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(node)
        elif m[1]:
            tag = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
    text(page[at:])
    return root


def _close_until(stack: list[Node], tags, barrier) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in barrier:
            return


# --- Text of a tree ------------------------------------------------------------------------------------------------------


def _size(node: Node) -> int:
    """Characters of text in a tree, but for white space."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            total += sum(map(len, x.split()))
        elif x.tag not in RAW and x.tag not in NOT_TEXT:
            todo.extend(x.children)
    return total


def _holds_article(node: Node) -> bool:
    todo = list(node.children)
    while todo:
        x = todo.pop()
        if not isinstance(x, str):
            if x.is_article():
                return True
            todo.extend(x.children)
    return False


class Text:
    """Reads the text of parts of one page."""

    def __init__(self, root: Node):
        self.root, self._total = root, None

    def excluded(self, x: Node) -> bool:
        if x.hidden or x.tag in NOT_TEXT or x.tag in RAW:
            return True
        if not x.hinted() or _holds_article(x):
            return False
        if self._total is None:
            self._total = _size(self.root)
        return _size(x) < WHOLE * self._total

    def articles(self) -> list[Node]:
        """The outermost article or main elements that nothing excludes, the articles inside a main one before it; the
        whole page without any."""
        found, todo = [], [(self.root, None)]
        while todo:
            x, outer = todo.pop()
            if isinstance(x, str) or self.excluded(x):
                continue
            if x.tag == "article":
                found.append((x, None))
                if outer is not None:
                    outer[1] = True
            elif x.is_article() and outer is None:
                own = [x, False]
                found.append((x, own))
                todo.extend((y, own) for y in reversed(x.children))
            else:
                todo.extend((y, outer) for y in reversed(x.children))
        return [x for x, own in found if own is None or not own[1]] or [self.root]

    def read(self, nodes: list[Node], skip: frozenset = frozenset()) -> str:
        """Text in page order, blocks joined by one blank, white space turned into one."""
        out: list[str] = []
        for node in nodes:
            todo: list = [node]
            while todo:
                x = todo.pop()
                if isinstance(x, str):
                    out.append(x)
                elif id(x) in skip or (x is not node and self.excluded(x)):
                    out.append("\n")
                else:
                    if x.tag in BLOCK:
                        out.append("\n")
                        todo.append("\n")
                    todo.extend(reversed(x.children))
            out.append("\n")
        return " ".join("".join(out).split())


# --- Alignment ---------------------------------------------------------------------------------------------------------


class Outline:
    """The blocks of a page in page order: inline elements belong to their block, like siblings are one node.

    ``key`` and ``size``, ``links`` say what text a node holds (a hash, its length, the length of its links)."""

    def __init__(self, labels: list[str], parent: list[int]):
        self.labels, self.parent = labels, parent
        self.kids: list[list[int]] = [[] for _ in labels]
        for k, p in enumerate(parent):
            if p >= 0:
                self.kids[p].append(k)

    @property
    def shape(self) -> str:
        return "\n".join(f"{p} {x}" for p, x in zip(self.parent, self.labels, strict=True))

    @classmethod
    def of_shape(cls, shape: str) -> Outline:
        rows = [x.split(" ", 1) for x in shape.split("\n")]
        return cls([x for _, x in rows], [int(p) for p, _ in rows])

    @classmethod
    def of_page(cls, root: Node, widest: int | None = None) -> Outline:
        labels, parent, members, own_text, own_links = ["html"], [-1], [[root]], [], []
        todo, order = [0], []
        children: list[list[tuple[str, list[Node]]]] = [[]]
        # Depth first; nodes get their numbers when their parent is read, so they are renumbered by page order below.
        while todo:
            k = todo.pop()
            order.append(k)
            text, links, groups = [], 0, []
            seen: dict[str, int] = {}
            for x in members[k]:
                inner = [(y, False) for y in reversed(x.children)]
                while inner:
                    y, linked = inner.pop()
                    if isinstance(y, str):
                        text.append(y)
                        links += len("".join(y.split())) * linked
                    elif y.tag in RAW or y.hidden:
                        continue
                    elif y.tag in BLOCK and y.tag not in ("br", "hr"):
                        if len(members[k]) > 1 and y.label in seen:
                            groups[seen[y.label]].append(y)
                        elif groups and groups[-1][0].label == y.label and y.tag in REPEATED:
                            groups[-1].append(y)
                        else:
                            seen[y.label] = len(groups)
                            groups.append([y])
                    else:
                        text.append(" " if y.tag in BLOCK else "")
                        inner.extend((z, linked or y.tag == "a") for z in reversed(y.children))
                text.append(" ")
            while len(own_text) <= k:
                own_text.append([])
                own_links.append(0)
            own_text[k], own_links[k] = text, links
            new = []
            if widest is not None and len(groups) > widest:
                groups = _by_label(groups)
            for g in _long_runs(groups):
                new.append(len(labels))
                labels.append(g[0].label)
                parent.append(k)
                members.append(g)
            if len(labels) > LARGE and widest != 0:
                return cls.of_page(root, WIDE if widest is None else 0)
            todo.extend(reversed(new))
        place = {k: i for i, k in enumerate(order)}
        out = cls([labels[k] for k in order], [place[parent[k]] if k else -1 for k in order])
        out.members = [members[k] for k in order]
        out.key, out.size, out.links = [0] * len(order), [0] * len(order), [own_links[k] for k in order]
        for i in range(len(order) - 1, -1, -1):
            text = " ".join("".join(own_text[order[i]]).split())
            out.size[i] += len(text) - text.count(" ")
            below = out.kids[i]
            out.key[i] = xxhash.xxh64_intdigest(text + "".join(f"\n{out.key[j]}" for j in below if out.size[j])) >> 1
            if i:
                out.size[out.parent[i]] += out.size[i]
                out.links[out.parent[i]] += out.links[i]
        return out


def _long_runs(groups: list[list[Node]]) -> list[list[Node]]:
    """Runs of more than RUN neighbours with one label become one node."""
    out: list[list[Node]] = []
    lo = 0
    for hi in range(1, len(groups) + 1):
        if hi == len(groups) or groups[hi][0].label != groups[lo][0].label:
            run = groups[lo:hi]
            out += [[x for g in run for x in g]] if len(run) > RUN else run
            lo = hi
    return out


def _by_label(groups: list[list[Node]]) -> list[list[Node]]:
    merged: dict[str, list[Node]] = {}
    for g in groups:
        merged.setdefault(g[0].label, []).extend(g)
    return list(merged.values())


def _places(labels: list[str], nodes: list[int]) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for j, q in enumerate(nodes):
        at.setdefault(labels[q], []).append(j)
    return at


def _chain(a: Outline, b: Outline, p: int, q: int, weight: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest pairing of the children of p and q that keeps the order of both: its weight and its pairs.

    Only like children are looked at; a tree of prefix maxima (over the places in q) gives each its best predecessor."""
    y = b.kids[q]
    at = _places(b.labels, y)
    best: list[tuple[int, int]] = [(0, -1)] * (len(y) + 1)
    links: list[tuple[int, int, int]] = []

    def before(j: int) -> tuple[int, int]:
        top = (0, -1)
        while j > 0:
            if best[j][0] > top[0]:
                top = best[j]
            j -= j & -j
        return top

    for x in a.kids[p]:
        # From the last place on, so that a child has no other pair of its own before it.
        for j in reversed(at.get(a.labels[x], ())):
            top = before(j)
            here = (top[0] + weight[x, y[j]], len(links))
            links.append((x, y[j], top[1]))
            j += 1
            while j <= len(y):
                if best[j][0] < here[0]:
                    best[j] = here
                j += j & -j
    total, k = before(len(y))
    pairs = []
    while k >= 0:
        x, z, k = links[k]
        pairs.append((x, z))
    return total, pairs


def aligned(a: Outline, b: Outline) -> tuple[int, list[int]]:
    """Simple tree matching: the most nodes of two ordered trees that can be paired, parents with parents; and for each
    node of ``a`` its partner in ``b`` (or -1).  Without recursion, so that pages may be of any depth."""
    partner = [-1] * len(a.labels)
    if a.labels[0] != b.labels[0]:
        return 0, partner
    pairs = [(0, 0)]
    for p, q in pairs:
        at = _places(b.labels, b.kids[q])
        pairs += [(x, b.kids[q][j]) for x in a.kids[p] for j in at.get(a.labels[x], ())]
    weight: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, q in reversed(pairs):
        total, chosen[p, q] = _chain(a, b, p, q, weight) if a.kids[p] and b.kids[q] else (0, [])
        weight[p, q] = 1 + total
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        partner[p] = q
        todo += chosen[p, q]
    return weight[0, 0], partner


class Fit:
    """Which of a host's seed structures a page follows, and how; remembered by structure."""

    def __init__(self, shapes: list[str]):
        self.seeds, self.known = [Outline.of_shape(s) for s in shapes], {}

    def __call__(self, page: Outline) -> tuple[int, list[int]]:
        shape = page.shape
        if shape not in self.known:
            if len(self.known) >= 5000:
                self.known.clear()
            found = [aligned(page, s) for s in self.seeds]
            k = max(range(len(found)), key=lambda k: (2 * found[k][0] / (len(page.labels) + len(self.seeds[k].labels)), -k))
            self.known[shape] = (k, found[k][1])
        return self.known[shape]


# --- Wrappers ----------------------------------------------------------------------------------------------------------


def decide(shape: str, pages: int, stats: dict[int, tuple]) -> dict:
    """What a wrapper says of its nodes, from (pages, pages with the commonest text, its hash, characters, of these in
    links) of each: ``constant`` ones with their text's hash, the ``slot`` that holds the article, ``menus``."""
    seed = Outline.of_shape(shape)
    n = len(seed.labels)
    tags = [x.split(".", 1)[0] for x in seed.labels]
    names = [Node(t, f'class="{x.partition(".")[2].replace(".", " ")}"') for t, x in zip(tags, seed.labels, strict=True)]
    constant, value = {}, [0.0] * n
    size, links = [0.0] * n, [0.0] * n
    for k, (m, top, key, chars, linked) in stats.items():
        size[k], links[k] = chars / m, linked / m
        if m >= max(CONSTANT_PAGES, CONSTANT_SHARE * pages) and top >= CONSTANT_SHARE * m:
            constant[k] = key
    # Text that varies from page to page, without links, under each node.
    for k in range(n - 1, -1, -1):
        if k in constant or tags[k] in NOT_TEXT:
            value[k] = 0.0
            continue
        own = size[k] - sum(size[j] for j in seed.kids[k]) - (links[k] - sum(links[j] for j in seed.kids[k]))
        value[k] = max(0.0, own) + sum(value[j] for j in seed.kids[k])

    def weighted(k: int) -> float:
        return value[k] * (ARTICLE_WEIGHT if names[k].is_article() else HINT_WEIGHT if names[k].hinted() else 1.0)

    slot = 0
    while not (slot and names[slot].is_article()):
        own = max(0.0, value[slot] - sum(value[j] for j in seed.kids[slot]))
        # Headings and paragraphs of its own make the node the article's.
        if any(value[j] for j in seed.kids[slot] if tags[j] not in OPENED and tags[j] not in ("ul", "ol", "dl")):
            break
        inner = [j for j in seed.kids[slot] if tags[j] in OPENED]
        best = max(inner, key=lambda j: (weighted(j), -j), default=None)
        if best is None or not weighted(best) or weighted(best) < DOMINANT * (own + sum(map(weighted, seed.kids[slot]))):
            break
        slot = best
    inside = {slot}
    for k in range(slot + 1, n):
        if seed.parent[k] in inside:
            inside.add(k)
    article = names[slot].is_article()
    menus = [k for k in sorted(inside - {slot}) if not article and tags[k] in ("div", "section", "ul", "ol", "table", "p") and links[k] >= MENU * size[k] > 0]
    return {"shape": shape, "pages": pages, "constant": constant, "slot": slot if value[slot] else None, "menus": menus}


class Wrapper:
    """A host's wrappers, as ``decide`` made them."""

    def __init__(self, decisions: list[dict]):
        self.fit = Fit([d["shape"] for d in decisions])
        self.decisions = [d | {"constant": {int(k): v for k, v in d["constant"].items()}, "menus": set(d["menus"])} for d in decisions]

    def parts(self, page: Outline) -> tuple[list[Node], frozenset]:
        """(elements that hold the article, elements to leave out)."""
        k, partner = self.fit(page)
        d = self.decisions[k]
        nodes: list[Node] = []
        skip: set[int] = set()
        if d["pages"] < CONSTANT_PAGES:
            return nodes, frozenset()
        for i, j in enumerate(partner):
            if j >= 0 and (j in d["menus"] or d["constant"].get(j) == page.key[i]):
                skip.update(map(id, page.members[i]))
            elif j >= 0 and j == d["slot"]:
                nodes += page.members[i]
        return nodes, frozenset(skip)


def main_text(page: str | None, wrapper: Wrapper | None) -> str:
    """The article of a page: what its wrapper says, else (a host with few pages) its article or main elements."""
    if not page:
        return ""
    root = parse(page)
    text = Text(root)
    nodes, skip = wrapper.parts(Outline.of_page(root)) if wrapper is not None else ([], frozenset())
    nodes = nodes or text.articles()
    # Pages that are copies of each other look like template throughout: then nothing is.
    return text.read(nodes, skip) or text.read(nodes)


# --- Jobs ----------------------------------------------------------------------------------------------------------------


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, shapes, keys, sizes, links = [], [], [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if page:
                o = Outline.of_page(parse(page))
                for part, value in zip((hosts, shapes, keys, sizes, links), (host, o.shape, o.key, o.size, o.links), strict=True):
                    part.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, sizes, links))], ["host", "shape", "keys", "sizes", "links"])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pages of a task: (host, seed, node, text hash, pages, characters, in links)."""
    fits: dict[str, Fit] = {}
    seen: Counter = Counter()
    sums: dict[tuple, list[int]] = {}

    def flush():
        rows = [(*k, n, *sums[k]) for k, n in seen.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        seen.clear()
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["host", "seed", "node", "key", "n", "size", "links"])

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in ("host", "shape", "keys", "sizes", "links", "seeds")]
        for host, shape, keys, sizes, links, seeds in zip(*cols, strict=True):
            if host not in fits:
                if len(fits) > 2000:
                    fits.clear()
                fits[host] = Fit(seeds)
            k, partner = fits[host](Outline.of_shape(shape))
            for j, key, size, link in zip(partner, keys, sizes, links, strict=True):
                if j >= 0:
                    row = (host, k, j, key)
                    seen[row] += 1
                    total = sums.setdefault(row, [0, 0])
                    total[0] += size
                    total[1] += link
            if len(seen) > 100_000:
                yield flush()
    yield flush()


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for shape, pages, stats in zip(*(batch.column(k).to_pylist() for k in ("shape", "pages", "stats")), strict=True):
            out.append(json.dumps(decide(shape, pages, {s["node"]: (s["n"], s["top"], s["key"], s["size"], s["links"]) for s in stats})))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("seed"), pa.array(out, pa.string())], ["host", "seed", "decision"])


def induce_wrappers(pages: DataFrame, url_col: str, html_col: str, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(host, decisions) of every host with at least CONSTANT_PAGES pages.

    A host's commonest page structures are its seeds (at most SEEDS); every page is aligned with the one it fits best by
    simple tree matching, and each node of a seed gets the sums over all its pages: how often it is there, how often with
    which text, how much text and how much of it in links.  Sums are grouped by host, node and text, so a host of any size
    is spread over the tasks, and the result depends neither on their number nor on their order."""
    rows = pages.select(url_host_path(F.col(url_col))[0].alias("host"), F.col(html_col).cast("string").alias("html"))
    outlines = stored(rows.mapInArrow(frugal(_outlines), "host string, shape string, keys array<long>, sizes array<long>, links array<long>"), "outlines")
    shapes = outlines.groupBy("host", "shape").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("host").orderBy(F.desc("n"), F.desc(F.length("shape")), "shape")
    top = shapes.withColumn("seed", F.row_number().over(rank)).where(f"seed <= {SEEDS}").withColumn("seed", F.col("seed") - 1)
    large = shapes.groupBy("host").agg(F.sum("n").alias("n_host")).where(f"n_host >= {CONSTANT_PAGES}")
    seeds = stored(top.join(large, "host").select("host", F.col("seed").cast("long").alias("seed"), "shape"), "seeds")
    known = seeds.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "shape"))), lambda x: x["shape"]).alias("seeds"))
    sums = outlines.join(_small(known, seeds, broadcast_bytes, "shape"), "host").mapInArrow(frugal(_statistics), "host string, seed long, node long, key long, n long, size long, links long")
    sums = sums.groupBy("host", "seed", "node", "key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    nodes = sums.groupBy("host", "seed", "node").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("key", F.struct("n", "key")).alias("key"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    stats = nodes.groupBy("host", "seed").agg(F.max("n").alias("pages"), F.sort_array(F.collect_list(F.struct("node", "n", "top", "key", "size", "links"))).alias("stats"))
    decided = stats.join(seeds, ["host", "seed"]).select("host", "seed", "shape", "pages", "stats").mapInArrow(_decisions, "host string, seed long, decision string")
    return decided.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "decision"))), lambda x: x["decision"]).alias("decisions"))


def _small(df: DataFrame, sized: DataFrame, most: int, column: str) -> DataFrame:
    """``df`` for a join: broadcast if the column of the stored table takes at most ``most`` bytes."""
    return F.broadcast(df) if (sized.agg(F.sum(F.octet_length(column) + 100)).first()[0] or 0) <= most else df


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Wrapper induction: pages of one host are aligned by simple tree matching.  Nodes with the same text on at least 90 % of
    the pages that have them (and 8) are template and left out; of the varying slots the one that holds the article is
    found by how much text outside links it holds over all pages of the host.  A host of fewer pages has no wrapper: then
    the page's article or main elements are taken.  In either, elements that can't be part of an article (menus, headers,
    footers, asides, forms, scripts, closed dialogs ...) and those whose class, id or role name is that of such a part are left
    out, unless they hold the article or nearly all of the text.  Character references are decoded, white space inside a block becomes one
    blank, and blocks are joined by one blank.

    Null or empty html has the empty text.  A null url, or one without a host, belongs to the empty host.  Pages may be of
    any length and depth; of pages with more than LARGE blocks, like siblings are one node of the alignment.  Repeated rows are kept; other columns are ignored.  Wrappers are broadcast if they take at most
    ``broadcast_bytes``, else joined.
    """
    bounded_batches(pages.sparkSession)
    wrappers = stored(induce_wrappers(pages, url_col, html_col, broadcast_bytes).withColumn("bytes", F.aggregate("decisions", F.lit(0), lambda a, x: a + F.length(x))), "wrappers")
    size = wrappers.agg(F.sum(F.col("bytes") + F.octet_length("host"))).first()[0] or 0
    wrappers = wrappers.drop("bytes")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), url_host_path(F.col(url_col))[0].alias("host"))
    joined = rows.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left")

    def extract(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for host, page, decisions in zip(*(batch.column(k).to_pylist() for k in ("host", "html", "decisions")), strict=True):
                if decisions and host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = Wrapper([json.loads(d) for d in decisions])
                texts.append(main_text(page, known.get(host)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "host", "decisions").mapInArrow(frugal(extract), f"page_id {kind}, url string, text string, n_chars long")
