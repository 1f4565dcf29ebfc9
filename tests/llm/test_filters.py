"""Quality rules, quality model, personal data, URL rules and decontamination."""

import re
from collections import Counter

import numpy as np
import pytest

from addrflow.llm import pii, url_filter
from addrflow.llm.decontamination import common_subsequence, contaminated
from addrflow.llm.quality_model import AdditiveModel, quality_scores
from addrflow.llm.quality_rules import quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_quality_rules(docs, texts, spark):
    rows = texts + [(30, "a b c a b c d\n#x\n#x\n \n \nlast"), (31, "p q r s t u"), (32, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:6] for r in quality_rules(df, df.where("doc_id < 5")).select("doc.doc_id", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())

    def row(i, t):
        w, t = WORD.findall(t or ""), t or ""
        three = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        again = {q for p in range(len(w) - 2) if three[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return i, len(w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)

    assert got == sorted(row(i, t) for i, t in rows)
    assert quality_rules(df.where("doc_id < 0"), df).count() == 0
    assert quality_rules(df, df.where("doc_id < 0")).where("llr <> 0").count() == 0


def test_likelihood_ratio(spark):
    """word_chars, the score and the verdict against the definition, with Spark's hash."""
    import xxhash

    from addrflow.llm.quality_rules import BUCKETS, DEVIATIONS, PRIOR

    rng = np.random.default_rng(2)
    good, bad = [f"good{k}" for k in range(40)], [f"baad{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 70)) + "\n$x") for i in range(40)] + [(90, None), (91, "é ü  \t" + "word " * 80)]
    trusted = [i for i in range(40) if i % 3]
    docs = spark.createDataFrame([(*r, 5, True) for r in rows], "doc_id long, text string, llr int, kept boolean")
    got = {r.doc_id: r for r in quality_rules(docs, spark.createDataFrame([(i,) for i in [*trusted, None, 777]], "doc_id long")).select("doc.doc_id", "word_chars", "n_words", "n_repeat_words", "base_failed", "llr", "kept").collect()}

    def grams(t):
        w = [x.encode() for x in WORD.findall(t or "")]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [h % BUCKETS for h in one + [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(w, w[1:])]]

    raw, half = np.ones(BUCKETS), [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    side = {i: xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) % 2 for i, _ in rows}
    for i, t in rows:
        np.add.at(raw, grams(t), 1)
        if i in trusted:
            np.add.at(half[side[i]], grams(t), 1)
    ratios = [np.log1p(h / (PRIOR * raw / raw.sum())) for h in half]
    ratio = (ratios[0] + ratios[1]) / 2
    apart = [ratios[1 - side[i]][grams(t)].mean() for i, t in rows if i in trusted and not got[i].base_failed]
    threshold = np.mean(apart) - DEVIATIONS * np.std(apart)
    for i, t in rows:
        g, r = grams(t), got[i]
        want = float(ratio[g].mean()) if g else 0.0
        assert abs(r.llr - want) < 1e-9 and r.word_chars == sum(map(len, WORD.findall(t or "")))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and want >= threshold)
    assert {r.kept for r in got.values()} == {True, False}


def test_few_trusted_documents_reject_nothing_clean(spark):
    """From ten trusted documents to all of them, the kept share of clean ones stays; with all of them junk is rejected."""
    rng = np.random.default_rng(12)
    vocabulary, p = np.array([f"w{k}" for k in range(2000)]), 1 / np.arange(1, 2001)
    clean = [(i, " ".join(rng.choice(vocabulary, 200, p=p / p.sum()))) for i in range(400)]
    junk = [(1000 + i, " ".join(f"{rng.integers(10**9)}%%%" for _ in range(200))) for i in range(40)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string").repartition(4)
    for n in (0, 1, 2, 10, 50, 400):
        kept = {r[0] for r in quality_rules(docs, spark.createDataFrame([(i,) for i in range(n)], "doc_id long")).where("kept").select("doc.doc_id").collect()}
        assert sum(i < 1000 for i in kept) >= 0.99 * 400
        if n >= 50:
            assert not any(i >= 1000 for i in kept)


def test_pair_tree_is_the_best_of_two_levels():
    """Against every tree of two levels."""
    from addrflow.llm.quality_model import LEAST_ROWS, SHRINK, _pair_tree

    def leaf(g, w, c, a, b, x, y):
        return g[a:b, x:y].sum() ** 2 / (w[a:b, x:y].sum() + SHRINK), c[a:b, x:y].sum()

    rng = np.random.default_rng(6)
    for _ in range(60):
        shape = rng.integers(1, 5, 2)
        g, w, c = rng.normal(size=shape) * 9, rng.random(shape) * 5, rng.integers(0, 9, shape).astype(float)
        best = -np.inf
        for u, v, n in ((g, w, c), (g.T, w.T, c.T)):
            rows, columns = u.shape
            for first in range(1, rows + 1):
                for p in range(columns):
                    for q in range(columns) if first < rows else [0]:
                        cells = [(a, b, x, y) for a, b, cut in ((0, first, p), (first, rows, q)) for x, y in ((0, cut), (cut, columns)) if a < b and x < y]
                        found = [leaf(u, v, n, *k) for k in cells]
                        sides = [n[:first].sum(), n[first:].sum()] if first < rows else [np.inf]
                        if min(sides) >= LEAST_ROWS and all(m >= LEAST_ROWS for _, m in found if len(cells) > 1):
                            best = max(best, sum(worth for worth, _ in found))
        values = _pair_tree(g, w, c)
        # A tree's worth follows from its values: each leaf's is gradient sum over shrunken weight.
        assert np.isclose((g * values).sum(), max(best, g.sum() ** 2 / (w.sum() + SHRINK)))


def test_additive_model_equals_a_plain_fit(monkeypatch):
    """Cyclic boosting over bins against the same steps row by row."""
    from addrflow.llm import quality_model as qm

    monkeypatch.setattr(qm, "ROUNDS", 4)
    monkeypatch.setattr(qm, "PAIR_ROUNDS", 0)
    rng = np.random.default_rng(9)
    x = np.round(rng.random((200, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.random(200) > 0.8).astype(float)
    score = np.full(200, np.log((y.sum() + 1) / (201 - y.sum())))
    bins = [np.searchsorted(np.unique(np.quantile(x[:, j], np.linspace(0, 1, qm.BINS + 1)[1:-1])), x[:, j], "right") for j in range(3)]
    for _ in range(4):
        for b in bins:
            p = 1 / (1 + np.exp(-score))
            r, h = y - p, p * (1 - p)
            worth = lambda m: r[m].sum() ** 2 / (h[m].sum() + qm.SHRINK)
            leaves = [np.ones(200, bool)]
            while len(leaves) < qm.LEAVES:
                cuts = [(worth(m & (b < t)) + worth(m & (b >= t)) - worth(m), k, t) for k, m in enumerate(leaves) for t in range(1, b.max() + 1) if (m & (b < t)).sum() >= qm.LEAST_ROWS and (m & (b >= t)).sum() >= qm.LEAST_ROWS]
                if not cuts or max(cuts)[0] <= 1e-9:
                    break
                _, k, t = max(cuts)
                m = leaves.pop(k)
                leaves += [m & (b < t), m & (b >= t)]
            for m in leaves:
                score[m] += qm.RATE * r[m].sum() / (h[m].sum() + qm.SHRINK)
    assert np.allclose(qm.AdditiveModel(x, y).score(x), 1 / (1 + np.exp(-score)))


def test_additive_model():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    assert np.allclose(AdditiveModel(np.empty((0, 4)), np.empty(0)).score(x[:3]), 0.5)


def test_quality_scores(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    assert quality_scores(docs.where("doc_id < 0"), labels).count() == 0


def test_quality_scores_odd_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_scores(docs, none).collect()
    assert len(rows) == docs.count() and all(r.score == 0.5 for r in rows)


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


@pytest.mark.parametrize("text", ["a@b", "x@y.z@c.d", "..@a.b-c.d.", "a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111 1111 1111 4111111111111112", "+1 (839) 555-1724, +12", "++48 22 555 12 34.", "", "é@x.y 007.08.9.10"])
def test_base_spans(text):
    want = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            want.append((m.start(), k, m.end()))
    assert pii.base_spans(text) == sorted(want)


def _private_rows():
    rows = [(i, f"card 4111 1111 1111 1111 number n{i}; 4111111111111111 again 4111111111111111x end") for i in range(20)]
    rows += [(100 + i, f"call me at +48 22 {555 + i} 12 34 or 22 {555 + i} 12 34 today, order 77 {i}") for i in range(20)]
    rows += [(200 + i, f"write to ann{i}@mail.example or to a***@mail.example now") for i in range(20)]
    return rows + [(50, "order 1234567890123452 only"), (51, None), (52, ""), (53, "call 22 555 12 34 alone"), (54, "x***@other.example")]


def test_field_is_consistent(spark):
    """A number that looks like a known one elsewhere in the text is found in another form too; a lone one is not."""
    df = spark.createDataFrame(_private_rows(), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df, pii.train(df), mask=True).collect()}
    assert got[51].masked is None and got[52].masked == "" and got[51].spans == ""
    assert all(got[i].n_card >= 1 and "4111111111111111" not in got[i].masked for i in range(20))
    assert all(got[i].masked == f"call me at [PHONE] or [PHONE] today, order 77 {i - 100}" for i in range(100, 120))
    assert all(got[i].masked == "write to [EMAIL] or to [EMAIL] now" for i in range(200, 220))
    assert got[50].n_added == got[53].n_added == got[54].n_added == 0
    assert pii.find_pii(df.where("doc_id < 0"), pii.train(df.where("doc_id < 0"))).count() == 0


def test_skip_edges_matter(spark):
    """Without skip edges no distant repeat is added; base spans stay as they are."""
    df = spark.createDataFrame(_private_rows() + [(100, "call me at +48 22 555 12 34 or 22 555 12 34")], "doc_id long, text string").selectExpr("*", "1 AS spans", "'z' AS masked")
    with_skips, without = (pii.find_pii(df, pii.train(df, skips=x)).collect() for x in (True, False))
    assert sum(r.n_added for r in with_skips) == 41 and len(with_skips) == df.count()
    phones = lambda rows: sum(r.n_added for r in rows if r.doc_id >= 100 and r.doc_id < 200)
    assert phones(with_skips) == 21 and phones(without) == 0
    assert sorted((r.doc_id, r.base_sha256) for r in with_skips) == sorted((r.doc_id, r.base_sha256) for r in without)


def test_digests(spark):
    """Counts, digest and span string against the patterns run one by one."""
    import hashlib

    rows = [r for r in _private_rows() if r[1]] + [(60, "1.2.3.4 a@b.c +1 (839) 555-1724 4111111111111111")]
    want = {}
    for i, t in rows:
        spans = []
        for k, p in enumerate(PATTERNS):
            for m in p.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if not (k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 10 <= len(d) <= 15):
                    spans.append((m.start(), k, m.end()))
        text = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want[i] = (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), text)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_pii(df, pii.train(df)).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[r.doc_id][:5]
        assert set(want[r.doc_id][5].split(",")) - {""} <= set(r.spans.split(",")) and len(r.spans.split(",")) == sum(want[r.doc_id][:4]) + r.n_added + (not r.spans)


def test_url_filter(spark):
    import duckdb

    urls = ["http://A.example.net/en/x?q", "http://example.net/de/", "http://x.org/fr/a", "http://org/fr/", "http://xorg/fr/", "http://net", "http://net/", "no scheme", None, "", "http://www.cheap-pills.example.com/en/1", "http://cheap-pills.example.com/de/", "ftp://e.com/a#b", "://", "http://example.com.net?x/y", "http://m.casino-win.xyz/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    got = sorted(map(tuple, url_filter.url_filter(df).collect()))
    con = duckdb.connect()
    con.register("pages", df.drop("rule").toPandas())
    assert got == sorted(con.execute(url_filter.oracle_sql()).fetchall())
    assert got[0][3:] == ("example.net/en/", "allow") and got[10][3:] == (None, "block") and got[8][1:] == ("", "", None, "allow")
    assert url_filter.url_filter(df.where("page_id < 0")).count() == 0


def test_url_filter_alternatives(spark):
    """Every alternative of the pattern rules is found without the others."""
    import duckdb

    urls = [f"http://{h}.example.com/" for w in ("casino", "poker", "viagra", "porn", "xxx") for h in (w, f"{w}-x", f"a.b-{w.upper()}", f"my{w}")]
    urls += [f"http://a.example.com/p{at}{k}=1" for k in ("aff_id", "affid", "affiliate_id", "affiliateid", "AFF_ID", "staff_id", "aff__id") for at in ("?", "?x=2&", "/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, url_filter.url_filter(df).collect()))
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert got == sorted(con.execute(url_filter.oracle_sql()).fetchall())
    assert sum(r[-1] == "block" for r in got) == 25
    for i, u in enumerate(urls):
        alone = url_filter.url_filter(df.where(f"page_id = {i}")).first() if u.endswith(("//poker.example.com/", "p?aff_id=1")) else None
        assert alone is None or alone.verdict == "block"


def test_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]


def test_contaminated(spark, texts):
    items = [(1, "Seven purple giraffes juggled eleven frozen melons beside quiet harbour walls during monday's thunderous opera rehearsal tonight"), (2, None), (3, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leak = items[0][1].lower().replace(" ", "  ")
    edited = items[0][1].replace("frozen", "iced").replace("quiet", "calm")
    rows = texts + [(100, "before words " + leak + " after words"), (101, edited), (102, "giraffes like melons")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verdict for r in contaminated(df, bench).collect()}
    assert got == {(100, 1): "copy", (101, 1): "copy"}
    assert contaminated(df, bench.where("item_id < 0")).count() == 0 and contaminated(df.where("doc_id < 0"), bench).count() == 0


def _every_place(docs, items):
    """Pairs that the verdict accepts at some place, by brute force; answers by counts of items."""
    from addrflow.llm.decontamination import ANSWER_SHARE, ANSWER_WORDS, _terms_of, verdict, window

    split = lambda x: _terms_of([x]).hashes.tolist()
    texts = {i: split(t) for i, t in docs}
    count = Counter(h for _, t in items for h in set(split(t)))
    found = {}
    for k, own in ((k, split(t)) for k, t in items):
        answer = {h for h in own if count[h] <= max(1, ANSWER_SHARE * len(items))}
        answer = frozenset(answer if len(answer) >= ANSWER_WORDS else sorted(set(own), key=lambda h: (count[h], h))[:ANSWER_WORDS])
        for i, t in texts.items():
            got = [v for s in range(len(t)) if (v := verdict(own, answer, t[s : s + window(len(own))]))[2]]
            if got:
                found[i, k] = max(got)
    return found


def test_contaminated_by_common_words(spark):
    """An item whose words are all common is found where a document holds it, though none of them has a weight."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary, 150))) for i in range(60)]
    item = " ".join(rng.choice(vocabulary, 36, replace=False))
    docs.append((100, " ".join(rng.choice(vocabulary, 150)) + " " + item + " " + " ".join(rng.choice(vocabulary, 150))))
    got = {(r.doc_id, r.item_id): (r.sequence_share, r.verdict) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[100, 7] == (1.0, "copy")


@pytest.mark.parametrize("holders, words", [(40, 200), (4, 2000)])
def test_common_items_and_long_texts(spark, holders, words):
    """An item that many documents hold, and texts so long that most hashed terms are common: all are retrieved."""
    rng = np.random.default_rng(6)
    draw = lambda n: rng.choice(np.array([f"w{k}" for k in range(9000)]), n).tolist()
    item = draw(17)
    docs = [(i, " ".join(draw(words // 2) + (item if i < holders else []) + draw(words // 2))) for i in range(200)]
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(draw(20)))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows if r.item_id == 1) == list(range(holders)) and all(r.item_id == 1 for r in rows)
    assert sum(r.retrieved for r in rows) >= 0.9 * holders


@pytest.mark.parametrize("holders", [1, 3, 40])
def test_like_paraphrases_do_not_hide_an_item(spark, holders):
    """One rewording, every third word replaced, in one, a few or a fifth of all documents: found in each, and nowhere else."""
    rng = np.random.default_rng(8)
    draw = lambda n: rng.choice(np.array([f"w{k}" for k in range(9000)]), n).tolist()
    items = [draw(17) for _ in range(5)]
    reworded = [f"other{j}" if j % 3 == 2 else w for j, w in enumerate(items[0])]
    docs = [(i, " ".join(draw(100) + (reworded if i < holders else []) + draw(100))) for i in range(200)]
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.verdict) for r in rows) == [(i, 0, "paraphrase") for i in range(holders)]


def test_contaminated_odd_rows(spark):
    """Null ids, repeated rows and clashing columns."""
    item = "seven purple giraffes juggled eleven frozen melons beside quiet harbour walls tonight"
    rows = [(None, item, 1.0, "x"), (5, item, 1.0, "x"), (5, item, 1.0, "x"), (6, "nothing here", 0.0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cosine double, item_id string")
    got = contaminated(df, spark.createDataFrame([(1, item, 9), (1, item, 9)], "item_id long, text string, doc_id long")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.verdict) for r in got) == [(False, 5, 1, "copy"), (True, 0, 1, "copy")]


def test_contaminated_equals_every_place(spark):
    """Evenly reworded items, long items held in part, copies: the same pairs as the verdict at every place."""
    rng = np.random.default_rng(4)
    vocabulary, p = np.array([f"w{k}" for k in range(3000)]), 1 / np.arange(1, 3001)
    draw = lambda n: rng.choice(vocabulary, n, p=p / p.sum()).tolist()
    items = [(k, draw(n)) for k, n in enumerate([16, 24, 36, 60, 120, 200] * 2)]
    docs = [(i, draw(200)) for i in range(100)]
    for every in (3, 4, 5, 6, 99):
        for k, own in items:
            text = [f"new{rng.integers(10**9)}" if j % every == every - 1 else w for j, w in enumerate(own)]
            docs.append((1000 * every + k, draw(90) + text + draw(90)))
    docs += [(10**6 + k, draw(50) + own[len(own) // 3 :] + draw(50)) for k, own in items]
    docs, items = [(i, " ".join(t)) for i, t in docs], [(k, " ".join(t)) for k, t in items]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), items_per_pass=8).collect()
    got = {(r.doc_id, r.item_id): (r.sequence_share, r.answer_share, r.verdict) for r in found}
    want = _every_place(docs, items)
    assert len(want) > 40 and got == want
    # Recall of the latent search alone, of all and of the reworded ones.
    assert sum(r.retrieved for r in found) >= 0.9 * len(found)
    reworded = [r.retrieved for r in found if r.sequence_share < 0.95]
    assert len(reworded) > 20 and sum(reworded) >= 0.9 * len(reworded)
