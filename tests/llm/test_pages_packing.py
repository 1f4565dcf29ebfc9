"""HTML extraction, packing and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from addrflow.llm import html_extract
from addrflow.llm.packing import best_pattern, pack_documents, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def page(body, title="T"):
    return f"<html><head><title>{title}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>{body}<footer>&copy; host</footer></body></html>"


def test_main_text():
    text = html_extract.main_text
    assert text(page("<article><h1>A &amp; B</h1><p>one<p>two <b>th</b>ree<br>four &lt;x&gt;</article>"), None) == "A & B one two three four <x>"
    assert text(page("<div class='cookie-notice'>C</div><div id=main><p>x</p><div class=comments><p>bad</p></div></div>"), None) == "x"
    assert text(page("<p>plain</p><form><p>no</p></form>"), None) == "plain"
    assert text(None, None) == "" and text("", None) == ""
    assert text("<article><p>cut &am", None) == "cut &am"
    assert text("<article><!-- x --><p hidden>h</p>a&nbsp; b</article>", None) == "a b"


def test_template_is_left_out(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div><p>story {i} {'w' * i}</p></div><div class=x><span>Follow us today</span></div>")) for i in range(12)]
    rows += [(50, None, page("<article>lone</article>")), (51, "http://h.example/51", None), (52, "x", "")]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"story {i}") and "Follow" not in got[i] for i in range(12))
    assert got[50] == "lone" and got[51] == "" and got[52] == ""


def extracted(spark, rows, parts=2):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return {r.page_id: r.text for r in html_extract.extract_text(df).collect()}


def plain_page(i, story, notice="Follow us for daily news and offers"):
    """A template without telling tags or names."""
    links = "".join(f"<div><a href=/{k}>topic {k} of {i}</a></div>" for k in range(4))
    return f"<body><div><div>{links}</div><div><div><h1>Title {i}</h1><p>{story}</p><p>more of {i}</p></div></div><div>Buy thing {i} now</div><div>{notice}</div></div></body>"


def test_wrapper_decides_without_names(spark):
    """Menus, adverts and notices in plain elements: the wrapper finds the story, a single page alone does not."""
    rows = [(i, f"http://h.example/{i}", plain_page(i, f"story {i} " + "word " * 30)) for i in range(30)]
    # One page of the host differs in its template text, one in its structure.
    rows[7] = (7, rows[7][1], plain_page(7, "story 7", notice="Folgen Sie uns"))
    rows.append((40, "http://h.example/40", "<body><h1>Error</h1><p>not found</p></body>"))
    rows.append((50, "http://lone.example/", rows[0][2]))
    got = extracted(spark, rows)
    for i in range(30):
        assert got[i] == f"Title {i} " + ("story 7" if i == 7 else f"story {i} " + "word " * 29 + "word") + f" more of {i}"
    assert got[40] == "Error not found"
    assert got[50] != got[0] and "Follow us" in got[50]
    assert extracted(spark, rows, 5) == extracted(spark, list(reversed(rows)), 1) == got


def test_one_odd_page_in_a_large_host(spark):
    """Template inside the article stays template though a page of the host deviates."""
    make = lambda i, note: f"<body><article><h1>T{i}</h1><p>text {i}</p><div>{note}</div></article></body>"
    rows = [(i, f"http://h.example/{i}", make(i, "All rights reserved" if i else "Alle Rechte vorbehalten")) for i in range(60)]
    got = extracted(spark, rows)
    assert all(got[i] == f"T{i} text {i}" for i in range(1, 60)) and got[0] == "T0 text 0 Alle Rechte vorbehalten"


def test_hints_do_not_swallow_articles():
    text = lambda x: html_extract.main_text(x, None)
    assert text('<body class="no-sidebar"><article><p>a</p></article></body>') == "a"
    assert text('<article class="post social-science widget"><p>a</p></article>') == "a"
    assert text('<div class="sidebar"><article><p>a</p></article></div>') == "a"
    assert text('<div class="with-sidebar"><p>here</p></div><div class="comment-list"><p>a longer comment</p></div>') == "here"
    assert text('<div class="page widget"><p>all of the text on this page but for</p></div>.') == "all of the text on this page but for ."
    assert text('<article><p title="5" tall">text</p><p title="a>b">c</p></article>') == "text c"


def test_subjects_are_no_hints():
    text = lambda x: html_extract.main_text(f"<article><p>a</p>{x}</article>", None)
    for kept in ('<section class="related-work">b</section>', '<div class="comment-analysis">b</div>', '<div class="ad-hoc">b</div>', '<p class="share-price">b</p>', "<p><math><mi>b</mi></math></p>", "<dialog open>b</dialog>", '<div id="cookie-recipes">b</div>', '<div class="notice-period">b</div>'):
        assert text(kept) == "a b", kept
    for gone in ('<div class="comment-list">b</div>', '<div class="ad-slot-3">b</div>', '<div id="share_buttons">b</div>', "<dialog>b</dialog>", '<div class="cookie-banner">b</div>', '<section id="comments">b</section>', '<ul class="related-posts"><li>b</ul>'):
        assert text(gone) == "a", gone


def test_alternating_blocks_are_aligned_in_linear_time(spark):
    """Pages of 20,000 alternating blocks, and of 5,000 kinds of blocks, in the time of their reading."""
    import time

    many = lambda i, n: "".join(f"<h2>head {i} {k}</h2><p>text {i} {k}</p>" for k in range(n))
    kinds = lambda i: "".join(f"<div class='{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}'>w{i} {k}</div>" for k in range(5000))
    for make in (lambda i: many(i, 10_000 + i), kinds):
        a, b = (html_extract.Outline.of_page(html_extract.parse(f"<body><div>{make(i)}</div></body>")) for i in (1, 2))
        start = time.process_time()
        score, _ = html_extract.aligned(a, b)
        assert score == len(a.labels) and time.process_time() - start < 2
    rows = [(i, f"http://h.example/{i}", f"<body><div>menu of the host</div><div>{many(i, 10_000)}</div></body>") for i in range(9)]
    got = extracted(spark, rows)
    assert all(got[i] == " ".join(f"head {i} {k} text {i} {k}" for k in range(10_000)) for i in range(9))


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>inner</p>" + "</div>" * 3000
    long = "<article>" + "<p>word</p>" * 200_000 + "</article>"
    rows = [(i, f"http://h.example/{i}", "<body>" + deep + f"<p>{i}</p></body>") for i in range(10)] + [(20, "http://k.example", long)] * 2
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, seed long, host string")
    got = [(r.page_id, r.n_chars) for r in html_extract.extract_text(df).collect()]
    assert len(got) == 12 and got.count((20, 5 * 200_000 - 1)) == 2
    assert html_extract.extract_text(df.where("page_id < 0")).count() == 0


def test_alignment_is_greatest(spark):
    """Simple tree matching against its recursive definition, and every pairing is one of nodes with paired parents."""

    def brute(a, b, i, j):
        if a.labels[i] != b.labels[j]:
            return 0
        x, y = a.kids[i], b.kids[j]
        rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x)):
            for q in range(len(y)):
                rows[p + 1][q + 1] = max(rows[p][q + 1], rows[p + 1][q], rows[p][q] + brute(a, b, x[p], y[q]))
        return 1 + rows[-1][-1]

    rng = np.random.default_rng(5)

    def tree():
        n = rng.integers(1, 14)
        parent = [-1] + [int(rng.integers(k)) for k in range(1, n)]
        # Numbers in page order: children follow their parent's earlier children.
        order, todo = [], [0]
        while todo:
            k = todo.pop()
            order.append(k)
            todo += [c for c in range(n - 1, 0, -1) if parent[c] == k]
        place = {k: i for i, k in enumerate(order)}
        return html_extract.Outline(["html"] + rng.choice(["a", "b"], n - 1).tolist(), [-1] + [place[parent[k]] for k in order[1:]])

    for _ in range(200):
        a, b = tree(), tree()
        score, partner = html_extract.aligned(a, b)
        assert score == brute(a, b, 0, 0) == sum(p >= 0 for p in partner)
        used = [p for p in partner if p >= 0]
        assert len(set(used)) == len(used) and used == sorted(used)
        assert all(a.labels[i] == b.labels[p] and (not i or partner[a.parent[i]] == b.parent[p]) for i, p in enumerate(partner) if p >= 0)


def test_outline():
    page = html_extract.parse("<body><div><p>a<p>b <b>c</b><span><div>in</div></span></div><ul><li>1<li><a>22</a></ul></body>")
    o = html_extract.Outline.of_page(page)
    assert o.labels == ["html", "body", "div", "p", "div", "ul", "li"] and o.size[0] == 8 and o.links[0] == 2
    assert html_extract.Outline.of_shape(o.shape).kids == o.kids


def test_word_ids_are_those_of_the_tokenizer(monkeypatch):
    """Plain words by ranks, others by the tokenizer, whatever is remembered and forgotten between."""
    from addrflow.llm import packing
    from addrflow.llm.arrays import text_bytes

    tokenizer = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefgXYZäöüßéñçÑÉ0123456789'.,-#%&_"))
    odd = ["İstanbul", "Σίσυφος", "don't", "WE'LL'd", "ǅungla", "a\x1fb", "a\x1cb", "<|endoftext|>x", "中文字", "x\x85y", "x\xa0y", "e\u0301", "ŉa", "\xad", "'s't", "x" * 5000, "…", "𝔘1"]
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(60)) + "\n" + " ".join(rng.choice(odd, 3)) for _ in range(120)] + ["", " ", *odd]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1 << 21, 64, 700):
        monkeypatch.setattr(packing, "CACHE_WORDS", most)
        encoder = packing.WordTokens(PATH)
        assert encoder.plain.usable
        for block in (texts, texts[::-1], texts[40:50]):
            data, offsets = text_bytes(pa.array(block))
            ids, edge = encoder.encode(data, offsets)
            assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [want[texts.index(t)] for t in block]


def test_places():
    from addrflow.llm.packing import Places

    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 3000, dtype=np.uint64) & np.uint64(0xFFFF0000000000FF) | np.uint64(1 << 50))
    p = Places(len(keys))
    for part in np.array_split(keys, 3):
        assert (p.find(part) == -1).all()
        p.add(part)
    assert p.find(keys).tolist() == list(range(len(keys))) and p.find(keys + np.uint64(1 << 20)).max() == -1


def test_knapsack():
    value, count = best_pattern(np.array([3.0, 5.0]), np.array([2, 3]), 7)
    assert value == 11.0 and count.tolist() == [2, 1]


def test_plan_places_every_piece():
    counts = {3: 40, 7: 25, 10: 3, 16: 5}
    seen = dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, 16):
        assert times > 0 and sum(c * n for c, n in pattern.items()) <= 16
        for c, n in pattern.items():
            seen[c] += n * times
    assert seen == counts


def test_pack(docs, texts, no_docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = pack_documents(docs, PATH, capacity=256).collect()
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    assert all(sum(p.length for p in pieces[i]) == sum(map(len, own)) for i, own in ids.items())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_documents(no_docs, PATH).count() == 0


def test_special_tokens_in_text(spark):
    text = "a <|endoftext|>b it's fine"
    got = pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    own = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
    assert got.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_pipeline_end_to_end(spark, tmp_path):
    """All stages through packing, with null and empty texts, repeated rows, copies and a leaked item; then empty tables."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 900, n))
    item = " ".join(f"item{k}" for k in range(30))
    texts = {i: draw(120) for i in range(30)}
    texts |= {40: texts[3], 41: texts[4] + " tail", 42: draw(60) + " " + item + " " + draw(60), 43: None, 44: "", 45: "short", 46: draw(80) + " mail bob@mail.example end", 47: draw(5000)}
    texts[None] = draw(100)
    rows = [(i, t, "en" if i is not None else None, "s", len(t or "")) for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for folder, docs in (("full", rows), ("none", [])):
        spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / folder / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in range(48)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / folder / "labels.parquet"))
        spark.createDataFrame([(1, item)] if docs else [], "item_id long, text string").write.parquet(str(tmp_path / folder / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    ids = {r.doc_id for r in got}
    # The document without an id is as clean as the others.
    assert ids == {*range(30), 46, 47, None}
    tokens = Tokenizer.from_file(PATH)
    masked = texts[46].replace("bob@mail.example", "[EMAIL]")
    lengths = {i: len(tokens.encode(masked if i == 46 else texts[i], add_special_tokens=False).ids) + 1 for i in ids}
    assert all(sum(r.length for r in got if r.doc_id == i) == n for i, n in lengths.items())
    assert all(r.offset + r.length <= 2048 for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from addrflow.llm.decontamination import contaminated
    from addrflow.llm.near_dedup import near_duplicates

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, data).persist()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unique = corpus_pipeline.near_duplicate_stage(spark, kept, data).persist()
    assert near_duplicates(unique).where("NOT kept").count() == 0
    clean = corpus_pipeline.decontamination_stage(spark, unique, data)
    assert contaminated(clean, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0 and clean.columns == docs.columns
    masked = corpus_pipeline.pii_stage(spark, clean, data)
    assert masked.columns == docs.columns and masked.where("text rlike '@mail[0-9].example'").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "packing"]
