"""License scan, phrase index, page text."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import DOCS, docs, documents, words
from tidemark.llm import html_density, license_scan, phrase_index

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base_places(text):
    found, w = [], words(text)
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), found


def check_licenses(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        n, found = base_places(text)
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_edges(spark):
    rows = license_scan.license_digest(license_scan.scan_licenses(docs(spark).coalesce(1))).collect()
    check_licenses(rows, [t for _, t, *_ in DOCS])
    assert license_scan.license_digest(license_scan.scan_licenses(docs(spark, []))).count() == 0


def test_license_all_documents(spark, sf_dir):
    source = documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in source.collect()}
    rows = license_scan.license_digest(license_scan.scan_licenses(source)).collect()
    check_licenses(rows, [texts[r.doc_id] for r in rows])
    assert any(r.n_base for r in rows) and any(r.n_base == 0 for r in rows)


def test_license_containment_is_exact():
    """Each template's fullest block is found whenever it reaches the threshold, whatever filters do."""
    t = license_scan.Template("t", "t", "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0.7)
    by_word = license_scan.probes([t], {b"alpha": 9, b"beta": 5})
    text = "alpha beta x gamma y delta epsilon zeta z eta q r s t u v w".encode().split()
    assert [m["containment"] for m in license_scan.matches(text, by_word)][:1] == [0.7]
    assert license_scan.matches("alpha beta gamma delta epsilon zeta".encode().split(), by_word) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdexyz"), max_size=40), st.integers(1, 100))
def test_license_filters_lose_nothing(text, percent):
    t = license_scan.Template("t", "t", "a b c d e", percent / 100)
    doc = [c.encode() for c in text]
    probe = license_scan._Probe(t, {b"a": 3, b"c": 1})
    found = {(m["start"], m["stop"]) for m in license_scan.matches(doc, license_scan.probes([t], {b"a": 3, b"c": 1}))}
    for block in range(len(doc) // probe.stride + 1):
        here = doc[block * 5 : block * 5 + 10]
        if len(set(here) & set(probe.rank)) >= probe.need:
            at = [block * 5 + i for i, w in enumerate(here) if w in probe.rank]
            assert (at[0], at[-1] + 1) in found


def brute_passages(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        b = words(item)
        if not b:
            continue
        k = min(10, len(b))
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(str(item_id))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "X"), (3, None), (4, ""), (10, "two spaces tabs"), (10, "all rights reserved")]


@pytest.mark.parametrize("block_words", [500_000, 5])
def test_passage_edges(spark, monkeypatch, block_words):
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", block_words)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = phrase_index.passage_digest(phrase_index.find_passages(docs(spark), items)).collect()
    want = sorted((str(i), *brute_passages(t, ITEMS)) for i, t, *_ in DOCS)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want
    none = items.where("false")
    assert not any(r.contaminated for r in phrase_index.passage_digest(phrase_index.find_passages(docs(spark), none)).collect())
    assert phrase_index.find_passages(docs(spark, []), items).count() == 0
    kept = phrase_index.without_passages(docs(spark), items)
    assert kept.columns == docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])


def test_proximity(spark):
    data = [(1, "the red quick fox runs over"), (2, "red a b c d e f g quick fox"), (3, "quick red fox")]
    source = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick red fox")], "item_id long, text string")
    rows = {r.doc_id: r for r in phrase_index.find_passages(source, items, slack=2).collect()}
    assert [len(rows[i].matches) for i in (1, 2, 3)] == [0, 0, 1]
    assert [bool(rows[i].near) for i in (1, 2, 3)] == [True, False, True]


PAGES = {
    "<article><header><h1>T</h1></header><p>Hello &amp; &lt;b&gt;&nbsp; world<ul><li>One<li>Two</ul><aside>side</aside></article>": "Hello & <b> world\nOne\nTwo",
    "<body><h1>Head</h1><p>Text one is here, long enough.</p><p>Text two is here, long enough.</p><div class=footer>foot</div>": "Head\nText one is here, long enough.\nText two is here, long enough.",
    "<html><body><nav><a href=/>Home</a></nav><div id=content><p>First paragraph of the text.<br>After it</div><div class='reader-comments'><p>So long a comment that it would win.</div>": "First paragraph of the text.\nAfter it",
    "<p><b>Never closed<br><p>Next<script>var t='</p>'</script> one": "Never closed\nNext one",
    "<main><section><h2>A</h2><p>para one long</section><section><h2>B</h2><p>two</section></main><div class='cookie-notice'>We use cookies. We use cookies. We use cookies.</div>": "A\npara one long\nB\ntwo",
    "no markup  at\nall": "no markup at all",
    "<!-- only a comment": "",
    "<a title='x > y'>link</a": "link",
    "": "",
}


def test_page_text(spark):
    pages = [(i, "u", h) for i, h in enumerate(PAGES)] + [(99, None, None), (None, "u", "<p>x"), (0, "u", next(iter(PAGES)))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    rows = html_density.extract_text(df).collect()
    assert [r.text for r in rows] == [*PAGES.values(), "", "x", next(iter(PAGES.values()))]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_density.extract_text(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab p&;\"'=!- \n", max_size=60))
def test_any_markup_is_read(page):
    assert isinstance(html_density.main_text(page), str)


def test_page_text_all_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in pages.join(html_density.extract_text(pages).drop("url"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert r.text == "\n".join(p for p in parts if p)
