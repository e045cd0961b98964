"""Spelling variants against deletions of every word."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import docs, documents
from tidemark.llm import spelling_variants as sv


def brute_counts(rows, least, every):
    n = Counter()
    for i, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return n


def one_edit(words):
    """Near words of each word: words that share a string with one place left out or open."""
    places = defaultdict(set)
    for w in words:
        places[w].add(w)
        for i in range(len(w)):
            places[w[:i] + w[i + 1 :]].add(w)
            places[w[:i] + "?" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for key, found in places.items():
        for a in found:
            for b in found:
                if a != b and ("?" in key or key in (a, b)):
                    near[a].add(b)
    return near


def brute(rows, least=6, count=5, ratio=5, every=None):
    n = {w: c for w, c in brute_counts(rows, least, every).items() if c >= count}
    near, form = one_edit(n), {}
    for w in n:
        best = min(((-n[x], x) for x in near[w]), default=None)
        if best and -best[0] >= ratio * n[w]:
            form[w] = best[1]
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def result(df, **more):
    return sorted(tuple(r) for r in sv.group_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def random_texts(alphabet, seed, words=400, shortest=1, longest=6):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list(alphabet), rng.integers(shortest, longest))) for _ in range(words)]
    return [(i, " ".join(rng.choice(pool, 300))) for i in range(12)]


@pytest.mark.parametrize("group", [4, 40, 8192])
@pytest.mark.parametrize("alphabet", ["ab", "abcdéÿ"])
def test_groups_of_any_size(spark, monkeypatch, group, alphabet):
    monkeypatch.setattr(sv, "GROUP", group)
    monkeypatch.setattr(sv, "BATCH", 50)
    monkeypatch.setattr(sv, "QUERIES", 16)
    rows = random_texts(alphabet, group)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, least_length=2, least_count=1, ratio=2) == brute(rows, 2, 1, 2)


def test_joined_keys_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(sv, "GROUP", 8)
    monkeypatch.setattr(sv, "HOT_KEYS", 0)
    monkeypatch.setattr(sv, "PIECE", 7)
    monkeypatch.setattr(sv, "PARTIAL", 5)
    rows = random_texts("abc", 9, longest=9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, least_length=3, least_count=2, ratio=3, misspell=7) == brute(rows, 3, 2, 3, 7)


def test_edges(spark):
    df = docs(spark).unionByName(spark.createDataFrame([(i, "colour\tcolor-colour COLOUR colours Cölour cölour ×÷words kolour") for i in range(5)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert result(df, misspell=199) == brute(rows, every=199)
    assert result(df, ratio=2) == brute(rows, ratio=2)
    assert result(df.where("false")) == []
    assert result(df.where("text IS NULL OR text = ''")) == []


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert result(documents(spark, sf_dir), misspell=199) == brute(rows, every=199)


def test_scan_skips_ranges():
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcdefghij"), 8)) for _ in range(4000)})
    table, lengths = sv.code_points(words)
    _, _, visited = sv.scan(table, lengths, np.zeros(len(words), np.int64), np.arange(200))
    prefixes = len({w[:i] for w in words for i in range(1, 9)})
    assert prefixes < 0.8 * 8 * len(words)  # rows of the matrix that ranges share
    assert visited < 0.05 * 200 * prefixes  # ranges looked into
