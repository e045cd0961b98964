"""Ratio of trusted to raw text against plain counts."""

import math
import re
from collections import Counter

import pytest
import xxhash

from tests.llm.helpers import docs, documents
from tidemark.llm import trusted_ratio


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def buckets(text):
    w = split_words(text)
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    return [h >> 50 for h in one + [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, w[1:])]]


def brute(rows, trusted):
    raw, good = Counter(), Counter()
    for i, text in rows:
        raw.update(buckets(text))
        if i is not None and i in trusted:
            good.update(buckets(text))
    size = trusted_ratio.BUCKETS
    share = lambda counts, b: math.log((counts[b] + 1) / (sum(counts.values()) + size))
    ratio = {b: round((share(good, b) - share(raw, b)) * 1e6) if good else 0 for b in raw}
    out = []
    for i, text in rows:
        w, own = split_words(text), buckets(text)
        times = Counter(zip(w, w[1:], w[2:]))
        places = {j + k for j in range(len(w) - 2) if times[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if split_words(x)]
        total = sum(ratio[b] for b in own)
        failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(places), failed, len(own), total, not failed and total >= len(own) * -50_000))
    return sorted(out, key=str)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "ratio_sum", "kept"]
TEXTS = [
    (10, "a a a a a a"), (11, "a b c a b c d"), (12, "one\n\n two \none\none\ttwo\n two \n"), (13, " ".join(f"w{i}" for i in range(60))), (14, " ".join(f"w{i}#$" for i in range(60))),
    (15, " ".join(f"w{i % 30}" for i in range(60))), (16, "x\x0by\x0cz q r \U0001f600 <a|b>"), (17, "a b"), (17, "a b c"),
]


def frame(spark):
    return docs(spark).unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_all_columns(spark, monkeypatch, broadcast):
    monkeypatch.setattr(trusted_ratio, "BROADCAST_IDS", broadcast)
    df = frame(spark)
    labels = spark.createDataFrame([(13, 1), (13, 1), (13, 0), (10, None), (None, 1), (3, 1), (14, 0), (999, 1)], "doc_id long, quality int").selectExpr("*", "1 AS trusted", "2 AS row")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r[n] for n in NAMES) for r in trusted_ratio.judge(df, labels).collect()), key=str) == brute(rows, {13, 3, 999})
    assert sorted((tuple(r[n] for n in NAMES) for r in trusted_ratio.judge(df, labels.where("false")).collect()), key=str) == brute(rows, set())
    assert trusted_ratio.judge(df.where("false"), labels).count() == 0


def test_junk_goes_and_clean_text_stays(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in trusted_ratio.judge(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    clean = [r.kept for r, q in labels if q == 1 and not r.base_failed]
    junk = [r.kept for r, q in labels if q == 0]
    assert sum(clean) / len(clean) > 0.995 and sum(junk) / len(junk) < 0.01
