"""Hard negatives against all products, and what the intervals promise."""

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn


def brute(rows, every=50, k=5, m=3):
    """anchor, positive, rank, negative and both scores, from all pairs in exact integers."""
    kept = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept[vec_id, label, tuple(int(np.floor(256 * float(x))) for x in v)] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in kept:
        if a[0] % every:
            continue
        others = [(-dot(a, b), b[0], b[1] == a[1]) for b in kept if b != a and len(b[2]) == len(a[2])]
        for p, positive, _ in sorted(o for o in others if o[2])[:k]:
            fit = sorted((s, i) for s, i, same in others if not same and 50 * -p <= 100 * -s <= 95 * -p)
            out += [(a[0], positive, r, i, -p, -s) for r, (s, i) in enumerate(fit[:m], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hn.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS number", "2 AS score", "3 AS rank", "'x' AS size")


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.9, 0.1]), (3, 2, [0.9, 0.1]), (4, 2, [0.8, 0.0]), (5, 2, [0.7, 0.1]), (6, None, [1.0, 1.0]), (7, 2, None), (8, 2, [nan, 1.0]),
        (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (11, 2, []), (12, 1, [0.0, 0.0]), (13, 2, [0.0, 0.0]), (14, 1, [-1.0, -1.0]), (50, 1, [1.0, 0.5]), (50, 1, [1.0, 0.5]), (50, 2, [1.0, 0.5]),
        (100, 1, [0.5, 0.5, 0.5]), (101, 1, [0.5, 0.5, 0.6]), (102, 3, [0.5, 0.4, 0.5]), (None, 1, [1.0, 1.0]), (150, 9, [1.0, 1.0]), (-50, 2, [0.3, -0.2]), (16, 2, [1e30, 1.0]),
    ]
    ok = [r for r in rows if r[0] != 16]
    assert mined(frame(spark, rows)) == brute(ok)  # a vector whose products are no longs takes no part
    assert mined(frame(spark, rows).where("false")) == []
    assert mined(frame(spark, rows).where("vec_id = 1")) == []
    assert mined(frame(spark, rows).where("vec_id = 0")) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 2), [float(x) for x in rng.normal(0, 2e5, 9)]) for i in range(0, 120)]
    assert mined(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("block_values", [300, 1 << 18])
def test_blocks_groups_and_one_hot_label(spark, monkeypatch, block_values):
    monkeypatch.setattr(hn, "BLOCK_VALUES", block_values)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 10))
    rows = [(int(i), int(0 if rng.random() < 0.4 else rng.integers(10)), [round(float(x), 2) for x in centres[rng.integers(4)] + rng.normal(0, 0.4, 10)]) for i in range(0, 600)]
    rows += [(i + 1000, label, v) for i, label, v in rows[:40]] + rows[:30]
    assert mined(frame(spark, rows)) == brute(rows)


def data(n, size, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int32)


def build(x, labels):
    order = np.argsort(labels, kind="stable")
    c = hn.Codes(x[order])
    return hn.Block(np.arange(len(x))[order], labels[order].astype(np.int32), x[order], c.codes, c.align, c.left)


@pytest.mark.parametrize("size", [1, 64, 100])
def test_intervals_hold_the_score_and_shrink(size):
    x = data(400, size)
    block = build(x, np.zeros(400, np.int32))
    anchors = hn.Anchors(np.arange(20), np.arange(20), np.zeros(20, np.int32), x[:20])
    for i in range(20):
        search, widths = hn.Search(block, anchors, i, np.arange(400)), []
        exact = x @ x[i].astype(np.int64)
        assert (search.scored() == exact).all()
        for level in range(hn.LEVELS):
            low, high = search.interval(level)
            assert (low <= exact).all() and (exact <= high).all()
            widths.append(float((high - low).mean()))
        assert widths == sorted(widths, reverse=True)


def test_rotation_keeps_products():
    x = data(50, 100).astype(float)
    assert np.allclose(hn.rotate(x) @ hn.rotate(x).T, x @ x.T)


def test_intervals_spare_most_integer_scores():
    x = data(4000, 64)
    labels = np.arange(4000) % 2
    block, scored = build(x, labels), []
    anchors = hn.Anchors(np.arange(10), np.arange(10), (np.arange(10) % 2).astype(np.int32), x[:10], np.full((10, 1), 30_000))
    for i in range(10):
        best = hn.Best(5)
        scored.append(hn.find_positives(block, anchors, i, best))
        own = [hn.Best(3)]
        scored.append(hn.find_negatives(block, anchors, i, own))
        assert len(best.ids) == 5 and len(own[0].ids) == 3
    assert max(scored) < 400 and sum(scored) / len(scored) < 250  # of 2,000 rows each
