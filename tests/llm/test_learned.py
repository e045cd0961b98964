"""Language model, toxicity and vector search against plain re-statements and held-out rows."""

import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

from tests.llm.helpers import docs, documents, plain_words
from tidemark.llm import collision_ann, context_tree, toxic_neighbours
from tidemark.llm.rows import WRITTEN, words


class PlainTree:
    """Context-tree weighting by recursion over all training places."""

    def __init__(self, texts, depth, nodes):
        self.depth = depth
        self.places = []
        for t in texts:
            x = bytes(depth) + t + b"\0"
            self.places += [(x[j - depth : j][::-1], x[j]) for j in range(depth, len(x))]
        seen = Counter(c[:d] for c, _ in self.places for d in range(3, depth + 1))
        frequent = {c for c, n in seen.items() if n * nodes >= len(self.places)}
        self.kept = {c for c in frequent if all(c[:d] in frequent for d in range(3, len(c)))}
        self.trees = {}

    @staticmethod
    def estimate(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - 2 * math.lgamma(0.5)

    def build(self, context, items):
        d = len(context)
        z, o = sum(b == 0 for _, b in items), sum(b == 1 for _, b in items)
        own = self.estimate(z, o)
        below, children, rest = defaultdict(list), {}, [0, 0]
        for c, b in items:
            k = c[: d + 1]
            if d < self.depth and (d < 2 or k in self.kept):
                below[k].append((c, b))
            else:
                rest[b] += 1
        wanted = list(below) if d < 2 else [k for k in self.kept if len(k) == d + 1 and k[:d] == context]
        children = {k: self.build(k, below[k]) for k in wanted}
        if d == self.depth or not children:
            return {"kt": (o + 0.5) / (z + o + 1), "whole": own, "children": None}
        under = sum(c["whole"] for c in children.values()) + self.estimate(*rest)
        stay = 1 / (1 + math.exp(max(-700, min(700, under - own))))
        return {"kt": (o + 0.5) / (z + o + 1), "whole": np.logaddexp(own, under) - math.log(2), "children": children, "stay": stay, "rest": (rest[1] + 0.5) / (sum(rest) + 1)}

    def one(self, node, context, d=0):
        if node["children"] is None:
            return node["kt"]
        child = node["children"].get(context[: d + 1])
        p = self.one(child, context, d + 1) if child else node["rest"]
        return node["stay"] * node["kt"] + (1 - node["stay"]) * p

    def score(self, text):
        x, total = bytes(self.depth) + text + b"\0", 0.0
        for j in range(self.depth, len(x)):
            node = 1
            for level in range(8):
                if node not in self.trees:
                    items = [(c, (s >> (7 - level)) & 1) for c, s in self.places if (s | 256) >> (8 - level) == node]
                    self.trees[node] = self.build(b"", items)
                bit = (x[j] >> (7 - level)) & 1
                p = self.one(self.trees[node], x[j - self.depth : j][::-1])
                total += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        return total


def held_out(i, folds, rest):
    return i is not None and zlib.crc32(str(i).encode()) % folds == rest


def check_scores(rows, texts, monkeypatch_nodes):
    train = [(t or "").encode() for i, t in texts if not held_out(i, 7, 2)]
    tree = PlainTree(train, context_tree.DEPTH, monkeypatch_nodes)
    counts = Counter(w for t in train for w in [*plain_words(t.decode()), None])
    total, distinct = sum(counts.values()), len(counts)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, r)
    for i, text in texts:
        r = by_id[i]
        tokens = [*plain_words(text), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held_out(i, 7, 2), len(tokens), total)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens), abs_tol=1e-6)
        if text is None or len(text) < 1000:
            assert math.isclose(r.score, tree.score((text or "").encode()), rel_tol=1e-5, abs_tol=1e-4)


def test_context_tree_is_exact(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "NODES", 64)
    monkeypatch.setattr(context_tree, "FREQUENT", 3)
    rng = np.random.default_rng(3)
    texts = [(i, "".join(rng.choice(list("aAb c"), rng.integers(0, 50)))) for i in range(30)] + [(41, None), (42, ""), (None, "no id")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_scores(context_tree.language_scores(df).collect(), texts, 64)


def test_context_tree_keeps_rare_contexts(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 300)  # several blocks and buckets
    rng = np.random.default_rng(5)
    common = [(i, "".join(rng.choice(list("ab "), 2000))) for i in range(12)]
    texts = [*common, (20, "a rare word: zyxwv"), (24, "zyxwv again"), (41, None), (42, "")]
    assert sum(len((t or "").encode()) + 1 for i, t in texts if not held_out(i, 7, 2)) > 1 << 14
    rows = context_tree.language_scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(2)).collect()
    short = [(i, t) for i, t in texts if len(t or "") < 1000]
    train = [(t or "").encode() for i, t in texts if not held_out(i, 7, 2)]
    tree, by_id = PlainTree(train, 4, 1 << 60), {r.doc_id: r.score for r in rows}
    for i, text in short:
        assert math.isclose(by_id[i], tree.score((text or "").encode()), rel_tol=1e-5, abs_tol=1e-4)


def test_context_tree_keeps_its_files_small(spark, monkeypatch):
    sizes, stored = {}, context_tree.stored

    def measured(df, name):
        out = stored(df, name)
        sizes[name] = sum(f.stat().st_size for f in Path(WRITTEN[-1].removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(context_tree, "stored", measured)
    rng = np.random.default_rng(7)
    texts = [(i, bytes(rng.choice(list(b"abcdefghijklmnop"), 5000).tolist()).decode()) for i in range(200)]  # four bits a letter
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert context_tree.language_scores(df).count() == 200
    assert sizes["blocks"] < 0.65 * 200 * 5000
    assert sizes["partial-counts"] < 2 * 200 * 5000  # nearly every place has a (context, byte) of its own


def test_steps_are_read_back():
    values, sizes = np.array([5, 9, 1 << 33, 2, 3, 7, (1 << 34) - 1]), np.array([3, 1, 3])
    column = pa.chunked_array([context_tree.lists(context_tree.steps(values, sizes), sizes)])
    assert context_tree.grams_in(column).tolist() == values.tolist()
    assert context_tree.grams_in(pa.chunked_array([column.slice(1).combine_chunks()])).tolist() == values[3:].tolist()


def test_packs_keep_ids_and_texts(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "PACK_BYTES", 20)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 70)
    rows = [("a", "x" * 50), (None, None), ("b", ""), ("b", "é" * 9), ("c", "c" * 200), ("d", None), ("e", "e")]
    blocks = context_tree.in_blocks(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1))
    packs = sorted(blocks.toArrow().to_pylist(), key=lambda p: p["row"])
    table = pa.Table.from_pylist(packs, blocks.toArrow().schema)
    assert [i for p in packs for i in p["doc_id"]] == [i for i, _ in rows]
    assert list(context_tree.unpacked(table)) == [(t or "").encode() for _, t in rows]
    assert [n for p in packs for n in p["n_bytes"]] == [len((t or "").encode()) for _, t in rows]
    assert [[p["block"]] * len(p["row"]) for p in packs] == [[0], [0, 0, 0], [0], [3, 3]]


def test_context_tree_edges(spark):
    rows = context_tree.language_scores(docs(spark)).collect()
    assert len(rows) == docs(spark).count() and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert context_tree.language_scores(docs(spark, [])).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(99) if held_out(i, 7, 2)), "ab")], "doc_id long, text string")
    row = context_tree.language_scores(alone).first()  # nothing to learn from: every bit one half
    assert math.isclose(row.score, 24 * math.log10(0.5), rel_tol=1e-6) and row.train_tokens == 0


def test_context_tree_predicts_held_out_text(spark, sf_dir):
    rows = [r for r in context_tree.language_scores(documents(spark, sf_dir)).collect() if r.held_out]
    assert np.median([r.bits_per_byte for r in rows]) < 3.2


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(0, 0, 1), (3, 1, 0), (3, 1, 1), (None, 0, 1), (4, 0, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxic_neighbours.toxicity_digest(docs(spark), labels).collect()
    assert len(rows) == docs(spark).count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == held_out(r.doc_id, 5, 0) for r in rows)
    assert all(r.score == 0 for r in toxic_neighbours.toxicity_digest(docs(spark), labels.where("false")).collect())
    assert toxic_neighbours.toxicity_digest(docs(spark, []), labels).count() == 0
    assert toxic_neighbours.without_toxic(docs(spark), labels).columns == docs(spark).columns


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(5)
    terms = [bytes([97 + i]) for i in range(12)]
    idf = rng.uniform(0.2, 4, 12)
    vectors = [(i, int(rng.integers(2)), {int(t): int(rng.integers(1, 4)) for t in rng.choice(12, rng.integers(0, 4), replace=False)}) for i in range(300)]
    model = toxic_neighbours.build_model(vectors, terms, idf, {0: 2.0, 1: 1.0}, toxic_neighbours.Settings(neighbours=7, block=16))
    dense = {}
    for i, _, counts in vectors:
        if counts:
            at, w = toxic_neighbours.vector(Counter(counts), idf)
            dense[i] = np.bincount(at, w, 12)
    for _ in range(200):
        counts = Counter({int(t): 1 for t in rng.choice(12, rng.integers(1, 4), replace=False)})
        at, w = toxic_neighbours.vector(counts, idf)
        query = np.bincount(at, w, 12)
        best = sorted(((-round(float(v @ query), 12), i) for i, v in dense.items() if v @ query > 0))[:7]
        found, cosine = toxic_neighbours.nearest(model, counts)
        assert np.allclose(cosine, [-s for s, _ in best], atol=1e-9)
        sure = {i for s, i in best if -s > -best[-1][0] + 1e-9}
        assert sure <= {model.ids[n] for n in found.tolist()}


def test_toxicity_of_a_toxic_majority_with_text_ids(spark):
    """Three rows in five are toxic and ids are texts: scores still tell the classes apart and name the examples."""
    rows = []
    for i in range(400):
        toxic = i % 5 < 3
        rows.append((f"d{i:03}", f"w{i % 7} w{i % 11} plain " + (f"foul{i % 3} nasty" if toxic else f"kind{i % 2}"), int(toxic)))
    source = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id string, toxic int")
    got = {r.doc_id: r for r in toxic_neighbours.toxicity_digest(source, labels).collect()}
    assert all(got[i].predicted == toxic for i, _, toxic in rows)
    toxic_ids = {i for i, _, toxic in rows if toxic and not held_out(i, 5, 0)}
    assert all({e.doc_id for e in got[i].evidence if e.toxic} <= toxic_ids and got[i].evidence for i in got if got[i].predicted)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    source, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r.doc_id: r for r in toxic_neighbours.toxicity_digest(source, labels).collect()}
    pairs = Counter((r.toxic, scored[r.doc_id].predicted) for r in labels.collect() if scored[r.doc_id].held_out)
    assert pairs[1, 1] / (pairs[1, 1] + pairs[1, 0]) > 0.85
    assert pairs[0, 1] / (pairs[0, 0] + pairs[0, 1]) < 0.03
    assert words(b"A-b") == [b"a", b"b"]


def brute_nearest(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            out[q] = sorted(((-float((v * x).sum()), i) for i, v in rows if i != q))[:k]
    return out


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [0.5, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (20, [-1.0, 0.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as label", "2 as score", "3 as rank")
    rows = collision_ann.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [
        (0, 1, 7, 2.0), (0, 2, 8, 2.0), (0, 3, 1, 0.5), (0, 4, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 0, -1.0), (20, 3, 7, -2.0), (20, 4, 8, -2.0),
    ]
    assert collision_ann.search(df.where("false")).count() == 0
    assert collision_ann.search(df.where("vec_id = 1")).count() == 0


def test_vector_recall(spark, monkeypatch):
    monkeypatch.setattr(collision_ann, "BLOCK", 700)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = collision_ann.search(df).collect()
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for _, i in w}) / len(w) for q, w in want.items()])
    assert recall >= 0.95
    for g in got.values():
        assert all(a >= b for (_, a), (_, b) in zip(g, g[1:]))
