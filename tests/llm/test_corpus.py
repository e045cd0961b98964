"""Token files, mix, near duplicates, shards and the pipeline against plain re-statements of the rules."""

import bisect
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import CLASHES, DOCS, docs, documents, plain_words
from tests.llm.test_text_scans import brute_passages
from tidemark.llm import components, curriculum, minimax_shards, phrase_index, simhash_gph, stages, toxic_neighbours
from tidemark.llm.piece_encoder import PieceEncoder
from tidemark.llm.rows import stored, words
from tidemark.llm.stages import TOKENIZER
from tidemark.llm.token_files import Settings, TokenFile, token_digest, write_token_files
from tidemark.session import scratch_path

# ---- token files


def plain_ids(texts):
    t = Tokenizer.from_file(TOKENIZER)
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def plain_token_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, out = 0, []
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def by_start(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_token_files_edges(spark):
    got = by_start(token_digest(docs(spark).repartition(3), Settings(TOKENIZER)))
    assert got == plain_token_rows([(i, t) for i, t, *_ in DOCS])
    assert token_digest(docs(spark, []), Settings(TOKENIZER)).count() == 0


def test_token_files_all_documents(spark, sf_dir):
    source = documents(spark, sf_dir)
    got = by_start(token_digest(source, Settings(TOKENIZER, sample=100)))
    assert got == plain_token_rows([(r.doc_id, r.text) for r in source.collect()])


def test_short_document_access(spark, sf_dir):
    folder = scratch_path(spark, "tokens")
    source = documents(spark, sf_dir)
    files = write_token_files(source.select("doc_id", "text"), folder, Settings(TOKENIZER, sample=100)).collect()
    text = {r.doc_id: r.text for r in source.collect()}
    for row in files[:2]:
        file = TokenFile(folder, row["file"])
        assert file.header["dictionary"] and file.index["ids"].sum() == row["ids"]
        for at in (0, len(file.index) - 1):
            assert file.ids(at).tolist() == plain_ids([text[file.keys[at].as_py()]])[0]


ENCODER = PieceEncoder(TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1é×÷.,\n \t'  漢ß_-\x1c\x85<|>", max_size=25), max_size=6))
def test_pieces_equal_whole_texts(texts):
    got = list(ENCODER.encode([t.encode() for t in texts]))
    assert [g.tolist() for g in got] == [ids[:-1] for ids in plain_ids(texts)]


def test_added_token_in_text():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>.", "tail <|endoftext|>  "]
    assert [g.tolist() for g in ENCODER.encode([t.encode() for t in texts])] == [i[:-1] for i in plain_ids(texts)]


# ---- mix


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, sum_weights = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / sum_weights > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / sum_weights for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def plain_mix(rows):
    """(doc_id, source, size) -> (source_size, target, taken)."""
    units = Counter((i, s, len(plain_words(t))) for i, t, s in rows)
    sizes = Counter()
    for (_, s, n), copies in units.items():
        sizes[s] += n * copies
    goals, out = plain_targets(sizes), {}
    key = lambda u: (hashlib.md5(f"0:{'' if u[0] is None else u[0]}".encode()).hexdigest(), u[0] is not None, u[0] or 0, u[2])
    at = Counter()
    for u in sorted(units, key=key):
        _, s, n = u
        uses = 0
        while n and at[s] + uses * sizes[s] < goals[s]:
            uses += 1
        out[u] = (sizes[s], goals[s], uses * n)
        at[s] += n * units[u]
    return out


def check_mix(rows, source):
    want = plain_mix([(r.doc_id, r.text, r.source) for r in source.collect()])
    by_key = defaultdict(list)
    for (i, _, n), v in want.items():
        by_key[i, n].append(v)
    assert len(rows) == source.count()
    for r in rows:
        assert any((r.source_size, r.taken) == (s, t) and math.isclose(r.target, g, rel_tol=1e-9) for s, g, t in by_key[r.doc_id, r.size])
        assert r.taken <= 3 * r.size


def test_mix_edges(spark):
    check_mix(curriculum.mix_digest(docs(spark)).collect(), docs(spark))
    assert curriculum.mix_digest(docs(spark, [])).count() == 0
    taken = curriculum.mixed(docs(spark), curriculum.mix_plan(docs(spark)))
    assert taken.columns == docs(spark).columns
    plan = plain_mix([(i, t, s) for i, t, _, s in DOCS])
    want = Counter()
    for i, t, _, s in DOCS:
        n = len(plain_words(t))
        if n:
            want[i] += plan[i, s, n][2] // n
    assert Counter(r.doc_id for r in taken.collect()) == +want


def test_mix_all_documents(spark, sf_dir):
    rows = curriculum.mix_digest(documents(spark, sf_dir)).collect()
    check_mix(rows, documents(spark, sf_dir))
    assert [tuple(r) for r in rows] == [tuple(r) for r in curriculum.mix_digest(documents(spark, sf_dir)).collect()]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_target_rule_is_consistent(sizes):
    goals = plain_targets({f"s{i}": n for i, n in enumerate(sizes)})
    assert math.isclose(sum(goals.values()), sum(sizes), abs_tol=1e-6)


def test_targets_with_limits(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 200, "B": 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in curriculum.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in got)


@pytest.mark.parametrize("schedule", [(1.5, 1.0, 0.5), (1.0, 1.0), (0.1, 2.0, 0.3, 1.0)])
def test_demand_is_inverted(spark, schedule):
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s,) for s in shares], "share double").select(curriculum.demand_inverse(F.col("share"), schedule).alias("t"))
    times = np.array([r.t for r in df.collect()])
    grid = np.linspace(0, 1, 20001)
    curve = np.interp(grid, np.linspace(0, 1, len(schedule)), schedule)
    demand = np.concatenate([[0], np.cumsum((curve[1:] + curve[:-1]) / 2)])
    assert np.allclose(np.interp(times, grid, demand / demand[-1]), shares, atol=1e-4)
    assert (np.diff(times) > 0).all()


def test_mix_follows_its_schedules(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]
    source = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = [r.source for r in curriculum.mixed(source, curriculum.mix_plan(source)).collect()]
    third = len(order) // 3
    assert order[:third].count("s0") > 1.5 * order[-third:].count("s0")
    assert order[:third].count("s2") < order[-third:].count("s2")


# ---- near duplicates


def plain_fingerprint(text, k=4):
    w = plain_words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius, alike=lambda a, b: True):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and alike(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def check_simhash(rows, source):
    data = sorted({(r.doc_id, r.text) for r in source.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    prints = {t: plain_fingerprint(t) for _, t in data}
    roots = plain_components([prints[t] for _, t in data], 4)
    want = Counter()
    copies = Counter((r.doc_id, r.text) for r in source.collect())
    for (i, t), root in zip(data, roots):
        want[i, f"{prints[t]:016x}", data[root][0]] += copies[i, t]
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_simhash_edges(spark):
    check_simhash(simhash_gph.simhash_digest(docs(spark)).collect(), docs(spark))
    assert simhash_gph.simhash_digest(docs(spark, [])).count() == 0
    kept = simhash_gph.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns and kept.where("doc_id = 3").count() == 1
    assert simhash_gph.keep_first(docs(spark, [])).count() == 0


def test_simhash_all_documents(spark, sf_dir):
    check_simhash(simhash_gph.simhash_digest(documents(spark, sf_dir)).collect(), documents(spark, sf_dir))


@pytest.mark.parametrize("limit", [20_000, 40])
def test_links_lose_nothing(spark, monkeypatch, limit):
    """Clusters of fingerprints a few bits apart, chunked groups and unequal thresholds included."""
    monkeypatch.setattr(simhash_gph, "LARGEST_GROUP", limit)
    rng = np.random.default_rng(11)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        centre = int(rng.integers(1 << 63)) & ~0xFFFF
        for _ in range(int(rng.integers(1, 12))):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(prints)], "node long, fp binary")
    for radius in (1, 4, 9):
        stars = {r.u: r.root for r in components.components(simhash_gph.links(nodes, radius)).collect()}
        assert [stars.get(i, i) for i in range(len(prints))] == plain_components(prints, radius)


@pytest.mark.parametrize("small", [64, 3])
def test_near_copies_are_found_and_others_stay(spark, monkeypatch, small):
    """Copies with a few words changed go; texts that share less than 0.8 of their shingles stay."""
    monkeypatch.setattr(simhash_gph, "SMALL_GROUP", small)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, number = [], 0
    for group in range(12):
        base = list(rng.choice(vocabulary, 300))
        for _ in range(8):
            copy = list(base)
            for at in rng.choice(300, rng.integers(0, 3), replace=False):
                copy[at] = "changed"
            rows.append((number, " ".join(copy)))
            number += 1
        half = base[:150] + list(rng.choice(vocabulary, 150))
        rows.append((number, " ".join(half)))
        number += 1
    source = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash_gph.keep_first(source).collect()}
    assert kept == {g * 9 for g in range(12)} | {g * 9 + 8 for g in range(12)}


def test_all_links_of_large_groups_are_tested(spark, monkeypatch):
    """A true pair whose nearest fingerprints are texts below the similarity: found however few links a round gives."""
    monkeypatch.setattr(simhash_gph, "SMALL_GROUP", 2)
    monkeypatch.setattr(simhash_gph, "CLOSEST", 1)
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = list(rng.choice(vocabulary, 200))
    rows = []
    for number in range(150):  # most pairs within the radius lie below 0.8
        copy = list(base)
        for at in rng.choice(20, 6, replace=False) * 10:
            copy[at] = f"own{number}x{at}" if at % 40 == 0 else f"own{at}"
        rows.append((number, " ".join(copy)))
    prints = [int.from_bytes(simhash_gph.fingerprint(t.encode(), 5, 2), "big") for _, t in rows]
    sets = [simhash_gph.shingles(t.encode(), 5) for _, t in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    roots = plain_components(prints, 22, alike)
    source = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash_gph.keep_first(source).collect()}
    assert kept == set(roots) and 1 < len(kept) < len(rows)


def test_repeats_neither_join_nor_part_texts(spark):
    """Against all pairs of shingle sets, without fingerprints: filler over half of a text, and passages repeated in one copy."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [f"{'filler ' * 400}{some(200)}" for _ in range(6)]
    for _ in range(6):
        text = some(300)
        rows += [text, f"{text} {(text[:150] + ' ') * 20}", text.upper().replace(" ", "  ")]
    sets = [simhash_gph.shingles(t.encode(), 5) for t in rows]
    roots = plain_components([0] * len(rows), 0, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    source = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in simhash_gph.keep_first(source).collect()} == set(roots) == {0, 1, 2, 3, 4, 5, 6, 9, 12, 15, 18, 21}


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    monkeypatch.setattr(simhash_gph, "print_of", lambda h, words64: bytes(8 * words64))
    monkeypatch.setattr(simhash_gph, "LARGEST_GROUP", 4)
    rows = [(i, " ".join(f"t{i // 2}x{j}" for j in range(30)) + " end" * (i % 2)) for i in range(12)]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_gph.keep_first(source).collect()) == [0, 2, 4, 6, 8, 10]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (2001, 2000)]
    stars = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert stars == {i: 0 for i in range(1, 51)} | {1000 + i: 1000 for i in range(1, 300)} | {2001: 2000}


# ---- shards


def plain_capacity(sizes, shards):
    def needed(capacity):
        n, now = 1, 0
        for s in sizes:
            if now + s > capacity:
                n, now = n + 1, 0
            now += s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


def check_shards(rows, texts, shards=16):
    assert len(rows) == len(texts)
    by_id = defaultdict(set)
    for i, t in texts:
        by_id[i].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    assert all((r.size, r.text_crc32) in by_id[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in rows)
    slots, load, place = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        place[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    groups = Counter()
    for _, t in texts:
        groups[hashlib.sha224(b"no text").hexdigest() if t is None else hashlib.sha256(t.encode()).hexdigest()] += len((t or "").encode()) + 1
    assert max(load.values()) == plain_capacity([groups[k] for k in sorted(groups)], shards)
    texts_apart = len({t for _, t in texts}) == len({(len((t or "").encode()), zlib.crc32((t or "").encode())) for _, t in texts})
    assert not texts_apart or all(len(p) == 1 for p in place.values())


@pytest.mark.parametrize("tail", [50_000, 2])
def test_shard_edges(spark, monkeypatch, tail):
    monkeypatch.setattr(minimax_shards, "TAIL_ROWS", tail)
    check_shards(minimax_shards.shard_digest(docs(spark)).collect(), [(i, t) for i, t, *_ in DOCS])
    assert minimax_shards.shard_digest(docs(spark, [])).count() == 0


@pytest.mark.parametrize("tail", [50_000, 30])
def test_shards_all_documents(spark, sf_dir, monkeypatch, tail):
    monkeypatch.setattr(minimax_shards, "TAIL_ROWS", tail)
    source = documents(spark, sf_dir)
    check_shards(minimax_shards.shard_digest(source).collect(), [(r.doc_id, r.text) for r in source.collect()])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=30), st.integers(1, 6))
def test_search_end_is_optimal(sizes, shards):
    points = np.cumsum(sizes).tolist()
    low = max(max(sizes), -(-points[-1] // shards))
    capacity, cuts = minimax_shards.finish(points, low, low + max(sizes), shards, points[-1])
    assert capacity == plain_capacity(sizes, shards) and cuts[-1] == points[-1]
    assert all(c in points for c in cuts) and bisect.bisect_right(cuts, 0) == 0


# ---- pipeline


def plain_harmless(spark, source, labels):
    """Rows whose exact cosine neighbours, by a dense matrix, vote below one half."""
    model = toxic_neighbours.fit(source.select("doc_id", "text"), labels)
    blocks = model.most.shape[1]
    dense = np.zeros((len(model.ids), len(model.terms)))
    for t in range(len(model.terms)):
        for b in range(blocks):
            at = slice(model.starts[t * blocks + b], model.starts[t * blocks + b + 1])
            dense[model.numbers[at], t] = model.weights[at]

    def score(text):
        counts = Counter(model.terms[w] for w in words((text or "").encode()) if w in model.terms)
        if not counts:
            return model.base
        query = np.zeros(len(model.terms))
        at, weights = toxic_neighbours.vector(counts, model.idf)
        query[at] = weights
        cosine = np.round(dense @ query, 12)
        best = [i for i in np.lexsort((model.ids, -cosine)) if cosine[i] > 0][: model.settings.neighbours]
        weight = cosine[best] / (1.05 - cosine[best]) * model.votes[best]
        return ((weight * model.toxic[best]).sum() + model.settings.prior * model.base) / (weight.sum() + model.settings.prior)

    return [r for r in source.collect() if score(r.text) < 0.5]


def test_pipeline_against_plain_steps(spark, sf_dir):
    import corpus_pipeline

    source, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = sorted(plain_harmless(spark, source, labels), key=lambda r: r.doc_id)
    prints = [int.from_bytes(simhash_gph.fingerprint((r.text or "").encode(), 5, 2), "big") for r in rows]
    sets = [simhash_gph.shingles((r.text or "").encode(), 5) for r in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    rows = [r for at, (r, root) in enumerate(zip(rows, plain_components(prints, 22, alike))) if at == root]
    rows = [r for r in rows if not brute_passages(r.text, items)[-1]]
    plan = plain_mix([(r.doc_id, r.text, r.source) for r in rows])
    mix = []
    for r in rows:
        n = len(plain_words(r.text))
        mix += [(r.doc_id, r.text)] * (plan[r.doc_id, r.source, n][2] // n if n else 0)
    found, without_start = by_start(corpus_pipeline.run(spark, sf_dir)), lambda rows: sorted((r[0], *r[2:]) for r in rows)
    assert without_start(found) == without_start(plain_token_rows(mix))
    assert [r[1] for r in found] == np.cumsum([0, *[r[2] for r in found]])[:-1].tolist()


def test_schedules_order_the_token_files(spark):
    rows = [(i, f"text {i} of a source", "en", "ab"[i % 2]) for i in range(60)]
    orders = []
    for schedules in (curriculum.SCHEDULES, curriculum.SCHEDULES[::-1]):
        frame = docs(spark, rows).select("doc_id", "text", "source")
        mix = stored(curriculum.mixed(frame, curriculum.mix_plan(frame, schedules=schedules)), "mix")
        in_files = [r.doc_id for r in mix.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
        found = stages.write_tokens(spark, mix, "").orderBy("start").collect()
        assert [r.doc_id for r in found] == in_files
        orders.append(in_files)
    assert orders[0] != orders[1]


def test_colliding_pieces_are_told_apart():
    """Texts that are equal under every polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(11):
        word += word.translate({97: "b", 98: "a"})
    pair = [word, word.translate({97: "b", 98: "a"})]
    texts = [*pair, " ".join(pair), "a\0", "a", "fifteen letters", "sixteen letters!"]
    found = ENCODER.encode([t.encode() for t in texts])
    assert [f.tolist() for f in found] == [ENCODER.whole(t.encode()).tolist() for t in texts]


def test_stages_keep_columns_and_accept_empty_tables(spark, sf_dir):
    import corpus_pipeline

    for rows in (DOCS, []):
        frame = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf_dir)
            assert frame.columns == docs(spark).columns and set(CLASHES) <= set(frame.columns)
        left = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir)
        assert left.count() == frame.count()
    assert phrase_index.WIDTH == 10
