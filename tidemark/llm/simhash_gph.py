"""SimHash near-duplicates by generalised pigeonhole.

Bits that vary together are grouped into partitions. Two fingerprints that differ in at
most ``radius`` bits differ, for any thresholds that sum to ``radius - partitions + 1``,
in at most the threshold in some partition (a threshold of -1 leaves a partition out).
Each fingerprint chooses its thresholds by dynamic programming on candidate counts that a
bounded sample estimates, is stored under its value in every partition, and is looked up
under all values within the threshold. What is looked up is verified, on the whole
fingerprint, against what is stored there.

Only distinct fingerprints take part (with verification on texts, distinct pairs of
fingerprint and set of shingles). Rows meet by (partition, value); a value with more
than ``LARGEST_GROUP`` rows is cut into chunks and each pair of chunks becomes a group of
its own, so no task holds more than two chunks. A group gives a spanning forest of its
links, never all pairs.

Null and empty texts have fingerprint zero, linked like any other. Null ids take part;
a component's id is its smallest id, null only if all are. Repeated rows are copies of
each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.components import components
from tidemark.llm.rows import plain_words, stored, texts

#: Fingerprints from which correlations and candidate counts are estimated.
SAMPLE = 512
LARGEST_GROUP = 20_000
# Of verified links only the order of the tests: the first round gives all links of groups up to SMALL_GROUP, and
# CLOSEST of each member of larger ones; each round that follows gives GROWTH times as many, until none is left out.
SMALL_GROUP = 64
CLOSEST = 4
GROWTH = 16
MOST = 2  # largest threshold of a partition
ROW_COST, COMPARE_COST = 3.0, 0.0005  # of one signature row (its shuffle and disk) and of one comparison


def hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, of the whole if there are fewer."""
    found = plain_words(text)
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    n = max(1, len(found) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[: n - 1]]
    stops = ends[-n:]
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, stops)), np.uint64, n)


def mixed_again(h: np.ndarray) -> np.ndarray:
    """A second hash from a first (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> bytes:
    """Eight bytes, most significant first: a bit is set if it is in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h)).tobytes() if len(h) else bytes(8)


def print_of(h: np.ndarray, words64: int) -> bytes:
    parts = [majority(h)]
    for _ in range(words64 - 1):
        h = mixed_again(h)
        parts.append(majority(h))
    return b"".join(parts)


def fingerprint(text: bytes, shingle: int = 4, words64: int = 1, seed: int = 42, repeats: bool = False) -> bytes:
    """Of the set of a text's shingles; with ``repeats`` a shingle counts as often as it occurs."""
    h = hashes(text, shingle, seed)
    return print_of(h if repeats else np.unique(h), words64)


def fingerprints(docs: DataFrame, shingle: int = 4, words64: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id, ``text_hash``, ``fp`` (8 * ``words64`` bytes) and ``same`` of every row.

    ``same`` tells what has one fingerprint apart: without ``repeats`` it is a 128-bit hash of the set of shingles
    and its size in four bytes, so rows that share it have equal sets; with them it is null.
    """

    def run(batches):
        for batch in batches:
            fps, sets = [], []
            for text in texts(batch.column(2)):
                h = hashes(text, shingle, 42)
                h = h if repeats else np.unique(h)
                fps.append(print_of(h, words64))
                sets.append(None if repeats else xxhash.xxh3_128_digest(h.tobytes()) + len(h).to_bytes(4, "big"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "fp", "same"])

    text = F.col("text").cast("string")
    source = docs.select("doc_id", F.xxhash64(text, text.isNull()).alias("text_hash"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_hash long, fp binary, same binary")


@dataclass(frozen=True)
class Plan:
    radius: int
    groups: tuple[tuple[int, ...], ...]  # bit numbers of each partition
    sample: np.ndarray  # values of the sample in each partition
    total: int  # distinct fingerprints


def bits_of(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)


def values_of(bits: np.ndarray, groups) -> np.ndarray:
    return np.stack([bits[:, list(g)].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups])


def within(width: int, threshold: int) -> int:
    return sum(comb(width, d) for d in range(threshold + 1))


def partition_count(bits: int, radius: int, total: int) -> int:
    """Partitions at which rows and comparisons of evenly spread fingerprints cost least."""

    def cost(m: int) -> float:
        width, left = bits / m, radius + 1
        spent = 0.0
        for i in range(m):
            t = min(MOST, -(-left // (m - i)) - 1)
            left -= t + 1
            if t >= 0:
                near = within(round(width), t)
                spent += ROW_COST * near + COMPARE_COST * total * near / 2**width
        return spent if left <= 0 else float("inf")

    return min(range(1, min(bits, radius + 1) + 1), key=cost)


def correlated_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """Partitions of equal width; each takes the bits most correlated with those it has."""
    n = bits.shape[1]
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    link = np.abs(centred.T @ centred / np.outer(spread, spread))
    free, groups = set(range(n)), []
    for i in range(m):
        width = -(-len(free) // (m - i))
        own = [min(free, key=lambda b: (-max((link[b, c] for c in free if c != b), default=0), b))]
        free.discard(own[0])
        while len(own) < width:
            best = min(free, key=lambda b: (-link[b, own].sum(), b))
            own.append(best)
            free.discard(best)
        groups.append(own)
    return groups


def make_plan(nodes: DataFrame, radius: int) -> Plan | None:
    total = nodes.count()
    if not total:
        return None
    sample = [bytes(r["fp"]) for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    bits = bits_of(sample)
    groups = correlated_groups(bits.astype(float), partition_count(bits.shape[1], radius, total))
    return Plan(radius, tuple(map(tuple, groups)), values_of(bits, groups), total)


def thresholds(values: np.ndarray, plan: Plan) -> np.ndarray:
    """For each fingerprint (column) the threshold of each partition (row), by dynamic programming on estimated costs."""
    m, n = values.shape
    budget = plan.radius + 1  # the sum of thresholds + 1
    best = np.full((budget + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((m, budget + 1, n), np.int8)
    for i, group in enumerate(plan.groups):
        apart = np.bitwise_count(plan.sample[i][None, :] ^ values[i][:, None])
        costs = [np.zeros(n)]
        for t in range(min(MOST, len(group)) + 1):
            near = within(len(group), t)
            even = near / 2.0 ** len(group)
            share = ((apart <= t).sum(axis=1) + 4 * even) / (plan.sample.shape[1] + 4)
            costs.append(ROW_COST * near + COMPARE_COST * plan.total * share)
        now = np.full_like(best, np.inf)
        for used, cost in enumerate(costs):
            for s in range(used, budget + 1):
                new = best[s - used] + cost
                better = new < now[s]
                now[s][better] = new[better]
                choice[i, s][better] = used
        best = now
    taken = np.full((m, n), -1, np.int64)
    left = np.full(n, budget)
    for i in reversed(range(m)):
        used = choice[i, left, np.arange(n)]
        taken[i] = used - 1
        left = left - used
    return taken


def signatures(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(key, node, role, fp): where each fingerprint is stored (role 1), looked up (2) or both (3)."""
    masks = [
        [np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(g)), d)], np.int64) for t in range(MOST + 1)]
        for g in plan.groups
    ]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                node, part = (batch.column(c).slice(at, 2048) for c in (0, 1))
                values = values_of(bits_of(part.to_pylist()), plan.groups)
                chosen = thresholds(values, plan)
                keys, rows, roles = [], [], []
                for i in range(len(plan.groups)):
                    base = np.int64(i) << np.int64(48)
                    keys.append(base | values[i])
                    rows.append(np.arange(len(part)))
                    roles.append(np.where(chosen[i] >= 0, 3, 1))
                    for t in range(1, MOST + 1):
                        at_t = np.flatnonzero(chosen[i] == t)
                        if len(at_t):
                            near = masks[i][t][1:]  # the first is the value itself
                            keys.append((base | (values[i][at_t][:, None] ^ near[None, :])).ravel())
                            rows.append(np.repeat(at_t, len(near)))
                            roles.append(np.full(len(at_t) * len(near), 2))
                rows = pa.array(np.concatenate(rows))
                role = pa.array(np.concatenate(roles).astype(np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), node.take(rows), role, part.take(rows)], ["key", "node", "role", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, role byte, fp binary")


def group_links(members: np.ndarray, roles: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one group (rows of 64-bit words): those looked up against those stored."""
    probes, held = np.flatnonzero(roles & 2), np.flatnonzero(roles & 1)
    if not len(probes) or not len(held):
        return []
    found: set[tuple[int, int]] = set()
    label = np.arange(len(members))
    stored_words = members[held].T
    step = max(1, (1 << 18) // len(held))
    for at in range(0, len(probes), step):
        some = probes[at : at + step]
        apart = sum(np.bitwise_count(members[some, w][:, None] ^ stored_words[w][None, :]) for w in range(members.shape[1]))
        near_all = (apart <= radius) & (held[None, :] != some[:, None])
        for i in np.flatnonzero(near_all.any(axis=1)):
            p = int(some[i])
            near = held[near_all[i]]
            others, first = np.unique(label[near], return_index=True)
            for other, q in zip(others.tolist(), near[first].tolist()):
                if other != label[p]:
                    label[label == other] = label[p]
                    found.add((min(p, q), max(p, q)))
    return sorted(found)


def group_pairs(members: np.ndarray, roles: np.ndarray, labels: np.ndarray, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Links of one group between different labels: of each that is looked up, to the ``most`` nearest stored.

    A bounded number of comparisons at a time: places of both ends, and whether links were left out.
    """
    probes, held = np.flatnonzero(roles & 2), np.flatnonzero(roles & 1)
    if not len(probes) or not len(held):
        return
    stored_words = members[held].T
    step = max(1, (1 << 18) // len(held))
    for at in range(0, len(probes), step):
        some = probes[at : at + step]
        apart = sum(np.bitwise_count(members[some, w][:, None] ^ stored_words[w][None, :]) for w in range(members.shape[1]))
        near = (apart <= radius) & (labels[held][None, :] != labels[some][:, None])
        cut = np.flatnonzero(near.sum(axis=1) > most)
        for i in cut.tolist():
            far_first = np.flatnonzero(near[i])
            near[i, far_first[np.argsort(apart[i, far_first], kind="stable")[most:]]] = False
        i, j = np.nonzero(near)
        yield some[i], held[j], len(cut) > 0


def group_rows(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(key, cell, node, role, fp) of all groups; keys with too many rows are cut into a cell per pair of chunks."""
    met = signatures(nodes, plan)
    large = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGEST_GROUP)
    large = large.select("key", F.ceil(F.col("n") / LARGEST_GROUP).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(own, k) * F.col("chunks") + F.greatest(own, k))
    cells = met.join(large, "key", "left").withColumn("cell", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pairs)))
    return cells.select("key", "cell", "node", "role", "fp")


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple[int, int], list[list]]]:
    """The groups of rows sorted by (key, cell): both, and lists of the columns after them."""
    current, held = None, [[] for _ in range(columns)]
    for batch in batches:
        for key, cell, *values in zip(*(batch.column(i).to_pylist() for i in range(columns + 2))):
            if (key, cell) != current:
                if current is not None:
                    yield current, held
                current, held = (key, cell), [[] for _ in range(columns)]
            for column, value in zip(held, values):
                column.append(value)
    if current is not None:
        yield current, held


def as_words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between the nodes of distinct fingerprints: enough to connect all that are linked."""
    plan = make_plan(nodes, radius)
    if plan is None:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))
    rows = group_rows(nodes, plan).repartition("key", "cell").sortWithinPartitions("key", "cell", "node")

    def run(batches):
        def edges(found):
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["u", "v"])

        found = []
        for _, (ids, roles, fps) in grouped(batches, 3):
            if len(fps) > 1:
                found += [(ids[a], ids[b]) for a, b in group_links(as_words(fps), np.array(roles), radius)]
            if len(found) >= 50_000:
                yield edges(found)
                found = []
        yield edges(found)

    return rows.mapInArrow(run, "u long, v long").distinct()


def pairs_and_rest(rows: DataFrame, stars: DataFrame | None, radius: int, most: int, small: int) -> DataFrame:
    """Of group_rows(): links (u, v) between nodes of different stars, and again the rows (v is null) of groups that have more of them.

    Groups of at most ``small`` rows give all their links.
    """
    if stars is None:
        labelled = rows.withColumn("label", F.col("node"))
    else:
        labelled = rows.join(stars.withColumnRenamed("u", "node"), "node", "left").withColumn("label", F.coalesce("root", "node"))
    labelled = labelled.select("key", "cell", "node", "role", "fp", "label").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    names = ["u", "v", "key", "cell", "role", "fp"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.binary()]

    def run(batches):
        def made(columns):
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], names)

        waiting, size = [], 0
        for (key, cell), (ids, roles, fps, labels) in grouped(batches, 4):
            n, left_out = len(ids), False
            if n < 2:
                continue
            node = np.array(ids, np.int64)
            for a, b, cut in group_pairs(as_words(fps), np.array(roles), np.array(labels, np.int64), radius, n if n <= small else most):
                left_out |= cut
                waiting.append((np.minimum(node[a], node[b]), np.maximum(node[a], node[b])))
                size += len(a)
                if size >= 50_000:
                    yield made([*map(np.concatenate, zip(*waiting)), None, None, None, None])
                    waiting, size = [], 0
            if left_out:
                yield made([node, None, np.full(n, key), np.full(n, cell), roles, fps])
        if waiting:
            yield made([*map(np.concatenate, zip(*waiting)), None, None, None, None])

    return labelled.mapInArrow(run, "u long, v long, key long, cell int, role byte, fp binary")


def shingles(text: bytes, k: int) -> set[bytes]:
    found = plain_words(text)
    return {b" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))}


def similar_edges(edges: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges whose texts' shingle sets have at least this Jaccard similarity.

    Sets of too different sizes are told apart without their texts; only texts that still have an edge are moved.
    """
    size = F.conv(F.hex(F.substring("same", 17, 4)), 16, 10).cast("long")
    sized = lambda end: nodes.select(F.col("node").alias(end), size.alias(f"{end}_size"))
    # One more in the smaller set: two of its shingles may have shared a hash.
    enough = F.least("u_size", "v_size") + 1 >= F.greatest("u_size", "v_size") * similarity
    edges = stored(edges.join(sized("u"), "u").join(sized("v"), "v").where(enough).select("u", "v"), "near-in-size")
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    wanted = nodes.join(ends, "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    text = F.col("text").cast("string")
    hashed = docs.select("doc_id", text.alias("text"), F.xxhash64(text, text.isNull()).alias("text_hash"))
    found = hashed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # Rows that repeat have the same text: any of them will do.
    held = stored(found.groupBy("node").agg(F.any_value("text").alias("text")), "linked-texts")
    pairs = edges.join(held.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(texts(batch.column(2)), texts(batch.column(3))):
                a, b = shingles(a, shingle), shingles(b, shingle)
                both = len(a & b)
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def numbered(rows: DataFrame) -> DataFrame:
    """The distinct fingerprints (and sets of shingles) as nodes, each with its first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("first")
    return stored(rows.groupBy("fp", "same").agg(first).withColumn("node", F.monotonically_increasing_id()), "fingerprints")


def components_of(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Of rows of fingerprints(): every ``fp`` with its ``root``, and every root with the ``first`` row of its component.

    First rows are structs (missing, doc_id, text_hash).
    """
    nodes = numbered(rows)
    placed = stored(with_root(nodes, components(links(nodes, radius))), "components")
    return placed.select("fp", "root"), placed.groupBy("root").agg(F.min("first").alias("first"))


def with_root(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    placed = nodes.join(stars.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return placed.select("fp", "root", "first")


def verified_stars(nodes: DataFrame, radius: int, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Components (u, root) over all links within the radius whose texts are similar.

    Links are tested in rounds. A round gives, of each node in each group, the nearest nodes of other components that
    are not tested yet; groups of which links were left out come again with larger numbers. At the end every link is
    tested or lies within one component.
    """
    plan = make_plan(nodes, radius)
    none = nodes.where("false").select(F.col("node").alias("u"), F.col("node").alias("root"))
    if plan is None:
        return none
    rows, stars, tested, most, small = group_rows(nodes, plan), None, None, CLOSEST, SMALL_GROUP
    while True:
        given = stored(pairs_and_rest(rows, stars, radius, most, small), "links")
        pairs = given.where("v is not null").select("u", "v").distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        alike = similar_edges(pairs, nodes, docs, shingle, similarity)
        stars = components(alike if stars is None else alike.union(stars.select("u", F.col("root").alias("v"))))
        rows = given.where("v is null").select("key", "cell", F.col("u").alias("node"), "role", "fp")
        if rows.isEmpty():
            return stars
        most, small = most * GROWTH, 0


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, words64: int = 1) -> DataFrame:
    """doc_id, text_hash, fp and ``first`` (the first row of its component) of every row."""
    rows = stored(fingerprints(docs, shingle, words64).drop("same"), "fingerprint-rows").withColumn("same", F.lit(None).cast("binary"))
    placed, firsts = components_of(rows, radius)
    return rows.drop("same").join(placed.join(firsts, "root").drop("root"), "fp")


def keep_first(docs: DataFrame, radius: int = 22, shingle: int = 5, words64: int = 2, similarity: float = 0.8) -> DataFrame:
    """One document of each component, with all its columns.

    Fingerprints of 128 bits over the sets of five-word shingles: sets of Jaccard similarity
    0.8 are about 19 bits apart and unrelated ones 64, so a radius of 22 finds nearly all
    pairs from 0.8 upwards. What it finds, equal fingerprints too, is then held against the
    shingle sets themselves; only texts with equal sets are taken together without that.
    """
    rows = stored(fingerprints(docs, shingle, words64, repeats=False), "fingerprint-rows")
    nodes = numbered(rows)
    placed = with_root(nodes, verified_stars(nodes, radius, docs, shingle, similarity))
    kept = placed.groupBy("root").agg(F.min("first").alias("first"))
    keys = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    text = F.col("text").cast("string")
    hashed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(text, text.isNull()).alias("_text"))
    chosen = hashed.join(keys, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    one = F.row_number().over(Window.partitionBy(F.col("row.doc_id"), "_text").orderBy(F.xxhash64("row")))
    return chosen.withColumn("_nth", one).where("_nth = 1").select("row.*")


def simhash_digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
