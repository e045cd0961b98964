"""Hard negatives by rotated one-bit codes with stored alignment and sure intervals.

Components become integers, and scores are their integer inner products. Every vector is
rotated (random signs and Walsh-Hadamard steps, which keep inner products) and coded by the
signs of its coordinates. With the code as a unit vector c, the vector is ``a*c + r``: the
alignment ``a`` (its product with the code) and the length of the residual r are stored.
Residuals are coded again, ``LEVELS`` codes in all, so that a later level leaves less of it.

An anchor is rotated too and rounded to ``PLANES`` bit planes. Popcounts of code and plane
give its product s with each code, their sum ``a*s`` over the levels the estimate. What is
left is bounded by Cauchy and Schwarz: the residual is orthogonal to the last code, hence at
most ``|r| * sqrt(|q|^2 - s^2)``, and the rounding at most ``|v| * |q - rounded q|``. The true
score lies in that interval, always. Level after level, rows whose interval cannot reach the
result are dropped; the rest are scored in integers. The result is exact.

Rows of all labels stand in blocks of ``BLOCK_VALUES`` components, sorted by label. Groups of
blocks form the tasks; blocks of at most ``ANCHORS`` anchors go through every group, and each
group hands on, for each anchor, no more rows than are asked for. So neither a task nor the
driver holds more than a group and one block of anchors, whatever a label's share of rows.

Rows without id, label or vector, with an empty vector or a null or non-finite component take
no part, nor do those whose squared integer length is 2^61 or more: the product of two such
vectors is no long. Rows equal in id, label and vector count once; other rows that share an id
are rows of their own. Vectors of different lengths do not meet. Ties go to the smaller id.
An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import stored

LEVELS = 4
PLANES = 6
BLOCK_VALUES = 1 << 19
ANCHORS = 1024
GROUP_BLOCKS = 8
PROBES = 3  # rows of the best estimates scored at each level, per row asked for: they set the score to reach
LONGEST = 2.0**61
SLACK = 1e-9  # of the product of lengths: rounding of the doubles that intervals are made of
SEED = 11
NONE = np.iinfo(np.int64).min


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Few rows to an Arrow batch while whole blocks are passed in rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def usable(vectors: DataFrame, relabel: Column | None = None, scale: int = 256) -> DataFrame:
    """vec_id, label, size and integer vector of the rows that take part."""
    given = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("int").alias("label"), F.col("`embedding`").cast("array<double>").alias("vector"))
    v = F.col("vector")
    there = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = F.aggregate(v, F.lit(0.0), lambda total, x: total + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    short = there.where(finite).where(F.forall(v, lambda x: F.abs(x) < 2.0**31 / scale) & (square < LONGEST))
    label = F.col("label") if relabel is None else relabel
    return short.select("vec_id", label.cast("int").alias("label"), F.size(v).alias("size"), F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("vector"))


def shifted_label(every: int = 7, labels: int = 10) -> Column:
    """The next label, modulo ``labels``, on rows whose id is divisible by ``every``."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


def rotate(data: np.ndarray) -> np.ndarray:
    """Rows padded to a power of two and rotated; inner products stay as they are."""
    size = max(64, 1 << (data.shape[1] - 1).bit_length())
    out = np.zeros((len(data), size))
    out[:, : data.shape[1]] = data
    rng = np.random.default_rng(SEED)
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(out), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def packed_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def ones(codes: np.ndarray) -> np.ndarray:
    """Number of bits set in the words of the last axis."""
    counts = np.bitwise_count(codes)
    return counts[..., 0].astype(np.uint32) if codes.shape[-1] == 1 else counts.sum(axis=-1, dtype=np.uint32)


class Codes:
    """Codes, alignments and residual lengths of the rows of a block, by level."""

    def __init__(self, data: np.ndarray):
        rest = rotate(data)
        root = np.sqrt(rest.shape[1])
        codes, align, left = [], [], []
        for _ in range(LEVELS):
            signs = rest >= 0
            unit = np.where(signs, 1.0, -1.0) / root
            a = (rest * unit).sum(axis=1)
            rest = rest - a[:, None] * unit
            codes.append(packed_bits(signs))
            align.append(a)
            left.append(np.sqrt((rest * rest).sum(axis=1)))
        self.codes, self.align, self.left = np.array(codes), np.array(align), np.array(left)


class Block:
    """Rows of one length in the order of their labels, with their codes."""

    def __init__(self, ids, labels, data, codes, align, left):
        self.ids, self.labels, self.data = ids, labels, data
        self.codes, self.align, self.left = codes, align, left
        self.ones = ones(codes)
        self.lengths = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
        self.exact = data.astype(np.float64)

    @classmethod
    def read(cls, row: dict, size: int) -> Block:
        n = len(row["ids"]) // 8
        shaped = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(shape)
        return cls(
            np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32), shaped("data", np.int32, n, size),
            shaped("codes", np.uint64, LEVELS, n, -1), shaped("align", np.float64, LEVELS, n), shaped("rest", np.float64, LEVELS, n),
        )

    def scores(self, rows: np.ndarray, anchor: np.ndarray, length: float) -> np.ndarray:
        """Integer products; doubles hold them exactly while they are below 2^53."""
        if length * self.lengths[rows].max(initial=0.0) < 2.0**52:
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.data[rows].astype(np.int64) * anchor.astype(np.int64)).sum(axis=1)


class Anchors:
    """A block of anchors: rotated, rounded to bit planes."""

    def __init__(self, numbers, ids, labels, data, wanted=None):
        self.numbers, self.ids, self.labels, self.data, self.wanted = numbers, ids, labels, data, wanted
        self.lengths = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
        turned = rotate(data)
        self.root = np.sqrt(turned.shape[1])
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * level
        self.total, self.square = rounded.sum(axis=1), (rounded * rounded).sum(axis=1)
        self.error = np.sqrt(((turned - rounded) ** 2).sum(axis=1))
        self.planes = np.stack([packed_bits((level >> p) & 1 == 1) for p in range(PLANES)], axis=1)


class Search:
    """Rows of a block that may matter for one anchor, level after level."""

    def __init__(self, block: Block, anchors: Anchors, i: int, rows: np.ndarray):
        self.block, self.anchors, self.i, self.rows = block, anchors, i, rows
        self.sum = np.zeros(len(rows))

    def interval(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ends between which the score of each row lies for sure."""
        b, a, i, rows = self.block, self.anchors, self.i, self.rows
        codes = b.codes[level, rows]
        counted = ones(codes & a.planes[i, 0])
        for p in range(1, PLANES):
            counted += ones(codes & a.planes[i, p]) << np.uint32(p)
        product = (2 * (a.low[i] * b.ones[level, rows] + a.step[i] * counted) - a.total[i]) / a.root
        self.sum = self.sum + b.align[level, rows] * product
        self.best, self.first = self.sum.max(initial=-np.inf), None
        reach = b.left[level, rows] * np.sqrt(np.maximum(0.0, a.square[i] - product * product))
        reach = reach + b.lengths[rows] * (a.error[i] + SLACK * a.lengths[i]) + SLACK
        return self.sum - reach, self.sum + reach

    def keep(self, mask: np.ndarray) -> None:
        self.rows, self.sum = self.rows[mask], self.sum[mask]

    def scored(self) -> np.ndarray:
        return self.block.scores(self.rows, self.anchors.data[self.i], self.anchors.lengths[self.i])

    def leaders(self, n: int, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
        """Integer scores, within a range, of the rows with the n best estimates below its end; any k of them bound the result."""
        if len(self.sum) and high >= self.best:
            if self.first is None:
                self.first = self.at(np.argpartition(self.sum, -n)[-n:] if len(self.sum) > n else slice(None))
            scores = self.first
        else:
            below = np.flatnonzero(self.sum <= high)
            scores = self.at(below[np.argpartition(self.sum[below], -n)[-n:]] if len(below) > n else below)
        return scores[(scores >= low) & (scores <= high)]

    def at(self, places: np.ndarray | slice) -> np.ndarray:
        return self.block.scores(self.rows[places], self.anchors.data[self.i], self.anchors.lengths[self.i])


class Best:
    """The first ``k`` (score, id) met so far, higher scores first, ties by smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def need(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else NONE

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, minus infinity if there are fewer."""
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def find_positives(block: Block, anchors: Anchors, i: int, best: Best) -> int:
    """Add the block's best rows of the anchor's label; returns how many were scored in integers."""
    low, high = np.searchsorted(block.labels, [anchors.labels[i]]), np.searchsorted(block.labels, [anchors.labels[i]], side="right")
    rows = np.arange(low[0], high[0])
    itself = (block.ids[rows] == anchors.ids[i]) & (block.data[rows] == anchors.data[i]).all(axis=1)
    search = Search(block, anchors, i, rows[~itself])
    need = float(best.need()) if best.need() != NONE else -np.inf
    for level in range(LEVELS if len(search.rows) else 0):
        _, most = search.interval(level)
        need = max(need, kth(search.leaders(PROBES * best.k), best.k))
        search.keep(most >= need)
    best.add(search.scored(), block.ids[search.rows])
    return len(search.rows)


def negative_range(score: int) -> tuple[int, int]:
    """Smallest and largest negative score for a positive's score: 50*p <= 100*n <= 95*p."""
    return -((-50 * score) // 100), (95 * score) // 100


def find_negatives(block: Block, anchors: Anchors, i: int, best: list[Best]) -> int:
    """Add, for each positive, the block's best rows of other labels in its range; returns how many were scored."""
    ranges = [negative_range(int(p)) for p in anchors.wanted[i, : len(best)]]
    possible = [j for j, (low, high) in enumerate(ranges) if low <= high]
    search = Search(block, anchors, i, np.flatnonzero(block.labels != anchors.labels[i]) if possible else np.zeros(0, np.int64))
    needs = [float(max(low, own.need())) for (low, _), own in zip(ranges, best)]
    for level in range(LEVELS if len(search.rows) else 0):
        least, most = search.interval(level)
        for j in possible:
            needs[j] = max(needs[j], kth(search.leaders(PROBES * best[j].k, *ranges[j]), best[j].k))
        search.keep((most >= min(needs[j] for j in possible)) & (least <= max(ranges[j][1] for j in possible)))
    scores, ids = search.scored(), block.ids[search.rows]
    for (low, high), own in zip(ranges, best):
        inside = (scores >= low) & (scores <= high)
        own.add(scores[inside], ids[inside])
    return len(scores)


def block_rows(size: int) -> int:
    return max(1, BLOCK_VALUES // size)


def index_blocks(rows: DataFrame) -> DataFrame:
    """One row per block of sorted rows."""
    facts = rows.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    per_block, workers = block_rows(facts["size"] or 1), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-facts["n"] // per_block)
    parts = max(1, min(blocks, workers), blocks // GROUP_BLOCKS)

    def run(batches):
        def block(size, ids, labels, data):
            ids, labels, data = np.array(ids, np.int64), np.array(labels, np.int32), np.array(data, np.int32)
            # Equal rows stand side by side, in one partition.
            same = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (data[1:] == data[:-1]).all(axis=1)
            own = np.append(True, ~same)
            ids, labels, data = ids[own], labels[own], np.ascontiguousarray(data[own])
            c = Codes(data)
            values = {"ids": ids, "labels": labels, "data": data, "codes": c.codes, "align": c.align, "rest": c.left}
            return pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in values.items()}})

        size, ids, labels, data = None, [], [], []
        for batch in batches:
            for vec_id, label, n, vector in zip(*(batch.column(c).to_pylist() for c in range(4))):
                again = ids and ids[-1] == vec_id and labels[-1] == label and data[-1] == vector
                if ids and (n != size or (len(ids) >= block_rows(n) and not again)):
                    yield block(size, ids, labels, data)
                    ids, labels, data = [], [], []
                if not again or n != size:
                    ids.append(vec_id)
                    labels.append(label)
                    data.append(vector)
                size = n
        if ids:
            yield block(size, ids, labels, data)

    order = rows.repartitionByRange(parts, "size", "label", "vec_id").sortWithinPartitions("size", "label", "vec_id", "vector")
    return order.mapInArrow(run, "size int, ids binary, labels binary, data binary, codes binary, align binary, rest binary")


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Anchors (number, vec_id, label, size, vector, wanted) as one row per block."""

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            for n in np.unique(size):
                some = batch.filter(pa.array(size == n))
                for at in range(0, some.num_rows, ANCHORS):
                    rows = some.slice(at, ANCHORS)
                    wanted = np.full((rows.num_rows, max([len(w) for w in rows.column("wanted").to_pylist()] + [1])), NONE, np.int64)
                    for line, given in zip(wanted, rows.column("wanted").to_pylist()):
                        line[: len(given)] = given
                    binary = lambda name, kind: rows.column(name).to_numpy().astype(kind).tobytes()  # noqa: E731, B023
                    yield pa.RecordBatch.from_pydict({
                        "size": pa.array([n], pa.int32()), "ids": pa.array([binary("vec_id", np.int64)], pa.binary()), "labels": pa.array([binary("label", np.int32)], pa.binary()),
                        "data": pa.array([rows.column("vector").flatten().to_numpy().astype(np.int32).tobytes()], pa.binary()),
                        "numbers": pa.array([binary("number", np.int64)], pa.binary()), "wanted": pa.array([wanted.tobytes()], pa.binary()),
                    })

    return anchors.select("number", "vec_id", "label", "size", "vector", "wanted").mapInArrow(run, "size int, ids binary, labels binary, data binary, numbers binary, wanted binary")


def meet(blocks: DataFrame, anchors: DataFrame, k: int, negatives: bool) -> DataFrame:
    """Rows (number, place, vec_id, score): each group's best for every anchor, and for each of its positives if negatives are asked for."""
    spark = blocks.sparkSession
    n, workers = blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(n, workers), -(-n // GROUP_BLOCKS))
    no_code, no_anchor = [F.lit(None).cast("binary").alias(c) for c in ("codes", "align", "rest")], [F.lit(None).cast("binary").alias(c) for c in ("numbers", "wanted")]
    common = ["size", "ids", "labels", "data"]
    here = blocks.select(F.pmod(F.xxhash64("ids", "size"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), *common, "codes", "align", "rest", *no_anchor)
    there = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *common, *no_code, "numbers", "wanted")
    # Blocks of a group come first and are held; blocks of anchors pass by, one at a time.
    both = here.unionByName(there).repartition(groups, "group").sortWithinPartitions("group", "kind")

    def run(batches):
        group, held = None, []
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                if row["group"] != group:
                    group, held = row["group"], []
                size = row["size"]
                if row["kind"] == 0:
                    held.append((size, Block.read(row, size)))
                    continue
                numbers = np.frombuffer(row["numbers"], np.int64)
                anchors = Anchors(
                    numbers, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32),
                    np.frombuffer(row["data"], np.int32).reshape(len(numbers), size), np.frombuffer(row["wanted"], np.int64).reshape(len(numbers), -1),
                )
                out: list[list] = [[], [], [], []]
                for i in range(len(numbers)):
                    asked = int((anchors.wanted[i] != NONE).sum()) if negatives else 1
                    best = [Best(k) for _ in range(asked)]
                    for n, block in held:
                        if n == size and asked:
                            find_negatives(block, anchors, i, best) if negatives else find_positives(block, anchors, i, best[0])
                    for place, own in enumerate(best):
                        for column, values in zip(out, (np.full(len(own.ids), numbers[i]), np.full(len(own.ids), place), own.ids, own.scores)):
                            column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["number", "place", "vec_id", "score"])

    with small_batches(spark, 8):
        return stored(both.mapInArrow(run, "number long, place long, vec_id long, score long"), "hard-negatives")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k over all groups, numbered from 1."""
    order = Window.partitionBy("number", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, relabel: Column | None = None, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchors have ids divisible by ``every``."""
    rows = stored(usable(vectors, relabel, scale), "integer-vectors")
    blocks = stored(index_blocks(rows), "code-blocks")
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vector"])
    anchors = stored(anchors.withColumn("number", F.monotonically_increasing_id()), "anchors")
    nothing = F.array().cast("array<long>")
    first = ranked(meet(blocks, stored(anchor_blocks(anchors.withColumn("wanted", nothing)), "anchor-blocks"), positives, False), positives)
    first = stored(first.select("number", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most ``positives`` rows an anchor.
    wanted = first.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asked = anchors.join(wanted.select("number", F.col("p.positive_score").alias("wanted")), "number")
    last = ranked(meet(blocks, stored(anchor_blocks(asked), "anchor-blocks"), negatives, True), negatives)
    named = last.select("number", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        named.join(first, ["number", "place"])
        .join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
