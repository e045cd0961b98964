"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each node of that decision tree with a context tree of
its own over the bytes before. At every context a Krichevsky-Trofimov estimate is kept;
a context's probability is half its own estimate and half the product of its
children's, and the estimates of all depths are mixed in proportion. The code length of
a text is summed over its bytes and a closing zero byte; texts begin after zero bytes.

All contexts of up to ``DEPTH`` bytes that occur are in the tree, however rare. Counts of
(context, byte) are packed by block of texts and dealt to buckets of contexts that agree
in the three nearest bytes. One pass over the buckets works out the depths below two bytes
and sums what contexts of two bytes need to know of them; those, at most 65,536 whatever
the corpus, are mixed with the depths above in one place. A second pass gives each
(context, byte) its log-probability and sends it back to the blocks that have it, where
texts are scored. The number of blocks and of buckets grows with the corpus, their size
does not. What is written and shuffled is kept small: texts in compressed packs, lists of
(context, byte) as steps from one to the next. A caller who sets ``NODES`` bounds the
tree: longer contexts than two bytes are then in it only if at least 1 in ``NODES`` places
has them, and a context's other continuations share one last child.

Word counts are summed by Spark: the most frequent words, at most ``FREQUENT``, are sent to
the tasks and all others are joined.

Null texts are empty and code the closing byte alone. Without training rows the tree
gives every bit one half. Rows that share an id are scored separately; null ids are
trained on. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.rows import WRITTEN, plain_words, remove_written, stored, texts

FOLDS, HELD = 7, 2
DEPTH = 4
NODES: int | None = None  # no bound
REST = 256  # stands for all bytes of a bounded tree that have no context of their own
BLOCK_BYTES = 8 << 20
PACK_BYTES = 64 << 10
FREQUENT = 200_000
GROUP_BYTES = 1 << 20
FLUSH_WORDS = 100_000


def held_out() -> Column:
    """Rows not trained on: crc32 of the id as text leaves ``HELD`` modulo ``FOLDS``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def groups(batch_texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of bounded size; a longer text stands alone."""
    group, size = [], 0
    for text in batch_texts:
        if group and size + len(text) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 3
    if group:
        yield group


@dataclass
class Places:
    """The coded places of some texts."""

    data: np.ndarray  # bytes, DEPTH zeros before each text and one after
    at: np.ndarray  # where the coded bytes are
    stops: np.ndarray  # number of places up to the end of each text

    def before(self, d: int) -> np.ndarray:
        """The byte ``d`` places before each coded one."""
        return self.data[self.at - d]

    def grams(self) -> np.ndarray:
        """Context and byte of each place as a number: nearest byte, second (8 bits each), third, fourth (9 bits each), the byte itself."""
        out = self.before(1).astype(np.int64)
        for d, bits in ((2, 8), (3, 9), (4, 9), (0, 8)):
            out = (out << bits) | self.before(d)
        return out


def coded(group: list[bytes]) -> Places:
    pad = bytes(DEPTH)
    data = np.frombuffer(pad + (b"\0" + pad).join(group) + b"\0", np.uint8)
    sizes = np.array([len(t) + 1 for t in group])
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(np.arange(1, len(group) + 1) * DEPTH, sizes)
    return Places(data, at, ends)


def lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def in_blocks(docs: DataFrame) -> DataFrame:
    """Packs of rows with their ids, sizes, compressed texts and the block they belong to.

    A block has texts one after the other, ``BLOCK_BYTES`` and at most one text more, a pack ``PACK_BYTES`` and at most one text more.
    """

    def run(batches):
        zstd = pa.Codec("zstd", compression_level=3)
        done = 0
        for batch in batches:
            sizes = batch.column("n_bytes").to_numpy()
            if not len(sizes):
                continue
            starts = done + np.cumsum(sizes) - sizes
            block = (batch.column("row").to_numpy() >> 33 << 33) + starts // BLOCK_BYTES  # the partition and the place in it
            first = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(starts // PACK_BYTES) != 0)))
            ends = np.append(first[1:], len(sizes))
            found = list(texts(batch.column("text")))
            data = [zstd.compress(b"".join(found[i:j]), asbytes=True) for i, j in zip(first, ends)]
            columns = {c: lists(batch.column(c), ends - first) for c in ("row", "doc_id", "held_out", "n_bytes")}
            yield pa.RecordBatch.from_pydict({**columns, "texts": pa.array(data, pa.binary()), "block": pa.array(block[first])})
            done = int(starts[-1] + sizes[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), held_out().alias("held_out"), size.alias("n_bytes"))
    schema = f"row array<long>, doc_id array<{kind}>, held_out array<boolean>, n_bytes array<long>, texts binary, block long"
    return stored(source.mapInArrow(run, schema), "blocks")


def unpacked(packs: pa.RecordBatch | pa.Table) -> Iterator[bytes]:
    """The texts of packs, one after the other."""
    zstd = pa.Codec("zstd")
    for data, sizes in zip(packs.column("texts"), packs.column("n_bytes")):
        ends = np.cumsum(sizes.values.to_numpy())
        whole = zstd.decompress(data.as_buffer(), int(ends[-1]), asbytes=True)
        for i, j in zip([0, *ends[:-1]], ends):
            yield whole[i:j]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of lists one after the other, none empty, the first value of each and the steps from one to the next: they compress well."""
    out, first = np.diff(values, prepend=0), np.cumsum(sizes) - sizes
    out[first] = values[first]
    return out


def grams_in(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers that lists of steps stand for."""
    array = column.combine_chunks()
    out, sizes = np.cumsum(step := array.flatten().to_numpy()), array.value_lengths().to_numpy()
    first = np.cumsum(sizes) - sizes
    return out - np.repeat(out[first] - step[first], sizes)


def gather(blocks: DataFrame, buckets: int, shared: int) -> DataFrame:
    """Partial counts of words of training rows, and by block and bucket the (context, byte) of all rows, as ``steps``, with their counts in training rows.

    A bucket takes contexts that agree in what is left of them after a shift by ``shared`` bits.
    """

    def run(batches):
        empty = [pa.nulls(0, t) for t in (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
        names = ["word", "n", "bucket", "block", "gram", "times"]

        def filled(size: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, e.type)) for c, e in zip(names, empty)], names)

        def words(counter: Counter) -> pa.RecordBatch:
            return filled(len(counter), word=pa.array(list(counter), pa.binary()), n=pa.array(list(counter.values()), pa.int64()))

        def packed(block: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            mixed = (keys >> shared).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, sizes = np.unique(bucket, return_counts=True)
            gram, times = lists(steps(keys[order], sizes), sizes), lists(counts[order].astype(np.int32), sizes)
            return filled(len(found), bucket=pa.array(found), block=pa.array(np.full(len(found), block)), gram=gram, times=times)

        counter: Counter = Counter()
        block, keys, counts = None, [], []
        for batch in batches:
            of = batch.column("block")
            for number in pc.unique(of):
                if number.as_py() != block and keys:
                    yield packed(block, *summed(keys, counts))
                    keys, counts = [], []
                block = number.as_py()
                packs = batch.filter(pc.equal(of, number))
                found_texts = list(zip(packs.column("held_out").flatten().to_pylist(), unpacked(packs)))
                for held in (False, True):
                    for group in groups(text for is_held, text in found_texts if is_held == held):
                        found, times = np.unique(coded(group).grams(), return_counts=True)
                        keys.append(found)
                        counts.append(np.zeros_like(times) if held else times)
                        if len(keys) > 8:
                            keys, counts = [[part] for part in summed(keys, counts)]
                        if not held:
                            for text in group:
                                counter.update(plain_words(text))
                        if len(counter) > FLUSH_WORDS:
                            yield words(counter)
                            counter = Counter()
        if keys:
            yield packed(block, *summed(keys, counts))
        yield words(counter)

    schema = "word binary, n long, bucket int, block long, gram array<long>, times array<int>"
    return blocks.select("block", "held_out", "n_bytes", "texts").mapInArrow(run, schema)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift to eight and above."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - 2 * log_gamma(np.array(0.5))


def next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The estimate's probability that a one comes next."""
    return (ones + 0.5) / (zeros + ones + 1)


def held_against(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """How far a context's own estimate holds against its children's, from the logarithms of what both gave so far."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


@dataclass
class Nodes:
    """Nodes of one depth of the context trees of one bit of the byte: context and bits so far, and what came next there."""

    first: np.ndarray  # the first key of each
    of: np.ndarray  # the node of each key
    zeros: np.ndarray
    ones: np.ndarray

    @classmethod
    def split(cls, keys: np.ndarray, counts: np.ndarray, bit: int) -> Nodes:
        """From (context, byte) in order and their counts."""
        prefix = keys >> (8 - bit)
        begins = np.append(True, prefix[1:] != prefix[:-1])
        first = np.flatnonzero(begins)
        total = np.add.reduceat(counts, first)
        ones = np.add.reduceat(counts * ((keys >> (7 - bit)) & 1), first)
        return cls(first, np.cumsum(begins) - 1, total - ones, ones)


def bounded(keys: np.ndarray, counts: np.ndarray, nodes: int, places: int) -> np.ndarray:
    """Keys with ``REST`` in place of the bytes that make a context too rare for a bounded tree."""
    out = keys.copy()
    for shift, rest in ((8, REST << 8), (17, REST << 17 | REST << 8)):
        _, at = np.unique(keys >> shift, return_inverse=True)
        rare = np.bincount(at, counts)[at] * nodes < max(1, places)
        out[rare] = (keys[rare] >> (shift + 9) << (shift + 9)) | rest | (keys[rare] & 255)
    return out


def deep_levels(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, Nodes, Nodes, np.ndarray, np.ndarray]]:
    """For each bit the nodes of depths 4 and 3 under some contexts, the parent of each of the former and the number of its
    node at depth 2, and the logarithm of what the children of the latter gave."""
    upper, up = np.unique((keys >> 17 << 8) | (keys & 255), return_inverse=True)
    sums = np.bincount(up, counts, len(upper))
    for bit in range(8):
        four, three = Nodes.split(keys, counts, bit), Nodes.split(upper, sums, bit)
        parent = three.of[up[four.first]]
        below = np.bincount(parent, log_estimate(four.zeros, four.ones), len(three.first))
        at = upper[three.first]
        yield (at >> 17 << 8) | ((at & 255 | 256) >> (8 - bit)), four, three, parent, below


def bucket_counts(table: pa.Table, nodes: int | None, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a bucket in order, their counts, and the place among them of each (context, byte) of the bucket's rows."""
    raw = grams_in(table["gram"])
    times = table["times"].combine_chunks().flatten().to_numpy()
    keys, at = np.unique(raw, return_inverse=True)
    counts = np.bincount(at, times, len(keys))
    if nodes:
        keys, again = np.unique(bounded(keys, counts, nodes, places), return_inverse=True)
        counts, at = np.bincount(again, counts, len(keys)), again[at]
    return keys, counts, at


def sum_below(nodes: int | None, places: int) -> Callable[[pa.Table], pa.Table]:
    """First pass over a bucket: what each node of depth 2 (nearest byte, second, bits so far) has seen below it."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, _ = bucket_counts(table, nodes, places)
        parts = []
        for node, _, three, _, below in deep_levels(keys, counts):
            whole = np.logaddexp(log_estimate(three.zeros, three.ones), below) - math.log(2)
            found, at = np.unique(node, return_inverse=True)
            parts.append([found, *(np.bincount(at, v, len(found)) for v in (three.zeros, three.ones, whole))])
        return pa.table(dict(zip(("node", "zeros", "ones", "below"), map(np.concatenate, zip(*parts)))))

    return run


@dataclass
class Top:
    """Depths 0 to 2, mixed: at a node of depth 2 a one has probability ``fixed`` and ``share`` of what depth 3 says."""

    node: np.ndarray
    fixed: np.ndarray
    share: np.ndarray


def mix_top(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Top:
    """Mix the upper depths, from what all nodes of depth 2, in order, have seen."""
    fixed, share = np.zeros(len(node)), np.ones(len(node))
    at, keys, levels = np.arange(len(node)), node, []
    for depth in (2, 1, 0) if len(node) else ():
        own = log_estimate(zeros, ones)
        levels.append((at, held_against(own, below), next_one(zeros, ones)))
        whole = np.logaddexp(own, below) - math.log(2)
        if depth:
            keys, up = np.unique((keys >> 16 << 8) | (keys & 255), return_inverse=True)
            zeros, ones, below = (np.bincount(up, v, len(keys)) for v in (zeros, ones, whole))
            at = up[at]
    for at, stay, one in reversed(levels):
        fixed += share * stay[at] * one[at]
        share *= 1 - stay[at]
    return Top(node, fixed, share)


def log_probabilities(top: Top, nodes: int | None, places: int) -> Callable[[pa.Table], pa.Table]:
    """Second pass over a bucket: the log10-probability of each (context, byte), for each block that has it."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, at = bucket_counts(table, nodes, places)
        total = np.zeros(len(keys))
        for bit, (node, four, three, parent, below) in enumerate(deep_levels(keys, counts)):
            stay = held_against(log_estimate(three.zeros, three.ones), below)
            deep = (stay * next_one(three.zeros, three.ones))[parent] + (1 - stay[parent]) * next_one(four.zeros, four.ones)
            above = np.searchsorted(top.node, node)[parent]
            one = (top.fixed[above] + top.share[above] * deep)[four.of]
            total += np.log10(np.where((keys >> (7 - bit)) & 1 == 1, one, 1 - one))
        gram = table["gram"].combine_chunks()
        logs = lists(total[at].astype(np.float32), gram.value_lengths().to_numpy())
        return pa.table({"block": table["block"].combine_chunks(), "gram": gram, "log": logs})

    return run


def fit_tree(packed: DataFrame, places: int) -> DataFrame:
    """block, gram and log: the log10-probabilities of the (context, byte) of each block, in lists; gram as ``steps``."""
    buckets = packed.select("bucket", "block", "gram", "times").groupBy("bucket")
    seen = buckets.applyInArrow(sum_below(NODES, places), "node long, zeros double, ones double, below double")
    at_two = seen.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    order = np.argsort(node := at_two["node"].to_numpy())
    top = mix_top(node[order], *[at_two[c].to_numpy()[order] for c in ("zeros", "ones", "below")])
    return buckets.applyInArrow(log_probabilities(top, NODES, places), "block long, gram array<long>, log array<float>")


@dataclass
class Model:
    logs: DataFrame  # block, gram, log of the tree
    frequent: dict[bytes, float]  # log10(count + 1)
    words: DataFrame  # word, c of the others
    tokens: int
    distinct: int
    ends: int


def fit(blocks: DataFrame) -> Model:
    trained = F.when(~F.col("held_out"), F.col("n_bytes") + 1)
    n_bytes, places, ends = blocks.selectExpr("inline(arrays_zip(held_out, n_bytes))").agg(*[F.coalesce(v, F.lit(0)) for v in (F.sum("n_bytes"), F.sum(trained), F.count(trained))]).first()
    # A bounded tree pools contexts that agree in two bytes: they must meet.
    partial = stored(gather(blocks, max(1, n_bytes // BLOCK_BYTES), 26 if NODES else 17), "partial-counts")
    words = stored(partial.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    # The smallest count that at most FREQUENT words reach; a row per different count.
    steps = words.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).toLocalIterator()
    least, held = None, 0
    for step in steps:
        held += step["words"]
        if held > FREQUENT:
            break
        least = step["c"]
    frequent = {} if least is None else dict(zip(*words.where(F.col("c") >= least).select("word", F.log10(F.col("c") + 1)).toArrow().to_pydict().values()))
    others = words if least is None else words.where(F.col("c") < least)
    return Model(fit_tree(partial.where("word is null"), places), frequent, others, total["n"] + ends, total["v"] + (ends > 0), ends)


def score_documents(blocks: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    frequent, ends = model.frequent, model.ends
    per_token = math.log10(model.tokens + model.distinct + 1)
    end_base = math.log10(ends + 1)
    pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])

    def run(packs: pa.Table, tree: pa.Table) -> pa.Table:
        keys, first = np.unique(grams_in(tree["gram"]), return_index=True)
        log10 = tree["log"].combine_chunks().flatten().to_numpy()[first]
        tokens, known, base, rare, scores = [], [], [], [], []
        for group in groups(unpacked(packs)):
            places = coded(group)
            found, at = np.unique(places.grams(), return_inverse=True)
            logs = log10[np.searchsorted(keys, found)][at]
            scores.append(np.add.reduceat(logs, np.append(0, places.stops[:-1]), dtype=np.float64))
            for text in group:
                found = plain_words(text)
                sure, total, others = int(ends > 0), end_base, []
                for word, n in Counter(found).items():
                    value = frequent.get(word)
                    if value is None:
                        others.append({"word": word, "n": n})
                    else:
                        sure += n
                        total += n * value
                tokens.append(len(found) + 1)
                known.append(sure)
                base.append(total)
                rare.append(others)
        ids = {c: packs[c].combine_chunks().flatten() for c in ("row", "doc_id", "held_out", "n_bytes")}
        return pa.table({**ids, "n_tokens": tokens, "known": known, "base": base, "score": np.concatenate(scores), "rare": pa.array(rare, pa.list_(pair))})

    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, known long, base double, score double, rare array<struct<word:binary, n:long>>"
    by_block = blocks.groupBy("block")
    scored = stored(by_block.cogroup(model.logs.groupBy("block")).applyInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    more = rare.join(model.words, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"))
    joined = scored.drop("rare").join(more, "row", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def language_scores(docs: DataFrame) -> DataFrame:
    first = len(WRITTEN)
    blocks = in_blocks(docs.select("doc_id", "text"))
    scores = score_documents(blocks, fit(blocks))
    remove_written(docs.sparkSession, first, first + 2)  # blocks and partial counts: what is left to do reads scored rows and words
    return scores
