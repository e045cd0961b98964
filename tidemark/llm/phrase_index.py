"""Benchmark decontamination with a positional inverted index of the training texts.

The index is partitioned by document: each segment row holds the posting lists (sorted
word positions) of the test vocabulary for a run of whole documents, and is stored. Term
frequencies are summed over all segments. A phrase starts from the posting list of its
rarest term and is intersected, shifted by each term's offset, with those of the next
rarer ones until it is empty or proven. Proximity looks around each posting of the
rarest term for a stretch that holds all terms in any order.

Test items are taken in blocks of at most ``BLOCK_WORDS`` words: a block's vocabulary
and windows are what is sent to the tasks, so their size is bounded whatever the
benchmark; each block has an index and a pass of its own, and the matches are joined by
row. Training rows are never shuffled for one block.

A window is ``width`` consecutive words of an item; an item with fewer words is one
window, an item with none has no window. Null and empty texts have no words. Repeated
rows are separate rows; repeated item ids are one item in the lists. Empty tables give
no rows, or rows without matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import stored, texts, words

WIDTH = 10
BROADCAST_ROWS = 2_000_000  # numbers of rows that are broadcast; more are joined
BLOCK_WORDS = 500_000
SEGMENT_WORDS = 200_000


@dataclass(frozen=True)
class Block:
    """Some test items: their ids, their windows (item, terms) and the numbers of their words."""

    items: list
    windows: list[tuple[int, tuple[int, ...]]]
    vocabulary: dict[bytes, int]


def blocks(benchmark: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The items in blocks of bounded size; rows come to the driver one partition at a time."""
    items, windows, vocabulary, n = [], set(), {}, 0
    rows = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    for row in rows.toLocalIterator():
        found = words((row["t"] or "").encode())
        if not found:
            continue
        if n and n + len(found) > BLOCK_WORDS:
            yield Block(items, sorted(windows), vocabulary)
            items, windows, vocabulary, n = [], set(), {}, 0
        n += len(found)
        terms = [vocabulary.setdefault(w, len(vocabulary)) for w in found]
        items.append(row["i"])
        for at in range(max(1, len(terms) - width + 1)):
            windows.add((len(items) - 1, tuple(terms[at : at + width])))
    if items:
        yield Block(items, sorted(windows), vocabulary)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], row: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of posting lists. ``row`` is a column that tells documents with equal ids apart; without it rows are numbered."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        find = vocabulary.get
        keys, rows, sizes, terms, places, at = [], [], [], [], [], 0

        def segment():
            term = np.concatenate(terms) if terms else np.empty(0, np.int32)
            place = np.concatenate(places) if places else np.empty(0, np.int32)
            order = np.argsort(term, kind="stable")
            held, counts = np.unique(term, return_counts=True)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids := pa.concat_arrays(keys))], pa.int32()), ids), one(np.array(rows, np.int64), pa.int64()), one(np.array(sizes, np.int32), pa.int32()), one(held.astype(np.int32), pa.int32()), one(counts.astype(np.int32), pa.int32()), one(place[order], pa.int32())],
                ["doc_ids", "row_ids", "n_words", "terms", "counts", "positions"],
            )

        for batch in batches:
            for i, value in enumerate(texts(batch.column(2))):
                found = words(value)
                number = np.fromiter((find(w, -1) for w in found), np.int32, len(found))
                known = np.flatnonzero(number >= 0)
                keys.append(batch.column(0).slice(i, 1))
                rows.append(batch.column(1)[i].as_py())
                sizes.append(len(found))
                terms.append(number[known])
                places.append((known + at).astype(np.int32))
                at += len(found) + 1  # a place without a word, so that no phrase runs into the next document
                if at >= SEGMENT_WORDS or len(keys) >= 10_000:
                    yield segment()
                    keys, rows, sizes, terms, places, at = [], [], [], [], [], 0
        if keys:
            yield segment()

    source = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"), F.col(f"`{text}`").cast("string").alias("text")
    )
    return source.mapInArrow(run, f"doc_ids array<{kind}>, row_ids array<long>, n_words array<int>, terms array<int>, counts array<int>, positions array<int>")


def term_counts(index: DataFrame) -> dict[int, int]:
    """How often each term of the vocabulary occurs in all documents."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return {r["t"]: r["n"] for r in pairs.groupBy(F.col("p.terms").alias("t")).agg(F.sum(F.col("p.counts")).alias("n")).collect()}


class Postings:
    """The posting lists of one segment."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        ends = np.cumsum(counts)
        self.lists = {int(t): positions[e - n : e] for t, n, e in zip(terms, counts, ends)}

    def phrase(self, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
        """Starts of a phrase given as (term, offset), rarest term first."""
        starts = None
        for term, offset in steps:
            places = self.lists.get(term)
            if places is None:
                return np.empty(0, np.int64)
            if starts is None:
                starts = places.astype(np.int64) - offset
                continue
            at = np.searchsorted(places, starts + offset)
            at[at == len(places)] = 0
            starts = starts[places[at] == starts + offset]
            if not len(starts):
                break
        return starts

    def near(self, steps: tuple[tuple[int, int], ...], span: int) -> np.ndarray:
        """Places of the rarest term within ``span`` words of which all terms occur, in any order."""
        terms = list(dict.fromkeys(t for t, _ in steps))
        if any(t not in self.lists for t in terms):
            return np.empty(0, np.int64)
        found = []
        for p in self.lists[terms[0]].astype(np.int64):
            around = [a[np.searchsorted(a, p - span + 1) : np.searchsorted(a, p + span)] for a in (self.lists[t] for t in terms)]
            if all(len(a) for a in around):
                for start in np.unique(np.concatenate(around)):
                    if start <= p and all(np.searchsorted(a, start) < np.searchsorted(a, start + span) for a in around):
                        found.append(p)
                        break
        return np.array(found, np.int64)


def spans(items: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int, int]]:
    """Overlapping stretches of one item joined: (item, start, stop)."""
    order = np.lexsort((starts, items))
    out: list[tuple[int, int, int]] = []
    for i, a, b in zip(items[order].tolist(), starts[order].tolist(), stops[order].tolist()):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1] = (i, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((i, a, b))
    return out


def search(index: DataFrame, block: Block, item_type: str, slack: int | None = None) -> DataFrame:
    """One row per indexed document: doc_id, row_id, n_words, ``matches`` (item, start, stop in words) and, with ``slack``,
    ``near`` (item, place of its rarest term where a stretch of window plus ``slack`` words holds all its terms)."""
    counts = term_counts(index)
    windows = [(i, tuple(sorted(((t, o) for o, t in enumerate(w)), key=lambda s: (counts.get(s[0], 0), s)))) for i, w in block.windows]
    windows = [w for w in windows if all(t in counts for t, _ in w[1])]
    items = block.items
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys, rows, sizes, terms, n, positions = (batch.column(c)[r].values for c in range(6))
                sizes, rows = sizes.to_numpy(), rows.to_numpy()
                postings = Postings(terms.to_numpy(), n.to_numpy(), positions.to_numpy())
                starts = np.cumsum(sizes.astype(np.int64) + 1) - sizes - 1
                exact, close = [], []
                for item, steps in windows:
                    if steps[0][0] not in postings.lists:
                        continue
                    if len(found := postings.phrase(steps)):
                        exact.append((item, len(steps), found))
                    if slack is not None and len(found := postings.near(steps, len(steps) + slack)):
                        close.append((item, 1, found))
                columns = []
                for hits in (exact, close):
                    of: dict[int, list] = {}
                    if hits:
                        item = np.concatenate([np.full(len(f), i) for i, _, f in hits])
                        first = np.concatenate([f for _, _, f in hits])
                        last = np.concatenate([f + k for _, k, f in hits])
                        doc = np.searchsorted(starts, first, side="right") - 1
                        order = np.argsort(doc, kind="stable")
                        for at in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                            d = int(doc[at[0]])
                            own = spans(item[at], first[at] - starts[d], last[at] - starts[d])
                            of[d] = [{"item": items[i], "start": a, "stop": b} for i, a, b in own]
                    columns.append([of.get(d, []) for d in range(len(sizes))])
                match = pa.list_(pa.struct([("item", item_arrow), ("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(rows), pa.array(sizes.astype(np.int64)), pa.array(columns[0], match), pa.array(columns[1], match)],
                    ["doc_id", "row_id", "n_words", "matches", "near"],
                )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    item_arrow = to_arrow_type(StructType.fromDDL(f"item {item_type}")["item"].dataType)
    span = f"array<struct<item:{item_type}, start:long, stop:long>>"
    return index.mapInArrow(run, f"doc_id {kind}, row_id long, n_words long, matches {span}, near {span}")


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int | None = None, row: str | None = None) -> DataFrame:
    """Matches of all items in all documents, one row per document."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", *([row] if row else []))
    waiting = blocks(benchmark, width)
    some = list(islice(waiting, 2))
    if len(some) > 1 and not row:  # rows must be known again in the next pass
        row = "_row"
        source = stored(source.withColumn(row, F.monotonically_increasing_id()), "numbered")
    parts = [search(stored(build_index(source, b.vocabulary, row), "index"), b, item_type, slack) for b in chain(some, waiting)]
    if not parts:
        parts = [search(build_index(source, {}, row), Block([], [], {}), item_type, slack)]
    if len(parts) == 1:
        return parts[0]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("doc_id", "row_id", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"), F.flatten(F.collect_list("near")).alias("near"))


def passage_digest(found: DataFrame) -> DataFrame:
    """n_hit (words inside any match), n_items, a hash of the item list and whether any item occurs."""
    places = F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["stop"] - 1)))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"].cast("string"))))
    hit = F.when(F.size("matches") == 0, 0).otherwise(F.size(F.array_distinct(places))).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no item window occurs, with all their columns."""
    numbered = stored(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("_row")), "numbered")
    source = numbered.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "_row")
    hit = find_passages(source, benchmark, row="_row").where(F.size("matches") > 0).select(F.col("row_id").alias("_row"))
    hit = stored(hit, "contaminated")
    # Few rows go, as a rule: their numbers travel instead of all texts.
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return numbered.join(hit, "_row", "left_anti").select("row.*")
