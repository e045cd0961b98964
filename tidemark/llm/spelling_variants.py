"""Spelling variants: words one edit apart, by dynamic programming over a sorted vocabulary.

A sorted list of words is scanned against a word by edit-matrix rows, of which only the
band of three diagonals around the main one can hold a distance of one. Words that stand
beside each other share the rows of their common prefix (their LCP), so a row is made once
for the whole range of words with that prefix; where the smallest value of a row is above
one, the whole range is skipped. The scan goes down one code point at a time for all words
at once: a state is a pair of a range and a word that is still within reach.

The list is cut into groups that fit a task, and no pair of words one edit apart is lost.
A pair consists of a word of some length and one of the same length or one more. The first
groups are these lengths. While a group is larger than ``GROUP`` words, its free part (at
first the whole word) is halved: an edit lies in one half, so the other half must be equal
and joins the group's key. A free part of one code point ends that: with some 90 letters
such a group is as small as ``GROUP``. Pairs that several groups find count once.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case. Null and empty
texts have none, an empty table gives no rows, repeated rows count as often as they occur,
a null id counts as an empty one, other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import stored, texts

LETTERS = "a-zÀ-ÿ"
PIECE = 1 << 20  # code points of a text looked at together
PARTIAL = 200_000  # distinct words a task counts before it hands them on
GROUP = 8192  # words of a group; see above
BATCH = 8192  # words of small groups scanned together
QUERIES = 1024  # words in the scan at once
HOT_KEYS = 100_000  # keys of too large groups that are broadcast; more are joined


def runs(text: str, pattern: re.Pattern, gap: re.Pattern) -> Iterator[list[str]]:
    """The runs of a text, some at a time; pieces end where no run does."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield pattern.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, least_length: int = 6, misspell: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n over whole texts, for words of at least ``least_length`` code points.

    With ``misspell`` set, a run whose crc32 of ``<doc_id>:<run>`` it divides loses the code
    point at that crc32 modulo its length: errors put in on purpose, the same at every run.
    """

    def run(batches):
        pattern, gap = re.compile(f"[{LETTERS}]{{{least_length},}}"), re.compile(f"[^{LETTERS}]")
        counts: dict[str, int] = {}

        def partial():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                start = zlib.crc32(f"{key}:".encode())
                for some in runs(data.lower().decode(errors="replace"), pattern, gap):
                    for word, n in Counter(some).items():
                        if misspell:
                            h = zlib.crc32(word.encode(), start)
                            if h % misspell == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                        counts[word] = counts.get(word, 0) + n
                    if len(counts) >= PARTIAL:
                        yield partial()
        if counts:
            yield partial()

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keyed(rows: DataFrame) -> DataFrame:
    """``key`` and ``middle`` of rows (word, n, size, start, stop): what must be equal around the free part, and that part."""
    word, length = F.col("word"), F.char_length("word")
    behind = F.col("size") - F.col("stop")
    middle = F.substring(word, F.col("start") + 1, length - behind - F.col("start"))
    key = F.concat(F.substring(word, F.lit(1), F.col("start")), F.lit(" "), F.substring(word, length - behind + 1, behind))
    return rows.select("word", "n", "size", "start", "stop", key.alias("key"), middle.alias("middle"))


def grouped(words: DataFrame, least_length: int) -> DataFrame:
    """Rows of groups that each fit a task: every pair of words one edit apart shares a group."""
    length = F.char_length("word")
    sizes = F.filter(F.array(length, length - 1), lambda s: s >= least_length)
    rows = words.select("word", "n", F.explode(sizes).alias("size")).withColumns({"start": F.lit(0), "stop": F.col("size")})
    names, done = ["size", "start", "stop", "key"], None
    while True:
        rows = stored(keyed(rows), "variant-groups")
        large = stored(rows.groupBy(*names).agg(F.count("*").alias("g")).where((F.col("g") > GROUP) & (F.col("stop") - F.col("start") > 1)).drop("g"), "variant-large")
        n = large.count()
        if n == 0:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if n <= HOT_KEYS else large
        fits = rows.join(large, names, "left_anti").select(*rows.columns)
        done = fits if done is None else done.unionByName(fits)
        half = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
        parts = F.array(F.struct(F.col("start").alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("stop").alias("b")))
        split = rows.join(large, names, "left_semi").select("word", "n", "size", F.explode(parts).alias("p"))
        rows = split.select("word", "n", "size", F.col("p.a").alias("start"), F.col("p.b").alias("stop"))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points by word and place (0 behind the end), and the lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max()) + 2
    table = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(words)), lengths)
    table[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return table, lengths


def common_prefixes(table: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Length of the prefix each word shares with the one before it; -1 where a group begins."""
    out = np.full(len(table), -1, np.int64)
    if len(table) > 1:
        same = table[1:] == table[:-1]
        first = np.where(same.all(axis=1), table.shape[1], same.argmin(axis=1))
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
        out[1:][groups[1:] != groups[:-1]] = -1
    return out


def scan(table: np.ndarray, lengths: np.ndarray, groups: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows (query, found) of a sorted list that are one edit apart, and the number of states the scan went through.

    ``asked`` are the rows used as queries; a query meets the words of its own group.
    """
    shared = common_prefixes(table, lengths, groups)
    starts = np.flatnonzero(shared < 0)
    queries, nodes = asked, starts[np.searchsorted(starts, asked, side="right") - 1]
    band = np.tile(np.array([2, 0, 1], np.int8), (len(asked), 1))  # distances of the empty prefix to -1, 0 and 1 code points
    out: list[tuple[np.ndarray, np.ndarray]] = []
    visited = 0
    for depth in range(int(lengths.max()) + 1):
        # A range begins with the word that ends there, if one does.
        place = lengths[queries] - depth + 1
        ended = np.flatnonzero((lengths[nodes] == depth) & (place >= 0) & (place <= 2))
        near = ended[band[ended, place[ended]] == 1]
        out.append((queries[near], nodes[near]))
        # Ranges of the next depth inside each range, and one row of the matrix for each.
        stops = np.append(starts[1:], len(table))[np.searchsorted(starts, nodes)]
        below = np.flatnonzero((shared <= depth) & (lengths > depth))
        low, high = np.searchsorted(below, nodes), np.searchsorted(below, stops)
        many = high - low
        pairs = np.repeat(np.arange(len(nodes)), many)
        children = below[np.arange(len(pairs)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
        queries, before = queries[pairs], band[pairs]
        visited += len(pairs)
        letter, size = table[children, depth], lengths[queries]
        step = lambda j: np.where((j >= 1) & (j <= size), letter != table[queries, max(j - 1, 0)], 2).astype(np.int8)  # noqa: E731, B023
        band = np.empty_like(before)
        band[:, 0] = np.minimum(before[:, 0] + step(depth), before[:, 1] + 1)
        band[:, 1] = np.minimum(np.minimum(before[:, 1] + step(depth + 1), before[:, 2] + 1), band[:, 0] + 1)
        band[:, 2] = np.minimum(before[:, 2] + step(depth + 2), band[:, 1] + 1)
        alive = np.flatnonzero(band.min(axis=1) <= 1)
        queries, nodes, band = queries[alive], children[alive], np.minimum(band[alive], 2)
        starts = np.flatnonzero(shared <= depth)
        if not len(queries):
            break
    return np.concatenate([q for q, _ in out]), np.concatenate([f for _, f in out]), visited


def near_pairs(words: DataFrame, least_length: int = 6) -> DataFrame:
    """word, near and near_n for all words one edit apart, in both directions; each pair once."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        data = pa.Table.from_batches(rows)
        names, n = data.column("word").to_pylist(), data.column("n").to_numpy()
        size = data.column("size").to_numpy()
        table, lengths = code_points(data.column("middle").to_pylist())
        whole = np.array([len(w) for w in names], np.int64)
        groups = data.column("group").to_numpy()
        asked = np.flatnonzero(whole == size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(asked), QUERIES):
            q, f, _ = scan(table, lengths, groups, asked[at : at + QUERIES])
            longer = whole[f] > whole[q]  # such a word is no query here: its own side of the pair comes from this one
            left += [q, f[longer]]
            right += [f, q[longer]]
        q, f = np.concatenate(left), np.concatenate(right)
        if not len(q):
            return None
        column = data.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([column.take(pa.array(q)), column.take(pa.array(f)), pa.array(n[f])], ["word", "near", "near_n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        number, last, n = 0, None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("size", "start", "stop", "key"))))
            changes = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
            numbers = np.zeros(len(keys), np.int64)
            numbers[changes] = 1
            numbers = np.cumsum(numbers) + number
            rows = pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), batch.column("size"), batch.column("middle"), pa.array(numbers)], ["word", "n", "size", "middle", "group"])
            at = 0
            for cut in changes:
                if n + cut - at >= BATCH:
                    held.append(rows.slice(at, cut - at))
                    if (out := found([h for h in held if h.num_rows])) is not None:
                        yield out
                    held, n, at = [], 0, cut
            held.append(rows.slice(at))
            n += len(keys) - at
            number, last = int(numbers[-1]) if len(keys) else number, keys[-1] if keys else last
        if n and (out := found([h for h in held if h.num_rows])) is not None:
            yield out

    names = ["size", "start", "stop", "key"]
    rows = grouped(words, least_length).repartition(*names).sortWithinPartitions(*names, "middle")
    pairs = rows.mapInArrow(run, "word string, near string, near_n long")
    return pairs.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form): forms followed to the last, twice as far in each round.

    A form is several times as frequent as its word, so there are no circles and few rounds.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left")
        now = stored(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, misspell: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``least_count`` occurrences or more.

    ``form`` is the most frequent word one edit away (ties: the first by code points) if it is
    ``ratio`` times as frequent, ``root`` the last form that forms lead to.
    """
    words = stored(word_counts(docs, least_length, misspell, doc_id, text).where(F.col("n") >= least_count), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_pairs(words, least_length).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    is_form = form_n >= F.col("n") * ratio
    facts = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, form_n).alias("form_n")
    )
    facts = stored(facts, "variant-facts")
    roots = last_forms(facts.where("form IS NOT NULL"))
    return facts.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
