"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are at most ``examples`` labelled training rows of each class, those with the
smallest hash of their id. Words that speak for the label in them (log-likelihood ratio,
and how much larger a part of the toxic than of the other examples has them, whichever
class is the larger) are the terms; a term's inverse document frequency counts all
documents. With all words as terms the nearest texts are those of the same subject: half
of the toxic texts were missed then (README). Examples stand in the order of their terms, in blocks; the index keeps a
posting list per term and block and the largest weight in it.

For a document the bounds of all blocks are the sums of its weights times the largest
weights; blocks are scored in full from the best bound down until no bound reaches the
k-th best cosine, so the neighbours are exact, ties going to the smaller example id.
Votes are weighted by cosine over distance and by how many labelled rows an example
stands for. A prior worth ``prior`` votes, the share of toxic rows among those without
any term, steadies the score and is the score of texts without terms (empty ones too).

Null texts are empty. Labels that are null are ignored; if an id is labelled twice, the
larger label holds. Without labels of both kinds every score is the share of toxic ones
(0 if none). Repeated rows get equal results. Neither labels nor lang, source or id of a
document enter its score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.rows import texts, words, worker_cache

FOLDS = 5
KNOWN = 4_000  # votes that a task remembers


@dataclass(frozen=True)
class Settings:
    examples: int = 8_000  # of each class
    terms: int = 2_000
    least_ratio: float = 20.0  # log-likelihood ratio of a term
    least_lift: float = 2.0  # part of the toxic examples that have a term over that of the others
    neighbours: int = 25
    block: int = 128
    prior: float = 0.5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by five."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    terms: dict[bytes, int]
    idf: np.ndarray
    ids: list  # example ids, of the type they have in the documents, by number
    places: np.ndarray  # of the example ids in ascending order, by number
    toxic: np.ndarray
    votes: np.ndarray  # labelled rows that an example stands for
    starts: np.ndarray  # where each (term, block) posting list begins
    numbers: np.ndarray
    weights: np.ndarray
    most: np.ndarray  # terms x blocks, largest weight
    base: float  # score of a text without terms
    settings: Settings


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and label of training rows, one per id."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")


def pick_examples(train: DataFrame, settings: Settings) -> tuple[dict, dict[int, int]]:
    """The bounded sample as id -> label, and the number of labelled rows of each class."""
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = {}
    for label in (0, 1):
        rows = train.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(settings.examples)
        chosen |= {r[0]: label for r in rows.collect()}
    return chosen, totals


def example_rows(docs: DataFrame, chosen: dict) -> DataFrame:
    """The texts of the sample; its ids are few enough to be sent with the filter."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = spark.createDataFrame(list(chosen.items()), f"doc_id {kind}, toxic int")
    return docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id")


def select_terms(examples: DataFrame, chosen: dict, settings: Settings) -> list[bytes]:
    """Words that the labels single out, by document counts in the examples."""

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                seen[label].update(set(words(text)))
        for label, counter in seen.items():
            items = list(counter.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in items], pa.binary()), pa.array([n if label else 0 for _, n in items], pa.int64()), pa.array([0 if label else n for _, n in items], pa.int64())],
                ["word", "t", "c"],
            )

    counted = examples.mapInArrow(count, "word binary, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n1 = sum(chosen.values())
    n0 = len(chosen) - n1
    if not n0 or not n1:
        return []

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    t, c, n = F.col("t"), F.col("c"), F.lit(float(n0 + n1))
    all_with = t + c
    cells = [(t, all_with * n1 / n), (c, all_with * n0 / n), (n1 - t, (n - all_with) * n1 / n), (n0 - c, (n - all_with) * n0 / n)]
    ratio = 2 * sum((part(seen.cast("double"), expected) for seen, expected in cells), F.lit(0.0))
    lifted = t * n0 >= c * F.lit(settings.least_lift * n1)
    good = counted.withColumn("ratio", ratio).where(lifted & (F.col("ratio") >= settings.least_ratio))
    return sorted(bytes(r["word"]) for r in good.orderBy(F.desc("ratio"), "word").limit(settings.terms).collect())


def document_counts(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and their number."""
    number = {w: i for i, w in enumerate(terms)}

    def count(batches):
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                for i in {number[w] for w in words(text) if w in number}:
                    total[i] += 1
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_pydict({"term": np.arange(len(terms) + 1, dtype=np.int32), "n": total})

    found = {r["term"]: r["n"] for r in docs.select(F.col("text").cast("string")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(i, 0) for i in range(len(terms))], np.int64), found.get(len(terms), 0)


def vector(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights of unit length."""
    terms = np.array(sorted(counts), np.int64)
    weights = (1 + np.log([counts[t] for t in terms.tolist()])) * idf[terms]
    return terms, weights / np.sqrt((weights * weights).sum())


def term_vectors(examples: DataFrame, terms: list[bytes]) -> list[tuple]:
    """(doc_id, toxic, {term: count}) of each example, from the bounded sample."""
    number = {w: i for i, w in enumerate(terms)}
    kind = examples.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts = [sorted(Counter(number[w] for w in words(t) if w in number).items()) for t in texts(batch.column(1))]
            pair = pa.struct([("term", pa.int32()), ("n", pa.int32())])
            rows = [[{"term": t, "n": n} for t, n in c] for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pair))], ["doc_id", "toxic", "counts"])

    rows = examples.mapInArrow(run, f"doc_id {kind}, toxic int, counts array<struct<term:int, n:int>>").collect()
    return sorted(((r["doc_id"], r["toxic"], {c["term"]: c["n"] for c in r["counts"]}) for r in rows), key=lambda r: r[0])


def build_model(vectors: list[tuple], terms: list[bytes], idf: np.ndarray, scale: dict[int, float], settings: Settings) -> Model:
    """The index of all examples that have terms; the others give the score of texts without."""
    bare = Counter()
    for _, toxic, counts in vectors:
        if not counts:
            bare[toxic] += scale[toxic]
    base = bare[1] / (bare[0] + bare[1]) if bare else 0.0
    made = [(sorted(c), i, toxic, *vector(Counter(c), idf)) for i, toxic, c in vectors if c]
    made.sort(key=lambda m: (m[0], m[1]))
    blocks = max(1, -(-len(made) // settings.block))
    lists: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for number, (_, _, _, own, weights) in enumerate(made):
        for t, w in zip(own.tolist(), weights.tolist()):
            lists.setdefault((t, number // settings.block), []).append((number, w))
    starts, numbers, weights, most = [0], [], [], np.zeros((len(terms), blocks))
    for t in range(len(terms)):
        for b in range(blocks):
            held = lists.get((t, b), [])
            numbers += [n for n, _ in held]
            weights += [w for _, w in held]
            most[t, b] = max((w for _, w in held), default=0.0)
            starts.append(len(numbers))
    ids = [m[1] for m in made]
    places = np.empty(len(ids), np.int64)
    places[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    return Model(
        {w: i for i, w in enumerate(terms)}, idf, ids, places, np.array([m[2] for m in made], np.int64),
        np.array([scale[m[2]] for m in made]), np.array(starts), np.array(numbers, np.int64), np.array(weights), most, base, settings,
    )


def nearest(model: Model, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and cosines of the nearest examples, by descending cosine, then id."""
    terms, weights = vector(counts, model.idf)
    bounds = weights @ model.most[terms]
    blocks = model.most.shape[1]
    k, size = model.settings.neighbours, model.settings.block
    best_n, best_s = np.empty(0, np.int64), np.empty(0)
    for b in np.argsort(-bounds, kind="stable"):
        if bounds[b] <= 0 or (len(best_n) == k and bounds[b] < best_s[-1] - 1e-9):
            break
        scores = np.zeros(size)
        for t, w in zip(terms.tolist(), weights.tolist()):
            at = slice(model.starts[t * blocks + b], model.starts[t * blocks + b + 1])
            scores[model.numbers[at] - b * size] += w * model.weights[at]
        hit = np.flatnonzero(scores > 0)
        best_n = np.concatenate([best_n, hit + b * size])
        best_s = np.concatenate([best_s, np.round(scores[hit], 12)])
        order = np.lexsort((model.places[best_n], -best_s))[:k]
        best_n, best_s = best_n[order], best_s[order]
    return best_n, best_s


def vote(model: Model, counts: Counter) -> tuple[float, list[dict]]:
    """Score and evidence of a document with terms."""
    found, cosine = nearest(model, counts)
    weight = cosine / (1.05 - cosine) * model.votes[found]
    toxic = float((weight * model.toxic[found]).sum())
    prior = model.settings.prior
    score = (toxic + prior * model.base) / (float(weight.sum()) + prior)
    return score, [{"doc_id": i, "toxic": t, "cosine": c} for i, t, c in zip([model.ids[n] for n in found.tolist()], model.toxic[found].tolist(), cosine.tolist())]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    train = labelled(labels)
    chosen, totals = pick_examples(train, settings)
    sample = Counter(chosen.values())
    scale = {label: totals[label] / n for label, n in sample.items()}
    examples = example_rows(docs, chosen)
    terms = select_terms(examples, chosen, settings)
    if not terms:
        base = totals.get(1, 0) / max(1, sum(totals.values()))
        return Model({}, np.empty(0), [], np.empty(0), np.empty(0), np.empty(0), np.zeros(1, int), np.empty(0), np.empty(0), np.zeros((0, 1)), base, settings)
    counts, n = document_counts(docs, terms)
    idf = np.log((n + 1) / (counts + 1)) + 0.1
    return build_model(term_vectors(examples, terms), terms, idf, scale, settings)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (example id, label and cosine) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: dict[tuple, tuple[float, list[dict]]] = worker_cache("votes")
        known.clear()
        number = model.terms
        for batch in batches:
            scores, evidence = [], []
            for text in texts(batch.column(1)):
                hits = [number[w] for w in words(text) if w in number]
                if not hits:
                    scores.append(model.base)
                    evidence.append([])
                    continue
                counts = Counter(hits)
                key = tuple(sorted(counts.items()))
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = vote(model, counts)
                scores.append(known[key][0])
                evidence.append(known[key][1])
            row = pa.struct([("doc_id", batch.column(0).type), ("toxic", pa.int64()), ("cosine", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(row))], ["doc_id", "score", "evidence"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind}, toxic:long, cosine:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    source = docs.select("doc_id", "text")
    return score_texts(source, fit(source, labels, settings))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is below one half, with all their columns."""
    model = fit(docs.select("doc_id", "text"), labels)
    at = docs.columns.index("text")

    def run(batches):
        known: dict[tuple, float] = worker_cache("votes")
        known.clear()
        number = model.terms
        for batch in batches:
            keep = []
            for text in texts(batch.column(at)):
                counts = Counter(number[w] for w in words(text) if w in number)
                key = tuple(sorted(counts.items()))
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = vote(model, counts)[0] if counts else model.base
                keep.append(known[key] < 0.5)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
