"""Quality rules: log-likelihood ratio of hashed n-grams between trusted and raw text, with DataFrame operations only.

Words and pairs of words are hashed (the top bits of their XXH64) into ``BUCKETS``
buckets. Two multinomials over the buckets are counted, one over the trusted documents and
one over all of them, each with one added to every bucket. A document's score is the sum
of the logarithms of their ratio over its n-grams, divided by their number; a document is
kept if that is at least ``THRESHOLD``. Ratios are rounded to whole millionths before they
are summed, so scores and verdicts do not depend on the order of additions.

Beside the score stand plain rules: too few words, or too many of them in repeated windows.

Everything about one document is computed in its row; only counts and one short row per
document are shuffled, and the ratios that are broadcast have at most ``BUCKETS`` rows. A
document counts as trusted if any row of its id in the label table says so. Trusted ids are
broadcast up to ``BROADCAST_IDS`` and joined beyond. Without trusted text there is no ratio
and only the plain rules decide. Null and empty texts have no words and fail the rules;
repeated rows are rows of their own; a null id is never trusted; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.once import compute_once
from tidemark.llm.rows import stored
from tidemark.session import configure

BITS = 14
BUCKETS = 1 << BITS
THRESHOLD = -0.05
UNIT = 1_000_000
LEAST_WORDS = 50
REPEATED_PERCENT = 50
BROADCAST_IDS = 2_000_000


def word_list(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def windows_of(words: Column) -> Column:
    """All runs of three words as strings; words hold no spaces, so different runs are different strings."""
    rest = F.greatest(F.size(words), F.lit(1))
    runs = F.arrays_zip(words, F.slice(words, 2, rest), F.slice(words, 3, rest)).cast("array<string>")
    return F.slice(runs, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def bucket(*words: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*words), 64 - BITS)


def word_pairs(rows: DataFrame) -> DataFrame:
    """One row per place of ``words``: the buckets of its word and of the pair that begins there (null at the last)."""
    kept = [c for c in rows.columns if c != "words"]
    places = rows.select(*kept, "words", F.posexplode_outer("words").alias("at", "word"))
    after = F.get("words", F.col("at") + 1)
    return places.select(*kept, F.when(F.col("word").isNotNull(), bucket(F.col("word"))).alias("one"), F.when(after.isNotNull(), bucket(F.col("word"), after)).alias("two"))


def covered(windows: Column) -> Column:
    """Number of places inside windows of three that occur twice or more.

    A map keeps the last place of each window, one of the reversed list the first: what is not the last or not the
    first place of its window is a place of a repeated one.
    """
    places = F.sequence(F.lit(0), F.size(windows) - 1)
    last = F.map_values(F.map_from_arrays(windows, places))
    first = F.map_values(F.map_from_arrays(F.reverse(windows), F.reverse(places)))
    again = F.array_union(F.array_except(places, last), F.array_except(places, first))
    return F.size(F.array_distinct(F.flatten(F.transform(again, lambda at: F.array(at, at + 1, at + 2)))))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, words and the plain measures of every document, from one look at its text."""
    configure(docs.sparkSession)  # maps keep the last value of a repeated key
    data, words = F.coalesce(F.col("text"), F.lit("")), F.col("words")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    parsed = compute_once(
        rows,
        words=word_list(F.col("text")),
        lines=F.filter(F.split(data, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=F.regexp_count(data, F.lit(r"[#*$%&|<>]")).cast("long"),
    ).drop("text")
    counted = compute_once(
        parsed,
        windows=windows_of(words),
        word_chars=F.char_length(F.array_join(words, "")).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    ).drop("lines")
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    n_repeat_words = F.when(repeats, covered(F.col("windows"))).otherwise(0).cast("long")
    return compute_once(counted, n_repeat_words=n_repeat_words).select("row", "doc_id", "words", F.size(words).cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def trusted_ids(labels: DataFrame, good: Column, doc_id: str = "doc_id") -> DataFrame:
    """Ids of the documents that some row of the label table calls good."""
    ids = stored(labels.where(good).select(F.col(f"`{doc_id}`").alias("trusted")).where("trusted IS NOT NULL").distinct(), "trusted-ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def bucket_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket and ratio (whole millionths) of the buckets that occur in the corpus."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    marked = rows.join(trusted, F.col("doc_id") == F.col("trusted"), "left").select(F.col("trusted").isNotNull().cast("long").alias("good"), "text")
    places = word_pairs(compute_once(marked, words=word_list(F.col("text"))).drop("text"))
    grams = places.select("good", F.explode(F.array("one", "two")).alias("bucket")).where("bucket IS NOT NULL")
    counts = stored(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")), "gram-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    if not total["good"]:
        return counts.select("bucket", F.lit(0).cast("long").alias("ratio"))
    share = lambda name: F.ln((F.col(name) + 1) / F.lit(float(total[name] + BUCKETS)))
    return counts.select("bucket", F.round((share("good") - share("raw")) * UNIT).cast("long").alias("ratio"))


def judge(docs: DataFrame, labels: DataFrame, good: Column | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, plain measures, base_failed, n_grams, ratio_sum (millionths), score (a word or pair) and kept of every document."""
    trusted = trusted_ids(labels, F.col("quality") == 1 if good is None else good, doc_id)
    ratios = bucket_ratios(docs, trusted, doc_id, text)
    plain = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    places = word_pairs(measured(docs, doc_id, text).select("row", "doc_id", *plain, "words"))
    of = lambda name: F.broadcast(ratios.select(F.col("bucket").alias(name), F.col("ratio").alias(f"{name}_ratio")))
    ratio = F.coalesce("one_ratio", F.lit(0)) + F.coalesce("two_ratio", F.lit(0))
    # All places of a document are in one task, so the partial sum leaves one short row of it.
    summed = places.join(of("one"), "one", "left").join(of("two"), "two", "left").groupBy("row", "doc_id", *plain).agg((F.count("one") + F.count("two")).alias("n_grams"), F.sum(ratio).alias("ratio_sum"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    enough = F.col("ratio_sum") >= F.col("n_grams") * round(threshold * UNIT)
    score = F.col("ratio_sum") / F.greatest("n_grams", F.lit(1)) / UNIT
    return summed.select("doc_id", *plain, failed.alias("base_failed"), "n_grams", "ratio_sum", score.alias("score"), (~failed & enough).alias("kept"))
