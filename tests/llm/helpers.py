"""Small tables with everything that may go wrong, and plain re-statements of the rules."""

import re

from pyspark.sql import functions as F

CLASHES = ("row", "size", "shard", "slot", "score", "fp", "first", "position", "source_size", "term", "matches", "_row", "_text", "item", "word", "n", "key")

DOCS = [
    (0, "All rights reserved. Licensed under CC BY 4.0.", "en", "b"),
    (1, None, "en", "b"),
    (2, "", None, None),
    (3, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (3, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (4, "one two three four five six seven eight nine ten eleven TWELVE", "en", "a"),
    (None, "a row without an id, all rights\nReserved", "en", "a"),
    (5, "É ü 漢字    two  spaces\t\ttabs\r\n<|endoftext|> end ", "fr", "c"),
    (6, "word " * 30_000, "en", "c"),
    (7, "   \n\t ", "en", "c"),
    (8, "x", "en", "c"),
]


def docs(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in CLASHES})


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
