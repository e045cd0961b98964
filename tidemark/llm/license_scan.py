"""License scan: exact set-similarity join of text blocks with license templates.

A template's distinct words are ordered by how often they occur in the whole corpus,
rarest first. A block that holds at least ``threshold`` of them must hold one of the
first ``n - need + 1`` (prefix filter), must have ``need`` template words at all (length
filter), and the place of its first common word bounds what can still be common
(positional filter). What passes is counted exactly. A template's blocks are runs of
``2 * len`` words that start every ``len`` words, so any text as long as the template
lies whole in one of them. Templates with ``phrase=True`` need their words in order.

Templates are a small parameter; the corpus is scanned twice and never shuffled, but
for one count per template word and task.

Null and empty texts have no words and no matches. Repeated rows and ids are separate
rows with equal results. Ties: matches are sorted by place, then by template name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import texts, words

#: The templates are sent to every task with their words; more text than this is refused.
MAX_TEMPLATE_WORDS = 200_000


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    threshold: float = 1.0
    phrase: bool = False


# The phrases and labels every scan reports.
BASE = (
    Template("phrase cc by", "cc-by", "cc by", phrase=True),
    Template("phrase general public license", "gpl", "general public license", phrase=True),
    Template("phrase all rights reserved", "reserved", "all rights reserved", phrase=True),
)

# Well-known notices, in the words their licenses ask for.
NOTICES = (
    Template("apache line", "apache-2.0", "Licensed under the Apache License, Version 2.0", 0.85),
    Template(
        "apache notice",
        "apache-2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "apache.org/licenses. Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS basis, without warranties or conditions of any kind",
        0.8,
    ),
    Template("mit line", "mit", "Released under the MIT License", 0.8),
    Template("mit line 2", "mit", "Licensed under the MIT License", 0.8),
    Template(
        "mit grant",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the software without restriction, including the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense and/or sell copies of the software",
        0.8,
    ),
    Template(
        "bsd grant",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        0.8,
    ),
    Template("gpl line", "gpl", "This work is licensed under the GNU General Public License, version 3", 0.8),
    Template(
        "gpl grant",
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        0.8,
    ),
    Template("cc by line", "cc-by", "Licensed under CC BY 4.0", 1.0),
    Template("cc by-nc line", "cc-by-nc", "Licensed under CC BY-NC 4.0", 1.0),
    Template("cc by-sa line", "cc-by-sa", "Licensed under CC BY-SA 4.0", 1.0),
    Template("mozilla line", "mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", 0.85),
)

MATCH = "struct<label:string, template:string, phrase:boolean, start:long, stop:long, containment:double>"


class _Probe:
    """One template with its words in corpus order."""

    def __init__(self, template: Template, counts: dict[bytes, int]):
        self.template = template
        self.run = words(template.text.encode())
        order = sorted(set(self.run), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.need = max(1, math.ceil(template.threshold * len(order) - 1e-9))
        self.prefix = order[: len(order) - self.need + 1]
        self.stride = len(self.run)

    def match(self, doc: list[bytes], block: int) -> tuple[int, int, float] | None:
        """Start, stop and containment of the template in a block, None if too few words are there."""
        at = block * self.stride
        rank = self.rank
        seen = {w for w in doc[at : at + 2 * self.stride] if w in rank}
        if len(seen) < self.need:
            return None
        mine = sorted(rank[w] for w in seen)
        if 1 + min(len(rank) - mine[0] - 1, len(mine) - 1) < self.need:
            return None
        places = [i for i in range(at, min(len(doc), at + 2 * self.stride)) if doc[i] in rank]
        return places[0], places[-1] + 1, len(mine) / len(rank)

    def phrases(self, doc: list[bytes], block: int) -> Iterator[int]:
        at, n = block * self.stride, len(self.run)
        for i in range(at, min(at + self.stride, len(doc) - n) + 1):
            if doc[i : i + n] == self.run:
                yield i


def probes(templates: Iterable[Template], counts: dict[bytes, int]) -> dict[bytes, list[_Probe]]:
    """The probes to try at each word of a prefix."""
    found: dict[bytes, list[_Probe]] = {}
    for template in templates:
        probe = _Probe(template, counts)
        for word in probe.prefix:
            found.setdefault(word, []).append(probe)
    return found


def matches(doc: list[bytes], by_word: dict[bytes, list[_Probe]]) -> list[dict]:
    """Every place of a phrase and, of each other template, its fullest block in each run of matching blocks."""
    tried: dict[tuple[int, int], tuple[_Probe, int]] = {}
    for i in [i for i, w in enumerate(doc) if w in by_word]:
        for probe in by_word[doc[i]]:
            block = i // probe.stride
            for b in (block - 1, block):
                if b >= 0:
                    tried[(id(probe), b)] = (probe, b)
    found: dict[tuple, dict] = {}
    for probe, block in sorted(tried.values(), key=lambda x: (x[0].template.name, x[1])):
        hit = probe.match(doc, block)
        if hit is None:
            continue
        t = probe.template
        spans = [(s, s + len(probe.run), 1.0) for s in probe.phrases(doc, block)] if t.phrase else [hit]
        for start, stop, share in spans:
            found[(t.name, start, stop)] = {
                "label": t.label, "template": t.name, "phrase": t.phrase, "start": start, "stop": stop, "containment": share
            }
    return sorted(found.values(), key=lambda m: (m["start"], m["template"], m["stop"]))


def word_counts(docs: DataFrame, templates: Iterable[Template], text: str = "text") -> dict[bytes, int]:
    """How often each template word occurs in all texts."""
    vocabulary = {w for t in templates for w in words(t.text.encode())}

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for value in texts(batch.column(0)):
                total.update(w for w in words(value) if w in vocabulary)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(total.keys()), pa.binary()), "n": pa.array(list(total.values()), pa.int64())}
        )

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(
    docs: DataFrame, templates: Iterable[Template] = BASE + NOTICES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its id, ``n_words`` and ``matches`` (label, template, words from ``start`` to before ``stop``)."""
    templates = tuple(templates)
    if sum(len(words(t.text.encode())) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words for one scan; scan in blocks of templates")
    if any(not words(t.text.encode()) for t in templates):
        raise ValueError("a template has no words")
    counts = word_counts(docs, templates, text)
    kind = docs.schema[doc_id].dataType

    def scan(batches):
        by_word = probes(templates, counts)
        for batch in batches:
            n_words, found = [], []
            for value in texts(batch.column(1)):
                doc = words(value)
                n_words.append(len(doc))
                found.append(matches(doc, by_word))
            match = pa.struct([("label", pa.string()), ("template", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(match))], ["doc_id", "n_words", "matches"]
            )

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(scan, f"doc_id {kind.simpleString()}, n_words long, matches array<{MATCH}>")


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place of the base phrases, label lists and a score per document."""
    base = F.filter("matches", lambda m: m["phrase"])
    starts = F.transform(base, lambda m: m["start"])
    best = F.array_max(F.transform("matches", lambda m: m["containment"]))
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
