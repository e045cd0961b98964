"""Mixing sources to target weights with a curriculum over training time.

Sources get shares of all words by weight; a target stops at ``max_repeat`` times its
source's size and the excess is shared anew by weight. A source's documents stand in a
fixed random order, again and again, on an axis of words; it takes documents from the
front until its target is reached.

Each source has a schedule: relative weights at evenly spaced times of training, linear
between them. The integral of the schedule is the demand for its words up to a time;
the document that begins at word ``u`` of a source is trained on when the demand reaches
``u``, so its position is the inverse of the demand at ``u``. The mix is range-sorted by
position.

Word offsets are running sums per (source, slice of the order): slice sums are one small
table, and no window holds a whole source.

Null sources come last in the order and form one source; null texts have no words and
take nothing. Rows equal in id, source and size are taken together. Ties of position
are broken by source and id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.rows import packed, stored, word_count

SLICES = 256
# Relative weights over training: later sources of the weight cycle rise, the first falls.
SCHEDULES: tuple[tuple[float, ...], ...] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), max_repeat: float = 3.0) -> DataFrame:
    """source, source_size, target and the place of the source in the weight cycle.

    Sharing with limits has a closed form: with sources sorted by limit per weight, the
    limited ones are a prefix, and the rest share what remains by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    cycle = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    weighted = sizes.withColumn("cycle", cycle).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cycle") + 1))
    limited = weighted.withColumn("limit", F.col("source_size") * F.lit(float(max_repeat)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sums = (
        limited.withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("limits_before", F.sum("limit").over(fill) - F.col("limit"))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"))
    )
    # The level (words per unit of weight) if this source were the first that is not limited.
    level = (F.col("all_size") - F.col("limits_before")) / F.col("weights_left")
    fits = sums.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    first = F.min(F.when(F.col("fits"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "source", "level"))).over(everything)
    final = first.getField("level")
    return fits.withColumn("final", final).select(
        "source", "source_size", "cycle", F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("limit")), F.col("limit")).alias("target")
    )


def demand_inverse(share: Column, schedule: Sequence[float]) -> Column:
    """The time in [0, 1] at which the integral of a piecewise-linear schedule reaches a share of its whole."""
    points = [float(x) for x in schedule]
    if len(points) < 2 or min(points) <= 0:
        raise ValueError("a schedule needs two or more positive weights")
    step = 1.0 / (len(points) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(points, points[1:])]
    whole, before, time = sum(areas), 0.0, None
    for i, area in enumerate(areas):
        a, slope = points[i], (points[i + 1] - points[i]) / step
        left = share * F.lit(whole) - F.lit(before)
        # a*t + slope*t*t/2 = left, in the form that also holds for slope 0
        root = 2 * left / (F.lit(a) + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * F.lit(slope) * left)))
        here = F.lit(i * step) + F.least(F.greatest(root, F.lit(0.0)), F.lit(step))
        before += area
        time = here if time is None else F.when(share * F.lit(whole) <= F.lit(before - area), time).otherwise(here)
    return time


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    max_repeat: float = 3.0,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, source, size, copies, source_size, target, taken and ``positions`` of its uses.

    ``copies`` counts rows that are equal in id, source and size; ``taken`` is of one row.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    units = stored(
        rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("order", order).withColumn("slice", F.conv(F.substring("order", 1, 2), 16, 10).cast("int")),
        "mix-units",
    )
    words = (F.col("size") * F.col("copies")).alias("words")
    slices = units.groupBy("source", "slice").agg(F.sum(words).alias("words"))
    # At most SLICES rows per source, and one row per source.
    before = F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")
    goals = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    offsets = slices.withColumn("before", before).alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
    offsets = offsets.select(F.col("o.source").alias("_source"), F.col("slice").alias("_slice"), "before", "source_size", "target", "cycle")
    inside = F.sum(words).over(Window.partitionBy("source", "slice").orderBy("order", "doc_id", "size")) - words
    placed = units.withColumn("inside", inside).join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
    start = F.col("before") + F.col("inside")
    # Use e begins at word start + e * source_size of the source's axis.
    uses = F.ceil((F.col("target") - start) / F.col("source_size"))
    uses = F.when((F.col("size") > 0) & (F.col("target") > start), uses).otherwise(0).cast("int")
    share = lambda e: (F.col("start") + e * F.col("source_size")) / F.col("target")
    curve = lambda e: F.coalesce(*[F.when(F.pmod("cycle", F.lit(len(schedules))) == i, demand_inverse(share(e), s)) for i, s in enumerate(schedules)])
    positions = F.when(F.col("uses") > 0, F.transform(F.sequence(F.lit(0), F.col("uses") - 1), curve)).otherwise(F.array().cast("array<double>"))
    return (
        placed.withColumn("start", start)
        .withColumn("uses", uses)
        .withColumn("positions", positions)
        .select("doc_id", "source", "size", "copies", "source_size", F.col("target").cast("double").alias("target"), (F.col("uses") * F.col("size")).cast("long").alias("taken"), "positions")
    )


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: the documents' rows, once per use, range-sorted by training position."""
    uses = plan.where(F.size("positions") > 0).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "positions")
    rows = packed(docs, _doc=F.col("doc_id"), _src=F.col("source").cast("string"), _words=word_count("text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_src").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    taken = rows.join(uses, same).select("row", F.explode("positions").alias("position"))
    return taken.orderBy("position", F.col("row.source"), F.col("row.doc_id")).select("row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per row of documents: size, source_size, target and taken, in the order of first training positions."""
    plan = mix_plan(docs)
    each = plan.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_")
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1)).alias("position")
    return each.select("doc_id", "size", "source_size", "target", "taken", first).orderBy(F.col("position").asc_nulls_last(), "doc_id").drop("position")
