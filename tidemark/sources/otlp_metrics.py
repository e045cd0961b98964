"""OpenTelemetry metric documents (JSON form) to samples.

A document is parsed once, then exploded to metrics, points and samples in turn,
whatever mix of shapes it holds. Labels and times are read once per point. No
shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timebin import floor_div

ATTRIBUTES = (
    "array<struct<key:string,value:struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,"
    "arrayValue:variant,kvlistValue:variant>>>"
)
NUMBER_POINT = f"struct<attributes:{ATTRIBUTES},timeUnixNano:string,asDouble:double,asInt:string>"
HISTOGRAM_POINT = (
    f"struct<attributes:{ATTRIBUTES},timeUnixNano:string,count:string,sum:double,"
    "bucketCounts:array<string>,explicitBounds:array<double>>"
)
SUMMARY_POINT = (
    f"struct<attributes:{ATTRIBUTES},timeUnixNano:string,count:string,sum:double,"
    "quantileValues:array<struct<quantile:double,value:double>>>"
)
BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
EXP_POINT = (
    f"struct<attributes:{ATTRIBUTES},timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,"
    f"positive:{BUCKETS},negative:{BUCKETS}>"
)
METRIC = (
    f"struct<name:string,gauge:struct<dataPoints:array<{NUMBER_POINT}>>,sum:struct<dataPoints:array<{NUMBER_POINT}>>,"
    f"histogram:struct<dataPoints:array<{HISTOGRAM_POINT}>>,summary:struct<dataPoints:array<{SUMMARY_POINT}>>,"
    f"exponentialHistogram:struct<dataPoints:array<{EXP_POINT}>>>"
)
METRICS_DOCUMENT = f"struct<resourceMetrics:array<struct<scopeMetrics:array<struct<metrics:array<{METRIC}>>>>>>"

KINDS = ("gauge", "sum", "histogram", "summary", "exponentialHistogram")


def unreadable(doc: Column, content: Column) -> Column:
    """Whether a text is not a JSON object; only texts without ``content`` after parsing are looked at again."""
    is_object = F.ltrim(doc).startswith("{") & F.try_parse_json(doc).isNotNull()
    return F.when(content.isNull(), ~F.coalesce(is_object, F.lit(False))).otherwise(F.lit(False))


def unreadable_documents(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows whose document cannot be read, without it, in the form of the other rejects."""
    content = F.from_json(F.col(doc), "resourceMetrics variant")["resourceMetrics"]
    carried = [c for c in df.columns if c != doc]
    return df.filter(unreadable(F.col(doc), content)).select(
        *carried, F.lit(None).cast("string").alias("name"), F.lit("document is not readable").alias("reason"), F.lit(0).alias("points")
    )


def metric_rows(df: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per metric of the documents in column ``doc``."""
    carried = [c for c in df.columns if c != doc]
    parsed = F.from_json(F.col(doc), METRICS_DOCUMENT)
    metrics = F.flatten(
        F.transform(
            F.flatten(F.transform(parsed["resourceMetrics"], lambda r: r["scopeMetrics"])), lambda s: s["metrics"]
        )
    )
    return df.select(*carried, F.inline(metrics))


def attribute_labels(attributes: Column) -> Column:
    """Label map of an attribute list: scalar values in text form, lists and maps as JSON."""

    def text(v: Column) -> Column:
        return F.coalesce(
            v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), v["bytesValue"],
            F.to_json(v["arrayValue"]), F.to_json(v["kvlistValue"]), F.lit(""),
        )

    listed = F.coalesce(attributes, F.array().cast(ATTRIBUTES))
    return F.map_from_entries(F.transform(listed, lambda a: F.struct(a["key"], text(a["value"]))))


def millis(time_unix_nano: Column) -> Column:
    return floor_div(F.coalesce(time_unix_nano.try_cast("bigint"), F.lit(0).cast("bigint")), 1_000_000)


def fixed6(c: Column) -> Column:
    """Six decimals, the text form of bounds and quantiles."""
    return F.format_string("%.6f", c)


# One point of any kind: its labels and time, and the values its kind carries.
POINT_FIELDS = {
    "kind": "string",
    "bad": "string",
    "labels": "map<string,string>",
    "ts_ms": "bigint",
    "value": "double",
    "total": "double",
    "buckets": "array<string>",
    "bounds": "array<double>",
    "quantiles": "array<struct<quantile:double,value:double>>",
    "scale": "int",
    "zeros": "double",
    "negative": BUCKETS,
    "positive": BUCKETS,
}
POINT_TYPES = {
    "gauge": NUMBER_POINT,
    "sum": NUMBER_POINT,
    "histogram": HISTOGRAM_POINT,
    "summary": SUMMARY_POINT,
    "exponentialHistogram": EXP_POINT,
}


def _unread(text: Column, to: str) -> Column:
    """Whether a number in text form is given but cannot be read."""
    return text.isNotNull() & text.try_cast(to).isNull()


def _bad_number(kind: str, p: Column) -> Column:
    """What is wrong with the numbers of a point, null if nothing is."""
    values = [p["asInt"]] if kind in ("gauge", "sum") else [p["count"]]
    lists = []
    if kind == "histogram":
        lists = [p["bucketCounts"]]
    if kind == "exponentialHistogram":
        values, lists = [*values, p["zeroCount"]], [p["negative"]["bucketCounts"], p["positive"]["bucketCounts"]]
    wrong = F.lit(False)
    for value in values:
        wrong = wrong | _unread(value, "double")
    for counts in lists:
        wrong = wrong | F.coalesce(F.exists(counts, lambda c: _unread(c, "double")), F.lit(False))
    return F.when(_unread(p["timeUnixNano"], "bigint"), F.lit("time is not a number")).when(wrong, F.lit("value is not a number"))


def _point(kind: str, p: Column) -> Column:
    """The common struct of one point."""
    number = F.coalesce(p["asDouble"], p["asInt"].try_cast("double"), F.lit(0.0)) if kind in ("gauge", "sum") else None
    given = {
        "kind": F.lit(kind),
        "bad": _bad_number(kind, p),
        "labels": attribute_labels(p["attributes"]),
        "ts_ms": millis(p["timeUnixNano"]),
        "value": number if number is not None else F.coalesce(p["count"].try_cast("double"), F.lit(0.0)),
    }
    if kind in ("histogram", "summary", "exponentialHistogram"):
        given["total"] = p["sum"]
    if kind == "histogram":
        given |= {"buckets": p["bucketCounts"], "bounds": p["explicitBounds"]}
    if kind == "summary":
        given |= {"total": F.coalesce(p["sum"], F.lit(0.0)), "quantiles": p["quantileValues"]}
    if kind == "exponentialHistogram":
        given |= {
            "scale": p["scale"],
            "zeros": F.coalesce(p["zeroCount"].try_cast("double"), F.lit(0.0)),
            "negative": p["negative"],
            "positive": p["positive"],
        }
    return F.struct(
        *[given.get(n, F.lit(None)).cast(kind_type).alias(n) for n, kind_type in POINT_FIELDS.items()]
    )


def _point_rows(metrics: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per point of the given kinds, so labels and time are read once per point."""
    carried = [c for c in metrics.columns if c not in KINDS]

    def points(kind: str) -> Column:
        listed = F.coalesce(F.col(kind)["dataPoints"], F.array().cast(f"array<{POINT_TYPES[kind]}>"))
        return F.transform(listed, lambda p: _point(kind, p))

    every = [points(k) for k in kinds]
    return metrics.select(*carried, F.inline(F.concat(*every) if len(every) > 1 else every[0]))


PARTS = "array<struct<suffix:string,key:string,bound:string,value:double>>"


def _part(suffix: str, value: Column, key: str | None = None, bound: Column | None = None) -> Column:
    return F.struct(
        F.lit(suffix).alias("suffix"),
        F.lit(key).cast("string").alias("key"),
        (F.lit(None).cast("string") if bound is None else bound).alias("bound"),
        value.try_cast("double").alias("value"),
    )


def _none() -> Column:
    return F.array().cast(PARTS)


def _count_and_sum() -> Column:
    total = F.when(F.col("total").isNotNull(), F.array(_part("_sum", F.col("total")))).otherwise(_none())
    return F.concat(F.array(_part("_count", F.col("value"))), total)


def _bucket_parts(cumulative: bool) -> Column:
    counts = F.coalesce("buckets", F.array().cast("array<string>"))

    def bucket(count: Column, i: Column) -> Column:
        last = i == F.size(counts) - 1
        bound = F.when(last, F.lit("+Inf")).otherwise(fixed6(F.get("bounds", i)))
        return _part("_bucket", count, "le", bound)

    numbers = F.transform(counts, lambda c: c.try_cast("double"))
    if cumulative:  # one running fold over the buckets
        none = F.array().cast("array<double>")
        numbers = F.aggregate(numbers, none, lambda acc, c: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + c)))
    return F.transform(numbers, bucket)


def _quantile_parts() -> Column:
    listed = F.coalesce("quantiles", F.array().cast(POINT_FIELDS["quantiles"]))
    return F.transform(listed, lambda q: _part("", q["value"], "quantile", fixed6(q["quantile"])))


def _exp_parts() -> Column:
    """Bucket ``i`` of a side covers ``(base^i, base^(i+1)]`` with base ``2^(2^-scale)``, as the data model defines it."""
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -F.col("scale")))

    def side(name: str, sign: int) -> Column:
        buckets = F.col(name)
        counts = F.coalesce(buckets["bucketCounts"], F.array().cast("array<string>"))
        # The upper bound of a negative bucket is its end nearer to zero.
        first = F.coalesce(buckets["offset"], F.lit(0)) + (1 if sign > 0 else 0)
        return F.transform(
            counts, lambda c, i: _part("_bucket", c, "le", fixed6(F.lit(float(sign)) * F.pow(base, first + i)))
        )

    zero = F.array(_part("_bucket", F.col("zeros"), "le", fixed6(F.lit(0.0))))
    return F.concat(_count_and_sum(), side("negative", -1), zero, side("positive", 1))


def _samples(points: DataFrame, parts: Column) -> DataFrame:
    """One row per sample: the point's labels, with the part's own label added."""
    carried = [c for c in points.columns if c not in (*POINT_FIELDS, "name")]
    rows = points.filter(F.col("bad").isNull()).select(*carried, "name", "labels", "ts_ms", F.inline(parts))
    return rows.select(
        *carried,
        F.concat("name", "suffix").alias("name"),
        F.when(F.col("key").isNull(), F.col("labels"))
        .otherwise(F.map_concat("labels", F.create_map("key", "bound")))
        .alias("labels"),
        "value",
        F.timestamp_millis("ts_ms").alias("ts"),
    )


def _number_parts() -> Column:
    return F.array(_part("", F.col("value")))


def _histogram_parts(cumulative: bool) -> Column:
    return F.concat(_count_and_sum(), _bucket_parts(cumulative))


def _summary_parts() -> Column:
    return F.concat(_count_and_sum(), _quantile_parts())


def number_points(metrics: DataFrame) -> DataFrame:
    """Samples of gauges and sums."""
    return _samples(_point_rows(metrics, ["gauge", "sum"]), _number_parts())


def histogram_points(metrics: DataFrame, cumulative: bool = False) -> DataFrame:
    """``_count``, ``_sum`` and ``_bucket`` samples.

    Buckets carry the count of their own interval; ``cumulative=True`` gives the
    running count a Prometheus histogram has.
    """
    return _samples(_point_rows(metrics, ["histogram"]), _histogram_parts(cumulative))


def summary_points(metrics: DataFrame) -> DataFrame:
    """``_count``, ``_sum`` and one sample per quantile."""
    return _samples(_point_rows(metrics, ["summary"]), _summary_parts())


def exp_histogram_points(metrics: DataFrame) -> DataFrame:
    """Opt-in expansion of exponential histograms, which the document reader rejects."""
    return _samples(_point_rows(metrics, ["exponentialHistogram"]), _exp_parts())


def flatten_otlp_metrics(df: DataFrame, doc: str = "doc", cumulative: bool = False) -> tuple[DataFrame, DataFrame]:
    """All samples of the documents, and what was not read: documents, metrics of unknown kind, points with bad numbers."""
    metrics = metric_rows(df, doc)
    points = _point_rows(metrics, list(KINDS[:-1]))
    kind = F.col("kind")
    samples = _samples(
        points,
        F.when(kind.isin("gauge", "sum"), _number_parts())
        .when(kind == "histogram", _histogram_parts(cumulative))
        .otherwise(_summary_parts()),
    )
    carried = [c for c in metrics.columns if c not in KINDS and c != "name"]
    known = F.lit(False)
    for name in KINDS[:-1]:
        known = known | F.col(name).isNotNull()
    is_exp = F.col("exponentialHistogram").isNotNull()
    rejects = metrics.filter(~known).select(
        *carried,
        "name",
        F.when(is_exp, F.lit("unsupported type ExponentialHistogram"))
        .otherwise(F.lit("unknown metric type"))
        .alias("reason"),
        F.when(is_exp, F.coalesce(F.size("exponentialHistogram.dataPoints"), F.lit(0))).otherwise(0).alias("points"),
    )
    wrong = points.filter(F.col("bad").isNotNull()).select(*carried, "name", F.col("bad").alias("reason"), F.lit(1).alias("points"))
    return samples, rejects.unionByName(wrong).unionByName(unreadable_documents(df, doc))
