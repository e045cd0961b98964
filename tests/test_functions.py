"""Fixed values of names, labels, times and parsers."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels, names, parsers, timebin
from tidemark.sources.host_logs import journal_condition, priority_number
from tidemark.sources.prometheus import explode_series, parse_prometheus_lines, read_prometheus_text


def each(spark, values, expr, kind="string"):
    """Apply a column function to a list of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expr(F.col("v"))).collect())]


def test_metric_table_name(spark):
    """Runs of ASCII letters and digits are words; each starts upper-case, nothing stands between them, 1024 characters at most."""
    words = ["tide", "Level", "7seas", "k9", "oF"]
    joined = "".join(w[0].upper() + w[1:] for w in words)
    cases = {gap.join(words): joined for gap in ("_", ".", " / ", "é", "__-")} | {f"--{words[0]}_": "Tide", "ab" * 700: ("Ab" + "ab" * 699)[:1024], "…": ""}
    assert each(spark, list(cases), names.metric_table_name) == list(cases.values())


def test_normalize_identifier(spark):
    cases = {"buoy no. 12!": "buoyno12", "ñandú": "and", "0" * 1500: "0" * 1024, " ": ""}
    assert each(spark, list(cases), names.normalize_identifier) == list(cases.values())


def test_normalize_metric_name(spark):
    """Lower-case words joined by one underscore: a capital opens a word, a run of capitals is one, a leading digit gets an underscore."""
    cases = {
        "HarbourDepth": "harbour_depth",
        "DNSLookup": "dns_lookup",
        "WaitP50": "wait_p50",
        "salt%%content ppm": "salt_content_ppm",
        "-buoy--id-": "buoy_id",
        "3Masts": "_3_masts",
        "...": None,
        " ": None,
    }
    assert each(spark, list(cases), names.normalize_metric_name) == list(cases.values())


def test_metric_name_parts(spark):
    rows = [("north", "pier_load", "Peak"), ("", "ferry_wait", "MeanMinutes"), ("south", "", "Total"), ("!", "pier", "Peak")]
    df = spark.createDataFrame(rows, "p string, b string, c string")
    got = [r[0] for r in df.select(names.metric_name(F.col("p"), F.col("b"), F.col("c"))).collect()]
    assert got == ["north_pier_load_peak", "ferry_wait_mean_minutes", "south_total", None]


# Labels and samples whose series id is known.
KNOWN_LABELS = [("__name__", "__redis__"), ("measurement", "used_cpu_user_children"), ("hostname", "host_1"), ("region", "eastus")]
KNOWN_ID = -9070404444212865161


def test_series_id_fixed_value(spark):
    pairs = KNOWN_LABELS
    samples = [(1669112524001, 0.0), (1669112525002, 1.0), (1669112526003, 2.0)]
    df = spark.createDataFrame([(pairs, samples)], "labels array<struct<name:string,value:string>>, samples array<struct<timestamp:long,value:double>>")
    rows = explode_series(df).orderBy("ts").collect()
    assert [r["series_id"] for r in rows] == [KNOWN_ID] * 3
    assert [r["value"] for r in rows] == [0.0, 1.0, 2.0]
    assert rows[0]["ts"] == datetime(2022, 11, 22, 10, 22, 4, 1000)
    assert rows[0]["labels"] == dict(KNOWN_LABELS[1:])


def test_series_id_equals_arrow_form(spark):
    df = spark.createDataFrame([(str(i) * 3,) for i in range(50)] + [("é⌘",)], "s string")
    both = df.select(labels.xxhash64_seed0(F.col("s")).alias("a"), labels._arrow_xxhash64()(F.col("s")).alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())


def test_label_order(spark):
    items = [("b", "1"), ("__name__", "m"), ("A", "2"), ("a_", "3"), ("B", "4"), ("Z", "5")]
    df = spark.createDataFrame([(items,)], "l array<struct<name:string,value:string>>")
    got = [e["name"] for e in df.select(labels.sort_labels(F.col("l"))).first()[0]]
    assert got[0] == "__name__" and got[1:3] == ["A", "a_"] and set(got[3:5]) == {"b", "B"} and got[5] == "Z"


def test_epochs(spark):
    values = [1694564005797489936, 1669112524001, -5, 0]
    got = each(spark, values, lambda c: timebin.nanos_to_rfc3339(timebin.epoch_to_nanos(c)), "long")
    assert got[:2] == ["2023-09-13T00:13:25.797489936Z", "2022-11-22T10:22:04.001000000Z"]
    assert each(spark, values, lambda c: F.unix_micros(timebin.epoch_to_timestamp(c)), "long") == [1694564005797489, 1669112524001000, -1, 0]
    texts = ["2021-07-01T00:00:00.000000000Z", "2021-07-01T02:00:00.123456789+02:00", "2021-07-01", "59.9"]
    assert each(spark, texts, timebin.rfc3339_to_nanos) == [1625097600000000000, 1625097600123456789, None, None]


def test_bin_origins(spark):
    ts = int(datetime(2024, 1, 31, 5, 6, 7, tzinfo=timezone.utc).timestamp()) * 1_000_000
    week = 7 * 86_400
    year_one = each(spark, [ts], lambda c: timebin.bin_micros(c, week, "year-one"), "long")[0]
    assert datetime.fromtimestamp(year_one / 1e6, timezone.utc) == datetime(2024, 1, 29, tzinfo=timezone.utc)
    epoch = each(spark, [ts], lambda c: timebin.bin_micros(c, week), "long")[0]
    assert datetime.fromtimestamp(epoch / 1e6, timezone.utc) == datetime(2024, 1, 25, tzinfo=timezone.utc)
    for origin in ("epoch", "year-one"):
        assert each(spark, [ts], lambda c: timebin.bin_micros(c, 3600, origin), "long")[0] == ts - 6 * 60_000_000 - 7_000_000


GOOD_LINES = {
    'up{job="a",host="h"} 1027 1395066363000': ("up", {"job": "a", "host": "h"}, 1027.0, 1395066363000),
    'esc{p="C:\\\\D\\\\F",e="no\\n\\"f\\""} 1.458e9': ("esc", {"p": "C:\\D\\F", "e": 'no\n"f"'}, 1.458e9, None),
    "plain 12.47": ("plain", {}, 12.47, None),
    '  odd{x="a b"}   +Inf   -3982045 ': ("odd", {"x": "a b"}, float("inf"), -3982045),
    "empty {} 5": ("empty", {}, 5.0, None),
    'trail{a="b",} 5': ("trail", {"a": "b"}, 5.0, None),
    'brace{a="}"} 1e3': ("brace", {"a": "}"}, 1000.0, None),
}
BAD_LINES = [
    "no_value", "m{ } 1027 1395066363000", "m{key", 'm{key="', 'm{key="a', 'm{key="a"  ,', 'm{key="a,', 'm{key="a","}', 'm{key="a",b="c"}     a',
    'm{key="a",b="c"}     1 a', 'm    {key="a",b="c"}     1 a', "m    {}     1 a", "m    {}    ", 'm    {a="b",=} 1027', "m 1d", "m 0x10",
]
SCRAPE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_prometheus_lines(spark, tmp_path):
    skipped = ["# HELP x", "", "   ", " \t# TYPE"]
    df = spark.createDataFrame([(x,) for x in [*GOOD_LINES, *BAD_LINES, *skipped]], "value string")
    samples, rejects = parse_prometheus_lines(df, SCRAPE)
    got = {r["name"]: (r["labels"], r["value"], r["ms"]) for r in samples.withColumn("ms", F.unix_millis("ts")).collect()}
    default = int(SCRAPE.timestamp() * 1000)
    assert got == {n: (lb, v, default if t is None else t) for n, lb, v, t in GOOD_LINES.values()}
    assert sorted(r["line"] for r in rejects.collect()) == sorted(BAD_LINES)
    path = tmp_path / "metrics.txt"
    path.write_text("\n".join([*GOOD_LINES, *BAD_LINES, *skipped]))
    samples, rejects = read_prometheus_text(spark, str(path), SCRAPE)
    assert (samples.count(), rejects.count()) == (len(GOOD_LINES), len(BAD_LINES))


# Raw values of a key=value text and what they are read as.
TYPED = [
    ("salt", "salt"), ("17", 17), ("-4", -4), ("0.125", 0.125), ("True", True), ("False", False), ("1.2.3", "1.2.3"), ("9" * 25, "9" * 25),
    ("a=b=c", "a=b=c"), ('"low tide"', "low tide"), ("'west wind'", "west wind"), ("\"it's\"", "it's"), ("", ""),
]


def test_keyvalue(spark):
    """Every raw value in every place; white space of any width between pairs, the last of equal keys counts."""
    texts, want = [], []
    for shift in range(len(TYPED)):
        pairs = TYPED[shift:] + TYPED[:shift]
        texts.append((" " * (shift % 3 + 1)).join(f"k{i % 11}={raw}" for i, (raw, _) in enumerate(pairs)))
        want.append({f"k{i % 11}": value for i, (_, value) in enumerate(pairs)})
    texts += ["anchor", " anchor  chain=8 ", "=lost", "", 'open="no end']
    want += [{"anchor": ""}, {"anchor": "", "chain": 8}, {"": "lost"}, {}, {"open": '"no end'}]
    got = each(spark, texts, lambda c: F.to_json(parsers.keyvalue_body(c)))
    assert [json.loads(x) for x in got] == want


def test_keyvalue_long_message(spark):
    """Long tokens and many escapes must not exhaust the regex stack."""
    text = 'm="' + 'a\\"b ' * 50_000 + '" n=' + "x" * 200_000
    body = json.loads(each(spark, [text], lambda c: F.to_json(parsers.keyvalue_body(c)))[0])
    assert len(body["n"]) == 200_000 and len(body["m"]) == 250_000


def klog_line(level, time, file, line, rest):
    return f"{level}0229 {time}      42 {file}:{line}] {rest}"


KLOG = {
    klog_line("W", "23:59:59.000001", "tide.go", 7, "\"High water\" harbour=\"OldPier\" depth='nine'"): {
        "timestamp": "23:59:59.000001", "filename": "tide.go", "line_number": "7", "message": "High water", "harbour": "OldPier", "depth": "nine",
    },
    klog_line("E", "00:00:00.123456", "buoy_watch.go", 1204, "lost, looking again"): {
        "timestamp": "00:00:00.123456", "filename": "buoy_watch.go", "line_number": "1204", "message": "lost, looking again",
    },
    "just words": {"message": "just words"},
    "F7 y] tail": {"message": "tail"},
    "": {},
}


def test_klog(spark):
    assert [json.loads(x) for x in each(spark, list(KLOG), lambda c: F.to_json(parsers.klog_body(c)))] == list(KLOG.values())


def test_json_and_space(spark):
    texts = ['{"a":1,"a":2,"b":{"c":[1]}}', ' {"a":1}', "[1]", '{"a":1} x', '{"a":1}}', '{"a":1}]', "{bad", "{}"]
    got = each(spark, texts, lambda c: F.to_json(parsers.json_body(c)))
    assert [json.loads(x) if x else None for x in got] == [{"a": 2, "b": {"c": [1]}}, None, None, None, None, None, None, {}]
    assert json.loads(each(spark, [" a \t b\nc "], lambda c: F.to_json(parsers.space_body(c)))[0]) == {"field0": "a", "field1": "b", "field2": "c"}


def test_parser_chain(spark):
    with pytest.warns(UserWarning, match="unknown message parser"):
        chain = parsers.parse_message(F.col("v"), ["nope", "json", "keyvalue"])
    assert [json.loads(x) for x in each(spark, ['{"a":1}', "k=v"], lambda _: F.to_json(chain))] == [{"a": 1}, {"k": "v"}]
    only_json = each(spark, ["k=v"], lambda c: F.to_json(parsers.parse_message(c, ["json"])))
    assert json.loads(only_json[0]) == {"message": "k=v"}


def test_priorities(spark):
    values = ["emerg", "ERROR", "warn", "Debug", "", None, "nonsense"]
    assert each(spark, values, priority_number) == [0, 3, 4, 7, 6, 6, 6]


def test_journal_matches(spark):
    rows = [({"U": "a", "P": "1"},), ({"U": "b", "P": "2"},), ({"U": "c"},), ({},)]
    df = spark.createDataFrame(rows, "f map<string,string>")

    def kept(*matches):
        return df.filter(journal_condition(F.col("f"), list(matches))).count()

    assert [kept(), kept("U=a"), kept("U=a", "U=b"), kept("U=a", "P=2"), kept("U=a", "+", "U=c"), kept("U=b", "P=2", "+")] == [4, 1, 2, 0, 2, 1]
    with pytest.raises(ValueError):
        journal_condition(F.col("f"), ["novalue"])
