"""Log sources, parsers, routing and enrichment over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.parsers import json_body, keyvalue_body, klog_body, space_body
from tidemark.functions.timebin import epoch_to_nanos, epoch_to_timestamp
from tidemark.operators import logs as ops
from tidemark.sources.containers import parse_container_lines, plain_lines
from tidemark.sources.host_logs import filter_journal, route_kernel_records
from tidemark.sources.spans import spans_to_logs
from tidemark.session import scratch_path, spread
from tidemark.sinks.routed import write_routed
from tidemark.workload.adapters import LOG_SQL, label_text, log_rows, node_meta, pod_meta, table
from tidemark.workload.registry import query


def body_pairs(body: Column) -> Column:
    """Sorted ``key=type:value;`` text of a body, so value types are compared too."""
    pairs = F.transform(
        F.map_entries(body),
        lambda e: F.concat(e["key"], F.lit("="), F.lower(F.schema_of_variant(e["value"])), F.lit(":"), e["value"].cast("string"), F.lit(";")),
    )
    return F.array_join(F.sort_array(pairs), "")


def stream_lines(spark, d) -> DataFrame:
    """Events as the lines of one log file per user: every fourth event is a partial line."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("/var/log/"), (F.col("user_id")).cast("string"), F.lit(".log")).alias("file"),
        F.col("event_id").alias("offset"),
        F.when(F.col("user_id") % 2 == 0, F.lit("stdout")).otherwise("stderr").alias("stream"),
        (F.col("event_id") % 4 == 0).alias("is_partial"),
        F.concat("event_type", F.lit("#"), F.col("event_id").cast("string")).alias("message"),
        (F.unix_micros("ts") * 1000).alias("time_ns"),
        "user_id",
    )


def container_lines(spark, d) -> DataFrame:
    """Files of even users in docker form, the others in CRI form; some lines are broken."""
    lines = stream_lines(spark, d)
    stamp = F.concat(
        F.date_format(F.timestamp_micros(F.call_function("div", F.col("time_ns"), F.lit(1000).cast("bigint"))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit("123Z"),
    )
    docker = F.to_json(
        F.struct(
            F.concat("message", F.when(F.col("is_partial"), F.lit("")).otherwise("\n")).alias("log"),
            F.col("stream"), stamp.alias("time"),
        )
    )
    cri = F.concat_ws(" ", stamp, "stream", F.when(F.col("is_partial"), F.lit("P")).otherwise("F"), "message")
    broken = F.when(F.col("user_id") % 2 == 0, F.lit("{not json")).otherwise("no-time here and more")
    line = F.when(F.col("offset") % 50 == 49, broken).when(F.col("user_id") % 2 == 0, docker).otherwise(cri)
    return lines.select("file", "offset", line.alias("line"))


@query(
    "S6_container_lines",
    """SELECT '/var/log/' || CAST(user_id AS VARCHAR) || '.log' AS file, event_id AS "offset", epoch_us(ts) * 1000 + 123 AS time_ns,
      CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, event_id % 4 = 0 AS is_partial,
      event_type || '#' || CAST(event_id AS VARCHAR) AS message
    FROM events WHERE event_id % 50 <> 49""",
)
def s6(spark, d):
    return parse_container_lines(container_lines(spark, d))[0].select("file", "offset", "time_ns", "stream", "is_partial", "message")


@query("S6_container_rejects", """SELECT event_id AS "offset", user_id % 2 = 0 AS docker FROM events WHERE event_id % 50 = 49""")
def s6_rejects(spark, d):
    rejects = parse_container_lines(container_lines(spark, d))[1]
    return rejects.select("offset", (F.col("line") == "{not json").alias("docker"))


@query("S6_plain_lines", """SELECT event_id AS "offset", CAST(5 AS BIGINT) AS time_ns, props AS message FROM events""")
def s6_plain(spark, d):
    lines = table(spark, d, "events").select(F.col("event_id").alias("offset"), F.col("props").alias("line"))
    return plain_lines(lines, 5).select("offset", "time_ns", "message")


@query(
    "S7_route_kernel_records",
    """WITH t AS (SELECT n_nationkey, 'db' || CAST(n_regionkey AS VARCHAR) AS database, n_name AS table_name, n_nationkey % 4 AS p,
        CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE n_nationkey * 50 END AS processed FROM nation)
    SELECT event_id AS seq, database, table_name, user_id % 8 AS priority FROM events, t
    WHERE user_id % 8 <= CASE p WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 1 END AND (processed = 0 OR event_id > processed)""",
)
def s7(spark, d):
    records = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 8).cast("int").alias("priority"), F.col("event_type").alias("message")
    )
    names = F.array(F.lit("Error"), F.lit("warn"), F.lit(""), F.lit("alert"))
    # One destination per nation, so the fan-out per record does not grow with the data.
    targets = table(spark, d, "nation").select(
        F.concat(F.lit("db"), F.col("n_regionkey").cast("string")).alias("database"), F.col("n_name").alias("table"),
        F.get(names, (F.col("n_nationkey") % 4).cast("int")).alias("priority"),
        F.when(F.col("n_nationkey") % 3 == 0, 0).otherwise(F.col("n_nationkey") * 50).alias("processed"),
    )
    out = route_kernel_records(records, targets)
    return out.select("seq", "database", F.col("table").alias("table_name"), F.col("priority").cast("bigint").alias("priority"))


@query(
    "S8_filter_journal",
    """SELECT event_id, 'PRIORITY=' || CAST(user_id % 8 AS VARCHAR) || ';_SYSTEMD_UNIT=' || event_type || ';' AS resource FROM events
    WHERE (event_type IN ('click', 'view') AND user_id % 8 = 3) OR event_type = 'error'""",
)
def s8(spark, d):
    rows = table(spark, d, "events").select(
        "event_id",
        F.create_map(
            F.lit("_SYSTEMD_UNIT"), F.col("event_type"), F.lit("PRIORITY"), (F.col("user_id") % 8).cast("string"), F.lit("MESSAGE"), F.col("props")
        ).alias("fields"),
    )
    matches = ["_SYSTEMD_UNIT=click", "PRIORITY=3", "_SYSTEMD_UNIT=view", "+", "_SYSTEMD_UNIT=error"]
    out = filter_journal(rows, matches, ["PRIORITY", "_SYSTEMD_UNIT", "ABSENT"])
    return out.select("event_id", label_text(F.col("resource")).alias("resource"))


def spans(spark, d) -> DataFrame:
    """Line items as child spans of their order, which is the root span and the trace."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"))
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag"))
    no_events = F.array().cast("array<struct<name:string,time_ns:bigint,attributes:map<string,string>>>")
    resource = F.create_map(F.lit("service.name"), F.col("service"))
    root = o.select(
        F.lower(F.hex("o_orderkey")).alias("trace_id"), F.lower(F.hex("o_orderkey")).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("order").alias("name"), F.lit("SERVER").alias("kind"), (F.unix_micros("o_orderdate") * 1000).alias("start_ns"),
        (F.unix_micros("o_orderdate") * 1000 + 5_000_000_000 + F.col("o_orderkey")).alias("end_ns"), F.col("o_orderpriority").alias("service"),
    )
    child = li.select(
        F.lower(F.hex("l_orderkey")).alias("trace_id"),
        F.lower(F.hex(F.col("l_orderkey") * 16 + F.col("l_linenumber"))).alias("span_id"), F.lower(F.hex("l_orderkey")).alias("parent_span_id"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"), F.lit("INTERNAL").alias("kind"),
        (F.unix_micros("l_shipdate") * 1000).alias("start_ns"),
        (F.unix_micros("l_shipdate") * 1000 + F.col("l_quantity").cast("bigint") * 1_000_000).alias("end_ns"), F.col("l_returnflag").alias("service"),
    )
    return root.unionByName(child).withColumns(
        {
            "attributes": F.create_map(F.lit("kind"), F.col("kind")), "resource": resource, "status_code": F.lit("OK"),
            "status_description": F.lit(None).cast("string"), "events": no_events,
        }
    )


SPAN_SQL = """span AS (
  SELECT printf('%032x', o_orderkey) AS trace_id, printf('%016x', o_orderkey) AS span_id, '0000000000000000' AS parent, '00000000000000000000000000000000' AS ptrace, '00' AS pflags,
    'order' AS name, 'SERVER' AS kind, epoch_us(o_orderdate) AS start_us, epoch_us(o_orderdate) + 5000000 + o_orderkey // 1000 AS end_us, o_orderkey % 1000 AS end_rest, o_orderpriority AS service FROM orders
  UNION ALL
  SELECT printf('%032x', l_orderkey), printf('%016x', l_orderkey * 16 + l_linenumber), printf('%016x', l_orderkey), printf('%032x', l_orderkey), '01',
    'line ' || CAST(l_linenumber AS VARCHAR), 'INTERNAL', epoch_us(l_shipdate), epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 1000, 0, l_returnflag FROM lineitem)"""


@query(
    "S10_spans_to_logs",
    f"""WITH {SPAN_SQL} SELECT end_us * 1000 + end_rest AS time_ns, trace_id, span_id, '{{"service.name":"' || service || '"}}' AS resource,
      '{{"dest.database":"Logs","dest.table":"Traces","span.id":"' || span_id || '","span.kind":"' || kind || '","span.name":"' || name || '","trace.id":"' || trace_id || '"}}' AS attributes,
      '{{"Attributes":{{"kind":"' || kind || '"}},"EndTime":"' || strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((end_us % 1000000) * 1000 + end_rest AS VARCHAR), 9, '0')
      || 'Z","Name":"' || name || '","Parent":{{"SpanID":"' || parent || '","TraceFlags":"' || pflags || '","TraceID":"' || ptrace || '"}},"Resource":{{"service.name":"' || service
      || '"}},"SpanContext":{{"SpanID":"' || span_id || '","TraceFlags":"01","TraceID":"' || trace_id || '"}},"SpanKind":"' || kind || '","StartTime":"'
      || strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((start_us % 1000000) * 1000 AS VARCHAR), 9, '0') || 'Z","Status":{{"Code":"OK","Description":""}}}}' AS body
    FROM span""",
)
def s10(spark, d):
    out = spans_to_logs(spans(spark, d))
    return out.select(
        "time_ns", F.col("TraceId").alias("trace_id"), F.col("SpanId").alias("span_id"), F.col("Resource").alias("resource"),
        F.col("Attributes").alias("attributes"), F.col("Body").alias("body"),
    )


@query(
    "L2_encode_native_logs",
    f"""WITH {LOG_SQL} SELECT epoch_us(ts) AS ts_us, epoch_us(ts) AS observed_us,
      '{{"k":' || CAST(k AS VARCHAR) || ',"lvl":"' || lvl || '","source":"' || event_type || '","msg":"' || msg || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}}' AS body,
      '{{"cpu":' || CAST(user_id % 4 AS VARCHAR) || '}}' AS resource, host, '' AS region,
      '{{"dest.database":"' || CASE WHEN event_type = 'view' THEN '' ELSE 'Logs' END || '","dest.table":"' || dest_table || '","tag":"' || CASE WHEN event_type = 'click' THEN '' ELSE event_type END || '"}}' AS attributes
    FROM log""",
)
def l2(spark, d):
    out = ops.encode_native_logs(log_rows(spark, d), ["host", "region"], now_ns=0)
    return out.select(
        F.unix_micros("Timestamp").alias("ts_us"), F.unix_micros("ObservedTimestamp").alias("observed_us"), F.col("Body").alias("body"),
        F.col("Resource").alias("resource"), "host", "region", F.col("Attributes").alias("attributes"),
    )


@query(
    "L3_epoch_to_timestamp",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) END AS ts_us,
      CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 * 1000000 ELSE epoch_us(ts) * 1000 + 7 END AS ts_ns FROM events""",
)
def l3(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_millis("ts")).otherwise(F.unix_micros("ts") * 1000 + 7)
    e = table(spark, d, "events").select("event_id", raw.alias("x"))
    return e.select("event_id", F.unix_micros(epoch_to_timestamp(F.col("x"))).alias("ts_us"), epoch_to_nanos(F.col("x")).alias("ts_ns"))


@query(
    "L4_observed_default",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1706745600000000 ELSE epoch_us(ts) END AS observed_us FROM events",
)
def l4(spark, d):
    rows = log_rows(spark, d).withColumn(
        "observed_ns", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("observed_ns"))
    ).withColumn("resource", F.map_concat("resource", F.create_map(F.lit("id"), F.col("event_id").cast("string").cast("variant"))))
    out = ops.encode_native_logs(rows, ["id"], now_ns=1_706_745_600_000_000_000)
    return out.select(F.col("id").cast("bigint").alias("event_id"), F.unix_micros("ObservedTimestamp").alias("observed_us"))


@query(
    "L5_resolve_destination",
    f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN event_type = 'view' THEN 'BodyDb' ELSE 'Logs' END AS database, dest_table AS table_name
    FROM log WHERE event_type <> 'view' OR event_id % 2 = 0""",
)
def l5(spark, d):
    rows = log_rows(spark, d).withColumn(
        "body",
        F.when(F.col("event_id") % 2 == 0, F.map_concat("body", F.create_map(F.lit("dest.database"), F.lit("BodyDb").cast("variant")))).otherwise(F.col("body")),
    )
    return ops.resolve_destination(rows)[0].select("event_id", "database", F.col("table").alias("table_name"))


@query("L5_resolve_destination_rejects", "SELECT event_id FROM events WHERE event_type = 'view'")
def l5_rejects(spark, d):
    return ops.resolve_destination(log_rows(spark, d))[1].select("event_id")


@query(
    "L6_parse_messages",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k=bigint:' || json_extract_string(props, '$.k') || ';' WHEN 1 THEN 'message=string:' || substr(props, 2) || ';'
      ELSE 'message=string:' || props || '};' END AS body FROM events""",
)
def l6(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.expr("substring(props, 2)")).otherwise(F.concat("props", F.lit("}")))
    e = table(spark, d, "events").select("event_id", text.alias("message"))
    return ops.parse_messages(e, ["json"]).select("event_id", body_pairs(F.col("body")).alias("body"))


@query(
    "L7_json_body",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'k=bigint:' || json_extract_string(props, '$.k') || ';t=string:' || event_type || ';' END AS body FROM events""",
)
def l7(spark, d):
    doc = F.concat(F.regexp_replace("props", "}$", ""), F.lit(',"t":"'), "event_type", F.lit('"}'))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), doc)).otherwise(doc)
    return table(spark, d, "events").select("event_id", body_pairs(json_body(text)).alias("body"))


@query(
    "L8_keyvalue_body",
    """SELECT event_id, 'bare=string:;cost=' || CASE WHEN value = floor(value) THEN 'double:' || CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE 'double:' || CAST(value AS VARCHAR) END
      || ';msg=string:event of ' || event_type || ';ok=boolean:' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ';type=string:' || event_type || ';user=bigint:' || CAST(user_id AS VARCHAR) || ';' AS body FROM events""",
)
def l8(spark, d):
    text = F.concat(
        F.lit(" user="), F.col("user_id").cast("string"), F.lit("  type='"), "event_type", F.lit("' bare msg=\"event of "), "event_type",
        F.lit('" ok='), F.when(F.col("event_id") % 2 == 0, F.lit("TRUE")).otherwise("False"), F.lit(" cost="), F.col("value").cast("string"),
    )
    # Values below 1e7 print without an exponent; the variant keeps a double either way.
    return table(spark, d, "events").select("event_id", F.regexp_replace(body_pairs(keyvalue_body(text)), r"(\d)\.0;", "$1;").alias("body"))


@query(
    "L9_klog_body",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'message=string:no header ' || event_type || ';'
      WHEN event_id % 7 = 1 THEN 'filename=string:kubelet.go;line_number=string:12;message=string:plain ' || event_type || ';timestamp=string:13:14:15.123456;'
      ELSE 'filename=string:kubelet.go;line_number=string:12;message=string:Pod ' || event_type || ';pod=string:kube/' || CAST(user_id AS VARCHAR) || ';timestamp=string:13:14:15.123456;' END AS body FROM events""",
)
def l9(spark, d):
    head = F.lit("I0205 13:14:15.123456 1 kubelet.go:12] ")
    text = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no header "), "event_type"))
        .when(F.col("event_id") % 7 == 1, F.concat(head, F.lit("plain "), "event_type"))
        .otherwise(F.concat(head, F.lit('"Pod '), "event_type", F.lit('" pod="kube/'), F.col("user_id").cast("string"), F.lit('"')))
    )
    return table(spark, d, "events").select("event_id", body_pairs(klog_body(text)).alias("body"))


@query(
    "L10_space_body",
    """SELECT doc_id, array_to_string(list_sort(list_transform(w, lambda x, i: 'field' || CAST(i - 1 AS VARCHAR) || '=' || x || ';')), '') AS body
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x{0B}]+'), lambda x: x <> '') AS w FROM documents)""",
)
def l10(spark, d):
    return table(spark, d, "documents").select("doc_id", label_text(space_body(F.col("text"))).alias("body"))


@query(
    "L11_reassemble_lines",
    """WITH s AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS time_ns, event_id % 4 = 0 AS partial, event_type || '#' || CAST(event_id AS VARCHAR) AS m,
        coalesce(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events)
    SELECT '/var/log/' || CAST(user_id AS VARCHAR) || '.log' AS file, CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream,
      max(event_id) AS "offset", max(time_ns) AS time_ns, string_agg(m, '' ORDER BY event_id) AS message, count(*) AS parts
    FROM s GROUP BY user_id, g HAVING bool_or(NOT partial)""",
)
def l11(spark, d):
    out = ops.reassemble_lines(stream_lines(spark, d).drop("user_id"), ["file", "stream"], slice_width=1000)
    return out.select("file", "stream", "offset", "time_ns", "message", "parts")


@query(
    "L12_route_logs",
    f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_type = 'error' THEN 'Errors' WHEN lvl = 'WARN' THEN 'Warn' WHEN k = 5 THEN 'Fives' ELSE 'Old' END AS database,
      CASE WHEN user_id % 2 = 0 AND event_type = 'error' THEN 'App' WHEN lvl = 'WARN' THEN 'W' WHEN k = 5 THEN 'F' ELSE 'Tab' END AS table_name FROM log""",
)
def l12(spark, d):
    annotations = F.create_map(
        F.lit("route/log-sources"), F.when(F.col("user_id") % 2 == 0, F.lit("bad:entry, error : Errors:App ,error:Second:X")).otherwise("").cast("variant"),
        F.lit("route/log-keys"), F.lit("lvl:WARN:Warn:W, k:5:Fives:F,a:b:c").cast("variant"),
    )
    rows = log_rows(spark, d).withColumns(
        {"resource": F.map_concat("resource", annotations), "database": F.lit("Old"), "table": F.lit("Tab")}
    )
    return ops.route_logs(rows).select("event_id", "database", F.col("table").alias("table_name"))


@query(
    "L13_add_resources",
    """SELECT event_id, 'cpu=fixed;host=host_' || CAST(user_id % 5 AS VARCHAR) || ';label.app=web;rack=' || coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'rack' || CAST(n_regionkey AS VARCHAR) ELSE '' END, '')
      || ';sys_cursor=c;zone=' || coalesce(r_name, '') || ';' AS resource
    FROM events LEFT JOIN nation ON n_nationkey = user_id LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def l13(spark, d):
    rows = log_rows(spark, d).withColumn("node", F.col("user_id"))
    out = ops.add_resources(rows, {"cpu": "fixed"}, node_meta(spark, d), {"zone": "zone"}, {"rack": "rack"})
    return out.select("event_id", label_text(F.col("resource")).alias("resource"))


@query(
    "L14_enrich_pods",
    """SELECT event_id, CASE WHEN c_custkey % 3 <> 0 THEN 'Logs' WHEN lower(c_mktsegment) = 'building' THEN 'Static' ELSE 'Tier' END AS database,
      CASE WHEN c_custkey % 3 <> 0 THEN 'Pods' WHEN lower(c_mktsegment) = 'building' THEN 'B' ELSE 'One' END AS table_name,
      'annotation.owner=' || c_name || ';container=main;containerID=docker://' || CAST(c_custkey AS VARCHAR) || ';label.tier=' || CAST(c_nationkey % 2 AS VARCHAR)
      || ';namespace=' || lower(c_mktsegment) || ';pod=pod-' || CAST(c_custkey AS VARCHAR) || ';route/log-sources=error:Errors:App;' AS resource
    FROM events JOIN customer ON c_custkey = user_id
    WHERE c_custkey % 10 <> 9 AND (c_custkey % 3 <> 0 OR lower(c_mktsegment) = 'building' OR c_nationkey % 2 = 1)""",
)
def l14(spark, d):
    lines = stream_lines(spark, d).select("file", F.col("offset").alias("event_id"))
    static = table(spark, d, "region").select(  # the other regions' targets fit no pod
        F.col("r_regionkey").alias("id"),
        F.when(F.col("r_regionkey") == 0, F.lit("building")).when(F.col("r_regionkey") == 1, "").otherwise(F.lower("r_name")).alias("namespace"), F.lit("").alias("name"),
        F.when(F.col("r_regionkey") == 1, F.create_map(F.lit("tier"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")).alias("labels"),
        F.when(F.col("r_regionkey") == 0, F.lit("Static")).otherwise("Tier").alias("database"),
        F.when(F.col("r_regionkey") == 0, F.lit("B")).otherwise("One").alias("table"),
    )
    out = ops.enrich_pods(lines, pod_meta(spark, d), static)
    return out.select("event_id", "database", F.col("table").alias("table_name"), label_text(F.col("resource")).alias("resource"))


def _shout(batches):
    for pdf in batches:
        yield pdf.assign(message=pdf["message"].str.upper())


@query(
    "L15_apply_transforms",
    "SELECT event_id, upper(event_type || ' ' || props) AS message FROM events WHERE value > 10",
)
def l15(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", F.concat_ws(" ", "event_type", "props").alias("message"))
    steps = [
        lambda df: df.filter(F.col("value") > 10).select("event_id", "message"),
        lambda df: df.mapInPandas(_shout, df.schema),
    ]
    return ops.apply_transforms(rows, steps)


@query(
    "logs_ingest_path",
    """WITH s AS (SELECT user_id, event_id, event_id % 4 = 0 AS partial, event_type || '#' || CAST(event_id AS VARCHAR) AS m,
        coalesce(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events),
      whole AS (SELECT user_id, string_agg(m, '' ORDER BY event_id) AS message FROM s GROUP BY user_id, g HAVING bool_or(NOT partial))
    SELECT 'Logs' AS database, 'Pods' AS table_name, 'pod-' || CAST(c_custkey AS VARCHAR) AS pod, count(*) AS n, CAST(sum(strlen(message)) AS BIGINT) AS chars
    FROM whole JOIN customer ON c_custkey = user_id WHERE c_custkey % 10 <> 9 AND c_custkey % 3 <> 0 GROUP BY 3""",
)
def logs_ingest_path(spark, d):
    """Lines to whole messages, with their pod's values, parsed, routed, encoded, written to their tables and read back."""
    lines = stream_lines(spark, d).select("file", "offset", "is_partial", "message", "time_ns")
    owned = ops.enrich_pods(ops.reassemble_lines(lines, ["file"]).drop("parts"), pod_meta(spark, d))
    none = F.create_map().cast("map<string,variant>")
    shaped = ops.parse_messages(owned, ["json"]).withColumns({"attributes": none, "observed_ns": F.col("time_ns")})
    root = scratch_path(spark, "logs")
    write_routed(ops.encode_native_logs(ops.route_logs(shaped)), root)
    stored = spark.read.parquet(root)
    pod = F.get_json_object("Resource", "$.pod").alias("pod")
    text = F.get_json_object("Body", "$.message")
    return stored.groupBy("database", F.col("table").alias("table_name"), pod).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("chars"))
