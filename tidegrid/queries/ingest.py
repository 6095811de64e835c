"""Queries for sources, sinks, parsing and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import roles
from tidegrid.functions.columns import between_dates, clean_number, to_local, to_number
from tidegrid.operators import clean, grid
from tidegrid.queries.inputs import EVENTS_SQL, HALF, HALF_SQL, RAW, STEP, USERS, events, half
from tidegrid.queries.registry import query
from tidegrid.session import durable, stage_path
from tidegrid.sources import csv, sinks

# separator of each synthetic export, and whether it starts with a hint line
DIALECTS = {"click": (";", 0), "view": (",", 0), "purchase": ("|", 0), "signup": (";", 1), "error": (",", 1)}
COLUMNS = ["Id", "Time", "Temp. Mandata", "Mod. V. Mandata", "User"]
#: Events in one export file.
FILE_EVENTS = 50_000


def _by_type(values: dict, other=None):
    col = F
    for t, v in values.items():
        col = col.when(F.col("event_type") == t, F.lit(v))
    return col.otherwise(F.lit(other))


def note(own: str = "event_id"):
    """Texts of a column that needs care: a quote inside, a quoted line break, quoted quotes and separators, a quoted line with a blank line.

    The first lines of a file, which show its dialect, are plain.
    """
    k = F.when(F.pmod(F.col(own), F.lit(FILE_EVENTS)) >= 200, F.pmod(F.col(own), F.lit(11)))
    text = F.when(k == 3, 'pipe 5" long').when(k == 4, "two\nlines").when(k == 5, 'a ""b"", c; d|e').when(k == 6, 'x\n\n"",y\nz').otherwise("plain")
    return F.when(k.between(4, 6), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)


def written(lines):
    """A folder with one text file for each value of ``file``, its lines by ``pos``; the folder is a stage that can be removed."""
    path = stage_path(lines.sparkSession)
    lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "value").write.partitionBy("file").text(path)
    return path


def exports(spark, sf):
    """Events written as export files, each of one event type and in its dialect; their number grows with the events."""
    ev = events(spark, sf).withColumn("sep", _by_type({t: d[0] for t, d in DIALECTS.items()}))
    ev = ev.withColumn("hint", _by_type({t: d[1] for t, d in DIALECTS.items()}))
    ev = ev.withColumn("file", F.concat_ws("-", "event_type", F.floor(F.col("event_id") / FILE_EVENTS)))
    unit = F.concat(F.round("value", 1).cast("string"), F.lit(" °C"))
    fields = F.array(
        F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), unit,
        F.concat(F.col("k").cast("int").cast("string"), F.lit(" %")), F.col("user_id").cast("string"), note(),
    )
    line = ev.withColumn("fields", fields).select("file", (F.col("event_id") + 10).alias("pos"), F.expr("array_join(fields, sep)").alias("value"))
    files = ev.select("file", "sep", "hint").distinct()
    header = F.array(*[F.lit(f" {c} ") for c in (*COLUMNS, "Note")])
    head = files.withColumn("h", header).select("file", F.lit(2).cast("bigint").alias("pos"), F.expr("array_join(h, sep)").alias("value"))
    hint = files.filter("hint = 1").select("file", F.lit(1).cast("bigint").alias("pos"), F.concat(F.lit("﻿sep="), "sep").alias("value"))
    return written(hint.union(head).union(line))


def event_type_of(file: str = "file"):
    return F.regexp_extract(file, "file=([a-z]+)-", 1)


@query("a01_delimiter_detection", """
SELECT DISTINCT event_type AS file,
  CASE event_type WHEN 'click' THEN ';' WHEN 'view' THEN ',' WHEN 'purchase' THEN '|' WHEN 'signup' THEN ';' ELSE ',' END AS sep,
  CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END AS skip FROM events""")
def a01(spark, sf):
    d = csv.sniff(durable(csv.read_lines(spark, exports(spark, sf))))
    return d.select(event_type_of().alias("file"), "sep", "skip").distinct()


@query("a02_csv_load", f"""
WITH {EVENTS_SQL} SELECT event_type AS file, event_id, date_trunc('second', ts) AS ts,
  CAST(round(CAST(value AS DECIMAL(18,2)), 1) AS DOUBLE) AS temp, k AS fan, user_id FROM ev""")
def a02(spark, sf):
    d = csv.read_export(spark, exports(spark, sf), COLUMNS)
    return d.select(
        event_type_of().alias("file"), F.col("Id").cast("bigint").alias("event_id"), F.col("Time").try_cast("timestamp_ntz").alias("ts"),
        clean_number("`Temp. Mandata`").alias("temp"), clean_number("`Mod. V. Mandata`").alias("fan"),
        F.col("User").cast("bigint").alias("user_id"),
    )


@query("a02_quoted_records", """
SELECT event_type AS file, event_id, CASE CASE WHEN event_id % 50000 >= 200 THEN event_id % 11 END WHEN 3 THEN 'pipe 5" long' WHEN 4 THEN 'two' || chr(10) || 'lines' WHEN 5 THEN 'a "b", c; d|e'
  WHEN 6 THEN 'x' || chr(10) || chr(10) || '",y' || chr(10) || 'z' ELSE 'plain' END AS note FROM events""")
def a02_quoted(spark, sf):
    """Records with quotes inside fields, and quoted separators, quotes and line ends."""
    d = csv.read_export(spark, exports(spark, sf), ["Id", "Note"])
    return d.select(event_type_of().alias("file"), F.col("Id").cast("bigint").alias("event_id"), F.col("Note").alias("note"))


@query("a03_decimal_comma", f"""
WITH {EVENTS_SQL} SELECT event_id, value, k FROM ev""")
def a03(spark, sf):
    ev = events(spark, sf).withColumn("file", F.concat(F.lit("x-"), F.floor(F.col("event_id") / FILE_EVENTS)))
    comma = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")), F.lit('"'))
    body = ev.select(
        "file", (F.col("event_id") + 10).alias("pos"),
        F.concat_ws(";", F.col("event_id").cast("string"), comma("value"), comma("k"), F.lit("")).alias("value"),
    )
    head = ev.select("file").distinct().select("file", F.lit(1).cast("bigint").alias("pos"), F.lit("﻿id;value;k;").alias("value"))
    d = csv.read_export(spark, written(head.union(body)), ["id", "value", "k"])
    return d.select(F.col("id").cast("bigint").alias("event_id"), clean_number("value").alias("value"), clean_number("k").alias("k"))


@query("a06_weather_offsets", """
SELECT date_trunc('second', ts) - INTERVAL '1 hour' AS ts, value AS temp FROM events""")
def a06(spark, sf):
    ev = events(spark, sf)
    raw = ev.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")).alias("timestamp"), F.col("value").cast("string").alias("temp"))
    return csv.read_weather(raw, "timestamp", "Europe/Rome", ["temp"])


@query("a07_rounded_copy", f"""
WITH {HALF_SQL} SELECT event_type, ts, CAST(round(CAST(v AS DECIMAL(18,6)), 1) AS DOUBLE) AS v,
  CAST(round(CAST(k AS DECIMAL(18,6)), 1) AS DOUBLE) AS k FROM half""")
def a07(spark, sf):
    path = stage_path(spark)
    sinks.write_full_and_rounded(half(spark, sf), path, 1)
    return spark.read.parquet(f"{path}/rounded")


@query("a08_run_summary", f"""
WITH {HALF_SQL} SELECT event_type, '{{"rows":' || count(*) || ',"missing":' || count(*) FILTER (v IS NULL) || '}}' AS summary
FROM half GROUP BY 1""")
def a08(spark, sf):
    g = half(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.isnull("v")).alias("missing"))
    path = stage_path(spark)
    sinks.write_summary(g, path)
    back = spark.read.schema("event_type string, rows long, missing long").json(path)
    return back.select("event_type", F.to_json(F.struct("rows", "missing")).alias("summary"))


@query("a09_run_registry", f"""
WITH {HALF_SQL} SELECT 'v1' AS version, '{{"step": 1800}}' AS config, event_type, round(avg(v), 8) AS mean_v, count(v) AS n
FROM half GROUP BY event_type""", digits=8)
def a09(spark, sf):
    m = half(spark, sf).groupBy("event_type").agg(F.avg("v").alias("mean_v"), F.count("v").alias("n"))
    path, record = stage_path(spark), sinks.run_record(m, "v1", {"step": STEP})
    # a run that is logged again is there once
    for _ in range(2):
        sinks.log_run(record, path)
    return sinks.read_runs(spark, path).drop("logged_at")


@query("b01_unit_cleaning", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS temp FROM events""")
def b01(spark, sf):
    mark = _by_type({"click": " °C", "view": " Â°C", "purchase": "¬∞C", "signup": " %", "error": " volts"})
    d = events(spark, sf).select("event_id", F.concat(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), mark).alias("temp"))
    return clean.clean_units(d, ["temp"])


@query("b02_modulation_number", f"""
WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k > 90 THEN NULL ELSE k END AS fan FROM ev""")
def b02(spark, sf):
    raw = F.when(F.col("k") > 90, "n/a").otherwise(F.concat(F.lit(" "), F.col("k").cast("string")))
    return events(spark, sf).select("event_id", to_number(raw).alias("fan"))


@query("b03_time_formats", """
SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_type <> 'error'""")
def b03(spark, sf):
    text = (
        F.when(F.col("event_type") == "error", "yesterday")
        .when(F.col("event_type") == "click", F.date_format("ts", "M/d/yyyy h:mm:ss a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    d = events(spark, sf).select("event_id", text.alias("Time"))
    return clean.with_parsed_time(d, "Time").select("event_id", "ts")


@query("b04_dst_spring", """
WITH l AS (SELECT event_id, ts + INTERVAL '81 days' AS local_ts FROM events)
SELECT event_id, CASE WHEN local_ts < TIMESTAMP '2024-03-31 02:00:00' THEN local_ts - INTERVAL '1 hour'
  WHEN local_ts < TIMESTAMP '2024-03-31 03:00:00' THEN TIMESTAMP '2024-03-31 01:00:00'
  ELSE local_ts - INTERVAL '2 hours' END AS instant FROM l""")
def b04_spring(spark, sf):
    d = events(spark, sf).withColumn("ts", F.col("ts") + F.expr("INTERVAL 81 DAYS"))
    return clean.localize(d, RAW, "Europe/Rome").select("event_id", F.col("instant").cast("timestamp_ntz").alias("instant"))


@query("b04_dst_autumn", """
WITH l AS (SELECT event_id, event_type, time_bucket(INTERVAL '30 minutes', ts + INTERVAL '290 days') AS local_ts FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, local_ts ORDER BY event_id) AS rn FROM l)
SELECT event_id, CASE WHEN local_ts < TIMESTAMP '2024-10-27 02:00:00' THEN local_ts - INTERVAL '2 hours'
  WHEN local_ts < TIMESTAMP '2024-10-27 03:00:00' AND rn = 1 THEN local_ts - INTERVAL '2 hours'
  ELSE local_ts - INTERVAL '1 hour' END AS instant FROM r""")
def b04_autumn(spark, sf):
    d = events(spark, sf).withColumn("ts", F.col("ts") + F.expr("INTERVAL 290 DAYS"))
    d = d.withColumn("ts", F.window("ts", "30 minutes")["start"])
    return clean.localize(d, RAW, "Europe/Rome").select("event_id", F.col("instant").cast("timestamp_ntz").alias("instant"))


@query("b05_local_clock", "SELECT event_id, ts + INTERVAL '1 hour' AS local_ts FROM events")
def b05(spark, sf):
    return events(spark, sf).select("event_id", to_local("ts", "Europe/Rome").alias("local_ts"))


@query("b06_range_nulling", "SELECT event_id, CASE WHEN value BETWEEN -10 AND 60 THEN value END AS value FROM events")
def b06(spark, sf):
    return clean.coarse_limits(events(spark, sf).select("event_id", "value"), ["value"])


@query("b07_rename_signals", f"""
WITH {EVENTS_SQL} SELECT event_id, value AS "Temperatura Esterna", k AS "Modulazione Ventilatore Mandata" FROM ev""")
def b07(spark, sf):
    d = events(spark, sf).select("event_id", F.col("value").alias("temp"), F.col("k").alias("Mod. V. Mandata"))
    return clean.rename_signals(d)


@query("b08_signal_variants", f"""
WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k > 50 THEN k ELSE value END AS tm FROM ev""")
def b08(spark, sf):
    d = events(spark, sf).select("event_id", F.when(F.col("k") > 50, F.col("k")).alias("T Mandata"), F.col("value").alias("Temp. Mandata"))
    return clean.pick_signal(d, ["T Mandata", "Temp. Mandata"], "tm").select("event_id", "tm")


@query("b09_first_per_timestamp", """
SELECT event_type, ts, event_id, value FROM (
  SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value,
    row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def b09(spark, sf):
    d = events(spark, sf).select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return clean.first_per_timestamp(d, RAW)


@query("b10_date_range", """
SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""")
def b10(spark, sf):
    return events(spark, sf).filter(between_dates("ts", "2024-01-05", "2024-01-20 12:00:00")).select("event_id", "ts")


@query("b11_season_presets", """
SELECT CASE WHEN o_orderdate < DATE '1996-04-16' THEN 'winter' ELSE 'summer' END AS season, 1996 AS season_year,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate BETWEEN DATE '1995-10-15' AND DATE '1996-10-14' GROUP BY 1""")
def b11(spark, sf):
    from tidegrid.queries.inputs import table

    presets = (("winter", 1996, "1995-10-15", "1996-04-15"), ("summer", 1996, "1996-04-16", "1996-10-14"))
    d = clean.season_filter(table(spark, sf, "orders"), "o_orderdate", presets)
    return d.groupBy("season", "season_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("b12_open_season", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def b12(spark, sf):
    return clean.open_range(events(spark, sf), "ts", "2024-01-15").select("event_id")


@query("b13_native_interval", """
WITH d AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS step_s FROM events),
c AS (SELECT user_id, step_s, count(*) AS c FROM d WHERE step_s IS NOT NULL GROUP BY 1, 2),
m AS (SELECT user_id, arg_max(step_s, struct_pack(c := c, s := -step_s)) AS mode_s, CAST(sum(c) AS BIGINT) AS n_steps FROM c GROUP BY 1),
q AS (SELECT user_id, quantile_cont(step_s, 0.5) AS median_s FROM d GROUP BY 1)
SELECT m.user_id, round(mode_s, 7) AS mode_s, n_steps, round(median_s, 7) AS median_s,
  CASE WHEN median_s/60 <= 2 THEN 1 WHEN median_s/60 <= 7 THEN 5 WHEN median_s/60 <= 12 THEN 10 WHEN median_s/60 <= 20 THEN 15
  WHEN median_s/60 <= 40 THEN 30 ELSE 60 END AS interval_min FROM m JOIN q USING (user_id)""", digits=7)
def b13(spark, sf):
    return clean.native_interval(events(spark, sf).select("user_id", "ts", "event_id"), USERS)


@query("b14_season_detection", f"""
WITH {EVENTS_SQL} SELECT user_id, min(ts) AS first_ts, count(*) FILTER (k > 50) AS n_cool, count(*) FILTER (k <= 50) AS n_heat,
 'winter' AS season FROM ev GROUP BY 1""")
def b14(spark, sf):
    d = events(spark, sf).select(
        "user_id", "ts", F.when(F.col("k") > 50, F.col("k")).alias("cool"), F.when(F.col("k") <= 50, F.col("k")).alias("heat"))
    return clean.detect_season(d, ["user_id"], "ts", "cool", "heat")


@query("b15_modulation_scale", f"""
WITH {EVENTS_SQL}, s AS (SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN k / 100 ELSE k END AS fan FROM ev),
q AS (SELECT event_type, quantile_cont(abs(fan), 0.99) AS q FROM s GROUP BY 1)
SELECT event_type, event_id, round(CASE WHEN q <= 1.5 THEN fan * 100 ELSE fan END, 6) AS fan FROM s JOIN q USING (event_type)""")
def b15(spark, sf):
    fan = F.when(F.col("event_type").isin("click", "view"), F.col("k") / 100).otherwise(F.col("k"))
    return clean.percent_scale(events(spark, sf).select("event_type", "event_id", fan.alias("fan")), ["event_type"], ["fan"])


@query("b16_column_roles", f"""
WITH {HALF_SQL} SELECT event_type, date_trunc('day', ts) AS ts, round(avg(v), 8) AS temperature, round(quantile_cont(k, 0.5), 8) AS fan_speed
FROM half GROUP BY 1, 2 HAVING count(v) > 0""", digits=8)
def b16(spark, sf):
    d = half(spark, sf).withColumnsRenamed({"v": "temperature", "k": "fan_speed"})
    return grid.role_aggregate(d, HALF, "day", ["temperature", "fan_speed"])


@query("b17_clock_filter", f"""
WITH {HALF_SQL} SELECT event_type, ts, v FROM half WHERE hour(ts) BETWEEN 8 AND 18 AND isodow(ts) < 6 AND v IS NOT NULL""")
def b17(spark, sf):
    d = half(spark, sf).withColumn("v_is_interpolated", F.col("v").isNull())
    return clean.clock_filter(d, "ts", (8, 18), True, ["v_is_interpolated"]).select("event_type", "ts", "v")


@query("b19_common_columns", """
SELECT 'open' AS part, o_orderkey AS id, o_orderdate AS ts, o_totalprice AS amount FROM orders
UNION ALL SELECT 'shipped', l_orderkey, l_shipdate, l_extendedprice FROM lineitem""")
def b19(spark, sf):
    from tidegrid.queries.inputs import table

    a = table(spark, sf, "orders").select(F.lit("open").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    b = table(spark, sf, "lineitem").select(F.lit("shipped").alias("part"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("amount"), "l_tax")
    keep = roles.common_columns(a.columns, b.columns)
    return a.select(*keep).unionByName(b.select(*keep))
