"""Inputs of the registered queries, derived from the shared tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import grid
from tidegrid.plans.series import Series
from tidegrid.session import durable

STEP = 1800
RAW = Series(("event_type",), "ts", None, ("event_id",))
USERS = Series(("user_id",), "ts", None, ("event_id",))
HALF = Series(("event_type",), "ts", STEP)
PLANT = Series((), "ts", STEP)
SIGNALS = {"tm": "click", "tr": "view", "tc": "purchase", "tout": "signup", "fan": "error"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the second numeric signal ``k``."""
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))


def two_decimals(c):
    """Stored precision of a series; the first rounding removes the noise of the summation order."""
    return F.round(F.round(c, 8), 2)


def half(spark: SparkSession, sf: str) -> DataFrame:
    """Half-hour means of ``value`` and ``k`` per event type on the full grid, with real gaps."""
    d = grid.resample(events(spark, sf), HALF, STEP, {"v": F.avg("value"), "k": F.avg("k")})
    d = d.withColumns({"v": two_decimals(F.col("v")), "k": two_decimals(F.col("k"))})
    return grid.regular_grid(d, HALF, STEP, ["v", "k"])


def staged(d: DataFrame) -> DataFrame:
    """A stage table, for queries that read their input several times."""
    return durable(d)


def plant(spark: SparkSession, sf: str) -> DataFrame:
    """One wide series without keys: half-hour means of each event type as a signal, fan scaled to 0-100."""
    ev = table(spark, sf, "events")
    d = grid.resample(
        ev, PLANT, STEP, {n: two_decimals(F.avg(F.when(F.col("event_type") == t, F.col("value")))) for n, t in SIGNALS.items()}
    )
    return grid.regular_grid(d, PLANT, STEP, list(SIGNALS))


TWO = "CAST(round(CAST(%s AS DECIMAL(18,8)), 2) AS DOUBLE)"
EVENTS_SQL = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"
HALF_SQL = f"""{EVENTS_SQL},
hb AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS ts, {TWO % 'avg(value)'} AS v, {TWO % 'avg(k)'} AS k
       FROM ev GROUP BY 1, 2),
hg AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM hb GROUP BY 1),
half AS (SELECT hg.event_type, hg.ts, hb.v, hb.k FROM hg LEFT JOIN hb ON hg.event_type = hb.event_type AND hg.ts = hb.ts)"""
_SIG = ", ".join(TWO % f"avg(value) FILTER (event_type = '{t}')" + f" AS {n}" for n, t in SIGNALS.items())
PLANT_SQL = f"""pb AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS ts, {_SIG} FROM events GROUP BY 1),
pg AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM pb),
plant AS (SELECT pg.ts, {", ".join(f"pb.{n}" for n in SIGNALS)} FROM pg LEFT JOIN pb ON pg.ts = pb.ts)"""
