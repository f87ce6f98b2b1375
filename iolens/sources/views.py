"""Canonical trace views derived from the driver's tables.

The reference reads per-request block traces from CSV files; the test tables
here are ``events`` and ``lineitem``. These views map them onto the four
input schemas the reference reads. Each view exists twice: as a Spark
DataFrame (used by the operators) and as DuckDB SQL text (used by the oracle
in ``oracle_sql()``). Both texts follow the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _us(col: str):
    # events.ts / l_shipdate are timestamp_ntz; the session zone is UTC.
    return F.expr(f"unix_micros(cast({col} as timestamp))")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: canonical trace (device_id, opcode, offset, length, timestamp, tie)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 8).cast("int").alias("device_id"),
        F.when(F.col("event_type").isin("click", "view", "error"), F.lit("R"))
        .otherwise(F.lit("W")).alias("opcode"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") * 16384
         + (F.col("event_id") % 4) * 1024).alias("offset"),
        ((F.floor("value") + 1) * 512).cast("int").alias("length"),
        _us("ts").alias("timestamp"),
        F.col("event_id").alias("tie"),
    )


def trace_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: dense trace from lineitem; one ship day becomes one second. No tie column."""
    li = table(spark, sf_dir, "lineitem")
    day = F.floor((_us("l_shipdate") - F.lit(788918400000000)) / F.lit(86400000000)).cast("bigint")
    return li.select(
        (F.col("l_suppkey") % 16).cast("int").alias("device_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("W")).otherwise(F.lit("R")).alias("opcode"),
        (F.col("l_partkey") * 8192).alias("offset"),
        (F.col("l_quantity") * 1024).cast("int").alias("length"),
        (F.lit(1577836800000000) + day * 1000000
         + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000000).alias("timestamp"),
    )


def sector_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: the sector-unit trace (Timestamp s, Offset sectors, Size sectors, IOType, VolumeID)."""
    t = trace(spark, sf_dir)
    return t.select(
        F.floor(F.col("timestamp") / 1000000).cast("bigint").alias("Timestamp"),
        F.floor(F.col("offset") / 512).cast("bigint").alias("Offset"),
        (F.col("length") / 512).cast("int").alias("Size"),
        F.when(F.col("opcode") == "R", 0).otherwise(1).cast("int").alias("IOType"),
        F.col("device_id").alias("VolumeID"),
        F.col("tie"),
    )


def object_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: object trace with the ten fields of the whitespace format, plus event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("block_id"),
        F.lit(0).cast("bigint").alias("io_offset"),
        (F.floor("value").cast("bigint") * 4096).alias("io_size"),
        (_us("ts") / F.lit(1e6)).alias("time"),
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2)
        .when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4)
        .otherwise(100).cast("int").alias("op_name"),
        F.col("event_type").alias("user_namespace"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_name"),
        (F.col("user_id") % 4).cast("int").alias("rs_shard_id"),
        F.lit(1).cast("int").alias("op_count"),
        F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")).alias("host_name"),
        F.col("event_id"),
    )


# Order keys: the reference treats row position in a time-sorted file as its
# clock. V1 has a unique tie; V2 has none, so all five columns are used.
TRACE_ORDER = ("timestamp", "tie")
DENSE_ORDER = ("timestamp", "device_id", "opcode", "offset", "length")
SECTOR_ORDER = ("Timestamp", "tie")
OBJECT_ORDER = ("time", "event_id")


# ---------------------------------------------------------------- DuckDB text
SQL_VIEWS = {
    "trace": """trace AS (
  SELECT CAST(user_id % 8 AS INTEGER) AS device_id,
         CASE WHEN event_type IN ('click','view','error') THEN 'R' ELSE 'W' END AS opcode,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 16384 + (event_id % 4) * 1024 AS "offset",
         CAST((floor(value) + 1) * 512 AS INTEGER) AS "length",
         epoch_us(ts) AS "timestamp",
         event_id AS tie
  FROM events)""",
    "trace_dense": """trace_dense AS (
  SELECT CAST(l_suppkey % 16 AS INTEGER) AS device_id,
         CASE WHEN l_returnflag = 'R' THEN 'W' ELSE 'R' END AS opcode,
         l_partkey * 8192 AS "offset",
         CAST(l_quantity * 1024 AS INTEGER) AS "length",
         1577836800000000
           + CAST(floor((epoch_us(l_shipdate) - 788918400000000) / 86400000000) AS BIGINT) * 1000000
           + (l_orderkey * 7919 + l_linenumber * 104729) % 1000000 AS "timestamp"
  FROM lineitem)""",
    "sector_trace": """sector_trace AS (
  SELECT CAST(floor("timestamp" / 1000000) AS BIGINT) AS "Timestamp",
         CAST(floor("offset" / 512) AS BIGINT) AS "Offset",
         CAST("length" / 512 AS INTEGER) AS "Size",
         CASE opcode WHEN 'R' THEN 0 ELSE 1 END AS "IOType",
         device_id AS "VolumeID",
         tie
  FROM trace)""",
    "object_trace": """object_trace AS (
  SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS block_id,
         CAST(0 AS BIGINT) AS io_offset,
         CAST(floor(value) AS BIGINT) * 4096 AS io_size,
         epoch_us(ts) / 1e6 AS "time",
         CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
              WHEN 'signup' THEN 4 ELSE 100 END AS INTEGER) AS op_name,
         event_type AS user_namespace,
         concat('u', user_id) AS user_name,
         CAST(user_id % 4 AS INTEGER) AS rs_shard_id,
         CAST(1 AS INTEGER) AS op_count,
         concat('h', user_id % 10) AS host_name,
         event_id
  FROM events)""",
}
_DEPS = {"sector_trace": ["trace"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs for the named views (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    return "WITH " + ",\n".join(SQL_VIEWS[n] for n in order) + "\n" + sql
