"""Trace loaders.

All loaders declare their schema (no inference pass) and express time and
device restrictions as filters, so Parquet scans prune partitions and row
groups. Text goes through the built-in CSV parser once: it reads every field of
a line, so the columns used later cannot change which lines are bad.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iolens.plans.order import BKT, global_index

HOUR_US = 3_600_000_000

# Column layouts of the three trace formats.
CANONICAL = T.StructType([
    T.StructField("device_id", T.IntegerType()), T.StructField("opcode", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.IntegerType()),
    T.StructField("timestamp", T.LongType())])
SECTOR = T.StructType([
    T.StructField("Timestamp", T.LongType()), T.StructField("Offset", T.LongType()),
    T.StructField("Size", T.IntegerType()), T.StructField("IOType", T.IntegerType()),
    T.StructField("VolumeID", T.IntegerType())])
OBJECT_FIELDS = (("block_id", "bigint"), ("io_offset", "bigint"), ("io_size", "bigint"), ("time", "double"),
                 ("op_name", "int"), ("user_namespace", "string"), ("user_name", "string"),
                 ("rs_shard_id", "int"), ("op_count", "int"), ("host_name", "string"))
CANONICAL_ORDER = ("timestamp", "device_id", "opcode", "offset", "length")


def to_micros(text: str) -> int:
    """'YYYY-MM-DD HH:MM:SS[.ffffff]' (UTC) -> epoch microseconds (Q1, Q2)."""
    fmt = "%Y-%m-%d %H:%M:%S.%f" if "." in text else "%Y-%m-%d %H:%M:%S"
    dt = datetime.strptime(text.strip(), fmt).replace(tzinfo=timezone.utc)
    return int(dt.timestamp()) * 1_000_000 + dt.microsecond


def _range(df: DataFrame, col: str, start, nhours, unit_per_hour: int = HOUR_US, scale: int = 1) -> DataFrame:
    if start is None:
        return df
    t1 = to_micros(start) // scale if isinstance(start, str) else int(start)
    df = df.filter(F.col(col) >= t1)
    if nhours is not None:
        df = df.filter(F.col(col) <= t1 + int(nhours * unit_per_hour))
    return df


def first_rows(df: DataFrame, nrows: int | None, order=CANONICAL_ORDER) -> DataFrame:
    """First ``nrows`` rows in trace order (the reference's head(n) on a sorted file)."""
    if nrows is None:
        return df
    return global_index(df, order, "__seq").df.filter(F.col("__seq") < nrows).drop("__seq", BKT)


_BAD = "__bad_line"
#: fixed values: comma-separated fields without quotes or comments, a line that doesn't fit kept in ``_BAD``
_CSV = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "columnPruning": "false", "quote": "", "escape": "", "comment": "",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}


def _layout(layout: T.StructType) -> T.StructType:
    return T.StructType([*layout.fields, T.StructField(_BAD, T.StringType())])


def _good(rows: DataFrame, layout: T.StructType) -> DataFrame:
    """Rows of lines with exactly the layout's fields, all numbers of which parse."""
    numbers = [f.name for f in layout if not isinstance(f.dataType, T.StringType)]
    return rows.filter(F.col(_BAD).isNull()).drop(_BAD).na.drop(subset=numbers)


def _read(spark: SparkSession, path, layout: T.StructType) -> DataFrame:
    """The good lines of text files, parsed in the scan."""
    return _good(spark.read.schema(_layout(layout)).options(**_CSV).csv(path), layout)


def _parsed(lines: DataFrame, layout: T.StructType) -> DataFrame:
    """The good lines of a column ``value``, by the same parser."""
    got = F.from_csv("value", F.lit(_layout(layout).simpleString()[len("struct<"):-1].replace(":", " ")), _CSV)
    return _good(lines.select(got.alias("__r")).filter("__r is not null").select("__r.*"), layout)


def load_trace_range(spark: SparkSession, path, start=None, nhours=None, nrows=None) -> DataFrame:
    """Canonical CSV; keep start <= ts <= start + nhours (both inclusive); bad lines skipped;
    then the first ``nrows``."""
    return first_rows(_range(_read(spark, path, CANONICAL), "timestamp", start, nhours), nrows)


def load_trace_tolerant(spark: SparkSession, path, start=None, nhours=None, nrows=None) -> DataFrame:
    """Line reader: only lines with exactly five fields whose numbers parse."""
    return load_trace_range(spark, path, start, nhours, nrows)


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``value`` and ``__line``: the lines of the files in ``path``, counted from 0
    in order of file name and place in the file."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__i"))
    # the ids follow from the files and their splits, so every read of them gives the same
    return global_index(lines, ("__file", "__at", "__i"), "__line").df.select("value", "__line")


def load_trace_stride(spark: SparkSession, path, k: int = 1, nhours=None, nrows=None) -> DataFrame:
    """S3: keep line 0 and every k-th line of a time-sorted file, bad ones
    included, of these the first ``nrows``; then drop lines that don't parse, and
    optionally keep ``nhours`` from the first kept row (inclusive)."""
    lines = numbered_lines(spark, path).filter(F.col("__line") % k == 0)
    if nrows is not None:
        lines = lines.filter(F.col("__line") < nrows * k)
    kept = _parsed(lines, CANONICAL)
    if nhours is None:
        return kept
    first = kept.agg(F.min("timestamp").alias("__t0"))
    return (kept.withColumn("__k", F.lit(0)).join(F.broadcast(first.withColumn("__k", F.lit(0))), "__k")
            .filter(F.col("timestamp") <= F.col("__t0") + F.lit(int(nhours * HOUR_US))).drop("__k", "__t0"))


def normalize_sector(df: DataFrame, keep=()) -> DataFrame:
    """Sector trace -> canonical bytes and microseconds; IOType 0 = R, 1 = W (Q5, Q6)."""
    return df.select(
        *keep, F.col("VolumeID").alias("device_id"),
        F.when(F.col("IOType") == 0, "R").otherwise("W").alias("opcode"),
        (F.col("Offset") * 512).alias("offset"), (F.col("Size") * 512).cast("int").alias("length"),
        (F.col("Timestamp") * 1_000_000).alias("timestamp"))


def load_sector_trace(spark: SparkSession, path, start=None, nhours=None, nrows=None,
                      normalize: bool = True) -> DataFrame:
    """Sector-unit CSV (seconds, 512-byte sectors); the range filter applies only
    when both start and nhours are given; bad lines are skipped."""
    df = _read(spark, path, SECTOR)
    if start is not None and nhours is not None:
        df = _range(df, "Timestamp", start, nhours, unit_per_hour=3600, scale=1_000_000)
    if nrows is not None:
        df = first_rows(df, nrows, ("Timestamp", "VolumeID", "Offset", "Size", "IOType"))
    return normalize_sector(df) if normalize else df


def load_object_trace(spark: SparkSession, path, bad_lines: str = "error") -> DataFrame:
    """Whitespace-separated object trace; text after '#' is a comment. A line has
    all ten fields or the first eight (the rest null), and its numbers parse; any
    other line is an error that names it, or left out with ``bad_lines="skip"``."""
    if bad_lines not in ("error", "skip"):
        raise ValueError("bad_lines is error or skip")
    lines = spark.read.text(path).select(F.split(F.col("value"), "#", 2)[0].alias("v"))
    v = F.regexp_replace("v", r"^\s+|\s+$", "")
    p = lines.select(v.alias("v")).filter(F.col("v") != "").select("v", F.split("v", r"\s+").alias("p"))
    full, short = len(OBJECT_FIELDS), len(OBJECT_FIELDS) - 2
    fields = [(F.get("p", F.lit(i)), n, t) for i, (n, t) in enumerate(OBJECT_FIELDS)]
    wrong = F.lit(False)
    for field, _, t in fields:
        if t != "string":
            # a whole number is digits alone: a cast would cut a fraction off
            fits = field.try_cast(t).isNotNull() & (field.rlike(r"^[+-]?[0-9]+$") if t != "double" else F.lit(True))
            wrong = wrong | (field.isNotNull() & ~fits)

    def refuse(why: str):
        if bad_lines == "skip":
            return F.lit(False)
        return F.raise_error(F.concat(F.lit(f"object trace line {why}: "), F.col("v"))).cast("boolean")

    p = p.filter(F.when(~F.size("p").isin(short, full), refuse("without eight or ten fields"))
                 .when(wrong, refuse("with a bad number")).otherwise(F.lit(True)))
    return p.select(*[field.try_cast(t).alias(n) for field, n, t in fields])


def load_device_slice(spark: SparkSession, path, device_id: int, start_hour: float = 0,
                      duration_hours: float = 2, base: str = "2020-01-01 00:00:00") -> DataFrame:
    """One device, [base + start_hour, + duration_hours] inclusive, from Parquet
    partitioned by device (partition pruning) and sorted by time (row-group pruning)."""
    t0 = to_micros(base) + int(start_hour * HOUR_US)
    t1 = t0 + int(duration_hours * HOUR_US)
    return (spark.read.parquet(path)
            .filter((F.col("device_id") == device_id) & F.col("timestamp").between(t0, t1))
            .select(*CANONICAL.fieldNames()))


def load_device_grid(df: DataFrame, device_ids, n_hours: int = 24, base: str = "2020-01-01 00:00:00",
                     slice_hours: int = 2) -> DataFrame:
    """Devices x consecutive slices over ``n_hours`` in one scan. Slices are closed
    intervals, as in the reference's per-slice loads, so a request exactly on a border
    belongs to both neighbours."""
    t0 = to_micros(base)
    width = slice_hours * HOUR_US
    nslices = n_hours // slice_hours
    rel = F.col("timestamp") - F.lit(t0)
    k = ((rel - F.pmod(rel, F.lit(width))) / F.lit(width)).cast("long")
    on_border = (F.pmod(rel, F.lit(width)) == 0) & (k >= 1)
    d = df.filter(F.col("device_id").isin(list(device_ids)) &
                  F.col("timestamp").between(t0, t0 + nslices * width))
    d = d.withColumn("__s", F.explode(F.when(on_border, F.array(k - 1, k)).otherwise(F.array(k))))
    return (d.filter((F.col("__s") >= 0) & (F.col("__s") < nslices))
            .withColumn("slice_start", F.lit(t0) + F.col("__s") * F.lit(width)).drop("__s"))
