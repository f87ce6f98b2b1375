"""Trace sinks (S9-S14) and text fixtures.

Splitting writes once, partitioned by device (and day), with rows range-
partitioned on (device, timestamp): a hot device is spread over several
tasks and files, and each file is sorted by time so later time-range reads
skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.plans.order import BKT, global_index
from iolens.sources.readers import CANONICAL, CANONICAL_ORDER, OBJECT_FIELDS, to_micros

DAY_US = 86_400_000_000
#: rows of one output file at most, and input bytes of one writing task
FILE_ROWS = 20_000_000
TASK_BYTES = 512 << 20


def _ranged(df: DataFrame, start, end) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("timestamp") >= (to_micros(start) if isinstance(start, str) else start))
    if end is not None:
        df = df.filter(F.col("timestamp") <= (to_micros(end) if isinstance(end, str) else end))
    return df


def _input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the frame's size, at most the bytes of all tables it reads:
    its estimate of a join is the product of both sides."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), read)


def _layout(df: DataFrame, n: int | None) -> DataFrame:
    """Ranges of (device, time), as many as the input's size asks for."""
    if not n:
        size = _input_bytes(df)
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // TASK_BYTES)))
    return df.repartitionByRange(n, "device_id", "timestamp").sortWithinPartitions("device_id", "timestamp")


def _write(df: DataFrame, path: str, by, partitions: int | None) -> str:
    (_layout(df, partitions).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
     .partitionBy(*by).parquet(path))
    return path


def split_by_device(df: DataFrame, path: str, start=None, end=None, partitions: int | None = None) -> str:
    """One pass: filter the time range, write Parquet partitioned by device."""
    d = _ranged(df.select(*CANONICAL.fieldNames()), start, end)
    return _write(d, path, ["device_id"], partitions)


def split_by_day(df: DataFrame, path: str, start, end=None, partitions: int | None = None) -> str:
    """Partitioned by device and day number since ``start``."""
    t0 = to_micros(start) if isinstance(start, str) else int(start)
    d = _ranged(df.select(*CANONICAL.fieldNames()), t0, end)
    rel = F.col("timestamp") - F.lit(t0)
    d = d.withColumn("day", ((rel - F.pmod(rel, F.lit(DAY_US))) / F.lit(DAY_US)).cast("long"))
    return _write(d, path, ["device_id", "day"], partitions)


def sample_hash(seq_col: str, seed: int):
    """Reproducible key of a row position: the leading 60 bits of the MD5 of
    'seed:position', which SQL engines compute identically."""
    text = F.concat(F.lit(f"{seed}:"), F.col(seq_col).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sample_n_rows(df: DataFrame, nrows=None, rate: float = 0.1, seed: int = 42,
                  order=CANONICAL_ORDER) -> DataFrame:
    """The first ``nrows`` rows, then exactly int(nrows * rate) of them without
    replacement (all when rate >= 1). Positions and the sample rank are two-level
    indexes, so no step gathers the sample in one task."""
    o = global_index(df, order, "__seq")
    first = o.df.drop(BKT)
    if nrows is not None:
        first = first.filter(F.col("__seq") < nrows)
    if rate >= 1:
        return first.drop("__seq")
    n = o.n if nrows is None else min(nrows, o.n)
    k = int(n * rate)
    ranked = global_index(first.withColumn("__h", sample_hash("__seq", seed)), ("__h", "__seq"), "__r",
                          materialize=True).df
    return ranked.filter(F.col("__r") < k).drop("__seq", "__h", "__r", BKT)


def write_csv(df: DataFrame, path: str, header: bool = False) -> str:
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)
    return path


def write_annotated_trace(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Annotated trace (W8) per device; ``path`` is named by the caller
    (device and range label in the reference)."""
    w = _layout(df, None).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("device_id")
    (w.parquet(path) if fmt == "parquet" else w.option("header", "true").csv(path))
    return path


def write_features(df: DataFrame, path: str) -> str:
    """Persist a feature table."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_features(spark, path: str, schema=None) -> DataFrame:
    """Reload a feature table (schema from the Parquet footer or given)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


def write_objects(df: DataFrame, path: str) -> str:
    """Persist a parsed object trace as Parquet (the reference used .npy)."""
    df.select(*[n for n, _ in OBJECT_FIELDS]).write.mode("overwrite").parquet(path)
    return path


def object_text(df: DataFrame, comment_every: int = 50) -> DataFrame:
    """Whitespace text of an object trace, with a '#' comment line per ``comment_every`` rows."""
    line = F.concat_ws(" ", *[F.col(n).cast("string") for n, _ in OBJECT_FIELDS]).alias("value")
    body = df.select(line)
    notes = df.filter(F.col("event_id") % comment_every == 0).select(
        F.concat(F.lit("# comment "), F.col("event_id").cast("string")).alias("value"))
    return body.unionByName(notes)
