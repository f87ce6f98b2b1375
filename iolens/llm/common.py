"""Helpers shared by the operators of this subpackage.

Rules all of them keep: an operator selects the columns it needs first (extra
columns, also with clashing names, never reach its internals), null text
counts as empty unless a docstring says otherwise, and intermediate tables go
to the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.session import ensure_checkpoint_dir, scratch_path, ship_package

#: rows and bytes of text in one Arrow batch; both bound a Python worker's memory
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on; safe to call again and again."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and
    what a lost executor has to replay ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` with null read as empty, and further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def map_text(df: DataFrame, schema: str, batch_fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch: ``batch_fn`` returns
    the new columns as lists or arrays in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = batch_fn(b)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
                     for f, c in ((f, cols[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b or b"" for b in col.cast(kind).to_pylist()]
