"""Block and request columns.

A block is a fixed-size unit of a device's address space, identified by
(device_id, offset // B). Requests expand to the blocks they touch under one
of four coverage conventions the reference uses in different places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Block size in bytes, sector size in bytes.
BLOCK_SIZE = 4096
SECTOR_SIZE = 512
MODES = ("count", "floor", "cover", "first")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(c, b: int) -> Column:
    """Exact floor division of an integral column by a positive constant."""
    c = _c(c).cast("long")
    if b & (b - 1) == 0:
        return F.shiftright(c, b.bit_length() - 1)
    return ((c - F.pmod(c, F.lit(b))) / F.lit(b)).cast("long")


def col_floordiv(a, b) -> Column:
    """Exact floor division of two integral columns (b > 0)."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return ((a - F.pmod(a, b)) / b).cast("long")


def block_of_offset(offset="offset", block_size: int = BLOCK_SIZE) -> Column:
    """First block of a request."""
    return idiv(offset, block_size)


def end_block(offset="offset", length="length", block_size: int = BLOCK_SIZE) -> Column:
    """(offset + length) // B."""
    return idiv(_c(offset) + _c(length).cast("long"), block_size)


def block_range(mode: str, offset="offset", length="length", block_size: int = BLOCK_SIZE):
    """(first, last) block ids of a request, inclusive, for a coverage mode.

    count: start .. start + ceil(length/B) - 1   (misses the tail of unaligned requests)
    floor: start .. floor((offset+length)/B) - 1 (drops partial blocks)
    cover: start .. ceil((offset+length)/B) - 1  (every touched block)
    first: start only
    """
    o, ln, b = _c(offset), _c(length).cast("long"), block_size
    start = idiv(o, b)
    if mode == "count":
        last = start + idiv(ln + (b - 1), b) - 1
    elif mode == "floor":
        last = idiv(o + ln, b) - 1
    elif mode == "cover":
        last = idiv(o + ln + (b - 1), b) - 1
    elif mode == "first":
        last = start
    else:
        raise ValueError(f"unknown block mode {mode!r}; use one of {MODES}")
    return start, last


def explode_blocks(df: DataFrame, mode: str = "cover", out: str = "block",
                   offset="offset", length="length", block_size: int = BLOCK_SIZE) -> DataFrame:
    """P5: one row per (request, block). Empty ranges give no rows."""
    start, last = block_range(mode, offset, length, block_size)
    if mode == "first":
        return df.withColumn(out, start)
    return df.withColumn(out, F.explode(F.when(start <= last, F.sequence(start, last))))


def op_indicator(opcode="opcode") -> Column:
    """R -> 1, W -> 0, anything else -> null."""
    c = _c(opcode)
    return F.when(c == "R", 1).when(c == "W", 0).cast("int")


# Object-trace operation codes and their classes.
GET_OPS = (2, 1, 5)
PUT_OPS = (4, 3, 6)


def op_class(op_name="op_name") -> Column:
    """Object op code -> 'GET' | 'PUT' | 'UNKNOWN'."""
    c = _c(op_name)
    return (F.when(c.isin(*GET_OPS), "GET").when(c.isin(*PUT_OPS), "PUT")
            .otherwise("UNKNOWN"))


def op_filter(df: DataFrame, op: str, opcode: str = "opcode") -> DataFrame:
    """Keep one operation."""
    return df.filter(F.col(opcode) == op)


def bytes_to_kb(c) -> Column:
    return _c(c) / F.lit(1024.0)


def bytes_to_mb(c) -> Column:
    return _c(c) / F.lit(1024.0 * 1024.0)


def sectors_to_kb(c) -> Column:
    return _c(c) / F.lit(2.0)
