"""DuckDB text fragments shared by the oracle queries (brute force, one machine)."""

SEQ_TRACE = """, r AS (SELECT *, row_number() OVER (ORDER BY "timestamp", tie) - 1 AS seq FROM trace)"""

# the trace with null timestamps and opcodes by a rule both engines repeat, and its order
SEQ_NULLS = """, nt AS (SELECT device_id, CASE WHEN tie % 97 = 7 THEN NULL ELSE opcode END AS opcode, "offset", "length",
                  CASE WHEN tie % 97 = 5 THEN NULL ELSE "timestamp" END AS "timestamp", tie FROM trace),
  r AS (SELECT *, row_number() OVER (ORDER BY "timestamp" NULLS FIRST, tie) - 1 AS seq FROM nt)"""


def block_bounds(mode: str, b: int = 4096) -> tuple[str, str]:
    s = f'"offset" // {b}'
    last = {
        "count": f'"offset" // {b} + ("length" + {b - 1}) // {b} - 1',
        "floor": f'("offset" + "length") // {b} - 1',
        "cover": f'("offset" + "length" + {b - 1}) // {b} - 1',
        "first": s,
    }[mode]
    return s, last


def exploded(src: str, mode: str, cols: str) -> str:
    """SELECT cols + block for every block of every request of ``src``."""
    s, l = block_bounds(mode)
    return (f"SELECT {cols}, unnest(generate_series(__s, __l)) AS block "
            f"FROM (SELECT *, {s} AS __s, {l} AS __l FROM {src}) WHERE __s <= __l")


def volume(mode: str = "floor", per: str = "opcode", seq: str = SEQ_TRACE) -> str:
    """CTEs r, c, e, p: accesses with previous same-op access and the byte volume between
    (summed per ``per``: the op, or device and op when keyed by device)."""
    return seq + f"""
, c AS (SELECT *, sum("length") OVER (PARTITION BY {per} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM r),
  e AS ({exploded('c', mode, 'opcode, device_id, seq, "length", cum')}),
  p AS (SELECT *, lag(seq) OVER w AS ps, lag(cum) OVER w AS pc, row_number() OVER w AS acc FROM e
        WINDOW w AS (PARTITION BY opcode, device_id, block ORDER BY seq)),
  v AS (SELECT opcode, device_id, block, seq, acc, ps,
               CAST(floor((cum - "length" - pc - 4096) / 4096) AS BIGINT) AS distance FROM p)"""
