"""iolens: block-I/O trace analytics as Spark DataFrame operators.

Every operator takes a canonical trace DataFrame (device_id, opcode, offset,
length, timestamp[, tie]) and returns a DataFrame; nothing is pulled to the
driver except bounded metadata (bucket boundaries, per-bucket counts).
"""

from iolens.session import get_session, scratch_path  # noqa: F401

__all__ = ["get_session", "scratch_path"]
