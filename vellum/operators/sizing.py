"""Joins that broadcast a side only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import written_bytes

#: Bytes of compressed files, and rows, up to which a narrow side may be broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 2_000_000, 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the frame may be broadcast: by the size of its files where it was
    written, else by its rows, of which no more than the limit are counted."""
    size = written_bytes(df)
    if size is not None:
        return size <= BROADCAST_BYTES
    return df.limit(limit + 1).count() <= limit


def lookup(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint where it is small enough; else as it is,
    so that the join shuffles and adaptive execution splits hot keys."""
    return F.broadcast(df) if small(df, limit) else df
