"""Streams: row-level verbs work on ``readStream`` tables as they are; these add event time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from verbena.functions.registry import column_function, lit
from verbena.table import Tbl, verb


@verb
def watermark(t: Tbl, /, column: str, delay: str) -> Tbl:
    """Late rows beyond ``delay`` are dropped and their state is freed."""
    return t.with_(t.df.withWatermark(column, delay))


@column_function("elwise")
def time_window(c, x, length, slide=None, start=None):
    """A tumbling or sliding window of event time, for ``group_by(w=time_window(_.ts, "1 hour"))``."""
    args: list[Any] = [length]
    if slide is not None or start is not None:
        args += [slide or length, start] if start is not None else [slide]
    return F.window(lit(x), *args)


@column_function("elwise")
def session_window(c, x, gap):
    """A session of event time that ends after ``gap`` without rows."""
    return F.session_window(lit(x), gap)
