"""Keyed random draws.

A draw is a function of its label and keys only, so it does not depend on the
partitioning, on task retries or on the engine that evaluates it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DRAW_RANGE = 2**32


def _text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def draw(*parts) -> Column:
    """Integer in ``[0, 2**32)`` keyed by the given columns or literals."""
    key = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def draw_below(n, *parts) -> Column:
    """Integer in ``[0, n)``."""
    return F.pmod(draw(*parts), (n if isinstance(n, Column) else F.lit(n)).cast("long"))
