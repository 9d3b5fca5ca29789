"""Stateless hash expressions that stand in for random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def hash52(*parts: Column | str | int) -> Column:
    """A 52-bit integer from SHA-256 of the parts joined by ``:``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from :func:`hash52`."""
    return hash52(*parts) / F.lit(TWO_52)


def hex_rank(*parts: Column | str | int) -> Column:
    """The SHA-256 hex of the parts joined by ``:``, an ordering key."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)


def content_key(col: Column) -> tuple[Column, Column]:
    """A 128-bit key of a text as two BIGINTs (two chained 64-bit hashes)."""
    return F.xxhash64(col), F.xxhash64(F.lit("strand"), F.length(col), col)
