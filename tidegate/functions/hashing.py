"""Portable hashes: SHA-256 over '|'-joined text, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_hex(*parts: str | Column) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


def hex_unit(hexa: Column, start: int | Column = 1) -> Column:
    """Thirteen hex digits, as many as a double holds, as a number in [0, 1)."""
    piece = F.substr(hexa, F.lit(start) if isinstance(start, int) else start, F.lit(13))
    return F.conv(piece, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def unit_hash(*parts: str | Column) -> Column:
    """A number in [0, 1) that depends on the values only, never on partitioning."""
    return hex_unit(hash_hex(*parts))


def hash_int(*parts: str | Column) -> Column:
    """The first 15 hex digits as a bigint."""
    return F.conv(F.substring(hash_hex(*parts), 1, 15), 16, 10).cast("bigint")
