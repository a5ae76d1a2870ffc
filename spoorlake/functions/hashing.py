"""Digests, public references and seeded split buckets, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = "spoorlake"


def stable_id(*parts: Column, length: int = 64) -> Column:
    """Hex SHA-256 of the parts joined by the unit separator, cut to ``length`` digits."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length)


def split_bucket(seed: str, group: Column) -> Column:
    """The first 64 bits of the group's digest modulo 10000: depends on seed and group alone."""
    digest = stable_id(F.lit(f"{DOMAIN}.split/v1"), F.lit(seed), group, length=16)
    return (F.conv(digest, 16, 10).cast("decimal(20,0)") % 10000).cast("long")


def split_of(bucket: Column, ratios: Sequence[tuple[str, int]]) -> Column:
    """The split whose cumulative share in basis points is the first above the bucket."""
    total, out = 0, None
    for name, share in ratios:
        total += share
        out = F.when(bucket < total, name) if out is None else out.when(bucket < total, name)
    if total != 10_000:
        raise ValueError("split ratios must add up to 10000 basis points")
    return out


def basis_points(part: Column, whole: Column) -> Column:
    """round-half-up(part * 10000 / whole); null unless whole is positive."""
    return F.when(whole > 0, F.floor(part * 10000 / whole + F.lit(0.5)).cast("long"))
