"""Order-free randomness: every draw is a digest of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def digest(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts joined by NUL."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(NUL, *[c.cast("string") for c in columns]), 256)


def fraction64(hexes: Column) -> Column:
    """First 64 bits of a digest as a fraction of 2^64."""
    number = F.conv(F.substring(hexes, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return number / F.lit(18446744073709551616.0)


def fraction52(hexes: Column) -> Column:
    """First 52 bits of a digest as a fraction of 2^52 (exact in a double)."""
    return F.conv(F.substring(hexes, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(4503599627370496.0)


def coin(hexes: Column) -> Column:
    """0 or 1 from the last bit of the first hex digit."""
    return F.conv(F.substring(hexes, 1, 1), 16, 10).cast("int") % 2


def hash_bucket(hexes: Column, digits: int = 2) -> Column:
    """Leading hex digits: buckets of even size that keep the digest's sort order."""
    return F.substring(hexes, 1, digits)
