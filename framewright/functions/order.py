"""Random orders and uniforms that depend on a seed and a key only, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int, salt: str, *keys: str | Column) -> Column:
    """Hex text to order by: md5 of seed, salt and keys, separated by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int, salt: str, *keys: str | Column) -> Column:
    """A number in [0, 1) of 32 random bits."""
    return F.conv(F.substring(shuffle_key(seed, salt, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def index_below(n: Column, seed: int, salt: str, *keys: str | Column) -> Column:
    """A whole number in [0, n) of 48 random bits; n is positive."""
    return F.pmod(F.conv(F.substring(shuffle_key(seed, salt, *keys), 1, 12), 16, 10).cast("bigint"), n.cast("bigint"))
