"""Seeded choices. Every random step of the library orders or picks by an md5 of (seed, key), so a result
depends on the rows alone: not on partitions, retries or lost executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """32 hex digits, uniform over the keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_unit(seed: int, *keys: Column | str) -> Column:
    """Number in [0, 1) made of the first eight hex digits of the hash."""
    return F.conv(F.substring(seeded_hash(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
