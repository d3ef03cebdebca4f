"""Stable, partition-independent pseudo-randomness from ``md5(seed:key)``.

``rand()``/``randomSplit`` depend on partitioning; these do not, and DuckDB
reproduces them bit for bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_int32(seed, *keys) -> Column:
    """First 32 bits of md5(seed:key...) as a non-negative bigint."""
    return F.conv(F.substring(seeded_md5(seed, *keys), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """Uniform in (0, 1): (h + 0.5) / 2^32."""
    return (hash_int32(seed, *keys) + F.lit(0.5)) / F.lit(4294967296.0)


def gaussian(seed, *keys) -> Column:
    """Standard normal by Box-Muller over two independent stable uniforms."""
    u1 = uniform(f"{seed}a", *keys)
    u2 = uniform(f"{seed}b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
