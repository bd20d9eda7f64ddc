"""Deterministic pseudo-randomness from md5, identical in Spark and DuckDB.

Spark: conv(substr(md5(concat_ws(':', seed, k1, ...)), 1, 8), 16, 10)
DuckDB: cast('0x' || substr(md5(concat_ws(':', seed, k1, ...)), 1, 8) as bigint)
Both give the first 32 bits of the md5 digest as an unsigned integer, so
sampling, random labels, random vectors and initial centres never depend on
partitioning or on rand().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                                  for k in keys]
    return F.concat_ws(":", *parts)


def det_uint32(seed, *keys) -> Column:
    """First 32 bits of md5('seed:k1:k2...') as bigint in [0, 2**32)."""
    return F.conv(F.substring(F.md5(_key(seed, *keys)), 1, 8), 16, 10).cast("bigint")


def det_unit(seed, *keys) -> Column:
    """Deterministic uniform double in [0, 1)."""
    return det_uint32(seed, *keys) / F.lit(4294967296.0)
