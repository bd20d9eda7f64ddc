"""Joins of rows with what is known of their key, where one key may hold a
large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 10_000
LEAST_HOT = 1_000


def join_counted(rows: DataFrame, known: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``rows`` joined to ``known``, which has one row per key and in ``count``
    the number of ``rows`` with that key.

    Keys of more than 1 / HOT_SHARE of all rows are dealt over several parts, and
    their row of ``known`` is repeated once per part.  There are fewer than
    HOT_SHARE such keys whatever the input's size, so the table of them may be
    broadcast."""
    total = known.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    part = max(total // HOT_SHARE, LEAST_HOT)
    hot = known.where(F.col(count) > part).select(*keys, F.ceil(F.col(count) / part).cast("int").alias("_parts"))
    dealt = (rows.join(F.broadcast(hot), list(keys), "left")
             .withColumn("_part", F.floor(F.rand(5) * F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts"))
    last = F.when(F.col(count) > part, F.ceil(F.col(count) / part).cast("int") - 1).otherwise(F.lit(0))
    spread = known.withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
    return dealt.join(spread, [*keys, "_part"]).drop("_part")
