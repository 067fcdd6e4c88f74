"""The first rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

_SALTS = 64


def top_per_group(
    df: DataFrame, group: str, order: Sequence[Column], limit: int, rank: str | None = None
) -> DataFrame:
    """The first ``limit`` rows of each group along ``order``, which must be total inside a group.

    A first pass over hashed parts of each group cuts every part down to ``limit`` rows, so a hot group never meets in one
    task as a whole, whatever the limit.
    """
    name = rank or "__rank"
    # Parts by content, not at random: a task that runs again must produce the same parts.
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    parts = df.withColumn("__part", F.pmod(F.xxhash64(*hashable), F.lit(_SALTS)))
    in_part = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    df = parts.withColumn(name, in_part).where(F.col(name) <= limit).drop(name, "__part")
    in_group = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = df.withColumn(name, in_group).where(F.col(name) <= limit)
    return ranked if rank else ranked.drop(name)
