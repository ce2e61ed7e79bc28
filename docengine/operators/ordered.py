"""Running values over an explicit integer position.

A plain window puts a whole group into one task. Here each group is cut into
ranges of ``SPAN`` positions; positions are unique within a group, so no range
holds more rows than that. Null keys are a group of their own. The window runs inside a range, and one summary row
per range carries the running value across ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = 65_536


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which null equals null; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _ranges(df: DataFrame, pos: str) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(pos) / SPAN))


def running_row_number(df: DataFrame, keys: list[str], pos: str, out: str, counted: Column | None = None) -> DataFrame:
    """0-based number of each row in its group by ``pos``.

    With ``counted``, the number of earlier rows for which it holds.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    parts = _ranges(df, pos).withColumn("_one", one)
    totals = parts.groupBy(*keys, "_range").agg(F.sum("_one").alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.withColumn("_before", F.coalesce(F.sum("_one").over(within), F.lit(0)))
    joined = null_safe_join(numbered, offsets, [*keys, "_range"])
    return joined.withColumn(out, F.col("_before") + F.col("_offset")).drop("_range", "_one", "_before", "_offset")


def nearest(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, forward: bool = False) -> DataFrame:
    """Value of the nearest row at or before (or at or after) each row, nulls passed over.

    ``forward`` also adds ``<out>_last``, the last value of the whole group.
    """
    parts = _ranges(df, pos).withColumn("_value", value)
    at = F.when(F.col("_value").isNotNull(), F.col(pos))
    summary = parts.groupBy(*keys, "_range").agg(
        F.min_by("_value", at).alias("_first"), F.max_by("_value", at).alias("_final")
    )
    group = Window.partitionBy(*keys).orderBy("_range")
    before = F.last("_final", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(group.rowsBetween(1, Window.unboundedFollowing))
    last = F.last("_final", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = summary.select(*keys, "_range", (after if forward else before).alias("_carried"), last.alias("_last"))
    inside = Window.partitionBy(*keys, "_range").orderBy(pos)
    if forward:
        local = F.first("_value", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    else:
        local = F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = null_safe_join(parts.withColumn("_local", local), carried, [*keys, "_range"])
    found = joined.withColumn(out, F.coalesce("_local", "_carried"))
    if forward:
        found = found.withColumn(f"{out}_last", F.col("_last"))
    return found.drop("_range", "_value", "_local", "_carried", "_last")


def round_robin(df: DataFrame, keys: list[str], pos: str, shards: int, out: str = "shard") -> DataFrame:
    """Item ``i`` of its group goes to shard ``i % shards``."""
    numbered = running_row_number(df, keys, pos, "_number")
    return numbered.withColumn(out, F.pmod(F.col("_number"), F.lit(shards)).cast("int")).drop("_number")
