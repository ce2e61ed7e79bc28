"""Log records: levels and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Level numbers, and the outputs with their least level.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
SINKS = {"normal": "INFO", "trace": "DEBUG", "error": "ERROR"}

LOG_SCHEMA = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("func_name", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
    ]
)


def level_number(level: Column) -> Column:
    number = F.lit(None).cast("int")
    for name, value in LEVELS.items():
        number = F.when(F.upper(level) == name, F.lit(value)).otherwise(number)
    return number


def route_levels(records: DataFrame, level: str = "level", sinks: dict[str, str] | None = None, unknown: str | None = None) -> DataFrame:
    """One row per record and output it belongs to.

    The outputs are a handful of literals, so each record is fanned out in place;
    no join is needed. Records whose level has no number go to the output ``unknown``
    where one is named, else to none.
    """
    routes = (sinks or SINKS).items()
    number = level_number(F.col(level))
    found = [F.when(number >= LEVELS[least], F.lit(name)) for name, least in routes]
    wanted = F.array_compact(F.array(*found, F.when(number.isNull(), F.lit(unknown))))
    return records.withColumn("sink", F.explode(wanted))
