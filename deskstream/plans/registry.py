"""Registration of queries and their oracles, and the common result format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskstream.sources.bind import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def present(frame: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Comparable columns: times as text, fractions to ``digits`` places, arrays joined with ``|``."""
    columns = []
    for f in frame.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StringType, T.LongType, T.IntegerType)):
            column = F.array_join(column.cast("array<string>"), "|")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            column = F.to_json(column)
        columns.append(column.alias(f.name))
    return frame.select(*columns)


def query(name: str, sql: str | None = None, ts: str = "", num: str = "", arr: str = "", digits: int = DIGITS):
    """Register ``fn(inputs) -> DataFrame`` under ``name``.

    ``ts``, ``num`` and ``arr`` name the columns of ``sql`` that get the common format. Scores
    that an operator already rounds keep all their ``digits``, so no value is rounded twice.
    """

    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, directory: present(fn(Inputs(spark, directory)), digits)
        if sql is not None:
            swaps = [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in ts.split()]
            swaps += [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {c}" for c in num.split()]
            swaps += [f"array_to_string({c}, '|') AS {c}" for c in arr.split()]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql}) AS q" if swaps else sql
        return fn

    return register
