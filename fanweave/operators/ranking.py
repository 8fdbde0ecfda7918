"""Ranks and running totals over a whole table without a window over all rows.

Both work in two levels on an integer order: rows fall into bands, a window over the bands (one row
each) carries what came before, and a window within each band adds the rest. A task sees one band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 4096


def running_sums(df: DataFrame, order: str, values: dict[str, Column], band: int = BAND) -> DataFrame:
    """``df`` with, for each name, the sum of its value over all rows up to and including this one, in ascending ``order`` (unique integers)."""
    rows = df.withColumns(
        {"__band": F.floor(F.col(order) / band)} | {f"__{name}": value.cast("long") for name, value in values.items()}
    )
    before = Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("__band").agg(*[F.sum(f"__{name}").alias(f"__sum_{name}") for name in values])
    bands = bands.select(
        "__band",
        *[F.coalesce(F.sum(f"__sum_{name}").over(before), F.lit(0)).alias(f"__before_{name}") for name in values]
    )
    within = Window.partitionBy("__band").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(bands, "__band").withColumns(
        {name: F.col(f"__before_{name}") + F.sum(f"__{name}").over(within) for name in values}
    )
    return rows.drop("__band", *[f"__{name}" for name in values], *[f"__before_{name}" for name in values])


def running_sum(df: DataFrame, order: str, value: Column, name: str, band: int = BAND) -> DataFrame:
    """``df`` with the running sum of one value."""
    return running_sums(df, order, {name: value}, band)


def running_max(df: DataFrame, order: str, value: Column, name: str, band: int = BAND) -> DataFrame:
    """``df`` with the largest ``value`` over all rows up to and including this one, in ascending ``order``."""
    rows = df.withColumns({"__band": F.floor(F.col(order) / band), "__value": value})
    before = Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("__band").agg(F.max("__value").alias("__max")).select(
        "__band", F.max("__max").over(before).alias("__before")
    )
    within = Window.partitionBy("__band").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(bands, "__band").withColumn(
        name, F.greatest("__before", F.max("__value").over(within))
    ).drop("__band", "__value", "__before")


def earlier_max(df: DataFrame, key: str, order: str, value: Column, name: str, band: int = BAND) -> DataFrame:
    """``df`` with the largest ``value`` among the earlier rows of the same ``key``, in ascending ``order``; null without any.

    A key's rows fall into bands of ``order``, so a hot key is many small windows and one over its bands' maxima.
    """
    rows = df.withColumns({"__band": F.floor(F.col(order) / band), "__value": value})
    bands = rows.groupBy(key, "__band").agg(F.max("__value").alias("__max"))
    before = Window.partitionBy(key).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(key, "__band", F.max("__max").over(before).alias("__before"))
    within = Window.partitionBy(key, "__band").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(bands, [key, "__band"]).withColumn(
        name, F.greatest("__before", F.max("__value").over(within))
    ).drop("__band", "__value", "__before")


def ranked(df: DataFrame, order: str, name: str, band: int = BAND) -> DataFrame:
    """``df`` with its rank from 1 in ascending ``order`` (unique integers)."""
    return running_sum(df, order, F.lit(1), name, band)
