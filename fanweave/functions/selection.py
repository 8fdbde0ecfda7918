"""Expressions over selections: STRUCT<kind, begin, end, list> of partitions 0..n-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def selection(kind: Column, begin: Column, end: Column, members: Column) -> Column:
    """A selection value. ``members`` is sorted; All and Range carry an empty list."""
    return F.struct(
        kind.alias("kind"), begin.cast("long").alias("begin"), end.cast("long").alias("end"),
        members.cast("array<bigint>").alias("list")
    )


def covers(s: Column, partition: Column) -> Column:
    """Whether the selection holds a partition."""
    return F.when(s["kind"] == "All", True).when(
        s["kind"] == "Range", (partition >= s["begin"]) & (partition < s["end"])
    ).otherwise(F.array_contains(s["list"], partition.cast("long")))


def selected_count(s: Column, n: int) -> Column:
    """How many of ``n`` partitions the selection holds, in closed form."""
    span = F.greatest(
        F.least(s["end"], F.lit(n).cast("long")) - F.least(s["begin"], F.lit(n).cast("long")), F.lit(0).cast("long")
    )
    return F.when(s["kind"] == "All", F.lit(n).cast("long")).when(s["kind"] == "Range", span).otherwise(
        F.size(F.filter(s["list"], lambda x: x < n)).cast("long")
    )


def canonical_key(s: Column) -> Column:
    """The selection as text: ``all``, ``range:b:e`` or ``list:a,b``."""
    return F.when(s["kind"] == "All", "all").when(
        s["kind"] == "Range", F.concat_ws(":", F.lit("range"), s["begin"].cast("string"), s["end"].cast("string"))
    ).otherwise(F.concat(F.lit("list:"), F.array_join(F.transform(s["list"], lambda x: x.cast("string")), ",")))


def selected_partitions(s: Column, n: int) -> Column:
    """The selected partitions as an array: what to explode instead of joining on a range."""
    last = F.least(s["end"], F.lit(n).cast("long")) - 1
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(s["kind"] == "All", F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).when(
        s["kind"] == "Range", F.when(s["begin"] <= last, F.sequence(s["begin"], last)).otherwise(none)
    ).otherwise(F.filter(s["list"], lambda x: x < n))


def parse_selection(text: Column) -> Column:
    """The selection that a text names; null where it names none."""
    t = F.trim(text)
    members = F.transform(
        F.split(F.regexp_extract(t, r"^list:([0-9]+(?:,[0-9]+)*)$", 1), ","), lambda x: x.try_cast("bigint")
    )
    zero, none = F.lit(0), F.expr("cast(array() as array<bigint>)")
    bounds = [F.regexp_extract(t, r"^range:([0-9]+):([0-9]+)$", i).try_cast("bigint") for i in (1, 2)]
    sorted_unique = F.array_sort(members)
    return F.when(t == "all", selection(F.lit("All"), zero, zero, none)).when(t.rlike(r"^range:[0-9]+:[0-9]+$") & (bounds[0] < bounds[1]), selection(F.lit("Range"), bounds[0], bounds[1], none)).when(
        t.rlike(r"^list:[0-9]+(,[0-9]+)*$") & (F.size(F.array_distinct(members)) == F.size(members)), selection(F.lit("List"), zero, zero, sorted_unique))
