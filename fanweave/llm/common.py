"""What the training-data operators share: shared tables, text helpers, bitmap filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# written tables cut lineage and outlive any executor
from ..sources.shared import written as durable

#: White space of the contracts: space and the five controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A membership filter has BITS_PER_KEY bits for every key, and MOST_FILTER_BITS (32 MB, which may be broadcast) at most.
BITS_PER_KEY, MOST_FILTER_BITS = 16, 1 << 28
_PAGE_BITS = 1 << 15


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Have Spark send Python workers batches of ``most`` bytes at most, unless the session says otherwise.

    By default a batch may hold 64 MB, in the executor and in each of its workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "67108864"):
        spark.conf.set(key, most)


def whole_text(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def one_space(text: Column) -> Column:
    """Every run of white space replaced by one space."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone.

    ``lower`` is exact and fast where all characters are ASCII; ``translate`` serves the rest.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(
        F.octet_length(text) == F.length(text), F.lower(text)
    ).otherwise(F.translate(text, upper, upper.lower()))


@dataclass(frozen=True)
class KeyFilter:
    """Which hashed keys occur: ``pages`` of 4 KB each, ``bits`` in all."""

    pages: DataFrame
    bits: int


def key_filter(keys: DataFrame, key: str, most_bits: int = MOST_FILTER_BITS) -> KeyFilter:
    """A bitmap of the hashed ``key`` values, sized from their number so that one in ``BITS_PER_KEY`` others passes, or fewer.

    ``most_bits`` bounds what is broadcast. Beyond ``most_bits / BITS_PER_KEY`` keys more others pass, which
    costs their shuffle but no result: whoever probes the filter checks the exact keys of what passes.
    """
    hashes = durable(keys.select(F.xxhash64(key).alias("hash")).distinct(), "key-hashes")
    bits = _PAGE_BITS
    n = hashes.count()
    while bits < min(most_bits, BITS_PER_KEY * n):
        bits *= 2
    bit = F.pmod(F.col("hash"), F.lit(bits))
    pages = (
        hashes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _PAGE_BITS).cast("int").alias("__fw_page"))
        .agg(F.bitmap_construct_agg(F.col("bit") % _PAGE_BITS).alias("__fw_bits"))
    )
    return KeyFilter(pages, bits)


def maybe_in(df: DataFrame, key: Column, keys: KeyFilter, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: false only where ``key`` is certainly not in the filter.

    ``key`` must hash as the filter's key did. No row is dropped or moved: the filter is broadcast.
    """
    at = df.withColumn("__fw_bit", F.pmod(F.xxhash64(key), F.lit(keys.bits))).withColumn(
        "__fw_page", F.floor(F.col("__fw_bit") / _PAGE_BITS).cast("int")
    )
    byte = F.expr(
        f"cast(conv(hex(substring(__fw_bits, cast((__fw_bit % {_PAGE_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
    )
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__fw_bit % 8 as int))")) != 0, F.lit(False))
    return at.join(
        F.broadcast(keys.pages), "__fw_page", "left"
    ).withColumn(flag, hit).drop("__fw_page", "__fw_bit", "__fw_bits")


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are no row of ``gone`` (the same number of columns and types, null equals null).

    Rows that a bitmap of ``gone`` clears pass straight from the scan; only the others are shuffled.
    """
    names, own = docs.columns, [f"__fw_key{i}" for i in range(len(keys))]
    gone = gone.toDF(*[f"__fw_gone{i}" for i in range(len(keys))])
    bitmap = key_filter(gone.select(F.struct(*gone.columns).alias("__fw_key")), "__fw_key")
    probed = maybe_in(docs.withColumns(dict(zip(own, keys))), F.struct(*own), bitmap, "__fw_maybe")
    same = F.lit(True)
    for mine, other in zip(own, gone.columns):
        same = same & F.col(mine).eqNullSafe(F.col(other))
    unclear = probed.filter("__fw_maybe").join(gone, same, "left_anti")
    return probed.filter(~F.col("__fw_maybe")).select(*names).unionByName(unclear.select(*names))


def text_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most_bytes`` of text, or one longer row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def task_number() -> int:
    """The number of the running task's partition."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
