"""Little-endian integers, digests and checksums as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def le_hex(value: Column, size: int) -> Column:
    """A non-negative integer as ``size`` little-endian bytes, in lower-case hex."""
    big = F.lower(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))
    return F.concat(*[F.substring(big, 2 * (size - i) - 1, 2) for i in range(size)])


def le_value(hex_text: Column, size: int) -> Column:
    """The integer of ``size`` little-endian bytes in hex; null beyond a signed long."""
    big = F.concat(*[F.substring(hex_text, 2 * (size - i) - 1, 2) for i in range(size)])
    return F.conv(big, 16, 10).try_cast("bigint")


def digest_hex(hex_text: Column) -> Column:
    """SHA-256 over the bytes that a hex text spells."""
    return F.sha2(F.unhex(hex_text), 256)


def is_digest(text: Column) -> Column:
    """Whether a text is a digest in canonical form: 64 lower-case hex digits."""
    return text.rlike("^[0-9a-f]{64}$")


_CASTAGNOLI = 0x82F63B78


def _table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (_CASTAGNOLI if value & 1 else 0)
        out.append(value)
    return out


def crc32c_bytes(data: bytes, table: list[int] = _table()) -> int:
    """CRC-32C (Castagnoli, reflected, all ones before and after)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = table[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of binary values; Spark's own ``crc32`` is another polynomial. Null stays null."""
    return data.map(crc32c_bytes, na_action="ignore").astype("Int64")
