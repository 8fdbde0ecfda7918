"""Canonical ids and checked arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import first_refusal

_MOST = "18446744073709551615"


def id_code(text: Column) -> Column:
    """How a text reads as an id: canonical decimals of at most 64 bits are ``Ok``."""
    digits = text.rlike(r"^[0-9]+$")
    return first_refusal(
        (F.coalesce(text, F.lit("")) == "", "EmptyValue"),
        ((F.length(text) > 1) & text.startswith("0"), "InvalidArgument"),
        (~digits, "InvalidArgument"),
        (
            (F.length(text) > 20) | (text.try_cast("decimal(38,0)") > F.lit(_MOST).cast("decimal(38,0)")),
            "IntegerOverflow"
        ),
    )


def id_value(text: Column) -> Column:
    """The id, null where it isn't canonical. DECIMAL(20,0), for ids have 64 bits without sign."""
    return F.when(id_code(text) == "Ok", text.try_cast("decimal(20,0)"))


def edge_text(partition: Column, generation: Column, consumer: Column) -> Column:
    """An edge's name, as explanations sort by it."""
    return F.concat(
        F.lit("p"), partition.cast("string"), F.lit("/g"), generation.cast("string"), F.lit("/c"),
        consumer.cast("string")
    )
