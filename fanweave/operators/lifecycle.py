"""The states of shuffles along the log: opened, then open until the first cancellation that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import first_refusal


def state_spans(opened: DataFrame, cancels: DataFrame) -> DataFrame:
    """(shuffle_id, opened_at, cancelled_at, reason): when each shuffle opened, and when and why it was cancelled.

    ``opened``: shuffle_id, opened_at; ``cancels``: seq, shuffle_id, reason. Only an open shuffle can be
    cancelled, and only with a reason, so the first such request counts: a grouped minimum, no window.
    """
    asked = cancels.join(opened, "shuffle_id").filter("seq > opened_at AND reason <> 'Ok'")
    first = asked.groupBy("shuffle_id").agg(
        F.min("seq").alias("cancelled_at"), F.min_by("reason", "seq").alias("reason")
    )
    return opened.join(first, "shuffle_id", "left").select("shuffle_id", "opened_at", "cancelled_at", "reason")


def state_at(seq: Column) -> Column:
    """A shuffle's state when the record ``seq`` is applied, from the columns of ``state_spans``."""
    return F.when(
        F.col("opened_at").isNull() | (seq <= F.col("opened_at")), "Closed"
    ).when(seq > F.col("cancelled_at"), "Cancelled").otherwise("Open")


def judge_cancellations(cancels: DataFrame, spans: DataFrame) -> DataFrame:
    """(seq, shuffle_id, error_code, applied): a cancellation repeated is fine and changes nothing."""
    rows = cancels.join(spans.drop("reason"), "shuffle_id", "left").withColumn("_state", state_at(F.col("seq")))
    code = first_refusal(
        ("_state = 'Cancelled'", "Ok"), ("_state <> 'Open'", "InvalidState"), ("reason = 'Ok'", "InvalidArgument")
    )
    return rows.select(
        "seq", "shuffle_id", code.alias("error_code"),
        F.coalesce(F.col("seq") == F.col("cancelled_at"), F.lit(False)).alias("applied")
    )


def lifecycle_gate(requests: DataFrame, spans: DataFrame) -> DataFrame:
    """``requests`` (seq, shuffle_id, ...) with ``shuffle_state`` and ``error_code``: authority is for open shuffles only."""
    rows = requests.join(spans.drop("reason"), "shuffle_id", "left").withColumn("shuffle_state", state_at(F.col("seq")))
    code = first_refusal(("shuffle_state = 'Cancelled'", "Cancelled"), ("shuffle_state <> 'Open'", "InvalidState"))
    return rows.withColumn("error_code", code).select(*requests.columns, "shuffle_state", "error_code")


def dropped_grants(grants: DataFrame, outcomes: DataFrame, spans: DataFrame) -> DataFrame:
    """(shuffle_id, in_flight, dropped): grants without an outcome; a cancellation takes the authority of those before it.

    ``grants``: shuffle_id, attempt, seq; ``outcomes``: shuffle_id, attempt.
    """
    open_ = grants.join(
        outcomes.select("shuffle_id", "attempt"), ["shuffle_id", "attempt"], "left_anti"
    ).join(spans, "shuffle_id", "left")
    gone = F.coalesce(F.col("seq") < F.col("cancelled_at"), F.lit(False))
    return open_.groupBy("shuffle_id").agg(F.count_if(~gone).alias("in_flight"), F.count_if(gone).alias("dropped"))
