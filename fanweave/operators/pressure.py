"""Congestion readings: admission, the latest as of a tick, freshness and hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import first_refusal


def admit_readings(readings: DataFrame, participants: DataFrame, policy_gen: int = 1) -> DataFrame:
    """Readings (tick, now, reporter_kind, reporter_id, reporter_incarnation, level, policy_gen) with ``error_code``."""
    known = participants.select(
        F.col("kind").alias("reporter_kind"), F.col("id").alias("reporter_id"),
        F.col("incarnation").alias("_incarnation"), F.col("state").alias("_state")
    )
    return readings.join(known, ["reporter_kind", "reporter_id"], "left").withColumn("error_code", first_refusal(
        ("level > 100", "InvalidArgument"), (
            F.col("policy_gen") != policy_gen, "StalePolicy"
        ), ("tick > now", "InvalidArgument"),
        ("_incarnation IS NULL", "UnknownParticipant"), (
            "_incarnation <> reporter_incarnation", "StaleIncarnation"
        ), ("_state <> 'Active'", "ParticipantNotActive"),
    )).drop("_incarnation", "_state")


def as_of(questions: DataFrame, readings: DataFrame) -> DataFrame:
    """Questions (target, tick) with the latest reading at or before: level, observed_at, null if there is none.

    A union and one window by target: no range join. Each (target, tick) is asked once and read once.
    """
    rows = questions.select("target", "tick", F.lit(1).alias("_ask"), F.lit(None).cast("struct<level:bigint,observed_at:bigint>").alias("_r")).unionByName(
        readings.select("target", "tick", F.lit(0).alias("_ask"), F.struct(F.col("level").cast("long").alias("level"), F.col("tick").cast("long").alias("observed_at")).alias("_r")))
    window = Window.partitionBy("target").orderBy("tick", "_ask").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = rows.withColumn("_last", F.last("_r", ignorenulls=True).over(window)).filter("_ask = 1")
    return found.select(
        "target", "tick", F.col("_last.level").alias("level"), F.col("_last.observed_at").alias("observed_at")
    )


def is_fresh(observed_at: Column, now: Column, validity: int) -> Column:
    """Whether evidence is neither from the future nor older than ``validity`` ticks; absent evidence isn't fresh."""
    return F.coalesce((observed_at <= now) & (now - observed_at <= validity), F.lit(False))


def hysteresis(readings: DataFrame, pause: int = 80, resume: int = 40) -> DataFrame:
    """(target, tick, level, paused): paused at ``pause`` or more, released at ``resume`` or less, else as before; at first not."""
    window = Window.partitionBy("target").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("level") >= pause, True).when(F.col("level") <= resume, False)
    return readings.select(
        "target", "tick", "level", F.coalesce(F.last(mark, ignorenulls=True).over(window), F.lit(False)).alias("paused")
    )


def decision(level: Column, fresh: Column, paused: Column, pause: int, resume: int, require_fresh: bool) -> Column:
    """Allow, Paused or Unknown for one target, given its latest level, whether that is fresh, and its state before."""
    stale = F.lit("Unknown") if require_fresh else F.when(paused, "Paused").otherwise("Allow")
    return F.when(
        ~fresh | level.isNull(), stale
    ).when(level >= pause, "Paused").when(level <= resume, "Allow").when(paused, "Paused").otherwise("Allow")
