"""Typed logs: audits, recovery and the demotion that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RECORD_KINDS, first_refusal

#: The version of snapshots that can be read.
SNAPSHOT_VERSION = 1


def audit(log: DataFrame, snapshot_sequence: int = 0) -> DataFrame:
    """Records (journal, position, seq, header_ok, payload_ok) of typed logs with ``status``: replayed, skipped, corrupt or discarded.

    The first record of a journal that can't be believed is corrupt, and those after it are discarded.
    """
    order = Window.partitionBy("journal").orderBy("position")
    back = F.col("seq") < F.coalesce(F.lag("seq").over(order), F.lit(0))
    rows = log.withColumns(
        {
            "_bad": ~F.col("header_ok") | ~F.col("payload_ok") | back,
            "_repeat": (F.col("seq") == F.lag("seq").over(order)) | (F.col("seq") <= snapshot_sequence)
        }
    )
    stopped = F.coalesce(F.max("_bad").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    status = F.when(stopped, "discarded").when(F.col("_bad"), "corrupt").when(
        F.col("_repeat"), "skipped"
    ).otherwise("replayed")
    return rows.select("journal", "position", "seq", status.alias("status"))


def records_by_kind(log: DataFrame) -> DataFrame:
    """(kind, records) for every kind, those without records too."""
    kinds = log.sparkSession.createDataFrame([(k,) for k in RECORD_KINDS], "kind string")
    counted = log.groupBy("kind").agg(F.count("*").alias("records"))
    return F.broadcast(kinds).join(counted, "kind", "left").select(
        "kind", F.coalesce("records", F.lit(0)).alias("records")
    )


def snapshot_union(snapshot: DataFrame, journal: DataFrame, upto: int) -> DataFrame:
    """Snapshot rows and the journal rows after it (seq > ``upto``), with ``origin``."""
    return snapshot.withColumn("origin", F.lit("snapshot")).unionByName(
        journal.filter(F.col("seq") > upto).withColumn("origin", F.lit("journal"))
    )


def demote(participants: DataFrame) -> DataFrame:
    """Participants after a restart: who was active is suspect until it registers anew, and ``pending`` marks it."""
    was = F.col("state") == "Active"
    return participants.withColumn("pending", was).withColumn("state", F.when(was, "Suspect").otherwise(F.col("state")))


def recover(records: DataFrame, version: int = SNAPSHOT_VERSION) -> DataFrame:
    """Per store what a restart adopts: error_code, adopted, epoch, pending, history_incomplete.

    ``records``: store, origin (snapshot or journal), version (of the snapshot a record is from), seq, kind,
    id, state, epoch, readable, torn. A torn tail was never acknowledged: it is discarded and noted. Any
    other record that can't be read, or a snapshot of another version, refuses the whole store, which then
    adopts nothing and keeps its epoch. Otherwise the restart is a new epoch, and ``pending`` participants,
    those whose last record says Active, must register anew.
    """
    used = records.filter("NOT torn")
    participants = used.filter("kind IN ('Producer', 'Consumer')").groupBy("store", "kind", "id").agg(
        F.max_by("state", "seq").alias("state")
    )
    pending = participants.groupBy("store").agg(F.count_if(F.col("state") == "Active").alias("_pending"))
    totals = records.groupBy("store").agg(
        F.bool_or(
            (F.col("origin") == "snapshot") & (F.col("version") != version)
        ).alias("_other"), F.bool_or(~F.col("readable") & ~F.col("torn")).alias("_broken"),
        F.count_if(~F.col("torn")).alias("_records"), F.max(F.when(~F.col("torn"), F.col("epoch"))).alias("_epoch"), F.bool_or("torn").alias("_torn"))
    rows = totals.join(pending, "store", "left").withColumn(
        "error_code", first_refusal(("_other", "UnsupportedVersion"), ("_broken", "StateCorrupt"))
    )
    ok = F.col("error_code") == "Ok"
    nil = F.lit(0).cast("long")
    return rows.select(
        "store", "error_code", F.when(ok, F.col("_records")).otherwise(nil).alias("adopted"), (
            F.coalesce("_epoch", nil) + ok.cast("long")
        ).alias("epoch"),
        F.when(ok, F.coalesce("_pending", nil)).otherwise(nil).alias("pending"), (ok & F.col("_torn")).alias("history_incomplete"))
