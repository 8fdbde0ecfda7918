"""Admission of completions against the grants they claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import first_refusal


def admit_commits(
    requests: DataFrame, grants: DataFrame, consumers: DataFrame, producers: DataFrame, owners: DataFrame,
    manifests: DataFrame, shuffle_state: str | Column = "Open", shuffle_gen: int = 1
) -> DataFrame:
    """Requests with ``error_code``: the first check that refuses names it.

    requests: seq, attempt, partition, partition_gen, consumer_id, consumer_incarnation, producer_id,
    producer_incarnation, shuffle_gen, digest, content_digest, bytes, integrity, chunk_digests;
    grants: attempt, partition, partition_gen, consumer_id, consumer_incarnation, producer_id,
    producer_incarnation, digest; manifests: partition, partition_gen, digest, content_digest, bytes, chunk_digests.
    ``shuffle_state`` is one state, or the column that holds each request's.
    """
    state = F.lit(shuffle_state) if isinstance(shuffle_state, str) else shuffle_state
    requests = requests.withColumn("_state", state)
    grant = grants.select(
        "attempt",
        F.struct(
            "partition", "partition_gen", "consumer_id", "consumer_incarnation", "producer_id", "producer_incarnation",
            "digest"
        ).alias("g")
    )
    joined = (
        requests.join(grant, "attempt", "left")
        .join(consumers.select("consumer_id", F.struct("incarnation", "state").alias("c")), "consumer_id", "left")
        .join(producers.select("producer_id", F.struct("incarnation", "state").alias("p")), "producer_id", "left")
        .join(owners.select("partition", F.col("producer_id").alias("owner")), "partition", "left")
        .join(
            manifests.select(
                "partition", F.struct("partition_gen", "digest", "content_digest", "bytes", "chunk_digests").alias("m")
            ),
            "partition", "left"
        )
    )
    return joined.select("seq", first_refusal(
        ("_state IN ('Cancelled', 'Cancelling')", "Cancelled"),
        ("g IS NULL", "StaleAttempt"),
        ("_state <> 'Open'", "InvalidState"),
        (F.col("shuffle_gen") != shuffle_gen, "StaleGeneration"),
        (
            "partition <> g.partition OR partition_gen <> g.partition_gen OR consumer_id <> g.consumer_id",
            "AttemptSuperseded"
        ),
        (
            "producer_id <> g.producer_id OR producer_incarnation <> g.producer_incarnation OR consumer_incarnation <> g.consumer_incarnation",
            "StaleIncarnation"
        ),
        ("digest <> g.digest", "ManifestInconsistent"),
        ("c IS NULL", "UnknownParticipant"),
        ("c.incarnation <> consumer_incarnation", "StaleIncarnation"),
        ("c.state <> 'Active'", "ParticipantNotActive"),
        ("owner IS NULL OR owner <> producer_id", "PartitionNotOwned"),
        ("p IS NULL OR p.incarnation <> producer_incarnation", "StaleIncarnation"),
        ("p.state <> 'Active'", "ParticipantNotActive"),
        ("m IS NULL OR m.partition_gen <> partition_gen", "StaleGeneration"),
        ("m.digest <> digest", "DigestMismatch"),
        ("NOT integrity", "IntegrityFailure"),
        ("content_digest <> m.digest AND content_digest <> m.content_digest", "DigestMismatch"),
        ("bytes <> m.bytes", "AccountingMismatch"),
        ("size(chunk_digests) <> size(m.chunk_digests)", "IntegrityFailure"),
        ("chunk_digests <> m.chunk_digests", "DigestMismatch"),
    ).alias("error_code"))
