"""Partition content as chunks with digests: building, checking and admitting manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import digest_hex, le_hex
from ..schemas import first_refusal

MAX_CHUNK_BYTES = 1 << 24
MAX_PARTITION_BYTES = 1 << 46
ZERO_DIGEST = "0" * 64


def chunk_rows(content: DataFrame, chunk_bytes: int, part: str = "partition", payload: str = "payload") -> DataFrame:
    """(partition, chunk_id, offset, length, digest) of every chunk of binary payloads; empty and null ones have none."""
    size = F.octet_length(payload)
    starts = F.sequence(F.lit(0), F.ceil(size / chunk_bytes).cast("int") - 1)
    rows = content.filter(size > 0).select(F.col(part), F.col(payload).alias("_payload"), F.explode(starts).alias("_k"))
    piece = F.expr(f"substring(_payload, _k * {chunk_bytes} + 1, {chunk_bytes})")
    return rows.select(
        part, F.col("_k").cast("long").alias("chunk_id"), (F.col("_k").cast("long") * chunk_bytes).alias("offset"),
        F.octet_length(piece).cast("long").alias("length"), F.sha2(piece, 256).alias("digest")
    )


def verify_chunks(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(partition, failing_chunk, error_code) of every declared partition: its first bad chunk. Length goes before digest."""
    seen = observed.select("partition", "chunk_id", F.col("length").alias("_length"), F.col("digest").alias("_digest"))
    code = first_refusal(
        ("_length IS NULL OR _length <> length", "IntegrityFailure"), ("_digest <> digest", "DigestMismatch")
    )
    judged = declared.join(seen, ["partition", "chunk_id"], "left").withColumn("code", code)
    return judged.groupBy("partition").agg(
        F.min(F.expr("CASE WHEN code <> 'Ok' THEN chunk_id END")).alias("failing_chunk"),
        F.coalesce(F.min_by("code", F.expr("CASE WHEN code <> 'Ok' THEN chunk_id END")), F.lit("Ok")).alias("error_code"))


def validate_manifests(
    headers: DataFrame, chunks: DataFrame, max_chunks: int = 1 << 16, max_partitions: int = 1 << 22
) -> DataFrame:
    """(partition, error_code) of headers (partition, shuffle, producer_id, total_bytes) and their chunk rows.

    ``position`` is a chunk's place in its manifest. Header rules go first, then each chunk's in order of
    position, then the sum.
    """
    window = Window.partitionBy("partition").orderBy("position")
    placed = chunks.withColumn("_expected", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(window), F.lit(0)))
    rule = first_refusal(
        ("chunk_id <> position", "ManifestInconsistent"), ("length = 0", "ManifestInconsistent"), (
            f"length > {MAX_CHUNK_BYTES}", "OversizedInput"
        ),
        ("offset <> _expected", "ManifestInconsistent"), (f"digest = '{ZERO_DIGEST}'", "ManifestInconsistent"),
    )
    judged = placed.withColumn("_rule", rule)
    by = judged.groupBy("partition").agg(
        F.count("*").alias("_chunks"), F.min_by("_rule", F.expr("CASE WHEN _rule <> 'Ok' THEN position END")).alias("_first"), F.max_by(F.col("offset") + F.col("length"), "position").alias("_end"))
    return headers.join(by, "partition", "left").select("partition", first_refusal(
        ("_chunks IS NULL", "ManifestInconsistent"), (f"_chunks > {max_chunks}", "TooManyChunks"), ("total_bytes = 0", "ManifestInconsistent"), (
            f"total_bytes > {MAX_PARTITION_BYTES}", "OversizedInput"
        ),
        (
            f"partition >= {max_partitions}", "TooManyPartitions"
        ), ("shuffle = 0", "ManifestInconsistent"), ("producer_id = 0", "ManifestInconsistent"),
        ("_first = 'OversizedInput'", "OversizedInput"), (
            "_first IS NOT NULL OR _end <> total_bytes", "ManifestInconsistent"
        ),
    ).alias("error_code"))


def _chunk_hex(chunks: DataFrame) -> DataFrame:
    """(partition, _count, _bytes, _body): the chunk list of each partition as canonical bytes in hex, in order of chunk id."""
    own = F.struct(
        "chunk_id",
        F.concat(
            le_hex(F.col("chunk_id"), 8), le_hex(F.col("offset"), 8), le_hex(F.col("length"), 4), F.col("digest")
        ).alias("h")
    )
    return chunks.groupBy("partition").agg(
        F.count("*").alias("_count"), F.sum("length").alias("_bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["h"]), "").alias("_body")
    )


def partition_digests(chunks: DataFrame) -> DataFrame:
    """(partition, total_bytes, chunks, partition_digest): SHA-256 over size, count and chunk list. A chunk list is bounded by the format."""
    return _chunk_hex(chunks).select(
        "partition", F.col("_bytes").alias("total_bytes"), F.col("_count").alias("chunks"),
        digest_hex(
            F.concat(le_hex(F.col("_bytes"), 8), le_hex(F.col("_count"), 4), F.col("_body"))
        ).alias("partition_digest")
    )


def manifest_digests(headers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(partition, manifest_digest): SHA-256 over identity and chunk list.

    Headers: shuffle, shuffle_gen, partition, partition_gen, producer_id, producer_incarnation, topology_gen, total_bytes.
    """
    names = (
        "shuffle", "shuffle_gen", "partition", "partition_gen", "producer_id", "producer_incarnation", "topology_gen",
        "total_bytes"
    )
    joined = headers.join(_chunk_hex(chunks), "partition")
    return joined.select(
        "partition",
        digest_hex(
            F.concat(*[le_hex(F.col(c), 8) for c in names], le_hex(F.col("_count"), 4), F.col("_body"))
        ).alias("manifest_digest")
    )


def admit_manifests(log: DataFrame, owners: DataFrame, producers: DataFrame, n: int, shuffle_gen: int = 1) -> DataFrame:
    """A manifest log (seq, partition, partition_gen, producer_id, producer_incarnation, shuffle_gen, digest) with ``error_code``.

    The refusals that need no history go first; among the rest, a generation below the running maximum is
    stale and one that differs from the first of its generation diverges. ``digest`` stands for the content.
    """
    own = owners.select("partition", F.col("producer_id").alias("_owner"))
    who = producers.select("producer_id", F.col("incarnation").alias("_incarnation"), F.col("state").alias("_state"))
    local = log.join(own, "partition", "left").join(who, "producer_id", "left").withColumn("error_code", first_refusal(
        (F.col("shuffle_gen") != shuffle_gen, "StaleGeneration"), (F.col("partition") >= n, "UnknownPartition"), (
            "_owner IS NULL OR _owner <> producer_id", "PartitionNotOwned"
        ),
        ("_incarnation IS NULL", "UnknownParticipant"), (
            "_incarnation <> producer_incarnation", "StaleIncarnation"
        ), ("_state <> 'Active'", "ParticipantNotActive"),
    ))
    before = Window.partitionBy("partition").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.col("error_code") == "Ok"
    same = Window.partitionBy("partition", "partition_gen", valid).orderBy("seq")
    judged = local.withColumns(
        {"_latest": F.max(F.when(valid, F.col("partition_gen"))).over(before), "_first": F.first("digest").over(same)}
    )
    return judged.select(
        "seq", "partition", "partition_gen",
        F.when(~valid, F.col("error_code")).when(
            F.col("_latest") > F.col("partition_gen"), "StaleGeneration"
        ).when(F.col("_first") != F.col("digest"), "DivergentCommit").otherwise("Ok").alias("error_code")
    )


def synthetic_payload(requests: DataFrame) -> DataFrame:
    """(partition, payload_hex) of requests (shuffle, shuffle_gen, partition, partition_gen, size): hash blocks in counter order, cut to size."""
    seed = F.concat(*[le_hex(F.col(c), 8) for c in ("shuffle", "shuffle_gen", "partition", "partition_gen")])
    blocks = F.when(
        F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / 32) - 1)
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    body = F.array_join(F.transform(F.col("_blocks"), lambda k: digest_hex(F.concat(F.col("_seed"), le_hex(k, 8)))), "")
    rows = requests.withColumns({"_seed": seed, "_blocks": blocks})
    return rows.select(
        "partition", F.expr("size").alias("size"),
        F.substring(body, F.lit(1), (F.col("size") * 2).cast("int")).alias("payload_hex")
    )


def missing_partitions(accepted: DataFrame, n: int) -> DataFrame:
    """(partition) of those that no accepted manifest describes."""
    return accepted.sparkSession.range(n).withColumnRenamed("id", "partition").join(
        accepted.select("partition"), "partition", "left_anti"
    )


def supersession(accepted: DataFrame) -> DataFrame:
    """(seq, partition, partition_gen, supersedes): the latest generation accepted before, if this one is newer."""
    before = Window.partitionBy("partition").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("partition_gen").over(before)
    return accepted.select(
        "seq", "partition", "partition_gen", F.when(last < F.col("partition_gen"), last).alias("supersedes")
    )


def chunk_evidence(observed: Column, declared: Column) -> Column:
    """How observed chunk digests compare with the declared ones: their number goes before their values."""
    return F.when(
        F.size(observed) != F.size(declared), "IntegrityFailure"
    ).when(observed != declared, "DigestMismatch").otherwise("Ok")
