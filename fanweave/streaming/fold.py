"""The commit fold as a stream: the same outcomes as the batch windows, partition by partition."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir

OUT = "seq long, partition long, partition_gen long, consumer_id long, error_code string, outcome string"
#: latest generation, its anchor (digest, producer, incarnation, bytes) and the consumers that completed it
STATE = "latest long, digest string, producer_id long, producer_incarnation long, bytes long, consumers array<long>"


def _local(row, n: int, shuffle_gen: int) -> str:
    if not 0 <= row.partition < n:
        return "UnknownPartition"
    if row.partition_gen == 0:
        return "InvalidArgument"
    if not row.integrity:
        return "IntegrityFailure"
    if not row.digest:
        return "ManifestInconsistent"
    if row.bytes == 0:
        return "InvalidArgument"
    return "StaleGeneration" if row.shuffle_gen != shuffle_gen else "Ok"


def fold_stream(log: DataFrame, n: int, shuffle_gen: int = 1) -> DataFrame:
    """A stream of commits (as for ``fold_commits``) with ``error_code`` and ``outcome``, in append mode.

    State is kept by partition, one generation each, for an older one can only be refused. Rows of one
    partition must arrive in order of seq from batch to batch; within a batch they are sorted.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, digest, producer, incarnation, size, consumers = state.get if state.exists else (
            0, None, None, None, None, []
        )
        consumers, out = set(consumers), []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            code, outcome = _local(row, n, shuffle_gen), "refused"
            if code == "Ok" and row.partition_gen < latest:
                code = "StaleGeneration"
            elif code == "Ok" and row.partition_gen > latest:
                latest, digest, producer, incarnation, size = row.partition_gen, row.digest, row.producer_id, row.producer_incarnation, row.bytes
                consumers, outcome = {row.consumer_id}, "new"
            elif code == "Ok" and (
                row.digest, row.producer_id, row.producer_incarnation
            ) != (digest, producer, incarnation):
                code = "DivergentCommit"
            elif code == "Ok" and row.bytes != size:
                code = "AccountingMismatch"
            elif code == "Ok":
                outcome = "duplicate" if row.consumer_id in consumers else "edge"
                consumers.add(row.consumer_id)
            out.append((row.seq, row.partition, row.partition_gen, row.consumer_id, code, outcome))
        state.update((latest, digest, producer, incarnation, size, sorted(consumers)))
        yield pd.DataFrame(out, columns=["seq", "partition", "partition_gen", "consumer_id", "error_code", "outcome"])

    return log.groupBy("partition").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def fold_batches(log: DataFrame, n: int, shuffle_gen: int = 1) -> DataFrame:
    """The outcomes of a stream of commits up to what is there now, as a table.

    Each batch is written under its number in the shared folder, so one that is retried after a loss
    replaces itself and counts once.
    """
    spark = log.sparkSession
    path = f"{shared_dir(spark)}/streamed-fold-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream = fold_stream(log, n, shuffle_gen).writeStream.foreachBatch(keep).option(
        "checkpointLocation", f"{path}/state"
    )
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{OUT}, batch long").parquet(f"{path}/rows").drop("batch")
