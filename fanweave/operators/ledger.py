"""Exactly-once accounts: the fold of commits and failures, edge phases, progress and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_text
from ..schemas import ERROR_CODES, EXPLAINED, first_refusal, retry_class_of
from .ranking import earlier_max, running_sum, running_sums

COMMIT = ("partition", "partition_gen", "consumer_id")


def fold_commits(log: DataFrame, n: int, shuffle_gen: int = 1, manifests: DataFrame | None = None) -> DataFrame:
    """The outcome of every commit of an ordered log, decided without a loop.

    The log: seq, partition, partition_gen, consumer_id, producer_id, producer_incarnation, shuffle_gen,
    digest, bytes, integrity. ``manifests`` (seq, partition, partition_gen) also move a partition's latest
    generation. Adds ``error_code`` and ``outcome``: new, edge, duplicate or refused.

    A locally valid commit of a new highest generation is always accepted, so the running maximum over valid
    rows is that over accepted rows; a generation's first row that isn't stale is the one that later claims
    must match, and the first good row of an edge completes it. The maximum runs over bands of the log, and
    both firsts are aggregates that combine before the shuffle, so a hot partition isn't one task.
    """
    local = first_refusal(
        (
            f"partition >= {n} OR partition < 0", "UnknownPartition"
        ), ("partition_gen = 0", "InvalidArgument"), ("NOT integrity", "IntegrityFailure"),
        (
            "digest IS NULL OR digest = ''", "ManifestInconsistent"
        ), ("bytes = 0", "InvalidArgument"), (f"shuffle_gen <> {shuffle_gen}", "StaleGeneration"),
    )
    rows = log.withColumns({"_local": local, "_commit": F.lit(True)})
    if manifests is not None:
        rows = rows.unionByName(
            manifests.select(
                "seq", "partition", "partition_gen", F.lit("Ok").alias("_local"), F.lit(False).alias("_commit")
            ),
            allowMissingColumns=True
        )
    valid = F.when(F.col("_local") == "Ok", F.col("partition_gen"))
    rows = earlier_max(rows, "partition", "seq", valid, "_latest").withColumn(
        "_stale", F.coalesce("_latest", F.lit(0)) > F.col("partition_gen")
    ).filter("_commit").drop("_commit", "_latest")
    claim = ("seq", "digest", "producer_id", "producer_incarnation", "bytes")
    anchors = rows.filter("_local = 'Ok' AND NOT _stale").groupBy("partition", "partition_gen").agg(
        F.min_by(F.struct(*claim), "seq").alias("_first")
    )
    rows = rows.join(anchors, ["partition", "partition_gen"], "left")
    code = F.when(F.col("_local") != "Ok", F.col("_local")).when(F.col("_stale"), "StaleGeneration").when(
        F.expr("digest <> _first.digest OR producer_id <> _first.producer_id OR producer_incarnation <> _first.producer_incarnation"), "DivergentCommit").when(F.expr("bytes <> _first.bytes"), "AccountingMismatch").otherwise("Ok")
    rows = rows.withColumn("error_code", code)
    edges = rows.filter("error_code = 'Ok'").groupBy(*COMMIT).agg(F.min("seq").alias("_edge"))
    outcome = F.expr(
        """CASE WHEN error_code <> 'Ok' THEN 'refused' WHEN seq = _first.seq THEN 'new' WHEN seq = _edge THEN 'edge' ELSE 'duplicate' END"""
    )
    return rows.join(edges, [*COMMIT], "left").withColumn("outcome", outcome).select(
        *log.columns, "error_code", "outcome"
    )


def bound_tracked(folded: DataFrame, reports: DataFrame, most_partitions: int, most_edges: int) -> DataFrame:
    """(seq, error_code, tracked_partitions, tracked_edges) of the commits that add something, under bounds on what a ledger tracks.

    Counts run over the log: committed generations, and completed edges with edges that ``reports`` (seq and
    the edge) named before. Both only grow, so what comes after a bound is reached is refused.
    """
    adds = folded.filter(F.col("outcome").isin("new", "edge")).select("seq", F.col("outcome").alias("_kind"))
    failing = reports.groupBy(*COMMIT).agg(F.min("seq").alias("seq")).select("seq", F.lit("failure").alias("_kind"))
    rows = running_sums(
        adds.unionByName(failing), "seq",
        {"tracked_partitions": (F.col("_kind") == "new").cast("int"), "tracked_edges": F.lit(1)}
    )
    over = (F.col("tracked_partitions") > most_partitions) | (F.col("tracked_edges") > most_edges)
    return rows.filter("_kind <> 'failure'").select(
        "seq", F.when(over, "TooManyTrackedEdges").otherwise("Ok").alias("error_code"), "tracked_partitions",
        "tracked_edges"
    )


def commit_receipts(folded: DataFrame) -> DataFrame:
    """(seq, commit_sequence, duplicate, bytes_counted) of accepted commits; the sequence counts newly committed generations."""
    numbered = running_sum(
        folded.filter("outcome = 'new'").select("seq", "partition", "partition_gen"), "seq", F.lit(1), "commit_sequence"
    ).select("partition", "partition_gen", "commit_sequence")
    return folded.filter("outcome <> 'refused'").join(numbered, ["partition", "partition_gen"]).select(
        "seq", "commit_sequence", (F.col("outcome") == "duplicate").alias("duplicate"),
        F.when(F.col("outcome") == "new", F.col("bytes")).otherwise(0).alias("bytes_counted")
    )


def committed_edges(folded: DataFrame) -> DataFrame:
    """(partition, partition_gen, consumer_id, digest, bytes, producer_incarnation) once per completed edge."""
    return folded.filter(F.col("outcome").isin("new", "edge")).select(
        *COMMIT, "digest", "bytes", "producer_incarnation"
    )


def latest_generations(*logs: DataFrame) -> DataFrame:
    """(partition, latest): the highest generation in any of the logs (partition, partition_gen)."""
    rows = logs[0].select("partition", "partition_gen")
    for log in logs[1:]:
        rows = rows.unionByName(log.select("partition", "partition_gen"))
    return rows.groupBy("partition").agg(F.max("partition_gen").alias("latest"))


def retained_generations(folded: DataFrame, keep: int = 2) -> DataFrame:
    """(partition, partition_gen, retained): whether each committed generation is among the newest ``keep``."""
    committed = folded.filter("outcome = 'new'").select("partition", "partition_gen")
    newest = Window.partitionBy("partition").orderBy(F.desc("partition_gen"))
    return committed.withColumn("retained", F.dense_rank().over(newest) <= keep)


def last_failures(log: DataFrame) -> DataFrame:
    """The last failure of each edge out of (seq, partition, partition_gen, consumer_id, code, permanent, attempts, ready_at)."""
    last = F.max_by(F.struct("code", "permanent", "attempts", "ready_at"), "seq")
    return log.groupBy(*COMMIT).agg(last.alias("_last")).select(*COMMIT, "_last.*")


def judge_failures(log: DataFrame, n: int, max_attempts: int = 3, min_ticks: int = 0) -> DataFrame:
    """Reports (seq, partition, partition_gen, consumer_id, code, attempts, tick) with ``error_code``, ``permanent``, ``ready_at``, ``outcome``.

    A deferred condition is pressure, not a failure, and is refused. Ready times compare with the caller's tick.
    """
    kind = retry_class_of(F.col("code"))
    rows = log.withColumn("retry_class", kind)
    permanent = F.col("retry_class").isin("Authority", "Permanent") | (F.col("attempts") >= max_attempts)
    rows = rows.withColumns(
        {
            "permanent": permanent,
            "error_code": first_refusal(
                ("retry_class = 'Deferred'", "InvalidArgument"), (f"partition >= {n}", "UnknownPartition"),
                ("code = 'Ok'", "InvalidArgument")
            )
        }
    )
    outcome = F.when(F.col("error_code") != "Ok", "refused").when(
        F.col("retry_class") == "Authority", "AuthorityRefused"
    ).when(F.col("permanent"), "PermanentFailure").otherwise("RetriableFailure")
    return rows.withColumns(
        {"outcome": outcome, "ready_at": F.col("tick") + F.when(F.col("permanent"), 0).otherwise(min_ticks)}
    )


def edge_status(
    wanted: DataFrame, completed: DataFrame, failures: DataFrame, latest: DataFrame, retained: DataFrame, n: int
) -> DataFrame:
    """Phase and reason of edges (partition, partition_gen, consumer_id), from what the ledger holds.

    A retained commit answers first, then a permanent failure; an older generation without either is
    purged, and everything else is pending.
    """
    alive = retained.filter("retained").select("partition", "partition_gen")
    done = completed.join(
        alive, ["partition", "partition_gen"], "left_semi"
    ).select(*COMMIT, F.lit(True).alias("_done"))
    joined = wanted.join(done, [*COMMIT], "left").join(failures, [*COMMIT], "left").join(latest, "partition", "left")
    case = lambda done, failed, purged, pending, unknown: F.when(F.col("partition") >= n, unknown).when(F.col("_done"), done).when(F.col("permanent"), failed).when(
        F.col("partition_gen") < F.col("latest"), purged
    ).otherwise(pending)
    return joined.select(
        *COMMIT, case(
            F.lit("Completed"), F.lit("Failed"), F.lit("Purged"), F.lit("Pending"), F.lit("Unknown")
        ).alias("phase"),
        case(
            F.lit("Ok"), F.col("code"), F.lit("PurgedHistory"), F.coalesce("code", F.lit("NotCommitted")),
            F.lit("UnknownPartition")
        ).alias("reason"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("ready_at", F.lit(0)).alias("ready_at"))


def progress(
    required: DataFrame, folded: DataFrame, failures: DataFrame, judged: DataFrame, latest: DataFrame, n: int
) -> DataFrame:
    """One row of measures. ``required`` has the single column planned_edges.

    Completions and failures count on each partition's current generation only, so no counter can drift;
    a failed edge that has since completed is completed. ``closes``: completed, failed and incomplete edges
    add up to the requirement and nothing is counted over it.
    """
    now = latest.withColumnRenamed("latest", "partition_gen")
    zero = F.lit(0).cast("long")
    done = folded.filter(F.col("outcome").isin("new", "edge")).select(
        *COMMIT, F.lit(1).alias("done"), zero.alias("lost"),
        F.when(F.col("outcome") == "new", F.col("bytes")).otherwise(zero).alias("size")
    )
    edges = done.unionByName(
        failures.filter("permanent").select(
            *COMMIT, F.lit(0).alias("done"), F.lit(1).cast("long").alias("lost"), zero.alias("size")
        )
    )
    edges = edges.join(now, ["partition", "partition_gen"], "left_semi").groupBy(*COMMIT).agg(
        F.max("done").alias("done"), F.max("lost").alias("lost"), F.sum("size").alias("size")
    )
    by_partition = edges.groupBy("partition").agg(
        F.sum("done").alias("done"), F.count_if(F.expr("lost > done")).alias("lost"), F.sum("size").alias("size")
    )
    by_edge = by_partition.agg(
        F.coalesce(F.sum("done"), zero).alias("edges_completed"), F.count_if(F.expr("done > 0")).alias(
            "partitions_committed"
        ), F.coalesce(F.sum("size"), zero).alias("bytes_committed"),
        F.coalesce(F.sum("lost"), zero).alias("edges_failed"), F.count_if(F.expr("done = 0 AND lost > 0")).alias("partitions_failed"))
    by_log = folded.agg(
        F.count_if(F.expr("outcome = 'duplicate'")).alias("duplicate_commits_suppressed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_attempted")
    )
    by_kind = failures.agg(
        F.count_if("permanent").alias("permanent_failures"), F.count_if(~F.col("permanent")).alias("retriable_failures")
    )
    refusals = judged.agg(F.count_if(F.expr("outcome = 'AuthorityRefused'")).alias("authority_refusals"))
    row = required.select(F.col("planned_edges").alias("edges_required"))
    for part in (by_edge, by_log, by_kind, refusals):
        row = row.crossJoin(F.broadcast(part))  # one row each
    resolved = F.col("edges_completed") + F.col("edges_failed")
    nil = F.lit(0).cast("long")
    row = row.withColumns({
        "partitions_total": F.lit(n).cast("long"), "partitions_incomplete": F.greatest(
            F.lit(n) - F.col("partitions_committed") - F.col("partitions_failed"), nil
        ),
        "edges_incomplete": F.greatest(F.col("edges_required") - resolved, nil), "edges_over_counted": F.greatest(resolved - F.col("edges_required"), nil)})
    return row.withColumn(
        "closes", (F.col("edges_over_counted") == 0) & (resolved + F.col("edges_incomplete") == F.col("edges_required"))
    )


def explain(
    failures: DataFrame, folded: DataFrame, missing: DataFrame, producers: DataFrame, consumers: DataFrame,
    status: DataFrame | None = None
) -> DataFrame:
    """(code, subject, detail, count): why what isn't done isn't done. Subjects compare as strings.

    ``status`` is one row of what the log as a whole says: epoch, pending (participants that must register
    anew), torn (a journal lost its tail), state and reason of the shuffle, durable, edges_over_counted, closes.
    """
    named = failures.withColumns(
        {
            "_subject": edge_text(*map(F.col, COMMIT)),
            "_detail": F.concat(
                F.lit("permanent="), F.when(F.col("permanent"), "yes").otherwise("no"), F.lit(" attempts="),
                F.col("attempts").cast("string"), F.lit(" ready_at="), F.col("ready_at").cast("string")
            )
        }
    )
    parts = [
        named.groupBy("code").agg(
            F.min("_subject").alias("subject"), F.min_by("_detail", "_subject").alias("detail"),
            F.count("*").alias("count")
        )
    ]

    def extra(
        df: DataFrame, code: Column | str, subject: Column | str, detail: Column | str, count: str = "count"
    ) -> None:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        parts.append(
            df.filter(f"{count} > 0").select(
                text(code).alias("code"), text(subject).alias("subject"), text(detail).alias("detail"),
                F.expr(count).cast("long").alias("count")
            )
        )

    extra(
        folded.filter("outcome = 'duplicate'").agg(F.count("*").alias("count")), "DuplicateCompletion", "ledger",
        EXPLAINED["duplicates"]
    )
    extra(
        missing.agg(F.count("*").alias("count"), F.min("partition").alias("p")), "PartitionNotProduced",
        F.concat(F.lit("partition "), F.col("p").cast("string")), EXPLAINED["missing"]
    )
    idle = producers.select("state").unionByName(consumers.select("state")).filter("state <> 'Active'")
    extra(idle.agg(F.count("*").alias("count")), "ParticipantNotActive", "topology", EXPLAINED["inactive"])
    if status is not None:
        extra(
            status, "RevalidationRequired", F.concat(F.lit("epoch "), F.col("epoch").cast("string")),
            EXPLAINED["pending"], "pending"
        )
        extra(status, "RevalidationRequired", "journal", EXPLAINED["torn"], "CAST(torn AS INT)")
        extra(
            status, F.when(F.col("state") == "Cancelled", F.col("reason")).otherwise("InvalidState"), "shuffle",
            F.concat(F.lit(EXPLAINED["state"]), "state"), "CAST(state <> 'Open' AS INT)"
        )
        extra(status, "CapabilityUnsupported", "durability", EXPLAINED["volatile"], "CAST(NOT durable AS INT)")
        extra(status, "AccountingMismatch", "progress", EXPLAINED["over"], "edges_over_counted")
        extra(
            status, "AccountingMismatch", "progress", EXPLAINED["open"],
            "CAST(edges_over_counted = 0 AND NOT closes AS INT)"
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def render(explanation: DataFrame) -> DataFrame:
    """(position, line): an explanation as text, in order of code number and subject."""
    number = F.create_map(*[F.lit(x) for pair in ERROR_CODES.items() for x in pair])[F.col("code")]
    ordered = Window.orderBy(number, "subject")  # a row per code
    return explanation.select(
        F.row_number().over(ordered).alias("position"),
        F.format_string("%dx %s [%s] %s", "count", "code", "subject", "detail").alias("line")
    )
