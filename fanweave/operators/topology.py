"""Who produces what for whom: ownership, edges, patterns, fan bounds and registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selection import canonical_key, selected_count, selected_partitions
from ..policy import Policy
from ..schemas import first_refusal
from .ranking import ranked, running_sum

REQUIRED = "state <> 'Withdrawn'"
ACTIVE = "state = 'Active'"


def patterns(consumers: DataFrame, n: int) -> DataFrame:
    """Distinct selections of the consumers that count: canonical_key, selection, selected, consumers, first_consumer."""
    keyed = consumers.filter(REQUIRED).select(
        "consumer_id", "selection", canonical_key(F.col("selection")).alias("canonical_key")
    )
    grouped = keyed.groupBy("canonical_key").agg(
        F.count("*").alias("consumers"), F.min("consumer_id").alias("first_consumer"),
        F.first("selection").alias("selection")
    )
    return grouped.withColumn("selected", selected_count(F.col("selection"), n))


def planned_edges(consumers: DataFrame, n: int) -> DataFrame:
    """One row: planned_edges (null if the count overflows), pattern_count and error_code, without making an edge."""
    counted = patterns(consumers, n).withColumn("edges", F.try_multiply("consumers", "selected"))
    total = F.when(
        F.count_if(F.col("edges").isNull()) == 0, F.coalesce(F.try_sum("edges"), F.when(F.count("*") == 0, F.lit(0)))
    )
    row = counted.agg(total.cast("long").alias("planned_edges"), F.count("*").alias("pattern_count"))
    return row.withColumn("error_code", F.when(F.col("planned_edges").isNull(), "IntegerOverflow").otherwise("Ok"))


def edges(consumers: DataFrame, n: int) -> DataFrame:
    """(partition, consumer_id): every required delivery. Selections are exploded, so nothing is joined on a range."""
    return consumers.filter(REQUIRED).select(
        F.explode(selected_partitions(F.col("selection"), n)).alias("partition"), "consumer_id"
    )


def owners(producers: DataFrame, n: int) -> DataFrame:
    """(partition, producer_id, incarnation, endpoint): the (p mod active)-th active producer owns partition p."""
    active = ranked(producers.filter(ACTIVE), "producer_id", "rank").select(
        "producer_id", "incarnation", "endpoint", (F.col("rank") - 1).alias("slot")
    )
    count = producers.filter(ACTIVE).agg(F.count("*").alias("active"))
    slots = producers.sparkSession.range(n).withColumnRenamed("id", "partition").crossJoin(F.broadcast(count)).filter("active > 0")  # one row
    return slots.withColumn("slot", F.col("partition") % F.col("active")).join(active, "slot").select(
        "partition", "producer_id", "incarnation", "endpoint"
    )


def fan_out(consumers: DataFrame, n: int) -> DataFrame:
    """(partition, fan_out) of all partitions; exploded by pattern, so the rows are patterns times partitions at most."""
    counted = patterns(consumers, n).select(
        F.explode(selected_partitions(F.col("selection"), n)).alias("partition"), "consumers"
    ).groupBy("partition").agg(F.sum("consumers").alias("fan_out"))
    space = consumers.sparkSession.range(n).withColumnRenamed("id", "partition")
    return space.join(counted, "partition", "left").select(
        "partition", F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out")
    )


def fan_in(consumers: DataFrame, producers: DataFrame, n: int) -> DataFrame:
    """(consumer_id, fan_in) of all consumers: how many producers own what each selects, in closed form."""
    count = producers.filter(ACTIVE).agg(F.count("*").alias("active"))
    s = F.col("selection")
    distinct = F.size(
        F.array_distinct(F.transform(F.filter(s["list"], lambda x: x < n), lambda x: x % F.col("active")))
    ).cast("long")
    value = F.when(F.col("active") == 0, F.lit(0).cast("long")).when(s["kind"] == "List", distinct).otherwise(
        F.least(selected_count(s, n), F.col("active"))
    )
    return consumers.crossJoin(F.broadcast(count)).select("consumer_id", value.alias("fan_in"))


def policy_violations(consumers: DataFrame, producers: DataFrame, n: int, policy: Policy, most: int = 8) -> DataFrame:
    """(code, subject, detail): breaches of the fan ceilings and the edge bound, the first ``most`` of each category in scan order."""
    planned = planned_edges(consumers, n).filter(
        (F.col("planned_edges") > policy.limits.max_planned_edges) | F.col("planned_edges").isNull()
    )
    planned = planned.select(
        F.lit("LimitExceeded").alias("code"), F.lit("shuffle").alias("subject"),
        F.concat(
            F.lit("planned edge count "), F.coalesce(F.col("planned_edges").cast("string"), F.lit("?")),
            F.lit(" exceeds max_planned_edges")
        ).alias("detail")
    )
    out = fan_out(consumers, n).filter(F.col("fan_out") > policy.max_fan_out).orderBy("partition").limit(most)
    out = out.select(
        F.lit("FanOutCeilingExceeded").alias("code"),
        F.concat(F.lit("partition "), F.col("partition").cast("string")).alias("subject"),
        F.concat(
            F.lit("fan-out "), F.col("fan_out").cast("string"), F.lit(f" exceeds max_fan_out {policy.max_fan_out}")
        ).alias("detail")
    )
    into = fan_in(consumers, producers, n).filter(
        F.col("fan_in") > policy.max_fan_in
    ).orderBy("consumer_id").limit(most)
    into = into.select(
        F.lit("FanInCeilingExceeded").alias("code"),
        F.concat(F.lit("consumer "), F.col("consumer_id").cast("string")).alias("subject"),
        F.concat(
            F.lit("fan-in "), F.col("fan_in").cast("string"), F.lit(f" exceeds max_fan_in {policy.max_fan_in}")
        ).alias("detail")
    )
    return planned.unionByName(out).unionByName(into)


def active_counts(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(kind, registered, active) of both sides."""
    count = lambda df, kind: df.agg(
        F.lit(kind).alias("kind"), F.count("*").alias("registered"), F.count_if(F.expr(ACTIVE)).alias("active")
    )
    return count(producers, "Producer").unionByName(count(consumers, "Consumer"))


def check_producers(requests: DataFrame, registered: DataFrame, policy: Policy) -> DataFrame:
    """Requests (producer_id, incarnation, endpoint) with ``error_code``; the first failing check names it."""
    known = registered.select(
        "producer_id", F.col("incarnation").alias("_incarnation"), F.col("endpoint").alias("_endpoint")
    )
    return requests.join(known, "producer_id", "left").select("producer_id", "incarnation", "endpoint", first_refusal(
        ("producer_id = 0", "InvalidArgument"),
        ("incarnation = 0", "InvalidArgument"),
        (f"octet_length(endpoint) > {policy.limits.max_endpoint_bytes}", "OversizedInput"),
        ("_incarnation = incarnation AND _endpoint <> endpoint", "IdentityMismatch"),
    ).alias("error_code"))


def check_consumers(requests: DataFrame, n: int, policy: Policy) -> DataFrame:
    """Requests (consumer_id, incarnation, endpoint, selection) with ``error_code``, in order of consumer_id.

    A selection that none before it had needs room among ``max_selection_patterns``: the first request
    that passes the other checks brings its pattern in.
    """
    s = F.col("selection")
    members = F.coalesce(F.size(F.filter(s["list"], lambda x: x >= n)), F.lit(0))
    own = requests.withColumns({"canonical_key": canonical_key(s), "error_code": first_refusal(
        ("consumer_id = 0", "InvalidArgument"),
        ("incarnation = 0", "InvalidArgument"),
        (f"octet_length(endpoint) > {policy.limits.max_endpoint_bytes}", "OversizedInput"),
        (F.lit(n == 0), "InvalidState"),
        ((s["kind"] == "Range") & (s["begin"] >= s["end"]), "InvalidArgument"),
        ((s["kind"] == "Range") & (s["end"] > n), "UnknownPartition"),
        ((s["kind"] == "List") & (F.size(s["list"]) == 0), "InvalidArgument"),
        ((s["kind"] == "List") & (members > 0), "UnknownPartition"),
    )})
    first = own.filter("error_code = 'Ok'").groupBy("canonical_key").agg(F.min("consumer_id").alias("_first"))
    first = ranked(first, "_first", "_pattern")
    out = own.join(first.select("canonical_key", "_pattern"), "canonical_key", "left")
    return out.withColumn(
        "error_code",
        F.when(
            (F.col("error_code") == "Ok") & (F.col("_pattern") > policy.limits.max_selection_patterns),
            "TooManyPatterns"
        ).otherwise(F.col("error_code"))
    ).select("consumer_id", "canonical_key", "error_code")


def check_state_changes(changes: DataFrame, participants: DataFrame) -> DataFrame:
    """Changes (seq, kind, id, incarnation, state) with ``error_code``; ``participants`` has kind, id, incarnation."""
    known = participants.select("kind", "id", F.col("incarnation").alias("_incarnation"))
    return changes.join(known, ["kind", "id"], "left").select("seq", "kind", "id", "state", first_refusal(
        (~F.col("state").isin("Joining", "Active", "Suspect", "Failed", "Withdrawn"), "InvalidArgument"),
        ("id = 0", "InvalidArgument"),
        ("_incarnation IS NULL", "UnknownParticipant"),
        ("_incarnation <> incarnation", "StaleIncarnation"),
    ).alias("error_code"))


def registration_fold(log: DataFrame) -> DataFrame:
    """The latest registration of each participant out of (seq, id, incarnation): id, incarnation, registrations, superseded."""
    window = Window.partitionBy("id").orderBy("seq")
    marked = log.withColumn("_new", F.coalesce(F.col("incarnation") != F.lag("incarnation").over(window), F.lit(False)))
    return marked.groupBy("id").agg(
        F.max_by("incarnation", "seq").alias("incarnation"), F.count("*").alias("registrations"),
        F.count_if("_new").alias("superseded")
    )


def topology_generation(log: DataFrame) -> DataFrame:
    """(seq, generation) of a log (seq, id, state): one more for each row that changes its participant's state."""
    window = Window.partitionBy("id").orderBy("seq")
    changed = (F.lag("state").over(window).isNull() | (F.lag("state").over(window) != F.col("state"))).cast("int")
    return running_sum(
        log.withColumn("_changed", changed), "seq", F.col("_changed"), "generation"
    ).select("seq", "generation")
