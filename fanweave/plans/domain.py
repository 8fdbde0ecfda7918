"""The given tables read as transfer planning: who produces, who consumes, and what was logged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.selection import selection

#: Partitions of the large shuffle, of each small one, and of the commit log.
SPACE, SMALL, LOGGED = 256, 32, 64

_KIND = "CASE WHEN {k} % 16 = 0 THEN 'All' WHEN {k} % 2 = 0 THEN 'Range' ELSE 'List' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """producer_id, incarnation, state, endpoint from supplier."""
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1).alias("producer_id"), F.expr(
            "1 + CAST(s_suppkey % 3 = 0 AS BIGINT)"
        ).alias("incarnation"),
        F.expr("""CASE s_suppkey % 10 WHEN 7 THEN 'Suspect' WHEN 8 THEN 'Failed' WHEN 9 THEN 'Withdrawn' ELSE 'Active' END""").alias("state"), F.concat(F.lit("loop:"), F.col("s_name")).alias("endpoint"))


def consumers(spark: SparkSession, sf_dir: str, n: int = SPACE) -> DataFrame:
    """consumer_id, incarnation, state, endpoint, selection and shuffle_id from customer; 64 customers make a small shuffle."""
    k = F.col("c_custkey") % n
    none = F.expr("cast(array() as array<bigint>)")
    kind = F.expr(_KIND.format(k="c_custkey"))
    members = F.when(kind == "List", F.array_sort(F.array_distinct(F.array(k, (k + 5) % n)))).otherwise(none)
    begin, end = (F.when(kind == "Range", x).otherwise(0) for x in (k, F.least(k + 8, F.lit(n))))
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("consumer_id"), F.lit(1).cast("long").alias("incarnation"),
        F.expr(
            "CASE c_custkey % 11 WHEN 9 THEN 'Suspect' WHEN 10 THEN 'Withdrawn' ELSE 'Active' END"
        ).alias("state"), F.concat(F.lit("loop:"), F.col("c_name")).alias("endpoint"),
        selection(kind, begin, end, members).alias("selection"), F.floor(F.col("c_custkey") / 64).alias("shuffle_id"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a row of the log."""
    return as_log(table(spark, sf_dir, "events"))


def as_log(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, with seq, kind and the columns that commits, manifests, failures and readings need."""
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), (
            F.col("user_id") % LOGGED
        ).alias("partition"), F.col("user_id"),
        F.expr(
            "1 + (day(ts) - 1) div 10 - CAST(event_id % 40 = 0 AS BIGINT)"
        ).alias("partition_gen"), F.expr("event_id % 25 + 1").alias("consumer_id"),
        F.expr(f"user_id % {LOGGED} % 7 + 1").alias("producer_id"), F.expr(
            "1 + CAST(event_id % 70 = 5 AS BIGINT)"
        ).alias("producer_incarnation"), F.expr("1 + CAST(event_id % 90 = 7 AS BIGINT)").alias("shuffle_gen"),
        F.expr(
            f"""sha2(concat(user_id % {LOGGED}, ':', 1 + (day(ts) - 1) div 10 - CAST(event_id % 40 = 0 AS BIGINT), CASE WHEN event_id % 50 = 1 THEN ':x' ELSE '' END), 256)"""
        ).alias("digest"),
        F.expr(
            f"1000 + user_id % {LOGGED} + CAST(event_id % 60 = 2 AS BIGINT)"
        ).alias("bytes"), F.expr("event_id % 20 <> 3").alias("integrity"),
        F.expr("least(100, CAST(floor(value) AS BIGINT))").alias("level"))


#: What failures report, by event id.
FAILURE_CODES = (
    "ConnectionFailure", "IntegrityFailure", "AuthorityDenied", "StateCorrupt", "BackpressureActive", "PeerUnavailable",
    "StaleIncarnation"
)


def failure_log(log: DataFrame) -> DataFrame:
    """Failures of the log: code, attempts and tick besides the edge."""
    codes = F.array(*map(F.lit, FAILURE_CODES))
    return log.filter("kind = 'error'").select(
        "seq", "partition", "partition_gen", "consumer_id",
        F.get(codes, (F.col("seq") % len(FAILURE_CODES)).cast("int")).alias("code"),
        (F.col("seq") % 4 + 1).alias("attempts"), F.col("seq").alias("tick")
    )


def commit_log(log: DataFrame) -> DataFrame:
    return log.filter("kind IN ('click', 'purchase')").select(
        "seq", "partition", "partition_gen", "consumer_id", "producer_id", "producer_incarnation", "shuffle_gen",
        "digest", "bytes", "integrity"
    )


def manifest_log(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'view'").select(
        "seq", "partition", "partition_gen", "producer_id", "producer_incarnation", "shuffle_gen", "digest"
    )


def participants(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """kind, id, incarnation, state of both sides."""
    side = lambda df, kind, key: df.select(
        F.lit(kind).alias("kind"), F.col(key).alias("id"), "incarnation", "state"
    )
    return side(producers, "Producer", "producer_id").unionByName(side(consumers, "Consumer", "consumer_id"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partition and payload from documents: the bytes of the text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("partition"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")
    )
