"""Line deduplication over levelled sorted runs (DataFrame operations only).

A run is a table bucketed and sorted by line hash, with the number of documents that hold the line and
the largest of their ids. Each batch of documents merge-anti-joins the runs: a line that no run owns yet
becomes a row that the batch's own run owns; of a line that an earlier run owns, the batch's run holds an
increment only. So every line has one owner, and the totals are the owners' rows with the increments of
later runs added. When a level holds ``fan`` runs they are compacted into one run of the next level.

Documents are dealt to batches by a hash of their id, so an id counts once however often it is repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, durable, key_filter, lower_ascii, maybe_in, whole_text

LEAST_CHARS = 40
LEAST_DOCS = 5


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Levelled sorted runs of (line hash, documents, largest id, owned), as managed tables of the session's catalog.

    The driver holds the names of the runs only: at most ``fan`` of each level. ``close`` drops them.
    """

    def __init__(self, spark: SparkSession, fan: int = 3, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        df.repartition(self.buckets, "line").write.bucketBy(self.buckets, "line").sortBy("line").saveAsTable(name)

    def runs(self) -> list[DataFrame]:
        """Every run, the oldest and largest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def add(self, lines: DataFrame) -> None:
        """Merge a batch of (line, doc) rows in. An id must not occur in more than one batch."""
        batch = durable(
            lines.groupBy("line").agg(F.countDistinct("doc").alias("docs"), F.max("doc").alias("last")), "line-batch"
        )
        new = batch
        for run in self.runs():
            new = new.join(run.filter("owned").select("line"), "line", "left_anti")
        marks = new.select("line", F.lit(True).alias("_new"))
        self._write(
            batch.join(marks, "line", "left").select("line", "docs", "last", F.col("_new").isNotNull().alias("owned")),
            0
        )
        level = 0
        while len(self.levels[level]) >= self.fan:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """Replace a full level by one run of the next: increments go into the row that owns the line, if it is among these runs."""
        full = self.levels[level]
        merged = self.spark.table(full[0])
        for name in full[1:]:  # full merge joins of sorted runs with equal buckets, so nothing is shuffled
            other = self.spark.table(name).select(
                "line", F.col("docs").alias("_docs"), F.col("last").alias("_last"), F.col("owned").alias("_owned")
            )
            merged = merged.join(other, "line", "full").select(
                "line", *self._summed(),
                (F.coalesce("owned", F.lit(False)) | F.coalesce("_owned", F.lit(False))).alias("owned")
            )
        self._write(merged, level + 1)
        self.levels[level] = []
        for name in full:
            self.spark.sql(f"DROP TABLE {name}")

    @staticmethod
    def _summed() -> tuple[Column, Column]:
        return (
            F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
        ).alias("docs"), F.greatest("last", "_last").alias("last")

    def totals(self) -> DataFrame:
        """(line, docs, last) over all runs: each owner's row, with the increments that the runs after it hold."""
        runs, parts = self.runs(), []
        for k, run in enumerate(runs):
            rows = run.filter("owned").select("line", "docs", "last")
            for later in runs[k + 1:]:
                more = later.filter("NOT owned").select(
                    "line", F.col("docs").alias("_docs"), F.col("last").alias("_last")
                )
                rows = rows.join(more, "line", "left").select("line", *self._summed())
            parts.append(rows)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def close(self) -> None:
        """Drop the runs."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def repeated_lines(lines: DataFrame, least_docs: int = LEAST_DOCS, batches: int = 4, fan: int = 3) -> DataFrame:
    """(line, last) of the lines that at least ``least_docs`` documents hold, out of (line, doc) rows."""
    runs = LineRuns(lines.sparkSession, fan)
    try:
        for k in range(batches):
            runs.add(lines.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k).select("line", "doc"))
        return durable(runs.totals().filter(F.col("docs") >= least_docs).select("line", "last"), "line-totals")
    finally:
        runs.close()


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS, batches: int = 4, fan: int = 3
) -> DataFrame:
    """Every row with its kept text: id, ``n_lines``, ``n_dropped``, ``kept_text``.

    A line's key is the line stripped of white space and with A-Z lower-cased. Keys of ``least_chars``
    code points or more that ``least_docs`` different ids hold lose their lines everywhere but in the
    largest of these ids. Null and empty texts are one empty line. Rows that repeat an id count as one
    document, and keep or lose a line together; a null id never counts nor keeps. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc"), whole_text(text_col).alias("_text"))
    rows = rows.withColumns({"_row": F.xxhash64("_text"), "_lines": F.split("_text", "\n", -1)})
    exploded = rows.select(
        "doc", "_row", F.posexplode("_lines").alias("pos", "_line")
    ).filter(F.length("_line") >= least_chars)
    keyed = exploded.withColumn("_key", line_key(F.col("_line"))).filter(F.length("_key") >= least_chars)
    lines = durable(
        keyed.select("doc", "_row", "pos", F.unhex(F.md5(F.encode("_key", "UTF-8"))).alias("line")), "lines"
    )

    repeated = repeated_lines(lines, least_docs, batches, fan)
    lost = lines.join(repeated, "line").filter(~F.col("doc").eqNullSafe(F.col("last")))
    drops = durable(lost.groupBy("doc", "_row").agg(F.collect_set("pos").alias("_drops")), "line-drops")

    # rows that lose no line pass from the scan; only texts that may lose one are shuffled
    texts = rows.select("doc", "_row", "_text")
    keys = key_filter(drops.select(F.struct("doc", "_row").alias("_key")), "_key")
    probed = maybe_in(texts, F.struct("doc", "_row"), keys, "_maybe")
    own = drops.select(F.col("doc").alias("_doc"), F.col("_row").alias("_hash"), "_drops")
    near = probed.filter("_maybe").join(
        own, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_hash")), "left"
    )
    joined = probed.filter("NOT _maybe").select(
        "doc", "_text", F.lit(None).cast("array<int>").alias("_drops")
    ).unionByName(near.select("doc", "_text", "_drops"))
    joined = joined.withColumn("_lines", F.split("_text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    kept = F.when(F.col("_drops").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    )
    return joined.select(
        F.col("doc").alias(id_col), F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"),
    )
