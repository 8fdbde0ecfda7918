"""Exact document deduplication by progressive refinement (DataFrame operations only).

Rows are grouped by the length of the normalised text, then by a hash of its first characters, and
only rows that still have company are hashed in full. The first two levels share one scan: it yields
a row per distinct (length, prefix hash) and its count, combined before the shuffle. The surviving
groups travel to the second scan as a bitmap of fixed size, so no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, key_filter, maybe_in, one_space, whole_text, without

PREFIX_CHARS = 256


def _grouped(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool) -> DataFrame:
    """(_id, _row, keep_id, group_size, _sha) of every row; ``_row`` is a hash of the text as it stands."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_row"), one_space(text).alias("_norm"))
    rows = rows.withColumns({"_len": F.length("_norm"), "_prefix": F.xxhash64(F.substring("_norm", 1, prefix_chars))})

    by_prefix = durable(rows.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")), "dedup-prefixes")
    lengths = by_prefix.groupBy("_len").agg(F.sum("_n").alias("_of_length")).filter("_of_length > 1").select("_len")
    alive = by_prefix.join(lengths, "_len", "left_semi").filter("_n > 1")
    keys = key_filter(alive.select(F.struct("_len", "_prefix").alias("_key")), "_key")

    probed = maybe_in(rows, F.struct("_len", "_prefix"), keys, "_alive")
    full = F.sha2(F.encode("_norm", "UTF-8"), 256)
    digests = durable(
        probed.select("_id", "_row", "_alive", (full if digest_all else F.when(F.col("_alive"), full)).alias("_sha")),
        "dedup-digests"
    )

    groups = digests.filter("_alive").groupBy(F.col("_sha").alias("_group")).agg(
        F.min("_id").alias("_keep"), F.count("*").alias("_size")
    ).filter("_size > 1")
    groups = durable(  # with plain scans on both sides Spark can split the partition of a large group
        groups, "dedup-groups"
    )
    # a row without company joins nothing; a key of its own keeps such rows from meeting in one partition
    key = F.when(F.col("_alive"), F.col("_sha")).otherwise(
        F.concat(F.lit("id "), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    )
    joined = digests.withColumn("_group", key).join(groups, "_group", "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        "_id", "_row", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), "_sha"
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False
) -> DataFrame:
    """The group of every row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after each run of white space becomes one space; null
    counts as empty. ``keep_id`` is the smallest id of the group and ``group_size`` its number of rows.
    ``text_sha256`` is null for rows that left the refinement early, unless ``digest_all`` asks for it.

    Rows that repeat an id and a text are in one group and all marked kept; null ids are never smallest
    unless a group has no other, and then stay null. Other columns are ignored; an empty table gives none.
    """
    found = _grouped(docs, id_col, text_col, prefix_chars, digest_all)
    return found.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256")
    )


def keep_first_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeating an id and a text, one stays.

    Only rows that share length and prefix with others are hashed in full, and once.
    """
    names, row = docs.columns, F.xxhash64(whole_text(text_col))
    found = durable(_grouped(docs, id_col, text_col, prefix_chars, False), "dedup-rows")
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    stays = without(docs, [F.col(id_col), row], found.filter(~kept).select("_id", "_row"))
    several = found.filter(
        kept & (F.col("group_size") > 1)
    ).groupBy("_id", "_sha").agg(F.count("*").alias("_times")).filter("_times > 1")
    # only the id that a group keeps can be repeated here, so a hash has one row in ``several``
    again = found.join(
        several.select("_sha", F.col("_id").alias("_same")), "_sha"
    ).filter(F.col("_id").eqNullSafe(F.col("_same")))
    again = durable(
        again.select(
            F.col("_id").alias("__fw_id"), F.col("_row").alias("__fw_row"), F.col("_sha").alias("__fw_sha")
        ).distinct(),
        "repeated-rows"
    )
    if again.isEmpty():
        return stays
    single = without(stays, [F.col(id_col), row], again.select("__fw_id", "__fw_row"))
    both = stays.withColumn("__fw_own", row).join(
        again, F.col(id_col).eqNullSafe(F.col("__fw_id")) & (F.col("__fw_own") == F.col("__fw_row"))
    )
    return single.unionByName(both.dropDuplicates(["__fw_id", "__fw_sha"]).select(*names))
