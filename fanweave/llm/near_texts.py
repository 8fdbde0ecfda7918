"""Near copies by their texts: MinHash bands propose, sets of word shingles decide.

SimHash bits can't serve here: texts of similarity 0.8 differ in about ten of 64 bits. Two sets share a
minimum with the probability of their similarity s, so they share one of ``BANDS`` bands with
1 - (1 - s ** PER_BAND) ** BANDS: 99.96% at 0.8. Documents that share a band are compared in blocks by their
whole sets. The bands take turns: most copies go with the first two, and later ones send only what a
document that is left could still be similar to, so a set travels a few times, not once for every band.
Texts stay where they are: what is written and shuffled are ids, band keys and the sets of documents that share a band.
A band of more documents than a block is dealt anew in rounds, each without the documents that
the one before dropped, so a dense cluster shrinks at once; what doesn't shrink is compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, key_filter, maybe_in, text_slices, whole_text, without
from .recurrent import block_words

WORDS, LEAST_SIMILARITY = 5, 0.8
BANDS, PER_BAND, BLOCK = 20, 5, 128
#: Where each turn of bands begins; the last ends with BANDS.
TURNS = (0, 2, 8)

_DRAWN = np.random.default_rng(17)
_XOR = _DRAWN.integers(0, 1 << 64, BANDS * PER_BAND, dtype=np.uint64)
_ODD = _DRAWN.integers(0, 1 << 64, BANDS * PER_BAND, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted hashes (64 bits) of its word shingles; a shorter text is one shingle, one without words has none."""
    words = block_words(texts, 1)
    hashes = words.hashes.view(np.uint64)[words.codes]
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size if n >= size else 0):
        rolled = _mixed(rolled + hashes[k:n - size + 1 + k])
    start = 0
    for stop in words.stops.tolist():
        if stop - start >= size:
            yield np.unique(rolled[start:stop - size + 1])
        elif stop > start:
            one = np.full(1, size, dtype=np.uint64)
            for h in hashes[start:stop]:
                one = _mixed(one + h)
            yield one
        else:
            yield np.zeros(0, dtype=np.uint64)
        start = stop


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys under which a set meets others, one per band."""
    least = np.full(BANDS * PER_BAND, (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[k:k + 4096] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, PER_BAND).T:
        key = _mixed(key * _ODD[:BANDS] + part)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return both >= least * (len(a) + len(b) - both)


def near_copies(
    docs: DataFrame, least_similarity: float = LEAST_SIMILARITY, block: int = BLOCK, besides: DataFrame | None = None
) -> DataFrame:
    """(doc_id) of the documents similar enough to one of a smaller id; ``docs`` has doc_id and text, null ids count as the largest.

    None of those left shares a band with another that it is similar to. Documents of ``besides`` (doc_id), a
    written table, take no part.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                keys = [band_keys(s) if len(s) else () for s in shingle_sets(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "keys"]
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):  # half of each hash serves to compare sets, and takes half the room
                sets = [
                    np.unique(s >> np.uint64(32)).astype("<u4").tobytes() for s in shingle_sets(batch.column("text"))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(sets, pa.binary())], names=["row", "shingles"]
                )

    signed = durable(rows.mapInArrow(sign, "doc_id long, row long, keys array<long>"), "band-keys")
    if besides is not None:
        signed = without(signed, [F.col("doc_id")], besides)
    keyed = signed.select("doc_id", "row", F.posexplode("keys").alias("band", "key"))
    shared = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-bands")
    places = durable(
        _maybe_among(keyed, shared, "key").join(shared, "key").select("band", "key", "doc_id", "row").distinct(),
        "band-places"
    )
    sets = _maybe_among(rows, places, "row").select("row", "text").mapInArrow(cut, "row long, shingles binary")
    if not signed.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        sets = sets.dropDuplicates(["row"])  # only repeated rows need it, and it shuffles all sets
    sets = durable(sets, "shingle-sets")

    gone = None
    for start, stop in zip(TURNS, (*TURNS[1:], BANDS)):
        own = places.filter(F.col("band").between(start, stop - 1)).select("key", "doc_id", "row")
        if gone is None:
            gone = _similar_to_smaller(own.withColumn("alive", F.lit(True)), sets, least_similarity, block)
            continue
        dropped = gone.distinct().select(F.col("doc_id").alias("_gone"), F.lit(True).alias("_dropped"))
        rank = F.coalesce("doc_id", F.lit((1 << 63) - 1))
        marked = durable(
            own.join(dropped, F.col("doc_id").eqNullSafe(F.col("_gone")), "left").select(
                "key", "doc_id", "row", F.col("_dropped").isNull().alias("alive"), rank.alias("rank")
            ),
            "band-places"
        )
        # a key matters if one that is left has a smaller partner, and of those that went only such partners do
        asks = durable(
            marked.groupBy("key").agg(
                F.max(F.when(F.col("alive"), F.col("rank"))).alias("_last"), F.min("rank").alias("_first")
            ).filter("_last > _first").select("key", "_last"),
            "asking-bands"
        )
        own = durable(
            marked.join(asks, "key").filter("rank <= _last").select("key", "doc_id", "row", "alive"), "band-places"
        )
        gone = gone.unionByName(_similar_to_smaller(own, sets, least_similarity, block))
    return gone.distinct()


def _maybe_among(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` but for most of those whose ``key`` isn't in ``others``; they stay where they are."""
    return maybe_in(df, F.col(key), key_filter(others.select(key), key), "_maybe").filter("_maybe").drop("_maybe")


def _similar_to_smaller(places: DataFrame, sets: DataFrame, least_similarity: float, block: int) -> DataFrame:
    """(doc_id) of those that are ``alive`` and similar to one of a smaller id under the same key; ``places``: key, doc_id, row, alive."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[int | None] = set()

        def settle(group: list[tuple[int | None, bool, np.ndarray]]) -> None:
            group.sort(key=lambda x: (x[0] is None, x[0] or 0))
            for i, (doc, asks, own) in enumerate(group):
                if asks and doc not in gone and any(
                    other is not None and other != doc and similar(own, theirs, least_similarity) for other, _,
                    theirs in group[:i]
                ):
                    gone.add(doc)

        now, group = None, []
        for batch in batches:
            for key, part, with_part, doc, asks, shingles in zip(
                *(batch.column(c) for c in ("key", "part", "with_part", "doc_id", "alive", "shingles"))
            ):
                if (own := (key.as_py(), part.as_py(), with_part.as_py())) != now:
                    settle(group)
                    now, group = own, []
                group.append((doc.as_py(), asks.as_py(), np.frombuffer(shingles.as_py(), dtype="<u4")))
        settle(group)
        yield pa.RecordBatch.from_arrays([pa.array(list(gone), pa.int64())], names=["doc_id"])

    gone, crossed, turn = None, False, 0
    while True:
        sizes = durable(places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "band-sizes")
        parts = F.ceil(F.col("n") / block).cast("int")
        dealt = places.join(sizes, "key").withColumn("parts", parts).withColumn(
            "own", F.pmod(F.xxhash64(F.lit(turn), "row"), F.col("parts")).cast("int")
        )
        sent = dealt.withColumns({"part": F.col("own"), "with_part": F.col("own")})
        if crossed:  # every two blocks of a band meet
            sent = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
                {"part": F.least("own", "_other"), "with_part": F.greatest("own", "_other")}
            )
        names = ["key", "part", "with_part"]
        blocks = sent.join(_maybe_among(sets, places, "row"), "row").select(
            *names, "doc_id", "alive", "shingles"
        ).repartition(*names).sortWithinPartitions(*names)
        found = durable(blocks.mapInArrow(compare, "doc_id long").distinct(), "near-texts")
        gone = found if gone is None else gone.unionByName(found)
        crowded = sizes.filter(F.col("n") > block)
        before = crowded.agg(F.sum("n")).first()[0] or 0
        if crossed or not before:
            return gone
        dropped = found.withColumnRenamed("doc_id", "_gone")
        places = durable(
            places.join(crowded.select("key"), "key").join(
                dropped, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti"
            ),
            "band-places"
        )
        crossed, turn = places.count() > 0.8 * before, turn + 1


def keep_dissimilar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_similarity: float = LEAST_SIMILARITY,
    besides: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document isn't similar to one of a smaller id.

    Documents of ``besides`` (doc_id), a written table, go too, and others may be similar to them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    gone = near_copies(rows, least_similarity, besides=besides)
    if besides is not None:
        gone = gone.unionByName(besides)
    return without(docs, [F.col(id_col).cast("long")], durable(gone, "near-copies"))
