"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words: a text becomes the numbers of its words in the benchmark's vocabulary, and every
window of a benchmark item is a pattern. Block shift tables over ``BLOCK`` consecutive words say how far the
search may jump; a block with shift 0 selects the bucket of windows that end in it, their first block thins
the bucket, and a direct comparison of all words confirms. Windows of different lengths have tables of
their own. All tables are sorted arrays over one row of the benchmark's words, so they take some fifty bytes
a word, and a search moves through many pieces of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_slices, whole_text, without

WINDOW = 13
BLOCK = 2
#: Benchmark text whose tables one pass broadcasts; a larger benchmark takes several passes over the documents.
PASS_BYTES = 32 << 20

#: Bytes of words stay, A-Z become lower case, other ASCII becomes a space; all bytes from 128 on are in words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: maximal runs of characters that aren't ASCII punctuation, space or control."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def _places(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where ``values`` are in an array of distinct sorted ones, -1 if nowhere."""
    if not len(sorted_values):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


class ShiftTables:
    """Wu-Manber tables for the windows of one length that begin at ``starts`` in ``stream``, a row of word numbers."""

    def __init__(self, length: int, stream: np.ndarray, starts: np.ndarray, vocabulary: int, block: int = BLOCK):
        self.length, self.stream, self.block = length, stream, min(block, length)
        self.jump = length - self.block + 1
        self.base = np.int64(vocabulary + 1)
        keys = self._keys(stream)
        found, steps = [], []
        for end in range(self.block, length + 1):  # the block that ends ``length - end`` words before the window does
            found.append(np.unique(keys[starts + end - 1]))
            steps.append(np.full(len(found[-1]), length - end, dtype=np.int32))
        blocks, steps = np.concatenate(found), np.concatenate(steps)
        order = np.lexsort((steps, blocks))
        self.blocks, first = np.unique(blocks[order], return_index=True)
        self.steps = steps[order][first]
        # buckets: windows in order of their last block, then of their first
        last, head = keys[starts + length - 1], keys[starts + self.block - 1]
        self.tails, self.heads = np.unique(last), np.unique(head)
        both = _places(self.tails, last) * len(self.heads) + _places(self.heads, head)
        order = np.argsort(both, kind="stable")
        self.starts = starts[order]
        self.buckets, self.bucket_starts = np.unique(both[order], return_index=True)
        self.bucket_sizes = np.diff(self.bucket_starts, append=len(order))

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        """The block that ends at each place, -1 where one of its words isn't in the vocabulary."""
        if self.block == 1:
            return codes.astype(np.int64)
        out = np.full(len(codes), -1, dtype=np.int64)
        known = (codes[1:] >= 0) & (codes[:-1] >= 0)
        out[1:] = np.where(known, codes[:-1] * self.base + codes[1:], -1)
        return out

    def find(self, codes: np.ndarray, stops: np.ndarray, piece: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``codes``, start in ``stream``) of every occurrence; ``stops`` is where each document ends.

        Documents are searched in pieces of window ends, all side by side.
        """
        m, b, keys = self.length, self.block, self._keys(codes)
        begins = np.concatenate([[0], stops[:-1]]) + m
        pieces = np.maximum(0, -(-(stops - begins + 1) // piece))
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(begins, pieces) + number * piece
        last = np.minimum(np.repeat(stops, pieces), end + piece - 1)
        stopped: list[np.ndarray] = []
        while len(end):
            at = _places(self.blocks, keys[end - 1])
            step = np.where(at >= 0, self.steps[at], self.jump)
            stopped.append(end[step == 0])
            end = end + np.maximum(step, 1)
            going = end <= last
            end, last = end[going], last[going]
        ends = np.concatenate(stopped) if stopped else np.zeros(0, dtype=np.int64)
        tail, head = _places(self.tails, keys[ends - 1]), _places(self.heads, keys[ends - m + b - 1])
        ends, tail, head = (x[(tail >= 0) & (head >= 0)] for x in (ends, tail, head))
        bucket = _places(self.buckets, tail * len(self.heads) + head)
        ends, bucket = ends[bucket >= 0], bucket[bucket >= 0]
        mine, theirs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for part in np.array_split(np.arange(len(ends)), 1 + len(ends) // 4096):
            sizes = self.bucket_sizes[bucket[part]]
            own = np.repeat(ends[part] - m, sizes)
            rank = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            window = self.starts[np.repeat(self.bucket_starts[bucket[part]], sizes) + rank]
            same = np.ones(len(own), dtype=bool)
            for k in range(m):
                same &= codes[own + k] == self.stream[window + k]
            mine.append(own[same])
            theirs.append(window[same])
        return np.concatenate(mine), np.concatenate(theirs)


class Patterns:
    """All windows of some items: the vocabulary, the row of their words, and shift tables by window length."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, block: int = BLOCK):
        self.vocabulary: dict[bytes, int] = {}
        codes, sizes, ids = [], [], []
        for item, text in items:
            words = words_of(text)
            if words:
                codes.append(
                    np.fromiter(
                        (self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), dtype=np.int64,
                        count=len(words)
                    )
                )
                sizes.append(len(words))
                ids.append(item)
        self.items, sizes_ = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)
        self.offsets = np.cumsum(sizes_) - sizes_
        stream = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        self.tables = []
        for length in sorted({min(window, n) for n in sizes}):
            own = np.flatnonzero(np.minimum(sizes_, window) == length)
            counts = sizes_[own] - length + 1
            starts = np.repeat(self.offsets[own], counts) + np.arange(counts.sum()) - np.repeat(
                np.cumsum(counts) - counts, counts
            )
            self.tables.append(ShiftTables(length, stream, starts, len(self.vocabulary), block))

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
        """Per text the number of words, the word ranges that windows cover and the items found."""
        rows = [self.codes(words_of(t)) for t in texts]
        sizes = np.array([len(x) for x in rows], dtype=np.int64)
        stops = np.cumsum(sizes)
        codes = np.concatenate([*rows, np.zeros(0, dtype=np.int64)])
        hits: dict[int, set[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for table in self.tables:
            mine, theirs = table.find(codes, stops)
            doc = np.searchsorted(stops, mine, side="right")
            item = self.items[np.searchsorted(self.offsets, theirs, side="right") - 1]
            for d, at in np.unique(np.stack([doc, mine - (stops - sizes)[doc]], 1), axis=0).tolist():
                hits.setdefault(d, set()).add((at, at + table.length))
            for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
                items.setdefault(d, set()).add(i)
        for d, n in enumerate(sizes.tolist()):
            yield n, _joined(hits.get(d, ())), sorted(items.get(d, ()))


def _joined(ranges) -> list[tuple[int, int]]:
    """The union of half-open ranges, as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "doc_id long, text_hash long, n_words long, starts array<int>, ends array<int>, items array<long>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))
    ]
)


def _search(rows: DataFrame, patterns: Patterns, hits_only: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(patterns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "_text"):
                found = list(shared.value.search(batch.column("_text").to_pylist()))
                own = [
                    [n for n, _, _ in found], *([[r[k] for r in hits] for _, hits, _ in found] for k in (0, 1)),
                    [items for _, _, items in found]
                ]
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text_hash"),
                        *(pa.array(x, f.type) for x, f in zip(own, list(_ARROW)[2:]))
                    ],
                    schema=_ARROW
                )
                yield out.filter(pa.array([bool(items) for items in own[3]], pa.bool_())) if hits_only else out

    return rows.mapInArrow(search, _FOUND)


def benchmark_passes(
    benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int
) -> Iterator[list[tuple[int, str]]]:
    """The items, in groups of about ``pass_bytes`` of text; the driver holds one group at a time."""
    items = benchmark.select(
        F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")
    ).filter("i is not null and t is not null")
    group, held = [], 0
    for row in items.toLocalIterator():
        group.append((row["i"], row["t"]))
        held += len(row["t"].encode())
        if held >= pass_bytes:
            yield group
            group, held = [], 0
    if group:
        yield group


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The first pass's rows, each with what later passes found for the same document and text."""
    more = parts[1]
    for part in parts[2:]:
        more = more.unionByName(part)
    more = more.distinct().groupBy("doc_id", "text_hash").agg(  # a row per pass
        F.collect_list(F.struct("starts", "ends", "items")).alias("more")
    )
    more = more.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    both = parts[0].join(
        more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left"
    ).drop("_doc", "_hash")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, items = [], [], []
            for row in batch.select(["starts", "ends", "items", "more"]).to_pylist():
                every = [row, *(row["more"] or ())]
                hits = _joined(h for r in every for h in zip(r["starts"], r["ends"]))
                starts.append([a for a, _ in hits])
                ends.append([b for _, b in hits])
                items.append(sorted({i for r in every for i in r["items"]}))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "text_hash", "n_words")),
                    *(pa.array(x, f.type) for x, f in zip((starts, ends, items), list(_ARROW)[3:]))
                ],
                schema=_ARROW
            )

    return both.select(*_ARROW.names, "more").mapInArrow(merge, _FOUND)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """Benchmark occurrences in every row: id, ``n_words``, ``n_hit``, ``items`` (sorted), ``starts``, ``ends``, ``text_hash``, ``contaminated``.

    ``starts`` and ``ends`` are the disjoint word ranges that benchmark windows cover; ``contaminated`` means
    that they cover a twentieth of the words or more. Null texts, and items without words or id, have no
    windows. Repeated rows each get their result; other columns are ignored; empty tables give no hits.

    A benchmark of up to ``pass_bytes`` takes one scan of the documents and no shuffle. A larger one takes a
    scan for each ``pass_bytes`` of it; every pass is written once, those after the first as their hits only.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash"),
        whole_text(text_col).alias("_text")
    )
    groups = benchmark_passes(benchmark, item_col, item_text_col, pass_bytes)
    found = _search(rows, Patterns(next(groups, []), window), False)
    parts = [durable(_search(rows, Patterns(group, window), True), "hits") for group in groups]
    if parts:
        found = _merged([durable(found, "hits"), *parts])
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    out = found.select(
        F.col("doc_id").alias(id_col), "text_hash", "n_words", hit.alias("n_hit"), "items", "starts", "ends"
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def keep_uncontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    found = contamination(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark
    )
    gone = durable(found.filter("contaminated").select("doc_id", "text_hash"), "contaminated")
    return without(docs, [F.col(id_col).cast("long"), F.xxhash64(whole_text(text_col))], gone)
