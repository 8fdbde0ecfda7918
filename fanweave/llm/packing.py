"""Best-fit-decreasing packing of tokenised documents into fixed-length training sequences.

Tokenising yields the pieces, each with its rank among its task's pieces of the same length. Only the
histogram of piece lengths (``capacity`` rows at most) reaches the driver, where best fit decreasing is
carried out for a whole run of equal lengths at a time: a segment tree over remaining capacities finds
the tightest open bins in logarithmic time, and spans of bin numbers stand for the bins. The resulting
plan maps (length, rank) to (sequence, offset); executors apply it to the pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, task_number, text_slices, whole_text

CAPACITY = 4096
END_ID = 1
#: Distinct white-space-free strings whose ids a worker remembers.
CACHE = 500_000


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity, each with its number of open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of ``length`` or more that has an open bin."""
        at = length + self.size
        if self.counts[at]:
            return length
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit decreasing over ``histogram`` (length -> pieces), in runs of equal lengths.

    Rows of (length, first rank, first sequence, offset): the pieces of that length from that rank up to
    the next row's go to consecutive sequences, all at that offset. Filling a bin makes it the tightest
    for the next piece of the same length as long as that fits, so a bin is filled before the next one.
    """
    tree, spans, plan, opened = CapacityTree(capacity), {}, [], 0

    def take(room: int, bins: int) -> list[tuple[int, int]]:
        tree.add(room, -bins)
        out, queue = [], spans[room]
        while bins:
            first, n = queue.popleft()
            if n > bins:
                queue.appendleft((first + bins, n - bins))
                n = bins
            out.append((first, n))
            bins -= n
        return out

    def put(room: int, parts: list[tuple[int, int]]) -> None:
        spans.setdefault(room, deque()).extend(parts)
        tree.add(room, sum(n for _, n in parts))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                bins = -(-left // (capacity // length))
                put(capacity, [(opened, bins)])
                opened += bins
                room = capacity
            fits = room // length
            full = min(left // fits, tree.counts[room + tree.size])
            for bins, copies in ((full, fits), (int(not full), left % fits if left < fits else 0)):
                if bins and copies:
                    parts = take(room, bins)
                    for k in range(copies):
                        for first, n in parts:
                            plan.append((length, rank, first, capacity - room + k * length))
                            rank += n
                    left -= bins * copies
                    put(room - copies * length, parts)
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 4)


#: Rows of the plan that one broadcast holds, 32 bytes each.
PLAN_ROWS = 1 << 20
#: Characters on which Unicode normalisation and lower-casing act one by one.
_PLAIN = re.compile("[\x21-\x7eÀ-įı-ſ]{1,200}")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class ChunkEncoder:
    """Ids of white-space-free strings under the vocabulary file, remembered for frequent ones.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    strings in order. Strings of plain letters, digits and signs go through the same vocabulary in
    tiktoken, which merges by the same ranks about ten times faster; all others through the tokenizer itself.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact, self.most = Tokenizer.from_file(path), cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith("</w>")
                ranks[bytes(byte_of[c] for c in token.removesuffix("</w>")) + b" " * ends] = rank
        # a word's end is written as a space, which no word holds
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]* ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 3, dtype=bool)
        self.ends[[i for b, i in ranks.items() if b.endswith(b" ")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.int32)
        self.starts, self.sizes, self.used = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64), 0

    def _store(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(chunks) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[first:first + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:first + len(chunks)] = sizes
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.used += len(ids)

    def learn(self, chunks: list[str]) -> np.ndarray:
        """The numbers under which the ids of ``chunks`` are stored; may forget what was stored before."""
        if len(self.known) + len(chunks) > self.most:
            self.clear()
        known = self.known
        new = [x for x in chunks if x not in known]
        plain, words = [], []
        for x in new:
            if _PLAIN.fullmatch(x) and "<|" not in x:
                parts = _PARTS.findall(x.lower())
                plain.append((x, len(parts)))
                words.extend(parts)
        if plain:
            ids = np.array(self.fast.encode_ordinary(" ".join(words) + " "), dtype=np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1  # after the last id of each word
            stops = ends[np.cumsum([n for _, n in plain]) - 1]
            self._store([x for x, _ in plain], ids, np.diff(stops, prepend=0))
        odd = [x for x in new if x not in known]
        if odd:
            found = [self.exact.encode(x, add_special_tokens=False).ids for x in odd]
            self._store(
                odd, np.array([i for x in found for i in x], dtype=np.int32),
                np.array([len(x) for x in found], dtype=np.int64)
            )
        return np.fromiter(map(known.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        chunks = coded.dictionary.to_pylist()
        empty = [i for i, x in enumerate(chunks) if not x]
        numbers = self.learn(chunks)
        at = numbers[coded.indices.to_numpy()]
        starts, sizes = self.starts[at], self.sizes[at]
        if empty:
            sizes[np.isin(coded.indices.to_numpy(), empty)] = 0
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts - ends + sizes, sizes)
        return self.flat[take], np.concatenate([[0], ends])[offsets[1:]]


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def chunk_encoder(path: str, cache: int = CACHE) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = ChunkEncoder(path, cache)
    return _ENCODERS[path, cache]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID
) -> DataFrame:
    """The pieces of every row: doc_id, piece, start, length, ids_crc32, with task and rank_in_task.

    A document is its ids and then ``end_id``; longer ones are cut every ``capacity`` ids.
    ``rank_in_task`` counts the task's pieces of the same length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = chunk_encoder(path), task_number(), Counter()
        for whole in batches:
            for batch in text_slices(whole, most_bytes=4 << 20):
                ids, stops = encoder.encode(batch.column("text"))
                docs, pieces, starts, lengths, crcs, ranks, first = [], [], [], [], [], [], 0
                for doc, stop in zip(batch.column("doc_id").to_pylist(), stops.tolist()):
                    own = np.append(ids[first:stop], np.int32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        docs.append(doc)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part.tobytes()))
                        ranks.append(seen[len(part)])
                        seen[len(part)] += 1
                    first = stop
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs)),
                        pa.array([task] * len(docs), pa.int32()), pa.array(ranks, pa.int64())
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"]
                )
        encoder.clear()  # a worker that goes on to other work doesn't keep half a million strings

    return rows.mapInArrow(
        tokenise, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"
    )


def pack(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, most_plan_rows: int = PLAN_ROWS
) -> DataFrame:
    """Every piece and its place: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is a document of the end id alone. Repeated rows are packed each, as other
    documents of the same id; a null id stays null. Other columns are ignored; an empty table packs nothing.
    """
    pieces = durable(
        token_pieces(docs, path or vocabulary("word_bpe_49k.json"), id_col, text_col, capacity, end_id), "pieces"
    )
    counts = durable(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {  # at most `capacity` rows
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    plan = best_fit_runs(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "task", "base")
    # as many rows as tasks times lengths, so it mustn't be broadcast
    ranked = pieces.join(bases.hint("merge"), ["length", "task"]).withColumn(
        "rank", F.col("base") + F.col("rank_in_task")
    )

    def placed(part: np.ndarray, stop: int | None) -> DataFrame:
        """The pieces whose place is in this part of the plan, which ends before the key ``stop``."""
        shared = pieces.sparkSession.sparkContext.broadcast(part)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            length, first, sequence, offset = shared.value.T
            keys = (length << 40) | first
            for batch in batches:
                key = (batch.column("length").to_numpy() << 40) | batch.column("rank").to_numpy()
                own = key >= keys[0] if stop is None else (key >= keys[0]) & (key < stop)
                batch, key = batch.filter(pa.array(own)), key[own]
                at = np.searchsorted(keys, key, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1], pa.array(sequence[at] + batch.column("rank").to_numpy() - first[at]),
                        pa.array(offset[at])
                    ],
                    names=[*batch.schema.names[:-1], "sequence_id", "offset"]
                )

        rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
        return rows.mapInArrow(
            place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
        )

    # one part as a rule; a plan of more rows is sent part by part
    parts = [plan[k:k + most_plan_rows] for k in range(0, max(1, len(plan)), most_plan_rows)]
    starts = [int((part[0, 0] << 40) | part[0, 1]) if len(part) else 0 for part in parts]
    if not len(plan):
        parts, starts = [np.zeros((1, 4), dtype=np.int64)], [0]
    out = placed(parts[0], *starts[1:2] or [None])
    for k in range(1, len(parts)):
        out = out.unionByName(placed(parts[k], starts[k + 1] if k + 1 < len(parts) else None))
    return out.withColumnRenamed("doc_id", id_col)
