"""SimHash near-duplicates through BK-trees.

Copies collapse first: one row per distinct fingerprint goes on. Fingerprints within ``radius`` bits agree
on at least one of a few masks, and each masked value selects a shard, so only the trees of a fingerprint's
own shards are asked for its neighbours. The first masks have so few bits that a shard holds about a
thousand fingerprints, whatever the table's size. A shard's fingerprints form one BK-tree, children keyed by
their integer Hamming distance to the parent, built in the task that all its queries go to; a search follows
only the edges within the radius. Shards of more than ``shard_size`` fingerprints go on to the next level,
whose masks have more bits, down to shards that can't be larger. So a fingerprint meets a bounded number of
trees of bounded size. A shard passes on a spanning forest of the links it finds, not all pairs; components
come from contracting that graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, whole_text, without

SHINGLE, RADIUS, SHARD_SIZE, SEED = 3, 2, 4096, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    parts = [words[i:] for i in range(min(shingle, len(words)))] if len(words) >= shingle else [[b" ".join(words)]]
    votes, count = np.zeros(64, dtype=np.int64), 0
    shingles = map(b" ".join, zip(*parts))
    while True:
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for _, s in zip(range(1 << 16), shingles)), dtype="<u8")
        if not len(hashes):
            break
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


class BKTree:
    """64-bit integers under Hamming distance; ``children[node, distance]`` is the child at that distance, or -1."""

    def __init__(self, values: np.ndarray):
        self.values = values = np.unique(values.astype(np.uint64))
        self.children = np.full((max(1, len(values)), 65), -1, dtype=np.int32)
        self.followed = 0
        # all values start at the root and sink together: of those at the same distance from their node the
        # first becomes the child, the others go on from it
        node = np.zeros(len(values), dtype=np.int64)
        left = np.arange(1, len(values))
        while len(left):
            at, d = node[left], np.bitwise_count(values[left] ^ values[node[left]]).astype(np.int64)
            _, first = np.unique(at * 65 + d, return_index=True)
            free = first[self.children[at[first], d[first]] < 0]
            self.children[at[free], d[free]] = left[free]
            node[left] = self.children[at, d]
            left = left[node[left] != left]

    def within(self, queries: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, values) by their places, at most ``radius`` bits apart; ``followed`` counts the edges taken."""
        steps = np.arange(-radius, radius + 1)
        for start in range(0, len(queries) if len(self.values) else 0, block):
            ask = np.arange(start, min(start + block, len(queries)))
            node = np.zeros(len(ask), dtype=np.int64)
            while len(ask):
                d = np.bitwise_count(queries[ask] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                yield ask[near], node[near]
                edge = d[:, None] + steps
                child = np.where((edge >= 1) & (edge <= 64), self.children[node[:, None], np.clip(edge, 0, 64)], -1)
                at, way = np.nonzero(child >= 0)
                ask, node = ask[at], child[at, way].astype(np.int64)
                self.followed += len(ask)


def _forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its component) of the distinct values that aren't their component's smallest."""
    tree = BKTree(values)
    label = np.arange(len(tree.values))
    for a, b in tree.within(tree.values, radius):
        while len(a):
            a, b = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(label, a, b)
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return tree.values[moved], tree.values[label[moved]]


def _bits(value: int) -> int:
    """An unsigned 64-bit value as Spark's signed long."""
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_bits(fingerprint(text.as_py(), shingle)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")
    ).mapInArrow(digest, "doc_id long, fp long")


def shard_masks(radius: int, blocks: int, bits: int = 64) -> list[int]:
    """Bit masks of which fingerprints within ``radius`` bits agree on at least one.

    The 64 bits fall into blocks, of which ``radius`` changes spoil ``radius`` at most; a mask leaves that
    many out, and uses the lowest ``bits`` of every other block.
    """
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << min(bits, stop - start)) - 1) << start for start, stop in zip(cuts, cuts[1:])]
    return sorted({sum(kept) for kept in combinations(parts, blocks - radius)})


def mask_levels(radius: int, count: int, shard_size: int) -> list[list[int]]:
    """The masks of each level. The first suit ``count`` fingerprints; under the last, a shard has 4,096 values at most."""
    if not 0 <= radius <= 3:
        raise ValueError("fingerprints link at 0 to 3 differing bits")
    if not radius:
        return [[(1 << 64) - 1]]
    few = max(0, (4 * count // shard_size).bit_length())
    blocks, levels = radius + 1, [shard_masks(radius, radius + 1, few)] if few < 64 // (radius + 1) else []
    while True:
        levels.append(shard_masks(radius, blocks))
        if 64 - min(m.bit_count() for m in levels[-1]) <= 12:
            return levels
        blocks = blocks + blocks // 2


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links (a, b), b < a, that span the components of distinct fingerprints ``fp`` within ``radius`` bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []

        def links() -> pa.RecordBatch:
            a, b = _forest(np.concatenate(own), radius) if own else (np.zeros(0, np.uint64),) * 2
            own.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            band, value, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "value", "fp"))
            new = np.flatnonzero((band[1:] != band[:-1]) | (value[1:] != value[:-1])) + 1
            for start, stop in zip([0, *new.tolist()], [*new.tolist(), len(fp)]):
                if stop > start and (key := (int(band[start]), int(value[start]))) != now:
                    yield links()
                    now = key
                own.append(fp[start:stop].view(np.uint64))
        yield links()

    levels = mask_levels(radius, prints.count(), shard_size)
    alive, found = prints.select("fp"), []
    for k, masks in enumerate(levels):
        keys = F.array(
            *[
                F.struct(F.lit(band).alias("band"), F.col("fp").bitwiseAND(F.lit(_bits(mask))).alias("value")) for band,
                mask in enumerate(masks)
            ]
        )
        keyed = alive.select("fp", F.explode(keys).alias("key")).select("key.band", "key.value", "fp")
        sizes = durable(keyed.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "shard-sizes")
        fits = F.col("n") <= shard_size if k + 1 < len(levels) else F.lit(True)
        shards = keyed.join(sizes.filter(fits), ["band", "value"]).select("band", "value", "fp")
        found.append(
            shards.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(
                search, "a long, b long"
            )
        )
        crowded = sizes.filter(~fits)
        if crowded.isEmpty():
            break
        alive = durable(
            keyed.join(crowded.select("band", "value"), ["band", "value"]).select("fp").distinct(), "crowded-shards"
        )
    links = found[0]
    for part in found[1:]:
        links = links.unionByName(part)
    return links


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the component's smallest node.

    Alternates large-star and small-star contraction until nothing changes; each round is a written table.
    Each round's rows are at most the links, and a node with many neighbours is a grouped minimum.
    """
    edges = durable(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, for Spark can split the partition of a hub only between plain scans
        low = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        # large star: larger neighbours of a node move to the smallest of its neighbourhood
        large = durable(
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label
        )
        # small star: smaller neighbours of a node, and itself, move to the smallest of them
        least = durable(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m"
        )
        after = durable(small.select(F.col("s.x").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), label)
        moved = after.count() != edges.count() or after.join(edges, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        if not moved:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    shard_size: int = SHARD_SIZE
) -> DataFrame:
    """Every row's class: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable through links).

    Fingerprints link at ``radius`` or fewer differing bits, equal ones always. Texts without words have
    fingerprint zero and link like any other. Repeated rows get the same class each; null ids are
    never a component's id unless it has no other. Other columns are ignored; an empty table gives no rows.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return fingerprint_classes(prints, radius, shard_size).select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(doc_id, fp) with ``component_id``; ``prints`` is a written table."""
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(fingerprint_links(distinct.select("fp"), radius, shard_size), "fingerprint-links")
    rooted = durable(
        distinct.join(found, distinct["fp"] == found["node"], "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "fingerprint-roots"
    )
    firsts = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    classes = durable(rooted.join(firsts, "root").select("fp", "component_id"), "fingerprint-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def not_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(doc_id) of the documents that aren't the smallest id of their component, a written table.

    Rows that repeat an id are one document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    classes = fingerprint_classes(durable(fingerprints(rows, shingle=shingle), "fingerprints"), radius)
    other = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    return durable(classes.filter(other).select("doc_id"), "near-copies")


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns: of each component the smallest id stays."""
    return without(docs, [F.col(id_col).cast("long")], not_representatives(docs, id_col, text_col, shingle, radius))
