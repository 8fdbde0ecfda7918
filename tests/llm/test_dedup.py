import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fanweave.llm.exact_dedup import exact_duplicates, keep_first_copies
from fanweave.llm.line_dedup import LineRuns, drop_repeated_lines
from fanweave.llm import simhash
from fanweave.llm.common import key_filter, maybe_in
from fanweave.llm.simhash import BKTree, components, fingerprint, fingerprint_links, keep_representatives, mask_levels, near_duplicates

from .fixtures import SCHEMA, documents, frame, plain, rows_of


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[norm(t)].append(i)
    out = []
    for i, t in docs:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_duplicates_match_brute_force(spark):
    docs = [(r[0], r[1]) for r in documents()]
    got = rows_of(
        exact_duplicates(frame(spark), digest_all=True), "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )
    assert got == brute_exact(docs)


def test_exact_duplicates_hash_only_survivors(spark):
    got = exact_duplicates(plain(spark, ["a b", "a\tb", "c", "dd"])).collect()
    assert {r["doc_id"]: r["text_sha256"] is not None for r in got} == {0: True, 1: True, 2: False, 3: False}
    assert {r["doc_id"]: r["keep_id"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_long_texts_that_share_length_and_prefix_differ(spark):
    a, b = "x" * 300_000 + "1", "x" * 300_000 + "2"
    assert {
        r["doc_id"]: r["group_size"] for r in exact_duplicates(plain(spark, [a, b, a])).collect()
    } == {0: 2, 1: 1, 2: 2}


def test_kept_rows_have_all_columns_and_no_repeats(spark):
    kept = keep_first_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    got = Counter((r["doc_id"], norm(r["text"])) for r in kept.collect())
    groups = defaultdict(list)
    for i, t, *_ in documents():
        groups[norm(t)].append(i)
    want = {(min((x for x in ids if x is not None), default=None), t) for t, ids in groups.items()}
    assert set(got) == want and set(got.values()) == {1}


@pytest.mark.parametrize(
    "operator", [exact_duplicates, keep_first_copies, near_duplicates, keep_representatives, drop_repeated_lines]
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_lines(docs, least_chars=40, least_docs=5):
    key = lambda line: "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r")
    )
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), set()) - {None}) >= least_docs and i != max(h))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_documents():
    long = [f"Line {k} is long enough to be looked at by the operator É" for k in range(6)]
    docs = []
    for i in range(30):
        lines = [f"own line of document {i} which also is quite long, as it happens"]
        lines += [
            (
                "  " + long[k].upper() if i % 2 else long[k] + "\t"
            ) if k < 3 else long[k] for k in range(6) if i % (k + 1) == 0
        ]
        docs.append((i, "\n".join(lines) + ("\n" if i % 4 == 0 else "")))
    return docs + [
        (30, None), (31, ""), (32, "\n\n"), (7, docs[7][1]), (7, docs[7][1]), (8, long[0]), (None, long[0]),
        (33, "\n".join(long * 400))
    ]


@pytest.mark.parametrize("batches,fan", [(1, 2), (4, 3), (7, 2)])
def test_line_dedup_matches_brute_force(spark, batches, fan):
    docs = line_documents()
    df = spark.createDataFrame(
        [(i, t, "x", "y") for i, t in docs], "doc_id long, text string, line string, docs string"
    )
    assert rows_of(
        drop_repeated_lines(df, batches=batches, fan=fan), "doc_id", "n_lines", "n_dropped", "kept_text"
    ) == brute_lines(docs)


def test_runs_count_a_line_over_all_batches_and_compact(spark):
    runs = LineRuns(spark, fan=2)
    for batch in ([(1, 1), (2, 1)], [(1, 2), (3, 2)], [(1, 3)], [(4, 4), (1, 5)]):
        runs.add(spark.createDataFrame(batch, "line long, doc long"))
    assert rows_of(runs.totals(), "line", "docs", "last") == [(1, 4, 5), (2, 1, 1), (3, 1, 2), (4, 1, 4)]
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert runs.runs()[0].filter("owned").count() == 4
    runs.close()


def test_the_anti_join_gives_every_line_one_owner(spark):
    runs = LineRuns(spark, fan=9)
    for batch in ([(1, 1), (2, 1)], [(1, 2), (3, 2)], [(1, 3), (3, 4)], [(1, 5)]):
        runs.add(spark.createDataFrame(batch, "line long, doc long"))
    owned = [sorted(r["line"] for r in run.filter("owned").collect()) for run in runs.runs()]
    assert owned == [[1, 2], [3], [], []]
    assert rows_of(runs.totals(), "line", "docs", "last") == [(1, 4, 5), (2, 1, 1), (3, 2, 4)]
    names = [name for level in runs.levels for name in level]
    runs.close()
    assert not any(spark.catalog.tableExists(name) for name in names)


@pytest.mark.parametrize("n", [10, 3_000, 200_000])
def test_key_filters_grow_with_their_keys(spark, n):
    keys = key_filter(spark.range(n).withColumnRenamed("id", "k"), "k")
    passed = maybe_in(spark.range(2 * n).withColumnRenamed("id", "k"), F.col("k"), keys, "maybe").filter("maybe")
    assert passed.filter(f"k < {n}").count() == n
    assert passed.filter(f"k >= {n}").count() <= max(1, n // 10)


def test_a_full_key_filter_clears_less_but_loses_nothing(spark):
    keys = key_filter(spark.range(100_000).withColumnRenamed("id", "k"), "k", most_bits=1 << 15)
    assert keys.bits == 1 << 15
    assert maybe_in(
        spark.range(100_000).withColumnRenamed("id", "k"), F.col("k"), keys, "maybe"
    ).filter("maybe").count() == 100_000


def brute_fingerprint(text, k=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < k else [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = {v: low if r == high else r for v, r in root.items()}
                    changed = True
    return root


def test_fingerprints():
    for _, text, *_ in documents():
        assert fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates_match_brute_force(spark):
    docs = [(r[0], r[1]) for r in documents()]
    prints = [brute_fingerprint(t) for _, t in docs]
    root = brute_components(sorted(set(prints)), 2)
    first = {}
    for (i, _), p in zip(docs, prints):
        first.setdefault(root[p], []).append(i)
    want = sorted(
        (
            (i, f"{p:016x}", min((x for x in first[root[p]] if x is not None), default=None)) for (i, _),
            p in zip(docs, prints)
        ),
        key=repr
    )
    assert rows_of(near_duplicates(frame(spark)), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("shard_size", [2, 40, 4096])
def test_links_span_components_when_shards_are_split(spark, shard_size):
    import random

    rng = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(25)} | {centre}
    values |= {v & ~0x3FFFFF | 5 for v in sorted(values)[:80]}  # a band that many share
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard_size=shard_size)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components(values, 2)
    mine = defaultdict(set)
    for v in values:
        s = v - (1 << 64) if v >> 63 else v
        mine[found.get(s, s)].add(v)
    theirs = defaultdict(set)
    for v, r in want.items():
        theirs[r].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_long_chains_contract(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


@pytest.mark.parametrize("bits,radius", [(12, 2), (64, 2), (16, 0), (10, 3)])
def test_bk_tree_finds_all_within(bits, radius):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << bits, 300, dtype=np.uint64)
    tree, asked = BKTree(values), rng.integers(0, 1 << bits, 60, dtype=np.uint64)
    got = sorted((int(a), int(tree.values[b])) for x, y in tree.within(asked, radius, block=7) for a, b in zip(x, y))
    assert got == sorted(
        (i, v) for i, q in enumerate(asked.tolist()) for v in set(values.tolist()) if (q ^ v).bit_count() <= radius
    )
    # a child's place is its distance to the parent, and every value but the root is one child
    kids = [(n, d, c) for n, row in enumerate(tree.children) for d, c in enumerate(row) if c >= 0]
    assert sorted(c for _, _, c in kids) == list(range(1, len(tree.values)))
    assert all((int(tree.values[n]) ^ int(tree.values[c])).bit_count() == d for n, d, c in kids)


def test_a_search_follows_few_edges():
    tree = BKTree(np.random.default_rng(4).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert sum(len(a) for a, _ in tree.within(tree.values, 2)) == 1000
    assert tree.followed < 100 * 1000  # of 999 edges that comparing with every value would take


def test_empty_trees_find_nothing():
    assert not list(BKTree(np.zeros(0, np.uint64)).within(np.arange(3, dtype=np.uint64), 2))


@pytest.mark.parametrize("radius,count", [(0, 9), (1, 10), (2, 10**6), (2, 10**12), (3, 10**5)])
def test_masks_leave_close_values_together_and_bound_the_last_shards(radius, count):
    import random

    rng = random.Random(3)
    levels = mask_levels(radius, count, 4096)
    assert all(64 - m.bit_count() <= 12 for m in levels[-1]) and len(levels[-1]) < 1000
    for masks in levels:
        for _ in range(200):
            change = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not change & m for m in masks)
    with pytest.raises(ValueError):
        mask_levels(4, 10, 4096)


def test_links_come_from_the_trees(spark, monkeypatch):
    """With trees that find nothing there are no links: no other path makes them."""
    values = spark.createDataFrame([(v,) for v in (1, 3, 7, (1 << 40) - 1)], "fp long")
    assert components(fingerprint_links(values)).count() == 2
    shards = mask_levels(2, 4, 4096)[0]
    assert len(shards) == 1  # so few fingerprints share one shard, whose tree has all of them
    monkeypatch.setattr(simhash, "_forest", lambda values, radius: (np.zeros(0, np.uint64),) * 2)
    assert fingerprint_links(values).count() == 0


def test_one_document_of_each_group_stays(spark):
    df = plain(spark, ["a b c d", "A  b c d", "else where now", None, ""])
    assert rows_of(keep_representatives(df), "doc_id") == [(0,), (2,), (3,)]


def test_only_rows_with_company_are_hashed_in_the_filter(spark):
    rows = [
        (1, "a b"), (2, "a  b"), (1, "a\tb"), (1, "a b"), (3, "other"), (None, "c d"), (None, "c  d"), (4, None),
        (4, "")
    ]
    kept = keep_first_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(
        (r["doc_id"] or 0, norm(r["text"])) for r in kept.collect()
    ) == [(0, "c d"), (1, "a b"), (3, "other"), (4, "")]
