import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fanweave.llm.packing import vocabulary
from fanweave.llm.registry import oracle_sql, queries

from .fixtures import SCHEMA, documents, frame
from .test_dedup import brute_components, brute_fingerprint, norm
from .test_near_texts import jaccard
from .test_text import brute_contamination, labelled


def corpus(spark):
    docs, _ = labelled(spark)
    rng = random.Random(21)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(25))
    words = [f"n{rng.randrange(10**5)}" for _ in range(400)]
    near = [
        (310 + k, " ".join(words[:a] + ["Y"] * (k > 0) + words[a + 1:]) + " the and ing " * 9, "en", "s3") for k,
        a in enumerate((9, 90, 200, 390))
    ]
    extra = [
        (300, docs[4][1], "fr", "s1"), (301, docs[4][1].replace(" ", "  "), "fr", "s1"),
        (302, docs[6][1].upper(), "en", "s1"), (303, docs[8][1] + " " + item, "de", "s2"), *near, (304, "", "en", "s1"),
        (305, None, None, None), (306, "12 34 !!", "en", "s1"), (0, docs[0][1], "en", "hot")
    ]
    return docs + extra, [(1, item), (2, "unseen words of an item")]


def stand_for_groups(docs, radius):
    """The smallest id of each document's component."""
    prints = {i: brute_fingerprint(t) for i, t in docs}
    root, low = brute_components(sorted(set(prints.values())), radius), {}
    for i, p in prints.items():
        low[root[p]] = min(i, low.get(root[p], i))
    return {i: low[root[p]] for i, p in prints.items()}


def test_stages_match_brute_force(spark, tmp_path):
    rows, items = corpus(spark)
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before
        seen.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr))
    identified, deduped, apart, clean = seen
    assert Counter(identified) == Counter((i, t) for i, t, *_ in rows if re.search("[a-z]", t or "", re.I))
    first = {}
    for i, t in identified:
        first[norm(t)] = min(i, first.get(norm(t), i))
    assert deduped == sorted(
        {(i, t) for i, t in identified if first[norm(t)] == i and (i, t) in set(identified)}, key=repr
    )
    narrow = stand_for_groups(deduped, 2)
    stand = [(i, t) for i, t in deduped if narrow[i] == i]
    # of those that stand for their group, texts of five-word similarity 0.8 or more to one of a smaller id go
    assert apart == sorted(
        ((i, t) for i, t in stand if not any(j < i and jaccard(t, o) >= 0.8 for j, o in stand)), key=repr
    )
    assert {i for i, _ in apart} & {310, 311, 312, 313} == {310}
    assert {i for i, _ in clean} == {i for i, _ in apart} - {
        r[0] for r in brute_contamination(apart, items) if r[4]
    } and len(clean) == len(set(clean))
    assert 303 not in {i for i, _ in clean} and 302 not in {i for i, _ in apart} and 300 not in {i for i, _ in deduped}

    exact = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for i, t in clean:
        own = np.array([*exact.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((i, k, zlib.crc32(own[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(own), 4096)))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want


@pytest.mark.parametrize("rows", [[], documents()])
def test_odd_documents_pass_all_stages(spark, tmp_path, rows):
    """No rows at all; and nulls, repeated rows, used ids, odd texts and columns that are named as the stages' own."""
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(packed) <= bool(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:  # as if every language were told
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame(spark, rows).columns
    kept = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    assert len(kept) == len(set(kept)) == len({t for _, t in kept})
    assert all(t in {norm(r[1]) for r in rows} for _, t in kept) and bool(kept) == bool(rows)


def test_registry():
    assert [sum(n.startswith(f"op{k}_") for n in queries()) for k in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"
    ]
