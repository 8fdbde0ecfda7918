import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
from fanweave.llm.near_texts import BANDS, keep_dissimilar, near_copies

from .fixtures import SCHEMA, plain, rows_of


def jaccard(a, b):
    cut = lambda t: set(zip(*[t.lower().split()[i:] for i in range(5)])) or {tuple(t.lower().split())}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def edited(rng, base, edits):
    out = list(base)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"x{rng.randrange(10**6)}"
    return out


def near_texts(seed=3):
    """Families of texts at similarities on both sides of 0.8."""
    rng, texts = random.Random(seed), []
    for _ in range(40):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(60, 300))]
        texts += [base, *(edited(rng, base, max(1, len(base) * k // 100)) for k in (1, 2, 4))]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def brute_gone(texts):
    return [(i,) for i, t in enumerate(texts) if any(jaccard(t, o) >= 0.8 for o in texts[:i])]


def test_stage_drops_texts_of_similarity_four_fifths(spark):
    texts = near_texts()
    want = brute_gone(texts)
    assert 40 < len(want) < 120
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, plain(spark, texts), "").collect()}
    assert kept == set(range(len(texts))) - {i for i, in want}


def test_similar_texts_of_each_pair_match_brute_force(spark):
    texts = near_texts(9) + ["one two", "ONE  two", "one three", "", "  "]
    assert rows_of(near_copies(plain(spark, texts)), "doc_id") == sorted(
        ((i,) for i, in brute_gone(texts) if texts[i].strip()), key=repr
    )


def test_crowded_bands_leave_no_similar_texts(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**5)}" for _ in range(100)]
    texts = [" ".join(edited(rng, base, 1)) for _ in range(60)]
    far = [" ".join(edited(rng, base, 9)) for _ in range(40)]
    for texts, block in ((texts, 4), (far, 4), (texts + far, 7)):
        gone = {r["doc_id"] for r in near_copies(plain(spark, texts), block=block).collect()}
        kept = [i for i in range(len(texts)) if i not in gone]
        assert not any(jaccard(texts[i], texts[j]) >= 0.8 for i in kept for j in kept if i < j)
        assert all(any(jaccard(texts[i], texts[j]) >= 0.8 for j in range(i)) for i in gone)


def test_rows_without_ids_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [
        (1, text), (1, text + " tail"), (None, text + " end"), (None, "no id"), (2, "other words"), (2, text + " more")
    ]
    df = spark.createDataFrame([(i, t, "en", "s", "x", 1, None, "y", "z") for i, t in rows], SCHEMA)
    assert rows_of(near_copies(df.select("doc_id", "text")), "doc_id") == [(2,), (None,)]
    assert keep_dissimilar(df).columns == df.columns
    assert keep_dissimilar(spark.createDataFrame([], SCHEMA)).count() == 0


def shuffled_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_stage_writes_no_text_to_the_shared_folder(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:6]]
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert corpus_pipeline.drop_near_copies(spark, plain(spark, texts), "").count() == 60
    made = set(shared.iterdir()) - before
    assert made and not [p.name for p in made if "text" in spark.read.parquet(str(p)).columns]
    assert sum(f.stat().st_size for p in made for f in p.glob("*.parquet")) < sum(map(len, texts))


def test_texts_that_share_no_band_are_shuffled_for_counts_only(spark):
    rng, n = random.Random(13), 2000
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(n)]
    texts += [t + " tail" for t in texts[:20]]
    df = plain(spark, texts).select("doc_id", "text").localCheckpoint()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the lists of keys were large
    try:
        before = shuffled_rows(spark)
        assert near_copies(df).count() == 20
        # a key of each band is counted once, and few go on
        assert shuffled_rows(spark) - before < 1.5 * BANDS * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_left_out_documents_and_repeated_rows_match_brute_force(spark):
    texts = near_texts(15)
    out = set(range(0, len(texts), 3))
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts) if i % 5 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    besides = spark.createDataFrame([(i,) for i in out], "doc_id long").localCheckpoint()
    left = [(i, t) for i, t in enumerate(texts) if i not in out]
    want = [i for i, t in left if any(j < i and jaccard(t, o) >= 0.8 for j, o in left)]
    assert 10 < len(want) < len(brute_gone(texts))
    assert {r["doc_id"] for r in near_copies(df, besides=besides).collect()} == set(want)
    kept = Counter(r["doc_id"] for r in keep_dissimilar(df, besides=besides).collect())
    assert kept == Counter(i for i, _ in rows if i not in out and i not in want)
