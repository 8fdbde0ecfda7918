"""Texts of a megabyte and more, and vocabularies' odd lengths, against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from fanweave.llm import packing, token_counts
from fanweave.llm.decontam import contamination
from fanweave.llm.exact_dedup import exact_duplicates
from fanweave.llm.line_dedup import drop_repeated_lines
from fanweave.llm.recurrent import Settings, initial, lexicon, log_probabilities, score_documents, step, targets, token_counts as word_counts
from fanweave.llm.simhash import near_duplicates

from .fixtures import plain, rows_of, words
from .test_dedup import brute_exact, brute_fingerprint, brute_lines
from .test_text import tiny


def long_words(seed, n=200_000):
    return words(random.Random(seed), n, 20_000)


def test_a_long_text_is_scored_like_any(spark):
    text = long_words(1, 60_000)
    s = Settings(head_classes=4, class_size=16, hidden=6, embed=5)
    got = {r["doc_id"]: r for r in score_documents(plain(spark, [text, "w1 w2", text]), s).collect()}
    n = len(text.split()) + 1
    assert got[0]["n_tokens"] == got[2]["n_tokens"] == n and got[1]["n_tokens"] == 3
    assert math.isfinite(got[0]["score"]) and abs(got[0]["score"] - got[2]["score"]) < 1e-4 * n


def plain_log_probability(w, s, symbols):
    """The forward pass of one document, place by place."""
    h, seen, total = np.zeros(s.hidden), s.symbols - 1, 0.0
    for goal in symbols.tolist():
        x = w["embed"][seen] @ w["in"] + w["in_bias"]
        own, n = h @ w["state"], s.hidden
        z, r = (1 / (1 + np.exp(-(x[k * n:(k + 1) * n] + own[k * n:(k + 1) * n]))) for k in (0, 1))
        candidate = np.tanh(x[2 * n:] + r * own[2 * n:])
        h = candidate + z * (h - candidate)
        softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
        c = 0 if goal == s.symbols - 1 else 1 + goal // s.class_size if goal < s.head else 1 + s.head_classes + goal - s.head
        total += np.log(softmax(h @ w["class"] + w["class_bias"])[c])
        if 1 <= c <= s.head_classes:
            total += np.log(softmax(h @ w["word"][c - 1] + w["word_bias"][c - 1])[goal % s.class_size])
        seen = goal
    return total


def test_the_forward_pass_matches_a_plain_loop(spark):
    s, w, rng = tiny()
    for n in (1, 5, 40):
        doc = rng.integers(0, s.symbols, n)
        assert abs(log_probabilities(w, s, doc, np.array([n]))[0] - plain_log_probability(w, s, doc)) < 1e-6
    s = Settings()  # as shipped
    rows = plain(spark, [long_words(3, 9000)]).selectExpr("doc_id", "text")
    w = initial(s, lexicon(word_counts(rows, s.suffixes), s))
    w = {k: (v + 0.2 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in w.items()}
    docs = [rng.integers(0, s.symbols, n) for n in (3, 120, 1)]
    got = log_probabilities(w, s, np.concatenate(docs), np.cumsum([len(d) for d in docs]))
    assert all(
        abs(p - plain_log_probability({k: v.astype(np.float64) for k, v in w.items()}, s, d)) < 1e-3 * len(d) for p,
        d in zip(got, docs)
    )
    assert set(targets(np.arange(s.symbols), s).tolist()) == set(range(s.classes)) and step is not None


def test_decontamination_of_a_long_text(spark):
    text = long_words(2).split()
    items = [
        (k, " ".join(text[at:at + 20])) for k, at in enumerate((0, 4090, 4096, 100_000, len(text) - 20))
    ] + [(9, "not there at all")]
    row = contamination(
        plain(spark, [" ".join(text)]), spark.createDataFrame(items, "item_id long, text string")
    ).first()
    assert row["n_words"] == len(text) and row["items"] == [0, 1, 2, 3, 4] and row["n_hit"] == 20 + 26 + 20 + 20


def test_dedup_of_long_texts(spark):
    a = long_words(4)
    texts = [a, a.replace(" ", "\n\t "), a + " x", "short", a]
    assert rows_of(
        exact_duplicates(plain(spark, texts), digest_all=True), "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    ) == brute_exact(list(enumerate(texts)))
    prints = {r["doc_id"]: r["fingerprint"] for r in near_duplicates(plain(spark, texts[:4])).collect()}
    assert prints == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts[:4])}


def test_lines_of_long_texts(spark):
    rng = random.Random(5)
    stock = [f"line {k} of a long text that is long enough to count {k}" for k in range(3000)]
    texts = ["\n".join(rng.choice(stock) for _ in range(20_000)) for _ in range(6)] + ["z" * 2_000_000, "short"]
    got = rows_of(drop_repeated_lines(plain(spark, texts), batches=2), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert got == brute_lines(list(enumerate(texts)))


def odd_lengths():
    rng = random.Random(6)
    out = [c * n + d for c in ("a", "Z9", "é", "-") for n in (198, 199, 200, 201, 202) for d in ("", "b", ".", "ß")]
    out += ["".join(rng.choice("abcXYZ019.,-é") for _ in range(n)) for n in (199, 200, 201, 399, 401, 600)]
    out += [
        f"x{w * n}y" for w in (" ", "\n", "\t ") for n in (1998, 1999, 2000, 2001, 4100)
    ] + ["q" * n + " r" for n in (1999, 2000, 2001)]
    return out + [long_words(7)]


@pytest.mark.parametrize("name", ["word", "byte"])
def test_odd_lengths_encode_like_the_tokenizer(spark, name):
    texts = odd_lengths()
    path = packing.vocabulary("word_bpe_49k.json" if name == "word" else "byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = name == "byte"
    want = [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]
    if name == "byte":
        assert rows_of(
            token_counts.token_lengths(plain(spark, texts)), "doc_id", "n_tokens"
        ) == sorted(enumerate(want), key=repr)
        return
    for most in (packing.PLAN_ROWS, 2):  # the plan in one part and in many
        got = packing.pack(plain(spark, texts), capacity=500, most_plan_rows=most).collect()
        sums = Counter()
        for r in got:
            sums[r["doc_id"]] += r["length"]
        assert sums == Counter({i: n + 1 for i, n in enumerate(want)})
        crc = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got}
        for i in (0, 50, len(texts) - 1):
            ids = np.array([*exact.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
            assert all(crc[i, k] == zlib.crc32(ids[a:a + 500].tobytes()) for k, a in enumerate(range(0, len(ids), 500)))
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(
            [o for o, _ in sorted(b)] == [
                sum(n for _, n in sorted(b)[:k]) for k in range(len(b))
            ] and sum(n for _, n in b) <= 500 for b in bins.values()
        )
