"""A gated recurrent language model in numpy, fitted and applied by Spark tasks.

Counts of all training tokens come from a grouped aggregation. The most frequent words (the head) are
symbols of their own; all other words fall into classes by their spelling. The output is factored: a
softmax over classes, then a softmax within each head class, or the smoothed relative frequency of the
word within its spelling class. The recurrent weights are fitted by truncated backpropagation in every
task, over all its training documents, and averaged over tasks, so more data means more fitting. Scoring runs documents side by side and carries each one's state from window
to window up to its end.

Counts of frequent words (a bounded number) are broadcast; those of rare words come by a join.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, task_number, text_slices, whole_text


@dataclass(frozen=True)
class Settings:
    """head_classes * class_size words have symbols of their own; at most ``frequent`` counts are broadcast.

    ``lanes``: pieces of a block of text that are read side by side, fewer where that would leave less than
    ``updates`` windows. ``rounds``: of fitting and averaging.
    """

    head_classes: int = 32
    class_size: int = 64
    suffixes: int = 21
    embed: int = 12
    hidden: int = 16
    window: int = 16
    lanes: int = 512
    updates: int = 64
    rate: float = 0.05
    rounds: int = 1
    frequent: int = 200_000
    seed: int = 7

    @property
    def head(self) -> int:
        return self.head_classes * self.class_size

    @property
    def spelled(self) -> int:
        return 3 * self.suffixes

    @property
    def classes(self) -> int:
        """The end, then the head classes, then the spelling classes."""
        return 1 + self.head_classes + self.spelled

    @property
    def code(self) -> np.dtype:
        """How symbols are written."""
        return np.dtype("<u2" if self.symbols <= 1 << 16 else "<u4")

    @property
    def symbols(self) -> int:
        """Head words, then spelling classes, then the end (also the start)."""
        return self.head + self.spelled + 1


def spelling(word: bytes, suffixes: int) -> int:
    """The class of a word by its last letters and its final sign."""
    last = word[-1]
    sign = 1 if last == 44 else 2 if last < 48 or 57 < last < 97 else 0
    return zlib.crc32(word[-3:-1] if sign else word[-2:]) % suffixes * 3 + sign


@dataclass
class Words:
    """A block of documents as codes of its distinct words."""

    codes: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    shapes: np.ndarray


def block_words(texts: pa.Array, suffixes: int) -> Words:
    """Lower-case A-Z and split at ASCII white space; ``stops`` is where each text's words end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    stops, codes = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py(), coded.indices.to_numpy()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    filled = np.fromiter((bool(w) for w in words), dtype=bool, count=len(words))
    if not filled.all():  # leading and trailing white space gives empty strings
        keep = filled[codes]
        stops = np.concatenate([[0], np.cumsum(keep)])[stops]
        codes = codes[keep]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)
    shapes = np.fromiter((spelling(w, suffixes) if w else 0 for w in words), dtype=np.int32, count=len(words))
    return Words(codes, stops, hashes, shapes)


def keep_heap(most: int = 64 << 20) -> bool:
    """Have glibc keep up to ``most`` bytes of freed memory in this process; false where it can't be asked.

    By default arrays of a few MB are mapped anew each time, and their page faults take a fourth of a fit.
    """
    trim_threshold, mmap_threshold = -1, -3
    try:
        libc = ctypes.CDLL(None)
        return bool(libc.mallopt(mmap_threshold, most // 2) and libc.mallopt(trim_threshold, most))
    except (AttributeError, OSError):
        return False


def is_held_out(ids: list[int | None]) -> np.ndarray:
    """crc32 of the id as text, mod 7, is 2; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], dtype=bool)


def token_counts(rows: DataFrame, suffixes: int) -> DataFrame:
    """(word, shape, c) of the training words, where ``word`` is a 64-bit hash; the row of shape -1 counts the ends.

    Each task adds up its words block by block before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("shape", pa.int32()), ("n", pa.int64())])
        for whole in batches:
            for batch in text_slices(whole, most_bytes=24 << 20):
                batch = batch.filter(pa.array(~is_held_out(batch.column("doc_id").to_pylist())))
                if not len(batch):
                    continue
                words = block_words(batch.column("text"), suffixes)
                n = np.bincount(words.codes, minlength=len(words.hashes))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(words.hashes[seen], 0)),
                        pa.array(np.append(words.shapes[seen], -1), pa.int32()),
                        pa.array(np.append(n[seen], len(batch)), pa.int64())
                    ],
                    schema=schema
                )

    counted = rows.mapInArrow(count, "word long, shape int, n long")
    return durable(counted.groupBy("word", "shape").agg(F.sum("n").alias("c")), "lm-counts")


@dataclass
class Lexicon:
    """What scoring knows of the words: sorted hashes of the frequent ones, their counts and head symbols."""

    hashes: np.ndarray
    counts: np.ndarray
    heads: np.ndarray
    total: int
    distinct: int
    ends: int
    shape_mass: np.ndarray
    class_mass: np.ndarray
    head_mass: np.ndarray = field(default_factory=lambda: np.zeros(0))


def lexicon(counts: DataFrame, s: Settings) -> Lexicon:
    """Collect the bounded part of the counts: at most ``s.frequent`` words and a row per spelling class."""
    words = counts.filter("shape >= 0")
    sizes = words.groupBy(  # 64 rows at most
        F.floor(F.log2("c")).cast("int").alias("p")
    ).agg(F.count("*").alias("n")).collect()
    least, n = 64, 0
    for p, k in sorted(((r["p"], r["n"]) for r in sizes), reverse=True):
        if n + k > s.frequent:
            break
        least, n = p, n + k
    top = words.filter(F.col("c") >= F.lit(2**least if least < 63 else 2**62)).toArrow()
    hashes, c, shapes = (top.column(k).to_numpy() for k in ("word", "c", "shape"))
    order = np.lexsort((hashes, -c))[:s.head]
    heads = np.full(len(hashes), -1, dtype=np.int32)
    heads[order] = np.arange(len(order))
    by_shape = words.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    ends = counts.filter("shape < 0").agg(F.sum("c")).first()[0] or 0
    mass, kinds = np.zeros(s.spelled), np.zeros(s.spelled)
    for r in by_shape:
        mass[r["shape"]], kinds[r["shape"]] = r["c"], r["n"]
    total, distinct = int(mass.sum()) + ends, int(kinds.sum()) + bool(ends)
    np.subtract.at(mass, shapes[order], c[order])
    np.subtract.at(kinds, shapes[order], 1)
    head_mass = np.zeros(s.head)
    head_mass[:len(order)] = c[order]
    class_mass = np.concatenate([[ends], head_mass.reshape(s.head_classes, -1).sum(1), mass]) + 1.0
    by_hash = np.argsort(hashes)
    return Lexicon(
        hashes[by_hash], c[by_hash], heads[by_hash], total, distinct, ends, mass + kinds + 1, class_mass,
        head_mass + 0.5
    )


def initial(s: Settings, lex: Lexicon) -> dict[str, np.ndarray]:
    """Weights that give the factored relative frequencies, whatever the state."""
    rng = np.random.default_rng(s.seed)
    draw = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": draw(s.symbols, s.embed) * math.sqrt(s.symbols) * 0.3, "in": draw(s.embed, 3 * s.hidden), "in_bias": np.zeros(
            3 * s.hidden, np.float32
        ), "state": draw(s.hidden, 3 * s.hidden),
        "class": np.zeros((s.hidden, s.classes), np.float32), "class_bias": np.log(
            lex.class_mass / lex.class_mass.sum()
        ).astype(np.float32),
        "word": np.zeros(
            (s.head_classes, s.hidden, s.class_size), np.float32
        ), "word_bias": np.log(lex.head_mass).astype(np.float32).reshape(s.head_classes, -1),
    }


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(w: dict[str, np.ndarray], projected: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step: (new state, gates, candidate, the state's share of the candidate)."""
    n = h.shape[1]
    own = h @ w["state"]
    gates = _sigmoid(projected[:, :2 * n] + own[:, :2 * n])
    candidate = gates[:, n:] * own[:, 2 * n:]
    candidate += projected[:, 2 * n:]
    np.tanh(candidate, out=candidate)
    after = h - candidate
    after *= gates[:, :n]
    after += candidate
    return after, gates, candidate, own[:, 2 * n:]


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state, being within -1 and 1, can give a logit that ``exp`` overflows on."""
    return float((np.abs(weights).sum(-2) + np.abs(bias)).max(initial=0)) < 80


def _raised(x: np.ndarray, small: bool) -> np.ndarray:
    """Make ``x`` what its softmax is in proportion to, and return each row's sum; rows of small logits need no maximum."""
    if not small:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _log_shares(x: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """Of each row, the log of the softmax at one place. ``x`` is used up."""
    if not small:
        x -= x.max(1, keepdims=True)
    own = x[np.arange(len(at)), at]
    return own - np.log(np.exp(x, out=x).sum(1))


def targets(symbols: np.ndarray, s: Settings) -> np.ndarray:
    """The output class of each symbol."""
    return np.where(
        symbols < s.head, 1 + symbols // s.class_size,
        np.where(symbols == s.symbols - 1, 0, symbols - s.head + 1 + s.head_classes)
    )


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``rows`` added up by their places ``at``, of which there are ``n``."""
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[places] = np.add.reduceat(rows[order], starts)
    return out


def fit_window(
    w: dict[str, np.ndarray], s: Settings, seen: np.ndarray, next_: np.ndarray, fresh: np.ndarray, h: np.ndarray
) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the loss over a window (steps x lanes) per place, the last state and the loss. Where ``next_`` is -1, nothing is predicted."""
    k, lanes, n = len(seen), h.shape[0], s.hidden
    known = w["embed"][seen.ravel()]
    inputs = (known @ w["in"] + w["in_bias"]).reshape(k, lanes, -1)
    keep = []
    states = np.empty((k, lanes, n), known.dtype)
    for t in range(k):
        before = h * ~fresh[t][:, None]
        h, gates, candidate, own = step(w, inputs[t], before)
        keep.append((before, gates, candidate, own))
        states[t] = h
    rows, goal = states.reshape(-1, n), next_.ravel()
    used = goal >= 0
    count = goal.size  # places after the last document weigh nothing, and the others no more than before
    cls = targets(np.where(used, goal, 0), s)
    weight = (used / count).astype(known.dtype)
    d, at_goal = rows @ w["class"], (np.arange(len(goal)), cls)
    d += w["class_bias"]
    sums = _raised(d, _small(w["class"], w["class_bias"]))
    small = _small(w["word"], w["word_bias"])
    loss = -np.log((d[at_goal] / sums)[used]).sum()
    d *= (weight / sums)[:, None]
    d[at_goal] -= weight
    g = {
        "class": rows.T @ d, "class_bias": np.ones(len(d), d.dtype) @ d, "word": np.zeros_like(w["word"]),
        "word_bias": np.zeros_like(w["word_bias"])
    }
    dh = d @ w["class"].T
    by_class = np.where(used, cls, 0)
    order = np.argsort(by_class.astype(np.int16), kind="stable")
    cuts = np.searchsorted(by_class[order], np.arange(1, s.head_classes + 2))
    order, cuts = order[cuts[0]:cuts[-1]], cuts - cuts[0]
    by_word, of_class, back = rows[order], goal[order] % s.class_size, np.empty((len(order), n), known.dtype)
    one = np.asarray(1 / count, known.dtype)
    for c in range(s.head_classes):
        at = slice(cuts[c], cuts[c + 1])
        if at.start < at.stop:
            own = by_word[at]
            dw, which = own @ w["word"][c], (np.arange(len(own)), of_class[at])
            dw += w["word_bias"][c]
            sums = _raised(dw, small)
            loss -= np.log(dw[which] / sums).sum()
            dw *= (one / sums)[:, None]
            dw[which] -= one
            g["word"][c], g["word_bias"][c] = own.T @ dw, dw.sum(0)
            np.matmul(dw, w["word"][c].T, out=back[at])
    dh[order] += back
    dh = dh.reshape(k, lanes, n)
    # what a step's gradient is multiplied by, for all steps at once
    befores, gates, candidates, owns = (np.stack(x) for x in zip(*keep))
    z, r = np.ascontiguousarray(gates[..., :n]), np.ascontiguousarray(gates[..., n:])
    rest = 1 - z
    by_candidate = rest * (1 - candidates**2)
    by_update, by_reset = (befores - candidates) * z * rest, by_candidate * owns * r * (1 - r)
    by_own, kept = by_candidate * r, ~fresh[:, :, None]
    carry, turned = np.zeros((lanes, n), known.dtype), np.ascontiguousarray(w["state"].T)
    totals, through = np.empty_like(dh), np.empty_like(inputs)
    for t in reversed(range(k)):
        total = np.add(dh[t], carry, out=totals[t])
        np.multiply(total, by_update[t], out=through[t, :, :n])
        np.multiply(total, by_reset[t], out=through[t, :, n:2 * n])
        np.multiply(total, by_own[t], out=through[t, :, 2 * n:])
        carry = through[t] @ turned
        carry += total * z[t]
        carry *= kept[t]
    g["state"] = befores.reshape(-1, n).T @ through.reshape(-1, 3 * n)
    into = through
    np.multiply(totals, by_candidate, out=into[..., 2 * n:])
    flat_into = into.reshape(k * lanes, -1)
    g["in"], g["in_bias"] = known.T @ flat_into, flat_into.sum(0)
    g["embed"] = _summed(flat_into @ w["in"].T, seen.ravel(), s.symbols)
    return g, h, float(loss) / count


def fit(w: dict[str, np.ndarray], s: Settings, symbols: np.ndarray, stops: np.ndarray) -> dict[str, np.ndarray]:
    """Truncated backpropagation (Adagrad) over documents of symbols, each with its end.

    The documents in a row are cut into equal lanes, so a long one fills no more memory than its symbols do;
    the state is carried from window to window and cleared where a document begins.
    """
    n = len(symbols)
    lanes = max(1, min(s.lanes, n // (s.window * s.updates)))
    length = -(-n // lanes)
    pad = lanes * length - n
    end = s.symbols - 1
    seen = np.concatenate([[end], symbols[:-1], np.full(pad, end)]).reshape(lanes, length)
    goal = np.concatenate([symbols, np.full(pad, -1)]).reshape(lanes, length)
    fresh = np.zeros(lanes * length, dtype=bool)
    fresh[np.concatenate([[0], stops[:-1]])] = True
    fresh = fresh.reshape(lanes, length)
    squares, h = {k: np.full_like(x, 1e-6) for k, x in w.items()}, np.zeros((lanes, s.hidden), np.float32)
    w = {k: x.copy() for k, x in w.items()}
    for at in range(0, length, s.window):
        part = slice(at, at + s.window)
        g, h, _ = fit_window(w, s, seen[:, part].T, goal[:, part].T, fresh[:, part].T, h)
        for k in w:
            squares[k] += g[k] ** 2
            w[k] -= (s.rate * g[k] / np.sqrt(squares[k])).astype(np.float32)
    return w


def log_probabilities(
    w: dict[str, np.ndarray], s: Settings, symbols: np.ndarray, stops: np.ndarray, most_rows: int = 1 << 15
) -> np.ndarray:
    """Natural log probability of every document's classes and head words. ``symbols`` holds each document's end."""
    table = w["embed"] @ w["in"] + w["in_bias"]
    starts = np.concatenate([[0], stops[:-1]])
    order = np.argsort(starts - stops, kind="stable")
    starts, sizes = starts[order], (stops - starts)[order]
    out, h = np.zeros(len(order)), np.zeros((len(order), s.hidden), np.float32)
    live = len(order)
    states, goals, held = [], [], 0
    small, small_words = _small(w["class"], w["class_bias"]), _small(w["word"], w["word_bias"])
    previous = np.full(len(order), s.symbols - 1, dtype=np.int64)

    def settle() -> None:
        nonlocal held
        rows, goal = np.concatenate(states), np.concatenate(goals)
        cls = targets(goal, s)
        x = rows @ w["class"]
        x += w["class_bias"]
        p = _log_shares(x, cls, small)
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(1, s.head_classes + 2))
        for c in range(s.head_classes):
            at = order[cuts[c]:cuts[c + 1]]
            if len(at):
                y = rows[at] @ w["word"][c]
                y += w["word_bias"][c]
                p[at] += _log_shares(y, goal[at] - c * s.class_size, small_words)
        done = 0
        for part in goals:
            out[:len(part)] += p[done:done + len(part)]
            done += len(part)
        states.clear()
        goals.clear()
        held = 0

    for t in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[live - 1] <= t:
            live -= 1
        h = step(w, table[previous[:live]], h[:live])[0]
        goal = symbols[starts[:live] + t]
        states.append(h)
        goals.append(goal)
        previous[:live] = goal
        held += live
        if held >= most_rows:
            settle()
    if held:
        settle()
    back = np.empty_like(out)
    back[order] = out
    return back


def _symbols(words: Words, lex: Lexicon, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct word of the block: its symbol, and its place among the frequent words or -1."""
    if not len(lex.hashes):
        return s.head + words.shapes.astype(np.int64), np.full(len(words.hashes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(lex.hashes, words.hashes), len(lex.hashes) - 1)
    at = np.where(lex.hashes[at] == words.hashes, at, -1)
    head = np.where(at >= 0, lex.heads[at], -1)
    return np.where(head >= 0, head, s.head + words.shapes).astype(np.int64), at


def _with_ends(values: np.ndarray, stops: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values followed by ``end``."""
    return np.insert(values, stops, end), stops + np.arange(1, len(stops) + 1)


def encoded(rows: DataFrame, s: Settings, lex: Lexicon) -> DataFrame:
    """Every row as symbols, written once for fitting and scoring.

    uid, doc_id, held_out, n_tokens, ``known`` (frequent tokens), ``base`` and ``tail`` (what the base and the
    spelling classes give for those), ``symbols`` (little-endian), and the hashes of rare words with their times.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lex)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_ = shared.value
        number = task_number() << 33
        norm = math.log10(lexicon_.total + lexicon_.distinct + 1)
        frequent, mass = np.log10(lexicon_.counts + 1.0), np.log10(lexicon_.shape_mass)
        for whole in batches:
            for batch in text_slices(whole, most_bytes=16 << 20):
                words = block_words(batch.column("text"), s.suffixes)
                symbol, place = _symbols(words, lexicon_, s)
                known = place >= 0
                base_of = np.where(known, frequent[place] if len(frequent) else 0.0, 0.0)
                # the part of a spelled word's probability within its class that needs no count of a rare word
                tail_of = np.where(symbol < s.head, 0.0, base_of - mass[words.shapes])
                add = lambda x: np.diff(
                    np.concatenate([[0.0], np.cumsum(x[words.codes])])[words.stops], prepend=0.0
                )
                symbols, stops = _with_ends(symbol[words.codes].astype(s.code), words.stops, s.symbols - 1)
                sizes = np.diff(stops, prepend=0)
                base = add(base_of) + math.log10(lexicon_.ends + 1) - sizes * norm
                doc = np.repeat(np.arange(len(batch)), sizes - 1)
                rare = ~known[words.codes]
                pairs, n = np.unique(doc[rare] * len(words.hashes) + words.codes[rare], return_counts=True)
                where = np.searchsorted(pairs, np.arange(len(batch) + 1) * max(1, len(words.hashes)))
                lists = [
                    pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(x)) for x in (
                        words.hashes[pairs % max(1, len(words.hashes))], n.astype(np.int64)
                    )
                ]
                bytes_ = pa.Array.from_buffers(
                    pa.large_binary(), len(batch),
                    [
                        None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int64) * s.code.itemsize),
                        pa.py_buffer(symbols)
                    ]
                )
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(len(batch))), ids, pa.array(is_held_out(ids.to_pylist())), pa.array(sizes.astype(np.int64)), pa.array(
                        np.rint(add(known.astype(float))).astype(np.int64) + bool(lexicon_.ends)
                    ),
                    pa.array(base), pa.array(add(tail_of)), bytes_.cast(pa.binary()), *lists,
                ], names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "tail", "symbols", "rare", "times"])
                number += len(batch)

    return durable(
        rows.mapInArrow(
            encode,
            "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, tail double, symbols binary, rare array<long>, times array<long>"
        ),
        "lm-symbols"
    )


def _read(column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all documents in a row, where each one's end)."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // s.code.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), s.code).astype(np.int64), np.cumsum(sizes)


def fitted(documents: DataFrame, s: Settings, lex: Lexicon, block: int = 1 << 20) -> dict[str, np.ndarray]:
    """The weights after ``s.rounds`` of fitting in every task and averaging, by the tokens that each task has seen.

    ``documents`` are those of ``encoded``. A task fits about ``block`` symbols at a time.
    """
    w = initial(s, lex)
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    learning = documents.filter("NOT held_out").select("symbols")

    for _ in range(s.rounds):
        shared = spark.sparkContext.broadcast(w)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_heap()
            now, tokens = shared.value, 0
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def settle(now: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
                starts = np.cumsum([0, *(len(x) for x, _ in held)])
                out = fit(
                    now, s, np.concatenate([x for x, _ in held]),
                    np.concatenate([stops + at for (_, stops), at in zip(held, starts)])
                )
                held.clear()
                return out

            for whole in batches:
                for batch in text_slices(whole, "symbols", block * s.code.itemsize):
                    held.append(_read(batch.column("symbols"), s))
                    tokens += len(held[-1][0])
                    if sum(len(x) for x, _ in held) >= block:
                        now = settle(now)
            if held:
                now = settle(now)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(tokens)]), pa.array([flat(now) * np.float32(tokens)], pa.list_(pa.float32()))],
                    names=["n", "w"]
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0.0, None
            for batch in batches:
                for k, vector in zip(batch.column("n").to_pylist(), batch.column("w")):
                    v = vector.values.to_numpy().astype(np.float64)
                    n, total = n + k, v if total is None else total + v
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n]), pa.array([total], pa.list_(pa.float64()))], names=["n", "w"]
                )

        each = learning.mapInArrow(train, "n double, w array<float>")
        sums = each.repartition(tasks).mapInArrow(  # two levels, so no task adds up too many
            add, "n double, w array<double>"
        )
        sums = sums.repartition(8).mapInArrow(add, "n double, w array<double>").toArrow()  # 8 rows at most
        n = sum(sums.column("n").to_pylist())
        if not n:
            return w
        w = unflat(sum(np.array(x) for x in sums.column("w").to_pylist()) / n, w)
    return w


def score_documents(
    docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's scores: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the rows whose id isn't held out. Both scores are log10 probabilities of the whole text and
    its end; the base is the add-one unigram model. Words are told apart by 64-bit hashes. Null texts count
    as empty (the end alone), repeated rows are each counted and scored, null ids are trained on. Other
    columns are ignored; an empty table gives no rows.
    """
    s = settings or Settings()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    counts = token_counts(rows, s.suffixes)
    lex = lexicon(counts, s)
    documents = encoded(rows, s, lex)
    shared = rows.sparkSession.sparkContext.broadcast(fitted(documents, s, lex))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        w, log10 = shared.value, math.log(10)
        for whole in batches:
            for batch in text_slices(whole, "symbols", 4 << 20):
                symbols, stops = _read(batch.column("symbols"), s)
                model = log_probabilities(w, s, symbols, stops) / log10 + batch.column("tail").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("uid", "doc_id", "held_out", "n_tokens", "known", "base")),
                        pa.array(model)
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model"]
                )

    asked = documents.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "tail", "symbols")
    scored = durable(
        asked.mapInArrow(
            score, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double"
        ),
        "lm-scores"
    )
    rare = documents.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "uid", F.col("x.rare").alias("word"), F.col("x.times").alias("n")
    )
    # rare words have bounded counts, so no key of this join is hot
    added = rare.join(counts.filter("shape >= 0").select("word", "c"), "word").groupBy("uid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_c"), F.sum("n").alias("rare_known")
    )
    out = scored.join(added, "uid", "left")
    log_c = F.coalesce("log_c", F.lit(0.0))
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (
            F.col("known") + F.coalesce("rare_known", F.lit(0))
        ).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + log_c).alias("base_score"), (F.col("model") + log_c).alias("score"))
