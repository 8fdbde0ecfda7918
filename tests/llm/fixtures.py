"""Documents with every odd case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, keep_id string, kept int, text_hash string, `_len` string, n string"


def words(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    out = list(enumerate(base))
    out += [(40 + i, base[i]) for i in range(8)]  # copies
    out += [(48 + i, base[i].replace(" ", " \t ", 3) + " tail") for i in range(8)]  # near copies
    out += [
        (60, None), (61, ""), (62, "   \n\t "), (63, "é" * 50), (64, words(rng, 4000)), (65, "A\nB\n\nA"), (66, None),
        (67, " lead and trail ")
    ]
    out += [
        (5, base[5]), (5, base[5]), (6, "another text under a used id"), (None, base[1]), (None, "no id of its own")
    ]
    return [
        (i, t, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "b", None]), "x", 1, None, "y", "z") for i,
        t in out
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def plain(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
