import random

from fanweave.llm.language import document_rows, fit_text_model, identify

SCHEMA = "doc_id long, text string, lang string, source string"


def skewed(spark, common=400, rare=8):
    """A common language and a rare one of another script; every fourth label has a region."""
    rng = random.Random(12)
    stock = {"en": "the and ing tion of th er".split(), "ru": "жизнь пре крас на уди ви тельна".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(stock[lang]) for _ in range(3)) for _ in range(n))
    rows = [
        (i, make(lang, 30), lang if i % 4 else lang + "-XX", "s") for i,
        lang in enumerate(["en"] * common + ["ru"] * rare)
    ]
    return spark.createDataFrame(rows, SCHEMA), make


def test_a_rare_language_is_learnt_beside_a_common_one(spark):
    df, make = skewed(spark)
    model = fit_text_model(df, sample_docs=40)
    assert model.languages == ["en", "ru", "und"]
    held = spark.createDataFrame([(1, make("ru", 40), "ru", "s"), (2, make("en", 40), "en", "s")], SCHEMA)
    assert {
        r["_id"]: (r["language"], r["accepted"]) for r in identify(document_rows(held), model).collect()
    } == {1: ("ru", True), 2: ("en", True)}


def test_the_sample_of_a_language_is_bounded_and_independent_of_others(spark):
    df, _ = skewed(spark)
    alone, beside = fit_text_model(df.filter("lang like 'ru%'"), sample_docs=6), fit_text_model(df, sample_docs=6)
    assert (alone.table[:, 0] == beside.table[:, 1]).all()
    assert (fit_text_model(df, sample_docs=8).table[:, 1] != beside.table[:, 1]).any()
    assert fit_text_model(df, least_docs=9).languages == ["en", "und"]
