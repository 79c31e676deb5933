"""Which documents the pipeline's language stage lets pass."""

import random

import corpus_pipeline
from slatewise.llm import language

EN, FR, RU = "the cat and the dog were in the house with that thing", "le chat est dans la maison avec les enfants et une voiture", "это большой дом и там живут люди вместе с собакой у реки"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_clean_texts_in_several_languages_stay(spark):
    rng = random.Random(3)
    noise = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(40))
    learn = [(k, t, lang, "s", 1) for k, (lang, t) in enumerate([("en", EN), ("fr", FR), ("ru", RU)] * 20)]
    asked = [(100, " ".join([EN] * 6 + [FR] * 5 + [RU] * 6), None, "s", 1), (101, "12 -- 3", None, "s", 1), (102, None, None, "s", 1), (103, EN, None, "s", 1)]
    docs = spark.createDataFrame(learn + asked, DOCS)
    left = corpus_pipeline.language_id(spark, docs, "")
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {*range(60), 100, 103}
    model = language.learn(docs.where("lang is not null"))
    said = {r.doc_id: r for r in language.label(spark.createDataFrame([*asked, (104, noise("bcdfghjkqvwxz"), None, "s", 1)], DOCS), model, with_evidence=True).collect()}
    assert said[100].score < corpus_pipeline.MIN_SHARE and min(said[100].evidence, said[103].evidence) > corpus_pipeline.MIN_EVIDENCE > said[104].evidence


def test_without_a_learned_language_all_stay(spark):
    docs = spark.createDataFrame([(1, EN, None, "s", 1), (2, FR, None, "s", 1), (3, None, None, "s", 1), (None, "", None, "s", 1)], DOCS)
    assert corpus_pipeline.language_id(spark, docs, "").count() == 4
