"""Only letters make words: numbers that are no decimal digits do not."""

from slatewise.llm import language


def test_numbers_are_no_words():
    assert [list(language.words(t)) for t in ("½ ²", "①②", "Ⅷ", "١٢")] == [[[]]] * 4
    assert [w for ws in language.words("x² + Ño½b 日本 一二 été③") for w in ws] == ["x", "ño", "b", "日本", "一二", "été"]


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["the and of it", "½ ²", "①②", None, "the ½ of ①"])], "doc_id long, text string, lang string")
    model = language.learn(docs.select("lang", "text"))
    got = {r.doc_id: r.lang_pred for r in language.label(docs.select("doc_id", "text"), model).collect()}
    assert got == {0: "en", 1: "und", 2: "und", 3: "und", 4: "en"}
