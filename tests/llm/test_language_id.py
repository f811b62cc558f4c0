import math

from briefloom.llm.common import read_table
from briefloom.llm.language_id import BackoffModel, Predictor, grams_of, identify_languages, keep_identified, words_of


def small_model():
    counts = [("a", 0, "the", 8), ("b", 0, "der", 6), ("a", 3, "ing", 5), ("b", 3, "sch", 5), ("a", 1, "x", 3), ("b", 1, "y", 3)]
    return BackoffModel.fit(counts, {("a", 0): 10, ("b", 0): 10, ("a", 3): 9, ("b", 3): 9, ("a", 1): 5, ("b", 1): 5})


def test_words_come_first_then_shorter_grams():
    model = small_model()
    assert math.isclose(model.evidence("the")[0], math.log(8.5 / 11.5)) and model.evidence("the")[0] > model.evidence("the")[1]
    assert (model.evidence("going") == model.table[model.grams["ing"]]).all() and (model.evidence("qx") == model.table[model.grams["x"]]).all() and model.evidence("qq") is None
    assert grams_of("ab", 3) == ["<ab", "ab>"]


def test_predictions_match_a_plain_loop():
    model = small_model()
    texts = ["the der the", "schön", "qq", "", "123 !?", "½", "The going der y x x"]
    names, scores = Predictor(model).predict(texts)
    for text, name, score in zip(texts, names, scores):
        words = [w for w in words_of(text) if any(map(str.isalpha, w))]
        rows = [e for w in words if (e := model.evidence(w)) is not None]
        if not words:
            assert (name, score) == ("und", 0.0)
            continue
        total = [sum(c) for c in zip(*rows)] if rows else [0.0, 0.0]
        scaled = [t * min(len(rows), 12) / max(len(rows), 1) for t in total]
        assert name == "ab"[total.index(max(total))]
        assert math.isclose(score, 1 / sum(math.exp(x - max(scaled)) for x in scaled))


def test_held_out_accuracy_and_whole_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_edge_rows(spark):
    rows = [(1, "the cat", "en", 1), (2, "der hund", "de", 1), (3, None, "en", 1), (4, "", None, 1), (5, "42 !", None, 1), (6, "the the", None, 1), (7, "the cat", "en", 2), (None, "the cat", "en", 2), (8, "der hund", "de", 1), (9, "the cat", "en", 1), (10, "der hund", "de", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(df).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[6] == "en" and len(got) == len(rows)
    kept = keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, None, 8, 9, 10}
    assert identify_languages(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(df.withColumn("lang", df["lang"].substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}
