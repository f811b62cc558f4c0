"""The pipeline on a small corpus against the stages' definitions."""

import random

import sentencepiece

import corpus_pipeline
from briefloom.llm.registry import tokenizer_file
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_line_dedup import brute as brute_lines


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(6)
    words = {"en": ["the", "and", "river", "stone", "walking", "bright", "morning"], "de": ["der", "und", "schnee", "wald", "gehen", "licht", "morgen"]}
    text = lambda lang, k: " ".join(rng.choice(words[lang]) + str(rng.randrange(10) or "") for _ in range(k))
    shared = "\n".join(text("en", 6) for _ in range(3))
    item = text("en", 20) + "\n" + text("en", 6)
    docs = [(i, text(lang, 40), lang) for i, lang in enumerate(["en", "de"] * 8)]
    docs += [(50, shared + "\n" + text("en", 30), "en"), (51, text("en", 30) + "\n" + shared, "en"), (52, "12 34", "en"), (53, None, "en"), (54, docs[0][1] + " tail", "en"), (55, text("en", 15) + " " + item + " " + text("en", 15), "en")]
    folder = f"file://{tmp_path}/sf"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r["pieces"] for r in corpus_pipeline.run(spark, folder).collect()}

    left = [(i, t) for i, t, _ in docs if i not in (52, 53)]
    cut = brute_lines(left)
    left = [(i, cut[i][2]) for i, _ in left]
    groups = brute_components(left)
    left = {i: t for i, t in left if groups[i][1] == i and i != 55}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert 54 not in left and 0 in left and left[51].count("\n") == 0
    assert got == {i: library.encode(t) for i, t in left.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the river and the stone", "en", "s", 3), (2, "der schnee und der wald", "de", "s", 3)] , "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns, name
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0, name
