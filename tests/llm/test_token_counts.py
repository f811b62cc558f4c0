import pytest

from briefloom.llm.registry import tokenizer_file
from briefloom.llm.token_counts import WordCounter, count_tokens, read_cache

TEXTS = [
    "Hello, World. It's 12.5 don't", "a  b\t\nc\r\n", "", None, "<|endoftext|> and <|STARTOFTEXT|>x", "x<|startoftext|>y", "naïve café. École, ΣΊΣΥΦΟΣ ẞ İstanbul", "日本語。テキスト, 😀😀.", "nbsp\u00a0here\u2003wide\u3000space \x1c sep \x85 nel",
    "end. end, end.end e\u0301. \u0301x ,. .. a", "Hello, World. It's 12.5 don't", "word " * 5000, "½ Ⅷ 42nd .x ,y",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def test_word_counts_are_the_library_s(library):
    counter = WordCounter(open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8").read())
    texts = [t or "" for t in TEXTS]
    assert counter.count([t.encode() for t in texts]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_cache_holds_distinct_texts_and_is_used(spark, tmp_path, library):
    path = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, content_digest string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, tokenizer_file("word_bpe_49k.json"), path).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}
    stored = read_cache(spark, path).count()
    assert stored == len({" ".join((t or "").split(" ")) for t in TEXTS})
    again = count_tokens(df.unionByName(spark.createDataFrame([(99, "one more", 1, "x")], df.schema)), tokenizer_file("word_bpe_49k.json"), path)
    assert again.count() == len(TEXTS) + 1 and read_cache(spark, path).count() == stored + 1


def test_empty_table(spark, tmp_path):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file("word_bpe_49k.json"), f"file://{tmp_path}/c").count() == 0
