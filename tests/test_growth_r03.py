"""Steps whose cost the findings F7 to F14 of round 3 named: what is computed once, or only where it can matter."""

import random
from difflib import SequenceMatcher
from html import unescape

import numpy as np
from pyspark.sql import functions as F

from briefloom.functions import article, dates, markdown, readme, text
from briefloom.llm import registry, sentencepiece_codec
from briefloom.operators import events, pairs, papers

ODD = ["", " ", "a", "　 a b  ", "\n\r\n a \x85", "\x1c a \x1f", "​ a", "a \n", "\t a", "a  ", "  "]


def shown(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_proxy_page_is_built_once(spark):
    """the page was built again wherever a step read it."""
    page = F.concat(F.lit("Title: "), F.regexp_replace("raw", "(?i)zebra", "horse"), F.lit("\n\nMarkdown Content:\n"), F.col("raw"))
    none = F.lit(None).cast("string")
    raw = "zebra stripes\n\n![z](/a.png) and a text that is long enough to be no label. It has two sentences.\n\nlogin"
    rows = spark.createDataFrame([(1, raw), (2, None)], "id int, raw string")
    pages = rows.select("id", page.alias("markdown"), F.lit("https://e.org/p").alias("url"), none.alias("title"), none.alias("published_raw"), none.alias("community_block"))
    items = markdown.proxy_items(pages)
    assert shown(items).count("zebra") == 1
    (row,) = items.collect()
    assert (row["id"], row["title"], [p["url"] for p in row["images"]]) == (1, "horse stripes", ["https://e.org/a.png"])
    assert row["body"] == "and a text that is long enough to be no label. It has two sentences."


def test_white_space_at_the_ends_as_the_pattern_takes_it(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select(article.stripped(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b"), text.single_blanks(F.col("t")).alias("c"), F.regexp_replace("t", "[ \t]+", " ").alias("d"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in df.collect())


def test_pictures_behind_the_last_that_is_kept_are_not_read(spark):
    """the first four that are content, each once, parameters aside."""
    marks = ["/a.png", "/logo.png", "/a.png?x=1", "b.png", "/c.svg", "//h.org/c.png", "d/../e.png", "/f.png"]
    body = " ".join(f"![p{i}]({m})" for i, m in enumerate(marks))
    found = spark.createDataFrame([(body,), ("",)], "t string").select(markdown.pictures_in(F.col("t"), F.lit("https://e.org/x/y")).alias("p")).collect()
    assert [(x["url"], x["alt"]) for x in found[0]["p"]] == [("https://e.org/a.png", "p0"), ("https://e.org/x/b.png", "p3"), ("https://h.org/c.png", "p5"), ("https://e.org/x/e.png", "p6")]
    assert found[1]["p"] == []


def test_first_and_last_paragraphs_among_many(spark):
    """paragraphs are tested one by one from the ends, however many lead in or are footers."""
    real = "This paragraph is long enough to be one. It has a second sentence."
    bodies = ["\n\n".join(["Menu"] * n + [real + str(n)] * (n % 3) + ["About us"] * n) for n in range(20)]
    rows = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, b string")
    got = {r["n"]: (r["lead"], r["plain"]) for r in rows.select("n", article.drop_leading(F.col("b"), F.lit("")).alias("lead"), article.drop_labels(F.col("b")).alias("plain")).collect()}
    for n, body in enumerate(bodies):
        kept = [real + str(n)] * (n % 3)
        assert got[n][0] == ("\n\n".join(kept + ["About us"] * n) if kept else body)
        assert got[n][1] == ("\n\n".join((["Menu"] if n else []) + kept[:1]) if kept else "")


def test_a_date_is_written_once_for_all_forms(spark):
    """F8, F10: the text of a date was made again for every form, group and part of the time, and empty parts were cast."""
    raw = F.concat(F.lit("zebra"), F.col("t"))
    rows = spark.createDataFrame([("2024-01-02",), ("",), (None,)], "t string")
    parsed = rows.select(dates.parse_date_ms(F.regexp_replace(raw, "zebra", ""), 1_706_659_200_000).alias("ms"))
    assert shown(parsed).count("(zebra, t") == 1
    assert [r["ms"] for r in parsed.collect()] == [1_704_153_600_000, None, None]


def test_parts_of_dates_that_are_no_numbers(spark):
    """F8: names of months, missing parts and long runs of digits."""
    texts = {"Jan 2, 2024": 1_704_153_600_000, "2 january 2024 3pm": 1_704_207_600_000, "2024-13-02": None, "02.01.24": 1_706_745_600_000, "13/01/2024 24:00": None, "20240102T010203.5+0530": 1_704_137_523_500, "2024-01-02 12345678901": None}
    got = {r["t"]: r["ms"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.parse_date_ms(F.col("t"), 1_706_659_200_000).alias("ms")).collect()}
    assert got == texts


def test_a_line_of_a_readme_is_read_once(spark):
    """the line and what is left of it were made again for every test."""
    lines = ["", "[a](b) | [c](d)", "<a href='x'>y</a> • <b>", "one | two | three", "| x | y | z |", "short |", "a|b", "· •", "plain", "| " + "x" * 500]
    kinds = spark.createDataFrame([(t,) for t in lines], "t string").select(readme.bar_kind(F.concat(F.lit("zebra"), F.col("t")).substr(6, 1000)).alias("k"))
    assert shown(kinds).count("zebra") == 1
    assert [r["k"] for r in kinds.collect()] == ["", "link", "link", "row", "", "pipe", "", "link", "", ""]


def test_pages_of_a_policy_are_cleaned_once(spark):
    """lines were made again to find the captions among them, and a page's words joined again to leave out empty pages."""
    pages = spark.createDataFrame([(1, 1, "Figure 1: a long enough caption\r\nsecond line\x85third"), (1, 2, " "), (1, 3, "co- \n operate x-\ny a -\nb")], "d int, p int, t string")
    told = papers.captions(pages.withColumn("t", F.regexp_replace("t", "zebra", "horse")), "d", "p", "t")
    assert shown(told).count("zebra") == 1
    assert [r["caption"] for r in told.collect()] == ["Figure 1: a long enough caption second line third"]
    none = told.groupBy("d").agg(F.collect_list("p").alias("pages")).where("false")
    picked = papers.chosen_pages(pages.withColumn("t", F.regexp_replace("t", "zebra", "horse")), none, "d", "p", "t")
    assert shown(picked).count("zebra") == 1
    assert [r["excerpt"].split("\n", 1)[1] for r in picked.orderBy("nth").collect()][1] == "cooperate xy a -\nb"


def test_only_entities_go_through_python(spark):
    """whole bodies went through Python, with as many in memory as a batch has rows."""
    texts = ["", "a", "&amp;amp; &lt;b&gt; &notit; &not &#65;&#x42 &#xD800; &unknown; && & &;", "&amp" + "x" * 40, "tail &copy", "&#0;&#128;&#x110000;", "一&nbsp;二&hellip;"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", article.unescape_text(F.col("t")).alias("u"))
    assert [r["u"] for r in df.collect()] == [*map(unescape, texts), ""]
    seen = article.clean_body(F.lit("x  \t\u00a0y \n\n\n \u3000z The Post a appeared first on b"), F.lit(None).cast("string"))
    assert spark.range(1).select(seen.alias("b")).first()["b"] == "x y\n\nz"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_characters_of(regexp_extract_all(" in plan


def test_a_worker_builds_its_trie_once():
    """op6: every task built the vocabulary's trie again and lost the words that it knew."""
    with open(registry.tokenizer_file("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    first = sentencepiece_codec.worker_trie(model)
    first.encode(["some words"])
    assert sentencepiece_codec.worker_trie(bytes(bytearray(model))) is first and first.memo


def test_cells_of_titles_are_tasks_and_long_texts_are_read_once(spark, tmp_path):
    """cells are few bytes, which made them one task, and titles were cut out of their pages three times."""
    rows = spark.createDataFrame([(d, d * 100 + n, f"title {n * 7919 % 1000} of a day {n}") for d in range(12) for n in range(20)], "day int, n long, title string")
    cells = pairs.alike_titles(rows.select(F.col("day").alias("grp"), F.col("n").alias("id"), F.col("title").alias("t")), 0.85)
    assert cells.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    path = str(tmp_path / "pages")
    rows.write.parquet(path)
    clustered = events.cluster(spark.read.parquet(path), ["day"], "title", ["n"])
    assert clustered.count() == 240 and not any(path in file for file in clustered.inputFiles())


def test_pairs_that_are_given_up_early_are_too_far_apart():
    """no pair that is alike enough is given up at a stop, whatever its lengths and wherever it differs."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = "".join(rng.choice("abcdeé ") for _ in range(rng.choice([12, 17, 30, 60, 90, 300])))
        for edits in (0, 1, 3, 6, 12):
            t = list(base)
            for _ in range(edits):
                k = rng.choice([0, len(t), rng.randrange(len(t) + 1)])
                t[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "ab"])
            texts.append("".join(t) or "a")
    size = np.array([len(t) for t in texts])
    kinds, masks = pairs._characters([t[: pairs.RUN] for t in texts])
    x, y = np.triu_indices(len(texts), 1)
    found = set(zip(*(side.tolist() for side in pairs._subsequent([(x, y)], size, kinds, masks, 0.85)), strict=True))
    want = {(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio() >= 0.85}
    assert want <= found and len(want) > 100
