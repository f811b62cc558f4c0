import random
import re

from pyspark.sql import functions as F

from briefloom.functions import readme

LINK = r"\[([^\]]*)\]\([^)]*\)"


def kind(line):
    text = line.strip()
    if not text or len(text) > 400:
        return ""
    rest = re.sub("<[^>]+>", "", re.sub(r"(?is)<a\b.*?</a>", "", re.sub(LINK, "", text)))
    if not re.sub(r"[|·•/\\\-—–>»\s]+", "", rest):
        return "link"
    plain = re.sub("<[^>]+>", "", re.sub(LINK, r"\1", text)).strip()
    cells = [c.strip() for c in plain.split("|") if c.strip()]
    if text.startswith("|"):
        return ""
    if len(cells) >= 3 and max(map(len, cells)) <= 16:
        return "row"
    return "pipe" if plain.endswith("|") and len(plain) <= 40 else ""


def bars(text):
    lines = text.split("\n")
    filled = [i for i, line in enumerate(lines) if line.strip()]
    kinds = [kind(lines[i]) for i in filled]
    gone = {i for p, i in enumerate(filled) if kinds[p] in ("link", "row") or kinds[p] == "pipe" and any(kinds[q] for q in (p - 1, p + 1) if 0 <= q < len(kinds))}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone)


def sections(text):
    out, skips = [], False
    for line in text.split("\n"):
        m = re.match(r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", line)
        bare, match = line.strip(), lambda s: bool(re.match(rf"(?i)^(?:{readme.BOILERPLATE})\s*[:：]?$", s))
        if m:
            skips = match(re.sub(r"\s+", " ", m[1]).strip())
        elif bare and len(bare) <= 40 and match(bare):
            skips = True
        if not skips:
            out.append(line)
    return "\n".join(out)


def tables(text):
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if re.match(r"^\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-{2,}:?\s*\|?\s*$", s):
            continue
        out.append(" | ".join(c.strip() for c in s.strip("|").split("|")) if s.startswith("|") and s.endswith("|") and s.count("|") >= 3 else line)
    return "\n".join(out)


LINES = [
    "", "", "  ", "## Installation", "# Usage ##", "### What it does", "Install", "FAQ：", "Community and friends", "text of the project with words", "- item *one*", "> quoted `code`", "[docs](https://e.org/x)", "[a](b) | [c](d)", "See [the docs](https://e.org) now.",
    "English | 简体中文 | 日本語", "<b>English</b> |", "short |", "| Model | Params |", "| --- | :---: |", "| Phi-4 | | 14B |", "one | two | a cell that is longer than sixteen", "  # not so ###", "####### seven", "| [Docs](x) | [Blog](y) |", "许可证", "a - b", "·•", "x" * 401,
]


def test_steps_against_loops(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.choice([1, 3, 8, 30]))) for _ in range(150)] + [""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    steps = {"bars": (readme.without_bars, bars), "sections": (readme.without_sections, sections), "tables": (readme.table_rows, tables)}
    got = {r["id"]: r for r in rows.select("id", *[f(F.col("t")).alias(name) for name, (f, _) in steps.items()]).collect()}
    normal = lambda t: re.sub(r"\n\s*\n", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip()
    for i, text in enumerate(texts):
        assert normal(got[i]["bars"]) == normal(bars(text)), text
        assert got[i]["sections"] == sections(text) and got[i]["tables"] == tables(text)


def test_whole_readmes(spark):
    cases = {
        '<p><b>English</b> |\n<a href="./i18n/zh.md">简体中文</a> |\n<a href="./i18n/ja.md">日本語</a></p>\n\nAcme is a framework.\n\n## Installation\n\n```py\npython -m venv .env\n```\n': "Acme is a framework.",
        "See [the docs](https://example.com/docs) now.\n": "See the docs now.",
        "| [Docs](https://a.b) | [Blog](https://b.c) |\n\nFast serving.\n\n| Model | Params |\n| --- | --- |\n| Phi | 14B |\n": "Fast serving.\n\nModel | Params\nPhi | 14B",
        "# Name\n\n> Quick *start* of `it`\n\n## License\nMIT\n### More\n\nAbout the rest": "Name\nQuick start of it\nMore\n\nAbout the rest",
        "before\n~~~\nopen fence\nnever closed": "before",
        "<!-- hidden -->a<pre>code</pre>b ![badge](x.svg)": "a b",
        "": "",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "id int, t string")
    got = {r["id"]: r["out"] for r in readme.with_readme_text(rows, "t", "out").collect()}
    assert got == {i: out for i, out in enumerate(cases.values())} | {99: ""}
    long = spark.createDataFrame([("word line of text\n" * 50_000 + "## Usage\n" + "gone\n" * 50_000,)], "t string")
    assert readme.with_readme_text(long, "t", "t").select(F.length("t")).first()[0] == len("word line of text\n" * 50_000) - 1
