import random
import re

from pyspark.sql import functions as F

from briefloom.operators import papers

ALIASES = {"摘要": r"abstract", "方法": r"(?:\d+(?:\.\d+)*[\s.]*)?(?:method(?:ology)?|方法)", "结果": r"(?:\d+(?:\.\d+)*[\s.]*)?(?:results?|analysis)"}


def clean(text):
    text = re.sub(r"(?<=\w)-\n(?=\w)", "", text)
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def clean_policy(text):
    text = re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", text or "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def brute_sections(pages, most, most_section):
    found, current = {}, "正文"
    for text in pages:
        for line in (text or "").splitlines():
            plain = re.sub(r"\s+", " ", line).strip(" \t.:")
            name = next((k for k, p in ALIASES.items() if len(plain) <= 80 and re.fullmatch(p, plain, re.I)), "")
            if name:
                current = name
            elif line.strip():
                found.setdefault(current, []).append(line.strip())
    out, left = [], most
    for name in papers.ORDER:
        text = clean("\n".join(found.get(name, [])))
        excerpt = text[: min(most_section, max(0, left))].strip()
        if excerpt:
            out.append((name, excerpt))
            left -= len(excerpt)
    return out


def brute_captions(pages):
    out = []
    for number, text in enumerate(pages, 1):
        lines = [line.strip() for line in (text or "").splitlines() if line.strip()]
        for k, line in enumerate(lines):
            m = re.match(papers.CAPTION, line, re.I)
            if m and len(line[m.end() :].strip(" .|:—-")) >= 8:
                out.append((number, " ".join(lines[k : k + 3])[:1200]))
    return out[:24]


def brute_visual(told):
    best = sorted(told, key=lambda c: (-(1 + 4 * bool(re.search(papers.TELLING, c[1], re.I)) + 2 * bool(re.match(papers.TABULAR, c[1], re.I))), c[0]))
    return sorted(list(dict.fromkeys(p for p, _ in best))[:4])


def brute_policy(pages, most):
    texts = [clean_policy(t) for t in pages]
    told = brute_captions(texts)
    shown = brute_visual(told)
    order = [p for p in dict.fromkeys([1, 2, 3, *shown, *range(4, len(pages) + 1)]) if p <= len(pages) and texts[p - 1]]
    score = lambda p: 5 * len(re.findall(papers.DUTIES, texts[p - 1], re.I)) + 3 * len(re.findall(papers.SUBJECTS, texts[p - 1], re.I)) + 10 * (p in shown)
    used, parts = 0, []
    for p in order[:3] + sorted(order[3:], key=lambda p: (-score(p), p)):
        if used >= most:
            break
        parts.append((p, f"[PDF 第 {p} 页]\n{texts[p - 1]}"[: most - used]))
        used += len(parts[-1][1])
    text = "\n\n".join(t for _, t in parts)
    if told:
        text = f"{text}\n\n【PDF 图表说明】\n" + "\n".join(f"[PDF 第 {p} 页] {c}" for p, c in told)
        text = text[: most + 4000]
    return len(pages), text.strip(), used, [p for p, _ in parts], len(told), shown


def documents():
    rng = random.Random(7)
    lines = ["Abstract", "ABSTRACT.", "2.1 Methodology", "3 Results:", "analysis", "Results of the study are given in the text", " we should fund AI re-", "search now", "", "  ", "Figure 3. Accuracy of all models", "Fig. 4", "Table IV: comparison of rewards here", "表 2 各模型的准确率与性能对比", "图3是模型的整体框架与流程", "Table of contents of the book", "x" * 90, "shall be required by the deadline", "plain text of the page", "方法"]
    docs = {d: [rng.choice([None, "", "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 4, 15])))]) if rng.random() < 0.3 else "\n".join(rng.choice(lines) for _ in range(rng.choice([3, 12, 40]))) for _ in range(rng.choice([1, 2, 6, 11]))] for d in range(30)}
    docs[100] = [None]
    docs[101] = ["Figure 1. A caption that is told\r\nsecond third\x0cfourth"] * 30
    return docs


def rows(spark, docs):
    return spark.createDataFrame([(d, n, t, "kept") for d, pages in docs.items() for n, t in enumerate(pages, 1)], "doc long, no int, body string, page string").drop("page").repartition(3)


def test_sections_run_over_pages(spark):
    docs = documents()
    for most, most_section in ((26_000, 4500), (300, 120)):
        out = papers.section_evidence(rows(spark, docs), "doc", "no", "body", ALIASES, most, most_section)
        got = {r["doc"]: [tuple(s) for s in r["sections"]] for r in out.collect()}
        want = {d: brute_sections(pages, most, most_section) for d, pages in docs.items()}
        assert got == {d: s for d, s in want.items() if s}
    assert papers.section_evidence(rows(spark, docs).limit(0), "doc", "no", "body").count() == 0


def test_headings(spark):
    names = {"1. Introduction": "引言", "2.3 Proposed  Method": "方法", "Conclusions": "结论", "局限性": "局限", "Experimental Setup.": "实验", "The abstract": "", "Ablation study": "结果", "abstract" + " " * 100: "摘要", "model " * 20: ""}
    df = spark.createDataFrame([(k,) for k in names], "line string")
    assert {r["line"]: r["name"] for r in df.select("line", papers.section_name(F.col("line")).alias("name")).collect()} == names


def test_captions_and_visual_pages(spark):
    docs = documents()
    told = papers.captions(rows(spark, docs), "doc", "no", "body")
    got = {}
    for r in told.orderBy("doc", "place").collect():
        got.setdefault(r["doc"], []).append((r["no"], r["caption"]))
    want = {d: c for d, pages in docs.items() if (c := brute_captions(pages))}
    assert got == want and len(want[101]) == 24
    assert {r["doc"]: r["pages"] for r in papers.visual_pages(told, "doc", "no").collect()} == {d: brute_visual(c) for d, c in want.items()}


def test_policy_evidence_under_a_budget(spark):
    docs = documents()
    for most in (8000, 250):
        out = papers.policy_evidence(rows(spark, docs), "doc", "no", "body", most)
        got = {r["doc"]: (r["n_pages"], r["text"], r["extracted_chars"], r["selected_pages"] or [], r["n_captions"], r["visual_pages"] or []) for r in out.collect()}
        assert got == {d: brute_policy(pages, most) for d, pages in docs.items()}
    null = spark.createDataFrame([(None, 1, "one"), (None, 2, "two")], "doc long, no int, body string")
    row = papers.policy_evidence(null, "doc", "no", "body").first()
    assert (row["n_pages"], row["selected_pages"]) == (2, [1, 2])
