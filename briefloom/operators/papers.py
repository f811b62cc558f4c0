"""Evidence from the text of PDF pages: sections that run over pages, captions, pages with figures, pages under a budget.

Pages are rows (document, page, text). A page's lines stay in its row, as an array; only its last heading goes to the pages
after it, by a window over the document's pages. Sections, captions and scores are expressions over those arrays.

Defined cases: null and blank pages count as pages and hold nothing; pages of a null document are one document; rows of the
same document and page are taken in the order of their text; a document without any text has no sections and no captions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions.article import join_hyphens, stripped
from briefloom.functions.text import once

# Names of sections with the headings that open them, in the order in which a line is tried.
_NUMBER = r"(?:\d+(?:\.\d+)*[\s.]*)?"
SECTIONS = {
    "摘要": r"abstract|摘要",
    "引言": rf"{_NUMBER}(?:introduction|引言)",
    "方法": rf"{_NUMBER}(?:method(?:ology)?|approach|model|framework|proposed method|方法|模型|框架)",
    "实验": rf"{_NUMBER}(?:experiment(?:s|al setup)?|evaluation|implementation details|实验|评测)",
    "结果": rf"{_NUMBER}(?:result(?:s)?|analysis|discussion|ablation(?: study)?|结果|分析|讨论|消融实验)",
    "局限": rf"{_NUMBER}(?:limitations?|局限性?|局限)",
    "结论": rf"{_NUMBER}(?:conclusion(?:s)?|concluding remarks|结论|总结)",
}
# The name of what precedes all headings, the order of sections in the evidence, their limits.
BODY, ORDER = "正文", ("摘要", "引言", "方法", "实验", "结果", "局限", "结论", "正文")
SECTION_CHARS, EVIDENCE_CHARS, HEADING_CHARS = 4500, 26_000, 80
# What begins a caption, what makes its page worth showing, and limits.
CAPTION = r"^\s*(?:fig(?:ure)?|table|图|表)\s*[.\-:]?\s*(?:[A-Z]?\d+|[IVX]+)\b"
TELLING = r"result|accuracy|benchmark|performance|ablation|comparison|training curve|reward|evaluation|结果|准确率|基准|性能|消融"
TABULAR = r"^\s*(?:table|表)\b"
CAPTIONS, CAPTION_LINES, CAPTION_CHARS, CAPTION_LEAST, VISUAL_PAGES = 24, 3, 1200, 8, 4
# Words that make a policy's page worth reading, their points, the budget and the marks of pages.
DUTIES = r"\b(?:recommend|should|shall|required?|direct(?:s|ed)?|deadline|budget|funding|implementation|action plan)\b"
SUBJECTS = r"\b(?:artificial intelligence|AI|Genesis Mission|R&D|research|compute|dataset|infrastructure|autonomous laborator)\b"
DUTY_POINTS, SUBJECT_POINTS, VISUAL_POINTS = 5, 3, 10
DOCUMENT_CHARS, CAPTION_ROOM, HEAD_PAGES = 8000, 4000, 3

_BREAK = r"[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def _lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), _BREAK), lambda line: stripped(line)), lambda line: line != "")


def section_name(line: Column, sections: dict[str, str] = SECTIONS) -> Column:
    """The section that a line opens as its heading, else empty."""
    plain = F.btrim(F.regexp_replace(line, r"(?U)\s+", " "), F.lit(" \t.:"))
    name = F.lit("")
    for key, pattern in reversed(sections.items()):
        name = F.when(plain.rlike(rf"(?iU)^(?:{pattern})$"), key).otherwise(name)
    return F.when(F.length(plain) > HEADING_CHARS, "").otherwise(name)


def section_texts(pages: DataFrame, doc: str, page: str, text: str, sections: dict[str, str] = SECTIONS) -> DataFrame:
    """(doc, section, text) of every section with text; a section goes on over pages until the next heading, and may return."""
    heads = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), section_name(line, sections).alias("name"))), lambda h: h["name"] != "")
    rows = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("raw"), _lines(F.col(text)).alias("lines")).withColumn("heads", heads)
    before = Window.partitionBy("doc").orderBy("page", "raw").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last(F.get("heads", F.size("heads") - 1)["name"], ignorenulls=True).over(before), F.lit(BODY))
    opened = rows.withColumn("marks", F.concat(F.array(F.struct(F.lit(-1).alias("at"), carried.alias("name"))), "heads"))
    ends = lambda k: F.coalesce(F.get("marks", k + 1)["at"], F.size("lines"))
    pieces = F.transform("marks", lambda m, k: F.struct(k.alias("k"), m["name"].alias("section"), F.slice("lines", m["at"] + 2, ends(k) - m["at"] - 1).alias("part")))
    parts = opened.select("doc", "page", "raw", F.inline(pieces)).where(F.size("part") > 0)
    whole = parts.groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("page", "raw", "k", "part"))).alias("parts"))
    joined = F.array_join(F.flatten(F.transform("parts", lambda p: p["part"])), "\n")
    return whole.select(F.col("doc").alias(doc), "section", join_hyphens(joined).alias("text")).where("text <> ''")


def section_evidence(pages: DataFrame, doc: str, page: str, text: str, sections: dict[str, str] = SECTIONS, most: int = EVIDENCE_CHARS, most_section: int = SECTION_CHARS) -> DataFrame:
    """(doc, sections): title and excerpt of each section in the order of evidence, within the budgets."""
    found = section_texts(pages, doc, page, text, sections)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("section"))
    ordered = found.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("section").alias("title"), F.left("text", F.lit(most_section)).alias("text")))).alias("all"))

    def take(state: Column, s: Column) -> Column:
        excerpt = stripped(F.left(s["text"], F.least(F.lit(most_section), state["left"])))
        grown = F.concat(state["kept"], F.array(F.struct(s["title"].alias("title"), excerpt.alias("text"))))
        return F.when((state["left"] > 0) & (excerpt != ""), F.struct((state["left"] - F.length(excerpt)).alias("left"), grown.alias("kept"))).otherwise(state)

    none = F.struct(F.lit(most).alias("left"), F.array().cast("array<struct<title:string,text:string>>").alias("kept"))
    return ordered.select(doc, F.aggregate("all", none, take)["kept"].alias("sections"))


def captions(pages: DataFrame, doc: str, page: str, text: str, pattern: str = CAPTION, most: int = CAPTIONS) -> DataFrame:
    """(doc, page, place, caption): the first captions of each document, each with the two lines that follow it.

    A line that says no more than which figure it means is a reference in the text, not a caption.
    """
    begins = rf"(?iU){pattern}"
    rows = once(pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("raw")), raw=F.col("raw"))
    rows = once(rows, lines=_lines(F.col("raw")))
    told = lambda line: line.rlike(begins) & (F.length(F.btrim(F.regexp_replace(line, begins, ""), F.lit(" .|:—-"))) >= CAPTION_LEAST)
    places = F.filter(F.transform("lines", lambda line, i: F.when(told(line), i)), lambda i: i.isNotNull())
    found = rows.select("doc", "page", "raw", "lines", F.explode(places).alias("at"))
    found = found.select("doc", "page", "raw", "at", F.left(F.array_join(F.slice("lines", F.col("at") + 1, F.lit(CAPTION_LINES)), " "), F.lit(CAPTION_CHARS)).alias("caption"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("page", "raw", "at"))
    return found.withColumn("place", nth).where(F.col("place") <= most).select(F.col("doc").alias(doc), F.col("page").alias(page), "place", "caption")


def visual_pages(found: DataFrame, doc: str, page: str, most: int = VISUAL_PAGES) -> DataFrame:
    """(doc, pages): the pages whose captions promise most, in the order of pages; tables and results before others."""
    value = 1 + F.when(F.col("caption").rlike(rf"(?iU){TELLING}"), 4).otherwise(0) + F.when(F.col("caption").rlike(rf"(?iU){TABULAR}"), 2).otherwise(0)
    best = found.groupBy(doc, page).agg(F.max(value).alias("value"))
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("value"), page))
    return best.withColumn("nth", nth).where((F.col("nth") <= most) & (F.col(page) > 0)).groupBy(doc).agg(F.array_sort(F.collect_list(page)).alias("pages"))


def chosen_pages(pages: DataFrame, visual: DataFrame, doc: str, page: str, text: str, most: int = DOCUMENT_CHARS, duties: str = DUTIES, subjects: str = SUBJECTS) -> DataFrame:
    """(doc, page, nth, excerpt): pages of a policy in the order in which they are taken, until the budget is used.

    The first three pages say what the document is; then come pages by their points for duties, subjects and figures. Where
    one of the first three is blank, a page with figures takes its place, or else the next page.
    """
    shown = visual.select(F.col(doc).alias("doc"), F.explode("pages").alias("page")).withColumn("visual", F.lit(True))
    rows = once(pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text")), text=join_hyphens(F.col("text"), over_blanks=True)).where("text <> ''")
    rows = rows.alias("r").join(shown.alias("v"), F.expr("r.doc <=> v.doc AND r.page = v.page"), "left").select("r.*", F.coalesce("v.visual", F.lit(False)).alias("visual"))
    count = lambda pattern: F.regexp_count("text", F.lit(rf"(?iU){pattern}"))
    points = DUTY_POINTS * count(duties) + SUBJECT_POINTS * count(subjects) + F.when(F.col("visual"), VISUAL_POINTS).otherwise(0)
    rank = F.when(F.col("page") <= HEAD_PAGES, 0).when(F.col("visual"), 1).otherwise(2)
    whole = Window.partitionBy("doc")
    rows = rows.withColumns({"points": points, "first": F.row_number().over(whole.orderBy(rank, "page", "text"))})
    head = F.col("first") <= HEAD_PAGES
    taken = whole.orderBy(F.when(head, F.col("first")).otherwise(HEAD_PAGES + 1), F.when(head, 0).otherwise(-F.col("points")), "page", "text")
    chunk = F.concat(F.lit("[PDF 第 "), F.col("page").cast("string"), F.lit(" 页]\n"), F.col("text"))
    used = F.coalesce(F.sum(F.length("chunk")).over(taken.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = rows.withColumn("chunk", chunk).withColumns({"nth": F.row_number().over(taken), "used": used}).where(F.col("used") < most)
    return picked.select(F.col("doc").alias(doc), F.col("page").alias(page), "nth", F.left("chunk", (most - F.col("used")).cast("int")).alias("excerpt"))


def policy_evidence(pages: DataFrame, doc: str, page: str, text: str, most: int = DOCUMENT_CHARS, duties: str = DUTIES, subjects: str = SUBJECTS, caption: str = CAPTION) -> DataFrame:
    """(doc, n_pages, text, extracted_chars, selected_pages, n_captions, visual_pages): a document's evidence as one row."""
    cleaned = pages.withColumn(text, join_hyphens(F.col(text), over_blanks=True))
    told = captions(cleaned, doc, page, text, caption)
    shown = visual_pages(told, doc, page)
    picked = chosen_pages(pages, shown, doc, page, text, most, duties, subjects)
    parts = picked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("nth", page, "excerpt"))).alias("picked"))
    notes = told.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("place", page, "caption"))).alias("told"))
    met = pages.groupBy(doc).agg(F.count("*").alias("n_pages"))
    for side in (parts, notes, shown.withColumnRenamed("pages", "visual_pages")):
        other = side.withColumnRenamed(doc, "_doc")
        met = met.join(other, F.col(doc).eqNullSafe(F.col("_doc")), "left").drop("_doc")
    body = F.array_join(F.transform("picked", lambda p: p["excerpt"]), "\n\n")
    listed = F.array_join(F.transform("told", lambda t: F.concat(F.lit("[PDF 第 "), t[page].cast("string"), F.lit(" 页] "), t["caption"])), "\n")
    both = F.when(F.col("told").isNull(), F.coalesce(body, F.lit(""))).otherwise(F.left(F.concat(F.coalesce(body, F.lit("")), F.lit("\n\n【PDF 图表说明】\n"), listed), F.lit(most + CAPTION_ROOM)))
    chars = F.coalesce(F.aggregate("picked", F.lit(0), lambda n, p: n + F.length(p["excerpt"])), F.lit(0))
    return met.select(doc, "n_pages", stripped(both).alias("text"), chars.alias("extracted_chars"), F.transform("picked", lambda p: p[page]).alias("selected_pages"), F.coalesce(F.size("told"), F.lit(0)).alias("n_captions"), "visual_pages")
