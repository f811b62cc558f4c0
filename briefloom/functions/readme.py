"""README texts: markdown beside HTML, with bars of links, set-up sections and tables, as plain paragraphs.

Lines are arrays. Bars of links are told from their neighbours among the lines that are not blank; what a heading drops is an
interval of lines, from the heading to the next one; tables keep one line a row. Only the HTML step in the middle is a
function in Python.

Defined cases: null and empty texts give an empty text; an open fence drops the rest; a heading of any level ends a dropped
section; blank lines beside dropped ones count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import html
from briefloom.functions.article import stripped
from briefloom.functions.similarity import bound
from briefloom.functions.text import single_blanks, where_held

# Sections that say nothing of what a project does, by their headings.
BOILERPLATE = (
    r"table\s+of\s+contents|contents|installation|install(?:ing)?|setup|requirements?|"
    r"prerequisites?|dependencies|quick\s*start|getting\s+started|usage|examples?|"
    r"development|developing|building|build\s+from\s+source|docker|deployment|deploy|"
    r"testing|tests|contributing|contributions?|contributors|code\s+of\s+conduct|"
    r"licen[sc]e|licensing|citation|citing|cite|acknowledge?ments?|"
    r"(?:seeking|getting)\s+help.*|community.*|contact(?:\s+us)?|media\s+kit.*|"
    r"stay\s+(?:up\s*to\s*date|updated|tuned).*|who(?:['’]s)?\s+using.*|disclaimer.*|"
    r"star\s+history|sponsors?|support|faq|changelog|release\s+notes|roadmap|security|"
    r"目录|安装|安装说明|部署|环境要求|依赖|快速开始|快速上手|快速入门|使用方法|使用说明|"
    r"用法|示例|样例|贡献|贡献指南|许可|许可证|开源许可|引用|致谢|更新日志|路线图|常见问题"
)
# Longest line that can be a bar, longest cell of a bar, its fewest cells, longest piece of a bar, longest heading without a mark.
BAR_CHARS, CELL_CHARS, LEAST_CELLS, PIECE_CHARS, BARE_HEADING = 400, 16, 3, 40, 40

_LINK = r"\[([^\]]*)\]\([^)]*\)"
_ONLY_BETWEEN = r"(?U)\A[|·•/\\\-—–>»\s]*+\z"
_FENCE = "`{3,}|~{3,}"
_DIVIDER = r"^\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-{2,}:?\s*\|?\s*$"


def bar_kind(line: Column) -> Column:
    """``link``: links and marks only; ``row``: a row of short names; ``pipe``: a short piece that ends in a bar; else empty."""
    cells = lambda plain: F.filter(F.transform(F.split(plain, r"\|"), lambda c: stripped(c)), lambda c: c != "")
    row = lambda cells: (F.size(cells) >= LEAST_CELLS) & ~F.exists(cells, lambda c: F.length(c) > CELL_CHARS)

    def kind(text: Column) -> Column:
        left_over = where_held(where_held(text, "](", (_LINK, "")), "<", (r"(?is)<a\b.*?</a>", ""), ("<[^>]+>", ""))
        plain = stripped(where_held(where_held(text, "](", (_LINK, "$1")), "<", ("<[^>]+>", "")))
        # Only a line with a bar is a row or a piece of one.
        by_bars = bound(plain, lambda p: F.when(bound(cells(p), row), "row").when(F.endswith(p, F.lit("|")) & (F.length(p) <= PIECE_CHARS), "pipe").otherwise(""))
        return (
            F.when((text == "") | (F.length(text) > BAR_CHARS), "")
            .when(left_over.rlike(_ONLY_BETWEEN), "link")
            .when(F.startswith(text, F.lit("|")) | ~F.contains(text, F.lit("|")), "")
            .otherwise(by_bars)
        )

    return bound(stripped(line), kind)


def without_bars(text: Column) -> Column:
    """The text without bars of links; a piece of a bar goes if a line beside it, blank ones aside, is part of a bar, too."""

    def marked(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("at"), bar_kind(line).alias("kind"))), lambda x: stripped(x["line"]) != "")

    def kept(filled: Column) -> Column:
        beside = lambda p: F.coalesce(F.get(filled, p)["kind"], F.lit("")) != ""
        gone = lambda x, p: x["kind"].isin("link", "row") | ((x["kind"] == "pipe") & (F.when(p > 0, beside(p - 1)).otherwise(False) | beside(p + 1)))
        return F.filter(F.transform(filled, lambda x, p: F.struct(x["line"].alias("line"), (x["at"] - p).alias("blanks"), gone(x, p).alias("gone"))), lambda x: ~x["gone"])

    def joined(rows: Column) -> Column:
        gap = lambda x, k: F.when(k == 0, "").when(F.get(rows, k - 1)["blanks"] != x["blanks"], "\n\n").otherwise("\n")
        return F.array_join(F.transform(rows, lambda x, k: F.concat(gap(x, k), x["line"])), "")

    return bound(bound(bound(F.split(text, "\n"), marked), kept), joined)


def without_sections(text: Column, names: str = BOILERPLATE) -> Column:
    """The text without the sections that ``names`` matches; a short line of that name is a heading, too."""
    skipped = rf"(?iU)^(?:{names})\s*[:：]?$"

    def opened(line: Column) -> Column:
        head = F.when(F.contains(line, F.lit("#")), F.regexp_extract(line, r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", 1)).otherwise("")
        skips = lambda name: stripped(F.regexp_replace(name, r"(?U)\s+", " ")).rlike(skipped)
        unmarked = bound(stripped(line), lambda bare: F.when((bare != "") & (F.length(bare) <= BARE_HEADING) & bare.rlike(skipped), True))
        return bound(head, lambda head: F.when(head != "", skips(head)).otherwise(unmarked))

    def kept(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("at"), opened(line).alias("skips"))), lambda h: h["skips"].isNotNull())
        spans = lambda marks: F.transform(marks, lambda m, k: F.when(m["skips"], F.slice(lines, 1, 0)).otherwise(F.slice(lines, m["at"] + 1, F.coalesce(F.get(marks, k + 1)["at"], F.size(lines)) - m["at"])))
        return F.array_join(F.flatten(bound(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(False).alias("skips"))), heads), spans)), "\n")

    return bound(F.split(text, "\n"), kept)


def table_rows(text: Column) -> Column:
    """Rows of markdown tables as cells between bars, without the line that divides head and body; empty cells stay."""

    def row(line: Column) -> Column:
        cells = lambda text: F.transform(F.split(F.btrim(text, F.lit("|")), r"\|"), lambda c: stripped(c))
        bars = lambda text: F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
        return bound(stripped(line), lambda text: F.when(F.startswith(text, F.lit("|")) & F.endswith(text, F.lit("|")) & (bars(text) >= 3), F.array_join(cells(text), " | ")).otherwise(line))

    # Dividers have bars, too.
    rows = lambda text: bound(F.split(text, "\n"), lambda lines: F.array_join(F.transform(F.filter(lines, lambda x: ~stripped(x).rlike(_DIVIDER)), row), "\n"))
    return bound(text, lambda text: F.when(F.contains(text, F.lit("|")), rows(text)).otherwise(text))


def without_code(raw: Column) -> Column:
    """The text without comments, fenced and preformatted code, and pictures."""
    text = F.coalesce(raw, F.lit(""))
    text = where_held(text, "<!--", ("(?s)<!--.*?-->", " "))
    closed, opened = r"(?msd)^[ \t]*({0})[^\n]*\n.*?^[ \t]*\1[ \t]*$", r"(?msd)^[ \t]*(?:{0})[^\n]*\n.*\z"
    fence = lambda t: F.contains(t, F.lit("```")) | F.contains(t, F.lit("~~~"))
    cut = lambda t: F.regexp_replace(F.regexp_replace(t, closed.replace("{0}", _FENCE), "\n"), opened.replace("{0}", _FENCE), "\n")
    text = bound(text, lambda t: F.when(fence(t), cut(t)).otherwise(t))
    text = where_held(text, "<", (r"(?is)<(pre|code)\b[^>]*>.*?</\1>", " "))
    return where_held(text, "![", (r"!\[[^\]]*\]\([^)]*\)", ""))


def with_readme_text(rows: DataFrame, raw: str, name: str, names: str = BOILERPLATE) -> DataFrame:
    """Adds ``name``: what a README says of its project, as paragraphs."""
    marked = rows.withColumn(name, without_bars(without_code(F.col(raw))))

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [html.text_of_html(text or "") for text in batch[name].to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(texts, pa.string()))

    text = table_rows(without_sections(F.col(name), names))
    text = where_held(text, "](", (_LINK, "$1"))
    text = F.regexp_replace(F.regexp_replace(text, r"(?Umd)^\s*[#>]+\s*", ""), "[*`~]+", "")
    text = where_held(single_blanks(text), "\n\n\n", ("\n{3,}", "\n\n"))
    # A step over batches stays apart from the array functions around it, which can hold no Python.
    return marked.mapInArrow(parsed, marked.schema).withColumn(name, stripped(text))
