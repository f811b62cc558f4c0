"""HTML and transcript texts whose structure needs a scan; batches of texts in pandas functions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a text may be cut behind, the best first.
BOUNDARIES = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", " ")

_DROPPED = re.compile(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1>|\Z)")
_TABLE = re.compile(r"(?is)<table\b[^>]*>(.*?)</table>")
_ROW, _CELL = re.compile(r"(?is)<tr\b[^>]*>(.*?)</tr>"), re.compile(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>")
_HEADING = re.compile(r"(?is)<h[2-5]\b[^>]*>(.*?)</h[2-5]>")
_BLOCK = re.compile(r"(?i)<br\s*/?>|</?(?:p|div|section|article|ul|ol|li|h1|h6|blockquote|pre|header|footer|figure|figcaption|main|nav)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")


def _line(text: str) -> str:
    return " ".join(_TAG.sub(" ", text).split())


def _table(found: re.Match) -> str:
    rows = [[c for cell in _CELL.findall(row) if (c := _line(cell))] for row in _ROW.findall(found[1])]
    lines = [" | ".join(row) for row in rows if row]
    return "\n\n" + "\n".join(lines) + "\n\n" if lines else " "


def paragraphs(text: str) -> str:
    """One blank within lines, one empty line between paragraphs."""
    lines = [" ".join(line.replace(" ", " ").replace("　", " ").split()) for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def text_of_html(html: str) -> str:
    """Paragraphs of a page, with tables as cells between bars and headings marked."""
    text = _DROPPED.sub(" ", html)
    text = _TABLE.sub(_table, text)
    text = _HEADING.sub(lambda m: f"\n\n## {_line(m[1])}\n\n" if _line(m[1]) else " ", text)
    return paragraphs(unescape(_TAG.sub(" ", _BLOCK.sub("\n\n", text))))


def article_of_html(html: str, least_share: float = 0.4) -> str:
    """The text of the container that holds most paragraph text, if it has enough of the page's; else of the page."""
    page = _DROPPED.sub(" ", html)
    mass = lambda part: sum(len(_line(p)) for p in re.findall(r"(?is)<p\b[^>]*>(.*?)</p>", part))
    parts = [m[0] for m in re.finditer(r"(?is)<(article|main)\b[^>]*>.*?</\1>", page)]
    best = max(parts, key=mass, default="")
    return text_of_html(best if best and mass(best) >= least_share * mass(page) else page)


def cut_on_boundary(text: str, limit: int) -> str:
    """At most ``limit`` characters, cut behind a paragraph, sentence or blank in the second half if there is one."""
    if len(text) <= limit:
        return text
    head = text[:limit]
    for mark in BOUNDARIES:
        at = head.rfind(mark)
        if at >= limit / 2:
            return head[: at + len(mark)].rstrip()
    return head.rstrip()


def clock(seconds: float) -> str:
    whole = max(0, int(seconds))
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"


_TIMING = re.compile(r"(?m)^.*?(?:(\d+):)?(\d{1,2}):(\d{2})(?:[.,]\d+)?[ \t]*-->.*$")


def _json_segments(content: str) -> list[tuple[int, str]]:
    """Segments of a JSON transcript; ``startTime`` is in milliseconds, ``start_time`` and ``start`` are in seconds."""
    try:
        data = pd.json_normalize(json.loads(content), "segments") if content.lstrip().startswith("{") else pd.json_normalize(json.loads(content))
    except (ValueError, KeyError, TypeError, AttributeError, NotImplementedError):
        return []
    column = lambda name: data[name] if name in data else pd.Series(None, data.index, dtype=object)
    spoken = column("body").where(column("body").astype(bool) & column("body").notna(), column("text")).fillna("").astype(str).map(_line)
    number = lambda name: pd.to_numeric(column(name), errors="coerce")
    seconds = (number("startTime") / 1000).fillna(number("start_time")).fillna(number("start")).fillna(0).astype(int)
    return [(s, t) for s, t in zip(seconds.tolist(), spoken, strict=True) if t]


def transcript_lines(content: str, media_type: str) -> list[tuple[int, str]]:
    """(second, text) of a VTT, SRT, JSON, HTML or plain transcript.

    A cue is what stands between its timing line and the next empty line; text without any timing line is a plain
    transcript, whose paragraphs all begin at 0.
    """
    kind, content = (media_type or "").lower(), content.replace("\r\n", "\n")
    if "json" in kind and (found := _json_segments(content)):
        return found
    timings = [] if "html" in kind else list(_TIMING.finditer(content))
    if timings:
        ends = [m.start() for m in timings[1:]] + [len(content)]
        cues = [(int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]), re.split(r"\n\s*\n", content[m.end() + 1 : end])[0]) for m, end in zip(timings, ends, strict=True)]
    else:
        cues = [(0, part) for part in ([content] if "html" in kind else re.split(r"\n\s*\n", content))]
    return [(second, text) for second, part in cues if (text := _line(part))]


def _batched(function):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: function(t or ""))

    return run


def chunks_of(text: str, limit: int) -> list[str]:
    """Paragraphs in order, joined by empty lines into chunks of at most ``limit`` characters; what is longer is cut at a boundary."""
    chunks: list[str] = []
    for part in filter(None, map(str.strip, text.split("\n\n"))):
        if chunks and len(chunks[-1]) + 2 + len(part) <= limit:
            chunks[-1] += "\n\n" + part
        else:
            chunks.append(part)
        while len(whole := chunks[-1]) > limit:
            head = cut_on_boundary(whole, limit)
            head = head if head and head != whole else whole[:limit]
            chunks[-1] = head
            if not (rest := whole[len(head) :].strip()):
                break
            chunks.append(rest)
    return chunks


def pack_paragraphs(text: Column, limit: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t or "", limit))

    return run(text)


html_to_text = _batched(text_of_html)
article_text = _batched(article_of_html)


@F.pandas_udf(T.ArrayType(T.StructType().add("second", "integer").add("text", "string")))
def parse_transcript(content: pd.Series, media_type: pd.Series) -> pd.Series:
    return pd.Series([[{"second": s, "text": t} for s, t in transcript_lines(c or "", m or "")] for c, m in zip(content, media_type, strict=True)])
