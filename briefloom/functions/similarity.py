"""Same-event tests on titles: anchors as array expressions, and a sequence ratio in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing about which event a title is about.
STOP_WORDS = (
    "the", "and", "for", "with", "new", "how", "why", "what", "from", "its", "our", "are", "can", "will", "now", "you", "your", "this", "that", "than", "more", "next",
    "first", "into", "但", "ai", "llm", "model", "models", "open", "source", "using", "use", "launch", "launches", "launching", "introducing", "introduces", "announcing",
    "announces", "release", "releases", "released", "update", "updates", "available", "blog", "news", "post", "com", "www", "http", "https",
)
# What a title is freed of, and what counts as a word in it.
HYPE = "(?U)[^\\w一-鿿]+|(独家|详解|速递|刚刚|突发|重磅|报道|：|:)"
WORDS = r"[a-z][a-z0-9]*(?:[.-][a-z0-9]+)*|\d+(?:\.\d+)*"
# The share of words that titles of one entity have in common; the least length and the similarity of a title within another one.
SHARED_WORDS, LEAST_CONTAINED, CONTAINED = 0.55, 16, 0.92


def normalize_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), HYPE, "")


def anchors(text: Column) -> Column:
    """Latin words and numbers in order, without stop words and short words that hold no digit."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & ((F.length(w) >= 3) | w.rlike(r"\d")))


def bound(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often the function uses it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def bigrams(words: Column) -> Column:
    """Distinct adjacent pairs."""
    pairs = lambda w: F.slice(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.array_distinct(bound(words, pairs))


def is_name(word: Column) -> Column:
    return (F.length(word) >= 4) & ~word.rlike(r"\d")


def is_version(word: Column) -> Column:
    """Holds a digit and is no year."""
    return word.rlike(r"\d") & ~word.rlike(r"^(?:19|20)\d{2}$")


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - size + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(size)))
    return F.array_distinct(F.filter(bound(text, runs), lambda g: F.length(g) == size))


def entity_match(a: Column, b: Column, least: float = SHARED_WORDS) -> Column:
    """Two anchor lists share a name, a version, an adjacent pair and most of their words."""
    shared = F.array_intersect(a, b)
    most = F.size(shared) / F.size(F.array_union(a, b)) >= least
    return F.exists(shared, is_name) & F.exists(shared, is_version) & F.arrays_overlap(bigrams(a), bigrams(b)) & most


def context_match(a: Column, b: Column) -> Column:
    """Anchor lists of title and summary share two pairs and two names, or one pair and four names."""
    names = F.size(F.filter(F.array_intersect(a, b), is_name))
    pairs = F.size(F.array_intersect(bigrams(a), bigrams(b)))
    return ((pairs >= 2) & (names >= 2)) | ((pairs >= 1) & (names >= 4))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ratio_from(least: float):
    """A function of two texts: difflib's ratio where it is ``least`` or more, else null; cheap bounds are tried first."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def of(x: str, y: str) -> float | None:
            matcher = SequenceMatcher(None, x, y)
            found = matcher.ratio() if matcher.quick_ratio() >= least else 0.0
            return found if found >= least else None

        return pd.Series([of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts is above this, by their lengths."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a) + F.length(b))


def contained(a: Column, b: Column) -> Column:
    """One of two texts has 16 characters or more and is within the other."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(shorter) >= LEAST_CONTAINED) & F.contains(longer, shorter)


def title_similarity(a: Column, b: Column) -> Column:
    """Of normalised titles: 1 if equal, .92 if one of 16 characters or more is within the other, else the ratio."""
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(contained(a, b), F.lit(CONTAINED))
        .otherwise(sequence_ratio(a, b))
    )
