"""Counts over a text column, all of one pass and without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, WORD

# The word groups of the counting functions.
FIRST_PERSON = ["i", "me", "myself", "my", "mine", "this"]
FIRST_PERSON_PLURAL = ["we", "us", "our", "ours", "these"]
SECOND_PERSON = ["you", "yours", "your", "yourself"]
SECOND_PERSON_PLURAL = ["he", "she", "it", "its", "his", "hers"]
THIRD_PERSON = ["they", "them", "theirs", "their", "they're", "their's", "those", "that"]
TO_BE = ["am", "is", "are", "was", "were", "being", "been", "be", "were", "be"]
PREPOSITIONS = [
    "about", "below", "excepting", "off", "toward", "above", "beneath", "on", "under", "across", "from", "onto", "underneath", "after", "between", "in", "out", "until", "against",
    "beyond", "outside", "up", "along", "but", "inside", "over", "upon", "among", "by", "past", "around", "concerning", "regarding", "with", "at", "despite", "into", "since", "within",
    "down", "like", "through", "without", "before", "during", "near", "throughout", "behind", "except", "of", "to", "for",
]


def _count(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(F.regexp_count(x, F.lit(pattern)), F.lit(0))


def _distinct(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))), F.lit(0))


def _group(words: list[str]) -> Callable[[Column], Column]:
    """How many entries the whole text equals: at most 1, but for words listed twice."""
    return lambda x: F.coalesce(sum(F.when(x.isin([w for w in words if words.count(w) >= k]), 1).otherwise(0) for k in sorted({words.count(w) for w in words})), F.lit(0))


COUNT_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "n_words": _count(WORD),
    "n_uq_words": _distinct(WORD),
    "n_charS": lambda x: F.coalesce(F.char_length(F.regexp_replace(x, BLANK, "")), F.lit(0)),
    "n_uq_charS": lambda x: F.coalesce(F.size(F.array_distinct(F.regexp_extract_all(F.regexp_replace(x, BLANK, ""), F.lit(r"(?s)\X"), F.lit(0)))), F.lit(0)),
    "n_digits": _count(r"\p{Nd}"),
    "n_hashtags": _count(r"#[\p{IsAlphabetic}\p{Nd}_]+"),
    "n_uq_hashtags": _distinct(r"#[\p{IsAlphabetic}\p{Nd}_]+"),
    "n_mentions": _count(r"@[^\t\n\f\r\p{Z}]+"),
    "n_uq_mentions": _distinct(r"@[^\t\n\f\r\p{Z}]+"),
    "n_commas": _count(","),
    "n_periods": _count(r"\."),
    "n_exclaims": _count("!"),
    "n_extraspaces": _count(rf"{BLANK}{{2}}|\t|\n"),
    "n_caps": _count(r"\p{IsUppercase}"),
    "n_lowers": _count(r"\p{IsLowercase}"),
    "n_urls": _count("https?"),
    "n_uq_urls": _distinct("https?"),
    "n_nonasciis": lambda x: F.coalesce(F.octet_length(F.regexp_replace(x, r"[\x00-\x7F]", "")), F.lit(0)),
    "n_puncts": lambda x: F.coalesce(F.regexp_count(F.regexp_replace(x, "[!.,]", ""), F.lit(r"\p{P}")), F.lit(0)),
    "first_person": _group(FIRST_PERSON),
    "first_personp": _group(FIRST_PERSON_PLURAL),
    "second_person": _group(SECOND_PERSON),
    "second_personp": _group(SECOND_PERSON_PLURAL),
    "third_person": _group(THIRD_PERSON),
    "to_be": _group(TO_BE),
    "prepositions": _group(PREPOSITIONS),
}


def token_counts(tokens: Column) -> dict[str, Column]:
    """The word groups counted over a token array instead of the whole text."""
    groups = {"first_person": FIRST_PERSON, "first_personp": FIRST_PERSON_PLURAL, "second_person": SECOND_PERSON, "second_personp": SECOND_PERSON_PLURAL, "third_person": THIRD_PERSON, "to_be": TO_BE, "prepositions": PREPOSITIONS}
    among = lambda g: F.size(F.filter(tokens, lambda t: t.isin(g)))
    return {f"{k}_tokens": among(g) for k, g in groups.items()}
