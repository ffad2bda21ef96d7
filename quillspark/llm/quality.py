"""Operator 7, line-first quality rules.

Lines are judged one by one: navigation (cells parted by bars or arrows),
symbols, shouting, stammering, boilerplate phrases, stubs without an end mark,
and repeats of an earlier line. Failing lines are removed. A document that
loses over MAX_LOSS of its letters and digits is rejected, and so is one that
fails the base rules: under MIN_WORDS words, or over MAX_REPEAT per cent of its
words in 5-word windows found twice or more.

Null text is empty: no words, so it fails. Texts are read whole, each in time
linear in its length (n log n for the windows). Repeated rows and null ids each get
a row; extra columns are ignored, whatever their names. Empty table: an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, texts_of

MIN_WORDS, MAX_REPEAT, WINDOW, MAX_LOSS = 10, 20, 5, 0.5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
NOT_CODE_POINT = SPACE + bytes(range(0x80, 0xC0))  # blanks and continuation bytes
BARS = frozenset((b"|", b">", b"<", b"/", b"-", b"*", "»".encode(), "•".encode(), "·".encode()))
END = re.compile(rb"[.!?:;,)\"'\]]\s*$|[^\x00-\x7f]\s*$")
BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|enable javascript|click here|sign up for|log ?in to|subscribe to our|powered by|back to top|skip to (?:main )?content",
    re.I,
)


def repeat_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that stand twice or more in ids."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for j in range(1, WINDOW):  # exact names for ever longer windows
        step = ids[j : j + n].astype(np.int64)
        key = np.unique(key * (int(step.max()) + 1) + step, return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def bad_line(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a rule."""
    n = len(words)
    if n <= 2 and not END.search(line):
        return True  # a stub without an end mark
    bars = sum(w in BARS for w in words)
    if n >= 3 and bars >= 2 and 5 * bars >= n:
        return True  # navigation
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols >= 3 and 12 * symbols >= len(line):
        return True
    marks = line.count(b"!!")
    if marks >= 3 and 3 * marks >= n:
        return True  # shouting
    if n >= 6 and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) >= n:
        return True  # stammering
    if n <= 40 and BOILERPLATE.search(line):
        return True
    return n >= 6 and line.isupper() and 2 * sum(c > 64 and c < 91 for c in line) > len(line)


def clean(text: bytes) -> tuple[bytes, int, int]:
    """(the text without failing lines, lines removed, lines with words equal to an earlier one)."""
    kept, seen, gone, repeats = [], set(), 0, 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            kept.append(line)
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        if again or bad_line(line, words):
            gone += 1
        else:
            kept.append(line)
    return b"\n".join(kept), gone, repeats


def judge(text: bytes, ids: dict[bytes, int]) -> tuple[int, int, int, int, int, bool, bool, int, bytes]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed, cleaned text)."""
    words = text.split()
    n = len(words)
    repeat = repeat_words(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64))
    chars = len(text.translate(None, NOT_CODE_POINT))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    left, gone, lines = clean(text)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT * n
    kept = not failed and len(left.translate(None, NOT_CODE_POINT)) >= (1 - MAX_LOSS) * chars
    return n, chars, symbols, lines, repeat, failed, kept, gone, left


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "cleaned")


def rules(docs: DataFrame) -> DataFrame:
    """doc_id and the columns NAMES for every row; ``cleaned`` is the text without failing lines."""
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]

    def run(batches):
        ids: dict[bytes, int] = {}
        for b in slices(batches):
            if len(ids) > 500_000:
                ids.clear()
            rows = [judge(t, ids) for t in texts_of(b)]
            cols = [[r[i] for r in rows] for i in range(8)] + [[r[8].decode() for r in rows]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, cleaned string")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cleaned")


#: The same in DuckDB: words, lines and windows as rows.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS t FROM d),
base AS (SELECT r, doc_id, len(t) AS n, coalesce(list_sum(list_transform(t, lambda v: length(v))), 0) AS chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols FROM w),
windows AS (SELECT r, i, array_to_string(t[i:i+4], ' ') AS k FROM (SELECT r, t, unnest(range(1, len(t) - 3)) AS i FROM w WHERE len(t) > 4)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT p) AS repeat FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, i, s[i] AS line FROM (SELECT r, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT r, string_split(x, chr(10)) AS s FROM d))),
worded AS (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS t FROM lines),
counted AS (
  SELECT r, line, t, len(t) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
    len(list_filter(t, lambda v: v IN ('|', '>', '<', '/', '-', '*', '»', '•', '·'))) AS bars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '!!')) AS marks,
    len(list_filter(range(1, len(t)), lambda j: t[j] = t[j + 1])) AS stammers, len(regexp_extract_all(line, '[A-Z]')) AS capitals
  FROM worded WHERE len(t) > 0
),
judged AS (
  SELECT r, again, list_sum(list_transform(t, lambda v: length(v))) AS chars, again
    OR (n <= 2 AND NOT regexp_matches(line, '([.!?:;,)"''\]]|[^\x00-\x7F])[\x20\x09-\x0D]*$'))
    OR (n >= 3 AND bars >= 2 AND 5 * bars >= n)
    OR (symbols >= 3 AND 12 * symbols >= strlen(line))
    OR (marks >= 3 AND 3 * marks >= n)
    OR (n >= 6 AND 2 * stammers >= n)
    OR (n <= 40 AND regexp_matches(line, '(?i)BOILERPLATE'))
    OR (n >= 6 AND NOT regexp_matches(line, '[a-z]') AND 2 * capitals > strlen(line)) AS gone
  FROM counted
),
lost AS (SELECT r, count(*) FILTER (again) AS again, count(*) FILTER (gone) AS gone, coalesce(sum(chars) FILTER (gone), 0) AS chars FROM judged GROUP BY r),
summed AS (
  SELECT base.*, coalesce(repeat, 0) AS repeat, coalesce(lost.again, 0) AS again, coalesce(lost.gone, 0) AS gone, coalesce(lost.chars, 0) AS lost,
    base.n < 10 OR 100 * coalesce(repeat, 0) > 20 * base.n AS failed
  FROM base LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(again AS BIGINT) AS n_dup_lines, CAST(repeat AS BIGINT) AS n_repeat_words,
  failed AS base_failed, NOT failed AND chars - lost >= 0.5 * chars AS kept, CAST(gone AS BIGINT) AS n_lines_removed
FROM summed
""".replace("BOILERPLATE", BOILERPLATE.pattern.decode())
