"""Text expressions: Column to Column, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow

#: Vocabularies up to this size may stand as literals in a plan.
LITERALS = 200
WORD = r"[\p{L}\p{M}\p{N}_]+(?:['\x{2019}.][\p{L}\p{M}\p{N}_]+)*"
BLANK = r"[\t\n\f\r\p{Z}]"


def _all(x: Column, pattern: str) -> Column:
    """All matches; a null text has none."""
    return F.coalesce(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _filled(x: Column) -> Column:
    return F.filter(x, lambda t: t != "")


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, also where fn's lambdas use it for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def words(x: Column, lowercase: bool = True, strip_numeric: bool = False, stopwords: list[str] | None = None) -> Column:
    out = _all(F.lower(x) if lowercase else x, WORD)
    if strip_numeric:
        out = F.filter(out, lambda t: ~t.rlike(r"^[\p{N}.,]+$"))
    return drop_tokens(out, stopwords) if stopwords else out


def characters(x: Column, lowercase: bool = True, strip_non_alphanum: bool = True) -> Column:
    """Graphemes, without those that are no letter or digit unless told otherwise."""
    x = F.lower(x) if lowercase else x
    return _all(x, r"[\p{L}\p{N}]\p{M}*" if strip_non_alphanum else r"(?s)\X")


def shingles(x: Column, n: int = 3, n_min: int | None = None, lowercase: bool = True, strip_non_alphanum: bool = True) -> Column:
    return ngrams(characters(x, lowercase, strip_non_alphanum), n, n_min or n, "")


def word_ngrams(x: Column, n: int = 3, n_min: int | None = None, ngram_delim: str = " ", lowercase: bool = True, stopwords: list[str] | None = None) -> Column:
    return ngrams(words(x, lowercase, stopwords=stopwords), n, n_min or n, ngram_delim)


def skip_ngrams(x: Column, n: int = 3, n_min: int = 1, k: int = 1, lowercase: bool = True, stopwords: list[str] | None = None) -> Column:
    """Word n-grams whose neighbours have up to k words between them, each once, by length and then by place."""
    return bind(words(x, lowercase, stopwords=stopwords), lambda t: _skipping(t, n, n_min, k))


def _skipping(t: Column, n: int, n_min: int, k: int) -> Column:
    starts = F.transform(t, lambda _, i: F.array(i))
    levels = [starts]
    for _ in range(1, n):
        starts = F.flatten(F.transform(starts, lambda p: F.transform(F.filter(F.sequence(F.lit(1), F.lit(k + 1)), lambda s: F.element_at(p, -1) + s < F.size(t)), lambda s: F.concat(p, F.array(F.element_at(p, -1) + s)))))
        levels.append(starts)
    paths = F.flatten(F.array(*levels[n_min - 1 :]))
    return F.array_distinct(F.transform(paths, lambda p: F.array_join(F.transform(p, lambda i: F.get(t, i)), " ")))


def sentences(x: Column, lowercase: bool = False, strip_punct: bool = False) -> Column:
    out = F.transform(F.split(F.regexp_replace(F.regexp_replace(x, r"[\n\r]", " "), r"([.!?]+['\"\)]*) +", "$1\n"), "\n"), lambda t: F.trim(t))
    if strip_punct:
        out = F.transform(out, lambda t: F.regexp_replace(t, r"\p{P}", ""))
    return _empty_if_null(_filled(F.transform(out, F.lower) if lowercase else out))


def lines(x: Column) -> Column:
    return _empty_if_null(_filled(F.split(x, "\n")))


def paragraphs(x: Column, paragraph_break: str = "\n\n") -> Column:
    return _empty_if_null(_filled(F.transform(F.split(x, F.lit(paragraph_break)), lambda t: F.regexp_replace(t, "\n", " "))))


def regex(x: Column, pattern: str = r"\s+") -> Column:
    return _empty_if_null(_filled(F.split(x, pattern)))


def _empty_if_null(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


#: Penn Treebank rules as published for its tokenizer, in order: (pattern, replacement). A quotation mark at the start of a text
#: comes under the first one, as a blank is put before it.
PTB = [
    (r'([ (\[{<])"', "$1`` "), (r"\.\.\.", " ... "), (r"[,;:@#$%&]", " $0 "), (r"([^.])([.])([\])}>\"']*)\s*$", "$1 $2$3 "), (r"[?!]", " $0 "),
    (r"[\]\[(){}<>]", " $0 "), (r"--", " -- "), (r'"', " '' "), (r"([^'])' ", "$1 ' "), (r"'([sSmMdD]) ", " '$1 "), (r"'(ll|LL|re|RE|ve|VE) ", " '$1 "), (r"n't ", " n't "), (r"N'T ", " N'T "),
    (r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i)\b(d)('ye)\b", "$1 $2"), (r"(?i)\b(gim|lem)(me)\b", "$1 $2"), (r"(?i)\b(gon|wan)(na)\b", "$1 $2"), (r"(?i)\b(got)(ta)\b", "$1 $2"), (r"(?i)'(t)(is|was)\b", "'$1 $2"),
]


def ptb(x: Column, lowercase: bool = False) -> Column:
    x = F.concat(F.lit(" "), F.lower(x) if lowercase else x, F.lit(" "))
    for pattern, to in PTB:
        x = F.regexp_replace(x, pattern, to)
    return regex(F.trim(x), r"\s+")


#: Kinds of token that step_tokenize takes by name.
KINDS: dict[str, Callable[..., Column]] = {
    "words": words,
    "characters": characters,
    "character_shingle": shingles,
    "ngrams": word_ngrams,
    "skip_ngrams": skip_ngrams,
    "sentences": sentences,
    "lines": lines,
    "paragraphs": paragraphs,
    "regex": regex,
    "ptb": ptb,
}


def ngrams(t: Column, n: int = 3, n_min: int | None = None, delim: str = "_") -> Column:
    """All n-grams of n_min to n tokens, shorter ones first. Arrays that are too short give none; null is empty."""
    n_min = n if n_min is None else n_min
    if n < 1 or n_min < 1 or n_min > n:
        raise ValueError(f"n-gram sizes must be 1 or more and in order, not {n_min} to {n}")

    def of(t: Column, k: int) -> Column:
        at = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, k), delim))

    return bind(_empty_if_null(t), lambda t: F.concat(*[of(t, k) for k in range(n_min, n + 1)]))


def _starts(s: Column) -> Column:
    """Where each run of equal elements of a sorted array begins."""
    at = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))


def runs(t: Column) -> Column:
    """The different elements of an array and how often each stands in it, as structs (token, n); nulls don't count.

    By sorting: n log n in one row, without a shuffle.
    """
    length = lambda s, at, i, k: (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long")
    of = lambda s: bind(_starts(s), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("token"), length(s, at, i, k).alias("n"))))
    return bind(F.sort_array(F.filter(_empty_if_null(t), lambda x: x.isNotNull())), of)


#: A bucket and a sum of signs in one long, so that numbers are sorted and not structs: the sum in the low bits, from MIDDLE up.
LOW = 40
MIDDLE = 1 << LOW - 1


def bucket_sums(t: Column, num_terms: int, signed: bool, scheme: str) -> Column:
    """The buckets of an array's tokens and the sums of their signs (counts, if not signed), as structs (bucket, value)."""
    packed = lambda b, v: F.shiftleft(b.cast("long"), LOW) + v + MIDDLE
    if scheme == "md5":  # the digest is computed once for each different token
        digits = lambda r: F.conv(F.substring(F.md5(r.token), 1, 10), 16, 10).cast("long")
        pair = lambda d, r: packed(F.shiftright(d, 8) % num_terms, r.n * (1 - 2 * d.bitwiseAND(F.lit(1)) if signed else 1))
        pairs = bind(runs(t), lambda found: F.zip_with(F.transform(found, digits), found, pair))
    else:
        pairs = F.transform(runs(t), lambda r: packed(bucket(r.token, num_terms, scheme), r.n * (sign(r.token, scheme) if signed else 1)))
    of = lambda x: F.shiftright(x, LOW)
    begins = lambda p: F.filter(F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (of(F.get(p, i)) != of(F.get(p, i - 1))))
    total = lambda p, at, i, k: F.aggregate(F.slice(p, i + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - i), F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit((1 << LOW) - 1)) - MIDDLE)
    summed = lambda p: bind(begins(p), lambda at: F.transform(at, lambda i, k: F.struct(of(F.get(p, i)).cast("int").alias("bucket"), total(p, at, i, k).alias("value"))))
    return bind(F.sort_array(pairs), summed)


def dense(sums: Column, num_terms: int) -> Column:
    """bucket_sums as an array of num_terms ints, the places between buckets filled with zeros."""
    before = lambda s, k: F.coalesce(F.get(s, k - 1).bucket, F.lit(-1))
    filled = lambda s: F.flatten(F.transform(s, lambda r, k: F.concat(F.array_repeat(F.lit(0), r.bucket - before(s, k) - 1), F.array(r.value.cast("int")))))
    return bind(sums, lambda s: F.concat(filled(s), F.array_repeat(F.lit(0), F.lit(num_terms - 1) - before(s, F.size(s)))))


def drop_tokens(t: Column, dropped: list[str]) -> Column:
    return F.filter(_empty_if_null(t), lambda x: ~x.isin(dropped)) if dropped else _empty_if_null(t)


def codes(t: Column, vocabulary: list[str], length: int = 100, padding: str = "pre", truncating: str = "pre") -> Column:
    """Places of the tokens in the vocabulary from 1, cut or filled with 0 to one length; 0 is also an unknown token."""
    if {padding, truncating} - {"pre", "post"}:
        raise ValueError("padding and truncating are 'pre' or 'post'")
    t = _empty_if_null(t)
    cut = bind(t, lambda t: F.when(F.size(t) > length, F.slice(t, F.size(t) - length + 1, length) if truncating == "pre" else F.slice(t, 1, length)).otherwise(t))
    if len(vocabulary) > LITERALS:  # a hash lookup instead of as many literals in the plan
        known = arrow.codes(vocabulary)(cut)
    else:
        place = F.create_map(*[y for i, v in enumerate(vocabulary, 1) for y in (F.lit(v), F.lit(i))]) if vocabulary else F.create_map().cast("map<string,int>")
        known = F.transform(cut, lambda x: F.coalesce(F.try_element_at(place, x), F.lit(0)))
    fill = lambda k: F.array_repeat(F.lit(0), F.lit(length) - F.size(k))
    return bind(known, lambda k: F.concat(fill(k), k) if padding == "pre" else F.concat(k, fill(k)))


def _md5_bucket(digest: Column, num_terms: int) -> Column:
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % num_terms).cast("int")


def _md5_sign(digest: Column) -> Column:
    return F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)


def bucket(x: Column, num_terms: int, scheme: str = "murmur") -> Column:
    """A token's bucket from 0. md5 is the portable scheme: the first 8 hex digits modulo num_terms."""
    return _md5_bucket(F.md5(x), num_terms) if scheme == "md5" else F.pmod(F.hash(x), F.lit(num_terms)).cast("int")


def sign(x: Column, scheme: str = "murmur") -> Column:
    """-1 or 1, from other bits than the bucket's."""
    return _md5_sign(F.md5(x)) if scheme == "md5" else F.when(F.hash(F.lit(1), x) >= 0, 1).otherwise(-1)
