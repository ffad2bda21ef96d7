"""Functions over token arrays that have no built-in form: Arrow in, Arrow out, one call of a Python function for each different token of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = "array<string>"
BLOCK = 1 << 15  # tokens whose vectors are held at once
TEXT_BYTES = 1 << 20  # of text whose tokens are held at once, or one text
WORD_CHARS = 1 << 21  # of words whose pieces are kept for later ones


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rebuilt(sizes: np.ndarray, flat: pa.Array) -> pa.ListArray:
    """Rows of these sizes; null rows become empty."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)


def map_tokens(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """fn of every token; a null token stays null."""

    @F.arrow_udf(TOKENS)
    def run(x: pa.Array) -> pa.Array:
        words = x.flatten().dictionary_encode()
        made = pa.array([None if w is None else fn(w) for w in words.dictionary.to_pylist()], pa.string())
        return _rebuilt(_sizes(x), made.take(words.indices))

    return run


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of TEXT_BYTES at most, or of one text: the tokens of a whole batch can take a hundred times its memory."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + TEXT_BYTES, "right")))
        yield texts.slice(i, j - i)
        i = j


def word_pieces(batches: Iterator[pa.Array], split: Callable[[str], list[str]], pieces: Callable[[list[str]], list[list[str]]]) -> Iterator[pa.ListArray]:
    """The pieces of the words of each text, in batches of their own size; a null text has none."""
    known: dict[str, list[str]] = {}
    room = WORD_CHARS
    for batch in batches:
        for x in parts(batch):
            texts = [split(t) if t else [] for t in x.to_pylist()]
            words = pa.array((w for t in texts for w in t), pa.string()).dictionary_encode()
            different = words.dictionary.to_pylist()
            made = {w: known[w] for w in different if w in known}
            new = [w for w in different if w not in made]
            if (room := room - sum(map(len, new))) < 0:
                known, room = {}, WORD_CHARS
            made |= (got := dict(zip(new, pieces(new), strict=True)))
            known |= got
            of_word = pa.array([made[w] for w in different], pa.list_(pa.string())).take(words.indices)
            ends = np.concatenate(([0], np.cumsum(_sizes(of_word))))
            at = np.cumsum([0, *map(len, texts)])
            yield _rebuilt(np.diff(ends[at]), of_word.flatten())


def map_words(split: Callable[[str], list[str]], pieces: Callable[[list[str]], list[list[str]]]) -> Callable[[Column], Column]:
    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from word_pieces(batches, split, pieces)

    return run


def codes(vocabulary: list[str]) -> Callable[[Column], Column]:
    """Places in the vocabulary from 1; 0 is an unknown token."""
    known = pa.array(vocabulary, pa.string())

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        at = pc.fill_null(pc.index_in(x.flatten(), value_set=known), -1)
        return _rebuilt(_sizes(x), pc.add(at, 1).cast(pa.int32()))

    return run


def keep_tokens(vocabulary: list[str]) -> Callable[[Column], Column]:
    """The tokens that are in the vocabulary."""
    known = pa.array(vocabulary, pa.string())

    @F.arrow_udf(TOKENS)
    def run(x: pa.Array) -> pa.Array:
        flat, sizes = x.flatten(), _sizes(x)
        keep = pc.is_in(flat, value_set=known)
        row = np.repeat(np.arange(len(sizes)), sizes)[keep.to_numpy(zero_copy_only=False)]
        return _rebuilt(np.bincount(row, minlength=len(sizes)), flat.filter(keep))

    return run


def pool_rows(row: np.ndarray, at: np.ndarray, matrix: np.ndarray, n: int, how: str, default: float) -> np.ndarray:
    """For each of n rows, the sum, mean, min or max of the matrix's lines ``at`` that stand in it (row ascends).

    NaN doesn't count; a value that nothing counts for is the default.
    """
    d = matrix.shape[1]
    ufunc, start = {"sum": (np.add, 0.0), "mean": (np.add, 0.0), "min": (np.fmin, np.nan), "max": (np.fmax, np.nan)}[how]
    out, count = np.full((n, d), start), np.zeros((n, d), np.int64)
    for i in range(0, len(at), BLOCK):  # blocks bound the memory, in a long row too
        r, x = row[i : i + BLOCK], matrix[at[i : i + BLOCK]]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        there = ~np.isnan(x)
        count[r[first]] += np.add.reduceat(there, first, 0, dtype=np.int64)
        part = ufunc.reduceat(np.where(there, x, 0.0) if ufunc is np.add else x, first, 0)
        out[r[first]] = ufunc(out[r[first]], part)
    if how == "mean":
        out /= np.maximum(count, 1)
    out[count == 0] = default
    return out


def pooled(tokens: list[str], matrix: np.ndarray, how: str, default: float, broadcast: Callable) -> Callable[[Column], Column]:
    """The pooled vectors of a row's tokens, an array of doubles; the table is sent to each executor once."""
    shared = broadcast((pa.array(tokens, pa.string()), matrix))

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, lines = shared.value
        for x in batches:
            sizes = _sizes(x)
            at = pc.fill_null(pc.index_in(x.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            row, found = np.repeat(np.arange(len(sizes)), sizes), at >= 0
            out = pool_rows(row[found], at[found], lines, len(sizes), how, default)
            yield _rebuilt(np.full(len(sizes), lines.shape[1]), pa.array(out.ravel()))

    return run
