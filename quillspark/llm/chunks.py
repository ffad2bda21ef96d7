"""Operator 5, substring dedup by content-defined chunks.

A gear rolling hash runs over a document's bytes (its value depends on the last
32). A chunk ends where the hash is the least of the NEAR positions on either
side and over NEAR bytes from either end of the text, so chunks have over NEAR
bytes, 2 * NEAR + 1 on average, and their borders depend on nearby bytes alone:
behind an insertion the next border is the same as before. A text of 2 * NEAR
bytes or fewer is one chunk; a word said over and over, whose equal minima are
all borders, is one each time. In a run of one byte, where each place has the
same hash as the one before, only the first is a border; chunks over MAX_CHUNK
bytes, as there, are cut at every MAX_CHUNK bytes from their start.

A chunk is repeated where its digest (128 bits) is found twice. The first one, by
doc_id and then by place, stays; all later ones go, however few bytes they make
up. What a repeated passage has before its first border and behind its last stays.

Digests are counted by a partial aggregation before the shuffle; repeated ones
are joined back by an equi-join that the skew rule may split. No group is
gathered: a document gets the numbers of its own repeated chunks.

Null text is empty: nothing is removed. Rows that share doc_id and text are the
same document given again and are all treated alike; other texts of a doc_id, or
of a null one, are documents of their own, in the order of their hashes. Extra
columns are ignored, whatever their names. Empty table: an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, merge_spans, texts_of

NEAR = 32
MAX_CHUNK = 1024
PIECE = 1 << 22
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(x: np.ndarray) -> np.ndarray:
    """h = 2 h + GEAR[byte] in 32 bits, at every byte, by doubling."""
    h = GEAR[x]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """At each position, the least value within w positions on either side."""
    n, span = len(h), 2 * w + 1
    padded = np.full(-(-(n + 2 * w) // span) * span, np.iinfo(h.dtype).max, h.dtype)
    padded[w : w + n] = h
    rows = padded.reshape(-1, span)
    pre = np.minimum.accumulate(rows, 1).ravel()
    suf = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suf[:n], pre[span - 1 : span - 1 + n])


def borders(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text; the last is its length."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    x, ends = np.frombuffer(text, np.uint8), []
    for a in range(0, n, PIECE):  # overlapping pieces bound the memory
        lo, hi = max(0, a - 2 * NEAR - 32), min(n, a + PIECE + NEAR)
        h = gear(x[lo:hi])
        cut = np.flatnonzero(h == _least(h, NEAR)) + lo + 1
        ends.append(cut[(cut > a) & (cut <= min(n, a + PIECE))])
    cut = np.concatenate(ends)
    cut = cut[np.concatenate(([True], np.diff(cut) > 1))] if len(cut) else cut  # a run of one byte has one border
    cut = cut[(cut > NEAR) & (cut < n - NEAR)]  # or a letter or two at an end would be a chunk, which repeats by chance
    start = np.concatenate(([0], cut))
    size = np.diff(np.append(start, n))
    more = [np.arange(s + MAX_CHUNK, s + z, MAX_CHUNK) for s, z in zip(start[size > MAX_CHUNK], size[size > MAX_CHUNK], strict=True)]
    return np.unique(np.concatenate([cut, *more, [n]])).astype(np.int64)


def digests(text: bytes, ends: np.ndarray) -> list[bytes]:
    """Digests of 128 bits, trusted without a look at the bytes."""
    d, a, out = xxhash.xxh3_128_digest, 0, []
    for b in ends.tolist():
        out.append(d(text[a:b]))
        a = b
    return out


def removed(text: bytes, again: list[int]) -> list[tuple[int, int]]:
    """Byte spans to remove; again: numbers of the chunks that occurred before."""
    ends = borders(text)
    start = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return merge_spans([(int(start[i]), int(ends[i])) for i in again])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans, n_repeated, kept (binary) for every row."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            rows, at, d, local = [], [], [], []
            for i, t in enumerate(texts_of(b)):
                seen: set[bytes] = set()
                for k, x in enumerate(digests(t, borders(t))):
                    rows.append(i)
                    at.append(k)
                    d.append(x)
                    local.append(x in seen)
                    seen.add(x)
            take, both = pa.array(rows, pa.int32()), np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(at, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(local, pa.bool_())], ["doc_id", "h", "at", "d1", "d2", "inner"])

    chunks = keyed.mapInArrow(cut, f"doc_id {kind}, h long, at int, d1 long, d2 long, inner boolean")
    # more than one document, or twice in one
    key = F.struct("doc_id", "h")  # a document; structs order nulls first and compare them as equal
    known = chunks.groupBy("d1", "d2").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("inner").alias("twice")).where("twice OR first <> last")
    # as a table of its own, so that the join has plain shuffles on both sides and a skewed digest can be split
    found = chunks.join(Shelf(docs.sparkSession, "chunks").put(known.select("d1", "d2", "first")), ["d1", "d2"])
    later = (F.col("inner") | ~key.eqNullSafe(F.col("first"))).alias("later")
    listed = found.select("doc_id", "h", "at", later).groupBy("doc_id", "h").agg(F.collect_set(F.when(F.col("later"), F.col("at"))).alias("again"), F.collect_set("at").alias("repeated"))
    listed = listed.withColumnsRenamed({"doc_id": "doc_id2", "h": "h2"})
    both = keyed.join(listed, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("h") == F.col("h2")), "left").select("doc_id", "text", "again", "repeated")

    def drop(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t, again, repeated in zip(texts_of(b), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ends = borders(t)
                size = np.diff(np.concatenate(([0], ends)))
                spans = removed(t, again) if again else []
                kept, p = [], 0
                for x, y in spans:
                    kept.append(t[p:x])
                    p = y
                for c, v in zip(cols, (len(t), len(ends), sum(y - x for x, y in spans), len(spans), int(size[repeated].sum()) if repeated else 0, b"".join([*kept, t[p:]])), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], ["doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "n_repeated", "kept"])

    return both.mapInArrow(drop, f"doc_id {kind}, n_bytes long, n_chunks long, n_removed long, n_spans long, n_repeated long, kept binary")


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
