"""Operator 3, SimHash near-duplicates by meeting in the middle.

Two fingerprints at distance 4 or less have a variant in common that is at most
2 flips from each. Every distinct fingerprint so belongs to the ball of its
2081 variants; fingerprints that meet at a variant are within 4 of each other
(triangle inequality), so a star for each variant links them without pairing a
group with itself.

The variants are shuffled in a short form. They are bucketed by their leading
bits, and instead of each variant its fingerprint goes to the bucket once (1 +
b + b(b-1)/2 buckets of b bits), where the variants that belong there are
written out, sorted and compared. A bucket that many fingerprints fall in, such
as the near copies of one text, is divided by a linear hash of the other bits;
a task takes some of its sub-buckets in turn, and the largest go to several tasks.

Fingerprints are linked once for all documents that share them.

Null and word-less texts have fingerprint zero, linked like any other. Repeated
rows each get a row. A component's id is its smallest doc_id (null ids are
passed over). Extra columns are ignored. Empty table: an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, free, texts_of
from .graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BALL = 2081  # variants of at most RADIUS // 2 flips of 64 bits
VARIANTS_PER_BUCKET = 4_000_000
MAX_BITS = 18
PASSES = 6  # log2 of the sub-buckets that a task takes in turn
FLUSH = 200_000
PIECE = 200_000


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    count, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for i in range(0, n, PIECE):  # bounds the memory of a very long text
        j = min(n, i + PIECE)
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(start[i:j].tolist(), end[i + SHINGLE - 1 : j + SHINGLE - 1].tolist(), strict=True)], np.uint64)
        count += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=None)
def _masks(bits: int, flips: int) -> np.ndarray:
    """All masks of at most ``flips`` of the ``bits`` low bits."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    parts = [np.zeros(1, np.uint64)]
    if flips >= 1:
        parts.append(one)
    if flips >= 2:
        i, j = np.triu_indices(bits, 1)
        parts.append(one[i] | one[j])
    return np.concatenate(parts)


#: Rows of a random linear map over the low bits; row k gives bit k of the sub-bucket.
LINEAR = np.random.default_rng(11).integers(1, 1 << 62, 24, dtype=np.uint64)


def _linear(x: np.ndarray, bits: int) -> np.ndarray:
    """A hash with f(x ^ y) = f(x) ^ f(y)."""
    out = np.zeros(len(x), np.int64)
    for k, row in enumerate(LINEAR[:bits]):
        out |= (np.bitwise_count(x & row) & 1).astype(np.int64) << k
    return out


def _split(x: np.ndarray, code: np.ndarray, sub_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """x in the order of its codes, and where each code begins."""
    order = np.argsort(code, kind="stable")
    return x[order], np.searchsorted(code[order], np.arange((1 << sub_bits) + 1))


def _meet(fps: np.ndarray, prefix: int, bits: int, subs: range, sub_bits: int):
    """For each of these sub-buckets, links of the fingerprints that meet in it, as a forest of stars."""
    fps = np.unique(fps)
    low = 64 - bits
    near = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)) if bits else np.zeros(len(fps), np.uint8)
    body = fps & np.uint64((1 << low) - 1)
    sides = []
    for gone in range(RADIUS // 2 + 1):
        who = np.flatnonzero(near == gone)
        masks = _masks(low, RADIUS // 2 - gone)
        sides.append((*_split(who, _linear(body[who], sub_bits), sub_bits), *_split(masks, _linear(masks, sub_bits), sub_bits)))
    for sub in subs:
        variants, owners = [], []
        for who, first, masks, begin in sides:
            for t in np.flatnonzero(np.diff(first)).tolist():
                w, m = who[first[t] : first[t + 1]], masks[begin[t ^ sub] : begin[(t ^ sub) + 1]]
                if len(m):
                    variants.append((body[w][:, None] ^ m).ravel())
                    owners.append(np.repeat(w, len(m)))
        if not variants:
            continue
        v, o = np.concatenate(variants), np.concatenate(owners).astype(np.int32)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        if not len(same):
            continue
        # neighbours in a run of equal variants are linked: a chain joins the run
        pairs = np.unique(np.minimum(o[same], o[same + 1]).astype(np.int64) << 32 | np.maximum(o[same], o[same + 1]))
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
        a, b = a[ok], b[ok]
        root = np.arange(len(fps))
        while True:  # smallest index reachable, by hooking and jumping
            old = root.copy()
            low_ab = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low_ab)
            np.minimum.at(root, root[b], low_ab)
            np.minimum.at(root, a, low_ab)
            np.minimum.at(root, b, low_ab)
            root = root[root]
            if (root == old).all():
                break
        node = np.flatnonzero(root != np.arange(len(fps)))
        yield fps[node], fps[root[node]]


def _loads(held: np.ndarray, bits: int) -> np.ndarray:
    """Variants that belong to each bucket; held: fingerprints by their leading bits."""
    at = np.arange(1 << bits)
    flipped = lambda x: sum(x[at ^ (1 << k)] for k in range(bits))
    one = flipped(held)
    two = (flipped(one) - bits * held) // 2  # two flips in turn: each pair twice, and back again
    return sum(x * len(_masks(64 - bits, RADIUS // 2 - gone)) for gone, x in enumerate((held, one, two)))


def links(distinct: DataFrame, shelf: Shelf) -> DataFrame:
    """Links (a, b) of the table ``distinct(fp)`` that join all within RADIUS."""
    n = distinct.count()
    bits = min(MAX_BITS, max(6, math.ceil(math.log2(max(1, n) * BALL / VARIANTS_PER_BUCKET))))
    low = 64 - bits
    # 2^bits counts at most: the only thing gathered, to plan the sub-buckets
    counts = np.zeros(1 << bits, np.int64)
    for p, c in distinct.groupBy(F.shiftrightunsigned("fp", low).alias("p")).count().collect():
        counts[p] = c
    flips = _masks(bits, RADIUS // 2).tolist()
    size = np.ceil(np.log2(np.maximum(_loads(counts, bits) / VARIANTS_PER_BUCKET, 1))).astype(int)
    deep = {int(p): int(size[p]) for p in np.flatnonzero(size)}
    # a task takes 2^PASSES sub-buckets one after the other; a fingerprint is sent again only for the tasks beyond
    tasks_of = lambda p: 1 << max(0, deep.get(p, 0) - PASSES)

    def send(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush():
            keys, blobs = [], []
            for p, parts in held.items():
                blob = np.concatenate(parts).tobytes()
                for s in range(tasks_of(p)):
                    keys.append(p << 32 | s)
                    blobs.append(blob)
            held.clear()
            for i in range(0, len(keys), 500):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 500], pa.int64()), pa.array(blobs[i : i + 500], pa.binary())], ["bucket", "fps"])

        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            top = (fps >> np.uint64(low)).astype(np.int64)
            order = np.argsort(top, kind="stable")
            fps, top = fps[order], top[order]
            cut = np.flatnonzero(np.diff(top)) + 1
            for part, p in zip(np.split(fps, cut), top[np.concatenate(([0], cut))] if len(top) else [], strict=True):
                for m in flips:
                    held.setdefault(int(p) ^ m, []).append(part)
            size += len(fps)
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    def meet(batches):
        at, parts = None, []

        def done():
            p, s = at >> 32, at & 0xFFFFFFFF
            subs = range(s, 1 << deep.get(p, 0), tasks_of(p))
            for a, b in _meet(np.frombuffer(b"".join(parts), np.uint64), p, bits, subs, deep.get(p, 0)):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != at and parts:
                    yield from done()
                    parts = []
                at = key
                parts.append(blob)
        if parts:
            yield from done()

    spark = distinct.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 8)
    sent = distinct.select("fp").mapInArrow(send, "bucket long, fps binary")
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long")


def classes(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """rows(doc_id, fp) to (fp, root, component_id) of every fingerprint, as a written table.

    root is the component's smallest fingerprint, component_id its smallest doc_id.
    """
    distinct = shelf.put(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, shelf), shelf)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = shelf.put(rooted)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return shelf.put(rooted.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    shelf = Shelf(docs.sparkSession, "simhash")
    rows = shelf.put(fingerprints(docs))
    return rows.join(classes(rows, shelf), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id; columns as in docs."""
    shelf, cols = Shelf(docs.sparkSession, "simhash"), docs.columns
    row, fp_name = free("_row", cols), free("_fp", cols)
    plain = docs.withColumn(row, F.monotonically_increasing_id())
    at = plain.columns.index("text")

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts_of(b.select([at]))], np.uint64).view(np.int64)
            yield b.append_column(fp_name, pa.array(fp))

    marked = shelf.put(plain.mapInArrow(run, plain.withColumn(fp_name, F.lit(0).cast("long")).schema))
    rows = marked.select(F.col(row).alias("_row"), "doc_id", F.col(fp_name).alias("fp"))
    found = rows.join(classes(rows, shelf), "fp")
    kept = shelf.put(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias(row)).select(row))
    # a merge join at every size: the list grows with the rows, and a switch to a broadcast would only hide the shuffle
    return marked.join(kept.hint("merge"), row).select(*cols)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
