"""Operator 10, exact substring dedup over a suffix array.

Every byte covered by a LENGTH-byte string that also starts anywhere else goes.

1. Anchors. A window (a LENGTH-byte string) is named by the least hash of its
   K-grams. Equal windows have equal names, so a run of windows with one name is
   a segment that meets all its possible repeats under that name. Names seen in
   two different places, or twice within one segment, are found by a partial
   aggregation; others need no further work.
2. Equal segments are made one, keeping whether they stand in two places. A name
   that over HOT different segments carry (those around a very common line) is
   divided: its segments are named again by longer and longer K-grams, which
   take in more and more of what stands around the line, up to whole windows,
   where only equal windows share a name. So no name has over HOT segments, and
   the list of such names stays a table.
3. The segments are shuffled by name. Batches of whole names get a suffix array
   by two-stage sorting: suffixes smaller than their successor are sorted
   directly, all others are induced by one scan over the buckets of first bytes.
   Adjacent suffixes whose common prefix has LENGTH bytes are repeats.
4. The removed spans go back to their texts, where overlapping ones are merged.

Texts and segments are told apart by 128-bit hashes. Equal texts count as one
text that stands in several places. Null text is empty. Repeated rows are repeats
of each other: both lose all their bytes if they have LENGTH or more. Null ids are
ids like any other. Extra columns are ignored, whatever their names. Empty table:
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, merge_spans, runs_of, slices, texts_of

LENGTH = 400
K = 32
HOT = 500
SORT_PIECE = 50_000
BATCH_BYTES = 1_000_000
TASK_BYTES = 64 << 20
PIECE = 1 << 21
M1, M2, M3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def kgrams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at every position, by doubling; the last step overlaps."""
    h = (x.astype(np.uint64) + np.uint64(1)) * M1
    h ^= h >> np.uint64(32)
    h *= M1
    step = 1
    while step < k:
        by = min(step, k - step)
        a, b = h[: len(h) - by], h[by:]
        h = (a * M2) ^ (b >> np.uint64(29)) ^ (b * M3)
        step += by
    h ^= h >> np.uint64(31)
    h *= M1
    return h ^ (h >> np.uint64(32))


def _slide(h: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over each w neighbouring values, in two passes over blocks of w."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, fill, h.dtype)
    padded[: len(h)] = h
    rows = padded.reshape(-1, w)
    pre = f.accumulate(rows, 1).ravel()
    suf = f.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return f(suf[:n], pre[w - 1 : w - 1 + n])


def _named(x: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, w = kgrams(x, k), length - k + 1
    m = _slide(h, w, np.minimum, np.iinfo(np.uint64).max)
    start = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    end = np.append(start[1:], len(m))
    # a K-gram is some window's least where it equals the greatest least of the windows around it
    around = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)])
    pos = np.flatnonzero(_slide(around, w, np.maximum, 0) == h)
    values, rank = np.unique(h[pos], return_inverse=True)
    key = np.sort(rank.astype(np.int64) * (len(h) + 1) + pos)
    base = np.searchsorted(values, m[start]).astype(np.int64) * (len(h) + 1)
    twice = np.searchsorted(key, base + end - 1 + w - 1, "right") - np.searchsorted(key, base + start) > 1
    return m[start], start, end, twice


def segments(text: bytes, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, end of windows, whether the K-gram stands in it twice) of the runs of windows with one name."""
    n, parts = len(text) - length + 1, []
    x = np.frombuffer(text, np.uint8)
    for a in range(0, n, PIECE):  # pieces bound the memory; a run may be cut between them
        name, start, end, twice = _named(x[a : a + PIECE + length - 1], length, k)
        parts.append((name, start + a, end + a, twice))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def finer(length: int) -> list[int]:
    """The lengths of the K-grams by which hot names are divided, the last a whole window."""
    w = length - K + 1
    return [length - max(1, w // by) + 1 for by in (2, 8, 40, w)]


def digest(part: bytes) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    d = xxhash.xxh3_128_digest(part)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def words_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(data: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes in the order of their first ``depth`` bytes at least.

    A suffix is small if it's smaller than its successor. Small ones are sorted
    directly, the others induced in one scan over the buckets of first bytes,
    each bucket at once. ``wanted`` is closed under successors up to the next
    small suffix (see ``close``).
    """
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    # smaller than the successor: the next differing byte is greater
    nxt = np.append(x[1:], 0)
    sign = np.sign(nxt.astype(np.int16) - x)
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n - 1)
    small = sign[np.minimum.accumulate(at[::-1])[::-1]] > 0
    direct = np.flatnonzero(wanted & small)
    text, lead = data.decode("latin-1"), words_of(x)
    direct = direct[np.argsort(lead[direct], kind="stable")]
    new, pieces, a = np.flatnonzero(np.diff(lead[direct])) + 1, [], 0
    while a < len(direct):  # pieces that no 8 leading bytes straddle bound the keys held at once
        at = np.searchsorted(new, a + SORT_PIECE)
        b = int(new[at]) if at < len(new) else len(direct)
        keys = [text[i : i + depth] for i in direct[a:b].tolist()]
        pieces.append(direct[a:b][sorted(range(b - a), key=keys.__getitem__)])
        a = b
    direct = np.concatenate(pieces) if pieces else direct
    waiting = wanted & ~small
    count = np.bincount(x[wanted], minlength=256)
    head = np.concatenate(([0], np.cumsum(count)))
    sa = np.full(head[-1], -1, np.int64)
    tail = head[1:] - np.bincount(x[direct], minlength=256)
    by = np.concatenate(([0], np.cumsum(np.bincount(x[direct], minlength=256))))
    for c in range(256):  # small suffixes fill the end of their bucket
        sa[tail[c] : head[c + 1]] = direct[by[c] : by[c + 1]]
    fill = head[:-1].copy()

    def induce(of: np.ndarray) -> None:
        """Places the waiting predecessors of suffixes that come in this order."""
        pred = of[of > 0] - 1
        pred = pred[waiting[pred]]
        if len(pred):
            first = x[pred]
            order = np.argsort(first, kind="stable")
            pred, first = pred[order], first[order]
            values, begin = np.unique(first, return_index=True)
            for v, a, b in zip(values.tolist(), begin.tolist(), [*begin[1:].tolist(), len(pred)], strict=True):
                sa[fill[v] : fill[v] + b - a] = pred[a:b]
                fill[v] += b - a

    last = n - 1  # the last suffix has no successor; the end is smaller than any byte
    if n and waiting[last]:
        sa[fill[x[last]]] = last
        fill[x[last]] += 1
    for c in range(256):
        a = head[c]
        while a < fill[c]:  # a run of c induces within its own bucket
            b = fill[c]
            induce(sa[a:b])
            a = b
        induce(sa[tail[c] : head[c + 1]])
    return sa


def close(data: bytes, starts: np.ndarray) -> np.ndarray:
    """starts and the suffixes behind them on which their inducing depends."""
    x = np.frombuffer(data, np.uint8)
    need = starts.copy()
    edge = np.flatnonzero(starts[:-1] & ~starts[1:])  # last start of each run
    while len(edge):  # goes on while it isn't smaller than its successor at sight
        edge = edge[(edge + 1 < len(x))]
        edge = edge[x[edge] >= x[edge + 1]] + 1
        edge = edge[~need[edge]] if len(edge) else edge
        need[edge] = True
    return need


def repeated(parts: list[bytes], many: list[bool], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows stand elsewhere too.

    parts: different segments; many: whether a segment stands in two places.
    """
    data = b"\0".join(parts) + b"\0"
    size = np.array([len(p) for p in parts])
    base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    starts = np.zeros(len(data), bool)
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, base, 1)
    np.add.at(mark, base + size - length + 1, -1)
    starts[:] = np.cumsum(mark[:-1]) > 0
    sa = suffix_array(data, close(data, starts), length)
    sa = sa[starts[sa]]
    w = words_of(np.frombuffer(data, np.uint8))
    alive = np.arange(len(sa) - 1)
    for d in [*range(0, length - 7, 8), max(0, length - 8)]:  # adjacent common prefixes, 8 bytes at a time
        alive = alive[w[sa[alive] + d] == w[sa[alive + 1] + d]]
    hit = np.zeros(len(data), bool)
    hit[sa[alive]] = hit[sa[alive + 1]] = True
    out = []
    for p, (a, z) in enumerate(zip(base.tolist(), size.tolist(), strict=True)):
        out.append(np.ones(z - length + 1, bool) if many[p] else hit[a : a + z - length + 1])
    return out


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


LONG, SPANS = pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _cells(rows: DataFrame, place: list[str]) -> DataFrame:
    """name, d1, d2, part, many of the different segments among rows(name, d1, d2, part, many, *place)."""
    at = F.xxhash64(*place)
    found = rows.groupBy("d1", "d2").agg(F.first("part", ignorenulls=True).alias("part"), F.min("name").alias("name"), (F.max("many") | (F.min(at) != F.max(at))).alias("many"))
    return found.select("name", "d1", "d2", "part", "many")


def _divided(cells: DataFrame, length: int, k: int) -> DataFrame:
    """The segments named again by k-grams: name, d1, d2, part, many, the former segment p1, p2 and the place in it."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for name, d1, d2, part, many in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                for m, s, e, _ in zip(*segments(part, length, k), strict=True):
                    sub = part[s : e + length - 1]
                    rows.append((xxhash.xxh3_64_intdigest(f"{name} {m}") >> 1, *digest(sub), sub, many, d1, d2, int(s)))
            yield _batch(rows, [LONG, LONG, LONG, pa.binary(), pa.bool_(), LONG, LONG, LONG], ["name", "d1", "d2", "part", "many", "p1", "p2", "a"])

    return cells.select("name", "d1", "d2", "part", "many").mapInArrow(run, "name long, d1 long, d2 long, part binary, many boolean, p1 long, p2 long, a long")


def _sorted(cells: DataFrame, length: int) -> DataFrame:
    """d1, d2 and the spans of windows that stand elsewhere too, for each of cells(name, d1, d2, part, many)."""

    def sort(batches):
        group, held, size, last = {}, {}, 0, None

        def work():
            keys = list(held)
            out = repeated([held[k][0] for k in keys], [held[k][1] for k in keys], length)
            spans = [(*k, [{"a": int(a), "b": int(b)} for a, b in runs_of(m)]) for k, m in zip(keys, out, strict=True)]
            return _batch([s for s in spans if s[2]], [LONG, LONG, SPANS], ["d1", "d2", "spans"])

        for b in slices(batches):
            for name, d1, d2, part, many in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if name != last:
                    held |= group
                    group = {}
                    if size > BATCH_BYTES:
                        yield work()
                        held, size = {}, 0
                    last = name
                group[d1, d2] = (part, many)
                size += len(part)
        held |= group
        if held:
            yield work()

    size = cells.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    ordered = cells.select("name", "d1", "d2", "part", "many").repartition(tasks, "name").sortWithinPartitions("name")
    return ordered.mapInArrow(sort, "d1 long, d2 long, spans array<struct<a:long,b:long>>")


def _repeats(rows: DataFrame, place: list[str], length: int, hot: int, steps: list[int], shelf: Shelf) -> DataFrame:
    """d1, d2, spans of the segments among rows; the segments of hot names are divided first."""
    cells = shelf.put(_cells(rows, place))
    crowded = shelf.put(cells.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("name")) if steps else None
    if crowded is None or crowded.isEmpty():
        return _sorted(cells, length)
    parts = shelf.put(_divided(cells.join(crowded, "name", "left_semi"), length, steps[0]))
    inner = _repeats(parts, ["p1", "p2", "a"], length, hot, steps[1:], shelf)
    moved = F.transform("spans", lambda s: F.struct((F.col("a") + s.a).alias("a"), (F.col("a") + s.b).alias("b")))
    back = parts.select("d1", "d2", "p1", "p2", "a").join(inner, ["d1", "d2"]).select("p1", "p2", moved.alias("spans"))
    back = back.groupBy("p1", "p2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rest = cells.join(crowded, "name", "left_anti")
    return _sorted(rest, length).unionByName(back.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), "spans"))


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row. length > K."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "suffixes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})

    # the texts, packed and once for each task, and where a text stands in several rows
    def pack(batches):
        seen: set[tuple[int, int]] = set()
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            out = []
            for t, k in zip(texts_of(b), zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), strict=True):
                if k not in seen:
                    seen.add(k)
                    out.append((*k, squeeze.compress(t)))
            yield _batch(out, [LONG, LONG, pa.binary()], ["t1", "t2", "z"])

    long_ones = keyed.where(F.octet_length("text") >= length).select("text", "t1", "t2")
    packed = long_ones.mapInArrow(pack, "t1 long, t2 long, z binary")
    counted = keyed.groupBy("t1", "t2").agg(F.count("*").alias("c")).where("c > 1").drop("c")

    def named(batches):
        seen: set[tuple[int, int]] = set()
        for b in slices(batches):
            cols = [[], [], [], [], [], []]
            for text, k in zip(texts_of(b), zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                name, a, e, twice = segments(text, length)
                for c, v in zip(cols, (name.view(np.int64), np.full(len(name), k[0]), np.full(len(name), k[1]), a, e, twice.astype(np.int64)), strict=True):
                    c.append(v)
            arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(x, LONG) for x in arrays], ["name", "t1", "t2", "a", "e", "twice"])

    place = F.xxhash64("t1", "t2", "a")
    runs = shelf.put(long_ones.mapInArrow(named, "name long, t1 long, t2 long, a long, e long, twice long"))
    twice = shelf.put(runs.groupBy("name").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("twice").alias("twice")).where("lo <> hi OR twice = 1").select("name"))
    listed = runs.join(twice, "name").groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "e", "name")).alias("runs"))

    def cut(batches):
        seen: set[tuple[int, int]] = set()
        for b in slices(batches):
            rows = []
            for z, t1, t2, found in zip(*[b.column(i).to_pylist() for i in (2, 0, 1, 3)], strict=True):
                text = zstandard.decompress(z)
                for r in found:
                    part = text[r["a"] : r["e"] + length - 1]
                    d = digest(part)
                    rows.append((r["name"], *d, None if d in seen else part, False, t1, t2, r["a"]))
                    seen.add(d)
            yield _batch(rows, [LONG, LONG, LONG, pa.binary(), pa.bool_(), LONG, LONG, LONG], ["name", "d1", "d2", "part", "many", "t1", "t2", "a"])

    rows = shelf.put(packed.join(listed, ["t1", "t2"]).select("t1", "t2", "z", "runs").mapInArrow(cut, "name long, d1 long, d2 long, part binary, many boolean, t1 long, t2 long, a long"))
    shelf.drop(runs, twice)
    hits = _repeats(rows, ["t1", "t2", "a"], length, hot, finer(length), shelf)
    spans = rows.select("d1", "d2", "t1", "t2", "a").join(hits, ["d1", "d2"])
    spans = spans.select("t1", "t2", F.transform("spans", lambda s: F.struct((F.col("a") + s.a).alias("a"), (F.col("a") + s.b - 1 + length).alias("b"))).alias("spans"))
    # one row for each text that loses bytes; a text that stands in several rows loses all
    spans = spans.withColumn("copied", F.lit(False)).unionByName(counted.withColumn("copied", F.lit(True)), allowMissingColumns=True)
    # as a table of its own, so that the join has plain shuffles on both sides and a text of very many rows can be split
    spans = shelf.put(spans.groupBy("t1", "t2").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.max("copied").alias("copied")))
    both = keyed.join(spans, ["t1", "t2"], "left")

    def drop(batches):
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(4)]
            for t, found, copied in zip(texts_of(b), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                spans = [(0, len(t))] if copied and len(t) >= length else merge_spans([(s["a"], s["b"]) for s in found or []])
                kept, p = [], 0
                for x, y in spans:
                    kept.append(t[p:x])
                    p = y
                for c, v in zip(cols, (len(t), sum(y - x for x, y in spans), len(spans), b"".join([*kept, t[p:]])), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, LONG) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.select("doc_id", "text", "spans", "copied").mapInArrow(drop, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
