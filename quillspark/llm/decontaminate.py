"""Operator 8, benchmark decontamination with an FM-index per shard.

Words: A-Z lower-cased, runs of letters, digits and non-ASCII characters. An
item's windows are its WINDOW consecutive words; an item of fewer words, but not
none, is one window. A word of a document inside any occurrence of a window is
hit.

Each task takes its documents in shards of about SHARD_WORDS words. The text
that is indexed is the sequence of word numbers; words that no item has become
a separator, and runs of known words shorter than the shortest window, which
can't hold an occurrence, are left out. A shard's index is the Burrows-Wheeler
transform of this sequence as a wavelet matrix. All windows are searched
backwards at once by ranks; occurrences are located by walking to a sampled
suffix position; spans that overlap are merged.

The items reach the tasks in blocks of at most BLOCK_BYTES, broadcast one by
one; a larger benchmark takes more blocks over the same row-local plan.

Null texts have no words. Items without words or id are no windows or aren't
named. Repeated rows and null ids each get a row; repeated item_ids count once.
Extra columns are ignored by the query and handed on by ``remove``, whatever their
names. Empty table: an empty result; empty benchmark: nothing is hit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, merge_spans, runs_of, slices, texts_of

WINDOW = 10
SHARD_WORDS = 400_000
SAMPLE = 8
RESULTS = ("_n_words", "_spans", "_items")
BLOCK_BYTES = 32 << 20
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of numbers in order, by doubling; the end is least."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(s.max() + 1).bit_length())
    h = max(1, 62 // bits)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << bits | padded[j : j + n]
    while True:
        sa = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[sa] = np.concatenate(([0], np.cumsum(np.diff(key[sa]) != 0)))
        if rank[sa[-1]] == n - 1:
            return sa
        after = np.zeros(n, np.int64)
        if h < n:
            after[: n - h] = rank[h:] + 1
        key, h = rank * (n + 1) + after, 2 * h


class FMIndex:
    """Backward search and location in a sequence of numbers of at least 0."""

    def __init__(self, s: np.ndarray):
        sa = suffix_array(np.append(s + 1, 0))  # 0 ends the sequence
        s = np.append(s + 1, 0)
        bwt = s[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s))))
        self.bwt, self.bits = bwt, max(1, int(s.max()).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):  # the wavelet matrix
            bit = bwt >> level & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(bwt) - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.sampled = sa % SAMPLE == 0
        self.before = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = sa[self.sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the first i places of the transform."""
        a = np.zeros_like(i)
        for k in range(self.bits):
            bit = (c >> (self.bits - 1 - k) & 1).astype(bool)
            oa, oi = self.ones[k][a], self.ones[k][i]
            a, i = np.where(bit, self.zeros[k] + oa, a - oa), np.where(bit, self.zeros[k] + oi, i - oi)
        return i - a

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of patterns, first, end) of the suffix ranges that are not empty."""
        who = np.arange(len(patterns))
        a, b = np.zeros(len(who), np.int64), np.full(len(who), len(self.bwt), np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[who, j] + 1
            ok = c < len(self.first) - 1
            who, a, b, c = who[ok], a[ok], b[ok], c[ok]
            a, b = self.first[c] + self.rank(c, a), self.first[c] + self.rank(c, b)
            ok = a < b
            who, a, b = who[ok], a[ok], b[ok]
        return who, a, b

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of these suffixes: steps back to a sampled one."""
        rows, out, step = rows.copy(), np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sampled[rows[todo]]
            done = todo[hit]
            out[done] = self.samples[self.before[rows[done]]] + step
            todo = todo[~hit]
            c = self.bwt[rows[todo]]
            rows[todo] = self.first[c] + self.rank(c, rows[todo])
            step += 1
        return out


class Phrases:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                of = windows.setdefault(tuple(w[i : i + WINDOW]), set())
                if name is not None:
                    of.add(name)
        self.by_size = {}
        for m in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == m]
            self.by_size[m] = np.array(own, np.int64), [windows[w] for w in own]
        self.least = min(self.by_size, default=0)

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """For each text's words, which are hit, and the items found."""
        found = [(np.zeros(len(t), bool), set()) for t in texts]
        if not self.least:
            return found
        get = self.vocab.get
        ids = np.array([get(w, 0) for t in texts for w in t], np.int64)
        base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        cut = np.zeros(len(ids) + 1, bool)
        cut[base] = True
        known = ids > 0
        # runs of known words within a text that are long enough
        edge = np.flatnonzero(cut[:-1] | np.concatenate(([True], known[1:] != known[:-1]))) if len(ids) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(ids)))
        use = known[edge] & (size >= self.least) if len(edge) else np.zeros(0, bool)
        edge, size = edge[use], size[use]
        if not len(edge):
            return found
        out = np.cumsum(size + 1) - size - 1  # where each run begins in the indexed sequence
        text = np.zeros(int((size + 1).sum()), np.int64)
        at = np.arange(int(size.sum()))
        shift = np.repeat(np.cumsum(size) - size, size)
        text[at - shift + np.repeat(out, size)] = ids[at - shift + np.repeat(edge, size)]
        index = FMIndex(text)
        mark = np.zeros(len(ids) + 1, np.int64)
        for m, (patterns, names) in self.by_size.items():
            who, a, b = index.search(patterns)
            if not len(who):
                continue
            count = b - a
            rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            pos, of = index.locate(rows), np.repeat(who, count)
            run = np.searchsorted(out, pos, "right") - 1
            pos = pos - out[run] + edge[run]
            np.add.at(mark, pos, 1)
            np.add.at(mark, pos + m, -1)
            doc = np.searchsorted(base, pos, "right") - 1
            for d, w in np.unique(np.stack([doc, of], 1), axis=0).tolist():
                found[d][1].update(names[w])
        hit = np.cumsum(mark[:-1]) > 0
        return [(hit[x:y], items) for x, y, (_, items) in zip(base[:-1].tolist(), base[1:].tolist(), found, strict=True)]


def shards(batches):
    """Batches of whole texts with about SHARD_WORDS words (by their bytes)."""
    held, size = [], 0
    for b in slices(batches):
        held.append(b)
        size += b.nbytes
        if size > 6 * SHARD_WORDS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(benchmark: DataFrame):
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        text = (r.text or "").encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, removing: bool = False) -> DataFrame:
    """The rows and columns of docs and ``_n_words``, ``_spans`` (of hit words, end exclusive), ``_items``.

    Columns of docs by these names give way. With ``removing``, the columns of docs alone, the spans cut out of ``text``.
    """
    docs = docs.drop(*RESULTS)
    spark, at = docs.sparkSession, docs.columns.index("text")
    empty = F.array().cast("array<struct<a:long,b:long>>")
    out = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_spans": empty, "_items": F.array().cast("array<string>")})
    schema = out.schema
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        phrases = spark.sparkContext.broadcast(block)

        def run(batches, phrases=phrases, cutting=removing and after is None):
            find = Phrases(phrases.value)
            for b in shards(batches):
                texts = texts_of(b)
                words = [words_of(t) for t in texts]
                old = zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
                spans, items = [], []
                for (hit, got), (spans0, items0) in zip(find.scan(words), old, strict=True):
                    new = [(s["a"], s["b"]) for s in spans0] + [tuple(s) for s in runs_of(hit).tolist()]
                    spans.append(merge_spans(new))
                    items.append(sorted(got | set(items0)))
                if cutting:
                    left = b.column(at).to_pylist()
                    for i, s in enumerate(spans):
                        if s:
                            left[i] = cut(texts[i], s).decode()
                    yield pa.RecordBatch.from_arrays([pa.array(left, c.type) if i == at else c for i, c in enumerate(b.columns[:-3])], b.schema.names[:-3])
                    continue
                pairs = pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array([len(w) for w in words], pa.int64()), pairs, pa.array(items, pa.list_(pa.string()))], b.schema.names)

        out = out.mapInArrow(run, docs.schema if removing and after is None else schema)
        block = after
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(TABLE))]
    kept, p = [], 0
    for a, b in spans:
        kept.append(text[p : at[a][0]])
        p = at[b - 1][1]
    return b"".join([*kept, text[p:]])


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of docs; benchmark passages are cut out of ``text``."""
    aside = {c: free(c + "0", docs.columns) for c in docs.columns if c.lower() in RESULTS}
    return scan(docs.withColumnsRenamed(aside), benchmark, removing=True).withColumnsRenamed({v: k for k, v in aside.items()})


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same in DuckDB: windows as rows, joined by their words.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
items AS (SELECT DISTINCT item, m, array_to_string(t[i:i+m-1], ' ') AS k FROM (SELECT item, t, least(len(t), 10) AS m, unnest(range(1, greatest(len(t) - 9, 1) + 1)) AS i FROM b WHERE len(t) > 0)),
sizes AS (SELECT DISTINCT m FROM items),
places AS (SELECT r, m, i, array_to_string(t[i:i+m-1], ' ') AS k FROM (SELECT r, t, m, unnest(range(1, len(t) - m + 2)) AS i FROM d, sizes WHERE len(t) >= m)),
found AS (SELECT r, i, places.m, item FROM places JOIN items ON places.k = items.k AND places.m = items.m),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
