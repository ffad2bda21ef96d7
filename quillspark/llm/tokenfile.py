"""Operator 9, token ids in bit-packed files.

Documents are put in ascending doc_id order (nulls first; ties as they come in the table), encoded
with the tokenizers library, END appended to each, and written as segments of at
most about SEGMENT_IDS ids. A segment is self-contained:

    magic "QPK1" | width: u8, 3 spare bytes | ids: u64 | documents: u64 | blocks: u64
    ends of the documents: u64 each | byte offsets of the blocks: u64 each
    blocks of BLOCK ids, the last shorter, each id in ``width`` bits, low bits
    first, each block filled up to whole bytes

``width`` is the least that holds the vocabulary. A block is found by its
offset and unpacked by numpy at once, so ids i..j of a segment are read without
the rest. Segments are rows of a Parquet table, written by Spark's committing
writer to any store it reaches: a lost or repeated task leaves no half file.

Null text is empty: END alone. Repeated rows are each written. An added token of
the tokenizer's file that stands in a text is that token, as in the library.
"""

from __future__ import annotations

import gc
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, held, slices

END = 0
BLOCK = 4096
SEGMENT_IDS = 1 << 20
CACHE, SEEN = 600_000, 1 << 23
#: Marks that a word may end in: none of them starts a contraction, so a run of them is a part of its own.
MARKS = ".,!?:;*$%&#|"
HEAD = struct.Struct("<4sB3xQQQ")


def width_of(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, low bits first, filled up to whole bytes."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def segment(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    offset = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0, np.int64)
    return b"".join([HEAD.pack(b"QPK1", width, len(ids), len(ends), len(blocks)), np.asarray(ends).astype("<u8").tobytes(), offset.astype("<u8").tobytes(), *blocks])


class Segment:
    """Random access to a segment's ids."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, docs, blocks = HEAD.unpack_from(data)
        if magic != b"QPK1":
            raise ValueError("not a token segment")
        self.data = memoryview(data)
        self.ends = np.frombuffer(data, "<u8", docs, HEAD.size).astype(np.int64)
        self.offset = np.frombuffer(data, "<u8", blocks, HEAD.size + 8 * docs).astype(np.int64)
        self.base = HEAD.size + 8 * (docs + blocks)

    def read(self, i: int, j: int) -> np.ndarray:
        """Ids i to j, end exclusive; only the blocks that hold them are unpacked."""
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last, parts = i // BLOCK, (j - 1) // BLOCK, []
        for k in range(first, last + 1):
            n = min(BLOCK, self.n - k * BLOCK)
            parts.append(unpack(self.data[self.base + int(self.offset[k]) : self.base + int(self.offset[k]) + -(-n * self.width // 8)], n, self.width))
        return np.concatenate(parts)[i - first * BLOCK : j - first * BLOCK]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()
#: White space other than the blank and the line end.
SPACES = [c for c in map(chr, [9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
ASCII_SPACES = SPACES[:8]


class _Pieces(dict):
    """Ids by piece; one that is not there is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, unit: str) -> bytes:
        return self.learn(unit)


class Encoder:
    """Encodes texts; what stands between white space is encoded once.

    The byte-level pre-tokenizer parts a text before a blank that follows a
    non-blank, around a line end between non-blanks, and between letters and a
    closing mark; merges stay within its parts. A text whose white space is
    single blanks and line ends is cut there. Words of letters, with or without
    a mark, go to the library's model; pieces of other kinds, and texts with
    other white space or an added token, to its whole encoder. With ``special``
    the file's special tokens are recognised in texts, as the library does if
    nothing else is said; without, they are text like any other.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.vocab = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.line = self._raw(["\n"])[0]
        self.marks: dict[str, bytes] = {"": b""}
        # pieces without the blank before them; those at the start of a line with the line end
        self.known = _Pieces(self._learn)
        self.seen = bytearray(SEEN)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, blank: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(blank + word if word.isascii() else blank + word.encode().decode("latin-1").translate(LETTERS))]).tobytes()

    def _learn(self, unit: str) -> bytes:
        """The ids of a piece, which is kept from its second time on."""
        word, blank, got = (unit, LETTERS[32], b"") if unit[:1] != "\n" else (unit[1:], "", self.line)
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            mark = word[len(stem) :]
            if mark not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[mark] = self._raw([mark])[0]
            ids = self.known.get(stem) if mark and blank else None
            got += (ids or self._word(stem, blank)) + self.marks[mark]
        else:
            got += self._raw([" " + word if blank else word])[0]
        at = hash(unit) % SEEN
        if self.seen[at]:
            self.known[unit] = got
        else:
            self.seen[at] = 1
        return got

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE:
            self.known, self.seen = _Pieces(self._learn), bytearray(SEEN)
        get, skip, out = self.known.__getitem__, len(self.line), []
        for t in texts:
            if not t or t[0] in " \n" or t[-1] in " \n" or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or any(c in t for c in (ASCII_SPACES if t.isascii() else SPACES)) or any(m in t for m in self.added):
                out += self._raw([t])
                continue
            units = ("\n" + t.replace("\n", " \n")).split(" ")
            out.append(b"".join(map(get, units))[skip:])
        return out


def write(docs: DataFrame, path: str, shelf: Shelf) -> DataFrame:
    """Writes the packed segments and returns their table: part, first, doc_ids, data."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_m"]  # splits a doc_id of very many rows too
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_m", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        gc.disable()  # nothing here makes cycles, and the table of pieces is large
        encode, part, before = held(Encoder, path, True), TaskContext.get().partitionId(), 0
        width = width_of(max(encode.vocab, END + 1))
        ids, ends, doc_ids, size = [], [], [], 0
        end, field = np.array([END], "<u4").tobytes(), None

        def done():
            data = segment(np.frombuffer(b"".join(ids), "<u4"), np.array(ends, np.int64), width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(field)), pa.array([data], pa.binary())], ["part", "first", "n_ids", "doc_ids", "data"])

        for b in slices(batches):
            field = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids += [t, end]
                size += len(t) // 4 + 1
                ends.append(size)
                doc_ids.append(i)
                if size >= SEGMENT_IDS:
                    yield done()
                    before += size
                    ids, ends, doc_ids, size = [], [], [], 0
        if ends:
            yield done()

    return shelf.put(ordered.mapInArrow(run, f"part int, first long, n_ids long, doc_ids array<{kind}>, data binary"))


def read(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    spark = table.sparkSession
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    # one number for each partition of the writer is all that is gathered
    sizes = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r.n
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))

    def run(batches):
        for b in batches:
            for first, doc_ids, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                s = Segment(data)
                begin = np.concatenate(([0], s.ends[:-1])).astype(np.int64)
                raw = np.concatenate([s.read(i, min(i + (BLOCK << 6), s.n)) for i in range(0, s.n, BLOCK << 6)]).astype("<u4")
                crc = [zlib.crc32(raw[x:y].tobytes()) for x, y in zip(begin.tolist(), s.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first + begin, pa.int64()), pa.array(s.ends - begin, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = table.join(base, "part").select((F.col("base") + F.col("first")).alias("first"), "doc_ids", "data")
    return placed.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shelf = Shelf(spark, "tokens")
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), shelf))
