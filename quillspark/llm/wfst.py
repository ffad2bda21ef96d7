"""Operator 6, SentencePiece encoding and decoding by a weighted transducer.

Machines are compiled from a model file and composed with each input:

* the normaliser: a trie of the strings that the file's character map rewrites,
  read longest match first, and then white space: runs made one (where the model
  says so), the dummy prefix, and marks for blanks. Where only single characters
  are rewritten it has one state, and its arcs are a table;
* the pieces: a trie whose final states write a piece at its weight and return
  to the root, and arcs for characters that no piece is, at the weight of an
  unknown, which write bytes if the model falls back to them;
* for BPE models, the neighbours: a machine whose states are the last piece
  written. Its arc from p to q weighs 0 if the model's merges, run on p + q, leave
  this border standing, and infinity if not.

The encoding is the shortest path in the tropical semiring (min, +). In a unigram
model a piece weighs minus its log probability, and the path is found by
relaxing the arcs in the order of the text. In a BPE model, whose encoding is not
the best sum of piece scores, a piece weighs 0 and a fallback 1 a byte; a
segmentation all of whose neighbours are permitted is the one that the merges
give, so the path through the neighbours' machine is the library's encoding. The
neighbours' arcs are found when first met and kept. No piece crosses a border of
units (see UNITS; checked when a model is compiled), so the machine is at its root
there, and the path of a unit is searched once and kept, in bounded tables.

Null text is empty: no ids. Very long texts are composed unit by unit. Repeated
rows and null ids each get a row; extra columns are ignored, whatever their names.
Empty table: an empty result. Decoding inverts the pieces: ids to bytes, the mark
to a blank, the dummy prefix dropped. With the identity normaliser and byte
fallback a text comes back as it was, but that U+2581 is a blank.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE, SEEN, PAIRS = 250_000, 1 << 23, 400_000
INFINITY = float("inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        shift += 7
        if c < 128:
            return out, i


def _fields(b: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of UTF-8 keys, and the strings that its values point to."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    unit = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    texts = blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules, todo, every = {}, [(int(offset(unit[0])), b"")], np.arange(1, 256)
    while todo:
        at, key = todo.pop()
        child = at ^ every
        child, label = child[child < len(unit)], every[child < len(unit)]
        ok = unit[child] & 0x800000FF == label
        for place, c in zip(child[ok].tolist(), label[ok].tolist(), strict=True):
            u = int(unit[place])
            to = place ^ offset(u)
            if u >> 8 & 1:  # a leaf: the key ends here
                first = int(unit[to]) & 0x7FFFFFFF
                rules[key + bytes([c])] = texts[first : texts.index(b"\0", first)]
            todo.append((to, key + bytes([c])))
    return {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in rules.items()}


class Normaliser:
    """A transducer from texts to what the pieces are matched with."""

    def __init__(self, spec: dict):
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("models that leave blanks as they are can't be compiled")
        rules = character_map(spec.get(2, b""))
        self.one_state = all(len(k) == 1 for k in rules)
        self.table = {ord(k): v for k, v in rules.items() if len(k) == 1}
        if not self.squeeze:
            self.table = {k: v.replace(" ", MARK) for k, v in self.table.items()}
            self.table.setdefault(32, MARK)
        self.root: dict = {}
        for k, v in rules.items():
            node = self.root
            for c in k:
                node = node.setdefault(c, {})
            node[""] = v

    def rewrite(self, text: str) -> str:
        """Longest matches of the map, left to right."""
        if self.table == {32: MARK} and self.one_state:  # the identity machine has one arc that changes anything
            return text.replace(" ", MARK)
        if self.one_state:
            return text.translate(self.table)
        out, i, n, root = [], 0, len(text), self.root
        while i < n:
            node, j, end, found = root, i, i + 1, text[i]
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    end, found = j, node[""]
            out.append(found)
            i = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).lstrip(" ")
            if not text:
                return ""
        if text and self.prefix:
            text = MARK + text
        text = text.replace(" ", MARK)
        return text.rstrip(MARK) if self.squeeze else text


class Transducer:
    """Compiled from a BPE or unigram model of the sentencepiece library."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        with open(path, "rb") as f:
            data = f.read()
        for n, v in _fields(data):
            if n == 1:
                p = dict(_fields(v))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                normaliser = dict(_fields(v))
        self.bpe, self.fallback = trainer.get(3, 1) == 2, bool(trainer.get(35))
        if trainer.get(3, 1) not in (1, 2) or trainer.get(24) or self.bpe and not self.fallback or any(k in (USER, UNUSED) for _, _, k in self.pieces):
            raise ValueError("only unigram models, and BPE models with byte fallback, are compiled, without pieces of the user's")
        self.normalise = Normaliser(normaliser)
        self.score = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.id = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        if self.fallback and len(self.byte) != 256:
            raise ValueError("the model has not all byte pieces")
        self.unit = next(u for u in UNITS if all(len(u.findall(p)) == 1 for p in self.id))
        # the arcs: from a place in the trie by character; under "" what a final state writes, and at what weight
        self.root: dict = {}
        for p in self.id:
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (p, 0.0 if self.bpe else -self.score[p])
        self.unknown_weight = 10 - min(self.score.values(), default=0.0)
        self.out = [b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.pieces]
        self.shortest = self._permitted if self.bpe else self._lightest
        self.borders: dict[tuple[str, str], bool] = {}
        self.paths: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)

    def _written(self, c: str) -> list[int]:
        """Ids of a character that no piece is."""
        return [self.byte[b] for b in c.encode()] if self.fallback else [self.unknown]

    def _lightest(self, text: str) -> list[int]:
        """Ids of the shortest path through a normalised string; of equal ones, the one found first."""
        n, root = len(text), self.root
        weight, back = [0.0] + [INFINITY] * n, [0] * (n + 1)
        ends: list[str | None] = [None] * (n + 1)
        for i in range(n):
            node, j, alone, base = root, i, False, weight[i]
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    p, w = node[""]
                    alone = alone or j == i + 1
                    if base + w < weight[j]:
                        weight[j], back[j], ends[j] = base + w, i, p
            if not alone and base + self.unknown_weight < weight[i + 1]:
                weight[i + 1], back[i + 1], ends[i + 1] = base + self.unknown_weight, i, None
        ids: list[list[int]] = []
        while n:
            ids.append([self.id[ends[n]]] if ends[n] else self._written(text[back[n] : n]))
            n = back[n]
        return [x for part in reversed(ids) for x in part]

    def merged(self, text: str) -> list[str]:
        """The model's merges run on a short string: best score first, then leftmost."""
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = -INFINITY, -1
            for i in range(len(s) - 1):
                v = score.get(s[i] + s[i + 1])
                if v is not None and v > best:
                    best, at = v, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def border(self, p: str, q: str) -> bool:
        """Whether the arc from p to q has weight 0; from no piece, whether q is what its own merges give."""
        if len(self.borders) >= PAIRS:
            self.borders.clear()
        known = self.borders[p, q] = self.merged(p + q) == ([p, q] if p else [q])
        return known

    def _permitted(self, text: str) -> list[int]:
        """Ids of the shortest path through a normalised string and the neighbours' machine.

        Dijkstra's search over states (position, last piece) of the lazily
        composed machine. Arcs of pieces weigh 0, so the states of least weight
        are a stack, the longest piece on top; fallback arcs wait in a heap.
        """
        n, root, borders = len(text), self.root, self.borders
        back: dict[tuple[int, str], tuple[int, str]] = {}
        stack, later, weight = [(0, "", 0, "")], [], 0
        while True:
            if not stack:
                weight, i, p, before, last = heappop(later)
                stack.append((i, p, before, last))
            i, p, before, last = stack.pop()
            if (i, p) in back:
                continue
            if p:
                ok = borders.get((last, p))
                if not (self.border(last, p) if ok is None else ok):
                    continue
            back[i, p] = (before, last)
            if i == n:
                break
            node, j, alone = root, i, False
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                if "" in node:
                    stack.append((j, node[""][0], i, p))
                    alone = alone or j == i + 1
            if not alone:
                heappush(later, (weight + len(text[i].encode()), i + 1, "", i, p))
        ids: list[int] = []
        while i:
            before, last = back[i, p]
            ids += [self.id[p]] if p else reversed(self._written(text[before:i]))
            i, p = before, last
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        if len(self.paths) > CACHE:
            self.paths.clear()
            self.seen = bytearray(SEEN)
        paths, out = self.paths, []
        for unit in self.unit.findall(self.normalise(text)):
            got = paths.get(unit)
            if got is None:
                got = np.array(self.shortest(unit), "<u4").tobytes()
                at = hash(unit) % SEEN
                if self.seen[at] and len(unit) <= 64:  # kept from its second time on
                    paths[unit] = got
                else:
                    self.seen[at] = 1
            out.append(got)
        ids = np.frombuffer(b"".join(out), "<u4")
        if not self.fallback and len(ids):  # neighbouring unknown characters are one
            ids = ids[np.concatenate(([True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)))]
        return ids

    def decode(self, ids) -> str:
        out, rest = self.out, 0
        data = b"".join([out[i] for i in ids])
        if data[:1] == b" " and (self.normalise.prefix or self.normalise.squeeze):
            for i in ids:  # the mark at the start goes; where runs are made one, all marks there
                if self.pieces[i][2] != NORMAL or out[i][:1] != b" ":
                    break
                rest += 1
                if not self.normalise.squeeze or len(out[i]) > 1:
                    break
        return data[rest:].decode("utf-8", "replace")


#: Ways to part a normalised string, the finest first: line ends, marks with a run of Latin letters, marks with a run of other
#: characters; marks with what follows; not at all.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
UNITS = [re.compile(f"\n|{MARK}*[{LATIN}]+|{MARK}*[^{MARK}\n{LATIN}]+|{MARK}+"), re.compile(f"{MARK}*[^{MARK}]+|{MARK}+"), re.compile("(?s).+")]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes (by fallback), ids_crc32, decoded, round_trip for every row."""
    path = path or model_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches):
        machine = held(Transducer, path)
        gc.disable()  # nothing here makes cycles, and the tables are large
        low, high = min(machine.byte.values(), default=0), max(machine.byte.values(), default=-1)
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                t = t or ""
                ids = machine.encode(t)
                back = machine.decode(ids.tolist())
                rows.append((ids.astype(np.int32), len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(ids.tobytes()), back, back == t.replace(MARK, " ")))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "ids", "n_pieces", "n_bytes", "ids_crc32", "decoded", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, n_bytes long, ids_crc32 long, decoded string, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_pieces", "n_bytes", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
