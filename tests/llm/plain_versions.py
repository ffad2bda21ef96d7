"""Plain versions of the operators' results, by trying everything; they share no code with the operators but the gear table."""

import hashlib
import re

import numpy as np
import xxhash

from quillspark.llm.chunks import GEAR


def spans_of(gone) -> list[tuple[int, int]]:
    out, start = [], None
    for i, g in enumerate([*gone, False]):
        if g and start is None:
            start = i
        elif not g and start is not None:
            out.append((start, i))
            start = None
    return out


def kept(text: bytes, gone) -> bytes:
    return bytes(c for c, g in zip(text, gone, strict=True) if not g)


def borders(text: bytes, near: int = 32, most: int = 1024) -> list[int]:
    """Ends of the chunks by a scan of the bytes."""
    if not text:
        return []
    h, hashes = 0, []
    for c in text:
        h = (2 * h + int(GEAR[c])) & 0xFFFFFFFF
        hashes.append(h)
    least = [hashes[i] == min(hashes[max(0, i - near) : i + near + 1]) for i in range(len(text))]
    cut = [i + 1 for i in range(len(text)) if least[i] and not (i and least[i - 1]) and near < i + 1 < len(text) - near]
    out, at = [], 0
    for c in [*cut, len(text)]:
        while c - at > most:
            at += most
            out.append(at)
        out.append(c)
        at = c
    return out


def chunks(docs: list[tuple]) -> dict:
    """(n_removed, sha256 of what stays) by (id, text)'s id, for ids that have one text; documents in the order of id (null first) and text hash."""
    return {key[0]: v for key, v in chunks_of(docs).items()}


def chunks_of(docs: list[tuple]) -> dict:
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64))
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1])))
    seen, out = set(), {}
    for i, t in order:
        gone = np.zeros(len(t), bool)
        ends = borders(t)
        for a, b in zip([0, *ends], ends, strict=False):
            if t[a:b] in seen:
                gone[a:b] = True
            seen.add(t[a:b])
        out[i, t] = int(gone.sum()), hashlib.sha256(kept(t, gone)).hexdigest()
    return out


def suffixes(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) of each text by a table of all windows."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), len(spans_of(gone)), hashlib.sha256(kept(t, gone)).hexdigest()))
    return out


def lowered(text: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in text)


def fingerprint(text: bytes) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(rows: list[tuple]) -> list[int]:
    """The first row that each (id, fingerprint) reaches."""
    root = list(range(len(rows)))
    for _ in rows:
        old = list(root)
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
        if root == old:
            break
    return root


def components(rows: list[tuple]) -> list:
    """The component_id of each (id, fingerprint)."""
    root = roots(rows)
    ids = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return [ids[r] for r in root]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind."""
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def words_of(text: bytes) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def decontaminate(texts: list[bytes], items: list[tuple]) -> list[tuple[int, int, int, str]]:
    """(n_words, n_hit, n_items, items_sha256) by trying every place."""
    windows = []
    for name, t in items:
        w = words_of(t)
        windows += [(name, tuple(w[i : i + 10])) for i in range(max(1, len(w) - 9) if w else 0)]
    out = []
    for t in texts:
        w, hit, got = words_of(t), set(), set()
        for m in {len(x) for _, x in windows}:
            where: dict[tuple, list[int]] = {}
            for i in range(len(w) - m + 1):
                where.setdefault(tuple(w[i : i + m]), []).append(i)
            for name, x in windows:
                if len(x) == m and x in where:
                    got.add(name)
                    hit.update(i + j for i in where[x] for j in range(m))
        out.append((len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()))
    return out


def quality(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t)
    w = split(text)
    grams: dict[tuple, list[int]] = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)})
    lines = [x for x in text.split(b"\n") if split(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in b"#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)
