"""Subword models: a byte-pair trainer over word counts, its encoder, and WordPiece."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from heapq import heappop, heappush

import numpy as np

MARK = "▁"
WORDPIECE = re.compile(r"\w+|[^\w\s]", re.UNICODE)


def train_bpe(counts: dict[str, int], vocabulary_size: int) -> list[tuple[str, str]]:
    """Merges learnt from words (each with MARK before it) and their counts."""
    return learn_bpe([("".join(counts), list(map(len, counts)), list(counts.values()))], vocabulary_size, lambda x: [x])[1]


def learn_bpe(batches: Iterable[tuple[str, list[int], list[int]]], vocabulary_size: int, exchange: Callable[[object], list]) -> tuple[list[str], list[tuple[str, str]]]:
    """The letters of the words, and the merges. batches: words joined, their lengths and their counts.

    The most frequent pair is merged first; of equals the one that sorts first.
    exchange gives what each of the workers has sent, itself included: each keeps
    a part of the words, all keep the counts of all pairs and so choose alike.
    No letters' merges are learnt if there are more letters than vocabulary_size.
    """
    codes, lengths, weights = [], [], []
    for joined, n, counts in batches:
        codes.append(np.frombuffer(joined.encode("utf-32-le"), np.uint32))
        lengths.append(np.array(n, np.int64))
        weights.append(np.array(counts, np.int64))
    codes, lengths, weights = (np.concatenate([np.zeros(0, k), *x]) for x, k in ((codes, np.uint32), (lengths, np.int64), (weights, np.int64)))
    found = np.unique(np.concatenate(exchange(np.unique(codes))))
    letters = [chr(c) for c in found]
    if len(letters) > vocabulary_size:
        return letters, []
    words = _Words(np.searchsorted(found, codes) + 1, lengths, weights, vocabulary_size)
    del codes
    names, ids = ["", *letters], {c: i for i, c in enumerate(letters, 1)}
    pairs: Counter = Counter()
    heap: list = []

    def add(key: np.ndarray, by: np.ndarray) -> None:
        changed = set()
        for keys, more in exchange((key, by)):
            for k, m in zip(keys.tolist(), more.tolist(), strict=True):
                pairs[k] += m
                changed.add(k)
        for k in changed:
            if pairs[k] > 0:
                heappush(heap, (-pairs[k], (names[k >> 32], names[k & 0xFFFFFFFF]), k))
            else:
                del pairs[k]

    add(*words.pairs())
    merges: list[tuple[str, str]] = []
    while len(letters) + len(merges) < vocabulary_size and heap:
        n, best, k = heappop(heap)
        if pairs.get(k) != -n:  # its count has changed since
            continue
        merges.append(best)
        whole = best[0] + best[1]
        if whole not in ids:
            ids[whole] = len(names)
            names.append(whole)
        add(*words.merge(k >> 32, k & 0xFFFFFFFF, ids[whole]))
    return letters, merges


class _Words:
    """Symbols of words, linked in both directions; symbol 0 is none. The last place ends every word."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, weights: np.ndarray, most: int):
        n = len(symbols)
        place = np.int32 if n < 2**31 - 1 else np.int64
        self.symbol = np.append(symbols, 0).astype(np.min_scalar_type(2 * most + 2))
        self.weight = np.append(np.repeat(weights.astype(np.min_scalar_type(weights.max(initial=0))), lengths), 0)
        self.next, self.last = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
        ends = np.cumsum(lengths)
        self.next[ends - 1] = self.next[n] = self.last[ends - lengths] = self.last[n] = n

    def pairs(self, at: np.ndarray | None = None, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that begin at these places, or at all, and their counts."""
        found: Counter = Counter()
        n = len(self.symbol) if at is None else len(at)
        for i in range(0, n, step):
            x = np.arange(i, min(n, i + step)) if at is None else at[i : i + step]
            a, b = self.symbol[x].astype(np.int64), self.symbol[self.next[x]].astype(np.int64)
            there = (a > 0) & (b > 0)
            keys, which = np.unique(a[there] << 32 | b[there], return_inverse=True)
            for k, m in zip(keys.tolist(), np.bincount(which, self.weight[x][there]).astype(np.int64).tolist(), strict=True):
                found[k] += m
        return np.array(list(found), np.int64), np.array(list(found.values()), np.int64)

    def find(self, a: int, b: int) -> np.ndarray:
        """Where a before b is to become one symbol, from the left."""
        at = np.flatnonzero(self.symbol == a)
        at = at[self.symbol[self.next[at]] == b]
        if a == b and len(at):  # every other one of a run
            begins = np.append(True, self.next[at[:-1]] != at[1:])
            first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        return at

    def join(self, at: np.ndarray, whole: int) -> None:
        gone = self.next[at]
        after = self.next[gone]
        self.symbol[at], self.symbol[gone] = whole, 0
        self.next[at], self.last[after] = after, at
        self.last[-1] = len(self.last) - 1

    def merge(self, a: int, b: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """Makes each a before b one symbol; the changes of pair counts."""
        at = self.find(a, b)
        less = self.pairs(np.unique(np.concatenate((self.last[at], at, self.next[at]))))
        self.join(at, whole)
        more = self.pairs(np.unique(np.concatenate((self.last[at], at))))
        return np.concatenate((less[0], more[0])), np.concatenate((-less[1], more[1]))


def merge(s: list[str], pair: tuple[str, str]) -> list[str]:
    out: list[str] = []
    for c in s:
        if out and (out[-1], c) == pair:
            out[-1] += c
        else:
            out.append(c)
    return out


def bpe_word(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """The pieces of a word, with MARK before it."""
    s, none = list(MARK + word), len(rank)
    while len(s) > 1:
        ranks = [rank.get(p, none) for p in zip(s, s[1:], strict=False)]
        if (best := min(ranks)) == none:
            break
        i = ranks.index(best)
        s = merge(s, (s[i], s[i + 1]))
    return s


def bpe_plan(rank: dict[tuple[str, str], int]) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """Symbols, and for each merge by rank its symbols, the one made, and the merge to go on with where it was found: the next one, or one before it
    which takes the symbol made, if that can be made in two ways."""
    order = sorted(rank, key=rank.get)
    names = ["", *sorted({x for a, b in order for x in (a, b, a + b)})]
    ids = {x: i for i, x in enumerate(names)}
    takes: dict[str, int] = {}
    for i, (a, b) in enumerate(order):
        takes.setdefault(a, i)
        takes.setdefault(b, i)
    return names, [(ids[a], ids[b], ids[a + b], min(i + 1, takes.get(a + b, i + 1))) for i, (a, b) in enumerate(order)]


def bpe_words(words: list[str], rank: dict[tuple[str, str], int], plan: tuple[list[str], list[tuple[int, int, int, int]]]) -> list[list[str]]:
    """The pieces of each word; those of many words are made together."""
    names, merges = plan
    if len(words) < 4 * len(merges) or not merges:
        return [bpe_word(w, rank) for w in words]
    codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32)
    found, which = np.unique(codes, return_inverse=True)
    names, ids = list(names), {x: i for i, x in enumerate(names)}
    for c in map(chr, found):
        if c not in ids:
            ids[c] = len(names)
            names.append(c)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    all_words = _Words(np.array([ids[chr(c)] for c in found])[which], lengths, np.zeros(len(words), np.int64), len(names))
    i = 0
    while i < len(merges):
        a, b, whole, then = merges[i]
        i += 1
        if len(at := all_words.find(a, b)):
            all_words.join(at, whole)
            i = then
    left = all_words.symbol > 0
    pieces = [names[x] for x in all_words.symbol[left].tolist()]
    ends = np.cumsum(left)[np.cumsum(lengths) - 1].tolist()
    return [pieces[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def wordpiece_text(text: str, cased: bool) -> list[str]:
    """The words of a text, in small letters without accents if the vocabulary is."""
    if not cased:
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFD", text)
            for c in set(text):
                if unicodedata.category(c) == "Mn":
                    text = text.replace(c, "")
    return WORDPIECE.findall(text)


def wordpiece_word(word: str, vocab: frozenset[str], longest: int, unk_token: str, max_chars: int) -> list[str]:
    """Greedy longest match in one word; longest: of the vocabulary's pieces."""
    if len(word) > max_chars:
        return [unk_token]
    pieces, i, end, before = [], 0, len(word), ""
    while i < end:
        for j in range(min(end, i + longest), i, -1):
            if (piece := before + word[i:j]) in vocab:
                break
        else:
            return [unk_token]
        pieces.append(piece)
        i, before = j, "##"
    return pieces


def is_cased(vocab: frozenset[str]) -> bool:
    return any(c.isupper() for v in vocab for c in v if not v.startswith("["))


def longest_of(vocab: frozenset[str]) -> int:
    return max(map(len, vocab), default=0)


def wordpiece(text: str | None, vocab: frozenset[str], unk_token: str = "[UNK]", max_chars: int = 100) -> list[str]:
    """Greedy longest match; continued pieces begin with ##."""
    longest = longest_of(vocab)
    return [p for w in wordpiece_text(text or "", is_cased(vocab)) for p in wordpiece_word(w, vocab, longest, unk_token, max_chars)]
