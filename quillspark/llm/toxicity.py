"""Operator 4, toxicity: a bidirectional GRU with attention pooling, in numpy.

Input: words (runs of non-blank characters, lower-cased A-Z; of a run over LONG
bytes, pieces of LONG bytes that overlap by half). A word's vector is
a hashed word embedding beside the mean of hashed character-trigram embeddings,
so an unseen inflection is known by its letters. A forward and a backward GRU
read a window of WINDOW words; attention pools their states; a logistic unit
scores the window. A document is scored over all its windows, which overlap by
WINDOW - STRIDE words, and takes the highest score. Texts are read whole.

Training: a bounded sample of the labelled rows outside the held-out fold, in the
order of a hash: at most MAX_FIT rows of each class, as long as their texts have
MAX_FIT_BYTES together; a text is read whole or, where it does not fit any more,
not at all. Fitted on the driver with Adam. In each step a document lends its
label to one of its windows, drawn from all of them with odds that lean to the
highest-scoring one more and more. Words and trigrams of fewer than MIN_DOCS
documents of the sample are not learnt, nor are words that it lacks: their word
vectors are zero.

Null and empty texts get the score of an empty window. With fewer than two
classes to learn from, every score is the smoothed share of label 1 (a quarter
without any label, so that nothing is rejected on no evidence). Null
labels are skipped; a label given again counts once, a document with both labels
gives a sample of each. Repeated rows are scored alike, each; null ids too. Empty table: an empty result. Extra
columns are handed on by ``score``, whatever their names, and ignored by the query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts_of

WINDOW, STRIDE = 48, 36
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN, ATT = 6, 12, 8, 8
MAX_FIT = {0: 4500, 1: 1500}
MAX_FIT_BYTES = 48 << 20
EPOCHS, MIN_STEPS, BATCH, SHARP, MIN_DOCS, RATE, DECAY = 5, 360, 64, 8, 10, 0.01, 0.02
LONG = 40
BLOCK = 1024  # windows scored at once
CACHE = 150_000
f32 = np.float32


def _sig(x: np.ndarray) -> np.ndarray:
    return f32(1) / (f32(1) + np.exp(-np.clip(x, -30, 30)))


def split(text: bytes) -> list[bytes]:
    """The words of a text; what is no longer than half of LONG stands whole in a piece of a long run."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONG else [w[a : a + LONG] for a in range(0, len(w) - LONG // 2, LONG // 2)])]


class Words:
    """Distinct words as numbers, with their word bucket and trigram buckets."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        ids = self.ids
        return np.array([ids.setdefault(w, len(ids)) for w in split(text)], np.int64)

    def features(self, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets; trigram buckets in a row; where each word's begin."""
        words = list(self.ids)[since:]
        bucket = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64) % WORD_ROWS
        # "^word$" has as many trigrams as the word has letters; at a join of two words there are two that belong to none
        flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size + 2)
        tri = ((flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * 2654435761 >> 7) % CHAR_ROWS
        keep = np.ones(len(tri) + 2, bool)
        keep[end - 1] = keep[end - 2] = False
        return bucket, tri[keep[:-2]], np.cumsum(size) - size


class Model:
    """The network's weights; ``forward`` and ``backward`` for the fit, ``score``."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        n = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(f32)
        self.p = {"we": np.zeros((WORD_ROWS, WORD_DIM), f32), "ce": n(CHAR_ROWS, CHAR_DIM, k=0.03), "va": n(2 * h, ATT, k=0.3), "ua": n(ATT, k=0.3), "wo": n(2 * h, k=0.3), "bo": np.full(1, -1, f32)}
        for s in "fb":
            self.p |= {f"w{s}": n(d, 3 * h, k=0.4), f"u{s}": n(h, 3 * h, k=0.3), f"c{s}": np.zeros(3 * h, f32)}
        self.prior: float | None = None

    def embed(self, feats) -> np.ndarray:
        bucket, tri, start = feats
        if not len(bucket):
            return np.zeros((0, WORD_DIM + CHAR_DIM), f32)
        count = np.diff(np.append(start, len(tri)))
        return np.concatenate([self.p["we"][bucket], np.add.reduceat(self.p["ce"][tri], start, 0) / np.maximum(count, 1)[:, None].astype(f32)], 1)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]

    def _gru(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, tape: list | None) -> np.ndarray:
        """x: (T, B, 3H) projected inputs; returns states (T, B, H)."""
        t_n, b_n, h = len(x), x.shape[1], HIDDEN
        s, out = np.zeros((b_n, h), f32), np.empty((t_n, b_n, h), f32)
        for t in range(t_n - 1, -1, -1) if back else range(t_n):
            su = s @ u[:, : 2 * h]
            zr = _sig(x[t, :, : 2 * h] + su)
            z, r = zr[:, :h], zr[:, h:]
            rs = r * s
            c = np.tanh(x[t, :, 2 * h :] + rs @ u[:, 2 * h :])
            m = mask[t][:, None]
            new = s + m * z * (c - s)
            if tape is not None:
                tape.append((t, s, z, r, rs, c))
            s = out[t] = new
        return out

    def states(self, ids: np.ndarray, mask: np.ndarray, proj, tapes=None):
        """ids, mask: (T, B)."""
        f = self._gru(proj[0][ids], mask, self.p["uf"], False, tapes and tapes[0])
        b = self._gru(proj[1][ids], mask, self.p["ub"], True, tapes and tapes[1])
        s = np.concatenate([f, b], 2)
        a = np.tanh(s @ self.p["va"])
        e = np.exp(a @ self.p["ua"]) * mask
        w = e / np.maximum(e.sum(0), f32(1e-9))
        pooled = (w[:, :, None] * s).sum(0)
        return s, a, w, pooled, pooled @ self.p["wo"] + self.p["bo"][0]

    def logits(self, ids: np.ndarray, mask: np.ndarray, proj) -> np.ndarray:
        return self.states(ids, mask, proj)[-1]


class _Tape(list):
    def __bool__(self) -> bool:  # an empty tape still records
        return True


def _grads(model: Model, feats, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean log loss. ids index the rows of x and of feats."""
    p, h = model.p, HIDDEN
    proj, tapes = model.project(x), (_Tape(), _Tape())
    s, a, w, pooled, logit = model.states(ids, mask, proj, tapes)
    prob = _sig(logit)
    loss = float(-np.mean(np.where(y > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))))
    dl = ((prob - y) / len(y)).astype(f32)
    g = {"wo": pooled.T @ dl, "bo": dl.sum(keepdims=True)}
    dp = dl[:, None] * p["wo"]
    ds = w[:, :, None] * dp
    dw = (s * dp).sum(2)
    de = w * (dw - (w * dw).sum(0))
    da = de[:, :, None] * p["ua"] * (1 - a * a)
    g["ua"] = (a * de[:, :, None]).sum((0, 1))
    g["va"] = np.tensordot(s, da, ((0, 1), (0, 1)))
    ds = ds + da @ p["va"].T
    dx = np.zeros_like(x)
    for k, (side, tape) in enumerate(zip("fb", tapes, strict=True)):
        u, gu, dproj = p[f"u{side}"], np.zeros_like(p[f"u{side}"]), np.zeros((*ids.shape, 3 * h), f32)
        carry = np.zeros((ids.shape[1], h), f32)
        for t, s0, z, r, rs, c in reversed(tape):
            m = mask[t][:, None]
            d = ds[t, :, k * h : (k + 1) * h] + carry
            dz, dc = d * m * (c - s0) * z * (1 - z), d * m * z * (1 - c * c)
            drs = dc @ u[:, 2 * h :].T
            dr = drs * s0 * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            gu[:, 2 * h :] += rs.T @ dc
            gu[:, : 2 * h] += s0.T @ dzr
            carry = d * (1 - m * z) + drs * r + dzr @ u[:, : 2 * h].T
            dproj[t] = np.concatenate([dzr, dc], 1)
        flat = dproj.reshape(-1, 3 * h)
        per = np.stack([np.bincount(ids.ravel(), flat[:, j], len(x)) for j in range(3 * h)], 1).astype(f32)
        g[f"w{side}"], g[f"u{side}"], g[f"c{side}"] = x.T @ per, gu, per.sum(0)
        dx += per @ p[f"w{side}"].T
    bucket, tri, start = feats
    count = np.diff(np.append(start, len(tri)))
    dce = np.repeat(dx[:, WORD_DIM:] / np.maximum(count, 1)[:, None].astype(f32), count, 0)
    g["we"] = np.stack([np.bincount(bucket, dx[:, j], WORD_ROWS) for j in range(WORD_DIM)], 1).astype(f32)
    g["ce"] = np.stack([np.bincount(tri, dce[:, j], CHAR_ROWS) for j in range(CHAR_DIM)], 1).astype(f32)
    return g, loss


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def _fill(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(1, max(map(len, ids), default=1))
    out, mask = np.zeros((t, len(ids)), np.int64), np.zeros((t, len(ids)), f32)
    for j, x in enumerate(ids):
        out[: len(x), j], mask[: len(x), j] = x, 1
    return out, mask


def window_logits(model: Model, proj, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, logit) of all windows of these documents; docs: numbers into the rows of proj."""
    starts = [windows(len(d)) for d in docs]
    of = np.repeat(np.arange(len(docs)), [len(a) for a in starts])
    at = np.concatenate([*starts, np.zeros(0, np.int64)])
    base = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    flat = np.concatenate([*docs, np.zeros(1, np.int64)])
    length = np.minimum(base[of + 1] - base[of] - at, WINDOW)
    order = np.argsort(length, kind="stable")  # short windows together
    out = np.empty(len(of), f32)
    for i in range(0, len(order), BLOCK):
        o = order[i : i + BLOCK]
        t = np.arange(max(1, length[o].max()))[:, None]
        mask = t < length[o]
        out[o] = model.logits(flat[np.where(mask, base[of[o]] + at[o] + t, len(flat) - 1)], mask.astype(f32), proj)
    return of, at, out


def train(texts: list[bytes], labels: list[int], seed: int = 3) -> Model:
    model, y = Model(), np.array(labels, f32)
    if len(y) == 0 or y.min() == y.max():
        model.prior = (float(y.sum()) + 0.5) / (len(y) + 2)
        return model
    words, rng = Words(), np.random.default_rng(seed)
    docs = [words.of(t) for t in texts]
    bucket, tri, start = words.features()
    size = np.diff(np.append(start, len(tri)))

    def part(used: np.ndarray):
        first = np.cumsum(size[used]) - size[used]
        return bucket[used], tri[np.arange(size[used].sum()) + np.repeat(start[used] - first, size[used])], first

    in_docs = np.zeros(WORD_ROWS, np.int64), np.zeros(CHAR_ROWS, np.int64)
    for d in docs:
        for count, found in zip(in_docs, part(np.unique(d)), strict=False):
            count[np.unique(found)] += 1
    rare = {k: count < MIN_DOCS for k, count in zip(("we", "ce"), in_docs, strict=True)}
    model.p["ce"][rare["ce"]] = 0
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    batches = math.ceil(len(docs) / BATCH)
    rounds = max(EPOCHS, math.ceil(MIN_STEPS / batches))
    total = rounds * batches
    for _ in range(rounds):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), BATCH):
            own, ys = [docs[j] for j in order[i : i + BATCH]], y[order[i : i + BATCH]]
            used, flat = np.unique(np.concatenate(own), return_inverse=True)
            if not len(used):
                continue
            own = np.split(flat, np.cumsum([len(d) for d in own])[:-1])
            feats = part(used)
            x = model.embed(feats)
            of, at, logit = window_logits(model, model.project(x), own)
            # one window of each document is drawn from all, with odds that lean to the highest more and more
            luck = SHARP * ((step + 1) / total) ** 3 * logit + rng.gumbel(size=len(logit))
            best = np.lexsort((luck, of))[np.searchsorted(of, np.arange(len(own)), "right") - 1]
            g, _ = _grads(model, feats, x, *_fill([own[k][a : a + WINDOW] for k, a in enumerate(at[best].tolist())]), ys)
            step += 1
            rate = RATE * (1 - 0.8 * step / total)
            for k, skip in rare.items():
                g[k][skip] = 0
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                if k in ("we", "ce"):
                    model.p[k] *= f32(1 - rate * DECAY)
                scale = m2[k]
                if k in ("we", "ce"):  # one scale for all rows, or rare words would be learnt by heart
                    scale = scale.sum() / max(1, np.count_nonzero(scale))
                model.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)).astype(f32)
    return model


class Scorer:
    """Scores many texts; projections of words already seen are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.proj = Words(), None

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.model.prior is not None:
            return np.full(len(texts), self.model.prior)
        if len(self.words.ids) > CACHE:
            self.words, self.proj = Words(), None
        since = len(self.words.ids)
        docs = [self.words.of(t) for t in texts]
        if self.proj is None:  # number 0 stands where there's no word
            self.proj = tuple(np.zeros((0, 3 * HIDDEN), f32) for _ in range(2))
        if len(self.words.ids) > since:
            new = self.model.project(self.model.embed(self.words.features(since)))
            self.proj = tuple(np.concatenate(x) for x in zip(self.proj, new, strict=True))
        proj = self.proj if len(self.proj[0]) else tuple(np.zeros((1, 3 * HIDDEN), f32) for _ in range(2))
        best = np.full(len(docs), -np.inf)
        of, _, logit = window_logits(self.model, proj, docs)
        np.maximum.at(best, of, logit)
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def held_out():
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most MAX_FIT rows of each class outside the held-out fold."""
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", "toxic")
    picked = [chosen.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT[k]) for k in (0, 1)]
    both = F.broadcast(picked[0].union(picked[1]))  # of bounded size
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(both, "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    # the sample by its keys first, then the texts of those that fit
    keys = rows.select("doc_id", "toxic", "h", F.octet_length("text").alias("size")).distinct().orderBy("h", "toxic").limit(2 * sum(MAX_FIT.values())).collect()
    room, taken = MAX_FIT_BYTES, []
    for r in keys:
        if r["size"] <= room:
            room -= r["size"]
            taken.append((r.h, r.toxic))
    if not taken:
        return train([], [])
    own = docs.sparkSession.createDataFrame(taken, "h long, toxic long").withColumnRenamed("toxic", "label")
    found = rows.join(F.broadcast(own), [rows.h == own.h, rows.toxic == own.label]).select(rows.h, "toxic", "text").dropDuplicates(["h", "toxic"]).orderBy("h", "toxic").collect()
    return train([r.text.encode() for r in found], [int(r.toxic) for r in found])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows and columns of docs and the score, a double; a column of docs by its name gives way."""
    cols = [c for c in docs.columns if c.lower() != name.lower()]
    docs = docs.select(*cols)

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches):
            yield b.append_column(name, pa.array(scorer(texts_of(b)), pa.float64()))

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
