"""The operators' functions against plain versions. Their queries: test_queries.py."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain_versions as plain
from quillspark.llm import chunks, decontaminate, pii, quality, sharding, simhash, suffixes, tokenfile, toxicity, wfst

random.seed(4)
VOCAB = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 8))) for _ in range(400)]
prose = lambda n: " ".join(random.choices(VOCAB, k=n))
PASSAGE = prose(90)
BASE = prose(120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [
    BASE, BASE, NEAR, prose(40) + ". " + PASSAGE + ".\n" + prose(30), prose(25) + "\n" + PASSAGE + " " + prose(8), None, "", " \n ", "a", "ab " * 400, prose(4000), "日本語 🔥 é́ ß " + prose(20), "x" * 5000,
    "mail a.b@c.de or 10.0.0.1 and +1 (389) 555-5010; card 4111 1111 1111 1111, iban DE89370400440532013000", "a@b 1.2.3 300.1.1.1 4111111111111112 +12 @x.y",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


B = [(t or "").encode() for t in TEXTS]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_sharding(spark, docs, empty):
    many = docs.crossJoin(F.broadcast(spark.range(60))).withColumn("doc_id", F.col("doc_id") % 7).drop("id")  # test data only
    out = sharding.shard(many, 5).collect()
    assert len(out) == 60 * len(TEXTS)
    slots: dict = {}
    for r in out:
        slots.setdefault(r.shard, []).append((r.slot, r["size"]))
    sizes = [sum(s for _, s in v) for v in slots.values()]
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    assert max(sizes) - min(sizes) <= max(map(len, B)) + 16 and max(sizes) <= sum(sizes) / 5 + max(map(len, B)) + 16
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len(b) + 16, zlib.crc32(b)) for b in B * 60)
    assert sharding.shard(empty, 5).collect() == []


def test_pii(docs, empty):
    got = by_id(pii.detect(docs))
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for i, t in enumerate(TEXTS):
        want = []
        for k, p in kinds:
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 10 <= len(d) <= 15:
                    want.append((k, *m.span()))
        assert sorted(want) == sorted((s.kind, s.start, s.end) for s in got[i].spans if s.kind in pii.BASE)
    assert {s.kind for s in got[13].spans} == {"email", "ip", "phone", "card", "iban"} and got[14].spans == []
    key = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    assert [s[:3] for s in pii.find(f'x token = "{key}" y')] == [("secret", 11, 51)] and pii.find(f"see {key} there") == [] and pii.find("the token abcdefghijklmnopqrstuvwxyz token") == []
    assert pii.mask(f"API_KEY={key}") == "API_KEY=[SECRET]" and [s[0] for s in pii.find("ssn 123-45-6789")] == ["ssn"] and pii.find("no 123-45-6789") == []
    masked = by_id(pii.redact(docs))
    assert masked[5].text is None and "[CARD]" in masked[13].text and masked[0].text == TEXTS[0]
    assert pii.detect(empty).collect() == []


def test_simhash(docs, empty):
    got = by_id(simhash.near_duplicates(docs))
    fps = {i: simhash.fingerprint(b) for i, b in enumerate(B)}
    root = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r.component_id for i, r in got.items()} == root and root[1] == 0
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("sub_bits", [0, 3])
def test_meeting(sub_bits):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:20] ^ np.uint64(0b1011), fps[:5] ^ np.uint64((1 << 63) | (1 << 40) | 5)]))
    want = {(int(a), int(b)) for a in fps for b in fps if a != b and int(a ^ b).bit_count() <= 4}
    root = {int(a): int(a) for a in fps}
    for p in range(16):
        near = np.bitwise_count((fps >> np.uint64(60)) ^ np.uint64(p)) <= 2
        for found in simhash._meet(fps[near], p, 4, range(1 << sub_bits), sub_bits):
            for a, b in zip(*found, strict=True):
                ra, rb = root[int(a)], root[int(b)]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    true = {k: k for k in root}
    for a, b in want:
        low = min(true[a], true[b])
        true = {k: low if v in (true[a], true[b]) else v for k, v in true.items()}
    assert root == true


def test_loads():
    held = np.random.default_rng(2).integers(0, 9, 64)
    want = [sum(held[q] * len(simhash._masks(58, 2 - (p ^ q).bit_count())) for q in range(64) if (p ^ q).bit_count() <= 2) for p in range(64)]
    assert simhash._loads(held, 6).tolist() == want


def test_simhash_divided(docs, monkeypatch):
    """Buckets divided into sub-buckets and over tasks give the same components."""
    want = {i: r.component_id for i, r in by_id(simhash.near_duplicates(docs)).items()}
    monkeypatch.setattr(simhash, "VARIANTS_PER_BUCKET", 50)
    monkeypatch.setattr(simhash, "MAX_BITS", 6)
    monkeypatch.setattr(simhash, "PASSES", 2)
    assert {i: r.component_id for i, r in by_id(simhash.near_duplicates(docs)).items()} == want


def test_toxicity(spark, docs, empty):
    bad = ["vileword", "nastyword"]
    rows = [(1000 + i, " ".join(prose(20) + (f" {random.choice(bad)}" if i % 3 == 0 else "") for _ in range(4)), int(i % 3 == 0)) for i in range(1200)]
    more = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(more.select("doc_id", "text"), more.select("doc_id", "toxic"))
    got = toxicity.score(more.select("doc_id", "text", F.lit(1).alias("score")), model).withColumn("held", toxicity.held_out()).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    scores = by_id(toxicity.score(docs, model))
    assert len(scores) == len(TEXTS) and all(0 <= r.score <= 1 for r in scores.values()) and scores[5].score == scores[6].score
    none = toxicity.fit(docs, more.select("doc_id", "toxic").limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.25}
    assert toxicity.score(empty, model).collect() == []


def test_long_words():
    """All of a run without blanks is read: in its features, and as far as the score."""
    run = "".join(random.choices("abcdefghijklmnop", k=997)).encode()
    words = toxicity.Words()
    ids, (_, tri, start) = words.of(run), words.features()
    short = toxicity.Words()
    for i in range(len(run) - 2):
        short.of(run[i : i + 3])
    want = set(short.features()[1].reshape(-1, 3)[:, 1].tolist())
    assert want <= set(tri.tolist()) and len(ids) == len(start) > toxicity.WINDOW
    assert toxicity.split(b"a" * 40 + b" B") == [b"a" * 40, b"b"]
    assert all(any(run[i : i + 20] in w for w in words.ids) for i in range(len(run) - 19))
    text = lambda bad, at: ("_".join(random.choices(VOCAB, k=30)) + "_" + ("vileword_" * bad) + "_".join(random.choices(VOCAB, k=at)))
    model = toxicity.train([text(i % 2, 60).encode() for i in range(600)], [i % 2 for i in range(600)])
    got = toxicity.Scorer(model)([text(i % 2, 60).encode() for i in range(100)])
    assert np.mean([(s >= 0.5) == i % 2 for i, s in enumerate(got)]) > 0.9


def test_fit_reads_whole_texts(spark, monkeypatch):
    """The sample has whole texts, each label once, none of the held-out fold, and none over the bound on bytes."""
    text = "a " * 9000 + "end"
    rows = [(i, text if i % 2 else f"short {i}") for i in range(40)] + [(1, text), (2, None)]
    labels = [(i, i % 2) for i in range(40)] * 2 + [(None, 1), (3, None), (4, 7)]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got: list = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: got.append(sorted(zip(texts, labels, strict=True))))
    toxicity.fit(*frames)
    own = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert got[0] == sorted([((text if i % 2 else f"short {i}").encode(), i % 2) for i in own] + [(b"", 0)] * (2 in own))
    monkeypatch.setattr(toxicity, "MAX_FIT_BYTES", 1000)
    toxicity.fit(*frames)
    assert got[1] == [x for x in got[0] if x[1] == 0]


def test_few_labels_few_steps(monkeypatch):
    steps, real = [], toxicity._grads
    monkeypatch.setattr(toxicity, "_grads", lambda *a: steps.append(1) or real(*a))
    toxicity.train([b"one two", b"three four"], [0, 1])
    assert len(steps) == toxicity.MIN_STEPS
    assert toxicity.train([b"", b" "], [0, 1]).prior is None  # no word to learn from


def test_all_windows():
    """Every window takes part in the choice, also those of a long text."""
    words = toxicity.Words()
    docs = [words.of(prose(n).encode()) for n in (0, 3, 48, 49, 700)]
    model = toxicity.Model()
    of, at, logit = toxicity.window_logits(model, model.project(model.embed(words.features())), docs)
    assert [at[of == i].tolist() for i in range(5)] == [toxicity.windows(len(d)).tolist() for d in docs] and at.max() + toxicity.WINDOW >= 700
    assert np.isfinite(logit).all()


def test_gradients():
    model = toxicity.Model(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    words = toxicity.Words()
    ids = [words.of(b"one two three"), words.of(b"two four")]
    feats, fill, y = words.features(), toxicity._fill(ids), np.array([1.0, 0.0])
    loss = lambda: toxicity._grads(model, feats, model.embed(feats), *fill, y)[1]
    g, _ = toxicity._grads(model, feats, model.embed(feats), *fill, y)
    for k in ("uf", "wb", "va", "wo", "ua", "cf"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = model.p[k][at], 1e-3
        model.p[k][at] = old + e
        up = loss()
        model.p[k][at] = old - e
        down = loss()
        model.p[k][at] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][at], rel=0.05, abs=1e-4)


def test_chunks(docs, empty):
    got = by_id(chunks.dedup(docs))
    want = plain.chunks(list(enumerate(B)))
    assert {i: (r.n_removed, hashlib.sha256(r.kept).hexdigest()) for i, r in got.items()} == want
    assert got[1].n_removed == len(B[1]) and got[0].n_removed == 0 and got[4].n_removed > 150
    shifted = b"zz" + B[10]
    assert set(chunks.digests(B[10], chunks.borders(B[10]))[3:]) <= set(chunks.digests(shifted, chunks.borders(shifted)))
    assert chunks.dedup(empty).collect() == []


def test_borders_are_local(monkeypatch):
    """Borders are those of a plain scan; what stands far off doesn't change them, nor do the pieces of the scan."""
    head = b"ab" * 300 + prose(300).encode()
    for t in (*B, head, b"a" * 3000, b"la " * 500, b"ab"):
        assert chunks.borders(t).tolist() == plain.borders(t)
    alone = chunks.borders(head)
    for far in (b"x" * 3000, b"xy" * 2000, prose(100).encode()):
        both = chunks.borders(head + far)
        assert set(alone[alone < len(head) - 100]) <= set(both.tolist())
    want = [chunks.borders(t).tolist() for t in (*B, head)]
    monkeypatch.setattr(chunks, "PIECE", 150)
    assert [chunks.borders(t).tolist() for t in (*B, head)] == want


def test_pieces(monkeypatch):
    """Texts longer than a piece: the same fingerprint, and equal windows have equal names."""
    t = (prose(300) + " " + PASSAGE + " " + prose(200) + " " + PASSAGE).encode()
    want = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert simhash.fingerprint(t) == want
    monkeypatch.setattr(suffixes, "PIECE", 500)
    for k in (32, 41, 77, 80):
        of, names = {}, np.zeros(len(t) - 79, np.uint64)
        cover = np.zeros(len(t) - 79, int)
        for name, a, e, _ in zip(*suffixes.segments(t, 80, k), strict=True):
            names[a:e] = name
            cover[a:e] += 1
        assert (cover == 1).all()
        for i, n in enumerate(names.tolist()):
            assert of.setdefault(t[i : i + 80], n) == n


def test_chunks_short(spark):
    """Short exact copies go whole, each of these passages of 51 words in part; ends that are alike by chance stay."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    rows, passages = [words(3), words(3)[:20], words(12)[:99], "q"] * 2, [words(51) for _ in range(200)]
    rows += [f"{words(60)} {p} {words(40)}" for _ in range(2) for p in passages]
    rows += ["so " + words(30) + " end.", "so " + words(30) + " end.", words(30) + " " + "la " * 200]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = by_id(chunks.dedup(frame))
    assert [got[i].n_removed for i in range(8)] == [0] * 4 + [len(r) for r in rows[:4]]
    assert all(got[8 + i].n_removed == 0 and 0 < got[208 + i].n_removed <= len(p) for i, p in enumerate(passages))
    assert got[408].n_removed == got[409].n_removed == 0 and 400 < got[410].n_removed < 600
    assert all(np.diff(chunks.borders(r.encode()), prepend=0).min() > chunks.NEAR for r in rows[8:410])


def test_chunks_ids(spark):
    """A passage shared by null ids, by other texts of one id, or by a null and another id is kept once."""
    for ids in ([None, 5], [None, None], [5, 5], ["a", None, "a", None]):
        texts = [f"{prose(60)} {PASSAGE} {prose(40)}" for _ in ids]
        kind = "string" if "a" in ids else "long"
        got = chunks.dedup(spark.createDataFrame([*zip(ids, texts), (ids[0], texts[0])], f"doc_id {kind}, text string").repartition(3)).collect()
        n = {r.kept: r.n_removed for r in got}
        assert len(got) == len(ids) + 1 and len(n) == len(ids) and all(r.n_repeated > 150 for r in got)
        assert sorted(x > 150 for x in n.values()) == [False] + [True] * (len(ids) - 1) and min(n.values()) == 0


def test_sentencepiece(docs, empty):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=wfst.model_path())
    machine = wfst.Transducer(wfst.model_path())
    odd = ["  a", "a  b ", "\n\n x", "▁a ▁", "<0x41> <s>", "if (x==1):\n    return  foo", "\0 n", *["".join(random.choices("ab  \n\t'sé日▁1.", k=20)) for _ in range(100)]]
    for t in [*[t or "" for t in TEXTS], *odd]:
        assert machine.encode(t).tolist() == sp.encode(t)
        assert machine.decode(sp.encode(t)) == sp.decode(sp.encode(t)) == t.replace("▁", " ")
    got = by_id(wfst.encode(docs))
    assert all(r.round_trip for r in got.values()) and got[5].n_pieces == 0 and wfst.encode(empty).collect() == []


def _message(n: int, v) -> bytes:
    """A field of a protocol buffer message."""
    varint = lambda x: bytes([x]) if x < 128 else bytes([x & 127 | 128]) + varint(x >> 7)
    if isinstance(v, int):
        return varint(n << 3) + varint(v)
    if isinstance(v, float):
        return varint(n << 3 | 5) + struct.pack("<f", v)
    v = v.encode() if isinstance(v, str) else v
    return varint(n << 3 | 2) + varint(len(v)) + v


@pytest.mark.parametrize("mapped", [False, True])
def test_unigram_models(tmp_path, mapped):
    """Unigram models written by hand, with and without a character map, byte fallback, prefix and squeezing, against the library."""
    sp = pytest.importorskip("sentencepiece")
    rng = random.Random(1)
    table = dict(wfst._fields(dict(wfst._fields(sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]))[2] if mapped else b""
    for fallback in (0, 1):
        for prefix, squeeze in ((0, 0), (1, 1)) if mapped else ((0, 0), (0, 1), (1, 0), (1, 1)):
            vocab = sorted({rng.choice(["", "▁"]) + "".join(rng.choices("abc" if rng.random() < 0.7 else "ab▁c日é.", k=rng.randint(1, 4))) for _ in range(60)})
            pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *[(f"<0x{i:02X}>", -30.0, 6) for i in range(256 * fallback)], *[(v, -rng.randint(8, 80) / 8, 1) for v in vocab]]
            data = b"".join(_message(1, _message(1, p) + _message(2, s) + _message(3, k)) for p, s, k in pieces)
            data += _message(2, _message(3, 1) + _message(35, fallback)) + _message(3, _message(2, table) + _message(3, prefix) + _message(4, squeeze))
            path = tmp_path / f"{fallback}{prefix}{squeeze}.model"
            path.write_bytes(data)
            library, machine = sp.SentencePieceProcessor(model_file=str(path)), wfst.Transducer(str(path))
            for _ in range(200):
                x = "".join(rng.choices("aabbccé日  .\t\nＡ①x▁é́ﬁ", k=rng.randint(0, 25)))
                ids = library.encode(x)
                assert machine.encode(x).tolist() == ids and machine.decode(ids) == library.decode(ids)


def test_quality(docs, empty):
    got = by_id(quality.rules(docs))
    for i, t in enumerate(B):
        w = t.split()
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        hit = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 1000 else None
        r = got[i]
        assert r.n_words == len(w) and r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(c in b"#*$%&|<>" for c in t)
        if hit is not None:
            assert r.n_repeat_words == len(hit)
        if r.base_failed:
            assert not r.kept
    assert got[0].kept and got[3].kept and not got[9].kept
    nav = b"\n".join(b" | ".join(w.encode() for w in VOCAB[i : i + 8]) for i in range(0, 80, 8))
    assert not quality.judge(nav, {})[6] and quality.judge(b"x.\nx.\n\n x", {})[3] == 1
    assert quality.rules(empty).collect() == []


def test_decontaminate(spark, docs, empty):
    items = [("1", " ".join(PASSAGE.upper().split()[20:45])), ("2", "zzz qqq"), ("10", "a"), ("3", None), ("4", "!!"), ("1", PASSAGE)]
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    want = plain.decontaminate(B, [(i, (t or "").encode()) for i, t in items])
    for block in (decontaminate.BLOCK_BYTES, 100):
        decontaminate.BLOCK_BYTES, old = block, decontaminate.BLOCK_BYTES
        got = by_id(decontaminate.scan(docs, bench))
        cut = by_id(decontaminate.remove(docs, bench))
        decontaminate.BLOCK_BYTES = old
        assert [(r._n_words, sum(s.b - s.a for s in r._spans), len(r._items), hashlib.sha256(",".join(sorted(r._items)).encode()).hexdigest()) for _, r in sorted(got.items())] == want
        assert PASSAGE not in cut[3].text and cut[0].text == TEXTS[0] and cut[5].text is None and PASSAGE.split()[0] not in cut[4].text.split("\n")[1].split()[:1]
    assert decontaminate.scan(empty, bench).collect() == [] and decontaminate.scan(docs, bench.limit(0)).count() == len(TEXTS)


def test_fm_index():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 300):
        s = rng.integers(0, 3, n)
        index = decontaminate.FMIndex(s)
        for m in (1, 2, 5):
            pats = rng.integers(0, 4, (20, m))
            who, a, b = index.search(pats)
            got = {int(w): sorted(index.locate(np.arange(x, y)).tolist()) for w, x, y in zip(who, a, b, strict=True)}
            for i, p in enumerate(pats.tolist()):
                assert got.get(i, []) == [j for j in range(n - m + 1) if s[j : j + m].tolist() == p]


def test_token_file(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = by_id(tokenfile.read(tokenfile.write(docs, path, tokenfile.Shelf(spark, "test"))))
    at = 0
    for i, x in enumerate(TEXTS):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    encode = tokenfile.Encoder(path, True)
    odd = ["", " ", "a  b", "foo \n bar", "foo\n \nbar", "don't 's it''s x.'s", " lead", "trail ", "a\nb", "<|endoftext|>", "é日 ok!!", *["".join(random.choices("ab  \n\t'sé日1.", k=15)) for _ in range(200)]]
    for _ in range(3):
        assert encode(odd) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(odd, add_special_tokens=False)]
    for width in (1, 3, 8, 11, 16, 17, 32):
        ids = np.random.default_rng(width).integers(0, 1 << width, 9001).astype(np.uint32)
        s = tokenfile.Segment(tokenfile.segment(ids, np.array([9001]), width))
        assert (s.read(0, 9001) == ids).all() and (s.read(4000, 8200) == ids[4000:8200]).all()
    assert tokenfile.read(tokenfile.write(empty, path, tokenfile.Shelf(spark, "test"))).collect() == []


def test_token_file_added(spark):
    """Texts that hold the file's added token, against the library's tokenizer as it comes."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, mark, at = Tokenizer.from_file(path), "<|endoftext|>", 0
    texts = ["one two", f"end {mark} next", mark, f"a{mark}b {mark}\nc.", f"{mark}{mark}", "<|endoftext|", f" {mark} ", f"é {mark}日 ok", "three four"]
    got = by_id(tokenfile.read(tokenfile.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, tokenfile.Shelf(spark, "test"))))
    assert plain.encode(texts[1], add_special_tokens=False).ids == [437, 220, 50256, 1306]
    for i, x in enumerate(texts):
        ids = np.array([*plain.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("length,hot", [(400, suffixes.HOT), (60, 3)])
def test_suffixes(docs, empty, length, hot):
    got = by_id(suffixes.dedup(docs, length, hot))
    want = plain.suffixes(B, length)
    assert [(r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for _, r in sorted(got.items())] == want
    assert suffixes.dedup(empty, length).collect() == []


def test_two_stage_sorting():
    for letters in (b"a", b"ab", bytes(range(256))):
        data = bytes(random.choices(letters, k=300))
        sa = suffixes.suffix_array(data, np.ones(300, bool), 300)
        assert sa.tolist() == sorted(range(300), key=lambda i: data[i:])


def test_clashing_columns(spark, docs, tmp_path):
    """Stages hand on columns that are named like their own, values and all."""
    names = ["score", "_row", "_fp", "_spans", "_items", "_n_words", "root", "component_id"]
    wide = docs.select("doc_id", "text", "n_chars", *[F.lit(c).alias(c) for c in names])
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [corpus_pipeline.STAGES[0][1](spark, wide, str(tmp_path))]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out.append(stage(spark, wide, str(tmp_path)))
    for o in out:
        assert o.columns == wide.columns and all(r[c] == c for r in o.collect() for c in names)
    assert PASSAGE not in by_id(out[2])[3].text and out[0].count() == len(TEXTS) and all(o.count() for o in out)


def test_pipeline_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "sentencepiece"]
    plain = docs.drop("fp")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.STAGES[1][1](spark, plain, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, out, str(tmp_path))
    rows = by_id(out)
    assert out.columns == plain.columns and 1 not in rows and rows[0].n_chars == len(TEXTS[0]) and PASSAGE not in rows[3].text
    assert all(r.round_trip for r in corpus_pipeline.STAGES[4][1](spark, out, str(tmp_path)).collect())
