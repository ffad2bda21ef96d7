"""The registered queries on a written table: their contract's columns against plain versions, with null ids and texts,
repeated rows, reused ids, long texts, clashing column names and empty tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import plain_versions as plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark import llm
from quillspark.llm import decontaminate, pii, wfst

rng = random.Random(12)
VOCAB = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(500)]
prose = lambda n: " ".join(rng.choices(VOCAB, k=n))
PASSAGE, BASE = prose(90), prose(150)
KEY = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
TEXTS = [
    BASE, BASE, BASE.replace(BASE.split()[80], "changed", 1), f"{prose(40)}. {PASSAGE}.\n{prose(30)}", f"{prose(25)}\n{PASSAGE} {prose(8)}", None, "", " \n ", "a", "la " * 900, prose(5000), "日本語 🔥 é́ ß " + prose(20),
    "mail a.b@c.de or 10.0.0.1 and +1 (389) 555-5010; card 4111 1111 1111 1111, iban DE89370400440532013000", f'the token = "{KEY}" and 1.2.3.4', "x" * 5000, "one\none\nOne two\n\none", "end <|endoftext|> next\n\n  two",
    "\n".join("Home | About | News | Contact" for _ in range(4)) + "\n" + prose(15) + ".", "\n".join(" | ".join(rng.sample(VOCAB, 8)) for _ in range(8)),
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3]), (None, BASE), (None, BASE), (4, prose(60) + " " + PASSAGE), (10**12, TEXTS[10])]
CLASHING = ["h", "fp", "score", "spans", "name", "part", "d1", "t1", "k2", "rid", "shard", "size", "kept", "again", "root", "component_id", "_n_words", "_m", "_spans", "held_out", "toxic", "at", "a", "b"]
BYTES = [(i, (t or "").encode()) for i, t in ROWS]
ITEMS = [(1, " ".join(PASSAGE.upper().split()[20:45])), (2, "zzz qqq"), (10, "changed"), (3, None), (4, "!!"), (1, PASSAGE)]


def written(spark, folder, rows, items, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASHING]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1)).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("tables"), ROWS, ITEMS, [(i, 1, int(i % 4 == 0)) for i in range(19)])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), [], [], [])


def rows(spark, folder, name, *cols):
    return sorted((tuple(r) for r in llm.QUERIES[name](spark, folder).select(*cols).collect()), key=str)


def expected(values):
    return sorted(((i, *v) for (i, _), v in zip(ROWS, values, strict=True)), key=str)


def test_empty_tables(spark, empty):
    for name, query in llm.QUERIES.items():
        assert query(spark, empty).collect() == [], name
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_op1(spark, folder):
    got = llm.QUERIES["op1_sharding"](spark, folder).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == expected([(len(b) + 16, zlib.crc32(b)) for _, b in BYTES])
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2(spark, folder):
    found = [plain.pii(t or "") for _, t in ROWS]
    digest = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    count = lambda spans: [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    assert rows(spark, folder, "op2_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected([(*count(s), digest(s)) for s in found])
    all_spans = {r.doc_id: r for r in llm.QUERIES["op2_pii"](spark, folder).collect()}
    for (i, _), spans in zip(ROWS, found, strict=True):
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(all_spans[i].spans.split(",")) | ({""} if not spans else set())
    assert all_spans[13].spans == "secret:13:53,ip:59:66" and all_spans[13].scores.split(",")[0] == "0.70" and all_spans[12].n_iban == 1 and all_spans[0].spans == ""


def test_op3(spark, folder):
    fps = [(i, plain.fingerprint(b)) for i, b in BYTES]
    want = [(f"{fp:016x}", c) for (_, fp), c in zip(fps, plain.components(fps), strict=True)]
    assert rows(spark, folder, "op3_simhash", "doc_id", "fingerprint", "component_id") == expected(want)


def test_op4(spark, folder):
    got = llm.QUERIES["op4_toxicity"](spark, folder).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert all(by[a] == pytest.approx(by[b], abs=1e-5) for a, b in ((0, 1), (0, None), (5, 6), (10, 10**12)))


def test_op5(spark, folder):
    want = plain.chunks_of(BYTES)
    assert rows(spark, folder, "op5_chunk_dedup", "doc_id", "n_bytes", "n_removed", "kept_sha256") == expected([(len(b), *want[i, b]) for i, b in BYTES])


def test_op6(spark, folder):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=wfst.model_path())
    want = []
    for _, t in ROWS:
        ids = library.encode(t or "")
        want.append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    assert rows(spark, folder, "op6_sentencepiece", "doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip") == expected(want)


def _views(folder):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql_twins(spark, folder, name):
    out = _views(folder).sql(llm.ORACLES[name])
    assert sorted(out.fetchall(), key=str) == rows(spark, folder, name, *out.columns) and set(out.columns) == set(llm.QUERIES[name](spark, folder).columns)


def test_op7(spark, folder):
    got = rows(spark, folder, "op7_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == expected([plain.quality(b) for _, b in BYTES])
    kept = rows(spark, folder, "op7_quality_rules", "doc_id", "base_failed", "kept")
    assert not any(failed and kept for _, failed, kept in kept) and (0, False, True) in kept and (17, True, False) in kept and (18, False, False) in kept


def test_op8(spark, folder):
    want = plain.decontaminate([b for _, b in BYTES], [(str(i), (t or "").encode()) for i, t in ITEMS])
    got = rows(spark, folder, "op8_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == expected([(*w, w[1] > 0) for w in want])


def test_op9(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in llm.QUERIES["op9_token_file"](spark, folder).collect()}
    texts: dict = {}
    for i, x in order:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        texts.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for (i, start), row in sorted(got.items(), key=lambda x: x[0][1]):  # texts of one id come in any order
        assert start == at and row in texts[i]
        texts[i].remove(row)
        at += row[0]
        want.append(i)
    assert want == [i for i, _ in order] and not any(texts.values())


def test_op10(spark, folder):
    want = plain.suffixes([b for _, b in BYTES], 400)
    assert rows(spark, folder, "op10_suffix_array", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected([(len(b), *w) for (_, b), w in zip(BYTES, want, strict=True)])


def test_pipeline_run(spark, tmp_path):
    """All five stages: without labels nothing is toxic; one of each group stays; passages, personal data and ids as by plain versions."""
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=wfst.model_path())
    folder = written(spark, tmp_path, ROWS, ITEMS[:1], [])
    got = corpus_pipeline.run(spark, folder).collect()
    fps = [(i, plain.fingerprint(b)) for i, b in BYTES]
    phrases, want, seen = decontaminate.Phrases([("1", ITEMS[0][1].encode())]), [], set()
    for (i, t), root, least in zip(ROWS, plain.roots(fps), plain.components(fps), strict=True):
        if i == least and root not in seen:
            seen.add(root)
            spans = plain.spans_of(phrases.scan([decontaminate.words_of((t or "").encode())])[0][0])
            want.append((i, library.encode(pii.mask(decontaminate.cut((t or "").encode(), spans).decode()))))
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted(want)


def test_pipeline_drops_toxic(spark, tmp_path):
    bad = [(100 + i, " ".join([prose(12), "vileword", prose(9)])) for i in range(40)]
    good = [(500 + i, prose(25)) for i in range(160)]
    folder = written(spark, tmp_path, bad + good, [], [(i, 1, int(i < 500)) for i, _ in bad + good])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and sum(i < 500 for i in ids) <= 4 and sum(i >= 500 for i in ids) >= 156
