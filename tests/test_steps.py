import hashlib
import io
import math
import random

import pyarrow as pa
import pytest
import sentencepiece as sp
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from quillspark import operators as O
from quillspark.functions import arrow, stem, subword, text
from quillspark.functions.counts import COUNT_FUNCTIONS
from quillspark.operators import taggers
from quillspark.plans import long

SAM = ["I would not eat them here or there.", "I would not eat them anywhere.", "I would not eat green eggs and ham.", "I do not like them, Sam-I-am."]
WORDS = [s.lower().replace(".", "").replace(",", "").replace("-", " ").split() for s in SAM]


@pytest.fixture(scope="module")
def sam(spark):
    return spark.createDataFrame(list(enumerate(SAM, 1)), "id int, text string").coalesce(1)


def tokens(df, name="text"):
    return [r[0] for r in df.orderBy("id").select(name).collect()]


def test_words(sam):
    assert tokens(O.Pipeline((O.Tokenize("text"),)).fit(sam).training) == WORDS


def test_top_k_ties(sam):
    out = O.Pipeline((O.Tokenize("text"), O.TokenFilter("text", max_tokens=10))).fit(sam)
    assert {t for r in tokens(out.training) for t in r} == set("i would not eat them anywhere eggs and do am".split())


def test_filter_range_and_function(sam):
    out = O.Pipeline((O.Tokenize("text"), O.TokenFilter("text", min_times=2, max_times=3))).fit(sam).training
    assert tokens(out) == [["would", "eat", "them"], ["would", "eat", "them"], ["would", "eat"], ["them"]]
    out = O.Pipeline((O.Tokenize("text"), O.TokenFilter("text", filter_fun=lambda t: F.length(t) >= 5))).fit(sam).training
    assert tokens(out) == [["would", "there"], ["would", "anywhere"], ["would", "green"], []]


def test_stopwords_keep_sets_the_vocabulary(sam):
    out = O.Pipeline((O.Tokenize("text"), O.Stopwords("text", keep=True, custom=("eat", "zebra")), O.TermFrequency("text"))).fit(sam).training
    assert out.columns == ["id", "tf_text_eat", "tf_text_zebra"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0)]


def test_tf_idf(sam):
    out = O.Pipeline((O.Tokenize("text"), O.TfIdf("text"))).fit(sam).training.orderBy("id").collect()
    for row, ws in zip(out, WORDS, strict=True):
        for t in {t for w in WORDS for t in w}:
            n_docs = sum(t in w for w in WORDS)
            assert row[f"tfidf_text_{t}"] == pytest.approx(ws.count(t) / len(ws) * math.log(1 + 4 / n_docs))


def test_idf_is_learnt_in_training_alone(spark):
    train = spark.createDataFrame([("i g",), ("i i i",)], "text string")
    fitted = O.Pipeline((O.Tokenize("text"), O.TfIdf("text"))).fit(train)
    row = fitted.transform(spark.createDataFrame([("i g",)], "text string")).first()
    assert (row.tfidf_text_g, row.tfidf_text_i) == pytest.approx((math.log(3) / 2, math.log(2) / 2))


@pytest.mark.parametrize("scheme,want", [("term frequency", [0.5, 0.25, 0.25]), ("binary", [1, 1, 1]), ("raw count", [2, 1, 1]), ("log normalization", [math.log(3), math.log(2), math.log(2)]), ("double normalization", [1, 0.75, 0.75])])
def test_schemes(spark, scheme, want):
    df = spark.createDataFrame([("a b a d",)], "text string")
    out = O.Pipeline((O.Tokenize("text"), O.TermFrequency("text", weight_scheme=scheme))).fit(df).training.first()
    assert list(out) == pytest.approx(want)


def test_ngrams(spark):
    df = spark.createDataFrame([(list("abcde"),), (["a", "b"],), ([],), (None,)], "t array<string>").coalesce(1)
    got = [r[0] for r in df.select(text.ngrams(F.col("t"), 3, 2)).collect()]
    assert got == [["a_b", "b_c", "c_d", "d_e", "a_b_c", "b_c_d", "c_d_e"], ["a_b"], [], []]
    for n, lo in ((0, 1), (1, 0), (1, 2)):
        with pytest.raises(ValueError):
            text.ngrams(F.col("t"), n, lo)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=5), st.integers(1, 3))
def test_ngram_counts(spark, rows, k):
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>").coalesce(1)
    assert [len(r[0]) for r in df.select(text.ngrams(F.col("t"), k)).collect()] == [max(0, len(r) - k + 1) for r in rows]


@pytest.mark.parametrize("pad,cut,want", [("pre", "pre", [[3, 4, 5, 6, 7], [0, 0, 1, 2, 3]]), ("post", "post", [[1, 2, 3, 4, 5], [1, 2, 3, 0, 0]])])
def test_codes(spark, pad, cut, want):
    df = spark.createDataFrame([(list("abcdefg"),), (list("abc"),), ([],)], "t array<string>").coalesce(1)
    got = [r[0] for r in df.select(text.codes(F.col("t"), list("abcdefg"), 5, pad, cut)).collect()]
    assert got == [*want, [0] * 5]


def test_embeddings(spark):
    emb = spark.createDataFrame([("the", 1.0, 0.0), ("cat", 0.0, 1.0), ("cat", 9.0, 9.0)], "token string, d1 double, d2 double").coalesce(1).limit(2)
    df = spark.createDataFrame([(1, "the cat the"), (2, "none"), (3, None)], "id int, text string")
    for agg, want in (("sum", (2, 1)), ("mean", (2 / 3, 1 / 3)), ("min", (0, 0)), ("max", (1, 1))):
        out = O.Pipeline((O.Tokenize("text"), O.WordEmbeddings("text", embeddings=emb, aggregation=agg, aggregation_default=7))).fit(df).training.orderBy("id").collect()
        assert tuple(out[0])[1:] == pytest.approx(want) and tuple(out[1])[1:] == (7, 7) and tuple(out[2])[1:] == (7, 7)


def test_hash(sam):
    made = [O.Pipeline((O.Tokenize("text"), O.TextHash("text", num_terms=16, signed=s))).fit(sam).training.orderBy("id").collect() for s in (True, False)]
    assert [sum(r[1:]) for r in made[1]] == [8, 6, 8, 8] and made[0] != made[1]
    assert made[1][0].__fields__[1] == "texthash_text_01"


def test_counts(spark):
    df = spark.createDataFrame([("café \U0001f525 #tag @me http://x!, a-b",), (None,)], "x string").coalesce(1)
    row, null = df.select(*[f(F.col("x")).alias(k) for k, f in COUNT_FUNCTIONS.items()]).collect()
    assert (row.n_nonasciis, row.n_hashtags, row.n_mentions, row.n_urls, row.n_commas, row.n_exclaims) == (6, 1, 1, 1, 1, 1)
    assert set(null) == {0}
    assert df.sparkSession.range(1).select(COUNT_FUNCTIONS["to_be"](F.lit("were")), COUNT_FUNCTIONS["first_person"](F.lit("i am"))).first()[:] == (2, 0)


def test_subwords(sam):
    with pytest.raises(ValueError, match="23 characters"):
        O.Pipeline((O.TokenizeBPE("text", vocabulary_size=10),)).fit(sam)
    out = O.Pipeline((O.TokenizeBPE("text", vocabulary_size=1000),)).fit(sam).training
    assert tokens(out) == [["▁" + w for w in s.split()] for s in SAM]
    vocab = ("[UNK]", "i", "would", "not", "eat", "them", "any", "##where", ".")
    assert subword.wordpiece(SAM[1], frozenset(vocab)) == ["i", "would", "not", "eat", "them", "any", "##where", "."]


def test_sentencepiece_counts(spark):
    """The model is that of the whole column: a word seen 500 times weighs more than one seen 51 times."""
    counts = {"hello": 51, "help": 51, "under": 51, "thunder": 500, "low": 60, "lower": 500, "newest": 500, "lowest": 60, "held": 51, "new": 60}
    words = [w for w, n in sorted(counts.items()) for _ in range(n)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, text string")
    out, model = O.Pipeline((O.TokenizeSentencePiece("text", vocabulary_size=30),)).fit(df).training, io.BytesIO()
    sp.SentencePieceTrainer.train(sentence_iterator=iter(words), model_writer=model, vocab_size=30, hard_vocab_limit=False, minloglevel=2)
    plain = sp.SentencePieceProcessor(model_proto=model.getvalue())
    assert tokens(out) == [plain.encode(w, out_type=str) for w in words]


def test_stems():
    for w, s in (("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("sky", "sky"), ("running", "run"), ("consistency", "consist")):
        assert stem.english(w) == s
    assert stem.russian("коты") == "кот"


#: Pairs from the samples that are published with the stemmers.
SAMPLES = {
    "french": "continu continu continua continu continuait continu continuation continu continué continu continuel continuel continuelle continuel continuellement continuel continuer continu continuera continu continuerait continu continuité continu "
    "continuons continuon contorsions contors contournant contourn contre contr main main mains main maintenaient mainten maintenant mainten maintenir mainten maintenue maintenu maire mair mairie mair mais mais maison maison maisons maison "
    "maître maîtr maîtresse maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeure majeur majordome majordom majorité major majorités major malade malad maladie malad maladive malad",
    "spanish": "cheque chequ cheques chequ cheraw cheraw chester chest chetumaleños chetumaleñ chía chi chiapas chiap chica chic chicago chicag chicas chic chicharrones chicharron chichen chich chicles chicl torá tor tórax torax torcer torc "
    "toreado tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer tormenta torment tornado torn tornen torn torneo torne torneos torne tornillo tornill torniquete torniquet torpedearon torped torpeza torpez torre torr "
    "torrenciales torrencial",
    "german": "aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgende aufeinanderfolg aufeinanderfolgt aufeinanderfolgt aufeinanderschlügen aufeinanderschlug aufenthaltes aufenthalt auferlegten auferlegt "
    "auferstehen aufersteh auferstehung aufersteh auferstünde auferstund aufessen aufess auffallend auffall kategorie kategori kategorien kategori kategorisch kategor kategorischer kategor kater kat katerliede katerlied katze katz käuer kau käufer kauf "
    "kaufleute kaufleut käuflich kauflich",
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_more_stems(language):
    words = SAMPLES[language].split()
    got = [(w, stem.STEMMERS[language](w)) for w in words[::2]]
    assert got == list(zip(words[::2], words[1::2], strict=True))
    assert all(isinstance(stem.STEMMERS[language](w), str) for w in ("", "a", "y", "qu", "gué", "日本", "s", "ß", "ment", "ement"))


def test_stop_lists(sam):
    """Four languages; forms made of stems and endings are there once."""
    from quillspark.functions.stopwords import SOURCES, stopwords

    for language, some in (("de", "keinem unser manche dein derselbe"), ("fr", "serions avaient eussent étées été"), ("es", "estuviéramos tendríais fueseis nuestra habidas")):
        words = stopwords(language)
        assert set(some.split()) <= set(words) and len(words) == len(set(words)) > 150
    assert all(w == w.lower() and w for words in SOURCES.values() for w in words)
    assert tokens(O.Pipeline((O.Tokenize("text"), O.Stopwords("text", language="de"))).fit(sam).training) == [[w for w in x if w not in stopwords("de")] for x in WORDS]


def test_bpe_is_the_plain_algorithm():
    """The heap's merges are those of counting all pairs anew at each step."""
    rng = random.Random(3)
    for _ in range(20):
        counts = {"▁" + "".join(rng.choices("abcd", k=rng.randint(1, 8))): rng.randint(1, 6) for _ in range(25)}
        words, want = {w: list(w) for w in counts}, []
        while len(want) + len({c for w in counts for c in w}) < 40:
            pairs: dict = {}
            for w, s in words.items():
                for p in zip(s, s[1:], strict=False):
                    pairs[p] = pairs.get(p, 0) + counts[w]
            if not pairs:
                break
            want.append(min(pairs, key=lambda p: (-pairs[p], p)))
            words = {w: subword.merge(s, want[-1]) for w, s in words.items()}
        assert subword.train_bpe(counts, 40) == want


INNER = ["_tokens", "_counts", "_values", "_hash", "_codes", "_topics", "_pooled", "_key", "_row", "_0", "_1", "token", "n", "_runs", "_lda_counts"]


def test_names_of_users_stay(spark, sam):
    """Columns that are called like the steps' own stay as they are."""
    emb = spark.createDataFrame([("eat", 1.0, 2.0), ("not", 3.0, None)], "token string, d1 double, d2 double")
    wide = sam.select("*", *[F.lit(c).alias(c) for c in INNER])
    tok = O.Tokenize("text")
    pipes = [
        (tok, O.TermFrequency("text")), (tok, O.TermFrequency("text", output="vector")), (tok, O.TfIdf("text")), (tok, O.TextHash("text", num_terms=4)), (tok, O.TextHash("text", num_terms=4, output="map")), (O.DummyHash("text", num_terms=4),),
        (tok, O.SequenceOneHot("text", sequence_length=3)), (tok, O.WordEmbeddings("text", embeddings=emb)), (tok, O.WordEmbeddings("text", embeddings=emb, max_bytes=0, key="id")), (tok, O.LDA("text", num_topics=2, max_iter=1)),
    ]
    for steps in pipes:
        out = O.Pipeline(steps).fit(wide).training
        rows = out.select("id", *INNER).collect()
        assert len(rows) == 4 and all(r[c] == c for r in rows for c in INNER), steps


def test_embeddings_after_a_shuffle(spark):
    """Vectors stay with their rows, on both ways, with rows dealt anew before; long rows are pooled in blocks."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    emb = spark.createDataFrame([(w, float(i), float(i % 7) if i % 5 else None) for i, w in enumerate(vocab)], "token string, d1 double, d2 double")
    texts = [" ".join(rng.choices([*vocab, "zz"], k=rng.randint(0, 30))) for _ in range(200)] + [" ".join(vocab * 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(7, F.rand(1))
    for agg, fn in (("sum", sum), ("mean", lambda x: sum(x) / len(x)), ("min", min), ("max", max)):
        for more in ({}, {"max_bytes": 0, "key": "id"}):
            out = {r.id: r[1:] for r in O.Pipeline((O.Tokenize("text"), O.WordEmbeddings("text", embeddings=emb, aggregation=agg, aggregation_default=-1, **more))).fit(df).training.collect()}
            for i, t in enumerate(texts):
                at = [int(w[1:]) for w in t.split() if w != "zz"]
                two = [x % 7 for x in at if x % 5]
                assert out[i] == pytest.approx((fn(at) if at else -1, fn(two) if two else -1))
    with pytest.raises(ValueError, match="key"):
        O.Pipeline((O.Tokenize("text"), O.WordEmbeddings("text", embeddings=emb, max_bytes=0))).fit(df)


def test_no_shuffle(spark, sam):
    """Counting, weighting and hashing within documents needs no exchange."""
    words = sam.select("id", text.words(F.col("text")).alias("t"))
    for out in (long.counts(words, "id", F.col("t")), long.term_frequency(words, "id", F.col("t"), "term frequency"), long.hashed(words, "id", F.col("t"), 8, True, "md5")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.sampled_from("abcdé")), max_size=9), min_size=1, max_size=4))
def test_runs(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t array<string>").coalesce(1)
    got = df.select(text.runs(F.col("t")), text.bucket_sums(F.col("t"), 3, True, "md5"), text.dense(text.bucket_sums(F.col("t"), 3, True, "md5"), 3)).collect()
    for row, (found, sums, dense) in zip(rows, got, strict=True):
        words = [x for x in row if x is not None]
        assert {r.token: r.n for r in found} == {w: words.count(w) for w in words}
        want: dict = {}
        for w in words:
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:8], 16) % 3] = want.get(int(h[:8], 16) % 3, 0) + (1 if int(h[8:10], 16) % 2 == 0 else -1)
        assert {r.bucket: r.value for r in sums} == want and dense == [want.get(i, 0) for i in range(3)]


def test_save_and_load(spark, sam, tmp_path):
    emb = spark.createDataFrame([("eat", 1.0, 2.0), ("not", 3.0, None)], "token string, d1 double, d2 double")
    tok = O.Tokenize("text")
    pipes = [
        (tok, O.Stopwords("text"), O.TokenFilter("text", max_tokens=5), O.TfIdf("text")), (tok, O.WordEmbeddings("text", embeddings=emb)), (tok, O.WordEmbeddings("text", embeddings=emb, max_bytes=0, key="id")), (tok, O.LDA("text", num_topics=2, max_iter=1)),
        (O.TokenizeSentencePiece("text", vocabulary_size=40),), (O.TokenizeBPE("text", vocabulary_size=40), O.TermFrequency("text", weight_scheme="log normalization", output="vector")), (O.CleanLevels("text"),), (O.TextFeature("text", extract_functions={"n": F.length}),),
    ]
    for i, steps in enumerate(pipes):
        fitted = O.Pipeline(steps).fit(sam)
        fitted.save(spark, f"{tmp_path}/{i}")
        again = O.FittedPipeline.load(spark, f"{tmp_path}/{i}")
        assert sorted(map(str, again.transform(sam).collect())) == sorted(map(str, fitted.transform(sam).collect())) and repr(again.steps) == repr(fitted.steps)
    with pytest.raises(ValueError, match="can't be saved"):
        O.Pipeline((O.TokenFilter("text", filter_fun=lambda t: F.length(t) > 2),)).fit(sam.select(F.split("text", " ").alias("text"))).save(spark, f"{tmp_path}/no")


def test_fit_keeps_rows_once(spark, sam):
    """Two learning steps: the tokens are kept while the fit lasts, not after it."""
    steps = (O.Tokenize("text"), O.TokenFilter("text", max_tokens=5), O.TfIdf("text"))
    kept, plain = O.Pipeline(steps).fit(sam), O.Pipeline(steps).fit(sam, persist=False)
    assert sorted(kept.training.collect()) == sorted(plain.training.collect())
    assert not spark.sparkContext._jsc.getPersistentRDDs().size() or not kept.training.storageLevel.useMemory


def test_bounds_raise(spark, sam, monkeypatch):
    """What the driver must gather is counted first; nothing is cut."""
    from quillspark.operators import base, numeric

    with pytest.raises(ValueError, match="there are over 3"):
        base.distinct_tokens(sam.select(text.words(F.col("text")).alias("t")), "t", 3)
    monkeypatch.setattr(numeric, "MAX_COLUMNS", 3)
    with pytest.raises(ValueError, match="there are over 3"):
        O.Pipeline((O.Tokenize("text"), O.TfIdf("text"))).fit(sam)


def test_large_vocabularies(spark):
    """Beyond the size of literals, tokens are looked up in Arrow batches: the same results."""
    vocab = [f"w{i:04d}" for i in range(400)]
    df = spark.createDataFrame([(["w0003", "zz", None, "w0399"],), ([],), (None,)], "t array<string>").coalesce(1)
    assert [r[0] for r in df.select(text.codes(F.col("t"), vocab, 4)).collect()] == [[4, 0, 0, 400], [0] * 4, [0] * 4]
    fitted = O.Pipeline((O.TokenFilter("t", max_tokens=None),)).fit(spark.createDataFrame([(vocab,)], "t array<string>"))
    assert [r[0] for r in fitted.transform(df).collect()] == [["w0003", "w0399"], [], []]


def test_ptb(spark):
    df = spark.createDataFrame([('"Hello," she said. They\'ll (not) cannot... Isn\'t it?',)], "x string")
    assert df.select(text.ptb(F.col("x"))).first()[0] == ["``", "Hello", ",", "''", "she", "said.", "They", "'ll", "(", "not", ")", "can", "not", "...", "Is", "n't", "it", "?"]
    assert df.select(text.ptb(F.col("x"), lowercase=True)).first()[0][1] == "hello"


def test_stream(spark, sam, tmp_path):
    """A fitted pipeline of row expressions is applied to a stream as it is."""
    emb = spark.createDataFrame([("eat", 1.0)], "token string, d1 double")
    fitted = O.Pipeline((O.Tokenize("text"), O.Stopwords("text"), O.TokenMerge(["text"], prefix="t", keep_original_cols=True), O.TfIdf("text"), O.WordEmbeddings("t", embeddings=emb))).fit(sam)
    sam.write.parquet(f"{tmp_path}/in")
    stream = fitted.transform(spark.readStream.schema(sam.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("features").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start().awaitTermination(60)
    assert sorted(spark.table("features").collect()) == sorted(fitted.transform(sam).collect())


def test_introspection(spark, sam):
    """Ranges for tuning, guesses of sparsity, token lists, tagger engines that are not there."""
    tuned = {s.__name__: set(s.tunable) for s in (O.DummyHash, O.NGram, O.TextHash, O.TermFrequency, O.TokenFilter, O.Tokenize, O.TokenizeBPE)}
    assert tuned == {"DummyHash": {"signed", "num_terms"}, "NGram": {"num_tokens"}, "TextHash": {"signed", "num_terms"}, "TermFrequency": {"weight_scheme", "num_terms"}, "TokenFilter": {"max_times", "min_times", "max_tokens"}, "Tokenize": {"token"}, "TokenizeBPE": {"vocabulary_size"}}
    assert O.TextHash("text", num_terms=8).sparsity(sam) == {"text": (8, 0.875)} and O.TermFrequency("text").sparsity(sam)["text"][0] == 32
    df = spark.createDataFrame([(["a", "b"], ["x", "y"], ["N", "V"])], "t array<string>, l array<string>, p array<string>")
    made = df.select(O.tokenlist(F.col("t"), F.col("l"), F.col("p")).alias("c"))
    assert O.all_tokenized(made) == ["c"] and O.Pipeline((O.PosFilter("c", keep_tags=("V",)), O.Lemma("c"))).fit(made).training.first()[0].tokens == ["y"]
    with pytest.raises(Exception, match="one length"):
        df.select(O.tokenlist(F.col("t"), F.slice("l", 1, 1))).collect()
    assert taggers.conllu("# x\n1-2\tdu\t_\t_\n1\tde\tde\tADP\n2\tle\tle\tDET\n") == (["de", "le"], ["de", "le"], ["ADP", "DET"])
    for engine in ("spacy", "udpipe"):
        with pytest.raises(ImportError, match="not installed"):
            O.Pipeline((O.Tokenize("text", engine=engine),)).fit(sam)


def test_tagged(spark):
    df = spark.createDataFrame([("hello there", 1), ("No", 2), (None, 3)], "text string, id int")
    tag = lambda t: (t.split(), [w.lower() for w in t.split()], ["NOUN" if w[0].isupper() else "INTJ" for w in t.split()])
    first = O.Tokenize("text", engine="tagger", tagger=tag)
    out = O.Pipeline((first, O.PosFilter("text"))).fit(df).training
    assert [r.text.tokens for r in out.orderBy("id").collect()] == [[], ["No"], []]
    out = O.Pipeline((first, O.Lemma("text"), O.Untokenize("text"))).fit(df).training
    assert tokens(out) == ["hello there", "no", ""]
    with pytest.raises(ValueError, match="no lemma"):
        O.Pipeline((O.Tokenize("text"), O.Lemma("text"))).fit(df)


def test_cleaning(spark):
    df = spark.createDataFrame([("A b", 1.0), ("A-b", 2.0), (None, 3.0)], "`Solar.R` string, Wind double")
    out = O.Pipeline((O.CleanNames(lambda d: d.columns), O.CleanLevels("solar_r"))).fit(df)
    assert out.training.columns == ["solar_r", "wind"]
    assert {r[0] for r in out.training.collect()} == {"a_b", "a_b_2", None}
    new = spark.createDataFrame([("zzz", 1.0)], "`Solar.R` string, Wind double")
    assert out.transform(new).first()[0] is None
    assert O.Pipeline((O.TextNormalization("x"),)).fit(spark.createDataFrame([("schön",)], "x string")).training.first()[0] == "schön"


def test_merge_skip_and_errors(spark, sam):
    out = O.Pipeline((O.Tokenize("text"), O.TokenMerge(["text", "text"], prefix="both"))).fit(sam).training
    assert [len(t) for t in tokens(out, "both")] == [16, 12, 16, 16]
    fitted = O.Pipeline((O.Tokenize("text"), O.Untokenize("text", skip=True))).fit(sam)
    assert fitted.transform(sam).schema["text"].dataType.simpleString() == "array<string>"
    for step, error in ((O.Tokenize("text", token="nope"), ValueError), (O.Tokenize("id"), TypeError), (O.Tokenize("nope"), ValueError), (O.Stem("text"), TypeError)):
        with pytest.raises(error):
            O.Pipeline((step,)).fit(sam)
    bad = sam.withColumn("tf_text_i", F.lit(1))
    with pytest.raises(ValueError, match="collision"):
        O.Pipeline((O.Tokenize("text"), O.TermFrequency("text"))).fit(bad)
    assert fitted.steps[0].describe(spark).first()[:2] == ("text", "words")


def test_empty_selection_changes_nothing(sam):
    assert O.Pipeline((O.Tokenize([]), O.TermFrequency(O.all_tokenized))).fit(sam).training.columns == ["id", "text"]


def test_entry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_wordpiece_in_bounded_parts(spark):
    """A batch of large texts is given back in parts, with the pieces of the whole."""
    vocab = ("[UNK]", "the", "##ing", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), ".")
    texts = [None, "", " ", "Thé sing-ing.", "x" * 101 + " the 日本", *(f"the walking {chr(97 + i % 26)} été. " * (20_000 if i == 7 else 4000) for i in range(40)), "thething"]
    want = [subword.wordpiece(t, frozenset(vocab)) for t in texts]
    assert want[3] == ["the", "s", "##ing", "[UNK]", "i", "##n", "##g", "."] and want[4] == ["[UNK]", "the", "[UNK]"]
    split = lambda t: subword.wordpiece_text(t, cased=False)
    made = list(arrow.word_pieces(iter([pa.array(texts, pa.string())]), split, lambda x: [subword.wordpiece_word(w, frozenset(vocab), 5, "[UNK]", 100) for w in x]))
    assert len(made) >= 4 and [x for a in made for x in a.to_pylist()] == want
    assert max(len(a.flatten()) for a in made) <= arrow.TEXT_BYTES
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    assert tokens(O.Pipeline((O.TokenizeWordPiece("text", vocab=vocab),)).fit(df).training) == want


def test_bpe_of_more_words_than_the_driver_holds(spark, monkeypatch):
    """Words that stay on the executors give the merges of one process; no number of words is too large."""
    from quillspark.operators import tokens as module

    rng = random.Random(8)
    texts = [None, "", *(" ".join("".join(rng.choices("aabcé", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    counts: dict = {}
    for w in " ".join(filter(None, texts)).split():
        counts["▁" + w] = counts.get("▁" + w, 0) + 1
    merges = subword.train_bpe(counts, 60)
    monkeypatch.setattr(module, "MAX_VOCABULARY", 10)
    monkeypatch.setattr(module, "LOCAL_CHARS", 0, raising=False)
    fitted = O.Pipeline((O.TokenizeBPE("text", vocabulary_size=60),)).fit(df)
    assert len(merges) > 50 and [tuple(m) for m in fitted.steps[0].learnt["merges"]["text"]] == merges
    rank = {m: i for i, m in enumerate(merges)}
    assert tokens(fitted.training) == [[p for w in (t or "").split() for p in subword.bpe_word(w, rank)] for t in texts]
    with pytest.raises(ValueError, match="5 characters"):
        O.Pipeline((O.TokenizeBPE("text", vocabulary_size=4),)).fit(df)


def test_bpe_words_together():
    """Many words at once have the pieces of each by itself, where a symbol is made in two ways too."""
    rng = random.Random(4)
    for k in range(40):
        parts = [*"abcd", "ab", "bc", "cd", "abc", "bcd"]
        pairs = {(a, b) for a in parts for b in parts if len(a + b) < 6}
        rank = {p: i for i, p in enumerate(rng.sample(sorted(pairs), rng.randint(1, 40)))}
        words = ["".join(rng.choices("abcdé", k=rng.randint(1, 12))) for _ in range(200)]
        assert subword.bpe_words(words, rank, subword.bpe_plan(rank)) == [subword.bpe_word(w, rank) for w in words]


def test_sentencepiece_of_more_words_than_the_driver_holds(spark, monkeypatch):
    from quillspark.operators import tokens as module

    rng = random.Random(8)
    texts = [None, *(" ".join("".join(rng.choices("aabcé", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    step = O.TokenizeSentencePiece("text", vocabulary_size=40)
    want = tokens(O.Pipeline((step,)).fit(df).training)
    monkeypatch.setattr(module, "MAX_VOCABULARY", 10)
    monkeypatch.setattr(module, "LOCAL_CHARS", 0)
    assert tokens(O.Pipeline((step,)).fit(df).training) == want and any(want)
