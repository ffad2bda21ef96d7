"""The registered queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..functions import counts as C
from ..functions import text as X
from ..functions.stopwords import ENGLISH
from . import long

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W = X.WORD.replace("'", "''")
TOK = f"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM documents)"
TOKS = f"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS t FROM documents)"


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def worded(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.words(F.col("text")).alias("t"))


def joined(df: DataFrame, t) -> DataFrame:
    return df.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


def listed(ctes: str, expr: str) -> str:
    return f"WITH {ctes} SELECT doc_id, CAST(len({expr}) AS BIGINT) AS n_tokens, array_to_string({expr}, '|') AS tokens FROM toks"


def valued(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "token", F.round("value", 6).alias("value"))


# Tokenisation
@query(listed(TOKS, "t"))
def tokenize_words(spark, d):
    return joined(O.Pipeline((O.Tokenize("text"),)).fit(docs(spark, d)).training, F.col("text"))


def _kind(name, sql, token, **options):
    @query(f"WITH toks AS (SELECT doc_id, {sql} AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens FROM toks" if sql else None, name)
    def run(spark, d):
        return joined(O.Tokenize("text", token=token, options=options).fit(docs(spark, d), O.base.State())[0].transform(docs(spark, d)), F.col("text"))


_kind("tokenize_characters", r"regexp_extract_all(lower(text), '[\p{L}\p{N}]\p{M}*')", "characters")
_kind("tokenize_lines", "list_filter(string_split(text, chr(10)), lambda x: x <> '')", "lines")
_kind("tokenize_paragraphs", "list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: replace(x, chr(10), ' ')), lambda x: x <> '')", "paragraphs")
_kind("tokenize_regex", r"list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')", "regex", pattern=r"[ \n]+")
SENTENCES = """string_split(regexp_replace(regexp_replace(text, '[\\n\\r]', ' ', 'g'), '([.!?]+[''"\\)]*) +', '\\1' || chr(10), 'g'), chr(10))"""
_kind("tokenize_sentences", f"list_filter(list_transform({SENTENCES}, lambda x: trim(x, ' ')), lambda x: x <> '')", "sentences")


def _ptb_sql() -> str:
    x = "' ' || text || ' '"
    for pattern, to in X.PTB:
        to = to.replace("$", "\\").replace("'", "''")
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda x: x <> '')"


_kind("tokenize_ptb", _ptb_sql(), "ptb")
CHARS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]\p{M}*')"
_kind("tokenize_character_shingle", "c", "character_shingle", n=3)
ORACLES["tokenize_character_shingle"] = (
    f"WITH c AS (SELECT doc_id, {CHARS} AS c FROM documents), s AS (SELECT doc_id, i, c[i] || c[i + 1] || c[i + 2] AS x FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM c)), "
    "t AS (SELECT doc_id, count(*) AS n, string_agg(x, '|' ORDER BY i) AS x FROM s GROUP BY doc_id) SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, coalesce(x, '') AS tokens FROM documents LEFT JOIN t ON documents.doc_id = t.doc_id"
)
_kind("tokenize_word_stems", None, "word_stems")


def _ngram_sql(lo: int, hi: int, delim: str) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, array_to_string(t[i:i+{k - 1}], '{delim}') AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) - {k} + 2)) AS i FROM toks WHERE len(t) >= {k})" for k in range(lo, hi + 1))
    return f"WITH {TOKS}, g AS ({parts}) SELECT doc_id, token, count(*) AS n FROM g GROUP BY doc_id, token"


def _ngram(name, lo, hi):
    @query(_ngram_sql(lo, hi, "_"), name)
    def run(spark, d):
        out = O.Pipeline((O.Tokenize("text"), O.NGram("text", num_tokens=hi, min_num_tokens=lo))).fit(docs(spark, d)).training
        return long.counts(out, "doc_id", F.col("text"))


_ngram("ngram_2", 2, 2)
_ngram("ngram_1_3", 1, 3)


@query(_ngram_sql(3, 3, " "))
def tokenize_ngrams(spark, d):
    return long.counts(docs(spark, d), "doc_id", X.word_ngrams(F.col("text"), 3))


SKIPS = "SELECT doc_id, unnest(t) AS token FROM toks" + "".join(f" UNION ALL SELECT doc_id, t[i] || ' ' || t[i + {k}] FROM (SELECT doc_id, t, unnest(range(1, len(t) - {k} + 1)) AS i FROM toks WHERE len(t) > {k})" for k in (1, 2))


@query(f"WITH {TOKS} SELECT DISTINCT doc_id, token, CAST(1 AS BIGINT) AS n FROM ({SKIPS})")
def tokenize_skip_ngrams(spark, d):
    return long.counts(docs(spark, d), "doc_id", X.skip_ngrams(F.col("text"), 2, 1, 1))


# Token filters
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)


@query(f"WITH {TOK} SELECT doc_id, token, count(*) AS n FROM tok WHERE token NOT IN ({STOP}) GROUP BY doc_id, token")
def stopwords(spark, d):
    out = O.Pipeline((O.Tokenize("text"), O.Stopwords("text"))).fit(docs(spark, d)).training
    return long.counts(out, "doc_id", F.col("text"))


@query(f"WITH {TOK} SELECT doc_id, token, count(*) AS n FROM tok WHERE token IN ({STOP}) GROUP BY doc_id, token")
def stopwords_keep(spark, d):
    out = O.Pipeline((O.Tokenize("text"), O.Stopwords("text", keep=True))).fit(docs(spark, d)).training
    return long.counts(out, "doc_id", F.col("text"))


def _filter(name, keep_sql, **options):
    @query(f"WITH {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token), k AS ({keep_sql}) SELECT doc_id, token, count(*) AS n FROM tok WHERE token IN (SELECT token FROM k) GROUP BY doc_id, token", name)
    def run(spark, d):
        step = O.TokenFilter("text", **options)
        if step.max_tokens is not None:
            out = O.Pipeline((O.Tokenize("text"), step)).fit(docs(spark, d)).training
            return long.counts(out, "doc_id", F.col("text"))
        # a vocabulary without a bound stays a table
        kept = long.checked(step.counted(long.tokens(worded(spark, d), "doc_id", F.col("t")).select("token")).select("token"))
        return long.counts(worded(spark, d), "doc_id", F.col("t")).join(kept, "token").select("doc_id", "token", "n")


_filter("tokenfilter_topk", "SELECT token FROM c ORDER BY n DESC, token LIMIT 100")
_filter("tokenfilter_min_max", "SELECT token FROM c WHERE n BETWEEN 5 AND 500", min_times=5, max_times=500, max_tokens=None)
_filter("tokenfilter_percentage", "SELECT token FROM c WHERE n / (SELECT sum(n) FROM c) <= 0.01 AND n / (SELECT sum(n) FROM c) >= 0.0001", percentage=True, max_times=0.01, min_times=0.0001, max_tokens=None)


# Frequencies
N = f"{TOK}, n AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY doc_id, token)"


def _tf(name, scheme, sql):
    @query(f"WITH {N} {sql}", name)
    def run(spark, d):
        out = long.term_frequency(worded(spark, d), "doc_id", F.col("t"), scheme)
        return out if scheme in ("raw count", "binary") else valued(out)


_tf("tf_raw", "raw count", "SELECT doc_id, token, n AS value FROM n")
_tf("tf_binary", "binary", "SELECT doc_id, token, CAST(1 AS BIGINT) AS value FROM n")
_tf("tf_freq", "term frequency", "SELECT doc_id, token, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS value FROM n")
_tf("tf_log", "log normalization", "SELECT doc_id, token, round(ln(1 + n), 6) AS value FROM n")
_tf("tf_double", "double normalization", "SELECT doc_id, token, round(0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id), 6) AS value FROM n")

IDF = f"{N}, idf AS (SELECT token, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM n GROUP BY token)"


def _tfidf(name, tf_sql, **options):
    @query(f"WITH {IDF}, tf AS (SELECT doc_id, token, {tf_sql} AS tf FROM n) SELECT doc_id, tf.token, round(tf * idf, 6) AS value FROM tf JOIN idf ON tf.token = idf.token", name)
    def run(spark, d):
        return valued(long.tf_idf(worded(spark, d), "doc_id", F.col("t"), **options))


_tfidf("tfidf_l1", "n / sum(n) OVER (PARTITION BY doc_id)")
_tfidf("tfidf_l2", "n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))", norm="l2")
_tfidf("tfidf_none", "CAST(n AS DOUBLE)", norm="none")
_tfidf("tfidf_sublinear", "1 + ln(n / sum(n) OVER (PARTITION BY doc_id))", sublinear=True)


# The steps' own wide and vector output, of a given vocabulary
WIDE_VOCAB = ["the", "of", "and", "der", "la", "que"]
WIDE = f"{TOKS}, c AS (SELECT doc_id, " + ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{v}')) AS DOUBLE) AS c{i}" for i, v in enumerate(WIDE_VOCAB)) + " FROM toks)"
WIDE_SUM = " + ".join(f"c{i}" for i in range(len(WIDE_VOCAB)))
WIDE_SQUARES = " + ".join(f"c{i} * c{i}" for i in range(len(WIDE_VOCAB)))
WIDE_MAX = "greatest(" + ", ".join(f"c{i}" for i in range(len(WIDE_VOCAB))) + ")"


def _wide(name, step, value, kind="DOUBLE"):
    """value: SQL of a column, with {c} for a token's count and {i} for its number."""
    cols = ", ".join(f"round({value.format(c=f'c{i}', i=i)}, 6) AS v{i}" if kind == "DOUBLE" else f"CAST({value.format(c=f'c{i}', i=i)} AS {kind}) AS v{i}" for i in range(len(WIDE_VOCAB)))
    idf = ", idf AS (SELECT " + ", ".join(f"ln(1 + count(*) / sum(CAST(c{i} > 0 AS INTEGER))) AS idf{i}" for i in range(len(WIDE_VOCAB))) + " FROM c)"

    @query(f"WITH {WIDE}{idf if 'idf' in value else ''} SELECT doc_id, {cols} FROM c{', idf' if 'idf' in value else ''}", name)
    def run(spark, d):
        out = O.Pipeline((O.Tokenize("text"), step)).fit(docs(spark, d)).training
        prefix = f"{step.prefix}_text"
        values = [F.get(vector_to_array(F.col(prefix)), i) if step.output == "vector" else F.col(f"{prefix}_{v}") for i, v in enumerate(WIDE_VOCAB)]
        return out.select("doc_id", *[(F.round(v, 6) if kind == "DOUBLE" else v).alias(f"v{i}") for i, v in enumerate(values)])


_given = {"vocabulary": tuple(WIDE_VOCAB)}
_wide("tf_wide_raw", O.TermFrequency("text", **_given), "{c}", "INTEGER")
_wide("tf_wide_binary", O.TermFrequency("text", weight_scheme="binary", **_given), "{c} > 0", "INTEGER")
_wide("tf_wide_freq", O.TermFrequency("text", weight_scheme="term frequency", **_given), f"CASE WHEN {WIDE_SUM} = 0 THEN 0 ELSE {{c}} / ({WIDE_SUM}) END")
_wide("tf_wide_log", O.TermFrequency("text", weight_scheme="log normalization", **_given), "ln(1 + {c})")
_wide("tf_wide_double", O.TermFrequency("text", weight_scheme="double normalization", **_given), f"CASE WHEN {WIDE_MAX} = 0 THEN CAST('NaN' AS DOUBLE) ELSE 0.5 + 0.5 * {{c}} / {WIDE_MAX} END")
_wide("tf_vector_log", O.TermFrequency("text", weight_scheme="log normalization", output="vector", **_given), "ln(1 + {c})")
_wide("tfidf_wide_l1", O.TfIdf("text", **_given), f"CASE WHEN {WIDE_SUM} = 0 THEN 0 ELSE {{c}} / ({WIDE_SUM}) * idf{{i}} END")
_wide("tfidf_wide_l2", O.TfIdf("text", norm="l2", **_given), f"CASE WHEN {WIDE_SQUARES} = 0 THEN 0 ELSE {{c}} / sqrt({WIDE_SQUARES}) * idf{{i}} END")
_wide("tfidf_vector_none", O.TfIdf("text", norm="none", output="vector", **_given), "{c} * idf{i}")
_wide("tfidf_wide_sublinear", O.TfIdf("text", sublinear_tf=True, **_given), f"CASE WHEN {{c}} = 0 THEN 0 ELSE (1 + ln({{c}} / ({WIDE_SUM}))) * idf{{i}} END")


# Hashing
MD5 = "CAST(concat('0x', substr(md5(token), 1, 8)) AS BIGINT)"
SIGN = "CASE WHEN CAST(concat('0x', substr(md5(token), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END"


@query(f"WITH {TOK} SELECT doc_id, CAST({MD5} % 1024 AS INTEGER) AS bucket, CAST(sum({SIGN}) AS BIGINT) AS value FROM tok GROUP BY 1, 2")
def texthash_md5(spark, d):
    return long.hashed(worded(spark, d), "doc_id", F.col("t"), 1024, True, "md5")


@query(f"WITH {TOK} SELECT doc_id, CAST({MD5} % 1024 AS INTEGER) AS bucket, count(*) AS value FROM tok GROUP BY 1, 2")
def texthash_md5_unsigned(spark, d):
    return long.hashed(worded(spark, d), "doc_id", F.col("t"), 1024, False, "md5")


@query(ORACLES["texthash_md5"])
def texthash_map(spark, d):
    """The step's sparse output."""
    out = O.Pipeline((O.Tokenize("text"), O.TextHash("text", scheme="md5", output="map"))).fit(docs(spark, d)).training
    return out.select("doc_id", F.explode("texthash_text").alias("bucket", "value")).withColumn("value", F.col("value").cast("long"))


def _texthash_wide(name, output):
    sums = ", ".join(f"CAST(coalesce(sum({SIGN}) FILTER ({MD5} % 16 = {i}), 0) AS INTEGER) AS h{i}" for i in range(16))

    @query(f"WITH {TOK}, h AS (SELECT doc_id, {sums} FROM tok GROUP BY doc_id) SELECT documents.doc_id, {', '.join(f'coalesce(h{i}, 0) AS h{i}' for i in range(16))} FROM documents LEFT JOIN h ON documents.doc_id = h.doc_id", name)
    def run(spark, d):
        out = O.Pipeline((O.Tokenize("text"), O.TextHash("text", num_terms=16, scheme="md5", output=output))).fit(docs(spark, d)).training
        value = lambda i: F.col(f"texthash_text_{i + 1:02d}") if output == "wide" else F.get(vector_to_array("texthash_text"), i).cast("int")
        return out.select("doc_id", *[value(i).alias(f"h{i}") for i in range(16)])


_texthash_wide("texthash_wide", "wide")
_texthash_wide("texthash_vector", "vector")


@query()
def texthash_murmur(spark, d):
    return O.Pipeline((O.Tokenize("text"), O.TextHash("text", num_terms=64))).fit(docs(spark, d)).training


PART = "SELECT p_partkey AS doc_id, unnest(list_filter(string_split({0}, ' '), lambda x: x <> '')) AS token FROM part"


@query(f"WITH tok AS ({PART.format('p_type')}) SELECT doc_id, CAST({MD5} % 32 AS INTEGER) AS bucket, CAST(sum({SIGN}) AS BIGINT) AS value FROM tok GROUP BY 1, 2")
def dummy_hash_md5(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("doc_id"), "p_type")
    return long.hashed(part, "doc_id", X.regex(F.col("p_type"), " "), 32, True, "md5")


@query(f"WITH tok AS ({PART.format('p_brand || p_type')}) SELECT doc_id, CAST({MD5} % 32 AS INTEGER) AS bucket, CAST(sum({SIGN}) AS BIGINT) AS value FROM tok GROUP BY 1, 2")
def dummy_hash_collapse(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", "p_type")
    out = O.DummyHash(["p_brand", "p_type"], num_terms=32, collapse=True, scheme="md5").fit(part, O.base.State())[0].transform(part)
    values = [c for c in out.columns if c.startswith("dummyhash_")]
    wide = out.select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(*values)).alias("bucket", "value"))
    return wide.where("value <> 0").select("doc_id", "bucket", F.col("value").cast("long").alias("value"))


# a bucket whose signs cancel is zero, which the wide form can't tell from an empty one
ORACLES["dummy_hash_collapse"] = f"SELECT * FROM ({ORACLES['dummy_hash_collapse']}) WHERE value <> 0"


# Text features
COUNT_SQL = {
    "n_words": f"len(regexp_extract_all(text, '{W}'))",
    "n_uq_words": f"len(list_distinct(regexp_extract_all(text, '{W}')))",
    "n_charS": r"length(regexp_replace(text, '[\t\n\f\r\p{Z}]', '', 'g'))",
    "n_digits": r"len(regexp_extract_all(text, '\p{Nd}'))",
    "n_commas": "len(regexp_extract_all(text, ','))",
    "n_periods": r"len(regexp_extract_all(text, '\.'))",
    "n_exclaims": "len(regexp_extract_all(text, '!'))",
    "n_extraspaces": r"len(regexp_extract_all(text, '[\t\n\f\r\p{Z}]{2}|\t|\n'))",
    "n_mentions": r"len(regexp_extract_all(text, '@[^\t\n\f\r\p{Z}]+'))",
    "n_urls": "len(regexp_extract_all(text, 'https?'))",
    "n_uq_urls": "len(list_distinct(regexp_extract_all(text, 'https?')))",
    "n_nonasciis": r"octet_length(encode(regexp_replace(text, '[\x00-\x7F]', '', 'g')))",
    "n_puncts": r"len(regexp_extract_all(regexp_replace(text, '[!.,]', '', 'g'), '\p{P}'))",
}


@query("SELECT doc_id, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in COUNT_SQL.items()) + " FROM documents")
def textfeature_counts(spark, d):
    step = O.TextFeature("text", extract_functions={k: C.COUNT_FUNCTIONS[k] for k in COUNT_SQL})
    out = step.fit(docs(spark, d), O.base.State())[0].transform(docs(spark, d))
    return out.select("doc_id", *[F.col(f"textfeature_text_{k}").cast("long").alias(k) for k in COUNT_SQL])


GROUPS = {"first_person": C.FIRST_PERSON, "first_personp": C.FIRST_PERSON_PLURAL, "second_person": C.SECOND_PERSON, "second_personp": C.SECOND_PERSON_PLURAL, "third_person": C.THIRD_PERSON, "to_be": C.TO_BE, "prepositions": C.PREPOSITIONS}
quoted = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
TAG = r"#[\p{L}\p{Nl}\p{M}\p{Nd}_]+"
MENTION = r"@[^\t\n\f\r\p{Z}]+"
ALL_SQL = COUNT_SQL | {
    "n_uq_charS": r"len(list_distinct(list_filter(string_split(regexp_replace(text, '[\t\n\f\r\p{Z}]', '', 'g'), ''), lambda x: x <> '')))",
    "n_hashtags": f"len(regexp_extract_all(text, '{TAG}'))",
    "n_uq_hashtags": f"len(list_distinct(regexp_extract_all(text, '{TAG}')))",
    "n_uq_mentions": f"len(list_distinct(regexp_extract_all(text, '{MENTION}')))",
    "n_caps": r"len(regexp_extract_all(text, '\p{Lu}'))",
    "n_lowers": r"len(regexp_extract_all(text, '[\p{Ll}ªº]'))",
    **{k: f"len(list_filter({quoted(v)}, lambda x: x = text))" for k, v in GROUPS.items()},
}


@query("SELECT doc_id, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in ALL_SQL.items()) + " FROM documents")
def textfeature_all(spark, d):
    out = O.Pipeline((O.TextFeature("text"),)).fit(docs(spark, d)).training
    return out.select("doc_id", *[F.col(f"textfeature_text_{k}").cast("long").alias(k) for k in C.COUNT_FUNCTIONS])


@query(f"WITH {TOKS} SELECT doc_id, " + ", ".join(f"CAST(len(list_filter(t, lambda x: list_contains({quoted(v)}, x))) AS BIGINT) AS {k}_tokens" for k, v in GROUPS.items()) + " FROM toks")
def word_groups(spark, d):
    """The counters of word groups over tokens instead of the whole text."""
    return worded(spark, d).select("doc_id", *[c.cast("long").alias(k) for k, c in C.token_counts(F.col("t")).items()])


# Sequences
SEQ_VOCAB = ["the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "le", "la", "de", "el", "que"]


@query(
    f"WITH {TOKS}, c AS (SELECT doc_id, list_transform(CASE WHEN len(t) > 20 THEN t[len(t)-19:len(t)] ELSE t END, lambda x: coalesce(list_position([{', '.join(repr(v) for v in SEQ_VOCAB)}], x), 0)) AS c FROM toks), "
    "p AS (SELECT doc_id, list_concat(list_transform(range(0, 20 - len(c)), lambda x: 0), c) AS c FROM c) SELECT doc_id, array_to_string(c, ',') AS codes FROM p"
)
def sequence_codes(spark, d):
    made = O.Pipeline((O.Tokenize("text"), O.SequenceOneHot("text", sequence_length=20, vocabulary=tuple(SEQ_VOCAB)))).fit(docs(spark, d)).training
    return made.select("doc_id", F.array_join(F.array(*[F.col(f"seq1hot_text_{i + 1}").cast("string") for i in range(20)]), ",").alias("codes"))


@query(f"WITH {TOKS} SELECT doc_id, array_to_string(t, '-') AS text FROM toks")
def untokenize(spark, d):
    return O.Pipeline((O.Tokenize("text"), O.Untokenize("text", sep="-"))).fit(docs(spark, d)).training


@query("SELECT p_partkey, array_to_string(list_concat(list_filter(string_split(p_name, ' '), lambda x: x <> ''), list_filter(string_split(p_type, ' '), lambda x: x <> '')), '|') AS merged FROM part")
def tokenmerge(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type")
    out = O.Pipeline((O.Tokenize(["p_name", "p_type"], token="regex", options={"pattern": " "}), O.TokenMerge(["p_name", "p_type"], prefix="merged"))).fit(part).training
    return out.select("p_partkey", F.array_join("merged", "|").alias("merged"))


@query(
    f"WITH {TOKS}, v AS (SELECT list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '{W}'))))) AS v FROM benchmark), "
    "c AS (SELECT doc_id, list_transform(t[1:12], lambda x: coalesce(list_position(v, x), 0)) AS c FROM toks, v) SELECT doc_id, array_to_string(list_concat(c, list_transform(range(0, 12 - len(c)), lambda x: 0)), ',') AS codes FROM c"
)
def sequence_codes_learnt(spark, d):
    """The codes of a vocabulary that is learnt from one table, the benchmark, and applied to another."""
    step = O.SequenceOneHot("text", sequence_length=12, padding="post", truncating="post")
    made = O.Pipeline((O.Tokenize("text"), step)).fit(spark.read.parquet(f"{d}/benchmark.parquet").select("text")).transform(docs(spark, d))
    return made.select("doc_id", F.array_join(F.array(*[F.col(f"seq1hot_text_{i + 1}").cast("string") for i in range(12)]), ",").alias("codes"))


# Embeddings: a vector for every word of the documents, of its digest's first 8 hex digits
DIMS = range(1, 9)
EMB_SQL = "emb AS (SELECT DISTINCT token, " + ", ".join(f"CAST(concat('0x', substr(md5(token), {k}, 1)) AS INTEGER) / 8.0::DOUBLE - 1 AS d{k}" for k in DIMS) + " FROM tok)"


def word_vectors(spark, d) -> DataFrame:
    words = worded(spark, d).select(F.explode(F.array_distinct("t")).alias("token")).distinct()
    return words.select("token", *[(F.conv(F.substring(F.md5("token"), k, 1), 16, 10).cast("double") / 8 - 1).alias(f"d{k}") for k in DIMS])


def _embedding(name, agg, fn, **options):
    dims = ", ".join(f"round(coalesce({fn}(d{k}), 0), 6) AS d{k}" for k in DIMS)

    @query(f"WITH {TOK}, {EMB_SQL}, m AS (SELECT doc_id, emb.* FROM tok JOIN emb ON tok.token = emb.token) SELECT documents.doc_id, {dims} FROM documents LEFT JOIN m ON documents.doc_id = m.doc_id GROUP BY documents.doc_id", name)
    def run(spark, d):
        step = O.WordEmbeddings("text", embeddings=word_vectors(spark, d), aggregation=agg, **options)
        out = O.Pipeline((O.Tokenize("text"), step)).fit(docs(spark, d)).training
        return out.select("doc_id", *[F.round(f"wordembed_text_d{k}", 6).alias(f"d{k}") for k in DIMS])


for _agg, _fn in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
    _embedding(f"word_embeddings_{_agg}", _agg, _fn)
_embedding("word_embeddings_joined", "mean", "avg", max_bytes=0, key="doc_id")


# Cleaning and normalising
@query("SELECT o_orderkey, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '^([0-9])', 'x\\1') AS o_orderpriority FROM orders")
def clean_levels(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return O.Pipeline((O.CleanLevels("o_orderpriority"),)).fit(orders).training


@query("SELECT c_custkey AS customer_key, c_mktsegment AS market_segment FROM customer")
def clean_names(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("Customer.Key"), F.col("c_mktsegment").alias("MarketSegment"))
    return O.Pipeline((O.CleanNames(lambda df: df.columns),)).fit(c).training


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def text_normalization_nfc(spark, d):
    return O.Pipeline((O.TextNormalization("text"),)).fit(docs(spark, d)).training


# Without SQL twins: Python rules and iterative fits
@query()
def stem(spark, d):
    return joined(O.Pipeline((O.Tokenize("text"), O.Stem("text"))).fit(docs(spark, d)).training, F.col("text"))


@query()
def tokenize_bpe(spark, d):
    return joined(O.Pipeline((O.TokenizeBPE("text"),)).fit(docs(spark, d)).training, F.col("text"))


WORDPIECES = ("[UNK]", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), "the", "##ing", "##tion", "##er", "of", "and", ".", ",")


@query()
def tokenize_wordpiece(spark, d):
    return joined(O.Pipeline((O.TokenizeWordPiece("text", vocab=WORDPIECES),)).fit(docs(spark, d)).training, F.col("text"))


@query()
def tokenize_sentencepiece(spark, d):
    return joined(O.Pipeline((O.TokenizeSentencePiece("text"),)).fit(docs(spark, d)).training, F.col("text"))


def simple_tagger(text: str) -> tuple[list[str], list[str], list[str]]:
    """A stand-in for a real tagger: capitals are nouns, -ing and -ed verbs; the lemma lacks the ending."""
    tokens = text.split()
    low = [t.lower().strip(".,!?") for t in tokens]
    pos = ["VERB" if t.endswith(("ing", "ed")) else "NOUN" if s[:1].isupper() else "X" for s, t in zip(tokens, low, strict=True)]
    lemma = [t.removesuffix("ing").removesuffix("ed") if p == "VERB" else t for t, p in zip(low, pos, strict=True)]
    return low, lemma, pos


TAGGED = r"""toks AS (
  SELECT doc_id, list_transform(s, lambda x: trim(lower(x), '.,!?')) AS low,
    list_transform(s, lambda x: CASE WHEN regexp_matches(trim(lower(x), '.,!?'), '(ing|ed)$') THEN 'VERB' WHEN regexp_matches(x, '^\p{Lu}') THEN 'NOUN' ELSE 'X' END) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+') AS s FROM documents)
)"""
CUT = "CASE WHEN pos[i] <> 'VERB' THEN low[i] WHEN suffix(regexp_replace(low[i], 'ing$', ''), 'ed') THEN regexp_replace(regexp_replace(low[i], 'ing$', ''), 'ed$', '') ELSE regexp_replace(low[i], 'ing$', '') END"


@query(f"WITH {TAGGED}, l AS (SELECT doc_id, list_transform(range(1, len(low) + 1), lambda i: {CUT}) AS t FROM toks) SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens FROM l")
def lemma(spark, d):
    return joined(O.Pipeline((O.Tokenize("text", engine="tagger", tagger=simple_tagger), O.Lemma("text"))).fit(docs(spark, d)).training, F.col("text.tokens"))


@query(f"WITH {TAGGED}, l AS (SELECT doc_id, list_transform(list_filter(range(1, len(low) + 1), lambda i: pos[i] = 'NOUN'), lambda i: low[i]) AS t FROM toks) SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens FROM l")
def pos_filter(spark, d):
    return joined(O.Pipeline((O.Tokenize("text", engine="tagger", tagger=simple_tagger), O.PosFilter("text", keep_tags=("NOUN",)))).fit(docs(spark, d)).training, F.col("text.tokens"))


@query()
def lda(spark, d):
    out = O.Pipeline((O.Tokenize("text"), O.Stopwords("text"), O.LDA("text", num_topics=4))).fit(docs(spark, d)).training
    return out.select("doc_id", *[F.round(f"lda_text_{i}", 4).alias(f"topic_{i}") for i in range(1, 5)])
