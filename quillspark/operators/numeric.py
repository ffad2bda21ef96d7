"""Steps from tokens, or from text, to numbers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA as SparkLDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow, text
from ..functions.counts import COUNT_FUNCTIONS
from .base import MAX_COLUMNS, MAX_VOCABULARY, State, Step, check_names, col, distinct_tokens, free, gathered, selected, tokens_of, vocabulary_of

SCHEMES = ("binary", "raw count", "term frequency", "log normalization", "double normalization")


def padded(i: int, n: int) -> str:
    return str(i).zfill(len(str(n)))


def count_vector(df: DataFrame, tokens: Column, vocab: list[str], out: str) -> DataFrame:
    """Counts of the vocabulary's tokens as a sparse vector, in one pass over a row's tokens. ``out`` must be a free name."""
    if not vocab:
        return df.withColumn(out, F.array().cast("array<double>"))
    name = free("_tokens", [*df.columns, out])
    made = df.withColumn(name, F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull()))
    model = CountVectorizerModel.from_vocabulary(vocab, inputCol=name, outputCol=out)
    return model.transform(made).drop(name)


def spread(made: DataFrame, df: DataFrame, new: dict[str, Column], gone: list[str], keep: bool) -> DataFrame:
    """The columns of df that stay, and the new ones, which are expressions over ``made``."""
    check_names(df, list(new), [] if keep else gone)
    return made.select(*[col(c) for c in df.columns if keep or c not in gone], *[c.alias(n) for n, c in new.items()])


def with_columns(df: DataFrame, new: dict[str, Column], gone: list[str], keep: bool) -> DataFrame:
    return spread(df, df, new, gone, keep)


def _divided(x: Column, by: Callable[[Column], Column]) -> Column:
    """The array over by(array), which is computed once; 0 where that is 0."""
    return text.bind(x, lambda x: text.bind(by(x), lambda b: F.transform(x, lambda v: F.when(b == 0, 0.0).otherwise(v / F.when(b == 0, 1.0).otherwise(b)))))


def _levels(df: DataFrame, names: list[str]) -> dict[str, tuple[int, float]]:
    """The mean length of the first ten values stands for the number of columns."""
    out = {}
    for n in names:
        sizes = [len(r[0]) for r in df.select(col(n)).limit(10).collect() if r[0] is not None]
        level = max(1, sum(sizes) // max(1, len(sizes)))
        out[n] = level, 1 - 1 / level
    return out


class _Counted(Step):
    """Steps over counts of a vocabulary."""

    learns = True

    def learn(self, df: DataFrame, names: list[str], state: State):
        vocab = {n: list(self.vocabulary) if self.vocabulary is not None else vocabulary_of(df, n, state) for n in names}
        return {"vocab": vocab}, state.without(names)

    def apply(self, df, names, learnt):
        for n in names:
            vocab = learnt["vocab"][n]
            counts, values = free("_counts", df.columns), free("_values", df.columns)
            counted = count_vector(df, tokens_of(df, n), vocab, counts)
            array = vector_to_array(counts) if vocab else F.col(counts)
            if self.output == "vector":
                new = {f"{self.prefix}_{n}": array_to_vector(self.values(array, learnt, n).cast("array<double>"))}
            else:
                counted = counted.withColumn(values, self.values(array, learnt, n))
                new = {f"{self.prefix}_{n}_{t}": F.get(values, i) for i, t in enumerate(vocab)}
            df = spread(counted, df, new, [n], self.keep_original_cols)
        return df

    def sparsity(self, df):
        return _levels(df, selected(df, self.columns))


@dataclass(frozen=True)
class TermFrequency(_Counted):
    """A column for each token of the sorted vocabulary (output="wide"), or one ML vector."""

    weight_scheme: str = "raw count"
    weight: float = 0.5
    vocabulary: tuple[str, ...] | None = None
    prefix: str = "tf"
    output: str = "wide"
    keep_original_cols: bool = False
    title = "Term frequency"
    tunable = {"weight_scheme": SCHEMES, "num_terms": None}

    def learn(self, df, names, state):
        if self.weight_scheme not in SCHEMES:
            raise ValueError(f"weight_scheme must be one of {', '.join(SCHEMES)}, not {self.weight_scheme}")
        return super().learn(df, names, state)

    def values(self, x, learnt, n):
        if self.weight_scheme == "binary":
            return F.transform(x, lambda v: (v > 0).cast("int"))
        if self.weight_scheme == "raw count":
            return x.cast("array<int>")
        if self.weight_scheme == "term frequency":
            return _divided(x, lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v))
        if self.weight_scheme == "log normalization":
            return F.transform(x, lambda v: F.log1p(v))
        w = self.weight
        return text.bind(x, lambda x: text.bind(F.array_max(x), lambda top: F.transform(x, lambda v: F.when(top == 0, F.lit(float("nan"))).otherwise(w + w * v / F.when(top == 0, 1.0).otherwise(top)))))

    def tidy(self, names, learnt):
        return [r | {"value": None if names is None else self.weight_scheme} for r in super().tidy(names, learnt)]


@dataclass(frozen=True)
class TfIdf(_Counted):
    """Normalised frequencies times inverse document frequencies learnt from the training data."""

    vocabulary: tuple[str, ...] | None = None
    smooth_idf: bool = True
    norm: str = "l1"
    sublinear_tf: bool = False
    prefix: str = "tfidf"
    output: str = "wide"
    keep_original_cols: bool = False
    title = "Term frequency-inverse document frequency"

    def learn(self, df, names, state):
        if self.norm not in ("l1", "l2", "none"):
            raise ValueError(f"norm must be l1, l2 or none, not {self.norm}")
        n_docs, vocab, idf = df.count(), {}, {}
        for n in names:
            known = list(self.vocabulary) if self.vocabulary is not None else sorted(state.vocab[n]) if n in state.vocab else None
            seen = df.select(F.explode(F.array_distinct(tokens_of(df, n))).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n"))
            if known is not None:
                seen = seen.join(F.broadcast(df.sparkSession.createDataFrame([(t,) for t in known], "t string")), "t")
            found = {r.t: r.n for r in gathered(seen, MAX_COLUMNS, f"distinct tokens of {n}")}
            vocab[n] = known if known is not None else sorted(found)
            idf[n] = [math.log(self.smooth_idf + n_docs / found[t]) if found.get(t) else math.inf for t in vocab[n]]
        return {"vocab": vocab, "idf": idf}, state.without(names)

    def values(self, x, learnt, n):
        if self.norm == "none":
            tf = x
        else:
            size = (lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)) if self.norm == "l1" else (lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)))
            tf = _divided(x, size)
        if self.sublinear_tf:
            tf = F.transform(tf, lambda v: F.when(v > 0, 1 + F.ln(v)).otherwise(0.0))
        idf = F.array(*[F.lit(v) for v in learnt["idf"][n]])
        return F.zip_with(tf, idf, lambda v, w: F.when(v == 0, 0.0).otherwise(v * w))

    def tidy(self, names, learnt):
        if names is None:
            return [{"terms": str(self.columns), "token": None, "weight": None}]
        return [{"terms": n, "token": t, "weight": w} for n in names for t, w in zip(learnt["vocab"][n], learnt["idf"][n], strict=True)]


OUTPUTS = ("wide", "vector", "map")


@dataclass(frozen=True)
class TextHash(Step):
    """Signed or plain feature hashing of tokens. Hash schemes: murmur (Spark's) and md5 (portable).

    output: "wide" gives a column for each bucket, "map" a map of the buckets that tokens fall in, the sparse form, and
    "vector" an ML vector.
    """

    signed: bool = True
    num_terms: int = 1024
    prefix: str = "texthash"
    scheme: str = "murmur"
    output: str = "wide"
    keep_original_cols: bool = False
    title = "Feature hashing"
    tunable = {"signed": (True, False), "num_terms": (2**8, 2**12)}

    def apply(self, df, names, learnt):
        for n in names:
            df = _spread_hash(df, tokens_of(df, n), n, [n], self)
        return df

    def sparsity(self, df):
        return {n: (self.num_terms, 1 - 1 / self.num_terms) for n in selected(df, self.columns)}

    def tidy(self, names, learnt):
        return [r | {"value": None if names is None else self.signed, "length": None if names is None else self.num_terms} for r in super().tidy(names, learnt)]


def _spread_hash(df: DataFrame, tokens: Column, name: str, gone: list[str], step) -> DataFrame:
    if step.output not in OUTPUTS:
        raise ValueError(f"output must be one of {', '.join(OUTPUTS)}, not {step.output}")
    sums, keep = text.bucket_sums(tokens, step.num_terms, step.signed, step.scheme), step.keep_original_cols
    sparse = lambda x: F.map_from_entries(F.transform(x, lambda r: F.struct(r.bucket, r.value.cast("int"))))
    if step.output == "map":
        return spread(df, df, {f"{step.prefix}_{name}": sparse(sums)}, gone, keep)
    hashed, dense = free("_hash", df.columns), text.dense(sums, step.num_terms)
    if step.output == "vector":
        return spread(df, df, {f"{step.prefix}_{name}": array_to_vector(dense.cast("array<double>"))}, gone, keep)
    made = df.withColumn(hashed, dense)
    return spread(made, df, {f"{step.prefix}_{name}_{padded(i + 1, step.num_terms)}": F.get(hashed, i) for i in range(step.num_terms)}, gone, keep)


@dataclass(frozen=True)
class DummyHash(Step):
    """Feature hashing of a category; collapse joins the columns' values first, without a mark between."""

    signed: bool = True
    num_terms: int = 32
    collapse: bool = False
    prefix: str = "dummyhash"
    scheme: str = "murmur"
    output: str = "wide"
    keep_original_cols: bool = False
    kind = "string"
    title = "Feature hashing"
    tunable = {"signed": (True, False), "num_terms": (2**8, 2**12)}

    def apply(self, df, names, learnt):
        if self.collapse:
            joined = F.concat(*[F.coalesce(col(n), F.lit("")) for n in names])
            return _spread_hash(df, text.regex(joined, " "), "_".join(names), names, self)
        for n in names:
            df = _spread_hash(df, text.regex(col(n), " "), n, [n], self)
        return df

    def sparsity(self, df):
        return {n: (self.num_terms, 1 - 1 / self.num_terms) for n in selected(df, self.columns)}

    def tidy(self, names, learnt):
        return [r | {"value": self.signed, "num_terms": self.num_terms, "collapse": self.collapse} for r in super().tidy(names, learnt)]


@dataclass(frozen=True)
class SequenceOneHot(Step):
    """Codes of the first or last tokens: one integer column for each place."""

    sequence_length: int = 100
    padding: str = "pre"
    truncating: str = "pre"
    vocabulary: tuple[str, ...] | None = None
    prefix: str = "seq1hot"
    keep_original_cols: bool = False
    title = "Sequence 1 hot encoding"
    learns = True

    def learn(self, df, names, state):
        return {"vocab": {n: list(self.vocabulary) if self.vocabulary is not None else sorted(state.vocab[n]) if n in state.vocab else distinct_tokens(df, n, MAX_VOCABULARY) for n in names}}, state.without(names)

    def apply(self, df, names, learnt):
        for n in names:
            codes = free("_codes", df.columns)
            made = df.withColumn(codes, text.codes(tokens_of(df, n), learnt["vocab"][n], self.sequence_length, self.padding, self.truncating))
            df = spread(made, df, {f"{self.prefix}_{n}_{i + 1}": F.get(codes, i) for i in range(self.sequence_length)}, [n], self.keep_original_cols)
        return df

    def tidy(self, names, learnt):
        if names is None:
            return [{"terms": str(self.columns), "vocabulary": None, "token": None}]
        return [{"terms": n, "vocabulary": i, "token": t} for n in names for i, t in enumerate(learnt["vocab"][n], 1)]


AGGREGATIONS = ("sum", "mean", "min", "max")


@dataclass(frozen=True)
class WordEmbeddings(Step):
    """Sum, mean, min or max of the vectors of a document's tokens.

    embeddings: a DataFrame whose first column is the token, the rest numbers. A
    table of at most max_bytes is sent to the executors, and a document's
    vectors are pooled within its row. A larger one is joined with the documents'
    different tokens, and ``key`` must then name a column that tells the rows
    apart. Unknown tokens and null values don't count; a document without any
    gets the default.
    """

    embeddings: DataFrame | None = None
    aggregation: str = "sum"
    aggregation_default: float = 0
    prefix: str = "wordembed"
    keep_original_cols: bool = False
    key: str | None = None
    max_bytes: int = 256 << 20
    title = "Word embeddings aggregated"

    def learn(self, df, names, state):
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}, not {self.aggregation}")
        fields = self.embeddings.schema.fields
        if not isinstance(fields[0].dataType, T.StringType) or not all(isinstance(f.dataType, T.NumericType) for f in fields[1:]):
            raise TypeError("embeddings must have a string column first and numeric columns after it")
        token, *dims = self.embeddings.columns
        vectors = self.embeddings.where(col(token).isNotNull()).dropDuplicates([token]).persist()
        size = vectors.agg(F.count("*"), F.sum(F.octet_length(col(token)))).first()
        small = size[0] * 8 * len(dims) + (size[1] or 0) <= self.max_bytes
        table = vectors.toArrow() if small else None
        vectors.unpersist()
        if small:
            columns = [pc.fill_null(c.cast(pa.float64()), float("nan")).to_numpy() for c in table.columns[1:]]
            return {"tokens": table.column(0).to_pylist(), "matrix": np.stack(columns, 1) if columns else np.zeros((table.num_rows, 0)), "dims": dims}, state.without(names)
        if self.key is None:
            raise ValueError(f"the embeddings have over {self.max_bytes} bytes; name a key column that tells the rows apart, to join them")
        return {"dims": dims}, state.without(names)

    def apply(self, df, names, learnt):
        dims, default = learnt["dims"], float(self.aggregation_default)
        broadcast = df.sparkSession.sparkContext.broadcast
        for n in names:
            if "matrix" in learnt:
                found = free("_pooled", df.columns)
                pool = arrow.pooled(learnt["tokens"], learnt["matrix"], self.aggregation, default, broadcast)
                made = df.withColumn(found, pool(F.coalesce(tokens_of(df, n), F.array().cast("array<string>"))))
                value = lambda i, d, found=found: F.get(found, i)
            else:
                made, own = self._joined(df, n, dims)
                value = lambda i, d, own=own: F.coalesce(own[i], F.lit(default))
            df = spread(made, df, {f"{self.prefix}_{n}_{d}": value(i, d) for i, d in enumerate(dims)}, [n], self.keep_original_cols)
        return df

    def _joined(self, df: DataFrame, n: str, dims: list[str]) -> tuple[DataFrame, list[Column]]:
        """df and the pooled columns: one join on the token, one aggregation by the key."""
        token = self.embeddings.columns[0]
        names = [f"_{i}" for i in range(len(dims))]
        vectors = self.embeddings.where(col(token).isNotNull()).dropDuplicates([token]).toDF("token", *names)
        long = df.select(col(self.key).alias("_key"), F.inline(text.runs(tokens_of(df, n))))
        agg = long.join(vectors, "token").groupBy("_key").agg(*[pooled(self.aggregation, d).alias(d) for d in names])
        key, own = free("_key", df.columns), [free(d, df.columns) for d in names]
        agg = agg.toDF(key, *own)
        return df.join(agg, col(self.key).eqNullSafe(F.col(key)), "left"), [F.col(d) for d in own]

    def tidy(self, names, learnt):
        rows = None if names is None else len(learnt["tokens"]) if "tokens" in learnt else self.embeddings.count()
        return [r | {"embeddings_rows": rows, "aggregation": self.aggregation} for r in super().tidy(names, learnt)]


def pooled(aggregation: str, dim: str, times: str = "n") -> Column:
    """An aggregate over vectors that stand ``times`` times each."""
    d, n = col(dim), F.col(times)
    if aggregation == "sum":
        return F.sum(d * n)
    if aggregation == "mean":
        return F.sum(d * n) / F.sum(F.when(d.isNotNull(), n))
    return (F.min if aggregation == "min" else F.max)(d).cast("double")


@dataclass(frozen=True)
class LDA(Step):
    """Topic shares by a model that is fitted once and then only applied."""

    num_topics: int = 10
    models: dict = field(default_factory=dict)
    seed: int = 1
    max_iter: int = 20
    prefix: str = "lda"
    keep_original_cols: bool = False
    title = "Text feature extraction"
    learns = True

    def learn(self, df, names, state):
        learnt = {"vocab": {}, "models": {}}
        for n in names:
            if n in self.models:
                learnt["vocab"][n], learnt["models"][n] = self.models[n]
                continue
            counts = df.select(F.explode(tokens_of(df, n)).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where("n >= 2")
            vocab = sorted(r.t for r in counts.orderBy(F.desc("n"), "t").limit(50 * max(self.num_topics, 1)).collect())
            learnt["vocab"][n] = vocab
            features = free("_lda_counts", [n])
            counted = count_vector(df.select(col(n)), tokens_of(df, n), vocab, features)
            learnt["models"][n] = SparkLDA(k=self.num_topics, maxIter=self.max_iter, seed=self.seed, featuresCol=features).fit(counted)
        return learnt, state.without(names)

    def apply(self, df, names, learnt):
        for n in names:
            counts = free("_lda_counts", df.columns)
            topics = free("_topics", [*df.columns, counts])
            counted = count_vector(df, tokens_of(df, n), learnt["vocab"][n], counts)
            model = learnt["models"][n].copy().setFeaturesCol(counts).setTopicDistributionCol(topics)
            made = model.transform(counted).withColumn(topics, vector_to_array(topics))
            df = spread(made, df, {f"{self.prefix}_{n}_{i + 1}": F.get(topics, i) for i in range(self.num_topics)}, [n], self.keep_original_cols)
        return df

    def tidy(self, names, learnt):
        return [r | {"num_topics": self.num_topics} for r in super().tidy(names, learnt)]


@dataclass(frozen=True)
class TextFeature(Step):
    """Named functions over a string column, Column to numeric Column each."""

    extract_functions: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: dict(COUNT_FUNCTIONS))
    prefix: str = "textfeature"
    keep_original_cols: bool = False
    kind = "string"
    title = "Text feature extraction"

    def learn(self, df, names, state):
        probe = df.sparkSession.range(1).select(*[f(F.lit("aa")).alias(k) for k, f in self.extract_functions.items()])
        for f in probe.schema:
            if not isinstance(f.dataType, T.NumericType):
                raise TypeError(f"the function {f.name} must give numbers, not {f.dataType.simpleString()}")
        return {}, state

    def apply(self, df, names, learnt):
        new = {f"{self.prefix}_{n}_{k}": f(col(n)) for n in names for k, f in self.extract_functions.items()}
        return with_columns(df, new, names, self.keep_original_cols)

    def tidy(self, names, learnt):
        return [{"terms": n, "functions": k} for n in (names if names is not None else [str(self.columns)]) for k in self.extract_functions]


__all__ = ["LDA", "DummyHash", "SequenceOneHot", "TermFrequency", "TextFeature", "TextHash", "TfIdf", "WordEmbeddings", "selected"]
