"""Long-form plans: (document, token, value) rows, which need no schema discovery.

A row is a document. Its tokens are counted within the row, by sorting its
array, so counts, weights and hashes need no shuffle. Only what is known of all
documents (document frequencies, a filter's vocabulary) is aggregated over the
cluster: it becomes a persisted table, whose rows are counted, and is broadcast if
they are few; beyond that it is joined by a shuffle that the skew rule may split.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

BROADCAST_ROWS = 1_000_000


def checked(table: DataFrame) -> DataFrame:
    """The table, persisted on disk, and marked for a broadcast if it has few rows."""
    table = table.persist(StorageLevel.DISK_ONLY)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def tokens(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    return df.select(key, F.explode(tokens).alias("token"))


def counts(df: DataFrame, key: str, toks: Column) -> DataFrame:
    """key, token, n."""
    return df.select(key, F.inline(text.runs(toks)))


def _inlined(found: DataFrame, key: str, of: Column) -> DataFrame:
    """key, _of, token, n; ``of`` is computed once for a row, before its tokens are rows."""
    return found.select(key, of.alias("_of"), "_runs").select(key, "_of", F.inline("_runs"))


def term_frequency(df: DataFrame, key: str, toks: Column, scheme: str = "raw count", weight: float = 0.5) -> DataFrame:
    """key, token, value of the tokens that a document has."""
    n = F.col("n")
    if scheme in ("raw count", "binary", "log normalization"):
        value = {"raw count": n, "binary": F.lit(1).cast("long"), "log normalization": F.log1p(n)}[scheme]
        return counts(df, key, toks).select(key, "token", value.alias("value"))
    found = df.select(key, text.runs(toks).alias("_runs"))
    if scheme == "term frequency":
        whole = F.aggregate("_runs", F.lit(0).cast("long"), lambda a, r: a + r.n)
        return _inlined(found, key, whole).select(key, "token", (n / F.col("_of")).alias("value"))
    top = F.array_max(F.transform("_runs", lambda r: r.n))
    return _inlined(found, key, top).select(key, "token", (weight + weight * n / F.col("_of")).alias("value"))


def frequencies(df: DataFrame, toks: Column) -> DataFrame:
    """token and _df, the number of documents that have it."""
    return df.select(F.explode(F.array_distinct(toks)).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("_df"))


def tf_idf(df: DataFrame, key: str, toks: Column, norm: str = "l1", smooth: bool = True, sublinear: bool = False, training: DataFrame | None = None) -> DataFrame:
    """key, token, value. Document frequencies come from ``training`` (the same rows unless given)."""
    base = training if training is not None else df
    idf = F.ln(F.lit(1 if smooth else 0) + F.lit(base.count()) / F.col("_df"))
    table = checked(frequencies(base, toks).select("token", idf.alias("_idf")))
    found = df.select(key, text.runs(toks).alias("_runs"))
    if norm == "none":
        of = F.lit(1.0)
    elif norm == "l1":
        of = F.aggregate("_runs", F.lit(0.0), lambda a, r: a + r.n)
    else:
        of = F.sqrt(F.aggregate("_runs", F.lit(0.0), lambda a, r: a + r.n * r.n))
    tf = F.col("n") / F.col("_of")
    if sublinear:
        tf = 1 + F.ln(tf)
    return _inlined(found, key, of).join(table, "token").select(key, "token", (tf * F.col("_idf")).alias("value"))


def hashed(df: DataFrame, key: str, toks: Column, num_terms: int, signed: bool, scheme: str) -> DataFrame:
    """key, bucket, value (sum of signs)."""
    return df.select(key, F.inline(text.bucket_sums(toks, num_terms, signed, scheme)))
