"""Steps, their fitted form and the pipeline.

A step is an immutable description. ``fit`` learns from a training DataFrame to
which all former steps were applied and gives a separate, immutable ``Fitted``,
whose ``transform`` is a lazy DataFrame expression.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Selector = str | list[str] | tuple[str, ...] | Callable[[DataFrame], list[str]]
TOKENS = T.ArrayType(T.StringType())
#: What a fit gathers on the driver at most: the entries of a vocabulary, and those that become columns.
MAX_VOCABULARY, MAX_COLUMNS = 1_000_000, 20_000


def is_tokens(kind: T.DataType) -> bool:
    """A token column: an array of strings, or a struct of them named tokens, lemma, pos."""
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and kind.fields[0].name == "tokens" and all(f.name in ("tokens", "lemma", "pos") for f in kind.fields)
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)


def all_tokenized(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_tokens(f.dataType)]


def all_tokenized_predictors(df: DataFrame) -> list[str]:
    """Token columns but those in role "outcome" or "id" by their metadata."""
    return [f.name for f in df.schema if is_tokens(f.dataType) and (f.metadata or {}).get("role", "predictor") == "predictor"]


def all_strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def selected(df: DataFrame, columns: Selector) -> list[str]:
    names = columns(df) if callable(columns) else [columns] if isinstance(columns, str) else list(columns)
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"these columns are not there: {', '.join(missing)}")
    return names


def check_type(df: DataFrame, names: list[str], kind: str) -> None:
    for n in names:
        t = df.schema[n].dataType
        if not (is_tokens(t) if kind == "tokens" else isinstance(t, T.StringType)):
            raise TypeError(f"column {n} must be of {'tokens' if kind == 'tokens' else 'strings'}, not {t.simpleString()}")


def tokens_of(df: DataFrame, name: str) -> Column:
    c = col(name)
    return c["tokens"] if isinstance(df.schema[name].dataType, T.StructType) else c


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def gathered(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must have ``most`` at most; one more is an error, and nothing is cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: there are over {most}; filter the tokens first, or use the long-form plans")
    return rows


def tokenlist(tokens: Column, lemma: Column | None = None, pos: Column | None = None) -> Column:
    """A token column of an array of tokens and, in step with it, their lemmas and parts of speech. Fields of other lengths are an error."""
    fields = {k: v for k, v in (("tokens", tokens), ("lemma", lemma), ("pos", pos)) if v is not None}
    if len(fields) == 1:
        return tokens.cast(TOKENS)
    same = lambda c: F.when(F.size(c) == F.size(tokens), c.cast(TOKENS)).otherwise(F.raise_error(F.lit("fields of a token list must have one length")).cast(TOKENS))
    return F.struct(*[(v if k == "tokens" else same(v)).cast(TOKENS).alias(k) for k, v in fields.items()])


def fields_of(df: DataFrame, name: str) -> list[str]:
    t = df.schema[name].dataType
    return t.fieldNames() if isinstance(t, T.StructType) else ["tokens"]


def check_names(df: DataFrame, new: list[str], gone: list[str] = ()) -> None:
    """New names must clash neither with columns nor with each other, as Spark resolves them."""
    same = (lambda s: s) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    there = {same(c) for c in df.columns if c not in gone}
    for n in new:
        if same(n) in there:
            raise ValueError(f"name collision: {n} is there already")
        there.add(same(n))


@dataclass(frozen=True)
class State:
    """What is known of token columns while a pipeline is fitted: vocabularies that are not the distinct tokens."""

    vocab: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def without(self, names: list[str]) -> State:
        return State({k: v for k, v in self.vocab.items() if k not in names})

    def with_vocab(self, vocab: dict[str, list[str]]) -> State:
        return State(self.vocab | {k: tuple(v) for k, v in vocab.items()})


@dataclass(frozen=True)
class Step:
    columns: Selector
    skip: bool = field(default=False, kw_only=True)
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:8], kw_only=True)
    kind = "tokens"
    title = "Step"
    #: Whether the fit reads the data.
    learns = False
    #: What may be tuned: the range or the choices of each argument, or None.
    tunable = {}

    def fit(self, df: DataFrame, state: State) -> tuple[Fitted, State]:
        names = selected(df, self.columns)
        if self.kind:
            check_type(df, names, self.kind)
        if not names:
            return Fitted(self, (), {}), state
        learnt, state = self.learn(df, names, state)
        return Fitted(self, tuple(names), learnt), state

    def learn(self, df: DataFrame, names: list[str], state: State) -> tuple[dict, State]:
        return {}, state.without(names)

    def apply(self, df: DataFrame, names: list[str], learnt: dict) -> DataFrame:
        raise NotImplementedError

    def tidy(self, names: list[str] | None, learnt: dict) -> list[dict]:
        """Rows of describe(); names is None before fitting."""
        return [{"terms": n} for n in (names if names is not None else [str(self.columns)])]

    def sparsity(self, df: DataFrame) -> dict[str, tuple[int, float]]:
        """A guess of the columns that a selected column becomes, and of the share of zeros in them."""
        return {}

    def describe(self, spark: SparkSession) -> DataFrame:
        return _rows(spark, self.tidy(None, {}), self.id)

    def __repr__(self) -> str:
        of = self.columns if isinstance(self.columns, (str, list, tuple)) else getattr(self.columns, "__name__", "selector")
        return f"{self.title} for {of}"


def _rows(spark: SparkSession, rows: list[dict], step: str) -> DataFrame:
    rows = [{k: v if v is None or isinstance(v, (int, float, bool)) else str(v) for k, v in r.items()} | {"id": step} for r in rows]
    if not rows:
        return spark.createDataFrame([], "terms string, id string")
    kinds = {k: next((type(r[k]) for r in rows if r[k] is not None), str) for k in rows[0]}
    sql = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {sql[t]}" for k, t in kinds.items()))


@dataclass(frozen=True)
class Fitted:
    step: Step
    names: tuple[str, ...]
    learnt: dict

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.names:
            return df
        selected(df, list(self.names))
        if self.step.kind:
            check_type(df, list(self.names), self.step.kind)
        return self.step.apply(df, list(self.names), self.learnt)

    def describe(self, spark: SparkSession) -> DataFrame:
        return _rows(spark, self.step.tidy(list(self.names), self.learnt), self.step.id)

    def __repr__(self) -> str:
        return f"{self.step.title} for {', '.join(self.names) or 'no columns'} [fitted]"


@dataclass(frozen=True)
class Pipeline:
    """Ordered steps. ``fit`` applies each to the training data before the next one learns."""

    steps: tuple[Step, ...] = ()

    def add(self, *steps: Step) -> Pipeline:
        return replace(self, steps=self.steps + steps)

    def fit(self, df: DataFrame, persist: bool = True) -> FittedPipeline:
        """Learns step by step. If two steps or more learn from the data, the rows that reach the first of them are kept (in memory, else
        on disk) until the last has learnt, so that text is tokenised once; ``persist=False`` computes them anew for each, for data beyond
        the executors' disks."""
        state, fitted, kept = State(), [], None
        for i, s in enumerate(self.steps):
            if persist and kept is None and i and s.learns and sum(x.learns for x in self.steps[i:]) > 1:
                kept = df = df.persist(StorageLevel.MEMORY_AND_DISK)
            f, state = s.fit(df, state)
            fitted.append(f)
            df = f.transform(df)
        if kept is not None:
            kept.unpersist()
        return FittedPipeline(tuple(fitted), df)

    def show_tokens(self, df: DataFrame, name: str, n: int = 6) -> list[list[str]]:
        out = self.fit(df).training
        return [r[0] for r in out.select(tokens_of(out, name)).limit(n).collect()]

    def __repr__(self) -> str:
        return "\n".join(f"{i}. {s!r}" for i, s in enumerate(self.steps, 1))


@dataclass(frozen=True)
class FittedPipeline:
    steps: tuple[Fitted, ...]
    training: DataFrame | None

    def transform(self, df: DataFrame) -> DataFrame:
        """Steps with skip=True took part in the fit only."""
        for f in self.steps:
            if not f.step.skip:
                df = f.transform(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the fitted pipeline to a new folder of any store that Spark reaches."""
        from .store import save

        save(self, spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedPipeline:
        """The pipeline that was saved there, without its training data (``training`` is None)."""
        from .store import load

        return load(spark, path)


def distinct_tokens(df: DataFrame, name: str, most: int = MAX_COLUMNS) -> list[str]:
    """Sorted vocabulary of a column; it becomes columns, so it is gathered."""
    found = df.select(F.explode(F.array_distinct(tokens_of(df, name))).alias("t")).where("t is not null").distinct()
    return sorted(r[0] for r in gathered(found, most, f"distinct tokens of {name}"))


def vocabulary_of(df: DataFrame, name: str, state: State) -> list[str]:
    return sorted(state.vocab[name]) if name in state.vocab else distinct_tokens(df, name)
