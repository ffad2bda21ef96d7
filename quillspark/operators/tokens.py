"""Steps that make, change and filter tokens."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.connection import Client, Listener

import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow, subword, text
from ..functions import stem as stems
from ..functions.stopwords import stopwords
from . import taggers
from .base import MAX_VOCABULARY, TOKENS, State, Step, check_names, col, distinct_tokens, fields_of, gathered, tokens_of


def python_udf(fn: Callable, out: T.DataType = TOKENS) -> Callable[[Column], Column]:
    """An Arrow UDF over one value at a time, for rules that have no built-in form."""

    @F.pandas_udf(out)
    def run(x: pd.Series) -> pd.Series:
        return x.map(fn)

    return run


def _each(x: list, fn: Callable) -> list:
    return [fn(v) for v in x]


def _listed(v) -> list[str]:
    return [] if v is None else list(v)


def _stemmer(language: str) -> Callable[[str], str]:
    if language not in stems.STEMMERS:
        raise ValueError(f"no stemmer for {language}; give custom_stemmer")
    return stems.STEMMERS[language]


def _custom_row(tokens, fn=None) -> list[str]:
    return list(fn(_listed(tokens)))


@dataclass(frozen=True)
class Tokenize(Step):
    """Text to tokens. ``custom`` is a Column to Column function, ``tagger`` a text to (tokens, lemma, pos) function.

    engine: "default"; "bpe", trained on the column; "tagger", with the function given; "spacy" and "udpipe", taggers of
    those libraries, where they are installed, with the model named in training_options["model"].
    """

    token: str = "words"
    engine: str = "default"
    options: dict = field(default_factory=dict)
    training_options: dict = field(default_factory=dict)
    custom: Callable[[Column], Column] | None = None
    tagger: Callable | None = None
    kind = "string"
    title = "Tokenization"
    tunable = {"token": (*text.KINDS, "word_stems")}

    @property
    def learns(self) -> bool:
        return self.custom is None and self.engine == "bpe"

    def learn(self, df: DataFrame, names: list[str], state: State):
        if self.custom is None and self.engine == "bpe":
            if "vocab_size" not in self.training_options:
                raise ValueError("training_options needs vocab_size")
            return TokenizeBPE(names, vocabulary_size=self.training_options["vocab_size"]).learn(df, names, state)
        if self.engine not in ("default", "tagger", "bpe", *taggers.ENGINES):
            raise ValueError(f"engine must be one of default, tagger, bpe, {', '.join(taggers.ENGINES)}, not {self.engine}")
        if self.engine in taggers.ENGINES:
            taggers.check(self.engine)
        kinds = [*text.KINDS, "word_stems"] if self.engine == "default" else ["words"]
        if self.custom is None and self.token not in kinds:
            raise ValueError(f"token must be one of {', '.join(kinds)}, not {self.token}")
        return {}, state.without(names)

    def apply(self, df: DataFrame, names: list[str], learnt: dict) -> DataFrame:
        if self.custom is None and self.engine == "bpe":
            return TokenizeBPE(names).apply(df, names, learnt)
        if self.engine == "tagger" or self.engine in taggers.ENGINES:
            kind = T.StructType([T.StructField(n, TOKENS) for n in ("tokens", "lemma", "pos")])
            tagger = self.tagger if self.engine == "tagger" else partial(taggers.tag, self.engine, self.training_options.get("model"))

            @F.pandas_udf(kind)
            def run(x: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([tuple(map(list, tagger(t))) if t else ([], [], []) for t in x], columns=["tokens", "lemma", "pos"])

            return df.withColumns({n: run(col(n)) for n in names})
        if self.custom:
            fn = self.custom
        elif self.token == "word_stems":
            options = dict(self.options)
            stemmed = arrow.map_tokens(_stemmer(options.pop("language", "english")))
            fn = lambda x: stemmed(text.words(x, **options))
        else:
            fn = partial(text.KINDS[self.token], **self.options)
        return df.withColumns({n: fn(col(n)) for n in names})

    def tidy(self, names, learnt):
        return [r | {"value": None if names is None else self.token} for r in super().tidy(names, learnt)]


def _words(df: DataFrame, n: str) -> DataFrame:
    """The words of a text column and their counts."""
    word = F.explode(F.filter(F.split(col(n), r"\s+"), lambda w: w != "")).alias("w")
    return df.select(word).groupBy("w").agg(F.count("*").alias("n"))


#: Characters of different words from which a model is trained on the driver at most; of more, on all executors at once.
LOCAL_CHARS = 1 << 21


def _marked(batch: pa.RecordBatch | pa.Table) -> tuple[str, list[int], list[int]]:
    words = [subword.MARK + w for w in batch.column("w").to_pylist()]
    return "".join(words), list(map(len, words)), batch.column("n").to_pylist()


@contextmanager
def _exchange() -> Iterator[Callable[[object], list]]:
    """A function that gives what each task of the stage has sent at this point. All tasks are connected with the first one: Spark's own allGather, by which
    they learn its port and a key, takes a second each time."""
    at = BarrierTaskContext.get()
    if at.partitionId() == 0:
        key = secrets.token_hex(32)
        with Listener(("", 0), backlog=1024, authkey=key.encode()) as door:
            at.allGather(json.dumps([door.address[1], key]))
            others = [door.accept() for _ in at.getTaskInfos()[1:]]

        def run(x):
            found = [x, *(c.recv() for c in others)]
            for c in others:
                c.send(found)
            return found
    else:
        port, key = json.loads(at.allGather("")[0])
        others = [Client((at.getTaskInfos()[0].address.rpartition(":")[0].strip("[]"), port), authkey=key.encode())]

        def run(x):
            others[0].send(x)
            return others[0].recv()

    try:
        yield run
    finally:
        for c in others:
            c.close()


def _learn_part(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    with _exchange() as exchange:
        letters, merges = subword.learn_bpe(map(_marked, batches), size, exchange)
    if BarrierTaskContext.get().partitionId() == 0:
        yield pa.RecordBatch.from_pydict({"letters": pa.array([letters], pa.list_(pa.string())), "merges": pa.array([[p for m in merges for p in m]], pa.list_(pa.string()))})


def _learn_bpe(words: DataFrame, size: int) -> tuple[list[str], list[tuple[str, str]]]:
    """Letters and merges of all words, which stay on the executors if there are many: each task of one stage keeps its part, and the tasks tell each other the
    pairs' counts, so that all of them need a slot at once."""
    words = words.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if (words.agg(F.sum(F.length("w"))).first()[0] or 0) <= LOCAL_CHARS:
            return subword.learn_bpe([_marked(words.toArrow())], size, lambda x: [x])
        sc = words.sparkSession.sparkContext
        slots = sc._jsc.sc().maxNumConcurrentTasks(sc._jsc.sc().resourceProfileManager().defaultResourceProfile())
        made = words.repartition(max(1, min(slots, sc.defaultParallelism))).mapInArrow(partial(_learn_part, size=size), "letters array<string>, merges array<string>", barrier=True)
        ((letters, flat),) = made.collect()
        return letters, list(zip(flat[::2], flat[1::2], strict=True))
    finally:
        words.unpersist()


@dataclass(frozen=True)
class TokenizeBPE(Step):
    """Byte-pair pieces of a model that is trained for each column on its word counts."""

    vocabulary_size: int = 1000
    options: dict = field(default_factory=dict)
    kind = "string"
    title = "BPE tokenization"
    learns = True
    tunable = {"vocabulary_size": (1000, 32000)}

    def learn(self, df, names, state):
        if "vocab_size" in self.options:
            raise ValueError("give vocabulary_size, not vocab_size in options")
        merges, vocab = {}, {}
        for n in names:
            letters, merges[n] = _learn_bpe(_words(df, n), self.vocabulary_size)  # letters with the mark, which stands for the blank
            if self.vocabulary_size < len(letters):
                raise ValueError(f"vocabulary_size of {self.vocabulary_size} is too small for column {n}; it has {len(letters)} characters")
            vocab[n] = sorted({*letters, *(a + b for a, b in merges[n])})
        return {"merges": merges}, state.with_vocab(vocab)

    def apply(self, df, names, learnt):
        out = {}
        for n in names:
            rank = {tuple(p): i for i, p in enumerate(learnt["merges"][n])}

            out[n] = arrow.map_words(str.split, partial(subword.bpe_words, rank=rank, plan=subword.bpe_plan(rank)))(col(n))
        return df.withColumns(out)


@dataclass(frozen=True)
class TokenizeSentencePiece(Step):
    """Pieces of a SentencePiece model: a given file, or one trained by the library on the full counts of its words."""

    vocabulary_size: int = 1000
    model_file: str | None = None
    options: dict = field(default_factory=dict)
    kind = "string"
    title = "SentencePiece tokenization"
    learns = True

    def learn(self, df, names, state):
        import sentencepiece as sp

        models, vocab = {}, {}
        for n in names:
            if self.model_file:
                with open(self.model_file, "rb") as f:
                    models[n] = f.read()
            else:
                words = _words(df, n).persist(StorageLevel.MEMORY_AND_DISK)
                letters = {r[0] for r in words.select(F.explode(F.split("w", ""))).distinct().collect()} - {""} | {subword.MARK}
                if self.vocabulary_size < len(letters):
                    raise ValueError(f"vocabulary_size of {self.vocabulary_size} is too small for column {n}; it has {len(letters)} characters")
                train = partial(_train_pieces, options={"vocab_size": self.vocabulary_size} | self.options)
                if (words.agg(F.sum(F.length("w"))).first()[0] or 0) <= LOCAL_CHARS:
                    models[n] = next(train(words.orderBy("w").toArrow().to_batches())).column(0)[0].as_py()
                else:  # the library holds all words in one process; an executor has more room than the driver
                    models[n] = words.repartition(1).sortWithinPartitions("w").mapInArrow(train, "model binary").collect()[0][0]
                words.unpersist()
            p = sp.SentencePieceProcessor(model_proto=models[n])
            vocab[n] = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        return {"models": models}, state.with_vocab(vocab)

    def apply(self, df, names, learnt):
        out = {}
        for n in names:
            model = learnt["models"][n]

            out[n] = _pieces(model)(col(n))
        return df.withColumns(out)


def _train_pieces(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    import io

    import sentencepiece as sp

    lines = (f"{w}\t{n}" for b in batches for w, n in zip(b.column("w").to_pylist(), b.column("n").to_pylist(), strict=True))
    out = io.BytesIO()
    sp.SentencePieceTrainer.train(sentence_iterator=lines, input_format="tsv", model_writer=out, hard_vocab_limit=False, minloglevel=2, **options)
    yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})


def _pieces(model: bytes):
    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece as sp

        p = sp.SentencePieceProcessor(model_proto=model)  # once for a task, not for each batch
        for x in batches:
            for part in arrow.parts(x):
                yield pa.array(p.encode([t or "" for t in part.to_pylist()], out_type=str), pa.list_(pa.string()))

    return run


@dataclass(frozen=True)
class TokenizeWordPiece(Step):
    """Greedy longest pieces of a given vocabulary."""

    vocab: tuple[str, ...] = ()
    unk_token: str = "[UNK]"
    max_chars: int = 100
    kind = "string"
    title = "WordPiece tokenization"

    def apply(self, df, names, learnt):
        vocab = frozenset(self.vocab)
        cased, longest = subword.is_cased(vocab), subword.longest_of(vocab)
        fn = arrow.map_words(partial(subword.wordpiece_text, cased=cased), partial(_each, fn=partial(subword.wordpiece_word, vocab=vocab, longest=longest, unk_token=self.unk_token, max_chars=self.max_chars)))
        return df.withColumns({n: fn(col(n)) for n in names})


@dataclass(frozen=True)
class Untokenize(Step):
    """Tokens joined to a text; null tokens are left out."""

    sep: str = " "
    title = "Untokenization"

    def apply(self, df, names, learnt):
        return df.withColumns({n: F.array_join(tokens_of(df, n), self.sep) for n in names})

    def tidy(self, names, learnt):
        return [r | {"value": None if names is None else self.sep} for r in super().tidy(names, learnt)]


@dataclass(frozen=True)
class Stem(Step):
    """Stems; lemma and pos go. A custom stemmer gets all tokens of a row and may change their number."""

    options: dict = field(default_factory=dict)
    custom_stemmer: Callable[[list[str]], list[str]] | None = None
    title = "Stemming"

    def apply(self, df, names, learnt):
        if self.custom_stemmer:
            fn = python_udf(partial(_custom_row, fn=self.custom_stemmer))
        else:
            fn = arrow.map_tokens(_stemmer(self.options.get("language", "english")))
        return df.withColumns({n: fn(tokens_of(df, n)) for n in names})

    def tidy(self, names, learnt):
        return [r | {"is_custom_stemmer": None if names is None else self.custom_stemmer is not None} for r in super().tidy(names, learnt)]


@dataclass(frozen=True)
class Lemma(Step):
    """Lemmas take the tokens' place; pos stays."""

    title = "Lemmatization"

    def learn(self, df, names, state):
        for n in names:
            if "lemma" not in fields_of(df, n):
                raise ValueError(f"column {n} has no lemma")
        return {}, state.without(names)

    def apply(self, df, names, learnt):
        new = {n: F.struct(col(n)["lemma"].alias("tokens"), col(n)["pos"].alias("pos")) if "pos" in fields_of(df, n) else col(n)["lemma"] for n in names}
        return df.withColumns(new)


@dataclass(frozen=True)
class PosFilter(Step):
    """Tokens whose part of speech is one of keep_tags."""

    keep_tags: tuple[str, ...] = ("NOUN",)
    title = "Part of speech filtering"

    def learn(self, df, names, state):
        for n in names:
            if "pos" not in fields_of(df, n):
                raise ValueError(f"column {n} has no pos")
        return {}, state.without(names)

    def apply(self, df, names, learnt):
        return df.withColumns({n: _filtered(df, n, lambda r: r["pos"].isin(list(self.keep_tags)) if self.keep_tags else F.lit(False)) for n in names})


def _members(df: DataFrame, n: str, vocab: list[str]) -> Column:
    """The tokens that are in the vocabulary; a large one is looked up in Arrow batches, not put into the plan."""
    if len(vocab) <= text.LITERALS or fields_of(df, n) != ["tokens"]:
        return _filtered(df, n, lambda r: r["tokens"].isin(vocab) if vocab else F.lit(False))
    return arrow.keep_tokens(vocab)(tokens_of(df, n))


def _filtered(df: DataFrame, n: str, keep: Callable[[Column], Column]) -> Column:
    """A token column with the elements for which keep(struct of fields) holds, all fields in step."""
    fields = fields_of(df, n)
    if fields == ["tokens"]:
        return F.filter(tokens_of(df, n), lambda t: keep({"tokens": t}))
    zipped = F.filter(F.arrays_zip(*[col(n)[f].alias(f) for f in fields]), keep)
    one = lambda f: F.transform(zipped, lambda r: r[f]).alias(f)
    return F.struct(*[one(f) for f in fields])


@dataclass(frozen=True)
class TokenMerge(Step):
    """The columns' tokens one after the other, in a new column."""

    prefix: str = "tokenmerge"
    keep_original_cols: bool = False
    title = "Merging tokens"

    def learn(self, df, names, state):
        check_names(df, [self.prefix], [] if self.keep_original_cols else names)
        return {}, state

    def apply(self, df, names, learnt):
        merged = F.concat(*[F.coalesce(tokens_of(df, n), F.array().cast(TOKENS)) for n in names])
        kept = [col(c) for c in df.columns if self.keep_original_cols or c not in names]
        check_names(df, [self.prefix], [] if self.keep_original_cols else names)
        return df.select(*kept, merged.alias(self.prefix))


@dataclass(frozen=True)
class Stopwords(Step):
    """Tokens of a list are dropped, or kept alone."""

    language: str = "en"
    keep: bool = False
    source: str = "snowball"
    custom: tuple[str, ...] | None = None
    title = "Stop word removal"

    def _list(self) -> list[str]:
        return list(self.custom) if self.custom is not None else stopwords(self.language, self.source)

    def learn(self, df, names, state):
        words = self._list()
        if self.keep:
            return {}, state.with_vocab({n: sorted(set(words)) for n in names})
        known = {n: [t for t in state.vocab[n] if t not in set(words)] for n in names if n in state.vocab}
        return {}, state.without(names).with_vocab(known)

    def apply(self, df, names, learnt):
        words = self._list()
        inside = lambda r: r["tokens"].isin(words) if words else F.lit(False)
        return df.withColumns({n: _filtered(df, n, inside if self.keep else lambda r: ~inside(r)) for n in names})

    def tidy(self, names, learnt):
        return [r | {"value": None if names is None else self.source, "keep": self.keep} for r in super().tidy(names, learnt)]


@dataclass(frozen=True)
class TokenFilter(Step):
    """Tokens whose number of occurrences is in range, the max_tokens most frequent of them (of equals, first in order)."""

    max_times: float = float("inf")
    min_times: float = 0
    percentage: bool = False
    max_tokens: int | None = 100
    filter_fun: Callable[[Column], Column] | None = None
    title = "Text filtering"
    tunable = {"max_times": None, "min_times": None, "max_tokens": None}

    @property
    def learns(self) -> bool:
        return self.filter_fun is None

    def learn(self, df, names, state):
        if self.filter_fun:
            return {}, state.without(names)
        vocab = {}
        for n in names:
            kept = self.counted(df.select(F.explode(tokens_of(df, n)).alias("token")))
            vocab[n] = [r.token for r in gathered(kept, MAX_VOCABULARY, f"tokens of {n} that stay")]
        return {"vocab": vocab}, state.with_vocab(vocab)

    def counted(self, tokens: DataFrame) -> DataFrame:
        """token and n of the tokens that stay."""
        counts = tokens.where("token is not null").groupBy("token").agg(F.count("*").alias("n"))
        n = F.col("n")
        if self.percentage:
            total = counts.agg(F.sum("n")).first()[0] or 1
            n = n / F.lit(float(total))
        if self.max_times != float("inf"):
            counts = counts.where(n <= self.max_times)
        counts = counts.where(n >= self.min_times)
        return counts if self.max_tokens is None else counts.orderBy(F.desc("n"), "token").limit(self.max_tokens)

    def apply(self, df, names, learnt):
        if self.filter_fun:
            return df.withColumns({n: _filtered(df, n, lambda r: self.filter_fun(r["tokens"])) for n in names})
        return df.withColumns({n: _members(df, n, learnt["vocab"][n]) for n in names})

    def tidy(self, names, learnt):
        return [{"terms": n, "value": None if names is None else len(learnt.get("vocab", {}).get(n, ()))} for n in (names if names is not None else [str(self.columns)])]


@dataclass(frozen=True)
class NGram(Step):
    """n-grams of min_num_tokens to num_tokens tokens; lemma and pos go."""

    num_tokens: int = 3
    min_num_tokens: int = 3
    delim: str = "_"
    title = "N-gram transformation"
    tunable = {"num_tokens": (1, 3)}

    def learn(self, df, names, state):
        text.ngrams(F.lit(None), self.num_tokens, self.min_num_tokens)
        return {}, state.without(names)

    def apply(self, df, names, learnt):
        return df.withColumns({n: text.ngrams(tokens_of(df, n), self.num_tokens, self.min_num_tokens, self.delim) for n in names})


__all__ = ["Lemma", "NGram", "PosFilter", "Stem", "Stopwords", "TokenFilter", "TokenMerge", "Tokenize", "TokenizeBPE", "TokenizeSentencePiece", "TokenizeWordPiece", "Untokenize", "distinct_tokens"]
