"""Adapters for tagging libraries that may be installed beside this one: text to (tokens, lemmas, parts of speech)."""

from __future__ import annotations

import importlib.util
from functools import lru_cache

#: The engines, and the module that each needs on the driver and the executors.
ENGINES = {"spacy": "spacy", "udpipe": "ufal.udpipe"}
Tagged = tuple[list[str], list[str], list[str]]


def check(engine: str) -> None:
    top = ENGINES[engine].split(".")[0]
    if importlib.util.find_spec(top) is None:
        raise ImportError(f"the engine {engine} needs the package {ENGINES[engine]}, which is not installed; or give a function as tagger with engine='tagger'")


@lru_cache(maxsize=4)
def _spacy(model: str):
    import spacy

    return spacy.load(model or "en_core_web_sm")


@lru_cache(maxsize=4)
def _udpipe(model: str):
    from ufal.udpipe import Model, Pipeline

    loaded = Model.load(model)
    if loaded is None:
        raise ValueError(f"no udpipe model at {model}")
    return Pipeline(loaded, "tokenize", Pipeline.DEFAULT, Pipeline.DEFAULT, "conllu")


def conllu(out: str) -> Tagged:
    """The words of a table in CoNLL-U format; multi-word ranges and empty nodes have no tags and are left out."""
    rows = [r.split("\t") for r in out.split("\n") if r and r[0] != "#"]
    rows = [r for r in rows if r[0].isdigit()]
    return [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]


def tag(engine: str, model: str | None, text: str) -> Tagged:
    """The model is loaded once in each Python worker."""
    if engine == "udpipe":
        return conllu(_udpipe(model).process(text))
    doc = [t for t in _spacy(model)(text) if not t.is_space]
    return [t.text for t in doc], [t.lemma_ for t in doc], [t.pos_ for t in doc]
