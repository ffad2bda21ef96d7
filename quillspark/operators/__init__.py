"""The steps of a text feature pipeline."""

from . import base
from .base import Fitted, FittedPipeline, Pipeline, Step, all_strings, all_tokenized, all_tokenized_predictors, tokenlist
from .cleaning import CleanLevels, CleanNames, TextNormalization
from .numeric import LDA, DummyHash, SequenceOneHot, TermFrequency, TextFeature, TextHash, TfIdf, WordEmbeddings
from .tokens import Lemma, NGram, PosFilter, Stem, Stopwords, TokenFilter, TokenMerge, Tokenize, TokenizeBPE, TokenizeSentencePiece, TokenizeWordPiece, Untokenize

__all__ = [
    "LDA", "CleanLevels", "CleanNames", "DummyHash", "Fitted", "FittedPipeline", "Lemma", "NGram", "Pipeline", "PosFilter", "SequenceOneHot", "Stem", "Step", "Stopwords", "TermFrequency", "TextFeature",
    "TextHash", "TextNormalization", "TfIdf", "TokenFilter", "TokenMerge", "Tokenize", "TokenizeBPE", "TokenizeSentencePiece", "TokenizeWordPiece", "Untokenize", "WordEmbeddings", "all_strings", "all_tokenized",
    "all_tokenized_predictors", "tokenlist",
]
