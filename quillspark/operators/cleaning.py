"""Steps that normalise text and clean names and levels."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Step, check_names, col, gathered

MAX_LEVELS = 2_000
FORMS = ("nfc", "nfd", "nfkc", "nfkd", "nfkc_casefold")


def normal(text: str | None, form: str) -> str | None:
    if text is None:
        return None
    if form == "nfkc_casefold":
        return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return unicodedata.normalize(form.upper(), text)


@dataclass(frozen=True)
class TextNormalization(Step):
    """A Unicode normal form; Spark has no function for it, so an Arrow UDF."""

    normalization_form: str = "nfc"
    kind = "string"
    title = "Text normalization"

    def learn(self, df, names, state):
        if self.normalization_form not in FORMS:
            raise ValueError(f"normalization_form must be one of {', '.join(FORMS)}, not {self.normalization_form}")
        return {}, state

    def apply(self, df, names, learnt):
        form = self.normalization_form

        @F.pandas_udf("string")
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda t: normal(t, form))

        return df.withColumns({n: run(col(n)) for n in names})

    def tidy(self, names, learnt):
        return [r | {"normalization_form": None if names is None else self.normalization_form} for r in super().tidy(names, learnt)]


def snake(name: str) -> str:
    """snake_case of a name: letters and digits in lower case, everything else one underscore."""
    s = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", re.sub(r"[^A-Za-z0-9]+", "_", s))
    s = re.sub(r"_+", "_", s).strip("_").lower() or "x"
    return "x" + s if s[0].isdigit() else s


def unique(names: list[str]) -> list[str]:
    """Repeated results get _2, _3 and so on in order."""
    seen: dict[str, int] = {}
    out = []
    for n in map(snake, names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


@dataclass(frozen=True)
class CleanNames(Step):
    """Columns renamed to snake_case by a map that the fit stores."""

    kind = None
    title = "Cleaning variable names"

    def learn(self, df, names, state):
        return {"to": dict(zip(names, unique(names), strict=True))}, state.without(names)

    def apply(self, df: DataFrame, names, learnt):
        to = {a: b for a, b in learnt["to"].items() if a != b}
        check_names(df, list(to.values()), list(to))
        return df.withColumnsRenamed(to)

    def tidy(self, names, learnt):
        if names is None:
            return [{"terms": str(self.columns), "value": None}]
        return [{"terms": b, "value": a} for a, b in learnt["to"].items()]


@dataclass(frozen=True)
class CleanLevels(Step):
    """Values to snake_case by a map of the training levels, in sorted order; other values are null.

    The levels become a literal map: this is for categories, of which there are few.
    """

    kind = "string"
    title = "Cleaning factor levels"
    learns = True

    def learn(self, df, names, state):
        to = {}
        for n in names:
            levels = sorted(r[0] for r in gathered(df.select(col(n)).where(col(n).isNotNull()).distinct(), MAX_LEVELS, f"levels of {n}"))
            to[n] = dict(zip(levels, unique(levels), strict=True))
        return {"to": to}, state

    def apply(self, df, names, learnt):
        new = {}
        for n in names:
            pairs = [F.lit(x) for p in learnt["to"][n].items() for x in p]
            new[n] = F.try_element_at(F.create_map(*pairs), col(n)) if pairs else F.lit(None).cast("string")
        return df.withColumns(new)

    def tidy(self, names, learnt):
        if names is None:
            return [{"terms": str(self.columns), "original": None, "value": None}]
        return [{"terms": n, "original": a, "value": b} for n in names for a, b in learnt["to"][n].items()]
