"""Fitted pipelines as files: one JSON line, and a folder for each table or model that a step holds."""

from __future__ import annotations

import base64
import dataclasses
import importlib
import json

import numpy as np
from pyspark.ml.clustering import DistributedLDAModel, LDAModel, LocalLDAModel
from pyspark.sql import DataFrame, SparkSession

from . import base


def _named(fn) -> str:
    """module:name of a function that can be found by them."""
    module, name = getattr(fn, "__module__", None), getattr(fn, "__qualname__", "")
    found = getattr(importlib.import_module(module), name, None) if module and name.isidentifier() and module != "__main__" else None
    if found is not fn:
        raise ValueError(f"{fn!r} can't be saved: only functions at the top of an importable module can")
    return f"{module}:{name}"


class _Writer:
    def __init__(self, path: str):
        self.path, self.n = path, 0

    def part(self) -> str:
        self.n += 1
        return f"part-{self.n}"

    def put(self, v):
        if v is None or isinstance(v, (bool, int, str)):
            return v
        if isinstance(v, float):
            return {"float": repr(v)}
        if isinstance(v, bytes):
            return {"bytes": base64.b64encode(v).decode()}
        if isinstance(v, (list, tuple)):
            return {type(v).__name__: [self.put(x) for x in v]}
        if isinstance(v, dict):
            return {"dict": [[self.put(k), self.put(x)] for k, x in v.items()]}
        if isinstance(v, np.ndarray):
            return {"array": [list(v.shape), str(v.dtype), base64.b64encode(np.ascontiguousarray(v).tobytes()).decode()]}
        if isinstance(v, DataFrame):
            name = self.part()
            v.write.parquet(f"{self.path}/{name}")
            return {"table": name}
        if isinstance(v, LDAModel):
            name = self.part()
            v.save(f"{self.path}/{name}")
            return {"local" if isinstance(v, LocalLDAModel) else "distributed": name}
        return {"function": _named(v)}


class _Reader:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, v):
        if not isinstance(v, dict):
            return v
        (kind, x), = v.items()
        if kind == "function":
            module, name = x.split(":")
            return getattr(importlib.import_module(module), name)
        if kind == "array":
            return np.frombuffer(base64.b64decode(x[2]), x[1]).reshape(x[0]).copy()
        return {
            "float": float, "bytes": base64.b64decode, "list": lambda x: [self.get(y) for y in x], "tuple": lambda x: tuple(self.get(y) for y in x), "dict": lambda x: {self.get(k): self.get(y) for k, y in x},
            "table": lambda x: self.spark.read.parquet(f"{self.path}/{x}"), "local": lambda x: LocalLDAModel.load(f"{self.path}/{x}"), "distributed": lambda x: DistributedLDAModel.load(f"{self.path}/{x}"),
        }[kind](x)


def save(fitted: base.FittedPipeline, spark: SparkSession, path: str) -> None:
    out, steps = _Writer(path), []
    for f in fitted.steps:
        # the columns are resolved by now, and a table that was learnt isn't needed twice
        own = {x.name: getattr(f.step, x.name) for x in dataclasses.fields(f.step)} | {"columns": list(f.names)}
        if "matrix" in f.learnt:
            own["embeddings"] = None
        steps.append({"step": _named(type(f.step)), "own": out.put(own), "names": list(f.names), "learnt": out.put(f.learnt)})
    spark.createDataFrame([(json.dumps(steps),)], "value string").coalesce(1).write.text(f"{path}/steps")


def load(spark: SparkSession, path: str) -> base.FittedPipeline:
    rows, src = spark.read.text(f"{path}/steps", wholetext=True).collect(), _Reader(spark, path)
    made = []
    for s in json.loads(rows[0][0]):
        module, name = s["step"].split(":")
        step = getattr(importlib.import_module(module), name)(**src.get(s["own"]))
        made.append(base.Fitted(step, tuple(s["names"]), src.get(s["learnt"])))
    return base.FittedPipeline(tuple(made), None)
