"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where the session
    names none, a session within one process gets a local one; on a cluster
    that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Shelf:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs only the tasks of
    the stage at hand. ``drop`` deletes a table that nothing reads any more; what
    a lazy result still reads goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        name = f"{self.root}/{self.n:04d}"
        df.write.parquet(name)
        if self.n == 1:
            path, files = self._path(self.root)
            files.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(name)
        out._quill_path = name
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, files = self._path(table._quill_path)
            files.delete(path, True)


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 500):
    """The batches in smaller pieces, so that what a task holds at once stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


_HELD: dict = {}


def held(make, *key):
    """make(*key), made once in a Python worker and kept for its later tasks."""
    if (make, key) not in _HELD:
        _HELD[make, key] = make(*key)
    return _HELD[make, key]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def runs_of(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)
