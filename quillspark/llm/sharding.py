"""Operator 1, sharding by sampled splitters. DataFrame and SQL functions only.

1. A key table (a few dozen bytes a row) is written once; the texts are read
   only for it. The key is (hash of the text, hash of doc_id and row), so equal
   texts lie next to each other and a hot text can still be divided.
2. A Bernoulli sample is drawn with a probability in proportion to a row's
   weight: its size plus the mean size, so that neither bytes nor rows pile up
   in one range. Its expected count is SAMPLES_PER_RANGE for each range, which
   is all that the driver gets.
3. Quantiles of the sample are the boundaries of many small ranges. Ranges
   found to hold over twice their share are sampled again and subdivided.
4. Ranges are dealt to shards by their exact bytes, the largest first, each to
   the shard that has the least so far; slots are the rank inside the range plus
   the rows of the shard's earlier ranges.

Law: ``bytes``. No shard has more than the mean and one range, and a range is
either a small part of a shard or a single document.

Null text: 16 bytes, crc32 of no bytes (0). Repeated rows, and rows without an id,
each get a slot. Empty table: an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf

RANGES_PER_SHARD = 96
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000
SAMPLES_PER_RANGE = 16
ROUNDS = 6


def _uniform(seed: int):
    """A number in (0, 1) that a row keeps on every retry."""
    return (F.pmod(F.xxhash64("k2", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table, as a literal in the plan."""
    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{schema}>>'))", args={"rows": json.dumps(rows)})


def _with_range(keys: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``rid``, the number of splitters at or below the row's key.

    A row compares itself with the few splitters of its own hash bucket only;
    where one text owns many splitters its rows are bucketed by the second hash.
    Both lookup tables have at most some rows for each splitter, so at most a
    few times MAX_RANGES, and are broadcast.
    """
    spark = keys.sparkSession
    per: dict[int, int] = {}
    for h, _ in splitters:
        per[h] = per.get(h, 0) + 1
    hot = {h: max(1, n.bit_length()) for h, n in per.items() if n >= 8}
    rows = []
    for b in range(-2048, 2048):
        lo, hi = bisect_right(splitters, ((b << 52) - 1, 1 << 63)), bisect_right(splitters, (((b + 1) << 52) - 1, 1 << 63))
        rows.append((b, None, lo, lo, hi))
    for h, bits in hot.items():
        for b in range(-(1 << bits - 1), 1 << bits - 1):
            width = 64 - bits
            lo = bisect_right(splitters, (h, (b << width) - 1))
            hi = bisect_right(splitters, (h, ((b + 1) << width) - 1))
            rows.append((h, b, lo, lo, hi))
    near = _table(spark, [{"c1": c1, "c2": c2, "base": base, "cuts": [{"h": h, "k2": k} for h, k in splitters[lo:hi]]} for c1, c2, base, lo, hi in rows], "c1:bigint,c2:bigint,base:int,cuts:array<struct<h:bigint,k2:bigint>>")
    bits = _table(spark, [{"h": h, "bits": b} for h, b in hot.items()], "h:bigint,bits:int")
    if hot:
        keys = keys.join(F.broadcast(bits), "h", "left")
    else:
        keys = keys.withColumn("bits", F.lit(None).cast("int"))
    c2 = F.expr("CASE WHEN bits IS NULL THEN -9223372036854775808L ELSE shiftright(k2, 64 - bits) END")
    keys = keys.withColumns({"c1": F.expr("CASE WHEN bits IS NULL THEN shiftright(h, 52) ELSE h END"), "c2": c2})
    near = near.withColumn("c2", F.coalesce("c2", F.lit(-(1 << 63))))
    below = F.size(F.filter("cuts", lambda s: (s.h < F.col("h")) | ((s.h == F.col("h")) & (s.k2 <= F.col("k2")))))
    return keys.join(F.broadcast(near), ["c1", "c2"]).withColumn("rid", F.col("base") + below).drop("c1", "c2", "bits", "base", "cuts")


def _cut(sample: list[tuple[int, int, float]], unit: float) -> list[tuple[int, int]]:
    """Every ``unit`` of the sample's weight one boundary."""
    cuts, got = [], 0.0
    for h, k2, w in sorted(sample):
        got += w
        if got >= unit:
            cuts.append((h, k2))
            got = 0.0
    return cuts


def shard(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = shelf.put(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("m"),
        ).withColumn("k2", F.xxhash64("doc_id", "m")).drop("m")
    )
    n, total = keys.agg(F.count("*"), F.sum("size")).first()
    if not n:
        empty = F.lit(None)
        return keys.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), empty.cast("int").alias("shard"), empty.cast("long").alias("slot"), empty.cast("int").alias("grown_shard"))
    ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * shards, n // ROWS_PER_RANGE))
    mean = total / n
    share = 2 * total / ranges  # of the weight, which is twice the bytes in all
    weight = F.col("size") + F.lit(mean)
    per = share / SAMPLES_PER_RANGE

    def drawn(df: DataFrame, per: float, seed: int) -> list[tuple[int, int, float]]:
        taken = df.withColumn("w", weight).where(_uniform(seed) < F.col("w") / F.lit(per)).select("h", "k2", F.greatest("w", F.lit(per)).alias("w"))
        return [tuple(r) for r in taken.collect()]

    splitters = _cut(drawn(keys, per, seed), share)
    for step in range(ROUNDS):
        ranged = _with_range(keys, splitters)
        held = {r.rid: r for r in ranged.groupBy("rid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        over = [i for i, r in held.items() if r["bytes"] + r["rows"] * mean > 2 * share and r["rows"] > 1]
        if not over or step == ROUNDS - 1:
            break
        finer = _cut(drawn(ranged.where(F.col("rid").isin(over)), per / 4, seed + step + 1), share / 2)
        if set(finer) <= set(splitters):
            break
        splitters = sorted({*splitters, *finer})
    placed, rows_in = [], [0] * shards
    least = [(0, k) for k in range(shards)]  # bytes so far
    for i in sorted(held, key=lambda i: (-held[i]["bytes"], i)):
        size, to = heapq.heappop(least)
        heapq.heappush(least, (size + held[i]["bytes"], to))
        placed.append({"rid": i, "shard": to, "first": rows_in[to]})
        rows_in[to] += held[i]["rows"]
    place = _table(spark, placed, "rid:int,shard:int,first:bigint")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("h", "k2"))
    out = ranged.withColumn("rank", rank).join(F.broadcast(place), "rid")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
