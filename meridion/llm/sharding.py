"""Sharding by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meridion.llm.common import materialise

LOW, HIGH = -(2**63), 2**63


def literal_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from the driver as one literal, so that its size is known to the planner."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def sized(df: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        # Tells rows apart that agree in id and text; fixed once the rows are kept.
        F.monotonically_increasing_id().alias("tie"),
    )


def quantiles(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """Splitters at the weighted quantiles of (key, weight) samples."""
    sample = sorted(sample)
    total = sum(w for _, w in sample)
    out: list[int] = []
    run, want = 0.0, 1
    for key, weight in sample:
        run += weight
        while want < ranges and run >= total * want / ranges:
            if not out or out[-1] < key:
                out.append(key)
            want += 1
    return out


def in_range(groups: DataFrame, splitters: list[int]) -> DataFrame:
    """``groups`` with the number ``cell`` of the range its key lies in.

    The intervals are matched through the keys' top bits: an interval stands once for each prefix it touches, at most
    2^bits + intervals rows in all, and a key meets the one or two intervals of its prefix.
    """
    spark = groups.sparkSession
    edges = [LOW, *splitters, HIGH]
    bits = max(4, min(20, math.ceil(math.log2(len(edges))) + 2))
    rows = [{"cell": i, "lo": lo, "hi": hi - 1} for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    table = literal_rows(spark, rows, "cell int, lo bigint, hi bigint")
    coarse = lambda c: F.shiftright(c, 64 - bits)
    spread = table.withColumn("prefix", F.explode(F.sequence(coarse(F.col("lo")), coarse(F.col("hi")))))
    return groups.withColumn("prefix", coarse(F.col("key"))).join(spread, "prefix").where("key between lo and hi").drop("prefix", "lo", "hi")


def least_loaded(pieces: list[tuple[int, int, int]], shards: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Pieces (bytes, key, salt) to shards, largest first, each to the shard that holds least."""
    loads = [0] * shards
    out = {}
    for size, key, salt in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        s = min(range(shards), key=lambda i: (loads[i], i))
        out[key, salt] = s
        loads[s] += size
    return out, loads


def level_for(loads: list[int], rest: float) -> float:
    """The level to which shards rise when ``rest`` is poured into those that hold least."""
    heights = sorted(loads)
    run = 0.0
    for n, h in enumerate(heights, 1):
        run += h
        level = (rest + run) / n
        if n == len(heights) or level <= heights[n]:
            return level
    return rest


def _place(bounds: list[float], at: Column) -> Column:
    """Which of the consecutive intervals between ``bounds`` the position lies in."""
    return sum((F.when(at >= F.lit(float(b)), 1).otherwise(0) for b in bounds), F.lit(0))


def shard(
    df: DataFrame, shards: int = 24, overhead: int = 8, ranges: int = 384, oversample: int = 8, rows_per_range: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` with shards of near equal bytes (law ``bytes``).

    Equal texts stay in one shard, unless a group of them is larger than a shard. Steps:

    1. Sizes and the text's hash, the key, are computed once and kept; sums per key combine before the shuffle, so a text
       that is a third of all rows is one number.
    2. Heavy keys, over a fiftieth of a shard in bytes or rows (so at most 50 of either kind for each shard), go to the shard
       that holds least, largest first. One above a whole shard is subdivided by a running number of its rows, counted in
       buckets, so repeated rows of one id and text are dealt out like any others.
    3. Light keys are sampled with a probability in proportion to their bytes, by the hash of the key; weighted quantiles of
       the sample are the splitters of a fixed number of ranges; a range over twice its share is subdivided until none is.
    4. Exact bytes of each range and running sums inside it give each key's place in the whole; shard borders lie where the
       shards, with their heavy keys, come out equal. Ranges of many keys are cut by a hash of the key first, so that no
       window is larger than about ``rows_per_range`` whatever the number of texts.
    5. Slots count rows within a range and shard, plus the rows of the ranges before it in the shard.

    The driver holds the sample (``oversample`` keys a range), a sum for each range and the heavy keys; all are bounded by
    the parameters, not by the table.

    A null text has size ``overhead`` and crc 0; null texts are equal to each other. Null ids are sharded like others.
    Very long texts are heavy keys. Repeated rows are rows of their own with slots of their own. An empty table gives an
    empty result. Other columns are not read, so their names can't clash.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    rec = materialise(sized(df, id_col, text_col, overhead))
    groups = materialise(rec.groupBy("key").agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("rows")))
    whole = groups.agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).first()
    total, total_rows = whole["b"] or 0, whole["r"] or 0
    share = total / shards
    limit = share / 50
    most_rows = max(rows_per_range, total_rows / shards / 50)

    is_heavy = (F.col("bytes") > limit) | (F.col("rows") > most_rows)
    heavy = [(r["key"], r["bytes"], r["rows"]) for r in groups.where(is_heavy).select("key", "bytes", "rows").collect()]
    light = groups.where(~is_heavy)
    light_total = total - sum(b for _, b, _ in heavy)
    light_rows = total_rows - sum(n for _, _, n in heavy)
    subs = max(1, math.ceil(2 * light_rows / (ranges * rows_per_range)))
    range_bytes = max(1.0, light_total / ranges, share / 16)

    # Heavy keys: parts of at most a sixteenth of a shard where the key is above a shard, and cells of the size of a range.
    parts = [{"key": k, "parts": math.ceil(16 * b / share) if b > share else 1, "rows": n, "buckets": math.ceil(n / rows_per_range)} for k, b, n in heavy]
    heavy_rows = None
    if heavy:
        dealt = rec.join(literal_rows(spark, parts, "key bigint, parts bigint, rows bigint, buckets bigint"), "key")
        dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("tie"), F.col("buckets")))
        before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        bases = dealt.groupBy("key", "bucket").count().select("key", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
        number = F.row_number().over(W.partitionBy("key", "bucket").orderBy("__id", "tie")) - 1
        counted = dealt.withColumn("number", number).join(bases, ["key", "bucket"]).withColumn("number", F.col("base") + F.col("number"))
        heavy_rows = materialise(counted.withColumn("salt", F.floor(F.col("number") * F.col("parts") / F.col("rows")).cast("int")).drop("base", "bucket", "buckets"))
    pieces = [(r["b"], r["key"], r["salt"], r["n"]) for r in heavy_rows.groupBy("key", "salt").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()] if heavy else []
    placed, loads = least_loaded([p[:3] for p in pieces], shards)

    # Light keys: sampled splitters, then subdivision of what is overfull.
    step = max(1.0, light_total / (ranges * oversample))
    chance = F.least(F.col("bytes") / F.lit(step), F.lit(1.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit(7)), 11).cast("double") / F.lit(float(2**53))
    sample = [(r["key"], max(step, r["bytes"])) for r in light.where(draw < chance).select("key", "bytes").collect()]
    splitters = quantiles(sample, ranges)
    while True:
        sums = {r["cell"]: r["b"] for r in in_range(light, splitters).groupBy("cell").agg(F.sum("bytes").alias("b")).collect()}
        edges = [LOW, *splitters, HIGH]
        more = [
            lo + (hi - lo) * j // n
            for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))
            if (b := sums.get(i, 0)) > 2 * max(range_bytes, limit) and (n := math.ceil(b / range_bytes)) > 1 and hi - lo > n
            for j in range(1, n)
        ]
        if not more:
            break
        splitters = sorted({*splitters, *more})
    n_cells = len(splitters) + 1

    level = level_for(loads, light_total)
    bounds, run = [], 0.0
    for held in loads[:-1]:
        run += max(0.0, level - held)
        bounds.append(run)
    bases, before = [], 0
    for i in range(n_cells):
        bases.append({"cell": i, "base": before})
        before += sums.get(i, 0)
    fine = in_range(light, splitters).withColumn("sub", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(subs)))
    earlier = W.partitionBy("cell").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    sub_sums = fine.groupBy("cell", "sub").agg(F.sum("bytes").alias("b")).select("cell", "sub", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("start"))
    here = F.col("base") + F.col("start") + F.coalesce(F.sum("bytes").over(W.partitionBy("cell", "sub").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    light_keys = (
        fine.join(literal_rows(spark, bases, "cell int, base bigint"), "cell")
        .join(sub_sums, ["cell", "sub"])
        .withColumn("middle", here + F.col("bytes") / 2)
        .select("key", (F.col("cell") * F.lit(subs) + F.col("sub")).cast("long").alias("cell"), _place(bounds, F.col("middle")).cast("int").alias("shard"))
    )
    columns = ["__id", "size", "text_crc32", "key", "tie", "cell", "shard"]
    # Light keys only; heavy keys are joined by a list of at most 100 for each shard.
    out = rec.join(light_keys, "key").select(*columns)
    if heavy:
        cells: list[dict] = []
        at = n_cells * subs
        for size, key, salt, count in sorted(pieces, key=lambda p: (p[1], p[2])):
            n = max(math.ceil(size / range_bytes), math.ceil(count / rows_per_range))
            cells.append({"key": key, "salt": salt, "shard": placed[key, salt], "first": at, "cells": n})
            at += n
        spread = F.pmod(F.col("number"), F.col("cells"))
        listed = literal_rows(spark, cells, "key bigint, salt int, shard int, first bigint, cells bigint")
        out = out.unionByName(heavy_rows.join(listed, ["key", "salt"]).withColumn("cell", F.col("first") + spread).select(*columns))

    counts = out.groupBy("shard", "cell").count()
    before_cell = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before_cell), F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", "__id", "tie")) - 1
    return (
        out.withColumn("within", within)
        .join(offsets, ["shard", "cell"])
        .select(
            F.col("__id").cast(kind).alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
