"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridion.llm.common import fresh, materialise

#: Fixed value: what separates words (space and the five control characters from tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"

#: Sources up to this number are broadcast when a corpus is mixed.
MOST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from the columns' text and a seed: 52 bits of an md5, the same in any SQL engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``: shares by repeating weights, capped at ``most`` times.

    Sources in code-point order, null last, take the weights in turn. The targets share the sum of all sizes by weight; a
    target stops at ``most`` times its source's size and its excess goes to the others by weight until none is above. That
    limit is found without iterating: with sources in the order of size over weight, the capped ones are the beginning of
    the list up to the first source whose share of what is left stays below its cap. The windows run over one row per
    source, after the sums; they hold one row at a time.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("size_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("size_left") / F.col("weight_left"))
        .withColumn("above", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # Levels rise along the capped sources and fall along the free ones, so the highest free one is that at the first source
    # that stays below its cap: the level to which all free sources rise.
    free = ranked.withColumn("rise", F.max(F.when(~F.col("above"), F.col("level"))).over(whole))
    target = F.when(F.col("above") | F.col("rise").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rise") * F.col("weight")))
    return free.select("source", "source_size", target.alias("target"))


def mixing_plan(df: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, source_size, target, copies)`` for every document.

    A source's rate is its target over its size. A document is taken floor(rate) times, and once more when the seeded hash
    of its id lies below the fraction of the rate; rate never exceeds ``most``, so neither do the copies. The same table
    and seed give the same plan on every run and partitioning.

    A null source is a source of its own, in the last place. A null or empty text has size 0 and follows its source's
    rate; a source of size 0 has target 0 and no copies. Repeated rows share their id's hash, so all or none get the extra
    copy. Other columns are not read. An empty table gives an empty result.

    Sums combine before the shuffle, so a source with a third of all rows costs no more than another. The join to one row
    per source is left to the planner, which broadcasts it only below its size limit and splits skewed keys otherwise.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialise(rows)  # words are counted once; a row is a few dozen bytes
    targets = source_targets(rows, weights, most).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return (
        rows.join(targets, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (unit_hash(seed, F.col("__id")) < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", "copies")
    )


def mix(df: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``df``, all columns as they are, as often as ``mixing_plan`` says.

    Only the few numbers of each source are joined to the rows. Up to ``MOST_SOURCES`` sources they are broadcast (about 50
    bytes each) and no text is shuffled; more are joined by the planner's choice. Nulls, empty and very long texts, ties and
    repeated rows are as in ``mixing_plan``; the columns of ``df`` may have any names.
    """
    source, rate, copy = (fresh(c, df.columns) for c in ("source", "rate", "copy"))
    sizes = df.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = source_targets(sizes, weights, most).select(
        F.col("source").alias(source),
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)).alias(rate),
    )
    targets = materialise(targets)
    targets = F.broadcast(targets) if targets.count() <= MOST_SOURCES else targets
    extra = (unit_hash(seed, F.col(id_col)) < F.col(rate) - F.floor(rate)).cast("int")
    copies = F.floor(rate).cast("int") + extra
    return (
        df.join(targets, F.col(source_col).cast("string").eqNullSafe(F.col(source)))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


#: The contract's answer in DuckDB SQL; the targets there come from trying every level, not from the running sums.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s
), v AS (
  SELECT a.source, a.source_size, a.weight, a.cap,
         (a.total - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0.0))
           / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level
  FROM c a, c b GROUP BY a.source, a.source_size, a.weight, a.cap, a.total
), t AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap OR rise IS NULL THEN cap ELSE least(cap, rise * weight) END AS target
  FROM (SELECT *, max(CASE WHEN level * weight < cap THEN level END) OVER () AS rise FROM v)
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT
         + CASE WHEN (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0
                     < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
