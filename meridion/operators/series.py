"""Series: time-bucketed and whole-range aggregates by value type, last-N, paging ranges, representations."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridion.functions.time import Period, bucket_end, bucket_start

Method = Callable[[Column], Column]

_COUNTS: dict[str, Method] = {"totalCount": F.count, "distinctCount": F.countDistinct}


def _seconds_to_time(s: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.round(s)), "HH:mm:ss")


def _time_of_day(v: Column) -> Column:
    parts = F.split(v, ":")
    return F.get(parts, F.lit(0)).cast("long") * 3600 + F.get(parts, F.lit(1)).cast("long") * 60 + F.coalesce(F.try_to_number(F.substring(F.get(parts, F.lit(2)), 1, 2), F.lit("99")).cast("long"), F.lit(0))


#: What each value type can be asked for; anything else is null.
METHODS: dict[str, dict[str, Method]] = {
    "NUMBER": _COUNTS | {
        "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": lambda v: F.round(F.stddev_samp(v), 10), "sumsq": lambda v: F.sum(v * v),
    },
    "STRING": _COUNTS | {"min": F.min, "max": F.max},
    "BOOLEAN": _COUNTS | {
        "sum": lambda v: F.sum(v.cast("int")), "avg": lambda v: F.round(F.avg(v.cast("int")), 5), "min": lambda v: F.min(v.cast("int")), "max": lambda v: F.max(v.cast("int")),
        "stddev": lambda v: F.stddev_samp(v.cast("int")), "sumsq": lambda v: F.sum(v.cast("int")),
    },
    "ARRAY": _COUNTS | {"sum": lambda v: F.sum(F.size(v)), "avg": lambda v: F.round(F.avg(F.size(v)), 5), "min": lambda v: F.min(F.size(v)), "max": lambda v: F.max(F.size(v))},
    "OBJECT": dict(_COUNTS),
    "DATETIME": _COUNTS | {"min": F.min, "max": F.max},
    "DATE": _COUNTS | {"min": F.min, "max": F.max},
    "TIME": _COUNTS | {"avg": lambda v: _seconds_to_time(F.avg(_time_of_day(v))), "min": F.min, "max": F.max},
    "URI": dict(_COUNTS),
    "GEOMETRY": {},
    "JSON": {},
}


def _aggregates(value: str, value_type: str, methods: Iterable[str]) -> list[Column]:
    known = METHODS[value_type]
    return [(known[m](F.col(value)) if m in known else F.lit(None).cast("double")).alias(m) for m in methods]


def bucketed(series: DataFrame, methods: Iterable[str], length: Period, value: str = "measured_value", value_type: str = "NUMBER", origin: Column | None = None, zone: str = "UTC", keys: tuple[str, ...] = ("entity_id", "attribute_name")) -> DataFrame:
    """Aggregates per series and time bucket, with the bucket's ``start`` and ``end``; empty buckets are absent.

    All methods come from one grouping, whose sums combine before the shuffle.
    """
    start = bucket_start(F.col("time"), length, origin, zone)
    rows = series.withColumn("start", start)
    grouped = rows.groupBy(*keys, "start").agg(*_aggregates(value, value_type, methods))
    return grouped.withColumn("end", bucket_end(F.col("start"), length))


def whole_range(series: DataFrame, methods: Iterable[str], value: str = "measured_value", value_type: str = "NUMBER", keys: tuple[str, ...] = ("entity_id", "attribute_name")) -> DataFrame:
    """Aggregates per series over all its points; ``start`` and ``end`` are the first and last of them."""
    return series.groupBy(*keys).agg(*_aggregates(value, value_type, methods), F.min("time").alias("start"), F.max("time").alias("end"))


def oldest(series: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The time of the first point: the origin of buckets when none is given."""
    return series.groupBy(*keys).agg(F.min("time").alias("origin"))


def newest(series: DataFrame, n: int, keys: tuple[str, ...] = ("entity_id", "attribute_name"), by: tuple[str, ...] = ("time", "instance_id")) -> DataFrame:
    """The last ``n`` points of each series; the planner limits each group before the shuffle."""
    order = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in by])
    return series.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def first_points(series: DataFrame, n: int, keys: tuple[str, ...] = ("entity_id", "attribute_name"), by: tuple[str, ...] = ("time", "instance_id")) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(*by)
    return series.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def current_and_history(series: DataFrame, keys: tuple[str, ...] = ("entity_id", "attribute_name")) -> DataFrame:
    """Every point with ``is_current``: the newest of its series is the state, the others are history."""
    order = W.partitionBy(*keys).orderBy(F.col("time").desc(), F.col("instance_id").desc())
    return series.withColumn("is_current", F.row_number().over(order) == 1)


def page_range(series: DataFrame, limit: int, last_n: bool = False, relation: str | None = None, at: str | None = None, until: str | None = None, keys: tuple[str, ...] = ("entity_id", "attribute_name")) -> DataFrame:
    """``(range_start, range_end)`` common to all series when some of them reach the limit; no row when none does."""
    full = series.groupBy(*keys).agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last")).where(F.col("n") >= limit)
    t, t2 = F.lit(at).cast("timestamp"), F.lit(until).cast("timestamp")
    if not last_n:
        start = t if relation in ("after", "between") else F.min("first")
        end = F.min("last")
    else:
        start = t if relation == "before" else t2 if relation == "between" else F.max("last")
        end = F.max("first")
    return full.agg(start.alias("range_start"), end.alias("range_end"), F.count("*").alias("n")).where("n > 0").drop("n")


def paged(series: DataFrame, page: DataFrame) -> DataFrame:
    """Points inside the range, whichever end comes first; all of them if there is no range. The range is one row."""
    bounds = page.select(F.least("range_start", "range_end").alias("__lo"), F.greatest("range_start", "range_end").alias("__hi"))
    some = F.broadcast(bounds.agg(F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi")))
    joined = series.join(some, F.lit(True))
    return joined.where(F.col("__lo").isNull() | F.col("time").between(F.col("__lo"), F.col("__hi"))).select(*series.columns)


def value_pairs(series: DataFrame, keys: tuple[str, ...] = ("entity_id", "attribute_name"), value: str = "measured_value") -> DataFrame:
    """Simplified representation: per series ``[(value, time), ...]`` in order of time."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("time"), F.col(value).alias("value"))))
    return series.groupBy(*keys).agg(F.transform(pairs, lambda p: F.struct(p["value"], p["time"])).alias("values"))


def method_series(buckets: DataFrame, methods: Iterable[str], keys: tuple[str, ...] = ("entity_id", "attribute_name")) -> DataFrame:
    """Aggregated representation: per series and method ``[(value, start, end), ...]`` in order of time."""
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("value")) for m in methods])
    rows = buckets.select(*keys, "start", "end", F.explode(entries).alias("e"))
    triples = F.sort_array(F.collect_list(F.struct("start", "end", F.col("e.value").alias("value"))))
    return rows.groupBy(*keys, F.col("e.method").alias("method")).agg(triples.alias("values"))


def normalized(series: DataFrame, keys: tuple[str, ...] = ("entity_id", "attribute_name")) -> DataFrame:
    """Normalized temporal representation: per series its instances in order of time."""
    entry = F.struct("time", "instance_id", F.col("measured_value").alias("value"))
    return series.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("instances"))
