"""Entity filters as columns and semi-joins: identifiers, types, scopes, attributes, time."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.sources.model import NONE


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def live() -> Column:
    """Not soft-deleted."""
    return F.col("deleted_at").isNull()


def with_ids(ids: Iterable[str]) -> Column:
    return F.col("entity_id").isin(list(ids))


def id_pattern(pattern: str) -> Column:
    """The pattern occurs somewhere in the id."""
    return F.col("entity_id").rlike(pattern)


def has_type(*types: str) -> Column:
    """Any of the types; combine with & and | for the full algebra. ``*`` is any type."""
    return F.lit(True) if "*" in types else F.arrays_overlap("types", F.array(*[F.lit(t) for t in types]))


def in_scope(pattern: str) -> Column:
    """A scope equals the pattern, where ``+`` stands for one level and a trailing ``#`` for anything that follows.

    Entities without a scope never match; both wildcards may be used together.
    """
    prefix = pattern.endswith("#")
    body = pattern[:-1] if prefix else pattern
    parts = [r"\w+".join(_quoted(x) for x in body.split("+"))]
    rx = "^" + parts[0] + ("" if prefix else "$")
    return F.coalesce(F.exists("scopes", lambda s: s.rlike(rx)), F.lit(False))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in text)


def selected(selectors: list[dict]) -> Column:
    """Any of the selectors ``{id?, pattern?, types?}``; each selector is a conjunction, in brackets of its own."""
    tests = []
    for s in selectors:
        parts = [has_type(*s["types"])] if s.get("types") else []
        parts += [F.col("entity_id") == s["id"]] if s.get("id") else []
        parts += [id_pattern(s["pattern"])] if s.get("pattern") else []
        tests.append(all_of(*parts))
    return any_of(*tests)


def with_any_attribute(entity: DataFrame, attribute: DataFrame, names: Iterable[str]) -> DataFrame:
    """Entities that have a live value of one of the attributes: a semi-join, so no entity is repeated."""
    return entity.join(attribute.where(live() & F.col("attribute_name").isin(list(names))), "entity_id", "left_semi")


def in_dataset(datasets: Iterable[str]) -> Column:
    """The dataset is one of those named, ``@none`` for the default instance."""
    named = list(datasets)
    test = F.col("dataset_id").isin([d for d in named if d != NONE])
    return F.coalesce(test, F.lit(False)) | F.col("dataset_id").isNull() if NONE in named else F.coalesce(test, F.lit(False))


def in_time(relation: str, at: str, until: str | None = None, column: str = "time") -> Column:
    """``before`` < at; ``after`` >= at; ``between`` [at, until)."""
    t, lo = F.col(column), F.lit(at).cast("timestamp")
    if relation == "before":
        return t < lo
    if relation == "after":
        return t >= lo
    if relation == "between" and until is not None:
        return (t >= lo) & (t < F.lit(until).cast("timestamp"))
    raise ValueError(f"time relation {relation!r} needs one of before, after, between (with an end)")


def existing(wanted: DataFrame, entity: DataFrame) -> DataFrame:
    return wanted.join(entity.where(live()).select("entity_id"), "entity_id", "left_semi")


def missing(wanted: DataFrame, entity: DataFrame) -> DataFrame:
    return wanted.join(entity.where(live()).select("entity_id"), "entity_id", "left_anti")


def expired(rows: DataFrame, now: str) -> DataFrame:
    """Live rows whose time to live has passed."""
    return rows.where(live() & (F.col("expires_at") < F.lit(now).cast("timestamp")))


def valid_name(name: Column) -> Column:
    """A name of an attribute or type without the characters that names can't have."""
    return F.coalesce((F.length(name) > 0) & ~name.rlike(r"[\s<>\"'=;()\[\]{},|]"), F.lit(False))
