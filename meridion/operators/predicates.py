"""Attribute predicates: sets of entity ids from attribute rows, combined by semi- and anti-joins.

A predicate is built from Python operators, ``(value("balance") > 10) & ~present("segment")``, and applied with ``where``.
Comparisons look at all values of an attribute: they hold when some value satisfies them, and never for an entity without the
attribute, ``!=`` included; ``unlike`` alone is the negation of ``like`` and holds for a missing attribute. Times are
compared as their ISO texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.operators.filters import live


@dataclass(frozen=True)
class Predicate:
    """``test`` picks attribute rows; ``how`` says whether entities with such a row stay or go; or a combination."""

    test: Column | None = None
    how: str = "left_semi"
    parts: tuple[Predicate, ...] = ()
    joined: str = ""

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(parts=(self, other), joined="and")

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(parts=(self, other), joined="or")

    def __invert__(self) -> Predicate:
        if self.joined:
            flipped = "or" if self.joined == "and" else "and"
            return Predicate(parts=tuple(~p for p in self.parts), joined=flipped)
        return Predicate(self.test, "left_anti" if self.how == "left_semi" else "left_semi")


@dataclass(frozen=True)
class Value:
    """An attribute, perhaps of one dataset or one language, to compare with literals."""

    name: str
    dataset: str | None = None
    lang: str | None = None
    rename: dict[str, str] = field(default_factory=dict)

    def _rows(self) -> Column:
        test = F.col("attribute_name") == self.name
        if self.dataset is not None:
            test = test & F.col("dataset_id").eqNullSafe(F.lit(None if self.dataset == "@none" else self.dataset))
        return test & (F.col("lang") == self.lang) if self.lang is not None else test

    def _column(self, literal: object) -> tuple[Column, Column]:
        if isinstance(literal, bool) or not isinstance(literal, int | float):
            return F.col("str"), F.lit(self.rename.get(str(literal), str(literal)))
        return F.col("num"), F.lit(float(literal))

    def _compare(self, literal: object, op: Callable[[Column, Column], Column]) -> Predicate:
        column, value = self._column(literal)
        return Predicate(self._rows() & F.coalesce(op(column, value), F.lit(False)))

    def __eq__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._compare(other, lambda a, b: a == b)

    def __ne__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._compare(other, lambda a, b: a != b)

    def __lt__(self, other: object) -> Predicate:
        return self._compare(other, lambda a, b: a < b)

    def __le__(self, other: object) -> Predicate:
        return self._compare(other, lambda a, b: a <= b)

    def __gt__(self, other: object) -> Predicate:
        return self._compare(other, lambda a, b: a > b)

    def __ge__(self, other: object) -> Predicate:
        return self._compare(other, lambda a, b: a >= b)

    def __hash__(self) -> int:
        return hash(self.name)

    def between(self, low: object, high: object) -> Predicate:
        """Inclusive at both ends."""
        column, lo = self._column(low)
        return Predicate(self._rows() & F.coalesce(column.between(lo, self._column(high)[1]), F.lit(False)))

    def outside(self, low: object, high: object) -> Predicate:
        column, lo = self._column(low)
        return Predicate(self._rows() & F.coalesce((column < lo) | (column > self._column(high)[1]), F.lit(False)))

    def one_of(self, *literals: object) -> Predicate:
        column, _ = self._column(literals[0])
        return Predicate(self._rows() & F.coalesce(column.isin([self._column(x)[1] for x in literals]), F.lit(False)))

    def none_of(self, *literals: object) -> Predicate:
        """Some value is none of them."""
        column, _ = self._column(literals[0])
        return Predicate(self._rows() & F.coalesce(~column.isin([self._column(x)[1] for x in literals]), F.lit(False)))

    def like(self, pattern: str) -> Predicate:
        """A text value contains the pattern; ``(?i)`` for any case."""
        return Predicate(self._rows() & F.coalesce(F.col("str").rlike(pattern), F.lit(False)))

    def unlike(self, pattern: str) -> Predicate:
        return ~self.like(pattern)


def value(name: str, dataset: str | None = None, lang: str | None = None, rename: dict[str, str] | None = None) -> Value:
    return Value(name, dataset, lang, rename or {})


def present(name: str) -> Predicate:
    return Predicate(F.col("attribute_name") == name)


def where(entity: DataFrame, attribute: DataFrame, predicate: Predicate) -> DataFrame:
    """Entities for which the predicate holds.

    All comparisons are evaluated in one pass over the attribute rows: each is a flag, the flags of an entity are or-ed by
    a grouping that combines before the shuffle, and one join brings them to the entities. A conjunction of plain
    comparisons on one attribute therefore costs no more than one.
    """
    leaves: list[Predicate] = []

    def formula(p: Predicate) -> Column:
        if p.joined:
            a, b = (formula(q) for q in p.parts)
            return a & b if p.joined == "and" else a | b
        leaves.append(p)
        flag = F.coalesce(F.col(f"__q{len(leaves) - 1}"), F.lit(False))
        return flag if p.how == "left_semi" else ~flag

    test = formula(predicate)
    if len(leaves) == 1:
        return entity.join(attribute.where(live() & leaves[0].test).select("entity_id"), "entity_id", leaves[0].how)
    flags = attribute.where(live()).select("entity_id", *[p.test.alias(f"__q{i}") for i, p in enumerate(leaves)])
    some = flags.where(" or ".join(f"__q{i}" for i in range(len(leaves))))
    found = some.groupBy("entity_id").agg(*[F.bool_or(f"__q{i}").alias(f"__q{i}") for i in range(len(leaves))])
    return entity.join(found, "entity_id", "left").where(test).select(*entity.columns)
