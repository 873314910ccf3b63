"""Attributes as nested members: sub-attributes, values inside values, metadata, typed comparison, member-level updates.

An attribute's instance is a JSON text of its members (``payload``); paths are lists of names, so nothing is parsed but JSON.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.sources.model import NULL

#: Members of an instance that are no sub-attributes, and those that hold a value.
VALUE_MEMBERS = ("value", "object", "languageMap", "vocab", "json", "valueList", "objectList")
SYSTEM_TIMES = ("createdAt", "modifiedAt", "deletedAt", "observedAt", "expiresAt")
METADATA = ("datasetId", "unitCode", "instanceId", *SYSTEM_TIMES)


def _json_path(names: Sequence[str]) -> str:
    return "$" + "".join(f'["{n}"]' for n in names)


def member(payload: Column, path: Sequence[str], inside: Sequence[str] = (), kind: str = "string") -> Column:
    """The value at a path of sub-attributes, or a metadata member when the last name is one, or a place inside the value.

    ``member(p, ["quality", "source"])`` is the value of a sub-attribute's sub-attribute, ``member(p, ["observedAt"])`` a
    system time, ``member(p, [], ["x", "y"])`` what ``a[x.y]`` means. Missing members are null.
    """
    doc = F.try_parse_json(payload)
    if path and path[-1] in METADATA:
        return F.try_variant_get(doc, _json_path(path), kind)
    return F.coalesce(*[F.try_variant_get(doc, _json_path([*path, v, *inside]), kind) for v in VALUE_MEMBERS])


def typed(column: Column, literal: object) -> tuple[Column, Column]:
    """A text column and a literal, both in the literal's type; texts that aren't of the type are null and never match."""
    if isinstance(literal, bool):
        return F.when(column.isin("true", "false"), column == "true"), F.lit(literal)
    if isinstance(literal, int | float):
        return column.try_cast("double"), F.lit(float(literal))
    if isinstance(literal, dt.datetime):
        return column.try_cast("timestamp"), F.lit(literal)
    if isinstance(literal, dt.date):
        return F.when(F.length(column) == 10, column.try_cast("date")), F.lit(literal)
    if isinstance(literal, dt.time):
        return F.when(column.rlike(r"^\d{2}:\d{2}:\d{2}"), F.substring(column, 1, 8)), F.lit(literal.strftime("%H:%M:%S"))
    return column, F.lit(str(literal))


def compared(column: Column, literal: object, op: Callable[[Column, Column], Column]) -> Column:
    return F.coalesce(op(*typed(column, literal)), F.lit(False))


def picked(rows: DataFrame, tree: dict[str, dict], path: str = "path") -> DataFrame:
    """Rows of nested members ``path array<string>`` that a tree of picked names keeps: ``{"a": {}, "b": {"c": {}}}``.

    A name without a tree of its own keeps all that is below it; the members on the way to a picked one are kept.
    """

    def test(tree: dict[str, dict], depth: int) -> Column:
        name = F.get(path, F.lit(depth))
        out = name.isNull()
        for key, below in tree.items():
            out = out | ((name == key) & test(below, depth + 1)) if below else out | (name == key)
        return out

    return rows.where(test(tree, 0))


def omitted(rows: DataFrame, leaves: Sequence[Sequence[str]], path: str = "path") -> DataFrame:
    """Rows that are not below one of the leaves; an omission names leaves only."""
    for leaf in leaves:
        rows = rows.where(~F.coalesce(F.slice(path, 1, len(leaf)) == F.array(*[F.lit(n) for n in leaf]), F.lit(False)))
    return rows


def members(rows: DataFrame, keys: Sequence[str], payload: str = "payload") -> DataFrame:
    """``(keys, name, raw)``: a row for each top-level member of a JSON object, its value as JSON text."""
    exploded = rows.select(*keys, F.explode(F.from_json(payload, "map<string,string>")).alias("name", "raw"))
    return exploded


def partly_updated(current: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, name, raw)`` after a partial update of members: named ones are replaced, null ones go, others stay.

    Both sides are member rows. The type and the dataset of an instance can't be changed.
    """
    new = patch.where(~F.col("name").isin("type", "datasetId")).select(*keys, "name", F.col("raw").alias("new"), F.lit(True).alias("patched"))
    both = current.join(new, [*keys, "name"], "full")
    raw = F.when(F.col("patched"), F.col("new")).otherwise(F.col("raw"))
    return both.select(*keys, "name", raw.alias("raw")).where(F.col("raw").isNotNull() & (F.col("raw") != NULL))


def normalized(raw: Column) -> Column:
    """A concise member as a struct ``(attribute_type, value)``: what holds an object is a relationship, and so on."""
    doc = F.try_parse_json(raw)
    kinds = [("object", "Relationship"), ("languageMap", "LanguageProperty"), ("vocab", "VocabProperty"), ("json", "JsonProperty"), ("coordinates", "GeoProperty"), ("value", "Property")]
    out = F.struct(F.lit("Property").alias("attribute_type"), F.coalesce(F.try_variant_get(doc, "$", "string"), raw).alias("value"))
    for name, kind in reversed(kinds):
        got = F.try_variant_get(doc, _json_path([name]), "variant")
        value = raw if name == "coordinates" else F.coalesce(F.try_variant_get(doc, _json_path([name]), "string"), F.to_json(got))
        out = F.when(got.isNotNull(), F.struct(F.lit(kind).alias("attribute_type"), value.alias("value"))).otherwise(out)
    return out


def expanded(rows: DataFrame, terms: dict[str, str], vocabulary: str, columns: Sequence[str]) -> DataFrame:
    """Short names in the columns as IRIs: by the terms, else below the default vocabulary; IRIs stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv]) if terms else F.create_map().cast("map<string,string>")
    for c in columns:
        known = F.try_element_at(table, F.col(c))
        rows = rows.withColumn(c, F.coalesce(known, F.when(F.col(c).contains(":"), F.col(c)).otherwise(F.concat(F.lit(vocabulary), F.col(c)))))
    return rows


def faults(instances: DataFrame) -> DataFrame:
    """``(entity_id, attribute_name, fault)`` of rows that break the attribute model.

    One type for an attribute of an entity, at most one default instance, no dataset twice.
    """
    of = instances.groupBy("entity_id", "attribute_name", F.coalesce("dataset_id", F.lit("@none")).alias("dataset")).agg(F.count("*").alias("n"), F.min("attribute_type").alias("lo"), F.max("attribute_type").alias("hi"))
    per = of.groupBy("entity_id", "attribute_name").agg(
        (F.min("lo") != F.max("hi")).alias("types"), F.max(F.when(F.col("dataset") == "@none", F.col("n"))).alias("defaults"), F.max(F.when(F.col("dataset") != "@none", F.col("n"))).alias("repeats")
    )
    found = F.array(
        F.when(F.col("types"), F.lit("several types")), F.when(F.coalesce("defaults", F.lit(0)) > 1, F.lit("several default instances")), F.when(F.coalesce("repeats", F.lit(0)) > 1, F.lit("dataset repeated"))
    )
    return per.select("entity_id", "attribute_name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("fault"))
