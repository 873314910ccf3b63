"""What types and attributes there are: distinct lists and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.operators.filters import live


def types(entity: DataFrame) -> DataFrame:
    return entity.where(live()).select(F.explode("types").alias("type")).distinct()


def attributes_of_types(entity: DataFrame, attribute: DataFrame) -> DataFrame:
    """``(type, attributes)``. Names are made distinct per entity type before the join's rows are gathered."""
    pairs = _pairs(entity, attribute).select("type", "attribute_name").distinct()
    return pairs.groupBy("type").agg(F.array_join(F.sort_array(F.collect_set("attribute_name")), ",").alias("attributes"))


def types_of_attributes(entity: DataFrame, attribute: DataFrame) -> DataFrame:
    pairs = _pairs(entity, attribute).select("type", "attribute_name").distinct()
    return pairs.groupBy("attribute_name").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))


def _pairs(entity: DataFrame, attribute: DataFrame) -> DataFrame:
    named = entity.where(live()).select("entity_id", F.explode("types").alias("type"))
    return named.join(attribute.where(live()).select("entity_id", "attribute_name", "attribute_type"), "entity_id")


def type_info(entity: DataFrame, attribute: DataFrame) -> DataFrame:
    """``(type, entity_count, attribute_name, attribute_types)``."""
    counts = entity.where(live()).select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("entity_count"))
    kinds = _pairs(entity, attribute).groupBy("type", "attribute_name").agg(F.array_join(F.sort_array(F.collect_set("attribute_type")), ",").alias("attribute_types"))
    return kinds.join(counts, "type")


def attribute_info(entity: DataFrame, attribute: DataFrame) -> DataFrame:
    """``(attribute_name, attribute_count, attribute_types, type_names)``; the count is of attribute rows, not of entities."""
    rows = attribute.where(live()).groupBy("attribute_name").agg(F.count("*").alias("attribute_count"), F.array_join(F.sort_array(F.collect_set("attribute_type")), ",").alias("attribute_types"))
    return rows.join(types_of_attributes(entity, attribute).withColumnRenamed("types", "type_names"), "attribute_name", "left")
