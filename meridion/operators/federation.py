"""Merging what several sources say of the same entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve(rows: DataFrame, now: str) -> DataFrame:
    """One value for each (entity, attribute, dataset) out of rows of several sources.

    In order: not expired, not auxiliary, later ``observed_at`` (missing is oldest), later ``modified_at``, first source.
    """
    order = W.partitionBy("entity_id", "attribute_name", "dataset_id").orderBy(
        F.coalesce(F.col("expires_at") < F.lit(now).cast("timestamp"), F.lit(False)), F.col("auxiliary"), F.col("observed_at").desc_nulls_last(), F.col("modified_at").desc_nulls_last(), "source_order"
    )
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merge_members(entities: DataFrame) -> DataFrame:
    """Entities by id over all sources: types and scopes united, earliest creation, latest change.

    The entity expires only if every source says so, and then with the last of them.
    """
    return entities.groupBy("entity_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("scopes")))).alias("scopes"),
        F.min("created_at").alias("created_at"),
        F.max("modified_at").alias("modified_at"),
        F.when(F.count("expires_at") == F.count("*"), F.max("expires_at")).alias("expires_at"),
    )


def merge_series(local: DataFrame, remote: DataFrame, keys: tuple[str, ...] = ("entity_id", "attribute_name", "time")) -> DataFrame:
    """Local points and those remote ones whose time is new in their series."""
    return local.unionByName(remote.join(local.select(*keys), list(keys), "left_anti"))


def merged_count(*counts: DataFrame) -> DataFrame:
    """The largest of the sources' counts: a lower bound of the union, and all that sources tell of it."""
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out.agg(F.max("n").alias("n"))


def matching_registrations(registration: DataFrame, ids: list[str] | None = None, types: list[str] | None = None, attributes: list[str] | None = None, operations: list[str] | None = None) -> DataFrame:
    """Registrations that may hold what is asked for: a part that a registration doesn't state matches anything.

    ``registration(id, operations, information array<struct<entities array<struct<id, pattern, types>>, names array<string>>>)``.
    """
    info = registration.select("id", "operations", F.explode_outer("information").alias("i"))
    rows = info.select("id", "operations", F.col("i.names").alias("names"), F.explode_outer("i.entities").alias("e"))
    test = F.lit(True)
    if operations:
        test = test & F.arrays_overlap("operations", F.array(*[F.lit(o) for o in operations]))
    if types:
        test = test & (F.col("e.types").isNull() | F.arrays_overlap("e.types", F.array(*[F.lit(t) for t in types])))
    if ids:
        wanted = F.array(*[F.lit(i) for i in ids])
        by_pattern = F.exists(wanted, lambda x: F.coalesce(F.regexp_like(x, F.col("e.pattern")), F.lit(False)))
        test = test & ((F.col("e.id").isNull() & F.col("e.pattern").isNull()) | F.coalesce(F.array_contains(wanted, F.col("e.id")), F.lit(False)) | by_pattern)
    if attributes:
        test = test & (F.col("names").isNull() | F.arrays_overlap("names", F.array(*[F.lit(a) for a in attributes])))
    return rows.where(test).select("id").distinct()


def owners(attribute: DataFrame, registered: DataFrame) -> DataFrame:
    """Attribute rows with the source that writes go to: exclusive before redirect before inclusive, else local.

    ``registered(attribute_name, source, mode)``; only the first two take an attribute away from the others.
    """
    rank = F.when(F.col("mode") == "exclusive", 0).when(F.col("mode") == "redirect", 1).otherwise(2)
    best = registered.withColumn("r", rank).groupBy("attribute_name").agg(F.min_by(F.struct("source", "mode"), F.struct("r", "source")).alias("o"))
    return attribute.join(best, "attribute_name", "left").select(*attribute.columns, F.coalesce("o.source", F.lit("local")).alias("owner"), F.coalesce("o.mode", F.lit("local")).alias("mode"))


def single_registrations(registration: DataFrame) -> DataFrame:
    """One row for each entity selector of each part of a registration; what isn't stated is null."""
    info = registration.select("id", "operations", F.explode_outer("information").alias("i"))
    rows = info.select("id", "operations", F.col("i.names").alias("names"), F.explode_outer("i.entities").alias("e"))
    return rows.select("id", "operations", "names", F.col("e.id").alias("entity_id"), F.col("e.pattern").alias("pattern"), F.col("e.types").alias("types"))


#: Fixed value: the operations that a group of them stands for.
OPERATION_GROUPS = {
    "retrieveOps": ("retrieveEntity", "queryEntity"), "updateOps": ("updateEntity", "updateAttrs", "replaceEntity", "replaceAttrs"),
    "redirectionOps": ("createEntity", "updateEntity", "appendAttrs", "updateAttrs", "deleteAttrs", "deleteEntity", "mergeEntity", "replaceEntity", "replaceAttrs", "retrieveEntity", "queryEntity"),
}


def with_operations(registration: DataFrame) -> DataFrame:
    """Registrations with their operation groups written out."""
    table = F.create_map(*[x for k, v in OPERATION_GROUPS.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    wide = F.flatten(F.transform("operations", lambda o: F.coalesce(F.try_element_at(table, o), F.array(o))))
    return registration.withColumn("operations", F.array_distinct(wide))


def narrowed(single: DataFrame, ids: list[str] | None, types: list[str] | None, names: list[str] | None) -> DataFrame:
    """What to ask each source for: the request's ids, types and names cut down to those that its registration states.

    ``single`` has the rows of ``single_registrations``; a part that isn't stated passes the request's on.
    """
    both = lambda mine, asked: mine if asked is None else F.when(mine.isNull(), F.array(*[F.lit(x) for x in asked])).otherwise(F.array_intersect(mine, F.array(*[F.lit(x) for x in asked])))
    wanted = None if ids is None else F.array(*[F.lit(i) for i in ids])
    chosen = F.when(F.col("entity_id").isNotNull(), F.array("entity_id"))
    if wanted is not None:
        by_pattern = F.filter(wanted, lambda i: F.regexp_like(i, F.col("pattern")))
        chosen = F.when(F.col("entity_id").isNotNull(), F.array_intersect(F.array("entity_id"), wanted)).when(F.col("pattern").isNotNull(), by_pattern).otherwise(wanted)
    out = single.select("id", chosen.alias("ids"), both(F.col("types"), types).alias("types"), both(F.col("names"), names).alias("names"))
    return out.where("(ids is null or size(ids) > 0) and (types is null or size(types) > 0) and (names is null or size(names) > 0)")


def distributed_results(wanted: DataFrame, holders: DataFrame) -> DataFrame:
    """``(entity_id, source, status)`` of a deletion at every source that holds the entity; notFound where none does."""
    return wanted.join(holders.select("entity_id", "source").distinct(), "entity_id", "left").select("entity_id", F.coalesce("source", F.lit("local")).alias("source"), F.when(F.col("source").isNull(), "notFound").otherwise("deleted").alias("status"))


def in_source_order(entities: DataFrame) -> DataFrame:
    """The row of each entity from the source that comes first, auxiliary ones last."""
    order = W.partitionBy("entity_id").orderBy("auxiliary", "source_order")
    return entities.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merged_with_remote(local: DataFrame, remote: DataFrame, columns: list[str]) -> DataFrame:
    """Entities that either side has; the local side's members come first."""
    theirs = remote.select("entity_id", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__remote"))
    both = local.withColumn("__local", F.lit(True)).join(theirs, "entity_id", "full")
    source = F.when(F.col("__local").isNull(), "remote").when(F.col("__remote").isNull(), "local").otherwise("both")
    return both.select("entity_id", *[F.coalesce(c, f"__{c}").alias(c) for c in columns], source.alias("held_by"))

