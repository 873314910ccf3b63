"""Row-level access: permissions by entity, by type and by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what each action includes.
INCLUDES = {"own": ("own",), "admin": ("own", "admin"), "write": ("own", "admin", "write"), "read": ("own", "admin", "write", "read")}


def granted(permission: DataFrame, claims: list[str], action: str) -> DataFrame:
    """Permissions of one of the claims that include the action."""
    return permission.where(F.col("assignee").isin(claims) & F.col("action").isin(list(INCLUDES[action])))


def readable(entity: DataFrame, permission: DataFrame, claims: list[str] | None, action: str = "read") -> DataFrame:
    """Entities that the claims may use: by id, or where types and scopes of a permission both overlap (null is any).

    ``claims=None`` is no restriction. The id permissions are an equi-semi-join; those by type and scope are exploded to
    single types and joined on them, so there is no all-pairs comparison; an entity without a scope has ``@none``.
    """
    if claims is None:
        return entity
    mine = granted(permission, claims, action)
    by_id = mine.where("target_id is not null").select(F.col("target_id").alias("entity_id"))
    rules = mine.where("target_id is null and (target_types is not null or target_scopes is not null)").select(F.explode(F.coalesce("target_types", F.array(F.lit("*")))).alias("type"), F.explode(F.coalesce("target_scopes", F.array(F.lit("*")))).alias("scope")).distinct()
    scopes = F.coalesce("scopes", F.array(F.lit("@none")))
    offered = entity.select("entity_id", F.explode(F.array_append("types", "*")).alias("type"), scopes.alias("s")).select("entity_id", "type", F.explode(F.array_append("s", "*")).alias("scope"))
    by_rule = offered.join(rules, ["type", "scope"], "left_semi").select("entity_id")
    return entity.join(by_id.unionByName(by_rule).distinct(), "entity_id", "left_semi")


def covered(permission: DataFrame, types: list[str], scopes: list[str]) -> DataFrame:
    """Permissions whose types and scopes contain all of those given."""
    t, s = F.array(*[F.lit(x) for x in types]), F.array(*[F.lit(x) for x in scopes])
    return permission.where((F.col("target_types").isNull() | (F.size(F.array_except(t, "target_types")) == 0)) & (F.col("target_scopes").isNull() | (F.size(F.array_except(s, "target_scopes")) == 0)))


def detailed(permission: DataFrame, entity: DataFrame) -> DataFrame:
    """Permissions with the types of their target, where it is an entity."""
    return permission.join(entity.select(F.col("entity_id").alias("target_id"), F.col("types").alias("of_types")), "target_id", "left")


def new_scopes(entity: DataFrame, permission: DataFrame) -> DataFrame:
    """Scopes in use that no permission names."""
    used = entity.select(F.explode("scopes").alias("scope")).distinct()
    named = permission.select(F.explode("target_scopes").alias("scope")).distinct()
    return used.join(named, "scope", "left_anti")


def members(subject: DataFrame, group: str) -> DataFrame:
    return subject.where(F.array_contains("groups_memberships", group))


def memberships(subject: DataFrame) -> DataFrame:
    """``(subject_id, group_id)`` of the groups that are subjects themselves."""
    groups = subject.where("subject_type = 'group'").select(F.col("subject_id").alias("group_id"))
    return subject.select("subject_id", F.explode("groups_memberships").alias("group_id")).join(groups, "group_id", "left_semi").select("subject_id", "group_id")


def claims_of(subject: DataFrame, token: list[str], sub: str, authenticated: bool = True) -> DataFrame:
    """``(claim)``: the token's claims, the subject and its groups and roles, and those that any caller has."""
    spark = subject.sparkSession
    fixed = spark.createDataFrame([(c,) for c in [*token, sub, *(["authenticated"] if authenticated else []), "public"]], "claim string")
    mine = subject.where(F.col("subject_id") == sub)
    groups = mine.select(F.explode("groups_memberships").alias("claim")).unionByName(mine.select(F.explode("roles").alias("claim")))
    return fixed.unionByName(groups).distinct()


def checked(entity: DataFrame, permission: DataFrame, entity_id: str, claims: list[str], action: str) -> DataFrame:
    """``(entity_id, allowed)`` of one entity: a filter on the id first, so that a single row meets the permissions."""
    one = entity.where(F.col("entity_id") == entity_id)
    hit = readable(one, permission, claims, action).select("entity_id", F.lit(True).alias("allowed"))
    return one.select("entity_id").join(hit, "entity_id", "left").select("entity_id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def redundant(permission: DataFrame) -> DataFrame:
    """``(id, by)``: permissions on one entity that another one of the same assignee and target covers with a stronger action.

    Of equal ones the smallest id stays. The join is on assignee and target.
    """
    strength = F.element_at(F.create_map(*[x for a, n in (("read", 1), ("write", 2), ("admin", 3), ("own", 4)) for x in (F.lit(a), F.lit(n))]), F.col("action"))
    best = permission.where("target_id is not null").groupBy("assignee", "target_id").agg(F.min_by("id", F.struct(-strength, F.col("id"))).alias("by"))
    return permission.join(best, ["assignee", "target_id"]).where("id <> by").select("id", "by")


def owner_rights(created: DataFrame, sub: str) -> DataFrame:
    """Permissions that a caller gets on what it creates."""
    return created.select(F.concat(F.lit("own:"), "entity_id").alias("id"), F.col("entity_id").alias("target_id"), F.lit(sub).alias("assignee"), F.lit("own").alias("action"))


def group_sizes(subject: DataFrame) -> DataFrame:
    """``(group_id, members)`` of every group, those without members included."""
    groups = subject.where("subject_type = 'group'").select(F.col("subject_id").alias("group_id"))
    counts = memberships(subject).groupBy("group_id").agg(F.count("*").alias("members"))
    return groups.join(counts, "group_id", "left").select("group_id", F.coalesce("members", F.lit(0)).alias("members"))


def for_entity(permission: DataFrame, types: list[str], scopes: list[str] | None) -> DataFrame:
    """Every permission with ``applies``: whether it speaks of an entity of these types and scopes."""
    t, s = F.array(*[F.lit(x) for x in types]), F.array(*[F.lit(x) for x in scopes or ["@none"]])
    both = (F.col("target_types").isNull() | F.arrays_overlap("target_types", t)) & (F.col("target_scopes").isNull() | F.arrays_overlap("target_scopes", s))
    return permission.withColumn("applies", F.col("target_id").isNull() & both & (F.col("target_types").isNotNull() | F.col("target_scopes").isNotNull()))
