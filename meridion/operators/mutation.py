"""Creating, patching, replacing and deleting, as one table out of the current one and the changes.

A change table has the columns of the current table. Results are the new current rows; who writes them (overwriting a
partition, or a table format's merge) is the caller's choice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridion.sources.model import NULL

KEY = ("entity_id", "attribute_name", "dataset_id")




def latest(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key: an upsert's result over all that was written."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(current: DataFrame, change: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Changed rows take the place of current ones; creation times stay and deletion marks go."""
    old = current.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("created_at").alias("__created"))
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    fresh = change.join(old, test, "left").withColumn("created_at", F.coalesce("__created", "created_at")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    change_keys = change.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return current.join(change_keys, test, "left_anti").unionByName(fresh.select(*current.columns))


def append(current: DataFrame, change: DataFrame, overwrite: bool) -> DataFrame:
    """``(key, status)`` of each appended attribute: created, updated, or ignored where it lives and may not be overwritten."""
    old = current.where("deleted_at is null").select(*[F.col(k).alias(f"__{k}") for k in KEY], F.lit(True).alias("__old"))
    test = F.lit(True)
    for k in KEY:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    status = F.when(F.col("__old").isNull(), "created").otherwise("updated" if overwrite else "ignored")
    return change.join(old, test, "left").select(*KEY, status.alias("status"))


def replace_entity(current: DataFrame, change: DataFrame, at: str) -> DataFrame:
    """All attributes of the changed entities: the new ones, and a deletion mark on those that are no longer there."""
    touched = change.select("entity_id").distinct()
    new_keys = change.select(*[F.col(k).alias(f"__{k}") for k in KEY])
    test = F.lit(True)
    for k in KEY:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    gone = current.join(touched, "entity_id", "left_semi").join(new_keys, test, "left_anti")
    marked = gone.withColumn("deleted_at", F.coalesce("deleted_at", F.lit(at).cast("timestamp")))
    rest = current.join(touched, "entity_id", "left_anti")
    return rest.unionByName(marked).unionByName(upsert(current.join(touched, "entity_id", "left_semi"), change).join(new_keys, test, "left_semi"))


def soft_delete(rows: DataFrame, which: DataFrame, at: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """A deletion mark on the rows whose key is named; those deleted before keep their time."""
    named = which.select(*keys).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(named, list(keys), "left")
    stamp = F.when(F.col("__hit") & F.col("deleted_at").isNull(), F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at"))
    return out.withColumn("deleted_at", stamp).select(*rows.columns)


def hard_delete(rows: DataFrame, which: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    return rows.join(which.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def purge(attribute: DataFrame, entity: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """What is left of the attributes of the selected entities: without ``drop``, or only ``keep``; neither: nothing."""
    hit = attribute.join(entity.select("entity_id"), "entity_id", "left_semi")
    rest = attribute.join(entity.select("entity_id"), "entity_id", "left_anti")
    if keep:
        return rest.unionByName(hit.where(F.col("attribute_name").isin(keep)))
    return rest.unionByName(hit.where(~F.col("attribute_name").isin(drop))) if drop else rest


def updated_types(entity: DataFrame, change: DataFrame) -> DataFrame:
    """Types only grow."""
    new = change.select("entity_id", F.col("types").alias("__new"))
    return entity.join(new, "entity_id", "left").withColumn("types", F.array_union("types", F.coalesce("__new", F.array().cast("array<string>")))).select(*entity.columns)


def updated_scopes(entity: DataFrame, change: DataFrame, operation: str) -> DataFrame:
    """``replace`` takes the new scopes, ``append`` and ``merge`` unite them with the old."""
    new = change.select("entity_id", F.col("scopes").alias("__new"))
    empty = F.array().cast("array<string>")
    scopes = F.coalesce("__new", "scopes") if operation == "replace" else F.when(F.col("__new").isNull(), F.col("scopes")).otherwise(F.array_union(F.coalesce("scopes", empty), "__new"))
    return entity.join(new, "entity_id", "left").withColumn("scopes", scopes).select(*entity.columns)


def batch_split(batch: DataFrame, entity: DataFrame) -> DataFrame:
    """Rows of ``batch(entity_id, seq)`` with ``action``: the first of an unknown id creates, a known id and any repeat updates."""
    known = entity.where("deleted_at is null").select("entity_id", F.lit(True).alias("__known"))
    turn = F.row_number().over(W.partitionBy("entity_id").orderBy("seq"))
    return batch.withColumn("__n", turn).join(known, "entity_id", "left").withColumn("action", F.when(F.col("__known").isNull() & (F.col("__n") == 1), "create").otherwise("update")).drop("__n", "__known")


def merge_patch(old: dict, new: dict) -> dict:
    """The members of an attribute after a merge: null deletes, languages one by one, JSON and objects deeply."""
    out = dict(old)
    for name, value in new.items():
        if name == "datasetId" and value == NULL:
            raise ValueError("a dataset can't be deleted by a patch")
        if value == NULL:
            out.pop(name, None)
        elif name == "languageMap" and isinstance(value, dict):
            langs = {**(out.get(name) or {}), **value}
            out[name] = {k: v for k, v in langs.items() if v != NULL}
        elif isinstance(value, dict) and isinstance(out.get(name), dict):
            out[name] = _deep(out[name], value)
        else:
            out[name] = value
    return out


def _deep(old: dict, new: dict) -> dict:
    out = dict(old)
    for k, v in new.items():
        if v is None or v == NULL:
            out.pop(k, None)
        else:
            out[k] = _deep(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def patched(rows: DataFrame, old: str = "payload", new: str = "patch") -> DataFrame:
    """Rows with ``payload`` after the merge of its JSON ``patch``; a null patch changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = [
                a if b is None else json.dumps(merge_patch(json.loads(a or "{}"), json.loads(b)), sort_keys=True, ensure_ascii=False)
                for a, b in zip(columns[old].to_pylist(), columns[new].to_pylist(), strict=True)
            ]
            columns[old] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, rows.schema)


def absent(current: DataFrame, change: DataFrame) -> DataFrame:
    """Attributes of the changed entities that the change doesn't have: what a replacement deletes."""
    new = change.select(*[F.col(k).alias(f"__{k}") for k in KEY])
    test = F.lit(True)
    for k in KEY:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return current.join(change.select("entity_id").distinct(), "entity_id", "left_semi").join(new, test, "left_anti")


def created(batch: DataFrame, entity: DataFrame) -> DataFrame:
    """``(entity_id, status)``: created, revived where it was deleted, or exists."""
    known = entity.select("entity_id", F.lit(True).alias("__known"), F.col("deleted_at").isNotNull().alias("__gone"))
    status = F.when(F.col("__known").isNull(), "created").when(F.col("__gone"), "revived").otherwise("exists")
    return batch.join(known, "entity_id", "left").select("entity_id", status.alias("status"))


def matches_key(keys: tuple[str, ...]) -> Column:
    """Null-safe equality of each key with its copy ``__key``."""
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return test


def updated(current: DataFrame, change: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Update of attributes: ``(rows, results)``. Only attributes that live are changed; a null value deletes.

    ``change(entity_id, attribute_name, dataset_id, num, str)``; results are ``(key, status)``: updated, deleted or
    notFound. A row with neither number nor text, or with the null value, deletes.
    """
    new = change.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("num").alias("__num"), F.col("str").alias("__str"), F.lit(True).alias("__hit"))
    test = matches_key(KEY)
    gone = F.col("__hit") & ((F.col("__num").isNull() & F.col("__str").isNull()) | F.coalesce(F.col("__str") == NULL, F.lit(False)))
    both = current.join(new, test & F.col("deleted_at").isNull(), "left").where(~F.coalesce(gone, F.lit(False)))
    rows = both.withColumn("num", F.when(F.col("__hit"), F.col("__num")).otherwise(F.col("num"))).withColumn("str", F.when(F.col("__hit"), F.col("__str")).otherwise(F.col("str")))
    old = current.where("deleted_at is null").select(*[F.col(k).alias(f"__{k}") for k in KEY], F.lit(True).alias("__old"))
    deletes = (F.col("num").isNull() & F.col("str").isNull()) | F.coalesce(F.col("str") == NULL, F.lit(False))
    status = F.when(F.col("__old").isNull(), "notFound").when(deletes, "deleted").otherwise("updated")
    return rows.select(*current.columns), change.join(old, test, "left").select(*KEY, status.alias("status"))


def replaced_attribute(current: DataFrame, change: DataFrame) -> DataFrame:
    """Attributes that live and are named by ``change`` with all columns of the change but the time of creation."""
    new = change.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.struct(*[c for c in current.columns if c not in (*KEY, "created_at")]).alias("__new"))
    both = current.join(new, matches_key(KEY) & F.col("deleted_at").isNull(), "left")
    value = lambda c: c if c in (*KEY, "created_at") else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[value(c) for c in current.columns])


def batch_results(batch: DataFrame, entity: DataFrame, operation: str) -> DataFrame:
    """``(entity_id, seq, success, reason)`` of a batch: create fails on what is there, update and delete on what isn't.

    Of an id that stands several times the first counts for a creation.
    """
    known = entity.where("deleted_at is null").select("entity_id", F.lit(True).alias("__known"))
    turn = F.row_number().over(W.partitionBy("entity_id").orderBy("seq"))
    rows = batch.withColumn("__n", turn).join(known, "entity_id", "left")
    there = F.col("__known").isNotNull()
    if operation == "create":
        reason = F.when(there, "already exists").when(F.col("__n") > 1, "duplicate in batch")
    elif operation in ("update", "merge", "replace", "delete"):
        reason = F.when(~there, "not found")
    else:
        reason = F.lit(None).cast("string")  # an upsert always succeeds
    return rows.select("entity_id", "seq", reason.isNull().alias("success"), reason.alias("reason"))


def with_telemetry(current: DataFrame, points: DataFrame) -> DataFrame:
    """Attribute rows with the newest point of their series as value; attributes without one stay.

    ``points(entity_id, attribute_name, time, measured_value, instance_id)``: one grouping that combines before the shuffle.
    """
    newest = points.groupBy("entity_id", "attribute_name").agg(F.max_by("measured_value", F.struct("time", "instance_id")).alias("__v"))
    out = current.join(newest, ["entity_id", "attribute_name"], "left")
    return out.withColumn("num", F.when(F.col("dataset_id").isNull(), F.coalesce("__v", "num")).otherwise(F.col("num"))).select(*current.columns)


def is_null_value(column: Column) -> Column:
    """The standard's null, as a text or as the only value of a language map."""
    return F.coalesce((column == NULL) | (F.get_json_object(column, "$.languageMap['@none']") == NULL), F.lit(False))


def applied_identities(subject: DataFrame, event: DataFrame) -> DataFrame:
    """``subject(subject_id, subject_type, roles)`` after events ``(subject_id, time, operation, subject_type, roles)``.

    The last event of a subject counts: CREATE and UPDATE set it, DELETE takes it away.
    """
    last = event.groupBy("subject_id").agg(F.max_by(F.struct("operation", "subject_type", "roles"), F.struct("time", "operation")).alias("e"))
    both = subject.join(last, "subject_id", "full").where("e is null or e.operation <> 'DELETE'")
    return both.select("subject_id", F.coalesce("e.subject_type", "subject_type").alias("subject_type"), F.coalesce("e.roles", "roles").alias("roles"))
