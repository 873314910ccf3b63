"""Continuous queries: change events against subscriptions, throttling, periodic evaluation, ingestion of points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("operationType", T.StringType()), T.StructField("sub", T.StringType()), T.StructField("tenantName", T.StringType()), T.StructField("entityId", T.StringType()),
    T.StructField("entityTypes", T.ArrayType(T.StringType())), T.StructField("attributeName", T.StringType()), T.StructField("datasetId", T.StringType()),
    T.StructField("operationPayload", T.StringType()), T.StructField("previousPayload", T.StringType()), T.StructField("updatedEntity", T.StringType()), T.StructField("eventTime", T.TimestampType()),
])

TELEMETRY = T.StructType([
    T.StructField("tenantName", T.StringType()), T.StructField("entityId", T.StringType()), T.StructField("attributeName", T.StringType()),
    T.StructField("datasetId", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("observedAt", T.TimestampType()),
])

#: Fixed value: the trigger that each operation is, and what a general trigger stands for.
TRIGGERS = {
    "ENTITY_CREATE": "entityCreated", "ENTITY_DELETE": "entityDeleted", "ATTRIBUTE_CREATE": "attributeCreated", "ATTRIBUTE_UPDATE": "attributeUpdated", "ATTRIBUTE_DELETE": "attributeDeleted",
}
UPDATED = ("attributeCreated", "attributeUpdated", "attributeDeleted")


def decoded(messages: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Messages of a stream or table as columns; those that aren't JSON of the shape are dropped."""
    rows = messages.select(F.from_json(F.col(column).cast("string"), schema).alias("m")).where("m is not null").select("m.*")
    return rows.where(F.col("entityId").isNotNull())


def encoded(events: DataFrame) -> DataFrame:
    """``(key, value)`` for a topic: the key is the entity, so that an entity's events stay in order."""
    return events.select(F.col("entityId").alias("key"), F.to_json(F.struct(*[c for c in events.columns])).alias("value"))


def fanned_out(changes: DataFrame) -> DataFrame:
    """One event for the entity and one for each changed attribute of ``changes(entity_id, created, attributes)``."""
    entity = changes.where("created").select("entity_id", F.lit("entityCreated").alias("trigger"), F.lit(None).cast("string").alias("attribute_name"))
    attribute = changes.select("entity_id", F.explode("attributes").alias("attribute_name")).select("entity_id", F.lit("attributeUpdated").alias("trigger"), "attribute_name")
    return entity.unionByName(attribute)


def matches(events: DataFrame, subscription: DataFrame, now: str) -> DataFrame:
    """Events ``(event_id, entity_id, types, trigger, attribute_name, time, value)`` with the subscriptions they concern.

    A subscription is exploded to its single triggers (``entityUpdated`` is any change of an attribute) and the join is
    an equi-join on them; type, id pattern, watched attributes and the value's bounds are conditions on it.
    ``subscription(sub_id, is_active, expires_at, interval, triggers, type, id_pattern, watched, least, most)``.
    """
    wide = F.flatten(F.transform("triggers", lambda t: F.when(t == "entityUpdated", F.array(*[F.lit(u) for u in UPDATED])).otherwise(F.array(t))))
    active = subscription.where(F.col("is_active") & F.col("interval").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp"))))
    by_trigger = active.select("sub_id", F.explode(F.array_distinct(wide)).alias("trigger"), "type", "id_pattern", "watched", "least", "most")
    joined = events.join(by_trigger, "trigger")
    return joined.where(
        (F.col("type").isNull() | F.array_contains("types", F.col("type")))
        & (F.col("id_pattern").isNull() | F.regexp_like("entity_id", F.col("id_pattern")))
        & (F.col("attribute_name").isNull() | F.col("watched").isNull() | F.array_contains("watched", F.col("attribute_name")))
        & (F.col("least").isNull() | (F.col("value") >= F.col("least")))
        & (F.col("most").isNull() | (F.col("value") <= F.col("most")))
    )


THROTTLE_STATE = "last timestamp"


def throttled(matched: DataFrame, seconds: int) -> DataFrame:
    """At most one notification of a subscription in ``seconds``, by event time: a stateful stream or a batch.

    ``matched(sub_id, event_id, time)``. In a stream the time of the last notification is the state of each subscription;
    in a batch the events of a subscription are walked in order of time.
    """
    gap = pd.Timedelta(seconds=seconds)

    def walk(rows: pd.DataFrame, last: pd.Timestamp | None) -> tuple[list[int], pd.Timestamp | None]:
        kept = []
        for i, t in enumerate(rows["time"]):
            if last is None or t - last >= gap:
                kept.append(i)
                last = t
        return kept, last

    columns = "sub_id string, event_id long, time timestamp"
    rows = matched.select("sub_id", "event_id", "time")
    if matched.isStreaming:

        def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            last = pd.Timestamp(state.get[0]) if state.exists else None
            all_rows = pd.concat(list(frames)).sort_values(["time", "event_id"])
            kept, last = walk(all_rows, last)
            if last is not None:
                state.update((last.to_pydatetime(),))
            yield all_rows.iloc[kept]

        return rows.groupBy("sub_id").applyInPandasWithState(update, columns, THROTTLE_STATE, "append", "NoTimeout")

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come in order of subscription and time; only the last subscription's state is carried on.
        sub, last = None, None
        for frame in frames:
            kept = []
            for i, (s, t) in enumerate(zip(frame["sub_id"], frame["time"], strict=True)):
                if s != sub:
                    sub, last = s, None
                if last is None or t - last >= gap:
                    kept.append(i)
                    last = t
            yield frame.iloc[kept]

    return rows.repartition("sub_id").sortWithinPartitions("sub_id", "time", "event_id").mapInPandas(batch, columns)


def due(subscription: DataFrame, now: str) -> DataFrame:
    """Periodic subscriptions that were never sent, or not for their interval."""
    passed = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_notification")
    return subscription.where(F.col("is_active") & F.col("interval").isNotNull() & (F.col("last_notification").isNull() | (passed > F.col("interval"))))


def cooled_down(subscription: DataFrame, now: str) -> DataFrame:
    """Subscriptions that may be sent: no cool-down, no failure, or a failure that is long enough ago."""
    passed = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("last_failure")) > F.col("cooldown")
    return subscription.where(F.col("cooldown").isNull() | (F.coalesce("status", F.lit("ok")) != "failed") | passed)


def status(subscription: DataFrame, now: str) -> DataFrame:
    expired = F.coalesce(F.col("expires_at") < F.lit(now).cast("timestamp"), F.lit(False))
    return subscription.withColumn("status", F.when(~F.col("is_active"), "paused").when(expired, "expired").otherwise("active"))


def changed_values(events: DataFrame) -> DataFrame:
    """Events with the value before: what a notification with changes shows."""
    from pyspark.sql import Window as W

    before = F.lag("value").over(W.partitionBy("entity_id", "attribute_name").orderBy("time", "event_id"))
    return events.withColumn("previous_value", before)


def windowed_average(points: DataFrame, lateness: str, length: str) -> DataFrame:
    """An addition for streams: averages per attribute in fixed windows, late points dropped after the watermark."""
    return points.withWatermark("time", lateness).groupBy(F.window("time", length), "attribute_name").agg(F.avg("measured_value").alias("avg"), F.count("*").alias("n"))


def upsert_points(target: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: points of a micro-batch are appended, the last one for each (series, time).

    A reader takes the newest epoch of a key (``latest_points``); a batch that is replayed writes the same epoch's folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        one = batch.groupBy("entity_id", "attribute_name", "time").agg(F.max_by("measured_value", "instance_id").alias("measured_value"), F.max("instance_id").alias("instance_id"))
        one.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def latest_points(stored: DataFrame) -> DataFrame:
    return stored.groupBy("entity_id", "attribute_name", "time").agg(F.max_by("measured_value", "epoch").alias("measured_value"))


def bookkeeping(matched: DataFrame) -> DataFrame:
    """``(sub_id, times_sent, last_notification)`` after the matched events are sent."""
    return matched.groupBy("sub_id").agg(F.count("*").alias("times_sent"), F.max("time").alias("last_notification"))


def triggered(events: DataFrame, trigger: str) -> DataFrame:
    """Events that a trigger stands for: ``entityUpdated`` is any change of an attribute."""
    return events.where(F.col("trigger").isin(list(UPDATED)) if trigger == "entityUpdated" else F.col("trigger") == trigger)


def merged_selectors(selector: DataFrame) -> DataFrame:
    """``(sub_id, types, patterns, ids)``: the entity selectors of each subscription together."""
    return selector.groupBy("sub_id").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("id_pattern")).alias("patterns"), F.array_sort(F.collect_set("id")).alias("ids"))


def selected_events(events: DataFrame, selector: DataFrame) -> DataFrame:
    """``(sub_id, event_id)``: events that one of a subscription's selectors wants; an equi-join on the type."""
    rows = events.withColumn("type", F.explode("types"))
    hit = rows.join(selector, "type").where((F.col("id").isNull() | (F.col("entity_id") == F.col("id"))) & (F.col("id_pattern").isNull() | F.regexp_like("entity_id", F.col("id_pattern"))))
    return hit.select("sub_id", "event_id").distinct()


def faults(subscription: DataFrame, now: str) -> DataFrame:
    """``(sub_id, fault)`` of subscriptions that can't be accepted."""
    t = F.lit(now).cast("timestamp")
    found = F.array(
        F.when(F.col("type").isNull() & F.col("watched").isNull(), F.lit("neither entities nor attributes")),
        F.when(F.col("interval").isNotNull() & F.col("watched").isNotNull(), F.lit("interval and watched attributes")),
        F.when(F.col("interval") <= 0, F.lit("interval not positive")),
        F.when(F.col("expires_at") < t, F.lit("expired")),
        F.when(F.size(F.array_except("triggers", F.array(*[F.lit(x) for x in (*TRIGGERS.values(), "entityUpdated")]))) > 0, F.lit("unknown trigger")),
        F.when(F.col("least") > F.col("most"), F.lit("empty range")),
    )
    return subscription.select("sub_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("fault"))


def matching_events(events: DataFrame, values: DataFrame, predicate) -> DataFrame:
    """Events whose entity, as the event shows it, fulfils a predicate; ``values`` has attribute rows keyed by ``event_id``."""
    from meridion.operators.predicates import where

    rows = values.drop("entity_id").withColumnRenamed("event_id", "entity_id")
    return where(events.withColumnRenamed("entity_id", "of").withColumnRenamed("event_id", "entity_id"), rows, predicate).withColumnRenamed("entity_id", "event_id").withColumnRenamed("of", "entity_id")
