"""The context-data model over plain tables: entities, attribute values, instances, scope history.

``entity(entity_id, types, scopes, created_at, modified_at, deleted_at, expires_at, lon, lat)`` has a row per entity,
``attribute(entity_id, attribute_name, attribute_type, value_type, dataset_id, num, str, lang, created_at, deleted_at)`` a row
per attribute value (multi-valued and multi-language attributes have several), and
``instance(entity_id, attribute_name, time, measured_value, instance_id, payload)`` a row per point of a series. A null
dataset is the default instance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The dataset of a default instance in requests.
NONE = "@none"
#: Fixed value: the standard's null, which deletes in a patch.
NULL = "urn:ngsi-ld:null"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a ``nationkey`` and their scope /REGION/NATION."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nationkey"), F.concat(F.lit("/"), F.translate("r_name", " ", "_"), F.lit("/"), F.translate("n_name", " ", "_")).alias("scope")
    )
    return rows.join(places, "nationkey", "left")


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers side by side: (kind, key, name, nationkey, balance, segment)."""
    customer = read(spark, sf_dir, "customer").select(
        F.lit("Customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    supplier = read(spark, sf_dir, "supplier").select(
        F.lit("Supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"), F.lit(None).cast("string").alias("segment")
    )
    return customer.unionByName(supplier)


def uri(kind: str | Column, key: str | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("urn:"), kind, F.lit(":"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def _days(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + n * 86400)


def entities(spark: SparkSession, sf_dir: str, scoped: bool = True) -> DataFrame:
    """All entities; ``scoped=False`` leaves the scopes null and spares the join that they take."""
    p = parties(spark, sf_dir)
    p = _placed(p, spark, sf_dir) if scoped else p.withColumn("scope", F.lit(None).cast("string"))
    k = F.col("key")
    created = _days(k % 365)
    return p.select(
        uri(F.col("kind"), k).alias("entity_id"),
        F.when((F.col("kind") == "Customer") & (F.col("balance") > 0), F.array(F.lit("Customer"), F.lit("Creditor")))
        .when(F.col("kind") == "Customer", F.array(F.lit("Customer")))
        .otherwise(F.array(F.lit("Supplier"))).alias("types"),
        F.when(F.col("scope").isNotNull() & (k % 10 != 0), F.array("scope")).alias("scopes"),
        created.alias("created_at"),
        _days(k % 365 + 1).alias("modified_at"),
        F.when(k % 17 == 0, _days(k % 365 + 2)).alias("deleted_at"),
        F.when(k % 5 == 0, _days(k % 365 + k % 40)).alias("expires_at"),
        ((k * 37) % 360 - 180).cast("double").alias("lon"),
        ((k * 17) % 180 - 90).cast("double").alias("lat"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the parties' attributes, a branch for each attribute.

    A filter on the name leaves the other branches out of the plan, and one on the value reaches the scan of its column.
    """
    p = parties(spark, sf_dir)
    k = F.col("key")
    none = F.lit(None).cast("string")

    def value(name: str, kind: str, value_type: str, num: Column | None = None, text: Column | None = None, dataset: Column = none, lang: Column = none, where: Column | None = None) -> DataFrame:
        deleted = F.when(k % 23 == 0, _days(k % 365 + 3)) if name == "segment" else F.lit(None).cast("timestamp")
        return (p if where is None else p.where(where)).select(
            uri(F.col("kind"), k).alias("entity_id"), F.lit(name).alias("attribute_name"), F.lit(kind).alias("attribute_type"), F.lit(value_type).alias("value_type"), dataset.alias("dataset_id"),
            (F.lit(None).cast("double") if num is None else num.cast("double")).alias("num"), (none if text is None else text.cast("string")).alias("str"), lang.alias("lang"),
            _days(k % 365).alias("created_at"), deleted.alias("deleted_at"),
        )

    has_segment = F.col("segment").isNotNull()
    values = (
        value("name", "Property", "STRING", text=F.col("name")),
        value("balance", "Property", "NUMBER", num=F.col("balance")),
        value("balance", "Property", "NUMBER", num=F.col("balance") * 2, dataset=F.lit("urn:dataset:alt"), where=k % 4 == 0),
        value("segment", "VocabProperty", "STRING", text=F.col("segment"), where=has_segment),
        value("nation", "Relationship", "URI", text=uri("Nation", "nationkey")),
        value("label", "LanguageProperty", "STRING", text=F.lower("segment"), lang=F.lit("en"), where=has_segment),
        value("label", "LanguageProperty", "STRING", text=F.concat(F.lit("fr "), F.lower("segment")), lang=F.lit("fr"), where=has_segment & (k % 3 == 0)),
    )
    return reduce(DataFrame.unionByName, values)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of numbers from ``events``; times are UTC. Filters on time and attribute reach the scan."""
    e = read(spark, sf_dir, "events")
    return e.select(
        uri("User", "user_id").alias("entity_id"), F.col("event_type").alias("attribute_name"), F.col("ts").cast("timestamp").alias("time"),
        F.col("value").alias("measured_value"), F.col("event_id").alias("instance_id"), F.col("props").alias("payload"),
    )


def scope_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity_id, time, value array)``: a user's scopes by the kind of event, from ``events``."""
    e = read(spark, sf_dir, "events")
    return e.select(
        uri("User", "user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("time"),
        F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), lambda i: F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), i.cast("string"))).alias("value"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges ``(src, attribute_name, dst)``: order -> customer -> nation -> region."""
    o = read(spark, sf_dir, "orders").select(uri("Order", "o_orderkey").alias("src"), F.lit("customer").alias("attribute_name"), uri("Customer", "o_custkey").alias("dst"))
    c = read(spark, sf_dir, "customer").select(uri("Customer", "c_custkey").alias("src"), F.lit("nation").alias("attribute_name"), uri("Nation", "c_nationkey").alias("dst"))
    n = read(spark, sf_dir, "nation").select(uri("Nation", "n_nationkey").alias("src"), F.lit("region").alias("attribute_name"), uri("Region", "n_regionkey").alias("dst"))
    return o.unionByName(c).unionByName(n)


#: The same tables in DuckDB SQL, for the oracles.
SQL = {
    "party": """SELECT 'Customer' AS kind, c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer
      UNION ALL SELECT 'Supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""",
    "entity": """SELECT 'urn:' || kind || ':' || key AS entity_id,
      CASE WHEN kind = 'Customer' AND balance > 0 THEN ['Customer', 'Creditor'] WHEN kind = 'Customer' THEN ['Customer'] ELSE ['Supplier'] END AS types,
      CASE WHEN n_name IS NOT NULL AND key % 10 <> 0 THEN ['/' || replace(r_name, ' ', '_') || '/' || replace(n_name, ' ', '_')] END AS scopes,
      TIMESTAMP '2024-01-01' + (key % 365) * INTERVAL 1 DAY AS created_at, TIMESTAMP '2024-01-01' + (key % 365 + 1) * INTERVAL 1 DAY AS modified_at,
      CASE WHEN key % 17 = 0 THEN TIMESTAMP '2024-01-01' + (key % 365 + 2) * INTERVAL 1 DAY END AS deleted_at,
      CASE WHEN key % 5 = 0 THEN TIMESTAMP '2024-01-01' + (key % 365 + key % 40) * INTERVAL 1 DAY END AS expires_at,
      ((key * 37) % 360 - 180)::DOUBLE AS lon, ((key * 17) % 180 - 90)::DOUBLE AS lat
      FROM party LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON nationkey = n_nationkey""",
    "attribute": """SELECT *, TIMESTAMP '2024-01-01' + (key % 365) * INTERVAL 1 DAY AS created_at,
      CASE WHEN key % 23 = 0 AND attribute_name = 'segment' THEN TIMESTAMP '2024-01-01' + (key % 365 + 3) * INTERVAL 1 DAY END AS deleted_at FROM (
      SELECT 'urn:' || kind || ':' || key AS entity_id, key, 'name' AS attribute_name, 'Property' AS attribute_type, 'STRING' AS value_type, NULL::VARCHAR AS dataset_id, NULL::DOUBLE AS num, name AS str, NULL::VARCHAR AS lang FROM party
      UNION ALL SELECT 'urn:' || kind || ':' || key, key, 'balance', 'Property', 'NUMBER', NULL, balance, NULL, NULL FROM party
      UNION ALL SELECT 'urn:' || kind || ':' || key, key, 'balance', 'Property', 'NUMBER', 'urn:dataset:alt', balance * 2, NULL, NULL FROM party WHERE key % 4 = 0
      UNION ALL SELECT 'urn:' || kind || ':' || key, key, 'segment', 'VocabProperty', 'STRING', NULL, NULL, segment, NULL FROM party WHERE segment IS NOT NULL
      UNION ALL SELECT 'urn:' || kind || ':' || key, key, 'nation', 'Relationship', 'URI', NULL, NULL, 'urn:Nation:' || nationkey, NULL FROM party
      UNION ALL SELECT 'urn:' || kind || ':' || key, key, 'label', 'LanguageProperty', 'STRING', NULL, NULL, lower(segment), 'en' FROM party WHERE segment IS NOT NULL
      UNION ALL SELECT 'urn:' || kind || ':' || key, key, 'label', 'LanguageProperty', 'STRING', NULL, NULL, 'fr ' || lower(segment), 'fr' FROM party WHERE segment IS NOT NULL AND key % 3 = 0)""",
    "instance": """SELECT 'urn:User:' || user_id AS entity_id, event_type AS attribute_name, ts AS time, value AS measured_value, event_id AS instance_id, props AS payload FROM events""",
    "scope_history": """SELECT 'urn:User:' || user_id AS entity_id, ts AS time, list_transform(range(0, event_id % 3 + 1), lambda i: '/' || event_type || '/' || i) AS value FROM events""",
    "edge": """SELECT 'urn:Order:' || o_orderkey AS src, 'customer' AS attribute_name, 'urn:Customer:' || o_custkey AS dst FROM orders
      UNION ALL SELECT 'urn:Customer:' || c_custkey, 'nation', 'urn:Nation:' || c_nationkey FROM customer
      UNION ALL SELECT 'urn:Nation:' || n_nationkey, 'region', 'urn:Region:' || n_regionkey FROM nation""",
}
