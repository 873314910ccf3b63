"""The registered queries of the engine: inventory operators on the driver's tables, with their DuckDB equivalents; the README lists those left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.functions import geo
from meridion.functions.time import bucket_start, period
from meridion.operators import access, discovery, federation, mutation, series, shaping
from meridion.operators import filters as flt
from meridion.operators.predicates import Predicate, present, value, where
from meridion.sources.model import SQL, attributes, entities, instances, read, relations, scope_history, uri
from meridion.streaming import subscriptions as subs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            needed = ["party", *ctes] if {"entity", "attribute"} & set(ctes) else list(ctes)
            ORACLE[name] = ("WITH " + ", ".join(f"{c} AS ({SQL[c]})" for c in needed) + " " if needed else "") + sql
        return f

    return add


def joined(column: str) -> F.Column:
    return F.array_join(F.array_sort(column), ",").alias(column)


# Sources ---------------------------------------------------------------------------------------------------------------

@query("S1_point_lookup", "SELECT entity_id, lon, lat FROM entity WHERE entity_id = 'urn:Customer:7' AND deleted_at IS NULL", "entity")
def s1(spark, d):
    return entities(spark, d).where(flt.with_ids(["urn:Customer:7"]) & flt.live()).select("entity_id", "lon", "lat")


WANTED = [("urn:Customer:9", 0), ("urn:Supplier:3", 1), ("urn:Customer:2", 2), ("urn:Customer:999999999", 3)]
WANTED_SQL = "wanted(entity_id, pos) AS (VALUES " + ", ".join(f"('{i}', {p})" for i, p in WANTED) + ")"


def wanted(spark):
    return spark.createDataFrame(WANTED, "entity_id string, pos int")


@query("S2_multi_lookup", "SELECT entity_id, pos, lon FROM entity JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {p})" for i, p in WANTED) + ") w(entity_id, pos)) USING (entity_id) ORDER BY pos", "entity")
def s2(spark, d):
    return shaping.in_list_order(wanted(spark), entities(spark, d)).select("entity_id", "pos", "lon")


@query("S3_existence", "SELECT w.entity_id, e.entity_id IS NOT NULL AS found FROM (VALUES " + ", ".join(f"('{i}', {p})" for i, p in WANTED) + ") w(entity_id, pos) LEFT JOIN (SELECT entity_id FROM entity WHERE deleted_at IS NULL) e USING (entity_id)", "entity")
def s3(spark, d):
    e = entities(spark, d)
    return flt.existing(wanted(spark), e).select("entity_id", F.lit(True).alias("found")).unionByName(flt.missing(wanted(spark), e).select("entity_id", F.lit(False).alias("found")))


@query("S4_attribute_scan", "SELECT entity_id, attribute_name, dataset_id, num, str FROM attribute WHERE deleted_at IS NULL AND attribute_name IN ('balance', 'segment') AND dataset_id IS NULL", "attribute")
def s4(spark, d):
    return shaping.dataset_view(shaping.pick(attributes(spark, d), ["balance", "segment"]), ["@none"]).where(flt.live()).select("entity_id", "attribute_name", "dataset_id", "num", "str")


@query("S5_attribute_lookup", "SELECT entity_id, num FROM attribute WHERE entity_id = 'urn:Customer:8' AND attribute_name = 'balance' AND dataset_id IS NOT DISTINCT FROM 'urn:dataset:alt'", "attribute")
def s5(spark, d):
    a = attributes(spark, d)
    return a.where((F.col("entity_id") == "urn:Customer:8") & (F.col("attribute_name") == "balance") & F.col("dataset_id").eqNullSafe(F.lit("urn:dataset:alt"))).select("entity_id", "num")


@query("S6_instance_scan", "SELECT instance_id, time, measured_value FROM instance WHERE attribute_name = 'click' AND time >= TIMESTAMP '2024-01-10'", "instance")
def s6(spark, d):
    return instances(spark, d).where((F.col("attribute_name") == "click") & flt.in_time("after", "2024-01-10")).select("instance_id", "time", "measured_value")


@query("S7_oldest_date", "SELECT entity_id, min(time) AS origin FROM instance GROUP BY entity_id", "instance")
def s7(spark, d):
    return series.oldest(instances(spark, d), ("entity_id",))


@query("S8_scope_history", "SELECT entity_id, time, len(value) AS n, array_to_string(value, ',') AS value FROM scope_history WHERE time < TIMESTAMP '2024-01-20'", "scope_history")
def s8(spark, d):
    return scope_history(spark, d).where(flt.in_time("before", "2024-01-20")).select("entity_id", "time", F.size("value").cast("long").alias("n"), F.array_join("value", ",").alias("value"))


@query("S9_expired", "SELECT entity_id, expires_at FROM entity WHERE deleted_at IS NULL AND expires_at < TIMESTAMP '2024-06-01'", "entity")
def s9(spark, d):
    return flt.expired(entities(spark, d), "2024-06-01").select("entity_id", "expires_at")


def _messages(spark, d):
    e = read(spark, d, "events")
    body = F.to_json(F.struct(uri("User", "user_id").alias("entityId"), F.col("event_type").alias("attributeName"), "value", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observedAt")))
    return e.select(F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(body).alias("value"))


@query("S10_telemetry_source", "SELECT 'urn:User:' || user_id AS \"entityId\", event_type AS \"attributeName\", value, ts AS \"observedAt\" FROM events WHERE event_id % 50 <> 0")
def s10(spark, d):
    return subs.decoded(_messages(spark, d), subs.TELEMETRY).select("entityId", "attributeName", "value", "observedAt")


@query("S13_event_sink", "SELECT 'urn:User:' || user_id AS key, count(*) AS n FROM events GROUP BY 1")
def s13(spark, d):
    e = instances(spark, d).select(F.col("entity_id").alias("entityId"), F.col("attribute_name").alias("attributeName"), F.col("measured_value").alias("value"))
    return subs.encoded(e).where(F.get_json_object("value", "$.attributeName").isNotNull()).groupBy("key").agg(F.count("*").alias("n"))


@query("S18_instance_upsert", "SELECT attribute_name, day, arg_max(measured_value, instance_id) AS measured_value FROM (SELECT *, date_trunc('day', time) AS day FROM instance) GROUP BY ALL", "instance")
def s18(spark, d):
    rows = instances(spark, d).withColumn("day", F.date_trunc("day", "time"))
    return mutation.latest(rows, ("attribute_name", "day"), ("instance_id",)).select("attribute_name", "day", "measured_value")


@query("S19_json_values", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def s19(spark, d):
    return read(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


# Entity filters --------------------------------------------------------------------------------------------------------

def entity_query(name: str, test: Callable[[], F.Column], sql: str) -> None:
    query(name, f"SELECT entity_id FROM entity WHERE deleted_at IS NULL AND {sql}", "entity")(lambda spark, d: entities(spark, d, scoped=name.startswith("F6")).where(flt.live() & test()).select("entity_id"))


entity_query("F1_ids", lambda: flt.with_ids(["urn:Customer:1", "urn:Supplier:2"]), "entity_id IN ('urn:Customer:1', 'urn:Supplier:2')")
entity_query("F2_id_pattern", lambda: flt.id_pattern("r:1\\d$"), "regexp_matches(entity_id, 'r:1\\d$')")
entity_query("F3_type_selection", lambda: (flt.has_type("Customer") & flt.has_type("Creditor")) | flt.has_type("Supplier"), "((list_contains(types, 'Customer') AND list_contains(types, 'Creditor')) OR list_contains(types, 'Supplier'))")
entity_query("F6_scope_exact", lambda: flt.in_scope("/EUROPE/FRANCE") | flt.in_scope("/ASIA/CHINA"), "scopes && ['/EUROPE/FRANCE', '/ASIA/CHINA']")
entity_query("F6_scope_level", lambda: flt.in_scope("/EUROPE/+"), "len(list_filter(scopes, lambda s: regexp_full_match(s, '/EUROPE/\\w+'))) > 0")
entity_query("F6_scope_prefix", lambda: flt.in_scope("/A#"), "len(list_filter(scopes, lambda s: starts_with(s, '/A'))) > 0")
entity_query("F7_live", lambda: F.lit(True), "true")
entity_query("F8_selectors", lambda: flt.selected([{"types": ["Supplier"], "pattern": "[13579]$"}, {"id": "urn:Customer:4"}]), "((list_contains(types, 'Supplier') AND regexp_matches(entity_id, '[13579]$')) OR entity_id = 'urn:Customer:4')")
entity_query("G1_near_max", lambda: geo.near(F.col("lon"), F.col("lat"), (10.0, 45.0), most=2_000_000), "2 * 6371008.771415 * asin(sqrt(least(power(sin(radians(45 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45)) * power(sin(radians(10 - lon) / 2), 2), 1))) <= 2000000")
entity_query("G1_near_min", lambda: geo.near(F.col("lon"), F.col("lat"), (10.0, 45.0), least=15_000_000), "2 * 6371008.771415 * asin(sqrt(least(power(sin(radians(45 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45)) * power(sin(radians(10 - lon) / 2), 2), 1))) >= 15000000")
BOX = [[[-50, -40], [60, -40], [60, 30], [-50, 30], [-50, -40]]]
entity_query("G2_within", lambda: geo.relation("within", "Polygon", BOX, F.col("lon"), F.col("lat")), "lon > -50 AND lon < 60 AND lat > -40 AND lat < 30")
entity_query("G2_intersects", lambda: geo.relation("intersects", "Polygon", BOX, F.col("lon"), F.col("lat")), "lon BETWEEN -50 AND 60 AND lat BETWEEN -40 AND 30")
entity_query("G2_disjoint", lambda: geo.relation("disjoint", "Polygon", BOX, F.col("lon"), F.col("lat")), "NOT (lon BETWEEN -50 AND 60 AND lat BETWEEN -40 AND 30)")
entity_query("G2_equals", lambda: geo.relation("equals", "Point", [-143, -73, 12], F.col("lon"), F.col("lat")), "lon = -143 AND lat = -73")


@query("F5_any_attribute", "SELECT entity_id FROM entity WHERE deleted_at IS NULL AND entity_id IN (SELECT entity_id FROM attribute WHERE deleted_at IS NULL AND attribute_name IN ('segment', 'label'))", "entity", "attribute")
def f5(spark, d):
    return flt.with_any_attribute(entities(spark, d).where(flt.live()), attributes(spark, d), ["segment", "label"]).select("entity_id")


@query("F9_all_filters", "SELECT entity_id FROM entity WHERE deleted_at IS NULL AND list_contains(types, 'Customer') AND len(list_filter(scopes, lambda s: starts_with(s, '/EUROPE/'))) > 0 AND entity_id IN (SELECT entity_id FROM attribute WHERE attribute_name = 'balance' AND num > 5000)", "entity", "attribute")
def f9(spark, d):
    e = entities(spark, d).where(flt.live() & flt.has_type("Customer") & flt.in_scope("/EUROPE/#"))
    return where(e, attributes(spark, d), value("balance") > 5000).select("entity_id")


@query("F10_dataset", "SELECT entity_id, num FROM attribute WHERE attribute_name = 'balance' AND (dataset_id IS NULL OR dataset_id = 'urn:dataset:alt')", "attribute")
def f10(spark, d):
    return attributes(spark, d).where((F.col("attribute_name") == "balance") & flt.in_dataset(["@none", "urn:dataset:alt"])).select("entity_id", "num")


@query("F11_time_between", "SELECT instance_id FROM instance WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-08'", "instance")
def f11(spark, d):
    return instances(spark, d).where(flt.in_time("between", "2024-01-05", "2024-01-08")).select("instance_id")


# Attribute predicates --------------------------------------------------------------------------------------------------

def predicate_query(name: str, p: Callable[[], Predicate], sql: str) -> None:
    body = f"SELECT entity_id FROM entity e WHERE deleted_at IS NULL AND ({sql})"
    query(name, body, "entity", "attribute")(lambda spark, d: where(entities(spark, d, scoped=False).where(flt.live()), attributes(spark, d), p()).select("entity_id"))


def some(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM attribute a WHERE a.entity_id = e.entity_id AND a.deleted_at IS NULL AND {test})"


MACHINERY = "attribute_name = 'segment' AND str = 'MACHINERY'"
BALANCE, SEGMENT, LABEL = "attribute_name = 'balance' AND", "attribute_name = 'segment' AND", "attribute_name = 'label' AND"
predicate_query("Q1_and_or", lambda: ((value("balance") > 9000) & present("segment")) | (value("segment") == "MACHINERY"), f"({some(BALANCE + ' num > 9000')} AND {some(SEGMENT + ' true')}) OR {some(MACHINERY)}")
predicate_query("Q2_exists", lambda: present("segment"), some("attribute_name = 'segment'"))
predicate_query("Q3_not_exists", lambda: ~present("segment"), "NOT " + some("attribute_name = 'segment'"))
predicate_query("Q6_number_at_least", lambda: value("balance") >= 8000, some(BALANCE + " num >= 8000"))
predicate_query("Q6_number_of_dataset", lambda: value("balance", dataset="urn:dataset:alt") < 0, some(BALANCE + " dataset_id = 'urn:dataset:alt' AND num < 0"))
predicate_query("Q8_string_or_language", lambda: (value("segment") == "building") | (value("label") == "building"), some("attribute_name IN ('segment', 'label') AND str = 'building'"))
predicate_query("Q9_uri", lambda: value("nation") == "urn:Nation:3", some("attribute_name = 'nation' AND str = 'urn:Nation:3'"))
predicate_query("Q10_like", lambda: value("label").like("(?i)MACH"), some(LABEL + " regexp_matches(str, '(?i)MACH')"))
predicate_query("Q11_unlike", lambda: value("segment").unlike("^B"), "NOT " + some(SEGMENT + " regexp_matches(str, '^B')"))
predicate_query("Q12_not_equal", lambda: value("segment") != "BUILDING", some(SEGMENT + " str <> 'BUILDING'"))
predicate_query("Q13_range", lambda: value("balance").between(100, 500), some(BALANCE + " num BETWEEN 100 AND 500"))
predicate_query("Q13_outside", lambda: value("balance").outside(-500, 9000), some(BALANCE + " (num < -500 OR num > 9000)"))
predicate_query("Q14_list", lambda: value("segment").one_of("BUILDING", "FURNITURE"), some(SEGMENT + " str IN ('BUILDING', 'FURNITURE')"))
predicate_query("Q14_not_in_list", lambda: value("segment").none_of("BUILDING", "FURNITURE"), some(SEGMENT + " str NOT IN ('BUILDING', 'FURNITURE')"))
predicate_query("Q18_language", lambda: value("label", lang="fr").like("^fr b"), some(LABEL + " lang = 'fr' AND regexp_matches(str, '^fr b')"))
predicate_query("Q20_expanded_value", lambda: value("segment", rename={"cars": "AUTOMOBILE"}) == "cars", some(SEGMENT + " str = 'AUTOMOBILE'"))


@query("Q7_iso_time", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') >= '2024-01-15T12:00:00Z'")
def q7(spark, d):
    return read(spark, d, "events").where(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") >= "2024-01-15T12:00:00Z").select("event_id")


@query("Q19_json_key", "SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT > 50")
def q19(spark, d):
    return read(spark, d, "events").where(F.variant_get(F.parse_json("props"), "$.k", "long") > 50).select("event_id")


# Projections and representations ---------------------------------------------------------------------------------------

@query("P1_pick", "SELECT entity_id, attribute_name FROM attribute WHERE attribute_name IN ('name', 'label')", "attribute")
def p1(spark, d):
    return shaping.pick(attributes(spark, d), ["name", "label"]).select("entity_id", "attribute_name")


@query("P2_omit", "SELECT entity_id, attribute_name FROM attribute WHERE attribute_name NOT IN ('name', 'label')", "attribute")
def p2(spark, d):
    return shaping.omit(attributes(spark, d), ["name", "label"]).select("entity_id", "attribute_name")


@query("P6_pick_document", "SELECT entity_id, string_agg(DISTINCT attribute_name, ',' ORDER BY attribute_name) AS members FROM attribute WHERE deleted_at IS NULL AND attribute_name IN ('segment', 'label') GROUP BY entity_id", "attribute")
def p6(spark, d):
    doc = shaping.picked_document(shaping.documents(attributes(spark, d)), pick_names=["segment", "label", "createdAt"])
    return doc.select("entity_id", F.array_join(F.array_sort(F.map_keys("document")), ",").alias("members"))


@query("P7_dataset_view", "SELECT entity_id, attribute_name, num FROM attribute WHERE dataset_id = 'urn:dataset:alt'", "attribute")
def p7(spark, d):
    return shaping.dataset_view(attributes(spark, d), ["urn:dataset:alt"]).select("entity_id", "attribute_name", "num")


@query("P9_simplified", "SELECT entity_id, max(str) FILTER (attribute_name = 'name') AS name, max(str) FILTER (attribute_name = 'nation') AS nation, count(*) FILTER (attribute_name = 'balance') > 1 AS several FROM attribute WHERE deleted_at IS NULL GROUP BY entity_id", "attribute")
def p9(spark, d):
    doc = shaping.simplified(shaping.documents(attributes(spark, d)))
    return doc.select("entity_id", F.try_element_at("document", F.lit("name")).alias("name"), F.try_element_at("document", F.lit("nation")).alias("nation"), F.try_element_at("document", F.lit("balance")).startswith('{"dataset"').alias("several"))


@query("P12_language", "SELECT entity_id, arg_min(str, CASE lang WHEN 'fr' THEN 0 ELSE 1 END) AS label, arg_min(lang, CASE lang WHEN 'fr' THEN 0 ELSE 1 END) AS lang FROM attribute WHERE attribute_name = 'label' GROUP BY entity_id", "attribute")
def p12(spark, d):
    return shaping.in_language(shaping.pick(attributes(spark, d), ["label"]), ["fr", "de"]).select("entity_id", F.col("str").alias("label"), "lang")


@query("P13_without_system", "SELECT entity_id, created_at, lon, lat, array_to_string(types, ',') AS types FROM entity", "entity")
def p13(spark, d):
    e = entities(spark, d)
    e = e.select(*shaping.without_system(e.columns, keep="createdAt"))
    return e.select("entity_id", "created_at", "lon", "lat", F.array_join("types", ",").alias("types"))


@query("P14_geojson", "SELECT entity_id, lon, lat, 'Feature' AS kind FROM entity", "entity")
def p14(spark, d):
    f = shaping.geojson(entities(spark, d))
    return f.select("entity_id", F.get_json_object("feature", "$.geometry.coordinates[0]").cast("double").alias("lon"), F.get_json_object("feature", "$.geometry.coordinates[1]").cast("double").alias("lat"), F.get_json_object("feature", "$.type").alias("kind"))


@query("P16_rename", "SELECT entity_id, CASE attribute_name WHEN 'name' THEN 'https://schema.org/name' ELSE attribute_name END AS attribute_name FROM attribute", "attribute")
def p16(spark, d):
    return shaping.renamed(attributes(spark, d), {"name": "https://schema.org/name"}).select("entity_id", "attribute_name")


@query("P17_document", "SELECT entity_id, count(DISTINCT attribute_name) AS members, count(*) AS instances FROM attribute WHERE deleted_at IS NULL GROUP BY entity_id", "attribute")
def p17(spark, d):
    doc = shaping.documents(attributes(spark, d))
    return doc.select("entity_id", F.size("document").cast("long").alias("members"), F.aggregate(F.map_values("document"), F.lit(0).cast("long"), lambda n, v: n + F.size(v)).alias("instances"))


@query("P20_temporal_values", "SELECT entity_id, attribute_name, count(*) AS n, arg_min(measured_value, (time, measured_value)) AS first, arg_max(measured_value, (time, measured_value)) AS last FROM instance GROUP BY ALL", "instance")
def p20(spark, d):
    v = series.value_pairs(instances(spark, d))
    return v.select("entity_id", "attribute_name", F.size("values").cast("long").alias("n"), F.element_at("values", 1)["value"].alias("first"), F.element_at("values", -1)["value"].alias("last"))


@query("P21_aggregated_values", "SELECT attribute_name, m.method, count(*) AS n FROM (SELECT DISTINCT attribute_name, date_trunc('day', time) AS day FROM instance), (VALUES ('max'), ('min')) m(method) GROUP BY ALL", "instance")
def p21(spark, d):
    b = series.bucketed(instances(spark, d), ["min", "max"], period("P1D"), origin=F.lit("2024-01-01").cast("timestamp"), keys=("attribute_name",))
    return series.method_series(b, ["min", "max"], keys=("attribute_name",)).select("attribute_name", "method", F.size("values").cast("long").alias("n"))


@query("P25_previous_value", "SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous_value FROM events")
def p25(spark, d):
    e = instances(spark, d).select("entity_id", "attribute_name", "time", F.col("instance_id").alias("event_id"), F.col("measured_value").alias("value"))
    return subs.changed_values(e).select("event_id", "value", "previous_value")


# Joins -----------------------------------------------------------------------------------------------------------------

@query("J3_linked_entities", "SELECT a.src AS root, 1 AS level, a.dst AS entity_id FROM edge a WHERE a.attribute_name = 'customer' UNION ALL SELECT DISTINCT a.src, 2, b.dst FROM edge a JOIN edge b ON a.dst = b.src WHERE a.attribute_name = 'customer' UNION ALL SELECT DISTINCT a.src, 3, c.dst FROM edge a JOIN edge b ON a.dst = b.src JOIN edge c ON b.dst = c.src WHERE a.attribute_name = 'customer'", "edge")
def j3(spark, d):
    roots = read(spark, d, "orders").select(uri("Order", "o_orderkey").alias("entity_id"))
    return shaping.linked(relations(spark, d), roots, 3).select("root", "level", "entity_id")


@query("J4_inline", "SELECT n.n_name AS name, count(*) AS customers FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY n.n_name")
def j4(spark, d):
    nation = read(spark, d, "nation").select(uri("Nation", "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    customer = read(spark, d, "customer").select(uri("Customer", "c_custkey").alias("entity_id"))
    back = relations(spark, d).where("attribute_name = 'nation'").select(F.col("dst").alias("src"), F.lit("customers").alias("attribute_name"), F.col("src").alias("dst"))
    return shaping.nested(nation, back, customer, "customers").where("entity is not null").select("name", F.size("entity").cast("long").alias("customers"))


@query("J10_flat_view", "SELECT i.instance_id, i.measured_value, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_mktsegment END AS segment FROM instance i LEFT JOIN customer c ON i.entity_id = 'urn:User:' || c.c_custkey", "instance")
def j10(spark, d):
    c = read(spark, d, "customer").select(uri("User", "c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    return instances(spark, d).join(c, "entity_id", "left").select("instance_id", "measured_value", "segment")


@query("J19_batch_split", "SELECT entity_id, seq, CASE WHEN known = 0 AND row_number() OVER (PARTITION BY entity_id ORDER BY seq) = 1 THEN 'create' ELSE 'update' END AS action FROM (SELECT 'urn:Customer:' || (user_id + 1) AS entity_id, event_id AS seq, (SELECT count(*) FROM entity e WHERE e.entity_id = 'urn:Customer:' || (user_id + 1) AND deleted_at IS NULL) AS known FROM events)", "entity")
def j19(spark, d):
    batch = read(spark, d, "events").select(uri("Customer", F.col("user_id") + 1).alias("entity_id"), F.col("event_id").alias("seq"))
    return mutation.batch_split(batch, entities(spark, d)).select("entity_id", "seq", "action")


# Aggregates and windows ------------------------------------------------------------------------------------------------

ALL = ["totalCount", "distinctCount", "sum", "avg", "min", "max", "stddev", "sumsq"]


@query("A1_number_methods", "SELECT attribute_name, count(*) AS \"totalCount\", count(DISTINCT measured_value) AS \"distinctCount\", round(sum(measured_value), 4) AS sum, round(avg(measured_value), 6) AS avg, min(measured_value) AS min, max(measured_value) AS max, round(stddev_samp(measured_value), 6) AS stddev, round(sum(power(measured_value, 2)), 2) AS sumsq, min(time) AS start, max(time) AS \"end\" FROM instance GROUP BY ALL", "instance")
def a1(spark, d):
    a = series.whole_range(instances(spark, d), ALL, keys=("attribute_name",))
    digits = {"sum": 4, "avg": 6, "stddev": 6, "sumsq": 2}
    return a.select("attribute_name", *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in ALL], "start", "end")


@query("A2_string_methods", "SELECT attribute_name, count(*) AS \"totalCount\", count(DISTINCT payload) AS \"distinctCount\", min(payload) AS min, max(payload) AS max FROM instance GROUP BY ALL", "instance")
def a2(spark, d):
    return series.whole_range(instances(spark, d), ["totalCount", "distinctCount", "min", "max"], "payload", "STRING", ("attribute_name",)).drop("start", "end")


@query("A3_boolean_methods", "SELECT attribute_name, count(*) AS \"totalCount\", sum((measured_value > 50)::INT)::BIGINT AS sum, round(avg((measured_value > 50)::INT), 5) AS avg, min((measured_value > 50)::INT) AS min, max((measured_value > 50)::INT) AS max FROM instance GROUP BY ALL", "instance")
def a3(spark, d):
    rows = instances(spark, d).withColumn("flag", F.col("measured_value") > 50)
    return series.whole_range(rows, ["totalCount", "sum", "avg", "min", "max"], "flag", "BOOLEAN", ("attribute_name",)).drop("start", "end")


@query("A4_array_methods", "SELECT entity_id, count(*) AS \"totalCount\", sum(len(value))::BIGINT AS sum, round(avg(len(value)), 5) AS avg, min(len(value))::INT AS min, max(len(value))::INT AS max FROM scope_history GROUP BY entity_id", "scope_history")
def a4(spark, d):
    return series.whole_range(scope_history(spark, d), ["totalCount", "sum", "avg", "min", "max"], "value", "ARRAY", ("entity_id",)).drop("start", "end")


@query("A8_time_methods", "SELECT attribute_name, count(*) AS \"totalCount\", min(strftime(time, '%H:%M:%S')) AS min, max(strftime(time, '%H:%M:%S')) AS max FROM instance GROUP BY ALL", "instance")
def a8(spark, d):
    rows = instances(spark, d).withColumn("clock", F.date_format("time", "HH:mm:ss"))
    return series.whole_range(rows, ["totalCount", "min", "max"], "clock", "TIME", ("attribute_name",)).drop("start", "end")


def bucket_query(name: str, text: str, sql_bucket: str, sql_end: str) -> None:
    @query(name, f"SELECT entity_id, attribute_name, {sql_bucket} AS start, {sql_end.format(b=sql_bucket)} AS \"end\", count(*) AS \"totalCount\", round(avg(measured_value), 6) AS avg FROM instance GROUP BY ALL", "instance")
    def run(spark, d):
        b = series.bucketed(instances(spark, d), ["totalCount", "avg"], period(text), origin=F.lit("2024-01-01").cast("timestamp"))
        return b.withColumn("avg", F.round("avg", 6))


bucket_query("A11_time_bucket_day", "P1D", "time_bucket(INTERVAL 1 DAY, time, TIMESTAMP '2024-01-01')", "{b} + INTERVAL 1 DAY")
bucket_query("A11_time_bucket_hours", "PT48H", "time_bucket(INTERVAL 48 HOUR, time, TIMESTAMP '2024-01-01')", "{b} + INTERVAL 48 HOUR")
bucket_query("A11_time_bucket_week", "P1W", "time_bucket(INTERVAL 7 DAY, time, TIMESTAMP '2024-01-01')", "{b} + INTERVAL 7 DAY")
bucket_query("A14_month_bucket", "P1M", "date_trunc('month', time)", "{b} + INTERVAL 1 MONTH")


@query("A12_scope_bucket", "SELECT entity_id, time_bucket(INTERVAL 7 DAY, time, TIMESTAMP '2024-01-01') AS start, count(*) AS \"totalCount\", max(len(value))::INT AS max FROM scope_history GROUP BY ALL", "scope_history")
def a12(spark, d):
    return series.bucketed(scope_history(spark, d), ["totalCount", "max"], period("P7D"), "value", "ARRAY", F.lit("2024-01-01").cast("timestamp"), keys=("entity_id",)).drop("end")


@query("A15_count", "SELECT count(*) AS n FROM entity WHERE deleted_at IS NULL AND list_contains(types, 'Customer')", "entity")
def a15(spark, d):
    return entities(spark, d).where(flt.live() & flt.has_type("Customer")).agg(F.countDistinct("entity_id").alias("n"))


@query("A16_types", "SELECT DISTINCT unnest(types) AS type FROM entity WHERE deleted_at IS NULL", "entity")
def a16(spark, d):
    return discovery.types(entities(spark, d))


TYPED = "(SELECT entity_id, unnest(types) AS type FROM entity WHERE deleted_at IS NULL)"


@query("A17_type_attributes", f"SELECT type, string_agg(DISTINCT attribute_name, ',' ORDER BY attribute_name) AS attributes FROM {TYPED} JOIN attribute USING (entity_id) WHERE attribute.deleted_at IS NULL GROUP BY type", "entity", "attribute")
def a17(spark, d):
    return discovery.attributes_of_types(entities(spark, d), attributes(spark, d))


@query("A18_type_info", f"SELECT type, attribute_name, string_agg(DISTINCT attribute_type, ',' ORDER BY attribute_type) AS attribute_types, (SELECT count(*) FROM {TYPED} t WHERE t.type = x.type) AS entity_count FROM {TYPED} x JOIN attribute USING (entity_id) WHERE attribute.deleted_at IS NULL GROUP BY type, attribute_name", "entity", "attribute")
def a18(spark, d):
    return discovery.type_info(entities(spark, d), attributes(spark, d))


@query("A20_attribute_types", f"SELECT attribute_name, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM {TYPED} JOIN attribute USING (entity_id) WHERE attribute.deleted_at IS NULL GROUP BY attribute_name", "entity", "attribute")
def a20(spark, d):
    return discovery.types_of_attributes(entities(spark, d), attributes(spark, d))


@query("A21_attribute_info", f"SELECT a.attribute_name, count(*) AS attribute_count, string_agg(DISTINCT attribute_type, ',' ORDER BY attribute_type) AS attribute_types, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM {TYPED} t JOIN attribute b USING (entity_id) WHERE b.deleted_at IS NULL AND b.attribute_name = a.attribute_name) AS type_names FROM attribute a WHERE a.deleted_at IS NULL GROUP BY a.attribute_name", "entity", "attribute")
def a21(spark, d):
    return discovery.attribute_info(entities(spark, d), attributes(spark, d))


@query("A24_merged_count", "SELECT greatest((SELECT count(*) FROM customer), (SELECT count(*) FROM supplier)) AS n")
def a24(spark, d):
    return federation.merged_count(read(spark, d, "customer").agg(F.count("*").alias("n")), read(spark, d, "supplier").agg(F.count("*").alias("n")))


@query("W1_last_n", "SELECT entity_id, attribute_name, instance_id, time FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_name ORDER BY time DESC, instance_id DESC) AS n FROM instance) WHERE n <= 3", "instance")
def w1(spark, d):
    return series.newest(instances(spark, d), 3).select("entity_id", "attribute_name", "instance_id", "time")


@query("W2_current_state", "SELECT instance_id, row_number() OVER (PARTITION BY entity_id, attribute_name ORDER BY time DESC, instance_id DESC) = 1 AS is_current FROM instance", "instance")
def w2(spark, d):
    return series.current_and_history(instances(spark, d)).select("instance_id", "is_current")


@query("W3_bucket_start", "SELECT event_id, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01 01:30:00') AS start FROM events")
def w3(spark, d):
    return read(spark, d, "events").select("event_id", bucket_start(F.col("ts").cast("timestamp"), period("PT3H"), F.lit("2024-01-01 01:30:00").cast("timestamp")).alias("start"))


@query("W4_last_buckets", "SELECT entity_id, attribute_name, start, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_name ORDER BY start DESC) AS r FROM (SELECT entity_id, attribute_name, date_trunc('day', time) AS start, count(*) AS n FROM instance GROUP BY ALL)) WHERE r <= 2", "instance")
def w4(spark, d):
    b = series.bucketed(instances(spark, d), ["totalCount"], period("P1D"), origin=F.lit("2024-01-01").cast("timestamp"))
    return series.newest(b, 2, by=("start",)).select("entity_id", "attribute_name", "start", F.col("totalCount").alias("n"))


@query("W5_page_range", "SELECT i.instance_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_name ORDER BY time, instance_id) AS n FROM instance WHERE time >= TIMESTAMP '2024-01-03') i, (SELECT min(last) AS hi FROM (SELECT max(time) AS last, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_name ORDER BY time, instance_id) AS n FROM instance WHERE time >= TIMESTAMP '2024-01-03') WHERE n <= 5 GROUP BY entity_id, attribute_name) WHERE c >= 5) WHERE n <= 5 AND (hi IS NULL OR time BETWEEN TIMESTAMP '2024-01-03' AND hi)", "instance")
def w5(spark, d):
    rows = series.first_points(instances(spark, d).where(flt.in_time("after", "2024-01-03")), 5)
    return series.paged(rows, series.page_range(rows, 5, relation="after", at="2024-01-03")).select("instance_id")


# Order, pages, sets ----------------------------------------------------------------------------------------------------

@query("O1_order_by_value", "SELECT e.entity_id, a.num FROM entity e LEFT JOIN (SELECT entity_id, min(num) AS num FROM attribute WHERE attribute_name = 'balance' AND dataset_id IS NULL AND deleted_at IS NULL GROUP BY entity_id) a USING (entity_id) WHERE e.deleted_at IS NULL ORDER BY a.num DESC NULLS LAST, e.entity_id LIMIT 25", "entity", "attribute")
def o1(spark, d):
    rows = shaping.ordered_by_value(entities(spark, d).where(flt.live()), attributes(spark, d), "balance", descending=True)
    return shaping.page(rows.select("entity_id", F.col("__k.num").alias("num")), 25)


@query("O4_page", "SELECT entity_id FROM entity WHERE deleted_at IS NULL ORDER BY created_at, entity_id LIMIT 30 OFFSET 40", "entity")
def o4(spark, d):
    return shaping.page(entities(spark, d).where(flt.live()).select("entity_id", "created_at").orderBy("created_at", "entity_id"), 30, 40).select("entity_id")


@query("U2_type_union", "SELECT entity_id, CASE WHEN entity_id LIKE 'urn:Supplier:%' THEN 'Partner,Supplier' ELSE array_to_string(list_sort(types), ',') END AS types FROM entity", "entity")
def u2(spark, d):
    e = entities(spark, d)
    change = e.where(flt.has_type("Supplier")).select("entity_id", F.array(F.lit("Partner")).alias("types"))
    return mutation.updated_types(e, change).select("entity_id", joined("types"))


@query("U3_scope_union", "SELECT entity_id, CASE WHEN scopes IS NULL THEN '/new' ELSE array_to_string(list_sort(list_append(scopes, '/new')), ',') END AS scopes FROM entity", "entity")
def u3(spark, d):
    e = entities(spark, d)
    return mutation.updated_scopes(e, e.select("entity_id", F.array(F.lit("/new")).alias("scopes")), "append").select("entity_id", joined("scopes"))


@query("U9_first_of_batch", "SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type")
def u9(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("entity_id"), F.col("event_id").alias("seq"))
    none = rows.where(F.lit(False)).select("entity_id", F.lit(None).cast("timestamp").alias("deleted_at"))
    return mutation.batch_split(rows, none).where("action = 'create'").select(F.col("entity_id").alias("event_type"), F.col("seq").alias("first"))


# Federation ------------------------------------------------------------------------------------------------------------

SOURCES_SQL = "SELECT 'urn:User:' || user_id AS entity_id, event_type AS attribute_name, NULL::VARCHAR AS dataset_id, value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS observed_at, date_trunc('day', ts) AS modified_at, CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '2024-01-05' END AS expires_at, event_id % 3 = 2 AS auxiliary, event_id AS source_order FROM events"


def source_rows(spark, d):
    t, i = F.col("ts").cast("timestamp"), F.col("event_id")
    return read(spark, d, "events").select(
        uri("User", "user_id").alias("entity_id"), F.col("event_type").alias("attribute_name"), F.lit(None).cast("string").alias("dataset_id"), "value",
        F.when(i % 4 != 0, F.date_trunc("hour", t)).alias("observed_at"), F.date_trunc("day", t).alias("modified_at"),
        F.when(i % 7 == 0, F.lit("2024-01-05").cast("timestamp")).alias("expires_at"), (i % 3 == 2).alias("auxiliary"), i.alias("source_order"),
    )


@query("L5_member_merge", "SELECT 'urn:User:' || user_id AS entity_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, min(ts) AS created_at, max(ts) AS modified_at FROM events GROUP BY user_id")
def l5(spark, d):
    e = read(spark, d, "events").select(uri("User", "user_id").alias("entity_id"), F.array("event_type").alias("types"), F.array().cast("array<string>").alias("scopes"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("modified_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    return federation.merge_members(e).select("entity_id", F.array_join("types", ",").alias("types"), "created_at", "modified_at")


@query("L6_attribute_conflict", f"SELECT entity_id, attribute_name, source_order, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_name, dataset_id ORDER BY coalesce(expires_at < TIMESTAMP '2024-02-01', false), auxiliary, observed_at DESC NULLS LAST, modified_at DESC NULLS LAST, source_order) AS n FROM ({SOURCES_SQL})) WHERE n = 1")
def l6(spark, d):
    return federation.resolve(source_rows(spark, d), "2024-02-01").select("entity_id", "attribute_name", "source_order", "value")


@query("L8_series_merge", "SELECT instance_id FROM instance i WHERE instance_id % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM instance l WHERE l.instance_id % 3 <> 0 AND l.entity_id = i.entity_id AND l.attribute_name = i.attribute_name AND l.time = i.time)", "instance")
def l8(spark, d):
    i = instances(spark, d)
    return federation.merge_series(i.where("instance_id % 3 <> 0"), i.where("instance_id % 3 = 0")).select("instance_id")


REGISTRATIONS = [
    ("r1", ["retrieveOps"], [{"entities": [{"id": None, "pattern": None, "types": ["Customer"]}], "names": None}]),
    ("r2", ["retrieveOps", "updateOps"], [{"entities": [{"id": "urn:Supplier:1", "pattern": None, "types": ["Supplier"]}], "names": ["balance"]}]),
    ("r3", ["updateOps"], [{"entities": [{"id": None, "pattern": "urn:Cust.*", "types": ["Customer"]}], "names": ["segment"]}]),
    ("r4", ["retrieveOps"], [{"entities": None, "names": ["balance"]}]),
]


@query("L1_registrations", "SELECT unnest(['r1', 'r4']) AS id")
def l1(spark, d):
    shape = "id string, operations array<string>, information array<struct<entities: array<struct<id: string, pattern: string, types: array<string>>>, names: array<string>>>"
    return federation.matching_registrations(spark.createDataFrame(REGISTRATIONS, shape), ids=["urn:Customer:5"], types=["Customer"], attributes=["balance"], operations=["retrieveOps"])


# Mutation --------------------------------------------------------------------------------------------------------------

CHANGE_SQL = "SELECT 'urn:Customer:' || c_custkey AS entity_id, 'balance' AS attribute_name, NULL::VARCHAR AS dataset_id, 0.0::DOUBLE AS num FROM customer WHERE c_custkey % 3 = 0"


def change(spark, d):
    a = attributes(spark, d)
    return a.where((F.col("attribute_name") == "balance") & F.col("dataset_id").isNull() & F.col("entity_id").startswith("urn:Customer:") & (F.split("entity_id", ":")[2].cast("long") % 3 == 0)).withColumn("num", F.lit(0.0))


@query("M2_upsert", f"SELECT a.entity_id, a.dataset_id, coalesce(c.num, a.num) AS num FROM attribute a LEFT JOIN ({CHANGE_SQL}) c ON a.entity_id = c.entity_id AND a.attribute_name = c.attribute_name AND a.dataset_id IS NOT DISTINCT FROM c.dataset_id WHERE a.attribute_name = 'balance'", "attribute")
def m2(spark, d):
    return mutation.upsert(attributes(spark, d), change(spark, d)).where("attribute_name = 'balance'").select("entity_id", "dataset_id", "num")


@query("M3_append_status", "SELECT entity_id, CASE WHEN key % 23 = 0 OR str IS NULL THEN 'created' ELSE 'ignored' END AS status FROM (SELECT 'urn:' || kind || ':' || key AS entity_id, key, segment AS str FROM party)", "attribute")
def m3(spark, d):
    a = attributes(spark, d)
    new = a.where("attribute_name = 'name'").withColumn("attribute_name", F.lit("segment"))
    return mutation.append(a, new, overwrite=False).select("entity_id", "status")


@query("M8_replace_entity", "SELECT entity_id, attribute_name, dataset_id, deleted_at IS NOT NULL OR (key % 3 = 0 AND entity_id LIKE 'urn:Customer:%' AND NOT (attribute_name = 'balance' AND dataset_id IS NULL)) AS deleted FROM attribute WHERE attribute_name <> 'label'", "attribute")
def m8(spark, d):
    out = mutation.replace_entity(attributes(spark, d), change(spark, d), "2024-12-01")
    return out.where("attribute_name <> 'label'").select("entity_id", "attribute_name", "dataset_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("M9_soft_delete", "SELECT entity_id, CASE WHEN deleted_at IS NULL AND list_contains(types, 'Supplier') THEN TIMESTAMP '2024-12-01' ELSE deleted_at END AS deleted_at FROM entity", "entity")
def m9(spark, d):
    e = entities(spark, d)
    return mutation.soft_delete(e, e.where(flt.has_type("Supplier")), "2024-12-01").select("entity_id", "deleted_at")


@query("M10_hard_delete", "SELECT entity_id FROM entity WHERE deleted_at IS NULL", "entity")
def m10(spark, d):
    e = entities(spark, d)
    return mutation.hard_delete(e, e.where("deleted_at is not null")).select("entity_id")


@query("M11_purge", "SELECT entity_id, attribute_name FROM attribute WHERE NOT (entity_id LIKE 'urn:Supplier:%' AND attribute_name IN ('name', 'nation'))", "attribute")
def m11(spark, d):
    return mutation.purge(attributes(spark, d), entities(spark, d).where(flt.has_type("Supplier")), drop=["name", "nation"]).select("entity_id", "attribute_name")


@query("M12_ttl", "SELECT entity_id, CASE WHEN deleted_at IS NULL AND expires_at < TIMESTAMP '2024-06-01' THEN TIMESTAMP '2024-06-01' ELSE deleted_at END AS deleted_at FROM entity", "entity")
def m12(spark, d):
    e = entities(spark, d)
    return mutation.soft_delete(e, flt.expired(e, "2024-06-01"), "2024-06-01").select("entity_id", "deleted_at")


@query("M6_merge_patch", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, value AS v FROM events")
def m6(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("props").alias("payload"), F.to_json(F.struct(F.col("value").alias("v"))).alias("patch"))
    return mutation.patched(rows).select("event_id", F.get_json_object("payload", "$.k").cast("long").alias("k"), F.get_json_object("payload", "$.v").cast("double").alias("v"))


# Access ----------------------------------------------------------------------------------------------------------------

PERMISSIONS = [
    ("p1", "urn:Customer:1", None, None, "ann", "read"), ("p2", None, ["Supplier"], None, "ann", "write"), ("p3", None, ["Customer"], ["/EUROPE/FRANCE"], "staff", "admin"),
    ("p4", None, None, ["@none"], "ann", "own"), ("p5", None, ["Customer"], None, "bob", "own"),
]


def permissions(spark):
    return spark.createDataFrame(PERMISSIONS, "id string, target_id string, target_types array<string>, target_scopes array<string>, assignee string, action string")


@query("Z3_row_filter", "SELECT entity_id FROM entity WHERE entity_id = 'urn:Customer:1' OR list_contains(types, 'Supplier') OR (list_contains(types, 'Customer') AND list_contains(scopes, '/EUROPE/FRANCE')) OR scopes IS NULL", "entity")
def z3(spark, d):
    return access.readable(entities(spark, d), permissions(spark), ["ann", "staff", "public"]).select("entity_id")


@query("Z6_permissions", "SELECT id, of_types FROM (VALUES ('p1', (SELECT array_to_string(types, ',') FROM entity WHERE entity_id = 'urn:Customer:1')), ('p2', NULL), ('p4', NULL)) t(id, of_types)", "entity")
def z6(spark, d):
    return access.detailed(permissions(spark).where("assignee = 'ann'"), entities(spark, d)).select("id", F.array_join("of_types", ",").alias("of_types"))


@query("U1_new_scopes", "SELECT DISTINCT unnest(scopes) AS scope FROM entity EXCEPT SELECT '/EUROPE/FRANCE'", "entity")
def u1(spark, d):
    return access.new_scopes(entities(spark, d), permissions(spark))


# Continuous queries ----------------------------------------------------------------------------------------------------

SUBSCRIPTIONS = [
    ("s1", True, None, None, ["attributeUpdated"], "User", None, ["click"], 50.0, None), ("s2", True, None, None, ["entityUpdated"], None, "r:[12]$", None, None, 20.0),
    ("s3", False, None, None, ["entityUpdated"], None, None, None, None, None), ("s4", True, "2023-01-01 00:00:00", None, ["entityUpdated"], None, None, None, None, None), ("s5", True, None, 60, ["entityUpdated"], None, None, None, None, None),
]


def subscription_table(spark):
    shape = "sub_id string, is_active boolean, expires string, interval int, triggers array<string>, type string, id_pattern string, watched array<string>, least double, most double"
    return spark.createDataFrame(SUBSCRIPTIONS, shape).withColumn("expires_at", F.col("expires").cast("timestamp")).drop("expires")


def event_rows(spark, d):
    i = instances(spark, d)
    return i.select(F.col("instance_id").alias("event_id"), "entity_id", F.array(F.lit("User")).alias("types"), F.lit("attributeUpdated").alias("trigger"), "attribute_name", "time", F.col("measured_value").alias("value"))


@query("T3_match", "SELECT 's1' AS sub_id, instance_id AS event_id FROM instance WHERE attribute_name = 'click' AND measured_value >= 50 UNION ALL SELECT 's2', instance_id FROM instance WHERE regexp_matches(entity_id, 'r:[12]$') AND measured_value <= 20", "instance")
def t3(spark, d):
    return subs.matches(event_rows(spark, d), subscription_table(spark), "2024-01-01").select("sub_id", "event_id")


T5_SQL = """WITH RECURSIVE instance AS (SELECT 'urn:User:' || user_id AS entity_id, event_type AS attribute_name, ts AS time, value AS measured_value, event_id AS instance_id FROM events),
  matched AS (SELECT 's1' AS sub_id, instance_id AS event_id, time FROM instance WHERE attribute_name = 'click' AND measured_value >= 50
    UNION ALL SELECT 's2', instance_id, time FROM instance WHERE regexp_matches(entity_id, 'r:[12]$') AND measured_value <= 20),
  kept AS (SELECT sub_id, min((time, event_id)) AS k FROM matched GROUP BY sub_id
    UNION ALL SELECT kept.sub_id, min((m.time, m.event_id)) FROM kept JOIN matched m ON m.sub_id = kept.sub_id AND m.time >= kept.k[1] + INTERVAL 1 HOUR GROUP BY kept.sub_id)
  SELECT sub_id, k[2] AS event_id, k[1] AS time FROM kept"""


@query("T5_throttle", T5_SQL)
def t5(spark, d):
    return subs.throttled(subs.matches(event_rows(spark, d), subscription_table(spark), "2024-01-01"), 3600)


@query("T2_fan_out", "SELECT entity_id, 'attributeUpdated' AS trigger, attribute_name FROM (SELECT DISTINCT entity_id, attribute_name FROM instance) UNION ALL SELECT DISTINCT entity_id, 'entityCreated', NULL FROM instance", "instance")
def t2(spark, d):
    changes = instances(spark, d).groupBy("entity_id").agg(F.collect_set("attribute_name").alias("attributes")).withColumn("created", F.lit(True))
    return subs.fanned_out(changes)


# The slice end to end --------------------------------------------------------------------------------------------------

@query("flagship", "SELECT entity_id, attribute_name, start, \"end\", avg FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_name ORDER BY start DESC) AS r FROM (SELECT entity_id, attribute_name, date_trunc('day', time) AS start, date_trunc('day', time) + INTERVAL 1 DAY AS \"end\", round(avg(measured_value), 6) AS avg FROM instance WHERE entity_id IN (SELECT entity_id FROM instance WHERE attribute_name = 'click' AND measured_value > 50) AND time >= TIMESTAMP '2024-01-02' GROUP BY ALL)) WHERE r <= 7", "instance")
def flagship(spark, d):
    """Users with a click above 50: daily averages of every kind of event since a day, the last seven buckets of each."""
    rows = instances(spark, d)
    users = rows.where((F.col("attribute_name") == "click") & (F.col("measured_value") > 50)).select("entity_id")
    chosen = rows.where(flt.in_time("after", "2024-01-02")).join(users, "entity_id", "left_semi")
    days = series.bucketed(chosen, ["avg"], period("P1D"), origin=F.lit("2024-01-01").cast("timestamp"))
    return series.newest(days, 7, by=("start",)).select("entity_id", "attribute_name", "start", "end", F.round("avg", 6).alias("avg"))


# Further operators ------------------------------------------------------------------------------------------------------

@query("S11_event_source", "SELECT 'urn:User:' || user_id AS \"entityId\", 'ATTRIBUTE_UPDATE' AS \"operationType\", event_type AS \"attributeName\" FROM events WHERE event_id % 50 <> 0")
def s11(spark, d):
    e = read(spark, d, "events")
    body = F.to_json(F.struct(F.lit("ATTRIBUTE_UPDATE").alias("operationType"), uri("User", "user_id").alias("entityId"), F.col("event_type").alias("attributeName"), F.to_json(F.struct("value")).alias("operationPayload")))
    return subs.decoded(e.select(F.when(F.col("event_id") % 50 == 0, F.lit("[]")).otherwise(body).alias("value")), subs.EVENT).select("entityId", "operationType", "attributeName")


@query("P19_temporal_normalized", "SELECT entity_id, attribute_name, instance_id, time AS observed_at, measured_value AS value FROM instance WHERE time < TIMESTAMP '2024-01-10'", "instance")
def p19(spark, d):
    rows = instances(spark, d).where(flt.in_time("before", "2024-01-10"))
    return series.normalized(rows).select("entity_id", "attribute_name", F.explode("instances").alias("i")).select("entity_id", "attribute_name", F.col("i.instance_id").alias("instance_id"), F.col("i.time").alias("observed_at"), F.col("i.value").alias("value"))


@query("P22_merged_datasets", "SELECT entity_id, attribute_name, count(*) AS instances FROM attribute GROUP BY entity_id, attribute_name", "attribute")
def p22(spark, d):
    a = attributes(spark, d)
    return a.groupBy("entity_id", "attribute_name").agg(F.size(F.collect_list(F.struct("dataset_id", "num", "str", "lang"))).cast("long").alias("instances"))


@query("P10_concise", "SELECT entity_id, count(*) FILTER (NOT several) AS plain, count(*) FILTER (several) AS several FROM (SELECT entity_id, attribute_name, count(*) > 1 OR bool_or(lang IS NOT NULL) AS several FROM attribute WHERE deleted_at IS NULL GROUP BY ALL) GROUP BY entity_id", "attribute")
def p10(spark, d):
    doc = shaping.concise(shaping.documents(attributes(spark, d)))
    values_ = F.map_values("document")
    plain = F.size(F.filter(values_, lambda v: ~v.startswith("[") & ~v.startswith('{"languageMap"')))
    return doc.select("entity_id", plain.cast("long").alias("plain"), (F.size("document") - plain).cast("long").alias("several"))


@query("J2_top_per_series", "SELECT entity_id, attribute_name, instance_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute_name ORDER BY time, instance_id) AS n FROM instance) WHERE n <= 2", "instance")
def j2(spark, d):
    return series.first_points(instances(spark, d), 2).select("entity_id", "attribute_name", "instance_id")


@query("J5_flat_linked", "SELECT DISTINCT dst AS entity_id FROM edge WHERE attribute_name = 'customer' UNION ALL SELECT src FROM edge WHERE attribute_name = 'customer'", "edge")
def j5(spark, d):
    roots = read(spark, d, "orders").select(uri("Order", "o_orderkey").alias("entity_id"))
    return roots.unionByName(shaping.linked(relations(spark, d), roots, 1).select("entity_id").distinct())


@query("J8_entities_of_type", "SELECT DISTINCT attribute_name FROM attribute WHERE entity_id IN (SELECT entity_id FROM entity WHERE list_contains(types, 'Supplier'))", "entity", "attribute")
def j8(spark, d):
    e = entities(spark, d).where(flt.has_type("Supplier")).select("entity_id")
    return attributes(spark, d).join(e, "entity_id", "left_semi").select("attribute_name").distinct()


@query("J9_types_and_kinds", "SELECT array_to_string(types, ',') AS types, attribute_type, count(*) AS n FROM entity JOIN attribute USING (entity_id) GROUP BY ALL", "entity", "attribute")
def j9(spark, d):
    rows = entities(spark, d).select("entity_id", F.array_join("types", ",").alias("types")).join(attributes(spark, d), "entity_id")
    return rows.groupBy("types", "attribute_type").agg(F.count("*").alias("n"))


@query("J15_registration_explode", "SELECT * FROM (VALUES ('r1', 'Customer', NULL), ('r2', 'Supplier', 'balance'), ('r3', 'Customer', 'segment'), ('r4', NULL, 'balance')) t(id, type, name)")
def j15(spark, d):
    shape = "id string, operations array<string>, information array<struct<entities: array<struct<id: string, pattern: string, types: array<string>>>, names: array<string>>>"
    return federation.single_registrations(spark.createDataFrame(REGISTRATIONS, shape)).select("id", F.get("types", F.lit(0)).alias("type"), F.get("names", F.lit(0)).alias("name"))


SUBJECTS = [("u1", "user", ["g1", "g2"]), ("u2", "user", ["g2"]), ("c1", "client", None), ("g1", "group", None), ("g2", "group", None)]


@query("J18_group_members", "SELECT * FROM (VALUES ('u1', 'g1'), ('u1', 'g2'), ('u2', 'g2')) t(subject_id, group_id)")
def j18(spark, d):
    s = spark.createDataFrame(SUBJECTS, "subject_id string, subject_type string, groups_memberships array<string>")
    return access.memberships(s)


@query("J20_replaced_away", "SELECT entity_id, attribute_name, dataset_id FROM attribute a WHERE key % 3 = 0 AND entity_id LIKE 'urn:Customer:%' AND NOT (attribute_name = 'balance' AND dataset_id IS NULL) AND deleted_at IS NULL AND lang IS NULL", "attribute")
def j20(spark, d):
    return mutation.absent(attributes(spark, d).where("deleted_at is null and lang is null"), change(spark, d)).select("entity_id", "attribute_name", "dataset_id")


@query("A5_object_methods", "SELECT attribute_name, count(*) AS \"totalCount\", count(DISTINCT payload) AS \"distinctCount\" FROM instance GROUP BY ALL", "instance")
def a5(spark, d):
    return series.whole_range(instances(spark, d), ["totalCount", "distinctCount"], "payload", "OBJECT", ("attribute_name",)).drop("start", "end")


@query("A7_date_methods", "SELECT attribute_name, count(*) AS \"totalCount\", count(DISTINCT strftime(time, '%Y-%m-%d')) AS \"distinctCount\", min(strftime(time, '%Y-%m-%d')) AS min, max(strftime(time, '%Y-%m-%d')) AS max FROM instance GROUP BY ALL", "instance")
def a7(spark, d):
    rows = instances(spark, d).withColumn("day", F.date_format("time", "yyyy-MM-dd"))
    return series.whole_range(rows, ["totalCount", "distinctCount", "min", "max"], "day", "DATE", ("attribute_name",)).drop("start", "end")


@query("A9_uri_methods", "SELECT attribute_name, count(*) AS \"totalCount\", count(DISTINCT entity_id) AS \"distinctCount\" FROM instance GROUP BY ALL", "instance")
def a9(spark, d):
    return series.whole_range(instances(spark, d), ["totalCount", "distinctCount"], "entity_id", "URI", ("attribute_name",)).drop("start", "end")


@query("A10_unsupported", "SELECT attribute_name, NULL::DOUBLE AS sum FROM (SELECT DISTINCT attribute_name FROM instance)", "instance")
def a10(spark, d):
    return series.whole_range(instances(spark, d), ["sum"], "payload", "JSON", ("attribute_name",)).drop("start", "end")


@query("A13_whole_range", "SELECT entity_id, attribute_name, max(measured_value) AS max, min(time) AS start, max(time) AS \"end\" FROM instance GROUP BY ALL", "instance")
def a13(spark, d):
    return series.whole_range(instances(spark, d), ["max"])


@query("A19_attributes", "SELECT DISTINCT attribute_name FROM attribute WHERE deleted_at IS NULL", "attribute")
def a19(spark, d):
    return attributes(spark, d).where(flt.live()).select("attribute_name").distinct()


@query("A22_permission_counts", "SELECT * FROM (VALUES ('ann', 3::BIGINT), ('staff', 1), ('bob', 1)) t(assignee, n)")
def a22(spark, d):
    return permissions(spark).groupBy("assignee").agg(F.count("*").alias("n"))


@query("W6_scope_last_n", "SELECT entity_id, time FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY time DESC) AS n FROM scope_history) WHERE n <= 2", "scope_history")
def w6(spark, d):
    return series.newest(scope_history(spark, d), 2, keys=("entity_id",), by=("time",)).select("entity_id", "time")


@query("O3_default_order", "SELECT entity_id, created_at FROM entity ORDER BY created_at, entity_id LIMIT 10", "entity")
def o3(spark, d):
    return shaping.page(entities(spark, d).select("entity_id", "created_at").orderBy("created_at", "entity_id"), 10)


@query("U4_list_union", "SELECT 'urn:Customer:' || c_custkey AS entity_id FROM customer UNION ALL SELECT 'urn:Supplier:' || s_suppkey FROM supplier")
def u4(spark, d):
    c = read(spark, d, "customer").select(uri("Customer", "c_custkey").alias("entity_id"))
    return c.unionByName(read(spark, d, "supplier").select(uri("Supplier", "s_suppkey").alias("entity_id")))


@query("U7_array_tests", "SELECT entity_id, types && ['Creditor', 'Supplier'] AS overlap, list_has_all(types, ['Customer', 'Creditor']) AS contains_all FROM entity", "entity")
def u7(spark, d):
    want = F.array(F.lit("Customer"), F.lit("Creditor"))
    return entities(spark, d).select("entity_id", F.arrays_overlap("types", F.array(F.lit("Creditor"), F.lit("Supplier"))).alias("overlap"), (F.size(F.array_except(want, "types")) == 0).alias("contains_all"))


@query("U8_notified_union", "SELECT DISTINCT entity_id FROM instance WHERE attribute_name = 'click' OR measured_value > 90", "instance")
def u8(spark, d):
    i = instances(spark, d)
    return i.where("attribute_name = 'click'").select("entity_id").union(i.where("measured_value > 90").select("entity_id")).distinct()


@query("L7_expiry_of_all_sources", "SELECT user_id, CASE WHEN count(e) = count(*) THEN max(e) END AS expires_at FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 OR event_id % 2 = 0 THEN ts END AS e FROM events) GROUP BY user_id")
def l7(spark, d):
    t = F.col("ts").cast("timestamp")
    none = F.array().cast("array<string>")
    e = read(spark, d, "events").select(F.col("user_id").alias("entity_id"), none.alias("types"), none.alias("scopes"), t.alias("created_at"), t.alias("modified_at"), F.when((F.col("user_id") % 3 == 0) | (F.col("event_id") % 2 == 0), t).alias("expires_at"))
    return federation.merge_members(e).select(F.col("entity_id").alias("user_id"), "expires_at")


@query("L9_bucket_merge", "SELECT attribute_name, time FROM (SELECT DISTINCT attribute_name, date_trunc('day', time) AS time FROM instance)", "instance")
def l9(spark, d):
    day = lambda rows: rows.select("attribute_name", F.date_trunc("day", "time").alias("time")).distinct()
    i = instances(spark, d)
    return federation.merge_series(day(i.where("instance_id % 3 = 0")), day(i.where("instance_id % 3 <> 0")), keys=("attribute_name", "time"))


@query("L10_write_owners", "SELECT attribute_name, CASE attribute_name WHEN 'balance' THEN 'x' WHEN 'segment' THEN 'y' ELSE 'local' END AS owner, count(*) AS n FROM attribute GROUP BY ALL", "attribute")
def l10(spark, d):
    registered = spark.createDataFrame([("balance", "x", "exclusive"), ("balance", "a", "inclusive"), ("segment", "y", "redirect")], "attribute_name string, source string, mode string")
    return federation.owners(attributes(spark, d), registered).groupBy("attribute_name", "owner").agg(F.count("*").alias("n"))


@query("M1_create_or_revive", "SELECT entity_id, CASE WHEN deleted_at IS NULL THEN 'exists' ELSE 'revived' END AS status FROM entity WHERE entity_id LIKE 'urn:Supplier:%' UNION ALL SELECT 'urn:New:1', 'created'", "entity")
def m1(spark, d):
    e = entities(spark, d)
    batch = e.where(flt.has_type("Supplier")).select("entity_id").unionByName(spark.createDataFrame([("urn:New:1",)], "entity_id string"))
    return mutation.created(batch, e)


@query("M14_scope_replace", "SELECT entity_id, CASE WHEN entity_id LIKE 'urn:Supplier:%' THEN '/new' ELSE array_to_string(scopes, ',') END AS scopes FROM entity", "entity")
def m14(spark, d):
    e = entities(spark, d)
    return mutation.updated_scopes(e, e.where(flt.has_type("Supplier")).select("entity_id", F.array(F.lit("/new")).alias("scopes")), "replace").select("entity_id", F.array_join("scopes", ",").alias("scopes"))


@query("M16_append_series", "SELECT entity_id, attribute_name, time, max(instance_id) AS instance_id FROM instance GROUP BY ALL", "instance")
def m16(spark, d):
    i = instances(spark, d)
    return mutation.latest(i.where("instance_id % 2 = 0").unionByName(i.where("instance_id % 2 = 1")), ("entity_id", "attribute_name", "time"), ("instance_id",)).select("entity_id", "attribute_name", "time", "instance_id")


@query("M17_delete_instances", "SELECT instance_id FROM instance WHERE instance_id % 4 <> 0", "instance")
def m17(spark, d):
    i = instances(spark, d)
    return mutation.hard_delete(i, i.where("instance_id % 4 = 0"), ("instance_id",)).select("instance_id")


@query("T6_cooldown", "SELECT * FROM (VALUES ('a'), ('b'), ('d')) t(sub_id)")
def t6(spark, d):
    rows = [("a", None, None, None), ("b", 1000, "failed", "2024-01-01 00:00:00"), ("c", 3600_000, "failed", "2024-01-01 23:30:00"), ("d", 3600_000, None, None)]
    s = spark.createDataFrame(rows, "sub_id string, cooldown int, status string, f string").withColumn("last_failure", F.col("f").cast("timestamp"))
    return subs.cooled_down(s, "2024-01-02").select("sub_id")


@query("T7_bookkeeping", "SELECT sub_id, count(*) AS times_sent, max(time) AS last_notification FROM (SELECT 's1' AS sub_id, time FROM instance WHERE attribute_name = 'click' AND measured_value >= 50 UNION ALL SELECT 's2', time FROM instance WHERE regexp_matches(entity_id, 'r:[12]$') AND measured_value <= 20) GROUP BY sub_id", "instance")
def t7(spark, d):
    return subs.bookkeeping(subs.matches(event_rows(spark, d), subscription_table(spark), "2024-01-01"))


@query("T10_status", "SELECT * FROM (VALUES ('s1', 'active'), ('s2', 'active'), ('s3', 'paused'), ('s4', 'expired'), ('s5', 'active')) t(sub_id, status)")
def t10(spark, d):
    return subs.status(subscription_table(spark), "2024-01-01").select("sub_id", "status")


@query("T9_linked_notification", "SELECT instance_id AS event_id, c_mktsegment AS segment FROM instance JOIN customer ON entity_id = 'urn:User:' || c_custkey WHERE attribute_name = 'click' AND measured_value >= 50", "instance")
def t9(spark, d):
    hit = subs.matches(event_rows(spark, d), subscription_table(spark).where("sub_id = 's1'"), "2024-01-01")
    c = read(spark, d, "customer").select(uri("User", "c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    return hit.join(c, "entity_id").select("event_id", "segment")


@query("Z5_covering_permissions", "SELECT unnest(['p2', 'p4']) AS id")
def z5(spark, d):
    return access.covered(permissions(spark).where("target_id is null"), ["Supplier"], ["@none"]).select("id")


@query("Z2_granted", "SELECT unnest(['p2', 'p4']) AS id")
def z2(spark, d):
    return access.granted(permissions(spark), ["ann"], "write").select("id")


from meridion.plans import further  # noqa: E402, F401  (adds its queries)
