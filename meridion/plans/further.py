"""Registered queries of nested attributes, typing, updates, identities, permissions and subscriptions on driver-table rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.functions import geo
from meridion.operators import access, discovery, federation, mutation, paths, series, shaping
from meridion.operators import filters as flt
from meridion.operators.predicates import value
from meridion.plans.queries import event_rows, query
from meridion.sources.model import NULL, attributes, entities, instances, read, relations, scope_history, uri
from meridion.streaming import subscriptions as subs


def order_values(spark, d) -> DataFrame:
    """Orders as entities with one nested attribute each: ``(key, entity_id, attribute_name, payload)``."""
    o = read(spark, d, "orders")
    quality = F.struct(F.col("o_orderpriority").alias("value"), F.struct(F.col("o_orderstatus").alias("value")).alias("source"))
    body = F.struct(
        F.struct(F.col("o_totalprice").alias("total"), F.struct((F.col("o_custkey") % 10).alias("y")).alias("x")).alias("value"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observedAt"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("EUR")).alias("unitCode"), quality.alias("quality"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")).alias("day"), F.struct((F.col("o_custkey") % 2 == 0).cast("string").alias("value")).alias("even"),
    )
    return o.select(F.col("o_orderkey").alias("key"), uri("Order", "o_orderkey").alias("entity_id"), F.lit("price").alias("attribute_name"), F.to_json(body).alias("payload"))


def path_query(name: str, test, sql: str) -> None:
    query(name, f"SELECT o_orderkey AS key FROM orders WHERE {sql}")(lambda spark, d: order_values(spark, d).where(test(F.col("payload"))).select("key"))


path_query("Q15_sub_attribute", lambda p: paths.compared(paths.member(p, ["quality"]), "1-URGENT", lambda a, b: a == b), "o_orderpriority = '1-URGENT'")
path_query("Q15_sub_sub_attribute", lambda p: paths.compared(paths.member(p, ["quality", "source"]), "F", lambda a, b: a == b), "o_orderstatus = 'F'")
path_query("Q16_system_time", lambda p: paths.compared(paths.member(p, ["observedAt"]), dt.datetime(1997, 1, 1), lambda a, b: a >= b), "o_orderdate >= TIMESTAMP '1997-01-01'")
path_query("Q17_object_path", lambda p: paths.compared(paths.member(p, [], ["x", "y"]), 6, lambda a, b: a > b), "o_custkey % 10 > 6")
path_query("Q21_metadata", lambda p: paths.compared(paths.member(p, ["unitCode"]), "EUR", lambda a, b: a == b), "o_orderkey % 2 = 0")
path_query("Q5_date", lambda p: paths.compared(paths.member(p, ["day"]), dt.date(1996, 6, 15), lambda a, b: a < b), "o_orderdate::DATE < DATE '1996-06-15'")
path_query("Q5_boolean", lambda p: paths.compared(paths.member(p, ["even"]), True, lambda a, b: a == b), "o_custkey % 2 = 0")
path_query("Q5_wrong_type", lambda p: paths.compared(paths.member(p, ["quality"]), 3, lambda a, b: a >= b), "false")


@query("Q5_time", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') < '06:30:00'")
def q5_time(spark, d):
    e = read(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss").alias("t"))
    return e.where(paths.compared(F.col("t"), dt.time(6, 30), lambda a, b: a < b)).select("event_id")


@query("Q4_comparisons", "SELECT op, count(*) AS n FROM (SELECT num, unnest(['==', '!=', '>', '>=', '<', '<=']) AS op FROM attribute WHERE attribute_name = 'balance' AND dataset_id IS NULL) WHERE CASE op WHEN '==' THEN num = 1000 WHEN '!=' THEN num <> 1000 WHEN '>' THEN num > 1000 WHEN '>=' THEN num >= 1000 WHEN '<' THEN num < 1000 ELSE num <= 1000 END GROUP BY op", "attribute")
def q4(spark, d):
    balance, all_ = value("balance", dataset="@none"), attributes(spark, d)
    tests = {"==": balance == 1000, "!=": balance != 1000, ">": balance > 1000, ">=": balance >= 1000, "<": balance < 1000, "<=": balance <= 1000}
    hit = F.array(*[F.when(t.test, F.lit(op)) for op, t in tests.items()])
    return all_.where(flt.live()).select(F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("op")).groupBy("op").agg(F.count("*").alias("n"))


@query("Q22_event_predicate", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 60 AND user_id % 2 = 0")
def q22(spark, d):
    e = event_rows(spark, d)
    shown = e.select("event_id", "entity_id", "attribute_name", F.lit(None).cast("string").alias("dataset_id"), F.col("value").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("timestamp").alias("deleted_at"))
    parity = F.substring_index("entity_id", ":", -1).cast("long") % 2
    shown = shown.unionByName(shown.withColumn("attribute_name", F.lit("parity")).withColumn("num", parity.cast("double")))
    return subs.matching_events(e, shown, (value("click") > 60) & (value("parity") == 0)).select("event_id")


# Geometries ------------------------------------------------------------------------------------------------------------

def geo_query(name: str, relation: str, kind: str, coordinates: list, sql: str) -> None:
    query(name, f"SELECT entity_id FROM entity WHERE {sql}", "entity")(
        lambda spark, d: entities(spark, d, scoped=False).where(geo.relation(relation, kind, coordinates, F.col("lon"), F.col("lat"))).select("entity_id")
    )


geo_query("G3_multipoint", "intersects", "MultiPoint", [[-143, -73], [-106, -56, 3]], "(lon = -143 AND lat = -73) OR (lon = -106 AND lat = -56)")
geo_query("G3_line", "intersects", "LineString", [[-180, 0], [180, 0]], "lat = 0")
geo_query("G3_multiline", "disjoint", "MultiLineString", [[[-180, 0], [180, 0]], [[0, -90], [0, 90]]], "lat <> 0 AND lon <> 0")
geo_query("G3_multipolygon", "within", "MultiPolygon", [[[[-50, -40], [0, -40], [0, 30], [-50, 30], [-50, -40]]], [[[10, 10], [60, 10], [60, 60], [10, 60], [10, 10]]]], "(lon > -50 AND lon < 0 AND lat > -40 AND lat < 30) OR (lon > 10 AND lon < 60 AND lat > 10 AND lat < 60)")


@query("G4_geoproperty", "SELECT entity_id FROM entity WHERE CASE WHEN entity_id LIKE 'urn:Supplier:%' THEN -lat ELSE lat END > 60", "entity")
def g4(spark, d):
    e = entities(spark, d, scoped=False)
    operation = e.withColumn("lat", F.when(flt.has_type("Supplier"), -F.col("lat")).otherwise(F.col("lat")))
    return operation.where(geo.relation("within", "Polygon", [[[-400, 60], [400, 60], [400, 100], [-400, 100], [-400, 60]]], F.col("lon"), F.col("lat"))).select("entity_id")


@query("G6_wkt", "SELECT entity_id, lon, lat FROM entity WHERE lon > 0", "entity")
def g6(spark, d):
    e = entities(spark, d, scoped=False).where("lon > 0").select("entity_id", shaping.wkt_point(F.col("lon"), F.col("lat")).alias("wkt"))
    return e.select("entity_id", shaping.point_of_wkt(F.col("wkt")).alias("p")).select("entity_id", "p.lon", "p.lat")


@query("G7_event_place", "SELECT event_id FROM events WHERE (user_id * 37) % 360 - 180 BETWEEN 0 AND 90")
def g7(spark, d):
    e = read(spark, d, "events").select("event_id", ((F.col("user_id") * 37) % 360 - 180).cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    return e.where(geo.relation("intersects", "Polygon", [[[0, -1], [90, -1], [90, 1], [0, 1], [0, -1]]], F.col("lon"), F.col("lat"))).select("event_id")


# Joins, projections, representations ------------------------------------------------------------------------------------

@query("J1_entity_values", "SELECT e.entity_id, count(a.attribute_name) AS n FROM entity e LEFT JOIN attribute a ON e.entity_id = a.entity_id AND a.deleted_at IS NULL WHERE e.deleted_at IS NULL GROUP BY e.entity_id", "entity", "attribute")
def j1(spark, d):
    a = attributes(spark, d).where(flt.live()).select("entity_id", "attribute_name")
    return entities(spark, d, scoped=False).where(flt.live()).join(a, "entity_id", "left").groupBy("entity_id").agg(F.count("attribute_name").alias("n"))


@query("J6_linked_by_level", "SELECT 'urn:Order:' || o_orderkey AS root, 1 AS level, 'urn:Customer:' || o_custkey AS entity_id FROM orders UNION ALL SELECT 'urn:Order:' || o_orderkey, 2, 'urn:Nation:' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def j6(spark, d):
    roots = read(spark, d, "orders").select(uri("Order", "o_orderkey").alias("entity_id"))
    back = read(spark, d, "customer").select(uri("Nation", "c_nationkey").alias("src"), F.lit("resident").alias("attribute_name"), uri("Customer", "c_custkey").alias("dst"))
    return shaping.linked_once(relations(spark, d).unionByName(back), roots, 3, {2: ["nation"], 3: ["nowhere"]}).select("root", "level", "entity_id")


@query("P3_presence", "SELECT e.entity_id, bool_or(coalesce(a.attribute_name IN ('segment', 'label') AND a.deleted_at IS NULL, false)) AS found FROM entity e LEFT JOIN attribute a USING (entity_id) GROUP BY e.entity_id", "entity", "attribute")
def p3(spark, d):
    return shaping.presence(entities(spark, d, scoped=False), attributes(spark, d), ["segment", "label"])


MEMBERS = [["price"], ["price", "quality"], ["price", "quality", "source"], ["price", "day"], ["owner"], ["owner", "name"]]


def member_rows(spark, d) -> DataFrame:
    path = F.array(*[F.array(*[F.lit(n) for n in m]) for m in MEMBERS])
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.explode(path).alias("path"))


@query("P4_nested_pick", "SELECT o_orderkey AS key, unnest(['price', 'price.quality', 'price.quality.source', 'owner', 'owner.name']) AS member FROM orders")
def p4(spark, d):
    return paths.picked(member_rows(spark, d), {"price": {"quality": {}}, "owner": {}}).select("key", F.array_join("path", ".").alias("member"))


@query("P5_omitted_leaves", "SELECT o_orderkey AS key, unnest(['price', 'price.day', 'owner', 'owner.name']) AS member FROM orders")
def p5(spark, d):
    return paths.omitted(member_rows(spark, d), [["price", "quality"]]).select("key", F.array_join("path", ".").alias("member"))


@query("P11_normalized", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Relationship' WHEN 1 THEN 'VocabProperty' ELSE 'Property' END AS attribute_type, CASE event_id % 3 WHEN 0 THEN 'urn:User:' || user_id WHEN 1 THEN event_type ELSE event_type || '!' END AS value FROM events")
def p11(spark, d):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.to_json(F.struct(uri("User", "user_id").alias("object")))).when(kind == 1, F.to_json(F.struct(F.col("event_type").alias("vocab")))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('!"')))
    return read(spark, d, "events").select("event_id", paths.normalized(raw).alias("m")).select("event_id", "m.attribute_type", "m.value")


@query("P18_core", "SELECT entity_id, array_to_string(types, ',') AS types, created_at, modified_at FROM entity WHERE deleted_at IS NULL", "entity")
def p18(spark, d):
    e = entities(spark, d, scoped=False).where(flt.live())
    return e.select(*shaping.without_system(e.columns, keep="createdAt"), "modified_at").select("entity_id", F.array_join("types", ",").alias("types"), "created_at", "modified_at")


@query("P23_always_arrays", "SELECT event_id, 1 AS n FROM events")
def p23(spark, d):
    one = read(spark, d, "events").select("event_id", F.struct("ts", "value").alias("instance"))
    return shaping.as_arrays(shaping.as_arrays(one, "instance"), "instance").select("event_id", F.size("instance").alias("n"))


@query("P24_scope_values", "SELECT entity_id, count(*) AS n, min(time) AS first FROM scope_history GROUP BY entity_id", "scope_history")
def p24(spark, d):
    return shaping.scope_values(scope_history(spark, d)).select("entity_id", F.size("values").cast("long").alias("n"), F.element_at("values", 1)["time"].alias("first"))


@query("P26_notification", "SELECT entity_id, max(CASE WHEN attribute_name = 'segment' THEN str END) AS segment, max(CASE WHEN attribute_name = 'name' THEN str END) AS label FROM attribute WHERE deleted_at IS NULL AND attribute_name IN ('name', 'segment') GROUP BY entity_id", "attribute")
def p26(spark, d):
    doc = shaping.notification(attributes(spark, d), ["name", "segment", "balance"], ["@none"], {"label": "name"})
    return doc.select("entity_id", F.try_element_at("document", F.lit("segment")).alias("segment"), F.try_element_at("document", F.lit("label")).alias("label"))


@query("P28_expansion", "SELECT entity_id, CASE attribute_name WHEN 'name' THEN 'https://schema.org/name' ELSE 'https://example.org/' || attribute_name END AS attribute_name FROM attribute", "attribute")
def p28(spark, d):
    return paths.expanded(attributes(spark, d), {"name": "https://schema.org/name"}, "https://example.org/", ["attribute_name"]).select("entity_id", "attribute_name")


@query("O7_sorted_types", "SELECT list(DISTINCT t ORDER BY t)[1] AS first, count(DISTINCT t) AS n FROM (SELECT unnest(types) AS t FROM entity WHERE deleted_at IS NULL)", "entity")
def o7(spark, d):
    names = discovery.types(entities(spark, d, scoped=False)).orderBy("type")
    return names.agg(F.array_sort(F.collect_list("type"))[0].alias("first"), F.count("*").alias("n"))


@query("A6_datetime_methods", "SELECT attribute_name, count(*) AS \"totalCount\", count(DISTINCT time) AS \"distinctCount\", min(time) AS min, max(time) AS max FROM instance GROUP BY ALL", "instance")
def a6(spark, d):
    return series.whole_range(instances(spark, d).withColumn("at", F.col("time")), ["totalCount", "distinctCount", "min", "max"], "at", "DATETIME", ("attribute_name",)).drop("start", "end")


@query("A23_oldest_of_series", "SELECT entity_id, attribute_name, min(time) AS origin FROM instance GROUP BY ALL", "instance")
def a23(spark, d):
    return series.oldest(instances(spark, d), ("entity_id", "attribute_name"))


# Writing ---------------------------------------------------------------------------------------------------------------

def balance_change(spark, d) -> DataFrame:
    """New balances of customers: twice the old one, none for every third, and an attribute that isn't there."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    rows = c.select(uri("Customer", "c_custkey").alias("entity_id"), F.lit("balance").alias("attribute_name"), none.alias("dataset_id"), F.when(k % 3 != 0, F.col("c_acctbal") * 2).alias("num"), F.when(k % 3 == 0, F.lit(NULL)).alias("str"))
    return rows.unionByName(c.select(uri("Customer", "c_custkey").alias("entity_id"), F.lit("height").alias("attribute_name"), none.alias("dataset_id"), F.lit(1.0).alias("num"), none.alias("str")))


@query("M4_update", "SELECT entity_id, num FROM (SELECT entity_id, key, CASE WHEN entity_id LIKE 'urn:Customer:%' THEN num * 2 ELSE num END AS num FROM attribute WHERE attribute_name = 'balance' AND dataset_id IS NULL) WHERE NOT (entity_id LIKE 'urn:Customer:%' AND key % 3 = 0)", "attribute")
def m4(spark, d):
    rows, _ = mutation.updated(attributes(spark, d).where("attribute_name = 'balance'"), balance_change(spark, d))
    return rows.where("dataset_id is null").select("entity_id", "num")


@query("M19_update_results", "SELECT attribute_name, status, count(*) AS n FROM (SELECT 'balance' AS attribute_name, CASE WHEN c_custkey % 3 = 0 THEN 'deleted' ELSE 'updated' END AS status FROM customer UNION ALL SELECT 'height', 'notFound' FROM customer) GROUP BY ALL")
def m19(spark, d):
    return mutation.updated(attributes(spark, d), balance_change(spark, d))[1].groupBy("attribute_name", "status").agg(F.count("*").alias("n"))


@query("M5_partial_update", "SELECT o_orderkey AS key, unnest(['observedAt', 'unitCode', 'quality', 'value', 'even']) AS name, unnest([NULL, 'USD', CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE NULL END, NULL, NULL]) AS new FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, unnest(['observedAt', 'unitCode', 'value', 'even', 'quality']), unnest([NULL, 'USD', NULL, NULL, 'x']) FROM orders WHERE o_orderkey % 2 <> 0")
def m5(spark, d):
    current = paths.members(order_values(spark, d), ["key"])
    changes = F.array(F.struct(F.lit("unitCode").alias("name"), F.lit("USD").alias("raw")), F.struct(F.lit("quality").alias("name"), F.lit("x").alias("raw")), F.struct(F.lit("day").alias("name"), F.lit(NULL).alias("raw")), F.struct(F.lit("type").alias("name"), F.lit("Other").alias("raw")))
    patch = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.explode(changes).alias("c")).select("key", "c.name", "c.raw")
    out = paths.partly_updated(current, patch, ["key"])
    return out.select("key", "name", F.when(F.col("name").isin("unitCode", "quality"), F.col("raw")).alias("new"))


@query("M7_replace_attribute", "SELECT entity_id, CASE WHEN entity_id LIKE 'urn:Customer:%' THEN 'new' ELSE str END AS str, created_at FROM attribute WHERE attribute_name = 'name'", "attribute")
def m7(spark, d):
    a = attributes(spark, d).where("attribute_name = 'name'")
    change = a.where(F.col("entity_id").startswith("urn:Customer:")).withColumn("str", F.lit("new")).withColumn("created_at", F.lit("2030-01-01").cast("timestamp"))
    return mutation.replaced_attribute(a, change).select("entity_id", "str", "created_at")


@query("M13_types_grow", "SELECT entity_id, array_to_string(list_sort(list_distinct(list_concat(types, ['Partner']))), ',') AS types FROM entity", "entity")
def m13(spark, d):
    e = entities(spark, d, scoped=False)
    return mutation.updated_types(e, e.select("entity_id", F.array(F.lit("Partner")).alias("types"))).select("entity_id", F.array_join(F.array_sort("types"), ",").alias("types"))


@query("M15_batch_results", "SELECT entity_id, seq, NOT known AND r = 1 AS success, CASE WHEN known THEN 'already exists' WHEN r > 1 THEN 'duplicate in batch' END AS reason FROM (SELECT 'urn:Customer:' || (user_id * 2) AS entity_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, e.entity_id IS NOT NULL AS known FROM events LEFT JOIN (SELECT entity_id FROM entity WHERE deleted_at IS NULL) e ON e.entity_id = 'urn:Customer:' || (user_id * 2))", "entity")
def m15(spark, d):
    batch = read(spark, d, "events").select(uri("Customer", F.col("user_id") * 2).alias("entity_id"), F.col("event_id").alias("seq"))
    return mutation.batch_results(batch, entities(spark, d, scoped=False), "create")


@query("M18_telemetry_merge", "SELECT entity_id, coalesce(v, num) AS num FROM (SELECT entity_id, num FROM attribute WHERE attribute_name = 'balance' AND dataset_id IS NULL) LEFT JOIN (SELECT 'urn:Customer:' || user_id AS entity_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id) USING (entity_id)", "attribute")
def m18(spark, d):
    e = read(spark, d, "events")
    points = e.select(uri("Customer", "user_id").alias("entity_id"), F.lit("balance").alias("attribute_name"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("measured_value"), F.col("event_id").alias("instance_id"))
    return mutation.with_telemetry(attributes(spark, d), points).where("attribute_name = 'balance' and dataset_id is null").select("entity_id", "num")


@query("M20_model_faults", "SELECT entity_id, attribute_name, 'several default instances' AS fault FROM attribute WHERE dataset_id IS NULL GROUP BY ALL HAVING count(*) > 1", "attribute")
def m20(spark, d):
    return paths.faults(attributes(spark, d))


@query("M21_null_values", "SELECT c_custkey AS key, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS gone FROM customer")
def m21(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.lit(NULL)).when(k % 5 == 0, F.to_json(F.struct(F.struct(F.lit(NULL).alias("@none")).alias("languageMap")))).otherwise(F.col("c_name"))
    return read(spark, d, "customer").select(k.alias("key"), mutation.is_null_value(raw).alias("gone"))


IDENTITY = """SELECT 'urn:User:' || user_id AS subject_id, ts AS time, CASE event_id % 7 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'CREATE' ELSE 'UPDATE' END AS operation, event_type AS role FROM events"""


def identity_events(spark, d) -> DataFrame:
    k = F.col("event_id") % 7
    operation = F.when(k == 0, "DELETE").when(k == 1, "CREATE").otherwise("UPDATE")
    return read(spark, d, "events").select(uri("User", "user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("time"), operation.alias("operation"), F.lit("user").alias("subject_type"), F.array("event_type").alias("roles"))


@query("M22_identities", f"SELECT subject_id, role FROM (SELECT subject_id, arg_max(operation, (time, operation)) AS operation, arg_max(role, (time, operation)) AS role FROM ({IDENTITY}) GROUP BY subject_id) WHERE operation <> 'DELETE'")
def m22(spark, d):
    e = identity_events(spark, d)
    known = e.select("subject_id").distinct().select("subject_id", F.lit("user").alias("subject_type"), F.array().cast("array<string>").alias("roles"))
    return mutation.applied_identities(known, e).select("subject_id", F.col("roles")[0].alias("role"))


@query("S12_identity_source", f"SELECT operation AS \"operationType\", count(*) AS n FROM ({IDENTITY}) GROUP BY operation")
def s12(spark, d):
    e = identity_events(spark, d).select(F.col("subject_id").alias("entityId"), F.col("operation").alias("operationType"))
    messages = e.select(F.to_json(F.struct("entityId", "operationType")).alias("value"))
    return subs.decoded(messages, subs.EVENT).groupBy("operationType").agg(F.count("*").alias("n"))


# Federation ------------------------------------------------------------------------------------------------------------

def registrations(spark, d) -> DataFrame:
    """A registration of each supplier: one of its customers, or a pattern, or a type; a third with names; groups of operations."""
    k = F.col("s_suppkey")
    entity = F.struct(F.when(k % 3 == 0, uri("Customer", k)).alias("id"), F.when(k % 3 == 1, F.concat(F.lit("r:"), (k % 10).cast("string"), F.lit("$"))).alias("pattern"), F.array(F.when(k % 2 == 0, F.lit("Customer")).otherwise(F.lit("Supplier"))).alias("types"))
    names = F.when(k % 4 == 0, F.array(F.lit("balance"), F.lit("segment")))
    info = F.array(F.struct(F.array(entity).alias("entities"), names.alias("names")))
    return read(spark, d, "supplier").select(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.array(F.when(k % 5 == 0, F.lit("updateOps")).otherwise(F.lit("retrieveOps"))).alias("operations"), info.alias("information"))


@query("L13_operation_groups", "SELECT 'r' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 4 ELSE 2 END AS n FROM supplier")
def l13(spark, d):
    return federation.with_operations(registrations(spark, d)).select("id", F.size("operations").alias("n"))


@query("L1_registrations_of_suppliers", "SELECT 'r' || s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 AND CASE s_suppkey % 3 WHEN 0 THEN s_suppkey = 6 WHEN 1 THEN s_suppkey % 10 = 6 ELSE true END")
def l1(spark, d):
    return federation.matching_registrations(federation.with_operations(registrations(spark, d)), ids=["urn:Customer:6"], types=["Customer"], operations=["queryEntity"])


@query("L2_single_registrations", "SELECT 'r' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'urn:Customer:' || s_suppkey END AS entity_id FROM supplier")
def l2(spark, d):
    return federation.single_registrations(registrations(spark, d)).select("id", "entity_id")


@query("L3_narrowed_requests", "SELECT 'r' || s_suppkey AS id, 'urn:Customer:6' AS ids, CASE WHEN s_suppkey % 4 = 0 THEN 'balance' ELSE 'balance,name' END AS names FROM supplier WHERE s_suppkey % 2 = 0 AND CASE s_suppkey % 3 WHEN 0 THEN s_suppkey = 6 WHEN 1 THEN s_suppkey % 10 = 6 ELSE true END")
def l3(spark, d):
    asked = federation.narrowed(federation.single_registrations(registrations(spark, d)), ["urn:Customer:6"], ["Customer"], ["balance", "name"])
    return asked.select("id", F.array_join("ids", ",").alias("ids"), F.array_join("names", ",").alias("names"))


@query("U5_registered_names", "SELECT 'r' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END AS n FROM supplier")
def u5(spark, d):
    return federation.narrowed(federation.single_registrations(registrations(spark, d)), None, None, ["balance", "name"]).select("id", F.size("names").alias("n"))


@query("U6_kept_attributes", "SELECT entity_id, attribute_name FROM attribute WHERE entity_id NOT LIKE 'urn:Supplier:%' OR attribute_name = 'name'", "attribute")
def u6(spark, d):
    return mutation.purge(attributes(spark, d), entities(spark, d, scoped=False).where(flt.has_type("Supplier")), keep=["name"]).select("entity_id", "attribute_name")


@query("L4_source_order", "SELECT user_id AS entity_id, arg_min(event_id, (event_id % 3 = 0, event_id)) AS event_id FROM events GROUP BY user_id")
def l4(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("entity_id"), "event_id", (F.col("event_id") % 3 == 0).alias("auxiliary"), F.col("event_id").alias("source_order"))
    return federation.in_source_order(e).select("entity_id", "event_id")


@query("L11_distributed_delete", "SELECT 'urn:User:' || c_custkey AS entity_id, coalesce(event_type, 'local') AS source, CASE WHEN event_type IS NULL THEN 'notFound' ELSE 'deleted' END AS status FROM customer LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events) ON user_id = c_custkey")
def l11(spark, d):
    holders = instances(spark, d).select("entity_id", F.col("attribute_name").alias("source"))
    return federation.distributed_results(read(spark, d, "customer").select(uri("User", "c_custkey").alias("entity_id")), holders)


@query("J21_local_and_remote", "SELECT key, coalesce(c_name, s_name) AS name, CASE WHEN c_name IS NULL THEN 'remote' WHEN s_name IS NULL THEN 'local' ELSE 'both' END AS held_by FROM (SELECT c_custkey AS key, c_name FROM customer) FULL JOIN (SELECT s_suppkey * 20 AS key, s_name FROM supplier) USING (key)")
def j21(spark, d):
    local = read(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    remote = read(spark, d, "supplier").select((F.col("s_suppkey") * 20).alias("entity_id"), F.col("s_name").alias("name"))
    return federation.merged_with_remote(local, remote, ["name"]).withColumnRenamed("entity_id", "key")


# Access ----------------------------------------------------------------------------------------------------------------

def grants(spark, d) -> DataFrame:
    """A permission of each supplier: on a customer, or on types, by turns; five assignees."""
    k = F.col("s_suppkey")
    action = F.element_at(F.array(*[F.lit(a) for a in ("read", "write", "admin", "own")]), (k % 4 + 1).cast("int"))
    return read(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 3 != 0, uri("Customer", F.floor(k / 10))).alias("target_id"), F.when(k % 3 == 0, F.array(F.when(k % 2 == 0, F.lit("Customer")).otherwise(F.lit("Creditor")))).alias("target_types"),
        F.lit(None).cast("array<string>").alias("target_scopes"), F.concat(F.lit("u"), (k % 5).cast("string")).alias("assignee"), action.alias("action"),
    )


def subjects(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    users = c.select(uri("User", "c_custkey").alias("subject_id"), F.lit("user").alias("subject_type"), F.array(F.concat(F.lit("g"), F.col("c_nationkey").cast("string"))).alias("groups_memberships"), F.array("c_mktsegment").alias("roles"))
    groups = read(spark, d, "nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("subject_id"), F.lit("group").alias("subject_type"), F.array().cast("array<string>").alias("groups_memberships"), F.array().cast("array<string>").alias("roles"))
    return users.unionByName(groups)


GRANT = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey // 10 END AS target, 'u' || s_suppkey % 5 AS assignee, s_suppkey % 4 AS strength FROM supplier"


@query("Z1_claims", "SELECT unnest(['admin', 'urn:User:7', 'authenticated', 'public']) AS claim UNION SELECT unnest(['g' || c_nationkey, c_mktsegment]) FROM customer WHERE c_custkey = 7")
def z1(spark, d):
    return access.claims_of(subjects(spark, d), ["admin"], "urn:User:7")


@query("Z2_granted_by_supplier", f"SELECT id FROM ({GRANT}) WHERE assignee IN ('u1', 'u2') AND strength >= 1")
def z2(spark, d):
    return access.granted(grants(spark, d), ["u1", "u2"], "write").select("id")


@query("Z4_single_entity", f"SELECT 'urn:Customer:0' AS entity_id, EXISTS (SELECT 1 FROM ({GRANT}) WHERE assignee = 'u1' AND strength >= 1 AND (target = 0 OR (target IS NULL AND list_contains((SELECT types FROM entity WHERE entity_id = 'urn:Customer:0'), CASE WHEN id % 2 = 0 THEN 'Customer' ELSE 'Creditor' END)))) AS allowed", "entity")
def z4(spark, d):
    return access.checked(entities(spark, d), grants(spark, d), "urn:Customer:0", ["u1"], "write")


@query("Z7_redundant_permissions", f"SELECT id, \"by\" FROM (SELECT id, first_value(id) OVER (PARTITION BY assignee, target ORDER BY strength DESC, id) AS \"by\" FROM ({GRANT}) WHERE target IS NOT NULL) WHERE id <> \"by\"")
def z7(spark, d):
    return access.redundant(grants(spark, d))


@query("Z8_owner_rights", "SELECT 'own:urn:Order:' || o_orderkey AS id, 'urn:Order:' || o_orderkey AS target_id, 'urn:User:7' AS assignee, 'own' AS action FROM orders WHERE o_orderstatus = 'O'")
def z8(spark, d):
    return access.owner_rights(read(spark, d, "orders").where("o_orderstatus = 'O'").select(uri("Order", "o_orderkey").alias("entity_id")), "urn:User:7")


@query("Z9_groups", "SELECT 'g' || n_nationkey AS group_id, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def z9(spark, d):
    return access.group_sizes(subjects(spark, d))


@query("Z10_no_restriction", "SELECT entity_id FROM entity", "entity")
def z10(spark, d):
    return access.readable(entities(spark, d), grants(spark, d), None).select("entity_id")


@query("J12_permissions_for_entity", f"SELECT id, target IS NULL AND id % 2 = 0 AS applies FROM ({GRANT})")
def j12(spark, d):
    return access.for_entity(grants(spark, d), ["Customer"], None).select("id", "applies")


@query("O8_ordered_permissions", f"SELECT id, assignee FROM ({GRANT}) ORDER BY assignee, id LIMIT 20 OFFSET 5")
def o8(spark, d):
    return shaping.page(grants(spark, d).orderBy("assignee", "id"), 20, 5).select("id", "assignee")


@query("A22_permission_actions", f"SELECT assignee, count(*) AS n FROM ({GRANT}) GROUP BY assignee")
def a22(spark, d):
    return grants(spark, d).groupBy("assignee").agg(F.count("*").alias("n"))


# Subscriptions ---------------------------------------------------------------------------------------------------------

def subscription_rows(spark, d) -> DataFrame:
    """A subscription of each supplier; by turns paused, expired, periodic, with faults, with a failure behind it."""
    k = F.col("s_suppkey")
    t = lambda c: F.timestamp_seconds(F.lit(1704067200) + c)
    return read(spark, d, "supplier").select(
        k.alias("sub_id"), (k % 4 != 0).alias("is_active"), F.when(k % 3 == 0, t((k % 20 - 10) * 3600)).alias("expires_at"), F.when(k % 5 == 0, (k % 15 * 60).cast("int")).alias("interval"),
        F.array(F.when(k % 7 == 0, F.lit("other")).otherwise(F.lit("entityUpdated"))).alias("triggers"), F.when(k % 6 != 0, F.lit("User")).alias("type"), F.concat(F.lit("r:"), (k % 10).cast("string"), F.lit("$")).alias("id_pattern"),
        F.when(k % 2 == 0, F.array(F.lit("click"))).alias("watched"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), F.when(k % 10 != 0, t(-(k % 12) * 60)).alias("last_notification"),
        F.when(k % 2 == 1, F.lit(600_000)).alias("cooldown"), F.when(k % 3 == 1, F.lit("failed")).alias("status"), t(-(k % 20) * 60).alias("last_failure"),
    )


SUB = "SELECT s_suppkey AS k, TIMESTAMP '2024-01-01' AS t FROM supplier"


@query("T4_triggers", "SELECT event_id FROM events")
def t4(spark, d):
    return subs.triggered(event_rows(spark, d), "entityUpdated").select("event_id")


@query("T6_cooled_down_suppliers", f"SELECT k AS sub_id FROM ({SUB}) WHERE k % 2 = 0 OR k % 3 <> 1 OR k % 20 > 10")
def t6(spark, d):
    return subs.cooled_down(subscription_rows(spark, d), "2024-01-01").select("sub_id")


@query("T8_due", f"SELECT k AS sub_id FROM ({SUB}) WHERE k % 4 <> 0 AND k % 5 = 0 AND (k % 10 = 0 OR k % 12 > k % 15)")
def t8(spark, d):
    return subs.due(subscription_rows(spark, d), "2024-01-01").select("sub_id")


@query("T10_status_of_suppliers", f"SELECT k AS sub_id, CASE WHEN k % 4 = 0 THEN 'paused' WHEN k % 3 = 0 AND k % 20 < 10 THEN 'expired' ELSE 'active' END AS status FROM ({SUB})")
def t10(spark, d):
    return subs.status(subscription_rows(spark, d), "2024-01-01").select("sub_id", "status")


@query("T11_subscription_faults", f"SELECT k AS sub_id, unnest(list_filter([CASE WHEN k % 6 = 0 AND k % 2 <> 0 THEN 'neither entities nor attributes' END, CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 'interval and watched attributes' END, CASE WHEN k % 15 = 0 THEN 'interval not positive' END, CASE WHEN k % 3 = 0 AND k % 20 < 10 THEN 'expired' END, CASE WHEN k % 7 = 0 THEN 'unknown trigger' END], lambda x: x IS NOT NULL)) AS fault FROM ({SUB})")
def t11(spark, d):
    return subs.faults(subscription_rows(spark, d), "2024-01-01")


@query("T13_expired", f"SELECT k AS sub_id FROM ({SUB}) WHERE k % 3 = 0 AND k % 20 < 10")
def t13(spark, d):
    rows = subscription_rows(spark, d).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return flt.expired(rows, "2024-01-01").select("sub_id")


@query("J16_selectors", "SELECT s_nationkey AS sub_id, count(DISTINCT s_suppkey % 10) AS patterns FROM supplier GROUP BY s_nationkey")
def j16(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("sub_id"), F.lit("User").alias("type"), F.concat(F.lit("r:"), (F.col("s_suppkey") % 10).cast("string"), F.lit("$")).alias("id_pattern"), F.lit(None).cast("string").alias("id"))
    return subs.merged_selectors(s).select("sub_id", F.size("patterns").cast("long").alias("patterns"))


@query("J17_selected_events", "SELECT DISTINCT s_nationkey AS sub_id, event_id FROM supplier JOIN events ON user_id % 10 = s_suppkey % 10 WHERE s_suppkey < 5")
def j17(spark, d):
    s = read(spark, d, "supplier").where("s_suppkey < 5").select(F.col("s_nationkey").alias("sub_id"), F.lit("User").alias("type"), F.concat((F.col("s_suppkey") % 10).cast("string"), F.lit("$")).alias("id_pattern"), F.lit(None).cast("string").alias("id"))
    return subs.selected_events(event_rows(spark, d), s)


@query("T1_telemetry_to_attributes", "SELECT entity_id, attribute_name, arg_max(measured_value, (time, instance_id)) AS num FROM instance GROUP BY ALL", "instance")
def t1(spark, d):
    i = instances(spark, d)
    empty = i.select("entity_id", "attribute_name").distinct().withColumn("dataset_id", F.lit(None).cast("string")).withColumn("num", F.lit(None).cast("double"))
    return mutation.with_telemetry(empty, i).select("entity_id", "attribute_name", "num")


@query("F4_types_of_events", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def f4(spark, d):
    e = event_rows(spark, d).withColumn("types", F.array(F.lit("User"), F.col("attribute_name")))
    return e.where(flt.has_type("User") & (flt.has_type("click") | flt.has_type("error"))).select("event_id")


@query("F12_time_property", "SELECT entity_id FROM entity WHERE modified_at >= TIMESTAMP '2024-06-01'", "entity")
def f12(spark, d):
    return entities(spark, d, scoped=False).where(flt.in_time("after", "2024-06-01", column="modified_at")).select("entity_id")


@query("F15_valid_names", "SELECT c_custkey AS key, c_custkey % 4 <> 0 AS valid FROM customer")
def f15(spark, d):
    name = F.when(F.col("c_custkey") % 4 == 0, F.lit("bad name<")).otherwise(F.lit("balance"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("key"), flt.valid_name(name).alias("valid"))


@query("O2_distance_order_is_by_value", "SELECT entity_id, lat FROM entity ORDER BY lat, entity_id LIMIT 10", "entity")
def o2(spark, d):
    return shaping.page(entities(spark, d, scoped=False).orderBy("lat", "entity_id"), 10).select("entity_id", "lat")


@query("P29_built_values", "SELECT event_id, value, ts AS time FROM events")
def p29(spark, d):
    e = instances(spark, d)
    built = e.select("instance_id", F.to_json(F.struct(F.col("measured_value").alias("value"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observedAt"))).alias("payload"))
    p = F.col("payload")
    return built.select(F.col("instance_id").alias("event_id"), paths.member(p, [], kind="double").alias("value"), paths.member(p, ["observedAt"], kind="string").cast("timestamp").alias("time"))

