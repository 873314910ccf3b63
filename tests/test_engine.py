import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meridion.functions import geo
from meridion.functions.time import Period, bucket_end, bucket_start, period
from meridion.operators import access, federation, mutation, series, shaping
from meridion.operators import filters as flt
from meridion.operators.mutation import merge_patch
from meridion.operators.predicates import present, value, where
from meridion.sources.model import NULL
from meridion.streaming import subscriptions as subs

POINT = "entity_id string, attribute_name string, time timestamp, measured_value double, instance_id long"


def at(day: float) -> dt.datetime:
    return dt.datetime(2023, 12, 29, 12) + dt.timedelta(days=day)


def utc(spark, text: str):
    return F.lit(text).cast("timestamp")


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([("e", "a", at(i), float(i + 1), i) for i in range(10)], POINT)


def test_number_aggregates(ten):
    r = series.whole_range(ten, ["totalCount", "distinctCount", "sum", "avg", "min", "max", "stddev", "sumsq"]).first()
    assert (r["totalCount"], r["distinctCount"], r["sum"], r["avg"], r["min"], r["max"], r["stddev"], r["sumsq"]) == (10, 10, 55.0, 5.5, 1.0, 10.0, 3.0276503541, 385.0)


def test_boolean_time_and_unsupported_aggregates(ten):
    r = series.whole_range(ten.withColumn("flag", F.col("instance_id") % 2 == 0), ["avg", "stddev", "sum"], "flag", "BOOLEAN").first()
    assert (r["avg"], r["sum"]) == (0.5, 5) and abs(r["stddev"] - 0.5270462766947299) < 1e-12
    clock = ten.withColumn("clock", F.format_string("%02d:00:02", F.col("instance_id") + 1))
    assert series.whole_range(clock, ["avg"], "clock", "TIME").first()["avg"] == "05:30:02"
    assert series.whole_range(ten, ["sum"], "attribute_name", "STRING").first()["sum"] is None


@pytest.mark.parametrize(("text", "n"), [("P1D", 10), ("PT48H", 6), ("PT12H", 10), ("P1W", 2), ("P2W", 1), ("P1M", 2)])
def test_bucket_counts(spark, ten, text, n):
    b = series.bucketed(ten, ["totalCount"], period(text), origin=utc(spark, "2023-12-28 12:00:00"))
    assert b.count() == n and b.agg(F.sum("totalCount")).first()[0] == 10


def test_buckets_in_a_zone(spark):
    df = spark.createDataFrame([("2024-03-30 23:30:00",), ("2024-03-31 22:30:00",), ("2024-03-31 21:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    day = df.select(bucket_start(F.col("t"), period("P1D"), utc(spark, "2023-12-31 23:00:00"), "Europe/Paris").cast("string").alias("s"))
    assert [r["s"] for r in day.collect()] == ["2024-03-30 23:00:00", "2024-03-31 22:00:00", "2024-03-30 23:00:00"]
    month = df.select(bucket_start(F.col("t"), period("P1M"), zone="Europe/Paris").cast("string").alias("s"))
    assert [r["s"] for r in month.collect()] == ["2024-02-29 23:00:00", "2024-03-31 22:00:00", "2024-02-29 23:00:00"]


def test_periods(spark):
    assert period("P1Y2M") == Period(14, 0) and period("P1DT1H") == Period(0, 25 * 3600 * 10**6) and period("PT0.5S") == Period(0, 500_000)
    for bad in ("P", "PT", "1D", "P1H", "P1DT"):
        with pytest.raises(ValueError):
            period(bad)
    r = spark.range(1).select(bucket_end(utc(spark, "2024-01-31 05:00:00"), period("P1M")).cast("string").alias("e")).first()
    assert r["e"] == "2024-02-29 05:00:00"


@pytest.mark.parametrize(
    ("last_n", "relation", "at_", "until", "want"),
    [
        (False, "after", "2024-01-01", None, ("2024-01-01", 5)), (False, "between", "2024-01-01", "2024-02-01", ("2024-01-01", 5)), (False, "before", "2024-02-01", None, ("first", 5)), (False, None, None, None, ("first", 5)),
        (True, "before", "2024-02-01", None, ("2024-02-01", None)), (True, "between", "2024-01-01", "2024-02-01", ("2024-02-01", None)), (True, "after", "2024-01-01", None, ("last", None)), (True, None, None, None, ("last", None)),
    ],
)
def test_page_range(spark, last_n, relation, at_, until, want):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("e", "a", t(d), 1.0, d) for d in (1, 2, 5)] + [("e", "b", t(d), 1.0, d) for d in (2, 3, 8)] + [("e", "c", t(9), 1.0, 9)]
    r = series.page_range(spark.createDataFrame(rows, POINT), 3, last_n, relation, at_, until).first()
    ends = {"first": t(1), "last": t(8)}
    assert r["range_start"] == (ends[want[0]] if want[0] in ends else dt.datetime.fromisoformat(want[0]))
    assert r["range_end"] == (t(5) if not last_n else t(2))
    assert series.page_range(spark.createDataFrame(rows, POINT), 4).count() == 0
    assert series.paged(spark.createDataFrame(rows, POINT), series.page_range(spark.createDataFrame(rows, POINT), 4)).count() == len(rows)


ATTRIBUTE = "entity_id string, attribute_name string, attribute_type string, value_type string, dataset_id string, num double, str string, lang string, created_at timestamp, deleted_at timestamp"


@pytest.fixture(scope="module")
def values(spark):
    row = lambda e, n, num=None, s=None, lang=None, ds=None, kind="Property": (e, n, kind, "", ds, num, s, lang, at(0), None)
    return spark.createDataFrame(
        [row("equal", "a", 5.0), row("differs", "a", 6.0), row("text", "a", None, "x"), row("array", "a", 5.0), row("array", "a", 7.0), row("other", "b", 5.0),
         row("lang", "l", None, "bonjour", "fr", kind="LanguageProperty"), row("lang", "l", None, "hello", "en", kind="LanguageProperty")], ATTRIBUTE,
    )


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        (lambda: present("a"), "equal differs text array"), (lambda: ~present("a"), "other lang none"), (lambda: value("a") == 5, "equal array"), (lambda: value("a") != 5, "differs array"), (lambda: value("a").like("x"), "text"),
        (lambda: value("a").unlike("x"), "equal differs array other lang none"), (lambda: value("a").between(5, 6), "equal differs array"), (lambda: value("a").outside(5, 6), "array"), (lambda: value("a").one_of(6, 7), "differs array"),
        (lambda: value("a").none_of(5, 6), "array"), (lambda: (value("a") == 5) & (value("a") == 7), "array"), (lambda: ~((value("a") == 5) | present("b")), "differs text lang none"), (lambda: value("l", lang="fr") == "bonjour", "lang"),
        (lambda: value("l", lang="fr") == "hello", ""), (lambda: ~present("a") | (value("a") > 5), "differs array other lang none"),
    ],
)
def test_predicates(spark, values, predicate, want):
    e = spark.createDataFrame([(i,) for i in "equal differs text array other lang none".split()], "entity_id string")
    assert {r[0] for r in where(e, values, predicate()).collect()} == set(want.split())


def test_scopes(spark):
    df = spark.createDataFrame([("1", ["/a/b"]), ("2", ["/a/b/c", "/x"]), ("3", None), ("4", ["/a"]), ("5", ["/a.b"])], "entity_id string, scopes array<string>")
    ids = lambda p: "".join(r[0] for r in df.where(flt.in_scope(p)).orderBy("entity_id").collect())
    assert (ids("/a/b"), ids("/a/+"), ids("/a/#"), ids("/a#"), ids("/+/b/#"), ids("/a.b"), ids("/+")) == ("1", "1", "12", "1245", "2", "5", "24")


def test_geo(spark):
    df = spark.createDataFrame([("p", 0.0, 0.0), ("q", 10.0, 10.0), ("edge", 5.0, 0.0)], "id string, lon double, lat double")
    ids = lambda t: "".join(sorted(r[0] + " " for r in df.where(t).collect())).split()
    ring = [[-5, -5], [5, -5], [5, 5], [-5, 5], [-5, -5]]
    rel = lambda n, k, c: ids(geo.relation(n, k, c, F.col("lon"), F.col("lat")))
    assert rel("within", "Polygon", [ring]) == ["p"] and rel("intersects", "Polygon", [ring]) == ["edge", "p"] and rel("disjoint", "Polygon", [ring]) == ["q"]
    hole = [[-1, -1], [1, -1], [1, 1], [-1, 1], [-1, -1]]
    assert rel("intersects", "Polygon", [ring, hole]) == ["edge"] and rel("equals", "Point", [10, 10, 99]) == ["q"] and rel("within", "LineString", [[0, 0], [20, 20]]) == ["p", "q"]
    d = df.select(geo.distance(F.col("lon"), F.col("lat"), (0.0, 1.0)).alias("d")).first()["d"]
    assert abs(d - 111195.08) < 1


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ({"value": 1, "unitCode": "M"}, {"value": 2}, {"value": 2, "unitCode": "M"}), ({"value": 1, "unitCode": "M"}, {"unitCode": NULL}, {"value": 1}), ({"value": {"a": 1, "b": {"c": 2}}}, {"value": {"b": {"c": None, "d": 3}}}, {"value": {"a": 1, "b": {"d": 3}}}),
        ({"languageMap": {"fr": "oui", "en": "yes"}}, {"languageMap": {"en": NULL, "de": "ja"}}, {"languageMap": {"fr": "oui", "de": "ja"}}), ({}, {"sub": {"value": 1}}, {"sub": {"value": 1}}), ({"json": [1]}, {"json": {"a": 1}}, {"json": {"a": 1}}),
    ],
)
def test_merge_patch(spark, old, new, want):
    assert merge_patch(old, new) == want
    df = spark.createDataFrame([(1, json.dumps(old), json.dumps(new)), (2, json.dumps(old), None)], "id int, payload string, patch string")
    assert {r["id"]: json.loads(r["payload"]) for r in mutation.patched(df).collect()} == {1: want, 2: old}


def test_a_dataset_is_not_deleted_by_a_patch():
    with pytest.raises(ValueError):
        merge_patch({"value": 1}, {"datasetId": NULL})


def test_language_choice(values):
    rows = {r["entity_id"]: (r["str"], r["lang"]) for r in shaping.in_language(values, ["de", "fr"]).where("attribute_name = 'l'").collect()}
    assert rows == {"lang": ("bonjour", "fr")}
    assert shaping.in_language(values, ["de"]).where("attribute_name = 'l'").first()["lang"] == "en"


def test_links():
    assert shaping.links(100, 30, 0) == {"next": 30} and shaping.links(100, 30, 60) == {"prev": 30, "next": 90} and shaping.links(10, 30, 5) == {"prev": 0}


def test_conflicts(spark):
    row = lambda order, aux=False, seen=None, mod=1, exp=None: ("e", "a", None, at(exp) if exp is not None else None, aux, at(seen) if seen is not None else None, at(mod), order)
    shape = "entity_id string, attribute_name string, dataset_id string, expires_at timestamp, auxiliary boolean, observed_at timestamp, modified_at timestamp, source_order int"
    win = lambda *rows: federation.resolve(spark.createDataFrame(list(rows), shape), "2024-06-01").first()["source_order"]
    assert win(row(1), row(2)) == 1 and win(row(1, seen=1), row(2, seen=2)) == 2 and win(row(1), row(2, seen=1)) == 2 and win(row(1), row(2, aux=True, seen=9)) == 1
    assert win(row(1, seen=9, exp=0), row(2)) == 2 and win(row(1, mod=1), row(2, mod=3)) == 2 and win(row(1, exp=0), row(2, aux=True)) == 2


def test_access_without_claims(spark):
    e = spark.createDataFrame([("e", ["T"], ["/s"])], "entity_id string, types array<string>, scopes array<string>")
    p = spark.createDataFrame([("p", None, ["T"], ["/other"], "ann", "read")], "id string, target_id string, target_types array<string>, target_scopes array<string>, assignee string, action string")
    assert access.readable(e, p, None).count() == 1 and access.readable(e, p, ["ann"]).count() == 0


def test_throttle_in_a_stream_equals_the_batch(spark, tmp_path):
    shape = "sub_id string, event_id long, time timestamp"
    rows = [(f"s{i % 3}", i, at(i * 0.013)) for i in range(60)]
    df = spark.createDataFrame(rows, shape)
    want = {(r["sub_id"], r["event_id"]) for r in subs.throttled(df, 5000).collect()}
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], shape).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = subs.throttled(stream, 5000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {(r["sub_id"], r["event_id"]) for r in spark.read.schema(shape).parquet(str(tmp_path / "out")).collect()}
    assert got == want and 3 < len(want) < 60


def test_points_of_a_stream_are_upserted(spark, tmp_path):
    rows = spark.createDataFrame([("e", "a", at(0), 1.0, 1), ("e", "a", at(0), 2.0, 2), ("e", "a", at(1), 3.0, 3)], POINT)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINT).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(subs.upsert_points(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    subs.upsert_points(str(tmp_path / "out"))(spark.createDataFrame([("e", "a", at(0), 9.0, 4)], POINT), 7)
    got = {r["time"]: r["measured_value"] for r in subs.latest_points(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {at(0): 9.0, at(1): 3.0}


def test_periodic_and_cooldown(spark):
    now = "2024-01-02 00:00:00"
    shape = "sub_id string, is_active boolean, interval int, last_notification timestamp, expires_at timestamp, cooldown int, status string, last_failure timestamp"
    t = dt.datetime(2024, 1, 1, 23, 59)
    rows = [("never", True, 60, None, None, None, None, None), ("early", True, 600, t, None, None, None, None), ("late", True, 30, t, None, None, None, None), ("off", False, 1, None, None, None, None, None), ("failed", True, None, None, None, 120_000, "failed", t), ("recovered", True, None, None, None, 1000, "failed", t)]
    df = spark.createDataFrame(rows, shape)
    assert {r["sub_id"] for r in subs.due(df, now).collect()} == {"never", "late"}
    assert {r["sub_id"] for r in subs.cooled_down(df, now).collect()} == {"never", "early", "late", "off", "recovered"}
