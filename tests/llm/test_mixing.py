import random
import re

from meridion.llm.mixing import mix, mixing_plan, source_targets


def poured(sizes: dict, weights=(1, 2, 3), most=3.0) -> dict:
    """Targets by pouring again and again: capped sources are fixed and the excess is shared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_targets_equal_pouring(spark):
    r = random.Random(4)
    for trial in range(6):
        sizes = {f"s{i:02d}" if i else None: r.choice([0, 1, 5, 50, 500, 5000]) for i in range(r.randint(1, 12))}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {x["source"]: x["target"] for x in source_targets(rows).collect()}
        want = poured(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), (trial, sizes, got, want)


def test_copies_follow_the_plan(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40))), r.choice(["a", "b", "c", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("text", "text")
    plan = {x["doc_id"]: x for x in mixing_plan(df).collect()}
    assert {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows} == {i: x["size"] for i, x in plan.items()}
    assert max(x["copies"] for x in plan.values()) <= 3
    counts = {x["doc_id"]: x["count"] for x in mix(df).groupBy("doc_id").count().collect()}
    assert counts == {i: x["copies"] for i, x in plan.items() if x["copies"]}
    for s in ("a", "b", "c", None):
        mine = [x for x in plan.values() if x["source"] == s]
        assert abs(sum(x["size"] * x["copies"] for x in mine) / mine[0]["target"] - 1) < 0.1
    assert [tuple(x) for x in mixing_plan(df.repartition(7)).orderBy("doc_id").collect()] == [tuple(x) for x in mixing_plan(df).orderBy("doc_id").collect()]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "", "a", 2), (2, "x y", "a", 3), (2, "x y", "a", 3)], "doc_id long, text string, source string, size int")
    rows = mixing_plan(df).collect()
    assert sorted(str(x["doc_id"]) for x in rows) == ["1", "2", "2", "None"]
    assert {x["size"] for x in rows if x["doc_id"] == 2} == {2}
    assert [x["copies"] for x in rows if x["source"] is None] == [0]
    assert mix(df).columns == df.columns
    assert mixing_plan(df.limit(0)).count() == 0 and mix(df.limit(0)).count() == 0
    assert mixing_plan(df.withColumn("text", df.text.substr(1, 0))).selectExpr("sum(copies)").first()[0] == 0


def test_mix_with_clashing_names(spark):
    rows = [(i, f"w{i} x", f"s{i % 3}", 7, 8, 9, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, source_ int, rate int, copy int, size int")
    out = mix(df)
    assert out.columns == df.columns
    want = {r["doc_id"]: r["copies"] for r in mixing_plan(df).collect()}
    got = [r["doc_id"] for r in out.collect()]
    assert {i: got.count(i) for i in want} == want
