import math
import random
import re

import numpy as np
import pytest

from meridion.llm import embedding_dedup, lsh_forest
from meridion.llm.common import components
from meridion.llm.vptree import index, nearest

VECTORS = "vec_id long, embedding array<float>, label int, dim string, rep string"


def vectors(n: int, dim: int, seed: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    base = r.standard_normal((max(2, n // 6), dim))
    x = base[r.integers(0, len(base), n)] + r.standard_normal((n, dim)) * r.choice([0.0, 0.15, 0.3, 1.0], n)[:, None]
    return [(i, [float(v) for v in x[i].astype(np.float32)], int(r.integers(0, 3)), "d", "r") for i in range(n)]


ODD_VECTORS = [
    (900, None, 1, None, None), (901, [0.0] * 6, 1, None, None), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, None, None), (903, [math.nan] * 6, 1, None, None),
    (904, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1, None, None), (905, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None, None, None), (906, [1.0, 2.0], 1, None, None), (907, [], 1, None, None),
    (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1, None, None), (908, [1e30, 0.0, 0.0, 0.0, 0.0, 1e30], 2, None, None), (909, [1e-30, 0.0, 0.0, 0.0, 0.0, 1e-30], 2, None, None),
]


def usable(v) -> bool:
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def roots(pairs, ids):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, i) for i in range(1001, 1050)]
    r = random.Random(1)
    edges = chain + hub + [(5, 5)]
    r.shuffle(edges)
    got = {x["id"]: x["component_id"] for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1050)}}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(260, 6, 3) + ODD_VECTORS
    rows += [(300 + i, rows[0][1], rows[0][2], None, None) for i in range(30)] + [rows[5], rows[5]]
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    one = {r[0]: r for r in rows if r[0] is not None}
    assert got.keys() == {r[0] for r in rows}
    links = []
    ids = sorted(one)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            u, v = one[a], one[b]
            if u[2] is not None and u[2] == v[2] and usable(u[1]) and usable(v[1]) and len(u[1]) == len(v[1]):
                x, y = np.array(u[1]), np.array(v[1])
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((a, b))
    counts = dict.fromkeys(ids, 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    comp = roots(links, ids)
    assert {i: got[i]["n_links"] for i in ids} == counts
    assert {i: got[i]["component_id"] for i in ids} == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in ids)
    assert tuple(got[None])[1:] == (0, None, True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest_equal_brute_force_and_recall(spark):
    rows = vectors(700, 6, 5) + ODD_VECTORS + [(2000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1, None, None) for i in range(60)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, VECTORS)
    trees = index(df, shard_rows=200)
    queries = df.where("vec_id % 20 = 0")
    got: dict[int, list] = {}
    for x in nearest(trees, queries, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    good = {r[0]: [float(np.float32(c)) for c in r[1]] for r in rows if r[0] is not None and usable(r[1])}
    loose: dict[int, set] = {}
    for x in nearest(trees, queries, k=20, factor=2.0).collect():
        loose.setdefault(x["query_id"], set()).add(x["vec_id"])
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        found = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                s = 0.0
                for a, b in zip(good[q], v, strict=True):
                    s += a * b
                found.append((i, s))
        want = sorted(found, key=lambda p: (-p[1], p[0]))[:20]
        assert got[q] == want, q
        hits += len(loose[q] & {i for i, _ in want})
        total += len(want)
    assert hits / total >= 0.6
    assert nearest(index(df.limit(0)), queries).count() == 0 and nearest(trees, queries.limit(0)).count() == 0


def shingled(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 6)))
    out, i = [], 0
    shared = " ".join(word() for _ in range(60))
    for n in (1, 1, 2, 5, 150):
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(n):
            text = list(base)
            for _ in range(r.randint(0, 6)):
                text[r.randrange(len(text))] = word()
            out.append((i, r.choice([" ", "\n", "\t "]).join(text), "x", "y"))
            i += 1
    for _ in range(60):
        out.append((i, " ".join(word() for _ in range(r.randint(10, 60))) + " " + shared, None, None))
        i += 1
    out += [(i, None, None, None), (i + 1, "", None, None), (i + 2, " \n ", None, None), (i + 3, "one", None, None), (i + 4, "ONE", None, None), (i + 5, "a b c", None, None), (i + 6, "é É b c d", None, None)]
    out += [(i + 7, out[4][1].upper(), None, None), (i + 8, "w " * 30000, None, None), (i + 9, "w " * 20000, None, None), out[3], out[3], (None, out[3][1], None, None), (None, None, None, None)]
    return out


@pytest.mark.parametrize("words", [4, 5])
@pytest.mark.parametrize("region", [64, 8])
def test_near_duplicates_equal_brute_force(spark, words, region, monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", region)
    rows = corpus(words)
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n string")
    got = lsh_forest.near_duplicates(df, words=words).collect()
    assert len(got) == len(rows)
    one = {i: shingled(t, words) for i, t, *_ in rows if i is not None}
    ids = sorted(one)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if one[a] and one[b] and 100 * len(one[a] & one[b]) >= 80 * len(one[a] | one[b])]
    comp = roots(pairs, ids)
    for x in got:
        if x["doc_id"] is None:
            assert (x["component_id"], x["kept"]) == (None, True)
        else:
            assert (x["n_shingles"], x["component_id"], x["kept"]) == (len(one[x["doc_id"]]), comp[x["doc_id"]], comp[x["doc_id"]] == x["doc_id"]), x
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0
