import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from meridion.llm.mixing import source_targets  # noqa: E402

#: Only A-Z are folded when words are compared.
UPPER = {c: c - 32 for c in range(97, 123)}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    parts = {"en": ["the", "ing", "er", "on", "th", "at"], "fr": ["eau", "é", "ou", "en", "tion", "ê"]}
    rows, labels = [], []
    for i in range(700):
        lang = r.choice(list(parts))
        words = ["".join(r.choice(parts[lang]) for _ in range(r.randint(2, 4))) for _ in range(r.randint(12, 50))]
        toxic = r.random() < 0.2
        if toxic:
            for k in r.sample(range(len(words)), 3):
                words[k] = r.choice(["vileword", "nastyone", "gromling"])
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    copies = [(700 + k, rows[k][1].translate(UPPER) if k % 2 else rows[k][1], rows[k][2], "s0") for k in range(0, 40)]
    odd = [(800, None, None, None), (801, "", "en", None), (802, "12 34", None, "s1"), rows[5], rows[5]]
    docs = [(*row, len(row[1] or "")) for row in rows + copies + odd]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, {i: t for i, _, t in labels}


def test_stages(spark, tables, tmp_path):
    path, docs, toxic = tables
    df, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        assert out.columns == COLUMNS or name == "packing"
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(x["doc_id"] for x in df.select("doc_id").collect())
    bad = {i for i, *_ in docs if toxic.get(i, toxic.get(i - 700, 0) if 700 <= i < 740 else 0)}
    assert kept["toxicity"] == sorted(i for i, *_ in docs if i not in bad)
    assert kept["language"] == [i for i in kept["toxicity"] if i not in (800, 801, 802)]
    text = {i: (t or "").lower() for i, t, *_ in docs}
    first: dict[str, int] = {}
    for i in kept["language"]:
        first.setdefault(text[i], i)
    assert kept["near_duplicates"] == sorted(set(first.values()))
    sizes = {}
    for i, t, _, s, _ in docs:
        if i in set(kept["near_duplicates"]):
            sizes[i] = (s, len(t.split()))
    per_source = spark.createDataFrame(list(sizes.values()), "source string, size long")
    targets = {x["source"]: x["target"] / x["source_size"] for x in source_targets(per_source).collect()}
    for i, (s, _) in sizes.items():
        assert int(targets[s]) <= kept["mixing"].count(i) <= int(targets[s]) + 1
    packed = spark.read.parquet(str(tmp_path / "packing")).collect()
    assert sorted(x["doc_id"] for x in packed if x["piece"] == 0) == kept["mixing"]
    assert all(0 <= x["offset"] and x["offset"] + x["length"] <= 4096 for x in packed)


def test_near_duplicates_by_id_and_text(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(40)) for _ in range(8)]
    near = texts[0] + " more"
    rows = [
        (1, texts[0], "s0"), (2, texts[1], "s0"), (2, texts[2], "s0"),  # one id, two texts
        (3, near, "s0"), (3, texts[3], "s0"),  # one of an id's texts is a near copy of another document
        (4, texts[4], "s2"), (4, texts[4], "s1"), (4, texts[4], "s2"),  # one document, several rows
        (5, texts[5], "s0"), (5, texts[5] + " more", "s0"),  # near copies of one id
        (None, texts[6], "s0"), (None, texts[7], "s0"), (None, texts[7], "s0"), (None, texts[0], "s0"), (None, None, "s0"),
    ]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, df.repartition(4), "")
    assert out.columns == COLUMNS
    got = [(x["doc_id"], x["text"], x["source"]) for x in out.collect()]
    assert sum(x[0] == 5 for x in got) == 1
    want = [rows[k] for k in (0, 1, 2, 4, 6)] + rows[10:]
    assert sorted((x for x in got if x[0] != 5), key=str) == sorted(want, key=str)


def test_run_equals_its_stages_and_is_registered(spark, tables):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, tables[0])
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_empty_documents(spark, tables, tmp_path):
    df = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, tables[0]).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert df.count() == 0, name


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")}
