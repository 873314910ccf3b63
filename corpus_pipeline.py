"""A training corpus in five stages, each an operator of the training-data part over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridion.llm import language_id, lsh_forest, mixing, toxicity
from meridion.llm.common import crc_of_id, dropped, fresh, shared_folder, table
from meridion.llm.packing import pack
from meridion.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, fitted on the labelled rows outside the held-out fold, doesn't reject.

    A null or empty text has no token and stays; very long texts are read whole; equal texts are judged alike, so ties and
    repeated rows stay or go together; a null id is in the fold of the empty text and its row is judged like any other. No
    labels: nothing goes. An empty table stays empty. Further columns, whatever their names, are carried along.
    """
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_of_id("doc_id") % 5 != 0)
    return toxicity.accepted(docs, model)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, and those whose codewords are too close to call, go.

    So null and empty texts go; very long texts are read whole; languages with the same loss are too close to call; repeated
    rows stay or go together, and a null id is judged like any other. An empty table stays empty. Further columns, whatever
    their names, are carried along.
    """
    model = language_id.fit(docs, crc_of_id("doc_id") % 3 != 1)
    return language_id.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id.

    A document is an id with a text, known by a hash of both: the texts of one id are judged one by one, and where they are
    near copies of each other, the one with the smallest hash stays. Of rows equal in id and text the smallest row stays.
    Rows without an id link with nothing and all stay, and so do null and empty texts. Very long texts are compared whole. An
    empty table stays empty. Further columns are carried along; where rows are equal in id and text, the smallest in their
    order stays.
    """
    key, turn, component = (fresh(c, docs.columns) for c in ("key", "turn", "component"))
    keyed = docs.where("doc_id is not null").withColumn(key, F.xxhash64("doc_id", "text"))
    groups = lsh_forest.near_duplicates(keyed, words=5, percent=80, id_col=key).select(key, F.col("component_id").alias(component)).distinct()
    members = keyed.select("doc_id", key).distinct().join(groups, key)
    first = members.groupBy(component).agg(F.min(F.struct("doc_id", key)).alias("first")).select("first.*")
    # Repeated rows are cut to one before the shuffle: the planner limits the window.
    order = Window.partitionBy("doc_id", key).orderBy(key, *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    rows = keyed.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).join(first, ["doc_id", key], "left_semi")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; repeats are rows of their own.

    A null or empty text has size 0 and follows its source; a null source is a source. Repeated rows share their id's draw,
    null ids one of their own. An empty table stays empty. Further columns, whatever their names, are carried along.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its place in a sequence of 4096 tokens.

    A null or empty text is the end id alone; a longer text than a sequence is cut; repeated rows and null ids are packed
    like any other. An empty table gives an empty result. Further columns are not read.
    """
    return pack(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted random field, language codes, near-duplicate components and the packing can't be put in SQL; the tests compare
#: the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again as the next one's input.

    A stage's folder goes as soon as the next one's is written; the last one's holds the result.
    """
    docs = table(spark, sf_dir, "documents")
    place, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            dropped(spark, f"{place}/{before}")
        before = name
    return docs
