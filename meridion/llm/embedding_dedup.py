"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.llm.common import as_long, components, fixed_rows, grouped, in_arrow, local_roots, materialise
from meridion.llm.vptree import usable

#: Rows of a block of a bucket; a larger bucket is compared block against block.
BLOCK = 1024

#: Large buckets up to this number are broadcast (16 bytes each); more are joined by a shuffle.
MOST_LISTED = 100_000


def tables_for(threshold: float, bits: int, miss: float) -> int:
    """Tables needed so that a pair at the threshold shares no bucket with a probability of at most ``miss``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree))


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Seeded random hyperplanes; each table's are made orthogonal to each other as far as the dimension allows."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(tables):
        m = rng.standard_normal((dim, bits))
        out.append(np.linalg.qr(m)[0] if bits <= dim else m)
    return np.concatenate(out, axis=1)


def code_type(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def normed(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def unit_codes(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The sign code of every row in every table, as unsigned numbers no wider than they need be."""
    signs = (x @ planes(x.shape[1], tables, bits, seed) > 0).reshape(len(x), tables, bits)
    return (signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2).astype(code_type(bits))


def near_duplicates(
    df: DataFrame, threshold: float = 0.93, miss: float = 1e-6, bucket_rows: int = 64, seed: int = 11,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    1. Equal vectors of a label are one class, with a count, before anything is compared.
    2. Each class is hashed by the signs of ``bits`` random projections in several tables. Bits follow the largest label, so
       that a bucket holds about ``bucket_rows`` unrelated rows; tables follow from the bits, so that a pair exactly at the
       threshold is missed in all of them with a probability of at most ``miss``.
    3. In each bucket all cosines are computed in double precision, block against block for buckets above a block. A pair is
       counted only in the first table whose bucket it shares, so counts are those of different links; what leaves a block
       is a count for each row and a tree of links, never the pairs.
    4. Connected components run over those trees.

    Rows with a null label, or a vector that is null, empty, zero or not finite, link with nothing: n_links 0, a component
    of their own. Vectors of different dimension don't link. Repeated rows of one id count as one row; of different vectors
    under one id the smallest label and vector in order stays. Rows with a null id are returned with 0, null and true.
    An empty table gives an empty result. Other columns are not read.
    """
    every = df.select(as_long(F.col(id_col)).alias("id")).distinct()
    labelled = df.where(F.col(label_col).isNotNull()).select(as_long(F.col(id_col)).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    rows = labelled.where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    rows = materialise(rows)
    group = F.xxhash64("label", "vector")
    members = rows.select("id", "label", "vector", group.alias("g1"), F.hash("label", "vector").alias("g2"))
    reps = members.groupBy("g1", "g2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    chosen = rows.select(F.col("id").alias("rep"), "label", "vector").join(reps, "rep").select("rep", "copies", "label", F.size("vector").alias("dim"), "vector")
    chosen = materialise(chosen)
    most = chosen.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    bits = max(4, min(24, math.ceil(math.log2(max(2, most / bucket_rows)))))
    tables = tables_for(threshold, bits, miss)

    width = "<f4" if "float" in df.schema[vector_col].dataType.simpleString() else "<f8"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(width)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([flat[offsets[i] : offsets[i + 1]] for i in at])
                codes = unit_codes(normed(x.astype("<f8")), tables, bits, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))],
                    names=["rep", "copies", "label", "dim", "vec", "codes", "list"],
                )

    coded = materialise(in_arrow(chosen, hashed, "rep long, copies long, label string, dim int, vec binary, codes binary, list array<bigint>"))
    placed = coded.select("rep", "copies", "dim", "vec", "codes", F.posexplode("list").alias("t", "code"), "label").withColumn("bucket", F.xxhash64("label", "dim", "t", "code"))
    # Buckets above a block: each row stands in its block's line and column of block pairs. Only these buckets are listed.
    large = materialise(placed.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK))
    listed = F.broadcast(large) if large.count() <= MOST_LISTED else large
    cut = placed.join(listed, "bucket", "left").withColumn("cuts", F.coalesce(F.ceil(F.col("m") / F.lit(BLOCK)), F.lit(1)).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("cuts")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select("bucket", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).alias("second"), "t", "rep", "copies", "vec", "codes")
    cells = cells.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, ["bucket", "a", "b"]):
            rep = cell.column("rep").to_numpy()
            copies = cell.column("copies").to_numpy()
            if len(rep) < 2:
                continue
            x = normed(fixed_rows(cell.column("vec"), width).astype("<f8"))
            codes = fixed_rows(cell.column("codes"), code_type(bits))
            t = cell.column("t")[0].as_py()
            a, b = cell.column("a")[0].as_py(), cell.column("b")[0].as_py()
            if a == b:
                left = right = np.arange(len(rep))
            else:
                second = cell.column("second").to_numpy(zero_copy_only=False)
                left, right = np.flatnonzero(~second), np.flatnonzero(second)
            if not len(left) or not len(right):
                continue
            i, j = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[i], right[j]
            if a == b:
                i, j = i[i < j], j[i < j]
            first = ~(codes[i, :t] == codes[j, :t]).any(axis=1) if t else np.ones(len(i), dtype=bool)
            i, j = i[first], j[first]
            if not len(i):
                continue
            links = np.zeros(len(rep), dtype=np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = local_roots(len(rep), i, j)
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[root[hit]])], names=["rep", "links", "root"])

    found = materialise(in_arrow(cells, compared, "rep long, links long, root long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    per_class = reps.join(linked, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "g1", "g2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    answers = members.select("id", "g1", "g2").join(per_class, ["g1", "g2"]).select(F.col("id").alias("__id"), "n_links", "component_id")
    out = every.join(answers, F.col("id") == F.col("__id"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
