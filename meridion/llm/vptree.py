"""Nearest neighbours by vantage-point trees, one for each shard of the rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridion.llm.common import as_long, fixed_rows, grouped, materialise

LEAF = 256


def usable(vector: Column) -> Column:
    """The vector takes part: not null, not empty, all components finite and not null, not all of them zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part, as doubles; a row with a null id does not."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(as_long(F.col(id_col)).alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))


def packed_vectors(df: DataFrame) -> DataFrame:
    """``(id, dim, vec)``: vectors as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<f8")
            vecs = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            dims = np.diff(offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(vecs, type=pa.binary())], names=["id", "dim", "vec"])

    return df.mapInArrow(run, "id long, dim int, vec binary")


def one_per_id(vectors: DataFrame) -> DataFrame:
    """Repeated rows of an id are one row; of different vectors under one id the smallest in byte order stays."""
    return vectors.groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v")).select("id", "v.dim", "v.vec")


def build(points: np.ndarray, leaf: int = LEAF) -> list[tuple]:
    """A vantage-point tree over row numbers: ('in', vantage, radius, near, far) and ('leaf', rows), children by position.

    The vantage point is the row that is farthest from the subset's first row; the radius is the median distance. A subset
    that the radius doesn't divide (equal points) is a leaf.
    """
    nodes: list[tuple] = []

    def grow(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(())
        if len(rows) > leaf:
            spread = ((points[rows] - points[rows[0]]) ** 2).sum(axis=1)
            vantage = rows[int(np.argmax(spread))]
            d = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(axis=1))
            radius = float(np.median(d))
            near = d <= radius
            if 0 < near.sum() < len(rows):
                nodes[me] = ("in", int(vantage), radius, grow(rows[near]), grow(rows[~near]))
                return me
        nodes[me] = ("leaf", rows)
        return me

    grow(np.arange(len(points)))
    return nodes


def search(tree: dict, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k rows of the shard with the largest inner product to each query, ties by smaller id.

    Inner products become distances when a coordinate is added: with m the largest norm and sqrt(m² - |x|²) added to a row,
    0 to a query, the squared distance is |q|² + m² - 2 q·x. A subtree is skipped when the triangle inequality puts all
    of it beyond ``bound / factor``: with factor one nothing nearer is lost, larger factors skip more.
    """
    ids, x, nodes, top = tree["ids"], tree["x"], tree["nodes"], tree["norm"]
    n_q = len(queries)
    q2 = (queries**2).sum(axis=1)
    k_here = min(k, len(ids))
    best = np.full((n_q, k_here), -np.inf)
    visits: list[tuple[np.ndarray, np.ndarray]] = []

    def bound(active: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        return np.sqrt(np.maximum(q2[active] + top * top - 2 * best[active, 0], 0.0))

    def walk(node: int, active: np.ndarray) -> None:
        kind = nodes[node]
        if kind[0] == "leaf":
            rows = kind[1]
            scores = queries[active] @ x[rows].T
            # The query's own row isn't a neighbour: its score must not tighten the bound.
            scores = np.where(own[active][:, None] == ids[rows][None, :], -np.inf, scores)
            both = np.concatenate([best[active], scores], axis=1)
            best[active] = np.sort(np.partition(both, both.shape[1] - k_here, axis=1)[:, -k_here:], axis=1)
            visits.append((active, rows))
            return
        _, vantage, radius, near, far = kind
        d = np.sqrt(np.maximum(q2[active] + top * top - 2 * (queries[active] @ x[vantage]), 0.0))
        inside = d <= radius
        for first, second, mask in ((near, far, inside), (far, near, ~inside)):
            part = active[mask]
            if not len(part):
                continue
            walk(first, part)
            gap = np.abs(d[mask] - radius)
            reach = bound(part) / factor * (1 + 1e-9) + 1e-9
            again = part[gap <= reach]
            if len(again):
                walk(second, again)

    walk(0, np.arange(n_q))
    # Which rows of the leaves visited reach the k-th score; a margin keeps ties that rounding in the products would part.
    who, where = [], []
    for active, rows in visits:
        scores = queries[active] @ x[rows].T
        margin = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(best[active, 0]), best[active, 0], 0.0)))
        a, b = np.nonzero((scores >= (best[active, 0] - margin)[:, None]) & (own[active][:, None] != ids[rows][None, :]))
        who.append(active[a])
        where.append(rows[b])
    who_, where_ = np.concatenate(who), np.concatenate(where)
    exact = np.zeros(len(who_))
    for c in range(queries.shape[1]):  # one fixed order of summation, so that equal rows have equal scores
        exact += queries[who_, c] * x[where_, c]
    order = np.lexsort((ids[where_], -exact, who_))
    who_, where_, exact = who_[order], where_[order], exact[order]
    begins = np.searchsorted(who_, np.arange(n_q))
    rank = np.arange(len(who_)) - begins[who_]
    take = rank < k
    return who_[take], ids[where_[take]], exact[take]


def index(df: DataFrame, shard_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(dim, shard, tree)``: every usable row in the tree of its shard, shards by the hash of the id.

    Shards hold ``shard_rows`` rows on average whatever the size of the data; a tree is one row of about
    ``16 * shard_rows * dim`` bytes, kept in the shared folder.
    """
    rows = materialise(one_per_id(packed_vectors(usable_vectors(df, id_col, vector_col))))
    shards = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = rows.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.col("shards")).cast("int"))
    parts = max(1, -(-rows.count() // shard_rows))
    dealt = dealt.select("dim", "shard", "id", "vec").repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["dim", "shard"]):
            ids = group.column("id").to_numpy()
            x = fixed_rows(group.column("vec"), "<f8")
            norms = np.sqrt((x**2).sum(axis=1))
            top = float(norms.max())
            points = np.concatenate([x, np.sqrt(np.maximum(top * top - norms**2, 0.0))[:, None]], axis=1)
            tree = {"ids": ids, "x": x, "nodes": build(points), "norm": top}
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.column("dim").to_pylist()[:1], pa.int32()), pa.array(group.column("shard").to_pylist()[:1], pa.int32()), pa.array([pickle.dumps(tree, protocol=5)], pa.binary())],
                names=["dim", "shard", "tree"],
            )

    return materialise(dealt.mapInArrow(run, "dim int, shard int, tree binary"))


def nearest(trees: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k nearest of the index by inner product.

    Queries stand in blocks of about ``block_rows``; each block goes to every shard once (an equi-join on the shard's
    number), and a shard answers with k rows for each query. The k of the k from all shards are taken by rank.

    Vectors that are null, empty, all zero or hold null or non-finite components take no part on either side, and rows with
    a null id neither; vectors meet only those of the same dimension. Ties go to the smaller id. A row is never its own
    neighbour; repeated rows of one id are one neighbour. An empty side gives an empty result.
    """
    rows = materialise(one_per_id(packed_vectors(usable_vectors(queries, id_col, vector_col))))
    blocks = max(1, -(-rows.count() // block_rows))
    wanted = trees.select("dim", "shard")
    sent = (
        rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block")
        .agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
        .join(wanted, "dim")
    )
    both = sent.join(trees, ["dim", "shard"]).select(F.col("rows.id").alias("ids"), F.col("rows.vec").alias("vecs"), "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = pickle.loads(batch.column(2)[i].as_py())
                own = batch.column(0)[i].values.to_numpy()
                q = fixed_rows(batch.column(1)[i].values, "<f8")
                who, found, score = search(tree, q, own, k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
