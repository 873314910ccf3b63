"""Helpers shared by the training-data operators: shared-folder checkpoints, grouped batches, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir: executors don't see the driver's temporary files")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return str(context.getCheckpointDir())


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a table in the shared folder, which goes when the application ends.

    Read again, its size is known to the planner, and many small parts are read by few tasks.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def give_back() -> None:
    """Return freed memory to the system: a Python worker is used again by later stages and would keep what this one needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` that gives memory back at the end of each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column has it, whatever its case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def as_long(column: Column) -> Column:
    return column.cast("long")


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text: the fold key of the held-out splits (null id: crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` as tables, from batches in which equal keys stand together.

    Only the run that is open is held, so memory is that of the largest group and one batch.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            if begin == end:
                continue
            key = tuple(values[begin] for values in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, column: int, rows: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and, but for a single longer row, ``most_bytes`` bytes of a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        before = run[begin - 1] if begin else 0
        end = int(np.searchsorted(run, before + most_bytes, side="right"))
        end = max(begin + 1, min(end, begin + rows, batch.num_rows))
        yield batch.slice(begin, end - begin)
        begin = end


def fixed_rows(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """A binary column whose values all have the same length, as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)


#: Links that a task contracts at least, where there are as many.
LINKS = 20_000


def gathered_rows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0 to n - 1 over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(src long, dst long)`` as ``(id, component_id)``, the component's smallest id.

    Every task first replaces the links it holds, at most half a million at a time, by stars to the smallest node of each of
    its own components. Then large-star and small-star steps alternate (Kiveris et al., "Connected components in MapReduce
    and beyond", 2014) until only stars are left. Every step groups by node with a ``min`` that combines before the shuffle
    and joins it back, so a hub's edges are never gathered in one place; each round is written to the shared folder. Nodes
    without an edge are absent. Self-edges are dropped.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered_rows(batches, 25 * LINKS):
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = local_roots(len(names), place[: len(a)], place[len(a) :])
            far = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], names=["src", "dst"])

    def pairs(df: DataFrame) -> DataFrame:
        return df.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()

    edges = edges.where("src <> dst").select("src", "dst")
    tasks = max(1, -(-edges.count() // LINKS))
    now = materialise(in_arrow(edges.coalesce(tasks), stars, "src long, dst long").distinct())
    for _ in range(most_rounds):
        # Done when every node points to one other, which itself points nowhere.
        ends = now.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(now.select(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if not ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").limit(1).count():
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = materialise(pairs(large))
        # Small star: every node points down, so the group of a node is its smaller neighbours and itself.
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        moved = large.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = materialise(pairs(moved.unionByName(low.select("src", F.col("m").alias("dst")))))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("component_id")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component_id")).unionByName(roots)
