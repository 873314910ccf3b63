"""Near-duplicate texts by an LSH forest of minhash signatures with exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.llm.common import as_long, components, fixed_rows, grouped, in_arrow, local_roots, materialise, slices
from meridion.llm.shingles import distinct, mixed, shingle_sets, signature

SLICE = 1000

#: Signature: 16 orders, each of which begins with four minima of its own and goes on with four of others.
ORDERS, DEPTH = 16, 4
MINIMA = ORDERS * DEPTH
LONGEST = 2 * DEPTH

#: The shortest common prefix that makes candidates, where a region is sparse.
SHORTEST = 2

#: How many rows before it in an order a row meets.
NEAR = 4

#: The common prefixes of a candidate pair in all orders together. Pairs at 0.8 have about 50 and seldom under 15 even where
#: none is longer than three; texts that share a passage only have fewer than three on average.
TOGETHER = 6

#: Rows of an order in one task.
STRETCH = 200_000

#: Regions up to four times this size are compared whole in the last round, larger ones block against block.
REGION = 64

#: Up to so many wanted documents are named to all tasks by a filter of 16 bits each; more are found by a semi-join.
MOST_WANTED = 500_000

#: Tables of a row for each region up to this length are broadcast (some dozens of bytes each); longer ones are joined by a shuffle.
MOST_LISTED = 100_000


def signatures(df: DataFrame, words: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, h1, h2, sig)``: size of each document's shingle set, two sums that identify it, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                sets = shingle_sets(pc.fill_null(part.column(1), b"").to_pylist(), words)
                sums = np.array([[s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], dtype=np.uint64).view(np.int64)
                sigs = [signature(s, MINIMA, seed).tobytes() for s in sets]
                n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(sigs, pa.binary())], names=["id", "n", "h1", "h2", "sig"]
                )

    rows = df.select(as_long(F.col(id_col)).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return in_arrow(rows, run, "id long, n long, h1 long, h2 long, sig binary")


def order_of(t: int) -> np.ndarray:
    """Which minima order ``t`` sorts by, the most significant first."""
    return np.concatenate([np.arange(DEPTH) + t * DEPTH, (np.arange(DEPTH) * 5 + (t + 1) * DEPTH) % MINIMA])


def order_keys(classes: DataFrame) -> DataFrame:
    """``(t, key, id)``: for each order the signature's first minima there, as bytes that sort like the list of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = fixed_rows(batch.column(1), "<u4")
            for t in range(ORDERS):
                keys = np.ascontiguousarray(sig[:, order_of(t)].astype(">u4")).view(f"S{4 * LONGEST}")
                data = pa.Array.from_buffers(pa.binary(4 * LONGEST), len(sig), [None, pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), data.cast(pa.binary()), batch.column(0)], names=["t", "key", "id"])

    return in_arrow(classes.select("id", "sig"), run, "t int, key binary, id long")


#: What a walk along an order finds: pairs (a, b, length of the common prefix), members (region, id), and the rows at the
#: borders of a task's stretch (border, id, t, key), which the walk over the borders joins.
FOUND = "kind int, x long, y long, z int, key binary"
PAIR, MEMBER, BORDER = 0, 1, 2


def walked(rows: DataFrame, borders: bool) -> DataFrame:
    """Neighbours and regions from rows ``(t, key, id)`` that stand in order, some ``NEAR`` of them held at a time.

    Each row meets the rows right before it, which are those with the longest common prefix; so in a dense region only long
    prefixes make candidates, in a sparse one any of at least ``SHORTEST`` minima. A region is the rows that agree in the
    first ``DEPTH`` minima; only rows that have a neighbour there, or stand at a border, are named.
    """
    factors = mixed(np.arange(1, DEPTH + 1, dtype=np.uint64)) | np.uint64(1)

    def out(kind: int, x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, key: pa.Array | None = None) -> pa.RecordBatch:
        n = len(x)
        z = np.zeros(n, np.int32) if z is None else z.astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(z), pa.nulls(n, pa.binary()) if key is None else key],
            names=["kind", "x", "y", "z", "key"],
        )

    def members(t: np.ndarray, minima: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        first = (minima[at][:, :DEPTH].astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
        return out(MEMBER, mixed(first + t[at].astype(np.uint64) + np.uint64(1)).view(np.int64), ids[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        t, minima, ids = np.zeros(0, np.int32), np.zeros((0, LONGEST), np.uint32), np.zeros(0, np.int64)
        head = 0
        named = False  # the last row so far is a member already
        edge = lambda border, at: out(BORDER, np.full(len(at), border), ids[at], t[at], pa.array([minima[k].astype(">u4").tobytes() for k in at], pa.binary()))
        for batch in batches:
            if not batch.num_rows:
                continue
            held = len(ids)
            t = np.concatenate([t, batch.column(0).to_numpy()])
            minima = np.concatenate([minima, fixed_rows(batch.column(1), ">u4").astype(np.uint32)])
            ids = np.concatenate([ids, batch.column(2).to_numpy()])
            new = np.arange(held, len(ids))
            if borders and head < NEAR:
                yield edge(number, np.arange(held, min(len(ids), held + NEAR - head)))
                head = min(NEAR, head + len(new))
            with_last = np.zeros(len(ids), dtype=np.int64)
            for back in range(1, NEAR + 1):
                i = new[new >= back]
                same = np.logical_and.accumulate(minima[i] == minima[i - back], axis=1).sum(axis=1) * (t[i] == t[i - back])
                if back == 1:
                    with_last[i] = same
                hit = (same >= SHORTEST) & (ids[i] != ids[i - back])
                if hit.any():
                    a, b = ids[i[hit]], ids[i[hit] - back]
                    yield out(PAIR, np.minimum(a, b), np.maximum(a, b), same[hit])
            joined = with_last >= DEPTH
            mark = joined.copy()
            mark[:-1] |= joined[1:]
            mark[: max(0, held - 1)] = False
            if held and named:
                mark[held - 1] = False
            if borders and not held:
                mark[0] = True  # its region may go on in the stretch before
            if mark.any():
                yield members(t, minima, ids, np.flatnonzero(mark))
            named = bool(mark[-1])
            t, minima, ids = t[-NEAR:], minima[-NEAR:], ids[-NEAR:]
        if borders and len(ids):
            yield edge(number + 1, np.arange(len(ids)))
            if not named:
                yield members(t, minima, ids, np.array([len(ids) - 1]))

    return in_arrow(rows, run, FOUND)


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b, depth)``: neighbours in the orders, with the sum of their common prefixes; and ``(region, id)``.

    The orders are sorted together by range, so that a long run of equal prefixes is spread over tasks (the id sorts last);
    rows at the borders of two tasks meet in a second walk.
    """
    stretches = max(1, -(-classes.count() * ORDERS // STRETCH))
    by_order = order_keys(classes).repartitionByRange(stretches, "t", "key", "id").sortWithinPartitions("t", "key", "id")
    found = materialise(walked(by_order, borders=True))
    edges = found.where(f"kind = {BORDER}").select(F.col("x").alias("border"), F.col("z").alias("t"), "key", F.col("y").alias("id"))
    edges = edges.repartition("border").sortWithinPartitions("border", "t", "key", "id")
    # Rows of different borders that happen to be neighbours are pairs of one order all the same.
    across = walked(edges.select("t", "key", "id"), borders=False).where(f"kind = {PAIR}")
    pairs = found.where(f"kind = {PAIR}").unionByName(across).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("z").alias("depth"))
    return pairs, found.where(f"kind = {MEMBER}").select(F.col("x").alias("region"), F.col("y").alias("id"))


def listed(df: DataFrame) -> DataFrame:
    """A table that is kept, and sent to all tasks where it has at most ``MOST_LISTED`` rows."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= MOST_LISTED else df


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many minima each pair of signatures shares."""
    out = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(left.shape[1]):
        out += left[:, k][:, None] == right[:, k][None, :]
    return out


def candidates(cell: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of an odd row and any row of a cell that may be a link between components, and how many minima they share."""
    odd = cell.column("odd").to_numpy(zero_copy_only=False)
    comp = cell.column("comp").to_numpy()
    sig = fixed_rows(cell.column("sig"), "<u4")
    x = np.flatnonzero(odd)
    same = alike(sig[x], sig)
    i, j = np.nonzero((same >= least) & (comp[x][:, None] != comp[None, :]))
    return x[i], j, same[i, j]


def best_strangers(cells: DataFrame, least: int) -> DataFrame:
    """``(a, b, same)``: each odd row of a cell with the row of another component that shares most minima with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, ["region", "c", "d"]):
            ids = cell.column("id").to_numpy()
            i, j, same = candidates(cell, least)
            order = np.lexsort((ids[j], -same, i))
            i, j, same = i[order], j[order], same[order]
            first = np.diff(i, prepend=-1) != 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[first]]), pa.array(ids[j[first]]), pa.array(same[first].astype(np.int32))], names=["a", "b", "same"])

    return in_arrow(cells, run, "a long, b long, same int")


def surviving(cells: DataFrame, least: int) -> DataFrame:
    """The rows ``(region, c, d, id, comp, odd)`` of each cell that are in some candidate pair of odd and other rows."""
    names = ["region", "c", "d", "id", "comp", "odd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, ["region", "c", "d"]):
            odd = cell.column("odd").to_numpy(zero_copy_only=False)
            if odd.all() or not odd.any():
                continue
            i, j, _ = candidates(cell, least)
            fine = ~odd[j]
            hit = np.zeros(cell.num_rows, dtype=bool)
            hit[i[fine]] = hit[j[fine]] = True
            yield from cell.select(names).filter(pa.array(hit)).combine_chunks().to_batches()

    return in_arrow(cells, run, "region long, c int, d int, id long, comp long, odd boolean")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right one: membership matrices, multiplied some columns at a time."""
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (left, right)]
    common = np.intersect1d(distinct(flat[0]), distinct(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    spots = []
    for values, of in zip(flat, owner, strict=True):
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = common[at] == values if len(common) else np.zeros(len(values), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        spots.append((at[hit][order], of[hit][order]))
    for lo in range(0, len(common), 4096):
        parts = []
        for (at, of), n in zip(spots, out.shape, strict=True):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((n, min(4096, len(common) - lo)), dtype=np.float32)
            m[of[a:b], at[a:b] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def crossed(cells: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)``: trees of the links between odd rows and rows of other components in a cell, at most a link a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, ["region", "c", "d"]):
            odd = cell.column("odd").to_numpy(zero_copy_only=False)
            ids, comp = cell.column("id").to_numpy(), cell.column("comp").to_numpy()
            sets = [np.frombuffer(v, "<u8") for v in cell.column("set").to_pylist()]
            x, y = np.flatnonzero(odd), np.flatnonzero(~odd)
            if not len(x) or not len(y):
                continue
            size = np.array([len(v) for v in sets])
            both = shared_counts([sets[k] for k in x], [sets[k] for k in y])
            linked = (100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)) & (comp[x][:, None] != comp[y][None, :])
            i, j = np.nonzero(linked)
            names, place = np.unique(ids, return_inverse=True)
            root = local_roots(len(names), place[x[i]], place[y[j]])
            far = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], names=["src", "dst"])

    return in_arrow(cells, run, "src long, dst long")


def sets_of(wanted_ids: DataFrame, repeated: bool, df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, set)``: the whole shingle sets of the wanted documents, made anew from the texts and kept, each once.

    Up to ``MOST_WANTED`` documents are named to all tasks by a filter of 16 bits each, so that texts stay where they are
    read; what it lets through by chance finds no partner in later joins. More are found by a semi-join.
    """
    rows = df.select(as_long(F.col(id_col)).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("id is not null")
    count = wanted_ids.count()
    bits = 1 << max(10, math.ceil(math.log2(max(1, 16 * count))))
    slots = [F.pmod(F.xxhash64(F.col("id"), F.lit(s)), F.lit(bits)) for s in (1, 2)]
    if count <= MOST_WANTED:
        slot = wanted_ids.select(F.explode(F.array(*slots)).alias("slot"))
        place, bit = F.floor(F.col("slot") / 32).cast("int"), F.expr("shiftleft(1L, cast(pmod(slot, 32) as int))")
        filled = slot.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
        table = np.zeros(bits // 32, dtype=np.uint32)
        table[filled.column("place").to_numpy()] = filled.column("bits").to_numpy().astype(np.uint32)
        shared = df.sparkSession.sparkContext.broadcast(table)
    else:
        rows, shared = rows.join(wanted_ids, "id", "left_semi"), None

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                keep = np.ones(batch.num_rows, dtype=bool)
                for c in (2, 3):
                    at = batch.column(c).to_numpy()
                    keep &= (shared.value[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1
                batch = batch.filter(pa.array(keep))
            for part in slices(batch, 1, SLICE):
                sets = shingle_sets(pc.fill_null(part.column(1), b"").to_pylist(), words)
                sums = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums, pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["id", "h", "set"])

    sets = in_arrow(rows.select("id", "text", *[s.alias(f"s{i}") for i, s in enumerate(slots)]), wanted, "id long, h long, set binary")
    if repeated:  # rows of an id with the same set are one
        sets = sets.groupBy("id", "h").agg(F.first("set").alias("set"))
    return materialise(sets.select("id", "set"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole shingle sets reach the similarity.

    The first join brings one set to each pair, the second the other; a document in many pairs is a skewed key that the
    planner splits.
    """
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(batch.column(2)[i].as_buffer(), "<u8"), np.frombuffer(batch.column(3)[i].as_buffer(), "<u8")
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both_ >= percent * (len(x) + len(y) - both_):
                    good.append(i)
            part = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays(part.columns[:2], names=["src", "dst"])

    return in_arrow(both.select("a", "b", "sa", "sb"), check, "src long, dst long")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row.

    1. Documents with the same shingle set are one class; from here on only its smallest id is looked at.
    2. Each class has 64 minima and stands in 16 sorted orders, each by eight of them. Its candidates are its neighbours in
       the orders, those with the longest common prefix; how deep that is follows the region: two minima where few share
       them, up to all eight among copies.
    3. First round: each class and the neighbour with the longest common prefixes in all orders together; such pairs are
       confirmed on whole sets.
    4. Second round, for regions (classes that agree in the first four minima of an order) that still hold several components:
       each class outside the largest of them and the class of another component that shares most minima with it.
    5. Third round, for what is still apart: every class outside a region's largest component against all of the region that
       shares enough minima. The whole sets of the classes that are in such pairs are compared block against block, and a block
       gives a tree of links. So what the first rounds left out is made good, without pairs inside a component.
    A pair at the similarity is missed only where it is no candidate, shares no region in any order (about 2 in 10,000 at
    0.8, none at 1) or shares fewer than 36 of 64 minima (about 3 in a million), and then found only through other documents
    that link the two.

    A text without words, or null, has an empty set, links with nothing and is its own component. Rows with a null id
    link with nothing: component null, kept true. Repeated rows get the same answer each; texts of one id that aren't linked
    count as one document all the same. Very long texts are read whole. An empty table gives an empty result. Other columns
    are not read.
    """
    least = 36 * MINIMA // 64
    sketched = materialise(signatures(df, words, seed, id_col, text_col))
    repeated = bool(sketched.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count())
    grouped_sets = sketched.where("n > 0 and id is not null").groupBy("h1", "h2", "n")
    classes = materialise(grouped_sets.agg(F.min("id").alias("id"), F.min("sig").alias("sig")))
    sigs = classes.select("id", "sig").groupBy("id").agg(F.min("sig").alias("sig")) if repeated else classes.select("id", "sig")

    pairs, member = forest(classes)
    pairs = pairs.where(F.col("depth") >= TOGETHER)
    first = materialise(pairs.groupBy("b").agg(F.max_by("a", F.struct("depth", -F.col("a"))).alias("a")).select("a", "b"))
    sizes = member.groupBy("region").agg(F.count("*").alias("m")).where("m > 1")
    multi = materialise(member.join(sizes.select("region"), "region", "left_semi"))

    def ends(*pairs: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.select(F.col(c).alias("id")) for p in pairs for c in "ab"]).distinct()

    def with_sets(sets: DataFrame | None, wanted: DataFrame) -> DataFrame:
        """``sets`` and those of the wanted documents that it lacks."""
        more = materialise(wanted if sets is None else wanted.join(sets.select("id"), "id", "left_anti"))
        return sets_of(more, repeated, df, words, id_col, text_col) if sets is None else sets.unionByName(sets_of(more, repeated, df, words, id_col, text_col))

    def opened(parts: DataFrame) -> DataFrame:
        """Members of the regions that hold several components, their sizes, and which are outside the largest component."""
        of = materialise(multi.join(parts, "id", "left").select("region", "id", F.coalesce("component_id", "id").alias("comp")))
        main = of.groupBy("region", "comp").agg(F.count("*").alias("k")).groupBy("region").agg(
            F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"), F.sum("k").alias("m"), F.max("k").alias("most")
        )
        kept = listed(main.where("m > most").select("region", "main", "m", (F.col("m") - F.col("most")).alias("s")))
        return materialise(of.join(kept, "region").join(sigs, "id").withColumn("odd", F.col("comp") != F.col("main")))

    def blocks(rows: DataFrame) -> DataFrame:
        """Cells of a region: all of it, or every block of strangers with every block of the region's rows."""
        cs, ds = F.ceil(F.col("m") / (8 * REGION)).cast("int"), F.ceil(F.col("s") / (8 * REGION)).cast("int")
        cs, ds = (F.when(F.col("m") <= 4 * REGION, 1).otherwise(n) for n in (cs, ds))
        c, d = F.pmod(F.xxhash64("id", F.lit(6)), cs).cast("int"), F.pmod(F.xxhash64("id", F.lit(8)), ds).cast("int")
        rest = ["id", "comp", "sig", "m"]
        every = rows.select("region", c.alias("c"), F.explode(F.sequence(F.lit(0), ds - 1)).alias("d"), *rest, F.lit(False).alias("odd"))
        strange = rows.where("odd").select("region", F.explode(F.sequence(F.lit(0), cs - 1)).alias("c"), d.alias("d"), *rest, F.lit(True).alias("odd"))
        return every.unionByName(strange).repartition("region", "c", "d").sortWithinPartitions("region", "c", "d")

    sets = with_sets(None, ends(first))
    links = materialise(confirmed(first, sets, percent))
    best = best_strangers(blocks(opened(components(links))), least)
    best = best.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = materialise(best.join(first, ["a", "b"], "left_anti"))
    sets = with_sets(sets, ends(second))
    links = materialise(links.unionByName(confirmed(second, sets, percent)))

    rows = opened(components(links))
    # Blocks of signatures say whose whole sets are needed; those are compared block against block, and only trees of links
    # come out, never the candidates.
    left = materialise(surviving(blocks(rows), least))
    sets = with_sets(sets, left.select("id").distinct())
    left = left.join(sets, "id").repartition("region", "c", "d").sortWithinPartitions("region", "c", "d")
    more = materialise(crossed(left, percent))
    final = components(links.unionByName(more))

    labelled = classes.select("h1", "h2", "n", "id").join(final, "id", "left").select("h1", "h2", "n", F.coalesce("component_id", "id").alias("component_id"))
    out = sketched.select("id", "n", "h1", "h2").join(labelled, ["h1", "h2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
