"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridion.llm.bpe import spaced_pieces, taken, word_ids
from meridion.llm.common import in_arrow, materialise, slices

SLICE = 1500


def tokenised(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: documents as ids with an end id, longer ones cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                texts = pc.replace_substring(pc.fill_null(part.column(1), ""), "\n", " ")
                names, index, begins = spaced_pieces(texts)
                flat, at = taken(*words.pieces(names), index)
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                for k in range(part.num_rows):
                    ids = flat[at[begins[k]] : at[begins[k + 1]]].tobytes() + end
                    for n, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[lo : lo + 4 * capacity]
                        rows.append(k)
                        numbers.append(n)
                        starts.append(lo // 4)
                        lengths.append(len(cut) // 4)
                        sums.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The fullest combination of (length, count), lengths falling, that fits ``room``.

    Bit s of a bitset says that some combination of the lengths seen sums to s. Counts enter as powers of two, so that a
    length takes a number of shifts logarithmic in its count. The walk ends when the room can be filled exactly.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length, count in available:
        left = min(count, room // length) if length <= room else 0
        many = 1
        while left > 0:
            take = min(many, left)
            grown = (reach | reach << take * length) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            many *= 2
            if reach >> room & 1:
                left = 0
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, length -> number in each) for pieces given as length -> count.

    Each bin takes the largest length left and the fullest combination that goes with it. Bins with the same combination are
    filled at once, as often as its lengths last, so the work depends on the number of different lengths (at most the
    capacity), not on the number of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    plan: list[tuple[int, dict[int, int]]] = []
    first = 0
    while first < len(order):
        largest = order[first]
        if not left[largest]:
            first += 1
            continue
        offered = [(length, left[length] - (length == largest)) for length in order[first:] if left[length]]
        used = fullest(offered, capacity - largest)
        used[largest] = used.get(largest, 0) + 1
        times = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        plan.append((times, used))
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks and where they go: arrays sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows = []
    bins = 0
    for times, used in plan:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken.get(length, 0), bins, n, offset))
            taken[length] = taken.get(length, 0) + times * n
            offset += n * length
        bins += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "bin": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def pack(
    df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, rows_per_bucket: int = 100_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``: pieces packed into sequences of ``capacity`` tokens.

    Packing depends on lengths alone. The driver gets the number of pieces of each length, at most ``capacity`` numbers at
    any size of the data, and finds the combinations by minimum bin slack; the n-th piece of a length then takes the n-th
    place that the combinations have for that length. Ranks are counted in buckets of a length, so a length that a third of
    all pieces share isn't counted in one task; the list of places (bounded by lengths and combinations) goes to the tasks.

    Texts are encoded once; pieces, without their ids, are kept in the shared folder. A null or empty text is the end id
    alone. Repeated rows and null ids are packed like any other row. An empty table gives an empty result. Other columns
    are not read.
    """
    pieces = materialise(tokenised(df, tokenizer, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = places(minimum_bin_slack(counts, capacity))
    shared = df.sparkSession.sparkContext.broadcast(plan)
    buckets = max(16, -(-sum(counts.values()) // rows_per_bucket))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col), F.col("piece"), F.col("ids_crc32")), F.lit(buckets)))
    sums = keyed.groupBy("length", "bucket").count()
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32")) - 1
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    ranked = keyed.withColumn("within", within).join(bases, ["length", "bucket"]).select(*names, (F.col("base") + F.col("within")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            nth = rank - p["rank"][at]
            sequence = p["bin"][at] + nth // p["each"][at]
            offset = p["offset"][at] + nth % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(ranked, run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
