"""Exact token counts of every prefix of a text, from one pass of prefix dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.llm.bpe import byte_counter, gathered, spaced_pieces
from meridion.llm.common import slices

SLICE = 2000


def _unclean(piece: str, special: list[str]) -> bool:
    """The piece can't be counted apart from its neighbours: white space at its ends, nothing in it, a special token."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return not body or body[0].isspace() or body[-1].isspace() or any(s in piece for s in special)


def count_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, list[bytes]]:
    """Token totals and the int8 changes of the prefix count at each byte, per text."""
    counter = byte_counter(path)
    special = [s for s in counter.special]
    marked = pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n")
    pieces, index, begins = spaced_pieces(marked)
    names = pieces.to_pylist()
    bad = np.zeros(len(names), dtype=bool)
    parts: list[bytes] = []
    totals = np.zeros(len(names), dtype=np.int64)
    known = counter.cache
    for i, name in enumerate(names):
        chunk = name if name[:1] == "\n" else " " + name
        got = known.get(chunk)
        if got is None:
            if _unclean(name, special):
                bad[i] = True
                parts.append(b"")
                continue
            got = counter.piece(chunk)
        totals[i] = got[0]
        parts.append(got[1])
    n = len(texts)
    firsts = begins[:-1]
    flagged = np.add.reduceat(bad[index].astype(np.int64), firsts) if len(index) else np.zeros(n, dtype=np.int64)
    flat, at = gathered(parts, index, "i1")
    sums = np.concatenate([[0], np.cumsum(totals[index])])
    out: list[bytes] = []
    tokens = np.zeros(n, dtype=np.int64)
    for k in range(n):
        lo, hi = int(begins[k]), int(begins[k + 1])
        first = names[index[lo]]
        if flagged[k] or first[:1] == "\n":
            tokens[k], deltas = counter.measure(texts[k].as_py() or "")
        else:
            head, deltas = counter.piece(first)
            tokens[k] = head + sums[hi] - sums[lo + 1]
            deltas += flat[at[lo + 1] : at[hi]].tobytes()
        out.append(deltas)
    return tokens, out


def longest_within(deltas: bytes, budget: int, text: bytes) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens that ends between characters, from the stored changes."""
    counts = np.cumsum(np.frombuffer(deltas, dtype="i1"), dtype=np.int64)
    inside = (np.frombuffer(text, dtype=np.uint8) & 0xC0) == 0x80  # bytes that go on with a character
    fits = np.flatnonzero((counts <= budget) & ~np.append(inside[1:], False))
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_count(deltas: bytes, n_bytes: int) -> int:
    """Tokens of the prefix of ``n_bytes`` bytes."""
    return int(np.frombuffer(deltas[:n_bytes], dtype="i1").sum(dtype=np.int64))


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", store: bool = True) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, fit_bytes[, prefix_deltas])`` of every whole text; one narrow pass, no shuffle.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file, the same on every executor. ``prefix_deltas`` holds a
    signed byte for each byte of the text: the change of the token count when the prefix grows by it, so the count at any
    prefix is a sum and ``longest_within`` answers any budget without encoding again. Counts are exact at every prefix
    that ends between characters. ``fit_bytes`` is the longest such prefix within ``limit`` tokens (the count is not
    monotone: a longer prefix may take fewer tokens).

    A null or empty text has 0 bytes and 0 tokens. Very long texts are counted whole; texts are taken some megabytes at a time. Repeated rows and null ids are kept as they come, a row for each row.
    Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                tokens, deltas = count_batch(part.column(1), tokenizer)
                sizes = np.fromiter(map(len, deltas), dtype=np.int64, count=len(deltas))
                over = tokens > limit
                fit = sizes.copy()
                for k in np.flatnonzero(over):
                    fit[k] = longest_within(deltas[k], limit, part.column(1)[k].as_py().encode())
                columns = [part.column(0), pa.array(sizes), pa.array(tokens), pa.array(over), pa.array(fit)]
                if store:
                    columns.append(pa.array(deltas, type=pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_bytes"] + ["prefix_deltas"] * store
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long" + ", prefix_deltas binary" * store
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
