"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.llm.common import fresh, in_arrow, materialise, slices

SLICE = 1000
BUCKET_BITS = 15

#: ASCII capitals to small letters, other ASCII but letters to a space, the bytes of other characters as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def codewords(classes: int, seed: int = 2) -> np.ndarray:
    """A matrix of +1 and -1 with a row for each class.

    All the different splits where that is at most 15 of them; else of many seeded random matrices of 10 log2(classes)
    columns the one whose closest rows are farthest apart.
    """
    if classes < 2:
        return np.ones((classes, 0), dtype=np.int8)
    if classes <= 5:
        splits = [[1, *((1 if k >> i & 1 else -1) for i in range(classes - 1))] for k in range(2 ** (classes - 1) - 1)]
        return np.array(splits, dtype=np.int8).T
    rng = np.random.default_rng(seed)
    columns = math.ceil(10 * math.log2(classes))
    best, most = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(classes, columns))
        gram = m.astype(int) @ m.T
        far = columns - int(np.max(gram - np.eye(classes, dtype=int) * 10**6))
        if far > most and (np.abs(m.sum(axis=0)) < classes).all():
            best, most = m, far
    return best


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every three-byte window with a letter in it, where each text's windows begin).

    Texts stand between spaces, so that words begin and end with one. Windows without a letter are in bucket 0.
    """
    joined = b" " + b"  ".join(texts).translate(FOLD) + b"  "
    a = np.frombuffer(joined, dtype=np.uint8).astype(np.uint32)
    window = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    bucket = (window * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    bucket[window == 0x202020] = 0
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    return bucket, np.concatenate([[0], np.cumsum(sizes)])


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over ``(lang, text)``: counts are summed in each batch, then by the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for lang in set(langs.tolist()):
                bucket, _ = grams([texts[i] for i in np.flatnonzero(langs == lang)])
                n = np.bincount(bucket, minlength=1 << BUCKET_BITS)
                n[0] = 0
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    return in_arrow(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their codewords, a weight per bucket and bit, and the weights of the bits in decoding."""

    def __init__(self, langs: list[str], counts: np.ndarray, sharpness: float) -> None:
        self.langs = langs
        self.code = codewords(len(langs)).astype(np.float32)
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        seen = (counts.sum(axis=0) > 0).astype(np.float32)
        self.weights = np.zeros((1 << BUCKET_BITS, self.code.shape[1]), dtype=np.float32)
        for bit in range(self.code.shape[1]):
            yes = self.code[:, bit] > 0
            # Languages of a side count alike, however many rows each has.
            self.weights[:, bit] = (np.log(share[yes].mean(axis=0)) - np.log(share[~yes].mean(axis=0))) * seen
        self.sharpness = sharpness
        self.trust = np.ones_like(self.code)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The mean log odds of each bit over a text's n-grams."""
        bucket, begins = grams(texts)
        n = np.add.reduceat((bucket > 0).astype(np.int64), begins[:-1])
        sums = np.empty((len(texts), self.weights.shape[1]))
        for bit in range(self.weights.shape[1]):
            sums[:, bit] = np.add.reduceat(self.weights[:, bit][bucket], begins[:-1])
        return sums / np.maximum(n, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted logistic loss of each language's codeword; bits weigh what they were right in training."""
        z = margins[:, None, :] * self.sharpness * self.code[None, :, :]
        weights = self.trust / np.maximum(self.trust.sum(axis=1, keepdims=True), 1e-9)
        return (np.logaddexp(0.0, -z) * weights[None, :, :]).sum(axis=2)

    def decide(self, texts: list[bytes], letters: np.ndarray, ambiguous_below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, one more for none; score; whether it is too close to call or none) of each text."""
        n = len(texts)
        if not self.langs:
            return np.zeros(n, dtype=np.int64), np.zeros(n), np.ones(n, dtype=bool)
        loss = self.losses(self.margins(texts)) * max(1, self.code.shape[1])
        score = 1.0 / np.exp(-(loss - loss.min(axis=1, keepdims=True))).sum(axis=1)
        second = np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) if len(self.langs) > 1 else np.full(n, np.inf)
        return np.where(letters, loss.argmin(axis=1), len(self.langs)), np.where(letters, score, 0.0), ~letters | (second < ambiguous_below)


def sample_of(df: DataFrame, keep: Column, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, text)``: about ``per_language`` labelled rows of each language, chosen by the hash of the id."""
    rows = df.where(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    # One number for each language, as the model has rows for each language; joining them would shuffle the texts.
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return rows.select("lang", "text").where(F.lit(False))
    n = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(r["count"]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw * n < per_language).select("lang", "text")


def fit(df: DataFrame, keep: Column, per_language: int = 2000, sharpness: float = 12.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``per_language`` rows of each language (the bound) for which ``keep`` holds, their whole texts.

    The sample is kept in the shared folder, so that texts are read once for it. The driver gets a count for each language
    and bucket, and how often each bit is right for each language. Rows with a null language or text teach nothing, repeated
    rows are drawn together, and an empty table gives a model without languages.
    """
    rows = materialise(sample_of(df, keep, per_language, id_col, text_col, lang_col))
    counted = gram_counts(rows).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(langs), 1 << BUCKET_BITS))
    counts[counted["lang"].map(place).to_numpy(dtype=np.int64), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    model = Model(langs, counts, sharpness)
    if model.code.shape[1]:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()])
                right = model.margins(batch.column(1).to_pylist()) * model.code[at] > 0
                for i in np.unique(at[at >= 0]):
                    mine = right[at == i]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * mine.shape[1], pa.int32()), pa.array(range(mine.shape[1]), pa.int32()), pa.array(mine.sum(axis=0)), pa.array([len(mine)] * mine.shape[1], pa.int64())], names=["lang", "bit", "good", "n"])

        for r in in_arrow(rows, run, "lang int, bit int, good long, n long").groupBy("lang", "bit").agg(F.sum("good").alias("g"), F.sum("n").alias("n")).collect():
            model.trust[r["lang"], r["bit"]] = (r["g"] + 1) / (r["n"] + 2)
    return model


def predict(df: DataFrame, model: Model, ambiguous_below: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, ambiguous)`` for every row; one narrow pass.

    Each bit's classifier gives a margin; the language whose codeword has the least weighted loss is chosen. The score is
    the share of exp(-loss) that it has among all, loss in units of one bit; ``ambiguous`` says that the second-best comes
    closer than ``ambiguous_below``. Whole texts are read, in parts of some megabytes, so a very long text is only held by
    itself. Of languages with the same loss the first by name is chosen, and the text is ambiguous. A null text, one without
    a letter, and any text when nothing was learned, is ``und`` with score 0 and ambiguous. Repeated rows and null ids get
    an answer each; an empty table gives an empty result; other columns are not read, so their names can't clash.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.col(id_col), F.col("text").cast("binary").alias("text"), F.col("text").rlike(r"\p{L}").alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                best, score, ambiguous = model.decide(part.column(1).to_pylist(), part.column(2).to_numpy(zero_copy_only=False), ambiguous_below)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(ambiguous)], names=[id_col, "lang_pred", "score", "ambiguous"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(rows, run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")


def accepted(df: DataFrame, model: Model, ambiguous_below: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is neither ``und`` nor ambiguous, all columns as they are; decided where they are read.

    What ``predict`` says of nulls, empty and very long texts, ties and repeated rows holds here; the columns of ``df`` may
    have any names, and an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], text.cast("binary").alias(fresh("bytes", df.columns)), text.rlike(r"\p{L}").alias(fresh("letters", df.columns)))
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, width, SLICE):
                _, _, ambiguous = model.decide(part.column(width).to_pylist(), part.column(width + 1).to_numpy(zero_copy_only=False), ambiguous_below)
                yield pa.RecordBatch.from_arrays(part.columns[:width], names=part.schema.names[:width]).filter(pa.array(~ambiguous))

    return in_arrow(rows, run, df.schema)
