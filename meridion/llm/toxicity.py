"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.llm.bpe import spaced_pieces
from meridion.llm.common import in_arrow, slices
from meridion.llm.shingles import distinct, shingle_sets, signature

EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")

#: What separates tokens: any character but letters, marks, digits and apostrophes.
SEPARATOR = r"[^\p{L}\p{M}\p{N}'’]"

#: Rows and bytes of text that are tagged at once.
SLICE, SLICE_BYTES = 1000, 2 << 20

#: Tokens whose score a task keeps; emptied when full. Longer tokens than ``KEPT_LENGTH`` are not kept.
KEPT, KEPT_LENGTH = 100_000, 64


def features(piece: str) -> list[int]:
    """Hashed features of a token: the bare word, its beginnings of 4 to 9 letters and its last 3; none without a letter."""
    word = EDGES.sub("", piece.lower())
    if not word:
        return []
    parts = ["w" + word, "e" + word[-3:], *(f"{n}{word[:n]}" for n in range(4, min(10, len(word) + 1)))]
    return [zlib.crc32(p.encode()) for p in parts]


@dataclass
class Tokens:
    """The tokens of some texts: the distinct ones, each token's place among them, where each text's begin, and each token's end.

    Ends count characters from the first text on; ``base`` has each text's own first character in that count.
    """

    names: pa.Array
    index: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    base: np.ndarray


def batch_tokens(texts: pa.Array) -> Tokens:
    """Runs of letters, digits, marks and apostrophes; white space of any kind and punctuation separate them."""
    # One space for each separating character keeps the offsets.
    names, index, begins = spaced_pieces(pc.replace_substring_regex(pc.fill_null(texts, ""), SEPARATOR, " "))
    size = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[index]
    ends = np.cumsum(size + 1) - 1
    base = np.concatenate([[0], ends + 1])[begins[:-1]]
    full = size > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return Tokens(names, index[full], before[begins], ends[full], base)


class Chain:
    """Sequences of different lengths side by side, each cut into stretches of at most ``stretch`` tokens.

    Step t of all stretches longer than t is one array operation. What enters a stretch is carried from the one before it: a
    stretch as a whole is a product of 2 x 2 matrices, which the stretches of a long text are chained by. So a very long text
    costs steps in proportion to its number of stretches, not of its tokens.

    States are clean and toxic. Messages are log odds of toxic to clean, so that neither sums nor products vanish.
    """

    def __init__(self, begins: np.ndarray, stretch: int = 256) -> None:
        counts = -(-np.diff(begins) // stretch)
        owner = np.repeat(np.arange(len(counts)), counts)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = begins[:-1][owner] + turn * stretch
        lengths = np.minimum(begins[1:][owner] - start, stretch)
        order = np.argsort(-lengths, kind="stable")
        self.start, self.lengths = start[order], lengths[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.active = self._active(self.lengths)
        #: For each turn, the stretches of that turn that have a next one, and those next ones.
        self.links = [(place[at], place[at + 1]) for k in range(int(counts.max(initial=0)) - 1) if len(at := np.flatnonzero((turn == k) & (counts[owner] > k + 1)))]
        self.linked = np.flatnonzero((counts[owner] > 1)[order])

    @staticmethod
    def _active(lengths: np.ndarray) -> np.ndarray:
        """How many sequences are longer than t, of lengths that fall."""
        top = int(lengths[0]) if len(lengths) else 0
        return len(lengths) - np.searchsorted(lengths[::-1], np.arange(top), side="right")

    def _products(self, e: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """The product of the step matrices of every stretch that has a neighbour, each scaled to a largest entry of one."""
        t = np.exp(trans - trans.max())
        m = np.zeros((len(self.lengths), 2, 2))
        start, lengths = self.start[self.linked], self.lengths[self.linked]
        some = np.broadcast_to(np.eye(2), (len(start), 2, 2)).copy()
        for k, n in enumerate(self._active(lengths).tolist()):
            step = some[:n] @ t
            x = np.clip(e[start[:n] + k], -200.0, 200.0)
            step[:, :, 1] *= np.exp(x)[:, None]
            some[:n] = step / step.max(axis=(1, 2), keepdims=True)
        m[self.linked] = some
        return m

    def run(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward odds (with the token's own score) and backward odds of every token; trans is [[cc, ct], [tc, tt]]."""
        (cc, ct), (tc, tt) = trans
        forward, backward = np.empty_like(e), np.zeros_like(e)
        enters, leaves = np.full(len(self.start), -np.inf), np.zeros(len(self.start))
        if self.links:
            m = self._products(e, trans)
            carried = np.zeros((len(self.start), 2))
            carried[:, 0] = 1.0
            for here, after in self.links:
                v = np.einsum("ni,nij->nj", carried[here], m[here])
                carried[after] = v / v.max(axis=1, keepdims=True)
                enters[after] = np.log(np.maximum(carried[after, 1], 1e-300)) - np.log(np.maximum(carried[after, 0], 1e-300))
            carried[:] = 1.0
            for here, after in reversed(self.links):
                w = np.einsum("nij,nj->ni", m[after], carried[after])
                carried[here] = w / w.max(axis=1, keepdims=True)
                leaves[here] = np.log(np.maximum(carried[here, 1], 1e-300)) - np.log(np.maximum(carried[here, 0], 1e-300))
        r = enters
        for t, n in enumerate(self.active.tolist()):
            at = self.start[:n] + t
            r = e[at] + np.logaddexp(tt + r[:n], ct) - np.logaddexp(tc + r[:n], cc)
            forward[at] = r
        if len(self.start):
            backward[self.start + self.lengths - 1] = leaves
        for t in range(len(self.active) - 2, -1, -1):
            n = self.active[t + 1]
            at = self.start[:n] + t
            x = e[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(tt + x, tc) - np.logaddexp(ct + x, cc)
        return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def by_text(values: np.ndarray, begins: np.ndarray, empty: float) -> np.ndarray:
    """The largest value of each text; ``empty`` for a text without tokens."""
    out = np.full(len(begins) - 1, empty)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        out[some] = np.maximum.reduceat(values, begins[some])
    return out


def most_toxic(p: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The largest log odds of a marginal in each document, held between -12 and 12; -12 without a token."""
    top = np.clip(by_text(p, begins, 0.0), 1e-9, 1 - 1e-9)
    return np.clip(np.log(top / (1 - top)), -12.0, 12.0)


class Crf:
    """Token weights, transitions, and the line that turns a document's most toxic token into a score."""

    def __init__(self) -> None:
        self.weights: dict[int, float] = {}
        self.bias = -6.0
        self.trans = np.zeros((2, 2))
        self.line = (-4.0, 0.0)
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def emission(self, piece: str) -> float:
        got = self._known.get(piece)
        if got is None:
            if len(self._known) > KEPT:
                self._known.clear()
            weights = self.weights
            got = self.bias + sum(weights.get(f, 0.0) for f in features(piece))
            if len(piece) <= KEPT_LENGTH:
                self._known[piece] = got
        return got

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """The probability of each token to be toxic."""
        pieces = tokens.names.to_pylist()
        e = np.fromiter(map(self.emission, pieces), dtype=np.float64, count=len(pieces))[tokens.index]
        forward, backward = Chain(tokens.begins).run(e, self.trans)
        return sigmoid(forward + backward)

    def score(self, p: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Documents' scores: a logistic line over the log odds of the most toxic token.

        The sum of the marginals would follow the length of a text: many tokens that are a little doubtful are not toxic.
        """
        return sigmoid(self.line[0] + self.line[1] * most_toxic(p, begins))


def labelled_tokens(
    index: np.ndarray, begins: np.ndarray, toxic: np.ndarray, size: np.ndarray, flat: np.ndarray, copies: np.ndarray, support: int, ratio: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token labels from document labels, which documents they explain, and in how many documents each feature is.

    ``copies`` has a column of minhashes each: texts that agree in one are counted once there, and the least count holds, so
    that the rare words of a text that was copied many times don't pass for evidence. ``flat`` holds the features of the distinct tokens end to end, as small numbers, and ``size`` how many each token has.

    A feature carries toxicity when at least ``support`` toxic documents have it, its smoothed share among toxic documents is
    ``ratio`` times that among clean ones, and no more than a one-in-twenty chance that any of all the features tried had so many
    toxic among its documents by accident (Chernoff's bound of the binomial tail). In toxic documents tokens with such a feature are toxic; toxic documents
    without one are not explained and teach nothing.
    """
    owner = np.repeat(np.arange(len(toxic)), np.diff(begins))
    n_features = int(flat.max()) + 1 if len(flat) else 1
    of = np.repeat(np.arange(len(size)), size)
    # Each document's distinct tokens, then its distinct features.
    pairs = distinct(owner * len(size) + index)
    doc, piece = pairs // len(size), pairs % len(size)
    first = np.concatenate([[0], np.cumsum(size)])
    spread = np.repeat(first[piece] - np.concatenate([[0], np.cumsum(size[piece])])[:-1], size[piece]) + np.arange(size[piece].sum())
    seen = distinct(np.repeat(doc, size[piece]) * n_features + flat[spread])
    which, f = seen // n_features, seen % n_features

    def counted(mask: np.ndarray) -> np.ndarray:
        w, g = which[mask], f[mask]
        columns = [np.bincount(distinct(c[w] * n_features + g) % n_features, minlength=n_features) for c in copies.T]
        return np.minimum.reduce(columns)

    bad, good = counted(toxic[which] == 1), counted(toxic[which] == 0)
    share = (bad + 0.5) / (toxic.sum() + 1) / ((good + 0.5) / ((1 - toxic).sum() + 1))
    prior = np.clip(toxic.mean(), 1e-6, 1 - 1e-6)
    part = np.clip(bad / np.maximum(bad + good, 1), 1e-12, 1 - 1e-12)
    surprise = (bad + good) * (part * np.log(part / prior) + (1 - part) * np.log((1 - part) / (1 - prior)))
    tried = max(1, int((bad + good >= support).sum()))
    carrier = (bad >= support) & (share >= ratio) & (surprise >= np.log(20 * tried))
    hit = np.bincount(of, weights=carrier[flat], minlength=len(size)) > 0
    labels = hit[index] & (toxic[owner] == 1)
    explained = np.bincount(owner, weights=labels, minlength=len(toxic)) > 0
    return labels, explained | (toxic == 0), bad + good


def fitted_line(u: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope (not falling) of a logistic line by Newton's steps, halved until they help."""
    middle, spread = float(u.mean()), float(u.std()) or 1.0
    x = np.stack([np.ones_like(u), (u - middle) / spread], axis=1)
    c = np.zeros(2)
    loss = lambda c: float(np.logaddexp(0, x @ c).sum() - y @ (x @ c) + 0.5 * ridge * c @ c)
    now = loss(c)
    for _ in range(50):
        q = sigmoid(x @ c)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(2), x.T @ (y - q) - ridge * c)
        while np.abs(step).max() > 1e-6 and loss(c + step) >= now:
            step = step / 2
        if np.abs(step).max() <= 1e-6:
            break
        c = c + step
        now = loss(c)
    slope = max(float(c[1]) / spread, 0.0)
    return float(c[0]) - slope * middle, slope


def train(texts: list[str], toxic: np.ndarray, rounds: int = 60, ridge: float = 1e-4, rate: float = 0.5, support: int = 3, ratio: float = 10.0) -> Crf:
    """Fit by gradient ascent on the conditional likelihood of the labelled tokens (Adagrad), then fit the score's line."""
    model = Crf()
    if not len(texts) or toxic.min() == toxic.max():
        model.line = (-4.0 if not len(texts) or toxic.max() == 0 else 4.0, 0.0)
        return model
    found = batch_tokens(pa.array(texts, pa.string()))
    index, begins = found.index, found.begins
    pieces = found.names.to_pylist()
    size = np.empty(len(pieces), dtype=np.int64)
    hashes = array("L")
    for i, piece in enumerate(pieces):
        mine = features(piece)
        size[i] = len(mine)
        hashes.extend(mine)
    known, flat = np.unique(np.frombuffer(hashes, dtype=np.uint64).astype(np.int64) if len(hashes) else np.zeros(0, np.int64), return_inverse=True)
    sigs = np.stack([signature(x, 4, 29) for x in shingle_sets([t.encode() for t in texts], 5)])
    copies = np.stack([np.unique(c, return_inverse=True)[1] for c in sigs.T], axis=1)
    labels, taught, spread = labelled_tokens(index, begins, toxic, size, flat, copies, support, ratio)
    of = np.repeat(np.arange(len(pieces)), size)
    # A feature of fewer documents has no weight: it could only be learned by heart.
    common = spread[flat] >= support if len(flat) else np.zeros(0, dtype=bool)
    flat, of = flat[common], of[common]
    n_known = max(1, len(known))
    use = np.flatnonzero(taught & (np.diff(begins) > 0))
    if not len(use):
        return model
    tokens = np.concatenate([np.arange(begins[k], begins[k + 1]) for k in use])
    y = labels[tokens].astype(np.float64)
    idx = index[tokens]
    own = np.concatenate([[0], np.cumsum(np.diff(begins)[use])])
    chain = Chain(own, 1024)
    last = np.zeros(len(tokens), dtype=bool)
    last[own[1:] - 1] = True
    inner = np.flatnonzero(~last)
    n = len(use)
    seen_t = np.array([[(1 - y[inner]) @ (1 - y[inner + 1]), (1 - y[inner]) @ y[inner + 1]], [y[inner] @ (1 - y[inner + 1]), y[inner] @ y[inner + 1]]])
    w, bias, trans = np.zeros(n_known), model.bias, np.zeros((2, 2))
    gw, gb, gt = np.full(n_known, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        e_piece = bias + np.bincount(of, weights=w[flat], minlength=len(pieces))
        e = e_piece[idx]
        forward, backward = chain.run(e, trans)
        p = sigmoid(forward + backward)
        x = e[inner + 1] + backward[inner + 1]
        r = forward[inner]
        joint = np.stack([np.full_like(x, trans[0, 0]), trans[0, 1] + x, r + trans[1, 0], r + trans[1, 1] + x])
        joint -= joint.max(axis=0)
        np.exp(joint, out=joint)
        joint /= joint.sum(axis=0)
        d_token = np.bincount(idx, weights=y - p, minlength=len(pieces))
        dw = np.bincount(flat, weights=d_token[of], minlength=n_known) / n - ridge * w
        db = d_token.sum() / n
        dt = (seen_t - joint.sum(axis=1).reshape(2, 2)) / n - ridge * trans
        gw += dw**2
        gb += db**2
        gt += dt**2
        w += rate * dw / np.sqrt(gw)
        bias += rate * db / np.sqrt(gb)
        trans = trans + 0.2 * rate * dt / np.sqrt(gt)
    model.weights = {int(known[i]): float(w[i]) for i in np.flatnonzero(np.abs(w) >= 1e-3)}
    model.bias, model.trans = float(bias), trans
    model.line = fitted_line(most_toxic(model.marginals(found), begins), toxic)
    return model


def training_rows(df: DataFrame, labels: DataFrame, keep, most_toxic: int, most_clean: int, most_bytes: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(text, toxic)``: the first labelled ids of either label by the hash of the id, with a text of up to ``most_bytes`` each.

    The chosen ids, a fixed number at most, are broadcast; texts are filtered where they are read. Repeated rows of an id are
    one row, the smallest text, and an id with both labels is toxic.
    """
    known = labels.where(keep & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("toxic")).where("of is not null")
    known = known.groupBy("of").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("of", F.lit(23))
    toxic = known.where("toxic = 1").orderBy(order, "of").limit(most_toxic)
    clean = known.where("toxic = 0").orderBy(order, "of").limit(most_clean)
    chosen = F.broadcast(toxic.unionByName(clean))
    rows = df.select(F.col(id_col).alias("of"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= most_bytes)
    return rows.join(chosen, "of").groupBy("of").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(
    df: DataFrame, labels: DataFrame, keep, most_toxic: int = 900, most_clean: int = 1500, most_bytes: int = 16384,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Crf:
    """Fit on a bounded sample of the labelled rows for which ``keep`` (a column of ``labels``) holds.

    At most ``most_toxic`` and ``most_clean`` rows of at most ``most_bytes`` each, in one task; the driver gets the model.
    The sample's share of toxic rows is not the table's where the bounds cut, so the score's line is moved by the difference
    of their log odds, which are counted over all labelled rows. Labels other than 0 and 1, null ids and null texts teach
    nothing; without rows of both labels every document gets the same score.
    """
    rows = training_rows(df, labels, keep, most_toxic, most_clean, most_bytes, id_col, text_col, label_col)
    share = {r["toxic"]: r["count"] for r in labels.where(keep & F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("toxic")).count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(((x["of"], x["text"], x["toxic"]) for batch in batches for x in batch.to_pylist()), key=lambda r: (str(r[0]), r[1]))
        toxic = np.array([r[2] for r in sample], dtype=np.int64)
        model = train([r[1] for r in sample], toxic)
        if len(toxic) and 0 < toxic.sum() < len(toxic):
            moved = np.log(share[1] / share[0]) - np.log(toxic.sum() / (len(toxic) - toxic.sum()))
            model.line = (model.line[0] + float(moved), model.line[1])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = in_arrow(rows.repartition(1), run, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], np.zeros(0, dtype=np.int64))


def tag(df: DataFrame, model: Crf, at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted, spans)`` for every whole text; one narrow pass.

    The score comes from the largest forward-backward marginal of the document's tokens; equal texts get equal scores.
    ``spans`` holds ``(start, end)`` in characters of runs of tokens whose marginal is at least ``at``, in order. A null or
    empty text, or one without a token, has no spans and the score of no toxic token. Very long texts are read whole, in
    stretches whose messages are carried on; texts are tagged some megabytes at a time. Repeated rows and null ids get an
    answer each; an empty table gives an empty result; other columns are not read, so their names can't clash.
    """
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, 1, SLICE, SLICE_BYTES):
                tokens = batch_tokens(part.column(1))
                p = model.marginals(tokens)
                scores = model.score(p, tokens.begins)
                sizes = pc.utf8_length(tokens.names).to_numpy(zero_copy_only=False).astype(np.int64)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in np.flatnonzero(by_text(p, tokens.begins, 0.0) >= at):
                    here = slice(tokens.begins[k], tokens.begins[k + 1])
                    ends = tokens.ends[here] - tokens.base[k]
                    starts = ends - sizes[tokens.index[here]]
                    edge = np.diff((p[here] >= at).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
                    spans[k] = [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, type=span)], names=[id_col, "score", "predicted", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(rows, run, f"`{id_col}` {kind}, score double, predicted int, spans array<struct<start:int,end:int>>")


def accepted(df: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text isn't predicted toxic, all columns as they are; decided where they are read.

    A null or empty text is kept unless everything is toxic; very long texts, ties and repeated rows are as in ``tag``. The
    columns may have any names; an empty table stays empty.
    """
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place, SLICE, SLICE_BYTES):
                tokens = batch_tokens(part.column(place))
                yield part.filter(pa.array(model.score(model.marginals(tokens), tokens.begins) < 0.5))

    return in_arrow(df, run, df.schema)
