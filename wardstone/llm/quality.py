"""Line quality by a linear-chain conditional random field, and document quality from it.

Each line of a text is good or bad. A line's features are coarse measures of its bytes and words (its own and
those of the lines before and after it), each cut into bins; the field has a weight for each bin and state and
for each pair of neighbouring states. Forward-backward sums give each line's probability of being good; weighted
by length they make the document's good share, and a logistic curve in that share and the worst line's turns it
into the probability of label 1.

Only documents are labelled, so learning alternates: lines of good documents are good; lines of bad documents
begin as bad, and are then set anew by the field's own marginals, each bad document keeping its worst line.
It uses a bounded sample: some ``most_docs`` labelled documents of up to ``longest`` bytes (those of the least
hash of their id; of rows that repeat an id the least text), as many of either label where there are enough.

Defined results: null and empty texts and texts of blank lines score the learned share of label 1 among the
sample. Without two labels to learn from every document scores 0.5. A line is what stands between line feeds;
blank lines are skipped. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import SPACE, blocks, buffers, words
from ._store import ship

BINS = 8
#: Upper edges of the bins of shares, and of counts.
SHARES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
COUNTS = np.array([1, 3, 6, 12, 25, 60, 150])


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_KINDS = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(bytes(range(48, 58))),
        _class(b"!?"),
        _class(b"|\t<>{}[]=\\/_~`^"),
        _class(b"#$%&*+@"),
        _class(b".,;:'\"()-"),
        _class(bytes(range(128, 256))),
    ]
)
OWN = len(_KINDS) + 6


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-blank lines of a block of texts: their text's number, length in bytes, and binned measures."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, OWN), np.uint8)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    add = lambda v: np.add.reduceat(v, begin)
    solid = add((~SPACE[data]).astype(np.float32))
    size = np.maximum(solid, 1)
    shares = [add(k[data]) / size for k in _KINDS]

    h, _, at = words(data, offsets)
    line = np.searchsorted(begin, at, side="right") - 1
    n = np.bincount(line, minlength=len(begin))
    per = np.maximum(n, 1)
    same = lambda k: np.bincount(line[k:][(h[k:] == h[:-k]) & (line[k:] == line[:-k])], minlength=len(begin)) / per
    order = np.lexsort((h, line))
    again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])])
    repeated = np.bincount(line[order][again], minlength=len(begin)) / per
    first = LETTER[data[at]]
    odd_ends = np.bincount(line[~first], minlength=len(begin)) / per

    share = np.stack([*shares, same(1), same(2), repeated, odd_ends], axis=1)
    binned = np.searchsorted(SHARES, share, side="left")
    counts = np.stack([np.searchsorted(COUNTS, n, side="left"), np.searchsorted(np.arange(2, 16, 2), solid / per, side="left")], axis=1)
    x = np.concatenate([binned, counts], axis=1).astype(np.uint8)
    ok = solid > 0
    text = np.searchsorted(offsets, begin, side="right") - 1
    return text[ok], solid[ok].astype(np.int64), x[ok]


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = True


def with_neighbours(text: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A line's own bins, and those of the line before and after in its text (BINS where there is none)."""
    none = np.full_like(x, BINS)
    before, after = none.copy(), none.copy()
    if len(x) > 1:
        joined = text[1:] == text[:-1]
        before[1:][joined] = x[:-1][joined]
        after[:-1][joined] = x[1:][joined]
    return np.concatenate([x, before, after], axis=1)


class Field:
    """The weights: emission[column, bin] (for good against bad) and the four transitions."""

    def __init__(self, emission: np.ndarray, trans: np.ndarray):
        self.emission, self.trans = emission, trans

    def potentials(self, x: np.ndarray) -> np.ndarray:
        u = self.emission[np.arange(x.shape[1])[None, :], x].sum(axis=1)
        return np.stack([np.zeros_like(u), u], axis=1)

    def marginals(self, text: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected transition counts. Lines of one text stand together."""
        n = len(u)
        if not n:
            return np.zeros(0), np.zeros((2, 2))
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        size = np.diff(np.concatenate([first, [n]]))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        live = lambda t: int(np.searchsorted(-size, -t, side="left"))  # texts of more than t lines
        t_exp = np.exp(self.trans)
        e = np.exp(u - u.max(axis=1, keepdims=True))
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        at = first
        a[at] = e[at] / e[at].sum(axis=1, keepdims=True)
        most = int(size[0])
        for t in range(1, most):
            k = live(t)
            at = first[:k] + t
            v = (a[at - 1] @ t_exp) * e[at]
            a[at] = v / v.sum(axis=1, keepdims=True)
        pair = np.zeros((2, 2))
        for t in range(most - 1, 0, -1):
            k = live(t)
            at = first[:k] + t
            w = e[at] * b[at]
            v = w @ t_exp.T
            p = a[at - 1][:, :, None] * t_exp[None] * w[:, None, :]
            pair += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b[at - 1] = v / v.sum(axis=1, keepdims=True)
        g = a * b
        return g[:, 1] / g.sum(axis=1), pair


def fit_field(text: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: Field | None = None, steps: int = 60) -> Field:
    """Conditional likelihood by accelerated, normalised gradient steps; y: line states, weight: of each text's lines."""
    columns = np.arange(x.shape[1])
    em = np.zeros((x.shape[1], BINS + 2)) if start is None else start.emission.copy()
    tr = np.zeros((2, 2)) if start is None else start.trans.copy()
    flat = (columns[None, :] * (BINS + 2) + x).reshape(-1)
    joined = text[1:] == text[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][joined], y[1:][joined]), 1)
    m1, m2, t1, t2 = np.zeros_like(em), np.zeros_like(em), np.zeros_like(tr), np.zeros_like(tr)
    for k in range(1, steps + 1):
        f = Field(em, tr)
        p, pair = f.marginals(text, f.potentials(x))
        g = np.bincount(flat, np.repeat((y - p) * weight, x.shape[1]), minlength=em.size).reshape(em.shape) / weight.sum() - 1e-4 * em
        gt = (seen - pair) / max(1, len(y)) - 1e-4 * tr
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        t1, t2 = 0.9 * t1 + 0.1 * gt, 0.99 * t2 + 0.01 * gt * gt
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        em = em + 0.1 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        tr = tr + 0.05 * (t1 / c1) / (np.sqrt(t2 / c2) + 1e-8)
    return Field(em, np.clip(tr, -4, 4))


def summarise(n: int, text: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each text: the length-weighted good share and the share of lines' length surely bad; -1 without lines."""
    total = np.bincount(text, size, n)
    good = np.bincount(text, size * p, n) / np.maximum(total, 1)
    bad = np.bincount(text, size * (p < 0.5), n) / np.maximum(total, 1)
    out = np.stack([good, bad], axis=1)
    out[total == 0] = -1
    return out


class Model:
    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rounds: int = 3):
        self.prior = float(np.clip(label.mean(), 0.001, 0.999)) if len(label) else 0.5
        self.field: Field | None = None
        if not 0 < label.sum() < len(label):
            self.prior = 0.5
            return
        text = np.concatenate([np.full(len(s), k) for k, (s, _) in enumerate(docs)]).astype(np.int64)
        size = np.concatenate([s for s, _ in docs]).astype(np.float64)
        x = with_neighbours(text, np.concatenate([b for _, b in docs]))
        doc_size = np.maximum(np.bincount(text, minlength=len(docs)), 1)
        weight = 1 / np.sqrt(doc_size[text])
        y = label[text].astype(np.int64)
        for _ in range(rounds):
            self.field = fit_field(text, x, y, weight, self.field)
            p, _ = self.field.marginals(text, self.field.potentials(x))
            worst = np.full(len(docs), 2.0)
            np.minimum.at(worst, text, p)
            y = np.where(label[text] == 1, 1, (p > 0.5) & (p > worst[text])).astype(np.int64)
        p, _ = self.field.marginals(text, self.field.potentials(x))
        s = summarise(len(docs), text, size, p)
        self.curve = np.zeros(3)
        keep = s[:, 0] >= 0
        z, t = np.concatenate([s[keep], np.ones((keep.sum(), 1))], axis=1), label[keep]
        for _ in range(60):
            q = 1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30)))
            h = (z * (q * (1 - q))[:, None]).T @ z + np.diag([0.05, 0.05, 1e-3])
            self.curve += np.linalg.solve(h, z.T @ (t - q) - np.array([0.05, 0.05, 1e-3]) * self.curve)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.field is None:
            return np.full(n, self.prior)
        text, size, x = lines(data, offsets)
        p, _ = self.field.marginals(text, self.field.potentials(with_neighbours(text, x)))
        s = summarise(n, text, size, p)
        score = 1 / (1 + np.exp(-np.clip(s @ self.curve[:2] + self.curve[2], -30, 30)))
        return np.where(s[:, 0] < 0, self.prior, score)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, sizes, bins) for learning."""
    for batch in batches:
        data, off = buffers(batch.column(1))
        for i, j in blocks(off):
            text, size, x = lines(data[off[i] : off[j]], off[i : j + 1] - off[i])
            cut = np.searchsorted(text, np.arange(j - i + 1))
            parts = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([size[a:b].astype(np.int64).tobytes() for a, b in parts], pa.binary()), pa.array([x[a:b].tobytes() for a, b in parts], pa.binary())],
                ["label", "sizes", "bins"],
            )


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", text: str = "text", row_id: str = "doc_id", most_docs: int = 3000, longest: int = 200_000) -> Model:
    """Fits the model on a bounded sample of the labelled documents that ``may_learn`` admits."""
    ship(docs.sparkSession)
    marked = labels.filter(F.col(label).isin(0, 1)).groupBy(row_id).agg(F.max(label).cast("int").alias("label"))
    rows = docs.filter(may_learn).select(F.col(row_id), F.col(text).cast("string").alias("text")).filter(F.octet_length("text").between(1, longest))
    place = F.pmod(F.xxhash64(F.col(row_id), F.lit(29)), F.lit(1 << 40))
    marked = marked.withColumn("place", place)
    count = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for v, n in count.items():
        chosen = chosen | ((F.col("label") == v) & (F.col("place") < F.lit(int(min(1.0, 0.8 * most_docs / n) * (1 << 40)))))
    picked = marked.filter(chosen).orderBy("place").limit(2 * most_docs)
    rows = rows.join(F.broadcast(picked), row_id).groupBy(row_id).agg(F.min(F.struct("label", "text")).alias("r")).select("r.label", "r.text")
    got = rows.mapInArrow(_measure, "label int, sizes binary, bins binary").toArrow()
    docs_ = [(np.frombuffer(s.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, OWN)) for s, b in zip(got.column("sizes"), got.column("bins"), strict=True)]
    y = got.column("label").to_numpy() if got.num_rows else np.zeros(0, np.int64)
    keep = [k for k, (s, _) in enumerate(docs_) if len(s)]
    return Model([docs_[k] for k in keep], y[keep])


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            rest = batch.schema.names[2:]
            for i, j in blocks(off):
                s = model.score(data[off[i] : off[j]], off[i : j + 1] - off[i])
                own = [batch.column(c).slice(i, j - i) for c in rest]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *own], ["id", "score", "predicted", *rest])

    return run


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", row_id: str = "doc_id", **more: Column) -> DataFrame:
    """One row per input row: id, score, predicted, and the columns asked for in ``more``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"), *[c.alias(n) for n, c in more.items()])
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    fields += [rows.schema[n] for n in more]
    return rows.mapInArrow(_score(model, threshold), T.StructType(fields)).withColumnRenamed("id", row_id)
