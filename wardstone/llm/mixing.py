"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives each document's posterior over domains (the distinct label
tuples). Document i gets a rate w_i >= 0, its expected number of copies, such that the expected domain totals
sum(w_i * tokens_i * posterior_i) match ``budget * target``. The rates minimise the squared distance between
the two by projected gradient steps from w = 1: each step is w_i = max(0, w_i - posterior_i . v) for a vector v of one
number a domain. The gradient is taken in the metric of the domains' second moments over the documents whose rate is
above 0: those at the bound don't move, and steps in the metric of all are too short by their share. The steps end when the totals match to
``tolerance`` of all tokens, or when a step moves the rates by less than that (root mean square over tokens): then they
are at the least distance. After ``most_steps`` without either a RuntimeWarning gives the last step and the distance
left. So only these few numbers pass through the driver: each pass over the posteriors folds all steps so far and sums
up the totals, and no state of documents is written between passes.

A domain without a target aims at the posterior mass that documents of the other domains carry at their targets. (At 0 it
would be out of reach, as posteriors are positive, and chasing it moves all weight to the few purest documents.)

The budget is the largest total that asks no domain for more than it has, unless one is given. Under it one scarce
domain shrinks all others. With a domain named as ``whole``, the budget is the one at which that domain is kept in full,
and the targets of the others are upper bounds: a domain that has less aims at what it has. If the labels don't know
that domain, or it has no target, the budget is as without it.

Tokens are words (runs without ASCII white space). Learning uses a bounded sample: some ``most_docs`` labelled
documents, as many of each domain where there are enough, of up to ``longest`` bytes (those of the least hash
of their id; of rows that repeat an id the least text); all else covers all documents. All domains are learned; more than ``most_domains`` (64) are an error, as
the driver holds a matrix of their second moments and the used word buckets are dealt out among them.

Defined results: null and empty texts have no tokens; they and all others get a posterior and a rate. Targets
of domains that the labels don't know are left out and the rest scaled up.
Without two domains to learn from all rates are 1. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality
from ._bytes import U64, blocks, buffers, words
from ._store import ship, written

WIDTH = 1 << 16
#: Word buckets that the classifier uses: those whose presence tells the domains apart best in the sample.
USED = 1024
SHAPE = quality.OWN * (quality.BINS + 1)


def shape_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The length-weighted shares of the bins of each text's lines."""
    n = len(offsets) - 1
    text, size, bins = quality.lines(data, offsets)
    total = np.maximum(np.bincount(text, size, n), 1)
    shape = np.zeros((n, quality.OWN, quality.BINS + 1), np.float32)
    for c in range(quality.OWN):
        np.add.at(shape[:, c], (text, bins[:, c]), size / total[text])
    return shape.reshape(n, SHAPE)


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hash bucket of each word."""
    h, doc, _ = words(data, offsets)
    return doc, (h >> U64(48)).astype(np.int64)


def parts(data: np.ndarray, offsets: np.ndarray, rows: int = 64) -> Iterator[tuple[int, int]]:
    for i, j in blocks(offsets):
        for a in range(i, j, rows):
            yield a, min(j, a + rows)


class Model:
    """Softmax regression over the domains, on the presence of telling words and the shape of lines."""

    def __init__(self, names: list[str], found: list[np.ndarray], shape: np.ndarray, label: np.ndarray, share: np.ndarray, steps: int = 300):
        """found: the distinct word buckets of each document; share: of the domains among all labelled documents."""
        self.names = names
        n, k = len(found), len(names)
        y = np.eye(k, dtype=np.float32)[label]
        per = y.sum(axis=0)
        seen = np.stack([np.bincount(np.concatenate([f for f, v in zip(found, label, strict=True) if v == c] or [np.zeros(0, np.int64)]), minlength=WIDTH) for c in range(k)], axis=1)
        here, rest = seen / np.maximum(per, 1), (seen.sum(axis=1, keepdims=True) - seen) / np.maximum(n - per, 1)
        telling = np.abs(here - rest) / np.sqrt((here + rest + 2 / n) / 2)
        best = np.argsort(-telling, axis=0, kind="stable")[: USED // k]
        self.used = np.unique(best)
        self.place = np.full(WIDTH, -1, np.int64)
        self.place[self.used] = np.arange(len(self.used))
        doc = np.repeat(np.arange(n), [len(f) for f in found])
        x = self.matrix(n, doc, np.concatenate(found) if n else np.zeros(0, np.int64), shape)
        w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
        pw, pb = w, b
        rate = 1.0 / max(1e-6, float((x * x).sum(axis=1).mean()))
        for t in range(steps):
            m = t / (t + 3)
            vw, vb = w + m * (w - pw), b + m * (b - pb)
            g = (self._softmax(x @ vw + vb) - y) / n
            pw, pb = w, b
            w, b = vw - rate * (x.T @ g + 1e-4 * vw), vb - rate * g.sum(axis=0)
        # The sample holds the domains in equal parts; posteriors are those of their true shares.
        self.w, self.b = w, b + np.log(share / share.sum()) - np.log(per / per.sum())

    def matrix(self, n: int, doc: np.ndarray, bucket: np.ndarray, shape: np.ndarray) -> np.ndarray:
        words_ = np.zeros((n, len(self.used)), np.float32)
        at = self.place[bucket]
        words_[doc[at >= 0], at[at >= 0]] = 1
        return np.concatenate([words_, shape], axis=1)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(x @ self.w + self.b)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        for i, j in parts(data, off):
            part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            doc, bucket = buckets_of(part, o)
            both = np.unique(doc * WIDTH + bucket)
            cut = np.searchsorted(both, np.arange(j - i + 1) * WIDTH)
            found = [(both[a:b] % WIDTH).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            shape = [v.tobytes() for v in shape_of(part, o)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.binary()), pa.array(shape, pa.binary())], ["domain", "found", "shape"])


def learn(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), text: str = "text", row_id: str = "doc_id", most_docs: int = 2400, longest: int = 200_000, most_domains: int = 64) -> Model | None:
    """Fits the domain classifier on a bounded sample of the labelled documents; None without two domains."""
    ship(docs.sparkSession)
    name = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    place = F.pmod(F.xxhash64(F.col(row_id), F.lit(31)), F.lit(1 << 40))
    marked = labels.filter(whole).groupBy(row_id).agg(F.min(name).alias("domain")).withColumn("place", place)
    count = {r.domain: r.n for r in marked.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(most_domains + 1).collect()}
    if len(count) > most_domains:
        raise ValueError(f"more than {most_domains} domains to learn; give a larger most_domains")
    chosen = F.lit(False)
    for v, n in count.items():
        chosen = chosen | ((F.col("domain") == v) & (F.col("place") < F.lit(int(min(1.0, most_docs / len(count) / n) * (1 << 40)))))
    picked = marked.filter(chosen).orderBy("place").limit(2 * most_docs).select(F.col(row_id).alias("mx_id"), "domain", "place")
    rows = docs.select(F.col(row_id).alias("mx_id"), F.col(text).cast("string").alias("text")).filter(F.octet_length("text") <= longest)
    rows = rows.join(F.broadcast(picked), "mx_id").groupBy("mx_id").agg(F.min(F.struct("domain", "text")).alias("r")).select("r.domain", "r.text")
    got = rows.mapInArrow(_featurise, "domain string, found binary, shape binary").toArrow()
    domain = got.column("domain").to_pylist()
    names = sorted(set(domain))
    if len(names) < 2:
        return None
    found = [np.frombuffer(v.as_buffer(), np.int32).astype(np.int64) for v in got.column("found")]
    shape = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in got.column("shape")])
    return Model(names, found, shape, np.array([names.index(v) for v in domain]), np.array([count[v] for v in names], float))


def _posteriors(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.names)
        for batch in batches:
            data, off = buffers(batch.column(1))
            ps, ns = [np.zeros((0, k))], [np.zeros(0, np.int64)]
            for i, j in parts(data, off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                doc, bucket = buckets_of(part, o)
                ps.append(model.posterior(model.matrix(j - i, doc, bucket, shape_of(part, o))).astype(np.float64))
                ns.append(np.bincount(doc, minlength=j - i))
            p = np.concatenate(ps)
            at = pa.array(np.arange(0, k * len(p) + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(ns)), pa.ListArray.from_arrays(at, pa.array(p.reshape(-1)))], ["id", "n_tokens", "posterior"])

    return run


def _fold(p: np.ndarray, steps: list[np.ndarray], w: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(p)) if w is None else w.copy()
    for v in steps:
        np.maximum(w - p @ v, 0, out=w)
    return w


def _totals(k: int, steps: list[np.ndarray]):
    """Of each task's rows, one after the other: the domains' totals, second moments of rows above 0, the mass that the documents of
    each likeliest domain carry, all tokens, and how far the last step moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, m, mass, all_tokens, moved = np.zeros(k), np.zeros((k, k)), np.zeros((k, k)), 0.0, 0.0
        for batch in batches:
            t = batch.column(0).to_numpy().astype(np.float64)
            p = batch.column(1).flatten().to_numpy().reshape(-1, k)
            before = _fold(p, steps[:-1])
            w = _fold(p, steps[-1:], before)
            g += (t * w) @ p
            moved += t @ (w - before) ** 2
            all_tokens += t.sum()
            free = w > 0
            m += (p[free] * t[free, None]).T @ p[free]
            if not steps:
                np.add.at(mass, p.argmax(axis=1), p * t[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, m.reshape(-1), mass.reshape(-1), [all_tokens, moved]]).tolist()])], ["v"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = None
    for batch in batches:
        for v in batch.column(0):
            v = v.values.to_numpy()
            out = v if out is None else out + v
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()])], ["v"])


def rates(posteriors: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None, whole: str | None = None, tolerance: float = 1e-6, most_steps: int = 100) -> list[np.ndarray]:
    """The gradient steps that turn a rate of 1 into each document's rate."""
    k = len(names)
    goal = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    if goal.sum() <= 0:
        return []
    goal /= goal.sum()
    steps: list[np.ndarray] = []
    table = posteriors.select("n_tokens", "posterior")
    aim = None
    while True:
        sums = table.mapInArrow(_totals(k, list(steps)), "v array<double>").repartition(16).mapInArrow(_added, "v array<double>").collect()
        v = np.sum([r.v for r in sums], axis=0) if sums else np.zeros(2 * k * k + k + 2)
        got, moment, mass, (total, moved) = v[:k], v[k : k + k * k].reshape(k, k), v[k + k * k : -2].reshape(k, k), v[-2:]
        if total <= 0:
            return []
        if aim is None:
            most = {names[i]: got[i] / total / goal[i] for i in range(k) if goal[i] > 0}
            if budget is None and whole in most:
                aim = np.minimum(goal * most[whole], got / total)
            else:
                aim = goal * (min(most.values()) if budget is None else budget / total)
            scale = np.where(goal > 0, aim * total / np.maximum(got, 1e-300), 0.0)
            aim = np.where(goal > 0, aim, scale @ mass / total)
        rest = got / total - aim
        moved = (moved / total) ** 0.5
        if np.abs(rest).max() < tolerance or (steps and moved < tolerance):
            break
        if len(steps) >= most_steps:
            warnings.warn(f"mixing: rates not settled after {most_steps} steps: last step {moved:.1e}, totals off by {np.abs(rest).max():.1e} of all tokens", RuntimeWarning, stacklevel=2)
            break
        steps.append(np.linalg.solve(moment / total + 1e-6 * np.eye(k), rest))
    return steps


def _apply(steps: list[np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, k)
            domain = pa.array([names[i] for i in p.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), domain, batch.column(2), pa.array(_fold(p, steps))], ["id", "n_tokens", "domain", "posterior", "rate"])

    return run


def mix(docs: DataFrame, model: Model | None, targets: dict[str, float], budget: float | None = None, text: str = "text", row_id: str = "doc_id", whole: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens (words), domain (the likeliest), posterior (in the order of names), rate."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    id_field = T.StructField("id", rows.schema["id"].dataType)
    out = T.StructType([id_field, T.StructField("n_tokens", T.LongType()), T.StructField("domain", T.StringType()), T.StructField("posterior", T.ArrayType(T.DoubleType())), T.StructField("rate", T.DoubleType())])
    if model is None:
        words_ = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        return rows.select("id", words_.alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate")).withColumnRenamed("id", row_id)
    table = written(rows.mapInArrow(_posteriors(model), T.StructType([id_field, out["n_tokens"], out["posterior"]])), "posteriors")
    steps = rates(table, model.names, targets, budget, whole)
    return table.mapInArrow(_apply(steps, model.names), out).withColumnRenamed("id", row_id)


def copies(rate: Column, row_id: Column) -> Column:
    """The number of copies of a row: its rate, rounded up or down by chance (a hash of its id), so that it is the rate on average."""
    chance = F.pmod(F.xxhash64(row_id, F.lit(37)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + chance).cast("int")


def shares(mixed: DataFrame, model: Model, targets: dict[str, float], count: Column) -> DataFrame:
    """domain, target, realised: the shares of tokens asked for, and those of ``count`` copies of each row of mix()."""
    tokens = F.col("n_tokens") * count
    of = [(n, max(0.0, targets.get(n, 0.0)), F.sum(F.col("posterior")[i] * tokens) / F.sum(tokens)) for i, n in enumerate(model.names)]
    whole = sum(t for _, t, _ in of) or 1.0
    rows = F.array(*[F.struct(F.lit(n).alias("domain"), F.lit(t / whole).alias("target"), v.alias("realised")) for n, t, v in of])
    return mixed.agg(rows.alias("rows")).select(F.inline("rows"))
