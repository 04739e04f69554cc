"""Language identification by error-correcting output codes.

Each language gets a codeword; for each bit a binary classifier (logistic regression on hashed byte n-grams of
the lower-cased text) predicts which languages' side a text is on. Decoding sums, for each codeword, the logistic
loss of all bits against it, weighted by each bit's held-back accuracy, and chooses the least; a text whose two
nearest codewords lie close is flagged ambiguous.

Codes: up to seven languages have all distinct two-way splits; more have a fixed pseudo-random code of
16 * ceil(log2(n)) bits whose rows all differ.

Learning uses a bounded sample: of each language, some ``per_language`` labelled documents, ``most_rows`` in all (those of the
least hash of their id, up to ``longest`` bytes each, so that the sample has a bound in bytes); each contributes
the hashed counts of its whole text. Everything else covers all documents. All languages are learned; more than
``most_languages`` (200) are an error, as the model's size and that of the sample grow with them.

Defined results: null texts and texts without a letter give ``und`` with score 0, as do all texts if there is
nothing to learn from. With one language all other texts get it, with score 1. Rows without an id are predicted
like all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U64
from ._pieces import text_blocks
from ._store import ship

WIDTH = 1 << 12
ORDERS = (1, 2, 3)
#: Bytes that are no letter count as a space.
_FOLD = bytes(b if (97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Hashed byte 1- to 3-grams of a whole text: square roots of their shares, of length 1."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8)
    raw = raw[(raw != 32) | np.concatenate([[True], raw[:-1] != 32])]
    out = np.zeros(WIDTH, np.float32)
    for start in range(0, max(1, len(raw)), 1 << 20):
        part = raw[start : start + (1 << 20) + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            if len(part) >= n:
                h = np.zeros(len(part) - n + 1, np.uint64)
                for k in range(n):
                    h = h * U64(257) + part[k : len(part) - n + 1 + k] + U64(1)
                h *= U64(0x9E3779B97F4A7C15)
                out += np.bincount((h >> U64(52)).astype(np.int64), minlength=WIDTH)
    np.sqrt(out, out=out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1."""
    if n <= 7:
        splits = range(1 << (n - 1), (1 << n) - 1)
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], np.float32).reshape(n, -1)
    bits, seed = 16 * math.ceil(math.log2(n)), 0
    while True:
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (n, bits))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all():
            return code
        seed += 1


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 30.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x bits) and offsets of logistic regressions on targets of -1 and 1, by accelerated gradient steps."""
    n, bits = len(x), y.shape[1]
    share = np.clip((y > 0).mean(axis=0), 0.02, 0.98)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    pw, pb = w.copy(), b.copy()
    for t in range(steps):
        m = t / (t + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        g = -y * weight / (1 + np.exp(np.clip(y * (x @ vw + vb), -30, 30))) / n
        pw, pb = w, b
        w = vw - rate / 8 * (x.T @ g) - decay * vw
        b = vb - g.sum(axis=0)
    return w, b


class Model:
    """Languages, codewords, the bits' classifiers and their weights."""

    def __init__(self, names: list[str], x: np.ndarray, label: np.ndarray):
        self.names = names
        self.code = codewords(len(names))
        y = self.code[label]
        back = np.arange(len(x)) % 5 == 0
        if len(x) >= 50:
            w, b = fit_logistic(x[~back], y[~back], steps=80)
            right = ((x[back] @ w + b) * y[back] > 0).mean(axis=0)
        else:
            right = np.ones(y.shape[1])
        self.trust = np.maximum(right - 0.5, 0.01) / np.maximum(right - 0.5, 0.01).sum() * y.shape[1]
        self.w, self.b = fit_logistic(x, y)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores and whether a text is ambiguous."""
        margin = np.clip(x @ self.w + self.b, -30, 30)
        loss = (np.log1p(np.exp(-self.code[None] * margin[:, None])) * self.trust).sum(axis=2)
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4 / max(1, self.code.shape[1]))
        score = near / near.sum(axis=1, keepdims=True)
        order = np.sort(score, axis=1)
        best = loss.argmin(axis=1)
        return best, score[np.arange(len(best)), best], order[:, -1] - order[:, -2] < 0.2 if score.shape[1] > 1 else np.zeros(len(best), bool)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, texts in text_blocks(batch.column(1), 1 << 20):
            x = [features(t).astype(np.float16).tobytes() for t in texts]
            place, mark, lang = (batch.column(c).slice(i, j - i) for c in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([place, mark, lang, pa.array(x, pa.binary())], ["place", "mark", "lang", "x"])


def learn(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", row_id: str = "doc_id", per_language: int = 300, most_rows: int = 2000, most_languages: int = 200, longest: int = 200_000) -> Model | None:
    """Fits the model on a bounded sample of the labelled rows that ``may_learn`` admits; None if there is none."""
    ship(docs.sparkSession)
    rows = docs.filter(may_learn).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    names = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()
    if not names:
        return None
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn; give a larger most_languages")
    per_language = min(per_language, max(8, most_rows // len(names)))
    place = F.pmod(F.xxhash64(F.col(row_id), F.lit(17)), F.lit(1 << 40))
    chosen = F.lit(False)
    for r in names:
        most = min(1.0, 1.2 * per_language / r.n)
        chosen = chosen | ((F.col(lang) == r.lang) & (place < F.lit(int(most * (1 << 40)))))
    picked = rows.filter(chosen & (F.octet_length(text) <= longest)).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), place.alias("place"))
    picked = picked.select("place", "text", F.xxhash64("text").alias("mark"), "lang")
    bound = per_language * len(names)
    # Texts are turned into features where they are read; only features (8 KB each) meet to be ordered and cut.
    picked = picked.mapInArrow(_featurise, "place long, mark long, lang string, x binary")
    got = picked.orderBy("place", "mark").limit(int(1.3 * bound) + 20).select("lang", "x").toArrow()
    if not got.num_rows:
        return None
    langs = got.column("lang").to_pylist()
    known = sorted(set(langs))
    x = np.empty((len(langs), WIDTH), np.float32)
    for k, v in enumerate(got.column("x")):
        x[k] = np.frombuffer(v.as_buffer(), np.float16)
    del got
    return Model(known, x, np.array([known.index(v) for v in langs]))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.schema.names[2:]
            for i, j, texts in text_blocks(batch.column(1), 1 << 20):
                name, score, vague = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                some = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
                for s in range(0, len(some), 256):
                    ks = some[s : s + 256]
                    best, sure, close = model.predict(np.stack([features(texts[k]) for k in ks]))
                    score[ks], vague[ks] = sure, close
                    for k, v in zip(ks, best, strict=True):
                        name[k] = model.names[v]
                own = [batch.column(c).slice(i, j - i) for c in rest]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(name, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(vague), *own], ["id", "lang_pred", "score", "ambiguous", *rest])

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text", row_id: str = "doc_id", **more: Column) -> DataFrame:
    """One row per input row: id, lang_pred, score, ambiguous, and the columns asked for in ``more``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"), *[c.alias(n) for n, c in more.items()])
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    fields += [rows.schema[n] for n in more]
    return rows.mapInArrow(_predict(model), T.StructType(fields)).withColumnRenamed("id", row_id)


def accepted(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.4) -> DataFrame:
    """The rows, with their own columns, whose language is known and whose score is at least ``least``.

    Without a model nothing is rejected but texts without a letter.
    """
    if model is None:
        return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = names[docs.columns.index(text)]
    rows = identify(plain.withColumn("no_id", F.lit(0)), model, at, "no_id", **{n: F.col(n) for n in names})
    return rows.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*names).toDF(*docs.columns)
