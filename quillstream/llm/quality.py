"""Quality by a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all its bytes. Each byte is embedded, learned filters run over
windows of bytes, and rectified responses are max-pooled per chunk; the maximum and the mean over a document's chunks
go through a hidden layer into one probability. Training is plain backpropagation: through a max-pool the gradient
reaches only the winning window of each filter.

Edge cases: null and empty texts count as one chunk of padding and get its score; a last short chunk is padded with
byte 0, whose embedding is fixed at zero; equal texts get equal scores; null labels or ids are not learned from;
without labelled rows each score is 1 (nothing is rejected); an empty table gives an empty result; other columns
pass through, one with the name of the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import Adam, arrow_rows, doc_fold, labelled_sample, table, text_bytes, with_text_scores

CHUNK, STRIDE, WIDTH, EMBED, FILTERS, HIDDEN = 256, 224, 8, 8, 24, 16


@dataclass(frozen=True)
class QualityParams:
    #: Bounds of the training sample.
    most_rows: int = 4000
    most_bytes: int = 12 << 20
    steps: int = 504
    batch: int = 48
    rate: float = 4e-3
    seed: int = 5


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each chunk and its document; chunks overlap by CHUNK - STRIDE bytes and reach the document's end."""
    size = np.diff(offsets)
    n = np.where(size <= CHUNK, 1, -(-(size - CHUNK) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[doc] + nth * STRIDE, doc


def gather(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Bytes of the chunks as rows of CHUNK, zero beyond the document."""
    at = start[:, None] + np.arange(CHUNK)
    out = raw[np.minimum(at, max(len(raw) - 1, 0))] if len(raw) else np.zeros(at.shape, np.uint8)
    return np.where(at < stop[:, None], out, np.uint8(0))


class QualityModel:
    def __init__(self, params: dict[str, np.ndarray] | None):
        self.p = params

    @staticmethod
    def new(seed: int) -> QualityModel:
        r = np.random.default_rng(seed)
        p = {
            "embed": r.normal(0, 0.5, (256, EMBED)),
            "filter": r.normal(0, 1 / np.sqrt(WIDTH * EMBED) * 2, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "in": r.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)),
            "in_b": np.zeros(HIDDEN),
            "out": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "out_b": np.full(1, 1.0),
        }
        p["embed"][0] = 0
        return QualityModel({k: v.astype(np.float32) for k, v in p.items()})

    def pooled(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk, and where it is. Windows of one phase don't overlap, so each
        phase is one matrix product over a reshaped view."""
        e = self.p["embed"][rows]
        n = len(rows)
        best, place = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int32) if where else None
        for r in range(WIDTH):
            m = (CHUNK - r) // WIDTH
            y = e[:, r : r + m * WIDTH].reshape(n * m, WIDTH * EMBED) @ self.p["filter"]
            y = y.reshape(n, m, FILTERS)
            top = y.max(1)
            if where:
                better = top > best
                place = np.where(better, y.argmax(1).astype(np.int32) * WIDTH + r, place)
            np.maximum(best, top, out=best)
        return best + self.p["bias"], place

    def head(self, f: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.maximum(f, 0)
        top, mean = np.maximum.reduceat(a, first), np.add.reduceat(a, first) / count[:, None]
        x = np.concatenate([top, mean], 1)
        h = np.tanh(x @ self.p["in"] + self.p["in_b"])
        return a, top, x, h, h @ self.p["out"] + self.p["out_b"]

    def score(self, raw: np.ndarray, offsets: np.ndarray, block: int = 2048) -> np.ndarray:
        n = len(offsets) - 1
        if self.p is None or not n:
            return np.ones(n)
        start, doc = chunks(raw, offsets)
        f = np.empty((len(doc), FILTERS), np.float32)
        for i in range(0, len(doc), block):
            s = slice(i, i + block)
            f[s] = self.pooled(gather(raw, start[s], offsets[doc[s] + 1]))[0]
        count = np.bincount(doc, minlength=n)
        z = self.head(f, np.cumsum(count) - count, count)[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))

    def gradients(self, raw: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        start, doc = chunks(raw, offsets)
        rows = gather(raw, start, offsets[doc + 1])
        f, place = self.pooled(rows, True)
        count = np.bincount(doc, minlength=len(y))
        first = np.cumsum(count) - count
        a, top, x, h, z = self.head(f, first, count)
        p = self.p
        dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60)))) - y).astype(np.float32) / len(y)
        dh = dz[:, None] * p["out"] * (1 - h * h)
        dx = dh @ p["in"].T
        winner = a == top[doc]
        ties = np.add.reduceat(winner.astype(np.float32), first)
        df = (dx[doc, :FILTERS] * winner / ties[doc] + dx[doc, FILTERS:] / count[doc][:, None]) * (f > 0)
        window = rows[np.arange(len(rows))[:, None, None], place[:, :, None] + np.arange(WIDTH)]
        e = p["embed"][window].reshape(len(rows), FILTERS, WIDTH * EMBED)
        g = {"out": h.T @ dz, "out_b": dz.sum(keepdims=True), "in": x.T @ dh, "in_b": dh.sum(0), "bias": df.sum(0), "filter": np.einsum("nf,nfk->kf", df, e, optimize=True)}
        de = (df[:, :, None] * p["filter"].T[None]).reshape(-1, EMBED)
        flat = window.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, de[:, k], minlength=256) for k in range(EMBED)], 1).astype(np.float32)
        g["embed"][0] = 0
        return float(np.mean(np.logaddexp(0, -z * (2 * y - 1)))), g


def fit(texts, y: np.ndarray, params: QualityParams = QualityParams()) -> QualityModel:
    raw, off = text_bytes(texts)
    n = len(y)
    if not n:
        return QualityModel(None)
    model = QualityModel.new(params.seed)
    adam, r = Adam(model.p, params.rate), np.random.default_rng(params.seed + 1)
    order = np.zeros(0, np.int64)
    for step in range(params.steps):  # as many for any number of rows
        if len(order) < params.batch:
            order = np.concatenate([order, r.permutation(n)])
        own, order = order[: params.batch], order[params.batch :]
        part = np.concatenate([raw[off[k] : off[k + 1]] for k in own])
        o = np.concatenate([[0], np.cumsum(off[own + 1] - off[own])])
        _, g = model.gradients(part, o, y[own].astype(np.float32))
        adam.rate = params.rate * (1 - 0.9 * step / params.steps)
        adam.step(g)
    model.p["out_b"] += np.float32(shift(model.score(raw, off), float(np.mean(y))))
    return model


def shift(score: np.ndarray, rate: float) -> float:
    """What to add to all log odds so that the mean score is the rate of label 1 (0 where all labels are equal)."""
    if not 0 < rate < 1:
        return 0.0
    z = np.log(np.clip(score, 1e-12, 1)) - np.log(np.clip(1 - score, 1e-12, 1))
    low, high = -30.0, 30.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.mean(1 / (1 + np.exp(-np.clip(z + mid, -60, 60)))) < rate else (low, mid)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """docs (doc_id, text), labels (doc_id, quality); pass only rows that may be learned from."""
    got = arrow_rows(labelled_sample(docs, labels, "quality", params.most_rows, params.most_bytes, params.seed))
    return fit(got["text"], np.asarray(got["label"]).astype(np.float32), params)


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """The frame plus the probability that each text is of good quality."""
    return with_text_scores(df, model, text, out)  # some thousand floats


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(doc_fold(5) != 0).select("doc_id", "text"), labels.where(doc_fold(5) != 0).select("doc_id", "quality"))
    scored = score_quality(docs.select("doc_id", (doc_fold(5) == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
