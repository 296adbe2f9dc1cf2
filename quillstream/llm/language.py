"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into runs of SPAN bytes that cover them whole. One recurrent layer reads each run forwards, another
backwards; both states label every byte position with a distribution over the learned languages, and a document's
probabilities are the mean over its positions. Since the input is a byte, its product with the input weights is a row
of a table. The network is trained in numpy by backpropagation through time.

Edge cases: a null text and one without a letter are ``und`` with score 0; null languages are not learned from;
without any language to learn each text is ``und``; ties go to the language that sorts first; equal texts get equal
results; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import Adam, arrow_rows, doc_fold, give_back, row_hash, sample_limit, sent, table, text_bytes, within

SPAN, HIDDEN = 128, 16


@dataclass(frozen=True)
class LanguageParams:
    #: Bounds of the training sample: rows, bytes, and runs a step; each step draws runs anywhere in the sample.
    most_rows: int = 6000
    most_bytes: int = 24 << 20
    batch: int = 256
    span: int = 48
    steps: int = 260
    rate: float = 0.03
    seed: int = 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class LanguageModel:
    def __init__(self, langs: list[str], params: dict[str, np.ndarray] | None):
        self.langs, self.p = langs, params

    @staticmethod
    def new(langs: list[str], seed: int) -> LanguageModel:
        r = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {}
        for d in "fb":
            p[d + "in"] = r.normal(0, 0.3, (256, 3 * HIDDEN))
            p[d + "gate"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 2 * HIDDEN))
            p[d + "new"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, HIDDEN))
        p["out"] = r.normal(0, 1 / np.sqrt(2 * HIDDEN), (2 * HIDDEN, len(langs)))
        p["out_b"] = np.zeros(len(langs))
        return LanguageModel(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def states(self, d: str, x: np.ndarray, keep: bool = False):
        """x: steps by runs. The state after each step; with keep, what backpropagation needs too."""
        p, steps, n = self.p, *x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        kept = []
        if not keep:
            return self._forward(d, x, out)
        for t in range(steps):
            a = p[d + "in"][x[t]]
            g = _sigmoid(a[:, : 2 * HIDDEN] + h @ p[d + "gate"])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            rh = r * h
            c = np.tanh(a[:, 2 * HIDDEN :] + rh @ p[d + "new"])
            if keep:
                kept.append((h, z, r, rh, c))
            h = h + z * (c - h)
            out[t] = h
        return (out, kept) if keep else out

    def _forward(self, d: str, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """states() without what training keeps: arrays are reused, units run along rows, and the halves of the sigmoid are
        folded into the weights."""
        p, (steps, n) = self.p, x.shape
        table = np.ascontiguousarray(p[d + "in"])
        table = np.concatenate([table[:, : 2 * HIDDEN] * 0.5, table[:, 2 * HIDDEN :]], 1).astype(np.float32)
        gate, new = (p[d + "gate"] * 0.5).astype(np.float32), p[d + "new"].astype(np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        g, c, q = (np.empty((n, w), np.float32) for w in (2 * HIDDEN, HIDDEN, HIDDEN))
        a = np.empty((n, 3 * HIDDEN), np.float32)
        for t in range(steps):
            np.take(table, x[t], axis=0, out=a, mode="clip")
            np.matmul(h, gate, out=g)
            g += a[:, : 2 * HIDDEN]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.multiply(g[:, HIDDEN:], h, out=q)
            np.matmul(q, new, out=c)
            c += a[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            c -= h
            c *= g[:, :HIDDEN]
            h = np.add(h, c, out=out[t])
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position: steps by runs by languages."""
        both = np.concatenate([self.states("f", x), self.states("b", x[::-1])[::-1]], 2)
        y = both.reshape(-1, 2 * HIDDEN) @ self.p["out"] + self.p["out_b"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y.reshape(*x.shape, len(self.langs))

    def pooled(self, raw: np.ndarray, offsets: np.ndarray, block: int = 2048) -> np.ndarray:
        """Mean probabilities of each document over its positions; zeros for empty ones."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.langs)))
        size = np.diff(offsets)
        runs = -(-size // SPAN)
        doc = np.repeat(np.arange(n), runs)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        start = offsets[doc] + nth * SPAN
        length = np.minimum(SPAN, offsets[doc + 1] - start)
        order = np.argsort(-length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for same in np.split(order, cuts):  # runs of one length, so that none is padded and no text's labels depend on others
            for i in range(0, len(same), block):
                own = same[i : i + block]
                x = raw[start[own] + np.arange(length[own[0]])[:, None]]
                y = self.labels(x).sum(0)
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(doc[own], y[:, k], minlength=n)
        return total / np.maximum(size, 1)[:, None]

    def gradients(self, x: np.ndarray, lang: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross entropy of every position's label, and its gradient through time."""
        p, (steps, n) = self.p, x.shape
        forward, kf = self.states("f", x, True)
        backward, kb = self.states("b", x[::-1], True)
        both = np.concatenate([forward, backward[::-1]], 2).reshape(-1, 2 * HIDDEN)
        y = both @ p["out"] + p["out_b"]
        y -= y.max(1, keepdims=True)
        y = np.exp(y)
        y /= y.sum(1, keepdims=True)
        own = np.tile(lang, steps)
        loss = -np.log(y[np.arange(len(own)), own] + 1e-9).mean()
        y[np.arange(len(own)), own] -= 1
        y /= len(own)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out_b"] = both.T @ y, y.sum(0)
        dboth = (y @ p["out"].T).reshape(steps, n, 2 * HIDDEN)
        for d, kept, ds, xs in (("f", kf, dboth[:, :, :HIDDEN], x), ("b", kb, dboth[::-1, :, HIDDEN:], x[::-1])):
            dh = np.zeros((n, HIDDEN), np.float32)
            da = np.empty((steps, n, 3 * HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                h, z, r, rh, c = kept[t]
                dh = dh + ds[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ p[d + "new"].T
                dr = drh * h * r * (1 - r)
                dg = np.concatenate([dz, dr], 1)
                g[d + "new"] += rh.T @ dc
                g[d + "gate"] += h.T @ dg
                dh = dh * (1 - z) + drh * r + dg @ p[d + "gate"].T
                da[t, :, : 2 * HIDDEN], da[t, :, 2 * HIDDEN :] = dg, dc
            hot = np.zeros((256, steps * n), np.float32)
            hot[xs.reshape(-1), np.arange(steps * n)] = 1
            g[d + "in"] = hot @ da.reshape(-1, 3 * HIDDEN)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        if norm > 1:
            g = {k: v / norm for k, v in g.items()}
        return float(loss), g


def fit(texts, langs: list[str], params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Languages weigh alike: each run of a step comes from a language drawn evenly, then from any place of its texts."""
    raw, off = text_bytes(texts)
    lang = np.array(langs, dtype=object)
    size = np.diff(off)
    names = sorted({x for x, s in zip(langs, size, strict=True) if s})
    if not names:
        return LanguageModel([], None)
    model = LanguageModel.new(names, params.seed)
    adam, r = Adam(model.p, params.rate), np.random.default_rng(params.seed + 1)
    of = [np.flatnonzero((lang == x) & (size > 0)) for x in names]
    ends = [np.cumsum(size[k]) for k in of]
    for step in range(params.steps if len(names) > 1 else 0):
        own = r.integers(0, len(names), params.batch)
        x = np.zeros((params.span, params.batch), np.uint8)
        for i, k in enumerate(own):
            j = int(np.searchsorted(ends[k], r.integers(ends[k][-1]), side="right"))
            d = of[k][j]
            a = off[d] + r.integers(max(1, size[d] - params.span + 1))
            part = raw[a : min(a + params.span, off[d + 1])]
            x[: len(part), i] = part
        adam.rate = params.rate * (1 - 0.95 * step / params.steps)
        adam.step(model.gradients(x, own)[1])
    return model


def train(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """docs (doc_id, text, lang); pass only rows that may be learned from."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang", row_hash(params.seed).alias("_h"))
    part = params.most_rows / max(docs.where("lang is not null").count(), 1)
    got = arrow_rows(within(known.where(F.col("_h") < sample_limit(part)), params.most_bytes).drop("_h"))
    return fit(got["text"], got["lang"].to_pylist(), params)


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of each row."""
    load = sent(df.sparkSession, model)  # some thousand floats
    lettered = df.select(key, text, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered"))

    def run(batches):
        model = load()
        for b in batches:
            raw, off = text_bytes(b.column(1))
            n = len(off) - 1
            letters = b.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(model.langs)
            best, score = ["und"] * n, np.zeros(n)
            if letters.any():
                p = model.pooled(raw, off)
                top = p.argmax(1)
                best = [model.langs[k] if ok else "und" for k, ok in zip(top, letters, strict=True)]
                score = np.where(letters, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score)], [key, "lang_pred", "score"])
            give_back()

    return lettered.mapInArrow(run, T.StructType([df.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(doc_fold(4) != 2).select("doc_id", "text", "lang"))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (doc_fold(4) == 2).alias("held_out"), "lang_pred", "score")
