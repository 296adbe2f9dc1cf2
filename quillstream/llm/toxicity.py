"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed byte n-grams and word beginnings is trained from confirmed toxic texts (P) and
unlabelled texts (U) by minimising the class-prior-corrected risk

    prior * E_P[loss(f, +1)] + max(0, E_U[loss(f, -1)] - prior * E_P[loss(f, -1)])

with the logistic loss; where the second part falls below zero its gradient is reversed, which keeps the
classifier from fitting the unlabelled toxic texts as clean (Kiryo et al., 2017). Training runs in numpy on
the driver over bounded samples; scoring covers every byte of every text on the executors.

Edge cases: a null or empty text has no n-gram and gets the score of the bias alone; texts that repeat get equal
scores; null labels or ids are not learned from; without any toxic example each score is 0; an empty table gives
an empty result; other columns pass through, one with the name of the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import IS_SPACE, LOWER, Adam, arrow_rows, doc_fold, labelled_sample, mix64, pieces, row_hash, runs, sample_limit, table, text_bytes, with_text_scores, within
from quillstream.llm.jaccard import shingles

#: Bytes of an n-gram anywhere, and of the beginnings of words; bits of a hash.
NGRAM, BEGINNINGS, BITS = 5, (4, 6, 8), 20


@dataclass(frozen=True)
class ToxicityParams:
    #: Bounds of the training samples: rows of each kind, and bytes of text.
    most_positive: int = 3000
    most_unlabelled: int = 5000
    most_bytes: int = 14 << 20
    features: int = 2048
    #: Least likelihood-ratio statistic of a feature's document counts in P against those in U.
    least_g: float = 24.0
    #: Used only where labels tell nothing of the class prior.
    default_prior: float = 0.1
    steps: int = 250
    rate: float = 0.05
    l2: float = 2e-4
    seed: int = 11


def _hashed(low: np.ndarray, at: np.ndarray | None, size: int) -> np.ndarray:
    """Hashes, of BITS bits, of the ``size`` bytes from each place (from every place where at is None)."""
    n = len(low) - size + 1 if at is None else len(at)
    h = np.full(n, size if at is None else size + 64, np.uint32)
    for k in range(size):
        h *= np.uint32(0x01000193)
        h += low[k : k + n] if at is None else low[at + k]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - BITS)
    return h


#: Bytes that pieces of one document share, so that whatever begins in one ends in it.
_SHARED = max(NGRAM, *BEGINNINGS) - 1


def _grams(raw: np.ndarray, start: np.ndarray, end: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams (A-Z lowered) and of the word beginnings within runs [start, end), and each one's run.
    opens, closes: whether a run begins or ends its document; what begins in the bytes shared with the next run is left to it."""
    size = end - start
    low = LOWER[np.concatenate([raw[a:b] for a, b in zip(start, end, strict=True)])]
    run = np.repeat(np.arange(len(start)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(low))
    own = left > np.repeat(np.where(closes, 0, _SHARED), size)
    space = IS_SPACE[low]
    begins = ~space
    begins[1:] &= space[:-1]
    first = np.cumsum(size) - size
    begins[first] = ~space[first] & (opens | IS_SPACE[raw[np.maximum(start - 1, 0)]])
    out, of = [], []
    if len(low) >= NGRAM:
        n = len(low) - NGRAM + 1
        inside = (left[:n] >= NGRAM) & own[:n]
        out.append(_hashed(low, None, NGRAM)[inside])
        of.append(run[:n][inside])
    for n in BEGINNINGS:
        at = np.flatnonzero(begins & own & (left >= n))
        out.append(_hashed(low, at, n))
        of.append(run[at])
    return np.concatenate(out), np.concatenate(of)


def presence(raw: np.ndarray, offsets: np.ndarray, index: np.ndarray | None, block: int = 1 << 20) -> np.ndarray:
    """Distinct (document, feature) pairs as document << 32 | feature. Each hash is two features: that a document holds
    it, and, 2**BITS further, that it does so more than once; index maps features to numbers, -1 to none."""
    keys, counts = [], []
    for doc, a, b in pieces(offsets, block, _SHARED):
        h, run = _grams(raw, a, b, a == offsets[doc], b == offsets[doc + 1])
        if index is not None:
            hit = (index[h] >= 0) | (index[h + np.uint32(1 << BITS)] >= 0)
            h, run = h[hit], run[hit]
        k, n = np.unique(doc[run].astype(np.int64) << 32 | h, return_counts=True)
        keys.append(k)
        counts.append(n)
    if not keys:
        return np.zeros(0, np.int64)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    twice = key[np.bincount(place, np.concatenate(counts), minlength=len(key)) > 1] + (1 << BITS)
    found = np.concatenate([key, twice])
    if index is None:
        return found
    number = index[found & 0xFFFFFFFF].astype(np.int64)
    return (found >> 32 << 32 | number)[number >= 0]


class ToxicityModel:
    def __init__(self, index: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.index, self.weights, self.bias, self.prior = index, weights, bias, prior

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.weights):
            return np.full(n, 0.0)
        found = presence(raw, offsets, self.index)
        z = self.bias + np.bincount(found >> 32, self.weights[found & 0xFFFFFFFF], minlength=n)[:n]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _document_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that hold each n-gram, counted over runs of whole documents so that few pairs are held at a time."""
    counts = np.zeros(2 << BITS, np.int64)
    for a, b in runs(offsets, 1 << 20):
        f = presence(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], None)
        counts += np.bincount(f & 0xFFFFFFFF, minlength=2 << BITS)
    return counts


def _unlike(texts, hashes: int = 4):
    """The texts without copies and near copies, which would make their own words look toxic or clean: a text goes if
    it shares one of a few minimum hashes of its three-word shingles with an earlier one."""
    texts = pc.unique(texts)
    raw, off = text_bytes(texts)
    seen: set[tuple[int, int]] = set()
    keep = np.ones(len(off) - 1, bool)
    for a, b in runs(off, 1 << 20):
        doc, s = shingles(raw[off[a] : off[b]], off[a : b + 1] - off[a], 3)
        first = np.searchsorted(doc, np.arange(b - a))
        has = np.flatnonzero(np.diff(np.append(first, len(doc))))
        least = [np.minimum.reduceat(mix64(s + np.uint64(k + 1) * np.uint64(0x9E37)), first[has]) for k in range(hashes)] if len(has) else []
        for i, *own in zip((a + has).tolist(), *(x.tolist() for x in least), strict=True) if len(has) else ():
            marks = set(enumerate(own))
            keep[i] = not marks & seen
            seen |= marks
    return texts.filter(keep)


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The non-negative risk of a linear classifier; its second part before it is cut at zero, the risk of what is not
    positive; and the direction of the next step: the risk's gradient, or, where that part is below zero, away from it."""
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    zp, zu = xp @ w + b, xu @ w + b
    first = prior * float(np.logaddexp(0, -zp).mean())
    rest = float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())
    d_first, d_p, d_u = -(1 - sig(zp)) * prior / len(zp), -prior * sig(zp) / len(zp), sig(zu) / len(zu)
    gp, gu = (d_first + d_p, d_u) if rest >= 0 else (-d_p, -d_u)
    gw = xp.T @ gp.astype(xp.dtype) + xu.T @ gu.astype(xu.dtype)
    return first + max(0.0, rest), rest, gw, np.array([gp.sum() + gu.sum()], w.dtype)


def fit(positive, unlabelled, prior: float, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """positive, unlabelled: Arrow columns of texts."""
    rp, op = text_bytes(_unlike(positive))
    ru, ou = text_bytes(_unlike(unlabelled))
    n_p, n_u = len(op) - 1, len(ou) - 1
    empty = np.full(2 << BITS, -1, np.int16)
    if not n_p or not n_u:
        return ToxicityModel(empty, np.zeros(0), -60.0, prior)
    dp, du = (_document_counts(r, o) for r, o in ((rp, op), (ru, ou)))
    expected = (du + 0.5) * (n_p / n_u)
    g = 2 * (dp * np.log(np.maximum(dp, 1) / expected) - (dp - expected))
    chosen = np.argsort(-g, kind="stable")[: params.features]
    chosen = np.sort(chosen[g[chosen] >= params.least_g])
    index = empty.copy()
    index[chosen] = np.arange(len(chosen))

    def dense(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = np.zeros((len(off) - 1, len(chosen)), np.float32)
        f = presence(raw, off, index)
        x[f >> 32, f & 0xFFFFFFFF] = 1
        return x

    xp, xu = dense(rp, op), dense(ru, ou)
    w = {"w": np.zeros(len(chosen), np.float32), "b": np.full(1, np.log(prior / (1 - prior)), np.float32)}
    adam = Adam(w, params.rate)
    for _ in range(params.steps):
        *_, gw, gb = risk(xp, xu, w["w"], w["b"], prior)
        adam.step({"w": gw + params.l2 * w["w"], "b": gb})
    return ToxicityModel(index, w["w"].astype(np.float64), float(w["b"][0]), prior)


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, toxic); pass only rows that may be learned from. The class prior is the share of toxic labels,
    however small or large; params.default_prior where labels are all alike or missing."""
    known = labels.where("doc_id is not null and toxic is not null")
    seen = known.agg(F.count(F.lit(1)), F.sum(F.col("toxic"))).first()
    prior = seen[1] / seen[0] if seen[0] and seen[1] and seen[1] < seen[0] else params.default_prior
    positive = labelled_sample(docs, known.where("toxic = 1"), "toxic", params.most_positive, params.most_bytes, params.seed)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_hash(params.seed + 1).alias("_h"))
    part = params.most_unlabelled / max(docs.select("doc_id").count(), 1)
    unlabelled = within(hashed.where(F.col("_h") < sample_limit(part)), params.most_bytes).drop("_h")
    return fit(arrow_rows(positive)["text"], arrow_rows(unlabelled)["text"], prior, params)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """The frame plus the probability that each text is toxic."""
    return with_text_scores(df, model, text, out)  # 2**21 int16 and at most `features` weights


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(doc_fold(3) != 1).select("doc_id", "text"), labels.where(doc_fold(3) != 1).select("doc_id", "toxic"))
    scored = score_toxicity(docs.select("doc_id", (doc_fold(3) == 1).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
