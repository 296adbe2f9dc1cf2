"""Classifiers, language identification and the language model: held-out accuracy, gradients, brute force, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import common, language, lm, quality, toxicity
from quillstream.llm.common import pieces, text_bytes, word_hashes
from quillstream.llm.trie import EliasFano, Trie

EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (4, "a"), (None, "x y"), (5, "é " * 5), (6, "word " * 60000), (7, "|" * 300)]


def edge(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in EDGE], "doc_id long, text string, score string")


def syllables(r, n, odd=()):
    words = ["".join(r.choice(["ba", "ko", "ri", "tu", "en", "so"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for w in odd:
        words[r.randrange(n)] = w
    return " ".join(words)


def test_pieces_cover_all_bytes():
    off = np.array([0, 0, 5, 5, 40])
    for most, overlap in ((8, 3), (100, 3), (1, 0)):
        seen = [set() for _ in range(4)]
        for doc, a, b in pieces(off, most, overlap):
            assert (b - a <= most).all()
            for d, x, y in zip(doc, a, b, strict=True):
                seen[d] |= set(range(x, y))
        assert [len(s) for s in seen] == [0, 5, 0, 35]


def test_word_hashes_match_words():
    r = random.Random(1)
    texts = ["", None, " a\tB  a", "x" * 9000, "x" * 9000 + "y x"] + ["".join(r.choice("ab \n") for _ in range(r.randint(0, 30))) for _ in range(200)]
    raw, off = text_bytes(pa.array(texts))
    h, doc = word_hashes(raw, off)
    words = [(i, w.lower()) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert doc.tolist() == [i for i, _ in words]
    assert len({(w, int(x)) for (_, w), x in zip(words, h, strict=True)}) == len({w for _, w in words}) == len(set(h.tolist()))


def test_toxicity_held_out(spark):
    r = random.Random(3)
    texts = [(i, syllables(r, 60, ["zogmuk", "vraxil"] if i % 8 == 0 else ())) for i in range(900)]
    p = pa.array([t for i, t in texts[:600] if i % 8 == 0])
    u = pa.array([t for _, t in texts[:600]])
    model = toxicity.fit(p, u, 1 / 8)
    s = model.score(*text_bytes(pa.array([t for _, t in texts[600:]])))
    y = np.array([i % 8 == 0 for i, _ in texts[600:]])
    assert ((s >= 0.7) == y).mean() > 0.97
    out = toxicity.score_toxicity(edge(spark), model).collect()
    assert len(out) == len(EDGE) and all(0 <= x["score"] <= 1 for x in out)
    assert toxicity.score_toxicity(edge(spark).limit(0), model).count() == 0
    assert (toxicity.fit(p.slice(0, 0), u, 0.1).score(*text_bytes(u)) == 0).all()


def test_risk_against_plain_sums():
    """The estimator written out, and its gradient by differences, on both sides of zero."""
    r = np.random.default_rng(4)
    xp, xu = r.integers(0, 2, (7, 5)).astype(np.float64), r.integers(0, 2, (11, 5)).astype(np.float64)
    loss = lambda z: math.log1p(math.exp(-z))
    sides = set()
    for scale, prior in ((0.3, 0.1), (0.3, 0.6), (3.0, 0.1), (3.0, 0.9)):
        w, b = r.normal(0, scale, 5), r.normal(0, scale, 1)
        if prior > 0.5:
            w, b = np.abs(w), np.abs(b) - 3 * scale  # positives high, unlabelled low
            xu = np.zeros_like(xu)
        p, u = xp @ w + b, xu @ w + b
        first = prior * np.mean([loss(z) for z in p])
        rest = np.mean([loss(-z) for z in u]) - prior * np.mean([loss(-z) for z in p])
        value, second, gw, gb = toxicity.risk(xp, xu, w, b, prior)
        assert value == pytest.approx(first + max(0, rest)) and second == pytest.approx(rest)
        sides.add(rest >= 0)
        part = (lambda w, b: sum(toxicity.risk(xp, xu, w, b, prior)[:1])) if rest >= 0 else (lambda w, b: -toxicity.risk(xp, xu, w, b, prior)[1])  # noqa: B023
        for k in range(5):
            e = np.eye(5)[k] * 1e-6
            assert gw[k] == pytest.approx((part(w + e, b) - part(w - e, b)) / 2e-6, abs=1e-6)
        assert gb[0] == pytest.approx((part(w, b + 1e-6) - part(w, b - 1e-6)) / 2e-6, abs=1e-6)
    assert sides == {True, False}


def test_toxicity_score_written_out():
    """Each text's n-grams, the chosen features, and the sum of their weights, without arrays."""
    r = random.Random(6)
    texts = ["", "zogmuk", "ZOGMUK vraxil  zogmuk", "é zogmuké", "abcd"] + [syllables(r, r.randint(1, 40), ["zogmuk"] if i % 2 else ()) for i in range(60)]
    model = toxicity.fit(pa.array([syllables(r, 50, ["zogmuk", "vraxil"]) for _ in range(90)]), pa.array([syllables(r, 50) for _ in range(300)]), 0.2)

    def hashed(b, salt):
        h = len(b) + salt
        for x in b:
            h = (h * 0x01000193 + x) & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - toxicity.BITS

    def score(text):
        low = bytes(x + 32 if 65 <= x <= 90 else x for x in text.encode())
        grams = [hashed(low[i : i + toxicity.NGRAM], 0) for i in range(len(low) - toxicity.NGRAM + 1)]
        for i, x in enumerate(low):
            if x not in b" \t\n\x0b\x0c\r" and (i == 0 or low[i - 1] in b" \t\n\x0b\x0c\r"):
                grams += [hashed(low[i : i + n], 64) for n in toxicity.BEGINNINGS if i + n <= len(low)]
        held = Counter(grams)
        features = set(held) | {g + (1 << toxicity.BITS) for g, n in held.items() if n > 1}
        z = model.bias + sum(model.weights[model.index[f]] for f in features if model.index[f] >= 0)
        return 1 / (1 + math.exp(-max(-60, min(60, z))))

    assert len(model.weights) > 5
    assert model.score(*text_bytes(pa.array(texts))) == pytest.approx([score(t) for t in texts], rel=1e-9)


@pytest.mark.parametrize(("rows", "toxic"), [(4000, 4), (400, 280)])
def test_toxicity_prior_of_any_size(spark, rows, toxic):
    """Of 0.1 % and of 70 % toxic labels: the risk takes the share as it is."""
    r = random.Random(rows)
    docs = spark.createDataFrame([(i, syllables(r, 12, ["zogmuk"] if i < toxic else ())) for i in range(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(rows)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, toxicity.ToxicityParams(steps=3)).prior == pytest.approx(toxic / rows)


def test_samples_hold_their_bound(spark):
    """One text longer than the bound beside short ones, ids that repeat and null ids by the thousand: rows in the order of their hash up
    to the bound, long texts cut to a piece, and the same sample on each run."""
    long = "".join(f"{i:07d} " for i in range(60_000))
    rows = [(i, f"short text {i} " * 10) for i in range(3000)] + [(5000, long), (7, "another"), *[(None, "the same")] * 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", common.row_hash(3))
    most = 200_000
    got = [sorted(map(tuple, common.within(d, most).select("doc_id", "text").collect()), key=str) for d in (docs, docs.repartition(7))]
    sizes = [len(t.encode()) for _, t in got[0]]
    assert got[0] == got[1] and most - most // 32 - 200 < sum(sizes) <= most and max(sizes) <= most // 32
    pieces_ = [t for i, t in got[0] if i == 5000]
    assert all(t in long for t in pieces_) and sum(i is None for i, _ in got[0]) <= 1 and len(got[0]) > 900
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(5000, 1), (None, 1)], "doc_id long, label int")
    sample = common.labelled_sample(docs.drop("_h"), labels, "label", 1500, most, 9).collect()
    assert 1000 < len(sample) < 1800 and sum(len(x["text"].encode()) for x in sample) <= most and len({x["doc_id"] for x in sample}) == len(sample)
    assert common.within(docs.limit(0), most).count() == 0


def test_toxicity_long_text_is_scored_whole():
    r = random.Random(5)
    base = [syllables(r, 60) for _ in range(400)]
    toxic = [syllables(r, 60, ["zogmuk", "vraxil"]) for _ in range(80)]
    model = toxicity.fit(pa.array(toxic), pa.array(base), 0.1)
    long = " ".join(base[:80])
    a, b = model.score(*text_bytes(pa.array([long + " zogmuk vraxil zogmuk vraxil", long])))
    small = toxicity.presence(*text_bytes(pa.array([long])), None, block=1000)
    assert np.array_equal(small, toxicity.presence(*text_bytes(pa.array([long])), None)) and a > b


def test_quality_gradients_and_held_out(spark):
    r = random.Random(2)
    texts = [syllables(r, r.randint(5, 150)) if i % 3 else " ".join(w + "###" for w in syllables(r, 60).split()) for i in range(300)]
    y = np.array([float(i % 3 > 0) for i in range(300)], np.float32)
    model = quality.QualityModel.new(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    raw, off = text_bytes(pa.array(texts[:6]))
    _, g = model.gradients(raw, off, y[:6])
    for name in ("filter", "in", "out"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        model.p[name][k] += 1e-4
        up = model.gradients(raw, off, y[:6])[0]
        model.p[name][k] -= 2e-4
        assert (up - model.gradients(raw, off, y[:6])[0]) / 2e-4 == pytest.approx(g[name][k], rel=0.05)
    fitted = quality.fit(pa.array(texts[:200]), y[:200], quality.QualityParams(steps=325, batch=16))
    s = fitted.score(*text_bytes(pa.array(texts[200:])))
    assert ((s >= 0.3) == (y[200:] == 1)).mean() > 0.95
    out = quality.score_quality(edge(spark), fitted).collect()
    assert len(out) == len(EDGE) and all(0 <= x["score"] <= 1 for x in out)
    assert (quality.QualityModel(None).score(raw, off) == 1).all()


def test_quality_against_plain_loops():
    """Every window of every chunk, the largest response of each filter, and the two layers, written out."""
    r = random.Random(8)
    model = quality.QualityModel.new(3)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    texts = ["", "short", syllables(r, 30), "é" * 300, syllables(r, 200)]
    got = model.score(*text_bytes(pa.array(texts)))
    for text, s in zip(texts, got, strict=True):
        raw = text.encode()
        starts = [0]
        while starts[-1] + quality.CHUNK < len(raw):
            starts.append(starts[-1] + quality.STRIDE)
        best = []
        for a in starts:
            own = np.frombuffer(raw[a : a + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
            answers = [p["embed"][own[i : i + quality.WIDTH]].reshape(-1) @ p["filter"] for i in range(quality.CHUNK - quality.WIDTH + 1)]
            best.append(np.maximum(np.max(answers, 0) + p["bias"], 0))
        x = np.concatenate([np.max(best, 0), np.mean(best, 0)])
        z = np.tanh(x @ p["in"] + p["in_b"]) @ p["out"] + p["out_b"][0]
        assert s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_intercept_follows_the_labels():
    s = np.random.default_rng(0).random(500)
    for rate in (0.02, 0.5, 0.93):
        z = np.log(s / (1 - s)) + quality.shift(s, rate)
        assert np.mean(1 / (1 + np.exp(-z))) == pytest.approx(rate, abs=1e-6)
    assert quality.shift(s, 1.0) == 0


def test_chunks_cover_documents():
    off = np.array([0, 0, 10, 10 + quality.CHUNK, 2000])
    start, doc = quality.chunks(np.zeros(2000, np.uint8), off)
    for d in range(4):
        end = max(s + quality.CHUNK for s in start[doc == d])
        assert end >= off[d + 1] and min(start[doc == d]) == off[d]


def test_language_gradient_and_held_out(spark):
    r = random.Random(4)
    sets = {"aa": ["bak", "kor", "tul"], "bb": ["éla", "ouer", "âne"], "cc": ["ßig", "zwei", "uüm"]}
    rows = [(k, " ".join(r.choice(v) + r.choice(v) for _ in range(r.randint(3, 40)))) for k, v in sets.items() for _ in range(60)]
    r.shuffle(rows)
    model = language.LanguageModel.new(["aa", "bb", "cc"], 1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, lang = np.frombuffer(rows[0][1].encode()[:12], np.uint8).reshape(12, 1), np.array([1])
    _, g = model.gradients(x, lang)
    scale = None
    for name in ("fgate", "bnew", "out", "fin"):
        k = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        model.p[name][k] += 1e-4
        up = model.gradients(x, lang)[0]
        model.p[name][k] -= 2e-4
        ratio = (up - model.gradients(x, lang)[0]) / 2e-4 / g[name][k]
        model.p[name][k] += 1e-4
        scale = scale or ratio  # gradients may be clipped to a common length
        assert ratio == pytest.approx(scale, rel=0.05)
    fitted = language.fit(pa.array([t for _, t in rows[:120]]), [k for k, _ in rows[:120]], language.LanguageParams(steps=80))
    p = fitted.pooled(*text_bytes(pa.array([t for _, t in rows[120:]])))
    assert np.mean([fitted.langs[i] == k for i, (k, _) in zip(p.argmax(1), rows[120:], strict=True)]) > 0.95
    out = {(r["doc_id"], r["lang_pred"]) for r in language.predict_language(edge(spark), fitted).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und")} <= out and not {(4, "und"), (5, "und")} & out
    assert {r["lang_pred"] for r in language.predict_language(edge(spark), language.LanguageModel([], None)).collect()} == {"und"}


def test_language_against_plain_loops():
    """Both recurrences byte by byte in each run, and the mean of the labels' probabilities."""
    r = random.Random(9)
    model = language.LanguageModel.new(["aa", "bb", "cc"], 2)
    p, h_size = {k: v.astype(np.float64) for k, v in model.p.items()}, language.HIDDEN
    texts = ["", "a", "héllo wörld", syllables(r, 60)]
    got = model.pooled(*text_bytes(pa.array(texts)))
    sig = lambda v: 1 / (1 + np.exp(-v))

    def walk(d, own):
        h, out = np.zeros(h_size), []
        for byte in own:
            a = p[d + "in"][byte]
            g = sig(a[: 2 * h_size] + h @ p[d + "gate"])
            z, reset = g[:h_size], g[h_size:]
            h = (1 - z) * h + z * np.tanh(a[2 * h_size :] + (reset * h) @ p[d + "new"])
            out.append(h)
        return out

    for text, mean in zip(texts, got, strict=True):
        raw, rows = text.encode(), []
        for i in range(0, len(raw), language.SPAN):
            own = list(raw[i : i + language.SPAN])
            for f, b in zip(walk("f", own), walk("b", own[::-1])[::-1], strict=True):
                y = np.exp(np.concatenate([f, b]) @ p["out"] + p["out_b"])
                rows.append(y / y.sum())
        want = np.mean(rows, 0) if rows else np.zeros(3)
        assert mean == pytest.approx(want, abs=1e-4)
        assert mean == pytest.approx(model.pooled(*text_bytes(pa.array([text])))[0], abs=1e-6)  # whatever stands beside it


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 2**64 - 1), (300, 400), (5000, 2**64 - 1)):
        v = np.unique(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = EliasFano.build(v)
        ask = np.unique(np.concatenate([v, r.integers(0, top, 300, dtype=np.uint64, endpoint=True)]))
        at = {int(x): i for i, x in enumerate(v)}
        assert e.index(ask).tolist() == [at.get(int(x), -1) for x in ask]
        assert (e[np.arange(len(v))] == v).all()


def test_trie_in_a_mapped_file(tmp_path):
    import mmap

    r = np.random.default_rng(1)
    c = r.integers(0, 50, 4000).astype(np.uint64) << np.uint64(57)
    w = r.integers(0, 90, 4000).astype(np.uint64) << np.uint64(40)
    k, n = np.unique(np.stack([c, w], 1), axis=0, return_counts=True)
    path = tmp_path / "t"
    path.write_bytes(Trie.build(k[:, 0], k[:, 1], n, 0.75).dump())
    with path.open("rb") as f:
        t = Trie.open(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        at = t.context(k[:, 0])
        total = Counter(c.tolist())
        assert np.allclose(t.successor(at, k[:, 1]), np.log10((n - 0.75) / np.array([total[int(x)] for x in k[:, 0]])), atol=2e-3)
        assert t.count(at).tolist() == [total[int(x)] for x in k[:, 0]]
        assert np.isnan(t.successor(at[:3], np.array([1, 2, 3], np.uint64))).all() and (t.context(np.array([7], np.uint64)) == -1).all()
        del t, at


def test_lm_against_brute_force(spark):
    r = random.Random(6)
    docs = [(i, syllables(r, r.randint(0, 60)) if i % 9 else None) for i in range(80)] + [(3, "the same Row"), (3, "the same Row"), (None, "tail"), (200, "the " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm.lm_scores(df, F.col("doc_id") % 4 != 0, lm.LmParams(least_shards=5)).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["</s>"]
    uni, bi = Counter(), Counter()
    for i, t in docs:
        if i is not None and i % 4 != 0:
            w = words(t)
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    total, kinds, context = sum(uni.values()), Counter(), Counter()
    for (a, _), n in bi.items():
        context[a] += n
        kinds[a] += 1
    p1 = lambda w: math.log10((uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1)))

    def score(w):
        out = 0.0
        for a, b in zip(["<s>", *w[:-1]], w, strict=True):
            n = bi[a, b]
            out += math.log10((n - 0.75) / context[a]) if n else p1(b) + (math.log10(0.75 * kinds[a] / context[a]) if context[a] else 0)
        return out

    want = sorted((-1 if i is None else i, len(w), sum(uni[x] > 0 for x in w), total, round(sum(map(p1, w)), 5), round(score(w), 1)) for i, t in docs for w in [words(t)])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 1)) for r in got) == want
    assert lm.lm_scores(df.limit(0), F.lit(True)).count() == 0
    untrained = lm.lm_scores(df.where("doc_id = 1"), F.lit(False)).first()
    assert untrained["train_tokens"] == 0 and untrained["n_known"] == 0
