"""Joins, graphs, packing, mixing, licences and media against brute force and round trips."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import avi, components, embedding, hnsw, jaccard, license_rules, licenses, mixing, packing
from quillstream.llm.common import text_bytes
from quillstream.llm.license_rules import rules

NASTY = [(900, None, "s", 1), (901, "", None, 1), (902, " \n\t", "s", 1), (903, "One", "s", 1), (904, "one", "s", 1), (905, "one two", "s", 1), (906, "one two", "s", 1), (907, "w " * 30000, "s", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long")


def corpus(r, n=120):
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = r.choice(base).split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(999)}"
            t = " ".join(w)
        else:
            t = " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(6, 80))) + (" shared passage that many of them hold at their end" if r.random() < 0.5 else "")
        base.append(t)
        rows.append((i, t, f"s{i % 3}", 1))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, k, percent):
    rows = corpus(random.Random(k)) + NASTY
    rows += [(5, "again another row of five", "s", 1), (5, rows[7][1], "s", 1), (6, rows[6][1], "s", 1), (2, None, "s", 1)]
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    # tiles and bands of clusters whole, and dealt in blocks over several tasks
    for together in (1024, 3):
        got = jaccard.jaccard_components(frame(spark, rows).repartition(5), jaccard.JaccardParams(words=k, percent=percent, together=together)).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in ids}
        assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((i, len(s)) for i, own in sets.items() for s in own)


def test_order_counts_all_documents(spark):
    """Levels follow the counts of all documents, however they are dealt, and the numbers sent survive their coding."""
    x = np.array([1, 254, 255, 256, 70000, 3])
    assert jaccard._from_small(jaccard._small(x)).tolist() == x.tolist()
    texts = ["a common passage of words"] * 300 + [f"w{i} x{i} y{i} z{i} v{i}" for i in range(300)]
    for parts in (1, 7):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        order = jaccard.counted_order(df, jaccard.JaccardParams(words=5))
        _, s = jaccard.shingles(*text_bytes(pa.array([texts[0]])), 5)
        _, rare = jaccard.shingles(*text_bytes(pa.array(texts[300:])), 5)
        assert order.level(s).tolist() == [8] and np.median(order.level(rare)) == 1


def test_jaccard_edge_tables(spark):
    assert jaccard.jaccard_components(frame(spark, []).select("doc_id", "text")).count() == 0
    out = jaccard.jaccard_components(frame(spark, [(None, "a b c", "s", 1), (1, "a b c", "s", 1)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(None, None), (1, 1)}


def test_components_in_rounds(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(links, "a long, b long")
    node, root = components.local_components(*(np.array(x) for x in zip(*[x for x in links if x[0] != x[1]], strict=True)))
    for block in (40, 10**6):
        assert {tuple(x) for x in components.components(df, block).collect()} == set(zip(node.tolist(), root.tolist(), strict=True))
    assert components.components(df.limit(0)).count() == 0


def linked_vectors(r, n, dims):
    """Vectors of which a tenth have near copies, some of them many."""
    base = r.normal(size=(n, dims))
    near = base[: n // 10] + r.normal(size=(n // 10, dims)) * 0.2 * r.random((n // 10, 1))
    return np.concatenate([base, near, np.repeat(base[:1], 60, 0) + r.normal(size=(60, dims)) * 0.02, base[:5]]).astype(np.float32)


def brute_links(v):
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    node, root = components.local_components(*np.nonzero(near))
    return near, dict(zip(node.tolist(), root.tolist(), strict=True))


def test_embedding_against_brute_force(spark):
    """Shards of more than a thousand, so that graphs are searched: beams of 16 are no scans."""
    v = linked_vectors(np.random.default_rng(2), 4000, 16)
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)] + [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 16, 0), (9003, [None] * 16, 0), (9004, [float("nan")] * 16, 0), (9005, [float("inf")] + [1.0] * 15, 0), (9006, [1.0, 2.0], 0), (9007, [3.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links long")
    got = {x["vec_id"]: x for x in embedding.embedding_links(df, embedding.EmbeddingParams(piece=100_000)).collect()}
    near, want = brute_links(v)
    assert near.any(1).sum() > 500 and len(got) == len(rows) and got[0]["recall"] >= 0.995
    same = [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), want.get(i, i), want.get(i, i) == i) for i in range(len(v))]
    assert np.mean(same) >= 0.99
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(9000, 9008))
    assert got[None]["component_id"] is None and embedding.embedding_links(df.limit(0)).count() == 0


def test_shards_search_their_graphs(monkeypatch):
    """Without any exact scan but the audit's, the beam finds what links; planted neighbours measure it."""
    v = linked_vectors(np.random.default_rng(3), 3000, 64)
    near, _ = brute_links(v)
    u, first = np.unique(embedding.unit(v), axis=0, return_index=True)
    near = near[first][:, first]
    shard = embedding.Shard(embedding.Graph(u.astype(np.float32), (np.arange(len(u)) + 1) / len(u), 32), u, np.arange(len(u)), np.ones(len(u), np.int64), embedding.EmbeddingParams())
    assert shard.true >= 128 and shard.hits >= 0.995 * shard.true and shard.ef < 1000
    scanned = []
    exact = shard._exact
    monkeypatch.setattr(shard, "_exact", lambda q, own, rows: scanned.append(len(rows)) or exact(q, own, rows))
    links = shard.search(u, np.arange(len(u)))
    assert sum(scanned) < 100 and links.count.sum() >= 0.99 * near.sum()
    probes = embedding.planted(u, embedding.EmbeddingParams())
    assert ((probes @ u.T).max(1) >= 0.95).all()


def test_layers_above_hold_more_points_than_enter_at_first():
    """As in shards of some 16,000 and more: a descent ended at places that were not yet in the layer below, an error."""
    v = linked_vectors(np.random.default_rng(4), 4000, 16)
    near, _ = brute_links(v)
    u = embedding.unit(v)
    draw = np.random.default_rng(5).permutation(len(u))
    draw = np.where(draw < 1200, float(hnsw.M) ** -2.5, np.where(draw < 2800, float(hnsw.M) ** -1.5, 1))
    graph = embedding.Graph(u.astype(np.float32), draw, 32)
    assert [len(x.ids) for x in graph.layers] == [1200, 2800, len(u)]
    for x in graph.layers:
        assert x.links.max() < len(x.ids) and (x.links >= 0).any(1).all() and not (x.links == np.arange(len(x.ids))[:, None]).any()
    at, sims = graph.search(u.astype(np.float32), 128)
    r, c = np.nonzero((at >= 0) & (sims >= 0.95))
    found = np.zeros_like(near)
    found[r, at[r, c]] = True
    assert (found & near).sum() >= 0.99 * near.sum()
    shard = embedding.Shard(graph, u, np.arange(len(u)), np.ones(len(u), np.int64), embedding.EmbeddingParams())
    assert shard.hits >= 0.995 * shard.true and shard.search(u, np.arange(len(u))).count.sum() >= 0.99 * near.sum()


def test_buckets_are_optimal():
    r = random.Random(3)
    for _ in range(20):
        length = sorted(r.sample(range(1, 60), 7))
        count = [r.randint(1, 9) for _ in length]
        cost = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(length, count, strict=True))  # noqa: B023, E731
        best = min(cost({length[i], length[j], length[-1]}) for i in range(7) for j in range(7))
        assert cost(packing.boundaries(np.array(length), np.array(count), 3).tolist()) == best
    assert packing.boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3).tolist() == []


def test_buckets_beside_a_huge_document(spark):
    """One long text must not coarsen the buckets of the others."""
    sized = spark.range(1, 901).selectExpr("id % 300 + 1 AS n_tokens").union(spark.createDataFrame([(5_000_000,)], "n_tokens long"))
    ends = packing.choose_buckets(sized, packing.PackingParams(buckets=31))
    assert ends.tolist() == [*range(10, 301, 10), 5_000_000]


def test_many_lengths_are_exact():
    """More distinct lengths than ever, against the plain programme over all split places."""
    r = np.random.default_rng(9)
    length, count = np.sort(r.choice(10**6, 6000, replace=False)) + 1, r.integers(1, 50, 6000)
    c, s = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count * length))
    best = np.concatenate([[0], length * c[1:] - s[1:]])
    for _ in range(3):
        best = np.array([0] + [(best[:j] + length[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])).min() for j in range(1, 6001)])
    ends = packing.boundaries(length, count, 4)
    assert int((count * (ends[np.searchsorted(ends, length)] - length)).sum()) == best[-1]


def test_packing(spark):
    rows = corpus(random.Random(4)) + NASTY + [(5, "a b", "s", 1), (5, "a b", "s", 1)]
    params = packing.PackingParams(buckets=4, budget=100, block=16)
    out = packing.pack(frame(spark, rows), params=params).toPandas()
    assert sorted(out.doc_id) == sorted(r[0] for r in rows) and not out.duplicated(["batch_id", "slot"]).any()
    for _, b in out.groupby("batch_id"):
        assert b.bucket_len.nunique() == 1 and (b.n_tokens <= b.bucket_len).all() and (len(b) == 1 or len(b) * b.bucket_len.iloc[0] <= 100)
    assert packing.pack(frame(spark, [])).count() == 0


def test_long_documents_do_not_unbalance():
    """One document as long as many others: settled first, the others make up for it."""
    r = random.Random(12)
    for _ in range(200):
        size = sorted([r.randint(5, 60) for _ in range(50)] + [r.randint(500, 1200)], reverse=True)
        p0 = r.uniform(0.3, 0.7)
        p, live = mixing.flight([p0] * 51, size, [r.random() for _ in size])
        assert len(live) <= 2
        p = mixing.land(p, size, live, [p0] * 51)
        off = p0 * sum(size) - sum(a * b for a, b in zip(p, size, strict=True))
        assert set(p) <= {0.0, 1.0}
        assert all(size[i] > abs(off) for i in range(51) if p[i] == (0.0 if off > 0 else 1.0))


def test_flight_keeps_totals():
    r = random.Random(5)
    size = [r.randint(0, 50) for _ in range(300)]
    p, live = mixing.flight([0.3] * 300, size, [r.random() for _ in range(300)])
    assert len(live) <= 2 and all(x in (0, 1) or i in live for i, x in enumerate(p))
    assert sum(p) == pytest.approx(90) and sum(a * b for a, b in zip(p, size, strict=True)) == pytest.approx(0.3 * sum(size))


def test_mixing(spark):
    rows = corpus(random.Random(6), 400) + NASTY + [(903, "One", "s", 1)]
    df = frame(spark, rows)
    params = mixing.MixParams(block=64)
    a = mixing.mix_sources(df, params).toPandas()
    assert len(a) == len(rows) and (a.copies <= 2).all() and (a.copies >= 0).all()
    # water filling by hand
    a["source"] = a["source"].map(lambda s: s if isinstance(s, str) else "~none")  # the null source sorts last
    size = a.groupby("source")["size"].sum()
    names = sorted(size.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * size.sum(), list(names), {}
    while open_:
        full = [s for s in open_ if 2 * size[s] <= left * weight[s] / sum(weight[x] for x in open_)]
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    for s, g in a.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and g.source_size.iloc[0] == size[s]
        off = target[s] - (g["size"] * g.copies).sum()
        # no document may change that would mend more: 's' has one of 30,000 words and hardly any others
        base = int(target[s] / size[s] + 1e-9) if size[s] else 0
        able = g[(g["size"] > 0) & (g.copies == base)] if off > 0 else g[(g["size"] > 0) & (g.copies > base)]
        assert abs(off) < 60 or (able["size"] > abs(off)).all()
    b = mixing.mix_sources(df.repartition(3), params).toPandas()
    key = ["doc_id", "size", "copies"]
    assert a.sort_values(key)[key].reset_index(drop=True).equals(b.sort_values(key)[key].reset_index(drop=True))
    clashing = df.withColumns({"__copies": F.lit("c"), "copies": F.lit(1), "hash": F.lit(2), "id": F.lit(3), "row": F.lit(4), "of": F.lit(5)})
    out = mixing.mixed_documents(clashing, params)
    assert out.columns == clashing.columns and out.count() == a.copies.sum() and out.where("__copies = 'c' and row = 4").count() == out.count()
    assert mixing.mix_sources(frame(spark, [])).count() == 0


LICENSED = [
    (1, "Under-the MIT\nLicense, under the mit license."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "CC BY-NC 4.0 and cc by nc"),
    (4, "mit der Hand"),
    (5, None),
    (6, ""),
    (7, "see https://creativecommons.org/licenses/by-sa/4.0/ and GNU Lesser General Public License version 2.1. All rights reserved."),
    (8, "SPDX-License-Identifier: MPL-2.0 " * 300),
]


def test_licenses(spark):
    assert len(rules()) > 300 and all(re.compile(r.pattern) for r in rules())
    df = spark.createDataFrame([(i, t, "x") for i, t in LICENSED], "doc_id long, text string, n_words string").withColumns({"words": F.lit(1), "_found": F.lit(2), "Base0": F.lit(3)})
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert all((r["words"], r["_found"], r["Base0"]) == (1, 2, 3) for r in got.values()) and licenses.license_scan(df.limit(0)).count() == 0
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in LICENSED:
        w = word.findall((t or "").lower())
        places = [k for p, _ in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert got[i]["n_words"] == len(w) and sorted(got[i]["base_first"]) == sorted(places)
    labels = {i: sorted({d["label"] for d in r["detections"]}) for i, r in got.items()}
    assert labels == {1: ["mit"], 2: ["apache-2.0"], 3: ["cc-by-nc", "cc-by-nc-4.0"], 4: [], 5: [], 6: [], 7: ["all-rights-reserved", "cc-by-sa-4.0", "lgpl-2.1"], 8: ["mpl-2.0"]}
    for r in got.values():  # nothing kept lies inside another
        spans = [(d["first"], d["stop"]) for d in r["detections"]]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in spans for b in spans)


def test_every_rule_passes_the_gate():
    """A keyword must not be gated away: each rule's shortest plain text is found by the gate."""
    from quillstream.llm.license_rules import GATE, LICENCES

    gate = re.compile(GATE)
    plain = lambda p: re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", re.sub(r"\((?:\?:)?[^()]*\)\?", "", re.sub(r"\((?:\?:)?[^()]*\)\?", "", p))).replace("[cs]", "c").replace(" ?", " ").replace("\\d", "1")
    missed = [r.label for r in rules() if r.priority == 2 and not gate.search("licensed under the " + plain(r.pattern))]
    assert len(LICENCES) > 90 and not missed


def spelled(pattern):
    """All texts of a pattern without loops; a digit is 1."""

    def row(items):
        out = [""]
        for x in items:
            out = [a + b for a in out for b in one(*x)]
        return out

    def one(op, arg):
        match str(op):
            case "LITERAL":
                return [chr(arg)]
            case "CATEGORY":
                return ["1"]
            case "SUBPATTERN":
                return row(arg[3])
            case "BRANCH":
                return [t for b in arg[1] for t in row(b)]
            case "IN":
                return [t for x in arg for t in one(*x)]
        assert str(op) == "MAX_REPEAT" and arg[:2] == (0, 1)
        return ["", *row(arg[2])]

    return row(re._parser.parse(pattern))


def test_every_alternative_is_found(spark):
    """Each spelling of each rule, alone in a text, is one detection from end to end, by the best rule that spells it so."""
    grants, tags = itertools.cycle(spelled(license_rules.GRANT)), itertools.cycle(spelled(license_rules.TAG))
    texts = []
    for r in rules():
        for t in spelled(r.pattern.replace(license_rules.GRANT, "<").replace(license_rules.TAG, ">")):
            texts.append(t.replace("<", next(grants)).replace(">", next(tags)))
    texts = [t for t in texts if t == " ".join(t.split())]  # words have single spaces between them
    assert len(texts) > 15000
    df = spark.createDataFrame([(t,) for t in set(texts)], "text string").repartition(8)
    found = {r["text"]: [d["label"] for d in r["detections"] if d["first"] == 0 and d["stop"] == r["n_words"]] for r in licenses.license_scan(df).collect()}
    assert not [t for t in texts if not found[t]]
    own = [(r.priority, k, re.compile(r.pattern), r.label) for k, r in enumerate(rules())]
    own.sort(key=lambda x: x[:2])
    assert not [t for t in texts if found[t] != [next(label for *_, p, label in own if p.fullmatch(t))]]
    notices = [("Licensed under the Expat License", "mit"), ("Internet Systems Consortium License", "isc"), ("SPDX-License-Identifier: PSF-2.0", "psf-2.0")]
    got = licenses.license_scan(spark.createDataFrame(notices, "text string, want string")).collect()
    assert all([d["label"] for d in r["detections"]] == [r["want"]] for r in got)


def test_avi_round_trip():
    for n in (0, 1, 64, 1024, 1025, 5000):
        for raw in (bytes(n), os.urandom(n), b"\xff" * n, b"\xff\x00\xd9" * (n // 3)):
            payload = avi.padded(raw)
            back, luma = avi.read_payload(avi.encode_payload(payload))
            assert back == payload and luma.shape[1] == avi.SIDE**2


def test_general_decoder_agrees():
    media = avi.encode_payload(os.urandom(2048))
    info = avi.read_avi(media)
    fast, _ = avi.coefficients(media, info)
    for k, (a, s) in enumerate(info["frames"]):
        jpeg = media[a : a + s]
        assert (avi.decode_scan(jpeg, avi.read_head(jpeg))[1] == fast[k]).all()


def _flat_jpeg(level):
    """An 8x8 grey frame with tables of several codes: a DC difference, then the end of the block."""
    dc = bytes([0, 2, 0, 0, 0, 0, 0, 0] + [0] * 8) + bytes([0, 7])
    ac = bytes([1, 0, 0, 0, 0, 0, 0, 0] + [0] * 8) + bytes([0])
    value = level - 128
    bits = "01" + (f"{value:07b}" if value > 0 else f"{value + 127:07b}") + "0" if value else "00" + "0"
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = avi._segment
    return b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([8] + [1] * 63)) + seg(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + body + b"\xff\xd9"


def test_shots_of_a_film(spark):
    film = avi.write_avi([_flat_jpeg(v) for v in [200] * 5 + [40] * 4 + [128] * 3], 8, 8, 10)
    flash = avi.write_avi([_flat_jpeg(v) for v in [200] + [40] * 4 + [128, 220]], 8, 8, 10)
    assert [r[1] for r in avi.clip_rows(flash)] == [0, 1, 5, 6]
    assert avi.clip_rows(film) == [(0, 0, 5, 0, 500), (1, 5, 4, 500, 900), (2, 9, 3, 900, 1200)]
    c, head = avi.coefficients(film, avi.read_avi(film))
    assert [int(x[0]) for x in avi.samples(c, head)] == [200] * 5 + [40] * 4 + [128] * 3
    df = spark.createDataFrame([(1, film), (2, None), (3, b"junk"), (4, film[:200])], "id long, media binary")
    assert {r["id"] for r in avi.clips(df, "media", "id").collect()} == {1}
    texts = spark.createDataFrame([(1, "héllo"), (2, None), (3, "x" * 5000)], "doc_id long, text string")
    media = {r["doc_id"]: bytes(r["media"]) for r in avi.text_media(texts).collect()}
    assert avi.read_payload(media[1])[0].rstrip(b"\0") == "héllo".encode() and avi.read_payload(media[2])[0] == bytes(64)


def test_pipeline_stages(spark, tmp_path):
    """Over a folder of its own: decisions take effect, columns stay, and edge rows go through."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    docs = [(i, t, "en", s, len(t)) for i, t, s, _ in corpus(r, 200)]
    docs += [(1000 + i, " ".join(f"{w}###" for w in f"bad {i} " .split() * 30), "en", "s0", 9) for i in range(60)] + [(2000, None, "en", None, 0), (2001, "", "en", "s1", 0)]
    labels = [(i, int(i < 1000), int(i % 9 == 0)) for i in [*range(200), *range(1000, 1060)]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, df, str(tmp_path)).cache()
    ids = {x["doc_id"] for x in kept.collect()}
    assert kept.columns == df.columns and len(ids & set(range(200))) > 190 and len(ids & set(range(1000, 1060))) < 6
    single = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    groups = jaccard.jaccard_components(kept)
    assert sorted(x["doc_id"] for x in single.collect()) == sorted(x["doc_id"] for x in groups.where("doc_id = component_id").collect())
    mixed = corpus_pipeline.mix_sources(spark, single, str(tmp_path))
    packed = corpus_pipeline.pack_batches(spark, mixed, str(tmp_path))
    assert mixed.columns == df.columns and packed.count() == mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("batch_id").isNull()).count() == 0
