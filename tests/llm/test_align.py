"""Groups, links and counts of two tokenizers against plain Python over the tokenizers' own encodings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import align, registry

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def encoders():
    a = tokenizers.Tokenizer.from_file(align.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.vocabulary("piece_bpe_32k.model"))
    alphabet = align.byte_alphabet()
    of_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    return (lambda t: [(i, of_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, of_b(i)) for i in b.encode(t)])


def groups_of(text, a, b):
    """[(A ids, B ids)] of a text, none where the tokens don't spell it."""
    if not text:
        return []
    sides = [a(text), b(text)]
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
        return []
    ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in sides]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, at = [], [0, 0]
    for c in cuts:
        own = []
        for k in range(2):
            first = at[k]
            while at[k] < len(ends[k]) and ends[k][at[k]] <= c:
                at[k] += 1
            own.append([i for i, _ in sides[k][first : at[k]]])
        out.append(tuple(own))
    return out


def brute(rows):
    a, b = encoders()
    groups = {t: groups_of(t, a, b) for t in {t for _, t in rows}}
    pairs = {t: Counter((x, y) for ga, gb in g for x in ga for y in gb) for t, g in groups.items()}
    holds = Counter(p for _, t in rows for p in pairs[t])
    most = {}
    for (x, _), n in holds.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, t in rows:
        g, p = groups[t], pairs[t]
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        sha = hashlib.sha256(told.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(p.values()), sum(n for q, n in p.items() if holds[q] == most[q[0]]), sum(n * holds[q] for q, n in p.items()), sha))
    return sorted(out, key=str)


def documents():
    r = random.Random(12)
    parts = ["the ", "Straße", " über", "東京タワー", "123456", "\n\n", "   ", "don't", "🙂👩‍👩‍👧", "<|endoftext|>", "</s>", "<s>", "\t", "a", "zzzz", "=====", "é", "é", " ", "ﬁ", "▁", "　", "\x00", "lorem ipsum dolor ", "XML<b>"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, "=" * 5000), (205, "word " * 30_000), (206, "x"), (None, "no id"), (None, "no id"), (207, " lead"), (208, "trail  ")]
    return rows + [rows[3]] * 3 + [(209, rows[5][1])]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_against_plain_python(spark, tmp_path, monkeypatch, broadcast):
    """Runs and steps of a few ids, so that groups, documents and pairs go over their edges; counts from a broadcast and by a join."""
    monkeypatch.setattr(align, "RUN", 500)
    monkeypatch.setattr(align, "STEP", 3000)
    monkeypatch.setattr(align, "FEW", 6)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k1", "pairs", "copies", "side", "n")}).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    if broadcast:
        got = registry.QUERIES["op12_token_alignment"](spark, str(tmp_path))
        assert got.columns == NAMES and sorted(map(tuple, got.collect()), key=str) == want
    else:
        got = align.aligned_scores(docs, align.AlignParams(broadcast=0, texts=True))
        assert sorted(map(tuple, got.select(NAMES).collect()), key=str) == want
        told = {r["doc_id"]: r for r in got.collect()}
        assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in told.values() if r["n_groups"])
        spelt = [r for r in told.values() if r["n_groups"]]
        assert len(spelt) > 60 and all(r["groups"].count(";") + 1 == r["n_groups"] for r in spelt)


def test_empty(spark):
    assert align.aligned_scores(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    got = align.aligned_scores(spark.createDataFrame([("a", None)], "doc_id string, text string")).first()
    assert tuple(got) == ("a", 0, 0, 0, 0, 0, 0, "")


def test_fast_encoding_is_the_same():
    """Ids from ranks against the tokenizer's own library, for every character of the basic plane that is no surrogate, in and between words."""
    side = align.ByteSide(align._file("byte_bpe_50k.json"))
    assert side.fast is not None
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F700))
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    slow = [x.ids for x in side.whole.encode_batch(texts, add_special_tokens=False)]
    other = [k for k, (x, y) in enumerate(zip(side.encode(texts), slow, strict=True)) if x != y]
    assert not other, [hex(points[k * 64]) for k in other]
    runs = [" " * 100_000, "a" * 100_000, "\n \t" * 30_000, "!" * 100_000, " <|endoftext|> "]
    assert side.encode(runs) == [x.ids for x in side.whole.encode_batch(runs, add_special_tokens=False)]


def test_links_of_a_large_group():
    """A group whose links are counted by distinct ids gives those that are written out."""
    r = np.random.default_rng(1)
    ga, gb = np.repeat([0, 1, 2], [3, 200, 2]), np.repeat([0, 1, 2], [2, 150, 1])
    ia, ib = r.integers(0, 9, len(ga)), r.integers(0, 7, len(gb))
    group, pair, times = align.linked(ga, ia, gb, ib, 3, 100)
    got = Counter()
    for g, p, n in zip(group, pair, times, strict=True):
        got[int(g), int(p)] += int(n)
    assert got == Counter((int(g), int(x * 100 + y)) for g, x in zip(ga, ia, strict=True) for h, y in zip(gb, ib, strict=True) if g == h)
