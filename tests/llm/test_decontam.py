"""Contaminated words against every window at every place, in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.llm import registry
from quillstream.llm.decontam import DecontamParams, contaminated, row_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LETTERS))


def brute(docs, items, size=10):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                own = windows.get(tuple(w[j : j + n]))
                if own:
                    hit |= set(range(j, j + n))
                    found |= own - {None}
        names = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables():
    r = random.Random(5)
    lexicon = ["ab", "Ab", "c1", "é", "東京", "x_y", "the", "a-b"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(lexicon) for _ in range(n))
    items = [(i, text(r.randint(10, 30))) for i in range(40)] + [(40, "two words"), (41, "alone"), (42, ""), (43, None), (44, "!! ?"), (45, "the " * 25), (3, text(12)), (46, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (None, "unnamed item here")]
    docs = [(i, text(r.randint(0, 80))) for i in range(150)]
    for i in range(0, 150, 3):  # leaks, whole, in part, at either end, and across other marks
        own = (items[r.randrange(48)][1] or "").split(" ")
        a = r.randrange(max(1, len(own) - 9))
        docs[i] = (i, r.choice(["", "begin "]) + r.choice([" ", "\n--"]).join(own[a : a + r.randint(9, 14)]).upper() + r.choice(["", " end", ". End"]))
    docs += [(200, None), (201, ""), (202, "Alone"), (203, "the " * 3000), (204, "TWO\tWORDS two, words"), (None, "two words"), (None, "two words"), (205, "Unnamed ITEM here!"), (206, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w1 w2")]
    return docs + [docs[3]] * 4, items


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_against_brute_force(spark, broadcast, tmp_path):
    docs, items = tables()
    for name, rows in (("documents", docs), ("benchmark", items)):
        frame = spark.createDataFrame(rows, f"{'doc_id' if name == 'documents' else 'item_id'} long, text string")
        frame.withColumns({c: F.lit(1) for c in ("k1", "token", "place", "near", "window", "start", "length")}).write.parquet(f"{tmp_path}/{name}.parquet")
    if broadcast:
        got = registry.QUERIES["op13_decontamination"](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items)
    found = contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), DecontamParams(broadcast=broadcast, salts=3))
    hits = {(r["doc_id"], r["n_words"], len({p for s in r["spans"] for p in range(s["start"], s["start"] + s["length"])}), len(r["item_ids"])) for r in found.collect()}
    assert hits == {x[:4] for x in brute(docs, items)}


def test_other_windows(spark):
    """Five words of a window and two of a shingle, and an item id that is text."""
    docs, items = tables()
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(None if i is None else f"{i}", t) for i, t in items], "item_id string, text string"), DecontamParams(words=5, shingle=2))
    got = {(r["doc_id"], r["n_words"], len({p for s in r["spans"] for p in range(s["start"], s["start"] + s["length"])}), len(r["item_ids"])) for r in found.collect()}
    assert got == {x[:4] for x in brute(docs, items, 5)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(none, items).count() == 0
    row = contaminated(none.unionByName(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")), items.limit(0)).first()
    assert (row["doc_id"], row["n_words"], row["spans"], row["item_ids"]) == (1, 3, [], [])


def test_long_row_in_pieces():
    import numpy as np

    from quillstream.llm import decontam

    text = " ".join(f"word{i}" for i in range(40_000)).encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = next(iter(row_words(raw, off)))
    small, decontam.MOST = decontam.MOST, 1 << 14
    try:
        parts = next(iter(row_words(raw, off)))
    finally:
        decontam.MOST = small
    assert np.array_equal(whole[2], parts[2]) and len(parts[2]) == 40_000
