"""Each opN query over a small folder of its own: what its contract fixes, against plain Python."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quillstream.llm import avi, licenses, registry
from quillstream.llm.components import local_components

Q = registry.QUERIES
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = {"en": ["the", "ing", "and", "er", "wh", "th"], "de": ["sch", "ein", "ung", "der", "ich", "keit"], "fr": ["eau", "que", "oui", "ai", "eux", "ment"]}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    """Three languages, clean and poor, clean and toxic, licences, copies, and rows that are odd."""
    r = random.Random(21)
    rows = []
    for i in range(400):
        lang = ("en", "de", "fr")[i % 3]
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 90))]
        if i % 10 == 0:
            words = [f"{w}###||" for w in words[:4]] * 12
        if i % 7 == 0:
            words.insert(r.randrange(len(words)), "zogmuk vraxil")
            words.insert(r.randrange(len(words)), "kwildorp")
        if i % 9 == 0:
            words.insert(r.randrange(len(words)), r.choice(["Under the MIT license.", "Apache License, Version 2.0", "CC-BY NC"]))
        text = " ".join(words)
        if i % 20 == 19:
            text = rows[-5][1]
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    odd = [(1000, None, "en", None, 0), (1001, "", None, "s0", 0), (1002, " \n\t ", "en", "s1", 4), (1003, "...", "fr", "s9", 3), (None, "the and the and", "en", "s0", 9), (1004, "the " * 60000, "en", "s2", 240000), (1005, "ÉCOLE Straße 東京", "fr", "s3", 9), (1006, "A b\x0bc", "en", "s0", 5)]
    return rows + odd + [(1007, "twice the same row", "en", "s1", 18)] * 2


def labels(rows):
    return [(i, int(i % 10 != 0), int(i % 7 == 0)) for i, *_ in rows if i is not None and i < 400] + [(None, 1, 1), (3, None, None)]


def written(spark, folder, rows, marks):
    spark.createDataFrame(rows, DOCUMENTS).withColumnRenamed("n_chars", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t, *_ in rows[:50:7]], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i // 5, i % 5, "user", t) for i, t, *_ in rows[:60] if i is not None], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    written(spark, path, rows, labels(rows))
    r = np.random.default_rng(1)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(60, 8)))] + [(60, None)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    written(spark, path, [], [])
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


def all_ids():
    return sorted((i is None, i or 0) for i, *_ in documents())


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


def test_no_labels(spark, tmp_path):
    written(spark, str(tmp_path), documents()[:40], [])
    assert {r["predicted"] for r in Q["op1_toxicity"](spark, str(tmp_path)).collect()} == {0}
    assert {r["predicted"] for r in Q["op8_quality"](spark, str(tmp_path)).collect()} == {1}


CLASSIFIERS = [("op1_toxicity", 3, 1, 0.7, 2), ("op8_quality", 5, 0, 0.3, 1)]


@pytest.mark.parametrize(("name", "n", "held", "least", "column"), CLASSIFIERS)
def test_classifiers(spark, folder, tmp_path, name, n, held, least, column):
    """Folds, bounds, thresholds, held-out rows told apart, and labels of held-out rows that change nothing."""
    got = Q[name](spark, folder).collect()
    assert ids(got) == all_ids()
    assert all(r["held_out"] == (fold(r["doc_id"], n) == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in got)
    rows = documents()
    mark = {m[0]: m[column] for m in labels(rows) if m[column] is not None}
    own = [r for r in got if r["held_out"] and r["doc_id"] in mark]
    wrong = [r for r in own if r["predicted"] != mark[r["doc_id"]]]
    rare = [r for r in own if mark[r["doc_id"]] == (column == 2)]
    assert len(own) > 50 and len(rare) > 5 and len(wrong) <= 0.1 * len(own)
    assert len([r for r in rare if r["predicted"] == mark[r["doc_id"]]]) >= 0.8 * len(rare)
    turned = [tuple(1 - v if v is not None and k == column and m[0] is not None and fold(m[0], n) == held else v for k, v in enumerate(m)) for m in labels(rows)]
    written(spark, str(tmp_path), rows, turned)
    again = {r["doc_id"]: r["score"] for r in Q[name](spark, str(tmp_path)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_language(spark, folder, tmp_path):
    got = Q["op9_language"](spark, folder).collect()
    rows = documents()
    assert ids(got) == all_ids() and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    lang = {i: x for i, _, x, *_ in rows if i is not None and i < 400 and i % 10 and i % 20 != 19}
    own = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert len(own) > 50 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in own]) >= 0.95
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [pred[i] for i in (1000, 1001, 1002, 1003)] == ["und"] * 4 and pred[1005] in ("en", "de", "fr")
    written(spark, str(tmp_path), [(i, t, "xx" if fold(i, 4) == 2 else x, s, n) for i, t, x, s, n in rows], [])
    assert {r["doc_id"]: r["lang_pred"] for r in Q["op9_language"](spark, str(tmp_path)).collect()} == pred


def test_lm(spark, folder):
    got = Q["op3_lm_score"](spark, folder).collect()
    assert ids(got) == all_ids()
    rows = [(i, WORD.findall((t or "").translate(LETTERS))) for i, t, *_ in documents()]
    count = Counter()
    for i, w in rows:
        if i is not None and fold(i, 10):
            count.update(w)
            count["\n"] += 1
    n, v = sum(count.values()), len(count)
    p = lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((i if i is not None else -1, len(w) + 1, sum(x in count for x in [*w, "\n"]), round(sum(map(p, [*w, "\n"])), 4)) for i, w in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    # an id that is missing is no row to learn from; its text's hash is that of the empty text, so it counts as held out
    assert all(r["held_out"] == (fold(r["doc_id"], 10) == 0) and r["train_tokens"] == n and r["score"] <= 0 for r in got)


def test_lengths(spark, folder):
    got = Q["op4_length_buckets"](spark, folder).collect()
    size = Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in documents())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == size
    assert len({(r["batch_id"], r["slot"]) for r in got}) == len(got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, Q["op4_length_buckets"](spark, folder).collect()), key=str)


def test_licences(spark, folder):
    got = {(r["doc_id"], k): r for k, r in enumerate(Q["op5_license_scan"](spark, folder).collect())}
    assert ids(got.values()) == all_ids()
    text = {i: t for i, t, *_ in documents()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for (i, _), r in got.items():
        w = word.findall((text[i] or "").translate(LETTERS))
        places = sorted((k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        base = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        own = r["labels"].split(",") if r["labels"] else []
        assert own == sorted(set(own)) and set(base) <= set(own) and 0 <= r["score"] <= 1
    assert sum(r["n_base"] > 0 for r in got.values()) > 20


def test_media(spark, folder):
    got = Q["op6_avi_clips"](spark, folder).collect()
    assert ids(got) == all_ids()
    text = {i: t for i, t, *_ in documents()}
    seen = {}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    media = avi.encode_payload(avi.padded(text[7].encode()))
    own = next(r for r in got if r["doc_id"] == 7)
    assert (own["media_bytes"], own["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and avi.read_payload(media)[0].rstrip(b"\0") == text[7].encode()


def test_near_duplicates(spark, folder):
    got = Q["op7_ngram_jaccard"](spark, folder).collect()
    assert ids(got) == all_ids()
    sets = {}
    for i, t, *_ in documents():
        w = WORD.findall((t or "").translate(LETTERS))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    own = [i for i in sets if i is not None]
    links = [(a, b) for a in own for b in own if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    node, root = local_components(*(np.array(x) for x in zip(*links, strict=True)))
    component = {i: i for i in sets} | dict(zip(node.tolist(), root.tolist(), strict=True))
    assert len(links) > 20 and all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), component[r["doc_id"]]) for r in got)


def test_mix(spark, folder):
    got = Q["op10_mixing"](spark, folder).collect()
    assert ids(got) == all_ids()
    rows = documents()
    of = {i: s for i, _, _, s, _ in rows}
    size, taken = Counter(), Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    target = {}
    for r in got:
        s = of[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[s] and target.setdefault(s, r["target"]) == r["target"]
        taken[s] += r["taken"]
    left, open_ = 1.5 * sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(open_)}
    want = {}
    while open_:
        full = [s for s in open_ if 2 * size[s] <= left * weight[s] / sum(weight[x] for x in open_)] or None
        want |= {s: 2.0 * size[s] for s in full} if full else {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left -= sum(2 * size[s] for s in full or ())
        open_ = [s for s in open_ if full and s not in full]
    assert {s: pytest.approx(v) for s, v in want.items()} == target
    for s in want:
        lone = [r["size"] for r in got if of[r["doc_id"]] == s and r["size"] > 30000]
        assert abs(taken[s] - want[s]) <= (max(lone) / 2 if lone else 60), s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, Q["op10_mixing"](spark, folder).collect()), key=str)


def test_embeddings(spark, folder):
    got = Q["op2_embedding_dedup"](spark, folder).collect()
    assert len(got) == 61 and all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got)


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def alien(rows):
    import importlib.util
    yield from [importlib.util.find_spec("quillstream") is None]
assert all(spark.sparkContext.parallelize([0], 1).mapPartitions(alien).collect()), "the workers can import the library"
for name in ("op1_toxicity", "op8_quality", "op9_language", "op7_ngram_jaccard", "op2_embedding_dedup", "op12_token_alignment", "op13_decontamination"):
    print(name, entry.queries()[name](spark, {folder!r}).count())
"""


def test_workers_without_the_library(folder, tmp_path):
    """Models and functions travel by value: executors that cannot import the library run the queries."""
    repo = str(Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # which the workers would inherit
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(repo=repo, folder=folder)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 14


def test_pipeline_edges(spark, folder, empty, tmp_path):
    """Columns of clashing names pass every stage but the last, each text of an id stays unless another one links with it, and an empty
    table passes."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert corpus_pipeline.run(spark, empty).count() == 0
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(7) for c in ("quality_score", "toxicity_score", "nth", "row", "copies", "label", "_h", "size", "block", "mark", "node", "k1", "text_")})
    other, near = "another text of the same id, long enough to have shingles of its own, and some more words behind", "another text of the same id, long enough to have shingles of its own, and some more words too"
    docs = docs.unionByName(docs.where("doc_id = 8").withColumn("text", F.lit(other))).unionByName(docs.where("doc_id = 9").withColumn("text", F.lit(near)))
    docs = docs.unionByName(docs.where("doc_id = 8")).unionByName(docs.where("doc_id = 1001"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.where("row = 7 and _h = 7").count() == out.count() > 0, name
    again = [sorted(corpus_pipeline.drop_near_duplicates(spark, d, folder).where("doc_id in (8, 9, 1001)").collect(), key=str) for d in (docs, docs.repartition(5))]
    assert again[0] == again[1]
    texts = [(r["doc_id"], r["text"]) for r in again[0]]
    # both texts of 8, and of 9 its own; of the two texts that link one stays; texts without words stay as often as they are
    assert [i for i, _ in texts].count(1001) == 2 and [t for _, t in texts].count(other) + [t for _, t in texts].count(near) == 1
    assert sum(i == 8 for i, _ in texts) + sum(i == 9 for i, _ in texts) == 3
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    # nulls and texts without words link with nothing and stay; copies go
    assert kept.columns == docs.columns and {1000, 1001, 1002} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id = 1007").count() == 1 and kept.count() < docs.count() - 15
    toxic = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    held = [i for i in range(400) if fold(i, 3) == 1 and i % 20 != 19]
    assert sum(i not in toxic for i in held if i % 7 == 0) >= 0.8 * sum(i % 7 == 0 for i in held) and sum(i in toxic for i in held if i % 7) >= 0.95 * sum(i % 7 > 0 for i in held)
    packed = corpus_pipeline.pack_batches(spark, docs, folder)
    assert packed.count() == docs.count() and packed.select("batch_id", "slot").distinct().count() == docs.count()
