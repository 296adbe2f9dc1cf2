"""Benchmark decontamination: which words of a document stand inside a window of a benchmark item, by a prefix-filtered join.

A window is ``words`` consecutive words of an item (all of a shorter one). As a set of shingles it is contained in a document's
window of its size only if its rarest shingle is, so that one is its necessary prefix: shingles are counted over all documents,
each window is indexed by its rarest, and only places of a document that hold such a shingle are joined with windows. A place tells
where the window would have to begin (positional bound), which must lie within the document (length bound), and the hash of all
words from there must be the window's.

Only hashes of words travel. Documents pass a bitmap of the shingles asked for (32 MB at most, whatever the benchmark's size), so of most
of them nothing but a count of words is left; false friends of the bitmap find no partner in the join. Windows are
broadcast while they are few, else dealt with a salt, so a passage that a third of all documents hold is dealt out.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. Null texts have none; an empty benchmark hits nothing; rows
that repeat get a row each, and repeated items count once; items without id mark words but are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import IS_MARK, give_back, mix64, runs, sent, table, text_bytes, word_hashes, written

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at a time.
MOST = 2 << 20


@dataclass(frozen=True)
class DecontamParams:
    words: int = 10  # words of a window
    shingle: int = 3  # words of a shingle
    broadcast: int = 200_000  # windows that may be broadcast
    salts: int = 16  # parts of a window's places where they are not
    bits: int = 28  # log2 of a bitmap's bits, at most


def row_words(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, the one behind the last, hashes of words, their rows counted from the first). Runs of rows; a very long one is hashed in pieces."""
    for a, b in runs(off, MOST):
        own, base = raw[off[a] : off[b]], off[a]
        if len(own) <= 2 * MOST:
            h, doc = word_hashes(own, off[a : b + 1] - base, IS_MARK)
        else:  # one row, cut between words
            cuts = [0]
            while cuts[-1] < len(own):
                end = min(cuts[-1] + MOST, len(own))
                while end < len(own) and not IS_MARK[own[end]]:
                    end += 1
                cuts.append(end)
            h = np.concatenate([word_hashes(own[x:y], np.array([0, y - x]), IS_MARK)[0] for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
            doc = np.zeros(len(h), np.int64)
        yield a, b, h, doc


def gram_hashes(h: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the n words from each place on, or from the places ``at`` only."""
    if at is None:
        at = slice(0, max(0, len(h) - n + 1))
        part = lambda j: h[at.start + j : at.stop + j]
    else:
        part = lambda j: h[at + j]
    with np.errstate(over="ignore"):
        total = part(0) * _ODD + np.uint64(n)
        for j in range(1, n):
            total = mix64(total) * _ODD + part(j)
        return mix64(total)


def _windows(params: DecontamParams):
    """Items (item_id, text) to (item_id, length, window, tokens): the hash of each window and of its shingles."""

    def run(batches):
        for b in batches:
            names = b.column(0)
            for first, last, h, doc in row_words(*text_bytes(b.column(1))):
                edges = np.searchsorted(doc, np.arange(last - first + 1))
                out = []
                for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    size = min(int(y - x), params.words)
                    if size:
                        k = min(size, params.shingle)
                        whole, tokens = gram_hashes(h[x:y], size).view(np.int64), gram_hashes(h[x:y], k).view(np.int64)
                        seen = np.unique(whole, return_index=True)[1]
                        out += [(names[first + i].as_py(), size, int(whole[j]), tokens[j : j + size - k + 1].tolist()) for j in seen]
                cols = list(zip(*out, strict=True)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["item_id", "length", "window", "tokens"])

    return run


def _bitmap(tokens: DataFrame, n: int, most: int) -> np.ndarray:
    """A bitmap of a column token (32 bits and more a token, 2**most bits at most) as bytes."""
    bits = min(most, max(16, int(np.ceil(np.log2(32 * max(n, 1))))))
    at = F.col("token").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    found = tokens.groupBy(F.bitmap_bucket_number(at + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bitmap"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.toLocalIterator():  # a bounded number of rows of 4 kB
        part = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        out[(r["bucket"] - 1) * 4096 :][: len(part)] = part[: len(out) - (r["bucket"] - 1) * 4096]
    return out


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _places(h: np.ndarray, doc: np.ndarray, k: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of shingles of k words within one document that pass the bitmap."""
    s = gram_hashes(h, k)
    if not len(s):
        return np.zeros(0, np.int64), s
    at = np.flatnonzero(_passes(bitmap, s))
    at = at[doc[at] == doc[at + k - 1]]
    return at, s[at]


def _counter(load, sizes: list[int]):
    """Documents' texts to (token, n): how often the shingles asked for occur, summed as they come."""

    def run(batches):
        bitmap, held = load(), []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], ["token", "n"])
        for b in batches:
            for _, _, h, doc in row_words(*text_bytes(b.column(0))):
                for k in sizes:
                    held.append(np.unique(_places(h, doc, k, bitmap)[1].view(np.int64), return_counts=True))
                if len(held) >= 64:
                    held[:] = [_summed(held)]
                    if len(held[0][0]) > 1_000_000:
                        yield told()
                        held.clear()
            give_back()
        if held:
            yield told()

    return run


def _summed(held):
    key, place = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([x[1] for x in held]), len(key)).astype(np.int64)


PROBED = "doc_id {kind}, k1 long, k2 long, n_words long, asked boolean, length int, token long, place long, near array<long>"


def _prober(load, lengths: list[int], params: DecontamParams):
    """Documents (doc_id, k1, k2, text) to a head (doc_id, k1, k2, n_words, asked) each, and a row for each place that may be a window's rarest
    shingle: near[o] is the hash of the words of a window that begins o words ahead of it, null where none fits."""

    def rows(batch, which, n, **own):
        fill = lambda name, kind: own.get(name, pa.nulls(n, kind))
        return pa.RecordBatch.from_arrays(
            [fill("doc_id", batch.schema.field(0).type), batch.column(1).take(which), batch.column(2).take(which), fill("n_words", pa.int64()), fill("asked", pa.bool_()), fill("length", pa.int32()), fill("token", pa.int64()), fill("place", pa.int64()), fill("near", pa.list_(pa.int64()))],
            ["doc_id", "k1", "k2", "n_words", "asked", "length", "token", "place", "near"],
        )

    def run(batches):
        bitmap = load()
        for b in batches:
            raw, off = text_bytes(b.column(3))
            for first, last, h, doc in row_words(raw, off):
                edges = np.searchsorted(doc, np.arange(last - first + 1))
                asked = np.zeros(last - first, bool)
                for size in lengths:
                    k = min(size, params.shingle)
                    at, tokens = _places(h, doc, k, bitmap)
                    for x in range(0, len(at), 4096):
                        p, t = at[x : x + 4096], tokens[x : x + 4096]
                        start = p[:, None] - np.arange(size - k + 1)
                        own = doc[p]
                        fits = (start >= edges[own][:, None]) & (start + size <= edges[own + 1][:, None])
                        some = fits.any(axis=1)
                        near = np.zeros(start.shape, np.int64)
                        near[fits] = gram_hashes(h, size, start[fits]).view(np.int64)
                        p, t, near, fits, own = p[some], t[some], near[some], fits[some], own[some]
                        asked[own] = True
                        flat = pa.array(near.ravel(), mask=~fits.ravel())
                        ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * near.shape[1])
                        yield rows(b, pa.array(own + first), len(p), length=pa.array(np.full(len(p), size, np.int32)), token=pa.array(t.view(np.int64)), place=pa.array(p - edges[own]), near=pa.ListArray.from_arrays(ends, flat))
                which = pa.array(np.arange(first, last))
                yield rows(b, which, last - first, doc_id=b.column(0).take(which), n_words=pa.array(np.diff(edges)), asked=pa.array(asked))
            give_back()

    return run


def contaminated(docs: DataFrame, items: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """Documents (doc_id, text) against items (item_id, text): (doc_id, n_words, spans, item_ids), a row each.

    spans: array of (start, length), where windows occur, in order, in words from 0; item_ids: the items whose windows occur, sorted as
    strings."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = written(items.mapInArrow(_windows(params), "item_id string, length int, window long, tokens array<long>"))
    distinct = windows.groupBy("length", "window").agg(F.first("tokens").alias("tokens"))
    told = windows.agg(F.count(F.lit(1)), F.sum(F.size("tokens")), F.collect_set("length")).first()
    n, n_tokens, lengths = told[0], told[1] or 0, sorted(told[2])
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    asked = sent(spark, _bitmap(tokens, n_tokens, params.bits))
    counted = docs.select("text").mapInArrow(_counter(asked, sorted({min(x, params.shingle) for x in lengths})), "token long, n long")
    counts = counted.groupBy("token").agg(F.sum("n").alias("n")).join(tokens, "token", "left_semi")
    each = distinct.select("length", "window", F.posexplode("tokens").alias("ahead", "token")).join(counts, "token", "left")
    rarest = each.groupBy("length", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "ahead", "token")).alias("r"))
    rarest = written(rarest.select("length", "window", F.col("r.ahead").alias("ahead"), F.col("r.token").alias("token")))

    prefixes = sent(spark, _bitmap(rarest.select("token").distinct(), n, params.bits))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    probed = written(keyed.mapInArrow(_prober(prefixes, lengths, params), PROBED.format(kind=kind)))

    places = probed.where("token is not null").select("k1", "k2", "length", "token", "place", "near")
    if n <= params.broadcast:
        met = places.join(F.broadcast(rarest), ["length", "token"])
        named = F.broadcast(windows.select("length", "window", "item_id"))
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt")
        met = places.withColumn("salt", F.pmod("k2", F.lit(params.salts)).cast("int")).join(rarest.select("*", salts), ["length", "token", "salt"])
        named = windows.select("length", "window", "item_id")
    hits = met.where(F.get("near", F.col("ahead")) == F.col("window")).select("k1", "k2", (F.col("place") - F.col("ahead")).alias("start"), "length", "window").distinct()
    hits = written(hits)
    spans = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    found = hits.select("k1", "k2", "length", "window").distinct().join(named, ["length", "window"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    heads = probed.where("n_words is not null").select("doc_id", "k1", "k2", "n_words", "asked")
    both = heads.where("asked").join(spans.join(found, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    none = heads.where("not asked").withColumns({"spans": F.lit(None).cast("array<struct<start:bigint,length:int>>"), "item_ids": F.lit(None).cast("array<string>")})
    out = both.select("doc_id", "n_words", "spans", "item_ids").unionByName(none.select("doc_id", "n_words", "spans", "item_ids"))
    return out.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:int>>")), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})


def covered(spans: Column) -> Column:
    """How many words spans, sorted by start, cover."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        stop = x["start"] + x["length"]
        more = F.greatest(stop - F.greatest(acc["end"], x["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], stop).cast("long").alias("end"), (acc["n"] + more).cast("long").alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of all ``documents`` against all of ``benchmark``."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
