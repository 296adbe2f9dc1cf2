"""Language-model scores of whole texts from a bigram model over the corpus, held in Elias-Fano tries.

The model is an absolutely discounted bigram that backs off to additively smoothed unigrams:

    seen pair        (c(v w) - D) / c(v)
    unseen pair      D * kinds(v) / c(v) * p1(w),   p1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    unseen context   p1(w)

(the back-off mass is not raised by what p1 gives to seen words, so sums stay below 1: scores never flatter a text).

Texts become word pairs, with a begin and an end. One pass packs each batch's distinct pairs, and which documents hold
them, into compressed messages to shards of the context space; nothing else of the corpus moves. A shard counts the pairs of the
training documents, builds its trie, and answers every pair of every document from it: sums for each document, and
the words of unseen pairs, whose p1 lies with the shard that has them as context and is joined after. Contexts that a
sample shows to be common are dealt over several shards by successor; their logarithms split into a local and a
total part, so the result does not depend on that choice beyond the rounding of the codes.

Edge cases: null and empty texts are a begin and an end; repeated rows count and score as rows of their own; a null
id is a document outside training; without training documents p1 is uniform (N = V = 0); an empty table gives an empty
result; only the id and the text are read.
"""

from __future__ import annotations

import mmap
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import doc_fold, give_back, input_bytes, runs, table, text_bytes, word_hashes, written
from quillstream.llm.trie import SLICE, W48, Trie

BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0x0FEDCBA987654321)
SMALL = 0.1  # of the unigram smoothing


@dataclass(frozen=True)
class LmParams:
    discount: float = 0.75
    #: Bytes of input a shard, and the least number of shards.
    shard: int = 9 << 20
    least_shards: int = 56
    #: Documents of the sample that shows common words, and the most such words.
    sample: int = 2000
    common: int = 4096
    #: Bytes of text, and pairs, of a message batch.
    block: int = 8 << 20
    pairs: int = 1 << 20


def pairs_of(raw: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, document) of each token: every word and one end, in order."""
    h, d = [], []
    for a, b in runs(offsets, block):
        x, y = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        h.append(x)
        d.append(y + a)
    n = len(offsets) - 1
    h = np.concatenate(h) if h else np.zeros(0, np.uint64)
    d = np.concatenate(d) if d else np.zeros(0, np.int64)
    count = np.bincount(d, minlength=n)
    context, word = np.empty(len(h) + n, np.uint64), np.empty(len(h) + n, np.uint64)
    at = np.arange(len(h)) + d
    context[at + 1], word[at] = h, h
    last = np.cumsum(count) + np.arange(n)
    context[last - count], word[last] = BEGIN, END
    return context, word, np.repeat(np.arange(n), count + 1)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, the lowest of all first: like bytes stand together for the compressor."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _message(context, word, owner, key, train) -> bytes:
    """Of pairs sorted by context, word and owner: contexts with their number of pairs, pairs with their number of
    tokens, the owner of each token, and the owners' keys."""
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
    first = np.flatnonzero(new)
    tokens = np.diff(np.append(first, len(word)))
    c = context[first]
    head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    names, place, often = np.unique(word[first], return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own, at = np.unique(owner, return_inverse=True)
    body = (c[head].tobytes(), _planes(np.diff(np.append(head, len(c)))), names[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), _planes(rank[place]), _planes(tokens), _planes(at), key[own].tobytes(), train[own].tobytes())
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(body, 5))


def _read_message(raw: bytes):
    """(context, word, tokens) of each pair, and (owner place) of each token, keys and train flags of the owners."""
    c, pairs, names, place, tokens, at, key, train = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))  # noqa: S301  written by _message
    six = np.frombuffer(names, np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, :6] = six
    word = eight.view("<u8").ravel().astype(np.uint64)[_unplanes(place)]
    context = np.repeat(np.frombuffer(c, np.uint64), _unplanes(pairs))
    return context, word, _unplanes(tokens), _unplanes(at), np.frombuffer(key, np.int64), np.frombuffer(train, bool)


def _sender(shards: int, common: np.ndarray, parts: np.ndarray, params: LmParams):
    def messages(context, word, owner, key, train):
        # one sort of 64-bit words: places of the context and the word among those of the batch, and the owner
        word = word & W48
        seen, place = np.unique(np.concatenate([context, word]), return_inverse=True)
        low = owner[0]
        bits = max(1, int(owner[-1] - low).bit_length())
        wide = max(1, len(seen).bit_length())
        if 2 * wide + bits > 64:
            order = np.lexsort((owner, word, context))
            c, w, o = context[order], word[order], owner[order]
        else:
            packed = place[: len(context)].astype(np.uint64) << np.uint64(wide + bits)
            packed |= place[len(context) :].astype(np.uint64) << np.uint64(bits)
            packed |= (owner - low).astype(np.uint64)
            del place
            packed.sort()
            c = seen[(packed >> np.uint64(wide + bits)).astype(np.int64)]
            w = seen[(packed >> np.uint64(bits) & np.uint64((1 << wide) - 1)).astype(np.int64)]
            o = (packed & np.uint64((1 << bits) - 1)).astype(np.int64) + low
        shard = c % np.uint64(shards)
        at = np.minimum(np.searchsorted(common, c), len(common) - 1)
        hot = common[at] == c
        shard[hot] = (shard[hot] + w[hot] % parts[at[hot]]) % np.uint64(shards)
        shard = shard.astype(np.int32)
        order = np.argsort(shard, kind="stable")
        for p in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            yield int(shard[p[0]]), _message(c[p], w[p], o[p], key, train)

    def run(batches):
        for b in batches:
            key, train = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            raw, off = text_bytes(b.column(2))
            for first, behind in runs(off, params.block):
                context, word, owner = pairs_of(raw[off[first] : off[behind]], off[first : behind + 1] - off[first])
                for i in range(0, len(context), params.pairs):
                    s = slice(i, i + params.pairs)
                    out = list(messages(context[s], word[s], owner[s] + first, key, train))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["shard", "message"])
            give_back()

    return run


def _numbered(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them, in 32 bits."""
    x = np.concatenate(parts)
    parts.clear()
    distinct = np.unique(x)
    out = np.empty(len(x), np.uint32)
    for i in range(0, len(x), 1 << 20):
        out[i : i + (1 << 20)] = np.searchsorted(distinct, x[i : i + (1 << 20)])
    return distinct, out


_ANSWER = "kind int, key long, word long, n long, m long, score double, base double"


def _answer(kind: int, rows: int, **columns) -> dict:
    full = {"kind": np.full(rows, kind, np.int32)}
    for name in ("key", "word", "n", "m"):
        full[name] = np.asarray(columns.get(name, np.zeros(rows, np.int64))).astype(np.int64, copy=False)
    for name in ("score", "base"):
        full[name] = np.asarray(columns.get(name, np.zeros(rows)), np.float64)
    return full


def mapped(raw: bytes) -> mmap.mmap:
    """The buffer as a memory map."""
    m = mmap.mmap(-1, max(1, len(raw)))
    m.write(raw)
    return m


def _shard(common: np.ndarray, params: LmParams):
    """Kinds of rows: 1 sums of a document (n tokens, m known, base, score), 2 tokens of a document to back off to a word
    (n), 3 a training word's count (n) and kinds (m), 4 tokens of a document behind a common context (word; n, m seen)."""

    def run(t: pa.Table) -> pa.Table:
        got = [_read_message(x) for x in t["message"].to_pylist()]
        keys, place = np.unique(np.concatenate([g[4] for g in got]), return_inverse=True)
        train = np.concatenate([g[5] for g in got])
        shift = np.cumsum([0] + [len(g[4]) for g in got])[:-1]
        owner = np.concatenate([g[3] + np.uint32(s) for g, s in zip(got, shift, strict=True)])  # of each token
        tokens = np.concatenate([g[2] for g in got])
        context, c_at = _numbered([g[0] for g in got])
        word, w_at = _numbered([g[1] for g in got])
        del got
        pair, p_at = _numbered([c_at.astype(np.uint64) * np.uint64(len(word)) + w_at])
        del c_at, w_at
        p_at = np.repeat(p_at, tokens)  # from here on for each token
        del tokens
        count = np.bincount(p_at[train[owner]], minlength=len(pair))
        owner = place.astype(np.uint32)[owner]
        c, w = (pair // np.uint64(len(word))).astype(np.int64), (pair % np.uint64(len(word))).astype(np.int64)
        del pair
        known = count > 0
        give_back()
        trie = Trie.open(mapped(Trie.build(context[c[known]], word[w[known]], count[known], params.discount).dump()))

        at = trie.context(context)
        total, kinds, weight = trie.count(at), trie.kinds(at), trie.backoff(at)
        logp = np.empty(len(c))
        for i in range(0, len(c), SLICE):
            s = slice(i, i + SLICE)
            logp[s] = trie.successor(at[c[s]], word[w[s]])
        hit = ~np.isnan(logp)
        often = np.isin(context, common)
        # a common context is only in part here: its own total is taken out again, and the sum over all shards comes later
        value = np.where(hit, logp + np.where(often & (total > 0), np.log10(np.maximum(total, 1)), 0.0)[c], np.where(often, 0.0, weight)[c])
        begin = context == BEGIN
        counted = ~often & ~begin
        score = np.bincount(owner, value[p_at], minlength=len(keys))
        here = counted[c][p_at]
        logs = np.where(counted, np.log10(total + SMALL), 0.0)
        rows = [
            _answer(1, len(keys), key=keys, n=np.bincount(owner[here], minlength=len(keys)), m=np.bincount(owner[here & (total > 0)[c][p_at]], minlength=len(keys)), score=score, base=np.bincount(owner, logs[c][p_at], minlength=len(keys)))
        ]
        # unseen pairs: the owners' words to back off to
        miss = np.flatnonzero(~hit[p_at])
        ask, n = np.unique(owner[miss].astype(np.uint64) * np.uint64(len(word)) + w[p_at[miss]].astype(np.uint64), return_counts=True)
        rows.append(_answer(2, len(ask), key=keys[(ask // np.uint64(len(word))).astype(np.int64)], word=word[(ask % np.uint64(len(word))).astype(np.int64)].view(np.int64), n=n))
        has = np.flatnonzero(total > 0)
        rows.append(_answer(3, len(has), word=context[has].view(np.int64), n=total[has], m=kinds[has]))
        both = np.flatnonzero(often[c][p_at])
        ask, place = np.unique(owner[both].astype(np.uint64) * np.uint64(len(context)) + c[p_at[both]].astype(np.uint64), return_inverse=True)
        n, m = np.bincount(place, minlength=len(ask)), np.bincount(place[hit[p_at[both]]], minlength=len(ask))
        rows.append(_answer(4, len(ask), key=keys[(ask // np.uint64(len(context))).astype(np.int64)], word=context[(ask % np.uint64(len(context))).astype(np.int64)].view(np.int64), n=n, m=m))
        out = pa.table({k: np.concatenate([r[k] for r in rows]) for k in rows[0]})
        del rows, trie, context, word, c, w, p_at, owner, value, logp
        give_back()
        return out

    return run


def _each(solve):
    """solve() over the whole of a partition."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield from solve(pa.Table.from_batches(parts)).to_batches(max_chunksize=1 << 16)

    return run


def common_words(docs: DataFrame, shards: int, params: LmParams) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that would fill half a shard or more by a sample, sorted, and over how many shards each is dealt."""
    part = min(1.0, params.sample / max(docs.select("key").count(), 1))

    def run(batches):
        for b in batches:
            h, n = np.unique(pairs_of(*text_bytes(b.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    some = docs.where(F.pmod("key", F.lit(1 << 20)) < int(part * (1 << 20))).select("text").mapInArrow(run, "h long, n long")
    some = some.groupBy("h").agg(F.sum("n").alias("n"))
    total = some.agg(F.sum("n")).first()[0] or 1
    often = some.where(F.col("n") >= total / (2 * shards)).orderBy(F.desc("n"), "h").limit(params.common).collect()
    names = np.array([BEGIN.astype(np.int64), *(r.h for r in often)], np.int64).view(np.uint64)
    parts = np.array([shards, *(min(shards, max(2, -(-4 * shards * r.n // total))) for r in often)], np.uint64)
    names, first = np.unique(names, return_index=True)
    return names, parts[first]


def lm_scores(docs: DataFrame, train: Column, params: LmParams = LmParams()) -> DataFrame:
    """docs (doc_id, text); train: which rows the model learns from. Returns (doc_id, n_tokens, n_known, train_tokens,
    base_score, score), a row for each row."""
    docs = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("key"))
    shards = max(params.least_shards, input_bytes(docs) // params.shard)
    common, parts = common_words(docs, shards, params)
    sent = docs.select("key", "train", "text").mapInArrow(_sender(shards, common, parts, params), "shard int, message binary")
    # each shard is a partition of its own, however many there are
    answers = written(sent.repartitionById(int(shards), F.col("shard")).mapInArrow(_each(_shard(common, params)), _ANSWER))
    ids = written(docs.select("doc_id", "key", "train"))
    ends = ids.where("train").count()
    often = F.col("word").isin([int(x) for x in common.view(np.int64)])
    begin, end = int(BEGIN.astype(np.int64)), int(END.astype(np.int64))
    counts = answers.where("kind = 3")
    spread = counts.where(often).groupBy("word").agg(F.sum("n").alias("c"), F.sum("m").alias("kinds"))  # at most `common` words
    words = counts.where(~often).select("word", F.col("n").alias("c")).unionByName(spread.where(F.col("word") != begin).select("word", "c"))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = sums[0] + ends, sums[1] + (ends > 0)
    floor = F.log10(F.lit(n_all + SMALL * (v_all + 1)))

    # what unseen pairs back off to; words that are common by the sample come by broadcast, so no key of the join is hot
    w48 = lambda c: c.bitwiseAND(F.lit(int(W48)))
    unigram = words.where(~often).groupBy(w48(F.col("word")).alias("w")).agg(F.sum("c").alias("c"))
    few = words.where(often).select(w48(F.col("word")).alias("w"), "c").unionByName(answers.sparkSession.createDataFrame([(end & int(W48), ends)], "w long, c long"))
    rare = F.col("word").isin([int(x) for x in (np.append(common, END) & W48).view(np.int64)])
    asked = answers.where("kind = 2").select("key", "word", F.col("n").alias("times"))
    weigh = lambda df: df.select("key", (F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + SMALL) - floor)).alias("score"), *[F.lit(0).cast(t).alias(x) for x, t in (("n", "long"), ("m", "long"), ("base", "double"))])
    far = weigh(asked.where(~rare).join(unigram, F.col("word") == F.col("w"), "left"))
    near = weigh(asked.where(rare).join(F.broadcast(few), F.col("word") == F.col("w"), "left"))
    # common contexts: their totals over all shards
    c, kinds = F.coalesce("c", F.lit(0)), F.coalesce("kinds", F.lit(0))
    whole = answers.where("kind = 4").withColumnsRenamed({"n": "times", "m": "hits"}).join(F.broadcast(spread), "word", "left")
    is_word = F.col("word") != begin
    behind = whole.select(
        "key",
        F.when(c > 0, F.col("times") * -F.log10(F.greatest(c, F.lit(1))) + (F.col("times") - F.col("hits")) * F.log10(F.greatest(kinds, F.lit(1)) * params.discount)).otherwise(0.0).alias("score"),
        F.when(is_word, F.col("times")).otherwise(0).alias("n"),
        F.when(is_word & (c > 0), F.col("times")).otherwise(0).alias("m"),
        F.when(is_word, F.col("times") * F.log10(c + SMALL)).otherwise(0.0).alias("base"),
    )
    own = answers.where("kind = 1").select("key", "score", "n", "m", "base")
    total = own.unionByName(far).unionByName(near).unionByName(behind).groupBy("key").agg(*[F.sum(x).alias(x) for x in ("score", "n", "m", "base")])
    rows = ids.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))  # equal rows share a key, and their sums
    each = total.join(rows, "key")
    per = lambda x: F.col(x) / F.col("rows")
    each = each.select(
        "key",
        (F.round(per("n")) + 1).cast("long").alias("n_tokens"),
        (F.round(per("m")) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (per("base") + F.log10(F.lit(ends + SMALL)) - (F.round(per("n")) + 1) * floor).alias("base_score"),
        per("score").alias("score"),
    )
    return ids.select("doc_id", "key").join(each, "key").drop("key")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scores(docs, F.col("doc_id").isNotNull() & (doc_fold(10) != 0))
    return scored.select("doc_id", (doc_fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
