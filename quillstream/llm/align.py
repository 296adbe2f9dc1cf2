"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, by a sweep over the ends of their tokens.

Each document is encoded by a byte-level tokenizer (A) and by a piece tokenizer (B). The ends of tokens are events (document, offset, side, id).
The events of both sides are dealt by document, sorted within partitions by offset, and streamed through one state machine: where
ends of both sides coincide, a group closes, and each A token of it is linked with each B token. The machine holds only the
tokens behind the last coincidence; documents follow one another on one axis, and the end of each is a coincidence.

Rows of events are runs: up to 65,536 ids of one side with the offset at which they begin, for the ends follow from the ids' lengths. So an
event costs about a byte to move, not a row. Linked id pairs of a document leave the machine as distinct pairs with how often they
occur, a row a document, written once; from that table the number of documents that hold each pair is counted, summed in tasks before it is
shuffled, and is looked up again: from a broadcast while there are few pairs, else by a join.

Null and empty texts, and those whose tokens don't spell the text, have no tokens. Rows that repeat (one id and text) are swept once and
counted and returned as often as they occur; batches drop repeats before the shuffle, so a row that a third of all rows repeat
does not meet in one task. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import give_back, runs, sent, table, text_bytes, written

#: Ids a row of events.
RUN = 1 << 16
#: Tokens that the machine takes at a time.
STEP = 1 << 20
#: Links of a group that are written out; of more, ids that repeat are counted first.
FEW = 1 << 12


def vocabulary(name: str) -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class AlignParams:
    a: str = "byte_bpe_50k.json"  # a path, or an installed file's name
    b: str = "piece_bpe_32k.model"
    broadcast: int = 4_000_000  # id pairs whose counts may be broadcast (52 MB)
    texts: bool = False  # the groups themselves as a column, too


def _file(name: str) -> bytes:
    with open(name if "/" in name else vocabulary(name), "rb") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """Encodes by a byte-level BPE. Where ids are the ranks of merges, tiktoken encodes by them some four times as fast; what it refuses,
    and any other vocabulary, the tokenizer's own library encodes."""

    def __init__(self, data: bytes):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_str(data.decode())
        self.whole.encode_special_tokens = True
        told, alphabet = json.loads(data), byte_alphabet()
        special = {t["id"] for t in told.get("added_tokens", [])}
        self.tokens = [b""] * (max([*told["model"]["vocab"].values(), *special]) + 1)
        for t, i in told["model"]["vocab"].items():
            if i not in special:
                self.tokens[i] = bytes(alphabet[c] for c in t)
        self.fast = self._ranked(told, special)

    def _ranked(self, told: dict, special: set[int]):
        pre, vocab = told.get("pre_tokenizer") or {}, told["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer") and not told["model"].get("ignore_merges")
        if not plain or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
            return None
        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {t: i for i, t in enumerate(self.tokens) if t and i not in special}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [x.ids for x in self.whole.encode_batch(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            try:
                out.append(self.fast.encode_ordinary(t))
            except BaseException as e:  # noqa: BLE001  its panics are no Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                out.append(self.whole.encode(t, add_special_tokens=False).ids)
        return out


class PieceSide:
    """Encodes by a sentencepiece model, which puts a space ahead itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokens = []
        for i in range(self.whole.get_piece_size()):
            piece = self.whole.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.whole.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.whole.encode(texts, num_threads=1)


class Sides:
    """The files of both tokenizers, read once by the driver (some megabytes); tasks load them."""

    def __init__(self, params: AlignParams):
        self.files = (_file(params.a), _file(params.b))

    def load(self) -> tuple[ByteSide, PieceSide]:
        return ByteSide(self.files[0]), PieceSide(self.files[1])

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in side.tokens], np.int64) for side in self.load())


EVENTS = "doc_id {kind}, k1 long, k2 long, side int, offset long, copies long, ids binary"


def _encoder(load: Callable):
    """Documents (doc_id, k1, k2, text) to runs of events; side -1 is a document without tokens."""
    names = [f.split()[0] for f in EVENTS.split(", ")]

    def run(batches):
        a, b = load().load()
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            raw, off = text_bytes(batch.column(3))
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            first: dict[tuple, int] = {}
            copies = np.zeros(len(keys), np.int64)
            for i, k in enumerate(keys):
                copies[first.setdefault(k, i)] += 1
            for x, y in runs(off, 4 << 20):
                which = [i for i in range(x, y) if copies[i]]
                spelt = [b" " + raw[off[i] : off[i + 1]].tobytes() for i in which]
                texts = [s.decode(errors="replace") for s in spelt]
                both = zip(a.encode(texts), b.encode([t[1:] for t in texts]), strict=True)
                row, side, offset, blobs = [], [], [], []
                for i, s, ids in zip(which, spelt, both, strict=True):
                    if len(s) == 1 or any(b"".join(map(t.__getitem__, own)) != s for own, t in zip(ids, (a.tokens, b.tokens), strict=True)):
                        row.append(i), side.append(-1), offset.append(0), blobs.append(b"")
                        continue
                    for k, (own, t) in enumerate(zip(ids, (a.tokens, b.tokens), strict=True)):
                        at = 0
                        for z in range(0, len(own), RUN):
                            part = own[z : z + RUN]
                            row.append(i), side.append(k), offset.append(at), blobs.append(pack(np.array(part, np.uint16 if len(t) <= 1 << 16 else np.uint32).tobytes()))
                            at += sum(len(t[j]) for j in part) if len(own) > RUN else 0
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(side, pa.int32()), pa.array(offset, pa.int64()), pa.array(copies[np.array(row, np.int64)]), pa.array(blobs, pa.binary())], names)
            give_back()

    return run


def swept(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of rising ends of both sides: each token's group, and how many groups have closed; tokens behind are of later groups."""

    def groups(own, other):
        at = np.searchsorted(other, own)
        closes = np.zeros(len(own), bool)
        inside = at < len(other)
        closes[inside] = other[at[inside]] == own[inside]
        return np.cumsum(closes) - closes, int(closes.sum())

    (ga, n), (gb, _) = groups(ea, eb), groups(eb, ea)
    return ga, gb, n


def linked(ga: np.ndarray, ia: np.ndarray, gb: np.ndarray, ib: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, times) of the links of n groups, whose tokens are in order of groups. A pair is a's id * width + b's."""
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    first_b = np.cumsum(nb) - nb
    small = na * nb <= FEW
    own = small[ga]
    each = nb[ga[own]]
    at = np.repeat(first_b[ga[own]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    group, pair = np.repeat(ga[own], each), np.repeat(ia[own].astype(np.int64) * width, each) + ib[at]
    times = np.ones(len(pair), np.int64)
    if small.all():
        return group, pair, times
    parts = [(group, pair, times)]
    first_a = np.cumsum(na) - na
    for g in np.flatnonzero(~small):
        a, ca = np.unique(ia[first_a[g] : first_a[g] + na[g]], return_counts=True)
        b, cb = np.unique(ib[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        pairs = (a.astype(np.int64)[:, None] * width + b[None, :]).ravel()
        parts.append((np.full(len(pairs), g), pairs, (ca[:, None] * cb[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Machine:
    """The sweep's state: the tokens behind the last coincidence, and of the document at hand its counts, hash and pairs."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], texts: bool):
        self.lengths, self.texts, self.width = lengths, texts, len(lengths[1])
        self.held = [[np.zeros(0, np.int64)] * 3 for _ in range(2)]  # end on the axis, id, number of the document
        self.docs: list[dict] = []  # documents that are not told yet
        self.base, self.waiting = 0, [[], []]
        n = max(len(x) for x in lengths)
        digits = np.zeros((n, len(str(n))), np.uint8)
        for i, t in enumerate(map(str, range(n))):
            digits[i, : len(t)] = np.frombuffer(t.encode(), np.uint8)
        self.digits = digits
        self.count = 0

    def begin(self, key, doc_id) -> dict:
        self.docs.append({"key": key, "doc_id": doc_id, "copies": 0, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": None, "pairs": [], "told": [], "seen": set(), "ends": [self.base, self.base]})
        return self.docs[-1]

    def feed(self, doc: dict, side: int, ids: np.ndarray) -> None:
        ends = doc["ends"][side] + np.cumsum(self.lengths[side][ids])
        doc["ends"][side] = int(ends[-1])
        doc["n_a" if side == 0 else "n_b"] += len(ids)
        self.waiting[side].append((ends, ids.astype(np.int64), np.full(len(ids), len(self.docs) - 1)))
        self.count += len(ids)
        self.base = max(doc["ends"])

    def sweep(self) -> None:
        """Closes what groups the tokens so far close."""
        (ea, ia, da), (eb, ib, db) = ([np.concatenate([h, *(w[i] for w in wait)]) for i, h in enumerate(held)] for held, wait in zip(self.held, self.waiting, strict=True))
        self.waiting, self.count = [[], []], 0
        ga, gb, n = swept(ea, eb)
        ca, cb = int(np.searchsorted(ga, n)), int(np.searchsorted(gb, n))
        self.held = [[x[ca:] for x in (ea, ia, da)], [x[cb:] for x in (eb, ib, db)]]
        if not n:
            return
        ga, ia, gb, ib, da = ga[:ca], ia[:ca], gb[:cb], ib[:cb], da[:ca]
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        first_a = np.cumsum(na) - na
        doc = da[first_a]  # of each group
        # tokens in the order in which they are told: by group, A ahead of B
        place_a, place_b = np.arange(ca) + (np.cumsum(nb) - nb)[ga], np.arange(cb) + np.cumsum(na)[gb]
        line = np.zeros((ca + cb, 1 + self.digits.shape[1]), np.uint8)
        line[place_a, 1:], line[place_b, 1:] = self.digits[ia], self.digits[ib]
        line[:, 0] = ord(",")
        heads = place_a[first_a]
        line[heads, 0], line[place_b[np.cumsum(nb) - nb], 0] = ord(";"), ord("|")
        new = np.flatnonzero(np.diff(doc, prepend=-1))  # the first group of each document here
        for g in new:
            if not self.docs[doc[g]]["n_groups"]:
                line[heads[g], 0] = 0
        filled = line != 0
        told = line[filled].tobytes()
        stops = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
        group, pair, times = linked(ga, ia, gb, ib, n, self.width)
        span = int(self.width) * len(self.lengths[0])
        key, back = np.unique(doc[group] * span + pair, return_inverse=True)
        often = np.bincount(back, times, len(key)).astype(np.int64)
        owner = key // span
        links = na * nb
        for x, g in enumerate(new):
            d = self.docs[doc[g]]
            to = new[x + 1] if x + 1 < len(new) else n
            part = told[stops[heads[g]] : stops[heads[to] if to < n else ca + cb]]
            d["sha"] = d["sha"] or hashlib.sha256()
            d["sha"].update(part)
            if self.texts:
                d["told"].append(part)
            d["n_groups"] += int(to - g)
            d["n_links"] += int(links[g:to].sum())
            lo, hi = np.searchsorted(owner, [doc[g], doc[g] + 1])
            d["pairs"].append((key[lo:hi] - doc[g] * span, often[lo:hi]))
            if len(d["pairs"]) > 8:
                d["pairs"] = [self._merged(d["pairs"])]

    @staticmethod
    def _merged(parts):
        key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key, np.bincount(back, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)

    def finished(self) -> list[dict]:
        """The documents so far, all of which have ended, with their pairs in one piece."""
        self.sweep()
        done, self.docs = self.docs, []
        for d in done:
            parts = d["pairs"]
            d["pairs"] = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if not parts else parts[0] if len(parts) == 1 else self._merged(parts)
        return done


SWEPT = "doc_id {kind}, k1 long, k2 long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def _sweeper(sides: Callable, texts: bool):
    """Streams runs of events sorted by document and offset through a Machine; a row a document."""
    names = [f.split()[0] for f in SWEPT.split(", ")]

    def frame(done: list[dict], kind) -> pa.RecordBatch:
        sizes = np.cumsum([0, *(len(d["pairs"][0]) for d in done)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, t), *(d["pairs"][i] for d in done)]).astype(t))) for i, t in enumerate((np.int64, np.int32))]
        longs = [pa.array([d[c] for d in done], pa.int64()) for c in ("copies", "n_a", "n_b", "n_groups", "n_links")]
        return pa.RecordBatch.from_arrays(
            [pa.array([d["doc_id"] for d in done], kind), *(pa.array([d["key"][i] for d in done], pa.int64()) for i in range(2)), *longs, pa.array([d["sha"].hexdigest() if d["sha"] else "" for d in done], pa.string()), pa.array([b"".join(d["told"]).decode() if texts else None for d in done], pa.string()), *lists], names
        )

    def run(batches):
        lengths = sides()
        machine, doc, kind = Machine(lengths, texts), None, None
        unpack = zstandard.ZstdDecompressor().decompress
        types = [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in lengths]
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, k1, k2, side, offset, copies, blobs = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                key = (k1[i], k2[i])
                if doc is None or doc["key"] != key:
                    if machine.count >= STEP or len(machine.docs) >= 20_000:
                        done = machine.finished()
                        for x in range(0, len(done), 2000):
                            yield frame(done[x : x + 2000], kind)
                    doc = machine.begin(key, ids[i])
                if offset[i] == 0 and side[i] <= 0:
                    doc["copies"] += copies[i]
                if side[i] < 0 or (side[i], offset[i]) in doc["seen"]:
                    continue
                doc["seen"].add((side[i], offset[i]))
                machine.feed(doc, side[i], np.frombuffer(unpack(blobs[i]), types[side[i]]))
                if machine.count >= STEP and len(machine.docs) == 1:
                    machine.sweep()  # a long document's groups close as they come
        if doc is not None:
            done = machine.finished()
            for x in range(0, len(done), 2000):
                yield frame(done[x : x + 2000], kind)
        give_back()

    return run


def aligned(docs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """documents (doc_id, text) as SWEPT says, one row for each id and text with how often it occurs; written once."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    sides = Sides(params)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    events = keyed.mapInArrow(_encoder(sent(spark, sides)), EVENTS.format(kind=kind))
    ordered = events.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "offset", "side")
    return written(ordered.mapInArrow(_sweeper(sent(spark, sides.lengths()), params.texts), SWEPT.format(kind=kind)))


def _pair_counter(batches):
    """(pairs, copies) to (pair, n): documents that hold a pair, summed as they come."""
    held, size = [], 0
    told = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in Machine._merged(held)], ["pair", "n"])  # noqa: E731, SLF001
    for b in batches:
        pairs, copies = b.column(0), np.asarray(b.column(1))
        flat = np.asarray(pairs.flatten())
        held.append(Machine._merged([(flat, np.repeat(copies, np.diff(np.asarray(pairs.offsets))))]))  # noqa: SLF001
        size += len(held[-1][0])
        if size > 4_000_000:
            held, size = [Machine._merged(held)], 0  # noqa: SLF001
            size = len(held[0][0])
            if size > 2_000_000:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def pair_counts(swept_docs: DataFrame, width: int) -> DataFrame:
    """(pair, a, n, best): how many documents hold each linked id pair, and whether no pair of its A id is held by more. An A id has
    at most as many pairs as B has ids."""
    parts = swept_docs.where("n_links > 0").select("pairs", "copies").mapInArrow(_pair_counter, "pair long, n long")
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.call_function("div", F.col("pair"), F.lit(width).cast("long")))
    counts = written(counts)
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return written(counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(swept_docs: DataFrame, counts: DataFrame, broadcast: int) -> DataFrame:
    """swept_docs plus n_best and count_sum."""
    n = counts.count()
    if n <= broadcast:
        held = counts.select("pair", "n", "best").toArrow().sort_by("pair")
        load = sent(swept_docs.sparkSession, tuple(np.asarray(held[c].combine_chunks()) if c != "best" else np.asarray(held[c].to_numpy()) for c in ("pair", "n", "best")))
        place = swept_docs.columns.index("pairs")

        def run(batches):
            pair, often, best = load()
            for b in batches:
                lists, times = b.column(place), np.asarray(b.column(place + 1).flatten()).astype(np.int64)
                at = np.searchsorted(pair, np.asarray(lists.flatten()))
                edges = np.asarray(lists.offsets)
                edges = edges - edges[0]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * often[at])]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[edges[1:]] - x[edges[:-1]]) for x in sums)], [*b.schema.names, "n_best", "count_sum"])

        return swept_docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in swept_docs.schema) + ", n_best long, count_sum long")
    each = swept_docs.select("k1", "k2", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("k1", "k2", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = each.join(counts, "pair")
    sums = met.groupBy("k1", "k2").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return swept_docs.join(sums, ["k1", "k2"], "left").na.fill(0, ["n_best", "count_sum"])


def aligned_scores(docs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """The contract's columns, and ``groups`` if params.texts, a row for each row of docs."""
    done = aligned(docs, params)
    width = len(Sides(params).lengths()[1])
    out = scored(done, pair_counts(done, width), params.broadcast)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if params.texts else []))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by the two tokenizers of the contract."""
    return aligned_scores(table(spark, sf_dir, "documents"))
