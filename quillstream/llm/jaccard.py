"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

1. One pass over the documents makes, for each, its set of distinct word shingles (64-bit hashes), the size, a hash
   of the whole set, a bitmap signature, and the prefix of the set in a global order (rare shingles first, by counts over all documents).
   Sets that overlap enough share a shingle of their prefixes, so no link is lost.
2. Equal sets are one class with one representative. Prefix shingles go in packed arrays to shards of the shingle
   space; those of at least two classes become groups, and groups of equal members are one.
3. A group is cut into tiles by size band; a class also visits the next band, so that all sizes that may link meet. In a
   tile, two classes with differing bits d have at least d shingles that only one of them holds, which bounds the
   overlap from above. Pairs that pass join candidate clusters. A first round pairs rows that are near in size, each
   pair once over all groups; a second compares the rest, but skips what lies in one cluster already. Groups with the
   same smallest member, as the shingles of one passage have, meet in one tile for all of them.
4. Clusters fetch their texts, and within size bands sorted arrays are intersected exactly; a pair that
   is connected already is not intersected again. Links then give the components.

A tile, or a band of a cluster, of more than ``together`` rows is dealt in blocks over several tasks, a task for each pair of
blocks, so no task grows with a group; the rows it sends grow with the square of such a group, divided by ``together``.

Edge cases: a text with fewer words than a shingle is one shingle of the whole sequence; null, empty and wordless
texts have the empty set and link with nothing; equal texts always link; repeated ids, of one text or of several,
are one document for the components and keep their rows; a null id keeps its row and has no component; an empty table gives an empty
result; only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import dropped, give_back, input_bytes, mix64, runs, sent, shards_for, table, text_bytes, word_hashes, written
from quillstream.llm.components import components, local_components

#: Bits of a bitmap: the power of two from twice the set's size on, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 17


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    percent: int = 80
    #: Most cells (of a byte) of the table of counts that orders the prefixes.
    most_cells: int = 1 << 26
    #: Rows after each one that the first round compares with.
    reach: int = 4
    #: Rows of a tile, or of a band of a cluster, that are not dealt over several tasks.
    together: int = 1024
    #: Rows (of some 20 bytes) up to which a join's side is broadcast; beyond, both sides are shuffled.
    broadcast: int = 2_000_000
    #: Bytes of text that are turned into shingles at a time.
    block: int = 1 << 20


def _cells(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.uint32)


@dataclass(frozen=True)
class Order:
    """A level for each cell of hashed shingles: the logarithm of how often all documents hold those of the cell. A prefix
    takes shingles by rising level, then by hash; any such order gives the same links."""

    levels: np.ndarray

    def level(self, s: np.ndarray) -> np.ndarray:
        return self.levels[_cells(s, len(self.levels).bit_length() - 1)]


def _shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each place where a shingle begins, repeats counted; short documents come last."""
    h, doc = word_hashes(raw, offsets)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        odd = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        n = max(0, len(h) - k + 1)
        full = doc[:n] == doc[k - 1 :] if n else np.zeros(0, bool)
        s = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            s += h[j : j + n] * odd[j]
        s, d = mix64(s[full]), doc[:n][full]
        count = np.bincount(doc, minlength=len(offsets) - 1)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            first = np.cumsum(count) - count
            own = np.zeros(len(few), np.uint64) + count[few].astype(np.uint64)
            for j in range(k - 1):
                has = count[few] > j
                own[has] += h[first[few[has]] + j] * odd[j]
            s, d = np.concatenate([s, mix64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))]), np.concatenate([d, few])
    return d, s


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, sorted by both."""
    d, s = _shingles(raw, offsets, k)
    by = np.lexsort((s, d))
    s, d = s[by], d[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return d[new], s[new]


def _sets(raw: np.ndarray, offsets: np.ndarray, params: JaccardParams):
    for a, b in runs(offsets, params.block):
        yield a, b, *shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params.words)


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    want = np.maximum(2 * np.asarray(n, np.int64), 1)
    return np.clip(1 << np.ceil(np.log2(want)).astype(np.int64), LEAST_BITS, MOST_BITS)


def bitmaps(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A bitmap for each document: the bit of each shingle is its hash modulo the size, so halves of a bitmap laid over each
    other are the bitmap of half the size."""
    bits = bitmap_bits(n)
    start = np.cumsum(bits) - bits
    flat = np.zeros(int(bits.sum()), bool)
    flat[start[doc] + ((s >> np.uint64(24)).astype(np.int64) & (bits[doc] - 1))] = True
    packed = np.packbits(flat, bitorder="little").tobytes()
    return [packed[a // 8 : (a + b) // 8] for a, b in zip(start.tolist(), bits.tolist(), strict=True)]


def differing(flat: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps i and j differ, at the size of the smaller; flat holds all bitmaps in 64-bit words."""
    out = np.zeros(len(i), np.int64)
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    wide = np.where(size[i] >= size[j], i, j)
    slim = np.where(size[i] >= size[j], j, i)
    for w, v in {(int(a), int(b)) for a, b in zip(small, large, strict=True)}:
        own = np.flatnonzero((small == w) & (large == v))
        for k in range(0, len(own), max(1, (1 << 21) // v)):
            part = own[k : k + max(1, (1 << 21) // v)]
            x = flat[start[slim[part]][:, None] + np.arange(w)]
            y = flat[start[wide[part]][:, None] + np.arange(v)]
            while y.shape[1] > w:
                y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
            out[part] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def needed(n, percent: int):
    """The least overlap of a set of n with any that links with it."""
    return -(-(percent * n) // 100)


_SKETCH = "doc_id long, mark long, set1 long, set2 long, n long, bits binary, shard int, keys binary, sets binary"


def _sketcher(params: JaccardParams, load, shards: int):
    names = [x.split()[0] for x in _SKETCH.split(", ")]

    def run(batches):
        levels = load()
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            posted = []
            total = len(off) - 1
            set1, set2, size = np.zeros(total, np.uint64), np.zeros(total, np.uint64), np.zeros(total, np.int64)
            bits: list[bytes] = []
            for a, b, doc, s in _sets(raw, off, params):
                n = np.bincount(doc, minlength=b - a)
                size[a:b] = n
                bits += bitmaps(doc, s, n)
                if not len(s):
                    continue
                has = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[has]
                # copies in a block post their prefix once
                once = np.zeros(b - a, bool)
                with np.errstate(over="ignore"):
                    set1[a + has] = mix64(np.add.reduceat(mix64(s), first) + n[has].astype(np.uint64))
                    set2[a + has] = mix64(np.add.reduceat(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), first))
                once[has[np.unique(set1[a + has], return_index=True)[1]]] = True
                # the first n - needed + 1 shingles by the order
                order = np.lexsort((s, levels.level(s), doc))
                rank = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                keep = order[(rank < (n - needed(n, params.percent) + 1)[doc]) & once[doc]]
                posted.append((s[keep], set1[a + doc[keep]]))
            rows = [batch.column(0), batch.column(2), pa.array(set1.view(np.int64)), pa.array(set2.view(np.int64)), pa.array(size), pa.array(bits, pa.binary())]
            none = pa.nulls(total)
            yield pa.RecordBatch.from_arrays([*rows, none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], names)
            if posted:
                key, owner = (np.concatenate(x) for x in zip(*posted, strict=True))
                shard = (key % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                shard, key, owner = shard[order], key[order], owner[order]
                cut = np.flatnonzero(np.diff(shard)) + 1
                starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(shard)]
                m = len(starts)
                gone = [pa.nulls(m, pa.int64())] * 5
                packs = [pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for x in (key, owner)]
                yield pa.RecordBatch.from_arrays([*gone, pa.nulls(m, pa.binary()), pa.array(shard[starts]), *packs], names)
            give_back()

    return run


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


def _grouped(t: pa.Table) -> pa.Table:
    """Of one shard: (grp, set1) of the shingles that at least two classes hold; groups of equal members come once."""
    key, owner = _unpack(t["keys"]), _unpack(t["sets"])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    if not len(start):
        return pa.table({"grp": pa.array([], pa.int64()), "set1": pa.array([], pa.int64())})
    with np.errstate(over="ignore"):
        grp = mix64(np.add.reduceat(mix64(owner + np.uint64(77)), start) + size.astype(np.uint64))
    once = np.zeros(len(start), bool)
    once[np.unique(grp, return_index=True)[1]] = True
    keep = np.repeat(once & (size > 1), size)
    return pa.table({"grp": np.repeat(grp, size)[keep].view(np.int64), "set1": owner[keep].view(np.int64)})


def band(n, percent: int):
    """Size bands in the ratio of the threshold: sets that may link are in one band or in two that follow each other."""
    return F.floor(F.log(n.cast("double")) / float(-np.log(percent / 100)) + 1e-9).cast("int")


def _blocks(rows: DataFrame, key: str, member: str, together: int) -> DataFrame:
    """Rows of groups (key) with cell and side: a group of at most ``together`` rows is one cell; a larger one has a cell for
    each pair of its blocks, in which rows of different sides meet (0 meets all)."""
    wide = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / together).alias("parts")).where("parts > 1")
    dealt = rows.join(wide, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(3), member), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.withColumn("cell", cell).withColumn("side", side).drop("parts", "own", "other")


def _in_tiles(t: pa.Table, *names: str):
    """The named columns sorted by tile, size and class, and the order."""
    tile, owner, n = (t[c].to_numpy() for c in ("tile", "set1", "n"))
    order = np.lexsort((owner, n, tile))
    return order, tile[order], owner[order], n[order], *(t[c].to_numpy(zero_copy_only=False)[order] for c in names)


def _steps(tile: np.ndarray, n: np.ndarray, guest: np.ndarray, percent: int, reach: int | None, side: np.ndarray | None = None):
    """(rows, k): rows to compare with those k further on. Sizes rise within a tile, so a row that has met one too large
    meets no more. Guests don't meet guests, nor do rows of one side."""
    live, k = np.arange(len(tile)), 0
    while len(live) and (reach is None or k < reach):
        k += 1
        live = live[live + k < len(tile)]
        live = live[(tile[live] == tile[live + k]) & (100 * n[live] >= percent * n[live + k])]
        todo = live[~(guest[live] & guest[live + k])]
        if side is not None:
            todo = todo[(side[todo] != side[todo + k]) | (side[todo] == 0)]
        if len(todo):
            yield todo, k


def _bounded(n: np.ndarray, i: np.ndarray, j: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether the pairs may link, by the bits that differ."""
    both = n[i] + n[j]
    most = (both - differ) // 2  # of the overlap
    return 100 * most >= percent * (both - most)


def _neighbours(params: JaccardParams):
    """Pairs of each row in the tiles of a shard with the ``reach`` next ones, by size alone."""

    def run(t: pa.Table) -> pa.Table:
        _, tile, owner, n, guest = _in_tiles(t, "guest")
        found = [(owner[i], owner[i + k]) for i, k in _steps(tile, n, guest, params.percent, params.reach)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _near(params: JaccardParams):
    """Of rows (a, b, n_a, n_b, bits_a, bits_b) the pairs that their bitmaps let link."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            maps = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            flat = np.frombuffer(b"".join(maps), np.uint64)
            size = np.array([len(x) // 8 for x in maps], np.int64)
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            i = np.arange(m)
            ok = _bounded(n, i, i + m, differing(flat, np.cumsum(size) - size, size, i, i + m), params.percent) if m else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _tiler(params: JaccardParams):
    """Candidate pairs within the tiles of a shard, as stars; what has one cluster already is not compared."""

    def run(t: pa.Table, signatures: pa.Table) -> pa.Table:
        _, tile, owner, n, guest, cluster, side = _in_tiles(t, "guest", "cluster", "side")
        signatures = signatures.sort_by("set1")
        maps = signatures["bits"].to_pylist()
        flat = np.frombuffer(b"".join(maps), np.uint64)
        size = np.array([len(x) // 8 for x in maps], np.int64)
        place = np.searchsorted(signatures["set1"].to_numpy(), owner)
        start, size = (np.cumsum(size) - size)[place], size[place]
        del maps
        found, held = [], 0
        a = b = np.zeros(0, np.int64)
        for i, k in _steps(tile, n, guest, params.percent, None, side):
            i = i[cluster[i] != cluster[i + k]]
            if len(i):
                i = i[_bounded(n, i, i + k, differing(flat, start, size, i, i + k), params.percent)]
                found.append((owner[i], owner[i + k]))
                held += len(i)
            if held > 1 << 20:
                a, b = local_components(np.concatenate([a, *(x for x, _ in found)]), np.concatenate([b, *(y for _, y in found)]))
                found, held = [], 0
        if found:
            a, b = local_components(np.concatenate([a, *(x for x, _ in found)]), np.concatenate([b, *(y for _, y in found)]))
        give_back()
        return pa.table({"a": a.astype(np.int64)[a != b], "b": b.astype(np.int64)[a != b]})

    return run


def _verifier(params: JaccardParams):
    """Exact links within the cells of a shard, as stars over doc_id."""

    def run(t: pa.Table) -> pa.Table:
        raw, off = text_bytes(t["text"])
        sets: list[np.ndarray] = []
        for a, b, doc, s in _sets(raw, off, params):
            sets += np.split(s, np.searchsorted(doc, np.arange(1, b - a)))
        ids, guest, side, tile = (t[c].to_numpy() for c in ("doc_id", "guest", "side", "cell"))
        size = np.array([len(s) for s in sets])
        order = sorted(range(len(ids)), key=lambda i: (tile[i], size[i], ids[i]))
        links: list[tuple[int, int]] = []
        groups: list[list[int]] = []  # components so far in this tile
        now = None
        for i in order:
            if tile[i] != now:
                now, groups = tile[i], []
            joined: list[list[int]] = []
            rest: list[list[int]] = []
            for g in groups:
                for j in reversed(g):  # the nearest in size first
                    if 100 * size[j] < params.percent * size[i]:
                        break
                    if (guest[i] and guest[j]) or (side[i] and side[i] == side[j]):
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= params.percent * (size[i] + size[j] - both):
                        links.append((int(ids[i]), int(ids[j])))
                        joined.append(g)
                        break
                else:
                    rest.append(g)
                    continue
                if not joined or joined[-1] is not g:
                    rest.append(g)
            merged = sorted([x for g in joined for x in g] + [i], key=lambda x: size[x]) if joined else [i]
            groups = [*rest, merged]
        a, b = (np.array(x, np.int64) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
        del sets
        give_back()
        return pa.table({"a": a, "b": b})

    return run


def _small(x: np.ndarray) -> bytes:
    """Numbers from 1 on in a byte each, and those of 255 or more in four bytes behind; the count of the former leads."""
    return len(x).to_bytes(4, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u4").tobytes()


def _from_small(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    x = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    x[x == 255] = np.frombuffer(raw[4 + n :], "<u4")
    return x


def _slices(t: pa.Table) -> pa.Table:
    """Of one slice of the count table: the levels of its cells."""
    cells = int(t["cells"][0].as_py())
    total = np.zeros(cells, np.int64)
    for at, n in zip(t["places"].to_pylist(), t["counts"].to_pylist(), strict=True):
        total[np.cumsum(_from_small(at)) - 1] += _from_small(n)
    return pa.table({"slice": pa.array([t["slice"][0].as_py()], pa.int32()), "levels": pa.array([np.log2(total + 1).astype(np.uint8).tobytes()], pa.binary())})


def counted_order(docs: DataFrame, params: JaccardParams) -> Order:
    """Counts the shingles of all documents in a table of hashed cells, in proportion to the input and of at most ``most_cells``.
    Tasks count what they read and send the cells that they met, by slices of the table; only levels (a byte a cell) come
    to the driver. Beyond some billions of shingles a cell holds many, and only those more common than its mean stand out."""
    bits = int(np.clip(input_bytes(docs) // 16, 1 << 12, params.most_cells)).bit_length() - 1
    slices = 1 << min(6, bits - 6)
    cells = (1 << bits) // slices

    def run(batches):
        held, rows = [], 0

        def met():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(at, np.arange(slices + 1, dtype=np.uint64) * np.uint64(cells))
            parts = [(i, a, b) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < b]
            places = (at % cells).astype(np.int64)
            packs = [pa.array([_small(x) for x in xs], pa.binary()) for xs in ([np.diff(places[a:b], prepend=-1) for _, a, b in parts], [n[a:b] for _, a, b in parts])]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in parts], pa.int32()), pa.array([cells] * len(parts), pa.int32()), *packs], ["slice", "cells", "places", "counts"])

        for batch in batches:
            raw, off = text_bytes(batch.column(0))
            for a, b in runs(off, params.block):
                held.append(_cells(_shingles(raw[off[a] : off[b]], off[a : b + 1] - off[a], params.words)[1], bits))
                rows += len(held[-1])
                if rows >= 1 << 22:
                    yield met()
                    held, rows = [], 0
        if rows:
            yield met()
        give_back()

    counts = docs.select("text").mapInArrow(run, "slice int, cells int, places binary, counts binary")
    got = counts.groupBy("slice").applyInArrow(_slices, "slice int, levels binary").collect()
    levels = np.zeros(1 << bits, np.uint8)
    for r in got:
        levels[r["slice"] * cells : (r["slice"] + 1) * cells] = np.frombuffer(r["levels"], np.uint8)
    return Order(levels)


def jaccard_components(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """docs (doc_id, text). Returns (doc_id, n_shingles, component_id), a row for each row; what it took is deleted."""
    out, steps = _joined(docs, params)
    for step in steps:
        dropped(step)
    return out


def _joined(docs: DataFrame, params: JaccardParams) -> tuple[DataFrame, list[DataFrame]]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    shards = shards_for(docs, 8 << 20)
    sketched = written(docs.mapInArrow(_sketcher(params, sent(docs.sparkSession, counted_order(docs, params)), shards), _SKETCH))
    sketch = sketched.where("shard is null").select("doc_id", "mark", "set1", "set2", "n", "bits")
    classes = sketch.where("n > 0 and doc_id is not null").groupBy("set1", "set2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.min("bits").alias("bits"))
    classes = written(classes.select("set1", "set2", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("mark"), "bits"))
    copies = sketch.where("n > 0 and doc_id is not null").join(classes.select("set1", "set2", "n", "rep"), ["set1", "set2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    groups = sketched.where("shard is not null").select("shard", "keys", "sets").groupBy("shard").applyInArrow(_grouped, "grp long, set1 long").distinct()
    sizes = classes.select("set1", "n").withColumn("band", band(F.col("n"), params.percent))
    groups = written(groups.join(sizes, "set1"))

    def tiles(rows: DataFrame) -> DataFrame:
        """Rows of groups with the tiles they visit; a tile counts if it has a pair."""
        visits = rows.withColumn("visit", F.explode(F.array(F.lit(0), F.lit(1))))
        visits = visits.withColumn("tile_band", F.col("band") + F.col("visit")).withColumn("guest", F.col("visit") == 1)
        visits = visits.withColumn("tile", F.xxhash64("grp", "tile_band"))
        return visits.drop("visit", "band", "grp")

    # the first round only looks for pairs that are likely, so blocks of a large group may go their own ways
    wide = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / params.together).alias("parts")).where("parts > 1")
    first = groups.join(wide, "grp", "left").withColumn("grp", F.when(F.col("parts").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64(F.lit(3), "set1"), F.col("parts"))))).drop("parts")
    pairs = tiles(first).drop("tile_band").groupBy(F.pmod("tile", F.lit(shards))).applyInArrow(_neighbours(params), "a long, b long").distinct()
    maps = classes.select("set1", "n", "bits")
    pairs = pairs.join(maps.toDF("a", "n_a", "bits_a"), "a").join(maps.toDF("b", "n_b", "bits_b"), "b")
    near = written(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_near(params), "a long, b long"))
    clusters = components(near)
    # groups that the first round did not compare whole, and that lie in more than one cluster; those with the same smallest
    # member are one, and a tile counts if a host of it meets another cluster
    label = groups.join(clusters.withColumnRenamed("node", "set1"), "set1", "left").withColumn("cluster", F.coalesce("component", "set1")).drop("component")
    mixed = label.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("set1").alias("anchor")).where((F.col("rows") > params.reach + 1) & (F.col("lo") < F.col("hi")))
    again = label.join(mixed.select("grp", "anchor"), "grp").select(F.col("anchor").alias("grp"), "set1", "n", "band", "cluster").distinct()
    again = tiles(again).drop("tile_band")
    busy = again.groupBy("tile").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("guest").alias("guests")).where("lo < hi and not guests").select("tile")
    again = _blocks(again.join(busy, "tile"), "tile", "set1", params.together).drop("tile").withColumnRenamed("cell", "tile")
    again = written(again.withColumn("shard", F.pmod("tile", F.lit(4 * shards))))
    signatures = again.select("shard", "set1").distinct().join(classes.select("set1", "bits"), "set1").toDF("set1_", "shard_", "bits").withColumnsRenamed({"set1_": "set1", "shard_": "at"})
    rest = again.groupBy("shard").cogroup(signatures.groupBy("at")).applyInArrow(_tiler(params), "a long, b long")
    clusters = components(near.unionByName(rest)).withColumnsRenamed({"node": "set1", "component": "cluster"})

    members = classes.join(clusters, "set1").select(F.col("rep").alias("doc_id"), "mark", "cluster", band(F.col("n"), params.percent).alias("band"))
    members = members.withColumn("visit", F.explode(F.array(F.lit(0), F.lit(1))))
    members = members.select("doc_id", "mark", F.xxhash64("cluster", F.col("band") + F.col("visit")).alias("tile"), (F.col("visit") == 1).alias("guest"))
    hosted = members.groupBy("tile").agg(F.min("guest").alias("guests"), F.count(F.lit(1)).alias("rows")).where("not guests and rows > 1").select("tile")
    # ids of candidates are few beside the documents: while they are, no text moves but theirs
    members = written(_blocks(members.join(hosted, "tile"), "tile", "mark", params.together).drop("tile"))
    members = F.broadcast(members) if members.count() <= params.broadcast else members
    texts = docs.join(members, ["doc_id", "mark"])
    texts = texts.dropDuplicates(["doc_id", "mark", "cell"]) if _repeated(sketch) else texts
    texts = texts.select("doc_id", "text", "cell", "side", "guest")
    links = texts.groupBy(F.pmod("cell", F.lit(4 * shards))).applyInArrow(_verifier(params), "a long, b long")
    found = components(links.unionByName(copies)).withColumnsRenamed({"node": "doc_id", "component": "component_id"})
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    out = written(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    return out, [sketched, classes, groups, near, again]


def _repeated(sketch: DataFrame) -> bool:
    """Whether an id and text occur twice."""
    return bool(sketch.where("doc_id is not null").groupBy("doc_id", "mark").count().where("count > 1").take(1))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), JaccardParams(words=4, percent=85))
