"""Near duplicates among embeddings: a small-world graph per shard, every shard searched, links verified by cosine.

Equal vectors are one class, so copies cost one search. Classes are dealt to shards of bounded bytes by a hash; each shard
builds a graph of its own, written in pieces to the shared folder. Each graph goes to ``groups`` tasks at most (one where there
are shards enough to keep the cluster busy), and the queries of all classes stream past it in Arrow batches, so no
task holds more than a shard and a batch. A query whose beam ends full of links, as in a large group of near copies,
is compared with the whole shard in blocks. Before a task searches, an audit asks for planted neighbours: vectors turned away
from members of the shard until their cosine barely reaches the threshold, so that each has a true link, and all
links that a scan finds for them count. While the beam finds less than ``recall`` of these, it doubles, and beyond
the shard's size the scan is exact. Only links whose cosine in double precision reaches the threshold count; of each
batch only counts and a spanning forest leave the task, and forests unite to components.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, have no links and are kept;
vectors of different lengths don't link; repeated ids are one vector for the components and keep their rows; a null id
keeps its row without component; an empty table gives an empty result; only the id and the vector are read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import give_back, mix64, table, written
from quillstream.llm.components import components, local_components
from quillstream.llm.hnsw import Graph


@dataclass(frozen=True)
class EmbeddingParams:
    threshold: float = 0.95
    #: Bytes of a shard in memory; inputs of some thousand vectors have at least ``least_shards`` shards, to build in parallel.
    shard: int = 192 << 20
    least_shards: int = 4
    #: Tasks in all that search, and over how many at most a shard's queries are dealt.
    tasks: int = 48
    groups: int = 12
    #: Width of the beam at first, planted neighbours of an audit, and the part of their links that must be found.
    ef: int = 16
    audit: int = 128
    recall: float = 0.995
    #: Bytes of a written piece of a graph.
    piece: int = 16 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _builder(ef: int, piece: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rows, ids = _rows(t["embedding"]), t["rep"].to_numpy()
        draw = ((mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        raw = pickle.dumps((np.ascontiguousarray(rows), ids, t["copies"].to_numpy(), Graph(unit(rows).astype(np.float32), draw, ef).dump()), 5)
        parts = [raw[i : i + piece] for i in range(0, len(raw), piece)]
        return pa.table({"shard": pa.array(np.full(len(parts), t["shard"][0].as_py()), pa.int64()), "part": pa.array(range(len(parts)), pa.int32()), "piece": pa.array(parts, pa.binary())})

    return run


class _Links:
    """Counts of links a query, and their spanning forest."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.a = self.b = np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q: np.ndarray, own: np.ndarray, other: np.ndarray, copies: np.ndarray) -> None:
        np.add.at(self.count, q, copies)
        self.parts.append((own, other))
        self.held += len(own)
        if self.held > 1 << 20:
            self.shrink()

    def shrink(self) -> None:
        if self.parts:
            self.a, self.b = local_components(np.concatenate([self.a, *(x for x, _ in self.parts)]), np.concatenate([self.b, *(x for _, x in self.parts)]))
            self.parts, self.held = [], 0


class Shard:
    """A shard's graph with its classes (unit rows v, ids, copies), and the width that the audit chose."""

    def __init__(self, graph: Graph, v: np.ndarray, ids: np.ndarray, copies: np.ndarray, params: EmbeddingParams):
        self.graph, self.v, self.ids, self.copies, self.params = graph, v, ids, copies, params
        self.near = np.float32(params.threshold - 1e-4)
        self.step = max(16, min(256, (64 << 20) // max(1, len(ids))))
        self.ef, self.hits, self.true = self._audit()

    @classmethod
    def load(cls, raw: bytes, params: EmbeddingParams) -> Shard:
        rows, ids, copies, links = pickle.loads(raw)  # noqa: S301  written by _builder in this job
        v = unit(rows)
        return cls(Graph.load(links, v.astype(np.float32)), v, ids, copies, params)

    def _exact(self, q: np.ndarray, own: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, c = np.nonzero(q[rows] @ self.v.T >= self.params.threshold)
        keep = self.ids[c] != own[rows[r]]
        return rows[r[keep]], c[keep]

    def _beams(self, q: np.ndarray, own: np.ndarray, rows: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified links (row, place), and the rows whose beam was full of links."""
        at, sims = self.graph.search(q[rows].astype(np.float32), ef)
        full = (sims[:, -1] >= self.near) & (at.shape[1] < len(self.ids))
        r, c = np.nonzero((sims >= self.near) & (at >= 0) & ~full[:, None])
        r, c = rows[r], at[r, c]
        keep = (self.ids[c] != own[r]) & (np.einsum("kd,kd->k", q[r], self.v[c]) >= self.params.threshold)
        return r[keep], c[keep], rows[full]

    def _found(self, q: np.ndarray, own: np.ndarray, ef: int):
        for i in range(0, len(q), self.step):
            part = np.arange(i, min(i + self.step, len(q)))
            if ef >= len(self.ids):
                yield self._exact(q, own, part)
                continue
            r, c, full = self._beams(q, own, part, ef)
            yield r, c
            if len(full):
                yield self._exact(q, own, full)

    def _audit(self) -> tuple[int, int, int]:
        """The width that finds enough, and how many of how many true links of planted neighbours it finds."""
        q = planted(self.v, self.params)
        none = np.full(len(q), -1)
        true = sum(len(self._exact(q, none, np.arange(i, min(i + 64, len(q))))[0]) for i in range(0, len(q), 64))
        ef = self.params.ef
        while True:
            hits = sum(len(r) for r, _ in self._found(q, none, ef))
            if ef >= len(self.ids) or hits >= self.params.recall * true:
                return ef, hits, true
            ef *= 2

    def search(self, q: np.ndarray, own: np.ndarray) -> _Links:
        """Links of the queries (unit rows q with ids own) with the shard's classes."""
        links = _Links(len(q))
        for r, c in self._found(q, own, self.ef):
            links.add(r, own[r], self.ids[c], self.copies[c])
        links.shrink()
        return links


def planted(v: np.ndarray, params: EmbeddingParams) -> np.ndarray:
    """Unit rows whose cosine with an evenly spaced row of v is just above the threshold, each turned its own way."""
    b = v[np.unique(np.linspace(0, len(v) - 1, min(params.audit, len(v))).astype(np.int64))]
    u = np.random.default_rng(len(v)).normal(size=b.shape)
    u -= (u * b).sum(1, keepdims=True) * b
    size = np.sqrt((u * u).sum(1, keepdims=True))
    cos = params.threshold + 0.02 * (1 - params.threshold)
    turned = cos * b + np.sqrt(1 - cos * cos) * u / np.maximum(size, 1e-300)
    return np.where(size > 1e-9, turned, b)  # in one dimension there is no other way


_FOUND = "rep long, links long, a long, b long, hits long, audited long"


def _searcher(params: EmbeddingParams):
    """Over rows sorted by cell, the pieces of a graph before its queries: (rep, links), forests (a, b), and an audit a graph."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], pa.int64()) if k in columns else pa.nulls(n, pa.int64()) for k in names], names)

    def run(batches):
        now, parts, shard = None, [], None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if i == j:
                    continue
                if cell[i] != now:
                    now, parts, shard = cell[i], [], None
                own = batch.slice(i, j - i)
                parts += [x for x in own.column("piece").to_pylist() if x is not None]
                asked = own.filter(own.column("rep").is_valid())
                if not asked.num_rows or not (parts or shard):
                    continue
                if shard is None:
                    shard, parts = Shard.load(b"".join(parts), params), []
                    yield rows(hits=[shard.hits], audited=[shard.true])
                ids = asked.column("rep").to_numpy()
                links = shard.search(unit(_rows(asked.column("embedding"))), ids)
                has = links.count > 0
                yield rows(rep=ids[has], links=links.count[has])
                yield rows(a=links.a, b=links.b)
            give_back()

    return run


def embedding_links(vectors: DataFrame, params: EmbeddingParams = EmbeddingParams(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Returns (key, n_links, component_id, kept, recall), a row for each row of vectors; recall is the least that an audit of
    a graph measured with the beam it chose (null without vectors)."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    sound = F.col("embedding").isNotNull() & F.expr("size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    ok = rows.where(F.col("vec_id").isNotNull()).where(sound)
    classes = ok.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    classes = written(classes.withColumn("dim", F.size("embedding")))
    # D distinct lengths need D * D / 2 components at least, so they are few beside the rows
    lengths, first = [], 0
    for r in sorted(classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        a_row = r.dim * 16 + 400
        shards = max(min(params.least_shards, -(-r.n // 1024)), -(-r.n * a_row // params.shard))
        lengths.append((r.dim, first, shards, max(1, min(params.groups, params.tasks // shards))))
        first += shards
    spark = vectors.sparkSession
    sizes = F.broadcast(spark.createDataFrame(lengths, "dim int, first long, shards long, groups long"))
    dealt = classes.join(sizes, "dim").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("shards")))
    built = dealt.select((F.col("first") + F.col("own")).alias("shard"), "rep", "copies", "embedding").groupBy("shard").applyInArrow(_builder(64, params.piece), "shard long, part int, piece binary")
    built = written(built)
    # a cell is a shard and a group of queries
    groups = max([g for *_, g in lengths], default=1)
    of = sizes.select(F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)).alias("shard"), "groups")
    graphs = built.join(F.broadcast(of), "shard").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    cell = F.col("shard") * groups + F.col("group")
    graphs = graphs.select(cell.alias("cell"), "part", "piece", F.lit(None).cast("long").alias("rep"), F.lit(None).cast(classes.schema["embedding"].dataType).alias("embedding"))
    asked = dealt.withColumn("group", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("groups"))).withColumn("shard", F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)))
    asked = asked.select(cell.alias("cell"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("piece"), "rep", "embedding")
    met = graphs.unionByName(asked).repartitionById(max(1, first * groups), F.col("cell").cast("int")).sortWithinPartitions("cell", F.col("part").asc_nulls_last(), "rep")
    found = written(met.mapInArrow(_searcher(params), _FOUND))
    seen = found.agg(F.min(F.try_divide("hits", "audited"))).first()[0]
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    # a class and its copies
    member = ok.join(classes.select("embedding", "rep", "copies"), "embedding").select("vec_id", "rep", "copies").distinct()
    member = written(member.join(counts, "rep", "left"))
    edges = found.where("a is not null").select("a", "b").unionByName(member.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    parts = components(edges)
    info = member.groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id").join(info, "vec_id", "left").join(parts.withColumnsRenamed({"node": "vec_id", "component": "component_id"}), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("vec_id", key)
    return out.withColumn("recall", F.lit(seen).cast("double"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("recall")
