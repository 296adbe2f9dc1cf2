"""Mixing sources to target weights by the cube method.

Each source has a target in words. A document is taken ``base`` whole times plus a fractional part, the same for all
documents of a source, so that the expected words meet the target exactly. The cube method (Deville and Tille, 2004)
turns the fractions into zeros and ones: it moves the vector of inclusion probabilities along the null space of the
balancing constraints (the document count and the word total) until some reach 0 or 1. Two constraints leave one free
direction among three documents, so one step looks at three documents and settles at least one of them; no more
than two of a block stay open. Blocks of a source run in parallel; what they leave open meets in further
rounds. The landing, where a source has one block left, rounds its last two documents and mends what that puts the words off
balance by changing short ones. A document much longer than the others would stay open to the end, so it is settled
at once, and the ones behind it make up for it.

Edge cases: null, empty and wordless texts have size 0 and are taken 0 words; a null source is a source of its own,
sorted last; repeated rows count as rows of their own, ordered by id and text hash; a source without words has target 0;
an empty table gives an empty result. The draws come from hashes, so reruns agree.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import mix64, table, written
from quillstream.operators import merge

WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9
#: A document so many times as long as all still to come is settled at once.
OUTLIER = 8


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Words of the mix as a share of all words, and the most copies of a source and of a document.
    share: float = 1.5
    most_copies: float = 2.0
    #: Documents that one task balances.
    block: int = 2048
    seed: int = 7


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, params: MixParams) -> DataFrame:
    """totals: (source, source_size, n_docs), a row for each source. Adds target: shares by weight, with what exceeds
    the cap of a source dealt again by weight among the others.

    The water level, at which the smaller of cap and level * weight sums to all words, is found by rounds of one aggregate:
    sources that the level so far fills stay full, and the rest share what is left, which raises it. No task sees all
    sources: their order, which gives the weights, is counted within ranges of it."""
    by_name = F.struct(F.col("source").isNull().alias("last"), "source")
    t = merge.next_ids(totals.sparkSession.createDataFrame([], "id long"), totals.withColumn("name", by_name), "name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in params.weights]), ((F.col("id") - 1) % len(params.weights) + 1).cast("int"))
    t = written(t.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * params.most_copies).cast("double").alias("cap")))
    words = float(t.agg(F.sum("source_size")).first()[0] or 0) * params.share
    level = 0.0
    while True:
        full = F.col("cap") <= level * F.col("weight")
        got = t.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not got[1]:  # every source is full
            level = float("inf")
            break
        new = (words - got[0]) / got[1]
        if new <= level * (1 + 1e-15):
            break
        level = new
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return t.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


class _Rest:
    """The documents that a flight has not reached yet, with what long documents were settled off balance dealt out among
    them: each one's p moves by the same share of its way to 1 (or 0), so all later moves are one line a * p + b."""

    def __init__(self, p: list[float], size: list[float]):
        self.a, self.b = 1.0, 0.0
        tail = lambda x: np.append(np.cumsum(np.asarray(x, np.float64)[::-1])[::-1], 0.0).tolist()
        own = np.asarray(p, np.float64)
        free = (own > _EPS) & (own < 1 - _EPS)
        self.words, self.taken = tail(np.where(free, size, 0.0)), tail(np.where(free, own * np.asarray(size, np.float64), 0.0))

    def p(self, p: float) -> float:
        return self.a * p + self.b if _EPS < p < 1 - _EPS else p

    def room(self, k: int) -> tuple[float, float]:
        """Words that the documents from place k on can take more, and less."""
        now = self.a * self.taken[k] + self.b * self.words[k]
        return self.words[k] - now, now

    def deal(self, k: int, words: float) -> None:
        """The documents from place k on take so many words more, on balance."""
        more, less = self.room(k)
        if words > 0:
            t = min(1.0, words / more) if more > 0 else 0.0
            self.a, self.b = self.a * (1 - t), self.b * (1 - t) + t
        elif words < 0:
            t = min(1.0, -words / less) if less > 0 else 0.0
            self.a, self.b = self.a * (1 - t), self.b * (1 - t)


def flight(p: list[float], size: list[float], draw: list[float]) -> tuple[list[float], list[int]]:
    """Moves p along the null space of (1, size), three entries at a time, until at most two are between 0 and 1.

    A document that is open beside others much shorter would stay open to the end: it moves by the difference of theirs. Where
    those still to come, all shorter by OUTLIER, can make up for it, it is settled by its probability, and they take the
    words that it took too many or too few. Sums of p * size stay as they are, those of p where nothing was settled so.

    Returns the moved p and the places still open.
    """
    p, live = list(p), []
    rest, longest = _Rest(p, size), np.maximum.accumulate(np.asarray(size)[::-1])[::-1].tolist()
    for k in range(len(p)):
        p[k] = rest.p(p[k])
        if _EPS < p[k] < 1 - _EPS:
            live.append(k)
        else:
            p[k] = float(round(p[k]))
        for i in [i for i in live if i != k and size[i] > OUTLIER * longest[k]]:
            more, less = rest.room(k + 1)
            for z in (1.0, 0.0) if draw[i] < p[i] else (0.0, 1.0):
                owed = (p[i] - z) * size[i]
                if -0.9 * less <= owed <= 0.9 * more:
                    rest.deal(k + 1, owed)
                    p[i] = z
                    live.remove(i)
                    break
        if len(live) < 3:
            continue
        a, b, c = live
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(live, u, strict=True) if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(live, u, strict=True) if v)
        step = up if draw[k] * (up + down) < down else -down
        still = []
        for i, v in zip(live, u, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q
            if 0 < p[i] < 1:
                still.append(i)
        live = still
    return p, live


def land(p: list[float], size: list[float], live: list[int], before: list[float]) -> list[float]:
    """Settles the last open entries, whose words are off balance by what they are rounded by: of their roundings the one that
    is off least. What is still off then is mended by settled documents that may change (``before`` was a fraction), the
    largest that fit first, so that less than the smallest of them stays off."""
    p = list(p)
    if live:
        due = sum(p[i] * size[i] for i in live)
        z = min(itertools.product((0.0, 1.0), repeat=len(live)), key=lambda z: (abs(due - sum(x * size[i] for x, i in zip(z, live, strict=True))), z))
        for x, i in zip(z, live, strict=True):
            p[i] = x
        due -= sum(x * size[i] for x, i in zip(z, live, strict=True))
        for i in sorted((i for i in range(len(p)) if size[i] and _EPS < before[i] < 1 - _EPS), key=lambda i: (-size[i], i)):
            if due >= size[i] and p[i] == 0:
                p[i], due = 1.0, due - size[i]
            elif -due >= size[i] and p[i] == 1:
                p[i], due = 0.0, due + size[i]
    return p


_STATE = T.StructType([T.StructField("row", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("bound", T.LongType()), T.StructField("open", T.BooleanType())])


def _round(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """One round over (row, tie, source, size, p, bound, block): a flight in each block, and the landing where a source, of
    ``bound`` rows at most, has no other block."""

    def run(t: pa.Table) -> pa.Table:
        last = t["bound"][0].as_py() <= block
        key = mix64(t["row"].to_numpy().view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + mix64(t["tie"].to_numpy().view(np.uint64)))
        # long documents first: they are settled while others can make up for them
        order = np.lexsort((t["tie"].to_numpy(), t["row"].to_numpy(), key, -t["size"].to_numpy()))
        t, key = t.take(pa.array(order)), key[order]
        draw = (mix64(key) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        size = t["size"].to_numpy().astype(np.float64).tolist()
        before = t["p"].to_pylist()
        p, live = flight(before, size, draw.tolist())
        if last:
            p, live = land(p, size, live, before), []
        still = np.zeros(len(p), bool)
        still[live] = True
        return pa.table([t["row"], t["tie"], t["source"], t["size"], pa.array(p, pa.float64()), t["bound"], pa.array(still)], names=_STATE.names)

    return rows.groupBy("source", "block").applyInArrow(run, _STATE)


def cube_sample(rows: DataFrame, params: MixParams) -> DataFrame:
    """rows: (row, tie, source, size, p, n_docs). Returns (row, tie, source, chosen 0/1).

    The number of rounds follows from the largest source: blocks of at most ``block`` documents leave two each.
    """
    blocks = F.greatest(F.ceil(F.col("bound") / params.block).cast("long"), F.lit(1))
    todo = rows.select("row", "tie", "source", "size", "p", F.col("n_docs").cast("long").alias("bound"))
    most = int(rows.agg(F.max("n_docs")).first()[0] or 0)
    done, depth = [], 0
    while True:
        dealt = todo.withColumn("block", F.pmod(F.xxhash64(F.lit(params.seed + depth), "row", "tie"), blocks))
        state = _round(dealt, params.block, params.seed + depth)
        if most <= params.block:
            done.append(state)
            break
        state = written(state)
        done.append(state.where("not open"))
        most = 2 * -(-most // params.block)
        depth += 1
        todo = state.where("open").select("row", "tie", "source", "size", "p", (2 * blocks).alias("bound"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row", "tie", "source", F.col("p").cast("int").alias("chosen"))


def mix_sources(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """docs (doc_id, text, source). Returns (doc_id, text_hash, source, size, source_size, target, copies), a row for each row."""
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = written(sized.withColumns({"tie": F.col("text_hash"), "row": F.coalesce("doc_id", F.lit(-1)).cast("long")}))
    # equal rows are told apart by a number within their (row, tie); such groups are copies of one row
    if _repeats(sized):
        nth = F.row_number().over(W.partitionBy("row", "tie").orderBy("source"))
        sized = written(sized.withColumn("tie", F.xxhash64("tie", nth)))
    totals = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), params))
    rated = sized.join(totals.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("base", F.floor(rate + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), rate - F.col("base")))
    chosen = cube_sample(rated.select("row", "tie", "source", "size", "p", "n_docs"), params)
    out = rated.join(chosen.select("row", "tie", "chosen"), ["row", "tie"])
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("base") + F.col("chosen")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns, whatever their names. Rows equal in id, text and
    source are one document that is taken as often as all of them are, with the other columns of any one of them."""
    taken = mix_sources(docs.select("doc_id", "text", "source"), params)
    taken = written(taken.groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).toDF("id", "hash", "of", "copies", "rows"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.select("row", F.col("row.doc_id").alias("row_id"), F.xxhash64("row.text").alias("row_hash"), F.col("row.source").alias("row_of"))
    if taken.where("rows > 1").take(1):
        own = own.dropDuplicates(["row_id", "row_hash", "row_of"])
    rows = own.join(taken.where("copies > 0"), F.expr("row_id <=> id and row_hash = hash and row_of <=> of"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _repeats(sized: DataFrame) -> bool:
    """Whether any (row, tie) occurs twice: only then the numbering is needed."""
    return bool(sized.groupBy("row", "tie").count().where("count > 1").take(1))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
