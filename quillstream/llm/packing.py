"""Packing into optimal length buckets.

The histogram of document lengths over all rows is gathered once: a row for each distinct length reaches the driver (D distinct
numbers of words need D * D / 2 words of input at least, so 5 billion words have at most 100,000). Dynamic programming chooses the bucket boundaries that minimise the padding of all documents to their bucket's length.
Inside each bucket documents are numbered in parallel and cut into batches whose padded tokens keep to a budget.

Edge cases: null and empty texts have length 0 and share the shortest bucket; documents longer than the budget
form batches of one; equal rows are packed as rows of their own, in the order of id and length, so that reruns agree; an empty table gives an empty result. No length is rounded,
however many there are: a bucket's length is that of the longest document in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.llm.common import table, written
from quillstream.llm.mixing import words


@dataclass(frozen=True)
class PackingParams:
    buckets: int = 16
    budget: int = 16384
    #: Documents that one task numbers.
    block: int = 65536


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> np.ndarray:
    """Upper lengths of at most ``buckets`` buckets over a histogram (lengths rising) that minimise
    sum(count * (bucket length - length)): exact dynamic programming in integers.

    The cost of bins i..j as one bucket is length[j] * (C[j] - C[i-1]) - (S[j] - S[i-1]), with prefix sums C and S. It keeps
    the quadrangle inequality, so the best split place rises with j: each layer finds the places of middle bins first, and
    theirs bound those of the halves (n log n costs a layer)."""
    n = len(length)
    if not n:
        return np.zeros(0, np.int64)
    length, count = length.astype(np.int64), count.astype(np.int64)
    c, s = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count * length))
    best = np.concatenate([[0], length * c[1:] - s[1:]])
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, place = _layer(best, length, c, s)
        back.append(place)
        best = new
    cuts, j = [], n
    for place in reversed(back):
        if j == 0:
            break
        cuts.append(int(length[j - 1]))
        j = int(place[j])
    return np.array(cuts[::-1], np.int64)


def _layer(best: np.ndarray, length: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least costs of the first j bins with one more bucket, and the first split place of each. All middles of one depth
    are settled at once: row by row their candidates lie one behind the other."""
    n = len(length)
    new, place = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    a, b, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(a):
        j = (a + b) // 2
        size = np.minimum(j - 1, high) - low + 1
        start = np.cumsum(size) - size
        k = np.arange(size.sum()) + np.repeat(low - start, size)
        row = np.repeat(j, size)
        total = best[k] + length[row - 1] * (c[row] - c[k]) - (s[row] - s[k])
        least = np.minimum.reduceat(total, start)
        hits = np.flatnonzero(total == np.repeat(least, size))
        at = k[hits[np.searchsorted(hits, start)]]
        new[j], place[j] = least, at
        a, b, low, high = (np.concatenate(x) for x in ((a, j + 1), (j - 1, b), (low, at), (at, high)))
        some = a <= b
        a, b, low, high = a[some], b[some], low[some], high[some]
    return new, place


def choose_buckets(sized: DataFrame, params: PackingParams) -> np.ndarray:
    """sized (n_tokens). The boundaries for all its rows."""
    rows = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: r["n_tokens"])
    return boundaries(np.array([r["n_tokens"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), params.buckets)


def pack(docs: DataFrame, key: str = "doc_id", length: Column | None = None, params: PackingParams = PackingParams()) -> DataFrame:
    """(key, n_tokens, bucket_len, batch_id, slot): batch_id is unique over all buckets, slot a place in the batch."""
    n_tokens = words(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    sized = written(docs.select(F.col(key).alias("doc_id"), n_tokens.alias("n_tokens")))
    ends = choose_buckets(sized, params)
    fits = F.lit(None).cast("long")
    for e in reversed(ends.tolist()):
        fits = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(fits)
    bucketed = sized.withColumn("bucket_len", fits)
    # numbers within a bucket: within blocks in parallel, plus the rows of the blocks before
    blocks = max(1, -(-sized.count() // params.block))
    bucketed = bucketed.withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(blocks)))
    counted = bucketed.groupBy("bucket_len", "block").agg(F.count(F.lit(1)).alias("rows"))
    ahead = W.partitionBy("bucket_len").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offset = counted.withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).drop("rows")
    nth = F.row_number().over(W.partitionBy("bucket_len", "block").orderBy("doc_id", "n_tokens")) - 1
    numbered = bucketed.withColumn("nth", nth).join(offset, ["bucket_len", "block"])
    room = F.greatest(F.lit(1), F.floor(F.lit(params.budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    place = F.col("nth") + F.col("ahead")
    return numbered.select(
        F.col("doc_id").alias(key),
        "n_tokens",
        "bucket_len",
        F.concat_ws("-", F.col("bucket_len"), F.floor(place / room)).alias("batch_id"),
        (place % room).cast("long").alias("slot"),
    )


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
