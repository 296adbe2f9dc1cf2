"""Deduplication by two keys, in order of arrival.

An item joins a stored article that has its fingerprint or its URL (the one with the smallest id). Of the rest an item becomes
an article unless an earlier one shares a key with it; only articles register their keys, so this is leader
clustering, not connected components: A(f1,u1), B(f1,u2), C(f3,u2) gives two articles.

Leaders are found in rounds: an item that comes first among the undecided by both its keys is a leader, and whatever
shares a key with a leader is none. Each round is two grouped minima and two joins on one key; no OR in a join. Rounds go on while
each decides a good part of what is left. What then remains are long chains, each item sharing a key with the next, which
rounds would take apart link by link: they are parted into connected components, and each component is settled by one task in its items'
order, all components at once. A component beyond FEW items is settled in blocks of that many, in order: a block drops what
shares a key with an earlier leader by joins, and only conflicts within the block are left to its task. So neither a task nor the number of
jobs grows with a chain beyond its length divided by FEW.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.operators import graph, merge
from quillstream.operators.lineage import cut, dropped

KEYS = ("fingerprint", "canonical_url")
#: Items of a component, of two keys each, that one task settles at a time.
FEW = 250_000
#: Part of the undecided items that a round must decide for another one to follow.
WORTH = 0.25


def _real(key: str):
    return F.col(key).isNotNull() & (F.col(key) != "")


def first_of_key(items: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """Deduplication by one key: each row with leader, the first row's order."""
    return items.withColumn("leader", F.when(_real(key), F.min(order).over(W.partitionBy(key))).otherwise(F.col(order)))


def stored_matches(items: DataFrame, articles: DataFrame) -> DataFrame:
    """(seq, article_id) of items that a stored article shares a key with. Stored articles are first cut to the items' keys, which
    are broadcast while they are few, and reduced to the first of each key, so a key that many hold costs no pairs."""
    found = None
    for key in KEYS:
        asked = items.where(_real(key)).select(key).distinct()
        first = articles.where(_real(key)).join(asked, key, "left_semi").groupBy(key).agg(F.min("id").alias("article_id"))
        hit = items.where(_real(key)).select("seq", key).join(first, key).select("seq", "article_id")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("seq").agg(F.min("article_id").alias("article_id"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of items sorted by component and seq those that share no key with an earlier one of their component that stayed."""
    held: tuple[set, set] = (set(), set())
    at = None
    for b in batches:
        keep = []
        for part, *keys in zip(b.column("component").to_pylist(), *(b.column(k).to_pylist() for k in KEYS), strict=True):
            if part != at:
                held, at = (set(), set()), part
            keep.append(not any(k and k in own for k, own in zip(keys, held, strict=True)))
            if keep[-1]:
                for k, own in zip(keys, held, strict=True):
                    own.add(k)
        yield b.filter(pa.array(keep, pa.bool_()))


def _without(items: DataFrame, led: DataFrame) -> DataFrame:
    """Items that share no key with a leader."""
    for key in KEYS:
        items = items.join(led.where(_real(key)).select(key).distinct(), key, "left_anti")
    return items.select("seq", *KEYS, *(c for c in ("component", "block") if c in items.columns))


def _in_blocks(items: DataFrame, few: int) -> DataFrame:
    """The leaders of what rounds left, component by component."""
    links = None
    for key in KEYS:
        first = items.where(_real(key)).groupBy(key).agg(F.min("seq").alias("b"))
        own = items.where(_real(key)).join(first, key).where("seq <> b").select(F.col("seq").alias("a"), "b")
        links = own if links is None else links.unionByName(own)
    parts = graph.components(links).withColumnRenamed("node", "seq")
    items = cut(items.join(parts, "seq", "left").withColumn("component", F.coalesce("component", "seq")))
    sizes = cut(items.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    long = sizes.where(F.col("size") > few)
    blocks = 1
    if long.take(1):
        # the rank within a component: the rank among all items of long components, less that of the component's first
        ranked = merge.next_ids(items.limit(0).select(F.col("seq").alias("id")), items.join(long.select("component"), "component", "left_semi").withColumn("_at", F.struct("component", "seq")), "_at")
        start = ranked.groupBy("component").agg(F.min("id").alias("_first"))
        ranked = ranked.join(start, "component").select("seq", F.floor((F.col("id") - F.col("_first")) / few).cast("int").alias("block"))
        items = cut(items.join(ranked, "seq", "left").withColumn("block", F.coalesce("block", F.lit(0))))
        blocks = items.agg(F.max("block")).first()[0] + 1
    else:
        items = items.withColumn("block", F.lit(0))
    found = None
    for k in range(blocks):
        own = items.where(F.col("block") == k)
        own = _without(own, found) if found is not None else own
        led = own.repartition("component").sortWithinPartitions("component", "seq").select("seq", *KEYS, "component").mapInArrow(_in_order, items.select("seq", *KEYS, "component").schema)
        led = cut(led.select("seq", *KEYS))
        found = led if found is None else found.unionByName(led)
    return found


def leaders(items: DataFrame, few: int = FEW, worth: float = WORTH) -> DataFrame:
    """items (seq, fingerprint, canonical_url), seq unique. Returns (seq, leader): the seq of the item it is one with."""
    items = cut(items.select("seq", *KEYS))
    todo, found, left = items, None, items.count()
    while left:
        first = todo
        for key in KEYS:
            least = todo.where(_real(key)).groupBy(key).agg(F.min("seq").alias(f"_{key}"))
            first = first.join(least, key, "left")
        own = first.where(" and ".join(f"(_{k} is null or _{k} = seq)" for k in KEYS)).select("seq", *KEYS)
        own = cut(own)
        found = own if found is None else found.unionByName(own)
        rest = cut(_without(todo.join(own.select("seq"), "seq", "left_anti"), own))
        if todo is not items:
            dropped(todo)
        todo = rest
        before, left = left, todo.count()
        if left and before - left < worth * before:
            found = found.unionByName(_in_blocks(todo, few))
            break
    if found is None:
        return items.select("seq", F.col("seq").alias("leader"))
    hits = found.select("seq", F.col("seq").alias("leader"))
    for key in KEYS:
        led = found.where(_real(key)).select(key, F.col("seq").alias("leader"))
        hits = hits.unionByName(items.where(_real(key)).join(led, key).where("leader <= seq").select("seq", "leader"))
    return hits.groupBy("seq").agg(F.min("leader").alias("leader"))


def resolve(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Each item with article_id (null if new), and leader (the seq whose article it is, null if stored)."""
    stored = cut(stored_matches(items, articles))
    rest = items.join(stored, "seq", "left_anti")
    led = leaders(rest)
    return items.join(stored, "seq", "left").join(led, "seq", "left")
