"""Collection over a stream of arriving items: each micro-batch is a run with its own start, and one transaction over the tables.

State is the tables themselves, for they never expire (a watermark would drop old keys). They lie in a store of hash buckets: a
batch rewrites the buckets of the rows it changes, and one manifest makes articles, provenance, relations, run and cursors visible
together, with the batch's number. A batch that runs again after a loss finds its number there and writes nothing; one that
was lost before its manifest has changed nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillstream.functions import dates
from quillstream.operators.collect import CollectSettings, changes
from quillstream.sources.store import BUCKETS, Snapshot, Store
from quillstream.sources.tables import ITEM, KEYS, SCHEMAS, Tables, load

ITEMS = f"rss_source_id long, keyword_id long, position int, {ITEM}"


def _tables(snapshot: Snapshot) -> Tables:
    return {name: snapshot[name] for name in SCHEMAS}


def current(spark: SparkSession, folder: str, batch: int | None = None) -> Tables:
    """The tables after a batch, the last one by default; -1 are those the stream began with."""
    store = Store(spark, f"{folder}/store")
    snapshot = store.current() if batch is None else store.current(batch + 2)
    if batch is not None and snapshot.meta.get("batch", -1) != batch:
        raise ValueError(f"version {snapshot.version} is not that of batch {batch}")
    return _tables(snapshot)


def begun(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> Store:
    """The store of a stream, whose first version are the tables in folder/base."""
    store = Store(spark, f"{folder}/store")
    if not store.current().version:
        t = store.begin()
        for name, df in load(spark, f"{folder}/base").items():
            t.replace(name, df, KEYS[name], buckets)
        t.commit(batch=-1)
    return store


def step(store: Store, items: DataFrame, batch: int, now: datetime, settings: CollectSettings = CollectSettings()) -> bool:
    """One micro-batch; whether it was new. Cursors and data are of one commit."""
    t = store.begin()
    if t.base.meta["batch"] >= batch:
        return False
    made = changes(_tables(t.base), items, dates.at(now), batch + 1, settings=settings)
    for name, rows in made.items():
        t.upsert(name, rows)
    t.commit(batch=batch)
    return True


def collected_stream(spark: SparkSession, source: str, folder: str, clock: Callable[[int], datetime], settings: CollectSettings = CollectSettings(), files: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Reads Parquet files of items as they arrive in ``source``, ``files`` a batch at most; the base tables lie in folder/base. Processes
    what is there and ends."""
    store = begun(spark, folder, buckets)
    reader = spark.readStream.schema(T._parse_datatype_string(ITEMS))  # noqa: SLF001
    items = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)

    def one(df: DataFrame, batch: int) -> None:
        step(store, df, batch, clock(batch), settings)

    return items.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
