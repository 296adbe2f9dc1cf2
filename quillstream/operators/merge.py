"""Keyed merges over immutable snapshots: upserts, inserts that ignore, deletes with their cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstream.sources.tables import CHILDREN, Tables


def latest(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key by order: one shuffle, and maxima are combined before it."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])).alias("_latest")
    return rows.groupBy(*keys).agg(best).select(*keys, "_latest.*").select(*rows.columns)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """base, which has a row for each key, with the delta's rows in place of those of their keys, the latest by seq of each. The
    base passes through one anti join, so a small delta's keys are broadcast and the base is not shuffled."""
    new = latest(delta.select(*base.columns, seq), keys, [seq]).drop(seq)
    return replaced(base, new, keys)


def replaced(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows, one for each of their keys, in place of those it has."""
    return base.join(rows.select(*keys), keys, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """base plus the delta's rows with new keys, the first of each by seq."""
    new = delta.join(base.select(*keys), keys, "left_anti")
    if seq:
        new = new.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(seq))).where("_nth = 1").drop("_nth", seq)
    return base.unionByName(new.select(*base.columns))


def keep_when(new: Column, old: Column, blank) -> Column:
    """The new value, unless it is blank."""
    return F.when(new.isNotNull() & (new != blank), new).otherwise(old)


def sighted(base: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of article_sources that sightings (the same columns, seen_at and seq) touch, with these merged in.

    The feed, the URL and last_seen_at are the latest; guid, language, country and categories the last that are not blank;
    first_seen_at stays.
    """
    keys = ["article_id", "rss_source_id", "canonical_url"]
    touched = seen.select(*keys).distinct()
    old = base.join(touched, keys, "left_semi").select(*base.columns).withColumns({"seq": F.lit(-1).cast("long"), "first": F.col("first_seen_at"), "last": F.col("last_seen_at")}).drop("first_seen_at", "last_seen_at")
    new = seen.withColumns({"seq": F.col("seq").cast("long"), "first": F.col("seen_at"), "last": F.col("seen_at")}).drop("seen_at")
    both = old.unionByName(new.select(*old.columns))
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col("seq"))).alias(c)
    always = F.lit(True)
    text = lambda c: last(c, F.coalesce(F.col(c), F.lit("")) != "")
    out = both.groupBy(*keys).agg(
        last("feed_url", always), last("observed_url", always), text("guid"), text("language"), text("country"), last("categories", F.size("categories") > 0), F.min_by("first", "seq").alias("first_seen_at"), F.max_by("last", "seq").alias("last_seen_at")
    )
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in ("guid", "language", "country")} | {"categories": F.coalesce("categories", F.array().cast("array<string>"))}
    return out.withColumns(filled).select(*base.columns)


def provenance(base: DataFrame, seen: DataFrame) -> DataFrame:
    """Where articles were seen: article_sources with sightings merged in. Rows that no sighting touches pass through unchanged."""
    return replaced(base, sighted(base, seen), ["article_id", "rss_source_id", "canonical_url"])


def advanced_cursors(cursors: DataFrame, pairs: DataFrame, at: Column) -> DataFrame:
    """Cursors of the successful pairs (rss_source_id, keyword_id) moved to the run's start; the others stay."""
    return replaced(cursors, moved_cursors(pairs, at), ["rss_source_id", "keyword_id"])


def moved_cursors(pairs: DataFrame, at: Column) -> DataFrame:
    """The cursors of the pairs, at the run's start."""
    return pairs.select("rss_source_id", "keyword_id").distinct().withColumn("last_collected_at", at.cast("timestamp"))


def deleted(tables: Tables, parent: str, doomed: DataFrame, key: str = "id") -> Tables:
    """All tables without the doomed rows (a frame of keys) and without what hangs on them."""
    gone = doomed.select(F.col(key).alias("_id")).distinct()
    out = dict(tables)
    out[parent] = tables[parent].join(gone, tables[parent][key] == gone["_id"], "left_anti")
    for child, column in CHILDREN.get(parent, ()):
        if child in tables:
            out[child] = tables[child].join(gone, tables[child][column] == gone["_id"], "left_anti")
    return out


def next_ids(base: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """new with ids that follow the highest of base, in order. Rows are numbered within ranges of the order, and the
    ranges' counts are added, so no task sees them all."""
    start = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    ranged = new.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    from quillstream.operators.lineage import cut

    ranged = cut(ranged)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    nth = F.row_number().over(W.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(ahead), "_part").crossJoin(F.broadcast(start)).withColumn("id", F.col("m") + F.col("_ahead") + F.col("_nth")).drop("_part", "_nth", "_ahead", "m")
