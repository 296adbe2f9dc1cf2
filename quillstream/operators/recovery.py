"""What a start does to tables that an interrupted or older program left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text, urls
from quillstream.operators import merge
from quillstream.sources.tables import Tables


def _message(default: str, column: str):
    return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column)).otherwise(default)


def restarted(t: Tables, note: str = "interrupted by a restart") -> Tables:
    """Runs and reports in progress become interrupted, stages in progress failed; messages that are there stay."""
    out = dict(t)
    for name in ("collection_runs", "ai_analysis_runs"):
        busy = F.col("status") == "running"
        out[name] = t[name].withColumn("message", F.when(busy, _message(note, "message")).otherwise(F.col("message"))).withColumn("status", F.when(busy, "interrupted").otherwise(F.col("status")))
    busy = F.col("status") == "running"
    out["daily_reports"] = t["daily_reports"].withColumn("error_message", F.when(busy, _message(note, "error_message")).otherwise(F.col("error_message"))).withColumn("status", F.when(busy, "interrupted").otherwise(F.col("status")))
    for name, column in (("article_contents", "status"), ("article_relevance_reviews", "status"), ("business_articles", "analysis_status")):
        busy = F.col(column) == "processing"
        out[name] = t[name].withColumn("error_message", F.when(busy, _message(note, "error_message")).otherwise(F.col("error_message"))).withColumn(column, F.when(busy, "failed").otherwise(F.col(column)))
    items = t["ai_analysis_run_items"]
    busy = F.col("status").isin("pending", "processing")
    stages = {c: F.when(F.col(c).isin("pending", "processing"), "failed").otherwise(F.col(c)) for c in ("content_status", "relevance_status", "business_analysis_status")}
    out["ai_analysis_run_items"] = items.withColumn("error_message", F.when(busy, _message(note, "error_message")).otherwise(F.col("error_message"))).withColumns(stages).withColumn("status", F.when(busy, "failed").otherwise(F.col("status")))
    return out


def upgraded_defaults(df: DataFrame, current: dict[str, dict[str, tuple[str, tuple[str, ...]]]], key: str = "name") -> DataFrame:
    """Values replaced where they still are a known older default: current[row][column] = (new value, older ones)."""
    for column in sorted({c for row in current.values() for c in row}):
        value = F.col(column)
        for row, columns in current.items():
            if column in columns:
                new, old = columns[column]
                value = F.when((F.col(key) == row) & F.col(column).isin(*old), F.lit(new)).otherwise(value)
        df = df.withColumn(column, value)
    return df


def backfilled(t: Tables) -> Tables:
    """Countries of sources, normalised publishers, and provenance of articles from before those were kept."""
    sources = t["rss_sources"].withColumn("country", F.when(F.coalesce("country", F.lit("")) == "", urls.country(F.col("url_template"), F.coalesce("language", F.lit("")))).otherwise(F.col("country")))
    articles = t["articles"].withColumn("publisher_normalized", F.when(F.coalesce("publisher_normalized", F.lit("")) == "", text.publisher_key("publisher")).otherwise(F.col("publisher_normalized")))
    s = sources.select(F.col("id").alias("rss_source_id"), F.col("url_template").alias("feed_url"), "language", "country")
    told = articles.where("rss_source_id is not null").join(s, "rss_source_id").select(
        F.col("id").alias("article_id"), "rss_source_id", "feed_url", F.col("url").alias("observed_url"), "canonical_url", F.lit("").alias("guid"), "language", "country", F.array().cast("array<string>").alias("categories"), F.col("collected_at").alias("first_seen_at"), F.col("collected_at").alias("last_seen_at")
    )
    return t | {"rss_sources": sources, "articles": articles, "article_sources": merge.insert_ignore(t["article_sources"], told, ["article_id", "rss_source_id", "canonical_url"])}


# Failure kinds of the days when pages were fetched over HTTP (besides those LIKE 'http_%').
OLD_FAILURES = ("network", "dns", "resolver", "extraction", "content_type", "too_large")
MIGRATED = "migration_pending"


def purged_contents(contents: DataFrame, extractor: str, note: str = "to be read again") -> DataFrame:
    """Contents after a change of the extractor: failures of the old one may be tried again, those of them that hold no text go,
    and so do another extractor's successes. The pattern's underscore is any character, as in LIKE."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    old = (F.col("status") == "failed") & (F.col("failure_kind").like("http_%") | F.col("failure_kind").isin(*OLD_FAILURES))
    new = {"attempt_count": F.lit(0), "next_retry_at": F.lit(None).cast("timestamp"), "is_terminal": F.lit(0), "ignored_at": F.lit(None).cast("timestamp"), "error_message": F.lit(note)}
    reset = contents.withColumn("_old", F.coalesce(old, F.lit(False)))
    reset = reset.withColumns({k: F.when(F.col("_old"), v).otherwise(F.col(k)) for k, v in new.items()} | {"failure_kind": F.when(F.col("_old"), MIGRATED).otherwise(F.col("failure_kind"))})
    gone = (F.col("status") == "failed") & (F.col("failure_kind") == MIGRATED) & empty("content_hash") & empty("full_text")
    foreign = (F.col("status") == "success") & ~empty("extractor") & (F.col("extractor") != extractor)
    return reset.where(~F.coalesce(gone, F.lit(False)) & ~F.coalesce(foreign, F.lit(False))).drop("_old")
