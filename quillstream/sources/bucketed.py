"""The tables that hang on an article's id, stored in as many buckets by it: joins among them need no shuffle.

Spark's own bucketed tables: rows of one id lie in the same bucket of each table, sorted, so the star of articles, contents, reviews and
analyses is merged bucket by bucket where it lies, and questions about the whole pipeline shuffle their final sums only.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillstream.sources.tables import Tables

#: Tables of the star, and the column that holds an article's id.
STAR = {"articles": "id", "article_contents": "article_id", "article_relevance_reviews": "article_id", "business_articles": "article_id", "article_keywords": "article_id", "article_sources": "article_id"}


def saved(tables: Tables, prefix: str, folder: str, buckets: int = 64) -> None:
    """Writes the tables of the star to a folder that all executors share, as tables named prefix_table, in place of earlier ones of the name. A bucket should fit a task: choose their number by
    the size of the largest table. Rows are dealt by bucket first, so each bucket is one file."""
    for name, key in STAR.items():
        if name in tables:
            rows = tables[name].repartition(buckets, key)
            rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(f"{prefix}_{name}")


def loaded(spark: SparkSession, prefix: str, rest: Tables | None = None) -> Tables:
    """The saved tables of the star, beside ``rest``."""
    there = [name for name in STAR if spark.catalog.tableExists(f"{prefix}_{name}")]
    return {**(rest or {}), **{name: spark.table(f"{prefix}_{name}") for name in there}}
