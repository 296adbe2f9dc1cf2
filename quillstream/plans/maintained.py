"""Hit counts and funnel cells that are kept, and moved by what a run or a purge changes, instead of being counted anew.

Every count is of distinct articles in a group, so it is a sum over articles: what a change adds is the count over the articles it
touched after it, less that before it. Deletes, new matches, reviews and flips of relevance are all the same to it. Only rows of touched
articles are read and grouped; keep the tables in buckets (sources.store) and only their buckets are. Counts follow the configuration they were made
with: where keywords or categories change, count anew. Cells of the funnel that depend on the clock are not kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators import enrich
from quillstream.plans.read_models import COUNTS, funnel_cells, hits, with_rates
from quillstream.plans.read_models import counted as counted_hits
from quillstream.sources.tables import Tables

#: Tables whose rows belong to an article, and the column that tells which.
OF_ARTICLE = {"articles": "id"} | dict.fromkeys(("article_keywords", "article_contents", "article_relevance_reviews", "business_articles"), "article_id")


def part(t: Tables, touched: DataFrame) -> Tables:
    """The tables with the rows of touched articles (a frame of article_id) only."""
    ids = touched.select("article_id").distinct()
    return {**t, **{name: t[name].join(ids.withColumnRenamed("article_id", column), column, "left_semi").select(*t[name].columns) for name, column in OF_ARTICLE.items() if name in t}}


def hit_counts(t: Tables, **rule) -> DataFrame:
    """(level, key, counts): of each keyword, of the active keywords of each category (null: none), and of all active ones."""
    rows = hits(t, **rule).where("article_id is not null")
    active = rows.where("active = 1")
    levels = [counted_hits(rows, "keyword_id").select(F.lit("keyword").alias("level"), F.col("keyword_id").alias("key"), *COUNTS), counted_hits(active, "category_id").select(F.lit("category").alias("level"), F.col("category_id").alias("key"), *COUNTS), counted_hits(active).select(F.lit("all").alias("level"), F.lit(None).cast("long").alias("key"), *COUNTS)]
    return reduce(DataFrame.unionByName, levels)


def cell_counts(t: Tables) -> DataFrame:
    """(level, key, counts) of the funnel's cells that no clock moves: the cell as level, its count in each column."""
    cells = funnel_cells()
    row = enrich.star(t).agg(*[F.count_if(c).alias(name) for name, c in cells.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("level"), F.col(name).alias("n")) for name in cells])
    return row.select(F.explode(pairs).alias("x")).select("x.level", F.lit(None).cast("long").alias("key"), *[F.col("x.n").alias(c) for c in COUNTS])


def counts(t: Tables, **rule) -> DataFrame:
    """Everything that is kept, counted from the tables."""
    out = hit_counts(t, **rule)
    return out.unionByName(cell_counts(t)) if "articles" in t else out


def change(before: Tables, after: Tables, touched: DataFrame, **rule) -> DataFrame:
    """What the counts move by, where only the touched articles differ."""
    new, old = counts(part(after, touched), **rule), counts(part(before, touched), **rule)
    return merged(new, old.select("level", "key", *[(-F.col(c)).alias(c) for c in COUNTS]))


def merged(kept: DataFrame, moved: DataFrame) -> DataFrame:
    """Counts after a change; groups that have become empty go."""
    sums = kept.unionByName(moved).groupBy("level", "key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return sums.where(" or ".join(f"{c} <> 0" for c in COUNTS))


def keyword_hit_stats(t: Tables, kept: DataFrame) -> DataFrame:
    """read_models.keyword_hit_stats from kept counts: the configuration alone is joined."""
    k = t["keywords"].where("archived = 0").select(F.col("id").alias("keyword_id"), F.col("name").alias("keyword_name"), "active", "category_id")
    c = t["keyword_categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), "sort_order")
    own = kept.where("level = 'keyword'").select(F.col("key").alias("keyword_id"), *COUNTS)
    rows = k.join(c, "category_id", "left").join(own, "keyword_id", "left").na.fill(0, list(COUNTS))
    return with_rates(rows).orderBy(F.coalesce("sort_order", F.lit(999999)), "keyword_id").drop("sort_order")
