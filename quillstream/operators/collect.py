"""A collection run over items that were fetched already: routing, windows, matching, deduplication, provenance, counters.

Pairs are atomic: a failed pair writes nothing and keeps its cursor. The run's start is a parameter, and so the upper
bound of every window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import dates, rules, terms, text, urls
from quillstream.operators import dedup, merge
from quillstream.operators.lineage import cut
from quillstream.sources.tables import KEYS, SCHEMAS, Tables

_STRINGS = T.ArrayType(T.StringType())


@dataclass(frozen=True)
class CollectSettings:
    timezone: str = dates.REPORT_ZONE
    incremental: bool = True
    local_filter: bool = True


def route(sources: DataFrame, keywords: DataFrame) -> DataFrame:
    """Tasks: active sources by active strategies, each strategy cut to the source's language.

    A source without language takes the strategy as it is, one in a language other than zh and en none. Both sides are
    configuration, so one is broadcast if Spark finds it small.
    """
    s = sources.where("archived = 0 and active = 1").select(F.col("id").alias("rss_source_id"), "url_template", F.when(F.col("crawler_enabled") == 1, "crawler").otherwise(F.col("mode")).alias("mode"), "language", "country", "site_domain")
    k = keywords.where("archived = 0 and active = 1").select(F.col("id").alias("keyword_id"), "category_id", "match_terms", "context_terms", "exclude_terms", "lookback_days", "require_local_match")
    tag = F.lower(F.element_at(F.split(F.trim(F.coalesce("language", F.lit(""))), "-"), 1))
    slices = {c: F.when(tag == "", F.col(c)).otherwise(text.terms_for(F.col(c), tag)) for c in ("match_terms", "context_terms", "exclude_terms")}
    pairs = s.crossJoin(k).where(tag.isin("", "zh", "en")).withColumns(slices)
    return pairs.where(F.size("match_terms") > 0)


def windows(tasks: DataFrame, cursors: DataFrame, now: Column, settings: CollectSettings) -> DataFrame:
    """Tasks with window_start, the cursor's or the lookback's, and the query of a search that asks far enough back."""
    first = dates.lookback_start(now, settings.timezone, F.col("lookback_days"))
    t = tasks.join(cursors.select("rss_source_id", "keyword_id", "last_collected_at"), ["rss_source_id", "keyword_id"], "left")
    t = t.withColumn("window_start", dates.window_start(F.col("last_collected_at"), first, settings.incremental)).drop("last_collected_at")
    days = dates.runtime_lookback(F.col("lookback_days"), F.col("window_start"), now)
    t = t.withColumn("query", text.search_expression(F.col("match_terms"), F.col("context_terms"), F.col("exclude_terms"), days))
    return t.withColumn("feed_url", urls.feed_url(F.col("url_template"), F.col("mode"), F.col("query"), F.col("site_domain")))


def run_window_start(sources: DataFrame, keywords: DataFrame, cursors: DataFrame, now: Column, settings: CollectSettings = CollectSettings()) -> DataFrame:
    """One row: the earliest start of all windows."""
    first = dates.lookback_start(now, settings.timezone, F.col("lookback_days"))
    pairs = sources.where("archived = 0 and active = 1").select(F.col("id").alias("rss_source_id")).crossJoin(keywords.where("archived = 0 and active = 1").select(F.col("id").alias("keyword_id"), "lookback_days"))
    pairs = pairs.join(cursors, ["rss_source_id", "keyword_id"], "left")
    return pairs.agg(F.coalesce(F.min(dates.window_start(F.col("last_collected_at"), first, settings.incremental)), now).alias("window_start"))


#: Columns of an item that no judgement needs: they stay where they are until it has matched.
TEXTS = ("title", "url", "publisher", "summary", "guid", "categories")


def scanned(items: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """Items, written once, with a number _item and the folded match terms that each holds (_held). A text is read once, by
    an automaton of the terms of all tasks, and only if it lies within a window of one of its source's; of the others, which
    cannot match, the TEXTS are left behind. Sources are many times fewer than items: their windows are written first, so Spark knows
    their size and broadcasts them, and no task gets all texts of a source."""
    windows_of = tasks.groupBy("rss_source_id").agg(F.min("window_start").alias("_from"), F.bool_or(F.col("window_start").isNull()).alias("_open"))
    rows = items.join(cut(windows_of), "rss_source_id", "left").withColumn("_item", F.monotonically_increasing_id())
    due = F.coalesce(F.col("published_at").between(F.col("_from"), now), F.lit(False))
    known = tasks.select(F.explode(terms.folded_terms("match_terms")).alias("term"))
    rows = terms.with_terms(rows, F.when(due, F.col("title")), F.when(due, F.col("summary")), known, "_held")
    rows = rows.withColumns({c: F.when(due | F.coalesce("_open", F.lit(False)), F.col(c)) for c in TEXTS if c in items.columns})
    return cut(rows.drop("_from", "_open"))


def judged(items: DataFrame, tasks: DataFrame, now: Column, local_filter: bool) -> DataFrame:
    """Items by task with matched_terms and outcome: undated, outside, unmatched or matched; TEXTS are left out. Items of direct sources
    (keyword_id null) meet every task of the source, those of searches their own. The window is closed at both ends."""
    items = items if "_held" in items.columns else scanned(items, tasks, now)
    narrow = items.drop(*(c for c in TEXTS if c not in tasks.columns))
    tasks = cut(tasks.withColumn("_folded", terms.folded_terms("match_terms")))  # of known size, so that few pairs are broadcast
    own = narrow.where("keyword_id is not null").join(tasks, ["rss_source_id", "keyword_id"])
    shared = narrow.where("keyword_id is null").drop("keyword_id").join(tasks, "rss_source_id")
    both = own.unionByName(shared.select(*own.columns))
    both = both.withColumn("matched_terms", terms.terms_in(F.col("match_terms"), F.col("_folded"), F.col("_held"))).drop("_folded", "_held")
    must = F.lit(True) if local_filter else F.col("require_local_match") == 1
    outcome = F.when(F.col("published_at").isNull(), "undated").when(~F.col("published_at").between(F.col("window_start"), now), "outside").when(must & (F.size("matched_terms") == 0), "unmatched").otherwise("matched")
    return both.withColumn("outcome", outcome)


def with_texts(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Judged rows with the TEXTS of their items."""
    return rows.join(items.select("_item", *(c for c in TEXTS if c in items.columns)), "_item").drop("_item")


def with_keys(items: DataFrame) -> DataFrame:
    """Items with canonical_url, publisher_normalized and fingerprint."""
    items = items.withColumn("canonical_url", urls.canonical_url(F.col("url"))).withColumn("publisher_normalized", text.publisher_key("publisher"))
    return items.withColumn("fingerprint", text.fingerprint(text.folded_title("title"), text.casefold("publisher_normalized"), F.col("published_at")))


def arrivals(matched: DataFrame) -> DataFrame:
    """Matches with seq, the order in which they arrive: source, strategy, place in the feed. The sort is by range, so no
    task holds all rows."""
    ordered = matched.withColumn("_order", F.struct("rss_source_id", "keyword_order", "keyword_id", "position"))
    return merge.next_ids(matched.sparkSession.createDataFrame([], "id long"), ordered, "_order").withColumnRenamed("id", "seq").drop("_order")


def merged_articles(articles: DataFrame, resolved: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(articles that are new or were met, matches with their article_id and inserted): new articles from leaders; of each article's later
    items a strictly longer summary replaces and a publisher fills a blank one, in order of arrival."""
    new = resolved.where("article_id is null and leader = seq").select("seq", "title", "url", "canonical_url", "fingerprint", "published_at", "rss_source_id")
    new = cut(merge.next_ids(articles, new, "seq"))
    numbered = resolved.join(new.select(F.col("seq").alias("leader"), F.col("id").alias("_new")), "leader", "left")
    numbered = numbered.withColumn("article_id", F.coalesce("article_id", "_new")).withColumn("inserted", F.col("_new").isNotNull() & (F.col("leader") == F.col("seq"))).drop("_new")
    numbered = cut(numbered)
    touched = numbered.select("article_id").distinct()
    met = articles.join(touched, articles["id"] == touched["article_id"], "left_semi")
    # the longest summary, the first of equally long ones; stored rows come before all
    old = met.select(F.col("id").alias("article_id"), F.lit(-1).cast("long").alias("seq"), "summary", "publisher", "publisher_normalized")
    told = old.unionByName(numbered.select("article_id", "seq", "summary", "publisher", "publisher_normalized"))
    first = lambda c: F.coalesce(F.min_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))), F.lit("")).alias(c)
    best = told.groupBy("article_id").agg(F.max_by(F.coalesce("summary", F.lit("")), F.struct(F.length(F.coalesce("summary", F.lit(""))), -F.col("seq"))).alias("summary"), first("publisher"), first("publisher_normalized"))
    base = met.drop("summary", "publisher", "publisher_normalized").unionByName(new.drop("seq").withColumn("collected_at", now.cast("timestamp")))
    return base.join(best, base["id"] == best["article_id"]).drop("article_id").select(*SCHEMAS["articles"].names), numbered


def counters(judged_items: DataFrame, numbered: DataFrame, tasks: DataFrame, seen: DataFrame) -> DataFrame:
    """A row for each task: items seen, matched, inserted, duplicates, outside the window, undated."""
    keys = ["rss_source_id", "keyword_id"]
    a = judged_items.groupBy(*keys).agg(F.count_if(F.col("outcome") == "matched").alias("items_matched"), F.count_if(F.col("outcome") == "outside").alias("skipped_outside_window"), F.count_if(F.col("outcome") == "undated").alias("skipped_without_date"))
    b = numbered.groupBy(*keys).agg(F.count_if("inserted").alias("items_inserted"), F.count_if(~F.col("inserted")).alias("duplicates"))
    out = tasks.select(*keys, "window_start", "feed_url").join(a, keys, "left").join(b, keys, "left").join(seen, keys, "left")
    return out.na.fill(0, ["items_matched", "skipped_outside_window", "skipped_without_date", "items_inserted", "duplicates", "items_seen"])


def collect(tables: Tables, items: DataFrame, now: Column, run_id: int, failures: DataFrame | None = None, settings: CollectSettings = CollectSettings()) -> Tables:
    """The tables after a run: what changes() says in place of the rows of the same keys."""
    made = changes(tables, items, now, run_id, failures, settings)
    return dict(tables) | {name: merge.replaced(tables[name], rows, KEYS[name]) for name, rows in made.items()}


def changes(tables: Tables, items: DataFrame, now: Column, run_id: int, failures: DataFrame | None = None, settings: CollectSettings = CollectSettings()) -> Tables:
    """The rows that a run writes, by table, one for each key.

    items: (rss_source_id, keyword_id or null for sources that are read once, position, item fields).
    failures: (rss_source_id, keyword_id or null for all of a source, error).
    """
    tasks = windows(route(tables["rss_sources"], tables["keywords"]), tables["collection_cursors"], now, settings)
    order = tables["keywords"].join(tables["keyword_categories"].select(F.col("id").alias("category_id"), "sort_order"), "category_id", "left").select(F.col("id").alias("keyword_id"), F.coalesce("sort_order", F.lit(999999)).alias("keyword_order"))
    tasks = cut(tasks.join(order, "keyword_id"))
    keys = ["rss_source_id", "keyword_id"]
    none = items.sparkSession.createDataFrame([], "rss_source_id long, keyword_id long, error string")
    failures = failures if failures is not None else none
    bad = tasks.select(*keys).join(failures.where("keyword_id is null").select("rss_source_id", "error"), "rss_source_id").unionByName(tasks.select(*keys).join(failures.where("keyword_id is not null"), keys)).groupBy(*keys).agg(F.min("error").alias("error"))
    good = tasks.join(bad, keys, "left_anti")
    read = scanned(items, good, now)
    seen_items = judged(read, good, now, settings.local_filter)
    matched = with_keys(with_texts(seen_items.where("outcome = 'matched'"), read))
    matched = cut(arrivals(matched))
    resolved = dedup.resolve(matched, tables["articles"])
    articles, numbered = merged_articles(tables["articles"], resolved, now)

    sightings = numbered.select("article_id", "rss_source_id", "feed_url", F.col("url").alias("observed_url"), "canonical_url", "guid", "language", "country", "categories", now.cast("timestamp").alias("seen_at"), "seq")
    relations = merge.latest(numbered.select("article_id", "keyword_id", "matched_terms", "seq"), ["article_id", "keyword_id"], ["seq"]).drop("seq")
    # what is counted is read from the numbered items, which lie in columns: a micro-batch would be read anew with all its texts
    per_source = read.groupBy("rss_source_id", F.col("keyword_id").alias("_k")).agg(F.count(F.lit(1)).alias("items_seen"))
    seen = good.select(*keys).join(per_source, "rss_source_id").where("_k is null or _k = keyword_id").groupBy(*keys).agg(F.sum("items_seen").alias("items_seen"))
    stats = cut(counters(seen_items, numbered, good, seen))
    details = stats.select(F.lit(run_id).cast("long").alias("run_id"), *keys, F.lit("success").alias("status"), "window_start", now.cast("timestamp").alias("window_end"), "feed_url", "items_seen", "items_matched", "items_inserted", "duplicates", "skipped_outside_window", "skipped_without_date", F.lit("").alias("error_message"))
    zero = {c: F.lit(0).cast("long") for c in ("items_seen", "items_matched", "items_inserted", "duplicates", "skipped_outside_window", "skipped_without_date")}
    lost = tasks.join(bad, keys).select(F.lit(run_id).cast("long").alias("run_id"), *keys, F.lit("failed").alias("status"), "window_start", now.cast("timestamp").alias("window_end"), "feed_url", *[v.alias(k) for k, v in zero.items()], F.substring("error", 1, 2000).alias("error_message"))
    details = details.unionByName(lost)

    # a run counts the items of a source that is read once once, though each of its tasks saw them all
    total_seen = read.join(good.select("rss_source_id").distinct(), "rss_source_id", "left_semi").agg(F.count(F.lit(1)).alias("items_seen"))
    totals = details.agg(F.count(F.lit(1)).cast("int").alias("tasks_total"), F.count_if(F.col("status") == "success").cast("int").alias("tasks_succeeded"), F.count_if(F.col("status") == "failed").cast("int").alias("tasks_failed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items_matched", "items_inserted", "duplicates")], F.min("window_start").alias("window_start")).crossJoin(total_seen)
    status = rules.run_status(F.col("tasks_failed"), F.col("tasks_succeeded"), F.lit(0))
    run = totals.withColumns({"id": F.lit(run_id).cast("long"), "status": status, "started_at": now.cast("timestamp"), "finished_at": F.lit(None).cast("timestamp"), "message": F.lit("")}).select(*SCHEMAS["collection_runs"].names)
    return {
        "articles": articles,
        "article_sources": merge.sighted(tables["article_sources"], sightings),
        "article_keywords": relations,
        "collection_run_details": details,
        "collection_runs": run,
        "collection_cursors": merge.moved_cursors(good, now),
    }


def crawler_health(sources: DataFrame, outcomes: DataFrame, now: Column, setting_minutes: int = 60) -> DataFrame:
    """Sources after crawler outcomes (rss_source_id, kind or null for success, explicit_seconds, message): success
    resets, a failure counts, rests and leaves its message; kinds that are not recorded change nothing."""
    o = outcomes.select(F.col("rss_source_id").alias("id"), "kind", "explicit_seconds", F.col("message").alias("_message"), F.lit(True).alias("_seen"))
    s = sources.join(o, "id", "left")
    good = F.col("_seen").isNotNull() & F.col("kind").isNull()
    bad = F.col("kind").isNotNull() & ~F.col("kind").isin(*rules.UNRECORDED)
    rest = rules.cooldown_seconds(F.col("kind"), F.col("explicit_seconds"), F.lit(60 * setting_minutes))
    return s.withColumns({
        "crawler_failures": F.when(good, 0).when(bad, F.col("crawler_failures") + 1).otherwise(F.col("crawler_failures")),
        "crawler_cooldown_until": F.when(good, None).when(bad, dates.later(now, seconds=rest)).otherwise(F.col("crawler_cooldown_until")),
        "crawler_last_status": F.when(good, "success").when(bad, F.col("kind")).otherwise(F.col("crawler_last_status")),
        "crawler_last_message": F.when(good, "").when(bad, F.substring("_message", 1, 2000)).otherwise(F.col("crawler_last_message")),
    }).select(*sources.columns)
