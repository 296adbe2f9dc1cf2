"""The engine's questions as functions from tables to frames; nothing is collected inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates, rules
from quillstream.operators import enrich, report
from quillstream.operators.config import checked_category, checked_days, page
from quillstream.sources.tables import Tables

COUNTS = ("hit_count", "reviewed_count", "business_relevant_count", "relevant_count")


def with_rates(df: DataFrame) -> DataFrame:
    """pending_review_count, and hit_rate: relevant by reviewed, null where nothing was reviewed."""
    return df.withColumns({"pending_review_count": F.greatest(F.lit(0), F.col("hit_count") - F.col("reviewed_count")), "hit_rate": rules.rate(F.col("relevant_count"), F.col("reviewed_count"))})


def hits(t: Tables, named: dict[str, str] | None = None, new_versions: tuple[str, ...] = ()) -> DataFrame:
    """A row for each (keyword, article) with flags, once; keywords without hits have a null article."""
    k = t["keywords"].where("archived = 0").alias("k")
    c = t["keyword_categories"].alias("c")
    ak = t["article_keywords"].select("article_id", "keyword_id").alias("ak")  # its key; what repeats counts once below
    rows = k.join(c, F.col("k.category_id") == F.col("c.id"), "left").join(ak, F.col("ak.keyword_id") == F.col("k.id"), "left").join(t["article_relevance_reviews"].alias("rr"), F.col("rr.article_id") == F.col("ak.article_id"), "left")
    reviewed = F.col("rr.status") == "success"
    relevant = rules.category_relevant(named or {}, new_versions, F.col("c.name"))
    return rows.select(
        F.col("k.id").alias("keyword_id"), F.col("k.name").alias("keyword_name"), F.col("k.active").alias("active"), F.col("k.category_id").alias("category_id"), F.col("c.name").alias("category_name"), F.col("c.sort_order").alias("sort_order"), F.col("c.active").alias("category_active"),
        F.col("ak.article_id").alias("article_id"), F.coalesce(reviewed, F.lit(False)).alias("reviewed"), F.coalesce(reviewed & (F.col("rr.is_relevant") == 1), F.lit(False)).alias("business"), F.coalesce(relevant, F.lit(False)).alias("relevant"),
    )


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of distinct articles: one row for each (group, article) first, then plain conditional counts. The first
    step combines before its shuffle, and no row is expanded for several distinct counts."""
    flags = rows.groupBy(*by, "article_id").agg(*[F.max(c).alias(c) for c in ("reviewed", "business", "relevant")])
    real = F.col("article_id").isNotNull()
    out = [F.count_if(real).alias("hit_count"), *[F.count_if(real & F.col(c)).alias(n) for c, n in (("reviewed", "reviewed_count"), ("business", "business_relevant_count"), ("relevant", "relevant_count"))]]
    return flags.groupBy(*by).agg(*out) if by else flags.agg(*out)


def keyword_hit_stats(t: Tables, **rule) -> DataFrame:
    """Each keyword that is not archived, inactive ones too."""
    by = ("keyword_id", "keyword_name", "active", "category_id", "category_name", "sort_order")
    return with_rates(counted(hits(t, **rule), *by)).orderBy(F.coalesce("sort_order", F.lit(999999)), "keyword_id").drop("sort_order")


def category_hit_stats(t: Tables, **rule) -> DataFrame:
    """Each active category, and one row for active keywords without one; articles that several keywords hit count once."""
    rows = hits(t, **rule).where("active = 1")
    keys = t["keywords"].where("archived = 0 and active = 1").groupBy("category_id").agg(F.count_distinct("id").alias("keyword_count"))
    own = counted(rows, "category_id").withColumnRenamed("category_id", "_c").join(keys.withColumnRenamed("category_id", "_k"), F.expr("_c <=> _k"), "left").drop("_k")
    named = t["keyword_categories"].where("active = 1").select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), "sort_order")
    spark = named.sparkSession
    every = named.unionByName(spark.createDataFrame([(None, None, 999999)], named.schema))
    out = every.join(own, F.expr("category_id <=> _c"), "left").drop("_c").na.fill(0, ["keyword_count", *COUNTS])
    return with_rates(out).orderBy("sort_order", "category_id").drop("sort_order")


def overall_hit_rate(t: Tables, **rule) -> DataFrame:
    rows = hits(t, **rule).where("active = 1")
    keys = t["keywords"].where("archived = 0 and active = 1").agg(F.count_distinct("id").alias("keyword_count"))
    return with_rates(counted(rows).crossJoin(keys))


def funnel_cells() -> dict[str, Column]:
    """The cells of the funnel that an article's own rows of the star decide, whatever the time."""
    ok, failed = F.col("ic.status") == "success", F.col("ic.status") == "failed"
    fresh = lambda alias: F.col(f"{alias}.content_hash") == F.col("ic.content_hash")
    reviewed = ok & (F.col("rr.status") == "success") & fresh("rr")
    return {
        "total": F.lit(True), "content_ready": ok, "content_failed": failed,
        "content_final_failed": failed & (F.col("ic.is_terminal") == 1) & F.col("ic.ignored_at").isNull(), "content_ignored": failed & F.col("ic.ignored_at").isNotNull(),
        "relevant": reviewed & (F.col("rr.is_relevant") == 1), "irrelevant": reviewed & (F.col("rr.is_relevant") == 0), "review_failed": ok & (F.col("rr.status") == "failed") & fresh("rr"),
        "analyzed": ok & (F.col("ba.analysis_status") == "success") & fresh("ba"), "analysis_failed": ok & (F.col("ba.analysis_status") == "failed") & fresh("ba"),
    }


def funnel(t: Tables, now: Column) -> DataFrame:
    """One row: how many articles are where in the pipeline, in one pass over the star."""
    cells = funnel_cells()
    waiting = (F.col("ic.status") == "failed") & (F.col("ic.is_terminal") == 0) & F.col("ic.ignored_at").isNull() & (F.col("ic.next_retry_at") > now)
    order = ("total", "pending", "content_ready", "content_failed", "content_retry_waiting", *(c for c in cells if c not in ("total", "content_ready", "content_failed")))
    of = cells | {"pending": rules.is_candidate(now), "content_retry_waiting": waiting}
    out = enrich.star(t).agg(*[F.count_if(of[name]).alias(name) for name in order])
    return out.withColumn("failed", F.col("content_failed") + F.col("review_failed") + F.col("analysis_failed"))


def search(t: Tables, q: str = "", keyword_id: int | None = None, source_id: int | None = None, language: str = "", country: str = "", run_id: int | None = None, day_from: str | None = None, day_to: str | None = None, limit: int = 50, offset: int = 0, count: bool = False) -> DataFrame:
    """Articles, newest first, with where they were seen and what they matched; or how many there are. The text is sought in
    title, summary, publisher and URL, and its % and _ stay wildcards."""
    limit, offset = page(limit, offset)
    checked_days(day_from, day_to)
    a = t["articles"]
    conditions: list[Column] = []
    if q:
        any_of = F.lit(False)
        for c in ("title", "summary", "publisher", "url"):
            any_of = any_of | F.col(c).ilike(f"%{q}%")
        conditions.append(any_of)
    if day_from:
        start, end = dates.day_window(day_from, day_to)
        conditions += [F.col("published_at") >= F.lit(start), F.col("published_at") < F.lit(end)]
    for c in conditions:
        a = a.where(c)
    if run_id is not None:
        a = a.join(t["collection_runs"].where(F.col("id") == run_id).select(F.col("started_at").alias("_at")), F.col("collected_at") == F.col("_at"), "left_semi")
    if keyword_id is not None:
        a = a.join(t["article_keywords"].where(F.col("keyword_id") == keyword_id), F.col("id") == F.col("article_id"), "left_semi")
    seen = t["article_sources"]
    for column, value in (("rss_source_id", source_id), ("language", language), ("country", country)):
        if value not in (None, ""):
            a = a.join(seen.where(F.col(column) == value), a["id"] == seen["article_id"], "left_semi")
    if count:
        return a.agg(F.count(F.lit(1)).alias("total"))
    a = a.orderBy(F.desc("published_at"), F.desc("id")).offset(offset).limit(limit)
    # only the children of the page's articles, at most 200, are grouped
    ids = F.broadcast(a.select(F.col("id").alias("article_id")))
    few = {name: t[name].join(ids, "article_id", "left_semi") for name in ("article_sources", "article_keywords")}
    return with_children(a, {**t, **few}).orderBy(F.desc("published_at"), F.desc("id"))


def with_children(a: DataFrame, t: Tables) -> DataFrame:
    """Articles with arrays: sources in order of first sight, keywords by name, and the distinct languages, countries and
    categories in that order."""
    names = t["rss_sources"].select(F.col("id").alias("rss_source_id"), F.col("name").alias("source_name"))
    s = t["article_sources"].join(names, "rss_source_id", "left")
    s = s.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("first_seen_at", "rss_source_id", "canonical_url", "source_name", "observed_url", "language", "country", "categories"))).alias("sources"))
    k = t["article_keywords"].join(t["keywords"].select(F.col("id").alias("keyword_id"), "name"), "keyword_id").groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("name", "keyword_id", "matched_terms"))).alias("keywords"))
    out = a.join(s, a["id"] == s["article_id"], "left").drop("article_id")
    out = out.join(k, out["id"] == k["article_id"], "left").drop("article_id")
    told = lambda f: F.array_distinct(F.filter(F.transform("sources", lambda x: x[f]), lambda v: F.coalesce(v, F.lit("")) != ""))
    return out.withColumns({"languages": told("language"), "countries": told("country"), "all_categories": F.array_distinct(F.flatten(F.transform("sources", lambda x: x["categories"])))})


def collection_run(t: Tables, run_id: int) -> DataFrame:
    d = t["collection_run_details"].where(F.col("run_id") == run_id)
    s = t["rss_sources"].select(F.col("id").alias("rss_source_id"), F.col("name").alias("source_name"))
    k = t["keywords"].select(F.col("id").alias("keyword_id"), F.col("name").alias("keyword_name"))
    return d.join(s, "rss_source_id").join(k, "keyword_id").orderBy("rss_source_id", "keyword_id")


def analysis_run(t: Tables, run_id: int) -> DataFrame:
    i = t["ai_analysis_run_items"].where(F.col("run_id") == run_id).alias("i")
    rows = i.join(t["articles"].alias("a"), F.col("a.id") == F.col("i.article_id"))
    for name, alias in (("article_contents", "ic"), ("article_relevance_reviews", "rr"), ("business_articles", "ba")):
        rows = rows.join(t[name].alias(alias), F.col(f"{alias}.article_id") == F.col("i.article_id"), "left")
    return rows.select("i.*", "a.title", "a.url", "ic.final_url", "ic.failure_kind", "rr.relevance_score", "rr.category", "ba.risk_score").orderBy("article_id")


def content_failures(t: Tables, now: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    limit, offset = page(limit, offset)
    c, a = t["article_contents"].where("status = 'failed'"), t["articles"].select(F.col("id").alias("article_id"), "title", "url", "publisher", "published_at")
    rows = c.join(a, "article_id").withColumn("disposition", rules.disposition(now, F.col("ignored_at"), F.col("is_terminal"), F.col("next_retry_at")))
    return rows.orderBy(rules.failure_rank(F.col("ignored_at"), F.col("is_terminal")), F.desc("fetched_at"), F.desc("article_id")).offset(offset).limit(limit)


def reviews(t: Tables, relevant: bool | None = None, day_from: str | None = None, day_to: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Reviews that hold, the latest first."""
    limit, offset = page(limit, offset)
    checked_days(day_from, day_to)
    c = t["article_contents"].where("status = 'success'").select("article_id", "content_hash", "final_url", "content_chars", "fetched_at")
    rows = t["article_relevance_reviews"].where("status = 'success'").join(c, ["article_id", "content_hash"]).join(t["articles"].select(F.col("id").alias("article_id"), "title", "url", "publisher", "published_at"), "article_id")
    if relevant is not None:
        rows = rows.where(F.col("is_relevant") == int(relevant))
    return _days(rows, day_from, day_to).orderBy(F.desc("reviewed_at"), F.desc("article_id")).offset(offset).limit(limit)


def business_articles(t: Tables, category: str = "", day_from: str | None = None, day_to: str | None = None, limit: int = 50, offset: int = 0, codes: tuple[str, ...] = ()) -> DataFrame:
    """Accepted articles, the newest first; a category must be one of the codes, if these are given."""
    limit, offset = page(limit, offset)
    checked_category(category, codes)
    checked_days(day_from, day_to)
    rows = report.accepted(t)
    if category:
        rows = rows.where(F.col("category") == category)
    return _days(rows, day_from, day_to).orderBy(F.desc("published_at"), F.desc("article_id")).offset(offset).limit(limit)


def _days(rows: DataFrame, day_from: str | None, day_to: str | None) -> DataFrame:
    if not day_from:
        return rows
    start, end = dates.day_window(day_from, day_to)
    return rows.where((F.col("published_at") >= F.lit(start)) & (F.col("published_at") < F.lit(end)))


def article_for_analysis(t: Tables, article_id: int) -> DataFrame:
    """One article with its content, its children and the URLs to read it from."""
    a = t["articles"].where(F.col("id") == article_id)
    c = t["article_contents"].select(F.col("article_id").alias("_c"), "full_text", "content_hash", F.col("status").alias("content_status"))
    e = report.evidence(t).select(F.col("article_id").alias("_e"), "urls")
    return with_children(a, t).join(c, F.col("id") == F.col("_c"), "left").join(e, F.col("id") == F.col("_e"), "left").drop("_c", "_e")


def runs(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.orderBy(F.desc("id")).limit(limit)


def reports(t: Tables, limit: int = 30) -> DataFrame:
    return t["daily_reports"].orderBy(F.desc("report_date"), F.desc("id")).limit(limit)


def report_exists(t: Tables, day: str) -> DataFrame:
    return t["daily_reports"].agg((~report.interrupted(t["daily_reports"], day)).alias("done"))


def categories(t: Tables) -> DataFrame:
    return t["keyword_categories"].where("active = 1").orderBy(F.coalesce("sort_order", F.lit(999999)), "id")


def system_status(t: Tables, now: Column, schedule: str | None = None) -> DataFrame:
    """One row: counts, the latest collection run, and the next scheduled report."""
    counts = t["articles"].agg(F.count(F.lit(1)).alias("articles"))
    for name, where in (("rss_sources", "archived = 0 and active = 1"), ("keywords", "archived = 0 and active = 1")):
        counts = counts.crossJoin(t[name].where(where).agg(F.count(F.lit(1)).alias(name)))
    latest = t["collection_runs"].agg(F.max_by(F.struct("id", "status", "started_at"), "id").alias("latest_run"))
    return counts.crossJoin(latest).withColumn("next_report_at", dates.next_run_at(now, F.lit(schedule)))
