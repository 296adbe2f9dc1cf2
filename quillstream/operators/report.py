"""Daily reports: input, assembly with a risk floor and citation check, detail, and older shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates, rules, text, urls
from quillstream.sources.tables import DETAILS, Tables

_STRINGS = "array<string>"


def accepted(t: Tables) -> DataFrame:
    """Analyses that hold: successful, and of the content that is there now."""
    ba, ic, a = t["business_articles"].alias("ba"), t["article_contents"].alias("ic"), t["articles"].alias("a")
    rows = ba.join(ic, (F.col("ba.article_id") == F.col("ic.article_id")) & (F.col("ba.content_hash") == F.col("ic.content_hash"))).join(a, F.col("a.id") == F.col("ba.article_id"))
    rows = rows.where("ba.analysis_status = 'success' and ic.status = 'success'")
    return rows.select("ba.*", "a.title", "a.url", "a.publisher", "a.published_at", "a.collected_at", "ic.final_url", "ic.content_chars", "ic.fetched_at")


def matched_names(t: Tables) -> DataFrame:
    """(article_id, matched_keyword_names): names in order, as an array, so that commas in them do no harm."""
    k = t["keywords"].select(F.col("id").alias("keyword_id"), "name")
    return t["article_keywords"].join(k, "keyword_id").groupBy("article_id").agg(F.sort_array(F.collect_set("name")).alias("matched_keyword_names"))


def of_day(t: Tables, day: str) -> DataFrame:
    """Accepted articles published on a local day."""
    start, end = dates.day_window(day)
    return accepted(t).where((F.col("published_at") >= F.lit(start)) & (F.col("published_at") < F.lit(end)))


def report_input(t: Tables, day: str) -> DataFrame:
    """Accepted articles of a day with the names they matched, the riskiest first, then the newest."""
    return of_day(t, day).join(matched_names(t), "article_id", "left").orderBy(F.desc("risk_score"), F.desc("published_at"), "article_id")


def assembled(inputs: DataFrame, response: DataFrame) -> DataFrame:
    """A report from the model's response (title, overview, risk_score, details): the risk is at least that of the riskiest
    article, details keep citations of the day's articles only, and those without any go. The ids of a day's accepted articles are one
    array: as many as a reader of the report could look at, thousands, not millions."""
    known = inputs.agg(F.max("risk_score").alias("floor"), F.sort_array(F.collect_set("article_id")).alias("allowed"), F.count(F.lit(1)).cast("int").alias("article_count"))
    score = F.greatest(F.col("risk_score"), F.coalesce("floor", F.lit(0)))
    details = rules.cited_details(F.col("details").cast(DETAILS), F.col("allowed"))
    return response.crossJoin(known).select("title", "overview", score.alias("risk_score"), rules.risk_level(score).alias("risk_level"), details.alias("details"), "article_count")


def cited(report: DataFrame) -> DataFrame:
    """(report_id, article_id) of a report's details."""
    return report.select(F.col("id").alias("report_id"), F.explode("details").alias("d")).select("report_id", F.explode("d.article_ids").alias("article_id")).distinct()


def report_detail(t: Tables, report_id: int) -> DataFrame:
    """The report with its cited articles, the riskiest first, as an array of structs."""
    r = t["daily_reports"].where(F.col("id") == report_id)
    links = t["daily_report_articles"].where(F.col("report_id") == report_id)
    a = t["articles"].select(F.col("id").alias("article_id"), "title", "url", "publisher", "published_at")
    ba = t["business_articles"].select("article_id", F.col("risk_score").alias("risk"), "category")
    names = matched_names(t).select("article_id", "matched_keyword_names")
    rows = links.join(a, "article_id").join(ba, "article_id", "left").join(names, "article_id", "left")
    item = F.struct((-F.coalesce("risk", F.lit(-1))).alias("order"), (-F.unix_micros("published_at")).alias("then"), "article_id", F.col("title"), "url", "publisher", "published_at", "risk", "category", F.coalesce("matched_keyword_names", F.array().cast(_STRINGS)).alias("keywords"))
    nested = rows.groupBy("report_id").agg(F.sort_array(F.collect_list(item)).alias("s")).select("report_id", F.transform("s", lambda x: x.dropFields("order", "then")).alias("sources"))
    return r.join(nested, r["id"] == nested["report_id"], "left").drop("report_id")


def from_legacy(executive: Column, developments: Column) -> Column:
    """Details of an old report: one for each development, and its summary if there is none."""
    each = F.transform(developments, lambda d: F.struct(F.coalesce(F.nullif(d["title"], F.lit("")), text.short_title(d["finding"])).alias("title"), F.concat_ws(" ", d["finding"], d["business_impact"]).alias("content"), F.array(d["article_id"].cast("bigint")).alias("article_ids")))
    lone = F.array(F.struct(text.short_title(executive).alias("title"), executive.alias("content"), F.array().cast("array<bigint>").alias("article_ids")))
    return F.when(F.size(developments) > 0, each).otherwise(lone).cast(DETAILS)


def evidence(t: Tables) -> DataFrame:
    """(article_id, urls) to read an article from: its own and where it was seen, an aggregator's last."""
    seen = t["article_sources"].groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("first_seen_at", "observed_url"))).alias("s"))
    rows = t["articles"].select(F.col("id").alias("article_id"), "url").join(seen, "article_id", "left")
    found = F.concat(F.array("url"), F.coalesce(F.transform("s", lambda x: x["observed_url"]), F.array().cast(_STRINGS)))
    return rows.select("article_id", urls.evidence_urls(found).alias("urls"))


def interrupted(reports: DataFrame, day: str) -> Column:
    """Whether the day has no successful report yet."""
    return F.count_if((F.col("report_date") == F.lit(day).cast("date")) & (F.col("status") == "success")) == 0
