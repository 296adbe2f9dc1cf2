"""Cleanup of collected data by scope: preview, guarded execution, cascades."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates, rules
from quillstream.operators import merge
from quillstream.operators.enrich import star
from quillstream.sources.tables import Tables

SCOPES = ("all_collected", "failed_records", "history")
CLEANED = ("articles", "collection_runs", "ai_analysis_runs", "daily_reports")


def doomed(t: Tables, scope: str, before: str | None = None) -> dict[str, DataFrame]:
    """Ids to delete of each table. history ends at the UTC midnight that begins the day, and spares runs in progress."""
    if scope not in SCOPES:
        raise ValueError("unknown scope")
    if before:
        before = date.fromisoformat(before).isoformat()
    if scope == "history" and not before:
        raise ValueError("history needs a day")
    everything = F.lit(True)
    ended = F.col("status").isin("partial", "failed", "interrupted")
    if scope == "all_collected":
        where: dict[str, Column] = dict.fromkeys(CLEANED, everything)
    elif scope == "failed_records":
        where = {"collection_runs": ended, "ai_analysis_runs": ended, "daily_reports": F.col("status").isin("failed", "interrupted")}
    else:
        at = dates.at(f"{before} 00:00:00")
        old = (F.col("status") != "running") & (F.col("started_at") < at)
        where = {"articles": F.col("published_at") < at, "collection_runs": old, "ai_analysis_runs": old, "daily_reports": F.col("report_date") < F.lit(before).cast("date")}
    out = {name: t[name].where(c).select("id") for name, c in where.items()}
    if scope == "failed_records":
        out["articles"] = t["articles"].join(t["article_contents"].where("status = 'failed'"), F.col("id") == F.col("article_id"), "left_semi").select("id")
    return out


def preview(t: Tables, scope: str, before: str | None = None) -> DataFrame:
    """One row: how many rows of each table would go, and in all."""
    counts = None
    for name, ids in doomed(t, scope, before).items():
        one = ids.agg(F.count(F.lit(1)).alias(name))
        counts = one if counts is None else counts.crossJoin(one)
    total = F.lit(0)
    for name in CLEANED:
        total = total + F.col(name)
    return counts.select(F.lit(scope).alias("scope"), F.lit(before).cast("string").alias("before"), *CLEANED, total.alias("total_records"))


def execute(t: Tables, scope: str, confirmation: str, before: str | None = None, busy: Callable[[], bool] = lambda: False, snapshot: Callable[[Tables], str] | None = None) -> tuple[Tables, str | None]:
    """(tables without the scope's rows and what hangs on them, the snapshot's path). The word DELETE confirms; nothing
    happens while a job runs; a snapshot is taken only if something would go."""
    if confirmation != "DELETE":
        raise ValueError("the word DELETE confirms a cleanup")
    if busy():
        raise RuntimeError("a job is running")
    if not preview(t, scope, before).first()["total_records"]:
        return t, None
    path = snapshot(t) if snapshot else None
    for name, ids in reversed(list(doomed(t, scope, before).items())):
        t = merge.deleted(t, name, ids)
    return t, path


def purge_pending(t: Tables, now: Column) -> Tables:
    """Tables without the articles that await work."""
    return merge.deleted(t, "articles", star(t).where(rules.is_candidate(now)).select(F.col("a.id").alias("id")))
