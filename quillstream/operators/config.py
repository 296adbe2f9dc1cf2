"""Configuration writes: sources, strategies and settings, with their checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from datetime import date
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import rules, text, urls
from quillstream.operators import merge
from quillstream.sources.tables import SCHEMAS, Tables

#: Changes of these invalidate a strategy's cursors and matches; its name, category and activity do not.
STRATEGY = ("match_terms", "context_terms", "exclude_terms", "lookback_days", "require_local_match")


@dataclass(frozen=True)
class Settings:
    """Typed settings. Each is stored as text; numbers outside their range are clamped, others take the default."""

    timezone: str = "Asia/Shanghai"
    incremental: bool = True
    crawler_enabled: bool = False
    local_filter: bool = True
    crawler_cooldown_minutes: int = 60
    ai_relevance_threshold: int = 70
    ai_batch_size: int = 20
    ai_parallelism: int = 4
    ai_content_max_chars: int = 30000
    report_time: str = "08:00"
    crawler_respect_robots: bool = True
    crawler_min_interval_seconds: int = 3
    business_profile: str = ""
    relevance_prompt: str = ""
    report_prompt: str = ""
    auto_analyze: bool = False
    auto_report: bool = False
    auto_push: bool = False

    #: Least characters of texts that are set, and the most.
    LENGTHS = {"business_profile": (50, 10000), "relevance_prompt": (20, 20000), "report_prompt": (20, 20000)}
    RANGES = {"crawler_cooldown_minutes": (5, 1440), "ai_relevance_threshold": (0, 100), "ai_batch_size": (1, 100), "ai_parallelism": (1, 20), "ai_content_max_chars": (2000, 100000), "crawler_min_interval_seconds": (0, 60)}

    @classmethod
    def read(cls, rows: dict[str, str]) -> Settings:
        out = {}
        for f in fields(cls):
            if f.name not in rows:
                continue
            value = rows[f.name]
            if f.type == "bool":
                out[f.name] = value == "true"
            elif f.type == "int":
                out[f.name] = rules.clamped(value, *cls.RANGES[f.name], f.default)
            else:
                out[f.name] = value
        return cls(**out)


def settings(df: DataFrame) -> Settings:
    """The settings table as a value; other keys than those of its fields stay where they are."""
    known = [f.name for f in fields(Settings)]
    return Settings.read({r["key"]: r["value"] for r in df.where(F.col("key").isin(known)).collect()})


def save_settings(t: Tables, changes: dict[str, object]) -> Tables:
    """Settings written after checks: what is read may be clamped, but what is written must be in its range. Booleans are
    stored as true and false, and texts trimmed."""
    kinds = {f.name: f.type for f in fields(Settings)}
    rows = []
    for name, value in changes.items():
        if name not in kinds:
            raise ValueError(f"no setting {name}")
        if kinds[name] == "bool":
            if not isinstance(value, bool):
                raise ValueError(f"{name} is true or false")
            value = str(value).lower()
        elif kinds[name] == "int":
            low, high = Settings.RANGES[name]
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        else:
            value = schedule(str(value)) if name == "report_time" else str(value).strip()
            low, high = Settings.LENGTHS.get(name, (1, 100))
            if not low <= len(value) <= high:
                raise ValueError(f"{name} must have {low} to {high} characters")
        rows.append((name, str(value), 1))
    new = t["app_settings"].sparkSession.createDataFrame(rows, "key string, value string, seq int")
    return t | {"app_settings": merge.upsert(t["app_settings"], new, ["key"])}


def checked_days(day_from: str | None, day_to: str | None) -> None:
    """ISO days, the last not before the first."""
    days = [date.fromisoformat(d) for d in (day_from, day_to) if d]
    if days != sorted(days):
        raise ValueError("the last day is before the first")


def checked_category(category: str, codes: tuple[str, ...]) -> None:
    if category and codes and category not in codes:
        raise ValueError("no such category")


def page(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200, offset not negative")
    return limit, offset


def checked_terms(terms: list[str], least: int = 0) -> list[str]:
    """Trimmed terms, distinct as they are spelled, at most 100."""
    out = list(dict.fromkeys(t.strip() for t in terms if t.strip()))
    if not least <= len(out) <= 100:
        raise ValueError(f"{least} to 100 terms")
    return out


def checked_source(name: str, url_template: str, mode: str, site_domain: str = "") -> str:
    """Checks a source; returns its domains joined by OR."""
    if not name.strip():
        raise ValueError("a source needs a name")
    if mode not in ("direct", "search", "crawler"):
        raise ValueError("unknown mode")
    if (mode == "search") != ("{query}" in url_template):
        raise ValueError("a search template has {query}, no other has")
    parts = urlsplit(url_template.replace("{query}", "keyword"))
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError("not an http(s) URL")
    domains = urls.site_domains(site_domain)
    if domains is None:
        raise ValueError("not a list of domains")
    return " OR ".join(domains)


def schedule(value: str) -> str:
    if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", value):
        raise ValueError("HH:MM")
    return value


def save_source(t: Tables, row: dict) -> Tables:
    """A source written: its domains normalised, its country inferred where none is given, crawler mode its own flag."""
    spark = t["rss_sources"].sparkSession
    row = row | {"site_domain": checked_source(row["name"], row["url_template"], row["mode"], row.get("site_domain") or ""), "crawler_enabled": int(row["mode"] == "crawler")}
    schema = SCHEMAS["rss_sources"]
    new = spark.createDataFrame([tuple(row.get(n, {"active": 1, "archived": 0, "crawler_failures": 0}.get(n)) for n in schema.names)], schema)
    new = new.withColumn("country", F.coalesce(F.nullif("country", F.lit("")), urls.country(F.col("url_template"), F.coalesce("language", F.lit("")))))
    return t | {"rss_sources": merge.upsert(t["rss_sources"], new.withColumn("seq", F.lit(1)), ["id"])}


def save_keyword(t: Tables, row: dict) -> Tables:
    """A strategy written with its expression. A category must be there. What was collected under another
    definition of it is invalid: its cursors and matches go."""
    spark = t["keywords"].sparkSession
    if row.get("category_id") is not None and not t["keyword_categories"].where((F.col("id") == row["category_id"]) & (F.col("active") == 1)).take(1):
        raise ValueError("no such category")
    row = row | {"match_terms": checked_terms(row["match_terms"], 1), "context_terms": checked_terms(row.get("context_terms") or []), "exclude_terms": checked_terms(row.get("exclude_terms") or [])}
    schema = SCHEMAS["keywords"]
    new = spark.createDataFrame([tuple(row.get(n, {"active": 1, "archived": 0, "lookback_days": 30, "require_local_match": 1}.get(n)) for n in schema.names)], schema)
    new = new.withColumn("query", text.search_expression(F.col("match_terms"), F.col("context_terms"), F.col("exclude_terms"), F.col("lookback_days")))
    both = new.alias("n").join(t["keywords"].alias("o"), "id")
    changed = ~F.lit(True)
    for c in STRATEGY:
        changed = changed | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    stale = both.where(changed).select(F.col("id").alias("keyword_id"))
    return t | {
        "keywords": merge.upsert(t["keywords"], new.withColumn("seq", F.lit(1)), ["id"]),
        "collection_cursors": t["collection_cursors"].join(stale, "keyword_id", "left_anti").select(*SCHEMAS["collection_cursors"].names),
        "article_keywords": t["article_keywords"].join(stale, "keyword_id", "left_anti").select(*SCHEMAS["article_keywords"].names),
    }


def archived(df: DataFrame, row_id: int) -> DataFrame:
    """The row archived and inactive."""
    hit = F.col("id") == row_id
    return df.withColumns({"archived": F.when(hit, 1).otherwise(F.col("archived")), "active": F.when(hit, 0).otherwise(F.col("active"))})


def listed_sources(sources: DataFrame, now) -> DataFrame:
    """Sources that are not archived, with the mode their flag gives them and whether they rest."""
    resting = F.coalesce(F.col("crawler_cooldown_until") > now, F.lit(False))
    return sources.where("archived = 0").withColumns({"mode": F.when(F.col("crawler_enabled") == 1, "crawler").otherwise(F.col("mode")), "in_cooldown": resting})
