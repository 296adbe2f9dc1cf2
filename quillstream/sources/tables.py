"""Schemas of the engine's tables, and readers that align what they find with them."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _S, _T, _D, _A = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.DateType(), T.ArrayType(T.StringType())
DETAILS = T.ArrayType(T.StructType([T.StructField("title", _S), T.StructField("content", _S), T.StructField("article_ids", T.ArrayType(_L))]))
ITEM = "title string, url string, publisher string, summary string, published_at timestamp, guid string, categories array<string>"


def arrow_fields(ddl: str) -> list[pa.DataType]:
    """Arrow types of a list of names and types; instants are UTC."""
    kinds = {"timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string()), "string": pa.string(), "int": pa.int32()}
    return [kinds[f.split(" ")[1]] for f in ddl.split(", ")]


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "rss_sources": _schema(id=_L, name=_S, url_template=_S, mode=_S, language=_S, country=_S, site_domain=_S, active=_I, archived=_I, crawler_enabled=_I, crawler_failures=_I, crawler_cooldown_until=_T, crawler_last_status=_S, crawler_last_message=_S),
    "keyword_categories": _schema(id=_L, name=_S, sort_order=_I, active=_I),
    "keywords": _schema(id=_L, name=_S, category_id=_L, match_terms=_A, context_terms=_A, exclude_terms=_A, query=_S, lookback_days=_I, require_local_match=_I, active=_I, archived=_I),
    "articles": _schema(id=_L, title=_S, url=_S, canonical_url=_S, fingerprint=_S, publisher=_S, publisher_normalized=_S, summary=_S, published_at=_T, collected_at=_T, rss_source_id=_L),
    "article_sources": _schema(article_id=_L, rss_source_id=_L, feed_url=_S, observed_url=_S, canonical_url=_S, guid=_S, language=_S, country=_S, categories=_A, first_seen_at=_T, last_seen_at=_T),
    "article_keywords": _schema(article_id=_L, keyword_id=_L, matched_terms=_A),
    "collection_cursors": _schema(rss_source_id=_L, keyword_id=_L, last_collected_at=_T),
    "collection_runs": _schema(id=_L, status=_S, started_at=_T, finished_at=_T, window_start=_T, tasks_total=_I, tasks_succeeded=_I, tasks_failed=_I, items_seen=_L, items_matched=_L, items_inserted=_L, duplicates=_L, message=_S),
    "collection_run_details": _schema(run_id=_L, rss_source_id=_L, keyword_id=_L, status=_S, window_start=_T, window_end=_T, feed_url=_S, items_seen=_L, items_matched=_L, items_inserted=_L, duplicates=_L, skipped_outside_window=_L, skipped_without_date=_L, error_message=_S),
    "ai_analysis_runs": _schema(id=_L, status=_S, started_at=_T, finished_at=_T, articles_total=_I, articles_succeeded=_I, articles_failed=_I, articles_relevant=_I, prompt_tokens=_L, completion_tokens=_L, message=_S),
    "article_analyses": _schema(article_id=_L, status=_S, payload=_S),
    "article_contents": _schema(article_id=_L, status=_S, requested_url=_S, final_url=_S, full_text=_S, content_hash=_S, content_chars=_I, http_status=_I, content_type=_S, extractor=_S, fetched_at=_T, error_message=_S, attempt_count=_I, failure_kind=_S, next_retry_at=_T, is_terminal=_I, ignored_at=_T),
    "article_relevance_reviews": _schema(article_id=_L, status=_S, content_hash=_S, is_relevant=_I, relevance_score=_I, relevance_reason=_S, category=_S, secondary_categories=_A, keyword_categories=_A, evidence=_A, confidence=_I, prompt_version=_S, reviewed_at=_T, error_message=_S),
    "business_articles": _schema(article_id=_L, analysis_status=_S, content_hash=_S, category=_S, secondary_categories=_A, summary=_S, impact_direction=_S, impact_score=_I, impact_analysis=_S, risk_level=_S, risk_score=_I, risk_factors=_A, opportunities=_A, recommended_actions=_A, evidence=_A, analyzed_at=_T, error_message=_S),
    "ai_analysis_run_items": _schema(run_id=_L, article_id=_L, status=_S, content_status=_S, relevance_status=_S, business_analysis_status=_S, is_relevant=_I, error_message=_S),
    "daily_reports": _schema(id=_L, report_date=_D, status=_S, title=_S, overview=_S, risk_level=_S, risk_score=_I, details=DETAILS, article_count=_I, error_message=_S),
    "daily_report_articles": _schema(report_id=_L, article_id=_L),
    "app_settings": _schema(key=_S, value=_S),
}
#: Columns of the tables that hang on another's row and go with it: child table and column, by parent.
CHILDREN: dict[str, tuple[tuple[str, str], ...]] = {
    "articles": tuple((t, "article_id") for t in ("article_sources", "article_keywords", "article_contents", "article_relevance_reviews", "business_articles", "article_analyses", "ai_analysis_run_items", "daily_report_articles")),
    "collection_runs": (("collection_run_details", "run_id"),),
    "ai_analysis_runs": (("ai_analysis_run_items", "run_id"),),
    "daily_reports": (("daily_report_articles", "report_id"),),
    "keywords": (("article_keywords", "keyword_id"), ("collection_cursors", "keyword_id")),
}
#: What tells a table's rows apart.
KEYS: dict[str, list[str]] = {name: [schema.names[0]] for name, schema in SCHEMAS.items()} | {
    "article_sources": ["article_id", "rss_source_id", "canonical_url"],
    "article_keywords": ["article_id", "keyword_id"],
    "collection_cursors": ["rss_source_id", "keyword_id"],
    "collection_run_details": ["run_id", "rss_source_id", "keyword_id"],
    "ai_analysis_run_items": ["run_id", "article_id"],
    "daily_report_articles": ["report_id", "article_id"],
}
#: What a missing column holds in rows of an older table.
DEFAULTS: dict[str, object] = {"archived": 0, "active": 1, "crawler_enabled": 0, "crawler_failures": 0, "language": "", "country": "", "guid": "", "is_terminal": 0, "attempt_count": 0, "failure_kind": "", "lookback_days": 30, "require_local_match": 1}

Tables = dict[str, DataFrame]


def aligned(df: DataFrame, table: str) -> DataFrame:
    """The frame with the table's columns and types: missing ones by default, text in place of lists read as JSON, others out."""
    out = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for f in SCHEMAS[table].fields:
        if f.name not in kinds:
            value = F.lit(DEFAULTS.get(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(kinds[f.name], T.StringType):
            value = F.coalesce(F.from_json(F.col(f.name), f.dataType), F.array().cast(f.dataType))
        else:
            value = F.col(f.name)
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def load(spark: SparkSession, folder: str, names: Iterable[str] = SCHEMAS) -> Tables:
    """Tables of a snapshot folder, aligned; absent ones are empty."""
    out = {}
    for name in names:
        try:
            out[name] = aligned(spark.read.parquet(f"{folder}/{name}"), name)
        except Exception as e:  # noqa: BLE001  only a path that is not there means an empty table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = empty(spark, name)
    return out


def columns(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def copied(source: Tables, target: Tables) -> Tables:
    """The source's rows in the target's columns, parents before children; columns only one side has go or are default."""
    order = [t for t in SCHEMAS if t in source]
    return {t: target[t].unionByName(aligned(source[t], t)) if t in target else aligned(source[t], t) for t in order}
