"""Rows of the engine's tables for tests."""

from datetime import datetime

from quillstream.sources.tables import ITEM, SCHEMAS


def tables(spark, **rows):
    out = {}
    for name, schema in SCHEMAS.items():
        given = [tuple(r.get(n) for n in schema.names) for r in rows.get(name, [])]
        out[name] = spark.createDataFrame(given, schema)
    return out


def source(i, **kw):
    return {"id": i, "name": f"s{i}", "url_template": "https://n.org/?q={query}", "mode": "search", "language": "en", "country": "US", "site_domain": "", "active": 1, "archived": 0, "crawler_enabled": 0, "crawler_failures": 0} | kw


def keyword(i, terms, **kw):
    return {"id": i, "name": f"k{i}", "match_terms": terms, "context_terms": [], "exclude_terms": [], "lookback_days": 14, "require_local_match": 0, "active": 1, "archived": 0} | kw


def item(source_id, keyword_id, position, **kw):
    base = {"title": "Tariff up", "url": "https://n.org/a?utm_source=z", "publisher": "Wire", "summary": "s", "published_at": datetime(2026, 7, 20), "guid": "", "categories": []} | kw
    return (source_id, keyword_id, position, *[base[n] for n in ("title", "url", "publisher", "summary", "published_at", "guid", "categories")])


def items_of(spark, *rows):
    return spark.createDataFrame(list(rows), f"rss_source_id long, keyword_id long, position int, {ITEM}")
