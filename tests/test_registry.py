"""Every registered query of the engine against DuckDB on the smallest tables, where they are there."""

import math
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no sample tables")


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


def test_queries_match_sql(spark):
    from quillstream.plans import registry

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, f in registry.QUERIES.items():
        got = f(spark, FOLDER).toPandas()
        if name in registry.ORACLES:
            want = con.execute(registry.ORACLES[name]).df()
            assert sorted(got.columns) == sorted(want.columns), name
            assert rows(got) == rows(want), name


def test_pushdown(spark):
    """The searched column reaches the scan alone, and the limit stays a top-k."""
    from quillstream.plans import registry

    plan = registry.QUERIES["latest_runs"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "o_totalprice" not in plan
    plan = registry.QUERIES["crawl_topk"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = registry.QUERIES["candidate_queue"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    for name in ("dedup_two_key", "stored_matches"):
        assert "NestedLoop" not in registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_star_in_buckets(spark, tmp_path):
    """No Exchange below the final aggregate, for the whole funnel and for the queue's candidates."""
    from quillstream.operators import enrich
    from quillstream.plans import read_models, registry
    from quillstream.sources import bucketed

    tables = registry._star_tables(spark, FOLDER)
    bucketed.saved(tables, "test_star", str(tmp_path), 4)
    stored = bucketed.loaded(spark, "test_star")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
        plain = read_models.funnel(tables, registry.now())._jdf.queryExecution().executedPlan().toString()
        plan = read_models.funnel(stored, registry.now())._jdf.queryExecution().executedPlan().toString()
        assert plain.count("Exchange hashpartitioning") >= 4 and "hashpartitioning" not in plan and plan.count("Exchange SinglePartition") == 1 and plan.count("SortMergeJoin") == 3
        plan = enrich.candidates(stored, registry.now(), limit=100)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "TakeOrderedAndProject" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert read_models.funnel(stored, registry.now()).collect() == read_models.funnel(tables, registry.now()).collect()


def test_page_of_articles_groups_its_children_only(spark):
    from quillstream.plans import registry

    plan = registry.QUERIES["article_search"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 2


ZONED = ("fingerprints", "next_runs", "retry_seconds", "collection_run", "collected_articles", "incremental_window", "run_window_start", "retention_preview", "cleaned_history", "url_date", "page_articles", "time_text_articles", "feed_items", "answered_items", "pipeline_funnel", "candidate_queue", "articles_in_day_range", "daily_risk_floor", "backoff_schedule", "system_status", "dedup_fingerprint", "crawler_health", "cooldowns", "judged_items")


def test_queries_in_two_zones(spark):
    """The session's zone changes no row."""
    from quillstream.plans import registry

    names = [n for n in ZONED if n in registry.QUERIES]
    assert len(names) > 20
    seen = {}
    for zone in ("UTC", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for n in names:
                df = registry.QUERIES[n](spark, FOLDER)
                assert "timestamp" not in dict(df.dtypes).values(), n
                got = sorted(map(str, df.collect()))
                assert seen.setdefault(n, got) == got, n
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_whole_queries_leave_no_document_out(spark):
    from quillstream.plans import registry

    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    for name, key in (("sentence_filter", "doc_id"), ("analysis_run", "article_id"), ("stored_matches", "seq")):
        got = registry.QUERIES[name](spark, FOLDER)
        assert {r[0] for r in got.select(key).collect()} == ids, name
    # the stored side holds articles of every remainder
    assert {r[0] % 10 for r in registry.QUERIES["stored_matches"](spark, FOLDER).select("article_id").collect()} == set(range(10))


def test_titles_that_end_within_a_reference(spark, tmp_path):
    """A title cut to so many letters after it was escaped: what is left of a reference is text, in titles and in labels."""
    from quillstream.plans import registry

    cuts = ["&amp;&amp;", "&amp;&amp", "&am", "&a", "&", "&quot", "&lt", "&#x27", "&copy", "&amp;lt;", "&copy;", "R&amp;D &lt;b&gt; &quot;x&quot; &#x27;y&#x27;"]
    html = [f"<html><title>One  two {c}</title><a href=\"/news/{k}-a\">A label {c}</a></html>" for k, c in enumerate(cuts)]
    pages = spark.createDataFrame([(k, "https://n.org/list", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("page_title_text", "link_scores", "crawl_topk"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES[name]).df()
        assert len(got) == len(cuts) and rows(got) == rows(want), name
