"""Deduplication, merges and whole runs, from inline literals and against brute force."""

import json
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream.operators import collect, config, dedup, enrich, graph, merge, recovery, report, retention, sinks
from quillstream.plans import read_models as q
from quillstream.sources.tables import SCHEMAS, empty
from tests_tables import item, items_of, keyword, source, tables

NOW = datetime(2026, 7, 22, 4)


def at(moment=NOW):
    return F.lit(moment).cast("timestamp")


def brute(items):
    prints, links, out = {}, {}, {}
    for seq, f, u in items:
        found = [x for x in (prints.get(f), links.get(u)) if x is not None]
        if found:
            out[seq] = min(found)
        else:
            out[seq] = seq
            prints.setdefault(f, seq)
            links.setdefault(u, seq)
    return out


def test_leaders_are_greedy(spark):
    chain = [(0, "f1", "u1"), (1, "f1", "u2"), (2, "f3", "u2")]
    r = random.Random(4)
    many = [(i, f"f{r.randrange(40)}", f"u{r.randrange(40)}") for i in range(150)]
    for items in (chain, many):
        df = spark.createDataFrame(items, "seq long, fingerprint string, canonical_url string")
        for few, worth in ((dedup.FEW, 0), (dedup.FEW, 1), (7, 1), (20, dedup.WORTH)):  # by rounds alone, by components, by blocks, by both
            assert {x["seq"]: x["leader"] for x in dedup.leaders(df, few, worth).collect()} == brute(items)
    assert dedup.leaders(df.limit(0)).count() == 0


def test_leaders_of_a_long_chain(spark):
    """Each item shares a key with the next, by turns, a million times: rounds alone would be as many as half the items. Blocks of its one
    component, four here, bound the jobs and what a task holds."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("f"), F.floor((F.col("id") + 1) / 2)).alias("fingerprint"), F.concat(F.lit("u"), F.floor(F.col("id") / 2)).alias("canonical_url"))
    got = dedup.leaders(df)
    # greedy: every other item leads, and the next joins it
    assert got.where("leader <> seq - seq % 2").count() == 0 and got.count() == n


def test_leaders_of_hot_keys(spark):
    """One fingerprint of a third of all items, blank keys that hold nobody together, and chains of all lengths."""
    r = random.Random(8)
    items = [(i, "hot" if i % 3 == 0 else ("", None, f"f{(i + 1) // 2}")[i % 5 % 3], f"u{i // 2 if i % 7 else r.randrange(50)}") for i in range(3000)]
    df = spark.createDataFrame(items, "seq long, fingerprint string, canonical_url string")
    prints, links, want = {}, {}, {}
    for seq, f, u in items:
        found = [x for x in (prints.get(f) if f else None, links.get(u)) if x is not None]
        want[seq] = min(found) if found else seq
        if not found:
            prints.setdefault(f, seq), links.setdefault(u, seq)
    for few, worth in ((dedup.FEW, dedup.WORTH), (50, 1)):
        assert {x["seq"]: x["leader"] for x in dedup.leaders(df, few, worth).collect()} == want


@pytest.mark.parametrize("block", [10, 60, 5000])
def test_components(spark, block):
    """Chains, a hub of half the links, and random links, contracted in parts and by rounds, against one walk."""
    r = random.Random(block)
    links = [(i, i + 1) for i in range(400) if i % 50] + [(1000, 1001 + i) for i in range(500)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (3, 2)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(links, "a long, b long"), block)
    assert {x["node"]: x["component"] for x in got.collect()} == {k: v for k, v in label.items() if k in linked}
    rounds = graph._rounds(spark.createDataFrame({(max(x), min(x)) for x in links if x[0] != x[1]}, "a long, b long"))
    assert {x["node"]: x["component"] for x in rounds.collect()} == {k: v for k, v in label.items() if k in linked}


def test_routing_by_language(spark):
    t = tables(spark, rss_sources=[source(1, language="zh-CN"), source(2), source(3, language="fr")], keywords=[keyword(1, ["关税", "tariff"]), keyword(2, ["贸易"])])
    rows = collect.route(t["rss_sources"], t["keywords"]).orderBy("rss_source_id", "keyword_id").collect()
    assert [(r["rss_source_id"], r["keyword_id"], r["match_terms"]) for r in rows] == [(1, 1, ["关税"]), (1, 2, ["贸易"]), (2, 1, ["tariff"])]


def test_two_runs(spark):
    t = tables(spark, rss_sources=[source(1), source(2, language="en-GB", country="GB")], keywords=[keyword(1, ["tariff"])])
    items = items_of(
        spark,
        item(1, 1, 0, categories=["Trade"], guid="g"),
        item(1, 1, 1, title="None", published_at=None),
        item(1, 1, 2, title="Old", published_at=datetime(2026, 7, 8, 15, 59, 59)),
        item(1, 1, 3, title="No match", url="https://n.org/z"),
        item(2, 1, 0, summary="longer", publisher=""),
        item(2, 1, 1, title="Tariff edge", url="https://n.org/edge", published_at=NOW),
    )
    one = {k: v.cache() for k, v in collect.collect(t, items, at(), 1).items()}
    run = one["collection_runs"].first()
    assert (run["status"], run["items_seen"], run["items_matched"], run["items_inserted"], run["duplicates"]) == ("success", 6, 3, 2, 1)
    d = {r["rss_source_id"]: r for r in one["collection_run_details"].collect()}
    assert (d[1]["skipped_without_date"], d[1]["skipped_outside_window"], d[1]["items_matched"], d[1]["items_inserted"]) == (1, 1, 1, 1)
    arts = one["articles"].orderBy("id").collect()
    assert [(a["id"], a["summary"], a["publisher"], a["canonical_url"]) for a in arts] == [(1, "longer", "Wire", "https://n.org/a"), (2, "s", "Wire", "https://n.org/edge")]
    assert one["article_sources"].count() == 3 and one["collection_cursors"].count() == 2
    found = q.search(one, q="tariff up").first()
    assert found["languages"] == ["en", "en-GB"] and found["countries"] == ["US", "GB"] and [k["name"] for k in found["keywords"]] == ["k1"]

    later = datetime(2026, 7, 22, 5)
    two = collect.collect(one, items, at(later), 2, settings=collect.CollectSettings(incremental=True))
    assert two["collection_run_details"].where("run_id = 2 and rss_source_id = 1").first()["skipped_outside_window"] == 3
    again = collect.collect(one, items, at(later), 2, settings=collect.CollectSettings(incremental=False))
    r2 = again["collection_runs"].where("id = 2").first()
    assert (r2["items_matched"], r2["duplicates"], r2["items_inserted"]) == (3, 3, 0)


def test_failed_pair_keeps_its_cursor(spark):
    t = tables(spark, rss_sources=[source(1), source(2)], keywords=[keyword(1, ["tariff"])], collection_cursors=[{"rss_source_id": 2, "keyword_id": 1, "last_collected_at": datetime(2026, 7, 1)}])
    bad = spark.createDataFrame([(2, None, "down")], "rss_source_id long, keyword_id long, error string")
    out = collect.collect(t, items_of(spark, item(1, 1, 0)), at(), 1, failures=bad)
    assert {r["rss_source_id"]: r["last_collected_at"] for r in out["collection_cursors"].collect()} == {1: NOW, 2: datetime(2026, 7, 1)}
    assert out["collection_runs"].first()["status"] == "partial"
    assert out["collection_run_details"].where("status = 'failed'").first()["error_message"] == "down"


def hit_tables(spark):
    review = lambda a, rel, cat, **kw: {"article_id": a, "status": "success", "is_relevant": rel, "category": cat, "secondary_categories": [], "keyword_categories": [], "prompt_version": "old"} | kw
    return tables(
        spark,
        keyword_categories=[{"id": 1, "name": "Tariffs", "sort_order": 1, "active": 1}, {"id": 2, "name": "Idle", "sort_order": 2, "active": 1}],
        keywords=[keyword(1, ["a"], category_id=1), keyword(2, ["b"], category_id=1), keyword(3, ["c"]), keyword(4, ["d"], active=0)],
        article_keywords=[{"article_id": a, "keyword_id": k, "matched_terms": []} for a, k in ((1, 1), (2, 1), (2, 2), (3, 2), (4, 3), (1, 4))],
        article_relevance_reviews=[review(1, 1, "trade_tariff"), review(2, 1, "other"), review(3, 0, "other"), review(4, 1, "other")],
    )


def test_hit_stats(spark):
    t, rule = hit_tables(spark), {"named": {"Tariffs": "trade_tariff"}, "new_versions": ("v7",)}
    c = {r["category_id"]: r for r in q.category_hit_stats(t, **rule).collect()}
    assert (c[1]["keyword_count"], c[1]["hit_count"], c[1]["reviewed_count"], c[1]["business_relevant_count"], c[1]["relevant_count"]) == (2, 3, 3, 2, 1)
    assert c[1]["hit_rate"] == pytest.approx(1 / 3) and c[2]["hit_rate"] is None and c[2]["hit_count"] == 0 and c[None]["hit_count"] == 1
    o = q.overall_hit_rate(t, **rule).first()
    assert (o["keyword_count"], o["hit_count"], o["reviewed_count"], o["business_relevant_count"], o["relevant_count"], o["hit_rate"]) == (3, 4, 4, 3, 2, 0.5)
    assert [r["keyword_id"] for r in q.keyword_hit_stats(t, **rule).collect()] == [1, 2, 3, 4]


def article(i, **kw):
    return {"id": i, "title": f"t{i}", "url": f"https://n.org/{i}", "canonical_url": f"https://n.org/{i}", "fingerprint": f"f{i}", "publisher": "p", "publisher_normalized": "p", "summary": "tax is up", "published_at": datetime(2026, 7, 20, i), "collected_at": NOW, "rss_source_id": 1} | kw


CODES = ("trade_tariff", "other")


def test_queue_and_gate(spark):
    t = tables(spark, articles=[article(1), article(2, summary="quiet"), article(3, summary="")])
    assert [r["article_id"] for r in enrich.candidates(t, at()).collect()] == [3, 2, 1]
    assert [r["batch"] for r in enrich.batches(enrich.candidates(t, at()), 2).orderBy("batch").collect()] == [0, 0, 1]
    out = enrich.run_queue(t, at(), 1, CODES, size=20, scorer=enrich.rule_scorer(("tax", "up"), "trade_tariff"))
    assert {r["article_id"]: r["is_relevant"] for r in out["article_relevance_reviews"].collect()} == {1: 1, 2: 0}
    assert [r["article_id"] for r in out["business_articles"].collect()] == [1]
    failed = out["article_contents"].where("article_id = 3").first()
    assert (failed["status"], failed["attempt_count"], failed["is_terminal"], failed["next_retry_at"]) == ("failed", 1, 0, datetime(2026, 7, 22, 4, 5))
    run = out["ai_analysis_runs"].first()
    assert (run["status"], run["articles_total"], run["articles_succeeded"], run["articles_failed"]) == ("partial", 3, 2, 1)
    assert enrich.candidates(out, at()).count() == 0
    f = q.funnel(out, at()).first()
    assert (f["total"], f["content_ready"], f["relevant"], f["irrelevant"], f["analyzed"], f["content_retry_waiting"], f["failed"]) == (3, 2, 1, 1, 1, 1, 1)
    # a score under the threshold makes it irrelevant, and no analysis is made
    low = enrich.run_queue(t, at(), 1, CODES, scorer=enrich.rule_scorer(("tax",), "trade_tariff"))
    r = low["article_relevance_reviews"].where("article_id = 1").first()
    assert (r["is_relevant"], r["category"], low["business_articles"].count()) == (0, "other", 0)
    # three failures are final; by hand they are new again, or ignored
    c = out["article_contents"]
    bad = spark.createDataFrame([(3, "u", None, None, 500, None, "http_500", True, "m")], enrich.CONTENT)
    for n in (2, 3):
        c = enrich.with_content(c, bad, at())
    assert tuple(c.where("article_id = 3").select("attempt_count", "is_terminal", "next_retry_at").first()) == (3, 1, None)
    assert enrich.retried(c, 3).where("article_id = 3").first()["attempt_count"] == 0
    gone = out | {"article_contents": enrich.ignored(c, 3, at())}
    assert q.content_failures(gone, at()).first()["disposition"] == "ignored"


def test_refusing_provider(spark):
    """A reader that is refused leaves the rest of its articles pending; a failure that passes at once is tried once more."""

    def reader(frames):
        for pdf in frames:
            kind = ["x_http_429" if i == 5 else "x_web_unavailable" if i == 2 else None for i in pdf["article_id"]]
            again = len(pdf) == 1 and pdf["article_id"].iloc[0] == 2
            yield pd.DataFrame({"article_id": pdf["article_id"], "requested_url": pdf["url"], "final_url": pdf["url"], "full_text": "tax is up", "http_status": 200, "content_type": "text/plain", "failure_kind": [None if again else k for k in kind], "retryable": True, "message": "m"})

    asked = pd.DataFrame({"article_id": range(1, 9), "url": "u", "title": "t", "publisher": "p", "summary": "s"})
    got = pd.concat(enrich.guarded(reader, 3)(iter([asked])))
    assert sorted(got["article_id"]) == [1, 2, 3, 4, 5, 6] and got.loc[got["article_id"] == 2, "failure_kind"].isna().all()
    t = tables(spark, articles=[article(i) for i in range(1, 9)])
    out = enrich.run_queue(t, at(), 1, CODES, size=3, reader=lambda frames: reader(x for x in frames if not (x["article_id"] == 99).any()), parallelism=1, scorer=enrich.rule_scorer(("tax", "up"), "trade_tariff"))
    status = {r["article_id"]: (r["run_id"], r["status"]) for r in out["ai_analysis_run_items"].collect()}
    assert len(status) == 8 and {run for run, _ in status.values()} == {1, 2, 3} and status[5][1] == "failed"
    runs = {r["id"]: r["status"] for r in out["ai_analysis_runs"].collect()}
    assert set(runs) == {1, 2, 3} and "partial" in runs.values()


def test_boundary(spark):
    told = enrich.Boundary("Acme", review_note=" Not named.", analysis_note=" Not named.", paths=(("trade_tariff", "Costs."),), other_path="Somehow.", summary="An event.")
    rows = spark.createDataFrame([(1, "Acme grew.", "trade_tariff", "Acme did. Good.", ["Acme x", "y"]), (2, "Others grew.", "trade_tariff", "Acme did。Good。", ["Acme x", "y"]), (3, None, "other", "Acme did.", ["Acme"])], "id int, full_text string, category string, relevance_reason string, evidence array<string>")
    got = rows.withColumns(told.review()).orderBy("id").collect()
    assert [(r["relevance_reason"], r["evidence"]) for r in got] == [("Acme did. Good.", ["Acme x", "y"]), ("Good。 Not named.", ["y"]), (" Not named.", [])]
    a = rows.withColumnRenamed("relevance_reason", "summary").withColumns({"impact_analysis": F.col("summary"), "risk_factors": F.array("summary"), "opportunities": F.array(F.lit("z")), "recommended_actions": F.array("summary")})
    got = a.withColumns(told.analysis()).orderBy("id").collect()
    assert [(r["summary"], r["impact_analysis"], r["risk_factors"]) for r in got] == [("Acme did. Good.", "Acme did. Good.", ["Acme did. Good."]), ("Good。", "Good。 Not named.", ["Good。"]), ("An event.", "Somehow. Not named.", [])]


def test_prompts(spark):
    rows = spark.createDataFrame([(1, "t", "p", "x" * 50, "other", "r"), (2, "u", "p", None, "other", None)], "article_id long, title string, publisher string, full_text string, category string, relevance_reason string").withColumn("published_at", at())
    got = enrich.prompt(rows, "judge", 10, "analysis", "we").orderBy("article_id").collect()
    assert got[0]["system_prompt"] == "we\n\njudge" and json.loads(got[0]["user_prompt"]) == {"title": "t", "publisher": "p", "published_at": "2026-07-22 04:00:00", "category": "other", "relevance_reason": "r", "full_text": "x" * 10, "truncated": True}
    inputs = rows.withColumns({"risk_score": F.when(F.col("article_id") == 1, 3).otherwise(9), "summary": F.lit("s"), "matched_keyword_names": F.array(F.lit("k"))})
    whole = json.loads(enrich.report_prompt(inputs, "report", "2026-07-22").first()["user_prompt"])
    assert whole["report_date"] == "2026-07-22" and [a["article_id"] for a in whole["articles"]] == [2, 1] and whole["article_count"] == 2
    assert json.loads(enrich.report_prompt(inputs.limit(0), "report", "2026-07-22").first()["user_prompt"])["articles"] == []


def test_settings(spark):
    t = tables(spark, app_settings=[{"key": "ai_parallelism", "value": "4"}, {"key": "other", "value": "x"}] + [{"key": f"k{i}", "value": "v"} for i in range(1200)])
    out = config.save_settings(t, {"ai_parallelism": 20, "crawler_enabled": True, "report_time": "23:59", "business_profile": " " + "x" * 50})
    assert config.settings(out["app_settings"]) == config.Settings(ai_parallelism=20, crawler_enabled=True, report_time="23:59", business_profile="x" * 50)
    assert out["app_settings"].count() == 1205
    for bad in ({"ai_parallelism": 21}, {"ai_batch_size": 0}, {"crawler_enabled": "yes"}, {"report_time": "24:00"}, {"business_profile": "short"}, {"unheard": 1}, {"ai_batch_size": True}):
        with pytest.raises(ValueError):
            config.save_settings(t, bad)


def test_list_checks(spark):
    t = tables(spark)
    for bad in (lambda: q.business_articles(t, category="x", codes=("y",)), lambda: q.search(t, day_from="2024-02-02", day_to="2024-02-01"), lambda: q.reviews(t, day_from="2024-02-02", day_to="2024-02-01"), lambda: q.search(t, limit=201)):
        with pytest.raises(ValueError):
            bad()


def test_upsert_does_not_shuffle_its_base(spark):
    base = spark.range(100_000).selectExpr("id", "cast(id as string) v")
    delta = spark.range(5, 6).selectExpr("id", "'x' v", "1 seq")
    plan = merge.upsert(base, delta, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_report(spark):
    ok = {"analysis_status": "success", "content_hash": "h", "category": "other"}
    t = tables(
        spark,
        articles=[article(1), article(2), article(3, published_at=datetime(2026, 7, 19, 15, 59))],
        article_contents=[{"article_id": i, "status": "success", "content_hash": "h"} for i in (1, 2, 3)],
        business_articles=[ok | {"article_id": 1, "risk_score": 55}, ok | {"article_id": 2, "risk_score": 72}, ok | {"article_id": 3, "risk_score": 99}],
        keywords=[keyword(1, ["x"], name="a,b"), keyword(2, ["y"], name="c")],
        article_keywords=[{"article_id": 2, "keyword_id": k, "matched_terms": []} for k in (2, 1)],
    )
    rows = report.report_input(t, "2026-07-20")
    assert [(r["article_id"], r["matched_keyword_names"]) for r in rows.collect()] == [(2, ["a,b", "c"]), (1, None)]
    answer = spark.createDataFrame([("t", "o", 20, [("a", "b", [2, 9, 2]), ("c", "d", [9])])], "title string, overview string, risk_score int, details array<struct<title:string,content:string,article_ids:array<bigint>>>")
    r = report.assembled(rows, answer).first()
    assert (r["risk_score"], r["risk_level"], [d["article_ids"] for d in r["details"]]) == (72, "high", [[2]])


def test_retention(spark, tmp_path):
    t = tables(spark, articles=[article(1, published_at=datetime(2026, 6, 1)), article(2)], article_keywords=[{"article_id": i, "keyword_id": 1, "matched_terms": []} for i in (1, 2)], article_contents=[{"article_id": 2, "status": "failed"}], collection_runs=[{"id": 1, "status": "running", "started_at": datetime(2026, 1, 1)}])
    assert retention.preview(t, "history", "2026-07-01").first()["total_records"] == 1
    out, path = retention.execute(t, "history", "DELETE", "2026-07-01", snapshot=lambda x: sinks.snapshot({"articles": x["articles"]}, str(tmp_path), "s1"))
    assert [r["id"] for r in out["articles"].collect()] == [2] and [r["article_id"] for r in out["article_keywords"].collect()] == [2]
    assert spark.read.parquet(f"{path}/articles").count() == 2
    assert retention.preview(t, "failed_records").first()["articles"] == 1
    for bad in (lambda: retention.execute(t, "history", "yes", "2026-07-01"), lambda: retention.preview(t, "history"), lambda: retention.preview(t, "nothing")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        retention.execute(t, "all_collected", "DELETE", busy=lambda: True)
    assert [r["id"] for r in retention.purge_pending(t, at())["articles"].collect()] == [2]  # its failure may not be retried


def test_strategy_change_invalidates(spark):
    t = tables(spark, keywords=[keyword(1, ["a"]), keyword(2, ["b"])], collection_cursors=[{"rss_source_id": 1, "keyword_id": k, "last_collected_at": NOW} for k in (1, 2)], article_keywords=[{"article_id": 1, "keyword_id": k, "matched_terms": []} for k in (1, 2)])
    named = config.save_keyword(t, keyword(1, ["a"], name="new"))
    assert named["collection_cursors"].count() == 2
    out = config.save_keyword(t, keyword(1, ["a", "z"]))
    assert [r["keyword_id"] for r in out["collection_cursors"].collect()] == [2] and [r["keyword_id"] for r in out["article_keywords"].collect()] == [2]
    assert out["keywords"].where("id = 1").first()["query"] == '("a"OR"z")when:14d'
    with pytest.raises(ValueError):
        config.save_keyword(t, keyword(1, ["a"], category_id=9))
    s = config.save_source(t, source(5, country="", language="en-AU", site_domain="https://a.org/, b.org"))["rss_sources"].first()
    assert (s["country"], s["site_domain"]) == ("AU", "a.org OR b.org")
    assert config.Settings.read({"incremental": "false", "ai_parallelism": "99", "ai_batch_size": "x"}) == config.Settings(incremental=False, ai_parallelism=20)


def test_recovery_and_backfill(spark):
    t = tables(spark, collection_runs=[{"id": 1, "status": "running", "message": ""}, {"id": 2, "status": "success"}], article_contents=[{"article_id": 1, "status": "processing", "error_message": "kept"}], rss_sources=[source(1, country="", language="en-US")], articles=[article(1, publisher="A  B", publisher_normalized="")])
    out = recovery.restarted(t)
    assert {r["id"]: (r["status"], r["message"]) for r in out["collection_runs"].collect()} == {1: ("interrupted", "interrupted by a restart"), 2: ("success", None)}
    assert tuple(out["article_contents"].select("status", "error_message").first()) == ("failed", "kept")
    back = recovery.backfilled(t)
    assert (back["rss_sources"].first()["country"], back["articles"].first()["publisher_normalized"], back["article_sources"].count()) == ("US", "A B", 1)


def test_crawler_health(spark):
    s = tables(spark, rss_sources=[source(1, crawler_failures=2), source(2), source(3)])["rss_sources"]
    o = spark.createDataFrame([(1, None, None, ""), (2, "access_blocked", None, "403"), (3, "cooldown", None, "")], "rss_source_id long, kind string, explicit_seconds int, message string")
    got = {r["id"]: r for r in collect.crawler_health(s, o, at()).collect()}
    assert (got[1]["crawler_failures"], got[2]["crawler_failures"], got[3]["crawler_failures"]) == (0, 1, 0)
    assert got[2]["crawler_cooldown_until"] == datetime(2026, 7, 23, 4)


def test_merges(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    delta = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, seq int")
    assert {tuple(r) for r in merge.upsert(base, delta, ["id"]).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert {tuple(r) for r in merge.insert_ignore(base, delta, ["id"], "seq").collect()} == {(1, "a"), (2, "b"), (3, "z")}


def test_card():
    assert sinks.signature("s", 1) == sinks.signature("s", 1) != sinks.signature("s", 2)
    big = {"title": "t", "overview": "o", "details": [{"title": "x", "content": "y" * 7000} for _ in range(9)]}
    c = sinks.card(big)
    import json

    assert len(json.dumps(c, ensure_ascii=False).encode()) <= 28000 and all(len(e["content"]) <= 6000 for e in c["elements"])
    assert len(sinks.card({"title": "t", "overview": "o", "details": [{"title": "x", "content": "y"}] * 9})["elements"]) == 10


def test_stream(spark, tmp_path):
    from quillstream.streaming.collect import collected_stream, current

    folder, src = tmp_path / "state", tmp_path / "in"
    for name, df in tables(spark, rss_sources=[source(1)], keywords=[keyword(1, ["tariff"])]).items():
        df.write.parquet(f"{folder}/base/{name}")
    for n in range(2):
        items_of(spark, item(1, 1, 0, url=f"https://n.org/{n}", title=f"Tariff {n}", published_at=datetime(2026, 7, 22, 4 + n))).coalesce(1).write.mode("append").parquet(str(src))
        collected_stream(spark, str(src), str(folder), lambda b: datetime(2026, 7, 22, 4 + b)).awaitTermination()
    t = current(spark, str(folder), 1)
    assert t["articles"].count() == 2 and t["collection_runs"].count() == 2
    assert empty(spark, "articles").count() == 0


def test_change_of_extractor(spark):
    rows = [{"article_id": 1, "status": "failed", "failure_kind": "http_500", "attempt_count": 3, "is_terminal": 1, "full_text": "kept"}, {"article_id": 2, "status": "failed", "failure_kind": "dns"}, {"article_id": 3, "status": "failed", "failure_kind": "not_found", "attempt_count": 1}, {"article_id": 4, "status": "success", "extractor": "old"}, {"article_id": 5, "status": "success", "extractor": "new"}, {"article_id": 6, "status": "success"}]
    out = {r["article_id"]: r for r in recovery.purged_contents(tables(spark, article_contents=rows)["article_contents"], "new").collect()}
    assert sorted(out) == [1, 3, 5, 6] and (out[1]["failure_kind"], out[1]["attempt_count"], out[1]["is_terminal"]) == ("migration_pending", 0, 0) and out[3]["attempt_count"] == 1


def test_maintained_counts(spark):
    """Ten random changes of matches, reviews, contents and analyses, with purges and flips among them: kept counts are those of the tables."""
    from quillstream.operators.lineage import cut
    from quillstream.plans import maintained

    r = random.Random(17)
    config = tables(spark, keywords=[keyword(k, ["x"], category_id=(1, 2, None)[k % 3], active=int(k % 4 > 0)) for k in range(1, 7)], keyword_categories=[{"id": i, "name": f"c{i}", "sort_order": i, "active": 1} for i in (1, 2)])
    rule = {"named": {"c2": "toxic"}, "new_versions": ("v2",)}
    held: dict[int, dict] = {}

    def article():
        return {
            "keys": r.sample(range(1, 7), r.randint(0, 4)),
            "review": r.choice([None, {"status": r.choice(["success", "failed"]), "content_hash": "h", "is_relevant": r.randint(0, 1), "category": r.choice(["toxic", "other"]), "prompt_version": r.choice(["v1", "v2"]), "keyword_categories": r.choice([[], ["c1"]])}]),
            "content": r.choice([None, {"status": r.choice(["success", "failed"]), "content_hash": r.choice("hg"), "is_terminal": r.randint(0, 1)}]),
            "analysis": r.choice([None, {"analysis_status": r.choice(["success", "failed"]), "content_hash": "h"}]),
        }

    def now():
        one = lambda what: [{"article_id": i} | a[what] for i, a in held.items() if a[what]]
        names = {"articles": [{"id": i} for i in held], "article_keywords": [{"article_id": i, "keyword_id": k} for i, a in held.items() for k in a["keys"]], "article_relevance_reviews": one("review"), "article_contents": one("content"), "business_articles": one("analysis")}
        own = tables(spark, **names)
        return config | {n: own[n] for n in names}

    for i in range(40):
        held[i] = article()
    before = now()
    kept = cut(maintained.counts(before, **rule))
    for step in range(10):
        touched = r.sample(sorted(held), 6)
        for i in touched[:2]:
            del held[i]
        for i in [*touched[2:], 100 + step]:
            held[i] = article()
        after = now()
        moved = maintained.change(before, after, spark.createDataFrame([(i,) for i in [*touched, 100 + step]], "article_id long"), **rule)
        kept = cut(maintained.merged(kept, moved).coalesce(1))
        before = after
    want = maintained.merged(maintained.counts(before, **rule), kept.limit(0))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert maintained.keyword_hit_stats(before, kept).collect() == q.keyword_hit_stats(before, **rule).select(*maintained.keyword_hit_stats(before, kept).columns).collect()


def test_a_provider_that_refuses_stops_what_has_not_begun(spark):
    """Sixteen partitions in four rounds: the first round is refused, the other rounds ask nothing, what was answered is stored once, and the waves behind
    are not begun; without a refusal every round asks."""
    articles = [{"id": i, "title": "t", "url": f"https://n.org/{i}", "summary": "text", "published_at": NOW, "collected_at": NOW} for i in range(160)]
    t = tables(spark, articles=articles)

    def service(kind):
        def run(frames):
            for pdf in frames:
                bad = (pdf["article_id"] % 10 == 0) & (kind is not None)
                yield pd.DataFrame({"article_id": pdf["article_id"], "requested_url": pdf["url"], "final_url": pdf["url"], "full_text": ["" if b else "text" for b in bad], "http_status": 200, "content_type": "x", "failure_kind": [kind if b else None for b in bad], "retryable": True, "message": ""})

        return run

    asked = lambda kind, **kw: enrich.run_queue(t, at(), 1, CODES, size=40, reader=service(kind), scorer=enrich.rule_scorer(("tax",), "trade_tariff"), parallelism=4, **kw)
    out = asked("reader_http_429", wave=2)
    rows = out["article_contents"].collect()
    first = {r[0] for r in spark.range(160).where(F.pmod(F.xxhash64("id"), F.lit(enrich.ROUNDS)) == 0).collect()}
    assert rows and {r["article_id"] for r in rows} <= first and len(rows) == len({r["article_id"] for r in rows}) < 40
    assert out["ai_analysis_runs"].count() == 2 and out["ai_analysis_run_items"].where("status = 'pending'").count() == 80 - len(rows)
    assert asked(None)["article_contents"].count() == 160


def test_texts_of_a_source_are_dealt_to_all_tasks(spark):
    """Items of one source stay in the tasks that read them, and texts that no window admits are left behind."""
    from quillstream.operators import collect

    made = spark.range(400, numPartitions=4).select(F.lit(1).cast("long").alias("rss_source_id"), F.lit(7).cast("long").alias("keyword_id"), F.col("id").cast("int").alias("position"), F.lit("License").alias("title"), F.concat(F.lit("x"), "id").alias("summary"))
    items = made.withColumn("published_at", F.when(F.col("position") % 2 == 0, F.lit("2024-01-02")).otherwise("2024-01-09").cast("timestamp"))
    tasks = spark.createDataFrame([(1, 7, ["license"])], "rss_source_id long, keyword_id long, match_terms array<string>").withColumn("window_start", F.lit("2024-01-01").cast("timestamp"))
    read = collect.scanned(items, tasks, F.lit("2024-01-03").cast("timestamp"))
    assert len(read.inputFiles()) == 4 and read.count() == 400
    assert read.where("summary is not null").count() == read.where("size(_held) = 1").count() == 200
    rows = collect.judged(read, tasks, F.lit("2024-01-03").cast("timestamp"), True)
    assert {(r["outcome"], r["count"]) for r in rows.groupBy("outcome").count().collect()} == {("matched", 200), ("outside", 200)}
    assert collect.with_texts(rows.where("outcome = 'matched'"), read).where("title = 'License' and summary = concat('x', position)").count() == 200


def test_content_is_cleaned_once(spark):
    """Text, hash and length come from one cleaning of the text."""
    from quillstream.functions import text

    got = spark.createDataFrame([(1, "u", "u", "a  b\n\n\n\nc ", 200, "text/plain", None, True, ""), (2, "u", "u", "  ", 200, "text/plain", "empty_content", True, "no text")], enrich.CONTENT)
    once = text.normalize_full_text(F.col("full_text"))
    out = enrich.with_content(empty(spark, "article_contents"), got, F.lit("2024-01-01").cast("timestamp"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pieces = lambda df: plan(df).count("regexp_replace(")
    assert pieces(out) == pieces(got.select(once.alias("x"))) > 0
    want = got.where("article_id = 1").select(once.alias("t"), text.content_hash(once).alias("h"), F.length(once).alias("n")).first()
    rows = {r["article_id"]: r for r in out.collect()}
    assert (rows[1]["full_text"], rows[1]["content_hash"], rows[1]["content_chars"]) == (want["t"], want["h"], want["n"])
    assert (rows[2]["status"], rows[2]["full_text"], rows[2]["content_hash"], rows[2]["content_chars"]) == ("failed", None, None, None)


def test_a_run_reads_its_items_once(spark):
    """Counts are taken from what was numbered, not from the items anew."""
    from quillstream.operators import collect

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    rows = items_of(spark, *(item(1, 1, k, url=f"https://n.org/{k}", title=f"Tariff {k}", published_at=datetime(2026, 7, 22, 3)) for k in range(30)))
    items = rows.mapInPandas(counted, rows.schema)
    made = collect.changes(tables(spark, rss_sources=[source(1)], keywords=[keyword(1, ["tariff"])]), items, F.lit("2026-07-22 04:00:00").cast("timestamp"), 1)
    run = made["collection_runs"].collect()[0]
    assert (run["items_seen"], run["items_inserted"]) == (30, 30) and made["collection_run_details"].collect()[0]["items_seen"] == 30
    assert [made[n].count() for n in ("articles", "article_sources", "article_keywords")] == [30, 30, 30] and seen.value == 30
