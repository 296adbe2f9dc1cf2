"""Runs, read models, configuration, recovery and cleanup over the sample tables, through the library's own functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import dates
from quillstream.operators import collect, config, enrich, recovery, report, retention, sinks
from quillstream.operators.lineage import cut, shared_folder
from quillstream.plans import read_models as q
from quillstream.plans.catalog import now, query, read, stamp
from quillstream.sources import tables, textindex
from quillstream.sources.store import Store
from quillstream.sources.tables import SCHEMAS, Tables, aligned, empty
from quillstream.streaming import collect as stream

_MOMENT = "(TIMESTAMP '2024-01-01' + to_minutes(doc_id))"
_DAYS = "published_at >= TIMESTAMP '2023-12-31 16:00:00' AND published_at < TIMESTAMP '2024-01-01 16:00:00'"


def _minutes(c: str = "doc_id", first: str = "2024-01-01"):
    return dates.later(dates.at(first), minutes=F.col(c))


def _rows(df: DataFrame, name: str, *columns) -> DataFrame:
    return aligned(df.select(*columns), name)


# ---- articles with their children -------------------------------------------------------------------------------


def _library(spark: SparkSession, d: str) -> Tables:
    """Documents as articles that one or two of twenty sources carried, with strategies that match every second and third."""
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    a = _rows(docs, "articles", n.alias("id"), F.concat(F.lit("t"), n).alias("title"), F.concat(F.lit("https://n.org/"), n).alias("url"), F.concat(F.lit("https://n.org/"), n).alias("canonical_url"), F.col("source").alias("publisher"), F.col("text").alias("summary"), _minutes().alias("published_at"), F.when(n % 5 == 0, now()).otherwise(_minutes()).alias("collected_at"))
    seen = docs.select("doc_id", "lang", F.explode(F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    source = (F.col("doc_id") * 7 + F.col("k")) % 20
    s = _rows(seen, "article_sources", F.col("doc_id").alias("article_id"), source.alias("rss_source_id"), F.concat(F.lit("https://n.org/"), n).alias("canonical_url"), F.concat(F.lit("https://s.org/"), source, F.lit("/"), n).alias("observed_url"), F.when(F.col("k") == 0, F.col("lang")).otherwise("xx").alias("language"), F.when(F.col("k") == 0, "US").otherwise("").alias("country"), F.array(F.lit("c"), F.col("lang")).alias("categories"), dates.later(_minutes(), minutes=60 * F.col("k")).alias("first_seen_at"))
    k = docs.select("doc_id", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda x: n % (x + 1) == 0)).alias("k"))
    ak = _rows(k, "article_keywords", F.col("doc_id").alias("article_id"), F.col("k").cast("long").alias("keyword_id"), F.array(F.lit("x")).alias("matched_terms"))
    names = _rows(spark.range(20), "rss_sources", "id", F.concat(F.lit("s"), F.col("id")).alias("name"))
    words = _rows(spark.createDataFrame([(1, "b"), (2, "a")], "id long, name string"), "keywords", "id", "name")
    runs = _rows(spark.createDataFrame([(7,)], "id long"), "collection_runs", "id", F.lit("success").alias("status"), now().alias("started_at"))
    return {"articles": a, "article_sources": s, "article_keywords": ak, "rss_sources": names, "keywords": words, "collection_runs": runs}


_LIBRARY = f"""WITH a AS (SELECT doc_id AS id, source AS publisher, lang, text AS summary, 'https://n.org/' || doc_id AS url, 't' || doc_id AS title, {_MOMENT} AS published_at, doc_id % 5 = 0 AS in_run FROM documents),
child AS (SELECT id, CASE WHEN id % 3 = 0 THEN 's' || (id * 7 % 20) || ',s' || ((id * 7 + 1) % 20) ELSE 's' || (id * 7 % 20) END AS sources, CASE WHEN id % 6 = 0 THEN 'a,b' WHEN id % 3 = 0 THEN 'a' WHEN id % 2 = 0 THEN 'b' ELSE '' END AS keywords,
 CASE WHEN id % 3 = 0 THEN lang || ',xx' ELSE lang END AS languages, 'US' AS countries, 'c,' || lang AS categories FROM a)"""


def _told(df: DataFrame) -> DataFrame:
    names = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ","), F.lit("")).alias(c)
    return df.select("id", names("sources", "source_name"), names("keywords", "name"), *[F.array_join(c, ",").alias(a) for c, a in (("languages", "languages"), ("countries", "countries"), ("all_categories", "categories"))])


_FOUND = "(title ILIKE '%licens%' OR summary ILIKE '%licens%' OR publisher ILIKE '%licens%' OR url ILIKE '%licens%')"


@query("article_search", f"{_LIBRARY} SELECT c.* FROM child c JOIN (SELECT id, published_at FROM a WHERE {_FOUND} ORDER BY published_at DESC, id DESC LIMIT 50 OFFSET 5) x USING (id)")
def article_search(spark, d):
    return _told(q.search(_library(spark, d), q="licens", limit=50, offset=5))


@query("article_search_filtered", f"{_LIBRARY} SELECT c.* FROM child c JOIN (SELECT id, published_at FROM a WHERE (id * 7 % 20 = 4 OR (id % 3 = 0 AND (id * 7 + 1) % 20 = 4)) AND id % 2 = 0 AND lang = 'en' ORDER BY published_at DESC, id DESC LIMIT 200) x USING (id)")
def article_search_filtered(spark, d):
    return _told(q.search(_library(spark, d), keyword_id=1, source_id=4, language="en", country="US", limit=200))


@query("article_search_count", f"{_LIBRARY} SELECT count(*) AS total FROM a WHERE {_DAYS} AND in_run AND id % 3 = 0")
def article_search_count(spark, d):
    return q.search(_library(spark, d), keyword_id=2, run_id=7, day_from="2024-01-01", count=True)


@query("article_with_children", f"{_LIBRARY} SELECT * FROM child")
def article_with_children(spark, d):
    t = _library(spark, d)
    return _told(q.with_children(t["articles"], t))


@query("article_for_analysis", f"{_LIBRARY} SELECT c.*, 'https://n.org/12 https://s.org/4/12 https://s.org/5/12' AS urls, 'full' AS full_text FROM child c WHERE id = 12")
def article_for_analysis(spark, d):
    t = _library(spark, d)
    t["article_contents"] = _rows(read(spark, d, "documents"), "article_contents", F.col("doc_id").alias("article_id"), F.lit("success").alias("status"), F.lit("full").alias("full_text"))
    row = q.article_for_analysis(t, 12)
    return _told(row).join(row.select("id", F.array_join("urls", " ").alias("urls"), "full_text"), "id")


@query("queue_of_run", "SELECT doc_id AS article_id, 0 AS rank FROM documents WHERE doc_id % 5 = 0 AND doc_id % 4 <> 0")
def queue_of_run(spark, d):
    """What awaits work of one collection run; every fourth article is done."""
    t = _library(spark, d)
    docs, n = read(spark, d, "documents"), F.col("doc_id").alias("article_id")
    done = docs.where("doc_id % 4 = 0")
    t["article_contents"] = _rows(done, "article_contents", n, F.lit("success").alias("status"), F.lit("h").alias("content_hash"))
    t["article_relevance_reviews"] = _rows(done, "article_relevance_reviews", n, F.lit("success").alias("status"), F.lit("h").alias("content_hash"), F.lit(0).alias("is_relevant"))
    t["business_articles"] = empty(spark, "business_articles")
    return enrich.candidates(t, now(), run_id=7).select("article_id", "rank")


@query("system_status", "SELECT (SELECT count(*) FROM documents) AS articles, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS rss_sources, 2 AS keywords, (SELECT max(o_orderkey) FROM orders) AS latest_run, '2024-02-01 00:00:00' AS next_report")
def system_status(spark, d):
    t = _library(spark, d)
    t["rss_sources"] = _rows(read(spark, d, "supplier"), "rss_sources", F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(1).alias("active"))
    t["collection_runs"] = _rows(read(spark, d, "orders"), "collection_runs", F.col("o_orderkey").alias("id"), F.lit("success").alias("status"), dates.instant_of(F.col("o_orderdate")).alias("started_at"))
    row = q.system_status(t, F.lit(datetime.fromisoformat("2024-01-31T10:00:00+00:00")), "08:00")
    return row.select("articles", "rss_sources", "keywords", F.col("latest_run.id").alias("latest_run"), stamp(F.col("next_report_at")).alias("next_report"))


# ---- runs -------------------------------------------------------------------------------------------------------


@query("run_details", "SELECT l_partkey % 50 AS rss_source_id, l_linenumber AS keyword_id, 's' || (l_partkey % 50) AS source_name, 'k' || l_linenumber AS keyword_name, l_orderkey AS items_seen FROM lineitem WHERE l_suppkey % 10 = 3 AND l_linenumber <= 5")
def run_details(spark, d):
    """The details of one of ten runs."""
    rows = _rows(read(spark, d, "lineitem"), "collection_run_details", (F.col("l_suppkey") % 10).alias("run_id"), (F.col("l_partkey") % 50).alias("rss_source_id"), F.col("l_linenumber").cast("long").alias("keyword_id"), F.col("l_orderkey").alias("items_seen"))
    named = lambda table, n, letter: _rows(spark.range(n), table, "id", F.concat(F.lit(letter), F.col("id")).alias("name"))
    t = {"collection_run_details": rows, "rss_sources": named("rss_sources", 50, "s"), "keywords": named("keywords", 6, "k")}
    return q.collection_run(t, 3).select("rss_source_id", "keyword_id", "source_name", "keyword_name", "items_seen")


@query("analysis_run", f"SELECT doc_id AS article_id, 't' || doc_id AS title, CASE WHEN doc_id % 13 <> 0 THEN 'f' || doc_id END AS final_url, quality * 50 AS relevance_score, CASE WHEN doc_id % 2 = 0 AND quality IS NOT NULL THEN doc_id % 101 END AS risk_score FROM documents LEFT JOIN labels USING (doc_id)")
def analysis_run(spark, d):
    """A run over all articles, with what its stages left."""
    docs, labels, n = read(spark, d, "documents"), read(spark, d, "labels"), F.col("doc_id").alias("article_id")
    t = {
        "ai_analysis_run_items": _rows(docs, "ai_analysis_run_items", F.lit(4).alias("run_id"), n, F.lit("success").alias("status")).unionByName(_rows(docs, "ai_analysis_run_items", F.lit(5).alias("run_id"), n, F.lit("failed").alias("status"))),
        "articles": _rows(docs, "articles", F.col("doc_id").alias("id"), F.concat(F.lit("t"), F.col("doc_id")).alias("title")),
        "article_contents": _rows(docs.where("doc_id % 13 <> 0"), "article_contents", n, F.concat(F.lit("f"), F.col("doc_id")).alias("final_url")),
        "article_relevance_reviews": _rows(labels, "article_relevance_reviews", n, (F.col("quality") * 50).alias("relevance_score")),
        "business_articles": _rows(labels.where("doc_id % 2 = 0"), "business_articles", n, (F.col("doc_id") % 101).cast("int").alias("risk_score")),
    }
    return q.analysis_run(t, 4).select("article_id", "title", "final_url", "relevance_score", F.col("risk_score").cast("long").alias("risk_score"))


def _collection(spark: SparkSession, d: str) -> tuple[Tables, DataFrame]:
    """Two searching sources and a direct one, three strategies, and documents as what they answered: each document comes from one
    search, every third from the direct source too, under another form of its URL."""
    t = {n: empty(spark, n) for n in SCHEMAS}
    s = [(1, "search", "en", "https://s.org/?q={query}"), (2, "search", "en-GB", "https://t.org/?q={query}"), (3, "direct", "", "https://u.org/feed"), (4, "direct", "fr", "https://v.org/feed")]
    t["rss_sources"] = _rows(spark.createDataFrame(s, "id long, mode string, language string, url_template string"), "rss_sources", "*", F.concat(F.lit("s"), F.col("id")).alias("name"))
    k = [(1, ["licens", "the"], 1), (2, [" der "], 0), (3, ["关税"], 1)]
    t["keywords"] = _rows(spark.createDataFrame(k, "id long, match_terms array<string>, require_local_match int"), "keywords", "*", F.array().cast("array<string>").alias("context_terms"), F.array().cast("array<string>").alias("exclude_terms"), F.lit(14).alias("lookback_days"))
    t["collection_cursors"] = aligned(spark.createDataFrame([(1, 1, datetime(2024, 1, 1, 1)), (9, 9, datetime(2024, 1, 1))], "rss_source_id long, keyword_id long, last_collected_at timestamp"), "collection_cursors")
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    fields = [F.concat(F.lit("T "), n).alias("title"), F.col("source").alias("publisher"), F.col("text").alias("summary"), F.when(n % 11 != 0, _minutes()).alias("published_at"), F.lit("").alias("guid"), F.array().cast("array<string>").alias("categories")]
    own = docs.select((n % 2 + 1).alias("rss_source_id"), (n % 4 - n % 2).cast("long").alias("k"), n.cast("int").alias("position"), F.concat(F.lit("https://n.org/"), n, F.lit("?utm_source=x")).alias("url"), *fields)
    own = own.withColumn("keyword_id", F.when(F.col("k") == 0, 1).otherwise(2).cast("long")).drop("k")
    also = docs.where(n % 3 == 0).select(F.lit(3).cast("long").alias("rss_source_id"), n.cast("int").alias("position"), F.concat(F.lit("HTTPS://N.org/"), n, F.lit("/")).alias("url"), *fields).withColumn("keyword_id", F.lit(None).cast("long"))
    return t, own.unionByName(also)


# of each pair its items: outcome, and whether the item's article is new (a search comes before the direct source)
_JUDGED = f"""WITH hit AS (SELECT doc_id, contains(lower(text), 'licens') OR contains(lower(text), 'the') AS one, contains(lower(text), 'der') AS two, doc_id % 2 + 1 AS source, CASE WHEN doc_id % 4 - doc_id % 2 = 0 THEN 1 ELSE 2 END AS keyword, CASE WHEN doc_id % 11 <> 0 THEN {_MOMENT} END AS seen FROM documents),
item AS (SELECT doc_id, source, keyword, CASE keyword WHEN 1 THEN one ELSE two END AS matched, seen FROM hit UNION ALL SELECT doc_id, 3, 1, one, seen FROM hit WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 3, 2, two, seen FROM hit WHERE doc_id % 3 = 0),
judged AS (SELECT *, CASE WHEN source = 1 AND keyword = 1 THEN TIMESTAMP '2024-01-01 01:00:00' ELSE TIMESTAMP '2023-12-21 16:00:00' END AS start FROM item),
told AS (SELECT *, CASE WHEN seen IS NULL THEN 'undated' WHEN seen < start OR seen > TIMESTAMP '2024-01-04' THEN 'outside' WHEN NOT matched THEN 'unmatched' ELSE 'matched' END AS outcome FROM judged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source, keyword) AS nth FROM told WHERE outcome = 'matched')"""


def _later():
    return dates.at("2024-01-04")


@query("judged_items", f"{_JUDGED} SELECT doc_id AS position, source AS rss_source_id, keyword AS keyword_id, outcome FROM told")
def judged_items(spark, d):
    t, items = _collection(spark, d)
    tasks = collect.windows(collect.route(t["rss_sources"], t["keywords"]), t["collection_cursors"], _later(), collect.CollectSettings())
    rows = collect.judged(items, tasks, _later(), True).where("keyword_id < 3")
    return rows.select(F.col("position").cast("long").alias("position"), "rss_source_id", "keyword_id", "outcome")


def _run(spark, d) -> Tables:
    t, items = _collection(spark, d)
    return collect.collect(t, items, _later(), 1)


@query("collection_details", f"""{_JUDGED}, n AS (SELECT source, keyword, count(*) FILTER (nth = 1) AS inserted, count(*) FILTER (nth > 1) AS duplicates FROM ranked GROUP BY 1, 2)
 SELECT source AS rss_source_id, keyword AS keyword_id, count(*) AS items_seen, count_if(outcome = 'matched') AS items_matched, coalesce(any_value(inserted), 0) AS items_inserted, coalesce(any_value(duplicates), 0) AS duplicates, count_if(outcome = 'outside') AS outside, count_if(outcome = 'undated') AS undated FROM told LEFT JOIN n USING (source, keyword) GROUP BY 1, 2""")
def collection_details(spark, d):
    rows = _run(spark, d)["collection_run_details"].where("keyword_id < 3 and status = 'success'")
    return rows.select("rss_source_id", "keyword_id", "items_seen", "items_matched", "items_inserted", "duplicates", F.col("skipped_outside_window").alias("outside"), F.col("skipped_without_date").alias("undated"))


@query("collection_run", f"{_JUDGED} SELECT 'success' AS status, (SELECT count(*) + count(*) FILTER (doc_id % 3 = 0) FROM documents) AS items_seen, count(*) AS items_matched, count(*) FILTER (nth = 1) AS items_inserted, count(*) FILTER (nth > 1) AS duplicates, '2023-12-21 16:00:00' AS window_start FROM ranked")
def collection_run(spark, d):
    return _run(spark, d)["collection_runs"].select("status", "items_seen", "items_matched", "items_inserted", "duplicates", stamp(F.col("window_start")).alias("window_start"))


@query("collected_articles", f"{_JUDGED} SELECT 'https://n.org/' || doc_id AS canonical_url, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords, count(DISTINCT source) AS sources FROM ranked GROUP BY doc_id")
def collected_articles(spark, d):
    """One article for each document that matched, wherever it was seen, with its strategies and sources."""
    t = _run(spark, d)
    k = t["article_keywords"].groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("keyword_id").cast("string"))), ",").alias("keywords"))
    s = t["article_sources"].groupBy("article_id").agg(F.count_distinct("rss_source_id").alias("sources"))
    return t["articles"].join(k, F.col("id") == k["article_id"]).drop("article_id").join(s, F.col("id") == s["article_id"]).select("canonical_url", "keywords", "sources")


@query("streamed_articles", f"{_JUDGED} SELECT 'https://n.org/' || doc_id AS canonical_url, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords FROM ranked GROUP BY doc_id UNION ALL SELECT 'cursors', (SELECT count(*) + 1 FROM (SELECT DISTINCT source, keyword FROM told)) + 1")
def streamed_articles(spark, d):
    """The same items as files that arrive: a micro-batch over snapshots, its cursors written last. French sources take no
    strategy; the third strategy, in Chinese alone, meets the direct source only."""
    t, items = _collection(spark, d)
    folder, arriving = shared_folder(spark, "stream"), shared_folder(spark, "items")
    for name, df in t.items():
        df.write.parquet(f"{folder}/base/{name}")
    columns = [x.split(" ") for x in stream.ITEMS.split(", ")]
    items.select([F.col(name).cast(kind) for name, kind in columns]).write.parquet(arriving)
    stream.collected_stream(spark, arriving, folder, lambda batch: datetime(2024, 1, 4)).awaitTermination()
    out = stream.current(spark, folder, 0)
    k = out["article_keywords"].groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("keyword_id").cast("string"))), ",").alias("keywords"))
    rows = out["articles"].join(k, F.col("id") == k["article_id"]).select("canonical_url", "keywords")
    return rows.unionByName(out["collection_cursors"].agg(F.lit("cursors").alias("canonical_url"), F.count(F.lit(1)).cast("string").alias("keywords")))


@query("streamed_in_batches", f"""{_JUDGED.replace("CASE WHEN source = 1 AND keyword = 1 THEN TIMESTAMP '2024-01-01 01:00:00' ELSE TIMESTAMP '2023-12-21 16:00:00' END", "TIMESTAMP '2023-12-21 16:00:00'")} SELECT 'https://n.org/' || doc_id AS canonical_url, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords FROM ranked GROUP BY doc_id
 UNION ALL SELECT 'cursors', (SELECT count(*) + 1 FROM (SELECT DISTINCT source, keyword FROM told)) + 1 UNION ALL SELECT 'runs', '3' UNION ALL SELECT 'sightings', (SELECT count(*) FROM (SELECT DISTINCT doc_id, source FROM ranked))""")
def streamed_in_batches(spark, d):
    """The items in three arrivals, each of which also holds the half of the one before it: three micro-batches, each a transaction over buckets,
    leave what one batch of all items would. The stream is started for each arrival and goes on from its checkpoint, so an arrival has as
    many files as the tasks that wrote it."""
    t, items = _collection(spark, d)
    folder, arriving = shared_folder(spark, "stream"), shared_folder(spark, "items")
    for name, df in t.items():
        df.write.parquet(f"{folder}/base/{name}")
    columns = [x.split(" ") for x in stream.ITEMS.split(", ")]
    items = items.select([F.col(name).cast(kind) for name, kind in columns])
    for k in range(3):
        own = F.col("position") % 3 == k
        again = (F.col("position") % 3 == (k + 2) % 3) & (F.col("position") % 2 == 0) & (k > 0)
        items.where(own | again).write.mode("append").parquet(arriving)
        stream.collected_stream(spark, arriving, folder, lambda batch: datetime(2024, 1, 4), collect.CollectSettings(incremental=False), buckets=4).awaitTermination()
    out = stream.current(spark, folder)
    k = out["article_keywords"].groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("keyword_id").cast("string"))), ",").alias("keywords"))
    rows = out["articles"].join(k, F.col("id") == k["article_id"]).select("canonical_url", "keywords")
    counted = lambda name, table: out[table].agg(F.lit(name).alias("canonical_url"), F.count(F.lit(1)).cast("string").alias("keywords"))
    return rows.unionByName(counted("cursors", "collection_cursors")).unionByName(counted("runs", "collection_runs")).unionByName(counted("sightings", "article_sources"))


@query("indexed_search", "SELECT DISTINCT doc_id AS id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%the%ing%' OR source ILIKE '%license%' OR source ILIKE '%the%ing%'")
def indexed_search(spark, d):
    """Documents as articles of a store, sought by two patterns in the files that their trigrams leave."""
    n = F.col("doc_id")
    rows = read(spark, d, "documents").select(n.alias("id"), F.concat(F.lit("T"), n).alias("title"), F.col("text").alias("summary"), F.col("source").alias("publisher"), F.lit("").alias("url"))
    kept = Store(spark, shared_folder(spark, "searched"))
    t = kept.begin()
    t.replace("articles", rows, ["id"], 8)
    last = t.commit()
    index = cut(textindex.signatures(last, "articles"))
    return textindex.holding(last, "articles", index, "License").unionByName(textindex.holding(last, "articles", index, "the%ing")).select("id").distinct()


@query("snapshot", "SELECT doc_id AS id, 't' || doc_id AS title, source AS publisher FROM documents")
def snapshot(spark, d):
    """A snapshot of the tables, read again as a folder of tables."""
    path = sinks.snapshot({"articles": _library(spark, d)["articles"]}, shared_folder(spark, "snapshots"), "s1")
    return tables.load(spark, path, ["articles", "keywords"])["articles"].select("id", "title", "publisher")


@query("active_categories", "SELECT n_nationkey AS id, row_number() OVER (ORDER BY coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 5 END, 999999), n_nationkey) AS nth FROM nation WHERE n_nationkey % 4 <> 0")
def active_categories(spark, d):
    n = F.col("n_nationkey").cast("long")
    c = _rows(read(spark, d, "nation"), "keyword_categories", n.alias("id"), F.when(n % 3 == 0, (n % 5).cast("int")).alias("sort_order"), F.when(n % 4 == 0, 0).otherwise(1).alias("active"))
    rows = q.categories({"keyword_categories": c}).collect()  # a few rows of configuration, in their order
    return spark.createDataFrame([(r["id"], k + 1) for k, r in enumerate(rows)], "id long, nth long")


@query("collected_again", f"{_JUDGED} SELECT count(*) AS items_matched, 0 AS items_inserted, count(*) AS duplicates FROM ranked")
def collected_again(spark, d):
    """The same items in a second run that looks at its whole window again: nothing is new."""
    t, items = _collection(spark, d)
    t["collection_cursors"] = t["collection_cursors"].where("rss_source_id = 1")
    first = collect.collect(t, items, _later(), 1)
    first["collection_cursors"] = t["collection_cursors"]
    rows = collect.collect(first, items, _later(), 2)["collection_runs"].where("id = 2")
    return rows.select("items_matched", F.col("items_inserted").cast("int").alias("items_inserted"), "duplicates")


@query("language_routing", """SELECT doc_id AS rss_source_id, k.id AS keyword_id, CASE WHEN lang = 'en' THEN k.en ELSE k.every END AS terms FROM documents, (VALUES (1, 'tariff', 'tariff,关税'), (2, '', '贸易'), (3, '42', '42')) k(id, en, every) WHERE lang = 'en' AND k.en <> '' OR lang = 'de'""")
def language_routing(spark, d):
    """A source a document: its language cuts the strategies' terms, and one without language (German ones here) takes them all."""
    docs = read(spark, d, "documents")
    s = _rows(docs, "rss_sources", F.col("doc_id").alias("id"), F.when(F.col("lang") != "de", F.concat(F.col("lang"), F.lit("-XX"))).otherwise("").alias("language"), F.lit("direct").alias("mode"))
    none = F.array().cast("array<string>")
    k = _rows(spark.createDataFrame([(1, ["tariff", "关税"]), (2, ["贸易"]), (3, ["42"])], "id long, match_terms array<string>"), "keywords", "*", none.alias("context_terms"), none.alias("exclude_terms"))
    return collect.route(s, k).select("rss_source_id", F.col("keyword_id").cast("int").alias("keyword_id"), F.array_join("match_terms", ",").alias("terms"))


_HEALTH = "CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'rate_limited' WHEN s_suppkey % 4 = 2 THEN 'access_blocked' ELSE 'cooldown' END"


@query("crawler_health", f"""WITH o AS (SELECT s_suppkey AS id, s_suppkey % 7 AS failures, s_suppkey % 5 <> 0 AS told, {_HEALTH} AS kind FROM supplier)
 SELECT id, CASE WHEN told AND kind IS NULL THEN 0 WHEN told AND kind <> 'cooldown' THEN failures + 1 ELSE failures END AS failures, CASE WHEN told AND kind = 'rate_limited' THEN '2024-02-01 01:00:00' WHEN told AND kind = 'access_blocked' THEN '2024-02-02 00:00:00' END AS until, CASE WHEN told AND kind IS NULL THEN 'success' WHEN told AND kind <> 'cooldown' THEN kind ELSE 'before' END AS status FROM o""")
def crawler_health(spark, d):
    n = F.col("s_suppkey")
    rows = read(spark, d, "supplier")
    s = _rows(rows, "rss_sources", n.alias("id"), (n % 7).cast("int").alias("crawler_failures"), F.lit("before").alias("crawler_last_status"))
    kind = F.when(n % 4 == 1, "rate_limited").when(n % 4 == 2, "access_blocked").when(n % 4 == 3, "cooldown")
    o = rows.where(n % 5 != 0).select(n.alias("rss_source_id"), kind.alias("kind"), F.lit(None).cast("int").alias("explicit_seconds"), F.lit("m").alias("message"))
    out = collect.crawler_health(s, o, now())
    return out.select("id", F.col("crawler_failures").cast("long").alias("failures"), stamp(F.col("crawler_cooldown_until")).alias("until"), F.col("crawler_last_status").alias("status"))


# ---- the queue and its stages -----------------------------------------------------------------------------------


_SCORED = """WITH p AS (SELECT doc_id, text, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) <> '' AS told, contains(lower(text), 'licens')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS hits FROM documents)"""


def _enriched(spark, d) -> Tables:
    docs = read(spark, d, "documents")
    t = {n: empty(spark, n) for n in SCHEMAS}
    t["articles"] = _rows(docs, "articles", F.col("doc_id").alias("id"), F.lit("0").alias("title"), F.concat(F.lit("https://n.org/"), F.col("doc_id")).alias("url"), F.col("text").alias("summary"), _minutes().alias("published_at"))
    return enrich.run_queue(t, now(), 1, ("trade", "other"), size=100, scorer=enrich.rule_scorer(("licens", "the", "and"), "trade"))


@query("queue_run", f"""{_SCORED}, b AS (SELECT *, floor((row_number() OVER (ORDER BY doc_id DESC) - 1) / 100) + 1 AS run_id FROM p)
 SELECT CAST(run_id AS BIGINT) AS id, CASE WHEN count_if(NOT told) = 0 THEN 'success' WHEN count_if(told) = 0 THEN 'failed' ELSE 'partial' END AS status, CAST(count(*) AS INT) AS total, CAST(count_if(told) AS INT) AS succeeded, CAST(count_if(told AND hits >= 2) AS INT) AS relevant, CAST(coalesce(sum(CASE WHEN told THEN 2 + hits + CASE WHEN hits >= 2 THEN 3 ELSE 0 END END), 0) AS INT) AS tokens FROM b GROUP BY 1""")
def queue_run(spark, d):
    """The whole queue through reading, the relevance gate and analysis, in runs of a hundred."""
    rows = _enriched(spark, d)["ai_analysis_runs"]
    return rows.select("id", "status", F.col("articles_total").alias("total"), F.col("articles_succeeded").alias("succeeded"), F.col("articles_relevant").alias("relevant"), (F.col("prompt_tokens") + F.col("completion_tokens")).cast("int").alias("tokens"))


@query("queue_items", f"""{_SCORED} SELECT doc_id AS article_id, CASE WHEN told THEN 'success' ELSE 'failed' END AS status, CASE WHEN told THEN 'success' ELSE 'failed' END AS content_status, CASE WHEN told THEN 'success' ELSE 'skipped' END AS relevance_status, CASE WHEN told AND hits >= 2 THEN 'success' ELSE 'skipped' END AS business_analysis_status, CASE WHEN told THEN (hits >= 2)::INT END AS is_relevant FROM p""")
def queue_items(spark, d):
    return _enriched(spark, d)["ai_analysis_run_items"].select("article_id", "status", "content_status", "relevance_status", "business_analysis_status", "is_relevant")


@query("negative_reviews", "SELECT doc_id AS article_id, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN doc_id % 10 <> 0 THEN quality END AS is_relevant, doc_id % 10 = 0 OR quality = 1 AS accepted FROM labels")
def negative_reviews(spark, d):
    """Reviews of articles that had been accepted: a negative one takes the accepted row away, a broken one does not."""
    labels, n = read(spark, d, "labels"), F.col("doc_id").alias("article_id")
    t = {name: empty(spark, name) for name in SCHEMAS}
    t["article_contents"] = _rows(labels, "article_contents", n, F.lit("success").alias("status"), F.lit("h").alias("content_hash"), F.lit("x").alias("full_text"))
    t["business_articles"] = _rows(labels, "business_articles", n, F.lit("success").alias("analysis_status"))
    none, number = F.array().cast("array<string>"), F.lit(0).cast("long")
    results = labels.select(n, F.col("quality").alias("is_relevant"), F.lit(90).alias("relevance_score"), F.lit("r").alias("relevance_reason"), F.when(F.col("doc_id") % 10 == 0, "unheard").otherwise("other").alias("category"), none.alias("secondary_categories"), none.alias("keyword_categories"), none.alias("evidence"), F.lit(50).alias("confidence"), number.alias("prompt_tokens"), number.alias("completion_tokens"), F.lit(None).cast("string").alias("error"))
    out = enrich.with_reviews(t, results, now(), ("trade", "other"), 70, "v1")
    kept = out["business_articles"].select("article_id", F.lit(True).alias("accepted"))
    return out["article_relevance_reviews"].join(kept, "article_id", "left").select("article_id", "status", "is_relevant", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("fact_boundary", """SELECT doc_id AS article_id, CASE WHEN contains(text, 'the') THEN 'Acme wins. Prices rise.' ELSE 'Prices rise.' END AS summary, CASE WHEN contains(text, 'the') THEN 'Acme alone.' WHEN doc_id % 2 = 0 THEN 'costs may pass on; not named' ELSE 'somehow; not named' END AS impact, CASE WHEN contains(text, 'the') THEN 'Acme|x' ELSE 'x' END AS evidence FROM documents""")
def fact_boundary(spark, d):
    """Analyses that speak of a company: its sentences stay only where the text names it (here, where it holds 'the')."""
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    t = {name: empty(spark, name) for name in SCHEMAS}
    t["article_contents"] = _rows(docs, "article_contents", n.alias("article_id"), F.lit("success").alias("status"), F.lit("h").alias("content_hash"), F.col("text").alias("full_text"))
    none, number = F.array().cast("array<string>"), F.lit(0).cast("long")
    results = docs.select(n.alias("article_id"), F.when(n % 2 == 0, "trade").otherwise("other").alias("category"), none.alias("secondary_categories"), F.lit("Acme wins. Prices rise.").alias("summary"), F.lit("neutral").alias("impact_direction"), F.lit(1).alias("impact_score"), F.lit("Acme alone.").alias("impact_analysis"), F.lit("low").alias("risk_level"), F.lit(1).alias("risk_score"), none.alias("risk_factors"), none.alias("opportunities"), none.alias("recommended_actions"), F.array(F.lit("Acme"), F.lit("x")).alias("evidence"), number.alias("prompt_tokens"), number.alias("completion_tokens"), F.lit(None).cast("string").alias("error"))
    boundary = enrich.Boundary("Acme|the", analysis_note="; not named", paths=(("trade", "costs may pass on"),), other_path="somehow", summary="Prices rise.")
    out = enrich.with_analyses(t, results, now(), ("trade", "other"), boundary)["business_articles"]
    return out.select("article_id", "summary", F.col("impact_analysis").alias("impact"), F.array_join("evidence", "|").alias("evidence"))


def _contents(spark, d) -> DataFrame:
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    failed = F.when(n % 2 == 0, "failed").otherwise("success")
    kind = F.when(n % 12 == 0, "http_500").when(n % 12 == 2, "dns").when(n % 12 == 4, "httpx500").when(n % 12 == 6, "not_found").otherwise("")
    return _rows(docs, "article_contents", n.alias("article_id"), failed.alias("status"), kind.alias("failure_kind"), F.when(n % 24 == 0, "kept").alias("full_text"), F.when(n % 5 == 0, "old").otherwise("new").alias("extractor"), F.lit(3).alias("attempt_count"), F.lit(1).alias("is_terminal"), now().alias("ignored_at"))


@query("retried_content", "SELECT doc_id AS article_id, CASE WHEN doc_id = 8 THEN 0 ELSE 3 END AS attempts, CASE WHEN doc_id = 8 THEN 0 ELSE 1 END AS terminal, doc_id = 10 OR doc_id <> 8 AS ignored FROM documents")
def retried_content(spark, d):
    """By hand: one failure is new again, another ignored; a success (id 7) is neither."""
    out = enrich.retried(enrich.retried(_contents(spark, d), 8), 7)
    out = enrich.ignored(out, 10, now())
    return out.select("article_id", F.col("attempt_count").alias("attempts"), F.col("is_terminal").alias("terminal"), F.col("ignored_at").isNotNull().alias("ignored"))


@query("purged_contents", """WITH c AS (SELECT doc_id, doc_id % 2 = 0 AS failed, doc_id % 12 IN (0, 2, 4) AS old, doc_id % 24 = 0 AS holds FROM documents)
 SELECT doc_id AS article_id, CASE WHEN old THEN 'migration_pending' WHEN doc_id % 12 = 6 THEN 'not_found' ELSE '' END AS kind, CASE WHEN old THEN 0 ELSE 3 END AS attempts FROM c WHERE NOT (failed AND old AND NOT holds) AND NOT (NOT failed AND doc_id % 5 = 0)""")
def purged_contents(spark, d):
    out = recovery.purged_contents(_contents(spark, d), "new")
    return out.select("article_id", F.col("failure_kind").alias("kind"), F.col("attempt_count").alias("attempts"))


# ---- reports ----------------------------------------------------------------------------------------------------


def _reports(spark, d) -> Tables:
    """Each day's articles, cited by the day's report; the risk of an article is its id modulo 101."""
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    t = _library(spark, d)
    t["business_articles"] = _rows(docs, "business_articles", n.alias("article_id"), F.lit("success").alias("analysis_status"), F.lit("h").alias("content_hash"), F.lit("other").alias("category"), (n % 101).cast("int").alias("risk_score"))
    t["article_contents"] = _rows(docs, "article_contents", n.alias("article_id"), F.lit("success").alias("status"), F.lit("h").alias("content_hash"))
    t["daily_reports"] = _rows(spark.range(1, 41), "daily_reports", "id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 35).cast("int")).alias("report_date"), F.when(F.col("id") % 3 == 0, "failed").otherwise("success").alias("status"), F.concat(F.lit("R"), F.col("id")).alias("title"))
    t["daily_report_articles"] = _rows(docs, "daily_report_articles", (n % 3 + 1).alias("report_id"), n.alias("article_id"))
    return t


_ASSEMBLED = f"""x AS (SELECT doc_id, doc_id % 101 AS risk FROM documents WHERE {_MOMENT} >= TIMESTAMP '2023-12-31 16:00:00' AND {_MOMENT} < TIMESTAMP '2024-01-01 16:00:00'), m AS (SELECT greatest(20, coalesce(max(risk), 0)) AS risk_score, count(*) AS articles FROM x)"""


@query("daily_risk_floor", f"WITH {_ASSEMBLED} SELECT risk_score, CASE WHEN risk_score >= 85 THEN 'critical' WHEN risk_score >= 65 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS risk_level, CAST(articles AS INT) AS articles, 'kept:3,1' AS details FROM m")
def daily_risk_floor(spark, d):
    """A report's risk is at least that of its riskiest article, and citations of other days' articles go."""
    answer = spark.createDataFrame([("t", "o", 20, [("kept", "b", [3, -1, 1, 3]), ("gone", "d", [-2])])], "title string, overview string, risk_score int, details array<struct<title:string,content:string,article_ids:array<bigint>>>")
    out = report.assembled(report.of_day(_reports(spark, d), "2024-01-01"), answer)
    return out.select(F.col("risk_score").cast("long").alias("risk_score"), "risk_level", F.col("article_count").alias("articles"), F.array_join(F.transform("details", lambda x: F.concat_ws(":", x["title"], F.array_join(x["article_ids"], ","))), "|").alias("details"))


@query("report_detail", f"{_LIBRARY} SELECT 2 AS id, 'R2' AS title, string_agg(a.id || ':' || (a.id % 101) || ':' || c.keywords, ' ' ORDER BY a.id % 101 DESC, published_at DESC, a.id) AS sources FROM a JOIN child c USING (id) WHERE a.id % 3 = 1")
def report_detail(spark, d):
    told = lambda x: F.concat_ws(":", x["article_id"], x["risk"], F.array_join(x["keywords"], ","))
    return report.report_detail(_reports(spark, d), 2).select(F.col("id").cast("int").alias("id"), "title", F.array_join(F.transform("sources", told), " ").alias("sources"))


@query("report_list", "SELECT r AS id, strftime(DATE '2024-01-01' + CAST(r % 35 AS INT), '%Y-%m-%d') AS day FROM range(1, 41) t(r) ORDER BY r % 35 DESC, r DESC LIMIT 30")
def report_list(spark, d):
    return q.reports(_reports(spark, d)).select("id", F.col("report_date").cast("string").alias("day"))


@query("report_days", "SELECT r AS day, r % 35 IN (SELECT x % 35 FROM range(1, 41) t(x) WHERE x % 3 <> 0) AS done FROM range(0, 3) t(r)")
def report_days(spark, d):
    """Whether a day has its report."""
    t, out = _reports(spark, d), None
    for k in range(3):
        one = q.report_exists(t, f"2024-01-0{k + 1}").select(F.lit(k).cast("long").alias("day"), "done")
        out = one if out is None else out.unionByName(one)
    return out


@query("evidence_urls", "SELECT doc_id AS article_id, 'https://n.org/' || doc_id || ' https://s.org/' || (doc_id * 7 % 20) || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' https://s.org/' || ((doc_id * 7 + 1) % 20) || '/' || doc_id ELSE '' END AS urls FROM documents")
def evidence_urls(spark, d):
    return report.evidence(_library(spark, d)).select("article_id", F.array_join("urls", " ").alias("urls"))


# ---- configuration, recovery, cleanup ---------------------------------------------------------------------------


def _suppliers(spark, d) -> DataFrame:
    n = F.col("s_suppkey")
    return _rows(read(spark, d, "supplier"), "rss_sources", n.alias("id"), F.col("s_name").alias("name"), F.when(n % 3 == 0, "").otherwise("US").alias("country"), F.lit("en-GB").alias("language"), F.concat(F.lit("https://n.org/"), n).alias("url_template"), F.lit("direct").alias("mode"), (n % 2).cast("int").alias("crawler_enabled"), F.when(n % 7 == 0, 1).otherwise(0).alias("archived"), F.when(n % 4 == 0, dates.at("2024-02-01 00:00:01")).otherwise(now()).alias("crawler_cooldown_until"))


@query("listed_sources", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 1 THEN 'crawler' ELSE 'direct' END AS mode, s_suppkey % 4 = 0 AS resting FROM supplier WHERE s_suppkey % 7 <> 0")
def listed_sources(spark, d):
    return config.listed_sources(_suppliers(spark, d), now()).select("id", "mode", F.col("in_cooldown").alias("resting"))


@query("archived_source", "SELECT s_suppkey AS id, s_suppkey % 7 = 0 OR s_suppkey = 2 AS archived, s_suppkey <> 2 AS active FROM supplier")
def archived_source(spark, d):
    return config.archived(_suppliers(spark, d), 2).select("id", (F.col("archived") == 1).alias("archived"), (F.col("active") == 1).alias("active"))


@query("saved_source", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'US' END AS country, '' AS domains FROM supplier WHERE s_suppkey <> 5 UNION ALL SELECT 5, 'new', 'AU', 'a.org OR b.org'")
def saved_source(spark, d):
    row = {"id": 5, "name": "new", "url_template": "https://n.org/?q={query}", "mode": "search", "language": "en-AU", "country": "", "site_domain": "site:A.org, b.org"}
    out = config.save_source({"rss_sources": _suppliers(spark, d)}, row)["rss_sources"]
    return out.select("id", "name", "country", F.coalesce("site_domain", F.lit("")).alias("domains"))


@query("saved_strategy", "SELECT 'article_keywords' AS name, count(*) FILTER (doc_id % 2 <> 0 AND doc_id % 3 = 0 OR doc_id % 6 = 0) AS n FROM documents UNION ALL SELECT 'collection_cursors', count(*) FROM supplier")
def saved_strategy(spark, d):
    """A strategy whose terms change loses its matches and cursors; a change of its name alone would not."""
    t = _library(spark, d)
    none = F.array().cast("array<string>")
    t["keywords"] = _rows(spark.createDataFrame([(1, "b", ["x"], 14), (2, "a", ["y"], 14)], "id long, name string, match_terms array<string>, lookback_days int"), "keywords", "*", none.alias("context_terms"), none.alias("exclude_terms"))
    t["keyword_categories"] = empty(spark, "keyword_categories")
    both = read(spark, d, "supplier").select(F.col("s_suppkey").alias("rss_source_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    t["collection_cursors"] = _rows(both, "collection_cursors", "rss_source_id", F.col("k").cast("long").alias("keyword_id"), now().alias("last_collected_at"))
    t = config.save_keyword(t, {"id": 2, "name": "renamed", "match_terms": ["y"], "lookback_days": 14})
    t = config.save_keyword(t, {"id": 1, "name": "b", "match_terms": [" x ", "z"], "lookback_days": 14})
    out = None
    for name in ("article_keywords", "collection_cursors"):
        one = t[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("saved_settings", "SELECT * FROM (VALUES ('ai_parallelism', '7'), ('incremental', 'false'), ('report_time', '06:30'), ('elsewhere', 'kept')) v(key, value)")
def saved_settings(spark, d):
    t = {"app_settings": spark.createDataFrame([("ai_parallelism", "4"), ("elsewhere", "kept")], "key string, value string")}
    out = config.save_settings(t, {"ai_parallelism": 7, "incremental": False, "report_time": "06:30"})
    if config.settings(out["app_settings"]) != config.Settings(ai_parallelism=7, incremental=False, report_time="06:30"):
        raise ValueError("settings differ from what was written")
    return out["app_settings"]


@query("upgraded_defaults", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 1 THEN 'new' WHEN s_suppkey % 5 = 2 THEN 'old2' ELSE 'own' END AS url_template FROM supplier")
def upgraded_defaults(spark, d):
    n = F.col("s_suppkey")
    rows = _rows(read(spark, d, "supplier"), "rss_sources", n.alias("id"), F.when(n % 5 == 2, "other").otherwise("known").alias("name"), F.when(n % 5 == 1, "old").when(n % 5 == 2, "old2").otherwise("own").alias("url_template"))
    return recovery.upgraded_defaults(rows, {"known": {"url_template": ("new", ("old", "old2"))}}).select("id", "url_template")


@query("backfilled", "SELECT doc_id AS article_id, 'AB' AS publisher, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN (doc_id % 10) IN (doc_id * 7 % 20, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 7 + 1) % 20 ELSE -1 END) THEN 0 ELSE 1 END AS sightings FROM documents")
def backfilled(spark, d):
    """Articles from before provenance was kept get a sighting by their own source, unless they have it."""
    t = _library(spark, d)
    t["articles"] = t["articles"].withColumns({"rss_source_id": F.col("id") % 10, "publisher": F.lit(" ＡＢ |"), "publisher_normalized": F.lit("")})
    t["rss_sources"] = t["rss_sources"].withColumns({"url_template": F.lit("https://n.org"), "language": F.lit("en-US")})
    out = recovery.backfilled(t)
    n = out["article_sources"].groupBy("article_id").agg(F.count(F.lit(1)).cast("int").alias("sightings"))
    return n.join(out["articles"], n["article_id"] == F.col("id")).select("article_id", F.col("publisher_normalized").alias("publisher"), "sightings")


@query("cleaned_history", "SELECT 'articles' AS name, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS n FROM orders UNION ALL SELECT 'article_keywords', count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'collection_runs', count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01' OR o_orderstatus = 'P') FROM orders")
def cleaned_history(spark, d):
    """History before a day goes with what hangs on it; runs in progress stay."""
    o, day = read(spark, d, "orders"), dates.instant_of(F.col("o_orderdate"))
    t = {n: empty(spark, n) for n in SCHEMAS}
    t["articles"] = _rows(o, "articles", F.col("o_orderkey").alias("id"), day.alias("published_at"))
    t["article_keywords"] = _rows(read(spark, d, "lineitem"), "article_keywords", F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").cast("long").alias("keyword_id"))
    t["collection_runs"] = _rows(o, "collection_runs", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("success").alias("status"), day.alias("started_at"))
    out, _ = retention.execute(t, "history", "DELETE", "1996-01-01")
    rows = None
    for name in ("articles", "article_keywords", "collection_runs"):
        one = out[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("folded_events", "SELECT user_id AS run_id, user_id % 7 AS article_id, coalesce(arg_max('s' || event_id % 3, event_id) FILTER (event_id % 2 = 0), NULL) AS status, coalesce(arg_max(CAST(event_id % 2 AS INT), event_id) FILTER (event_id % 3 = 0), NULL) AS is_relevant FROM events GROUP BY 1, 2")
def folded_events(spark, d):
    """Run items from a log of stage events: the last value that is told of each field."""
    e, n = read(spark, d, "events"), F.col("event_id")
    rows = e.select(F.col("user_id").alias("run_id"), (F.col("user_id") % 7).alias("article_id"), n.alias("seq"), F.when(n % 2 == 0, F.concat(F.lit("s"), n % 3)).alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("content_status", "relevance_status", "business_analysis_status", "error_message")], F.when(n % 3 == 0, (n % 2).cast("int")).alias("is_relevant"))
    return enrich.folded_events(rows).select("run_id", "article_id", "status", "is_relevant")
