"""Feeds, pages and answers, from inline literals."""

import json

from pyspark.sql import functions as F

from quillstream.sources import feed, page, responses

RSS = b"""<?xml version="1.0"?><rss xmlns:dc="urn:dc"><channel><title>c</title>
<item><title>New &lt;b&gt;duty&lt;/b&gt;</title><link>https://n.org/a?utm_source=x</link><description><![CDATA[<p>On gloves</p>]]></description>
<source url="https://w.org">Wire  Desk</source><guid>g1</guid><category>Trade</category><category>trade</category><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>No link</title></item><item><title>Undated</title><link>https://n.org/b</link></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>t:1</id><title>Rule</title><link rel="self" href="https://n.org/self"/>
<link rel="alternate" href="https://n.org/r"/><updated>2024-01-02T03:04:05Z</updated><author><name>Agency</name></author><category term="Law"/></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, b"<rss><channel/></rss>"), (4, b"oops <")], "source_id long, body binary")
    rows = [r.asDict() for r in feed.parse_feeds(df).orderBy("source_id", "position").collect()]
    assert [(r["source_id"], r["position"], r["title"], r["url"]) for r in rows] == [(1, 0, "New duty", "https://n.org/a?utm_source=x"), (1, 1, "Undated", "https://n.org/b"), (2, 0, "Rule", "https://n.org/r"), (4, None, None, None)]
    assert rows[0]["publisher"] == "Wire Desk" and rows[0]["summary"] == "On gloves" and rows[0]["categories"] == ["Trade"] and rows[0]["published_at"].isoformat() == "2024-01-02T10:00:00"
    assert rows[1]["published_at"] is None and rows[2]["publisher"] == "Agency" and rows[2]["categories"] == ["Law"] and rows[3]["error"]


def test_feeds_keep_their_keys(spark):
    """Numbers beyond 2^53 beside nulls, and clashing names, stay as they are."""
    df = spark.createDataFrame([(9007199254740993, RSS), (None, ATOM)], "keyword_id long, body binary").withColumn("who", F.lit("w"))
    got = feed.parse_feeds(df)
    assert {(r["keyword_id"], r["who"], r["title"]) for r in got.collect()} == {(9007199254740993, "w", "New duty"), (9007199254740993, "w", "Undated"), (None, "w", "Rule")}
    assert feed.parse_feeds(df.limit(0)).count() == 0
    assert [x["url"] for x in feed.items(b"<feed><entry><title>t</title><link> </link><link>https://n.org/?a=1&amp;amp;b</link></entry></feed>")] == ["https://n.org/?a=1&b"]


LIST = b"""<html><head><base href="https://evil.org/"><title>List</title></head><body><a href="/about">About this site</a>
<a href="/news/2024/05/06/duty-rises">Duty rises again</a><a href="/news/2024/05/07/quota">Quota is cut in half</a><a href="https://other.org/news/1">Elsewhere today</a></body></html>"""
META = b"""<html><head><meta property="og:title" content="Duty rises"><meta property="og:site_name" content="Wire"><meta name="description" content="d">
<meta property="article:published_time" content="2024-05-06T01:00:00Z"></head><body><h1>Other</h1></body></html>"""
LD = b"""<html><script type="application/ld+json">{"@graph":[{"@type":["NewsArticle"],"headline":"Quota","datePublished":"2024-05-07","url":"/news/2024/05/07/quota","publisher":{"name":"Desk"},"articleSection":["Trade"]}]}</script></html>"""


def test_pages(spark):
    top = "https://www.n.org/list"
    rows = [(1, top, LIST), (2, "https://www.n.org/news/2024/05/06/duty-rises", META), (3, "https://www.n.org/news/2024/05/07/quota", LD)]
    pages = page.read_pages(spark.createDataFrame(rows, "page_id long, url string, body binary")).cache()
    links = page.ranked_links(pages.where("page_id = 1")).orderBy("rank").collect()
    assert [(r["position"], r["score"]) for r in links] == [(1, 11), (2, 11)]
    found = page.crawl(pages.where("page_id = 1"), pages.where("page_id > 1")).orderBy("nth").collect()
    assert [(r["title"], r["publisher"], list(r["categories"])) for r in found] == [("Duty rises", "Wire", []), ("Quota", "Desk", ["Trade"])]
    assert found[0]["published_at"].isoformat() == "2024-05-06T01:00:00"
    assert page.read_pages(spark.createDataFrame(rows, "page_id long, url string, body binary"), articles=False).where("own is not null or size(linked) > 0").count() == 0
    odd = b'<a href="https://a_b.org/news/x|y z">A link of some length</a><a href="http://[bad">Another bad link</a>'
    got = page.ranked_links(page.read_pages(spark.createDataFrame([(9007199254740993, "https://www.a_b.org/", odd), (2, None, None)], "page_id long, url string, body binary"))).collect()
    assert [(r["page_id"], r["rank"], r["url"]) for r in got] == [(9007199254740993, 1, "https://a_b.org/news/x|y z")]


def test_sniffing(spark):
    df = spark.createDataFrame([(b"  <!DOCTYPE html><p>", ), (b"<rss/>", ), (b"<html>Please VERIFY you are human", )], "b binary")
    assert [tuple(r) for r in df.select(page.looks_like_html(F.col("b")), page.looks_like_challenge(F.col("b"))).collect()] == [(True, False), (False, False), (True, True)]
    assert page.decoded("<meta charset=gb18030>关税".encode("gb18030")).endswith("关税")


def test_reader_answers(spark):
    def answer(page_json, search="completed", status="completed"):
        return json.dumps({"status": status, "output": [{"type": "web_search_call", "status": search}, {"type": "message", "content": [{"type": "output_text", "text": page_json}]}]})

    good = answer('```json\n{"success": true, "full_text": "a  b\\n\\nc", "final_url": "https://n.org"}\n```')
    rows = [good, answer("{}"), answer('{"success": false}'), answer("x", search="failed"), answer("x", status="incomplete"), "junk"]
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(responses.read_reader(F.col("x")).alias("r")).collect()]
    assert got[0]["full_text"] == "a b\nc" and got[0]["content_chars"] == 5
    assert [r["failure_kind"] for r in got] == [None, "invalid_json", "not_found", "search_not_used", "incomplete_response", "invalid_response"]


def test_scorer_answers(spark):
    def answer(text, reason="stop"):
        return json.dumps({"choices": [{"finish_reason": reason, "message": {"content": text}}], "usage": {"prompt_tokens": 3}})

    rows = [answer('```\n{"a": 1}\n```'), answer("[1]"), answer('{"a"', "length")]
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(responses.read_scorer(F.col("x")).alias("r")).collect()]
    assert (got[0]["data"], got[0]["prompt_tokens"], got[0]["completion_tokens"]) == ('{"a": 1}', 3, 0)
    assert [r["error"] for r in got] == [None, "invalid_json", "length"]


def test_page_structure():
    """Times with and without an attribute, empty and later headings, anchors in anchors, titles of drawings, metadata without a name."""
    read = page.Page("""<base href=""><base href=' /b/ '><meta property=' ' name='Date' content=' 2024 '><meta name=date content=later>
      <title>Page</title><svg><title>Icon</title></svg><h1></h1><h1> <i> </i></h1><h1>Big<b>news</b> <time>5 May 2024 10:00:00</time></h1><h1>Other</h1>
      <time datetime='2024-01-02'> second </time><time datetime=''></time><a href=' /x '>one <a href='/y'>two</a> three</a><a href='/empty'> </a><a>nowhere</a>
      <script type='application/LD+json '>{"a": "<b>"}</script><script>var x</script><a href='/open'>open""")
    assert (read.base, read.meta, read.title, read.heading) == ("/b/", {"date": "2024"}, "Page Icon", "Big news 5 May 2024 10:00:00")
    assert read.times == ["5 May 2024 10:00:00", "2024-01-02", "second"] and read.anchors == [("/x", "one two")] and read.blocks == ['{"a": "<b>"}']
    assert page.Page("<h1>Head <p>goes on").heading == "Head goes on" and page.Page("").title == ""


def test_answers_as_they_stream(spark, tmp_path):
    """Bodies that arrive in files are read as those of a table, the feeds' items exploded on the way."""
    from quillstream.sources import items

    feed_of = b"<rss><item><title>T</title><link>https://n.org/1</link></item></rss>"
    rows = [(1, "direct", 0, feed_of), (2, None, None, b"<html><p>x<br>"), (3, "direct", 1, feed_of), (4, "direct", 0, b"oops"), (5, "direct", 0, None), (6, "direct", 0, b""), (7, "direct", 0, b"<rss/>")]
    answers = spark.createDataFrame(rows, "id long, mode string, crawler_enabled int, body binary")
    want = {1: ("feed", 1), 2: ("crawler", 0), 3: ("crawler", 0), 4: ("error", 0), 5: ("error", 0), 6: ("error", 0), 7: ("feed", 0)}
    assert {r["id"]: (r["read_as"], len(r["items"])) for r in items.read_answers(answers).collect()} == want
    answers.write.parquet(f"{tmp_path}/in")
    stream = items.read_answers(spark.readStream.schema(answers.schema).parquet(f"{tmp_path}/in")).select("id", "read_as", F.size("items").alias("n"))
    stream.writeStream.format("memory").queryName("answers_read").trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: (r["read_as"], r["n"]) for r in spark.table("answers_read").collect()} == want
    assert items.read_answers(answers.limit(0)).count() == 0


def test_a_crawl_parses_each_page_once(spark):
    """Listings are parsed and written before the steps that read them; only the linked pages are parsed in the plan."""
    body = "<script type='application/ld+json'>{\"@type\": \"NewsArticle\", \"headline\": \"Own one\", \"url\": \"/own\", \"datePublished\": \"2024-05-06T01:00:00Z\"}</script><a href='/news/2024/05/06/1'>A title that is long</a>"
    listed = page.read_pages(spark.createDataFrame([(1, "https://n.org/list", body)], "page_id long, url string, body string"))
    linked = page.read_pages(spark.createDataFrame([(9, "https://n.org/news/2024/05/06/1", "<h1>Linked</h1>")], "page_id long, url string, body string"))
    rows = page.crawl(listed, linked)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r["nth"], r["title"]) for r in rows.orderBy("nth").collect()] == [(1, "Own one"), (2, "Linked")]
