"""Functions and sources over the sample tables: their inputs are made from the rows, and the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import dates, rules, terms, text, urls
from quillstream.operators import enrich, report, sinks
from quillstream.plans.catalog import query, read, stamp
from quillstream.sources import feed, page, responses, tables
from quillstream.sources import items as item_reader

_MOMENT = "(TIMESTAMP '2024-01-01' + to_minutes(doc_id))"
_SQUASHED = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _posted(instant):
    """As RFC 2822 has it, without a zone."""
    wall = dates.wall_of(instant)
    return F.concat(F.date_format(wall.cast("date"), "EEE, dd MMM yyyy"), F.lit(" "), F.substring(wall.cast("string"), 12, 8))


def _moment() -> Column:
    return dates.later(dates.at("2024-01-01"), minutes=F.col("doc_id"))


def _escaped(c: Column, times: int) -> Column:
    """Text in which & and < survive so many readings of entities."""
    amp = "&" + "amp;" * times
    return F.replace(F.replace(c, F.lit("&"), F.lit(amp)), F.lit("<"), F.lit("&" + "amp;" * (times - 1) + "lt;"))


@query("html_text", f"SELECT doc_id, sha256({_SQUASHED}) AS plain FROM documents")
def html_text(spark, d):
    value = F.concat(F.lit("<div><p>"), _escaped(F.col("text"), 2), F.lit("</p><br></div>"))
    return _docs(spark, d).select("doc_id", F.sha2(text.html_text(value), 256).alias("plain"))


@query("page_decoded", "SELECT page_id, sha256(html) AS text FROM pages")
def page_decoded(spark, d):
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    decoded = F.regexp_replace(page.decode_page(body), "^﻿", "")  # a page that names utf-8 keeps its mark
    return read(spark, d, "pages").select("page_id", F.sha2(decoded, 256).alias("text"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    body = F.when(n % 3 == 0, F.concat(F.lit("Access Denied "), F.col("html"))).when(n % 3 == 1, F.col("html")).otherwise(F.concat(F.lit("plain "), F.col("url")))
    return read(spark, d, "pages").withColumn("body", F.encode(body, "UTF-8"))


@query("page_marks", "SELECT page_id, page_id % 3 <> 2 AS html, page_id % 3 = 0 AS challenge FROM pages")
def page_marks(spark, d):
    return _bodies(spark, d).select("page_id", page.looks_like_html(F.col("body")).alias("html"), page.looks_like_challenge(F.col("body")).alias("challenge"))


@query("load_modes", "SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 5 = 0 THEN 'crawler' WHEN page_id % 7 = 1 THEN CASE WHEN page_id % 3 <> 2 THEN 'crawler' ELSE 'error' END WHEN page_id % 2 = 0 AND page_id % 3 <> 2 THEN 'crawler' ELSE 'feed' END AS mode FROM pages")
def load_modes(spark, d):
    n = F.col("page_id")
    mode = page.load_mode(F.when(n % 4 == 0, "crawler").otherwise("direct"), F.when(n % 5 == 0, 1).otherwise(0), F.when(n % 7 == 1, "broken"), n % 2, F.col("body"))
    return _bodies(spark, d).select("page_id", mode.alias("mode"))


# What XML cannot hold.
_FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


@query("feed_items", rf"""SELECT doc_id, 'New & ' || source AS title, 'https://n.org/' || doc_id || '?a=1&b=2' AS url, 'Desk ' || lang AS publisher, sha256(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))) AS summary,
 strftime({_MOMENT}, '%Y-%m-%d %H:%M:%S') AS published, CASE WHEN doc_id % 2 = 0 THEN 'g' || doc_id ELSE '' END AS guid, 'Trade,' || upper(lang) AS categories FROM documents""")
def feed_items(spark, d):
    """A feed a document, RSS or Atom, each with an item that has no link and does not count."""
    tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name.split(' ')[0]}>"))
    n = F.col("doc_id")
    body = _escaped(F.regexp_replace("text", _FORBIDDEN, ""), 3)
    url = F.concat(F.lit("https://n.org/"), n, F.lit("?a=1&amp;amp;b=2"))
    title = tag("title", F.lit("New &amp;amp;amp; "), F.col("source"))
    who = F.concat(F.lit(" Desk "), F.col("lang"), F.lit(" | "))
    rss = F.concat(
        F.lit("<rss xmlns:dc='urn:dc'><channel><title>c</title><item><title>No link</title></item><item>"), title, tag("link", url), tag("description", F.lit(" "), ), tag("dc:encoded", body), tag("dc:creator", who), tag("guid", F.lit("g"), n),
        tag("category", F.lit("Trade")), tag("category", F.upper("lang")), tag("category", F.lit("TRADE")), tag("pubDate", _posted(_moment()), F.lit(" GMT")), F.lit("</item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry>"), title, F.lit("<link rel='self' href='https://n.org/self'/><link rel='alternate' href='"), url, F.lit("'/>"), tag("summary", body), tag("author", tag("name", who)),
        F.lit("<category term='Trade'/><category label='"), F.upper("lang"), F.lit("'/>"), tag("updated", F.concat(F.translate(dates.told(_moment()), " ", "T"), F.lit("Z"))), F.lit("</entry><entry><title>No link</title></entry></feed>"),
    )
    rows = feed.parse_feeds(_docs(spark, d).select("doc_id", F.encode(F.when(n % 2 == 0, rss).otherwise(atom), "UTF-8").alias("body")))
    return rows.select("doc_id", "title", "url", "publisher", F.sha2("summary", 256).alias("summary"), stamp(F.col("published_at")).alias("published"), "guid", F.array_join("categories", ",").alias("categories"))


@query("page_articles", f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'T ' || source END AS title, CASE doc_id % 4 WHEN 0 THEN 'L ' || lang WHEN 1 THEN 'M ' || lang WHEN 2 THEN '' END AS summary, CASE doc_id % 4 WHEN 0 THEN 'Desk' WHEN 3 THEN NULL ELSE 'Wire' END AS publisher,
 CASE doc_id % 4 WHEN 0 THEN strftime({_MOMENT}, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime({_MOMENT}, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN '2024-05-06 00:00:00' END AS published FROM documents""")
def page_articles(spark, d):
    """Pages with JSON-LD, with metadata, with a heading and a dated path, and without any date."""
    n, title = F.col("doc_id"), F.concat(F.lit("T "), F.col("source"))
    when = F.concat(F.translate(dates.told(_moment()), " ", "T"), F.lit("Z"))
    url = F.concat(F.lit("https://www.n.org/news/"), F.when(n % 4 == 2, F.lit("2024/5/6/")).otherwise(""), n)
    own = F.struct(F.array(F.lit("NewsArticle")).alias("@type"), title.alias("headline"), when.alias("datePublished"), F.concat(F.lit("/news/"), n).alias("url"), F.concat(F.lit("L "), F.col("lang")).alias("description"), F.struct(F.lit("Desk").alias("name")).alias("publisher"))
    other = F.struct(F.array(F.lit("Report")).alias("@type"), F.lit("Other").alias("headline"), F.lit("2023-01-01").alias("datePublished"), F.lit("/else").alias("url"), F.lit("").alias("description"), F.struct(F.lit("x").alias("name")).alias("publisher"))
    ld = F.concat(F.lit("<html><script type='application/ld+json'>"), F.to_json(F.struct(F.array(other, own).alias("@graph"))), F.lit("</script><h1>No</h1></html>"))
    meta = F.concat(F.lit("<html><meta property='og:title' content='"), title, F.lit("'><meta name='description' content='M "), F.col("lang"), F.lit("'><meta itemprop='datePublished' content='"), when, F.lit("'><h1>No</h1></html>"))
    plain = F.concat(F.lit("<html><title>No</title><h1> "), title, F.lit("\n</h1></html>"))
    rows = _docs(spark, d).select("doc_id", url.alias("url"), F.when(n % 4 == 0, ld).when(n % 4 == 1, meta).otherwise(plain).alias("body"), F.lit("Wire").alias("who"))
    own = F.col("own")
    return page.read_pages(rows, "doc_id", publisher="who").select("doc_id", own["title"].alias("title"), own["summary"].alias("summary"), own["publisher"].alias("publisher"), stamp(own["published_at"]).alias("published"))


@query("base_urls", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]*') || '/base' ELSE url END AS base FROM pages")
def base_urls(spark, d):
    proposed = F.when(F.col("page_id") % 2 == 0, F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), F.lit("/base"))).otherwise("https://elsewhere.org/")
    return read(spark, d, "pages").select("page_id", urls.base_url(F.col("url"), proposed).alias("base"))


def _odd_urls() -> Column:
    n = F.col("doc_id")
    s = F.concat(F.lit("https://a_"), F.col("source"), F.lit(".org/x|y z/"), n)
    return F.when(n % 8 == 0, F.concat(F.lit("ftp://n.org/"), n)).when(n % 8 == 1, "http://LOCALHOST.:80/").when(n % 8 == 2, F.concat(F.lit("http://10.0.0."), n % 250, F.lit("/x"))).when(n % 8 == 3, "http://[::1]:8080/").when(n % 8 == 4, "http://8.8.8.8/x").when(n % 8 == 5, "https://me@").when(n % 8 == 6, F.concat(F.lit("https://x.localhost/"), n)).otherwise(s)


@query("url_failures", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'invalid_url' WHEN 5 THEN 'invalid_url' WHEN 4 THEN NULL WHEN 7 THEN NULL ELSE 'unsafe_url' END AS failure, doc_id % 8 NOT IN (0, 5) AS web FROM documents")
def url_failures(spark, d):
    return _docs(spark, d).select("doc_id", urls.url_failure(_odd_urls()).alias("failure"), urls.http_url(_odd_urls()).alias("web"))


@query("odd_urls", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://a_' || source || '.org/x|y z?k=a+b&k=%25&e=' WHEN 1 THEN 'http://h.org:8080/?%C3%A9=%2A~' WHEN 2 THEN 'https://h.org/p?b=2&b=1' ELSE 'http://h.org:99999/x/' END AS canonical FROM documents""")
def odd_urls(spark, d):
    n = F.col("doc_id")
    url = F.when(n % 4 == 0, F.concat(F.lit("  HTTPS://user:pw@A_"), F.upper("source"), F.lit(".org/x|y z//?k=a%20b&UTM_x=1&k=%&e&&fbclid=9#f"))).when(n % 4 == 1, "http://H.org:08080?é=*~").when(n % 4 == 2, "https://h.org:/p/?b=2&mc_eid=&b=1").otherwise("http://h.org:99999/x/ ")
    return _docs(spark, d).select("doc_id", urls.canonical_url(url).alias("canonical"))


@query("evidence_order", "SELECT doc_id, 'https://n.org/' || doc_id || ' https://' || source || '.org https://news.google.com/' || lang AS urls FROM documents")
def evidence_order(spark, d):
    own = F.concat(F.lit("https://n.org/"), F.col("doc_id"))
    found = F.array(own, F.concat(F.lit("https://news.google.com/"), F.col("lang")), F.lit(" "), F.concat(F.lit("https://"), F.col("source"), F.lit(".org")), own)
    return _docs(spark, d).select("doc_id", F.array_join(urls.evidence_urls(found), " ").alias("urls"))


@query("site_domain_lists", "SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN source || '.org xn--bcher-kva.example ' || lang || '.com' END AS domains FROM documents")
def site_domain_lists(spark, d):
    """A port, a path, a user or a query is no domain; those lists are refused whole."""
    n = F.col("doc_id")
    last = F.when(n % 5 == 4, F.when(n % 2 == 0, "n.org:8080").otherwise("me@n.org/p?q=1")).otherwise(F.concat(F.lit("https://"), F.upper("lang"), F.lit(".com/")))
    value = F.concat(F.lit("site:"), F.col("source"), F.lit(".org OR Bücher.example 或 "), F.col("source"), F.lit(".ORG；\n"), last)
    return _docs(spark, d).select("doc_id", F.array_join(urls.site_domain_list(value), " ").alias("domains"))


@query("publisher_names", "SELECT doc_id, 'AB ' || source AS publisher, lang || ',STRASSE' AS categories FROM documents")
def publisher_names(spark, d):
    names = F.array(F.concat(F.lit(" "), F.col("lang")), F.lit(" "), F.lit("STRASSE"), F.upper("lang"), F.lit("Straße"))
    return _docs(spark, d).select("doc_id", text.publisher_key(F.concat(F.lit("- ＡＢ  "), F.col("source"), F.lit(" |·"))).alias("publisher"), F.array_join(text.category_list(names), ",").alias("categories"))


@query("fingerprints", f"SELECT doc_id, sha256('strasse ' || lower(source) || '|' || lang || '|' || strftime({_MOMENT}, '%Y-%m-%d')) AS fingerprint FROM documents")
def fingerprints(spark, d):
    title = text.folded_title(F.concat(F.lit(" Straße \t"), F.col("source")))
    return _docs(spark, d).select("doc_id", text.fingerprint(title, text.casefold("lang"), _moment()).alias("fingerprint"))


@query("term_matches", "SELECT doc_id, array_to_string(list_filter(['License', ' AND ', 'qui', 'DER'], lambda t: contains(lower(source || chr(10) || text), lower(trim(t)))), ',') AS terms FROM documents")
def term_matches(spark, d):
    wanted = F.array(*[F.lit(t) for t in ("License", " AND ", " ", "qui", "DER")])
    known = spark.range(1).select(F.explode(terms.folded_terms(wanted)).alias("term"))
    found = terms.with_terms(_docs(spark, d), F.col("source"), F.col("text"), known, "held")
    return found.select("doc_id", F.array_join(terms.terms_in(wanted, terms.folded_terms(wanted), F.col("held")), ",").alias("terms"))


@query("document_terms", """WITH t AS (SELECT DISTINCT chr(97 + p_partkey::INT % 26) || chr(97 + p_partkey::INT // 26 % 26) || chr(97 + p_partkey::INT // 676 % 26) AS term FROM part UNION SELECT p_name FROM part), d AS (SELECT doc_id, replace(lower(coalesce(text, '')), 'ß', 'ss') AS x FROM documents),
 h AS (SELECT doc_id, count(*) AS n, sha256(array_to_string(list_sort(list(term)), ',')) AS held FROM d JOIN t ON contains(x, term) GROUP BY 1) SELECT doc_id, coalesce(n, 0)::INT AS n_terms, coalesce(held, sha256('')) AS held FROM d LEFT JOIN h USING (doc_id)""")
def document_terms(spark, d):
    """Every document against a name and a code of three letters for each part, some thousand terms that overlap, in one scan of each text."""
    n = F.col("p_partkey")
    letter = lambda k: F.chr((F.floor(n / k) % 26 + 97).cast("int"))
    parts = read(spark, d, "part")
    named = F.concat(letter(1), letter(26), letter(676))
    known = parts.select(F.explode(terms.folded_terms(F.array(named, "p_name"))).alias("term"))
    found = terms.with_terms(_docs(spark, d), F.lit(None).cast("string"), F.col("text"), known, "held")
    return found.select("doc_id", F.size("held").alias("n_terms"), F.sha2(F.array_join("held", ","), 256).alias("held"))


@query("legacy_reports", r"""WITH s AS (SELECT doc_id, text, trim(string_split_regex(text, '[。！？!?\n]')[1], ' ') AS first FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own' WHEN first = '' THEN 'Summary' ELSE substr(first, 1, 24) END AS title, CASE WHEN doc_id % 2 = 0 THEN sha256(text || ' so') ELSE sha256(text) END AS content, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS ids FROM s""")
def legacy_reports(spark, d):
    """Old reports: with a development each, or with their summary alone."""
    n = F.col("doc_id")
    one = F.struct(F.lit("own").alias("title"), F.col("text").alias("finding"), F.lit("so").alias("business_impact"), n.alias("article_id"))
    developments = F.when(n % 2 == 0, F.array(one)).otherwise(F.filter(F.array(one), lambda x: F.lit(False)))
    first = _docs(spark, d).select("doc_id", F.element_at(report.from_legacy(F.col("text"), developments), 1).alias("x"))
    return first.select("doc_id", "x.title", F.sha2("x.content", 256).alias("content"), F.array_join("x.article_ids", ",").alias("ids"))


@query("name_lists", "SELECT doc_id, lang || '|' || source AS names, length(text) > 200 AS was_cut, sha256(substr(text, 1, 200)) AS head FROM documents")
def name_lists(spark, d):
    head, was_cut = text.truncated(F.col("text"), 200)
    return _docs(spark, d).select("doc_id", F.array_join(text.split_names(F.concat(F.lit(" "), F.col("lang"), F.lit(", ,"), F.col("source"), F.lit(" ,"))), "|").alias("names"), was_cut.alias("was_cut"), F.sha2(head, 256).alias("head"))


@query("prompts", f"""SELECT doc_id, 'who we are' || chr(10) || chr(10) || 'judge' AS system, sha256('{{"title":"t","publisher":' || to_json(source)::VARCHAR || ',"published_at":"' || strftime({_MOMENT}, '%Y-%m-%d %H:%M:%S') || '","category":"c","full_text":' || to_json(substr(text, 1, 2000))::VARCHAR || ',"truncated":' || (length(text) > 2000) || '}}') AS user FROM documents""")
def prompts(spark, d):
    rows = _docs(spark, d).select("doc_id", F.lit("t").alias("title"), F.col("source").alias("publisher"), _moment().alias("published_at"), F.lit("c").alias("category"), F.col("text").alias("full_text"))
    out = enrich.prompt(rows, "judge", 2000, "analysis", "who we are")
    return out.select("doc_id", F.col("system_prompt").alias("system"), F.sha2("user_prompt", 256).alias("user"))


@query("runtime_lookbacks", "SELECT o_orderkey, CAST(least(365, greatest(o_orderkey % 30 + 1, floor((o_orderkey * 7 % 800000) * 60 / 86400.0) + 1)) AS INT) AS days FROM orders")
def runtime_lookbacks(spark, d):
    end = dates.at("2024-02-01")
    start = dates.later(end, minutes=-(F.col("o_orderkey") * 7 % 800000))
    return read(spark, d, "orders").select("o_orderkey", dates.runtime_lookback((F.col("o_orderkey") % 30 + 1).cast("int"), start, end).alias("days"))


@query("positive_id_lists", "SELECT o_orderkey, array_to_string(CASE WHEN o_custkey > 0 THEN [o_custkey] ELSE [] END || CASE WHEN o_orderkey % 2 = 0 AND o_orderkey <> o_custkey AND o_orderkey > 0 THEN [o_orderkey] ELSE [] END, ',') AS ids FROM orders")
def positive_id_lists(spark, d):
    n = F.col("o_orderkey").cast("string")
    values = F.array(F.col("o_custkey").cast("string"), F.lit("0"), F.lit("-7"), F.lit("x"), F.when(F.col("o_orderkey") % 2 == 0, n).otherwise("1.5"), F.col("o_custkey").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(rules.positive_ids(values), ",").alias("ids"))


@query("cooldowns", """WITH k AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'robots_denied' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'access_blocked' WHEN 3 THEN 'temporarily_unavailable' WHEN 4 THEN 'crawler_error' END AS kind FROM orders)
 SELECT o_orderkey, kind, CASE WHEN kind IS NULL THEN NULL WHEN o_orderkey % 4 = 0 THEN greatest(1, o_orderkey % 900) WHEN kind IN ('robots_denied', 'access_blocked') THEN 86400 WHEN kind = 'temporarily_unavailable' THEN 900 ELSE 3600 END AS seconds FROM k""")
def cooldowns(spark, d):
    n = F.col("o_orderkey") % 6
    kind = rules.crawler_failure(F.when(n == 1, 429).when(n == 2, 403).when(n == 3, 503).when(n == 4, 404).otherwise(200), n != 0)
    rows = read(spark, d, "orders").select("o_orderkey", kind.alias("kind"))
    asked = F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_orderkey") % 900).cast("int"))
    return rows.select("o_orderkey", "kind", rules.cooldown_seconds(F.col("kind"), asked, F.lit(3600)).cast("long").alias("seconds"))


@query("reader_answers", r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not_found' WHEN 2 THEN 'search_not_used' WHEN 3 THEN 'incomplete_response' WHEN 4 THEN 'invalid_response' ELSE 'empty_content' END AS failure,
 CASE WHEN doc_id % 6 = 0 THEN sha256(array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) END AS hash FROM documents""")
def reader_answers(spark, d):
    n = F.col("doc_id") % 6
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct((n != 1).alias("success"), F.when(n == 5, F.lit(" \n ")).otherwise(F.col("text")).alias("full_text"), F.lit("https://n.org").alias("final_url"))), F.lit("\n```"))
    search = F.struct(F.lit("web_search_call").alias("type"), F.when(n == 2, "failed").otherwise("completed").alias("status"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"))
    said = F.struct(F.lit("message").alias("type"), F.lit("completed").alias("status"), F.array(F.struct(F.lit("output_text").alias("type"), answer.alias("text"))).alias("content"))
    raw = F.when(n == 4, "junk").otherwise(F.to_json(F.struct(F.when(n == 3, "incomplete").otherwise("completed").alias("status"), F.array(search, said).alias("output"))))
    rows = _docs(spark, d).select("doc_id", responses.read_reader(raw).alias("r"))
    return rows.select("doc_id", F.col("r.failure_kind").alias("failure"), F.col("r.content_hash").alias("hash"))


@query("scorer_answers", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'length' WHEN 2 THEN 'invalid_json' ELSE 'invalid_response' END AS error, CASE WHEN doc_id % 4 = 0 THEN '{"a":' || doc_id || '}' END AS data, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE doc_id % 100 END AS prompt, 0 AS completion FROM documents""")
def scorer_answers(spark, d):
    n = F.col("doc_id") % 4
    content = F.when(n == 2, "[1]").otherwise(F.concat(F.lit('```\n{"a":'), F.col("doc_id"), F.lit("}\n```")))
    choice = F.struct(F.when(n == 1, "length").otherwise("stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message"))
    raw = F.when(n == 3, "{}").otherwise(F.to_json(F.struct(F.array(choice).alias("choices"), F.struct((F.col("doc_id") % 100).alias("prompt_tokens")).alias("usage"))))
    rows = _docs(spark, d).select("doc_id", responses.read_scorer(raw).alias("r"))
    return rows.select("doc_id", "r.error", "r.data", F.col("r.prompt_tokens").cast("long").alias("prompt"), F.col("r.completion_tokens").cast("int").alias("completion"))


@query("table_columns", "SELECT * FROM (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'bigint')) v(name, type)")
def table_columns(spark, d):
    return spark.createDataFrame(tables.columns(_docs(spark, d)), "name string, type string")


@query("copied_rows", """SELECT doc_id AS id, 'k' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN lang || '|' || source WHEN doc_id % 3 = 1 THEN '' ELSE 'x' END AS terms, 30 AS lookback, 1 AS active FROM documents UNION ALL SELECT -1, 'there', 'old', 7, 0""")
def copied_rows(spark, d):
    """Strategies of an older base: lists are JSON text, some of it broken, and columns are missing."""
    n = F.col("doc_id")
    terms = F.when(n % 3 == 0, F.to_json(F.array("lang", "source"))).when(n % 3 == 1, "broken[").otherwise('["x"]')
    old = _docs(spark, d).select(n.alias("id"), F.concat(F.lit("k"), n).alias("name"), terms.alias("match_terms"), F.lit(1).alias("dropped_since"))
    there = tables.aligned(spark.createDataFrame([(-1, "there", ["old"], 7, 0)], "id long, name string, match_terms array<string>, lookback_days int, active int"), "keywords")
    out = tables.copied({"keywords": old}, {"keywords": there})["keywords"]
    return out.select("id", "name", F.array_join("match_terms", "|").alias("terms"), F.col("lookback_days").alias("lookback"), "active")


@query("retry_seconds", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN greatest(1, o_orderkey % 900) WHEN 1 THEN greatest(1, o_orderkey % 3000 - 100) END AS seconds FROM orders")
def retry_seconds(spark, d):
    n, now = F.col("o_orderkey"), dates.instant_of(F.col("o_orderdate"))
    date = F.concat(_posted(dates.later(now, seconds=n % 3000 - 100)), F.lit(" GMT"))
    value = F.when(n % 4 == 0, (n % 900).cast("string")).when(n % 4 == 1, date).when(n % 4 == 2, "soon")
    return read(spark, d, "orders").select("o_orderkey", dates.retry_seconds(value, now).alias("seconds"))


@query("next_runs", """WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS now, CASE WHEN o_orderkey % 3 = 0 THEN 480 WHEN o_orderkey % 3 = 1 THEN 1439 ELSE 30 END AS m FROM orders), t AS (SELECT *, date_trunc('day', now + INTERVAL 8 HOUR) + to_minutes(m) - INTERVAL 8 HOUR AS due FROM o)
 SELECT o_orderkey, strftime(CASE WHEN due > now THEN due ELSE due + INTERVAL 24 HOUR END, '%Y-%m-%d %H:%M:%S') AS due FROM t""")
def next_runs(spark, d):
    n = F.col("o_orderkey")
    now = dates.later(dates.instant_of(F.col("o_orderdate")), minutes=n % 1440)
    schedule = F.when(n % 3 == 0, "25:00").when(n % 3 == 1, "23:59").otherwise("00:30")
    return read(spark, d, "orders").select("o_orderkey", stamp(dates.next_run_at(now, schedule)).alias("due"))


@query("clamped_values", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN greatest(1, least(20, o_orderkey - 50)) WHEN 1 THEN 4 ELSE 20 END AS value FROM orders")
def clamped_values(spark, d):
    """Settings as text, each clamped to its range; what is no number takes the default."""
    own = F.udf(lambda v: rules.clamped(v, 1, 20, 4), "long", useArrow=True)
    n = F.col("o_orderkey")
    value = F.when(n % 3 == 0, (n - 50).cast("string")).when(n % 3 == 1, "many").otherwise("99")
    return read(spark, d, "orders").select("o_orderkey", own(value).alias("value"))


@query("report_cards", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'orange' ELSE 'red' END AS colour, CAST(1 + (doc_id % 5) AS INT) AS blocks, length(source) + CAST((doc_id % 5) * (length('**' || lang || '**') + 1 + length(source)) AS BIGINT) AS chars FROM documents""")
def report_cards(spark, d):
    """The cards of reports: colour by risk, and a block for the overview and each detail."""

    def made(title, overview, level, details):
        card = sinks.card({"title": title, "overview": overview, "risk_level": level, "details": [{"title": x[0], "content": x[1]} for x in details]})
        return card["header"]["template"], len(card["elements"]), sum(len(x["content"]) for x in card["elements"])

    n = F.col("doc_id")
    level = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), (n % 4 + 1).cast("int"))
    details = F.array_repeat(F.array("lang", "source"), (n % 5).cast("int"))
    out = F.udf(made, "struct<colour:string,blocks:int,chars:bigint>", useArrow=False)(F.col("lang"), F.col("source"), level, details)
    return _docs(spark, d).select("doc_id", out.alias("x")).select("doc_id", "x.colour", "x.blocks", "x.chars")


@query("crawled_articles", """SELECT doc_id AS page_id, nth, 'A ' || doc_id || ' ' || k AS title, strftime(TIMESTAMP '2024-05-06' + to_hours(k), '%Y-%m-%d %H:%M:%S') AS published
 FROM documents, (VALUES (1, 2), (2, 0), (3, 1)) v(nth, k) WHERE nth <= 2 OR doc_id % 2 = 0""")
def crawled_articles(spark, d):
    """Listing pages and the pages they link to: dated links first, links to the site alone, and undated articles out."""
    n = F.col("doc_id")
    site = F.concat(F.lit("https://www.n"), n, F.lit(".org"))
    link = lambda path, text: F.concat(F.lit("<a href='"), path, F.lit(f"'>{text}</a>"))
    paths = [F.concat(F.lit("/news/"), n, F.lit("-0")), F.concat(F.lit("/x/"), n, F.lit("-1")), F.lit("/news/2024/05/06/2")]
    body = F.concat(F.lit("<base href='https://evil.org/'>"), link(F.lit("/about"), "About this site"), *[link(p, "A title that is long") for p in paths], link(F.lit("https://other.org/news/1"), "Elsewhere today"))
    docs = _docs(spark, d)
    listed = page.read_pages(docs.select(n.alias("page_id"), F.concat(site, F.lit("/list")).alias("url"), body.alias("body")))
    meta = lambda k: F.concat(F.lit("<meta property='og:title' content='A "), n, F.lit(f" {k}'>"), F.lit(f"<time datetime='2024-05-06T0{k}:00:00Z'>"))
    found = None
    for k, p in enumerate(paths):
        body = meta(k) if k != 1 else F.when(n % 2 == 0, meta(k)).otherwise("<h1>no date</h1>")
        one = docs.select(n.alias("page_id"), F.concat(site, p).alias("url"), body.alias("body"))
        found = one if found is None else found.unionByName(one)
    rows = page.crawl(listed, page.read_pages(found))
    return rows.select("page_id", "nth", "title", stamp(F.col("published_at")).alias("published"))


@query("time_text_articles", """SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id WHEN doc_id % 3 = 1 THEN 'Doc ' || doc_id ELSE 'One two ' || lang END AS title, strftime(TIMESTAMP '2024-05-06' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS published,
 CASE WHEN doc_id % 2 = 0 THEN 'outer inner rest' ELSE 'plain' END AS link FROM documents""")
def time_text_articles(spark, d):
    """Pages that say when only in the text of a time element; headings that are empty, missing or in parts, and anchors within anchors."""
    n = F.col("doc_id")
    drawn = F.when(n % 3 == 0, F.concat(F.lit("<title>Title "), n, F.lit("</title><h1> </h1>"))).when(n % 3 == 1, F.concat(F.lit("<h1></h1><h1>Doc "), n, F.lit("</h1><h1>Later</h1>"))).otherwise(F.concat(F.lit("<h1>One<b>two</b> "), F.col("lang"), F.lit("</h1>")))
    link = F.when(n % 2 == 0, "<a href='/a'>outer <a href='/b'>inner<i>rest</i></a><a href='/none'> </a>").otherwise("<a href='/p'>plain</a><a href='/open'>unclosed")
    body = F.concat(drawn, F.lit("<time datetime='soon'>at noon</time><time>"), F.translate(dates.told(dates.later(dates.at("2024-05-06"), minutes=n)), " ", "T"), F.lit("Z</time>"), link)
    pages = page.read_pages(_docs(spark, d).select(n.alias("page_id"), F.concat(F.lit("https://n.org/x/"), n).alias("url"), body.alias("body")))
    return pages.select("page_id", "own.title", stamp(F.col("own.published_at")).alias("published"), F.array_join(F.transform("anchors", lambda a: a["text"]), "|").alias("link"))


def _answers(spark, d):
    """Sources' answers, by the document's number: a feed; an empty feed; a page that a feed's source gave; a page of a crawled source, with two
    articles in its JSON-LD; a feed that breaks off; nothing."""
    n = F.col("doc_id")
    when = lambda k: F.concat(F.translate(dates.told(dates.later(dates.at("2024-05-06"), minutes=n + k)), " ", "T"), F.lit("Z"))
    item = lambda k: F.concat(F.lit("<item><title>F "), n, F.lit(f" {k}</title><link>https://n.org/"), n, F.lit(f"/{k}</link><pubDate>"), when(k), F.lit("</pubDate></item>"))
    feed_of = F.concat(F.lit("<rss><channel>"), item(0), item(1), F.lit("</channel></rss>"))
    own = F.concat(F.lit("<!doctype html><title>P "), n, F.lit("</title><time>"), when(0), F.lit("</time><p>no XML<br>"))
    linked = lambda k: F.concat(F.lit('{"@type":"NewsArticle","headline":"J '), n, F.lit(f' {k}","url":"/j/'), n, F.lit(f'/{k}","datePublished":"'), when(k), F.lit('"}'))
    listed = F.concat(F.lit("<html><script type='application/ld+json'>["), linked(0), F.lit(","), linked(1), F.lit("]</script><a href='/x'>A link</a></html>"))
    body = F.when(n % 6 == 0, feed_of).when(n % 6 == 1, "<rss><channel></channel></rss>").when(n % 6 == 2, own).when(n % 6 == 3, listed).when(n % 6 == 4, "<rss><item>")
    return _docs(spark, d).select(n.alias("source_id"), F.when(n % 6 == 3, "crawler").otherwise("direct").alias("mode"), F.lit(0).alias("crawler_enabled"), F.concat(F.lit("https://n.org/s/"), n).alias("url"), body.cast("binary").alias("body"))


_ANSWERED = """WITH d AS (SELECT doc_id AS n, doc_id % 6 AS m FROM documents), k AS (SELECT * FROM d, (VALUES (0), (1)) v(k)),
 r AS (SELECT n, 'feed' AS read_as, k AS position, 'F ' || n || ' ' || k AS title, 'https://n.org/' || n || '/' || k AS url, k AS late FROM k WHERE m = 0 UNION ALL SELECT n, 'crawler', 0, 'P ' || n, 'https://n.org/s/' || n, 0 FROM d WHERE m = 2
 UNION ALL SELECT n, 'crawler', k, 'J ' || n || ' ' || k, 'https://n.org/j/' || n || '/' || k, k FROM k WHERE m = 3)"""


@query("answered_items", f"{_ANSWERED} SELECT n AS source_id, read_as, position, title, url, strftime(TIMESTAMP '2024-05-06' + to_minutes(n + late), '%Y-%m-%d %H:%M:%S') AS published, FALSE AS failed FROM r UNION ALL SELECT n, 'error', NULL, NULL, NULL, NULL, TRUE FROM d WHERE m IN (4, 5)")
def answered_items(spark, d):
    """Bodies of all kinds in one table, read in one pass into items and errors."""
    rows = item_reader.answered_items(item_reader.read_answers(_answers(spark, d)), "source_id")
    return rows.select("source_id", "read_as", "position", "title", "url", stamp(F.col("published_at")).alias("published"), F.col("error").isNotNull().alias("failed"))


@query("lateral_items", f"""{_ANSWERED} SELECT n AS source_id, CASE WHEN title LIKE 'P %' THEN 'own' ELSE 'item' END AS kind, title, url FROM r UNION ALL SELECT n, 'link', 'A link', '/x' FROM d WHERE m = 3 UNION ALL SELECT n, 'error', NULL, NULL FROM d WHERE m IN (4, 5)""")
def lateral_items(spark, d):
    """The same bodies from SQL, by a table function."""
    _answers(spark, d).createOrReplaceTempView("quillstream_answers")
    return spark.sql(f"SELECT source_id, kind, title, i.url AS url FROM quillstream_answers a, LATERAL {item_reader.registered(spark)}(a.mode, a.crawler_enabled, a.url, a.body) i")
