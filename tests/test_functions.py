"""Functions against literals."""

from datetime import UTC, datetime
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from quillstream.functions import dates, rules, text, urls


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://EXAMPLE.org/a/b/?utm_source=x&k=1#top", "https://example.org/a/b?k=1"),
        ("http://me@Host.org:8080/", "http://host.org:8080/"),
        ("https://h.org?gclid=1&b=2&a=1", "https://h.org/?b=2&a=1"),
        ("https://h.org/x?flag", "https://h.org/x?flag="),
        ("https://a_b.org/x|y z/?q=a%20b&x=100%", "https://a_b.org/x|y z?q=a+b&x=100%25"),
        ("https://h.org:99999/x/", "https://h.org:99999/x/"),
        ("https://h.org:x/y/", "https://h.org:x/y/"),
        ("  /a/b/?utm_id=1 ", "/a/b"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == want


def test_country(spark):
    c = urls.country(F.col("u"), F.col("l"))
    assert one(spark, c, u="https://n.org/rss?q={query}&gl=us", l="en-GB") == "US"
    assert one(spark, c, u="https://n.org/rss", l="en-GB") == "GB"
    assert one(spark, c, u="https://www.trade.gov.br/x", l="pt") == "BR"
    assert one(spark, c, u="https://n.org", l="") == ""


def test_links(spark):
    score = urls.link_score(F.col("u"), F.col("t"))
    assert one(spark, score, u="https://n.org/news/2024/05/06/title", t="A long title") == 11
    assert one(spark, score, u="https://n.org/tag/x", t="A long title") is None
    assert one(spark, score, u="https://n.org/a.pdf", t="A long title") is None
    assert one(spark, score, u="https://n.org/a", t="short") is None
    assert one(spark, urls.url_date(F.col("u")), u="https://n.org/2024/5/6/t").isoformat() == "2024-05-06"
    assert one(spark, urls.url_date(F.col("u")), u="https://n.org/2024/2/30/t") is None
    assert one(spark, urls.same_site(F.col("a"), F.col("b")), a="https://www.n.org/1", b="http://N.org/2")


def test_domains_and_safety(spark):
    assert urls.site_domains("https://a.org/, site:B.org OR c.org；a.org") == ["a.org", "b.org", "c.org"]
    assert urls.site_domains("a.org 或 Bücher.de\nxn--p1ai.org") == ["a.org", "xn--bcher-kva.de", "xn--p1ai.org"] and urls.site_domains(" , ") == []
    assert all(urls.site_domains(v) is None for v in ("not a domain", "a.org/x", "a.org:80", "me@a.org", "a.org?q=1", "a.org#f", "a", "-a.org", "a..org", "甲或a.org b"))
    df = spark.createDataFrame([(u,) for u in ("ftp://a", "http://localhost/", "http://10.0.0.1/", "https://n.org/", "http://[::1]:80/", "https://a_b.org/x|y", "x", None)], "u string")
    assert [r[0] for r in df.select(urls.url_failure(F.col("u"))).collect()] == ["invalid_url", "unsafe_url", "unsafe_url", None, "unsafe_url", None, "invalid_url", "invalid_url"]
    assert [r[0] for r in df.select(urls.host(F.col("u"))).collect()] == ["a", "localhost", "10.0.0.1", "n.org", "::1", "a_b.org", "", None]


def test_feed_url(spark):
    u = urls.feed_url(F.col("t"), F.col("m"), F.col("q"), F.col("d"))
    assert one(spark, u, t="https://s.org/?q={query}", m="search", q='("a b"OR"c*~")', d="x.org OR y.org") == "https://s.org/?q=" + quote_plus('(site:x.org OR site:y.org) ("a b"OR"c*~")')
    assert one(spark, u, t="https://s.org/feed", m="direct", q="x", d="") == "https://s.org/feed"


def test_search_expression(spark):
    e = text.search_expression(F.array(F.lit(' a "x" '), F.lit("A X"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("d")), F.lit(30))
    assert one(spark, e) == '("a x"OR"b")AND("c")-"d"when:30d'
    with pytest.raises(Exception, match="match term"):
        one(spark, text.search_expression(F.array(F.lit(" ")), F.array(), F.array(), F.lit(30)))


def test_text(spark):
    assert text.plain_text("<p>a&amp;b</p>\n<b> c</b>") == "a&b c"
    assert text.publisher_name("  Ａcme   News - ") == "Acme News"
    assert text.category_names(["Trade", "trade", " ", "Tax"]) == ["Trade", "Tax"]
    assert one(spark, text.normalize_full_text(F.col("t")), t="a　 b\n\n  c ") == "a b\nc"
    assert one(spark, text.sentences_without(F.col("t"), r"(?i)\bAcme\b"), t="Good. Is it? ACME won! Fine") == "Good. Is it? Fine"
    assert one(spark, text.clean_list(F.array(F.lit(" a  b"), F.lit("A B"), F.lit(""), F.lit("c")))) == ["a b", "c"]
    assert one(spark, text.terms_for(F.array(F.lit("关税"), F.lit("tax"), F.lit("42")), F.lit("zh"))) == ["关税", "42"]


def test_sentences_against_brute_force(spark):
    """Marks, line ends and both together, against the rule in Python."""
    import random
    import re

    r = random.Random(11)
    rows = [(i, "".join(r.choice(["a", "Acme", " ", "\t", "\u3000", "\n", "!", "。", "?"]) for _ in range(r.randint(0, 25)))) for i in range(400)]
    got = {x["i"]: x["s"] for x in spark.createDataFrame(rows, "i long, t string").select("i", text.sentences_without(F.col("t"), "(?i)Acme").alias("s")).collect()}
    for i, t in rows:
        assert got[i] == "".join(s for s in re.split(r"(?<=[。！？!?])|\n+", t) if s.strip() and not re.search("(?i)Acme", s)).strip(), t


def test_fingerprint_keeps_empty_parts(spark):
    import hashlib

    f = text.fingerprint(F.lit(" A  b"), F.lit(None).cast("string"), F.lit(None).cast("timestamp"))
    assert one(spark, f) == hashlib.sha256(b"a b||").hexdigest()


def test_dates(spark):
    now = F.lit("2026-07-22 04:00:00").cast("timestamp")
    assert one(spark, dates.lookback_start(now, "Asia/Shanghai", F.lit(14)).cast("string")) == "2026-07-08 16:00:00"
    assert one(spark, dates.parse_date(F.lit("Tue, 02 Jan 2024 10:00:00 +0800")).cast("string")) == "2024-01-02 02:00:00"
    assert one(spark, dates.parse_date(F.lit("2024-01-02T03:04:05Z")).cast("string")) == "2024-01-02 03:04:05"
    assert one(spark, dates.parse_date(F.lit("soon"))) is None
    assert dates.parse_instant("Tue, 02 Jan 2024 10:00:00 GMT") == datetime(2024, 1, 2, 10, tzinfo=UTC)
    assert [one(spark, dates.wait_minutes(F.lit(n))) for n in (1, 2, 9, 30)] == [5, 10, 1280, 1440]
    told = lambda hours, schedule, day=None: str(one(spark, dates.next_run_at(F.lit(datetime(2024, 1, 1, hours, tzinfo=UTC)), F.lit(schedule), last_day=F.lit(day).cast("date")).cast("string")))
    assert told(1, "bad") == "2024-01-02 00:00:00" and told(1, "09:30") == "2024-01-01 01:30:00"
    assert told(1, "09:30", "2024-01-01") == "2024-01-02 01:30:00" and told(1, "09:30", "2023-12-31") == "2024-01-01 01:30:00"
    at = F.lit(datetime(2024, 1, 2, 10, tzinfo=UTC))
    wait = lambda v: one(spark, dates.retry_seconds(F.lit(v), at))
    assert [wait(v) for v in (" 120 ", "0", "Tue, 02 Jan 2024 10:01:30 GMT", "Tue, 02 Jan 2024 09:00:00 GMT", "soon", "", None, "9" * 30, "2024-01-03")] == [120, 1, 90, 1, None, None, None, None, None]
    start, end = dates.day_window("2024-01-01", "2024-01-02")
    assert (end - start).days == 2
    with pytest.raises(ValueError):
        dates.day_window("2024-01-05", "2024-01-02")


def test_rules(spark):
    assert [one(spark, rules.risk_level(F.lit(n))) for n in (90, 65, 35, 0)] == ["critical", "high", "medium", "low"]
    assert one(spark, rules.positive_ids(F.array(F.lit("3"), F.lit("x"), F.lit("-1"), F.lit("3")))) == [3]
    assert one(spark, rules.json_list(F.lit("broken"))) == []
    assert one(spark, rules.cooldown_seconds(F.lit("access_blocked"), F.lit(None).cast("int"), F.lit(60))) == 86400
    assert rules.clamped("7000", 1, 100, 20) == 100 and rules.clamped("x", 1, 100, 20) == 20
    assert one(spark, rules.valid_ids(F.array(F.lit(2), F.lit(9), F.lit(2), F.lit(1)), F.array(F.lit(1), F.lit(2)))) == [2, 1]


def test_terms_against_brute_force(spark):
    """Terms that overlap, hold each other, fold to two letters or are blank, in one automaton and in several."""
    import random

    from quillstream.functions import terms

    r = random.Random(3)
    known = ["a", "ab", "bab", "abab", "Straße", "STRASSE", "İ", " trim\u2003", "", "  ", None, "ﬁ", "fi", "b\na"] + ["".join(r.choice("abß") for _ in range(r.randint(1, 5))) for _ in range(300)]
    texts = [(i, "".join(r.choice("abBßs fi") for _ in range(r.randint(0, 40))), "".join(r.choice("abİ trim") for _ in range(20)) if i % 3 else None) for i in range(200)] + [(200, None, None), (201, "", ""), (202, "STRASSE", "ﬁn"), (203, "xb", "ay")]
    items = spark.createDataFrame(texts, "i long, title string, summary string")
    tasks = spark.createDataFrame([(known,)], "match_terms array<string>")
    folded = tasks.select(F.explode(terms.folded_terms("match_terms")).alias("term"))
    want = {i: [t for t in known if t and t.strip() and t.strip().casefold() in f"{a or ''}\n{b or ''}".casefold()] for i, a, b in texts}
    for most in (terms.MOST, 700):
        found = terms.with_terms(items, F.col("title"), F.col("summary"), folded, "held", most).crossJoin(tasks.withColumn("f", terms.folded_terms("match_terms")))
        got = {x["i"]: x["hits"] for x in found.select("i", terms.terms_in(F.col("match_terms"), F.col("f"), F.col("held")).alias("hits")).collect()}
        assert got == want
    assert want[202] and want[203] == ["a", "b\na"] or "b\na" in want[203]
    none = terms.with_terms(items, F.col("title"), F.col("summary"), folded.limit(0), "held")
    assert none.where("size(held) > 0").count() == 0


def test_judged_reads_no_text(spark):
    """Items meet their tasks without their texts, which are scanned once."""
    from quillstream.operators import collect

    items = spark.createDataFrame([(1, None, "License", "x"), (2, 7, "none", "y")], "rss_source_id long, keyword_id long, title string, summary string").withColumn("published_at", F.lit(datetime(2024, 1, 2, tzinfo=UTC)))
    tasks = spark.createDataFrame([(1, k, [f"t{k}", "license"]) for k in range(50)] + [(2, 7, ["ON"])], "rss_source_id long, keyword_id long, match_terms array<string>").withColumn("window_start", F.lit(datetime(2024, 1, 1, tzinfo=UTC)))
    rows = collect.judged(items, tasks, F.lit(datetime(2024, 1, 3, tzinfo=UTC)), True)
    assert not {"title", "summary"} & set(rows.columns) and rows.where("outcome = 'matched'").count() == 51
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and not any("title" in x or "summary" in x for x in plan.split("ReadSchema")[1:] if "ArrowEvalPython" not in x[:20])


def test_scanned_in_steps(spark):
    """What a batch's texts hold goes out a few texts at a time, in their order."""
    import pandas as pd

    from quillstream.functions import terms

    texts = [f"ab {k}" if k % 3 else None for k in range(1000)]
    out = list(terms.scanner(["ab", "b 7", "zz"]).func(iter([(pd.Series([None] * 1000, dtype=object), pd.Series(texts, dtype=object))])))
    assert max(len(x) for x in out) <= terms.STEP and len(out) == -(-1000 // terms.STEP)
    assert [list(x) for s in out for x in s] == [[t for t in ("ab", "b 7") if t in (x or "")] for x in texts]
