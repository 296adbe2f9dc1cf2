"""Web pages as rows: structure, articles, and ranked links. Fetching stays outside; pages arrive as bytes."""

from __future__ import annotations

import codecs
import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import dates, urls
from quillstream.functions.dates import parse_instant
from quillstream.functions.text import category_names, plain_text, publisher_name
from quillstream.operators.lineage import cut
from quillstream.sources.tables import ITEM, arrow_fields

# JSON-LD types that are articles, and metadata names of each field in order of preference.
ARTICLE_TYPES = {"article", "blogposting", "newsarticle", "report"}
TITLE_META = ("og:title", "twitter:title", "headline")
DATE_META = ("article:published_time", "datepublished", "date", "dc.date", "dcterms.date", "pubdate")
PUBLISHER_META = ("og:site_name", "author")
SUMMARY_META = ("og:description", "twitter:description", "description")
SECTION_META = ("article:section", "section")
# Marks of HTML in the first 4 KB, and of a bot challenge in the first 64 KB.
HTML_MARKS = (b"<!doctype html", b"<html", b"<article", b"<a ")
CHALLENGE_MARKS = (b"cf-chl-", b"/cdn-cgi/challenge-platform/", b"verify you are human", b"captcha", b"access denied")
MOST_ARTICLES = 30


def decoded(body: bytes) -> str:
    """Text of a page: by the charset it names in its first 4 KB, else UTF-8, GB 18030, Latin-1."""
    named = re.search(rb"""charset\s*=\s*["']?\s*([a-zA-Z0-9._-]+)""", body[:4096], re.IGNORECASE)
    for name in (named[1].decode() if named else "utf-8-sig", "utf-8-sig", "gb18030", "latin-1"):
        try:
            codecs.lookup(name)
            return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decode_page(s: pd.Series) -> pd.Series:
    return s.map(lambda b: decoded(bytes(b)), na_action="ignore")


def _marked(body: Column, length: int, marks: tuple[bytes, ...]) -> Column:
    head = F.lower(F.decode(F.substring(body, 1, length), "ISO-8859-1"))
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(head, F.lit(m.decode()))
    return F.coalesce(found, F.lit(False))


def looks_like_html(body: Column) -> Column:
    return _marked(body, 4096, HTML_MARKS)


def looks_like_challenge(body: Column) -> Column:
    return _marked(body, 65536, CHALLENGE_MARKS)


class Page(HTMLParser):
    """Base, first value of each metadata name, anchors, JSON-LD blocks, title, first h1 with text, and times of a page.

    Elements whose text counts are kept apart while they are open, so they may stand within each other: an anchor in an anchor is
    text of the outer one, a time within a heading is both. Pieces of a text that other tags part are words of their own. All
    titles, those of drawings too, are one title; a title or heading that is never closed goes on to the end.
    """

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.base, self.meta, self.anchors, self.blocks = "", {}, [], []
        self.heading, self.times, self.titles = "", [], []
        self._open: dict[str, list[str]] = {}
        self._href = ""
        self.feed(text)
        self.close()
        for tag in ("title", "h1"):
            self.handle_endtag(tag)

    @property
    def title(self) -> str:
        return " ".join(self.titles)

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: (v or "").strip() for k, v in attrs}
        if tag == "base":
            self.base = self.base or a.get("href", "")
        elif tag == "meta":
            name = next((a[k] for k in ("property", "name", "itemprop") if a.get(k)), "").casefold()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"])
        elif tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        if tag == "a" and "a" not in self._open:
            self._href = a.get("href", "")
        counts = {"a": "a" not in self._open, "title": tag not in self._open, "h1": not self.heading and tag not in self._open, "time": True, "script": a.get("type", "").casefold() == "application/ld+json"}
        if counts.get(tag):
            self._open[tag] = []

    def handle_endtag(self, tag: str) -> None:
        parts = self._open.pop(tag, None)
        if parts is None:
            return
        words = " ".join(" ".join(parts).split())
        if tag == "script":
            self.blocks.append("".join(parts))
        elif not words:
            return
        elif tag == "a" and self._href:
            self.anchors.append((self._href, words))
        elif tag == "time":
            self.times.append(words)
        elif tag == "title":
            self.titles.append(words)
        elif tag == "h1":
            self.heading = words

    def handle_data(self, data: str) -> None:
        for parts in self._open.values():
            parts.append(data)

    def first(self, names: tuple[str, ...]) -> str:
        return next((self.meta[n] for n in names if self.meta.get(n)), "")


def _objects(value) -> Iterator[dict]:
    todo = [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, dict):
            yield v
            todo = [*v.values(), *todo]
        elif isinstance(v, list):
            todo = [*v, *todo]


def _text(value) -> str:
    return value if isinstance(value, str) else str(value) if value else ""


def linked_articles(page: Page, page_url: str, publisher: str) -> list[dict]:
    """Articles of the page's JSON-LD, however nested, that have a title and a date."""
    out = []
    for block in page.blocks:
        try:
            root = json.loads(block)
        except ValueError:
            continue
        for v in _objects(root):
            kinds = v.get("@type")
            kinds = {kinds.casefold()} if isinstance(kinds, str) else {k.casefold() for k in kinds if isinstance(k, str)} if isinstance(kinds, list) else set()
            title = plain_text(_text(v.get("headline") or v.get("name"))) if kinds & ARTICLE_TYPES else ""
            date = parse_instant(_text(v.get("datePublished") or v.get("dateCreated") or v.get("dateModified"))) if title else None
            if date is None:
                continue
            link = v.get("url") or v.get("mainEntityOfPage") or ""
            link = (link.get("@id") or link.get("url") or "") if isinstance(link, dict) else link
            link = urljoin(page_url, link) if isinstance(link, str) else page_url
            who = v.get("publisher")
            who = _text(who.get("name")) if isinstance(who, dict) else who if isinstance(who, str) else ""
            section = v.get("articleSection")
            section = [_text(x) for x in section] if isinstance(section, list) else [_text(section)]
            out.append({"title": title, "url": link, "publisher": publisher_name(who or publisher), "summary": plain_text(_text(v.get("description") or v.get("abstract"))), "published_at": date, "guid": link, "categories": category_names(section)})
    return out


def described(page: Page, url: str, publisher: str = "") -> dict | None:
    """The page's own article by its metadata, heading and times; none without a title. Its date may be missing."""
    title = plain_text(page.first(TITLE_META) or page.heading or page.title)
    if not title:
        return None
    dates = (parse_instant(v) for v in (page.first(DATE_META), *page.times))
    return {"title": title, "url": url, "publisher": publisher_name(page.first(PUBLISHER_META) or publisher), "summary": plain_text(page.first(SUMMARY_META)), "published_at": next((d for d in dates if d), None), "guid": url, "categories": category_names([page.first(SECTION_META)])}


_NAMES = [f.split(" ")[0] for f in ITEM.split(", ")]
_ITEM = T.StructType([T.StructField(n, T.TimestampType() if k == "timestamp" else T.ArrayType(T.StringType()) if k.startswith("array") else T.StringType()) for n, k in (f.split(" ") for f in ITEM.split(", "))])
_ANCHORS = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))
_ARROW_ITEM = pa.struct(list(zip(_NAMES, arrow_fields(ITEM), strict=True)))
_ARROW = {
    "url": pa.string(), "title": pa.string(), "heading": pa.string(), "meta": pa.map_(pa.string(), pa.string()), "base": pa.string(),
    "linked": pa.list_(_ARROW_ITEM), "described": _ARROW_ITEM, "anchors": pa.list_(pa.struct([("position", pa.int32()), ("url", pa.string()), ("text", pa.string())])),
}


def own_article(url: Column, linked: Column, told: Column) -> Column:
    """The page's own article: the JSON-LD article of its URL, else the only one there is, else what the page says of itself,
    dated by its URL where it names no date; null without any date."""
    same = F.get(F.filter(linked, lambda x: urls.canonical_url(x["url"]) == urls.canonical_url(url)), F.lit(0))
    by_path = dates.instant_of(urls.url_date(url))
    dated = F.when(told.isNotNull(), told.withField("published_at", F.coalesce(told["published_at"], by_path)))
    return F.coalesce(same, F.when(F.size(linked) == 1, F.get(linked, F.lit(0))), F.when(dated["published_at"].isNotNull(), dated))


def read_pages(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "body", publisher: str | None = None, articles: bool = True) -> DataFrame:
    """(key, url, title, heading, meta, base, linked: its JSON-LD articles, own: its own article or null, anchors) of
    each page; body is binary or text. Links are absolute against the page's base where that is on its site. Without
    ``articles`` linked is empty and own null, and nothing is spent on them. Keys stay in Arrow, so none of them changes."""
    told = T._parse_datatype_string("url string, title string, heading string, meta map<string,string>, base string").fields  # noqa: SLF001
    schema = T.StructType([df.schema[key], *told, T.StructField("linked", T.ArrayType(_ITEM)), T.StructField("described", _ITEM), T.StructField("anchors", _ANCHORS)])
    taken = df.select(key, F.coalesce(F.col(url), F.lit("")), F.col(body), F.coalesce(F.col(publisher), F.lit("")) if publisher else F.lit(""))

    def absolute(base: str, href: str) -> str | None:
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    def row(u: str, b, who: str) -> dict:
        page = Page(b if isinstance(b, str) else decoded(bytes(b or b"")))
        base = absolute(u, page.base) or u if page.base else u
        base = base if site(base) and site(base) == site(u) else u
        links = ((i, absolute(base, html.unescape(href)), text) for i, (href, text) in enumerate(page.anchors))
        return {
            "url": u, "title": page.title, "heading": page.heading, "meta": list(page.meta.items()), "base": base,
            "linked": linked_articles(page, u, who) if articles else [], "described": described(page, u, who) if articles else None,
            "anchors": [{"position": i, "url": link, "text": text} for i, link, text in links if link is not None],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], k) for n, k in _ARROW.items())], schema.names)

    pages = taken.mapInArrow(run, schema)
    own = own_article(F.col("url"), F.col("linked"), F.col("described")) if articles else F.col("described")
    return pages.select(key, *[f.name for f in told], "linked", own.alias("own"), "anchors")


def site(url: str) -> str:
    """The site of a URL: its host without port and without one leading www."""
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", url, re.IGNORECASE)
    return re.sub(r"^www\.", "", (found[1] if found else "").casefold())


def ranked_links(pages: DataFrame, key: str = "page_id", most: int = 2 * MOST_ARTICLES) -> DataFrame:
    """Links of each page worth fetching, best score first: on its site, not itself, one of each canonical URL.
    Returns (key, rank, position, url, canonical_url, text, score). A page's links rank within its row: nothing is shuffled."""
    link = lambda a: F.struct((-urls.link_score(a["url"], a["text"])).alias("order"), a["position"].alias("position"), a["url"].alias("url"), urls.canonical_url(a["url"]).alias("canonical_url"), a["text"].alias("text"))
    near = F.filter("anchors", lambda a: urls.scheme(a["url"]).isin("http", "https") & urls.same_site(F.col("base"), a["url"]))
    rows = pages.select(key, urls.canonical_url(F.col("url")).alias("own"), F.filter(F.transform(near, link), lambda x: x["order"].isNotNull()).alias("links"))
    rows = rows.select(key, F.filter("links", lambda x: x["canonical_url"] != F.col("own")).alias("links"))
    rows = rows.select(key, "links", F.transform("links", lambda x: x["canonical_url"]).alias("seen"))
    first = F.filter("links", lambda x, i: F.array_position("seen", x["canonical_url"]) == i + 1)
    ranked = rows.select(key, F.posexplode(F.slice(F.array_sort(first), 1, most)).alias("nth", "x"))
    return ranked.select(key, (F.col("nth") + 1).alias("rank"), "x.position", "x.url", "x.canonical_url", "x.text", (-F.col("x.order")).alias("score"))


def crawl(pages: DataFrame, fetched: DataFrame, key: str = "page_id", most: int = MOST_ARTICLES) -> DataFrame:
    """Articles of crawled listing pages: of the page's JSON-LD, of itself, then of its ranked links' pages.

    pages: what read_pages gave for the listings; fetched: what it gave for the links' pages, with their url.
    Returns (key, nth, item fields): on the page's site, one of each canonical URL, at most ``most`` a page.
    """
    pages = cut(pages.select(key, "url", "base", "linked", "own", "anchors"))  # three steps read them, and each page is parsed once
    listed = pages.select(key, F.col("url").alias("page_url"), F.posexplode("linked").alias("pos", "item")).withColumn("step", F.lit(0))
    own = pages.where("own is not null").select(key, F.col("url").alias("page_url"), F.lit(0).alias("pos"), F.col("own").alias("item"), F.lit(1).alias("step"))
    links = ranked_links(pages, key).join(fetched.where("own is not null").select("url", F.col("own").alias("item")), "url")
    linked = links.join(pages.select(key, F.col("url").alias("page_url")), key).select(key, "page_url", F.col("rank").alias("pos"), "item", F.lit(2).alias("step"))
    rows = listed.unionByName(own).unionByName(linked)
    rows = rows.where(urls.scheme(F.col("item.url")).isin("http", "https") & urls.same_site(F.col("page_url"), F.col("item.url")))
    rows = rows.withColumn("canonical", urls.canonical_url(F.col("item.url")))
    once = F.row_number().over(W.partitionBy(key, "canonical").orderBy("step", "pos"))
    rows = rows.withColumn("once", once).where("once = 1")
    nth = F.row_number().over(W.partitionBy(key).orderBy("step", "pos"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select(key, "nth", "item.*")


def load_mode(mode: Column, crawler: Column, parse_error: Column, item_count: Column, body: Column) -> Column:
    """How a source's answer is read: as crawler, as feed, or by falling back from a feed that fails or is empty to the crawler
    where the body is HTML; error where neither reads it."""
    page = looks_like_html(body)
    return F.when((mode == "crawler") | (crawler == 1), "crawler").when(parse_error.isNotNull(), F.when(page, "crawler").otherwise("error")).when((item_count == 0) & page, "crawler").otherwise("feed")
