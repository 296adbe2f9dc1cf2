"""From the bytes that sources answered to items: how a body is read is decided body by body, in one pass.

A crawled source's body is a page. Any other is a feed; what is no XML, or a feed without items, is a page if it looks like HTML. A body that is
neither fails with its parser's message. From SQL the same reading is a table function (see registered).
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.sources import page
from quillstream.sources.feed import items as feed_items
from quillstream.sources.page import HTML_MARKS, Page, decoded, described, linked_articles
from quillstream.sources.tables import ITEM, arrow_fields

_ITEMS = T.ArrayType(page._ITEM)  # noqa: SLF001
_ARROW_ITEMS = pa.list_(pa.struct(list(zip([f.split(" ")[0] for f in ITEM.split(", ")], arrow_fields(ITEM), strict=True))))


def is_html(body: bytes) -> bool:
    """Whether a body's beginning looks like a page: page.looks_like_html of one value."""
    return any(mark in body[:4096].lower() for mark in HTML_MARKS)


def read_body(mode: str | None, crawler: int | None, body: bytes) -> tuple[str, list[dict], str | None]:
    """(feed, crawler or error; a feed's items; the error) of a body. A source that is crawled by its mode or its switch is a page."""
    if mode == "crawler" or crawler == 1:
        return "crawler", [], None
    try:
        found, fault = feed_items(body), None
    except ET.ParseError as e:
        found, fault = [], str(e)
    if not found and is_html(body):
        return "crawler", [], None
    return ("error", [], fault) if fault is not None else ("feed", found, None)


def read_answers(df: DataFrame, mode: str = "mode", crawler: str = "crawler_enabled", body: str = "body") -> DataFrame:
    """The frame with read_as (feed, crawler or error), items (of feeds) and error; the body stays for pages only. A null body is an
    error, a null mode is a feed's. Works on streams, too: rows are read on their own."""
    names = [c for c in df.columns if c != body]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(body, T.BinaryType()), T.StructField("read_as", T.StringType()), T.StructField("items", _ITEMS), T.StructField("error", T.StringType())])
    if {"read_as", "items", "error"} & set(names):
        raise ValueError("read_as, items and error are the names of what is read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [None if x is None else x.encode() if isinstance(x, str) else bytes(x) for x in b.column(body).to_pylist()]
            read = [("error", [], "no body") if raw is None else read_body(m, c, raw) for m, c, raw in zip(b.column(mode).to_pylist(), b.column(crawler).to_pylist(), raws, strict=True)]
            kept = pa.array([raw if r[0] == "crawler" else None for raw, r in zip(raws, read, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), kept, pa.array([r[0] for r in read]), pa.array([r[1] for r in read], _ARROW_ITEMS), pa.array([r[2] for r in read], pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def answered_items(read: DataFrame, key: str, url: str = "url", publisher: str | None = None, fetched: DataFrame | None = None) -> DataFrame:
    """Items and errors of read_answers: (key, read_as, position, item fields, error). Pages give the articles of their JSON-LD, their own and, where
    ``fetched`` has what page.read_pages gave for the pages they link to, those of their ranked links; errors have no position."""
    fields = [f"item.{f.name}" for f in page._ITEM.fields]  # noqa: SLF001
    of_feeds = read.where("read_as = 'feed'").select(key, "read_as", F.posexplode("items").alias("position", "item")).select(key, "read_as", "position", *fields)
    pages = page.read_pages(read.where("read_as = 'crawler'"), key, url, "body", publisher)
    none = pages.limit(0) if fetched is None else fetched
    crawled = page.crawl(pages, none, key).withColumn("position", (F.col("nth") - 1).cast("int")).withColumn("read_as", F.lit("crawler")).select(*of_feeds.columns)
    told = of_feeds.unionByName(crawled).withColumn("error", F.lit(None).cast("string"))
    failed = read.where("read_as = 'error'").select(key, "read_as", "error")
    return told.unionByName(failed, allowMissingColumns=True)


class ItemsOf:
    """Rows of a body for SQL: (kind, position, item fields, error). kind is item (of a feed, or of a page's JSON-LD), own (what a page says of itself,
    dated or not, unless one JSON-LD article stands for it), link (of a page: its reference as url, its text as title) or error."""

    def eval(self, mode: str, crawler: int, url: str, body: bytes):
        read_as, found, fault = ("error", [], "no body") if body is None else read_body(mode, crawler, bytes(body))
        rows = [("item", x) for x in found]
        if read_as == "crawler":
            told = Page(decoded(bytes(body)))
            linked, own = linked_articles(told, url or "", ""), described(told, url or "", "")
            rows = [("item", x) for x in linked] + [("own", own)] * (own is not None and len(linked) != 1) + [("link", {"url": href, "title": text}) for href, text in told.anchors]
        for i, (kind, x) in enumerate(rows):
            yield (kind, i, *(x.get(name) for name in ("title", "url", "publisher", "summary", "published_at", "guid", "categories")), None)
        if fault is not None:
            yield ("error", None, *[None] * 7, fault)


def registered(spark: SparkSession, name: str = "items_of") -> str:
    """Registers ItemsOf for SQL: SELECT ... FROM answers, LATERAL items_of(mode, crawler_enabled, url, body)."""
    spark.udtf.register(name, F.udtf(ItemsOf, returnType=f"kind string, position int, {ITEM}, error string"))
    return name
