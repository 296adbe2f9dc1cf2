"""RSS, Atom and RDF feeds as rows, whatever their namespaces."""

from __future__ import annotations

import html
import itertools
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstream.functions.dates import parse_instant
from quillstream.functions.text import category_names, plain_text, publisher_name
from quillstream.sources.tables import ITEM, arrow_fields

# Names of the elements that hold each field.
SUMMARY = ("description", "summary", "content", "encoded")
PUBLISHER = ("source", "author", "creator")
DATE = ("pubDate", "published", "updated", "date")


class Entry:
    """An item or entry of a feed: its children by local name, in the order of the document."""

    def __init__(self, node: ET.Element):
        self.children = [(c.tag.rpartition("}")[2], c) for c in node if isinstance(c.tag, str)]

    def named(self, *names: str) -> Iterator[ET.Element]:
        return (c for name, c in self.children if name in names)

    def text(self, *names: str) -> str:
        """Text of the first child, in document order, that has one of the names and is not blank."""
        return next(filter(None, (" ".join("".join(c.itertext()).split()) for c in self.named(*names))), "")

    def link(self) -> str:
        """The first alternate href; without any, the first link that is text."""
        alternate = (c.get("href", "").strip() for c in self.named("link") if c.get("rel", "alternate") in ("alternate", ""))
        written = ((c.text or "").strip() for c in self.named("link"))
        return html.unescape(next(filter(None, itertools.chain(alternate, written)), ""))

    def item(self) -> dict | None:
        """The item's fields; None without a title or a link. An undated one stays, to be counted later."""
        item = {"title": plain_text(self.text("title")), "url": self.link()}
        if not all(item.values()):
            return None
        labels = (c.get("term") or c.get("label") or c.text for c in self.named("category"))
        return item | {
            "publisher": publisher_name(plain_text(self.text(*PUBLISHER))),
            "summary": plain_text(self.text(*SUMMARY)),
            "published_at": parse_instant(self.text(*DATE)),
            "guid": plain_text(self.text("guid", "id")),
            "categories": category_names([plain_text(x) for x in labels]),
        }


def items(body: bytes) -> list[dict]:
    """The items of a feed in order; raises ET.ParseError for what is no XML."""
    found = (Entry(n).item() for n in ET.fromstring(body).iter() if isinstance(n.tag, str) and n.tag.rpartition("}")[2] in ("item", "entry"))
    return [x for x in found if x]


def parse_feeds(df: DataFrame, body: str = "body") -> DataFrame:
    """All columns but the body, and for each item position and the item's fields; a body that is no XML gives one row
    with position null and its error. The other columns stay in Arrow, so none of their values changes."""
    extra = T._parse_datatype_string(f"position int, {ITEM}, error string")  # noqa: SLF001
    others = [c for c in df.columns if c != body]
    schema = T.StructType([*(df.schema[c] for c in others), *extra.fields])
    kinds = [pa.int32(), *arrow_fields(ITEM), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(b.column(body).to_pylist()):
                try:
                    found = [x | {"position": k} for k, x in enumerate(items(bytes(raw or b"")))]
                except ET.ParseError as e:
                    found = [{"error": str(e)}]
                at += [i] * len(found)
                rows += found
            kept = [b.column(c).take(pa.array(at, pa.int64())) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r.get(f.name) for r in rows], k) for f, k in zip(extra.fields, kinds, strict=True))], schema.names)

    return df.mapInArrow(run, schema)
