"""Text functions: JVM expressions where Spark has the semantics, Arrow UDFs for Unicode normalisation, case folding and HTML.

Python's whitespace includes no-break and ideographic spaces, so the patterns here say (?U).
"""

from __future__ import annotations

import html
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import dates

_STRINGS = T.ArrayType(T.StringType())
HAN = r"[㐀-䶿一-鿿豈-﫿]"
LATIN = r"[A-Za-z]"


def squash(c: Column) -> Column:
    """Whitespace runs as one space, ends trimmed; null stays null."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


class _Words(HTMLParser):
    """The words of a fragment's text, whatever tags stand between them."""

    def reset(self) -> None:
        super().reset()
        self.words: list[str] = []

    def handle_data(self, data: str) -> None:
        self.words += data.split()


def plain_text(value: str | None) -> str:
    """Text of an HTML fragment whose markup may be escaped: entities resolved, tags dropped, whitespace squashed. What the parser
    refuses is text as it stands."""
    fragment, reader = html.unescape(value or ""), _Words()
    try:
        reader.feed(fragment)
        reader.close()
    except Exception:  # noqa: BLE001
        return " ".join(fragment.split())
    return " ".join(reader.words)


def publisher_name(value: str | None) -> str:
    """NFKC, whitespace squashed, and the separators around a name stripped."""
    return " ".join(unicodedata.normalize("NFKC", value or "").split()).strip(" -|·")


def category_names(values) -> list[str]:
    """NFKC names without blanks, the first spelling of each by case folding."""
    found: dict[str, str] = {}
    for value in values if values is not None else ():
        name = " ".join(unicodedata.normalize("NFKC", value or "").split())
        if name:
            found.setdefault(name.casefold(), name)
    return list(found.values())


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(plain_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def publisher_key(s: pd.Series) -> pd.Series:
    return s.map(publisher_name)


@F.pandas_udf(_STRINGS)
def category_list(s: pd.Series) -> pd.Series:
    return s.map(category_names)


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(_STRINGS)
def _folded_first(terms: pd.Series) -> pd.Series:
    """The first spelling of each term by case folding."""

    def first(own):
        found: dict[str, str] = {}
        for t in own:
            found.setdefault(t.casefold(), t)
        return list(found.values())

    return terms.map(first, na_action="ignore")


def normalize_terms(terms: Column) -> Column:
    """Search terms: double quotes out, whitespace squashed, blanks out, first spelling by case folding. Strategies are few, so
    an Arrow UDF serves where Java's lower case and folding differ."""
    return _folded_first(F.filter(F.transform(terms, lambda t: squash(F.replace(t, F.lit('"'), F.lit(" ")))), lambda t: t != ""))


def fingerprint(title: Column, publisher: Column, published: Column) -> Column:
    """SHA-256 of title, publisher and UTC date; missing parts are empty, never skipped."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(part(squash(F.lower(title))), F.lit("|"), part(F.lower(publisher)), F.lit("|"), part(dates.wall_of(published).cast("date").cast("string"))), 256)


@F.pandas_udf(T.StringType())
def folded_title(s: pd.Series) -> pd.Series:
    """What the fingerprint takes of a title: case folded, then squashed."""
    return s.map(lambda t: " ".join((t or "").casefold().split()))


def normalize_full_text(c: Column) -> Column:
    """Lines squashed, blank lines out."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\R"), squash), lambda x: x != ""), "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def sentences_without(c: Column, pattern: str) -> Column:
    """Text without the sentences that match the pattern, and without blank ones. Line ends part sentences and go, after a mark
    too: Java's split would skip a line end right behind the empty match at a mark."""
    parts = F.split(c, r"(?<=[。！？!?])(?!\n)|\n+")
    kept = F.array_join(F.filter(parts, lambda s: s.rlike(r"(?U)[^\s\x1C-\x1F]") & ~s.rlike(pattern)), "")
    return F.regexp_replace(kept, r"(?U)^[\s\x1C-\x1F]+|(?<![\s\x1C-\x1F])[\s\x1C-\x1F]+\z", "")


def clean_list(values: Column, limit: int = 8, length: int = 500) -> Column:
    """The first ``limit`` values, squashed and cut, without blanks or values that case folding makes one."""
    cut = F.filter(F.transform(F.slice(values, 1, limit), lambda v: F.substring(squash(v), 1, length)), lambda v: v != "")
    return _folded_first(cut)


def split_names(c: Column) -> Column:
    """Names of a comma-joined list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def short_title(c: Column, length: int = 24, default: str = "Summary") -> Column:
    """The first sentence, cut; the default where there is none."""
    first = F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), r"[。！？!?\n]"), 1))
    return F.when(first != "", F.substring(first, 1, length)).otherwise(default)


def truncated(c: Column, length: int) -> tuple[Column, Column]:
    """(text, whether it was cut)."""
    return F.substring(c, 1, length), F.length(c) > length


def script(term: Column) -> Column:
    """zh for any Han character, else en for a Latin letter, else null."""
    return F.when(term.rlike(HAN), "zh").when(term.rlike(LATIN), "en")


def terms_for(terms: Column, language: Column) -> Column:
    """Trimmed terms written in the language, or in no script that tells one."""
    kept = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: (t != "") & (script(t).isNull() | (script(t) == language)))
    return F.coalesce(kept, F.array().cast(_STRINGS))


def search_expression(match: Column, context: Column, exclude: Column, lookback: Column) -> Column:
    """One search expression: ("a"OR"b")AND("c")-"d"when:30d. No match term, or a lookback outside 1..365, raises."""
    quoted = lambda terms: F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    group = lambda terms: F.concat(F.lit("("), F.array_join(quoted(terms), "OR"), F.lit(")"))
    none = F.array().cast(_STRINGS)
    own, more, less = normalize_terms(match), F.coalesce(normalize_terms(context), none), F.coalesce(normalize_terms(exclude), none)
    text = F.concat(
        group(own),
        F.when(F.size(more) > 0, F.concat(F.lit("AND"), group(more))).otherwise(""),
        F.array_join(F.transform(less, lambda t: F.concat(F.lit('-"'), t, F.lit('"'))), ""),
        F.when(lookback.isNotNull(), F.concat(F.lit("when:"), lookback.cast("string"), F.lit("d"))).otherwise(""),
    )
    return F.when(F.coalesce(F.size(own), F.lit(0)) < 1, F.raise_error(F.lit("a strategy needs a match term"))).when(lookback.isNotNull() & ~lookback.between(1, 365), F.raise_error(F.lit("lookback must be 1 to 365 days"))).otherwise(text)
