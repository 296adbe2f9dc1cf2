"""Which of very many terms a text holds: each text is scanned once by an automaton of all terms, where it lies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
#: Bytes of terms in one automaton (which takes some twenty times as much): more terms are dealt to several, one after the other.
MOST = 8 << 20
#: Texts of a batch that are folded and scanned at a time: what they hold goes out before the next are begun.
STEP = 256


@F.pandas_udf(_STRINGS)
def folded_terms(terms: pd.Series) -> pd.Series:
    """Each term without the blanks around it, case folded: what is looked for. A blank or null term is the empty text, which is not."""
    return terms.map(lambda own: [(t or "").strip().casefold() for t in own], na_action="ignore")


def scanner(terms: list[str]):
    """A pandas UDF (title, summary): the folded terms that title or summary holds, case folded, sorted. Terms may overlap, and hold each other."""

    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t in cloudpickle.loads(sent.value):
            machine.add_word(t, t)
        machine.make_automaton()
        for title, summary in batches:
            for i in range(0, len(title), STEP):
                texts = (title.iloc[i : i + STEP].fillna("") + "\n" + summary.iloc[i : i + STEP].fillna("")).map(str.casefold)
                yield texts.map(lambda x: sorted({t for _, t in machine.iter(x)}) if x != "\n" else [])

    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(cloudpickle.dumps(terms))
    scan.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(scan, _STRINGS)


def with_terms(df: DataFrame, title: Column, summary: Column, terms: DataFrame, out: str, most: int = MOST) -> DataFrame:
    """The frame plus ``out``: of the folded terms (a column term) those that title or summary holds. Null texts hold none."""
    from quillstream.operators.lineage import cut

    terms = terms.where("term is not null and term <> ''").distinct()
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    if not size:
        return df.withColumn(out, F.array().cast(_STRINGS))
    parts, found = -(-size // most), None
    for i in range(parts):
        own = [r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).collect()]
        if not own:
            continue
        hits = scanner(own)(title, summary)
        df = df.withColumn(out, hits if found is None else F.concat(out, hits))
        found = True
        if parts > 1:  # so that one automaton is in memory at a time
            df = cut(df)
    return df


def terms_in(terms: Column, folded: Column, held: Column) -> Column:
    """The terms that are held, as they are spelled and in their order; folded: folded_terms of terms."""
    pairs = F.arrays_zip(terms.alias("term"), folded.alias("folded"))
    kept = F.transform(F.filter(pairs, lambda p: (p["folded"] != "") & F.array_contains(held, p["folded"])), lambda p: p["term"])
    return F.coalesce(kept, F.array().cast(_STRINGS))
