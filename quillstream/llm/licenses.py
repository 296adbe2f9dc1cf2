"""Licence scan by ordered signature rules, in DataFrame functions only.

A text becomes lower-case words parted by single spaces. Texts that pass the gate try the rules of which they hold a keyword;
each match is an interval of words. Of overlapping detections one is dropped that lies inside a longer one, that equals
one of better priority or earlier rank, or that partly overlaps one of better priority.

Edge cases: null and empty texts have no words and no detections; nothing of a text is left out, however long; matches
of one rule don't overlap each other; repeated rows get equal results; an empty table gives an empty result; other
columns pass through ``license_scan`` (those it adds are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import table, unused
from quillstream.llm.license_rules import GATE, Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Detections of a text that are compared with those beside them at a time.
RUN = 256
_OPEN, _SHUT = "\x01", "\x02"
_NONE = "cast(array() as array<struct<label:string,rule:int,priority:int,first:int,stop:int>>)"


def _places(words: Column, pattern: Column) -> tuple[Column, Column]:
    """First words and last words of all matches of a pattern of whole words."""
    marked = F.split(F.regexp_replace(words, F.concat(F.lit("(?<![^ ])("), pattern, F.lit(")(?![^ ])")), F.lit(f"{_OPEN}$1{_SHUT}")), " ")
    at = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    return at(lambda w: w.startswith(_OPEN)), at(lambda w: w.endswith(_SHUT))


def _rule_table(own: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.other).cast("string").alias("other"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(k).alias("rule")) for k, r in enumerate(own)])


def _detected(words: Column, own: list[Rule]) -> Column:
    opened = lambda r: F.contains(words, r["keyword"]) | F.coalesce(F.contains(words, r["other"]), F.lit(False))
    held = F.filter(_rule_table(own), lambda r: opened(r) & F.rlike(words, F.concat(F.lit("(?<![^ ])(?:"), r["pattern"], F.lit(")(?![^ ])"))))

    def rows(r: Column) -> Column:
        first, last = _places(words, r["pattern"])
        return F.zip_with(first, last, lambda a, b: F.struct(r["label"].alias("label"), r["rule"].alias("rule"), r["priority"].alias("priority"), a.alias("first"), (b + 1).alias("stop")))

    return F.flatten(F.transform(held, rows))


def _beaten(d: Column, e: Column) -> Column:
    """Whether detection e suppresses d."""
    size = lambda x: x["stop"] - x["first"]
    inside = (e["first"] <= d["first"]) & (e["stop"] >= d["stop"])
    better = (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (e["rule"] < d["rule"]))
    crossing = (e["first"] < d["stop"]) & (d["first"] < e["stop"]) & ~inside & ~((d["first"] <= e["first"]) & (d["stop"] >= e["stop"]))
    return (inside & ((size(e) > size(d)) | better)) | (crossing & (e["priority"] < d["priority"]))


def license_scan(df: DataFrame, text: str = "text", own: list[Rule] | None = None) -> DataFrame:
    """The frame plus n_words, base_first (words where base phrases start), base_labels (array), and detections: an array of
    (label, rule, priority, first, stop) of what suppression leaves, by place."""
    own = rules() if own is None else own
    t = F.col(text)
    words, found, near, *base = unused(df, "words", "found", "near", *[f"base{k}" for k in range(len(BASE))])
    low = F.translate(t, UPPER, LOWER)
    df = df.withColumns({"n_words": F.coalesce(F.regexp_count(t, F.lit(RAW_WORD)), F.lit(0)).cast("long"), words: F.when(t.rlike(GATE), F.array_join(F.regexp_extract_all(low, F.lit(WORD), 0), " "))})
    bases = [F.when(F.contains(F.col(words), F.lit(p)), _places(F.col(words), F.lit(p))[0]) for p, _ in BASE]
    df = df.withColumns({name: F.coalesce(b, F.expr("cast(array() as array<int>)")) for name, b in zip(base, bases, strict=True)})
    df = df.withColumn(found, F.when(F.col(words).isNotNull(), _detected(F.col(words), own)))
    df = df.withColumn(found, F.coalesce(F.array_sort(found, lambda a, b: F.when(a["first"] != b["first"], a["first"] - b["first"]).when(a["stop"] != b["stop"], b["stop"] - a["stop"]).otherwise(a["rule"] - b["rule"])), F.expr(_NONE)))
    # runs of detections, each with those that overlap its stretch of words: only these are compared
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(found), F.lit(1)) - 1) / RUN).cast("int")), lambda k: F.slice(found, k * RUN + 1, F.lit(RUN)))
    beside = lambda own: F.filter(found, lambda e: (e["first"] < F.array_max(own["stop"])) & (e["stop"] > F.array_min(own["first"])))
    df = df.withColumn(near, F.transform(runs, lambda own: F.struct(own.alias("own"), beside(own).alias("near"))))
    kept = F.flatten(F.transform(near, lambda p: F.filter(p["own"], lambda d: ~F.exists(p["near"], lambda e: _beaten(d, e)))))
    labels = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(name)) for b, (_, name) in zip(base, BASE, strict=True)]))
    df = df.withColumns({"base_first": F.flatten(F.array(*[F.col(b) for b in base])), "base_labels": labels, "detections": kept})
    return df.drop(words, found, near, *base)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.transform("detections", lambda d: d["label"])
    covered = F.aggregate("detections", F.lit(0), lambda a, d: a + d["stop"] - d["first"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base_first").cast("long").alias("n_base"),
        F.array_min("base_first").cast("long").alias("first_word"),
        F.array_max("base_first").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", found))), ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.least(F.lit(1.0), covered / F.col("n_words"))).otherwise(F.lit(0.0)).alias("score"),
    )
