"""Substring search that reads only the files that may hold the text: a signature of trigrams for each immutable file of a stored table.

A file's signature is the bitmap of the hashes of all three-letter runs of its texts, in lower case, kept in pieces of 32,768 bits (a row each,
empty ones not at all). Text that holds a pattern holds each run of three letters between the pattern's wildcards, so a file that
lacks one of their bits is not read. Bits may collide: what is read is still matched, so the rows are those of a scan. A pattern without three
letters in a row, or with an escape, reads every file. Files never change, so a commit's new files are all that is indexed anew.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.sources.store import Snapshot

#: log2 of a signature's bits: a file of some hundred thousand distinct runs sets a tenth of them.
BITS = 20
TEXTS = ("title", "summary", "publisher", "url")


def _runs(text: Column) -> Column:
    """The distinct runs of three letters of a text in lower case, found by a pattern that looks ahead: one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), 1))


def _place(run: Column) -> Column:
    """A run's bit, counted from 1, as Spark's bitmap functions count."""
    return F.xxhash64(run).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) + 1


def _name(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def pieces(pattern: str) -> list[str]:
    """The runs of three letters that any text holding the pattern holds; none where that cannot be told."""
    if "\\" in pattern:
        return []
    parts = re.split("[%_]", pattern)
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


def signatures(snapshot: Snapshot, table: str, columns: tuple[str, ...] = TEXTS, known: DataFrame | None = None) -> DataFrame:
    """(file, bucket, bitmap) of the table's files, and of files without any run (file, null, null): those of ``known`` as they are, the others
    indexed. Runs are told apart within a text, and bits are told apart in tasks before they are shuffled: bitmaps are made of those that differ."""
    spark, files = snapshot.spark, snapshot.files(table)
    done = {r[0] for r in known.select("file").distinct().collect()} if known is not None else set()
    fresh = [f for f in files if f not in done]
    kept = known.where(F.col("file").isin(files)) if known is not None and done else None
    if not fresh:
        return kept if kept is not None else spark.createDataFrame([], "file string, bucket long, bitmap binary")
    rows = spark.read.schema(snapshot[table].schema).parquet(*fresh).select(_name(F.col("_metadata.file_path")).alias("file"), F.explode(F.array(*columns)).alias("text"))
    bits = rows.select("file", F.explode(_runs(F.col("text"))).alias("run")).select("file", _place(F.col("run")).alias("at")).distinct()
    made = bits.groupBy("file", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    every = spark.createDataFrame([(f,) for f in fresh], "file string").join(made, "file", "left")
    return every if kept is None else kept.unionByName(every)


def files_with(index: DataFrame, snapshot: Snapshot, table: str, pattern: str) -> list[str]:
    """The files that may hold the pattern (as of ILIKE, between wildcards)."""
    runs, files = pieces(pattern), snapshot.files(table)
    if not runs:
        return files
    spark = snapshot.spark
    asked = spark.createDataFrame([(r,) for r in runs], "run string").select(_place(F.lower("run")).alias("at")).distinct()
    n = asked.count()
    at = asked.select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    met = index.join(F.broadcast(at), "bucket")
    byte = F.conv(F.hex(F.substr("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = met.where(F.call_function("bit_get", byte, (F.col("bit") % 8).cast("int")) == 1)
    held = {r["file"] for r in there.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("file").collect()}
    return [f for f in files if f in held]


def holding(snapshot: Snapshot, table: str, index: DataFrame, pattern: str, columns: tuple[str, ...] = TEXTS) -> DataFrame:
    """The table's rows with the pattern in one of the columns, whatever the case; its % and _ stay wildcards. Hand them to
    read_models.search as articles, and the rest of the search is as ever."""
    schema, files = snapshot[table].schema, files_with(index, snapshot, table, pattern)
    rows = snapshot.spark.read.schema(schema).parquet(*files) if files else snapshot.spark.createDataFrame([], schema)
    return rows.where(reduce(lambda x, y: x | y, [F.col(c).ilike(f"%{pattern}%") for c in columns]))
