"""A corpus from raw documents: drop poor and toxic texts, keep one of each near-duplicate group, mix sources, pack batches.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever further columns there are. Classifiers learn from the labelled
documents that are still there, never from those that the queries of the same operators hold out.

Edge cases: an empty table passes every stage as one; rows that repeat are judged alike, and each stage's docstring says what
becomes of null ids, null and empty texts. Nothing is cut from long texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import jaccard, mixing, packing, quality, toxicity
from quillstream.llm.common import doc_fold, table, unused, written
from quillstream.operators import merge

#: SQL can't express the classifiers, the cube method or the dynamic program; tests hold each stage against brute force.
ORACLE_SQL = None

LEAST_QUALITY, MOST_TOXICITY = 0.3, 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches LEAST_QUALITY. Null and empty texts are scored as one chunk of padding; a null id
    is only never learned from; without labels every document stays."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(doc_fold(5) != 0)
    model = quality.train(docs.select("doc_id", "text").where(doc_fold(5) != 0), labels)
    (score,) = unused(docs, "quality_score")
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under MOST_TOXICITY. Null and empty texts hold no n-gram and are scored by the
    class prior alone, so they stay; without toxic labels every document stays."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(doc_fold(3) != 1)
    model = toxicity.train(docs.select("doc_id", "text").where(doc_fold(3) != 1), labels)
    (score,) = unused(docs, "toxicity_score")
    return toxicity.score_toxicity(docs, model, out=score).where(F.col(score) < MOST_TOXICITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that five-word shingles link at 0.8 or more. An id that several texts share is
    a document for each of them: the text with the smallest hash goes by the id, the others come behind all ids, so texts that link
    with nothing stay whatever their id. Of rows that repeat an id and its text the first by the other columns' hash stays, the same
    on each run. Rows without id stay, and so do all without words, which link with nothing."""
    (mark,) = unused(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    known = marked.where("doc_id is not null").select("doc_id", mark).distinct()
    further = known.join(known.groupBy("doc_id").agg(F.min(mark).alias("_first")), "doc_id").where(F.col(mark) != F.col("_first")).select("doc_id", mark)
    (node,) = unused(docs, "node")
    if further.take(1):
        # numbered behind the largest id, in ranges, so that no task numbers them all
        numbered = merge.next_ids(docs.select(F.col("doc_id").alias("id")), further.withColumn("_at", F.struct("doc_id", mark)), "_at").select("doc_id", mark, F.col("id").alias(node))
        marked = marked.join(written(numbered), ["doc_id", mark], "left").withColumn(node, F.coalesce(node, "doc_id"))
    else:
        marked = marked.withColumn(node, F.col("doc_id"))
    groups = jaccard.jaccard_components(marked.select(F.col(node).alias("doc_id"), "text"))
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(node)).distinct()
    few = others.count() <= jaccard.JaccardParams.broadcast  # then no text moves
    kept = marked.join(F.broadcast(others) if few else others, node, "left_anti")
    twice = groups.where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias(node)).count().where("count > 1").select(node)
    if not twice.take(1):
        return kept.select(*docs.columns)
    again = kept.join(twice, node, "left_semi")
    rest = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = again.groupBy(node).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*rest)).alias("_row"))
    return kept.join(twice, node, "left_anti").select(*docs.columns).unionByName(first.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, up to twice. A null source is one of its own; documents without
    words count no words of any target, and are taken as the flight of their source settles them."""
    return mixing.mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket_len, batch_id, slot) of every row; wordless texts share the shortest bucket, one longer than the
    budget is a batch of its own, and null ids are packed like others."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
