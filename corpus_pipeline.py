"""A corpus pipeline of five stages over ``documents``, each calling one operator of ``fidelis.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
their input, which are those of documents and may be more. The result of each is written as Parquet
and read again as the next one's input. Tests compare the stages with brute force; SQL can't express
them, so ORACLE_SQL is None.

Cases that hold for all stages: an empty table stays empty; rows are judged one by one, so repeated
rows and null ids are rows like others; a null text counts as empty (and fails the quality rules).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import mixing, ngram_join, quality_classifier, quality_rules, queries, sentencepiece_lattice
from fidelis.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None
#: What the mixing stage adds and the last stage returns.
PLACES = ["mix_slot", "mix_position"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (labels of the corpus train it).

    Null and empty texts are scored like others; a table without labelled rows rejects nothing.
    """
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts have no words and fail them."""
    return quality_rules.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: five words, similarity 0.8.

    Where ids repeat or are null, rows get numbers of their own first, so that each row is a document;
    of rows with the same id, or of rows without any, the smallest number stays. Documents without
    words are near nothing and stay.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        found = ngram_join.ngram_join(docs, width=5, percent=80)
        return docs.join(found.filter("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    numbered = written(docs.select(F.monotonically_increasing_id().alias("_number"), row), "numbered-rows")
    found = ngram_join.ngram_join(numbered.select(F.col("_number").alias("doc_id"), "row.text"), width=5, percent=80)
    named = found.select(F.col("doc_id").alias("_number"), "component_id").join(numbered.select("_number", F.col("row.doc_id").alias("id")), "_number")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_number")).alias("best"))
    return numbered.join(best.select(F.col("best._number").alias("_number")), "_number", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixed sequence, mix_slot and mix_position, written in its order.

    Null sources are a source of their own; rows with equal or null ids stand in any order among them. A
    column of the input that has one of these names is replaced.
    """
    columns = [c for c in docs.columns if c not in PLACES]
    mixed = mixing.mix(docs, queries.SHARES, block=queries.BLOCK, many=True)
    return mixed.orderBy("mix_position", "doc_id").select(*columns, *PLACES)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' SentencePiece ids, whether they decode to the text, and their places in the mixed sequence.

    Ordering by mix_position gives the mixed sequence. Documents that come without places are mixed first.
    """
    if not set(PLACES) <= set(docs.columns):
        docs = mixing.mix(docs.select("doc_id", "text", "source"), queries.SHARES, block=queries.BLOCK, many=True)
    return sentencepiece_lattice.sentencepiece_encoded(docs, keep=PLACES)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("quality rules", drop_by_rules),
    ("n-gram jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
