"""The corpus pipeline: toxicity, language, near-duplicates, mixing and tokenisation, one after the other over documents.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.

Defined cases: null and empty text, and text without words, scores as the toxicity model's bias, and goes with all other text without
a letter in the language stage; very long texts are read whole by every stage; of rows that repeat an id or have none, equal ones
among them, near-duplicates keep the first of each group by id and a hash of the text; rows that tie in order of mixing follow
id and size; a document without words has no row after mixing; an empty table gives empty tables with the same columns; other
columns, whatever their names, are carried up to the last stage. Without labels or languages to learn from, toxicity keeps all that its
bias keeps, and the language stage rejects all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, language, mixing, neardup, toxicity
from wayline.llm.common import id_remainder, read, settle, shared_folder
from wayline.llm.neardup import MOST_BROADCAST
from wayline.llm.pieces import path
from wayline.llm.queries import digest

#: A document is rejected from this score for toxicity on, and below this certainty of its language.
TOXIC, UNSURE = 0.5, 0.3


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the ids in rejected, which are broadcast if they are few; rows without an id stay."""
    ids = settle(rejected.select("doc_id").filter("doc_id is not null").distinct())
    ids = F.broadcast(ids) if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select("row.*")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or whose language no reading of their bytes makes likely."""
    net = language.learn(docs, id_remainder(F.col("doc_id"), 3) != 1)
    return language.identify(docs, net).filter((F.col("lang_pred") != language.UND) & (F.col("score") >= UNSURE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near-duplicates, one row of each group even where ids repeat or are missing."""
    copies = lambda d: neardup.near_duplicates(d).filter("doc_id != component_id")
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return _without(docs, copies(docs))
    # ids don't tell rows apart: number the rows in their order, once, so that the numbers stay
    folder = shared_folder(spark, "numbered")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).orderBy(F.col("row.doc_id").asc_nulls_last(), F.xxhash64("row.text"))
    rows.select(F.monotonically_increasing_id().alias("doc_id"), "row").write.parquet(folder)
    numbered = spark.read.parquet(folder)
    return _without(numbered, copies(numbered.select("doc_id", F.col("row.text").alias("text")))).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their sources' targets take them."""
    return mixing.materialise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and decoded text of each document, as digests."""
    return digest(bpe.round_trip(docs, path("word_bpe_49k.json")))


STAGES = [("toxicity", toxic), ("language", languages), ("near-duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None  # the first two stages score with fitted models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what its predecessor wrote."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
