"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def some_rows(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most so many rows, chosen by a hash of the columns in by: the same rows in any run and any partitioning."""
    return rows.orderBy(F.xxhash64(*by), *by).limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (doc_id, ...), a bounded list that is broadcast, with whole texts: one row for each of its rows that documents hold.

    Of several texts of one id the one of least hash counts.
    """
    met = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy(*chosen.columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled rows that learn allows.

    The rows are chosen among the labels, which hold no text, so only that bounded list is broadcast to the documents.
    """
    chosen = some_rows(labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(learn & F.col("label").isin(0, 1)).distinct(), most, "doc_id", "label")
    return texts_of(docs.filter(learn), chosen)
