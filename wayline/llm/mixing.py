"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a random key, the MD5 of its id. The first hex digits of the key name a bucket, so that a source of any
size is range-sorted by key over thousands of buckets of like size; sums per bucket, then running sums over the buckets and
within each bucket, give each document the number of words that stand before it in its source. A document is taken as many
times as whole epochs fit its source's budget, and once more, whole or in part, if it stands before the cut of the last epoch.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; rows that repeat
an id follow each other and are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import WORD, settle, word_count

WEIGHTS = (3, 1, 2)


def source_targets(source_sizes: DataFrame, weights=WEIGHTS, ratio: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """Adds target (double) to one row per source: (source_key, source_size).

    The budget, ratio times all words, is dealt by weight; a source stops at most_epochs times its size and what it leaves goes
    to the others by weight. Ordered by capacity over weight, the sources that stop come first, so the level of the others
    follows from running sums: no iteration. The input has a row per source, so its global order is as small as their number.
    """
    by_name = Window.orderBy(F.col("source_key") == "", "source_key")
    ranked = source_sizes.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    ).withColumn("capacity", F.col("source_size") * most_epochs)
    by_need = Window.orderBy(F.col("capacity") / F.col("weight"), "place")
    before, after, whole = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(ratio)) - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("own_level", level)
    stops = F.col("capacity") < F.col("weight") * F.col("own_level")
    final = F.min(F.when(~stops, F.struct(F.col("capacity") / F.col("weight"), "place", "own_level"))).over(whole)["own_level"]
    return levelled.withColumn("target", F.least(F.col("capacity").cast("double"), F.col("weight") * final)).select("source_key", "source_size", "target")


def mix(docs: DataFrame, whole: bool = False, weights=WEIGHTS, ratio: float = 1.5, most_epochs: int = 2, seed: str = "mix", bucket_digits: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, and as row, if whole rows are asked for, all its columns.

    Two shuffles by (source, bucket), neither of which a large source can make uneven: one of sums per bucket, and one of the
    rows themselves, which hold no text unless whole rows are asked for.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    sized = docs.select(
        "doc_id", *row, word_count(F.col("text")).alias("_size"), key.alias("_key"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key")
    ).withColumn("_bucket", F.substring("_key", 1, bucket_digits))
    if not whole:
        sized = settle(sized)

    sums = sized.groupBy("source_key", "_bucket").agg(F.sum("_size").alias("_in_bucket"))
    targets = source_targets(sums.groupBy("source_key").agg(F.sum("_in_bucket").alias("source_size")), weights, ratio, most_epochs)
    in_source = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    buckets = sums.withColumn("_before_bucket", F.coalesce(F.sum("_in_bucket").over(in_source), F.lit(0))).join(targets, "source_key")
    buckets = buckets.select(
        "source_key", "_bucket", "_before_bucket", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("_epochs"),
    ).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))

    in_bucket = Window.partitionBy("source_key", "_bucket").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(in_bucket), F.lit(0))).join(buckets, ["source_key", "_bucket"])
    part = F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before_bucket") - F.col("_before")))
    taken = F.col("_size") * F.col("_epochs") + part
    return placed.select("doc_id", *["row"] * whole, F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def materialise(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus with the columns of documents: a row per time that a document is taken, the last cut after its share of words.

    A document of which nothing is taken has no row. Only the one document that holds a source's cut loses words.
    """
    mixed = mix(docs, whole=True, **how).filter("taken > 0")
    times = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("_copy") * F.col("size")).cast("int")
    text = F.col("row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), words), "")
    shown = times.withColumn("_text", F.when(words < F.col("size"), cut).otherwise(text))
    made = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    return shown.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns])
