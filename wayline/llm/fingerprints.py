"""Document fingerprints by order MinHash, with DataFrame functions only.

The elements of a text are its k-mers of words, each numbered by how often it occurred before, hashed to 39 bits that stand above
24 bits of its place in the text. For each of TUPLES orders of the hashes (by their exclusive-or with the order's number in the top
bits) the ELL first elements are taken, put back in the order of the text, and hashed together. The share of equal tuples of
two fingerprints estimates a likeness that falls with edit distance, as moved text changes order and repeated text changes numbers.

An order's first elements are the lowest of its own bin of the sorted hashes, or of the bin next to it in exclusive-or if its own
is short, so one sort serves all orders: only the ELL lowest elements of each bin can ever be taken.

Defined cases: null text is empty; an empty text, or one without words, has the fingerprint of no elements, which is like itself
only; a text of fewer than K words is one k-mer; places beyond 2**24 words count as that; repeated ids follow each other in order
of their text, null ids come last; the next of a single row is itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import WORD

K, ELL, TUPLES = 5, 2, 32
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1
_BIN_SHIFT = 63 - (TUPLES.bit_length() - 1)


def _packed(h: Column, place: Column) -> Column:
    """The top 39 of 63 bits of a hash above 24 bits of place."""
    return F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(((1 << 63) - 1) & ~_PLACE)).bitwiseOR(place)


def _hash(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column as an array of TUPLES hashes. Each step stands in a projection of its own, so none is computed twice."""
    words, hashes, kmers, starts, elements, lowest = (f"_{name}_{x}" for x in ("words", "hashes", "kmers", "starts", "elements", "lowest"))
    keep = df.columns
    df = df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias(words))
    df = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias(hashes))
    count = F.size(hashes)
    kmer = lambda i: _packed(F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]), F.least(i, F.lit(_PLACE)).cast("long"))
    none = F.array().cast("array<bigint>")
    df = df.select(*keep, F.sort_array(F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - K, F.lit(0))), kmer)).otherwise(none)).alias(kmers))

    size = F.size(kmers)
    opens = lambda j: (j == 0) | (_hash(F.get(kmers, j)) != _hash(F.get(kmers, j - 1)))
    df = df.select(*keep, kmers, F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), opens)).otherwise(F.array().cast("array<int>")).alias(starts))

    numbered = lambda x, o: F.when(o == 0, x).otherwise(_packed(F.xxhash64(_hash(x), o), x.bitwiseAND(F.lit(_PLACE))))
    run = lambda s, u: F.transform(F.slice(kmers, s + 1, F.coalesce(F.get(starts, u + 1), size) - s), numbered)
    df = df.select(*keep, F.when(F.size(starts) == size, F.col(kmers)).otherwise(F.sort_array(F.flatten(F.transform(starts, run)))).alias(elements))

    bin_ = lambda x: F.shiftright(x, _BIN_SHIFT)
    low = lambda x, i: (i < ELL) | (bin_(x) != bin_(F.get(elements, i - ELL)))
    df = df.select(*keep, F.when(F.size(elements) > ELL, F.filter(elements, low)).otherwise(F.col(elements)).alias(lowest))

    orders = F.sequence(F.lit(0), F.lit(TUPLES - 1))
    turned = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 63 - _PLACE_BITS).bitwiseOR(_hash(x))
    in_text = lambda p: F.transform(F.sort_array(F.transform(p, turned)), lambda y: y.bitwiseAND(F.lit((1 << (63 - _PLACE_BITS)) - 1)))
    hashed = lambda p: F.xxhash64(in_text(p)).bitwiseAND(F.lit(0xFFFFFFFF))
    own = lambda t: F.slice(lowest, t * ELL + 1, F.lit(ELL))
    top = lambda t: F.shiftleft(t.cast("long"), _BIN_SHIFT)
    nearest = lambda t: F.transform(F.slice(F.sort_array(F.transform(lowest, lambda x: x.bitwiseXOR(top(t)))), 1, ELL), lambda x: x.bitwiseXOR(top(t)))
    tuples = F.when(F.size(lowest) == ELL * TUPLES, F.transform(orders, lambda t: hashed(own(t)))).otherwise(F.transform(orders, lambda t: hashed(nearest(t))))
    return df.select(*keep, tuples.alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda n, x: n + x) / TUPLES


def text_form(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _ranges(docs: DataFrame, rows_each: int, coarse_most: int = 1000) -> Column:
    """A number that rises with doc_id and that about rows_each rows share.

    From at most coarse_most quantiles of the ids (the only thing that reaches the driver), with even steps between two of them.
    """
    n = docs.select(F.count("*")).first()[0]
    wanted = max(1, ceil(n / rows_each))
    coarse = min(wanted, coarse_most)
    steps = ceil(wanted / coarse)
    bounds = sorted(set(docs.select(F.percentile_approx("doc_id", [i / coarse for i in range(coarse + 1)], 10 * coarse_most)).first()[0] or [0]))
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.size(F.filter(known, lambda b: b <= F.col("doc_id")))
    if steps == 1:
        return F.coalesce(at, F.lit(-1)).cast("long")
    low, high = F.get(known, at - 1), F.get(known, at)
    step = F.coalesce(F.floor((F.col("doc_id") - low).cast("double") / (high - low) * steps), F.lit(0))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at * steps + F.least(F.greatest(step, F.lit(0)), F.lit(steps - 1))).cast("long")


def with_next(rows: DataFrame, carry: list[str], add: Callable[[DataFrame], DataFrame], rows_each: int = 2000) -> DataFrame:
    """Adds next_<c> for each column c in carry: its value in the next row by descending doc_id, text; after the last comes the first.

    add makes columns of carry that rows doesn't have. Rows meet in ranges of ids (one shuffle); the last row of a range finds the
    first of the next range that has rows by a join of one row per range. Those ranges' numbers are put in order in groups of 1024.
    add runs once for each row, and once more for the first rows of ranges only, which are found before it.
    """
    ranged = rows.withColumn("_range", _ranges(rows, rows_each))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc())
    whole = F.struct(*carry)
    made = add(ranged)
    led = made.withColumn("_next", F.lead(whole).over(order))
    heads = ranged.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")
    heads = add(heads).select(F.col("_range").alias("_of"), whole.alias("_head"))
    ranges = ranged.groupBy("_range").agg(F.lit(1)).select("_range", F.floor(F.col("_range") / 1024).alias("_group"))
    groups = ranges.groupBy("_group").agg(F.max("_range").alias("_top"))
    down = Window.orderBy(F.col("_group").desc())
    groups = groups.select("_group", F.coalesce(F.lead("_top").over(down), F.max("_top").over(Window.partitionBy())).alias("_after"))
    within = Window.partitionBy("_group").orderBy(F.col("_range").desc())
    follows = ranges.withColumn("_follows", F.lead("_range").over(within)).join(groups, "_group").select("_range", F.coalesce("_follows", "_after").alias("_of"))
    tails = follows.join(heads, "_of").select("_range", "_head")
    met = led.join(tails, "_range").withColumn("_next", F.when(F.col("_next").isNull(), F.col("_head")).otherwise(F.col("_next")))
    return met.select(*[c for c in made.columns if c != "_range"], *[F.col("_next")[c].alias(f"next_{c}") for c in carry])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its text with the last third replaced by the start of the next document, both fingerprints, and the next one's."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = with_next(plain, ["text", "print"], lambda rows: with_fingerprint(rows, "text", "print"))
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    edited = met.withColumn("edited", F.concat(F.left("text", size - third), F.left("next_text", third))).drop("next_text")
    return with_fingerprint(edited, "edited", "edited_print")
