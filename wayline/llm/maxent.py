"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are a text's words and one end. The OWN most frequent words have a slot of their own, all others share one of SHARED slots by their
crc32. A token's probability is that of its slot's class, times that of the slot in its class, times the word's smoothed share of its slot's
tokens, where a slot's unseen words are one more word: it sums to 1 over the words of the training texts and an unseen one in each shared slot.

Class and slot are softmaxes over WIDE outputs. Their logits are the log frequency of the output and rows of weights, which a hash of a
feature (and, for slots, of the class) finds among 2**ROW_BITS: the word before and the word but one before, a skip, for classes; the word before and
the two words before for slots.

What is gathered grows with the corpus: tokens are counted over all training texts, and the weights are fitted on all of them. Tasks take adaptive
gradient steps on their texts from the shared weights; how far they moved a row, weighed by how often they touched it, is summed by rows
in a shuffle, and the driver adds the means, 2**ROW_BITS rows at any size of the corpus. Texts are cut into words once for that and for scoring:
their slots are written as packed 16-bit streams.

Counts of the up to KNOWN most frequent words are sent to the tasks: a bounded list of words of at most 33 bytes, as longer ones go by their
SHA-256. All other words meet their counts in a join, once for each document that holds them; none of these makes up more than one in KNOWN tokens, so
no key is hot.

Defined cases: null and empty texts are one end; very long texts are read whole; rows without id are scored and not learned from; rows that
repeat an id are scored each for itself; without training texts N and V are 0 and every slot is as likely as any; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.bytetext import mixed, slices
from wayline.llm.common import shared_folder, small_batches

#: Slots of words of their own and shared ones; outputs of a softmax, so that WIDE classes of WIDE slots are all slots.
OWN, SHARED, WIDE = 768, 256, 32
#: At most so many words have their counts sent to the tasks; distinct words that a task counts before it passes them on, and bytes of a text that are cut at once.
KNOWN, HELD, PIECE = 50_000, 1 << 18, 1 << 22
#: Rows of weights, and rows that are summed together.
ROW_BITS, BLOCK = 16, 256
#: Tokens of a gradient step, and of a scoring batch: their rows stay in a core's own cache.
STEP = 2048
#: Rounds of training, its pace, and what a row's history begins with.
ROUNDS, PACE, BEGIN = 1, 0.4, 1.0
#: Contexts finer than slots: OWN + SHARED and more are crc32 remainders. None before a text's first token.
_FINE, _NONE = 64_000, 65_535
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_OUT = np.uint64(0xD6E8FEB86659FD93)
_ONES = np.ones(WIDE, np.float32)
#: The end of a text. No word holds a blank.
END = b" "


def key_of(word: bytes) -> bytes:
    """A word, or a digest that is no word in place of a long one."""
    return word if len(word) <= 32 else hashlib.sha256(word).digest() + b" "


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, those of about PIECE bytes at a time."""
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        words = text[at:to].lower().split()
        # a word may go on beyond the piece
        while to < len(text) and len(words) < 2 and not text[to - 1 : to].isspace():
            to = min(len(text), 2 * to - at)
            words = text[at:to].lower().split()
        if to < len(text) and words and not text[to - 1 : to].isspace():
            to -= len(words.pop())
        yield words
        at = to


def gathered(texts: list[bytes], most: int = 1 << 17) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """The tokens of the texts, about so many at a time: which text each run of them is from, the runs' lengths, and the tokens."""
    owners, sizes, words = [], [], []
    for i, text in enumerate(texts):
        for part in chain(words_of(text), [[END]]):
            owners.append(i)
            sizes.append(len(part))
            words += part
            if len(words) >= most:
                yield owners, sizes, words
                owners, sizes, words = [], [], []
    if words:
        yield owners, sizes, words


def counted(docs: DataFrame, folder: str) -> DataFrame:
    """(word, n): how often each token comes in all texts. Tasks sum before the shuffle."""
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in seen], pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            seen[END] += batch.num_rows
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                for words in words_of(text or b""):
                    seen.update(words)
                if len(seen) >= HELD:
                    yield out()
                    seen.clear()
        yield out()

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n bigint")
    parts.groupBy("word").agg(F.sum("n").alias("n")).write.parquet(folder)
    return docs.sparkSession.read.schema("word binary, n bigint").parquet(folder)


@dataclass(frozen=True)
class Lexicon:
    """What tasks know of words: known maps KNOWN keys to their context and count; tokens and words of all training texts; and of each slot."""

    known: dict[bytes, tuple[int, int]]
    tokens: int
    types: int
    slot_tokens: np.ndarray
    slot_types: np.ndarray

    @property
    def place(self) -> np.ndarray:
        """A slot's class and its output there, as WIDE * class + output: slots by falling frequency."""
        order = np.argsort(-self.slot_tokens, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place

    def share_log(self) -> np.ndarray:
        """log10 of the tokens of each slot, to be taken from the log10 of a word's count: 0 for words of their own."""
        return np.where(np.arange(OWN + SHARED) < OWN, 0.0, np.log10(self.slot_tokens + self.slot_types + 1.0))

    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies of classes and, class by class, of the slots within: slots that no word can have are all but impossible."""
        n = self.slot_tokens.astype(float)
        n[OWN:] += 0.5
        p = np.empty(len(n))
        p[self.place] = np.maximum(n, 1e-9)
        p = p.reshape(WIDE, WIDE)
        return np.log(p.sum(1) / p.sum()).astype(np.float32), np.log(p / p.sum(1, keepdims=True)).astype(np.float32)


def slots(contexts: np.ndarray) -> np.ndarray:
    return np.where(contexts < OWN, contexts, OWN + (contexts - OWN) % SHARED)


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, as many as there are at most `most` of down to some frequency; by falling count.

    How many words there are of each frequency, in 64 steps an octave, tells where to cut, so no task and no driver holds more words than that.
    """
    step = F.floor(F.log2("n") * 64)
    cut, upto = None, 0
    for r in sorted(counts.groupBy(step.alias("at")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.at):
        upto += r.words
        if upto > most:
            break
        cut = r.at
    if cut is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in counts.filter(step >= cut).collect()), key=lambda x: (-x[1], x[0]))


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals and the most frequent words: the driver gets up to KNOWN words, SHARED rows of totals and two numbers."""
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, KNOWN)
    shared = F.pmod(F.crc32("word"), F.lit(SHARED))
    n, v = np.zeros(OWN + SHARED, np.int64), np.zeros(OWN + SHARED, np.int64)
    for r in counts.groupBy(shared.alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[OWN + r.at], v[OWN + r.at] = r.n, r.v
    known = {}
    for i, (word, many) in enumerate(top):
        crc = zlib.crc32(word)
        if i < OWN:
            n[i], v[i] = many, 1
            n[OWN + crc % SHARED] -= many
            v[OWN + crc % SHARED] -= 1
        known[word] = (i if i < OWN else OWN + crc % _FINE, many)
    return Lexicon(known, tokens, types, n, v)


PLACED = "row bigint, doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, base_log double, own_log double, stream binary, rare array<struct<word: binary, n: bigint>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


class Placer:
    """Texts to contexts, with what their known words add to the scores and the words that have to meet their counts."""

    def __init__(self, lexicon: Lexicon):
        self.number = {w: i for i, w in enumerate(lexicon.known)}
        self.contexts, counts = np.array(list(lexicon.known.values()), np.int64).reshape(-1, 2).T
        # of ratios below 1, whose sum keeps its digits where sums of the parts would lose them
        self.log = np.log10((counts + 1.0) / (lexicon.tokens + lexicon.types + 1.0))
        self.shared_log = np.where(self.contexts < OWN, 0.0, np.log10(counts + 1.0))
        self.share = lexicon.share_log()

    def place(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[list[dict]]]:
        """Per text: tokens, known tokens, their base score, sum of log10(count + 1) of words that share a slot less the slots' logs, contexts, other words."""
        n = len(texts)
        sums, streams, rare = np.zeros((4, n)), [[] for _ in texts], [Counter() for _ in texts]
        for owners, sizes, words in gathered(texts):
            number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
            there, owner = number >= 0, np.repeat(owners, sizes)
            contexts = np.where(there, self.contexts[number], 0) if len(self.contexts) else np.zeros(len(words), np.int64)
            other = np.flatnonzero(~there).tolist()
            if other:
                keys = [key_of(words[i]) for i in other]
                contexts[other] = [OWN + zlib.crc32(k) % _FINE for k in keys]
                for i, k in zip(owner[other].tolist(), keys, strict=True):
                    rare[i][k] += 1
            met, of = number[there], owner[there]
            sums[0] += np.bincount(owner, minlength=n)
            sums[1] += np.bincount(of, minlength=n)
            sums[2] += np.bincount(of, self.log[met], n)
            sums[3] += np.bincount(of, self.shared_log[met], n) - np.bincount(owner, self.share[slots(contexts)], n)
            packed = contexts.astype("<u2")
            for i, part in zip(owners, np.split(packed, np.cumsum(sizes)[:-1]), strict=True):
                streams[i].append(part.tobytes())
        return sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3], [b"".join(x) for x in streams], [[{"word": w, "n": k} for w, k in x.items()] for x in rare]


def placed(docs: DataFrame, allowed: Column, lexicon: Lexicon, folder: str) -> DataFrame:
    """Writes each text's contexts and what its known words give, under a row number of its own, and reads them."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(lexicon)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = Placer(sent.value)
        for batch in slices(batches):
            made = placer.place([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), _RARE)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("learn"), *(pa.array(m, kind) for m, kind in zip(made, kinds, strict=True))], names=[c.split()[0] for c in PLACED.split(", ")[:9]])

    learn = F.coalesce(allowed, F.lit(False))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), learn.alias("learn"), F.col("text").cast("string").alias("text"))
    given.mapInArrow(place, PLACED).write.parquet(folder)
    return spark.read.schema(PLACED).parquet(folder)


class Model:
    """The class-factored softmax: rows of weights and the log frequencies they add to."""

    def __init__(self, weights: np.ndarray, lexicon: Lexicon):
        self.weights, self.place = weights, lexicon.place
        self.classes, self.within = lexicon.prior()

    def events(self, contexts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, output, rows for the class, rows for the output) of every token of texts of so many tokens; rows are (features, tokens)."""
        at = self.place[slots(contexts)]
        cls, out = at // WIDE, at % WIDE
        place = np.arange(len(contexts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one, two = np.full((2, len(contexts)), _NONE, np.uint64)
        one[1:], two[2:] = contexts[:-1], contexts[:-2]
        one[place < 1], two[place < 2] = _NONE, _NONE
        last, both, skip = one * _KINDS[0], (one << np.uint64(16) | two) * _KINDS[1] + np.uint64(1), two * _KINDS[2] + np.uint64(2)
        of, shift = (cls.astype(np.uint64) + np.uint64(1)) * _OUT, np.uint64(64 - ROW_BITS)
        of_class, of_slot = (np.stack([mixed(x) >> shift for x in rows]).astype(np.int64) for rows in ((last, skip), (last + of, both + of)))
        return cls, out, of_class, of_slot

    def chances(self, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
        z = self.weights[rows[0]]
        z += self.weights[rows[1]]
        z += prior
        np.minimum(z, 60, out=z)  # of floats, whose exponentials end at 88
        np.exp(z, out=z)
        z /= (z @ _ONES)[:, None]
        return z

    def log10(self, contexts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text's slots."""
        logs = np.zeros(len(contexts))
        begins = np.cumsum(sizes) - sizes
        cls, out, of_class, of_slot = self.events(contexts, sizes)
        for a in range(0, len(contexts), STEP):
            s = slice(a, a + STEP)
            n = np.arange(len(cls[s]))
            p = self.chances(self.classes, of_class[:, s])[n, cls[s]] * self.chances(self.within[cls[s]], of_slot[:, s])[n, out[s]].astype(float)
            logs[s] = np.log10(np.maximum(p, 1e-30))
        return np.add.reduceat(logs, begins)

    def slopes(self, cls, out, of_class, of_slot) -> tuple[np.ndarray, np.ndarray]:
        """The rows that tokens touch and the loss's slopes in them, summed over the tokens."""
        n = np.arange(len(cls))
        d = self.chances(self.classes, of_class), self.chances(self.within[cls], of_slot)
        d[0][n, cls] -= 1
        d[1][n, out] -= 1
        rows = np.concatenate([of_class.ravel(), of_slot.ravel()])
        # each token's slopes go to the two rows of its class and the two of its slot; a sort of row and place in one number is the fastest
        key = rows << 20 | np.concatenate([n, n, n + len(n), n + len(n)])
        key.sort()
        rows, token = key >> 20, key & ((1 << 20) - 1)
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        many = np.diff(np.append(begins, len(rows)))
        d = np.concatenate(d)
        out, several = d[token[begins]], many > 1
        if several.any():
            out[several] = np.add.reduceat(d[token[np.repeat(several, many)]], np.cumsum(many[several]) - many[several], axis=0)
        return rows[begins], out


def streams_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A batch's contexts side by side, and how many each text has."""
    data = batch.column("stream").to_pylist()
    return np.frombuffer(b"".join(data), "<u2").astype(np.int64), np.array([len(d) // 2 for d in data])


MOVED = "block int, touched binary, moved binary"


def fit(rows: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Weights fitted on the contexts of all rows."""
    sc = rows.sparkSession.sparkContext
    weights = np.zeros((1 << ROW_BITS, WIDE), np.float32)
    words = sc.broadcast(Lexicon({}, lexicon.tokens, lexicon.types, lexicon.slot_tokens, lexicon.slot_types))

    def trained(sent):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = sent.value
            model = Model(before.copy(), words.value)
            history, touched = np.full(len(before), BEGIN, np.float32), np.zeros(len(before), np.float32)
            for batch in batches:
                contexts, sizes = streams_of(batch)
                cls, out, of_class, of_slot = model.events(contexts, sizes)
                for a in range(0, len(contexts), STEP):
                    s = slice(a, a + STEP)
                    at, g = model.slopes(cls[s], out[s], of_class[:, s], of_slot[:, s])
                    history[at] += np.einsum("ij,ij->i", g, g)
                    model.weights[at] -= g * (PACE / np.sqrt(history[at]))[:, None]
                    touched[at] += 1
            moved = (model.weights - before) * touched[:, None]
            for b in range(len(before) // BLOCK):
                here = touched[b * BLOCK : (b + 1) * BLOCK]
                if here.any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([here.astype("<f4").tobytes()], pa.binary()), pa.array([moved[b * BLOCK : (b + 1) * BLOCK].astype("<f4").tobytes()], pa.binary())], names=["block", "touched", "moved"])

        return work

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, t, m in zip(*(batch.column(c).to_pylist() for c in ("block", "touched", "moved")), strict=True):
                sums = total.setdefault(b, [np.zeros(BLOCK), np.zeros(BLOCK * WIDE)])
                sums[0] += np.frombuffer(t, "<f4")
                sums[1] += np.frombuffer(m, "<f4")
        names = ["block", "touched", "moved"]
        for b, (t, m) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([t.astype("<f4").tobytes()], pa.binary()), pa.array([m.astype("<f4").tobytes()], pa.binary())], names=names)

    for _ in range(rounds):
        sent = sc.broadcast(weights)
        parts = rows.filter("learn").select("stream").mapInArrow(trained(sent), MOVED)
        weights = weights.copy()
        for r in parts.repartition("block").mapInArrow(summed, MOVED).collect():
            t, m = np.frombuffer(bytes(r.touched), "<f4"), np.frombuffer(bytes(r.moved), "<f4").reshape(BLOCK, WIDE)
            weights[r.block * BLOCK : (r.block + 1) * BLOCK] += m / np.maximum(t, 1)[:, None]
    return weights


@dataclass(frozen=True)
class Fitted:
    """A model with the words it was made from. counts: (word, n) of all training texts, a table in the shared folder."""

    counts: DataFrame
    lexicon: Lexicon
    weights: np.ndarray
    placed: DataFrame


def learn(docs: DataFrame, allowed: Column, rounds: int = ROUNDS) -> Fitted:
    """Counts the words of the documents that `allowed` admits and fits the weights on them; all documents are placed, so that they can be scored."""
    spark = docs.sparkSession
    counts = counted(docs.filter(allowed), shared_folder(spark, "words"))
    known = lexicon(counts)
    rows = placed(docs, allowed, known, shared_folder(spark, "contexts"))
    return Fitted(counts, known, fit(rows, known, rounds), rows)


def scores(model: Fitted) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of every document that was placed."""
    spark = model.placed.sparkSession
    known = model.lexicon
    few = Lexicon({}, known.tokens, known.types, known.slot_tokens, known.slot_types)
    sent = spark.sparkContext.broadcast((model.weights, few))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = Model(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lm.log10(*streams_of(part)))], names=[*part.schema.names[:-1], "slots_log"])

    given = model.placed.select("row", "doc_id", "learn", "n_tokens", "n_known", "base_log", "own_log", "stream")
    of_slots = given.mapInArrow(scored, given.drop("stream").schema.add("slots_log", "double"))
    rare = model.placed.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("many"))
    # the words that were sent to the tasks meet nothing here: their documents have no rows for them
    met = rare.join(model.counts, "word")
    most = float(known.tokens + known.types + 1)
    base, within = F.log10((F.col("n") + 1) / most), F.log10(F.col("n") + 1)
    late = met.groupBy("row").agg(F.sum("many").alias("late"), F.sum(F.col("many") * base).alias("late_base"), F.sum(F.col("many") * within).alias("late_log"))
    whole = of_slots.join(late, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("late", "late_base", "late_log")}).withColumn("n_known", F.col("n_known") + F.col("late"))
    unseen = (F.col("n_tokens") - F.col("n_known")) * float(np.log10(1 / most))
    return whole.select(
        "doc_id", "learn", "n_tokens", "n_known", F.lit(known.tokens).cast("bigint").alias("train_tokens"), (F.col("base_log") + F.col("late_base") + unseen).alias("base_score"),
        (F.col("slots_log") + F.col("own_log") + F.col("late_log")).alias("score"),
    )
