"""MinHash near-duplicates with SetSketch registers.

A document's set is its distinct shingles of WIDTH words. A register holds the least of one hash function over the set, taken as an
exponential variable and truncated to a step of a scale of base BASE: registers of a union are the larger ones of its parts, and
equal registers are as likely as sets are alike. Bands of registers name buckets; registers of two sets and the sets' sizes
give their likeness by maximum likelihood; what that leaves is verified on the full sets.

Equal sets are one class; equality is told by their size and two 64-bit sums of their elements' hashes. In a first round every class is
compared with one other, the least class that it meets in most bands, which joins large groups of copies at a cost that grows with
their size only; a class and those that it leads so are a group. The second round looks at every bucket whose classes are not all of
one group and compares its classes from different groups block by block: those with a likely partner there meet again with their
full sets, and each leaves with one class that its links reach. Pairs never leave a block, and no link between groups is lost that
the bands can show (with 32 bands of 4, sets with 80 of 100 shingles in common share none in one case of 10**7).

Defined cases: null and empty text, and text without words, has the empty set and links with nothing, even where its id repeats; a
text of fewer than WIDTH words has one shingle, the whole of it; rows that repeat an id are one document with several texts, so all that
any of them links with is one component; null ids link with nothing; an empty table gives an empty result; very long texts are taken
whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.bytetext import joined, mixed, slices, within, word_hashes
from wayline.llm.common import settle, shared_folder, small_batches
from wayline.llm.graph import blocks, components, map_groups, map_runs, matrix, of_one_id, pairs_within, roots

WIDTH, REGISTERS, BAND, BASE = 4, 128, 4, 1.001
#: A word of the contract: anything but blank, tab, LF, VT, FF, CR.
_WORD_BYTE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
_RNG = np.random.default_rng(17)
_FLIP = _RNG.integers(1 << 32, size=REGISTERS, dtype=np.uint32)
_TIMES = _RNG.integers(1 << 31, size=REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Ids that may be broadcast, of 8 bytes each.
MOST_BROADCAST = 1_000_000
#: Weight of a part of a bucket that is compared with other parts at once.
MOST_OF_BLOCK = 256
#: A set of more shingles counts as several members when a bucket is cut into blocks, which bounds a block's bytes.
LONG = 1024


def sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending hashes, side by side, and each text's bounds among them."""
    h, bounds = word_hashes(*joined(column), _WORD_BYTE)
    at = within(bounds, width - 1)
    rolled = np.zeros(len(at), np.uint64)
    for k in range(width):
        rolled = (rolled ^ h[at + k]) * np.uint64(0x9FB21C651E98DF25)
        rolled ^= rolled >> np.uint64(29)
    words = np.diff(bounds)
    upto = np.append(0, np.cumsum(np.maximum(words - width + 1, 0)))
    out = []
    for k, n in enumerate(words.tolist()):
        if n >= width:
            out.append(np.unique(rolled[upto[k] : upto[k + 1]]))
        else:
            value = np.full(min(n, 1), 0x51ED270B, np.uint64)
            for word in h[bounds[k] : bounds[k + 1]]:
                value = mixed(value * np.uint64(0xA24BAED4963EE407) + word)
            out.append(value)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers of each set, (sets, REGISTERS); sets must not be empty."""
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((len(bounds) - 1, REGISTERS), np.uint32)
    value = np.empty_like(short)
    for k in range(REGISTERS):
        np.bitwise_xor(short, _FLIP[k], out=value)
        np.multiply(value, _TIMES[k], out=value)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        least[:, k] = np.minimum.reduceat(value, bounds[:-1])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def likelihood_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeness of pairs of sets that makes their registers' order most likely, given the sets' sizes; on a grid of 1/100."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    return jaccard_of_counts(above, below, a.shape[1] - above - below, n_a, n_b)


def _log_likelihood(j: float, above: np.ndarray, below: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    p = lambda x: np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-9)
    up, down = p(u - (1 - u) * j), p(1 - u - u * j)
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))


def jaccard_of_counts(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    u = n_a / (n_a + n_b)
    v = 1 - u
    best, like = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in np.arange(0, 101) / 100:
        score = np.where(j <= np.minimum(u / v, v / u) + 0.005, _log_likelihood(j, above, below, equal, u), -np.inf)
        like = np.where(score > best, j, like)
        best = np.maximum(best, score)
    return like


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, bounds = sets(batch.column("text"))
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        sums = np.zeros((2, len(sizes)), np.uint64)
        registers: list = [None] * len(sizes)
        if len(full):
            cuts = np.append(bounds[:-1][full], bounds[-1])
            for row, salt in zip(sums, (0x243F6A8885A308D3, 0x13198A2E03707344), strict=True):
                row[full] = np.add.reduceat(mixed(hashes ^ np.uint64(salt)), cuts[:-1])
            for i, row in zip(full, sketch(hashes, cuts), strict=True):
                registers[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums), pa.array(registers, pa.binary())], names=["doc_id", "n", "s1", "s2", "registers"])


def alike_enough(above: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the most likely likeness of each pair is at least `least`: the likelihood has one top, so it must still rise there."""
    below, u = REGISTERS - above - equal, n_a / (n_a + n_b)
    return _log_likelihood(least, above, below, equal, u) >= _log_likelihood(least - 0.01, above, below, equal, u)


def _likely_members(table: pa.Table, starts: np.ndarray, percent: int, least: float) -> pa.Table | None:
    """The members of some blocks that have a likely partner in theirs, of another group, and no earlier band in common with it."""
    rep, group, sizes, part, first, second, band = (table.column(c).to_numpy() for c in ("rep", "group", "n", "part", "first", "second", "band"))
    registers, hit = matrix(table.column("registers"), "<u2"), np.zeros(len(rep), bool)
    for a, b in pairs_within(starts, len(rep)):
        met = (group[a] != group[b]) & (rep[a] != rep[b]) & ((first[a] == second[a]) | (part[a] != part[b]))
        met &= 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
        a, b = a[met], b[met]
        x, y = registers[a], registers[b]
        same = x == y
        ours = same.reshape(len(a), REGISTERS // BAND, BAND).all(2).argmax(1) == band[a]
        a, b, equal, above = a[ours], b[ours], same[ours].sum(1), (x[ours] > y[ours]).sum(1)
        likely = alike_enough(above, equal, sizes[a], sizes[b], least)
        hit[a[likely]] = hit[b[likely]] = True
    return table.select(MEMBER.names).filter(pa.array(hit))


MEMBER = pa.schema([("key", pa.int64()), ("first", pa.int32()), ("second", pa.int32()), ("part", pa.int32()), ("rep", pa.int64())])


def common(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, as a matrix; `width` shared elements at a time."""
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, code, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    rows, code = rows[counts[code] > 1], (np.cumsum(counts > 1) - 1)[code[counts[code] > 1]]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        x, y = np.searchsorted(code, [at, at + width])
        held = np.zeros((len(left) + len(right), width), np.float32)
        held[rows[x:y], code[x:y] - at] = 1
        both += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return both


def _links_of_block(table: pa.Table, percent: int) -> pa.Table | None:
    """(a, b): members of a block, each with one that stands for all that links on full sets reach from it within the block."""
    reps, part = table.column("rep").to_numpy(), table.column("part").to_numpy()
    sets_ = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("set")]
    sizes = np.array([len(x) for x in sets_])
    left, right = np.flatnonzero(part == table.column("first")[0].as_py()), np.flatnonzero(part == table.column("second")[0].as_py())
    both = common([sets_[i] for i in left], [sets_[j] for j in right])
    a, b = np.nonzero(100 * both >= percent * (sizes[left][:, None] + sizes[right] - both))
    root = roots(len(reps), left[a], right[b])
    some = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": reps[root[some]], "b": reps[some]})


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, set) of the documents whose ids are given, made anew from their texts."""
    wanted = settle(ids.distinct())
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, bounds = sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashes[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "set"])

    return settle(docs.join(wanted, "doc_id", "left_semi").mapInArrow(made, "doc_id bigint, set binary"))


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    whole = _full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    # the many members of one leader bring their sets to it: the leader's set is copied in the join, never in a shuffle
    met = pairs.join(whole.toDF("b", "y"), "b").join(whole.toDF("a", "x"), "a")
    return settle(met.select("a", "b", "x", "y").mapInArrow(kept, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, percent: int = 80, least_estimate: float = 0.6) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents."""
    small_batches(docs.sparkSession)
    plain = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    folder = shared_folder(docs.sparkSession, "sketches")
    plain.mapInArrow(_sketched, "doc_id bigint, n bigint, s1 bigint, s2 bigint, registers binary").write.parquet(folder)
    sketched = docs.sparkSession.read.parquet(folder)
    some = sketched.filter("n > 0 and doc_id is not null")
    classes = settle(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers")))

    width = 2 * BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda b: F.xxhash64(b, F.substring("registers", b * width + 1, F.lit(width))))
    members = classes.select("rep", F.explode(keys).alias("key"))
    met = settle(members.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1").select("key", "leader"))
    led = members.join(met, "key").filter("rep != leader").groupBy("rep").agg(F.mode("leader", True).alias("leader"))
    ours, theirs = classes.select("rep", "n", "registers"), classes.select(F.col("rep").alias("leader"), F.col("n").alias("leader_n"), F.col("registers").alias("leader_registers"))
    sized = led.join(ours, "rep").join(theirs, "leader").filter(100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n"))

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                like = likelihood_jaccard(matrix(table.column("registers"), "<u2"), matrix(table.column("leader_registers"), "<u2"), batch.column("n").to_numpy().astype(float), batch.column("leader_n").to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("rep")], names=["a", "b"]).filter(pa.array(like >= least_estimate))

    first = _verified(plain, settle(sized.mapInArrow(likely, "a bigint, b bigint")), percent)
    placed = settle(classes.join(first.select(F.col("b").alias("rep"), F.col("a").alias("group")), "rep", "left").select("rep", "n", "registers", F.coalesce("group", "rep").alias("group")))
    spread = placed.select("rep", "group", F.greatest(F.lit(1.0), F.col("n") / LONG).alias("weight"), F.posexplode(keys).alias("band", "key"))
    of_groups = spread.groupBy("key", "group").agg(F.sum("weight").alias("weight")).groupBy("key").agg(F.sum("weight").alias("size"), F.max(F.struct("weight", "group")).alias("top"), F.count("*").alias("groups"))
    sizes = settle(of_groups.filter("groups > 1").select("key", "size", F.col("top.group").alias("main"), F.col("top.weight").alias("main_size")))
    dealt = blocks(spread.drop("weight"), sizes, "rep", MOST_OF_BLOCK).join(placed.drop("group"), "rep")
    of_blocks = settle(map_runs(dealt, lambda t, starts: _likely_members(t, starts, percent, least_estimate), "key bigint, first int, second int, part int, rep bigint", MEMBER))
    whole = _full_sets(plain, of_blocks.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    second = map_groups(of_blocks.join(whole, "rep"), lambda t: _links_of_block(t, percent), "a bigint, b bigint", links)
    shared = of_one_id(some, "doc_id", ["s1", "s2", "n"], classes)
    parts = components(first.union(second) if shared is None else first.union(second).union(shared))

    of_class = classes.select("s1", "s2", "n", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    whole = some.select("doc_id", "s1", "s2", "n").join(of_class, ["s1", "s2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return whole.union(sketched.filter("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))
