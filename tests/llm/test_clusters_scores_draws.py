"""Centroid clustering, language-model scores and resampling against SQL, brute force, plain sums and differences."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import clusters, maxent, queries, resampling
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string"
ODD = [
    (1, "The cat sat on the mat, and the dog sat too.", "en", "a"),
    (1, "The cat sat on the mat, and the dog sat too.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\x0b ", "en", "b"),
    (5, "word " * 30_000, "en", "a"),
    (6, "...!!! 123", "en", None),
    (7, "日本語 テキスト ½ é İ x\x1cy\x00z", "fr", "é"),
    (8, "x" * 100_000 + " the cat " + "y" * 40, "en", "b"),
    (None, "no id the cat", "en", "b"),
    (None, "no id the cat", "en", "b"),
]
CLASHES = ("score", "row", "rank", "word", "n", "learn", "stream", "weight", "cluster", "ends")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in CLASHES})


def same_as_sql(spark, name, sf, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    cols = sorted(df.columns)
    got = df.select(cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()))


# 11


def plain_clusters(rows, k, rounds, dim):
    """(vec_id, vector) by comparing every vector with every centroid."""
    x = np.array([v for _, v in rows], np.int64).reshape(-1, dim)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
        at = d.argmin(1)
        for j in range(len(c)) if r < rounds else ():
            if (at == j).any():
                c[j] = [sum(col) // int((at == j).sum()) for col in x[at == j].T.tolist()]
    return at, d.min(1), c


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_clusters_agree_with_sql(spark, sf):
    same_as_sql(spark, "op11_clusters", sf, ["embeddings"])


@pytest.mark.parametrize("k, rounds, dim, n", [(5, 3, 2, 200), (40, 2, 3, 30), (7, 6, 4, 300)])
def test_clusters_by_brute_force(spark, k, rounds, dim, n):
    """Few distinct whole numbers, so that distances tie; repeated vectors and ids; fewer vectors than clusters."""
    rng = np.random.default_rng(n)
    rows = [(int(i) if i % 11 else None, [float(v) / 256 for v in rng.integers(-4, 5, dim)]) for i in rng.integers(0, n, n)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    found = clusters.cluster(df, k=k, rounds=rounds, dim=dim)
    whole = [(i, [int(v * 256) for v in e]) for i, e in rows]
    at, d, c = plain_clusters(whole, k, rounds, dim)
    assert sorted((r.vec_id or -1, r.cluster, r.distance) for r in found.rows.collect()) == sorted((i or -1, int(a), int(b)) for (i, _), a, b in zip(whole, at, d, strict=True))
    assert (found.centroids == c).all()
    assert {r.cluster: r.inertia for r in found.sums.collect()} == {int(a): int(d[at == a].sum()) for a in set(at.tolist())}


def test_balls_save_comparisons_and_stay_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (30, 8))
    x = np.concatenate([c + rng.integers(-60, 61, (200, 8)) for c in centres])
    balls = clusters.Balls.of(centres)
    start, _ = balls.first(x)
    moved = clusters.Balls.of(centres + rng.integers(-20, 21, centres.shape))
    best, distance, done = moved.again(x, start)
    assert (best == moved.first(x)[0]).all() and (distance == moved.first(x)[1]).all()
    assert done < 3 * len(x)
    still = clusters.Balls.of(centres, moved=False)
    assert still.again(x, start)[2] == len(x)
    # from any clusters at all, not only those of the round before
    wrong = rng.integers(0, 30, len(x))
    assert (moved.again(x, wrong)[0] == moved.first(x)[0]).all()


def test_large_whole_numbers_are_exact():
    rng = np.random.default_rng(4)
    most = clusters.largest(64)
    x, c = rng.integers(-most, most + 1, (20, 64)), rng.integers(-most, most + 1, (6, 64))
    want = [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in c.tolist()] for p in x.tolist()]
    assert clusters.squared(x, c).tolist() == want and 4 * 64 * (2 * most) ** 2 < 2**63


def test_clusters_of_odd_vectors(spark):
    good = [(i, [float(i % 3)] * 64) for i in range(9)]
    bad = [(20, None), (21, []), (22, [1.0] * 63), (23, [1.0] * 63 + [None]), (24, [float("nan")] + [1.0] * 63), (25, [float("inf")] * 64)]
    huge = [(30, [1e38] * 64), (31, [-1e38] * 64)]
    df = spark.createDataFrame(good + bad + huge + [(None, [2.0] * 64)], "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in CLASHES})
    rows = clusters.digest(spark, clusters.cluster(df)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in rows) == sorted([*range(9), 30, 31, -1])
    assert all(r.distance >= 0 and r.inertia >= r.cluster_inertia >= r.distance for r in rows)
    none = clusters.digest(spark, clusters.cluster(df.limit(0)))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# 12


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [b" "]


def check_counts(rows, texts, allowed):
    seen = Counter(w for i, t in texts if i is not None and allowed(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(w in seen for w in tokens(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in texts)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in got], [x[4] for x in want], rtol=1e-9)


def test_language_model_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op12_maxent(spark, "/root/testdata/sf0.01").collect()
    check_counts(rows, [(r.doc_id, r.text) for r in docs.collect()], lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.75


def test_counts_by_brute_force_with_few_known_words(spark, odd, monkeypatch):
    """All but twenty words meet their counts in the join; tasks pass counts on early; texts are cut in small pieces."""
    monkeypatch.setattr(maxent, "KNOWN", 20)
    monkeypatch.setattr(maxent, "OWN", 10)
    monkeypatch.setattr(maxent, "WIDE", 8)
    monkeypatch.setattr(maxent, "SHARED", 54)
    monkeypatch.setattr(maxent, "_ONES", np.ones(8, np.float32))
    monkeypatch.setattr(maxent, "HELD", 50)
    monkeypatch.setattr(maxent, "PIECE", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    # a task's functions take the module's numbers from its worker: plain calls stand in for tasks
    counts = Counter()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for _, t in texts:
        parts = [w for part in maxent.words_of((t or "").encode()) for w in part] + [maxent.END]
        assert parts == tokens(t)
        counts.update(maxent.key_of(w) for w in parts)
    known = maxent.lexicon(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n bigint"))
    assert known.tokens == sum(counts.values()) and known.types == len(counts) and 10 < len(known.known) <= 20
    assert known.slot_tokens.sum() == known.tokens and known.slot_types.sum() == known.types
    placer = maxent.Placer(known)
    n, k, base, own, streams, rare = placer.place([(t or "").encode() for _, t in texts])
    for j, (_, t) in enumerate(texts):
        want = [maxent.key_of(w) for w in tokens(t)]
        assert n[j] == len(want) == len(streams[j]) // 2
        assert k[j] + sum(r["n"] for r in rare[j]) == len(want)
        most = known.tokens + known.types + 1
        assert np.isclose(base[j] + sum(r["n"] * math.log10((counts[r["word"]] + 1) / most) for r in rare[j]), sum(math.log10((counts[w] + 1) / most) for w in want))


@pytest.mark.parametrize("most", [0, 3, 40, 10_000])
def test_frequent_words_are_a_bounded_head(spark, most):
    counts = Counter({f"w{i}".encode(): 4000 // (i + 1) + 1 for i in range(3000)})
    got = maxent.frequent(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n bigint"), most)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert got == want[: len(got)] and len(got) <= most
    assert len(got) == len(want) if most >= len(want) else most == 0 or len(got) >= most / 2


def test_language_model_of_odd_rows(spark, odd):
    model = maxent.learn(odd, F.col("doc_id") != 7)
    rows = maxent.scores(model).collect()
    check_counts(rows, [(r[0], r[1]) for r in ODD], lambda i: i != 7)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    twice = [r for r in rows if r.doc_id == 1]
    assert len(twice) == 2 and twice[0].score == twice[1].score
    none = maxent.scores(maxent.learn(odd.limit(0), F.lit(True)))
    assert none.count() == 0
    untaught = maxent.scores(maxent.learn(odd, F.lit(False))).collect()
    assert len(untaught) == len(ODD) and all(r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in untaught)


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = Counter({f"w{i}".encode(): int(5000 / (i + 1)) + 1 for i in range(3000)})
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    n, v, known = np.zeros(1024, np.int64), np.zeros(1024, np.int64), {}
    for i, (w, k) in enumerate(top):
        at = i if i < maxent.OWN else maxent.OWN + zlib.crc32(w) % maxent.SHARED
        n[at] += k
        v[at] += 1
        known[w] = (i if i < maxent.OWN else maxent.OWN + zlib.crc32(w) % maxent._FINE, k)
    lexicon = maxent.Lexicon(known, sum(counts.values()), len(counts), n, v)
    return maxent.Model(rng.normal(0, 0.3, (1 << maxent.ROW_BITS, maxent.WIDE)).astype(np.float32), lexicon), lexicon, counts


def test_chances_of_all_words_sum_to_one():
    """Over the words of the training texts and an unseen word in each shared slot, whatever came before."""
    model, lexicon, counts = small_model()
    contexts = np.array([c for c, _ in lexicon.known.values()])
    shared = [maxent.OWN + k for k in range(maxent.SHARED)]
    for before in ([], [5], [800, 3]):
        def chance(context, n):
            logs = model.log10(np.array([*before, context]), np.array([len(before) + 1]))[0] - (model.log10(np.array(before), np.array([len(before)]))[0] if before else 0)
            at = maxent.slots(np.array([context]))[0]
            return 10 ** (logs + (0 if at < maxent.OWN else math.log10(n + 1)) - lexicon.share_log()[at])

        some = dict(zip(contexts.tolist(), [0] * len(contexts), strict=True))
        by_slot = {}
        for context in some:
            by_slot.setdefault(int(maxent.slots(np.array([context]))[0]), context)
        slot_chance = {s: chance(c, 0) for s, c in by_slot.items()}
        whole = sum(slot_chance[int(maxent.slots(np.array([c]))[0])] * (1 if maxent.slots(np.array([c]))[0] < maxent.OWN else n + 1) for c, n in lexicon.known.values())
        whole += sum(slot_chance[s] if s in slot_chance else chance(s, 0) for s in shared)
        assert abs(whole - 1) < 1e-3


def test_slopes_by_differences():
    model, _, _ = small_model(1)
    model.weights = model.weights.astype(float)
    contexts, sizes = np.random.default_rng(2).integers(0, 900, 60), np.array([20, 1, 39])
    at, g = model.slopes(*model.events(contexts, sizes))
    loss = lambda: -model.log10(contexts, sizes).sum() * math.log(10)
    assert len(set(at.tolist())) == len(at)
    for row in at[::17]:
        for j in range(0, maxent.WIDE, 5):
            was, ends = model.weights[row, j], []
            for step in (1e-5, -1e-5):
                model.weights[row, j] = was + step
                ends.append(loss())
            model.weights[row, j] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - g[list(at).index(row), j]) < 1e-4


def test_texts_do_not_see_each_other():
    model, _, _ = small_model(3)
    a, b = np.array([4, 9, 800]), np.array([7, 7])
    both = model.log10(np.concatenate([a, b]), np.array([3, 2]))
    assert np.allclose(both, [model.log10(a, np.array([3]))[0], model.log10(b, np.array([2]))[0]])


def test_scores_depend_on_order(spark):
    """What often follows what is likelier than the same words shuffled."""
    rng = np.random.default_rng(5)
    chain = [" ".join(f"a{(s + i) % 20}" for i in range(40)) for s in rng.integers(0, 20, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(chain)] + [(1000, chain[0]), (1001, " ".join(rng.permutation(chain[0].split())))], "doc_id bigint, text string")
    by = {r.doc_id: r for r in maxent.scores(maxent.learn(docs, F.col("doc_id") < 1000)).collect()}
    assert by[1000].score > by[1001].score + 5 and np.isclose(by[1000].base_score, by[1001].base_score)


# 13


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_draw_agrees_with_sql(spark, sf):
    same_as_sql(spark, "op13_resampling", sf, ["documents", "benchmark"])


def plain_draw(texts, target, percent, least, buckets, longest, seed="2024"):
    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    docs = [(i, *features(t)) for i, t in texts]
    s, t = Counter(f for d in docs for f in d[2]), Counter(f for x in target for f in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)}
    rows = []
    for i, n_words, f in docs:
        weight = sum(map(gain.__getitem__, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


@pytest.mark.parametrize("percent, least, buckets, longest", [(50, 3, 100, 1), (100, 1, 7, 1), (30, 2, 60_000, 2), (40, 4, 500, 3)])
def test_draw_by_brute_force(spark, odd, percent, least, buckets, longest):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(5)
    target = spark.read.parquet(f"{SF}/benchmark.parquet").select("text")
    got = resampling.resample(docs, target, percent, least, buckets, longest)
    want = plain_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, least, buckets, longest)
    assert sorted(map(repr, map(tuple, got.collect()))) == want


def test_draw_of_odd_rows(spark, odd):
    rows = resampling.resample(odd, odd.select("text"), percent=100, least_words=0).collect()
    assert len(rows) == len(ODD) and sorted(r["rank"] for r in rows) == list(range(1, len(ODD) + 1))
    none = resampling.resample(odd.limit(0), odd.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(r["rank"] is None for r in resampling.resample(odd, odd.limit(0), percent=0).collect())


def test_words_in_pieces(monkeypatch):
    text = ("ab, cd " * 50 + "é" * 300 + " " + "z" * 70 + "!!").encode()
    want = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    known = resampling.Buckets(1000)
    whole = resampling.stream_of(text, known, 3)
    for piece in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(resampling, "PIECE", piece)
        assert [w for part in resampling.words_of(text) for w in part] == want
        assert sorted(resampling.stream_of(text, known, 3).tolist()) == sorted(whole.tolist())
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(maxent, "PIECE", piece)
        assert [w for part in maxent.words_of(text) for w in part] == text.lower().split()


@pytest.mark.parametrize("most", [0, 1, 7, 400, 10**6])
def test_least_score_drawn(spark, most):
    scores = np.random.default_rng(1).integers(-3000, 4000, 900).tolist()
    df = spark.createDataFrame([(s,) for s in scores], "score bigint")
    got = resampling.least_drawn(df, most)
    assert got == (sorted(scores, reverse=True)[most - 1] if 0 < most <= len(scores) else None)


def test_ranks_where_all_is_equal(spark):
    df = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(7).cast("bigint").alias("score")).repartition(6)
    assert sorted(r["rank"] for r in resampling.ranked(df, 4000).collect() if r["rank"] is not None) == list(range(1, 4001))
