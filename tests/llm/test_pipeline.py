"""The pipeline on a small table, each stage against its operator."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline as C
import numpy as np
from pyspark.sql import functions as F
from test_operators import DOCS, ODD, brute_near, plain_reading

from wayline.llm import bpe, language, mixing, neardup, toxicity
from wayline.llm.common import id_remainder
from wayline.llm.pieces import path, text_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_what_they_reject(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES[:-1]:
        before, out = docs, stage(spark, docs, SF)
        assert out.schema.simpleString() == before.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)
    for name in ("toxicity", "language"):
        before, after = kept[name]
        assert 0.7 * before.count() < after.count() <= before.count()
    before, after = kept["near-duplicates"]
    groups = neardup.near_duplicates(before).groupBy("component_id").agg(F.min("doc_id").alias("least"))
    assert sorted(r.least for r in groups.collect()) == sorted(r.doc_id for r in after.collect())
    before, after = kept["mixing"]
    want = sum(r.taken for r in mixing.mix(before).collect())
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    assert after.agg(F.sum(words)).first()[0] == want
    assert C.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_duplicates_keeps_one_row_of_a_group_where_ids_repeat(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (None, "a"), (4, "e")]
    docs = spark.createDataFrame([(i, text[k], "en", k, 1) for i, k in rows] + [(5, None, "en", "x", 1), (5, "", "en", "y", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = C.near_duplicates(spark, docs, SF)
    assert out.schema.simpleString() == docs.schema.simpleString()
    kept = sorted(((r.doc_id, r.source) for r in out.collect()), key=repr)
    assert kept == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (4, "e"), (5, "x"), (5, "y")], key=repr)


def plain_mix(rows):
    """The texts of (doc_id, text, source) as often as their sources' targets take them."""
    words = lambda t: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t or "")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, rest, budget = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in rest)
        full = {s for s in rest if 2 * size[s] < weight[s] * level}
        if not full:
            break
        target |= {s: 2 * size[s] for s in full}
        rest -= full
    target |= {s: weight[s] * level for s in rest}
    for source in size:
        left = int(target[source])
        some = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, len(words(t)), t) for i, t, s in rows if s == source)
        while left > 0:
            for _, i, n, t in some:
                if min(n, left) > 0:
                    yield i, t if n <= left else "".join(words(t)[:left])
                    left -= min(n, left)


def test_run_by_plain_versions(spark, tmp_path):
    """run() on sixty short documents, each stage again one document after the other; the fitted models are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 600")
    held = docs.orderBy("doc_id").limit(60).collect()
    copies = [(100_000 + r.doc_id, (r.text or "") + " ", r.lang, r.source, r.n_chars) for r in held[::7]]
    spark.createDataFrame([tuple(r) for r in held] + copies, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.filter(F.col("doc_id").isin([r.doc_id for r in held])).write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    got = Counter(map(tuple, C.run(spark, str(tmp_path)).collect()))

    model = toxicity.learn(docs, labels, id_remainder(F.col("doc_id"), 5) != 0)
    of, rows = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True)), []
    for r in docs.collect():
        data = (r.text or "").encode()
        at = set(toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1].tolist())
        if 1 / (1 + np.exp(-model.bias - sum(of.get(i, 0) for i in at))) < C.TOXIC:
            rows.append(r)
    net = language.learn(spark.createDataFrame(rows, docs.schema), id_remainder(F.col("doc_id"), 3) != 1)
    kept = []
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        if any(c.isalpha() for c in r.text or ""):
            parts = [data[a : a + language.WINDOW] for a in range(0, len(data), language.WINDOW)]
            read = np.concatenate([plain_reading(net, np.pad(p, (0, language.WINDOW - len(p)), constant_values=32))[: len(p)] for p in parts])
            if read.mean(0).max() >= C.UNSURE:
                kept.append(r)
    parts = brute_near([(r.doc_id, r.text) for r in kept])
    mixed = plain_mix([(r.doc_id, r.text, r.source) for r in kept if parts[r.doc_id][1] == r.doc_id])
    tok, want = bpe.library(text_of(path("word_bpe_49k.json"))), Counter()
    for i, t in mixed:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want and sum(1 for r in kept if parts[r.doc_id][1] != r.doc_id) >= 5


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(8, 1, 0), (5, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in ("score", "row", "size", "key", "taken", "component_id", "group", "label")})
    for name, table in (("odd", odd), ("none", odd.limit(0))):
        docs, seen = table, {}
        for stage, f in C.STAGES:
            out = f(spark, docs, str(tmp_path))
            if stage != "bpe":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            seen[stage] = Counter(r.doc_id for r in docs.collect())
        if name == "none":
            assert not any(seen.values())
        else:
            assert seen["toxicity"] == Counter(x[0] for x in ODD)
            assert set(seen["language"]) <= {1, 5, 7, 8, None} and seen["language"][1] in (0, 2)
            assert all(n == 1 for n in seen["near-duplicates"].values()) and set(seen["near-duplicates"]) == set(seen["language"])


def test_reruns_agree(spark):
    first, again = (sorted(map(tuple, C.run(spark, SF).collect())) for _ in range(2))
    assert first == again and C.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
