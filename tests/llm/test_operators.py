"""The operators against brute force, exact round trips and held-out rows, on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayline.llm import bpe, fingerprints, idfiles, language, licenses, mixing, neardup, queries, quality, toxicity, vectors
from wayline.llm.bytetext import word_hashes
from wayline.llm.pieces import path, text_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "plain words stand here and there", "en", "a", 1),
    (1, "plain words stand here and there", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", "b", 4),
    (5, "word " * 30_000, "en", "a", 150_000),
    (6, "...!!! 123", "en", None, 10),
    (7, "日本語 テキスト ½ é İ <|endoftext|> x\x1cy", "fr", "é", 30),
    (8, "under the MIT license; Apache License, Version 2.0 and CC-BY-NC", "en", "b", 60),
    (None, "no id", "en", "b", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use inside."""
    extra = ("score", "row", "size", "key", "taken", "source_key", "registers", "label")
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in extra})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    df = queries.op1_mixing(spark, f"/root/testdata/{sf}")
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE['op1_mixing']})").fetchall())


def test_mixing_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.target for r in rows if r.doc_id == 5) <= 2 * 30_000 + 100
    assert mixing.mix(none).count() == 0


def test_mixed_corpus_has_the_words_taken(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for d in (docs, odd):
        want = sum(r.taken for r in mixing.mix(d).collect())
        made = mixing.materialise(d)
        assert made.columns == d.columns
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in made.collect()) == want


# 2


def test_license_places_by_brute_force(spark, odd, none):
    texts = [x[1] for x in ODD]
    got = licenses.scan(odd).collect()
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), texts, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert r.n_words == len(words)
        want = [(label, i) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert sorted((b.label, b.first_word) for b in r.base) == sorted(want)
    assert licenses.scan(none).count() == 0


def test_license_suppression():
    rules = licenses.rules()
    assert len(rules) > 300
    gates = frozenset().union(*(r.gates for r in rules))
    _, _, finds = licenses.find_all(b"released under the GNU General Public License version 3 or any later version", rules, gates)
    assert {f["label"] for f in finds} == {"gpl-3"}
    _, base, finds = licenses.find_all(b"cc-by-nc-sa 4.0", rules, gates)
    assert [b["label"] for b in base] == ["cc-by-nc"] and {f["label"] for f in finds} == {"cc-by-nc", "cc-by-nc-sa"}
    for first, inner in ((0, 5), (2, 2)):
        kept = licenses.resolve([], [(1, -9, 0, 0, 8), (2, -3, first, 1, first + inner)], rules)
        assert len(kept) == 1


def sentences(parsed):
    """A sentence for every choice of alternatives and options of a rule, repeats at their least and most (but 2 of an open end)."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "IN":
            parts = ["x"] if arg[0][0].name == "CATEGORY" else [chr(c) for o, a in arg for c in (range(a[0], a[1] + 1) if o.name == "RANGE" else [a])][:3]
        elif name == "BRANCH":
            parts = [x for branch in arg[1] for x in sentences(branch)]
        elif name == "SUBPATTERN":
            parts = sentences(arg[-1])
        elif name == "MAX_REPEAT":
            parts = [x * n for n in sorted({arg[0], min(arg[1], 2)}) for x in sentences(arg[2])]
        else:
            assert name in ("ASSERT", "ASSERT_NOT")
            parts = [""]
        out = [a + b for a in out for b in dict.fromkeys(parts)]
    return out


def test_license_gates_refuse_no_match():
    rules = licenses.rules()
    for rule in rules:
        for x in sentences(re._parser.parse(rule.pattern.pattern.decode())) if rule.priority in (3, 4, 5) else ():
            for m in rule.pattern.finditer(f" {x} ".encode()):
                assert rule.gates.intersection(m[0].split()), (rule.label, m[0])


def test_license_finds_are_the_same_without_gates():
    rules = licenses.rules()
    gates = frozenset().union(*(r.gates for r in rules))
    open_rules = licenses.rules()
    for r in open_rules:
        r.gates = frozenset({b"zz"})
    for rule in rules:
        if rule.priority == 4:
            for x in sentences(re._parser.parse(rule.pattern.pattern.decode())):
                _, _, found = licenses.find_all(x.encode(), rules, gates)
                _, _, want = licenses.find_all(f"{x} zz".encode(), open_rules, frozenset({b"zz"}))
                assert found == want, x


def brute_scan(text, rules):
    """Every rule on every text, every find against every kept one, words counted one by one."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    line = " " + " ".join(words) + " "
    base = [(i, i + len(p.split()) - 1, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    finds = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern.pattern.decode(), line):
            first = len(line[: m.start()].split())
            finds.append((rule.priority, -len(m[0]), first, k, first + len(m[0].split()) - 1))
    kept = [(first, last) for first, last, _ in base]
    out = []
    for _, _, first, k, last in sorted(finds):
        if not any(a <= first and last <= b for a, b in kept):
            kept.append((first, last))
            out.append((first, last, rules[k].label))
    return sorted(base), sorted(out)


def test_no_license_rule_repeats_without_end_before_its_first_fixed_word():
    """Each place that such a repeat may begin at would read it to its end: time would grow with the square of a text."""
    from re import _parser

    def opens(parsed):
        for op, arg in parsed:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                if str(high) == "MAXREPEAT" and any(str(o) in ("SUBPATTERN", "BRANCH", "LITERAL") for o, _ in inner):
                    return True
                if low and not opens(inner):
                    return False
            elif name == "SUBPATTERN":
                if opens(arg[-1]):
                    return True
                return False
            elif name == "BRANCH":
                return any(opens(branch) for branch in arg[1])
            elif name in ("LITERAL", "IN"):
                return False
        return False

    assert opens(_parser.parse("(?:a )?(?:limited |personal )*non")) and not opens(_parser.parse("only (?:a |b )*c"))
    assert not [r.label for r in licenses.rules() if opens(_parser.parse(r.pattern.pattern.decode().removeprefix("(?<= )")))]


@pytest.mark.parametrize("words", ["transferable limited", "transferable non exclusive and", "only for academic research", "license licensed under the terms", "copyright c 2020 all rights reserved", "may not be used", "spdx license identifier mit or later only", "permission"])
def test_license_time_grows_with_the_text(words):
    import time

    rules = licenses.rules()
    gates = frozenset().union(*(r.gates for r in rules))
    taken = []
    for n in (20_000, 80_000):
        text = (words.split()[0] + " " + (words.split(" ", 1)[-1] + " ") * n).encode()
        began = time.time()
        licenses.find_all(text, rules, gates)
        taken.append(time.time() - began)
    assert taken[1] < 10 * taken[0] + 1


def test_license_scan_by_brute_force():
    rules = licenses.rules()
    gates = frozenset().union(*(r.gates for r in rules))
    rng = np.random.default_rng(12)
    pool = [x for r in rules for x in sentences(re._parser.parse(r.pattern.pattern.decode()))[:3]] + list(licenses.BASE) * 40
    for n in rng.integers(0, 14, 60):
        text = " ".join(" ".join(rng.choice(["the", "license", "Under", "MIT", "apache,", "of"], rng.integers(0, 4))) + " " + str(x) + "." for x in rng.choice(pool, n))
        n_words, base, finds = licenses.find_all(text.encode(), rules, gates)
        want_base, want = brute_scan(text, rules)
        assert sorted((b["first_word"], b["last_word"], b["label"]) for b in base) == want_base
        assert sorted((f["first_word"], f["last_word"], f["label"]) for f in finds if f["rule"] >= 0) == want


# 3


def labelled(spark, kind):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 40))
        bad = i % 4 == 0
        if kind == "toxic":
            text[7:7] = ["vile", "rotten"] if bad else []
        elif bad:
            text = ["BUY!!", "###"] * 20
        docs.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 0 if bad else 1, int(bad)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, none):
    docs, labels = labelled(spark, "toxic")
    model = toxicity.learn(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert 0 < len(model.at) < 2000
    wrong = [r.doc_id for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and (r.score >= 0.5) != (r.doc_id % 4 == 0)]
    assert wrong == []
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores) and scores[0].row.source_key == 1
    assert toxicity.score(none, model).count() == 0
    assert len(toxicity.learn(docs, labels.limit(0), F.lit(True)).at) == 0


def plain_features(text):
    """A text's words, neighbours and pairs with one word between, as strings."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:])), *(f"{a} ? {b}" for a, b in zip(w, w[2:]))]


def test_toxicity_features_are_plain_ones():
    rng = np.random.default_rng(2)
    pool = ["Aa", "aa", "bé", "c1", "d" * 70, "日本", "e"]
    texts = [rng.choice([" ", ", ", "-"]).join(rng.choice(pool, n)) for n in (0, 1, 2, 3, 9, 40)] + ["", "...", "x" * 200]
    data = "".join(texts).encode()
    text, at = toxicity.features(np.frombuffer(data, np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts])))
    place = {}
    for k, t in enumerate(texts):
        want, got = Counter(plain_features(t)), Counter(at[text == k].tolist())
        assert sorted(want.values()) == sorted(got.values())
        for f in want:
            (alone,) = {int(x) for x in toxicity.features(np.frombuffer(f.encode(), np.uint8), np.array([0, len(f.encode())]))[1]} if " " not in f else (None,)
            assert alone is None or place.setdefault(f, alone) == alone and got[alone] == want[f]
    assert len(set(place.values())) == len(place) > 5


def test_toxicity_fit_is_plain_ftrl():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(40, size=8)) for _ in range(120)]
    labels = np.array([float(3 in r or 5 in r) for r in rows])
    got = toxicity.fit(rows, labels, epochs=3, alpha=0.5, beta=1.0, l1=0.6, l2=0.3)
    size, z, n = 1 << toxicity.BITS, Counter(), Counter()

    def weight(i):
        lasso = 0.0 if i == size else 0.6
        return 0.0 if abs(z[i]) <= lasso else -(z[i] - np.copysign(lasso, z[i])) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.3)

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(len(rows)):
            at = [*rows[r].tolist(), size]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[r]
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert dict(zip(got.at.tolist(), got.weight.tolist(), strict=True)) == pytest.approx(want) and got.bias == pytest.approx(weight(size)) and len(want) < 40


def test_scores_are_the_weights_of_distinct_features(spark):
    docs = spark.createDataFrame([(1, "Bad bad word"), (2, "word"), (3, None), (4, "good " * 3000)], "doc_id bigint, text string")
    of = {f: int(toxicity.features(np.frombuffer(f.encode(), np.uint8), np.array([0, len(f)]))[1][0]) for f in ("bad", "word", "good")}
    at = np.sort(list(of.values()))
    model = toxicity.Weights(at, np.array([{of["bad"]: 2.0, of["word"]: -0.5, of["good"]: -3.0}[i] for i in at.tolist()]), -1.0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got == pytest.approx({i: 1 / (1 + np.exp(-z)) for i, z in ((1, 0.5), (2, -1.5), (3, -1.0), (4, -4.0))})


# 4


def test_bpe_equals_the_library(odd, none):
    file = path("word_bpe_49k.json")
    tok = bpe.library(text_of(file))
    got = bpe.decode(bpe.encode(odd, file), file).collect()
    want = Counter()
    for x in ODD:
        ids = tok.encode(x[1] or "", add_special_tokens=False).ids
        want[x[0], tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.text) for r in got) == want
    assert bpe.decode(bpe.encode(none, file), file).count() == 0


def test_bpe_of_the_table_equals_the_library(spark):
    file = path("word_bpe_49k.json")
    tok = bpe.library(text_of(file))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op4_bpe(spark, SF).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_bpe_of_words_that_share_a_long_beginning():
    """Time and room grow with the words, not with the square of what they share; ids are the library's."""
    import time

    encoder, tok = bpe.WordEncoder(text_of(path("word_bpe_49k.json"))), bpe.library(text_of(path("word_bpe_49k.json")))
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("etaoinshrdlu"), 300_000))
    short = long[:3000]
    texts = [f"{short}a {short}b {short[:1500]} {short} {short[:1501]}x aa a aaa", f"{short}"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    began = time.time()
    a, b = encoder.encode([long + "ka", long + "kb"])
    assert time.time() - began < 20 and a[:-40] == b[: len(a) - 40]


def test_trie_lists_words_depth_first():
    words = ["abc", "ab", "abd", "b", "abcde", "ba"]
    assert list(bpe.trie_of(words, "")) == [("ab", 0), ("abc", 2), ("abcde", 3), ("abd", 2), ("b", 0), ("ba", 1)]
    assert list(bpe.trie_of(words, bpe.END)) == [("ab", 0), ("abc", 1), ("abcde", 2), ("abd", 2), ("b", 0), ("ba", 0)]


# 5


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(1 << bits, size=1001).astype("<u4")
    assert (idfiles.unpack(idfiles.pack(ids, bits), len(ids), bits) == ids).all()


def test_id_files_round_trip(spark, odd, none, tmp_path):
    file = path("byte_bpe_50k.json")
    tok = idfiles.library(text_of(file))
    for docs, rows in ((odd, ODD), (none, [])):
        manifest = idfiles.write(docs, file, 2, f"file://{tmp_path}/{len(rows)}")
        got = sorted(idfiles.read_back(manifest).collect(), key=lambda r: r.start)
        start = 0
        for r, x in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0])), strict=True):
            ids = tok.encode(x[1] or "", add_special_tokens=False).ids + [2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (x[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    (first, *_) = idfiles.write(odd, file, 2, f"file://{tmp_path}/random").collect()
    reader = idfiles.Reader(first.file)
    whole = list(reader.documents())
    for k in reversed(range(len(whole))):
        assert (reader.document(k) == whole[k][2]).all()


def test_ids_of_one_document_stand_in_one_order_over_files(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(300)] + [(8, "last"), (3, "first")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = idfiles.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/ids")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    got = [(r.doc_id, r.ids_crc32) for r in sorted(idfiles.read_back(manifest).collect(), key=lambda r: r.start)]
    tok = idfiles.library(text_of(path("byte_bpe_50k.json")))
    order = sorted(rows, key=lambda x: (x[0], signed(spark_hash(x[1]))))
    assert got == [(i, zlib.crc32(np.array([*tok.encode(t).ids, 2], "<u4").tobytes())) for i, t in order]


# 6


def brute_links(ids, x, labels, least):
    n, root = Counter(), {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for a in range(len(ids)):
        for b in range(a):
            if labels[a] == labels[b] and x[a] @ x[b] >= least:
                n[ids[a]] += 1
                n[ids[b]] += 1
                p, q = sorted((top(ids[a]), top(ids[b])))
                root[q] = p
    return n, {i: top(i) for i in ids}


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    noise = rng.normal(size=(60, 64))
    noise -= (noise * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    noise *= np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    cos = np.linspace(0.90, 0.99, 60)[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * noise, np.repeat(base[:1], 5, 0)]).astype(np.float32).astype(float)
    labels = [i % 3 for i in range(60)] * 2 + [0] * 5
    rows = [(i, x[i].tolist(), labels[i]) for i in range(len(x))]
    bad = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [None, 1.0], 1), (1004, x[0].tolist(), None), (1005, [], 0), (1006, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int")
    clashing = frame.withColumns({c: F.lit("x") for c in ("node", "rep", "key", "copies", "links", "part", "group", "component")})
    got = {r.vec_id: r for r in vectors.near_duplicates(clashing).collect()}
    n, root = brute_links(list(range(len(x))), x, labels, 0.93)
    assert len(got) == len(rows + bad)
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(x))} == {i: (n[i], root[i]) for i in range(len(x))}
    assert all((got[b[0]].n_links, got[b[0]].component_id) == (0, b[0]) for b in bad)
    again = {r.vec_id: r for r in vectors.near_duplicates(frame.orderBy(F.desc("vec_id")).repartition(5)).collect()}
    assert got == again
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert vectors.near_duplicates(empty).count() == 0


def test_vectors_of_one_id_and_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (15, [0.0, 1.0], 0), (10, [0.0, 2.0], 0), (15, [1.0, 1.0], 0), (20, [2.0, 2.0], 0), (20, [2.0, 2.0], 0), (7, [1.0, 0.0, 0.0], 0), (8, [2.0, 0.0, 0.0], 0), (9, [0.0, 2.0], 1)]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == Counter([(1, 0, 1)] * 2 + [(15, 1, 10), (10, 1, 10), (15, 1, 10)] + [(20, 1, 10)] * 2 + [(7, 1, 7), (8, 1, 7), (9, 0, 9)])


@pytest.mark.parametrize("cut", [4, 1024])
def test_crowded_buckets_of_vectors(spark, monkeypatch, cut):
    """Parts of one bucket meet each other once, whatever a part's size."""
    monkeypatch.setattr(vectors, "MOST_OF_BLOCK", cut)
    rng = np.random.default_rng(5)
    x = np.ones(16) + 0.25 * rng.normal(size=(90, 16))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")).collect()}
    n, root = brute_links(list(range(90)), x, [3] * 90, 0.93)
    missed = sum(n.values()) - sum(v[0] for v in got.values())
    assert sum(n.values()) > 400 and 0 <= missed <= 0.01 * sum(n.values())


@pytest.mark.parametrize("n", [3000, 100_000, 10_000_000])
def test_recall_of_planted_vectors(n):
    """Pairs of cosine 0.93 and a little more, by the hashing that a table of n vectors gets."""
    rng = np.random.default_rng(n)
    how = vectors.hashing(n, 64, 0.93)
    x, y = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.94, (1500, 1))
    a, b = vectors.buckets(x, how), vectors.buckets(cos * x + np.sqrt(1 - cos**2) * y, how)
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() >= 0.99


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 8])
def test_vectors_of_few_dimensions_by_brute_force(spark, dim):
    """Crowds in a few directions and strays: every link is found up to four dimensions, and nearly all at eight."""
    rng = np.random.default_rng(dim)
    x = np.concatenate([c + 0.15 * rng.normal(size=(40, dim)) for c in rng.normal(size=(6, dim))] + [rng.normal(size=(40, dim))])
    labels = [i % 2 for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    n, root = brute_links(list(range(len(x))), x, labels, 0.93)
    if dim <= vectors.EXACT:
        assert got == {i: (n[i], root[i]) for i in range(len(x))}
    assert sum(n.values()) > 300 and sum(n.values()) - sum(v[0] for v in got.values()) <= 0.004 * sum(n.values())


@pytest.mark.parametrize("dim", [6, 8, 16, 100, 768])
@pytest.mark.parametrize("n", [1000, 1_000_000])
def test_recall_and_time_of_the_plan_by_dimensions(dim, n):
    import time

    began = time.time()
    how = vectors.hashing(n, dim, 0.93)
    assert time.time() - began < 20
    if how is not None:
        rng = np.random.default_rng(dim)
        x, y = rng.normal(size=(2, 600, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        assert vectors.met(how, x, 0.93 * x + np.sqrt(1 - 0.93**2) * y).any(1).mean() >= 0.985


def test_all_are_compared_where_tables_are_too_few(spark, monkeypatch):
    monkeypatch.setattr(vectors, "hashing", lambda *_: None)
    monkeypatch.setattr(vectors, "MOST_OF_BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5, 10))[rng.integers(0, 5, 120)] + 0.2 * rng.normal(size=(120, 10))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")).collect()}
    n, root = brute_links(list(range(120)), x, [3] * 120, 0.93)
    assert sum(n.values()) > 100 and got == {i: (n[i], root[i]) for i in range(120)}


def test_pairs_of_groups_agree_with_plain_ones(monkeypatch):
    monkeypatch.setattr(vectors, "SMALL", 5)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    starts = np.array([0, 1, 4, 9, 30, 33])
    group = np.searchsorted(starts, np.arange(60), side="right")
    a, b = vectors.close_pairs(x, starts, 0.5, chunk=7)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(60) for j in range(i + 1, 60) if group[i] == group[j] and x[i] @ x[j] >= 0.5]


# 7


def test_language_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.learn(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1, most=300, steps=120)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.identify(docs.limit(300), net).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.93
    got = by_id(language.identify(odd, net))
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 4, 6} and sum(got[5].labelled) == 150_000
    assert language.identify(none, net).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.learn(none, F.lit(True))).collect()} == {"und"}


def plain_reading(net, window):
    """One window byte by byte, from both ends."""
    size = net.inner.shape[2]
    sig = lambda v: 1 / (1 + np.exp(-v))
    seen = np.zeros((len(window), 2 * size))
    for way in (0, 1):
        state = np.zeros(size)
        for t in range(len(window)) if way == 0 else reversed(range(len(window))):
            x, a = net.table[way][:, window[t]].astype(float), net.inner[way].astype(float) @ state
            z, r = sig(x[:size] + a[:size]), sig(x[size : 2 * size] + a[size : 2 * size])
            n = np.tanh(x[2 * size :] + r * a[2 * size :])
            state = (1 - z) * n + z * state
            seen[t, way * size : (way + 1) * size] = state
    e = np.exp(seen @ net.out.T + net.bias)
    return e / e.sum(1, keepdims=True)


def some_network(rng, kind=np.float32):
    return [x.astype(kind) for x in (rng.normal(size=(2, 12, 256)), 0.5 * rng.normal(size=(2, 12, 4)), rng.normal(size=(3, 8)), rng.normal(size=3))]


def test_language_reading_by_plain_loops():
    rng = np.random.default_rng(1)
    net = language.Network(["a", "b", "c"], *some_network(rng))
    text = [rng.integers(256, size=n).astype(np.uint8) for n in (5, 0, 3 * language.WINDOW // 2, 1)]
    prob, counts = language.pooled(net, np.concatenate(text), np.append(0, np.cumsum([len(t) for t in text])))
    for k, t in enumerate(text):
        # a short last window is filled up with blanks, which the reading from the end begins with
        at = range(0, len(t), language.WINDOW)
        whole = [plain_reading(net, np.pad(t[a : a + language.WINDOW], (0, max(0, language.WINDOW - len(t[a:]))), constant_values=32))[: len(t[a:])] for a in at]
        want = np.concatenate(whole) if whole else np.zeros((0, 3))
        assert prob[k] == pytest.approx(want.sum(0) / max(len(t), 1), abs=1e-4)
        assert np.abs(counts[k] - np.bincount(want.argmax(1), minlength=3)).sum() <= 2 and counts[k].sum() == len(t)


def test_language_slopes_by_differences():
    rng = np.random.default_rng(4)
    w, x, truth = some_network(rng, float), rng.integers(97, 103, size=(7, 5)).astype(np.uint8), rng.integers(3, size=5)
    _, grads = language.slopes(w, x, truth)
    for k, g in enumerate(grads):
        for at in [tuple(rng.integers(n) for n in g.shape) for _ in range(12)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            moved = []
            for step in (1e-5, -1e-5):
                v = [y.copy() for y in w]
                v[k][at] += step
                moved.append(language.slopes(v, x, truth)[0])
            assert g[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-7)


def test_language_gradient_reads_both_ways():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b"], rng.normal(size=(2, 12, 256)).astype(np.float32), rng.normal(size=(2, 12, 4)).astype(np.float32), rng.normal(size=(2, 8)).astype(np.float32), np.zeros(2, np.float32))
    w = rng.integers(256, size=(9, 3)).astype(np.uint8)
    changed = w.copy()
    changed[4] ^= 1
    moved = np.abs(language.read_windows(net, w) - language.read_windows(net, changed)).max((1, 2))
    assert (moved > 0).all()


# 8


def brute_near(rows, percent=80):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(12):
        text = list(rng.choice(words, 120))
        for k in range(8):
            edited = list(text)
            for at in rng.choice(120, k, replace=False):
                edited[at] = rng.choice(words)
            rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b", "A  b", "a b c", "", None, " ", "a b c d", "a b c d"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd).collect())
    want = brute_near([x[:2] for x in ODD if x[0] is not None])
    assert got == Counter([(x[0], want[x[0]][0], want[x[0]][1]) for x in ODD if x[0] is not None] + [(None, 1, None)])
    assert neardup.near_duplicates(none).count() == 0


def test_words_that_swap_their_bytes_are_different_words(spark):
    a, b, c = "a" * 64, "b" * 64, "漢字仮名" * 40
    rows = [(1, f"{a}{b} q w e"), (2, f"{b}{a} q w e"), (3, f"{c}x{c}y q w e"), (4, f"{c}y{c}x q w e"), (5, f"{a}{b} q w e")]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    words = [bytes(w) for w in np.random.default_rng(3).permuted(np.tile(np.arange(97, 123, dtype=np.uint8), (2000, 12)), axis=1)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    assert len(set(word_hashes(data, np.array([0, len(data)]))[0].tolist())) == len(set(words)) == 2000


def test_rows_of_one_id_are_one_document(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(10, "a"), (15, "a"), (15, "b"), (20, "b"), (15, "c"), (30, "c"), (5, "d"), (40, "d"), (40, None)]
    got = neardup.near_duplicates(spark.createDataFrame([(i, text.get(k)) for i, k in rows], "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(10, 10), (15, 10), (15, 10), (15, 10), (20, 10), (30, 10), (5, 5), (40, 5), (40, 40)])


def test_near_duplicates_in_crowded_buckets(spark, monkeypatch):
    """Many versions of one text, some of them too far from the first for a link with it, cut into many blocks."""
    monkeypatch.setattr(neardup, "MOST_OF_BLOCK", 8)
    rng = np.random.default_rng(8)
    text, rows = [f"w{i}" for i in range(130)], []
    for k in range(90):
        edited = list(text)
        for at in rng.choice(130, 3 + k % 5, replace=False):
            edited[at] = f"x{rng.integers(1000)}"
        rows.append((k, " ".join(edited)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)
    again = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(7)).collect()}
    assert got == again


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(1 << 63, size=3000, dtype=np.uint64))
    a, b = pool[:1500], pool[300:1800]
    reg = neardup.sketch(np.concatenate([a, b, np.union1d(a, b)]), np.cumsum([0, len(a), len(b), 1800]))
    assert (np.maximum(reg[0], reg[1]) == reg[2]).all()
    (like,) = neardup.likelihood_jaccard(reg[:1], reg[1:2], np.array([1500.0]), np.array([1500.0]))
    assert abs(like - 1200 / 1800) < 0.12


def test_counts_and_tests_of_pairs_agree_with_plain_ones():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(60, size=n, dtype=np.uint64)) for n in (1, 20, 40, 80, 120, 120)]
    assert (neardup.common(sets[:3], sets[3:], width=7) == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]).all()
    equal = rng.integers(1, neardup.REGISTERS, size=500)
    above = (rng.random(500) * (neardup.REGISTERS - equal)).astype(np.int64)
    n_a, n_b = rng.integers(80, 101, size=(2, 500)).astype(float)
    whole = neardup.jaccard_of_counts(above, neardup.REGISTERS - above - equal, equal, n_a, n_b)
    assert (neardup.alike_enough(above, equal, n_a, n_b, 0.6) == (whole >= 0.6)).all()


# 9


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = labelled(spark, "quality")
    model = quality.learn(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert 0.4 < model.prior < 0.85
    wrong = [r.doc_id for r in quality.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and (r.score >= 0.3) != (r.doc_id % 4 != 0)]
    assert wrong == []
    scores = quality.score(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(odd, quality.learn(none, labels.limit(0), F.lit(True))).collect()} == {0.5}


def plain_measures(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    raw, n, d = text.encode(), len(words), len(set(words))
    has = lambda f: sum(map(f, raw))
    upper, lower, far = has(lambda b: 65 <= b <= 90), has(lambda b: 97 <= b <= 122), has(lambda b: b >= 128)
    digit, blank, line = has(lambda b: 48 <= b <= 57), has(lambda b: b in (9, 11, 12, 13, 32)), raw.count(b"\n")
    stop, shout, bar = has(lambda b: b in b".,;:?'\"-"), raw.count(b"!"), raw.count(b"|")
    letters, rest = upper + lower + far, len(raw) - upper - lower - far - digit - blank - line - stop - shout - bar
    per = lambda a, b: a / max(b, 1)
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [np.log1p(n), per(upper, letters), per(digit, len(raw)), per(blank, n), per(line, n), per(stop, n), per(shout, n), per(bar, n), per(far, len(raw)), per(rest, n), per(letters, n) / 10, per(d, n), per(again, n), d / max(n**0.5, 1) / 10, float(n == 0)]


@pytest.mark.parametrize("kept", [1, 3, 1000])
def test_cells_hold_every_document(spark, odd, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(3)
    texts = [(r.text or "").encode() for r in docs.collect()]
    x = np.array([quality.measures(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts])
    medians = np.median(x, axis=0)
    u, n, mean, scale = quality.cells(docs, medians, kept)
    want = Counter(tuple(row > medians) for row in x)
    assert np.isclose(n.sum(), len(texts)) and len(u) == sum(min(kept, v) for v in want.values())
    got = Counter()
    for row, k in zip(u, n, strict=True):
        got[tuple(row > medians)] += k
    assert {k: round(v) for k, v in got.items()} == dict(want)
    assert {tuple(row) for row in u} <= {tuple(row) for row in x}
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0) + 1e-3)


def test_quality_learns_from_every_document_and_label(spark, odd):
    """More positives than 5000 and hundreds of documents alike: the steps of the fit are those of all rows taken at once."""
    rows = [(i, " ".join(["word", "And", "more!"][: 1 + i % 3] * (1 + i % 7)), i % 8 != 0) for i in range(100, 7100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").union(odd.select("doc_id", "text")).repartition(3)
    labels = spark.createDataFrame([(i, int(good), 0) for i, _, good in rows] + [(2, 1, 0)], "doc_id bigint, quality int, toxic int")
    blocks = quality.points(docs, labels, F.lit(True))
    texts = [t.encode() for _, t, _ in rows] + [(r[1] or "").encode() for r in ODD]
    x = quality.measures(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    good = np.array([g for *_, g in rows] + [r[0] == 2 for r in ODD])
    kind = np.concatenate([np.frombuffer(r.kind, np.uint8) for r in blocks.collect()])
    assert len(kind) == len(x) and (kind > 0).sum() == good.sum() > 5000 and abs((kind == 1).sum() - (kind == 2).sum()) < 500
    standard = quality.Standard(x.mean(0), x.std(0) + 1e-3)
    rng = np.random.default_rng(5)
    w = [rng.normal(size=(quality.MEASURES, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    by_sigmoid, by_one, unlabelled, cost_p, cost_u = quality.slopes(blocks, w, standard, (1, 2))
    a, g = quality.outputs(w, standard(x))
    seen = set()
    for prior in (0.05, 0.95):
        parts = quality.risk_parts(cost_u / len(x) - prior * cost_p / good.sum(), prior)
        seen.add(parts[2])
        got = (parts[0] * by_sigmoid + parts[1] * by_one) / good.sum() + parts[2] * unlabelled / len(x)
        of_p, of_u = quality.risk_slope(g[good], g, prior)
        of_u[good] += of_p
        want = quality.back(w, standard(x), a, of_u, 0.0)
        assert np.allclose(got, np.concatenate([v.ravel() for v in want]))
    assert len(seen) == (2 if np.mean(np.logaddexp(0, g)) < 0.95 * np.mean(np.logaddexp(0, g[good])) else 1)
    p, u = quality.score_counts(blocks, w, standard, (1, 2))
    assert p.sum() == good.sum() and u.sum() == len(x)
    bins = np.floor(g * 256).astype(int) + 4096
    assert (u == np.bincount(bins.clip(0, 8191), minlength=8192)).mean() > 0.999


def test_quality_prior_is_what_the_counts_allow():
    """Seven in ten of all documents are positives, which score like the labelled ones; the others score less."""
    p, u = np.zeros(100), np.zeros(100)
    p[50:] = 200
    u[50:], u[:50] = 14_000, 6000
    assert quality.estimate_prior(p, u) == pytest.approx(0.96 * 0.7, abs=0.003)


def test_windows_come_from_all_over_a_text():
    text = bytes(range(256)) * 40
    some = language.drawn(text, 7, many=400)
    assert all(w in text and len(w) == language.LENGTH for w in some) and len({w[0] for w in some}) > 150
    assert language.drawn(b"short", 7) == [b"short"] and language.drawn(b"", 7) == [] and some == language.drawn(text, 7, many=400)


def test_quality_measures_are_plain_ones():
    texts = ["Plain words, plain WORDS stand here!", "", "1 2 2 2 | | é日本 ###\n\nend.", "...", "a " * 500, "x" * 100]
    data = "".join(texts).encode()
    got = quality.measures(np.frombuffer(data, np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts])))
    assert got == pytest.approx(np.array([plain_measures(t) for t in texts]))


@pytest.mark.parametrize("prior, below", [(0.3, False), (0.9, True)])
def test_quality_risk_slopes_by_differences(prior, below):
    rng = np.random.default_rng(6)
    gp, gu = rng.normal(1.0, 1, 9), rng.normal(0.0 if not below else -1.0, 1, 11)
    cost = lambda v: np.mean(np.log1p(np.exp(v)))
    negative = lambda p, u: cost(u) - prior * cost(p)
    assert (negative(gp, gu) < 0) == below
    # below 0 the step goes against the negatives' share, else down the whole risk
    loss = (lambda p, u: -negative(p, u)) if below else (lambda p, u: prior * cost(-p) + negative(p, u))
    for got, which in zip(quality.risk_slope(gp, gu, prior), (0, 1), strict=True):
        for i in range(len(got)):
            both = [[gp.copy(), gu.copy()] for _ in range(2)]
            both[0][which][i] += 1e-6
            both[1][which][i] -= 1e-6
            assert got[i] == pytest.approx((loss(*both[0]) - loss(*both[1])) / 2e-6, abs=1e-8)


def test_quality_network_slopes_by_differences():
    rng = np.random.default_rng(7)
    w = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    x, c = rng.normal(size=(8, 5)), rng.normal(size=8)
    a, _ = quality.outputs(w, x)
    loss = lambda v: (c * quality.outputs(v, x)[1]).sum() + 0.05 * ((v[0] ** 2).sum() + (v[2] ** 2).sum())
    for k, g in enumerate(quality.back(w, x, a, c, 0.1)):
        for at in np.ndindex(g.shape):
            both = [[y.copy() for y in w] for _ in range(2)]
            both[0][k][at] += 1e-6
            both[1][k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(both[0]) - loss(both[1])) / 2e-6, abs=1e-6)


# 10


def spark_hash(*values, seed=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def signed(u):
    return u - (1 << 64) if u >= 1 << 63 else u


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [spark_hash(w) for w in words]
    place = (1 << 24) - 1
    pack = lambda u, p: (u >> 1) & ~place | p
    seen, elements = Counter(), []
    for i in range(max(1, len(words) - 4) if words else 0):
        x = pack(spark_hash(*[(signed(v), 8) for v in h[i : i + 5]]), i)
        o = seen[x >> 24]
        seen[x >> 24] += 1
        elements.append(x if o == 0 else pack(spark_hash((x >> 24, 8), (o, 4)), i))
    out = []
    for t in range(32):
        pick = sorted(elements, key=lambda x: x ^ (t << 58))[:2]
        out.append(spark_hash(*[(x >> 24, 8) for x in sorted(pick, key=lambda x: x & place)]) & 0xFFFFFFFF)
    return out


def test_fingerprints_by_brute_force(spark, none):
    rng = np.random.default_rng(6)
    rows = [(int(i) * 3, " ".join(rng.choice(["a", "b", "c", "dé", "e"] if k % 2 else [f"w{j}" for j in range(500)], size=int(k * 17)))) for k, i in enumerate(rng.permutation(24))]
    rows += [(100, None), (101, ""), (102, " "), (103, "one two"), (104, "same text"), (105, "same text")]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i].edited == edited
        assert [list(x) for x in (got[i].print, got[i].edited_print, got[i].next_print)] == [brute_fingerprint(t) for t in (text, edited, after)]
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    rows = [(i * i, f"text {i}") for i in range(40)] + [(None, "last")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    met = fingerprints.with_next(df, ["text"], lambda d: d, rows_each=3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.next_text for r in met.collect()} == want


def test_fingerprints_of_odd_rows(odd):
    assert fingerprints.edited_fingerprints(odd).count() == len(ODD)


# all


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_a_row_per_document(spark, name):
    table = "embeddings" if name in ("op6_vectors", "op11_clusters") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert Path(SF).exists()
