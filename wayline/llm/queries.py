"""The queries of this subpackage over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, clusters, fingerprints, idfiles, language, licenses, maxent, mixing, neardup, quality, resampling, toxicity, vectors
from wayline.llm.common import id_remainder, read
from wayline.llm.pieces import path


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    names = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.col(spans)["label"])))
    doubt = F.aggregate(F.array_distinct(F.transform("finds", lambda x: F.struct(x["label"], x["confidence"]))), F.lit(1.0), lambda p, x: p * (1 - x["confidence"]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["first_word"]).alias("first_word"), F.array_max(F.col("base")["first_word"]).alias("last_word"),
        names("base").alias("base_labels"), names("finds").alias("labels"), (1 - doubt).alias("score"),
    )


def _verdict(scores: DataFrame, divisor: int, held_out: int, least: float) -> DataFrame:
    return scores.select("doc_id", (id_remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    return _verdict(toxicity.score(docs, model), 5, 0, 0.5)


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded documents."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(bpe.round_trip(read(spark, sf_dir, "documents"), path("word_bpe_49k.json")))


def op5_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = idfiles.new_folder(spark)
    return idfiles.read_back(idfiles.write(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), 2, folder))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = language.learn(docs, id_remainder(F.col("doc_id"), 3) != 1)
    return language.identify(docs, net).select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.learn(docs, read(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 5) != 0)
    return _verdict(quality.score(docs, model), 5, 0, 0.3)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.text_form("print").alias("fingerprint"), fingerprints.text_form("edited_print").alias("edited_fingerprint"),
        fingerprints.likeness("print", "edited_print").alias("near_edited"), fingerprints.likeness("print", "next_print").alias("near_next"),
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.digest(spark, clusters.cluster(read(spark, sf_dir, "embeddings")))


def op12_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out")
    scored = maxent.scores(maxent.learn(docs, id_remainder(F.col("doc_id"), 7) != 2))
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_licenses, op3_toxicity, op4_bpe, op5_idfiles, op6_vectors, op7_language, op8_neardup, op9_quality, op10_fingerprints, op11_clusters, op12_maxent, op13_resampling)}


def _clusters_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Each round in turn: distances to all centroids, the least, and floored means, of which an empty cluster has none."""
    parts = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS cluster, v AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, v, (m).cluster AS cluster, (m).d AS distance FROM (
  SELECT vec_id, v, min({{'d': CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'cluster': cluster}}) AS m FROM v, c{r} GROUP BY ALL))""")
        if r < rounds:
            parts.append(f"""e{r} AS (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY ALL),
c{r + 1} AS (SELECT c{r}.cluster, COALESCE(m, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM e{r} GROUP BY cluster) USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a{rounds}.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat('mix:', CAST(doc_id AS VARCHAR))) AS k
  FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, [3, 1, 2][CAST((place - 1) % 3 + 1 AS INT)] AS weight, 2 * source_size AS capacity FROM w),
l AS (SELECT *,
        (SUM(source_size) OVER () * CAST(1.5 AS DOUBLE)
         - COALESCE(SUM(capacity) OVER (ORDER BY capacity / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / SUM(weight) OVER (ORDER BY capacity / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
      FROM c),
f AS (SELECT arg_min(own_level, place_by_need) AS level FROM (
        SELECT *, row_number() OVER (ORDER BY capacity / weight, place) AS place_by_need FROM l) WHERE NOT capacity < weight * own_level),
t AS (SELECT source, source_size, LEAST(CAST(capacity AS DOUBLE), weight * level) AS target FROM l, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE size * (budget // source_size) + LEAST(size, GREATEST(0, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM p
""",
    "op11_clusters": _clusters_sql(),
    # DuckDB has no crc32: a table by eight shifts a byte, then a fold over each distinct word's bytes
    "op13_resampling": r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
wd AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
wb AS (SELECT regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT n, w, count(*) AS k FROM (SELECT n, unnest(ws) AS w FROM wd) GROUP BY ALL),
bw AS (SELECT w, count(*) AS k FROM (SELECT unnest(ws) AS w FROM wb) GROUP BY ALL),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bk AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM hexed, tab),
s AS (SELECT b, sum(k) AS s FROM dw JOIN bk USING (w) GROUP BY ALL), t AS (SELECT b, sum(k) AS t FROM bw JOIN bk USING (w) GROUP BY ALL),
g AS (SELECT b, CAST(floor(1000 * ln((COALESCE(t, 0) + CAST(1 AS DOUBLE)) * ((SELECT sum(s) FROM s) + CAST(10000 AS DOUBLE)) / ((s + CAST(1 AS DOUBLE)) * (COALESCE((SELECT sum(t) FROM t), 0) + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
f AS (SELECT n, CAST(sum(k) AS BIGINT) AS n_features, CAST(sum(k * gain) AS BIGINT) AS total FROM dw JOIN bk USING (w) JOIN g USING (b) GROUP BY n),
x AS (SELECT doc_id, COALESCE(n_features, 0) AS n_features, COALESCE((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, substr(sha256('2024:' || doc_id), 1, 8) AS h FROM wd LEFT JOIN f USING (n)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || h AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 THEN place END AS rank FROM r
""",
}
