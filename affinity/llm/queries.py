"""The registered queries of this subpackage: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from affinity.llm import (best_fit_packing, bitplane_kmeans, chat_tree, cover_tree, hnsw, merge_rounds, mixing,
                          quality_ranking, secret_scan, simhash_trie, topk_threshold, url_filter, warc_derivatives)
from affinity.llm.common import table


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_tree.read_back(*chat_tree.prefix_tree(turns.unionByName(extra)))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derive_pages(table(spark, sf_dir, "pages")).withColumnRenamed("source_key", "page_id")


def op4_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_threshold.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_threshold.top_k(vectors, vectors.where("id % 20 = 0"), k=20)


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_ranking.score(docs, quality_ranking.train(docs, table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract asks for digests of the ids, so the ids themselves stay out of the shuffle
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mixing.sample(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "row.source", "row.lang", "mix_weight", "mix_probability")


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    # every seventh label is made wrong
    noisy = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    rows = cover_tree.integer_rows(noisy, scale=256.0)
    return cover_tree.mine(rows, rows.where("id % 100 = 0"), positives=5, negatives=10, low_pct=30, high_pct=90)


def op12_bitplane_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane_kmeans.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, scale=256.0)


def op13_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = merge_rounds.public_model()
    decoded = merge_rounds.decode_ids(merge_rounds.encode_texts(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_hnsw, op2_chat_tree, op3_warc_derivatives, op4_topk_threshold, op5_simhash_trie, op6_quality_ranking, op7_best_fit_packing, op8_secret_scan,
    op9_url_filter, op10_mixing, op11_cover_tree, op12_bitplane_kmeans, op13_merge_rounds)}
_FINITE = """embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

# A control string, after which the template puts one more character.
_CONTROL = r"[<\[]\\*(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round spelled out: m0 are the first centroids, a_i the assignment to m_i."""
    steps = [f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) AS r, vec_id, e FROM v),
m0 AS (SELECT (r - 1)::INT AS cluster, e FROM w WHERE r <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT w.r, w.vec_id, w.e, m.cluster, list_sum(list_transform(list_zip(w.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
         FROM w CROSS JOIN m{i} m),
a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min(struct_pack(distance, cluster)) AS b FROM d{i} GROUP BY r),
u{i} AS (SELECT b.cluster AS cluster, j, sum(e[j])::HUGEINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY 1, 2),
g{i} AS (SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY j) AS e FROM u{i} GROUP BY cluster),
m{i + 1} AS (SELECT m.cluster, coalesce(g.e, m.e) AS e FROM m{i} m LEFT JOIN g{i} g ON g.cluster = m.cluster)""")
    last = f"a{rounds}"
    return f"""WITH {",".join(steps)}
SELECT a.vec_id, a.b.cluster::INT AS cluster, a.b.distance AS distance,
       (sum(a.b.distance) OVER (PARTITION BY a.b.cluster))::BIGINT AS cluster_inertia,
       (sum(a.b.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM {last} a JOIN m{rounds} m ON m.cluster = a.b.cluster"""


ORACLE_SQL: dict[str, str] = {
    "op1_hnsw": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.c),
best AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM best LEFT JOIN n ON n.a = best.vec_id""",
    "op2_chat_tree": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
           + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op4_topk_threshold": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_cover_tree": f"""
WITH v AS (SELECT vec_id, min(struct_pack(label := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
                                          e := list_transform(embedding, lambda x: floor(256 * x::DOUBLE)))) AS s
           FROM embeddings WHERE label IS NOT NULL AND {_FINITE} GROUP BY vec_id),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.s.label = c.s.label AS same, list_inner_product(a.s.e, c.s.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS slot FROM p WHERE same),
neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score,
               row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
        FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND NOT n.same
        WHERE slot <= 5 AND 30 * pos.score <= 100 * n.score AND 100 * n.score <= 90 * pos.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10""",
    "op12_bitplane_kmeans": _kmeans_sql(),
}
