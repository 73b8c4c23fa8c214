"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.language import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op3_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=80).select("doc_id", "n_shingles", "component_id", "kept")


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.multi_index import nearest_documents

    return nearest_documents(table(spark, sf_dir, "embeddings"))


def op5_dom_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.pages import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.toxicity import fit, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.repeats import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.col("_sha256").alias("kept_sha256"), F.col("text"))


def op9_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.voronoi import top_documents

    return top_documents(table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skirmish.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary())


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_kd_sharding, op3_chosen_path_dedup, op4_inverted_multi_index, op5_dom_tree_extraction, op6_toxicity_chain, op7_pfair_mixing, op8_suffix_dedup, op9_voronoi_top_k, op10_best_fit_packing)}
#: Near-duplicates by counting common shingles and a recursive reach; repeats by all windows in hexadecimal, in pieces that
#: overlap by a window; exact search is a join and a ranking, where vectors without a null or non-finite component are meant.
ORACLE_SQL: dict[str, str] = {
    "op3_chosen_path_dedup": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM texts),
parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM reach r JOIN edges l ON l.a = r.doc_id WHERE r.least < l.b),
found AS (SELECT doc_id, min(least) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (doc_id)
""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (SELECT doc_id, 1000 * b AS pos, substring(h, 2000 * b + 1, 2798) AS p FROM (SELECT doc_id, h, unnest(range((n + 600) // 1000)) AS b FROM d WHERE n >= 400)),
starts AS (SELECT doc_id, pos + i AS pos, md5(substring(p, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, pos, p, unnest(range(least(1000, len(p) // 2 - 399))) AS i FROM pieces)),
again AS (SELECT doc_id, pos FROM starts WHERE k IN (SELECT k FROM starts GROUP BY 1 HAVING count(*) > 1)),
fresh AS (SELECT *, CAST(pos > lag(pos, 1, -1000) OVER (PARTITION BY doc_id ORDER BY pos) + 400 AS INTEGER) AS f FROM again),
runs AS (SELECT doc_id, min(pos) AS lo, max(pos) + 400 AS hi FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM fresh) GROUP BY doc_id, r),
gaps AS (
  SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS b FROM runs
  UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS left_ FROM gaps JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM runs GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(left_, h))) AS kept_sha256, CASE WHEN left_ IS NULL THEN text ELSE decode(unhex(left_)) END AS text
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_voronoi_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM whole q JOIN whole e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM scored)
SELECT * FROM ranked WHERE "rank" <= 5
""",
}
