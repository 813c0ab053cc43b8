"""The registered queries of this subpackage and their SQL.

Every query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embedding_dedup, html_text, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts

#: The vocabulary file of the queries, by its name in public_tokenizers.
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """removed: the numbers of the lines that go, joined by commas."""
    return line_dedup.line_counts(_table(spark, sf_dir, "documents")).withColumn("removed", F.array_join("removed", ","))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents")).select(*columns)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


#: Shingle sets, all pairs that share a shingle, and what links reach.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
r(i, j) AS (SELECT i, j FROM p UNION SELECT r.i, p.j FROM r JOIN p ON r.j = p.i)
SELECT doc_id, coalesce(least(doc_id, c), doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_links FROM documents
LEFT JOIN (SELECT i, min(j) AS c FROM r GROUP BY i) a ON a.i = doc_id LEFT JOIN (SELECT i, count(*) AS n FROM p GROUP BY i) b ON b.i = doc_id
"""

OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS w FROM l),
s AS (SELECT doc_id, line, row_number() OVER (ORDER BY doc_id, line) AS g,
  list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
e AS (SELECT g, len(s) AS n, unnest(s) AS x FROM s),
gone AS (SELECT DISTINCT g FROM (SELECT a.g FROM e a JOIN e b ON a.x = b.x AND b.g < a.g GROUP BY a.g, b.g, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n))),
removed AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS r FROM s JOIN gone USING (g) GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(r, '') AS removed
FROM documents d LEFT JOIN removed ON removed.doc_id = d.doc_id
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(i, j) AS (SELECT i, j FROM p UNION SELECT r.i, p.j FROM r JOIN p ON r.j = p.i),
c AS (SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(vec_id, m), vec_id) AS component_id FROM embeddings
  LEFT JOIN (SELECT i, count(*) AS n FROM p GROUP BY i) b ON b.i = vec_id LEFT JOIN (SELECT i, min(j) AS m FROM r GROUP BY i) a ON a.i = vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_line_dedup": op3_line_dedup,
        "op4_packing": op4_packing,
        "op5_token_counts": op5_token_counts,
        "op6_quality_rules": op6_quality_rules,
        "op7_sharding": op7_sharding,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_html_extraction": op9_html_extraction,
        "op10_bpe_codec": op10_bpe_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op3_line_dedup": OP3_SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op8_embedding_near_dedup": OP8_SQL,
    }
