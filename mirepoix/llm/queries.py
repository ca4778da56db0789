"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirepoix.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _byte_bpe())


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _byte_bpe())


@query
def op6_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.decontaminate import with_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.distance", "leak.start", "leak.end")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.common import crc_mod
    from mirepoix.llm.language import fit, with_language

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs.filter(~held_out & F.col("lang").isNotNull()), "doc_id", "text", "lang")
    predicted = with_language(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.common import crc_mod
    from mirepoix.llm.toxicity import toxicity

    held_out = crc_mod("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    scored = toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_neighbours", "nearest", "neighbours")


@query
def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.pii import KINDS, joined, personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[joined(k, F.col(k)) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, joined(None, F.col("added")))).alias("spans"),
    )


@query
def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.html_text import with_main_text

    pages = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from mirepoix.llm.rank_bpe import decode, encode

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = decode(encode(table(spark, sf_dir, "documents"), *vocabulary), *vocabulary)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), lambda i: i % 100 == 0)


ORACLES["op12_threshold_negatives"] = """
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.x) = len(b.x)
), positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score
  FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@query
def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mirepoix.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), group=5, opening=9)


#: The checksum goes byte by byte and bit by bit, as SQL has no function for it.
ORACLES["op11_burst_trie"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS seq
  FROM turns GROUP BY conv_id
), opened AS (
  SELECT conv_id, seq, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.seq[1:o.h], []), o.seq[o.h + 1:]) AS seq
  FROM opened o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, md5(seq[1:d]::VARCHAR) AS node, len(seq) = d AS ends, seq
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         any_value(CASE WHEN d = 0 THEN 0 ELSE strlen(seq[d].text) END) AS bytes,
         any_value(CASE WHEN d > 0 THEN md5(seq[1:d - 1]::VARCHAR) END) AS parent
  FROM prefixes GROUP BY node, d
), children AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent, depth
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node, depth)
), above AS (
  SELECT DISTINCT node, d AS depth, a AS above_depth, md5(seq[1:a]::VARCHAR) AS above
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM prefixes)
), subtrees AS (
  SELECT a.above AS node, a.above_depth AS depth, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM above a JOIN counted n USING (node, depth) GROUP BY a.above, a.above_depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s USING (node, depth) LEFT JOIN counted p ON p.node = n.parent AND p.depth = n.depth - 1
"""
