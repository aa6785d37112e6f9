"""Queries of the training-text problems, by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.llm import conversations, entities, leakage, packing, pairs, truncation
from lumenry.sources.tables import read_table


def p1_firms(spark: SparkSession, d: str) -> DataFrame:
    """Each company id with the class of its firm and the number of its variants."""
    classes = entities.firm_classes(read_table(spark, d, "companies"))
    return classes.join(classes.groupBy("firm").agg(F.count(F.lit(1)).alias("n_ids")), "firm").select("id", "firm", "n_ids")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.variant_pairs(entities.firm_classes(read_table(spark, d, "companies")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_defects(read_table(spark, d, "messages")).select("response_id", F.element_at("defects", 1).alias("defect"))


def p4_defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_defects(read_table(spark, d, "messages")).select("response_id", F.explode("defects").alias("defect"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    states = conversations.conversation_state(read_table(spark, d, "conversations"), read_table(spark, d, "messages"))
    return states.where("reason is not null").select("conversation_id", "reason")


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuilt_conversations(read_table(spark, d, "conversations"), read_table(spark, d, "messages"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest parent of each message among all of the four hours before it, whether it is the one directly before, and the root of its thread."""
    links = conversations.reply_threads(read_table(spark, d, "messages"))
    return links.select(F.col("id").alias("message_id"), "parent_id", F.round("score", 6).alias("score"), (F.col("parent_id") == F.col("prev_id")).alias("is_direct"), "root_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_sizes(read_table(spark, d, "documents"), "doc_id", "text")
    return packing.harmonic_pack(packing.pieces(sizes, read_table(spark, d, "pack_sizes")))


def p7_bins(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("pack_name", F.col("key").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), "bin_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents that hold it, and the longest passage."""
    return _leaked(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("doc").alias("n_docs"), F.max("length").alias("longest"))


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read_table(spark, d, "documents")).select(F.col("key").alias("doc_id"), "source", "reason")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read_table(spark, d, "documents")).select(F.col("key").alias("doc_id"))


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return truncation.share_per_source(docs, truncation.truncated(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_firms, p4_found, p4_defects, p5_found, p5_turns, p5_links, p7_bins, p7_fill, p8_found, p8_items, p9_found, p9_cut, p9_sources)}
_MESSAGES = """
SELECT DISTINCT conv, id, role, created_at AS sent, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS rank,
  words IN ('', 'null', 'none', 'undefined', 'nan', 'na', 'nil', 'void', 'empty', 'blank', 'noresponse', 'noanswer', 'nocontent', 'tbd', 'todo', 'keine', 'vide', 'vacío', '无', '空') AS is_empty
FROM (
  SELECT id, created_at, lower(translate(regexp_replace(conversation_id, '^\\s+|\\s+$', '', 'g'), '{}-', '')) AS conv,
    CASE lower(regexp_replace(role, '^[\\s[:punct:]]+|[\\s[:punct:]]+$', '', 'g')) WHEN '' THEN NULL WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant'
      ELSE lower(regexp_replace(role, '^[\\s[:punct:]]+|[\\s[:punct:]]+$', '', 'g')) END AS role,
    regexp_replace(lower(regexp_replace(regexp_replace(coalesce(content, ''), '<[^<>]*>|&[a-zA-Z#0-9]+;', '', 'g'), '```[a-z]*', '', 'g')), '[^\\p{L}\\p{N}\\p{So}]+', '', 'g') AS words
  FROM messages WHERE conversation_id IS NOT NULL
)
"""
SQL: dict[str, str] = {
    "p5_found": f"""
WITH m AS ({_MESSAGES}), o AS (
  SELECT conv, role, is_empty, lag(role) OVER w AS before, lead(role) OVER w AS after, lead(is_empty) OVER w AS after_empty
  FROM m WHERE role IS NOT NULL AND sent IS NOT NULL WINDOW w AS (PARTITION BY conv ORDER BY sent, rank, id)
), s AS (SELECT conv, bool_and(is_empty) AS all_empty, bool_or(role IS NULL OR sent IS NULL) AS unordered FROM m GROUP BY conv),
j AS (
  SELECT conv, bool_or(role = 'assistant' AND (before IS NULL OR before = 'assistant')) AS misplaced,
    bool_or(role = 'user' AND (after IS NULL OR after <> 'assistant' OR after_empty)) AS unanswered FROM o GROUP BY conv
), c AS (SELECT DISTINCT lower(id) AS id, replace(lower(id), '-', '') AS conv FROM conversations)
SELECT * FROM (
  SELECT c.id AS conversation_id, CASE WHEN coalesce(all_empty, true) THEN 'empty' WHEN coalesce(unordered, false) OR coalesce(misplaced, false) THEN 'broken'
    WHEN coalesce(unanswered, false) THEN 'missing_reply' END AS reason
  FROM c LEFT JOIN s ON s.conv = c.conv LEFT JOIN j ON j.conv = c.conv
) WHERE reason IS NOT NULL""",
}
