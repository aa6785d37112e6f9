"""Queries of the general data-pipeline problems 2, 3 and 6, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.operators.nested import chain_keys, flat_rows, flat_table, json_triples, object_rows, row_triples
from lumenry.operators.references import Reference, orphan_counts, orphan_references
from lumenry.operators.rolling import rolling_usage
from lumenry.sources.tables import read_table

REPORT_FIELDS = ("recommendations", "schema_analysis", "content_analysis")


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    usage = rolling_usage(read_table(spark, d, "user_daily_usage"), "user_id", "usage_date", "updated_at", ("total_tokens", "request_count"), (7, 30))
    rounded = [F.round(f"{c}_{n}d_avg", 6).alias(f"{c}_{n}d_avg") for c in ("total_tokens", "request_count") for n in (7, 30)]
    return usage.select(F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), *[f"{c}_{n}d" for c in ("total_tokens", "request_count") for n in (7, 30)], *rounded)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    usage = rolling_usage(read_table(spark, d, "user_daily_usage"), "user_id", "usage_date", "updated_at", ("total_tokens", "request_count"), (7, 30))
    falling = usage.where((F.col("request_count") == 0) & (F.col("total_tokens_7d") * 30 > F.col("total_tokens_30d") * 7))
    return falling.select(F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def references(spark: SparkSession, d: str) -> list[Reference]:
    companies, conversations, reports, messages = (read_table(spark, d, t) for t in ("companies", "conversations", "diagnostic_reports", "messages"))
    return [
        Reference("company_votes", "company_id", read_table(spark, d, "company_votes"), "companies", companies),
        Reference("diagnostic_reports", "company_id", reports, "companies", companies),
        Reference("messages", "conversation_id", messages, "conversations", conversations),
        Reference("messages", "diagnostic_context_id", messages, "diagnostic_reports", reports),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(references(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p3_found(spark, d))


def latest_companies(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The newest state of each company; the greatest values win among equal times."""
    rows = read_table(spark, d, "companies").select("id", "updated_at", *columns)
    return rows.groupBy("id").agg(F.max(F.struct("updated_at", *columns)).alias("r")).select("id", *[f"r.{c}" for c in columns])


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    reports = read_table(spark, d, "diagnostic_reports")
    return object_rows(reports, "id", REPORT_FIELDS).unionByName(object_rows(latest_companies(spark, d, "geo_details"), "id", ("geo_details",)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_objects(spark, d).select("field", "record_id", "path")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    return p6_objects(spark, d).groupBy("field", "table").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_records"), F.count_if(F.col("parent") != "").alias("n_nested"))


def p6_triples(spark: SparkSession, d: str) -> DataFrame:
    """The triples of the four fields, of one row per report and the newest state of each company."""
    reports = read_table(spark, d, "diagnostic_reports").groupBy("id").agg(F.max(F.struct("created_at", *REPORT_FIELDS)).alias("r")).select("id", "r.*")
    return json_triples(reports, "id", REPORT_FIELDS).unionByName(json_triples(latest_companies(spark, d, "geo_details"), "id", ("geo_details",)))


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the flat tables of every chain of the four fields, with all keys of their table."""
    return flat_rows(p6_triples(spark, d))


def p6_phase_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the tasks of the phase plans, with links to their phases and every key that occurs."""
    reports = read_table(spark, d, "diagnostic_reports").groupBy("id").agg(F.max("recommendations").alias("recommendations"))
    triples = row_triples(json_triples(reports, "id", ("recommendations",)))
    keys = chain_keys(triples).where("table = 'phase_plan.tasks'").collect()
    return flat_table(triples, "recommendations", "phase_plan.tasks", keys[0]["keys"] if keys else ())


QUERIES = {f.__name__: f for f in (p2_rolling, p2_found, p3_found, p3_counts, p6_found, p6_tables, p6_rows, p6_phase_tasks)}

_DAYS = """
WITH last AS (
  SELECT user_id, usage_date, total_tokens, request_count FROM user_daily_usage
  QUALIFY row_number() OVER (PARTITION BY user_id, usage_date ORDER BY updated_at DESC NULLS LAST, total_tokens DESC NULLS LAST, request_count DESC NULLS LAST) = 1
), span AS (SELECT user_id, min(usage_date) AS a, max(usage_date) AS b FROM last GROUP BY user_id),
grid AS (SELECT user_id, unnest(generate_series(a::timestamp, b::timestamp, INTERVAL 1 DAY))::date AS day FROM span),
dense AS (
  SELECT g.user_id, g.day, coalesce(l.total_tokens, 0)::bigint AS t, coalesce(l.request_count, 0)::bigint AS r
  FROM grid g LEFT JOIN last l ON l.user_id = g.user_id AND l.usage_date = g.day
), sums AS (
  SELECT user_id, day, r, sum(t) OVER w7 AS t7, sum(t) OVER w30 AS t30, sum(r) OVER w7 AS r7, sum(r) OVER w30 AS r30 FROM dense
  WINDOW w7 AS (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY user_id ORDER BY day ROWS 29 PRECEDING)
)
"""


def _key(c: str) -> str:
    bare = f"lower(translate(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '{{}}-', ''))"
    return f"CASE WHEN {bare} = '' OR regexp_full_match({bare}, '0+') THEN NULL ELSE {bare} END"


def _orphans(table: str, column: str, parent: str) -> str:
    return f"""
  SELECT DISTINCT '{table}' AS child_table, '{column}' AS ref_column, c.id AS child_id, CASE WHEN p.k IS NULL THEN 'missing' ELSE 'late' END AS kind,
    coalesce(strftime(c.created_at, '%Y-%m'), 'unknown') AS period
  FROM (SELECT id, created_at, {_key(column)} AS k FROM {table}) c
  LEFT JOIN (SELECT {_key("id")} AS k, min(created_at) AS born FROM {parent} GROUP BY 1) p ON p.k = c.k
  WHERE c.k IS NOT NULL AND (p.k IS NULL OR c.created_at < p.born)"""


_ORPHANS = " UNION ALL ".join(_orphans(*x) for x in (("company_votes", "company_id", "companies"), ("diagnostic_reports", "company_id", "companies"), ("messages", "conversation_id", "conversations"), ("messages", "diagnostic_context_id", "diagnostic_reports")))

SQL = {
    "p2_rolling": _DAYS + """SELECT user_id, strftime(day, '%Y-%m-%d') AS day, t7::bigint AS total_tokens_7d, t30::bigint AS total_tokens_30d, r7::bigint AS request_count_7d, r30::bigint AS request_count_30d,
  round(t7 / 7.0::double, 6) AS total_tokens_7d_avg, round(t30 / 30.0::double, 6) AS total_tokens_30d_avg, round(r7 / 7.0::double, 6) AS request_count_7d_avg, round(r30 / 30.0::double, 6) AS request_count_30d_avg FROM sums""",
    "p2_found": _DAYS + "SELECT user_id, strftime(day, '%Y-%m-%d') AS day FROM sums WHERE r = 0 AND t7 * 30 > t30 * 7",
    "p3_found": _ORPHANS,
    "p3_counts": f"SELECT child_table, ref_column, kind, period, count(*) AS n_rows FROM ({_ORPHANS}) GROUP BY ALL",
}
