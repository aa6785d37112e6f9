"""Exports: CSV lines, reports, manifests, and the validation of graph payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_line(columns: Sequence[Column]) -> Column:
    """One CSV line with every value in quotes, quotes doubled; null is an empty value."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in part files: the first holds the byte-order mark and the unquoted header, the others rows with every value quoted, so that the files in their order are one CSV."""
    head = df.sparkSession.createDataFrame([("\ufeff" + ",".join(df.columns),)], "value string").coalesce(1)
    head.union(df.select(csv_line([F.col(c) for c in df.columns]).alias("value"))).write.text(path)


def write_verified(df: DataFrame, path: str) -> int:
    """Writes Parquet, reads it back and compares number and hash of the rows; the number, or RuntimeError if they differ."""

    def digest(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns)), F.sum(F.xxhash64(*rows.columns) % 1_000_003)).first())

    df.write.parquet(path)
    meant, there = digest(df), digest(df.sparkSession.read.schema(df.schema).parquet(path))
    if meant != there:
        raise RuntimeError(f"{path}: {there} instead of {meant}")
    return there[0]


def markdown_report(title: Column, scores: dict[str, Column], sections: dict[str, Column]) -> Column:
    """A Markdown report: title, one line per score, and a list per section, with a placeholder for an empty one."""
    lines = [F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), F.lit("")]
    lines += [F.concat(F.lit(f"- {name}: "), F.coalesce(c.cast("string"), F.lit("-"))) for name, c in scores.items()]
    for name, items in sections.items():
        listed = F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit("")))), "\n")
        lines += [F.lit(""), F.lit(f"## {name}"), F.when(listed == "", F.lit("- none")).otherwise(listed)]
    return F.concat_ws("\n", *lines)


def script_safe(json_text: Column) -> Column:
    """JSON text that may stand inside a script element."""
    return F.replace(F.replace(F.replace(json_text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file below a folder, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_totals(files: DataFrame) -> DataFrame:
    """Number and size of the files of a manifest."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


# Kinds of nodes and edges an organisation graph may hold.
LABELS = ("Person", "Product", "Technology", "Company")
EDGES = ("FOUNDED_BY", "HAS_PRODUCT", "USES_TECH", "COMPETES_WITH")


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(company_id, problem, value): nodes of unknown label, blank or repeated name, edges of unknown type or with blank ends."""
    bad = F.when(~F.coalesce(F.col("type").isin(*LABELS), F.lit(False)), "label").when(F.trim(F.coalesce("name", F.lit(""))) == "", "blank name")
    a = nodes.select("company_id", bad.alias("problem"), F.coalesce("name", F.lit("")).alias("value")).where("problem is not null")
    named = nodes.select("company_id", F.trim(F.coalesce("name", F.lit(""))).alias("name")).where("name <> ''")
    b = named.groupBy("company_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("company_id", F.lit("repeated name").alias("problem"), F.col("name").alias("value"))
    kind = F.when(~F.coalesce(F.col("type").isin(*EDGES), F.lit(False)), "edge").when((F.trim(F.coalesce("src", F.lit(""))) == "") | (F.trim(F.coalesce("dst", F.lit(""))) == ""), "blank end")
    c = edges.select("company_id", kind.alias("problem"), F.coalesce("type", F.lit("")).alias("value")).where("problem is not null")
    return a.unionByName(b).unionByName(c)
