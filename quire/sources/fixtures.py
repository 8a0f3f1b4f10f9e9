"""Views that present the driver's tables as ``files`` and ``changes``.

The documents view decorates plain prose with paths, comments, docstrings,
blank lines and missing final newlines, so every cleaning and ignore rule has
something to act on.  The same SQL text runs in the DuckDB oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_SQL = """concat(
  CASE doc_id % 11 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/core/' WHEN 2 THEN 'lib/'
    WHEN 3 THEN 'tests/unit/' WHEN 4 THEN 'docs/' WHEN 5 THEN 'node_modules/dep/'
    WHEN 6 THEN 'config/' WHEN 7 THEN 'build/out/' WHEN 8 THEN 'assets/' ELSE '' END,
  CASE WHEN doc_id % 29 = 0 THEN 'README' WHEN doc_id % 17 = 0 THEN 'index'
       WHEN doc_id % 23 = 0 THEN 'main' ELSE 'f' END,
  CASE WHEN doc_id % 29 = 0 OR doc_id % 17 = 0 OR doc_id % 23 = 0 THEN ''
       ELSE CAST(doc_id AS VARCHAR(20)) END,
  CASE doc_id % 13 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.md'
    WHEN 4 THEN '.json' WHEN 5 THEN '.png' WHEN 6 THEN '.log' WHEN 7 THEN '.yaml'
    WHEN 8 THEN '.css' WHEN 9 THEN '.go' WHEN 10 THEN '' WHEN 11 THEN '.min.js'
    ELSE '.JS' END)"""

CONTENT_SQL = """concat(
  CASE WHEN doc_id % 13 IN (0,1,9,12)
         THEN concat('// head ', CAST(doc_id AS VARCHAR(20)), chr(10), '/* block', chr(10), ' note */', chr(10))
       WHEN doc_id % 13 IN (2,7)
         THEN concat('#!/bin/x', chr(10), 'k = 1  # note', chr(10), '\"\"\"doc', chr(10), 'string\"\"\"', chr(10))
       ELSE '' END,
  text, chr(10), chr(10), '  tail   of    file',
  CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END)"""

# Per-corpus rule file derived from the corpus's own rows (used by the
# per-corpus ignore query): patterns chosen by the smallest doc id.
RULES_CONTENT_SQL = """concat('# rules', chr(10),
  CASE min(doc_id) % 3 WHEN 0 THEN 'docs' WHEN 1 THEN 'lib' ELSE 'config' END, chr(10),
  '  ', CASE min(doc_id) % 4 WHEN 0 THEN '*.md' WHEN 1 THEN '*.css' WHEN 2 THEN '*.yaml' ELSE '*.go' END, chr(10),
  chr(10), 'f', CAST(min(doc_id) % 10 AS VARCHAR(5)), '*', chr(10))"""


# A second rule file, with patterns of its own.
MORE_RULES_SQL = "concat('assets', chr(10), '# note', chr(10), '*.js', chr(10), CAST(max(doc_id) % 7 AS VARCHAR(5)), '1', chr(10))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return (d.selectExpr("source AS corpus_id", "doc_id", f"{PATH_SQL} AS path", f"{CONTENT_SQL} AS content")
            .withColumn("size", F.octet_length("content").cast("long")))


def files_docs_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files_docs`` plus one ``.gitignore`` per corpus derived from its rows."""
    return files_docs(spark, sf_dir).unionByName(_rule_file(spark, sf_dir, ".gitignore", RULES_CONTENT_SQL))


def files_docs_with_both_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a ``.ctxignore`` beside it."""
    return files_docs_with_rules(spark, sf_dir).unionByName(_rule_file(spark, sf_dir, ".ctxignore", MORE_RULES_SQL))


def _rule_file(spark: SparkSession, sf_dir: str, name: str, content_sql: str) -> DataFrame:
    return (table(spark, sf_dir, "documents").groupBy(F.col("source").alias("corpus_id"))
            .agg(F.expr(content_sql).alias("content"))
            .select("corpus_id", F.lit(None).cast("long").alias("doc_id"), F.lit(name).alias("path"),
                    "content", F.octet_length("content").cast("long").alias("size")))


def files_docs_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files_docs`` in which a twentieth of the corpora's rows have no corpus
    name, a ninth stand twice and a fifteenth a second time with more text."""
    d = files_docs(spark, sf_dir).withColumn("corpus_id", F.when(F.col("doc_id") % 20 != 3, F.col("corpus_id")))
    longer = d.where("doc_id % 15 = 1").withColumn("content", F.concat("content", F.lit("\nmore\n"))).withColumn("size", F.octet_length("content").cast("long"))
    return d.unionByName(d.where("doc_id % 9 = 2")).unionByName(longer)


def files_docs_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each top folder of a source as a corpus of its own, so that some
    corpora hold ignored files alone."""
    d = files_docs(spark, sf_dir)
    return d.withColumn("corpus_id", F.concat("corpus_id", F.lit(":"), F.regexp_extract("path", "^([^/]*)", 1)))


def files_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return (p.selectExpr("regexp_extract(url, 'https?://([^/?]+)', 1) AS corpus_id",
                         "concat('p/', CAST(page_id AS VARCHAR(20)), '.html') AS path",
                         "html AS content")
            .withColumn("size", F.octet_length("content").cast("long")))


def files_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return (c.selectExpr("CAST(conv_id AS VARCHAR(20)) AS corpus_id",
                         "concat(lpad(CAST(turn AS VARCHAR(10)), 3, '0'), '_', role, '.txt') AS path",
                         "text AS content")
            .withColumn("size", F.octet_length("content").cast("long")))


def changes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return changes_from_events(e)


def changes_from_events(e: DataFrame) -> DataFrame:
    return (e.selectExpr(
        "CAST(user_id AS VARCHAR(20)) AS corpus_id",
        "concat('src/', event_type, '_', CAST(event_id % 7 AS VARCHAR(2)), '.js') AS path",
        "CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS op",
        "ts", "event_id AS seq", "props AS content")
        .withColumn("size", F.octet_length("content").cast("long")))


def events_in_order(spark: SparkSession, sf_dir: str, path: str, files: int, after: list[str]) -> str:
    """The events as ``files`` folders of rows that follow each other in time,
    written one after the other, then a marker event each of the intervals
    ``after`` after the last.  Returns a pattern of the folders for a stream."""
    import time
    e = table(spark, sf_dir, "events")
    cuts = e.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / files for i in range(1, files)] or [0.5], 1000)).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    part = F.lit(0)
    for c in (cuts if files > 1 else []):
        part = part + (at > c).cast("int")
    for i in range(files):
        e.where(part == i).write.parquet(f"{path}/{i:03d}")
        time.sleep(0.02)                   # the stream takes files by their time
    last = e.agg(F.max("ts").alias("ts"))
    for i, interval in enumerate(after, files):
        marker = last.select(*[(F.col("ts") + F.expr(f"INTERVAL {interval}")).cast(f.dataType).alias("ts") if f.name == "ts"
                               else F.lit(-1).cast(f.dataType).alias(f.name) if f.name in ("user_id", "event_id")
                               else F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema.fields])
        marker.write.parquet(f"{path}/{i:03d}")
        time.sleep(0.02)
    return f"{path}/*"


def files_docs_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files_docs`` as it may have been: a tenth of the files are not there
    yet, another tenth have other text, and each eighth also stands under an old name."""
    d = files_docs(spark, sf_dir).where("doc_id % 10 <> 4")
    d = d.withColumn("content", F.when(F.col("doc_id") % 10 == 7, F.concat("content", F.lit("old\n"))).otherwise(F.col("content")))
    old = d.where("doc_id % 8 = 1").withColumn("path", F.concat(F.lit("old/"), "path"))
    return d.unionByName(old).withColumn("size", F.octet_length("content").cast("long"))
