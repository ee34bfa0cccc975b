"""Inputs that the catalogue's queries share, in Spark and in DuckDB.

The test tables hold no Han characters, so documents with an even id get some in place of vowels, by the
same call in both engines. ``lines`` are a document's lines that aren't blank: its nodes, regions or segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import budget

HAN_FOR_VOWELS = ("aeiou", "的一是不了")
#: One identifier of each kind, which the test tables lack.
SAMPLES = " See https://example.com/x?q=1 or www.example.org/a then a.b@mail.com has ABC-12345 over USB-C on Windows 11 at 10.2.3 by 15 mm of AB 1234 end"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

DOCS_SQL = "d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeiou', '的一是不了') ELSE text END AS t FROM documents)"
LINES_SQL = DOCS_SQL + """,
 r AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS pos FROM d),
 l AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, CAST(greatest(1, (length(line) + 1) // 2) AS BIGINT) AS tokens FROM r WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '')"""
MARKED_SQL = f"m AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN '{SAMPLES}' ELSE '' END AS t FROM documents)"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer splits than there are (small inputs); else as it is."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t."""
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", *HAN_FOR_VOWELS)).otherwise(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.alias("t"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, pos (among all lines, from 1), seq (among these, from 1), tokens. Numbered inside the row, without a shuffle."""
    all_lines = F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(x.alias("line"), (i + 1).cast("long").alias("pos")))
    kept = F.filter(all_lines, lambda x: ~x["line"].rlike(r"^\s*\z"))
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(kept).alias("seq", "x"))
    return rows.select("doc_id", "x.line", "x.pos", (F.col("seq") + 1).cast("long").alias("seq"), budget.measure(F.col("x.line")).alias("tokens"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: the documents as they are, every fifth with the samples after it."""
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, SAMPLES).otherwise(""))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.alias("t"))


def by_doc(*order: str) -> W:
    return W.partitionBy("doc_id").orderBy(*order)
