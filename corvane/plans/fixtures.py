"""Views of the stored tables under the engine's own names, for the queries and their oracles.

item = document, family = source, host = language; two models' scores are hash-based with two decimals, so ties occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.scalar import stable_bucket
from corvane.session import table


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("source").alias("family"), F.col("lang").alias("host"), "n_chars")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: item_id, label_id, y."""
    wide = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")
    return wide.unpivot("item_id", ["quality", "toxic"], "label_id", "y")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, label_id, y, base, context, family, host."""
    key = lambda m: F.concat_ws("|", F.col("item_id").cast("string"), "label_id", F.lit(m))
    value = lambda a, b, m: F.floor((a * F.col("y") + b * stable_bucket(key(m))) / 10000) / 100.0
    out = truth(spark, sf).withColumn("base", value(350000, 65, "base")).withColumn("context", value(450000, 55, "context"))
    return out.join(items(spark, sf).select("item_id", "family", "host"), "item_id")


def bucket_sql(key: str, n: int = 10000) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT % {n})::BIGINT"


ITEMS = "items AS (SELECT doc_id AS item_id, text, source AS family, lang AS host, n_chars FROM documents)"
TRUTH = "truth AS (SELECT doc_id AS item_id, 'quality' AS label_id, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"
SCORES = (
    f"{ITEMS}, {TRUTH}, scores AS (SELECT t.item_id, label_id, y, "
    f"floor((350000 * y + 65 * {bucket_sql("t.item_id::VARCHAR || '|' || label_id || '|base'")}) / 10000) / 100.0 AS base, "
    f"floor((450000 * y + 55 * {bucket_sql("t.item_id::VARCHAR || '|' || label_id || '|context'")}) / 10000) / 100.0 AS context, "
    "family, host FROM truth t JOIN items USING (item_id))"
)


def split_sql(seed: int, scheme: str, key: str) -> str:
    b = bucket_sql(f"'{seed}|{scheme}|' || {key}::VARCHAR")
    return f"CASE WHEN {b} < 8000 THEN 'train' WHEN {b} < 9000 THEN 'val' ELSE 'test' END"


SPLIT_ITEMS = f"{ITEMS}, split_items AS (SELECT *, {split_sql(42, 'family', 'family')} AS split, {split_sql(42, 'item', 'item_id')} AS item_split FROM items)"
