"""Seeded split assignment and its totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import split_bucket, split_of
from .registry import query, table

SEED = "7"
RATIOS = (("train", 8000), ("validation", 1000), ("test", 1000))

_BUCKET = "(('0x' || substr(sha256('spoorlake.split/v1' || chr(31) || '7' || chr(31) || source), 1, 16))::UBIGINT % 10000)::BIGINT"
_SPLIT = "CASE WHEN bucket < 8000 THEN 'train' WHEN bucket < 9000 THEN 'validation' ELSE 'test' END"


@query("split_assignment", f"SELECT doc_id, bucket, {_SPLIT} AS split FROM (SELECT doc_id, {_BUCKET} AS bucket FROM documents)")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bucket = split_bucket(SEED, F.col("source"))
    return docs.select("doc_id", bucket.alias("bucket"), split_of(bucket, RATIOS).alias("split"))


@query(
    "split_totals",
    f"""WITH s AS (SELECT lang, {_SPLIT} AS split FROM (SELECT lang, {_BUCKET} AS bucket FROM documents)),
    d AS (SELECT unnest(['train', 'validation', 'test']) AS split)
    SELECT d.split, count(s.lang) AS n_examples, count(DISTINCT s.lang) AS n_langs FROM d LEFT JOIN s ON s.split = d.split GROUP BY d.split""",
)
def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = split_of(split_bucket(SEED, F.col("source")), RATIOS)
    found = docs.groupBy(split.alias("split")).agg(F.count("lang").alias("n_examples"), F.countDistinct("lang").alias("n_langs"))
    domain = spark.createDataFrame([(s,) for s, _ in RATIOS], "split string")
    return domain.join(F.broadcast(found), "split", "left").na.fill(0)  # `found` has at most three rows
