"""JSON-lines and whole-file sources with diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROW_BYTES = 64 << 20


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """``path, line, value`` of ``path, content``; lines count from 1, a final empty line isn't one."""
    cut = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("p", "value"), F.size(F.split("content", r"\r?\n")).alias("n"))
    return cut.where(~((F.col("p") == F.col("n") - 1) & (F.trim("value") == ""))).select("path", (F.col("p") + 1).cast("long").alias("line"), "value")


def line_code(value: Column) -> Column:
    """``ok``, ``empty_line``, ``invalid_json`` or ``non_object``."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    return F.when(F.trim(value) == "", "empty_line").when(parsed.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "non_object").otherwise("ok")


def parse_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (``path, line, value``) and diagnostics (``path, line, code``)."""
    coded = lines(files).withColumn("code", line_code(F.col("value")))
    return coded.where("code = 'ok'").drop("code"), coded.where("code <> 'ok'").select("path", "line", "code")


def strict_json(spark: SparkSession, path: str, schema: str, max_row_bytes: int = MAX_ROW_BYTES) -> DataFrame:
    """Rows of a declared schema; a malformed row or one beyond the row cap fails the read."""
    raw = spark.read.text(path)
    fits = F.assert_true(F.octet_length("value") <= max_row_bytes, F.lit("a row is beyond the row cap"))
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return raw.where(fits.isNull()).select(parsed.alias("r")).select("r.*")


def with_row_limit(rows: DataFrame, limit: int) -> DataFrame:
    """``rows``, failing when there are more than ``limit``: a guard, not a cut."""
    n = rows.agg(F.count("*").alias("n"))
    checked = n.select(F.assert_true(F.col("n") <= limit, F.lit(f"more than {limit} rows")).alias("ok"))
    return rows.join(F.broadcast(checked)).where("ok IS NULL").drop("ok")  # one row


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of every file, for checksums."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")
