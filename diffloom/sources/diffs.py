"""Sources: diffs from files or tables, recorded responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators.scans import laid_out, scanned


def read_diffs(spark: SparkSession, path: str, glob: str = "*.diff") -> DataFrame:
    """changes(change_id, diff_text, decodable): one change for each file, named by the file.

    Bytes that are no UTF-8 give a null text and decodable = false: a parse error later on, no crash.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return decoded(raw.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("change_id"), "content"))


def decoded(raw: DataFrame) -> DataFrame:
    """raw(change_id, content binary) as changes."""
    text = F.col("content").cast("string")
    ok = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    return raw.select("change_id", F.when(ok, text).alias("diff_text"), ok.alias("decodable"))


def read_diff_lines(spark: SparkSession, path: str, glob: str = "*.diff") -> DataFrame:
    """line_rows(change_id, pos, raw) of files of any size (S1): a file is read in blocks by many tasks, its lines numbered across them.

    For operators.longdiffs. A line that is no UTF-8 is null, which makes its change a parse error (S2).
    """
    raw = spark.read.format("text").option("lineSep", "\n").option("pathGlobFilter", glob).load(path)
    rows = raw.select(F.regexp_extract("_metadata.file_name", r"^(.+?)(?:\.[^./]*)?$", 1).alias("change_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.when(F.is_valid_utf8("value"), F.col("value")).alias("raw"))
    laid = laid_out(rows, ["change_id"], ["file", "block", "id"])
    return scanned(laid, ["change_id"], sums={"pos": F.lit(1).cast("long")}).select("change_id", (F.col("pos") - 1).alias("pos"), "raw")


def from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """changes from any table with a text column."""
    return df.select(F.col(id_col).alias("change_id"), F.col(text_col).cast("string").alias("diff_text"), F.col(text_col).isNotNull().alias("decodable"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """responses(label, response): one recorded response for each file, named by its label (S3)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("label"), F.col("value").alias("response"))


def read_response_table(spark: SparkSession, path: str) -> DataFrame:
    """responses(label, response) of a table of recorded responses: the form for many, where a file each would be too small (S3)."""
    return spark.read.schema("label string, response string").parquet(path)
