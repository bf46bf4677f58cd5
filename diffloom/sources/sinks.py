"""Sinks: reviews as JSON and Markdown, recorded responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.operators.reports import to_json, to_markdown


def artifacts(reviews: DataFrame, findings: DataFrame, notes: DataFrame) -> DataFrame:
    """change_id, overall_risk, json, md from one result."""
    return reviews.select("change_id", "overall_risk").join(to_json(reviews), "change_id").join(to_markdown(reviews, findings, notes), "change_id")


def write_artifacts(arts: DataFrame, path: str) -> None:
    """Both renderings, partitioned by overall risk."""
    arts.write.mode("overwrite").partitionBy("overall_risk").parquet(path)


def write_parts(parts: DataFrame, path: str) -> None:
    """Artifacts in parts, a folder for each kind; files in order, and parts in order within each."""
    by = ("kind", "change_id", "part_no")
    parts.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("kind").parquet(path)


def write_json_lines(reviews: DataFrame, path: str) -> None:
    to_json(reviews).select("json").write.mode("overwrite").text(path)


def labelled(responses: DataFrame) -> DataFrame:
    """responses with the label they are recorded under: review-STEM, with the batch's number if there are several,
    or summary-STEM (S7). responses: stem, call, batch_no, n_batches."""
    number = F.when((F.col("call") == "review") & (F.col("n_batches") > 1), F.concat(F.lit("-"), (F.col("batch_no") + 1).cast("string"))).otherwise("")
    return responses.withColumn("label", F.concat("call", F.lit("-"), F.col("stem").cast("string"), number))
