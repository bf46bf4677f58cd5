"""Check model findings against the change, cap, merge with the rules' findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffloom.functions.text import rank, unrank


def known_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of files that the change has (V1)."""
    paths = files.select("change_id", F.col("path").alias("file")).distinct()
    return findings.join(paths, ["change_id", "file"], "left_semi")


def unknown_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    paths = files.select("change_id", F.col("path").alias("file")).distinct()
    return findings.join(paths, ["change_id", "file"], "left_anti")


def mapped_lines(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Lines that the file didn't add become null; `unmapped` says which (V2). added: change_id, path, line_no.

    A line may be a long before; after it, it is a line that the file has. The findings' (change, path) pairs, few against the lines, first cut the lines down by a semi join.
    """
    wanted = findings.where("line IS NOT NULL").select("change_id", F.col("file").alias("path")).distinct()
    few = added.join(wanted, ["change_id", "path"], "left_semi").select("change_id", F.col("path").alias("file"), F.col("line_no").alias("line"), F.lit(True).alias("_hit"))
    joined = findings.join(few, ["change_id", "file", "line"], "left")
    return joined.withColumn("unmapped", F.col("line").isNotNull() & F.col("_hit").isNull()).withColumn("line", F.when(F.col("_hit"), F.col("line")).cast("int")).drop("_hit")


def validation_stats(findings: DataFrame, files: DataFrame, added: DataFrame) -> DataFrame:
    """change_id, unmappable_count, hallucinated_file_count and what they count, sorted (V3).

    One pass: a finding carries along whether the change has its file; one whose file it hasn't is on no added line either.
    """
    paths = files.select("change_id", F.col("path").alias("file")).distinct().withColumn("_known", F.lit(True))
    told = mapped_lines(findings.select("change_id", "file", "line", F.col("line").alias("_line")).join(paths, ["change_id", "file"], "left"), added)
    u = F.when(F.col("_known") & F.col("unmapped"), F.concat("file", F.lit(":"), F.col("_line").cast("string")))
    told = told.select("change_id", u.alias("u"), F.when(F.col("_known").isNull(), F.col("file")).alias("h"))
    return told.groupBy("change_id").agg(F.count("u").alias("unmappable_count"), F.count("h").alias("hallucinated_file_count"), F.array_sort(F.collect_list("u")).alias("unmappable_lines"), F.array_sort(F.collect_list("h")).alias("hallucinated_files"))


def capped(findings: DataFrame, packed: DataFrame) -> DataFrame:
    """Confidence at most medium for files that were split in the finding's batch (V4). packed: change_id, batch_no, path, capped."""
    split = packed.where("capped").select("change_id", "batch_no", F.col("path").alias("file")).distinct().withColumn("_cap", F.lit(1))
    f = findings.withColumn("batch_no", F.col("seq.batch_no")).join(split, ["change_id", "batch_no", "file"], "left")
    return f.withColumn("confidence", unrank(F.least(rank(F.col("confidence")), F.coalesce(F.col("_cap"), F.lit(2))))).drop("_cap", "batch_no")


KEY = ["change_id", "file", "line", "category"]


def strongest(findings: DataFrame) -> DataFrame:
    """One finding for each key: the highest confidence, the earliest on ties (V5, V6). A null line is a key of its own."""
    w = W.partitionBy(*KEY).orderBy(rank(F.col("confidence")).desc(), "seq")
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Both detectors' findings, one for each key (V5-V7).

    Where both have the key: confidence high, source both, the higher severity, risk and recommendation of the model's first
    finding, evidence and rule of the rule's.
    """
    d = strongest(rules).select(*(F.col(c).alias(f"d_{c}") for c in (*KEY, "severity", "confidence", "evidence", "risk", "recommendation", "rule_id")))
    w = W.partitionBy(*KEY)
    best = model.withColumn("_n", F.row_number().over(w.orderBy(rank(F.col("confidence")).desc(), "seq"))).withColumn("_first", F.first(F.struct("severity", "risk", "recommendation")).over(w.orderBy("seq")))
    # over a running frame the first row is the same for all rows of the key
    m = best.where("_n = 1").select(*(F.col(c).alias(f"m_{c}") for c in (*KEY, "severity", "confidence", "evidence", "risk", "recommendation")), "_first")
    on = (F.col("d_change_id") == F.col("m_change_id")) & (F.col("d_file") == F.col("m_file")) & (F.col("d_category") == F.col("m_category")) & F.col("d_line").eqNullSafe(F.col("m_line"))
    j = d.join(m, on, "full_outer")
    only_d, only_m = F.col("m_file").isNull(), F.col("d_file").isNull()
    pick = lambda c, both: F.when(only_d, F.col(f"d_{c}")).when(only_m, F.col(f"m_{c}")).otherwise(both)
    return j.select(
        *(F.coalesce(f"d_{c}", f"m_{c}").alias(c) for c in KEY),
        pick("severity", unrank(F.greatest(rank(F.col("d_severity")), rank(F.col("_first.severity"))))).alias("severity"),
        pick("confidence", F.lit("high")).alias("confidence"),
        pick("evidence", F.col("d_evidence")).alias("evidence"),
        pick("risk", F.col("_first.risk")).alias("risk"),
        pick("recommendation", F.col("_first.recommendation")).alias("recommendation"),
        F.when(only_d, "deterministic").when(only_m, "llm").otherwise("both").alias("source"),
        F.col("d_rule_id").alias("rule_id"),
    )


def ordered(findings: DataFrame) -> DataFrame:
    """By change, file, line (null first), category (V8)."""
    return findings.orderBy("change_id", "file", F.coalesce("line", F.lit(-1)), "category")


def overall_risk(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """change_id, overall_risk: the highest severity, low without findings."""
    top = findings.groupBy("change_id").agg(F.max(rank(F.col("severity"))).alias("_r"))
    return changes.select("change_id").join(top, "change_id", "left").select("change_id", unrank(F.coalesce("_r", F.lit(0))).alias("overall_risk"))
