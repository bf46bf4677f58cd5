"""Model responses: framing, strict contract, one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.functions.text import CATEGORIES, RANKS, strip

REVIEW_KEYS = ("file", "line", "category", "severity", "confidence", "evidence", "risk", "recommendation")
TEXT_KEYS = tuple(k for k in REVIEW_KEYS if k != "line")
SUMMARY_KEYS = ("summary", "overall_risk", "pr_comment")
#: The model may report all categories but the masker's.
MODEL_CATEGORIES = tuple(c for c in CATEGORIES if c != "hardcoded_secrets")


def strip_code_fence(c: Column) -> Column:
    """The text inside one code fence, if it starts with one and its last line starts with one; else the text."""
    fence = r"(?s)^```[^\n]*\n(.*?)\n?[ \t]*```[^\n]*$"
    return F.when(c.startswith("```") & c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c)


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _kind(value: str, key: str) -> str:
    return f"schema_of_variant(try_variant_get({value}, '$.{key}', 'variant'))"


def _only(value: str, allowed) -> str:
    return f"size(array_except(map_keys(try_variant_get({value}, '$', 'map<string,variant>')), array({_in(allowed)}))) = 0"


def _text(value: str, key: str) -> str:
    return f"try_variant_get({value}, '$.{key}', 'string')"


#: The line of a finding f as a whole number: integers, whole floats, booleans, and strings of either. Null if there is none or it is none.
_KIND_OF_LINE = "coalesce(schema_of_variant(try_variant_get(f, '$.line', 'variant')), 'VOID')"
_NUMBER = "try_variant_get(f, '$.line', 'double')"
_WHOLE = r"rlike(try_variant_get(f, '$.line', 'string'), '^\\s*[+-]?[0-9]+([.]0+)?\\s*$')"
_GOOD_LINE = f"({_KIND_OF_LINE} IN ('VOID', 'BIGINT', 'BOOLEAN') OR (({_KIND_OF_LINE} LIKE 'DECIMAL%' OR {_KIND_OF_LINE} IN ('DOUBLE', 'FLOAT')) AND (abs({_NUMBER}) >= 1e18 OR {_NUMBER} = floor({_NUMBER}))) OR ({_KIND_OF_LINE} = 'STRING' AND {_WHOLE}))"
#: Beyond a long it is the largest or smallest one: no diff has such a line, whichever it is.
_LINE = f"""CASE WHEN {_KIND_OF_LINE} = 'VOID' THEN CAST(NULL AS BIGINT) WHEN {_KIND_OF_LINE} = 'BOOLEAN' THEN CAST(try_variant_get(f, '$.line', 'boolean') AS BIGINT)
  ELSE coalesce(try_cast(CASE WHEN {_KIND_OF_LINE} = 'STRING' THEN regexp_replace(trim(try_variant_get(f, '$.line', 'string')), '[.]0+$', '') END AS BIGINT), try_variant_get(f, '$.line', 'bigint'), CASE WHEN {_NUMBER} < 0 THEN -9223372036854775808L ELSE 9223372036854775807L END) END"""


def _once(value: str, name: str, result: str) -> str:
    """SQL of result, in which name stands for value. A filter on a column is pushed below the step that makes it and takes a copy of the
    column's expression for each mention; a bound value is worked out once however often it is mentioned."""
    return f"element_at(transform(array({value}), {name} -> {result}), 1)"


_OBJECT = _once("try_parse_json(_text)", "v", "CASE WHEN schema_of_variant(v) LIKE 'OBJECT<%' THEN v END")


def decode(responses: DataFrame) -> DataFrame:
    """responses(call, response, ...) with `doc` (variant, null if it is no JSON object)."""
    text = strip_code_fence(strip(F.col("response")))
    # of a repeated key the last one counts, as in most decoders; plans read the setting when they run, so it stays
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return responses.withColumn("_text", text).withColumn("doc", F.expr(_OBJECT)).drop("_text")


def check(responses: DataFrame) -> DataFrame:
    """decoded responses with `valid` and `error` (J3, J4, J6). One bad finding fails the response; the raw text stays.

    Lines may be whole floats, booleans, and strings of whole numbers; of repeated keys the last one counts.
    """
    f = "f"
    good = " AND ".join(
        [
            f"coalesce(schema_of_variant(f) LIKE 'OBJECT<%', false)",
            f"coalesce({_only(f, REVIEW_KEYS)}, false)",
            *(f"coalesce({_kind(f, k)} = 'STRING', false)" for k in TEXT_KEYS),
            f"coalesce({_text(f, 'category')} IN ({_in(MODEL_CATEGORIES)}), false)",
            f"coalesce({_text(f, 'severity')} IN ({_in(RANKS)}), false)",
            f"coalesce({_text(f, 'confidence')} IN ({_in(RANKS)}), false)",
            _GOOD_LINE,
        ]
    )
    kind = _kind("doc", "findings")
    review = f"""CASE WHEN doc IS NULL THEN 'not a JSON object' WHEN NOT {_only('doc', ['findings'])} THEN 'unknown key'
        WHEN {kind} IS NULL THEN NULL WHEN NOT {kind} LIKE 'ARRAY<%' THEN 'findings is no list'
        WHEN NOT forall(try_variant_get(doc, '$.findings', 'array<variant>'), f -> {good}) THEN 'bad finding' END"""
    summary = f"""CASE WHEN doc IS NULL THEN 'not a JSON object' WHEN NOT {_only('doc', SUMMARY_KEYS)} THEN 'unknown key'
        WHEN NOT ({' AND '.join(f"coalesce({_kind('doc', k)} = 'STRING', false)" for k in SUMMARY_KEYS)}) THEN 'bad or missing key'
        WHEN NOT coalesce({_text('doc', 'overall_risk')} IN ({_in(RANKS)}), false) THEN 'bad risk' END"""
    checked = _once("doc", "doc", f"named_struct('doc', doc, 'error', CASE WHEN call = 'summary' THEN {summary} ELSE {review} END)")
    c = decode(responses).withColumn("_c", F.expr(checked))
    return c.withColumn("doc", F.col("_c.doc")).withColumn("error", F.col("_c.error")).withColumn("valid", F.col("_c.error").isNull()).drop("_c")


def model_findings(checked: DataFrame) -> DataFrame:
    """One row for each finding of the valid review responses, in response order: seq = (batch_no, pos) (J5). line is a long here: one that no
    file can have is still told apart from none (V2)."""
    # of other responses nothing is exploded: a filter on `valid` would be pushed below the check and check every response twice
    listed = F.expr("CASE WHEN valid THEN coalesce(try_variant_get(doc, '$.findings', 'array<variant>'), array()) END")
    rows = checked.where("call = 'review'").select("change_id", "batch_no", F.posexplode_outer(listed).alias("pos", "f")).where("pos IS NOT NULL")
    return rows.select("change_id", *(F.expr(_text("f", k)).alias(k) for k in ("file",)), F.expr(_LINE).alias("line"), *(F.expr(_text("f", k)).alias(k) for k in TEXT_KEYS if k != "file"), F.lit("llm").alias("source"), F.struct("batch_no", "pos").alias("seq"))


def summaries(checked: DataFrame) -> DataFrame:
    return checked.where("valid AND call = 'summary'").select("change_id", *(F.expr(_text("doc", k)).alias(k) for k in SUMMARY_KEYS))


def attached(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requests with the response of their key; a request without one has a null response: its call failed.

    Equal requests share a key and a response; of several responses to a key the least text counts.
    """
    columns = [c for c in answers.columns if c != "prompt_key"]
    one = answers.groupBy("prompt_key").agg(F.min(F.struct("response", *(c for c in columns if c != "response"))).alias("a"))
    return requests.join(one, "prompt_key", "left").select(*requests.columns, *(F.col(f"a.{c}").alias(c) for c in columns))
