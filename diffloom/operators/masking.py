"""Secrets become typed placeholders (M1-M6). Detectors run in order, the specific ones first; a placeholder matches none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffloom.functions.text import strip

#: The kinds of placeholder.
PLACEHOLDER = r"\[MASKED_[A-Z_]*\]"
#: Bits a character from which a quoted literal counts as random.
HEX_BITS, BASE64_BITS = 3.0, 4.5
#: In order: what is matched, and what stands for it.
DETECTORS = (
    (r"\b(AKIA|ASIA)[A-Z0-9]{16}\b", "[MASKED_AWS_KEY]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[MASKED_PRIVATE_KEY]"),
    (r"(?i)\b[a-z][a-z0-9+]*://[^\s:/@'\"]+:[^\s@'\"]+@[^\s'\"]+", "[MASKED_DB_URL]"),
    (r"\b(gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})", "[MASKED_TOKEN]"),
)
#: A literal, up to its own closing quote, with or without a prefix letter; not one that is a placeholder already.
_VALUE = r"['\"]?\s*[:=]\s*[bfru]{0,2})(['\"])(?!\[MASKED_[A-Z_]*\]\2)(?:\\.|(?!\2)[^\\]){4,}\2"
#: A literal assigned to a name that says it is a secret: TOKEN if the name says token, else KEY.
TOKEN_NAME = r"(?i)(\b[a-z0-9_]*token[a-z0-9_]*" + _VALUE
KEY_NAME = r"(?i)(\b(?:[a-z0-9_]*(?:password|passwd|passphrase|pwd|secret|key)[a-z0-9_]*|(?:[a-z0-9_]*_)?pass)" + _VALUE
LITERAL = r"['\"]([A-Za-z0-9+/=_-]{20,})['\"]"
#: The first and last line of a private key, and what a line between them looks like.
KEY_BEGINS, KEY_ENDS = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
KEY_BODY = r"^\s*['\"]?(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{2,}={1,2}|Proc-Type: .*|DEK-Info: .*)(?:\\n)?['\"]?[,+\\]?\s*$"


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character of a string (built-in functions only)."""
    chars = F.split(c, "")
    chars = F.filter(chars, lambda x: x != "")
    n = F.size(chars)
    share = lambda x: (n - F.size(F.filter(chars, lambda y: y != x))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))


def _random(c: Column) -> Column:
    hexadecimal = c.rlike("^[0-9a-fA-F]+$")
    return (hexadecimal & (entropy(c) >= HEX_BITS)) | (~hexadecimal & c.rlike("[0-9]") & (entropy(c) >= BASE64_BITS))


#: No detector matches a text without one of these; most lines have none and are left alone after one look.
MAYBE = r"['\"]|://|-----BEGIN|AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ"


def _typed(c: Column) -> Column:
    """The named detectors, in order (M1)."""
    out = c
    for pattern, to in DETECTORS:
        out = F.regexp_replace(out, pattern, to)
    out = F.regexp_replace(out, TOKEN_NAME, "$1$2[MASKED_TOKEN]$2")
    out = F.regexp_replace(out, KEY_NAME, "$1$2[MASKED_KEY]$2")
    return F.when(c.rlike(MAYBE), out).otherwise(c)


def _untyped(c: Column) -> Column:
    """Random literals (M2): few lines have a candidate at all, and only those are looked at."""
    found = F.filter(F.regexp_extract_all(c, F.lit(LITERAL), F.lit(1)), _random)
    return F.when(c.rlike(LITERAL), F.aggregate(found, c, lambda a, x: F.replace(a, x, F.lit("[MASKED_KEY]")))).otherwise(c)


def without_placeholders(c: Column) -> Column:
    """M6: the words in placeholders are no evidence."""
    return F.regexp_replace(c, PLACEHOLDER, "")


def mask(c: Column) -> Column:
    """The text with every secret value replaced (M1, M2)."""
    return _untyped(_typed(c))


def mask_lines(lines: DataFrame) -> DataFrame:
    """diff_lines with masked content; `masked` says whether it changed, `typed` whether a named detector did it. Lines keep their
    numbers (M1).

    The body of a private key is masked too, from its first line to its last as far as the hunk shows them; it belongs to the secret of its first
    line, so `masked` stays false. Lines that are in no hunk stand for themselves.
    """
    out = lines
    if "hunk_no" in lines.columns:
        w = W.partitionBy("change_id", "file_no", "hunk_no").orderBy("line_idx")
        marker = F.when(F.col("content").rlike(KEY_BEGINS), 1).when(F.col("content").rlike(KEY_ENDS), 0)
        before = F.last(marker, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        hunk = W.partitionBy("change_id", "file_no", "hunk_no")
        first_end, first_begin = (F.min(F.when(marker == m, F.col("line_idx"))).over(hunk) for m in (0, 1))
        # a hunk that begins within a key: its first marker is an end
        tail = before.isNull() & (F.col("line_idx") < first_end) & F.coalesce(first_end < first_begin, F.lit(True))
        ends_next = F.lead(marker).over(w) == 0
        body = ((before == 1) | tail) & marker.isNull() & (F.col("content").rlike(KEY_BODY) | F.coalesce(ends_next & F.col("content").rlike(r"^\s*['\"]?[A-Za-z0-9+/=]+"), F.lit(False)))
        out = out.withColumn("_body", F.coalesce(body, F.lit(False)))
    else:
        out = out.withColumn("_body", F.lit(False))
    out = out.withColumn("_t", _typed(F.col("content"))).withColumn("typed", F.col("_t") != F.col("content"))  # steps of their own, so that each is worked out once
    out = out.withColumn("_m", _untyped(F.col("_t"))).withColumn("masked", ~F.col("_body") & (F.col("_m") != F.col("content"))).withColumn("typed", ~F.col("_body") & F.col("typed"))
    return out.withColumn("content", F.when(F.col("_body"), "[MASKED_PRIVATE_KEY]").otherwise(F.col("_m"))).drop("_t", "_m", "_body")


def path_signal(path: Column) -> Column:
    """test or src (M3)."""
    return F.when(path.rlike(r"(^|/)tests?/|(^|/)fixtures/|(^|/)test_[^/]*$|(^|/)conftest\.py$|_test\.[^/.]+$"), "test").otherwise("src")


def secret_evidence() -> Column:
    """What a masked line shows: the variable, the kinds of its placeholders in order, the masked text."""
    kind = F.array_join(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[(MASKED_[A-Z_]*)\]"), F.lit(1))), ", ")
    name = F.regexp_extract("content", r"([A-Za-z_][A-Za-z0-9_.]*)['\"]?\s*[:=]", 1)
    return F.concat(F.lit("Secret value "), F.when(name != "", F.concat(F.lit("in `"), name, F.lit("` "))).otherwise(""), F.lit("replaced by ["), kind, F.lit("]: `"), strip(F.col("content")), F.lit("`"))


SECRET_RISK = "A credential in source code is readable by everyone with access to the repository and its history."
SECRET_RECOMMENDATION = "Rotate the credential and load it from a secret store."


def secret_severity() -> Column:
    return F.when(path_signal(F.col("path")) == "test", "low").otherwise("high")


def secret_confidence() -> Column:
    """By detector (M4): high for a named one, medium where entropy alone speaks."""
    return F.when(F.col("typed"), "high").otherwise("medium")


def masked_line_count(masked: DataFrame) -> DataFrame:
    """change_id, masked_lines (M5)."""
    return masked.groupBy("change_id").agg(F.count_if("masked").alias("masked_lines"))
