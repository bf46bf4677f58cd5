"""Diff text to tables: file sections, hunks, numbered lines, parse status.

changes(change_id, diff_text) is split with built-in functions only: `posexplode` of regex splits at markers that no hunk
content can hold (content always has a prefix), then running counts per hunk. All windows are per hunk, so a change
that holds most lines of a table is still spread over its hunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?([^\n]*)"


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern doesn't match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _bare(path: Column) -> Column:
    """Without git's a/ or b/."""
    return F.regexp_replace(path, "^[ab]/", "")


def _sections(changes: DataFrame) -> DataFrame:
    """One row per file section; element 0 of the split is what stands before the first one."""
    text = F.regexp_replace(F.coalesce("diff_text", F.lit("")), r"\n\z", "")  # the last line's end begins no line
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=diff --git )")
    return changes.select("change_id", F.posexplode(parts).alias("n", "section")).where("n > 0").select("change_id", (F.col("n") - 1).alias("file_no"), "section")


def split_files(changes: DataFrame) -> DataFrame:
    """diff_files: one row per file section with its paths and flags."""
    return _described(changes).drop("section")


def _described(changes: DataFrame) -> DataFrame:
    s = _sections(changes).withColumn("head", F.regexp_extract("section", r"(?s)^(.*?)(?:\n@@ -|\z)", 1))
    return s.select("change_id", "file_no", *file_columns(F.col("head")), "section")


def file_columns(head: Column) -> list[Column]:
    """Paths and flags from a file's header lines."""
    git = r"^diff --git (?:a/)?(.+?) (?:b/)?(\S+)\s*(?:\n|$)"
    old = F.coalesce(_first(head, r"(?m)^--- ([^\t\n\r]+)"), _first(head, r"(?m)^rename from ([^\n\r]+)"), F.concat(F.lit("a/"), _first(head, git, 1)))
    new = F.coalesce(_first(head, r"(?m)^\+\+\+ ([^\t\n\r]+)"), _first(head, r"(?m)^rename to ([^\n\r]+)"), F.concat(F.lit("b/"), _first(head, git, 2)))
    removed = head.rlike(r"(?m)^deleted file mode ") | (new == "/dev/null")
    added = head.rlike(r"(?m)^new file mode ") | (old == "/dev/null")
    return [
        F.when(new == "/dev/null", _bare(old)).otherwise(_bare(new)).alias("path"),
        _bare(old).alias("source_path"),
        _bare(new).alias("target_path"),
        head.rlike(r"(?m)^(Binary files .* differ|GIT binary patch)").alias("is_binary"),
        F.coalesce(added, F.lit(False)).alias("is_added_file"),
        F.coalesce(removed, F.lit(False)).alias("is_removed_file"),
        head.rlike(r"(?m)^rename (from|to) ").alias("is_rename"),
    ]


def hunk_length(text: str, group: int) -> Column:
    """A length of a hunk header; one that is not given is 1."""
    n = F.regexp_extract(text, HUNK, group)
    return F.when(n == "", 1).otherwise(F.try_to_number(n, F.lit("9999999999")).cast("int"))


def line_kind(raw: Column) -> Column:
    """added, removed, context, marker or bad, by the first character."""
    mark = F.substring(raw, 1, 1)
    return F.when(mark == "+", "added").when(mark == "-", "removed").when((mark == " ") | raw.isin("", "\r"), "context").when(mark == "\\", "marker").otherwise("bad")


def line_content(raw: str) -> Column:
    """A line without its prefix and a carriage return at its end."""
    return F.regexp_replace(F.when(F.col(raw) == "", "").otherwise(F.expr(f"substring({raw}, 2)")), r"\r$", "")


def _hunks(changes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    parts = F.split("section", r"\n(?=@@ -\d)")
    s = _described(changes) if carry else _sections(changes)
    h = s.select("change_id", "file_no", *carry, F.posexplode(parts).alias("n", "hunk")).where("n > 0")
    part = lambda i: F.regexp_extract("hunk", HUNK, i)
    return h.select("change_id", "file_no", (F.col("n") - 1).alias("hunk_no"), part(1).cast("int").alias("source_start"), hunk_length("hunk", 2).alias("source_length"), part(3).cast("int").alias("target_start"), hunk_length("hunk", 4).alias("target_length"), F.regexp_replace(part(5), r"\r$", "").alias("section_header"), *carry, "hunk")


def split_hunks(changes: DataFrame) -> DataFrame:
    """diff_hunks: header numbers and section text; a missing length is 1 (D3)."""
    return _hunks(changes).drop("hunk")


#: What located lines carry of their file, and of their hunk's header.
FILE_COLUMNS = ("path", "is_binary")
HUNK_COLUMNS = ("source_start", "source_length", "target_start", "target_length")


def _body(changes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """All lines below hunk headers with running counts of what the hunk has had before them."""
    h = _hunks(changes, carry)
    rows = h.select("change_id", "file_no", "hunk_no", *HUNK_COLUMNS, *carry, F.posexplode(F.split("hunk", "\n")).alias("line_idx", "raw")).where("line_idx > 0")
    rows = rows.withColumn("kind", line_kind(F.col("raw"))).withColumn("content", line_content("raw"))
    w = W.partitionBy("change_id", "file_no", "hunk_no").orderBy("line_idx").rowsBetween(W.unboundedPreceding, 0)
    old, new = F.col("kind").isin("removed", "context").cast("int"), F.col("kind").isin("added", "context").cast("int")
    return rows.withColumn("olds", F.sum(old).over(w)).withColumn("news", F.sum(new).over(w)).withColumn("open", (F.col("olds") - old < F.col("source_length")) | (F.col("news") - new < F.col("target_length")))


def number_lines(changes: DataFrame, located: bool = False) -> DataFrame:
    """diff_lines: every line of every hunk, numbered after and before the change.

    Text after a hunk has reached its declared lengths is dropped, and so are `\\ No newline` markers. line_idx counts
    the hunk's lines from 0. located: the lines carry FILE_COLUMNS and HUNK_COLUMNS too, so that a scan needs no join
    with files that come out of the same texts.
    """
    b = _body(changes, FILE_COLUMNS if located else ()).where(F.col("open") & F.col("kind").isin("added", "removed", "context"))
    return b.select(
        "change_id",
        "file_no",
        "hunk_no",
        (F.col("line_idx") - 1).alias("line_idx"),
        "kind",
        "content",
        F.when(F.col("kind") != "removed", F.col("target_start") - 1 + F.col("news")).cast("int").alias("line_no"),
        F.when(F.col("kind") != "added", F.col("source_start") - 1 + F.col("olds")).cast("int").alias("source_line_no"),
        *(FILE_COLUMNS + HUNK_COLUMNS if located else ()),
    )


def located(lines: DataFrame, files: DataFrame) -> DataFrame:
    """lines with their file's path and is_binary, joined on if they don't carry them."""
    return lines if "path" in lines.columns else lines.join(files.select("change_id", "file_no", *FILE_COLUMNS), ["change_id", "file_no"])


def _after_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.lit(1 << 30))


def _broken(hunk: Column) -> Column:
    """Whether a hunk's text ends before or goes beyond its declared lengths, or has a line without a known prefix before that."""
    rest = lambda i: F.when(F.regexp_extract(hunk, HUNK, i) == "", 1).otherwise(F.coalesce(F.try_to_number(F.regexp_extract(hunk, HUNK, i), F.lit("9999999999")).cast("int"), F.lit(-1)))
    start = F.struct(rest(2).alias("old"), rest(4).alias("new"), F.lit(False).alias("bad"))

    def read(s, raw):
        kind = line_kind(raw)
        left = F.struct((s["old"] - kind.isin("removed", "context").cast("int")).alias("old"), (s["new"] - kind.isin("added", "context").cast("int")).alias("new"), (s["bad"] | (kind == "bad")).alias("bad"))
        return F.when((s["old"] > 0) | (s["new"] > 0), left).otherwise(s)

    return F.aggregate(_after_first(F.split(hunk, "\n")), start, read, lambda s: s["bad"] | (s["old"] != 0) | (s["new"] != 0))


def status(text: Column) -> Column:
    """ok, empty (blank text) or parse_error (D7), a projection of the text.

    An error is text without a file section, a hunk that ends before or goes beyond its declared lengths, a line without
    a known prefix inside a hunk, or a null text.
    """
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, r"\n\z", "")), r"\n(?=diff --git )")
    broken = F.exists(_after_first(parts), lambda section: F.exists(_after_first(F.split(section, r"\n(?=@@ -\d)")), _broken))
    return F.when(text.isNull() | broken, "parse_error").when(~text.rlike(r"(?U)\S"), "empty").when(F.size(parts) < 2, "parse_error").otherwise("ok")


def parse_status(changes: DataFrame) -> DataFrame:
    """change_id, status."""
    return changes.select("change_id", status(F.col("diff_text")).alias("status"))


def sound(changes: DataFrame) -> DataFrame:
    """The changes that can be read: all that comes after reading works on these, so that nothing of a text that was cut short is
    scanned, sent or reviewed."""
    return changes.where(status(F.col("diff_text")) == "ok")


def added_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct change_id, path, line_no of added lines; of a path that a change has twice the first file counts."""
    return lines.where("kind = 'added'").select("change_id", "file_no", "line_no").join(first_file(files).select("change_id", "file_no", "path"), ["change_id", "file_no"]).select("change_id", "path", "line_no").distinct()


def has_added_lines(lines: DataFrame) -> DataFrame:
    """change_id, reviewable: the change has an added line anywhere."""
    return lines.groupBy("change_id").agg(F.bool_or(F.col("kind") == "added").alias("reviewable"))


def first_file(files: DataFrame) -> DataFrame:
    """The first file with each path of a change."""
    w = W.partitionBy("change_id", "path").orderBy("file_no")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
