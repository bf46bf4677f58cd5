"""Diffs line by line (S1, D1-D7): for texts that are larger than a task, or that come as lines.

line_rows(change_id, pos, raw): pos rises in the order of the text. What `lines` does by splitting one text is here a few ordered
scans: windows over a change that fits in a task, ranges (operators.scans) for one that doesn't, so one diff may fill any number of
tasks. All state of a reader is running sums: the number of markers so far, and the old and new lines since the last hunk header. A hunk is open while either count is below its
declared length; so a line `--- a/x` is a removed line in an open hunk and a file header elsewhere, which needs no reader that
counts along. Plain diffs, whose files begin at `---` and `+++` without `diff --git`, are read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.operators.lines import FILE_COLUMNS, HUNK, HUNK_COLUMNS, file_columns, hunk_length, line_content, line_kind
from diffloom.operators.scans import laid_out, scanned, windowed
from diffloom.sources.shared import stored

_KEY = ["change_id"]
#: A change with a line at this place or beyond is scanned over ranges.
LARGE = 100_000


def split_lines(changes: DataFrame) -> DataFrame:
    """line_rows of texts that do fit in a value; null texts have none, and the last line's end begins no line."""
    text = F.regexp_replace("diff_text", r"\n\z", "")
    return changes.select("change_id", F.posexplode(F.split(text, "\n")).alias("pos", "raw"))


def marked(line_rows: DataFrame, large: int = LARGE) -> DataFrame:
    """line_rows with file_no and hunk_no (null before the first), kind, olds, news (counts of the hunk up to the line), the hunk's header
    numbers, and open: the line stands in its hunk, before that is complete.

    The lines are written once. Those of changes that end before the place `large` are dealt by change, once: all windows, and what is grouped or
    joined by change after them, need no other exchange. Larger changes are scanned over ranges, which writes and deals their rows several times.
    """
    rows = stored(line_rows.select("change_id", "pos", "raw"))
    long = rows.where(F.col("pos") >= large).select("change_id").distinct()
    if long.isEmpty():
        return _marked(rows, lambda r, **what: windowed(r, _KEY, ["pos"], **what))
    long = stored(long)
    same = rows["change_id"].eqNullSafe(long["change_id"])
    short = _marked(rows.join(long, same, "left_anti"), lambda r, **what: windowed(r, _KEY, ["pos"], **what))
    ranged = _marked(laid_out(rows.join(long, same, "left_semi"), _KEY, ["pos"]), lambda r, **what: scanned(r, _KEY, **what), keep=stored)
    return short.unionByName(ranged)


def _marked(rows: DataFrame, scan: Callable[..., DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows of `marked` by scan(rows, sums, last, following); keep is done with what several scans read."""
    raw = F.col("raw")
    head = raw.rlike(r"^@@ -\d")
    kind = line_kind(raw)
    count = lambda *kinds: F.when(~head & kind.isin(*kinds), 1).otherwise(0).cast("long")
    numbers = F.struct(F.regexp_extract("raw", HUNK, 1).cast("int").alias("source_start"), hunk_length("raw", 2).alias("source_length"), F.regexp_extract("raw", HUNK, 3).cast("int").alias("target_start"), hunk_length("raw", 4).alias("target_length"), F.regexp_replace(F.regexp_extract("raw", HUNK, 5), r"\r$", "").alias("section_header"), "pos")
    a = scan(rows, sums={"_heads": F.when(head, 1).otherwise(0).cast("long"), "_olds": count("removed", "context"), "_news": count("added", "context")}, last={"_head": F.when(head, numbers)}, following={"_after": raw})
    a = a.withColumn("_is_head", head).withColumn("kind", kind)
    # the sums at the header, carried along, make the sums of the hunk
    b = scan(a, last={"_at_head": F.when(F.col("_is_head"), F.struct(F.col("_olds").alias("o"), F.col("_news").alias("n")))})
    b = b.withColumn("olds", F.col("_olds") - F.col("_at_head.o")).withColumn("news", F.col("_news") - F.col("_at_head.n"))
    before_old, before_new = F.col("olds") - F.col("kind").isin("removed", "context").cast("int"), F.col("news") - F.col("kind").isin("added", "context").cast("int")
    is_open = F.coalesce(~F.col("_is_head") & ((before_old < F.col("_head.source_length")) | (before_new < F.col("_head.target_length"))), F.lit(False))
    b = b.withColumn("open", is_open)
    git = ~F.col("open") & raw.startswith("diff --git ")
    pair = ~F.col("open") & raw.startswith("--- ") & F.coalesce(F.col("_after").startswith("+++ "), F.lit(False))
    b = keep(b.withColumn("_git", git).withColumn("_pair", pair).drop("_after", "_at_head", "_olds", "_news"))
    # a pair of path lines begins a file unless it is the first one below a git header
    c = scan(b, sums={"_pairs": F.col("_pair").cast("long")}, last={"_git_at": F.when(F.col("_git"), F.col("pos"))})
    d = scan(c, last={"_pairs_at_git": F.when(F.col("_git"), F.col("_pairs"))})
    starts = F.col("_git") | (F.col("_pair") & F.coalesce(F.col("_pairs") - F.col("_pairs_at_git") > 1, F.lit(True)))
    d = d.withColumn("_starts", starts)
    e = scan(d, sums={"_files": F.col("_starts").cast("long")}, last={"_start": F.when(F.col("_starts"), F.struct("pos", F.col("_heads").alias("heads")))})
    file_no = F.when(F.col("_files") > 0, F.col("_files") - 1).cast("int")
    # a hunk belongs to the file that its header stands in; what stands above a file's first header is its head
    below = F.col("_head.pos") > F.col("_start.pos")
    hunk_no = F.when(below, F.col("_heads") - F.col("_start.heads") - 1).cast("int")
    e = e.withColumn("file_no", file_no).withColumn("hunk_no", hunk_no)
    return keep(e.select("change_id", "pos", "raw", "kind", "olds", "news", "open", "file_no", "hunk_no", F.col("_is_head").alias("is_head"), *(F.col(f"_head.{k}").alias(k) for k in (*HUNK_COLUMNS, "section_header")), F.col("_head.pos").alias("head_pos")))


def files(rows: DataFrame) -> DataFrame:
    """diff_files of marked rows: a file's header lines are few, and only they are put together."""
    head = rows.where("file_no IS NOT NULL AND hunk_no IS NULL").groupBy("change_id", "file_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("head"))
    # plain diffs have no git line, whose paths stand in where others are missing
    return head.select("change_id", "file_no", *file_columns(F.col("head")))


def hunks(rows: DataFrame) -> DataFrame:
    """diff_hunks of marked rows."""
    return rows.where("is_head AND file_no IS NOT NULL").select("change_id", "file_no", "hunk_no", *HUNK_COLUMNS, "section_header")


def number_lines(rows: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """diff_lines of marked rows, as lines.number_lines has them; with `described` (diff_files) they carry FILE_COLUMNS and HUNK_COLUMNS."""
    body = rows.where("open AND hunk_no IS NOT NULL AND kind IN ('added', 'removed', 'context')")
    body = body.select(
        "change_id",
        "file_no",
        "hunk_no",
        (F.col("pos") - F.col("head_pos") - 1).cast("int").alias("line_idx"),
        "kind",
        line_content("raw").alias("content"),
        F.when(F.col("kind") != "removed", F.col("target_start") - 1 + F.col("news")).cast("int").alias("line_no"),
        F.when(F.col("kind") != "added", F.col("source_start") - 1 + F.col("olds")).cast("int").alias("source_line_no"),
        *HUNK_COLUMNS,
    )
    if described is None:
        return body.drop(*HUNK_COLUMNS)
    body = body.join(described.select("change_id", "file_no", *FILE_COLUMNS), ["change_id", "file_no"])
    return body.select(*[c for c in body.columns if c not in (*FILE_COLUMNS, *HUNK_COLUMNS)], *FILE_COLUMNS, *HUNK_COLUMNS)


def parse_status(rows: DataFrame) -> DataFrame:
    """change_id, status of marked rows, as lines.parse_status has it; a null line (undecodable) is an error, a text without lines has no rows."""
    inside = F.col("open") & F.col("hunk_no").isNotNull()
    counted = inside | (F.col("is_head") & F.col("hunk_no").isNotNull())
    # hunks first, then changes: one pass without a join
    hunk = rows.groupBy("change_id", "file_no", "hunk_no").agg(
        F.bool_or(counted).alias("counted"), F.coalesce(F.max(F.when(inside, F.col("olds"))), F.lit(0)).alias("o"), F.coalesce(F.max(F.when(inside, F.col("news"))), F.lit(0)).alias("n"), F.max(F.when(counted, F.col("source_length"))).alias("sl"), F.max(F.when(counted, F.col("target_length"))).alias("tl"), F.bool_or(inside & (F.col("kind") == "bad")).alias("bad"),
        F.bool_or(F.col("raw").rlike(r"(?U)\S")).alias("text"), F.bool_or(F.col("raw").isNull()).alias("unreadable"))
    broken = F.col("counted") & F.coalesce(F.col("bad") | (F.col("o") != F.col("sl")) | (F.col("n") != F.col("tl")), F.lit(False))
    seen = hunk.groupBy("change_id").agg(F.bool_or(broken).alias("broken"), F.bool_or("text").alias("text"), F.max("file_no").alias("last_file"), F.bool_or("unreadable").alias("unreadable"))
    status = F.when(F.col("broken") | F.col("unreadable"), "parse_error").when(~F.col("text"), "empty").when(F.col("last_file").isNull(), "parse_error").otherwise("ok")
    return seen.select("change_id", status.alias("status"))
