"""The parser on small, hand-counted diffs."""

import pytest
from pyspark.sql import functions as F

from diffloom.operators import lines, longdiffs, scans
from diffloom.plans import corpus
from diffloom.sources import diffs

MULTI = """diff --git a/app/handlers.py b/app/handlers.py
--- a/app/handlers.py
+++ b/app/handlers.py
@@ -1,3 +1,4 @@ def top
 first
+second
 third
 fourth
@@ -30,3 +31,3 @@
 x
-y
+why
 z
diff --git a/zzz.py b/zzz.py
new file mode 100644
--- /dev/null
+++ b/zzz.py
@@ -0,0 +1,2 @@
+one
+two
\\ No newline at end of file
"""
DELETED = "diff --git a/old.py b/old.py\ndeleted file mode 100644\n--- a/old.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
RENAMED = "diff --git a/old/a.py b/new/a.py\nsimilarity index 100%\nrename from old/a.py\nrename to new/a.py\n"
BINARY = "diff --git a/logo.png b/logo.png\nBinary files a/logo.png and b/logo.png differ\n" + MULTI
BAD_SHORT = "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1,3 +1,4 @@\n x\n+y\n"
TRAP = "diff --git a/a.sql b/a.sql\n--- a/a.sql\n+++ b/a.sql\n@@ -1,2 +1,2 @@\n--- a/x\n+++ b/y\n keep\r\n"
EMPTY_CONTEXT = "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1,2 +1,3 @@\n x\n\n+y\n\n\n"


def changes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "change_id long, diff_text string")


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy(*df.columns[:4]).select(*cols).collect()]


def test_numbers_and_order(spark):
    got = rows(lines.number_lines(changes(spark, MULTI)), "file_no", "hunk_no", "kind", "content", "line_no", "source_line_no")
    assert got == [(0, 0, "context", "first", 1, 1), (0, 0, "added", "second", 2, None), (0, 0, "context", "third", 3, 2), (0, 0, "context", "fourth", 4, 3), (0, 1, "context", "x", 31, 30), (0, 1, "removed", "y", None, 31), (0, 1, "added", "why", 32, None), (0, 1, "context", "z", 33, 32), (1, 0, "added", "one", 1, None), (1, 0, "added", "two", 2, None)]


def test_hunk_headers(spark):
    c = changes(spark, MULTI, "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -5 +7 @@\n-x\n+y\n")
    got = rows(lines.split_hunks(c), "change_id", "file_no", "hunk_no", "source_start", "source_length", "target_start", "target_length", "section_header")
    assert got[0] == (0, 0, 0, 1, 3, 1, 4, "def top") and got[-1] == (1, 0, 0, 5, 1, 7, 1, "")


def test_files(spark):
    f = lines.split_files(changes(spark, MULTI, DELETED, RENAMED, BINARY))
    got = {(r.change_id, r.file_no): r for r in f.collect()}
    assert (got[0, 1].path, got[0, 1].source_path, got[0, 1].is_added_file) == ("zzz.py", "/dev/null", True)
    assert (got[1, 0].path, got[1, 0].target_path, got[1, 0].is_removed_file) == ("old.py", "/dev/null", True)
    assert (got[2, 0].path, got[2, 0].source_path, got[2, 0].is_rename) == ("new/a.py", "old/a.py", True)
    assert got[3, 0].is_binary and not got[3, 1].is_binary and got[3, 1].path == "app/handlers.py"


@pytest.mark.parametrize(("text", "status"), [(MULTI, "ok"), (DELETED, "ok"), (RENAMED, "ok"), ("", "empty"), (" \n\n", "empty"), ("prose\n", "parse_error"), (BAD_SHORT, "parse_error"), (None, "parse_error"), (EMPTY_CONTEXT, "ok"), (MULTI.replace("\n third", "\nthird"), "parse_error"), (MULTI.replace("-1,3 +1,4", "-1,2 +1,9"), "parse_error"), (TRAP, "ok")])
def test_status(spark, text, status):
    assert lines.parse_status(changes(spark, text)).first().status == status


def test_content_that_looks_like_headers_and_cr(spark):
    got = rows(lines.number_lines(changes(spark, TRAP)), "kind", "content")
    assert got == [("removed", "-- a/x"), ("added", "++ b/y"), ("context", "keep")]


def test_empty_context_line_and_trailing_blanks(spark):
    assert rows(lines.number_lines(changes(spark, EMPTY_CONTEXT)), "kind", "content", "line_no") == [("context", "x", 1), ("context", "", 2), ("added", "y", 3)]


PLAIN = "\n".join(x for x in MULTI.split("\n") if not x.startswith(("diff ", "new file"))) + TRAP.split("\n", 1)[1]


def test_plain_diffs(spark):
    rows_ = longdiffs.marked(longdiffs.split_lines(changes(spark, PLAIN, MULTI, None)))
    assert [r.path for r in longdiffs.files(rows_).where("change_id = 0").orderBy("file_no").collect()] == ["app/handlers.py", "zzz.py", "a.sql"]
    assert longdiffs.number_lines(rows_).where("change_id = 0").count() == 13
    mixed = MULTI + TRAP.split("\n", 1)[1]  # a plain file below git's
    got = longdiffs.files(longdiffs.marked(longdiffs.split_lines(changes(spark, mixed))))
    assert [r.path for r in got.orderBy("file_no").collect()] == ["app/handlers.py", "zzz.py", "a.sql"]


def test_line_by_line_as_in_one_text(spark):
    """Every table of the splitting reader, from lines that are spread over ranges."""
    texts = [MULTI, DELETED, RENAMED, BINARY, BAD_SHORT, TRAP, EMPTY_CONTEXT, "prose\n", " \n\n", MULTI.replace("\n third", "\nthird"), MULTI.replace("-1,3 +1,4", "-1,2 +1,9"), "@@ -1 +1 @@\n x\n" + MULTI]
    big = "diff --git a/big.py b/big.py\n--- a/big.py\n+++ b/big.py\n" + "".join(f"@@ -{9 * h + 1},5 +{9 * h + 1},6 @@ part\n keep\n-gone\n+new {h}\n+more\n a\n-- b\n\n+c\n" for h in range(1500))
    c = changes(spark, *texts, big)
    rows_ = longdiffs.marked(longdiffs.split_lines(c).repartition(5))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(lines.split_files(c), longdiffs.files(rows_))
    assert same(lines.split_hunks(c), longdiffs.hunks(rows_))
    assert same(lines.number_lines(c), longdiffs.number_lines(rows_))
    assert same(lines.number_lines(c, located=True), longdiffs.number_lines(rows_, longdiffs.files(rows_)))
    assert same(lines.parse_status(c), longdiffs.parse_status(rows_))


@pytest.fixture
def ranges(spark):
    """Small tables keep their ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("large", [0, 9])
def test_large_changes_over_ranges_as_small_ones_in_windows(spark, ranges, large):
    """All changes over ranges, and those only that have ten lines or more."""
    texts = [MULTI, DELETED, RENAMED, BINARY, BAD_SHORT, TRAP, EMPTY_CONTEXT, PLAIN, "prose\n", " \n\n", "@@ -1 +1 @@\n x\n" + MULTI]
    rows_ = longdiffs.split_lines(changes(spark, *texts, None)).repartition(5)
    assert sorted(map(str, longdiffs.marked(rows_, large).collect())) == sorted(map(str, longdiffs.marked(rows_).collect()))


def dealt(df):
    """How often a plan deals its rows."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_dealt_once_by_change(spark):
    """All that is made of the lines of changes that fit in a task."""
    rows_ = longdiffs.marked(longdiffs.split_lines(changes(spark, MULTI, BAD_SHORT)))
    sound = longdiffs.parse_status(rows_).where("status = 'ok'").select("change_id")
    assert dealt(longdiffs.number_lines(rows_)) == dealt(longdiffs.parse_status(rows_)) == dealt(longdiffs.files(rows_)) == 1
    assert dealt(longdiffs.number_lines(rows_).join(sound.hint("merge"), "change_id", "left_semi")) == 2  # of one text: Spark runs it once


def test_scans_in_a_chain_deal_rows_once(spark, ranges):
    laid = scans.laid_out(spark.range(1000).selectExpr("id % 7 AS k", "id AS v"), ["k"], ["v"])
    assert len({r._range for r in laid.select("_range").distinct().collect()}) > 1
    one = scans.scanned(laid, ["k"], sums={"n": F.lit(1).cast("long")})
    two = scans.scanned(one, ["k"], last={"tens": F.when(F.col("n") % 10 == 0, F.col("n"))}, following={"next": F.col("n")})
    got = two.select("k", "v", "n", "tens", "next").collect()
    assert all(r.n == r.v // 7 + 1 and r.tens == (r.n // 10 * 10 or None) and r.next == (r.n + 1 if r.v + 7 < 1000 else None) for r in got)
    rows_ = [x for x in two._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x]
    assert rows_ and all("BroadcastHashJoin" in x for x in rows_)


def test_corpus_is_rendered_where_its_rows_are_dealt(spark):
    assert dealt(corpus.changes(spark, "/root/testdata/sf0.001")) == dealt(lines.number_lines(corpus.changes(spark, "/root/testdata/sf0.001", damage=True))) == 1


def test_files_read_in_blocks(spark, tmp_path):
    big = "diff --git a/b b/b\n--- a/b\n+++ b/b\n@@ -1,0 +1,30000 @@\n" + "".join(f"+line {i}\r\n" for i in range(30000))
    (tmp_path / "b.diff").write_bytes(big.encode())
    (tmp_path / "m.x.diff").write_bytes(MULTI.encode())
    (tmp_path / "bad.diff").write_bytes(MULTI.encode() + b"\xff\xfe\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        rows_ = longdiffs.marked(diffs.read_diff_lines(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {r.change_id: r.status for r in longdiffs.parse_status(rows_).collect()} == {"b": "ok", "m.x": "ok", "bad": "parse_error"}
    got = longdiffs.number_lines(rows_).where("change_id = 'b'").orderBy("line_idx").collect()
    assert [(r.line_no, r.content) for r in got] == [(i + 1, f"line {i}") for i in range(30000)]


def test_added_lines_take_the_first_file_of_a_path(spark):
    twice = MULTI + MULTI.replace("second", "again").replace("@@ -1,3 +1,4", "@@ -101,3 +101,4")
    c = changes(spark, twice)
    got = {(r.path, r.line_no) for r in lines.added_lines(lines.number_lines(c), lines.split_files(c)).collect()}
    assert got == {("app/handlers.py", 2), ("app/handlers.py", 32), ("zzz.py", 1), ("zzz.py", 2)}


def test_reviewable(spark):
    c = changes(spark, MULTI, DELETED)
    assert {r.change_id: r.reviewable for r in lines.has_added_lines(lines.number_lines(c)).collect()} == {0: True, 1: False}
