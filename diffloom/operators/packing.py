"""Filter files, size and pack them into requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffloom.functions.text import json_list, tokens
from diffloom.operators.rules import is_manifest
from diffloom.operators.scans import next_fit
from diffloom.sources.shared import stored

# Paths of generated and vendored files.
GENERATED = r"(^|/)vendor/|(^|/)node_modules/|(^|/)dist/|(^|/)build/|\.min\.js$|\.generated\.[^/]+$|_pb2\.py$"
MAX_INPUT_TOKENS = 8000


def exclusions(files: DataFrame, lines: DataFrame) -> DataFrame:
    """diff_files with exclusion_reason, null for files to review."""
    added = lines.where("kind = 'added'").groupBy("change_id", "file_no").agg(F.count("*").alias("n_added"))
    reason = F.when(F.col("is_binary"), "binary").when(F.col("n_added").isNull(), "no added lines").when(is_manifest(F.col("path")), "lockfiles").when(F.col("path").rlike(GENERATED), "generated")
    return files.join(added, ["change_id", "file_no"], "left").withColumn("exclusion_reason", reason).drop("n_added")


def exclusion_notes(filtered: DataFrame) -> DataFrame:
    """change_id, n_excluded, note (P2). Fixed value: the wording of the note."""
    g = filtered.where("exclusion_reason IS NOT NULL").groupBy("change_id").agg(F.count("*").alias("n_excluded"), F.array_sort(F.collect_set("exclusion_reason")).alias("reasons"))
    return g.select("change_id", "n_excluded", F.concat(F.col("n_excluded").cast("string"), F.lit(" files excluded from LLM review ("), F.array_join("reasons", ", "), F.lit(")")).alias("note"))


def _rendered(kind: Column, line_no: Column, content: Column) -> Column:
    number = F.lpad(line_no.cast("string"), 6, " ")
    number = F.when(F.length(line_no.cast("string")) > 6, line_no.cast("string")).otherwise(number)
    return F.when(kind == "added", F.concat(F.lit("+ "), number, F.lit(" | "), content)).when(kind == "removed", F.concat(F.lit("-        | "), content)).otherwise(F.concat(F.lit("         | "), content))


def _hunk_head() -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in ("@@ -", F.col("source_start").cast("string"), ",", F.col("source_length").cast("string"), " +", F.col("target_start").cast("string"), ",", F.col("target_length").cast("string"), " @@")])


def hunk_texts(filtered: DataFrame, hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """change_id, file_no, path, hunk_no, citable (sorted line numbers), text of each hunk to review."""
    keep = filtered.where("exclusion_reason IS NULL").select("change_id", "file_no", "path")
    body = lines.join(keep.select("change_id", "file_no"), ["change_id", "file_no"]).groupBy("change_id", "file_no", "hunk_no").agg(F.array_sort(F.collect_list(F.struct("line_idx", _rendered(F.col("kind"), F.col("line_no"), F.col("content")).alias("t"), F.when(F.col("kind") == "added", F.col("line_no")).alias("n")))).alias("l"))
    rows = keep.join(hunks, ["change_id", "file_no"]).join(body, ["change_id", "file_no", "hunk_no"], "left")
    return rows.select("change_id", "file_no", "path", "hunk_no", F.coalesce(F.filter("l.n", lambda n: n.isNotNull()), F.array().cast("array<int>")).alias("citable"), F.concat_ws("\n", _hunk_head(), F.array_join("l.t", "\n")).alias("text"))


def located_hunk_texts(located: DataFrame) -> DataFrame:
    """hunk_texts from located lines alone: one grouping by hunk, then a window over the file's hunks for its added lines."""
    g = located.where("NOT is_binary").groupBy("change_id", "file_no", "path", "hunk_no", "source_start", "source_length", "target_start", "target_length").agg(
        F.array_sort(F.collect_list(F.struct("line_idx", _rendered(F.col("kind"), F.col("line_no"), F.col("content")).alias("t"), F.when(F.col("kind") == "added", F.col("line_no")).alias("n")))).alias("l"))
    g = g.withColumn("citable", F.filter("l.n", lambda n: n.isNotNull())).withColumn("_added", F.max(F.size("citable")).over(W.partitionBy("change_id", "file_no")))
    keep = (F.col("_added") > 0) & ~is_manifest(F.col("path")) & ~F.col("path").rlike(GENERATED)
    return g.where(keep).select("change_id", "file_no", "path", "hunk_no", "citable", F.concat_ws("\n", _hunk_head(), F.array_join("l.t", "\n")).alias("text"))


def block_text(path: Column, citable: Column, hunks: Column) -> Column:
    """One file, or some of its hunks, as request text."""
    return F.concat_ws("\n", F.concat(F.lit('<file path="'), path, F.lit('">')), F.concat(F.lit("citable_lines: "), json_list(citable)), hunks, F.lit("</file>"))


def file_blocks(hunk_rows: DataFrame) -> DataFrame:
    """change_id, file_no, path, text, tokens of each whole file."""
    g = hunk_rows.groupBy("change_id", "file_no", "path").agg(F.array_sort(F.collect_list(F.struct("hunk_no", "citable", "text"))).alias("h"))
    text = block_text(F.col("path"), F.array_sort(F.array_distinct(F.flatten("h.citable"))), F.array_join("h.text", "\n"))
    return g.select("change_id", "file_no", "path", text.alias("text")).withColumn("tokens", tokens(F.col("text")))


ASSIGNED = "change_id long, file_no int, hunk_no int, chunk_no int, batch_no int, capped boolean"
#: Changes of more hunks than this are packed by `assign_large`, over many tasks.
LARGE = 10_000
_FILE, _HUNK = ["change_id", "file_no"], ["change_id", "file_no", "hunk_no"]


def hunk_sizes(hunk_rows: DataFrame) -> DataFrame:
    """What packing needs of each hunk: chars of its text, number and digits of its cited lines, and those lines themselves only in files where
    a line number may stand in two hunks (the hunks of a well-formed diff don't overlap, so hardly ever)."""
    n = F.col("citable")
    digits = F.aggregate(n, F.lit(0), lambda a, x: a + F.length(x.cast("string")))
    s = hunk_rows.select("change_id", "path", "file_no", "hunk_no", F.length("text").alias("chars"), F.size(n).alias("n_cited"), digits.alias("digits"), F.array_min(n).alias("_lo"), F.array_max(n).alias("_hi"), n.alias("cited"))
    before = F.max("_hi").over(W.partitionBy(*_FILE).orderBy("hunk_no").rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("_twice", F.max(F.coalesce(F.col("_lo") <= before, F.lit(False))).over(W.partitionBy(*_FILE)))
    return s.withColumn("cited", F.when(F.col("_twice"), F.col("cited"))).drop("_lo", "_hi", "_twice")


def _block_tokens(path: Column, body: Column, n_cited: Column, digits: Column) -> Column:
    """Tokens of a block by its parts: chars of its hunks with a line end each, number and digits of its distinct cited lines."""
    frame = len('<file path="">\ncitable_lines: []\n</file>')
    return F.ceil((F.length(path) + body + digits + 2 * F.greatest(n_cited - 1, F.lit(0)) + frame) / 4).cast("long")


def _block_sizes(sizes: DataFrame, by: list[str]) -> DataFrame:
    """by, tokens of the block that the hunks with the same `by` make up; a line number counts once in it."""
    whole = sizes.groupBy(*by).agg(F.sum(F.col("chars") + 1).alias("body"), F.sum("n_cited").alias("n"), F.sum("digits").alias("d"))
    lines = sizes.where("cited IS NOT NULL").select(*by, F.explode("cited").alias("line")).distinct()
    fewer = lines.groupBy(*by).agg(F.count("*").alias("n2"), F.sum(F.length(F.col("line").cast("string"))).alias("d2"))
    both = whole.join(fewer, by, "left")
    return both.select(*by, _block_tokens(F.col("path"), F.col("body"), F.coalesce("n2", "n"), F.coalesce("d2", "d")).alias("tokens"))


def assign_large(sizes: DataFrame, max_input_tokens: int = MAX_INPUT_TOKENS) -> DataFrame:
    """`assign` of hunk_sizes without an ordered fold: a change, or a file, of any number of hunks is packed over many tasks.

    Sizes of files, next-fit over the hunks of oversized ones, sizes of the blocks, next-fit over a change's blocks.
    """
    sizes = stored(sizes)
    file = [*_FILE, "path"]
    over = stored(_block_sizes(sizes, file).where(F.col("tokens") > max_input_tokens).select(*_FILE))
    own = sizes.join(over, _FILE, "left_semi").withColumn("tokens", _block_tokens(F.col("path"), F.col("chars") + 1, F.col("n_cited"), F.col("digits")))
    chunks = next_fit(own.select(*_HUNK, "tokens"), _FILE, ["hunk_no"], "tokens", max_input_tokens).select(*_HUNK, F.col("group_no").alias("chunk"))
    cut = stored(sizes.join(chunks, _HUNK, "left").select(*sizes.columns, F.coalesce("chunk", F.lit(0)).cast("int").alias("chunk_no"), F.col("chunk").isNotNull().alias("capped")))
    blocks = _block_sizes(cut, [*file, "chunk_no"])
    batches = next_fit(blocks, ["change_id"], ["path", "file_no", "chunk_no"], "tokens", max_input_tokens).select(*_FILE, "chunk_no", F.col("group_no").cast("int").alias("batch_no"))
    return cut.join(batches, [*_FILE, "chunk_no"]).select(*_HUNK, "chunk_no", "batch_no", "capped")


def assign(hunk_rows: DataFrame, max_input_tokens: int = MAX_INPUT_TOKENS, change_type: str = "long", large: int = LARGE) -> DataFrame:
    """Chunk and batch of each hunk: next-fit over whole files in path order, hunks of oversized files apart.

    Changes of up to `large` hunks are folded in order, many to a task; those beyond go through `assign_large`, with the same result.
    """
    many = stored(hunk_rows.groupBy("change_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("change_id"))
    sizes = hunk_sizes(hunk_rows)
    if many.isEmpty():
        return _folded(sizes, max_input_tokens, change_type)
    few = _folded(sizes.join(many, "change_id", "left_anti"), max_input_tokens, change_type)
    return few.unionByName(assign_large(sizes.join(many, "change_id", "left_semi"), max_input_tokens))


def _folded(sizes: DataFrame, max_input_tokens: int, change_type: str) -> DataFrame:
    """The ordered fold with resets: rows come sorted within partitions by change, and the state (the open batch's
    tokens) is carried across Arrow batches; only the sizes of one file's hunks are held."""
    ordered = sizes.repartition("change_id").sortWithinPartitions("change_id", "path", "file_no", "hunk_no")

    def block(path, hunks):
        if any(h[4] is not None for h in hunks):
            cited = {int(n) for h in hunks for n in h[4]}
            n, digits = len(cited), sum(len(str(x)) for x in cited)
        else:
            n, digits = sum(h[2] for h in hunks), sum(h[3] for h in hunks)
        chars = len(f'<file path="{path}">\ncitable_lines: []\n</file>') + digits + 2 * max(n - 1, 0) + sum(h[1] + 1 for h in hunks)
        return -(-chars // 4)

    def fold(frames):
        change = open_tokens = batch = None
        key, held, out = None, [], []

        def place(path, group, chunk, capped):
            nonlocal open_tokens, batch
            t = block(path, group)
            if open_tokens is None:
                open_tokens, batch = 0, 0
            elif open_tokens + t > max_input_tokens:
                open_tokens, batch = 0, batch + 1
            open_tokens += t
            out.extend((key[0], key[2], h[0], chunk, batch, capped) for h in group)

        def close():
            if not held:
                return
            path = key[1]
            if block(path, held) <= max_input_tokens:
                place(path, held, 0, False)
                return
            group, used, chunk = [], 0, 0
            for h in held:
                t = block(path, [h])
                if group and used + t > max_input_tokens:
                    place(path, group, chunk, True)
                    group, used, chunk = [], 0, chunk + 1
                group.append(h)
                used += t
            place(path, group, chunk, True)

        for frame in frames:
            for row in frame.itertuples(index=False):
                now = (row.change_id, row.path, row.file_no)
                if now != key:
                    close()
                    if row.change_id != change:
                        change, open_tokens = row.change_id, None
                    key, held = now, []
                held.append((row.hunk_no, row.chars, row.n_cited, row.digits, row.cited))
            if out:
                yield pd.DataFrame(out, columns=["change_id", "file_no", "hunk_no", "chunk_no", "batch_no", "capped"])
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=["change_id", "file_no", "hunk_no", "chunk_no", "batch_no", "capped"])

    return ordered.mapInPandas(fold, ASSIGNED.replace("change_id long", f"change_id {change_type}"))


def blocks(hunk_rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """change_id, batch_no, path, file_no, chunk_no, capped, tokens, text of each packed block."""
    g = hunk_rows.join(assigned, ["change_id", "file_no", "hunk_no"]).groupBy("change_id", "batch_no", "path", "file_no", "chunk_no", "capped").agg(F.array_sort(F.collect_list(F.struct("hunk_no", "citable", "text"))).alias("h"))
    text = block_text(F.col("path"), F.array_sort(F.array_distinct(F.flatten("h.citable"))), F.array_join("h.text", "\n"))
    return g.select("change_id", "batch_no", "path", "file_no", "chunk_no", "capped", text.alias("text")).withColumn("tokens", tokens(F.col("text")))


def batches(packed: DataFrame) -> DataFrame:
    """change_id, batch_no, tokens, paths (distinct, sorted), text."""
    g = packed.groupBy("change_id", "batch_no").agg(F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("path")).alias("paths"), F.array_sort(F.collect_list(F.struct("path", "file_no", "chunk_no", "text"))).alias("b"))
    return g.select("change_id", "batch_no", "tokens", "paths", F.array_join("b.text", "\n\n").alias("text"))


def review_requests(batch_rows: DataFrame, suppressed: DataFrame, system: str) -> DataFrame:
    """change_id, batch_no, system, user: the batch's text and the suppressions of its own files, or none."""
    paths = batch_rows.select("change_id", "batch_no", F.explode("paths").alias("path"))
    own = paths.join(suppressed, ["change_id", "path"]).groupBy("change_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), F.col("line_no").alias("line")))).alias("s"))
    note = F.when(F.col("s").isNull(), "Suppression list: none.").otherwise(F.concat(F.lit("Suppression list, already reported by rules; report none of these pairs:\n"), F.to_json("s")))
    return batch_rows.join(own, ["change_id", "batch_no"], "left").select("change_id", "batch_no", F.lit(system).alias("system"), F.concat_ws("\n", "text", F.lit(""), note, F.lit(""), F.lit("Review the added lines above.")).alias("user"))


def summary_requests(filtered: DataFrame, findings: DataFrame, system: str) -> DataFrame:
    """change_id, system, user: paths, reasons and findings, never the diff."""
    files = filtered.groupBy("change_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("exclusion_reason").isNull(), F.col("path")))).alias("files_reviewed"),
        F.array_sort(F.collect_list(F.when(F.col("exclusion_reason").isNotNull(), F.concat("path", F.lit(" ("), "exclusion_reason", F.lit(")"))))).alias("files_excluded"),
    )
    f = findings.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("file", F.coalesce("line", F.lit(-1)).alias("at"), "category", "severity", "confidence", "evidence", "risk", "recommendation", "line"))).alias("f"))
    public = F.transform(F.coalesce("f", F.array().cast(f.schema["f"].dataType)), lambda x: F.struct(*(x[k].alias(k) for k in ("category", "confidence", "evidence", "file", "line", "recommendation", "risk", "severity"))))
    return files.join(f, "change_id", "left").select("change_id", F.lit(system).alias("system"), F.to_json(F.struct("files_excluded", "files_reviewed", public.alias("findings")), {"ignoreNullFields": "false"}).alias("user"))
