"""Registered queries: name (the inventory's id first), Spark plan, SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions.text import flatten, tokens
from diffloom.operators import cost, lines, longdiffs, masking, merging, outcome, packing, reports, responses, rules
from diffloom.plans import corpus
from diffloom.plans.oracles import JSON, MASKED_DOCS, PUBLIC, SIGNAL, markdown_sql, over, random_sql, reviews_sql
from diffloom.plans.review import Requests, Reviewed, Scan
from diffloom.sources import diffs, sinks
from diffloom.sources.cache import ResponseCache
from diffloom.sources.shared import folder as shared
from diffloom.sources.shared import stored
from diffloom.streaming.arrivals import ReviewStream, review_arrivals

QUERIES: dict = {}
ORACLES: dict = {}
FOUND = ("file", "line", "category", "severity", "confidence", "evidence", "source", "rule_id")
LIMIT = 60


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def scan(spark, sf_dir, damage: bool = False) -> Scan:
    return Scan(corpus.changes(spark, sf_dir, damage))


def whole(spark, sf_dir, damage: bool = False) -> Scan:
    """The same with the tables that several steps read written once, the rendered texts too. damage: some texts can't be read."""
    return Scan(stored(corpus.changes(spark, sf_dir, damage)), keep=stored)


# ---- sources and sinks


@query("s1_read_changes", over("SELECT change_id, CAST(sum(CASE WHEN is_binary THEN 0 ELSE n_added END) AS BIGINT) AS n_added, true AS decodable FROM files GROUP BY change_id"))
def s1(spark, d):
    """Changes from a table with a text column."""
    c = diffs.from_table(corpus.changes(spark, d), "change_id", "diff_text")
    g = lines.number_lines(c.select("change_id", "diff_text")).groupBy("change_id").agg(F.count_if(F.col("kind") == "added").alias("n_added"))
    return c.join(g, "change_id", "left").select("change_id", F.coalesce("n_added", F.lit(0)).alias("n_added"), "decodable")


@query("s2_undecodable", "SELECT l_orderkey AS change_id, l_orderkey % 5 <> 0 AS decodable, CASE WHEN l_orderkey % 5 = 0 THEN 'parse_error' ELSE 'ok' END AS status FROM lineitem GROUP BY l_orderkey")
def s2(spark, d):
    raw = corpus.changes(spark, d).select("change_id", F.when(F.col("change_id") % 5 == 0, F.concat(F.col("diff_text").cast("binary"), F.lit(b"\xff\xfe"))).otherwise(F.col("diff_text").cast("binary")).alias("content"))
    c = diffs.decoded(raw)
    return c.select("change_id", "decodable").join(lines.parse_status(c), "change_id")


@query("s4_review_json", over(f", {reviews_sql('det')} SELECT change_id, sha256({JSON}) AS json_sha256 FROM review", damaged=True))
def s4(spark, d):
    return reports.to_json(whole(spark, d, damage=True).reviews()).select("change_id", F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


@query("s5_both_artifacts", over(f", {reviews_sql('det')}, {markdown_sql('det')} SELECT change_id, overall_risk, sha256({JSON}) AS json_sha256, sha256(md) AS md_sha256 FROM review JOIN pages USING (change_id)", damaged=True))
def s5(spark, d):
    out = shared(spark)
    sinks.write_artifacts(whole(spark, d, damage=True).artifacts(), out)
    r = spark.read.schema("change_id long, json string, md string, overall_risk string").parquet(out)
    return r.select("change_id", "overall_risk", *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("json", "md")))


_FILES_OF = "len(list_distinct(list_transform(fs, lambda x: x.file)))"


@query(
    "s5_artifact_parts",
    over(
        f""", {reviews_sql('det')}, {markdown_sql('det')} SELECT change_id, 'json' AS kind, CAST(ceil((len(fs) + 2) / 3.0) AS BIGINT) AS n_parts, sha256({JSON}) AS sha256 FROM review
        UNION ALL SELECT change_id, 'md', CAST(ceil((len(fs) + {_FILES_OF} + 2) / 3.0) AS BIGINT), sha256(md) FROM review JOIN pages USING (change_id)""",
        damaged=True,
    ),
)
def s5b(spark, d):
    """Both artifacts in parts of three rows, written and read back; joined in order they are the whole texts."""
    out = shared(spark)
    sinks.write_parts(whole(spark, d, damage=True).artifact_parts(part_rows=3), out)
    parts = spark.read.schema("change_id long, part_no long, text string, kind string").parquet(out)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("part_no", "text")))["text"], "")
    return parts.groupBy("change_id", "kind").agg(F.count("*").alias("n_parts"), F.sha2(text.cast("binary"), 256).alias("sha256"))


@query("s6_stream_review", over("SELECT change_id, file, line, category, severity, confidence, evidence, rule_id FROM det"))
def s6(spark, d):
    source, target, state = shared(spark), shared(spark), shared(spark)
    corpus.changes(spark, d).write.parquet(source)
    review_arrivals(spark, source, target, state, lambda batch: Scan(batch).findings.select("change_id", *FOUND)).awaitTermination()
    return spark.read.schema("change_id long, file string, line int, category string, severity string, confidence string, evidence string, rule_id string").parquet(target).select("change_id", "file", "line", "category", "severity", "confidence", "evidence", "rule_id")


@query("s7_record_labels", "SELECT l_orderkey AS change_id, b AS batch_no, 'review-' || l_orderkey || CASE WHEN l_orderkey % 3 > 0 THEN '-' || (b + 1) ELSE '' END AS label FROM (SELECT DISTINCT l_orderkey FROM lineitem), range(3) t(b) WHERE b <= l_orderkey % 3")
def s7(spark, d):
    o = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("change_id")).distinct()
    r = o.select("change_id", F.col("change_id").alias("stem"), F.lit("review").alias("call"), (F.col("change_id") % 3 + 1).alias("n_batches"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("change_id") % 3)).alias("batch_no"))
    return sinks.labelled(r).select("change_id", "batch_no", "label")


def new_cache(spark) -> ResponseCache:
    """A cache of its own for a query, gone with it."""
    return ResponseCache(spark, f"diffloom_cache_{uuid.uuid4().hex}")


@query("s8_cache_put", "SELECT sha256(CAST(k AS VARCHAR)) AS prompt_key, 'answer ' || k AS response FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem)")
def s8(spark, d):
    """Three puts, the last of a batch that is there already: one response for each key, the first that came."""
    o = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"))
    keyed = o.select(F.sha2(F.col("k").cast("string").cast("binary"), 256).alias("prompt_key"), "k")
    cache = new_cache(spark)
    cache.put(keyed.where("k % 2 = 0").select("prompt_key", F.concat(F.lit("answer "), F.col("k").cast("string")).alias("response")))
    late = keyed.select("prompt_key", F.concat(F.when(F.col("k") % 2 == 0, "later ").otherwise("answer "), F.col("k").cast("string")).alias("response"))
    cache.put(late)
    cache.put(late)
    rows = stored(spark.table(cache.name).select("prompt_key", "response"))
    cache.drop()
    return rows


# ---- diff text to lines


@query("d1_d2_files", over("SELECT change_id, file_no, path, CASE WHEN is_added_file THEN '/dev/null' WHEN is_rename THEN 'old/' || path ELSE path END AS source_path, CASE WHEN is_removed_file THEN '/dev/null' ELSE path END AS target_path, is_binary, is_added_file, is_removed_file, is_rename FROM files"))
def d2(spark, d):
    return scan(spark, d).files


@query("d3_hunks", over("SELECT change_id, file_no, hunk_no, 10 * hunk_no + 1 AS source_start, CAST(count_if(kind <> 'added') AS INT) AS source_length, 10 * hunk_no + 1 AS target_start, CAST(count_if(kind <> 'removed') AS INT) AS target_length, 'def part_' || hunk_no AS section_header FROM lines GROUP BY change_id, file_no, hunk_no"))
def d3(spark, d):
    return scan(spark, d).hunks


@query("d4_d5_number_lines", over("SELECT change_id, file_no, hunk_no, line_idx, kind, content, line_no, source_line_no FROM lines"))
def d5(spark, d):
    return lines.number_lines(corpus.changes(spark, d))


@query("d6_trailing_text", over("SELECT change_id, count(*) AS n_lines FROM lines GROUP BY change_id"))
def d6(spark, d):
    c = corpus.changes(spark, d).withColumn("diff_text", F.concat("diff_text", F.lit("\n\n")))
    return lines.number_lines(c).groupBy("change_id").agg(F.count("*").alias("n_lines"))


@query("d7_parse_status", over("SELECT * FROM state", damaged=True))
def d7(spark, d):
    return lines.parse_status(corpus.changes(spark, d, damage=True))


@query("d8_added_line_numbers", over("SELECT * FROM added"))
def d8(spark, d):
    return scan(spark, d).added


@query("d9_reviewable", over("SELECT change_id, bool_or(kind = 'added') AS reviewable FROM lines GROUP BY change_id"))
def d9(spark, d):
    return scan(spark, d).reviewable


@query("d10_first_file", over("SELECT change_id, path, min(file_no) AS file_no FROM files GROUP BY change_id, path"))
def d10(spark, d):
    return lines.first_file(scan(spark, d).files).select("change_id", "path", "file_no")


@query("d1_plain_diffs", over("SELECT change_id, file_no, hunk_no, line_idx, kind, content, line_no, source_line_no FROM (SELECT * REPLACE (CAST(dense_rank() OVER (PARTITION BY change_id ORDER BY file_no) - 1 AS INT) AS file_no) FROM lines)"))
def d1_plain(spark, d):
    """Diffs without `diff --git` lines, line by line; binary files have no lines there, so they count for no file."""
    c = corpus.changes(spark, d).withColumn("diff_text", F.regexp_replace("diff_text", r"(?m)^(diff --git|new file|deleted file|rename|Binary files).*\n", ""))
    return longdiffs.number_lines(longdiffs.marked(longdiffs.split_lines(c)))



def long_rows(spark, d) -> DataFrame:
    return longdiffs.marked(longdiffs.split_lines(corpus.changes(spark, d, damage=True)))


@query("d4_d6_long_lines", over("SELECT change_id, file_no, hunk_no, line_idx, kind, content, line_no, source_line_no FROM lines", damaged=True))
def d5_long(spark, d):
    """Damaged texts line by line, as for diffs that are larger than a task: the lines of those that can be read."""
    rows = long_rows(spark, d)
    sound = longdiffs.parse_status(rows).where("status = 'ok'").select("change_id")
    return longdiffs.number_lines(rows).join(sound, "change_id", "left_semi")


@query("d1_d3_long_files", over("SELECT f.change_id, file_no, path, is_binary, is_added_file, is_removed_file, is_rename, coalesce(n_hunks, 0) AS n_hunks, coalesce(declared, 0) AS declared FROM files f LEFT JOIN (SELECT change_id, file_no, count(DISTINCT hunk_no) AS n_hunks, CAST(count_if(kind <> 'added') + count_if(kind <> 'removed') AS BIGINT) AS declared FROM lines GROUP BY ALL) h USING (change_id, file_no)", damaged=True))
def d3_long(spark, d):
    rows = long_rows(spark, d)
    sound = longdiffs.parse_status(rows).where("status = 'ok'").select("change_id")
    h = longdiffs.hunks(rows).groupBy("change_id", "file_no").agg(F.count("*").alias("n_hunks"), F.sum(F.col("source_length") + F.col("target_length")).alias("declared"))
    f = longdiffs.files(rows).join(sound, "change_id", "left_semi").join(h, ["change_id", "file_no"], "left")
    return f.select("change_id", "file_no", "path", "is_binary", "is_added_file", "is_removed_file", "is_rename", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hunks", "declared")))


@query("d7_long_status", over("SELECT change_id, status FROM state JOIN (SELECT DISTINCT change_id FROM every_file) USING (change_id) WHERE change_id % 13 <> 4", damaged=True))
def d7_long(spark, d):
    return longdiffs.parse_status(long_rows(spark, d))


# ---- masking

_DOCS = "docs AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_idx, parts[i] AS content, source || '/' || doc_id || '.txt' AS path FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) t(i))"


@query("m1_mask_documents", f"WITH {_DOCS}, {MASKED_DOCS} SELECT doc_id AS change_id, line_idx, safe AS content FROM m WHERE safe <> content")
def m1(spark, d):
    m = masking.mask_lines(corpus.document_lines(spark, d))
    return m.where("masked").select("change_id", "line_idx", "content")


@query("m1_mask_lines", over("SELECT change_id, file_no, hunk_no, line_idx, safe AS content, safe <> content AS masked FROM masked"))
def m1b(spark, d):
    return scan(spark, d).masked.select("change_id", "file_no", "hunk_no", "line_idx", "content", "masked")


@query("m2_entropy", f"SELECT doc_id, w AS word, round(list_entropy(string_split(w, '')), 9) AS bits, {random_sql('w')} AS is_random FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: length(w) >= 20))) AS w FROM documents)")
def m2(spark, d):
    w = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.array_distinct(F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda x: F.length(x) >= 20))).alias("word"))
    return w.select("doc_id", "word", F.round(masking.entropy(F.col("word")), 9).alias("bits"), masking._random(F.col("word")).alias("is_random"))


@query("m3_path_signal", over(f"SELECT path, {SIGNAL} AS signal, count(*) AS n FROM files GROUP BY path"))
def m3(spark, d):
    return scan(spark, d).files.groupBy("path", masking.path_signal(F.col("path")).alias("signal")).agg(F.count("*").alias("n"))


def _hits(table: str, rule: str | None = None) -> str:
    where = f" WHERE rule_id = '{rule}'" if rule else ""
    return over(f"SELECT change_id, file, line, category, severity, confidence, evidence, 'deterministic' AS source, rule_id FROM {table}{where}")


@query("m4_r14_secret_findings", _hits("secret_hits"))
def m4(spark, d):
    return scan(spark, d).of_rule("secrets.detect_secrets").select("change_id", *FOUND)


@query("m5_masked_line_count", f"WITH {_DOCS}, {MASKED_DOCS} SELECT doc_id AS change_id, CAST(count_if(safe <> content) AS BIGINT) AS masked_lines FROM m GROUP BY doc_id")
def m5(spark, d):
    return masking.masked_line_count(masking.mask_lines(corpus.document_lines(spark, d)))


@query("m6_strip_placeholders", over("SELECT change_id, file_no, hunk_no, line_idx, regexp_replace(safe, '\\[MASKED_[A-Z_]*\\]', '', 'g') AS bare FROM masked WHERE safe <> content"))
def m6(spark, d):
    return scan(spark, d).masked.where("masked").select("change_id", "file_no", "hunk_no", "line_idx", masking.without_placeholders(F.col("content")).alias("bare"))


# ---- rules


def _one_rule(name: str, rule_id: str, table: str = "line_hits") -> None:
    @query(name, _hits(table, rule_id))
    def run(spark, d, rule_id=rule_id):
        return scan(spark, d).of_rule(rule_id).select("change_id", *FOUND)


for _n, _r in (("r1_weak_hash", "crypto.weak_hash"), ("r2_weak_cipher", "crypto.weak_cipher"), ("r3_weak_random", "crypto.weak_random"), ("r4_hardcoded_iv", "crypto.hardcoded_iv"), ("r5_code_exec", "injection.code_exec"), ("r6_shell_true", "injection.shell_true"), ("r7_sql_string_build", "injection.sql_string_build"), ("r8_sensitive_log", "logging.sensitive_args"), ("r9_unsafe_redirect", "redirect.unsafe"), ("r10_injection_phrases", "prompt_injection.phrases")):
    _one_rule(_n, _r)


@query("r11_removed_check", _hits("removed_hits"))
def r11(spark, d):
    return scan(spark, d).of_rule("auth.removed_check").select("change_id", *FOUND)


@query("r12_anchor", over("SELECT change_id, file_no, hunk_no, line_idx, anchor FROM scanned WHERE kind = 'removed'"))
def r12(spark, d):
    s = scan(spark, d)
    rows = s.masked.where(~F.col("is_binary") & ~rules.is_manifest(F.col("path")))
    return rules.anchors(rows).where("kind = 'removed'").select("change_id", "file_no", "hunk_no", "line_idx", "anchor")


@query("r13_manifests", _hits("manifest_hits"))
def r13(spark, d):
    return rules.manifest_changes(scan(spark, d).files).select("change_id", *FOUND)


@query("r15_scan", over("SELECT rule_id, severity, confidence, count(*) AS n FROM found WHERE stage = 1 GROUP BY ALL"))
def r15(spark, d):
    s = scan(spark, d)
    return s.found.where("seq.stage = 1").groupBy("rule_id", "severity", "confidence").agg(F.count("*").alias("n"))


@query("r16_suppressions", over("SELECT * FROM suppressed"))
def r16(spark, d):
    return scan(spark, d).suppressed


# ---- filter, size, pack, requests

_HUNK = """hunk AS (SELECT s.change_id, s.file_no, s.path, h.hunk_no, list_filter(h.nums, lambda n: n IS NOT NULL) AS cit, '@@ -' || (10 * hunk_no + 1) || ',' || olds || ' +' || (10 * hunk_no + 1) || ',' || news || ' @@' || chr(10) || body AS text
  FROM shown s JOIN (SELECT change_id, file_no, hunk_no, count_if(kind <> 'added') AS olds, count_if(kind <> 'removed') AS news, list(CASE WHEN kind = 'added' THEN line_no END ORDER BY line_idx) AS nums,
    string_agg(CASE kind WHEN 'added' THEN '+ ' || lpad(CAST(line_no AS VARCHAR), 6, ' ') || ' | ' WHEN 'removed' THEN '-        | ' ELSE '         | ' END || safe, chr(10) ORDER BY line_idx) AS body FROM masked GROUP BY ALL) h USING (change_id, file_no) WHERE s.reason IS NULL)"""
_BLOCK = "'<file path=\"' || path || '\">' || chr(10) || 'citable_lines: [' || array_to_string(cit, ', ') || ']' || chr(10) || text || chr(10) || '</file>'"
_FILE = f"whole AS (SELECT *, {_BLOCK} AS block, CAST(ceil(length({_BLOCK}) / 4.0) AS BIGINT) AS tokens FROM (SELECT change_id, file_no, path, list_sort(flatten(list(cit))) AS cit, string_agg(text, chr(10) ORDER BY hunk_no) AS text FROM hunk GROUP BY ALL))"
# In the corpus a file has two hunks at most: an oversized file falls into one chunk, or into one for each hunk.
_CHUNKS = f"""sized AS (SELECT *, CAST(ceil(length({_BLOCK}) / 4.0) AS BIGINT) AS own FROM hunk),
pieces AS (SELECT change_id, path, file_no, hunk_no, w.tokens > {LIMIT} AS capped, CASE WHEN w.tokens > {LIMIT} AND sum(own) OVER (PARTITION BY change_id, file_no) > {LIMIT} THEN hunk_no - min(hunk_no) OVER (PARTITION BY change_id, file_no) ELSE 0 END AS chunk_no FROM sized JOIN (SELECT change_id, file_no, tokens FROM whole) w USING (change_id, file_no)),
chunk AS (SELECT *, {_BLOCK} AS block, CAST(ceil(length({_BLOCK}) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY change_id ORDER BY path, file_no, chunk_no) AS ord FROM (SELECT change_id, path, file_no, chunk_no, bool_or(capped) AS capped, list_sort(flatten(list(cit))) AS cit, string_agg(text, chr(10) ORDER BY hunk_no) AS text FROM pieces JOIN hunk USING (change_id, path, file_no, hunk_no) GROUP BY ALL)),
packed AS (SELECT change_id, ord, CAST(0 AS INT) AS batch_no, tokens AS used FROM chunk WHERE ord = 1 UNION ALL SELECT c.change_id, c.ord, CASE WHEN p.used + c.tokens > {LIMIT} THEN p.batch_no + 1 ELSE p.batch_no END, CASE WHEN p.used + c.tokens > {LIMIT} THEN c.tokens ELSE p.used + c.tokens END FROM packed p JOIN chunk c ON c.change_id = p.change_id AND c.ord = p.ord + 1),
laid AS (SELECT * FROM chunk JOIN packed USING (change_id, ord))"""


def packing_sql(select: str) -> str:
    return over("", damaged=True).rstrip().replace("WITH raw", "WITH RECURSIVE raw", 1).replace("WITH \nraw", "WITH RECURSIVE\nraw", 1) + f", {_HUNK}, {_FILE}, {_CHUNKS} {select}"


@query("p1_exclusions", over("SELECT change_id, file_no, path, reason AS exclusion_reason FROM shown"))
def p1(spark, d):
    return scan(spark, d).filtered.select("change_id", "file_no", "path", "exclusion_reason")


@query("p2_exclusion_note", over("SELECT change_id, count(*) AS n_excluded, count(*) || ' files excluded from LLM review (' || array_to_string(list_sort(list(DISTINCT reason)), ', ') || ')' AS note FROM shown WHERE reason IS NOT NULL GROUP BY change_id"))
def p2(spark, d):
    return scan(spark, d).notes


@query("p3_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def p3(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tokens(F.col("text")).alias("tokens"))


def requests(spark, d) -> Requests:
    return Requests(whole(spark, d, damage=True), "Review the change for security flaws.", "model-b", "2026-06-01", prices(spark, d), LIMIT)


@query("p4_file_blocks", packing_sql("SELECT change_id, file_no, path, block AS text, tokens FROM whole"))
def p4(spark, d):
    return packing.file_blocks(requests(spark, d).hunk_texts)


@query("p5_p6_pack", packing_sql("SELECT change_id, batch_no, path, file_no, CAST(chunk_no AS INT) AS chunk_no, capped, tokens FROM laid"))
def p6(spark, d):
    return requests(spark, d).blocks.select("change_id", "batch_no", "path", "file_no", "chunk_no", "capped", "tokens")


@query("p5_p6_pack_large", packing_sql("SELECT change_id, file_no, hunk_no, CAST(chunk_no AS INT) AS chunk_no, CAST(batch_no AS INT) AS batch_no, capped FROM pieces JOIN (SELECT change_id, file_no, chunk_no, batch_no FROM laid) USING (change_id, file_no, chunk_no)"))
def p6_large(spark, d):
    """Every change packed the way that large ones are: by prefix sums and doubled steps instead of a fold."""
    return packing.assign(requests(spark, d).hunk_texts, LIMIT, large=0)


@query("p7_batches", packing_sql("SELECT change_id, batch_no, CAST(sum(tokens) AS BIGINT) AS tokens, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths, string_agg(block, chr(10) || chr(10) ORDER BY ord) AS text FROM laid GROUP BY change_id, batch_no"))
def p7(spark, d):
    return requests(spark, d).batches.withColumn("paths", F.array_join("paths", ","))


_OWN = "own AS (SELECT DISTINCT change_id, batch_no, path FROM laid), sup AS (SELECT change_id, batch_no, count(s.path) AS n_suppressed, '[' || string_agg('{\"file\":\"' || s.path || '\",\"line\":' || s.line_no || '}', ',' ORDER BY s.path, s.line_no) || ']' AS j FROM own LEFT JOIN suppressed s USING (change_id, path) GROUP BY ALL)"
_USER = "b.text || chr(10) || chr(10) || CASE WHEN n_suppressed = 0 THEN 'Suppression list: none.' ELSE 'Suppression list, already reported by rules; report none of these pairs:' || chr(10) || j END || chr(10) || chr(10) || 'Review the added lines above.'"
_REQ = f"{_OWN}, req AS (SELECT change_id, batch_no, {_USER} AS user_text FROM (SELECT change_id, batch_no, string_agg(block, chr(10) || chr(10) ORDER BY ord) AS text FROM laid GROUP BY ALL) b JOIN sup USING (change_id, batch_no))"
_KEY = "sha256('model-b' || chr(0) || '-' || chr(0) || 'Review the change for security flaws.' || chr(0) || user_text || chr(0))"


@query("p8_review_requests", packing_sql(f", {_REQ} SELECT change_id, batch_no, user_text FROM req").replace(" , own", ", own"))
def p8(spark, d):
    return requests(spark, d).reviews.select("change_id", "batch_no", F.col("user").alias("user_text"))


def summary_sql(findings: str) -> str:
    """CTE sums(change_id, n_findings, n_reviewed, n_excluded, user_text) of summary requests."""
    return f"""sums AS (SELECT change_id, coalesce(n, 0) AS n_findings, n_reviewed, n_excluded, to_json(struct_pack(files_excluded := coalesce(x, []), files_reviewed := coalesce(r, []), findings := coalesce(fs, []))) AS user_text
      FROM (SELECT change_id, count(*) FILTER (reason IS NULL) AS n_reviewed, count(*) FILTER (reason IS NOT NULL) AS n_excluded, list_sort(list(path) FILTER (reason IS NULL)) AS r, list_sort(list(path || ' (' || reason || ')') FILTER (reason IS NOT NULL)) AS x FROM shown GROUP BY 1)
      LEFT JOIN (SELECT change_id, count(*) AS n, list({PUBLIC} ORDER BY file, coalesce(line, -1), category) AS fs FROM {findings} GROUP BY 1) USING (change_id))"""


@query("p9_summary_requests", over(f", {summary_sql('det')} SELECT change_id, sha256(user_text) AS user_sha256 FROM sums", damaged=True))
def p9(spark, d):
    s = whole(spark, d, damage=True)
    return packing.summary_requests(s.filtered, s.findings, "Sum up.").select("change_id", F.sha2(F.col("user").cast("binary"), 256).alias("user_sha256"))


@query("p10_request_keys", packing_sql(f", {_REQ} SELECT change_id, batch_no, {_KEY} AS prompt_key FROM req").replace(" , own", ", own"))
def p10(spark, d):
    return requests(spark, d).reviews.select("change_id", "batch_no", "prompt_key")


#: A price list derived from the part table's first rows would be arbitrary; models and rates are parameters of a run.
PRICES = "VALUES ('model-a', DATE '2000-01-01', DATE '2099-12-31', 3.0, 15.0), ('model-b', DATE '2000-01-01', DATE '2026-08-31', 2.0, 10.0), ('model-b', DATE '2026-09-01', DATE '2099-12-31', 3.0, 15.0), ('model-c', DATE '2000-01-01', DATE '2099-12-31', 10.0, 50.0)"


def prices(spark, d) -> DataFrame:
    return spark.sql(f"SELECT col1 AS model, col2 AS valid_from, col3 AS valid_to, CAST(col4 AS DOUBLE) AS rate_in, CAST(col5 AS DOUBLE) AS rate_out FROM {PRICES}")


_CALLS = """calls AS (SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY c) AS INT) AS call_no, 'call-' || c AS label, model, run_date, tokens, output_tokens, cache_read, cache_write, hit FROM
  (SELECT l_orderkey AS change_id, l_linenumber AS c, CASE l_orderkey % 4 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' WHEN 2 THEN 'model-c' ELSE 'model-x' END AS model, CAST(max(l_shipdate) AS DATE) AS run_date,
   CAST(sum(l_quantity) * 100 AS BIGINT) AS tokens, CAST(sum(l_suppkey) AS BIGINT) AS output_tokens, CAST(sum(l_partkey) AS BIGINT) AS cache_read, CAST(min(l_partkey) AS BIGINT) AS cache_write, l_orderkey % 5 = 0 AS hit FROM lineitem GROUP BY l_orderkey, l_linenumber))"""
_RATED = f"""prices(model, valid_from, valid_to, rate_in, rate_out) AS ({PRICES}), {_CALLS},
rated AS (SELECT c.*, CAST(coalesce(p.rate_in, 10.0) AS DOUBLE) AS rate_in, CAST(coalesce(p.rate_out, 50.0) AS DOUBLE) AS rate_out FROM calls c LEFT JOIN prices p ON p.model = c.model AND c.run_date BETWEEN p.valid_from AND p.valid_to),
costed AS (SELECT *, (tokens * rate_in + 2000 * rate_out) / 1e6 AS worst, (tokens * rate_in + cache_read * rate_in * CAST(0.1 AS DOUBLE) + cache_write * rate_in * CAST(1.25 AS DOUBLE) + output_tokens * rate_out) / 1e6 AS actual FROM rated),
spent AS (SELECT *, coalesce(sum(CASE WHEN hit THEN 0 ELSE actual END) OVER (PARTITION BY change_id ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM costed),
flagged AS (SELECT *, NOT hit AND tokens > 4500 AS over_tokens, NOT hit AND tokens <= 4500 AND spent + worst > 0.2 AS over_cost FROM spent)"""


def calls(spark, d) -> DataFrame:
    """Calls derived from lineitem: one for each order and line number."""
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("diffloom_lineitem")
    c = spark.sql("WITH " + _CALLS.replace("FROM lineitem", "FROM diffloom_lineitem") + " SELECT * FROM calls").withColumnRenamed("tokens", "input_tokens").withColumn("tokens", F.col("input_tokens"))
    c = cost.with_rates(c, prices(spark, d))
    return c.withColumn("worst", cost.worst_cost(F.col("tokens"), F.lit(cost.SUMMARY_OUTPUT))).withColumn("actual", cost.usage_cost())


@query("p11_worst_cost", f"WITH {_RATED} SELECT change_id, call_no, round(worst, 9) AS worst FROM costed")
def p11(spark, d):
    return calls(spark, d).select("change_id", "call_no", F.round("worst", 9).alias("worst"))


@query("p12_rates", f"WITH {_RATED} SELECT change_id, call_no, model, CAST(rate_in AS DOUBLE) AS rate_in, CAST(rate_out AS DOUBLE) AS rate_out FROM rated")
def p12(spark, d):
    return calls(spark, d).select("change_id", "call_no", "model", "rate_in", "rate_out")


@query("p13_dry_run", f"WITH {_RATED} SELECT change_id, label, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(worst), 9) AS cost, count(*) AS calls FROM costed GROUP BY GROUPING SETS ((change_id, label), (change_id))")
def p13(spark, d):
    return cost.dry_run(calls(spark, d)).withColumn("cost", F.round("cost", 9))


def _half_cached(spark, d) -> tuple[ResponseCache, DataFrame]:
    r = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("change_id")).distinct().withColumn("prompt_key", F.sha2(F.col("change_id").cast("string"), 256))
    cache = new_cache(spark)
    cache.put(r.where("change_id % 3 = 0").select("prompt_key", F.lit("{}").alias("response")))
    return cache, r


@query("p14_uncached", "SELECT DISTINCT l_orderkey AS change_id FROM lineitem WHERE l_orderkey % 3 <> 0")
def p14(spark, d):
    cache, r = _half_cached(spark, d)
    rows = stored(cache.misses(r).select("change_id"))
    cache.drop()
    return rows


@query("p14_cached", "SELECT DISTINCT l_orderkey AS change_id FROM lineitem WHERE l_orderkey % 3 = 0")
def p14b(spark, d):
    cache, r = _half_cached(spark, d)
    rows = stored(cache.hits(r).select("change_id"))
    cache.drop()
    return rows


# ---- responses


def answers(spark, d) -> DataFrame:
    """Responses derived from the orders: good, fenced and broken in seven ways; two findings in each good review."""
    o = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("change_id")).distinct()
    # ids are few bytes, but the responses made of them are not. By the id itself the distinct's own exchange would do, and be coalesced to one task
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    o = o.repartition(n, F.xxhash64("change_id"))
    k = F.col("change_id") % 7
    path = F.element_at(F.array(*map(F.lit, corpus.PATHS)), ((F.col("change_id") * 5) % len(corpus.PATHS) + 1).cast("int"))
    one = lambda file, line, cat, sev, conf, more="": F.concat(F.lit('{"file":"'), file, F.lit('","line":'), line, F.lit(f',"category":"{cat}","severity":"'), F.lit(sev), F.lit(f'","confidence":"{conf}","evidence":"model saw it","risk":"risk {cat}","recommendation":"fix {sev}"{more}}}'))
    c = F.col("change_id")
    line = F.when(c % 6 == 0, "1").when(c % 6 == 2, "1.0").when(c % 6 == 4, "1e0").when(c % 6 == 1, '"2"').when(c % 6 == 3, '7,"line":2').otherwise("2")
    first = one(path, line, "crypto_misuse", "medium", "high")
    second = one(F.when(c % 5 == 0, "nope.py").otherwise(path), F.when(c % 3 == 0, "null").when(c % 4 == 1, "99999999999").otherwise("999"), "injection", "high", "low")
    wrap = lambda *f: F.concat(F.lit('{"findings":['), F.concat_ws(",", *f), F.lit("]}"))
    good = wrap(first, second, second)
    review = (
        F.when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```\n")))
        .when(k == 2, "I found nothing")
        .when(k == 3, wrap(one(path, F.lit("1"), "injection", "high", "low", ',"extra":1')))
        .when(k == 4, wrap(one(path, F.lit("1"), "hardcoded_secrets", "high", "low")))
        .when(k == 5, wrap(one(path, F.lit("1.5"), "injection", "high", "low")))
        .when(k == 6, "{}")
        .otherwise(good)
    )
    risk = F.when(F.col("change_id") % 9 == 0, "grave").otherwise("medium")
    summary = F.concat(F.lit('{"summary":"sum '), F.col("change_id").cast("string"), F.lit('","overall_risk":"'), risk, F.lit('","pr_comment":"comment"}'))
    both = o.select("change_id", F.explode(F.array(F.struct(F.lit("review").alias("call"), F.lit(0).alias("batch_no"), F.lit(1).alias("call_no"), F.when(F.col("change_id") % 31 != 0, review).alias("response")), F.struct(F.lit("summary").alias("call"), F.lit(0).alias("batch_no"), F.lit(2).alias("call_no"), F.when(F.col("change_id") % 37 != 0, summary).alias("response")))).alias("c"))
    return both.select("change_id", "c.*")


_ORDERS = "o AS (SELECT DISTINCT l_orderkey AS change_id FROM lineitem)"
_CHECKED = f"{_ORDERS}, checked AS (SELECT change_id, 'review' AS call, CASE WHEN change_id % 31 = 0 THEN 'not a JSON object' ELSE CASE change_id % 7 WHEN 2 THEN 'not a JSON object' WHEN 3 THEN 'bad finding' WHEN 4 THEN 'bad finding' WHEN 5 THEN 'bad finding' END END AS error FROM o UNION ALL SELECT change_id, 'summary', CASE WHEN change_id % 37 = 0 THEN 'not a JSON object' WHEN change_id % 9 = 0 THEN 'bad risk' END FROM o)"
_PATH = "CASE (change_id * 5) % " + str(len(corpus.PATHS)) + " " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(corpus.PATHS)) + " END"
_SECOND = f"SELECT change_id, CASE WHEN change_id % 5 = 0 THEN 'nope.py' ELSE {_PATH} END AS file, CASE WHEN change_id % 3 = 0 THEN NULL WHEN change_id % 4 = 1 THEN 99999999999 ELSE 999 END AS line, 'injection' AS category, 'high' AS severity, 'low' AS confidence"


def _finding_sql(file: str, line: str, category: str, severity: str, confidence: str, more: str = "") -> str:
    tail = f',"category":"{category}","severity":"{severity}","confidence":"{confidence}","evidence":"model saw it","risk":"risk {category}","recommendation":"fix {severity}"{more}}}'
    return f"""'{{"file":"' || {file} || '","line":' || {line} || '{tail}'"""


def _listed_sql(*findings: str) -> str:
    return """'{"findings":[' || """ + " || ',' || ".join(findings) + " || ']}'"


_FIRST_TEXT = _finding_sql(_PATH, """CASE change_id % 6 WHEN 0 THEN '1' WHEN 2 THEN '1.0' WHEN 4 THEN '1e0' WHEN 1 THEN '"2"' WHEN 3 THEN '7,"line":2' ELSE '2' END""", "crypto_misuse", "medium", "high")
_SECOND_TEXT = _finding_sql(f"CASE WHEN change_id % 5 = 0 THEN 'nope.py' ELSE {_PATH} END", "CASE WHEN change_id % 3 = 0 THEN 'null' WHEN change_id % 4 = 1 THEN '99999999999' ELSE '999' END", "injection", "high", "low")
_GOOD_TEXT = _listed_sql(_FIRST_TEXT, _SECOND_TEXT, _SECOND_TEXT)
_EXTRA_TEXT = _listed_sql(_finding_sql(_PATH, "'1'", "injection", "high", "low", ',"extra":1'))
_MASKER_TEXT = _listed_sql(_finding_sql(_PATH, "'1'", "hardcoded_secrets", "high", "low"))
_HALF_TEXT = _listed_sql(_finding_sql(_PATH, "'1.5'", "injection", "high", "low"))
#: The recorded response to a change's call, character by character; null where there is none.
_REVIEW_TEXT = f"""CASE WHEN change_id % 31 = 0 THEN NULL ELSE CASE change_id % 7 WHEN 1 THEN '```json' || chr(10) || {_GOOD_TEXT} || chr(10) || '```' || chr(10) WHEN 2 THEN 'I found nothing'
  WHEN 3 THEN {_EXTRA_TEXT} WHEN 4 THEN {_MASKER_TEXT} WHEN 5 THEN {_HALF_TEXT} WHEN 6 THEN '{{}}' ELSE {_GOOD_TEXT} END END"""
_SUMMARY_TEXT = """CASE WHEN change_id % 37 <> 0 THEN '{"summary":"sum ' || change_id || '","overall_risk":"' || CASE WHEN change_id % 9 = 0 THEN 'grave' ELSE 'medium' END || '","pr_comment":"comment"}' END"""
_GOOD = "change_id % 7 IN (0, 1) AND change_id % 31 <> 0"
_MODEL = f"model AS (SELECT change_id, {_PATH} AS file, CASE WHEN change_id % 2 = 0 THEN 1 ELSE 2 END AS line, 'crypto_misuse' AS category, 'medium' AS severity, 'high' AS confidence, 0 AS pos FROM o WHERE {_GOOD} UNION ALL {_SECOND}, 1 FROM o WHERE {_GOOD} UNION ALL {_SECOND}, 2 FROM o WHERE {_GOOD})"


@query("s3_read_responses", f"WITH {_ORDERS} SELECT 'review-' || change_id AS label, {_REVIEW_TEXT} AS response FROM o UNION ALL SELECT 'summary-' || change_id, {_SUMMARY_TEXT} FROM o")
def s3(spark, d):
    """Every change's recorded responses, written as a table and read by label."""
    out = shared(spark)
    sinks.labelled(answers(spark, d).withColumn("stem", F.col("change_id")).withColumn("n_batches", F.lit(1))).select("label", "response").write.parquet(out)
    return diffs.read_response_table(spark, out)


@query("j1_j2_decode", f"WITH {_ORDERS} SELECT change_id, NOT (change_id % 7 = 2 OR change_id % 31 = 0) AS is_object FROM o")
def j2(spark, d):
    return responses.decode(answers(spark, d).where("call = 'review'")).select("change_id", F.col("doc").isNotNull().alias("is_object"))


@query("j3_j4_contract", f"WITH {_CHECKED} SELECT change_id, call, error, error IS NULL AS valid FROM checked")
def j3(spark, d):
    return responses.check(answers(spark, d)).select("change_id", "call", "error", "valid")


@query("j5_model_findings", f"WITH {_ORDERS}, {_MODEL} SELECT change_id, pos, file, CAST(line AS VARCHAR) AS line, category, severity, confidence, 'risk ' || category AS risk FROM model")
def j5(spark, d):
    return responses.model_findings(responses.check(answers(spark, d))).select("change_id", "seq.pos", "file", F.col("line").cast("string").alias("line"), "category", "severity", "confidence", "risk")


@query("j6_malformed_raw", f"WITH {_CHECKED} SELECT change_id, call, error, CASE WHEN call = 'summary' THEN {_SUMMARY_TEXT} ELSE {_REVIEW_TEXT} END AS raw FROM checked WHERE error IS NOT NULL")
def j6(spark, d):
    """The raw text of every malformed response, missing ones too."""
    return responses.check(answers(spark, d)).where("NOT valid").select("change_id", "call", "error", F.col("response").alias("raw"))


# ---- validate, cap, merge

_VALID = "known AS (SELECT * FROM model WHERE EXISTS (SELECT 1 FROM files f WHERE f.change_id = model.change_id AND f.path = model.file)), mapped AS (SELECT known.*, a.line_no IS NULL AND line IS NOT NULL AS unmapped, a.line_no AS fixed FROM known LEFT JOIN added a ON a.change_id = known.change_id AND a.path = known.file AND a.line_no = known.line)"


def model_sql(select: str) -> str:
    return over(f", {_ORDERS}, {_MODEL}, {_VALID} {select}")


def _model(spark, d):
    return responses.model_findings(responses.check(answers(spark, d)))


def _sought(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the model's findings, files, added lines): what lines are sought by. Findings and files, which several steps read, are written once; nothing is masked."""
    s = scan(spark, d)
    files = stored(s.files.select("change_id", "file_no", "path"))
    return stored(_model(spark, d)), files, lines.added_lines(s.lines, files)


@query("v1_known_files", model_sql("SELECT change_id, file, pos FROM known"))
def v1(spark, d):
    return merging.known_files(_model(spark, d), scan(spark, d).files).select("change_id", "file", "seq.pos")


@query("v1_unknown_files", model_sql("SELECT change_id, file, pos FROM model WHERE file = 'nope.py'"))
def v1b(spark, d):
    return merging.unknown_files(_model(spark, d), scan(spark, d).files).select("change_id", "file", "seq.pos")


@query("v2_mapped_lines", model_sql("SELECT change_id, file, pos, fixed AS line, unmapped FROM mapped"))
def v2(spark, d):
    m, files, added = _sought(spark, d)
    return merging.mapped_lines(merging.known_files(m, files), added).select("change_id", "file", "seq.pos", "line", "unmapped")


@query("v3_validation_stats", model_sql("SELECT change_id, count(u) AS unmappable_count, count(h) AS hallucinated_file_count, array_to_string(list_sort(list(u) FILTER (u IS NOT NULL)), ',') AS unmappable, array_to_string(list_sort(list(h) FILTER (h IS NOT NULL)), ',') AS hallucinated FROM (SELECT change_id, CASE WHEN unmapped THEN file || ':' || line END AS u, NULL AS h FROM mapped UNION ALL SELECT change_id, NULL, file FROM model WHERE file = 'nope.py') GROUP BY change_id HAVING count(u) + count(h) > 0"))
def v3(spark, d):
    r = merging.validation_stats(*_sought(spark, d)).where("unmappable_count + hallucinated_file_count > 0")
    lists = (F.when(F.size(c) > 0, F.array_join(c, ",")).alias(n) for c, n in (("unmappable_lines", "unmappable"), ("hallucinated_files", "hallucinated")))
    return r.select("change_id", "unmappable_count", "hallucinated_file_count", *lists)


_CAPPED = "list_extract(['low', 'medium', 'high'], 1 + least(list_position(['low', 'medium', 'high'], confidence) - 1, CASE WHEN change_id % 2 = 0 THEN 1 ELSE 2 END))"


def _packed(spark, d):
    return scan(spark, d).files.select("change_id", F.lit(0).alias("batch_no"), "path", (F.col("change_id") % 2 == 0).alias("capped"))


@query("v4_confidence_caps", model_sql(f"SELECT change_id, file, pos, {_CAPPED} AS confidence FROM known"))
def v4(spark, d):
    f = merging.known_files(_model(spark, d), scan(spark, d).files)
    return merging.capped(f, _packed(spark, d)).select("change_id", "file", "seq.pos", "confidence")


@query("v5_strongest_rules", _hits("det"))
def v5(spark, d):
    return scan(spark, d).findings.select("change_id", *FOUND)


_BEST = f"capped AS (SELECT * REPLACE (fixed AS line, {_CAPPED} AS confidence) FROM mapped), llm AS (SELECT *, row_number() OVER (PARTITION BY change_id, file, line, category ORDER BY list_position(['low', 'medium', 'high'], confidence) DESC, pos) AS n, first_value(severity) OVER (PARTITION BY change_id, file, line, category ORDER BY pos) AS fs FROM capped)"


@query("v6_strongest_model", model_sql(f", {_BEST} SELECT change_id, file, line, category, severity, confidence FROM llm WHERE n = 1").replace(" , capped", ", capped"))
def v6(spark, d):
    return merging.strongest(merged(spark, d)[0]).select("change_id", "file", "line", "category", "severity", "confidence")


def merged(spark, d) -> tuple[DataFrame, DataFrame]:
    """(the model's findings, both detectors' findings) of the answers, whatever became of their calls."""
    s = whole(spark, d)
    f = merging.mapped_lines(merging.known_files(stored(_model(spark, d)), s.files), s.added).drop("unmapped")
    f = merging.capped(f, s.files.select("change_id", F.lit(0).alias("batch_no"), "path", (F.col("change_id") % 2 == 0).alias("capped")))
    f = stored(f)
    return f, merging.merge(s.found, f)


_MERGED = f"""{_BEST}, merged AS (SELECT coalesce(d.change_id, m.change_id) AS change_id, coalesce(d.file, m.file) AS file, coalesce(d.line, m.line) AS line, coalesce(d.category, m.category) AS category,
  CASE WHEN m.file IS NULL THEN d.severity WHEN d.file IS NULL THEN m.severity WHEN list_position(['low', 'medium', 'high'], d.severity) >= list_position(['low', 'medium', 'high'], m.fs) THEN d.severity ELSE m.fs END AS severity,
  CASE WHEN m.file IS NULL THEN d.confidence WHEN d.file IS NULL THEN m.confidence ELSE 'high' END AS confidence, coalesce(d.evidence, 'model saw it') AS evidence, CASE WHEN m.file IS NULL THEN d.risk ELSE 'risk ' || m.category END AS risk, CASE WHEN m.file IS NULL THEN d.recommendation WHEN d.file IS NULL THEN 'fix ' || m.severity ELSE 'fix ' || m.fs END AS recommendation,
  CASE WHEN m.file IS NULL THEN 'deterministic' WHEN d.file IS NULL THEN 'llm' ELSE 'both' END AS source, d.rule_id FROM det d FULL JOIN (SELECT * FROM llm WHERE n = 1) m ON d.change_id = m.change_id AND d.file = m.file AND d.category = m.category AND d.line IS NOT DISTINCT FROM m.line)"""


def merged_sql(select: str) -> str:
    return model_sql(f", {_MERGED} {select}").replace(" , capped", ", capped")


@query("v7_merge", merged_sql("SELECT * FROM merged"))
def v7(spark, d):
    return merged(spark, d)[1].select("change_id", *FOUND, "risk", "recommendation")


@query("v8_order", merged_sql("SELECT change_id, array_to_string(list(file || ':' || coalesce(line, -1) || ':' || category ORDER BY file, coalesce(line, -1), category), '|') AS keys FROM merged GROUP BY change_id"))
def v8(spark, d):
    """The keys of each change in the order of the sorted rows: their places are read off before they are grouped."""
    f = merging.ordered(merged(spark, d)[1]).withColumn("place", F.monotonically_increasing_id())
    key = F.concat("file", F.lit(":"), F.coalesce("line", F.lit(-1)).cast("string"), F.lit(":"), "category")
    return f.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("place", key.alias("key")))).alias("k")).select("change_id", F.array_join("k.key", "|").alias("keys"))


@query("v9_union", _hits("found"))
def v9(spark, d):
    return scan(spark, d).found.select("change_id", *FOUND)


@query("v10_overall_risk", over("SELECT change_id, list_extract(['low', 'medium', 'high'], CAST(coalesce(max(sr), 0) AS INT) + 1) AS overall_risk FROM (SELECT DISTINCT change_id FROM files) LEFT JOIN det USING (change_id) GROUP BY change_id"))
def v10(spark, d):
    s = scan(spark, d)
    return merging.overall_risk(s.changes, s.findings)


# ---- assemble and render


@query("o1_o2_severity_counts", over("SELECT change_id, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, count(DISTINCT file) AS n_files, array_to_string(list_filter([CASE WHEN count_if(severity = 'high') > 0 THEN count_if(severity = 'high') || ' high' END, CASE WHEN count_if(severity = 'medium') > 0 THEN count_if(severity = 'medium') || ' medium' END, CASE WHEN count_if(severity = 'low') > 0 THEN count_if(severity = 'low') || ' low' END], lambda x: x IS NOT NULL), ' · ') AS counts FROM det GROUP BY change_id", damaged=True))
def o1(spark, d):
    return reports.severity_counts(scan(spark, d, damage=True).findings)


@query("o3_o4_review", over(f", {reviews_sql('det')} SELECT change_id, summary, overall_risk, pr_comment, len(fs) AS n_findings, sha256(to_json(fs)) AS findings_sha256, no_findings_reason FROM review", damaged=True))
def o3(spark, d):
    r = whole(spark, d, damage=True).reviews()
    one = F.transform("findings", lambda x: F.struct(*(x[k].alias(k) for k in sorted(reports.PUBLIC))))
    return r.select("change_id", "summary", "overall_risk", "pr_comment", F.size("findings").cast("long").alias("n_findings"), F.sha2(F.to_json(one, {"ignoreNullFields": "false"}).cast("binary"), 256).alias("findings_sha256"), "no_findings_reason")


_GOOD_SUMMARIES = f"(SELECT change_id, 'sum ' || change_id AS s, 'medium' AS r, 'comment' AS c FROM (SELECT DISTINCT l_orderkey AS change_id FROM lineitem) WHERE change_id % 9 <> 0 AND change_id % 37 <> 0) good"


@query("o3_with_summary", over(f", {reviews_sql('det', _GOOD_SUMMARIES)} SELECT change_id, overall_risk, summary, pr_comment, no_findings_reason FROM review", damaged=True))
def o3b(spark, d):
    r = whole(spark, d, damage=True).reviews(summaries=responses.summaries(responses.check(answers(spark, d))))
    return r.select("change_id", "overall_risk", "summary", "pr_comment", "no_findings_reason")


@query("o5_by_file", over("SELECT change_id, file, array_to_string(list(coalesce(line, -1) || ':' || category ORDER BY sr DESC, cr DESC, coalesce(line, -1), category), '|') AS listed FROM det GROUP BY change_id, file"))
def o5(spark, d):
    return reports.by_file(scan(spark, d).findings).select("change_id", "file", F.array_join(F.transform("findings", lambda x: F.concat(F.coalesce(x["line"], F.lit(-1)).cast("string"), F.lit(":"), x["category"])), "|").alias("listed"))


@query("o6_flatten", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS flat FROM documents")
def o6(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", flatten(F.col("text")).alias("flat"))


@query("o7_markdown", over(f", {reviews_sql('det')}, {markdown_sql('det')} SELECT change_id, length(md) AS n_chars, sha256(md) AS md_sha256 FROM pages", damaged=True))
def o7(spark, d):
    s = whole(spark, d, damage=True)
    return reports.to_markdown(s.keep(s.reviews()), s.findings, s.notes).select("change_id", F.length("md").cast("long").alias("n_chars"), F.sha2(F.col("md").cast("binary"), 256).alias("md_sha256"))


@query("o8_public", over("SELECT change_id, file, line, category, severity, confidence, evidence, risk, recommendation FROM det"))
def o8(spark, d):
    return reports.public(scan(spark, d).findings)


@query("o9_gate", over("SELECT change_id, bool_or(severity = 'high') AS gated FROM det GROUP BY change_id"))
def o9(spark, d):
    return outcome.gate(scan(spark, d).findings)


# ---- outcome, usage, tuning


@query("u1_usage_cost", f"WITH {_RATED} SELECT change_id, call_no, round(actual, 9) AS actual FROM costed")
def u1(spark, d):
    return calls(spark, d).select("change_id", "call_no", F.round("actual", 9).alias("actual"))


@query("u2_u3_budgets", f"WITH {_RATED} SELECT change_id, call_no, round(spent, 9) AS spent, over_tokens, over_cost, NOT (coalesce(bool_or(over_tokens OR over_cost) OVER (PARTITION BY change_id ORDER BY call_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR over_tokens OR over_cost) AS made FROM flagged")
def u2(spark, d):
    return cost.budgets(calls(spark, d), 4500, 0.2).select("change_id", "call_no", F.round("spent", 9).alias("spent"), "over_tokens", "over_cost", "made")


#: Budgets of the run below: they stop some of its calls.
CALL_TOKENS, RUN_COST = 220, 0.3
SYSTEM = "Review the change for security flaws."


def review_answers(requests: DataFrame) -> DataFrame:
    """requests(prompt_key, path, ...) that are answered, with k and response: a function of the first two digits of the key."""
    r = requests.withColumn("k", F.conv(F.substring("prompt_key", 1, 2), 16, 10).cast("int"))
    one = lambda file, line, cat, sev, conf: F.concat(F.lit('{"file":"'), file, F.lit('","line":'), line, F.lit(f',"category":"{cat}","severity":"{sev}","confidence":"{conf}","evidence":"model saw it","risk":"risk {cat}","recommendation":"fix {sev}"}}'))
    first = one(F.col("path"), F.when(F.col("k") % 3 == 0, "null").when(F.col("k") % 3 == 1, "1").otherwise("999"), "crypto_misuse", "medium", "high")
    file = F.when(F.col("k") % 5 == 0, "nope.py").otherwise(F.col("path"))
    good = F.concat(F.lit('{"findings":['), F.concat_ws(",", first, one(file, F.lit("1"), "injection", "high", "low"), one(file, F.lit("1"), "injection", "medium", "medium")), F.lit("]}"))
    text = F.when(F.col("k") < 12, "I found nothing").when(F.col("k") % 2 == 0, good).otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    return r.where("k NOT BETWEEN 12 AND 23").withColumn("response", text)


def summary_answers(requests: DataFrame) -> DataFrame:
    """The same of summary requests: of the numbers of findings and files."""
    shape = F.from_json("user", "files_excluded array<string>, files_reviewed array<string>, findings array<struct<file:string>>")
    s = requests.withColumn("j", shape).withColumn("k", (F.size("j.findings") * 7 + F.size("j.files_reviewed") * 3 + F.size("j.files_excluded")) % 9)
    text = F.concat(F.lit('{"summary":"sum '), F.col("k").cast("string"), F.lit('","overall_risk":"'), F.when(F.col("k") == 1, "grave").otherwise("medium"), F.lit('","pr_comment":"comment"}'))
    return s.where("k <> 0").withColumn("response", text)


def run(spark, d, cache: ResponseCache | None = None) -> Reviewed:
    """A whole run over changes some of which can't be read. Every response is a function of its request: of the first two digits of the key
    for a review (some malformed, some missing), of the numbers of findings and files for a summary."""
    s = whole(spark, d, damage=True)
    requests = Requests(s, SYSTEM, "model-b", "2026-06-01", prices(spark, d), LIMIT)
    usage = ("input_tokens", "output_tokens", "cache_read", "cache_write")
    r = requests.reviews.join(requests.blocks.groupBy("change_id", "batch_no").agg(F.min("path").alias("path")), ["change_id", "batch_no"])
    given = review_answers(r).select("prompt_key", "response", F.col("tokens").alias(usage[0]), (100 * F.col("k")).cast("long").alias(usage[1]), *(F.lit(0).cast("long").alias(c) for c in usage[2:]))
    reviews = Reviewed(requests, given, CALL_TOKENS, RUN_COST, cache)
    said = summary_answers(requests.summaries(reviews.merged)).select("prompt_key", "response", F.col("tokens").alias(usage[0]), *(F.lit(0).cast("long").alias(c) for c in usage[1:]))
    done = Reviewed(requests, s.keep(given.unionByName(said)), CALL_TOKENS, RUN_COST, cache)
    done.merged = reviews.merged  # the summaries' responses change nothing before them
    done.review_calls, done.review_failures = reviews.review_calls, reviews.review_failures
    return done


_HEX = "0123456789abcdef"
_RUN_MODEL = ", ".join(
    (
        f"keyed AS (SELECT change_id, batch_no, {_KEY} AS prompt_key, CAST(ceil(length('{SYSTEM}') / 4.0) + ceil(length(user_text) / 4.0) AS BIGINT) AS tokens FROM req)",
        f"called AS (SELECT *, (strpos('{_HEX}', substr(prompt_key, 1, 1)) - 1) * 16 + strpos('{_HEX}', substr(prompt_key, 2, 1)) - 1 AS k FROM keyed)",
        "costed AS (SELECT *, (tokens * 2.0 + 8000 * 10.0) / 1e6 AS worst, CASE WHEN k BETWEEN 12 AND 23 THEN 0 ELSE (tokens * 2.0 + 100 * k * 10.0) / 1e6 END AS actual FROM called)",
        "run_spent AS (SELECT *, coalesce(sum(actual) OVER (PARTITION BY change_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM costed)",
        f"run_results AS (SELECT *, CASE WHEN tokens > {CALL_TOKENS} OR spent + worst > {RUN_COST} THEN 'budget' WHEN k BETWEEN 12 AND 23 THEN 'api_error' WHEN k < 12 THEN 'malformed' ELSE 'ok' END AS result FROM run_spent)",
        "review_failed AS (SELECT change_id, min_by(result, batch_no) AS result FROM run_results WHERE result <> 'ok' GROUP BY 1)",
        "good_calls AS (SELECT c.change_id, c.batch_no, c.k, p.file FROM run_results c JOIN (SELECT change_id, batch_no, min(path) AS file FROM laid GROUP BY ALL) p USING (change_id, batch_no) WHERE c.k > 23 AND c.change_id NOT IN (SELECT change_id FROM review_failed))",
        "model AS (SELECT change_id, batch_no, 0 AS pos, file, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 999 END AS line, 'crypto_misuse' AS category, 'medium' AS severity, 'high' AS confidence FROM good_calls UNION ALL SELECT change_id, batch_no, p, CASE WHEN k % 5 = 0 THEN 'nope.py' ELSE file END, 1, 'injection', CASE p WHEN 1 THEN 'high' ELSE 'medium' END, CASE p WHEN 1 THEN 'low' ELSE 'medium' END FROM good_calls, (VALUES (1), (2)) t(p))",
        _VALID,
        "capped AS (SELECT m.* REPLACE (fixed AS line, CASE WHEN c.hit AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence) FROM mapped m LEFT JOIN (SELECT DISTINCT change_id, batch_no, path AS file, true AS hit FROM laid WHERE capped) c USING (change_id, batch_no, file))",
        "llm AS (SELECT *, row_number() OVER (PARTITION BY change_id, file, line, category ORDER BY list_position(['low', 'medium', 'high'], confidence) DESC, batch_no, pos) AS n, first_value(severity) OVER (PARTITION BY change_id, file, line, category ORDER BY batch_no, pos) AS fs FROM capped)",
        _MERGED[len(_BEST) + 2 :].replace("merged AS (", "merged_any AS ("),
        "merged AS (SELECT * FROM merged_any WHERE change_id IN (SELECT change_id FROM lines WHERE kind = 'added'))",
        summary_sql("merged"),
        f"sum_calls AS (SELECT s.*, (n_findings * 7 + n_reviewed * 3 + n_excluded) % 9 AS k, CAST(ceil(length('{SYSTEM}') / 4.0) + ceil(length(user_text) / 4.0) AS BIGINT) AS tokens, t.spent FROM sums s JOIN (SELECT change_id, sum(actual) AS spent FROM costed GROUP BY 1) t USING (change_id) WHERE change_id NOT IN (SELECT change_id FROM review_failed))",
        f"sum_results AS (SELECT *, CASE WHEN tokens > {CALL_TOKENS} OR spent + (tokens * 2.0 + 2000 * 10.0) / 1e6 > {RUN_COST} THEN 'budget' WHEN k = 0 THEN 'api_error' WHEN k = 1 THEN 'malformed' ELSE 'ok' END AS result FROM sum_calls)",
        "failed AS (SELECT change_id, result, 'review' AS call FROM review_failed UNION ALL SELECT change_id, result, 'summary' FROM sum_results WHERE result <> 'ok')",
        "ended AS (SELECT change_id, CASE WHEN status = 'parse_error' THEN 1 WHEN NOT coalesce(rev, false) THEN 0 WHEN result = 'malformed' THEN 2 WHEN result = 'budget' THEN 3 WHEN g THEN 4 ELSE 0 END AS outcome, NOT coalesce(rev AND result = 'api_error' AND call = 'review', false) AS keep_model FROM state LEFT JOIN (SELECT change_id, bool_or(kind = 'added') AS rev FROM lines GROUP BY 1) USING (change_id) LEFT JOIN failed USING (change_id) LEFT JOIN (SELECT change_id, bool_or(severity = 'high') AS g FROM merged GROUP BY 1) USING (change_id))",
    )
)


def run_sql(select: str) -> str:
    return packing_sql(f", {_REQ}, {_RUN_MODEL} {select}").replace(" , own", ", own")


@query("u4_outcomes", run_sql("SELECT change_id, outcome, keep_model, outcome IN (0, 4) AS has_review FROM ended"))
def u4(spark, d):
    return run(spark, d).outcomes


@query("u4_kept_model_findings", run_sql("SELECT change_id, batch_no, pos, file FROM model"))
def u4b(spark, d):
    r = run(spark, d)
    return outcome.kept_model_findings(responses.model_findings(r.review_calls), r.review_failures).select("change_id", "seq.batch_no", "seq.pos", "file")


@query("w3_calls", run_sql("SELECT change_id, 'review-' || batch_no AS label, tokens, round(worst, 9) AS worst, round(actual, 9) AS actual, round(spent, 9) AS spent, result FROM run_results"))
def w3_calls(spark, d):
    """The review calls: responses joined to requests by key, budgets, what became of each."""
    r = run(spark, d)
    return r._results(r.review_calls).select("change_id", "label", "tokens", *(F.round(c, 9).alias(c) for c in ("worst", "actual", "spent")), "result")


_MADE = "first_fail AS (SELECT change_id, min(batch_no) AS b FROM run_results WHERE result <> 'ok' GROUP BY 1), made AS (SELECT r.* FROM run_results r LEFT JOIN first_fail f USING (change_id) WHERE result <> 'budget' AND (f.b IS NULL OR batch_no <= f.b))"
_AGAIN = f"""{_MADE}, again AS (SELECT *, prompt_key IN (SELECT prompt_key FROM made WHERE k NOT BETWEEN 12 AND 23) AS hit FROM costed),
  again_spent AS (SELECT *, coalesce(sum(CASE WHEN hit THEN 0 ELSE actual END) OVER (PARTITION BY change_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent2 FROM again)"""


@query("w3_cached_calls", run_sql(f", {_AGAIN} SELECT change_id, 'review-' || batch_no AS label, hit, round(CASE WHEN hit THEN 0 ELSE actual END, 9) AS actual, round(spent2, 9) AS spent, CASE WHEN NOT hit AND (tokens > {CALL_TOKENS} OR spent2 + worst > {RUN_COST}) THEN 'budget' WHEN k BETWEEN 12 AND 23 THEN 'api_error' WHEN k < 12 THEN 'malformed' ELSE 'ok' END AS result FROM again_spent"))
def w3_cached_calls(spark, d):
    """The review calls of a second run, after the first has filled the cache: what was answered costs nothing and meets no budget."""
    first = run(spark, d, new_cache(spark))
    first.remember()
    again = Reviewed(first.requests, first.answers, CALL_TOKENS, RUN_COST, first.cache)
    rows = stored(again._results(again.review_calls).select("change_id", "label", "hit", *(F.round(c, 9).alias(c) for c in ("actual", "spent")), "result"))
    first.cache.drop()
    return rows


_SENT = f"""{_MADE}, sum_made AS (SELECT s.change_id, 'summary' AS label, s.tokens, 0 AS out, s.tokens * 2.0 / 1e6 AS actual, s.k FROM sum_calls s JOIN sum_results r USING (change_id) WHERE r.result <> 'budget' AND s.k <> 0)"""


@query("u5_run_usage", run_sql(f", {_SENT}, sent AS (SELECT change_id, 'review-' || batch_no AS label, tokens, 100 * k AS out, actual FROM made WHERE k NOT BETWEEN 12 AND 23 UNION ALL SELECT change_id, label, tokens, out, actual FROM sum_made) SELECT change_id, label, CAST(sum(tokens) AS BIGINT) AS input_tokens, CAST(sum(out) AS BIGINT) AS output_tokens, round(sum(actual), 9) AS cost FROM sent GROUP BY ROLLUP (change_id, label)"))
def u5_run(spark, d):
    """Tokens and cost of the calls that the run sent and that were answered."""
    return run(spark, d).usage().select("change_id", "label", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"))


@query("s7_run_labels", run_sql(f", {_SENT}, n AS (SELECT change_id, count(*) AS n FROM keyed GROUP BY 1) SELECT change_id, 'review-' || change_id || CASE WHEN n > 1 THEN '-' || (batch_no + 1) ELSE '' END AS label FROM made JOIN n USING (change_id) WHERE k NOT BETWEEN 12 AND 23 UNION ALL SELECT change_id, 'summary-' || change_id FROM sum_made"))
def s7_run(spark, d):
    """The labels that the run's responses are recorded under."""
    return run(spark, d).recorded().select("change_id", "label")


#: So large that every change of the corpus is one request, and a run takes three batches of the stream.
STREAM_LIMIT = 8000
_STREAMED = run_sql("SELECT 1").replace(f"> {LIMIT}", f"> {STREAM_LIMIT}").replace(f" OR spent + worst > {RUN_COST}", "").replace(f" OR spent + (tokens * 2.0 + 2000 * 10.0) / 1e6 > {RUN_COST}", "").removesuffix("SELECT 1")
_WAITS = "(SELECT change_id FROM failed WHERE result = 'api_error')"
_SAID = "(SELECT change_id, 'sum ' || k AS s, 'medium' AS r, 'comment' AS c FROM sum_results WHERE result = 'ok') said"


@query("s6_stream_run", f"{_STREAMED}, {reviews_sql('merged', _SAID)}, {markdown_sql('merged')} SELECT change_id, overall_risk, sha256({JSON}) AS json_sha256, sha256(md) AS md_sha256 FROM review JOIN pages USING (change_id) JOIN ended USING (change_id) WHERE outcome IN (0, 4) AND change_id NOT IN {_WAITS}")
def s6_run(spark, d):
    """Changes arrive, and their unanswered requests are written out; responses to those arrive, then responses to the summary requests that
    are written out in turn. Cached responses cost nothing, so only a call's size is held against a budget."""
    changes, answered, folder = shared(spark), shared(spark), shared(spark)
    corpus.changes(spark, d, damage=True).write.parquet(changes)
    parameters = {"system": SYSTEM, "model": "model-b", "run_date": "2026-06-01", "prices": prices(spark, d), "max_input_tokens": STREAM_LIMIT, "max_call_tokens": CALL_TOKENS, "max_run_cost": RUN_COST}
    stream = ReviewStream(spark, folder, new_cache(spark), parameters)
    stream.changes(changes).awaitTermination()
    for turn in ("reviews", "summaries"):
        asked = stream.table("requests").where(F.col("label") == "summary" if turn == "summaries" else F.col("label") != "summary").dropDuplicates(["prompt_key"])
        first_path = F.regexp_extract("user", '<file path="([^"]*)">', 1)
        said = summary_answers(asked) if turn == "summaries" else review_answers(asked.withColumn("path", first_path))
        said.select("prompt_key", "response").write.mode("append").parquet(answered)
        stream.responses(answered).awaitTermination()
    rows = stored(stream.table("reviews").select("change_id", "overall_risk", *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("json", "md"))))
    stream.cache.drop()
    return rows


@query("w3_findings", run_sql("SELECT m.* FROM merged m JOIN ended USING (change_id) WHERE outcome IN (0, 4)"))
def w3_findings(spark, d):
    """The findings of the reviews that are written, both detectors' merged."""
    r = run(spark, d)
    return r.merged.join(r.outcomes.where("has_review").select("change_id"), "change_id", "left_semi").select("change_id", *FOUND, "risk", "recommendation")



@query("w3_reviews", run_sql(f", {reviews_sql('merged', _SAID)}, {markdown_sql('merged')} SELECT change_id, overall_risk, sha256({JSON}) AS json_sha256, sha256(md) AS md_sha256 FROM review JOIN pages USING (change_id) JOIN ended USING (change_id) WHERE outcome IN (0, 4)"))
def w3_reviews(spark, d):
    """JSON and Markdown of every change that ends with a review."""
    return run(spark, d).artifacts().select("change_id", "overall_risk", *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("json", "md")))


@query("w2_dry_run", run_sql(f", {summary_sql('det').replace('sums AS', 'rule_sums AS', 1)}, priced AS (SELECT change_id, 'review-' || batch_no AS label, tokens, worst FROM costed UNION ALL SELECT change_id, 'summary', t, (t * 2.0 + 2000 * 10.0) / 1e6 FROM (SELECT change_id, CAST(ceil(length('{SYSTEM}') / 4.0) + ceil(length(user_text) / 4.0) AS BIGINT) AS t FROM rule_sums WHERE change_id IN (SELECT change_id FROM costed))) SELECT change_id, label, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(worst), 9) AS cost, count(*) AS calls FROM priced GROUP BY GROUPING SETS ((change_id, label), (change_id))"))
def w2_dry_run(spark, d):
    """What the run's own requests would cost at worst, the summary call included."""
    return run(spark, d).requests.dry_run.withColumn("cost", F.round("cost", 9))


@query("u5_usage_totals", f"WITH {_RATED} SELECT change_id, label, CAST(sum(tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, round(sum(actual), 9) AS cost FROM costed GROUP BY ROLLUP (change_id, label)")
def u5(spark, d):
    return cost.usage_totals(calls(spark, d)).withColumn("cost", F.round("cost", 9))


@query("u6_tuning", merged_sql("SELECT rule_id, source, confidence, count(*) AS n FROM merged GROUP BY ALL"))
def u6(spark, d):
    return outcome.tuning(merged(spark, d)[1])


@query("u6_unmappable_share", model_sql("SELECT round(count_if(unmapped) / (SELECT count(*) FROM model), 9) AS unmappable_share FROM mapped"))
def u6b(spark, d):
    m, files, added = _sought(spark, d)
    return outcome.unmappable_share(merging.validation_stats(m, files, added), m).select(F.round("unmappable_share", 9).alias("unmappable_share"))


@query("u7_contract_failures", f"WITH {_CHECKED} SELECT call, error, count(*) AS n FROM checked WHERE error IS NOT NULL GROUP BY ALL")
def u7(spark, d):
    return outcome.contract_failures(responses.check(answers(spark, d)))


@query("u8_canary", over("SELECT change_id, rule_id FROM det WHERE change_id NOT IN (SELECT change_id FROM lines WHERE content NOT IN ('digest = hashlib.sha256(data).digest()', 'model.eval()', 'return total  ', '', 'return redirect(\"/home\")', 'logger.info(\"user %s\", uid)', 'token_id = secrets.token_hex(32)'))"))
def u8(spark, d):
    s = scan(spark, d)
    safe = ("digest = hashlib.sha256(data).digest()", "model.eval()", "return total  ", "", 'return redirect("/home")', 'logger.info("user %s", uid)', "token_id = secrets.token_hex(32)")
    clean = s.changes.select("change_id").join(s.lines.where(~F.col("content").isin(*safe)).select("change_id").distinct(), "change_id", "left_anti")
    return outcome.canary(clean, s.findings).select("change_id", "rule_id")


def flagship(spark, sf_dir) -> DataFrame:
    """Diff text to findings to severity counts of each change."""
    return reports.severity_counts(scan(spark, sf_dir).findings)

