"""Packing, responses, validation, merging, outcome, rendering, sources and sinks on small cases."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators import cost, lines, merging, outcome, packing, reports, responses, scans
from diffloom.plans import corpus, queries
from diffloom.plans.review import Requests, Reviewed, Scan, whole_run
from diffloom.sources import diffs, sinks
from diffloom.sources.cache import ResponseCache
from diffloom.sources.shared import stored
from diffloom.streaming.arrivals import ReviewStream, review_arrivals
from tests.test_lines import MULTI
from tests.test_rules import diff, scan

F_SCHEMA = "change_id long, file string, line int, category string, severity string, confidence string, evidence string, risk string, recommendation string, source string, rule_id string, seq struct<batch_no:int,pos:int>"


def finding(file="a.py", line=1, category="injection", severity="low", confidence="low", evidence="e", risk="r", rec="f", source="llm", rule=None, seq=(0, 0), change=1):
    return (change, file, line, category, severity, confidence, evidence, risk, rec, source, rule, seq)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), F_SCHEMA)


def reference_pack(files, limit):
    """Next-fit over files in path order, oversized files by hunk: (path, hunk) -> (chunk, batch, capped)."""
    tok = lambda p, hs: -(-len(packing_text(p, hs)) // 4)
    blocks = []
    for path, hunks in sorted(files.items()):
        if tok(path, hunks) <= limit:
            blocks.append((path, hunks, 0, False))
            continue
        group, used, chunk = [], 0, 0
        for h in hunks:
            if group and used + tok(path, [h]) > limit:
                blocks.append((path, group, chunk, True))
                group, used, chunk = [], 0, chunk + 1
            group.append(h)
            used += tok(path, [h])
        blocks.append((path, group, chunk, True))
    out, used, batch, first = {}, 0, 0, True
    for path, hunks, chunk, capped in blocks:
        t = tok(path, hunks)
        if not first and used + t > limit:
            used, batch = 0, batch + 1
        first, used = False, used + t
        for h in hunks:
            out[path, h[0]] = (chunk, batch, capped)
    return out


def packing_text(path, hunks):
    cited = sorted({n for h in hunks for n in h[2]})
    return "\n".join([f'<file path="{path}">', f"citable_lines: {json.dumps(cited)}", *(h[1] for h in hunks), "</file>"])


@pytest.mark.parametrize("limit", [25, 40, 70, 300])
def test_pack_matches_a_plain_loop(spark, limit):
    files = {f"f{i}.py": [(h, "x" * (7 * i + 13 * h + 5), list(range(h * 10, h * 10 + i % 4))) for h in range(1 + i % 5)] for i in range(12)}
    rows = [(1, i, p, h, c, t) for i, (p, hs) in enumerate(files.items()) for h, t, c in hs]
    df = spark.createDataFrame(rows, "change_id long, file_no int, path string, hunk_no int, citable array<int>, text string")
    names = dict(enumerate(files))
    got = {(names[r.file_no], r.hunk_no): (r.chunk_no, r.batch_no, r.capped) for r in packing.assign(df, limit).collect()}
    assert got == reference_pack(files, limit)
    text = packing.blocks(df, packing.assign(df, limit)).where("NOT capped").collect()
    assert all(r.text == packing_text(r.path, files[r.path]) and r.tokens == -(-len(r.text) // 4) for r in text)


def test_large_changes_are_packed_as_the_fold_does(spark):
    """Files and chunks that pass the limit, blocks beyond it alone, line numbers that stand in several hunks, several changes."""
    rng = random.Random(8)
    schema = "change_id long, file_no int, path string, hunk_no int, citable array<int>, text string"
    rows = []
    for change in (1, 2, 3):
        for f in range(12):
            path = f"f{rng.randint(0, 6)}.py"
            for h in range(rng.choice([1, 2, 9, 60])):
                start = rng.choice([h * 10, 5])  # the latter overlap
                rows.append((change, f, path, h, list(range(start, start + rng.randint(0, 6))), "x" * rng.choice([0, 3, 40, 700])))
    df = spark.createDataFrame(rows, schema).repartition(3)
    for limit in (60,):
        small, large = packing.assign(df, limit), packing.assign_large(packing.hunk_sizes(df), limit)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    one = packing.assign(df, 150, large=200)
    assert sorted(map(str, one.collect())) == sorted(map(str, packing.assign(df, 150).collect()))


def test_next_fit_over_many_ranges(spark):
    rng = random.Random(9)
    sizes = {k: [rng.randint(1, 12) for _ in range(n)] for k, n in (("a", 5000), ("b", 1), ("c", 40))}
    df = spark.createDataFrame([(k, i, s) for k, v in sizes.items() for i, s in enumerate(v)], "k string, i int, s int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    try:
        laid = scans.laid_out(df, ["k"], ["i"])
        assert laid.where("k = 'a'").select("_range").distinct().count() > 1  # one key over several tasks
        got = {(r.k, r.i): r.group_no for r in scans.next_fit(df, ["k"], ["i"], "s", 20).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, v in sizes.items():
        group, used = 0, 0
        for i, s in enumerate(v):
            if used and used + s > 20:
                group, used = group + 1, 0
            used += s
            assert got[k, i] == group
    assert scans.next_fit(df.limit(0), ["k"], ["i"], "s", 20).count() == 0


def test_block_text_and_exclusions(spark):
    s = scan(spark, MULTI + diff("+x", path="vendor/a.py") + diff("-x", path="gone.py") + diff("+x", path="poetry.lock"))
    assert {r.path: r.exclusion_reason for r in s.filtered.collect()} == {"app/handlers.py": None, "zzz.py": None, "vendor/a.py": "generated", "gone.py": "no added lines", "poetry.lock": "lockfiles"}
    assert s.notes.first().note == "3 files excluded from LLM review (generated, lockfiles, no added lines)"
    texts = {r.path: r.text for r in packing.file_blocks(packing.hunk_texts(s.filtered, s.hunks, s.lines)).collect()}
    assert texts["zzz.py"] == '<file path="zzz.py">\nciteable'.replace("citeable", "citable") + "_lines: [1, 2]\n@@ -0,0 +1,2 @@\n+      1 | one\n+      2 | two\n</file>"
    assert "-        | y\n+     32 | why" in texts["app/handlers.py"]


GOOD = {"file": "a.py", "line": 1, "category": "injection", "severity": "low", "confidence": "low", "evidence": "e", "risk": "r", "recommendation": "f"}
BAD = ["", "no", "[1]", "null", '{"findings": 1}', json.dumps({"findings": [GOOD], "x": 1}), json.dumps({"findings": [GOOD | {"x": 1}]}), json.dumps({"findings": [{k: v for k, v in GOOD.items() if k != "risk"}]}), json.dumps({"findings": [GOOD | {"severity": "huge"}]}), json.dumps({"findings": [GOOD | {"category": "hardcoded_secrets"}]}), json.dumps({"findings": [GOOD | {"line": 1.5}]}), json.dumps({"findings": [GOOD | {"evidence": 3}]}), json.dumps({"findings": [GOOD | {"line": "1.5"}]}), '{"findings": [], "x": 1, "findings": []}', None]
FINE = ["{}", json.dumps({"findings": []}), json.dumps({"findings": [GOOD]}), json.dumps({"findings": [GOOD | {"line": None}]}), json.dumps({"findings": [GOOD | {"line": "12"}]}), "```json\n" + json.dumps({"findings": [GOOD]}, indent=1) + "\n```", json.dumps({"findings": [{k: v for k, v in GOOD.items() if k != "line"}]}), json.dumps({"findings": [GOOD | {"line": True}]}), '{"findings": [], "findings": [' + json.dumps(GOOD) + "]}", *(json.dumps({"findings": [GOOD]}).replace('"line": 1', f'"line": {x}') for x in ("7.0", "1e2", '" 12.0 "', "99999999999", "1e30", '"-99999999999999999999"', '5, "line": 6'))]


def test_review_contract(spark):
    df = spark.createDataFrame([(i, "review", 0, t) for i, t in enumerate(BAD + FINE)], "change_id long, call string, batch_no int, response string")
    checked = responses.check(df)
    assert {r.change_id for r in checked.where("valid").collect()} == set(range(len(BAD), len(BAD) + len(FINE)))
    lines_of = {r.change_id - len(BAD): r.line for r in responses.model_findings(checked).collect()}
    assert lines_of == {2: 1, 3: None, 4: 12, 5: 1, 6: None, 7: 1, 8: 1, 9: 7, 10: 100, 11: 12, 12: 99999999999, 13: 2**63 - 1, 14: -(2**63), 15: 6}


def test_summary_contract(spark):
    one = {"summary": "s", "overall_risk": "low", "pr_comment": "c"}
    texts = [json.dumps(one), json.dumps(one | {"x": 1}), json.dumps(one | {"overall_risk": "x"}), json.dumps({"summary": "s"}), json.dumps(one | {"summary": 1})]
    df = spark.createDataFrame([(i, "summary", 0, t) for i, t in enumerate(texts)], "change_id long, call string, batch_no int, response string")
    assert [r.valid for r in responses.check(df).orderBy("change_id").collect()] == [True, False, False, False, False]


def test_validation(spark):
    files = spark.createDataFrame([(1, 0, "a.py"), (1, 1, "b.py")], "change_id long, file_no int, path string")
    added = spark.createDataFrame([(1, "a.py", 1), (1, "b.py", 7)], "change_id long, path string, line_no int")
    f = frame(spark, finding(), finding(line=999, seq=(0, 1)), finding(line=7, seq=(0, 2)), finding(file="nope", seq=(0, 3)), finding(line=None, seq=(0, 4)))
    got = {r.seq.pos: r.line for r in merging.mapped_lines(merging.known_files(f, files), added).collect()}
    assert got == {0: 1, 1: None, 2: None, 4: None}
    r = merging.validation_stats(f, files, added).first()
    assert (r.unmappable_count, r.hallucinated_file_count, r.unmappable_lines, r.hallucinated_files) == (2, 1, ["a.py:7", "a.py:999"], ["nope"])


def test_merge(spark):
    det = frame(spark, finding(severity="medium", evidence="d", risk="dr", source="deterministic", rule="x"), finding(line=None, source="deterministic", rule="y"), finding(line=5, confidence="low", source="deterministic", rule="first", seq=(0, 1)), finding(line=5, confidence="high", source="deterministic", rule="second", seq=(0, 2)))
    llm = frame(spark, finding(severity="low", risk="first", seq=(0, 0)), finding(severity="high", confidence="high", risk="second", seq=(0, 1)), finding(line=2, confidence="low", risk="weak", seq=(0, 2)), finding(line=2, confidence="medium", risk="strong", seq=(0, 3)), finding(category="auth_perms", seq=(0, 4)), finding(line=None, severity="high", risk="n", seq=(0, 5)))
    got = {(r.line, r.category): r for r in merging.merge(det, llm).collect()}
    assert len(got) == 5
    both = got[1, "injection"]
    assert (both.source, both.confidence, both.severity, both.risk, both.evidence, both.rule_id) == ("both", "high", "medium", "first", "d", "x")
    assert got[2, "injection"].risk == "strong" and got[5, "injection"].rule_id == "second" and got[1, "auth_perms"].source == "llm"
    assert (got[None, "injection"].source, got[None, "injection"].severity) == ("both", "high")


def test_caps(spark):
    packed = spark.createDataFrame([(1, 0, "a.py", True), (1, 1, "a.py", False)], "change_id long, batch_no int, path string, capped boolean")
    f = frame(spark, finding(confidence="high"), finding(confidence="high", seq=(1, 0)), finding(confidence="low", seq=(0, 2)))
    assert [r.confidence for r in merging.capped(f, packed).orderBy("seq").collect()] == ["medium", "low", "high"]


def test_outcomes(spark):
    st = spark.createDataFrame([(i, "parse_error" if i == 0 else "ok") for i in range(9)], "change_id long, status string")
    calls = spark.createDataFrame([(1, 1, "review", "malformed"), (2, 1, "review", "ok"), (2, 2, "summary", "budget"), (3, 1, "review", "api_error"), (3, 2, "summary", "malformed"), (4, 1, "review", "ok"), (4, 2, "summary", "api_error"), (5, 1, "review", "ok")], "change_id long, call_no int, call string, result string")
    gates = spark.createDataFrame([(4, True), (5, False), (7, True), (8, True)], "change_id long, gated boolean")
    reviewable = spark.createDataFrame([(i, i != 7) for i in range(8)], "change_id long, reviewable boolean")  # 8: no line at all
    got = {r.change_id: (r.outcome, r.keep_model, r.has_review) for r in outcome.outcomes(st, reviewable, outcome.first_failures(calls), gates).collect()}
    assert got == {0: (1, True, False), 1: (2, True, False), 2: (3, True, False), 3: (0, False, True), 4: (4, True, True), 5: (0, True, True), 6: (0, True, True), 7: (0, True, True), 8: (0, True, True)}


PRICES = "model string, valid_from date, valid_to date, rate_in double, rate_out double"
ANSWER = "prompt_key string, response string, input_tokens long, output_tokens long, cache_read long, cache_write long"


def run_with(spark, changes, reviews, summary=None, **budgets):
    """A whole run of one batch for each file; reviews: response by path (none: the call fails)."""
    prices = spark.createDataFrame([("m", datetime.date(2000, 1, 1), datetime.date(2099, 1, 1), 2.0, 10.0)], PRICES)
    requests = Requests(Scan(scan(spark, *changes).changes, keep=stored), "s", "m", "2026-01-01", prices, 20)
    given = [(r.prompt_key, text, 10, 10, 0, 0) for r in requests.reviews.collect() for path, text in reviews.items() if f'path="{path}"' in r.user]
    first = Reviewed(requests, spark.createDataFrame(given, ANSWER), **budgets)
    if summary is not None:
        given += [(r.prompt_key, summary, 10, 10, 0, 0) for r in requests.summaries(first.merged).collect()]
    return Reviewed(requests, spark.createDataFrame(given, ANSWER), **budgets)


def answer(file, line=1, severity="high"):
    return json.dumps({"findings": [GOOD | {"file": file, "line": line, "severity": severity}]})


TWO = diff("+first line", path="a.py") + diff("+second line", path="b.py")
SUMMARY = json.dumps({"summary": "all told", "overall_risk": "medium", "pr_comment": "c"})


def test_a_failed_review_call_discards_all_model_findings(spark):
    r = run_with(spark, [TWO], {"a.py": answer("a.py")}, SUMMARY)
    assert r.requests.reviews.count() == 2  # two batches, the second without a response
    assert [tuple(x) for x in r.outcomes.collect()] == [(0, 0, False, True)]
    assert r.merged.count() == 0 and r.summary_calls.count() == 0
    assert [(x.overall_risk, x.summary.startswith(reports.RULES_ONLY), x.findings) for x in r.reviews.collect()] == [("low", True, [])]


def test_a_run_with_all_responses(spark):
    r = run_with(spark, [TWO], {"a.py": answer("a.py"), "b.py": answer("b.py", 7, "low")}, SUMMARY)
    assert [tuple(x) for x in r.outcomes.collect()] == [(0, 4, True, True)]
    assert sorted((x.file, x.line, x.severity) for x in r.merged.collect()) == [("a.py", 1, "high"), ("b.py", None, "low")]
    assert [(x.summary, x.overall_risk, len(x.findings)) for x in r.reviews.collect()] == [("all told", "medium", 2)]
    assert r.artifacts().count() == 1
    failed = run_with(spark, [TWO], {"a.py": answer("a.py"), "b.py": answer("b.py", 7, "low")})  # the summary fails: findings stay
    assert [tuple(x) for x in failed.outcomes.collect()] == [(0, 4, True, True)] and failed.merged.count() == 2
    assert failed.reviews.first().summary.startswith(reports.RULES_ONLY)


def test_malformed_responses_and_budgets_leave_no_review(spark):
    changes = [diff("+first line", path="a.py"), diff("+second line", path="b.py"), TWO.replace("a.py", "c.py").replace("b.py", "d.py")]
    # a malformed review; a malformed summary; a second call that doesn't fit the run's budget beside the first one's cost
    r = run_with(spark, changes, {"a.py": "no", **{f"{x}.py": answer(f"{x}.py") for x in "bcd"}}, "no", max_run_cost=0.08012)
    assert {x.change_id: (x.outcome, x.has_review) for x in r.outcomes.collect()} == {0: (2, False), 1: (2, False), 2: (3, False)}
    assert r.reviews.count() == 0


def test_changes_without_added_lines_end_well(spark):
    r = run_with(spark, [diff("-@login_required"), "prose", diff("+eval(x)")], {}, SUMMARY)
    assert {x.change_id: (x.outcome, x.has_review) for x in r.outcomes.collect()} == {0: (0, True), 1: (1, False), 2: (4, True)}
    got = {x.change_id: (x.summary, x.overall_risk, len(x.findings)) for x in r.reviews.collect()}
    assert got[0] == (reports.EMPTY_SUMMARY, "low", 0) and set(got) == {0, 2} and got[2][1:] == ("high", 1)


def test_equal_requests_share_a_response(spark):
    requests = spark.createDataFrame([(1, "k"), (2, "k"), (3, "l")], "change_id long, prompt_key string")
    answers = spark.createDataFrame([("k", "b", 1, 1, 0, 0), ("k", "a", 2, 2, 0, 0)], ANSWER)
    got = sorted((r.change_id, r.response, r.input_tokens) for r in responses.attached(requests, answers).collect())
    assert got == [(1, "a", 2), (2, "a", 2), (3, None, None)]


def test_a_whole_run_writes_its_tables_once(spark):
    prices = spark.createDataFrame([("m", datetime.date(2000, 1, 1), datetime.date(2099, 1, 1), 2.0, 10.0)], PRICES)
    changes = scan(spark, TWO, diff("+eval(x)")).changes
    r = whole_run(changes, system="s", model="m", run_date="2026-01-01", prices=prices, answers=spark.createDataFrame([], ANSWER))
    assert sorted((x.change_id, x.outcome) for x in r.outcomes.collect()) == [(0, 0), (1, 4)]
    plan = r.artifacts()._jdf.queryExecution().optimizedPlan().toString()
    assert "diff_text" not in plan  # all of it reads tables that were written


def test_prices_and_budget(spark):
    prices = spark.createDataFrame([("a", "2000-01-01", "2026-08-31", 2.0, 10.0), ("a", "2026-09-01", "2099-01-01", 3.0, 15.0), ("z", "2000-01-01", "2099-01-01", 10.0, 50.0)], "model string, valid_from string, valid_to string, rate_in double, rate_out double").selectExpr("model", "CAST(valid_from AS DATE) valid_from", "CAST(valid_to AS DATE) valid_to", "rate_in", "rate_out")
    calls = spark.createDataFrame([(1, 1, "a", "2026-08-31"), (1, 2, "a", "2026-09-01"), (1, 3, "unknown", "2026-01-01")], "change_id long, call_no int, model string, d string").withColumn("run_date", F.col("d").cast("date"))
    assert [r.rate_in for r in cost.with_rates(calls, prices).orderBy("call_no").collect()] == [2.0, 3.0, 10.0]
    run = spark.createDataFrame([(1, 1, 10, 0.5, 0.3, False), (1, 2, 10, 0.5, 0.3, False), (1, 3, 10, 0.5, 0.3, True), (1, 4, 99, 0.1, 0.1, False)], "change_id long, call_no int, tokens int, worst double, actual double, hit boolean")
    got = [(r.over_tokens, r.over_cost, r.made) for r in cost.budgets(run, 50, 0.7).orderBy("call_no").collect()]
    assert got == [(False, False, True), (False, True, False), (False, False, False), (True, False, False)]


def test_key_depends_on_every_part(spark):
    df = spark.createDataFrame([("m", "", "s", "u"), ("m", None, "s", "u"), ("m", "high", "s", "u"), ("ms", "", "", "u")], "m string, e string, s string, u string")
    keys = [r[0] for r in df.select(cost.request_key(F.col("m"), F.col("e"), F.col("s"), F.col("u"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_markdown_and_json(spark):
    s = scan(spark, diff('+cursor.execute(f"a")', "+hashlib.md5(x)"), diff("+fine"), diff("-gone"))
    arts = {r.change_id: r for r in s.artifacts().collect()}
    md = arts[0].md
    assert md.startswith("# Security review\n\n**Overall risk: high** — 2 high across 1 file\n")
    assert md.index("Line 2") < md.index("Line 1 ·") and "- **Evidence:** Statement put together" in md
    assert f"**No findings.** {reports.NO_RULE_FINDINGS}" in arts[1].md and reports.EMPTY_REASON in arts[2].md
    doc = json.loads(arts[0].json)
    assert list(doc) == sorted(doc) and doc["no_findings_reason"] is None and "rule_id" not in doc["findings"][0]


@pytest.mark.parametrize("part_rows", [2, 1000])
def test_artifact_parts_join_to_the_whole(spark, tmp_path, part_rows):
    rng = random.Random(3)
    lots = [finding(f"f{rng.randrange(9)}.py", rng.choice([None, *range(1, 40)]), rng.choice(["injection", "auth_perms"]), rng.choice(["low", "medium", "high"]), rng.choice(["low", "high"]), f" a\n{i} \"x\"") for i in range(300)]
    lots += lots[:3] + [finding(change=2), finding(change=4)]  # repeated findings; one in a change that adds no line
    f = frame(spark, *lots)
    changes = spark.createDataFrame([(i,) for i in range(1, 5)], "change_id long")
    notes = spark.createDataFrame([(1, "2 files excluded"), (3, "1 files excluded")], "change_id long, note string")
    adds = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "change_id long, reviewable boolean")
    sums = spark.createDataFrame([(2, " said ", "medium", "c\n")], "change_id long, summary string, overall_risk string, pr_comment string")
    whole = reports.assemble(changes, f, sums, notes, adds)
    parts = reports.parts(reports.heads(changes, f, sums, notes, adds), f, notes, part_rows)
    sinks.write_parts(parts, str(tmp_path / "parts"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "parts")).orderBy("change_id", "kind", "part_no").collect():
        got.setdefault((r.kind, r.change_id), []).append(r.text)
    if part_rows == 2:
        assert len(got["json", 1]) == 153 and len(got["md", 1]) == 157
    joined = {k: "".join(v) for k, v in got.items()}
    assert joined == {("json", r.change_id): r.json for r in reports.to_json(whole).collect()} | {("md", r.change_id): r.md for r in reports.to_markdown(whole, f, notes).collect()}


def test_severity_counts_leave_out_zeros(spark):
    f = frame(spark, finding(severity="high"), finding(line=2, severity="high", file="b.py"), finding(line=3))
    r = reports.severity_counts(f).first()
    assert (r.counts, r.n_files) == ("2 high · 1 low", 2)


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.diff").write_text(MULTI)
    (tmp_path / "in/bad.diff").write_bytes(b"\xff\xfe" + MULTI.encode())
    c = diffs.read_diffs(spark, f"file://{tmp_path}/in")
    assert {r.change_id: r.decodable for r in c.collect()} == {"good": True, "bad": False}
    assert {r.change_id: r.status for r in lines.parse_status(c).collect()} == {"good": "ok", "bad": "parse_error"}
    (tmp_path / "in/review-x.json").write_text("{}\n")
    got = diffs.read_responses(spark, f"file://{tmp_path}/in/*.json").collect()
    assert [(r.label, r.response) for r in got] == [("review-x", "{}\n")]
    rows = [("review-x", "{}"), ("review-y", None), ("review-x", "{}")]
    spark.createDataFrame(rows, "label string, response string").withColumn("extra", F.lit(1)).write.parquet(f"file://{tmp_path}/table")
    table = diffs.read_response_table(spark, f"file://{tmp_path}/table")
    assert table.columns == ["label", "response"] and sorted(map(tuple, table.collect()), key=str) == sorted(rows, key=str)


def test_cache(spark):
    cache = ResponseCache(spark, "test_cache", digits=2, buckets=4)
    r = spark.createDataFrame([("aa1", "b"), ("aa1", "a"), ("bb2", "c"), (None, "x"), ("cc3", None)], "prompt_key string, response string")
    ask = spark.createDataFrame([("aa1",), ("ff9",)], "prompt_key string")
    assert cache.misses(ask).count() == 2 and cache.found(ask).where("cached IS NULL").count() == 2  # there is none yet
    assert {x.prompt_key for x in cache.put(r).collect()} == {"aa1", "bb2"}
    assert cache.put(r).isEmpty()  # the same batch again
    cache.put(spark.createDataFrame([("aa1", "late"), ("aa7", "d")], r.schema))
    assert sorted(tuple(x) for x in spark.table(cache.name).select("prompt_key", "response").collect()) == [("aa1", "a"), ("aa7", "d"), ("bb2", "c")]
    assert [x.prompt_key for x in cache.misses(ask).collect()] == ["ff9"] and [x.cached for x in cache.found(ask).where("prompt_key = 'aa1'").collect()] == ["a"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("prompt_key")).unionByName(ask)
        plan = cache.found(ask)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # only the requests move
        assert "prefix" in plan.split("PartitionFilters: ")[1].split("]")[0] and cache.found(many).count() == 1002
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    cache.drop()
    assert not cache.exists()


def test_second_run_is_served_by_the_cache(spark):
    prices = spark.createDataFrame([("m", datetime.date(2000, 1, 1), datetime.date(2099, 1, 1), 2.0, 10.0)], "model string, valid_from date, valid_to date, rate_in double, rate_out double")
    changes = spark.createDataFrame([(1, diff("+eval(x)")), (2, diff("+fine")), (3, diff("+eval(x)")), (4, "prose")], "change_id long, diff_text string")
    cache = ResponseCache(spark, "test_run_cache")

    def go(answers, cache=cache):
        return whole_run(changes, answers=answers, cache=cache, system="s", model="m", run_date="2026-01-01", prices=prices)

    schema = "prompt_key string, response string, input_tokens long, output_tokens long, cache_read long, cache_write long"
    none = spark.createDataFrame([], schema)
    asked = go(none).requests.reviews.select("prompt_key", "change_id").collect()
    keys = {r.change_id: r.prompt_key for r in asked}
    given = spark.createDataFrame([(keys[1], '{"findings": []}', 10, 5, 0, 0), (keys[2], " \n", 10, 5, 0, 0)], schema)
    first = go(given)
    assert {(r.change_id, r.label): r.result for r in first.calls.collect()} == {(1, "review-0"): "ok", (2, "review-0"): "api_error", (3, "review-0"): "ok", (1, "summary"): "api_error", (3, "summary"): "api_error"}
    assert {(r.change_id, r.label) for r in first.usage().collect()} == {(1, "review-0"), (3, "review-0"), (1, None), (3, None), (None, None)}
    assert sorted((r.label, r.response) for r in first.recorded().collect()) == [("review-1", '{"findings": []}'), ("review-3", '{"findings": []}')]
    assert [r.prompt_key for r in first.remember().collect()] == [keys[1]] and first.remember().isEmpty()
    again = go(none)
    assert again.calls.where("call = 'review' AND hit AND actual = 0 AND result = 'ok'").count() == 2 and again.usage().where("label IS NOT NULL").isEmpty()
    assert len(again.recorded().collect()) == 2
    assert go(none, None).calls.where("hit OR response IS NOT NULL").isEmpty()  # no cache unless one is given
    cache.drop()


def test_stream(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([(1, diff("+eval(x)")), (2, diff("+fine"))], "change_id long, diff_text string").write.parquet(f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        review_arrivals(spark, f"{base}/in", f"{base}/out", f"{base}/state", lambda b: Scan(b).findings.select("change_id", "rule_id")).awaitTermination()
    assert [(r.change_id, r.rule_id) for r in spark.read.parquet(f"{base}/out").collect()] == [(1, "injection.code_exec")]


def test_stream_of_a_whole_run_survives_being_cut_off(spark, tmp_path):
    """Every batch is cut off before each of its writes in turn, and started again: each review is there once, as in one run."""
    base = f"file://{tmp_path}"
    prices = spark.createDataFrame([("m", datetime.date(2000, 1, 1), datetime.date(2099, 1, 1), 2.0, 10.0)], "model string, valid_from date, valid_to date, rate_in double, rate_out double")
    spark.createDataFrame([(1, diff("+eval(x)")), (2, diff("+fine")), (3, diff("-gone")), (4, "prose")], "change_id long, diff_text string").write.parquet(f"{base}/changes")
    parameters = {"system": "s", "model": "m", "run_date": "2026-01-01", "prices": prices}
    cut = {("c0", "waiting"), ("c0", "outcomes"), ("r0", "cache"), ("r0", "reviews"), ("r1", "outcomes")}

    def before(part, what):
        if (part, what) in cut:
            cut.discard((part, what))
            raise RuntimeError("cut off")

    cache = ResponseCache(spark, "test_stream_cache")
    stream = ReviewStream(spark, f"{base}/out", cache, parameters, before=before)

    def until_done(start):
        for _ in range(4):
            try:
                return start().awaitTermination()
            except Exception as e:
                assert "cut off" in str(e)

    until_done(lambda: stream.changes(f"{base}/changes"))
    assert {r.change_id for r in stream.table("waiting").collect()} == {1, 2}
    assert {r.change_id: (r.outcome, r.has_review) for r in stream.table("outcomes").collect()} == {3: (0, True), 4: (1, False)}
    asked = {r.change_id: r.prompt_key for r in stream.table("requests").collect()}
    spark.createDataFrame([(asked[1], '{"findings": []}')], "prompt_key string, response string").write.parquet(f"{base}/responses")
    until_done(lambda: stream.responses(f"{base}/responses"))
    sums = [r for r in stream.table("requests").collect() if r.label == "summary"]
    assert [r.change_id for r in sums] == [1] and {r.change_id for r in stream.table("outcomes").collect()} == {3, 4}
    spark.createDataFrame([(sums[0].prompt_key, '{"summary": "fine so far", "overall_risk": "low", "pr_comment": "c"}'), (asked[2], "no json")], "prompt_key string, response string").write.mode("append").parquet(f"{base}/responses")
    until_done(lambda: stream.responses(f"{base}/responses"))
    assert not cut
    assert sorted((r.change_id, r.outcome, r.has_review) for r in stream.table("outcomes").collect()) == [(1, 4, True), (2, 2, False), (3, 0, True), (4, 1, False)]
    assert sorted((r.change_id, "fine so far" in r.json) for r in stream.table("reviews").collect()) == [(1, True), (3, False)]
    stream.catch_up("1")  # nobody waits
    assert stream.table("reviews").count() == 2
    cache.drop()


def test_empty_tables(spark):
    s = scan(spark)
    none = Scan(spark.createDataFrame([], "change_id long, diff_text string"))
    assert none.findings.count() == 0 and none.reviews().count() == 0 and none.artifacts().count() == 0
    assert s is not None


SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_responses_are_checked_once_and_by_many_tasks(spark):
    """No filter takes a copy of the check along, and the distinct ids' own exchange, which a few tasks would do for, isn't all there is."""
    p = plan(queries._model(spark, SF))
    assert p.count("parseJson") == 1 and "REPARTITION_BY_NUM" in p


def test_lines_are_sought_without_masking(spark):
    m, files, added = queries._sought(spark, SF)
    assert "MASKED" not in plan(added) and all("lineitem" not in plan(x) for x in (m, files))
    stats = plan(merging.validation_stats(m, files, added))
    assert stats.count("lineitem.parquet") == 1


def test_validation_stats_of_known_and_unknown_files(spark):
    files = spark.createDataFrame([(1, 0, "a.py"), (1, 1, "a.py"), (2, 0, "b.py")], "change_id long, file_no int, path string")
    added = spark.createDataFrame([(1, "a.py", 3)], "change_id long, path string, line_no int")
    f = frame(spark, finding(line=3), finding(line=4), finding(line=None), finding("b.py", 3), finding("b.py", None), finding("b.py", 1, change=2))
    got = {r.change_id: (r.unmappable_count, r.hallucinated_file_count, r.unmappable_lines, r.hallucinated_files) for r in merging.validation_stats(f, files, added).collect()}
    assert got == {1: (1, 2, ["a.py:4"], ["b.py", "b.py"]), 2: (1, 0, ["b.py:1"], [])}


def test_corpus_is_dealt_to_as_many_tasks_as_there_are(spark):
    """Its rows are few bytes, the texts made of them are not: coalesced by bytes they would meet in a few tasks."""
    assert "REPARTITION_BY_NUM" in plan(corpus.changes(spark, SF))


def test_artifacts_read_findings_that_are_written_once(spark):
    """Else every use of them, six in all, brings its own windows into the driver's plan."""
    s = Scan(stored(corpus.changes(spark, SF)), keep=stored)
    assert "Window" not in plan(s.findings) and plan(s.artifacts()).count("Window") == 0
